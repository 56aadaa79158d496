"""Formula tables and provenance: formulas by fingerprint, relations, derivations, rewriting, and where results came from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewright.functions.algebra import equivalent, expression, renamed
from lorewright.functions.science import domain, formula_fingerprint
from lorewright.operators import graph
from lorewright.operators.expressions import classes
from lorewright.operators.lineage import cut

# Kinds of relations; the second can be walked both ways.
RELATIONS = [
    "derives_from", "equivalent", "special_case", "generalizes", "approximates", "defines", "component_of", "contradicts",
]


def extract(chunks: DataFrame, least: int = 3) -> DataFrame:
    """(chunk_id, content) -> formulas of each chunk, displayed ones first, with domain and fingerprint; short ones are left out."""
    shown = F.regexp_extract_all("content", F.lit(r"(?s)\$\$(.+?)\$\$"), F.lit(1))
    rest = F.regexp_replace("content", r"(?s)\$\$.+?\$\$", " ")
    found = F.concat(shown, F.regexp_extract_all(rest, F.lit(r"\$([^$\n]+)\$"), F.lit(1)))
    f = chunks.select("chunk_id", domain(F.col("content")).alias("domain"), F.posexplode(found).alias("ord", "latex")).withColumn("latex", F.trim("latex")).where(F.length("latex") >= least)
    return f.withColumn("fingerprint", formula_fingerprint(F.col("latex")))


def merge(found: DataFrame) -> DataFrame:
    """One row per formula text: its fingerprint, domain and chunks."""
    return found.groupBy("latex").agg(F.min("fingerprint").alias("fingerprint"), F.min("domain").alias("domain"), F.array_sort(F.collect_set("chunk_id")).alias("source_chunks"))


def structure(formulas: DataFrame) -> DataFrame:
    """Adds number of variables, and whether there are trigonometric or exponential functions."""
    plain = F.regexp_replace("latex", r"\\[A-Za-z]+", " ")
    names = F.array_distinct(F.regexp_extract_all(plain, F.lit("[A-Za-z]"), F.lit(0)))
    return formulas.withColumn("n_vars", F.size(names)).withColumn("has_trig", F.col("latex").rlike(r"\\(sin|cos|tan)\b")).withColumn("has_exp", F.col("latex").rlike(r"\\exp\b|e\^"))


def by_structure(formulas: DataFrame, n_vars: int | None = None, has_trig: bool | None = None, has_exp: bool | None = None, domain: str | None = None) -> DataFrame:
    """Formulas with all of the properties that are given."""
    for name, value in (("n_vars", n_vars), ("has_trig", has_trig), ("has_exp", has_exp), ("domain", domain)):
        if value is not None:
            formulas = formulas.where(F.col(name) == F.lit(value))
    return formulas


def matches(queries: DataFrame, formulas: DataFrame) -> DataFrame:
    """(query_id, latex): formulas with the query's fingerprint; `same` marks equal texts, the others are proposals."""
    q = queries.select("query_id", F.col("latex").alias("asked"), formula_fingerprint(F.col("latex")).alias("fingerprint"))
    return q.join(formulas, "fingerprint").select("query_id", "latex", "source_chunks", (F.col("asked") == F.col("latex")).alias("same"))


def equal_formulas(queries: DataFrame, formulas: DataFrame, equalities: DataFrame | None = None) -> DataFrame:
    """(query_id, latex) and stored (latex) -> (query_id, latex): formulas that are the query's up to the order of sums and products and up to names; with `equalities` (lhs, rhs, verified relations between expressions) names count and equals may stand for each other.

    Formulas that are no arithmetic expression match nothing.
    """
    every = cut(queries.select(F.col("query_id").cast("string").alias("query_id"), "latex").unionByName(formulas.select(F.lit(None).cast("string").alias("query_id"), "latex").distinct()).withColumn("id", F.monotonically_increasing_id()))
    of = cut(classes(every.select("id", expression(F.col("latex")).alias("expression")), equalities, names=equalities is not None).join(every, "id"))
    asked = of.where("query_id is not null").select(F.col("query_id").cast(dict(queries.dtypes)["query_id"]).alias("query_id"), "class")
    return asked.join(of.where("query_id is null").select("class", "latex"), "class").select("query_id", "latex").distinct()


def with_formulas(hits: DataFrame, found: DataFrame) -> DataFrame:
    """Hits with the formulas of their chunks."""
    f = found.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "latex"))), lambda x: x["latex"]).alias("formulas"))
    return hits.join(f, "chunk_id", "left").withColumn("formulas", F.coalesce("formulas", F.array().cast("array<string>")))


def derivations(pairs: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """(src, dst) -> path with the fewest relations; only `equivalent` ones can be walked backwards."""
    e = edges.select("src", "dst").unionByName(edges.where("relation = 'equivalent'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    e = cut(e.select(F.col("src").alias("at"), F.col("dst").alias("to")))
    front = pairs.select("src").distinct().select("src", F.col("src").alias("at"), F.array("src").alias("path"))
    seen = front
    for _ in range(most):
        step = front.join(e, "at").groupBy("src", F.col("to").alias("at")).agg(F.min(F.concat("path", F.array("to"))).alias("path"))
        front = cut(step.join(seen.select("src", "at"), ["src", "at"], "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return pairs.join(seen.withColumnRenamed("at", "dst"), ["src", "dst"]).select("src", "dst", "path")


def rewrite(expressions: DataFrame, rules: DataFrame, most: int = 10) -> DataFrame:
    """(id, expression) with rules (rule_id, lhs, rhs, verified, bidirectional): steps until no verified rule leads to a new expression.

    A rule proposed by the fingerprint applies where its side is the expression itself but for the names of variables, one
    name for another throughout; its other side is then given in the expression's names. The first rule by rule_id, its left
    side first, wins.
    """
    r = rules.where("verified").select("rule_id", F.lit(0).alias("way"), "lhs", "rhs")
    r = r.unionByName(rules.where("verified AND bidirectional").select("rule_id", F.lit(1).alias("way"), F.col("rhs").alias("lhs"), F.col("lhs").alias("rhs")))
    r = cut(r.withColumn("fp", formula_fingerprint(F.col("lhs"))))
    now = expressions.select("id", F.col("expression").alias("current"), F.array("expression").alias("seen"))
    steps = None
    for k in range(1, most + 1):
        fits = now.withColumn("fp", formula_fingerprint(F.col("current"))).join(r, "fp").withColumn("rhs", renamed(F.col("lhs"), F.col("current"), F.col("rhs")))
        fits = fits.where(F.col("rhs").isNotNull() & ~F.array_contains("seen", F.col("rhs")))
        best = fits.groupBy("id").agg(F.min_by(F.struct("rule_id", "rhs", "seen"), F.struct("rule_id", "way")).alias("b"))
        best = cut(best.select("id", F.lit(k).alias("step"), "b.rule_id", F.col("b.rhs").alias("expression"), F.concat("b.seen", F.array("b.rhs")).alias("seen")))
        if best.isEmpty():
            break
        done = best.drop("seen")
        steps = done if steps is None else steps.unionByName(done)
        now = best.select("id", F.col("expression").alias("current"), "seen")
    return steps if steps is not None else expressions.select("id", F.lit(0).alias("step"), F.lit("").alias("rule_id"), "expression").limit(0)


def add_formulas(store: DataFrame, found: DataFrame) -> DataFrame:
    """Formulas (latex, fingerprint, domain, source_chunks) with those of `found` (as `extract` gives) merged in: chunks are united, the store's fingerprint and domain stay."""
    new = merge(found).withColumn("_new", F.lit(1))
    every = store.select("latex", "fingerprint", "domain", "source_chunks").withColumn("_new", F.lit(0)).unionByName(new)
    return every.groupBy("latex").agg(F.min_by("fingerprint", "_new").alias("fingerprint"), F.min_by("domain", "_new").alias("domain"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_chunks")))).alias("source_chunks"))


def add_relations(store: DataFrame, found: DataFrame) -> DataFrame:
    """Relations (src, dst, relation, verified), one of each kind between two formulas; verified as soon as one row says so, and unknown kinds are left out. Where `lhs` and `rhs` come with the new ones, equivalences are tried on numbers."""
    if {"lhs", "rhs"} <= set(found.columns):
        found = found.withColumn("verified", F.col("verified") | ((F.col("relation") == "equivalent") & F.coalesce(equivalent(F.col("lhs"), F.col("rhs"))["passed"], F.lit(False))))
    cols = ["src", "dst", "relation", "verified"]
    every = store.select(cols).unionByName(found.select(cols)).where(F.col("relation").isin(RELATIONS))
    return every.groupBy("src", "dst", "relation").agg(F.max("verified").alias("verified"))


def add_rules(store: DataFrame, new: DataFrame) -> DataFrame:
    """Rules (rule_id, lhs, rhs, verified, bidirectional): a new one replaces the one of its id; what is not verified yet is, where both sides agree on numbers."""
    tried = new.withColumn("verified", F.col("verified") | F.coalesce(equivalent(F.col("lhs"), F.col("rhs"))["passed"], F.lit(False)))
    return store.join(tried.select("rule_id"), "rule_id", "left_anti").unionByName(tried)


# -- provenance: activities (activity_id, used[], generated[], agent_id) and derivations (entity, source)


def provenance_edges(activities: DataFrame, derived: DataFrame) -> DataFrame:
    """(entity, source): what was generated goes back to all that its activity used, and to what it is said to derive from."""
    made = activities.select(F.explode("generated").alias("entity"), "used").select("entity", F.explode("used").alias("source"))
    return made.unionByName(derived.select("entity", "source")).distinct()


def origins(activities: DataFrame, derived: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """Everything that each start goes back to, and whether it is an origin itself."""
    e = cut(provenance_edges(activities, derived))
    back = graph.lineage(e, starts, most)
    return back.join(e.select("entity").distinct().withColumn("inner", F.lit(True)), "entity", "left").select("start", "entity", "distance", F.col("inner").isNull().alias("is_origin"))
