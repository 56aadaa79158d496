"""Checks and edits of generated answers, as Spark columns: citations, claims, criticism, support, compression."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_whitespace, excerpt, strip, strip_accents, token_estimate

CITATION = r"\[(\d+(?:[-,]\d+)*)\]"
SENTENCE_END = r"(?<=[.!?])\s+"


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_END), strip), lambda s: s != "")


def cited(text: Column) -> Column:
    """All cited numbers in order, ranges spelt out, repetitions included."""
    part = lambda p: F.when(F.contains(p, F.lit("-")), F.when(
        F.split(p, "-")[0].cast("int") <= F.split(p, "-")[1].cast("int"), F.sequence(F.split(p, "-")[0].cast("int"), F.split(p, "-")[1].cast("int")))
        .otherwise(F.array().cast("array<int>"))).otherwise(F.array(p.cast("int")))
    groups = F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))
    return F.flatten(F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, ","))), part))


def valid_citations(text: Column, n_sources: Column) -> Column:
    """Distinct cited numbers that a source has, in order of their first use."""
    return F.array_distinct(F.filter(cited(text), lambda i: i <= n_sources))


def citation_report(text: Column, n_sources: Column) -> Column:
    """{valid, invalid, used, coverage} of an answer's citations."""
    every = cited(text)
    invalid = F.filter(every, lambda i: i > n_sources)
    used = F.array_sort(valid_citations(text, n_sources))
    coverage = F.when(n_sources > 0, F.size(used) / n_sources).otherwise(F.lit(0.0))
    return F.struct((F.size(invalid) == 0).alias("valid"), invalid.alias("invalid"), used.alias("used"), coverage.alias("coverage"))


def uncited(text: Column, titles: Column) -> Column:
    """Titles of the sources that are never cited, in order."""
    every = F.when(F.size(titles) > 0, F.sequence(F.lit(1), F.size(titles))).otherwise(F.array().cast("array<int>"))
    return F.transform(F.array_except(every, cited(text)), lambda i: F.element_at(titles, i))


def bibliography_entry(index: Column, title: Column, path: Column) -> Column:
    return F.concat(F.lit("["), index.cast("string"), F.lit("] "), F.concat_ws(", ", title, path))


# Words that don't count when a sentence is compared with a source.
OVERLAP_STOPWORDS = ["el", "la", "los", "las", "un", "una", "de", "en", "que", "y", "a", "es", "se"]


def overlap_words(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return F.array_except(words, F.array(*[F.lit(w) for w in OVERLAP_STOPWORDS]))


def best_source(sentence: Column, sources: Column, least: int = 3) -> Column:
    """Position (from 1) of the source with the most distinct words in common, the first on ties; null below `least`."""
    mine = overlap_words(sentence)
    sizes = F.transform(sources, lambda s: F.size(F.array_intersect(mine, overlap_words(s))))
    top = F.array_max(sizes)
    return F.when(top >= least, F.array_position(sizes, top).cast("int"))


def inject_citations(text: Column, sources: Column) -> Column:
    """Marks each sentence with its best source, before its final mark."""

    def mark(s: Column) -> Column:
        n = best_source(s, sources)
        tag = F.concat(F.lit(" ["), n.cast("string"), F.lit("]"))
        cut = F.length(s) - 1
        ended = F.concat(F.substring(s, F.lit(1), cut), tag, F.substring(s, F.length(s), F.lit(1)))
        return F.when(n.isNull(), s).when(s.rlike(r"[.!?]$"), ended).otherwise(F.concat(s, tag))

    return F.when(F.size(sources) == 0, text).otherwise(F.array_join(F.transform(sentences(text), mark), " "))


def cite(style: str, title: Column, section: Column, number: Column) -> Column:
    """A reference in one of the styles apa, ieee, chicago, markdown or inline (also for unknown ones)."""
    has = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    sec, num = has(section), has(number)
    mark = F.concat(F.lit("§"), num)
    if style == "apa":
        return F.concat_ws(", ", title, mark, F.concat(F.lit("("), sec, F.lit(")")))
    if style == "ieee":
        return F.concat_ws(", ", F.concat(F.lit('"'), title, F.lit('"')), F.concat(F.lit("sec. "), num), sec)
    if style == "chicago":
        return F.concat(F.concat_ws(", ", title, F.concat(F.lit('"'), sec, F.lit('"')), mark), F.lit("."))
    if style == "markdown":
        return F.concat_ws(" - ", F.concat(F.lit("**"), title, F.lit("**")), F.concat(F.lit("*"), sec, F.lit("*")), mark)
    return F.concat_ws(" — ", title, sec, mark)


def rich_citation(title: Column, hierarchy: Column, header_path: Column, number: Column) -> Column:
    """Title, the first two levels of the hierarchy (or the header path), and the section number."""
    where = F.when(F.size(hierarchy) > 0, F.array_join(F.slice(hierarchy, 1, 2), " > ")).otherwise(F.nullif(header_path, F.lit("")))
    return F.concat_ws(" — ", title, where, F.concat(F.lit("§"), F.nullif(number, F.lit(""))))


# a claim begins where its run of characters does; saying so keeps the search linear
CLAIM = r"(?<![^.!?\[\]])([^.!?\[\]]+)\s*\[(\d+(?:\s*,\s*\d+)*)\]"
# Beginnings of sentences that claim nothing.
CONNECTIVES = ("en resumen", "por lo tanto", "así", "es decir", "además")


def claims(text: Column) -> Column:
    """Claims with the numbers they cite."""
    whole = F.regexp_extract_all(text, F.lit(CLAIM), F.lit(0))
    ids = lambda c: F.transform(F.split(F.regexp_extract(c, CLAIM, 2), r"\s*,\s*"), lambda n: n.cast("int"))
    return F.transform(whole, lambda c: F.struct(F.trim(F.regexp_extract(c, CLAIM, 1)).alias("claim"), ids(c).alias("citations")))


def uncited_claims(text: Column) -> Column:
    """The first five sentences of more than 30 characters without citation that no connective opens, cut to 100."""
    parts = F.transform(F.split(text, "[.!?]"), strip)
    opens = lambda s: reduce(lambda a, b: a | b, [F.startswith(F.lower(s), F.lit(c)) for c in CONNECTIVES])
    keep = F.filter(parts, lambda s: (F.length(s) > 30) & ~s.rlike(r"\[\d+\]") & ~opens(s))
    return F.slice(F.transform(keep, lambda s: F.substring(s, 1, 100)), 1, 5)


# Words that don't count for the support of a claim.
SUPPORT_STOPWORDS = ["esta", "esto", "como", "para", "desde", "sobre", "entre", "cuando"]


def keywords(text: Column, least: int) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w{%d,}\b" % least), F.lit(0)))


def claim_support(claim: Column, source: Column) -> Column:
    """{is_supported, support_score, ratio}: the share of the claim's keywords that the source contains; from one half on it is support."""
    words = F.array_except(keywords(claim, 4), F.array(*[F.lit(w) for w in SUPPORT_STOPWORDS]))
    low = F.lower(source)
    ratio = F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: F.contains(low, w))) / F.size(words)).otherwise(F.lit(0.0))
    return F.struct((ratio >= 0.5).alias("is_supported"), F.least(ratio * 1.2, F.lit(1.0)).alias("support_score"), ratio.alias("ratio"))


def supporting_passage(claim: Column, source: Column) -> Column:
    """The source's sentence with the most of the claim's keywords, the first on ties, at most 300 characters; empty where none has any."""
    words = F.array_except(keywords(claim, 4), F.array(*[F.lit(w) for w in SUPPORT_STOPWORDS]))
    parts = F.split(source, r"\.")
    hits = F.transform(parts, lambda s: F.size(F.filter(words, lambda w: F.contains(F.lower(s), w))))
    top = F.array_max(hits)
    return F.when(top > 0, F.substring(F.trim(F.element_at(parts, F.array_position(hits, top).cast("int"))), 1, 300)).otherwise(F.lit(""))


def relevance_overlap(query: Column, content: Column) -> Column:
    """Share of the query's terms (three characters or more, without accents) that the content has."""
    terms = lambda c: F.array_distinct(F.regexp_extract_all(strip_accents(F.lower(c)), F.lit(r"(?U)\b\w{3,}\b"), F.lit(0)))
    q = terms(query)
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, terms(content))) / F.size(q))


def verdict(overlap: Column, correct: float = 0.7, incorrect: float = 0.3) -> Column:
    return F.when(overlap >= correct, F.lit("correct")).when(overlap <= incorrect, F.lit("incorrect")).otherwise(F.lit("ambiguous"))


def correction(incorrect_share: Column) -> Column:
    return F.when(incorrect_share <= 0.2, F.lit("pass")).when(incorrect_share >= 0.5, F.lit("reformulate")).otherwise(F.lit("filter"))


# -- criticism of an answer

# Penalty of an issue by severity.
PENALTIES = {"low": 0.1, "medium": 0.25, "high": 0.4}
# A claim as the critic reads it.
CRITIC_CLAIM = r"(?:(?<![^.!?\n])|\G)([^.!?\n]+?)(?:\s*\[(\d+(?:,\s*\d+)*)\])"
NUMBER = r"\b\d+(?:\.\d+)?\b"


def source_coverage(answer: Column, n_sources: Column) -> Column:
    """Share of the sources that the answer cites as [n]; 1 without sources."""
    used = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda n: n.cast("int")), lambda i: (i >= 1) & (i <= n_sources)))
    return F.when(n_sources == 0, F.lit(1.0)).otherwise(F.size(used) / n_sources)


def grounding(answer: Column, sources: Column) -> Column:
    """Share of the answer's words (five letters or more, with repetitions) that some source has; one half where there is nothing to compare."""
    long = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b\w{5,}\b"), F.lit(0))
    known = F.array_distinct(F.flatten(F.transform(sources, long)))
    words = long(answer)
    return F.when((F.size(sources) == 0) | (F.size(words) == 0), F.lit(0.5)).otherwise(F.size(F.filter(words, lambda w: F.array_contains(known, w))) / F.size(words))


def completeness(answer: Column, query: Column) -> Column:
    terms = keywords(query, 4)
    return F.when(F.size(terms) == 0, F.lit(1.0)).otherwise(F.size(F.filter(terms, lambda t: F.contains(F.lower(answer), t))) / F.size(terms))


def unknown_numbers(answer: Column, sources: Column) -> Column:
    """The first three numbers of two characters or more that no source has."""
    numbers = lambda c: F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0))
    known = F.flatten(F.transform(sources, numbers))
    return F.slice(F.filter(numbers(answer), lambda n: (F.length(n) > 1) & ~F.array_contains(known, n)), 1, 3)


def citation_issues(answer: Column, sources: Column) -> Column:
    """{claim, citation, severity} for citations of sources that don't exist or share less than 30 % of the claim's keywords."""
    whole = F.regexp_extract_all(answer, F.lit(CRITIC_CLAIM), F.lit(0))

    def issues(c: Column) -> Column:
        claim = F.trim(F.regexp_extract(c, CRITIC_CLAIM, 1))
        words = keywords(claim, 5)

        def judge(n: Column) -> Column:
            missing = (n < 1) | (n > F.size(sources))
            text = F.lower(F.get(sources, n - 1))
            share = F.size(F.filter(words, lambda w: F.contains(text, w))) / F.size(words)
            severity = F.when(missing, F.lit("high")).when((F.size(words) > 0) & (share < 0.3), F.when(share > 0.1, F.lit("medium")).otherwise(F.lit("high")))
            return F.struct(claim.alias("claim"), n.alias("citation"), severity.alias("severity"))

        return F.transform(F.transform(F.split(F.regexp_extract(c, CRITIC_CLAIM, 2), r",\s*"), lambda n: n.cast("int")), judge)

    return F.filter(F.flatten(F.transform(whole, issues)), lambda i: i["severity"].isNotNull())


def critique_score(penalty: Column, coverage: Column, grounded: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - penalty) * 0.4 + coverage * 0.3 + grounded * 0.3


# -- compression

# Words that make a sentence important.
IMPORTANT = [
    "qubit", "quantum", "cuántico", "entrelazamiento", "entanglement", "superposición", "superposition", "medición", "measurement", "estado", "state",
    "gate", "puerta", "circuito", "circuit", "algoritmo", "algorithm", "protocolo", "protocol", "teorema", "theorem", "lema", "lemma", "definición",
    "definition", "demostración", "proof", "corolario", "corollary", "ecuación", "equation", "fórmula", "formula", "clave", "key", "seguridad",
    "security", "error", "corrección", "código", "code", "canal", "channel", "información", "information",
]


def importance(sentence: Column) -> Column:
    """0 to 1: distinct important words over 5, less for very short and very long sentences, more for formulas and citations."""
    words = F.array_distinct(F.filter(F.split(F.lower(sentence), r"\s+"), lambda w: w != ""))
    hits = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in IMPORTANT])))
    factor = F.when(F.size(words) < 5, 0.5).when(F.size(words) > 50, 0.8).otherwise(1.0)
    bonus = F.when(F.contains(sentence, F.lit("$")), 0.3).otherwise(0.0) + F.when(sentence.rlike(r"\[\d+\]"), 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), hits / 5 * factor + bonus)


def compress_medium(text: Column, least: float = 0.3) -> Column:
    """Cleaned text with the sentences of enough importance (for texts without code or formulas; see `compress`)."""
    parts = F.split(F.trim(clean_whitespace(text)), SENTENCE_END)
    return F.array_join(F.filter(parts, lambda s: importance(s) >= least), " ")


def compression_level(tokens: Column, budget: int = 4000) -> Column:
    """none where the contexts fit, else by the ratio that is needed."""
    ratio = budget / tokens
    return F.when(tokens <= budget, F.lit("none")).when(ratio > 0.8, F.lit("light")).when(ratio > 0.5, F.lit("medium")).otherwise(F.lit("aggressive"))


def compressor(level: str, ratio: float = 0.5, least: float = 0.3):
    """A vectorised function that compresses whole texts; code and formulas pass as one unbroken word each."""
    import re

    shielded = re.compile(r"```.*?```|\$\$[^$]+\$\$|\$[^$]+\$", re.DOTALL)
    end = re.compile(SENTENCE_END)

    def tidy(t: str) -> str:
        t = re.sub(r"\n{3,}", "\n\n", re.sub(" +", " ", t))
        return "\n".join(x.strip() for x in t.split("\n")).strip()

    def weight(s: str) -> float:
        words = set(s.lower().split())
        factor = 0.5 if len(words) < 5 else 0.8 if len(words) > 50 else 1.0
        return min(1.0, len(words.intersection(IMPORTANT)) / 5 * factor + 0.3 * ("$" in s) + 0.2 * bool(re.search(r"\[\d+\]", s)))

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        held: list[str] = []

        def hide(m):
            held.append(m[0])
            return f"\ue000{len(held) - 1}\ue001"

        t = tidy(shielded.sub(hide, text))
        if level in ("medium", "aggressive"):
            parts = end.split(t)
            if level == "medium":
                parts = [p for p in parts if weight(p) >= least]
            else:
                room, kept = int(len(t) // 3 * ratio), set()
                for i in sorted(range(len(parts)), key=lambda i: -weight(parts[i])):
                    if len(parts[i]) // 3 <= room:
                        room -= len(parts[i]) // 3
                        kept.add(i)
                parts = [p for i, p in enumerate(parts) if i in kept]
            t = " ".join(parts)
        return tidy(re.sub("\ue000(\\d+)\ue001", lambda m: held[int(m[1])], t))

    def compress(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return F.pandas_udf(compress, "string")


def excerpt_of(content: Column) -> Column:
    return excerpt(F.trim(content))


def within_budget(tokens_before: Column, tokens: Column, budget: int = 4000) -> Column:
    return tokens_before + tokens <= budget


def tokens_of(text: Column) -> Column:
    return token_estimate(text)


def section_citation(doc_title: Column, hierarchy: Column, number: Column) -> Column:
    """Title, the first two levels and the section's number, unless a level has it already."""
    levels = F.array_join(F.slice(hierarchy, 1, 2), ", ")
    mark = F.when((F.coalesce(number, F.lit("")) != "") & ~F.contains(F.array_join(hierarchy, "\n"), number), F.concat(F.lit("§"), number))
    return F.concat_ws(" — ", doc_title, F.nullif(levels, F.lit("")), mark)
