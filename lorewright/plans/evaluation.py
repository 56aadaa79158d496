"""Evaluation of answers: a runner over a suite of cases, stand-ins for model judges, and the report."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewright.operators import records
from lorewright.operators.lineage import cut


def overlap(a: Column, b: Column) -> Column:
    """Share of a's words of four letters or more that b has; null without any."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(a), F.lit(r"[\p{L}\p{N}_]{4,}"), F.lit(0)))
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: F.contains(F.lower(b), w))) / F.size(words))


def judge(answered: DataFrame) -> DataFrame:
    """(query, answer, sources, ground_truth): overlap stand-ins under the judges' names, each null where it has nothing to go by, and the overall score."""
    told = F.array_join("sources", "\n")
    some = F.size("sources") > 0
    useful = F.size(F.filter("sources", lambda s: overlap(F.col("query"), s) >= 0.5))
    out = answered.withColumn("faithfulness", F.when(some, overlap(F.col("answer"), told))).withColumn("answer_relevancy", overlap(F.col("query"), F.col("answer")))
    out = out.withColumn("context_precision", F.when(some, useful / F.size("sources"))).withColumn("context_recall", F.when(some, overlap(F.col("ground_truth"), told)))
    return out.withColumn("overall_score", records.overall_score())


def run(cases: DataFrame, rag: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(case_id, query, ground_truth, category) through `rag` ((query_id, query) -> (query_id, answer, sources)): judged answers with the mean latency of a case. Empty queries get no answer."""
    asked = cases.where(F.length(F.trim("query")) > 0).select(F.col("case_id").alias("query_id"), "query")
    n = asked.count()
    began = time.perf_counter()
    told = cut(rag(asked).select(F.col("query_id").alias("case_id"), "answer", "sources"))
    spent = (time.perf_counter() - began) * 1000 / max(1, n)
    both = cases.join(told, "case_id", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))
    return judge(both.withColumn("latency_ms", F.when(F.col("answer").isNotNull(), F.lit(spent))))


METRICS = ["faithfulness", "answer_relevancy", "context_precision", "context_recall"]


def report(results: DataFrame, title: str, shown: int = 200) -> str:
    """A Markdown report: metrics, latency, and the first `shown` cases of the categories. The summaries are aggregates; only cases that are printed come to the driver."""
    lines = [f"# Benchmark Report: {title}", f"**Total Cases:** {results.count()}", "## Overall Metrics", "| Metric | Mean | Min | Max | Count |", "|--------|------|-----|-----|-------|"]
    for r in records.metric_summary(results, METRICS).where("n > 0").orderBy("metric").collect():
        lines.append(f"| {r['metric']} | {r['mean']:.3f} | {r['min']:.3f} | {r['max']:.3f} | {r['n']} |")
    late = records.latency_summary(results).first()
    if late["n"]:
        lines += ["## Latency Statistics", *[f"- **{k.capitalize()}:** {late[k]:.0f}ms" for k in ("mean", "min", "max")]]
    last = None
    for r in results.orderBy("category", "case_id").limit(shown).collect():
        if r["category"] != last:
            last = r["category"]
            lines.append(f"## Category: {last}")
        lines += [f"### Query: {r['query'][:60]}{'...' if len(r['query']) > 60 else ''}", f"- **Overall Score:** {r['overall_score']:.3f}"]
        if r["answer"]:
            lines.append(f"> {r['answer'][:200]}{'...' if len(r['answer']) > 200 else ''}")
    return "\n\n".join(lines)


def reference(index: Column, style: str = "inline") -> Column:
    """A citation mark: [n], [^n] for footnotes, (n) for endnotes; unknown styles are inline."""
    return F.format_string({"footnote": "[^%s]", "endnote": "(%s)"}.get(style, "[%s]"), index.cast("string"))


def linked(text: Column, sources: Column, base_url: str | None = None) -> Column:
    """The first mark of each cited source as a link, and the references with anchors; sources: array of {chunk_id, doc_title, header_path}, marks count from 1."""
    numbered = F.transform(sources, lambda s, i: F.struct((i + 1).cast("string").alias("n"), s.alias("s")))
    cited = F.filter(numbered, lambda x: F.contains(text, F.concat(F.lit("["), x["n"], F.lit("]"))))

    def link(out: Column, x: Column) -> Column:
        mark = F.concat(F.lit("["), x["n"], F.lit("]"))
        to = F.concat(F.lit(f"({base_url}#"), x["s"]["chunk_id"], F.lit(")")) if base_url else F.concat(F.lit("(#ref-"), x["n"], F.lit(")"))
        at = F.position(mark, out)
        return F.when(at > 0, F.concat(F.substr(out, F.lit(1), at - 1), mark, to, F.substr(out, at + F.length(mark)))).otherwise(out)

    body = F.aggregate(cited, text, link)
    entry = lambda x: F.concat(F.lit("\n<a id='ref-"), x["n"], F.lit("'></a>**["), x["n"], F.lit("]** "), x["s"]["doc_title"], F.lit(" — _"), x["s"]["header_path"], F.lit("_"))
    return F.when(F.size(cited) > 0, F.concat(body, F.lit("\n\n---\n\n**Referencias:**\n"), F.array_join(F.transform(cited, entry), ""))).otherwise(text)
