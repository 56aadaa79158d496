"""The branches that a query's replies reach."""


def test_relevance_replies_reach_model_and_fallback(spark, tmp_path):
    from lorewright.queries_cases import queries

    spark.createDataFrame([(i, "alpha beta gamma" + "." * i, "en", "s", 16 + i) for i in range(8)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"] % 4, r["result"], r["by_model"]) for r in queries()["udf11_relevance"](spark, str(tmp_path)).collect()}
    says = lambda verdict, sure: f'{{"result":{{"verdict":"{verdict}","confidence":{sure}}}}}'
    assert got == {(0, says("ambiguous", 0.5), True), (1, says("correct", 0.8), True), (2, says("incorrect", 0.0), False), (3, says("correct", 1.0), False)}
