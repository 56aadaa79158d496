"""Steps that a model may take over from a heuristic."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lorewright.plans import models


@pytest.fixture(scope="module")
def rows(spark):
    data = [(1, "Qubits", "1 A > B", "Gates are reversible maps of states.", 7), (2, "Qubits", None, None, 8), (3, None, "C", "", 9)]
    return spark.createDataFrame(data, "chunk_id long, doc_title string, header_path string, content string, result int")


def test_without_a_provider_the_heuristic_stays_in_the_jvm(rows):
    out = models.take(rows, models.DIFFICULTY, "found")
    assert "Python" not in out._jdf.queryExecution().toString() and "InPandas" not in out._jdf.queryExecution().toString()
    assert [(r["chunk_id"], r["by_model"], r["result"]) for r in out.orderBy("chunk_id").collect()] == [(1, False, 7), (2, False, 8), (3, False, 9)]


def test_failing_models_and_null_texts_fall_back(rows):
    for step in (models.DIFFICULTY, models.SECTION, models.PREFIX, models.PROPOSITION, models.TRIPLES, models.SUMMARY):
        plain = models.take(rows, step, "found").select("chunk_id", F.to_json(F.struct("found")).alias("f")).collect()
        failed = models.take(rows, step, "found", lambda prompts: [None] * len(prompts))
        assert sorted(plain) == sorted(failed.select("chunk_id", F.to_json(F.struct("found")).alias("f")).collect())
        assert failed.where("by_model").isEmpty()
    spoken = models.take(rows, models.PREFIX, "found", lambda prompts: ["here"] * len(prompts)).orderBy("chunk_id").collect()
    assert [(r["found"], r["by_model"]) for r in spoken][::2] == [("here", True), ("here", True)] and not spoken[1]["by_model"]


def test_the_model_sees_task_and_columns(rows):
    seen = models.take(rows.where("chunk_id = 1"), models.PREFIX, "found", lambda prompts: prompts).first()["found"]
    assert seen.startswith(models.PREFIX.task) and "doc_title: Qubits" in seen and seen.endswith("Gates are reversible maps of states.")


def test_empty_table(rows):
    assert models.take(rows.limit(0), models.TRIPLES, "r", lambda p: p).isEmpty()


def test_statements_of_several_chunks_stay_once(spark):
    said = '["Measurement makes a qubit collapse at once.", "A gate is a reversible map of states, always."]'
    chunks = spark.createDataFrame([(1, "t", "h", said), (2, "t", "h", said), (3, "t", "h", "plain text")], "chunk_id long, doc_title string, header_path string, content string")
    echo = lambda prompts: [p.split("content: ")[-1] for p in prompts]
    got = {r["proposition_id"]: r["content"] for r in models.proposition_rows(chunks, echo).collect()}
    assert got == {"1_prop_001": "Measurement makes a qubit collapse at once.", "1_prop_002": "A gate is a reversible map of states, always.", "3_prop_001": "plain text"}


def test_queries_are_registered():
    assert {"udf4_image", "udf5_section", "udf8_triples", "res18_reflection"} <= set(entry.oracle_sql())
