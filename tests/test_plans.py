"""End-to-end flows, providers, streaming and the driver's entry."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lorewright.plans import library, providers
from lorewright.streaming import jobs


@pytest.fixture(scope="module")
def lib(spark):
    body = "El algoritmo de Shor factoriza números enteros en tiempo polinómico usando la transformada de Fourier cuántica y un qubit. "
    other = "El protocolo BB84 distribuye claves secretas con fotones polarizados entre dos personas que no se conocen. "
    fill = [(f"z{i}", f"Relleno {i}", f"# Tema {i}\n" + f"Materia {i} trata cosas número{i} distintas{i} de historia{i} y geografía{i} antigua{i}. " * 6) for i in range(6)]
    docs = spark.createDataFrame([("a", "Libro A", "# Shor\n" + body * 8), ("b", "Libro B", "# BB84\n" + other * 8)] + fill, "doc_id string, doc_title string, text string")
    return library.index(docs)


def test_retrieve(spark, lib):
    q = spark.createDataFrame([(0, "algoritmo de Shor factoriza"), (1, "protocolo BB84 claves")], "query_id int, query string")
    top = {r["query_id"]: r["doc_id"] for r in library.retrieve(q, lib, 3, vector_least=0.1).where("rank = 1").collect()}
    assert top == {0: "a", 1: "b"}


def test_ask_verify_cite(spark, lib, tmp_path):
    q = spark.createDataFrame([(0, "¿Qué es el algoritmo de Shor?")], "query_id int, query string")
    a = library.ask(q, lib).first()
    assert a["query_type"] == "explanatory"
    assert not a["abstained"]
    assert a["grounding"] > 0.5
    c = spark.createDataFrame([(1, "Shor factoriza números enteros")], "claim_id int, claim string")
    assert library.verify(c, lib).first()["status"] in ("supported", "partial")
    one = lib.chunks.where("level = 'micro'").first()["chunk_id"]
    assert library.cite(lib, [one, "none"]).count() == 1
    library.save(lib, str(tmp_path))
    assert library.load(spark, str(tmp_path)).chunks.count() == lib.chunks.count()
    assert library.stats(lib).count() == 9


def test_providers(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "id int, t string")
    v = {r["id"]: r["embedding"] for r in providers.embed(d, "t").collect()}
    assert abs(sum(x * x for x in v[1]) - 1) < 1e-5
    assert not any(v[2])
    with pytest.raises(ValueError, match="unknown provider"):
        providers.completions.pick("nobody")
    flaky = providers.retried(lambda p: p.upper(), workers=2)
    assert flaky(["x", "y"]) == ["X", "Y"]


def test_streaming_ingest(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.md").write_text("# T\n" + "x" * 80)
    for _ in range(2):
        jobs.ingest(jobs.read_files(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_streaming_sessions_and_ledger(spark, tmp_path):
    src = str(tmp_path / "m")
    spark.createDataFrame([("s", i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(14)], "session_id string, turn int, role string, content string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("session_id string, turn int, role string, content string").parquet(src)
    q = jobs.bounded_sessions(stream).writeStream.outputMode("update").format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    r = spark.sql("select * from sessions").first()
    assert (r["n_messages"], r["last_user"]) == (10, "t12")
    jobs.to_ledger(stream.withColumn("query", F.repeat("content", 100)), str(tmp_path / "ledger"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "ledger")).agg(F.max(F.length("query"))).first()[0] == 100


def test_entry(spark):
    known, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(known)
    assert entry.entry(spark).columns == ["query_id", "chunk_id", "score", "rank"]
