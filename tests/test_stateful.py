"""Streams with timers: each file is one batch, so the watermark moves from batch to batch."""

import datetime as dt

import pytest

from lorewright.streaming import stateful

AT = dt.datetime(2024, 1, 1)


def at(minutes):
    return AT + dt.timedelta(minutes=minutes)


@pytest.fixture
def run(spark, tmp_path):
    """Rows of a stream whose batches are given as lists, in the order of the batches."""

    def go(batches, schema, job):
        before = spark.conf.get(stateful.STATE_STORE[0], None)
        stateful.prepare(spark)
        try:
            out = str(tmp_path / "out")
            for i, rows in enumerate(batches):
                spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
                stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
                q = job(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
                q.awaitTermination()
            return spark.read.parquet(out).collect()
        finally:
            spark.conf.set(stateful.STATE_STORE[0], before) if before else spark.conf.unset(stateful.STATE_STORE[0])

    return go


MESSAGE = "session_id string, ts timestamp, turn int, role string, content string, sources array<string>"


def test_sessions_end_by_a_timer(run):
    say = lambda s, m, turn, role, text, src=None: (s, at(m), turn, role, text, src)
    batches = [
        [say("a", 0, 0, "user", "hi", ["x", "y"]), say("a", 1, 1, "assistant", "hello", ["y", "z"]), say("b", 0, 0, "user", "one"), (None, at(0), 0, "user", "lost", None)],
        [say("a", 20, 2, "user", "more"), say("a", 21, 3, "assistant", None), say("a", 22, 4, "user", "end")],
        [say("c", 100, 0, "user", "late comer")],
        [say("a", 110, 0, "user", "again"), say("c", 111, 1, "user", "x")],
        [say("d", 400, 0, "user", "last")],
    ]
    got = run(batches, MESSAGE, lambda s: stateful.sessions(s, most=3, life=3600, late="1 minute"))
    active = [(r["session_id"], r["n_messages"], r["last_user"], r["sources"]) for r in got if r["status"] == "active"]
    assert sorted(active) == sorted([("a", 2, "hi", ["x", "y", "z"]), ("b", 1, "one", []), ("a", 3, "end", ["x", "y", "z"]), ("c", 1, "late comer", []), ("a", 1, "again", []), ("c", 2, "x", []), ("d", 1, "last", [])])
    ended = sorted((r["session_id"], r["n_messages"], r["updated_at"]) for r in got if r["status"] == "expired")
    assert ended == [("a", 1, at(110)), ("a", 3, at(22)), ("b", 1, at(0)), ("c", 2, at(111))]
    assert [r["summary"] for r in got if r["n_messages"] == 3 and r["status"] == "active"] == ["user: more\nassistant: \nuser: end"]


EVENT = "cache_key string, ts timestamp, kind string, value string"


def test_cached_values_end(run):
    batches = [
        [("k", at(0), "put", "1"), ("k", at(5), "get", None), ("m", at(1), "get", None), (None, at(1), "get", None)],
        [("k", at(50), "put", "2"), ("k", at(70), "get", None)],
        [("k", at(109), "get", None), ("k", at(111), "get", None)],
        [("z", at(300), "get", None)],
        [("z", at(301), "get", None), ("k", at(302), "get", None)],
    ]
    got = run(batches, EVENT, lambda s: stateful.lookups(s, life=3600, late="1 minute"))
    seen = sorted((r["cache_key"], r["ts"], r["status"], r["value"]) for r in got)
    assert seen == sorted([("k", at(5), "hit", "1"), ("m", at(1), "miss", None), ("k", at(70), "hit", "2"), ("k", at(109), "hit", "2"), ("k", at(110), "expired", None), ("k", at(111), "miss", None), ("z", at(300), "miss", None), ("z", at(301), "miss", None), ("k", at(302), "miss", None)], key=lambda x: (x[0], x[1], x[2]))
