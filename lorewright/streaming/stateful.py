"""Sessions and caches as keyed state with timers.

Both need the RocksDB state store (`STATE_STORE`), which `prepare` sets. Time is the rows' own:
a timer fires when the watermark passes it, so a stream that is run again gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
SESSION = "session_id string, status string, n_messages int, last_user string, summary string, sources array<string>, updated_at timestamp"
LOOKUP = "cache_key string, status string, value string, ts timestamp"


def prepare(spark: SparkSession) -> None:
    spark.conf.set(*STATE_STORE)


def _ms(ts: datetime) -> int:
    return int(round(ts.timestamp() * 1000))


def _time(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, timezone.utc).replace(tzinfo=None)


class Sessions(StatefulProcessor):
    """The last messages of a session in a list, its sources in a map by first use, its last time in a value; a timer ends it."""

    def __init__(self, most: int, life_ms: int):
        self.most, self.life = most, life_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.messages = handle.getListState("messages", "ms long, turn int, role string, content string")
        self.sources = handle.getMapState("sources", "source string", "place int")
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802  the interface's names
        held = [tuple(m) for m in self.messages.get()]
        seen = {k[0]: v[0] for k, v in self.sources.iterator()}
        new = sorted((_ms(r["ts"]), int(r["turn"]), r["role"] or "", r["content"] or "", tuple(r["sources"] or ())) for r in rows)
        for *message, used in new:
            held.append(tuple(message))
            for s in used:
                if s is not None and s not in seen:
                    seen[s] = len(seen)
                    self.sources.updateValue((s,), (seen[s],))
        held = sorted(held)[-self.most :]
        self.messages.put(held)
        before = self.last.get()[0] if self.last.exists() else None
        last = max([m[0] for m in new] + ([before] if before is not None else []))
        self.last.update((last,))
        if self.life and last != before:
            if before is not None:
                self.handle.deleteTimer(before + self.life)
            self.handle.registerTimer(last + self.life)
        user = next((m[3] for m in reversed(held) if m[2] == "user"), None)
        yield Row(session_id=key[0], status="active", n_messages=len(held), last_user=user, summary="\n".join(f"{m[2]}: {m[3][:500]}" for m in held[-4:]), sources=sorted(seen, key=seen.get), updated_at=_time(last))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        last = self.last.get()[0] if self.last.exists() else 0
        n = len(list(self.messages.get()))
        self.messages.clear()
        self.sources.clear()
        self.last.clear()
        yield Row(session_id=key[0], status="expired", n_messages=n, last_user=None, summary="", sources=[], updated_at=_time(last))

    def close(self) -> None:
        pass


class Cache(StatefulProcessor):
    """A key's value with the time it was put; a timer ends it, and a get after its life misses whether or not the timer has fired."""

    def __init__(self, life_ms: int):
        self.life = life_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "value string, ms long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        value, since = tuple(self.held.get()) if self.held.exists() else (None, None)
        put = since
        # puts of a moment come before its gets
        for ms, kind, given in sorted((_ms(r["ts"]), 0 if r["kind"] == "put" else 1, r["value"] or "") for r in rows):
            if kind == 0:
                if put is None or ms >= put:
                    value, put = given, ms
            else:
                fresh = put is not None and put <= ms <= put + self.life
                yield Row(cache_key=key[0], status="hit" if fresh else "miss", value=value if fresh else None, ts=_time(ms))
        if put != since:
            if since is not None:
                self.handle.deleteTimer(since + self.life)
            self.held.update((value, put))
            self.handle.registerTimer(put + self.life)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        put = self.held.get()[1] if self.held.exists() else 0
        self.held.clear()
        yield Row(cache_key=key[0], status="expired", value=None, ts=_time(put + self.life))

    def close(self) -> None:
        pass


def sessions(messages: DataFrame, *, most: int = 20, life: float = 2 * 3600, late: str = "10 minutes") -> DataFrame:
    """(session_id, ts, turn, role, content, sources) -> a row for each session and batch that changed it, and one when it ends: see SESSION.

    A session holds its last `most` messages and ends `life` seconds after its last one (0: never).
    Rows later than the watermark, or without a session or time, are left out; a session that comes
    back after its end is a new one.
    """
    m = messages.where("session_id is not null and ts is not null").withWatermark("ts", late)
    m = m.select("session_id", "ts", F.coalesce("turn", F.lit(0)).cast("int").alias("turn"), "role", "content", "sources")
    return m.groupBy("session_id").transformWithState(Sessions(most, int(life * 1000)), SESSION, "append", "eventTime")


def lookups(events: DataFrame, *, life: float = 86_400, late: str = "10 minutes") -> DataFrame:
    """(cache_key, ts, kind 'put' or 'get', value) -> a row for each get (hit or miss) and for each value that ends `life` seconds after it was put: see LOOKUP."""
    e = events.where("cache_key is not null and ts is not null").withWatermark("ts", late)
    return e.select("cache_key", "ts", "kind", "value").groupBy("cache_key").transformWithState(Cache(int(life * 1000)), LOOKUP, "append", "eventTime")
