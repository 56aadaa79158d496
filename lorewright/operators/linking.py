"""Which names stand in which texts, and which names a text is part of, without comparing all with all.

Names in texts: the names are dealt into groups of bounded size, each a trie with failure links that
reads a block of texts once, whatever the number of names. Texts in names: names are posted under
their runs of three characters, a text asks for its rarest run, and only those names are compared;
each distinct text once, whatever the number of queries that ask for it.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewright.operators.lineage import cut
from lorewright.operators.retrieval import against

#: Characters of the names of one trie, and of the texts that it reads at a time.
NAME_CHARS, TEXT_CHARS = 100_000, 4_000_000
RUN = 3
#: Names of a part, queries of a block, and names that a task lists at a time.
NAMES, QUERIES, LISTED = 16_384, 256, 1_000_000


class Trie:
    """Names as paths of characters; `fail` leads to the longest other beginning that the path ends with, `back` to the next name on that way."""

    def __init__(self, names: list[str]):
        self.step: list[dict[str, int]] = [{}]
        self.name: list[str | None] = [None]
        for n in names:
            at = 0
            for c in n:
                if c not in self.step[at]:
                    self.step[at][c] = len(self.step)
                    self.step.append({})
                    self.name.append(None)
                at = self.step[at][c]
            self.name[at] = n
        self.fail, self.back = [0] * len(self.step), [0] * len(self.step)
        todo = deque(self.step[0].values())
        while todo:
            at = todo.popleft()
            for c, to in self.step[at].items():
                f = self.fail[at]
                while f and c not in self.step[f]:
                    f = self.fail[f]
                self.fail[to] = self.step[f][c] if c in self.step[f] and self.step[f][c] != to else 0
                todo.append(to)
            f = self.fail[at]
            self.back[at] = f if self.name[f] is not None else self.back[f]

    def found(self, text: str) -> set[str]:
        step, fail, at, ends = self.step, self.fail, 0, set()
        for c in text:
            while at and c not in step[at]:
                at = fail[at]
            at = step[at].get(c, 0)
            ends.add(at)
        out = set()
        for at in ends:
            while at:
                if self.name[at] is not None:
                    if self.name[at] in out:
                        break  # and with it all that follow
                    out.add(self.name[at])
                at = self.back[at]
        return out


def names_in_texts(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, text) and (name) -> (query_id, name) of the names that are part of a text. Empty and null names are in none; query_id may repeat, pairs are distinct."""
    n = names.select("name").where("name is not null and name != ''").distinct()
    t = texts.select("query_id", "text").where("text is not null and query_id is not null")
    chars = lambda d, c: d.agg(F.coalesce(F.sum(F.length(c)), F.lit(0))).first()[0]
    groups, blocks = max(1, -(-chars(n, "name") // NAME_CHARS)), max(1, -(-chars(t, "text") // TEXT_CHARS))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    n = n.withColumn("group", F.pmod(F.xxhash64("name"), F.lit(groups)).cast("int")).withColumn("block", every(blocks))
    t = t.withColumn("block", F.pmod(F.xxhash64("query_id", "text"), F.lit(blocks)).cast("int")).withColumn("group", every(groups))
    kind = dict(texts.dtypes)["query_id"]

    def read(left: pa.Table, right: pa.Table) -> pa.Table:
        at, out = [], []
        if left.num_rows and right.num_rows:
            trie = Trie(right.column("name").to_pylist())
            for i, text in enumerate(left.column("text")):
                for name in sorted(trie.found(text.as_py())):
                    at.append(i)
                    out.append(name)
        return pa.table({"query_id": left.column("query_id").take(pa.array(at, pa.int64())), "name": pa.array(out, pa.string())})

    return t.groupBy("group", "block").cogroup(n.groupBy("group", "block")).applyInArrow(read, f"query_id {kind}, name string").distinct()


def runs_of(text: Column, size: int = RUN) -> Column:
    """The distinct runs of `size` characters, none for a shorter text."""
    n = F.length(text)
    return F.when(n >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def numbered(names: DataFrame, n: int, size: int) -> DataFrame:
    """(name, part, at): distinct names in order, `size` to a part; n is about how many there are."""
    s = cut(names.repartitionByRange(max(1, -(-n // size)), "name").sortWithinPartitions("name").withColumn("_id", F.monotonically_increasing_id()))
    s = s.select("name", F.shiftright("_id", 33).alias("_p"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_i"))
    # one row for each range of names
    before = s.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_p")) - F.col("_n"))
    place = F.col("_before") + F.col("_i")
    return cut(s.join(F.broadcast(before), "_p").select("name", F.floor(place / size).cast("int").alias("part"), F.pmod(place, F.lit(size)).cast("int").alias("at")))


def _matches(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(text) and (name, part, at) -> (text, part, at) of the names that a text is part of; texts are distinct."""
    found = []
    # texts shorter than a run are posted under runs of their own length
    for size in range(1, RUN + 1):
        mine = texts.where(F.length("text") == size) if size < RUN else texts.where(F.length("text") >= size)
        asked = mine.select("text", F.explode(runs_of(F.col("text"), size)).alias("run"))
        posted = names.select("*", F.explode(runs_of(F.col("name"), size)).alias("run"))
        often = posted.groupBy("run").agg(F.count("*").alias("_n"))
        # a run that no name has ends the search
        rare = asked.join(often, "run", "left").groupBy("text").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "run")).alias("_r")).where("_r.n > 0")
        found.append(posted.join(rare.select("text", F.col("_r.run").alias("run")), "run").where(F.contains(F.col("name"), F.col("text"))).select("text", "part", "at"))
    return reduce(lambda a, b: a.unionByName(b), found)


def _lists(texts: DataFrame, names: DataFrame) -> tuple[DataFrame, int]:
    """(query_id, part, names), and how many parts there are: of each query and part of the names those that one of its texts is part of, in order.

    A text that many queries ask for is looked up once. Blocks of queries meet parts of the names,
    where each text marks its names, so a name that many of a query's texts are part of is one mark.
    """
    n = names.select("name").where("name is not null and name != ''").distinct()
    n = numbered(n, n.count(), NAMES)
    parts = (n.agg(F.max("part")).first()[0] or 0) + 1
    q = cut(texts.select("query_id", "text").where("text is not null and text != ''").distinct())
    hits = cut(_matches(q.select("text").distinct(), n))
    heads = n.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("names"))
    marks = hits.groupBy("part", "text").agg(F.collect_list("at").alias("ats")).groupBy("part").agg(F.collect_list(F.struct("text", "ats")).alias("m"))
    marks = marks.select("part", F.transform("m", lambda x: x["text"]).alias("texts"), F.transform("m", lambda x: F.size(x["ats"])).alias("sizes"), F.flatten(F.transform("m", lambda x: x["ats"])).alias("ats"))
    packed = heads.join(marks, "part")
    asked = q.join(hits.select("text").distinct(), "text", "left_semi").groupBy("query_id").agg(F.collect_list("text").alias("texts"))
    kind = dict(texts.dtypes)["query_id"]

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, QUERIES):
                ids, lists = (b.column(c).slice(i, QUERIES) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, lists)], names=["query_ids", "asked"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids: pa.Array, part: int, names: pa.Array, at: list[int], own: list[np.ndarray]) -> pa.RecordBatch:
            ends = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
            return pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array([part] * len(at), pa.int32()), pa.ListArray.from_arrays(pa.array(ends), names.take(pa.array(np.concatenate(own))))], names=["query_id", "part", "names"])

        last = None
        for b in batches:
            for i in range(b.num_rows):
                ids, asked, part, names, texts, sizes, ats = (x[i] for x in b.columns)
                ids, part, names = ids.values, part.as_py(), names.values
                if last is None or last[0] != part:
                    cuts = np.split(ats.values.to_numpy(), np.cumsum(sizes.values.to_numpy())[:-1])
                    last = part, dict(zip(texts.values.to_pylist(), cuts, strict=True))
                mark = np.zeros(len(names), bool)
                at, own, n = [], [], 0
                for k, mine in enumerate(asked.as_py()):
                    mark[:] = False
                    for text in mine:
                        if text in last[1]:
                            mark[last[1][text]] = True
                    which = np.flatnonzero(mark)
                    if len(which):
                        at.append(k)
                        own.append(which)
                        n += len(which)
                    if n > LISTED:
                        yield out(ids, part, names, at, own)
                        at, own, n = [], [], 0
                if n:
                    yield out(ids, part, names, at, own)

    # few but heavy rows, which go to as many tasks as there are
    blocks = asked.mapInArrow(block, f"query_ids array<{kind}>, asked array<array<string>>").repartition(max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))))
    return against(blocks, packed, "part").select("query_ids", "asked", "part", "names", "texts", "sizes", "ats").mapInArrow(read, f"query_id {kind}, part int, names array<string>"), parts


def texts_in_names(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, text) and (name) -> (query_id, name) of the names that a text is part of; pairs are distinct. Empty and null texts are in none."""
    return _lists(texts, names)[0].select("query_id", F.explode("names").alias("name"))


def name_lists(texts: DataFrame, names: DataFrame) -> DataFrame:
    """As `texts_in_names`, but one row a query, its names in order: (query_id, names)."""
    lists, parts = _lists(texts, names)
    if parts > 1:
        lists = lists.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("part", "names"))).alias("l")).select("query_id", F.flatten(F.transform("l", lambda x: x["names"])).alias("names"))
    return lists.select("query_id", "names")
