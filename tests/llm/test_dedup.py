"""Near and exact duplicates, repeated passages, top-k and the pipeline against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewright.llm import common, minmax_dedup, queries, substring_dedup, suffix_dedup, topk

from .conftest import prose


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def edited(text, seed, share):
    r = random.Random(seed)
    return " ".join("zz" + str(r.randrange(10**6)) if r.random() < share else w for w in text.split())


@pytest.fixture(scope="module")
def corpus(frame, nasty):
    base, passage = prose(50, 200, 5000), prose(51, 70, 5000)
    rows = list(nasty[1])
    rows += [(100 + i, edited(base, i, 0.01 * (i % 6))) for i in range(60)]
    rows += [(300 + i, prose(400 + i, 60 + i % 30, 5000) + " " + passage + " " + prose(500 + i, 40, 5000)) for i in range(12)]
    rows += [(400 + i, prose(600 + i, 100, 5000)) for i in range(20)]
    chain = prose(70, 150, 5000).split()
    for i in range(12):  # each is close to the next only
        chain[i * 12 % 150 : i * 12 % 150 + 3] = [f"k{i}a", f"k{i}b", f"k{i}c"]
        rows.append((500 + i, " ".join(chain)))
    return frame(rows), rows


def sets_of(rows, width):
    out = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t or ""))
        out.append(set() if not w else {tuple(w)} if len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)})
    return out


@pytest.mark.parametrize(("width", "similarity"), [(3, 85), (5, 80)])
def test_near_duplicates(corpus, width, similarity):
    docs, rows = corpus
    sets, parent = sets_of(rows, width), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                    parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    want = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            least = (min(ids) if ids else None) if sets[i] else rows[i][0]
            want.append((rows[i][0] or -1, len(sets[i]), least or -1, rows[i][0] is not None and rows[i][0] == least))
    got = [(r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1, r["kept"]) for r in minmax_dedup.near_duplicates(docs, width=width, similarity=similarity).collect()]
    assert sorted(got) == sorted(want)


def test_blocks_of_a_large_unit(corpus, monkeypatch):
    docs, _ = corpus
    key = lambda d: sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in d.collect())
    whole = key(minmax_dedup.near_duplicates(docs, width=3, similarity=85))
    monkeypatch.setattr(minmax_dedup, "BLOCK_SETS", 7)
    assert key(minmax_dedup.near_duplicates(docs, width=3, similarity=85)) == whole


def test_near_duplicates_empty(frame):
    assert minmax_dedup.near_duplicates(frame([])).count() == 0


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def brute_suffix(rows, length):
    seen = Counter(t[s : s + length] for _, x, *_ in rows for t in [(x or "").encode()] for s in range(len(t) - length + 1))
    out = []
    for i, x, *_ in rows:
        t = (x or "").encode()
        gone = np.zeros(len(t) + 1, int)
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                gone[s] += 1
                gone[s + length] -= 1
        g = np.cumsum(gone)[:-1] > 0
        kept = bytes(b for b, k in zip(t, g, strict=True) if not k)
        spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if len(g) else 0
        out.append((i or -1, len(t), int(g.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length", [200, 64])
def test_suffix_dedup(corpus, frame, length):
    docs, rows = corpus
    rows = [r for r in rows if not r[1] or len(r[1]) < 20_000] + [(900, "abcdefghij" * 90), (901, prose(80, 5) + "abcdefghij" * 40), (902, "xy" * 50 + prose(81, 100) + "xy" * 120)]
    got = sorted((r["doc_id"] or -1, *r[1:]) for r in suffix_dedup.suffix_dedup(frame(rows), length=length).collect())
    assert got == brute_suffix(rows, length)
    assert suffix_dedup.suffix_dedup(frame([])).count() == 0


def test_suffix_shards_take_spares_and_contexts(frame, monkeypatch):
    line = prose(90, 40)
    rows = [(i, prose(1000 + i, 12) + line + prose(2000 + i, 12)) for i in range(200)] + [(300 + i, line * 2) for i in range(30)]
    monkeypatch.setattr(suffix_dedup, "CONTEXTS", 4)
    got = sorted((r["doc_id"] or -1, *r[1:]) for r in suffix_dedup.suffix_dedup(frame(rows)).collect())
    assert got == brute_suffix(rows, 200)


def test_levels_grow_geometrically():
    r = np.random.default_rng(1)
    levels, every = suffix_dedup.Levels(), []
    for n in (50, 40, 60, 10, 80, 5):
        k, c = r.integers(0, 40, n).astype(np.uint64), r.integers(0, 3, n).astype(np.uint64)
        every += list(zip(k.tolist(), c.tolist(), strict=True))
        levels.add([k, c, np.arange(n), np.arange(n), np.ones(n), np.zeros(n, np.uint8)])
    sizes = [len(x[0]) for x in levels.levels]
    assert all(a > 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
    count, contexts = Counter(every), defaultdict(set)
    for k, c in every:
        contexts[k].add(c)
    for level in levels.levels:
        for k, c, flag in zip(level[0].tolist(), level[1].tolist(), level[5].tolist(), strict=True):
            assert bool(flag & suffix_dedup.WHOLE) == (count[k, c] > 1)
            if not flag & suffix_dedup.SENT:
                assert bool(flag & suffix_dedup.BORDER) == (len(contexts[k]) > 1)


def test_passages(corpus, frame):
    docs, rows = corpus
    got = {}
    for r in substring_dedup.passages(docs).collect():
        got.setdefault(r["doc_id"], r)
    assert all(got[300 + i]["n_passages"] >= 1 for i in range(12))
    words = {r[0]: low(r[1] or "").split() for r in rows}
    for i in range(12):  # the passage's 70 words, nearly to the word
        first = 60 + i % 30
        covered = {w for s in got[300 + i]["spans"].split(",") for w in range(*map(int, s.split(":")))}
        assert len(covered & set(range(first, first + 70))) >= 66
        assert len(covered) <= 70 + 12
    assert all(got[400 + i]["n_passages"] == 0 and got[400 + i]["partner_id"] is None for i in range(20))
    assert got[6]["partner_id"] == 1
    assert all(got[k]["n_passages"] == 0 for k in (2, 3, 4, 9, 10, 11, 12))
    assert words[300]
    assert substring_dedup.passages(frame([])).count() == 0


def test_compact_windows_are_those_of_the_minimum():
    text = prose(5, 300).encode()
    data, off = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    s, _, count, _ = substring_dedup.shingles(data, off, 5)
    f, v, _, _, c, before, after = substring_dedup.compact_windows(data, off, 5, 46, 2)
    for k in range(2):
        g = common.mix(s * (substring_dedup._SEEDS[0, k] | np.uint64(1)) + substring_dedup._SEEDS[1, k])
        want = set()
        for i in range(int(count[0])):
            lo, hi = i, i
            while lo > 0 and g[lo - 1] > g[i]:
                lo -= 1
            while hi + 1 < count[0] and g[hi + 1] >= g[i]:
                hi += 1
            if hi - lo + 1 >= 46:
                want.add((i, i - lo, hi - i))
        mine = f == k
        assert set(zip(c[mine].tolist(), before[mine].tolist(), after[mine].tolist(), strict=True)) == want
        assert (v[mine] == g[c[mine]]).all()


def brute_topk(rows, k):
    good = [(i, [int(np.floor(float(np.float32(x)) * 64)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i in sorted({i for i, _ in good if i % 20 == 0}):
        for q in [v for j, v in good if j == i]:
            s = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in good if j != i and len(v) == len(q))[:k]
            out += [(i, n + 1, j, -x) for n, (x, j) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("size", [(2048, 4096), (16, 3)])
def test_topk(spark, size):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(size=40).round(2)]) for i in range(150)]
    rows += [(200, None), (220, [1.0, None]), (240, [float("nan")] * 40), (260, [float("inf")] * 40), (None, rows[0][1]), (280, []), (300, [0.5, 0.5]), (301, [0.5, 0.25])]
    rows += [(400 + i, rows[3][1]) for i in range(25)]  # ties
    d = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, score int")
    got = topk.top_k(d, F.col("vec_id") % 20 == 0, 20, candidates=size[0], queries=size[1])
    assert sorted(map(tuple, got.collect())) == brute_topk(rows, 20)
    assert topk.top_k(d.limit(0), F.col("vec_id") % 20 == 0).count() == 0


SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontaminate", "secrets", "mix"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols, d = docs.columns, docs
    before = d.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, SF).checkpoint()
        assert d.columns == cols, name
        assert d.count() <= before
        before = d.count()
    assert d.where(F.col("text").rlike("[0-9a-f]{32}")).count() == 0
    out = corpus_pipeline.run(spark, SF)
    assert out.count() == before
    assert {"doc_id", "taken", "target"} <= set(out.columns)


def test_stage_results_are_parquet(spark, nasty, frame, tmp_path):
    import corpus_pipeline

    for n, d in enumerate((nasty[0], frame([]))):
        again = corpus_pipeline.stored(spark, d, str(tmp_path / str(n)))
        assert again.inputFiles()[0].endswith(".parquet") and again.dtypes == d.dtypes
        assert sorted(map(str, again.collect())) == sorted(map(str, d.collect()))


def test_pipeline_stages_on_odd_rows(nasty, frame, spark):
    import corpus_pipeline

    for d in (nasty[0].select("doc_id", "text", "lang", "source", "n_chars"), frame([]).select("doc_id", "text", "lang", "source", "n_chars")):
        for _, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, SF)
        d.collect()


def test_queries_have_sql_for_known_names():
    assert set(queries.oracle_sql()) <= set(queries.queries())


def passage_rows(frame, rows):
    return {r["doc_id"]: r for r in substring_dedup.passages(frame(rows), partners=True).collect()}


def words_in(row):
    return {w for s in row["spans"].split(",") if s for w in range(*map(int, s.split(":")))}


def test_near_copies_of_a_common_line_are_all_found(frame):
    line = prose(700, 25, 5000)
    rows = []
    for i in range(60):  # pairs: the line in the middle of a text of their own, one word of it changed
        a, b = prose(800 + i, 20, 5000), prose(900 + i, 20, 5000).split()
        rows += [(1000 + i, f"{prose(2000 + i, 30, 5000)} {a} {line} {' '.join(b)}"), (3000 + i, f"{prose(4000 + i, 30, 5000)} {a} {line} {' '.join(b[:9] + ['changed'] + b[10:])}")]
    got = passage_rows(frame, rows)
    assert all(str(3000 + i) in got[1000 + i]["partner_ids"].split(",") for i in range(60))


def test_near_passages_at_the_threshold_against_brute_force(frame):
    rows = []
    for i in range(200):  # one word of fifty changed: 41 of 51 shingles, 0.804
        p = prose(5000 + i, 50, 5000).split()
        at = 5 + i % 40
        rows += [(2 * i, f"{prose(6000 + i, 20, 5000)} {' '.join(p)} {prose(7000 + i, 20, 5000)}"), (2 * i + 1, f"{prose(8000 + i, 20, 5000)} {' '.join(p[:at] + ['changed'] + p[at + 1 :])} {prose(9000 + i, 20, 5000)}")]
    got = passage_rows(frame, rows)
    assert all(got[2 * i]["partner_id"] == 2 * i + 1 and got[2 * i + 1]["partner_id"] == 2 * i for i in range(200))


def test_a_passage_twice_in_one_document(frame):
    p = prose(71, 120, 5000)
    text = lambda k, n: prose(k, n, 5000)
    rows = [(1, f"{text(72, 40)} {p} {text(73, 60)} {p} {text(74, 40)}"), (2, f"{text(75, 40)} {p} {text(76, 40)}")]
    for d in (frame(rows), frame(rows).repartition(2, "doc_id")):
        got = {r["doc_id"]: r for r in substring_dedup.passages(d).collect()}
        assert set(range(40, 160)) | set(range(220, 340)) <= words_in(got[1])
        assert got[1]["n_passages"] == 2


def test_links_and_classes_of_passages(frame):
    p, q, r = (prose(k, 80, 5000) for k in (81, 82, 83))
    rows = [(1, f"{q} {r}"), (2, f"{q} filler words here {p}"), (3, f"{p} other filler words {r}"), (4, prose(84, 80, 5000)), (5, prose(85, 70, 5000)), (6, prose(85, 70, 5000))]
    got = passage_rows(frame, rows)
    assert [(got[i]["class_id"], got[i]["n_links"], got[i]["partner_ids"]) for i in range(1, 7)] == [(1, 2, "2,3"), (1, 2, "1,3"), (1, 2, "1,2"), (None, 0, ""), (5, 1, "6"), (5, 1, "5")]


def test_suffix_period_of_one_more_than_the_seeds_reach(frame):
    line = prose(91, 40)[:100] + "\n"  # 101 = length - seed + 1 bytes
    rows = [(1, line * 6), (2, prose(92, 20) + line[::-1] * 3), (3, prose(93, 100))]
    got = sorted((r["doc_id"], *r[1:]) for r in suffix_dedup.suffix_dedup(frame(rows)).collect())
    assert got == brute_suffix(rows, 200)
    assert got[0][2] == 606


def test_components_that_have_not_settled(spark):
    with pytest.raises(RuntimeError, match="settled"):
        common.connected_components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"), rounds=2)


def test_topk_of_huge_components_and_repeated_queries(spark):
    rows = [(20, [3e38, 1.0]), (1, [3e38, -1.0]), (2, [-3e38, 2.0]), (3, [1e15, 1e15]), (4, [1e9, 5.0]), (40, [1e9, 4.0]), (5, [1e9, 4.5]), (60, [0.5, 1.0]), (60, [1.0, 0.25])]
    got = sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, 4).collect()))
    q = [(i, [int(np.floor(float(np.float32(x)) * 64)) if abs(x) < 1e17 else int(float(np.float32(x))) * 64 for x in v]) for i, v in rows]
    clip = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    want = []
    for i in (20, 40, 60):
        every = sorted((-clip(sum(a * b for a, b in zip(v, w, strict=True))), j) for k, v in q if k == i for j, w in q if j != i)[:4]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(every)]
    assert got == want


def test_repeated_rows_lose_everything_and_grow_linearly(frame):
    text = prose(44, 300)
    rows = [(1, text)] * 40 + [(2, text + prose(45, 50)), (3, prose(46, 100)), (4, "short"), (4, "short"), (None, text), (None, text)]
    got = sorted((r["doc_id"] or -1, *r[1:]) for r in suffix_dedup.suffix_dedup(frame(rows)).collect())
    assert got == brute_suffix(rows, 200)


def test_a_crowd_around_a_common_line(frame):
    """A line in many texts: only the pairs that share more than the line are passages, in one task, by hubs and in blocks."""
    line = prose(701, 30, 5000)
    rows = [(i, f"{prose(5000 + i, 60, 5000)} {line} {prose(6000 + i, 60, 5000)}") for i in range(80)]
    for i in range(12):
        around = prose(7000 + i, 20, 5000)
        rows += [(1000 + i, f"{prose(7100 + i, 40, 5000)} {line} {around} {prose(7200 + i, 40, 5000)}"), (2000 + i, f"{prose(7300 + i, 40, 5000)} {line} {around} {prose(7400 + i, 40, 5000)}")]
    for most in (4096, 20, 5):
        got = {r["doc_id"]: r for r in substring_dedup.passages(frame(rows), most=most).collect()}
        assert all(got[i]["n_passages"] == 0 and got[i]["class_id"] is None for i in range(80)), most
        for i in range(12):
            assert got[1000 + i]["class_id"] == got[2000 + i]["class_id"] == 1000 + i, most
            assert {w for w in range(40, 90)} <= words_in(got[1000 + i]), most


def test_members_of_a_hot_passage_share_a_class(frame):
    p = prose(702, 70, 5000)
    rows = [(i, f"{prose(5000 + i, 60, 5000)} {edited(p, i, 0.004 * (i % 4))} {prose(6000 + i, 60, 5000)}") for i in range(60)]
    for most in (4096, 15):
        got = {r["doc_id"]: r for r in substring_dedup.passages(frame(rows), most=most).collect()}
        assert sum(r["class_id"] == 0 for r in got.values()) >= 58
        assert all(len(words_in(got[i]) & set(range(60, 130))) >= 66 for i in range(0, 60, 4))


def test_near_passages_by_rate_of_edits(frame):
    """Recall against the share of changed words: pairs at 0.8 or more over the whole passage, found as passages of both."""
    rows, pairs = [], []
    for i in range(150):
        p = prose(9000 + i, 60 + i, 5000).split()
        q = edited(" ".join(p), i, 0.005 * (i % 6)).split()
        a, b = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (p, q))
        if len(a & b) >= 0.8 * len(a | b):
            pairs.append(i)
        rows += [(2 * i, f"{prose(20_000 + i, 30, 5000)} {' '.join(p)} {prose(21_000 + i, 30, 5000)}"), (2 * i + 1, f"{prose(22_000 + i, 30, 5000)} {' '.join(q)} {prose(23_000 + i, 30, 5000)}")]
    got = {r["doc_id"]: r for r in substring_dedup.passages(frame(rows)).collect()}
    found = [i for i in pairs if got[2 * i]["class_id"] == got[2 * i + 1]["class_id"] == 2 * i]
    assert len(pairs) >= 100 and len(found) >= 0.99 * len(pairs)


def test_monotonous_stretches(frame):
    rows = [(1, prose(1, 60, 5000) + " spam" * 90 + " " + prose(2, 30, 5000)), (2, prose(3, 80, 5000) + " spam" * 70), (3, prose(4, 30, 5000) + " eggs" * 90 + prose(5, 30, 5000)), (4, " ".join(["lorem ipsum dolor"] * 60)), (5, prose(6, 20, 5000) + " " + " ".join(["lorem ipsum dolor"] * 30))]
    got = passage_rows(frame, rows)
    assert set(range(60, 150)) <= words_in(got[1]) and set(range(80, 150)) <= words_in(got[2])
    assert got[3]["n_passages"] == 0 and got[4]["class_id"] == got[5]["class_id"] == 4


def test_pipeline_stages_against_brute_force(spark, frame):
    """Each stage on its own input: the rows that stay, and their texts, by plain Python."""
    import corpus_pipeline as cp

    from lorewright.llm import decontaminate, secrets

    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    item = next(r["text"] for r in bench if r["text"] and len(decontaminate.normalise(r["text"])) >= 10)
    base = prose(1200, 120)
    rows = [(i, prose(1300 + i, 60), "en", "s" if i % 2 else None) for i in range(30)] + [(40, base, "en", "s"), (41, edited(base, 1, 0.01), "en", "s"), (42, base, "en", "t"), (40, base, "en", "s"), (None, base, "en", "s"), (None, base, "en", "s")]
    rows += [(50, f"{prose(1400, 30)} {item} {prose(1401, 30)}", "en", "s"), (51, "password = hunter2hunter2 and " + "0123456789abcdef" * 3, "en", "s"), (60, None, "en", "s"), (61, "", "en", "s"), (62, "12 34 !!", None, "s")]
    d = frame(rows)
    d = d.withColumnRenamed("size", "_kept").withColumnRenamed("key", "_n").withColumnRenamed("score", "redacted")
    key = lambda x: sorted((str(r["doc_id"]), r["text"]) for r in x.collect())
    of = lambda rs: sorted((str(r[0]), r[1]) for r in rs)

    got = cp.language(spark, d, SF)
    assert key(got) == of([r for r in rows if r[1] and any(c.isalpha() for c in r[1])])
    assert set(got.columns) == set(d.columns)

    sets, keep, ids = sets_of(rows, 5), [], [r[0] for r in rows]
    parent = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = parent[i], parent[j]
                parent = [min(a, b) if p in (a, b) else p for p in parent]
    for p in set(parent):
        least = min((ids[i] for i in range(len(rows)) if parent[i] == p and ids[i] is not None), default=None)
        keep += [next(r for r in rows if r[0] == least)] if least is not None else []
    assert key(cp.near_duplicates(spark, d, SF)) == of(keep + [r for r in rows if r[0] is None])

    windows = {w for r in bench if r["text"] for w in decontaminate.windows(decontaminate.normalise(r["text"]))}

    def dirty(t):
        w = decontaminate.normalise(t)
        return any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))

    assert key(cp.decontaminated(spark, d, SF)) == of([r for r in rows if not dirty(r[1])])

    got = cp.without_secrets(spark, d, SF)
    assert key(got) == of([(r[0], None if r[1] is None else secrets.cover(r[1], secrets.find(r[1], secrets.automaton()), cp.REDACTED)) for r in rows])
    assert {r["n_chars"] for r in got.where("doc_id = 51").collect()} == {len(cp.REDACTED) * 2 + len(" and ")}
    plain = d.select("doc_id", "text", "lang", "source", "n_chars")
    mix = cp.mixed(spark, plain, SF).collect()
    assert sorted(str(r["doc_id"]) for r in mix) == sorted(str(r[0]) for r in rows)
    assert all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) and r["taken"] <= 2 * r["size"] for r in mix for t in {x[1] for x in rows if x[0] == r["doc_id"] and r["doc_id"] is not None})


def test_near_copies_below_the_threshold_are_compared_once_each():
    r = np.random.default_rng(3)
    base = r.integers(1, 1 << 62, 120, dtype=np.uint64)

    def near(k):
        x = base.copy()
        x[r.choice(120, k, replace=False)] = r.integers(1, 1 << 62, k, dtype=np.uint64)
        return np.unique(x)

    sets = [near(int(k)) for k in r.integers(2, 24, 300)]
    compared = []

    class Counted(minmax_dedup.Group):
        def compare(self, *rows):
            compared.extend(np.atleast_1d(rows[0]).tolist())
            super().compare(*rows)

    links = Counted(np.arange(300), minmax_dedup.bands(sets).view(np.int64), sets, 85).link()
    assert len(compared) == len(set(compared))
    parent = list(range(300))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    alike = lambda a, b: 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))
    assert all(alike(a, b) for a, b in links)
    for a, b in links:
        assert root(a) != root(b)
        parent[root(a)] = root(b)
    assert all(root(a) == root(b) for a in range(300) for b in range(a) if alike(a, b))
    assert len({root(x) for x in range(300)}) > 20
