"""Decontamination, token counts, languages, mixing, secrets and licenses."""

import hashlib
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewright.llm import decontaminate, language_id, licenses, mixing, secrets, token_counts

from .conftest import prose


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


# -- decontamination


def brute_hits(text, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))
    w = words(text)
    hit, found = set(), set()
    for i, t in items:
        b = words(t)
        for k in range(max(1, len(b) - n + 1)) if b else []:
            win = b[k : k + n]
            for s in range(len(w) - len(win) + 1):
                if w[s : s + len(win)] == win:
                    hit.update(range(s, s + len(win)))
                    found.add(str(i))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("limit", [1 << 20, 40])
def test_decontamination(spark, nasty, limit):
    docs, rows = nasty
    items = [(1, prose(2, 120)[30:200]), (2, "ONE"), (10, None), (11, "!!"), (12, "Ümlauten, \U0001f600"), (3, "one"), (20, "mit ümlauten")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, bench, limit=limit).collect()
    assert sorted((r["doc_id"] or -1, r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == sorted((r[0] or -1, *brute_hits(r[1], items)) for r in rows)


def test_decontamination_empty(spark, frame, nasty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(nasty[0], none).where("contaminated").count() == 0
    assert decontaminate.contamination(frame([]), none).count() == 0


# -- token counts

tokenizers = pytest.importorskip("public_tokenizers")


def test_token_counts(spark, nasty, frame):
    docs, rows = nasty
    args = (tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    enc = token_counts.encoder(*args)
    n = sorted(len(enc.encode_ordinary(r[1])) if r[1] else 0 for r in rows)
    assert enc.decode(enc.encode_ordinary(rows[0][1])) == rows[0][1]
    got = {r["n_tokens"]: r for r in token_counts.token_counts(docs, *args).collect()}
    assert sorted(got) == sorted(set(n))
    for x, r in got.items():
        assert r["n_docs"] == n.count(x)
        assert r["docs_at_least"] == sum(k >= x for k in n)
        assert r["tokens_at_least"] == sum(k for k in n if k >= x)
        assert r["truncated_total"] == sum(min(k, x) for k in n)
        assert r["cut_tokens"] == sum(k - min(k, x) for k in n)
        assert abs(r["quantile"] - sum(k <= x for k in n) / len(n)) < 1e-12
    assert token_counts.token_counts(frame([]), *args).count() == 0


# -- languages


def brute_phrases(text, trained):
    """Greedy longest phrases of one segment, by substring search."""
    n = i = 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i : i + k + 1] in trained:
            k += 1
        n += 1
        i += k
    return n


def test_cross_parsing_is_exact():
    import numpy as np

    trained = {"de": "der die das und nicht ein haus im wald steht", "en": "the house in the wood is not there and it stands"}
    m = language_id.train(trained)
    table = language_id.class_table(m)
    for text in ("das haus und der wald", "there it is", "x", "abcdef the"):
        sym = table[[ord(c) for c in text]].astype(np.int64)
        got = language_id.phrases(m, sym, np.array([0, len(sym)]))[:, 0]
        want = [brute_phrases(text, trained[k]) for k in m.languages]
        assert got.tolist() == want


def test_languages(spark, frame, nasty):
    words = {"aa": "kala mulu tiri sopo vane", "bb": "xerq zwib ptah dorg fnim", "cc": "öläm ürük äni söt yül"}
    rows = [(i, " ".join(words[k].split()[(i * 7 + j * 3) % 5] for j in range(60)), k) for i, k in enumerate(["aa", "bb", "cc"] * 30)]
    got = {r["doc_id"]: r for r in language_id.identify(frame(rows), keep=["lang"]).collect()}
    held = [r for r in got.values() if r["held_out"]]
    assert held
    assert all(r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1 for r in got.values())
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got.values())
    docs, odd = nasty
    pred = language_id.identify(docs, labelled=frame(rows)).collect()
    assert len(pred) == len(odd)
    und = sum(not any(c.isalpha() for c in (r[1] or "")) for r in odd)
    assert sum(r["lang_pred"] == "und" and r["score"] == 0 for r in pred) == und
    assert language_id.identify(frame([])).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(frame([(1, "text", None)])).collect()} == {"und"}


def test_a_stray_language_and_many_languages(frame):
    def told(k, i):  # of the six words of language k
        w = prose(9000 + k, 6).split()
        return " ".join(w[(i * 5 + j * j) % 6] for j in range(60))

    rows = [(10 * i + k, told(k, i), f"l{k:02}") for i in range(20) for k in range(2)]
    got = language_id.identify(frame([*rows, (5001, "ok", "xx"), (5002, "a", "yy"), (5003, "no", "zz")]), keep=["lang"]).collect()
    assert any(not r["held_out"] for r in got if r["doc_id"] > 5000)
    assert all(r["lang_pred"] == r["lang"] for r in got if r["doc_id"] < 5000)
    many = [(k * 100 + i, told(k, i), f"l{k:02}") for k in range(40) for i in range(8)]
    named = language_id.identify(frame(many), keep=["lang"]).collect()
    assert all(r["lang_pred"] == r["lang"] for r in named)


# -- mixing


def brute_targets(sizes, weights=(5, 2, 1)):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, out, free = Fraction(3 * sum(sizes.values()), 2), {}, set(order)
    while free:
        level = (total - sum(out.values())) / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > 2 * sizes[s]}
        if not over:
            out |= {s: level * w[s] for s in free}
            break
        out |= {s: Fraction(2 * sizes[s]) for s in over}
        free -= over
    return out


def test_mixing(spark, frame, nasty):
    rows = [(i, prose(i, 5 + i % 40), "en", ["a", "b", "c", "d", None][min(i % 9, 4)]) for i in range(400)]
    for d, r in ((frame(rows), rows), nasty):
        got = mixing.mix_sources(d, keep=["source"], rows_per_bucket=20).collect()
        assert len(got) == len(r)
        sizes, taken, target = defaultdict(int), defaultdict(int), {}
        for x in got:
            sizes[x["source"]] += x["size"]
            taken[x["source"]] += x["taken"]
            target[x["source"]] = x["target"]
            assert x["taken"] <= 2 * x["size"]
        want = brute_targets(sizes)
        for s in sizes:
            assert abs(target[s] - want[s]) < 1e-6
            assert abs(taken[s] - want[s]) <= 1
        first = [x["first_position"] for x in got if x["first_position"] is not None]
        assert first == sorted(first)
        assert all(0 <= p <= 1 for p in first)
        again = mixing.mix_sources(d.repartition(7), keep=["source"], rows_per_bucket=50).collect()
        key = lambda x: (x["doc_id"] or -1, x["size"], x["taken"], x["source"] or "")
        assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix_sources(frame([])).count() == 0


# -- secrets

BASE = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def brute_secrets(text):
    out = []
    for k, (kind, p) in enumerate(BASE.items()):
        for m in p.finditer(text or ""):
            if (kind == "assign" and len(m[2]) >= 8) or (kind == "access" and len(m[0]) >= 16) or (kind == "hex" and len(m[0]) >= 32):
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_secrets(frame, nasty):
    h = "0123456789abcdef"
    body = "A" * 30
    good = "ghp_" + body + secrets.base62_crc(body)
    texts = [
        f"password = '{h}' and TOKEN:{h * 2}", "apikey=short", "Api_Key==abcdefgh", "token token=abcdefgh12", "passwordpassword=12345678", "secret: 12345678", "ſecret=12345678",
        "AKIAABCDEFGHIJKL12 AKIAAKIA AKIA" + "Z" * 12, h * 3 + "G" + h * 2, "é" * 40 + h * 2, h + "x" + h, good, good[:-1] + ("A" if good[-1] != "A" else "B"), "-----BEGIN RSA PRIVATE KEY-----", "\U0001f600" * 3 + " token='" + h * 2 + "'", "x" * 15 + h * 2, "f" * 31, "f" * 32,
    ]
    rows = [(i, x) for i, x in enumerate(texts)]
    for d, r in ((frame(rows), rows), nasty):
        got = secrets.secrets(d, redact="[X]").collect()
        assert len(got) == len(r)
        said = sorted((x["doc_id"] or -1, x["n_assign"], x["n_access"], x["n_hex"], x["base_sha256"]) for x in got)
        want = []
        for i, x, *_ in r:
            b = brute_secrets(x)
            n = [sum(s.startswith(k) for s in b) for k in BASE]
            want.append((i or -1, *n, hashlib.sha256(",".join(b).encode()).hexdigest()))
        assert said == sorted(want)
    by = {x["doc_id"]: x for x in secrets.secrets(frame(rows), redact="[X]").collect()}
    assert "github:" in by[11]["spans"]
    assert "github:" not in by[12]["spans"]
    assert "key_block" in by[13]["spans"]
    assert by[0]["redacted"] == "[X]' and [X]"
    assert secrets.secrets(frame([])).count() == 0


# -- licenses


def test_licenses(spark):
    rows = [
        (1, "repo/LICENSE", "Released under the MIT License."), (2, "repo/src/a.py", "code here"), (3, "repo/src/b.py", "# Licensed under the Apache License, Version 2.0.\ncode\nmore code\nand more"),
        (4, "repo/vendor/LICENSE.txt", "Licensed under the Apache License, Version 2.0."), (5, "repo/vendor/lib/x.c", None), (6, "other/y.c", "no word of it"), (7, None, "x"), (None, "z.c", ""), (8, "repo/src/long.txt", prose(9, 20_000)),
    ]
    d = spark.createDataFrame([(*r, 1.0, "own") for r in rows], "file_id long, path string, text string, score double, origin string")
    got = {r["file_id"]: (r["license"], r["origin"], r["directory"]) for r in licenses.license_scan(d).collect()}
    assert got[1][:2] == ("MIT", "own")
    assert got[2] == ("MIT", "inherited", "repo")
    assert got[3][:2] == ("Apache-2.0", "own")
    assert got[5] == ("Apache-2.0", "inherited", "repo/vendor")
    assert got[6] == got[7] == got[None] == (None, None, None)
    assert got[8] == ("MIT", "inherited", "repo")
    assert licenses.license_scan(d.unionAll(d)).count() == 2 * len(rows)
    assert licenses.license_scan(d.limit(0)).count() == 0
    assert licenses.license_scan(d.where(F.col("file_id") == 6)).count() == 1


def test_creative_commons_family(spark):
    long = "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."
    said = ["Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0.", "Licensed under CC BY-NC-SA 4.0.", "Licensed under CC BY-ND 4.0.", long, "Licensed under CC BY-SA 4.0."]
    d = spark.createDataFrame([(i, f"d{i}/a.txt", s + "\ncode\nmore\ncode") for i, s in enumerate(said)], "file_id long, path string, text string")
    got = {r["file_id"]: (r["license"], r["origin"]) for r in licenses.license_scan(d).collect()}
    want = ["CC-BY-NC-4.0", "CC-BY-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-NC-ND-4.0", "CC-BY-SA-4.0"]
    assert [got[i] for i in range(6)] == [(k, "own") for k in want]


def test_web_tokens_that_fail_are_read_once():
    import time

    auto = secrets.automaton()
    began = time.perf_counter()
    assert secrets.find("eyJ" * 400_000, auto) == []
    assert time.perf_counter() - began < 5
    good = "eyJabcdefghij0.eyJabcdefghij0.abcdefghij0"
    text = f"eyJeyJ {good} eyJx.{good}"
    assert [(a, b) for a, b, kind in secrets.find(text, auto) if kind == "jwt"] == [(7, 7 + len(good)), (len(text) - len(good), len(text))]


def test_letters_beyond_the_table_and_other_code_points(frame):
    rows = [(i, prose(i, 60), "en") for i in range(1, 30)] + [(100, "\U000e0100\U000e0101"), (101, "\U0010fffd"), (102, "\U00020001"), (103, "\U0001f600 12")]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(frame(rows)).collect()}
    assert got[100] == got[101] == got[103] == "und" and got[102] == "en"


def test_every_language_is_learned(frame):
    rows = [(40 * k + i, prose(1000 + k, 400, 60), f"l{k:02d}") for k in range(40) for i in range(3)]
    got = language_id.identify(frame(rows)).collect()
    assert sum(r["lang_pred"] == f"l{r['doc_id'] // 40:02d}" for r in got) >= 0.95 * len(got)


def brute_language(texts: dict[str, str], document: str) -> tuple[str, float]:
    """Greedy longest phrases in each language's text, parsed anew every SEGMENT symbols; the first language with the fewest bits."""
    squeezed = {k: language_id.squeeze(v) for k, v in texts.items()}
    common = min(len(v) for v in squeezed.values())
    known = {c for v in squeezed.values() for c in v[:common]}
    symbols = "".join(c if c == " " or c in known else "\0" for c in language_id.squeeze(document))
    need = {}
    for k in sorted(texts):
        text, n = squeezed[k][:common], 0
        for s in range(0, len(symbols), language_id.SEGMENT):
            part, i = symbols[s : s + language_id.SEGMENT], 0
            while i < len(part):
                j = i + 1
                while j < len(part) and part[i : j + 1] in text:
                    j += 1
                i, n = j, n + 1
        need[k] = n * np.log2(max(2, common))
    order = sorted(need, key=lambda k: (need[k], k))
    return order[0], 1 - need[order[0]] / need[order[1]]


def test_language_and_score_against_brute_force(frame):
    rows = [(i, prose(i % 3, 900, 300) + (" Ünïcode" if i % 3 else ""), "abc"[i % 3]) for i in range(12)]
    learned = language_id.sample(frame(rows))
    assert set(learned) == set("abc") and all(len(v) >= language_id.LEAST for v in learned.values())
    asked = [(200 + i, prose(50 + i, 10 + 60 * i, 300 + i)) for i in range(6)] + [(300, prose(0, 400, 300)), (301, "x" * 1500), (302, "q"), (303, "漢字 漢字")]
    got = {r["doc_id"]: r for r in language_id.identify(frame(asked), frame(rows)).collect()}
    for i, text in asked:
        lang, score = brute_language(learned, text)
        assert got[i]["lang_pred"] == lang and abs(got[i]["score"] - score) < 1e-9, i


def test_sample_of_one_id_is_bounded(frame):
    doc_id = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5)
    rows = [(doc_id, f"text number {i} of one id", "xx") for i in range(3000)]
    learned = language_id.sample(frame(rows), rows=50, chars=600)
    assert len(learned["xx"]) <= 600 and learned == language_id.sample(frame(rows).repartition(5), rows=50, chars=600)
    assert learned["xx"].count("\n") < 50


def test_large_alphabet_takes_little_memory_and_parses_alike():
    r = np.random.default_rng(3)
    texts = {k: "".join(chr(0x4E00 + int(c)) for c in r.integers(0, 2500, 24_000)) for k in ("aa", "bb")}
    m = language_id.train(texts)
    assert len(m.symbols) > 2400
    assert sum(x.nbytes for x in (m.table, m.keys, m.targets, m.restart)) < 50 << 20
    table = language_id.class_table(m)
    for k, t in texts.items():
        piece = t[100:500] + "x" + texts["aa"][7:60]
        names, _ = language_id.classify(m, table, np.frombuffer(piece.encode(), np.uint8), np.array([0, len(piece.encode())]))
        assert names == [k]


def test_decontamination_group_by_group(frame, spark):
    items = [(i, prose(600 + i, 30, 3000)) for i in range(9)] + [(20, "short item words"), (21, "short item words"), (22, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, f"{prose(700 + i, 30)} {items[i % 9][1]} {prose(800 + i, 20)} short item words") for i in range(20)] + [(3, prose(9, 40)), (3, prose(9, 40)), (None, None)]
    key = lambda d: sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in d.collect())
    whole = key(decontaminate.contamination(frame(rows), bench))
    assert key(decontaminate.contamination(frame(rows), bench, limit=40)) == whole
    assert key(decontaminate.contamination(frame(rows), bench, limit=1)) == whole
    assert any(x[3] >= 3 for x in whole)


def test_wrapped_and_commented_headers(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    words = mit.split()
    lines = [" ".join(words[i : i + 9]) for i in range(0, len(words), 9)]
    apache = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.'
    rows = [(1, "a/x.py", "# " + "\n# ".join(lines) + "\n\nx = 1"), (2, "b/y.c", "/*\n * " + apache.replace("\n", "\n * ") + "\n */\nint x;"), (3, "c/LICENSE", "MIT License\n\n" + "\n".join(lines)), (4, "c/d/z.txt", "plain words\nof a text"), (5, "e.txt", None), (4, "c/d/z.txt", "plain words\nof a text")]
    got = {(r["file_id"], r["license"], r["origin"]) for r in licenses.license_scan(spark.createDataFrame(rows, "file_id int, path string, text string")).collect()}
    assert got == {(1, "MIT", "own"), (2, "Apache-2.0", "own"), (3, "MIT", "own"), (4, "MIT", "inherited"), (5, None, None)}
