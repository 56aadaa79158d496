"""Packing against the contract: every id in exactly one piece, no gaps, no padding, proportions of sources."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lorewright.llm import packing

from .conftest import prose

tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("byte_bpe_50k.json")


def plain(text):
    return [*packing.encoder(PATH).tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, pieces, length=1024):
    """rows: (doc_id, text, ...) in any order; documents with one id are told apart by what their pieces hold."""
    ids = [(r[0], plain(r[1])) for r in rows]
    want = Counter((d, len(x)) for d, x in ids)
    covered = defaultdict(list)
    for p in pieces:
        covered[p["doc_id"], p["doc_tokens"]] += range(p["start"], p["start"] + p["length"])
    for k, times in want.items():
        assert sorted(covered[k]) == sorted(list(range(k[1])) * times)
    crcs = defaultdict(set)
    for d, x in ids:
        raw = np.array(x, "<u4").tobytes()
        for p in pieces:
            if (p["doc_id"], p["doc_tokens"]) == (d, len(x)):
                crcs[d, len(x), p["start"], p["length"]].add(zlib.crc32(raw[4 * p["start"] : 4 * (p["start"] + p["length"])]))
    assert all(p["ids_crc32"] in crcs[p["doc_id"], p["doc_tokens"], p["start"], p["length"]] for p in pieces)
    at = defaultdict(int)
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == at[p["sequence_id"]] and p["length"] > 0
        at[p["sequence_id"]] += p["length"]
    total = sum(len(x) for _, x in ids)
    assert sum(at.values()) == total and sorted(at) == list(range(len(at)))
    assert sum(n == length for n in at.values()) >= total // length
    assert all(n <= length and (n == length or n & (n - 1) == 0) for n in at.values())


@pytest.mark.parametrize("options", [{}, {"pack": 2048, "grain": 1, "rows_per_bucket": 2}, {"length": 100, "pack": 1000, "grain": 7}, {"length": 64, "pack": 640, "weights": {"s": 3, None: 1}}])
def test_every_id_once(nasty, options):
    docs, rows = nasty
    got = packing.pack_documents(docs, PATH, **options)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check(rows, [r.asDict() for r in got.collect()], options.get("length", 1024))


def test_empty(frame):
    assert packing.pack_documents(frame([]), PATH).count() == 0
    got = packing.pack_documents(frame([(1, None), (2, "")]), PATH).collect()
    check([(1, None), (2, "")], [r.asDict() for r in got])


def test_proportions_and_reruns(frame):
    rows = [(i, prose(i, 20 + i % 200), "en", "big" if i % 3 == 0 else f"s{i % 7}") for i in range(400)]
    docs = frame(rows)
    got = [r.asDict() for r in packing.pack_documents(docs, PATH, length=256, pack=256 * 16, grain=16).collect()]
    again = [r.asDict() for r in packing.pack_documents(docs.repartition(7), PATH, length=256, pack=256 * 16, grain=16).collect()]
    order = lambda p: tuple(p.values())
    assert sorted(got, key=order) == sorted(again, key=order)
    source = {r[0]: r[3] for r in rows}
    total = sum(p["length"] for p in got)
    share = Counter()
    for p in got:
        share[source[p["doc_id"]]] += p["length"]
    so_far, at = Counter(), 0
    by_sequence = defaultdict(list)
    for p in got:
        by_sequence[p["sequence_id"]].append(p)
    for s in sorted(by_sequence):
        for p in by_sequence[s]:
            so_far[source[p["doc_id"]]] += p["length"]
            at += p["length"]
        assert all(abs(so_far[k] - at * share[k] / total) <= 2 * 16 + 8 for k in share)


def test_weights_hold_until_a_source_runs_out(frame):
    rows = [(i, prose(i, 100), "en", "ab"[i % 2]) for i in range(200)]
    got = [r.asDict() for r in packing.pack_documents(frame(rows), PATH, length=200, pack=2000, grain=1, weights={"a": 3, "b": 1}).collect()]
    check(rows, got, 200)
    first = Counter()
    for p in got:
        if p["sequence_id"] < 50:
            first["ab"[p["doc_id"] % 2]] += p["length"]
    assert abs(first["a"] - 3 * first["b"]) <= 40


def test_encoder_equals_the_tokenizer():
    texts = ["", " ", "  a  b", "a b", "a  b\n\n c d", "don't stop  \t x I'll we've 'S", "<|endoftext|> a<|endoftext|> b", " lead", "tail ", "é  ü  x", "\u180e a \u180e", "日本 語 " * 5, "x" * 100 + " " + "y" * 100, "\x1c a\x1d b \x85 c"]
    texts += [prose(i, 200) for i in range(20)]
    texts += [f"a{chr(c)}b {chr(c)} 1{chr(c)}{chr(c)}2  {chr(c)}" for c in [*range(0x180), *range(0x400, 0x460), *range(0x2010, 0x2028), *range(0x3041, 0x3095), *range(0x30A1, 0x30FB), *range(0x4E00, 0x9FA6, 97), *range(0xAC00, 0xD7A4, 97), 0x20AC, 0x1F600, 0x0660, 0x2028, 0x1D7CE]]
    enc = packing.encoder(PATH)
    assert enc.ranks is not None
    # every entry of the vocabulary that is a text
    texts += [t for i in range(enc.tokenizer.get_vocab_size()) if "\ufffd" not in (t := enc.tokenizer.decode([i], skip_special_tokens=False))]
    got = enc(texts)
    assert [np.frombuffer(x, enc.kind).tolist() for x in got] == [x.ids for x in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_encoder_of_another_kind():
    enc = packing.Encoder(tokenizers.path("word_bpe_49k.json"))
    assert enc.ranks is None
    assert np.frombuffer(enc(["Some Words, here"])[0], enc.kind).tolist() == enc.tokenizer.encode("Some Words, here", add_special_tokens=False).ids


def test_windows_of_the_end():
    assert list(packing.windows(0, 2500, 2500, 1024)) == [(0, 0, 1024, 0), (1, 0, 1024, 1024), (2, 0, 256, 2048), (3, 0, 128, 2304), (4, 0, 64, 2432), (5, 0, 4, 2496)]
    parts = [w for a in range(0, 2500, 77) for w in packing.windows(a, min(a + 77, 2500), 2500, 1024)]
    assert sum(w[2] for w in parts) == 2500
