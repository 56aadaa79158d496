"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text is built for each language. A text is parsed
greedily into the longest phrases that occur in a language's labelled text; the
language that needs the fewest bits of phrases wins. A phrase costs the same in every
language, log2 of the common length of the labelled texts, so a language with little
labelled text has no cheap phrases: it only knows fewer of them.

The automata are flattened into one transition table, and many segments of many
documents walk it side by side, so the inner loop is NumPy over lanes. Texts are
parsed whole, in segments of a fixed number of symbols (a phrase ends where a segment
ends), which keeps lanes alike whatever a document's length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_blocks

#: Every language is learned, from a bounded sample: at most so many rows of each, characters of each, and characters of all (but LEAST of each).
CHARS_OF_ALL = 768_000
ROWS_PER_LANGUAGE = 200
CHARS_PER_LANGUAGE = 24_000
#: A language with fewer symbols than this is learned from what it has, and doesn't shorten the others.
LEAST = 4_000
SEGMENT = 512
UNKNOWN = "und"
#: Code points up to here have a table entry; the few above are looked up one by one.
_TABLE = 0x20000

#: Symbols with a column in the transition table; rarer ones are found by binary search, so the table grows with the text alone and not with its alphabet.
DENSE = 64
_BLANK, _OTHER = 0, 1  # symbol classes: no letter; a letter that no labelled text has


@dataclass
class Model:
    languages: list[str]
    symbols: dict[int, int]  # lower-case code point -> class, from 2, frequent ones first
    table: np.ndarray  # state * width + symbol -> state or -1, of all languages one after another, for symbols below width
    keys: np.ndarray  # state * n_symbols + symbol of the transitions by all other symbols, in order
    targets: np.ndarray  # where they lead
    roots: np.ndarray
    restart: np.ndarray  # (language, symbol): state of a phrase that begins with it
    bits: np.ndarray  # of a phrase


def lower(c: str) -> str:
    x = c.lower()
    return x if len(x) == 1 else c


def squeeze(text: str) -> str:
    out = "".join(lower(c) if c.isalpha() else " " for c in text)
    while "  " in out:
        out = out.replace("  ", " ")
    return out


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions (symbol -> state) of the smallest automaton of all substrings, by state."""
    link, length, step = [-1], [0], [{}]
    last = 0
    for s in symbols:
        cur = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and s not in step[p]:
            step[p][s] = cur
            p = link[p]
        if p >= 0:
            q = step[p][s]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(s) == q:
                    step[p][s] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return step


def train(labelled: dict[str, str]) -> Model:
    """A model of labelled text by language, all cut to as many symbols as the smallest one with LEAST or more has."""
    languages = sorted(labelled)
    texts = [squeeze(labelled[k]) for k in languages]
    sizes = [len(t) for t in texts]
    common = min([n for n in sizes if n >= LEAST], default=max(sizes, default=0))
    texts = [t[:common] for t in texts]
    often = Counter(ord(c) for t in texts for c in t if c != " ")
    symbols = {c: i + 2 for i, c in enumerate(sorted(often, key=lambda c: (-often[c], c)))}
    n = len(symbols) + 2
    width = min(n, DENSE)
    restart = np.zeros((len(languages), n), np.int32)
    tables, keys, targets, roots, at = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [], 0
    for k, t in enumerate(texts):
        steps = suffix_automaton([_BLANK if c == " " else symbols[ord(c)] for c in t])
        size = np.array([len(d) for d in steps])
        state = np.repeat(np.arange(len(steps)), size) + at
        symbol = np.fromiter((s for d in steps for s in d), np.int64, size.sum())
        target = np.fromiter((q for d in steps for q in d.values()), np.int64, size.sum()) + at
        table = np.full((len(steps), width), -1, dtype=np.int32)
        near = symbol < width
        table[state[near] - at, symbol[near]] = target[near]
        far = state[~near] * n + symbol[~near]
        order = np.argsort(far)
        tables.append(table.ravel())
        keys.append(far[order])  # states rise from language to language, so all keys stand in order
        targets.append(target[~near][order].astype(np.int32))
        restart[k] = at
        for s, q in steps[0].items():
            restart[k, s] = q + at
        roots.append(at)
        at += len(steps)
    bits = np.full(len(languages), np.log2(max(2, common)))
    return Model(languages, symbols, np.concatenate(tables), np.concatenate(keys), np.concatenate(targets), np.array(roots, np.int32), restart, bits)


def class_table(model: Model) -> np.ndarray:
    out = np.zeros(_TABLE + 1, dtype=np.int16)
    for c in range(_TABLE):
        x = chr(c)
        if x.isalpha():
            out[c] = model.symbols.get(ord(lower(x)), _OTHER)
    return out


def classes(model: Model, table: np.ndarray, code: np.ndarray) -> np.ndarray:
    out = table[np.minimum(code, _TABLE)]
    high = np.flatnonzero(code >= _TABLE)
    if len(high):
        points, which = np.unique(code[high], return_inverse=True)
        of = [model.symbols.get(ord(lower(chr(c))), _OTHER) if chr(c).isalpha() else _BLANK for c in points.tolist()]
        out[high] = np.array(of, out.dtype)[which]
    return out


def phrases(model: Model, sym: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(language, document): phrases of each document's symbols sym[bounds[i]:bounds[i+1]]."""
    n_docs, n_lang = len(bounds) - 1, len(model.languages)
    sizes = np.diff(bounds)
    per = -(-sizes // SEGMENT)
    doc = np.repeat(np.arange(n_docs), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    start = bounds[doc] + nth * SEGMENT
    size = np.minimum(SEGMENT, bounds[doc + 1] - start)
    order = np.argsort(-size, kind="stable")
    doc, start, size = doc[order], start[order], size[order]
    n_symbols = model.restart.shape[1]
    width = min(n_symbols, DENSE)
    state = np.repeat(model.roots[:, None], len(doc), axis=1)
    count = np.zeros(state.shape, dtype=np.int32)
    root = model.roots[:, None]
    alive = np.searchsorted(-size, -np.arange(SEGMENT), side="left")  # segments longer than t
    for t in range(int(size[0]) if len(size) else 0):
        m = alive[t]
        s = sym[start[:m] + t]
        now = model.table[state[:, :m] * width + np.minimum(s, width - 1)]
        rare = np.flatnonzero(s >= width)
        if len(rare):
            key = state[:, rare].astype(np.int64) * n_symbols + s[rare]
            at = np.searchsorted(model.keys, key)
            known = at < len(model.keys)
            at[~known] = 0
            now[:, rare] = np.where(known & (model.keys[at] == key), model.targets[at], -1) if len(model.keys) else -1
        bad = now < 0
        # a phrase begins where the last one can't go on, and at a root: at the start and after a letter that no labelled text has
        count[:, :m] += bad | (state[:, :m] == root)
        state[:, :m] = np.where(bad, model.restart[:, s], now)
    out = np.zeros((n_lang, n_docs), dtype=np.int64)
    for k in range(n_lang):
        out[k] = np.bincount(doc, weights=count[k], minlength=n_docs).astype(np.int64)
    return out


def classify(model: Model, table: np.ndarray, data: np.ndarray, off: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each document of a block of UTF-8."""
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    code = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), dtype=np.uint32)
    sym = classes(model, table, code)
    edge = lead[off]
    keep = np.ones(len(sym), dtype=bool)
    keep[1:] = (sym[1:] != _BLANK) | (sym[:-1] != _BLANK)
    keep[edge[:-1][edge[:-1] < len(sym)]] = True
    kept = np.zeros(len(sym) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    letters = np.zeros(len(sym) + 1, np.int64)
    np.cumsum(sym != _BLANK, out=letters[1:])
    has = np.diff(letters[edge]) > 0
    if not model.languages:
        return [UNKNOWN] * len(has), np.zeros(len(has))
    need = phrases(model, sym[keep].astype(np.int64), kept[edge]) * model.bits[:, None]
    best = np.argmin(need, axis=0)
    low = need[best, np.arange(len(has))]
    second = np.partition(need, 1, axis=0)[1] if len(model.languages) > 1 else np.full(len(has), np.inf)
    score = np.where(has, 1 - low / np.maximum(second, 1e-300), 0.0)
    return [model.languages[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], score


def held_out(doc_id="doc_id", folds: int = 5):
    """True where crc32 of the id, as text, is divisible by `folds`; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def sample(docs: DataFrame, *, rows: int = ROWS_PER_LANGUAGE, chars: int = CHARS_PER_LANGUAGE, chars_of_all: int = CHARS_OF_ALL) -> dict[str, str]:
    """Labelled text of each language for `train`, at most `rows` rows and `chars` characters each, fewer where there are many languages.

    Rows with a null text, lang or id don't teach; nor do held-out ones. The rows are
    those first in a hash order of their ids, so the sample doesn't depend on partitions.
    """
    d = docs.where("text is not null and lang is not null and doc_id is not null").where(~held_out())
    top = [r[0] for r in d.select("lang").distinct().collect()]
    if not top:
        return {}
    chars = min(chars, max(LEAST, chars_of_all // len(top)))

    def first(rows_of: DataFrame, *order: str) -> DataFrame:
        """The rows that come first in each language: at most `rows`, and less than 2 * chars characters."""
        w = Window.partitionBy("lang").orderBy(*order)
        before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return rows_of.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= rows).withColumn("_b", before).where(F.col("_b") < chars)

    lean = d.select("lang", "doc_id", F.least(F.length("text"), F.lit(chars)).alias("_n"), F.xxhash64("doc_id").alias("_h"))
    ids = first(lean, "_h", "doc_id").select("doc_id").distinct()
    # an id may stand for any number of rows, so the rows are cut once more, with their texts, before they come to the driver
    near = d.join(F.broadcast(ids), "doc_id", "left_semi").select("lang", F.substring("text", 1, chars).alias("text"), F.xxhash64("doc_id").alias("_h"))
    taken = first(near.withColumn("_n", F.length("text")).withColumn("_t", F.xxhash64("text")), "_h", "_t", "text")
    out: dict[str, list[str]] = {}
    for r in sorted(taken.collect(), key=lambda r: (r["_h"], r["text"])):
        out.setdefault(r["lang"], []).append(r["text"])
    joined = {k: "\n".join(v) for k, v in out.items()}
    return {k: v[:chars] for k, v in joined.items() if any(c.isalpha() for c in v[:chars])}


def identify(docs: DataFrame, labelled: DataFrame | None = None, *, keep: list[str] | None = None, **bounds) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score (+ `keep`).

    The model is learned from `labelled` (`docs` where none is given) as `sample` says.
    score is 1 - best / second-best bits, in [0, 1]. A text that is null or has no letter
    is `und` with score 0; so is every text where nothing could be learned. Ties go to
    the first language in code point order; repeated rows are judged each; texts of any
    length are parsed whole. Columns beyond doc_id, text, lang and `keep` are ignored.
    """
    keep = [c for c in keep or [] if c != "doc_id"]
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(sample(docs if labelled is None else labelled, **bounds)))
    kinds = dict(docs.dtypes)
    kept = {f"_keep_{c}": c for c in keep if c != "text"}
    base = docs.select("doc_id", held_out().alias("held_out"), "text", *[F.col(c).alias(k) for k, c in kept.items()])
    with_text = "text" in keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = class_table(model.value)
        for batch in batches:
            col = batch.column(batch.schema.get_field_index("text"))
            langs, scores = [], []
            for _, _, data, off in text_blocks(col):
                a, b = classify(model.value, table, data, off)
                langs += a
                scores.append(b)
            names = [f.name for f in batch.schema if with_text or f.name != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(x)) for x in names], pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=[*names, "lang_pred", "score"])

    schema = f"doc_id {kinds['doc_id']}, held_out boolean, " + ("text string, " if with_text else "") + "".join(f"`{k}` {kinds[c]}, " for k, c in kept.items()) + "lang_pred string, score double"
    return base.mapInArrow(run, schema).select("doc_id", "held_out", "lang_pred", "score", *(["text"] if with_text else []), *[F.col(k).alias(c) for k, c in kept.items()])
