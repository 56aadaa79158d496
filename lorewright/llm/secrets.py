"""Secret scans.

One Aho-Corasick automaton over keywords and token prefixes runs over each whole
text; anchored regular expressions are tried only where it hits; formats with an
embedded checksum are kept only where the checksum holds. Long hexadecimal runs
have no keyword: there the prefilter tests every 16th character, which no run of 32
can avoid, and the anchored expression is tried around those.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keywords of an assignment; order and spelling as in the pattern below.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Prefixed formats; the last six characters of the first two are a base-62 CRC-32 of what stands before.
CHECKED = {
    "github": ("ghp_ gho_ ghu_ ghs_ ghr_".split(), re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")),
    "npm": (["npm_"], re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")),
}
#: Formats without a checksum.
PLAIN = {
    "key_block": (["-----BEGIN "], re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----")),
    "jwt": (["eyJ"], re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")),
}
#: Order of kinds among spans that start together.
KINDS = ("assign", "access", "hex", *CHECKED, *PLAIN)
BASE_KINDS = KINDS[:3]
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

#: What a web token's part consists of: a token that fails can't begin again before the end of its first part.
_PART = re.compile(r"[A-Za-z0-9_-]*")

_HEXES = np.zeros(256, dtype=bool)
_HEXES[list(b"0123456789abcdef")] = True
_RUN = 32
_STEP = 16


def base62_crc(body: str) -> str:
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out.rjust(6, "0")


def automaton():
    import ahocorasick

    auto = ahocorasick.Automaton()
    for k in KEYWORDS:
        auto.add_word(k, ("assign", len(k)))
    auto.add_word("akia", ("access", 4))
    for kind, (prefixes, _) in (CHECKED | PLAIN).items():
        for p in prefixes:
            auto.add_word(p.lower(), (kind, len(p)))
    auto.make_automaton()
    return auto


def hex_runs(text: str) -> list[tuple[int, int]]:
    """All maximal runs of 32 or more lower-case hexadecimal digits, in code points."""
    raw = np.frombuffer(text.encode("latin-1", "replace"), dtype=np.uint8)  # a byte a code point; no replacement is a digit
    probe = _HEXES[raw[_STEP - 1 :: _STEP]]
    near = np.flatnonzero(probe[:-1] & probe[1:])  # two neighbouring probes lie in any run of 32
    out, end = [], 0
    for k in near.tolist():
        at = (k + 1) * _STEP - 1
        if at < end:
            continue
        if not _HEXES[raw[at : at + _STEP]].all():
            continue
        start = at
        while start > end and _HEXES[raw[start - 1]]:
            start -= 1
        end = HEX.match(text, start).end()
        if end - start >= _RUN:
            out.append((start, end))
    return out


def find(text: str | None, auto) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets of a text, in code points, by start and then kind as listed."""
    if not text:
        return []
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z only: as long as the text
    spans = [(a, b, "hex") for a, b in hex_runs(text)]
    done = dict.fromkeys(KINDS, 0)
    for last, (kind, n) in auto.iter(low):
        start = last + 1 - n
        if start < done[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(text, start):
                done[kind] = m.end()
                if len(m[2]) >= 8:
                    spans.append((start, m.end(), kind))
        elif kind == "access":
            if m := ACCESS.match(text, start):
                done[kind] = m.end()
                if m.end() - start >= 16:
                    spans.append((start, m.end(), kind))
        elif kind in CHECKED:
            m = CHECKED[kind][1].match(text, start)
            if m and base62_crc(m[1]) == m[2]:
                done[kind] = m.end()
                spans.append((start, m.end(), kind))
        elif m := PLAIN[kind][1].match(text, start):
            done[kind] = m.end()
            spans.append((start, m.end(), kind))
        elif kind == "jwt":
            done[kind] = _PART.match(text, start).end()
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def secrets(docs: DataFrame, *, keep: list[str] | None = None, redact: str | None = None) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans (+ `keep`).

    spans lists kind:start:end (code points, end exclusive), by start and then kind;
    base_sha256 digests the base kinds alone. With `redact`, a column `redacted` holds
    the text with the union of all spans replaced by that string. A null text counts as
    empty: no spans (and a null redacted text). Repeated rows are scanned each; a text of
    any length is scanned whole. Columns beyond doc_id, text and `keep` are ignored.
    """
    keep = [c for c in keep or [] if c not in ("doc_id", "text")]
    kinds = dict(docs.dtypes)
    base = docs.select("doc_id", "text", *[F.col(c).alias(f"_keep_{c}") for c in keep])
    schema = f"doc_id {kinds['doc_id']}, " + "".join(f"`_keep_{c}` {kinds[c]}, " for c in keep) + "n_assign long, n_access long, n_hex long, base_sha256 string, spans string" + (", redacted string" if redact is not None else "")
    out = base.mapInArrow(_scanner(redact), schema)
    return out.withColumnsRenamed({f"_keep_{c}": c for c in keep})


def cover(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _scanner(redact: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton()
        for batch in batches:
            at = batch.schema.get_field_index("text")
            rows: list[tuple] = []
            for value in batch.column(at):
                text = value.as_py()
                spans = find(text, auto)
                said = [f"{k}:{a}:{b}" for a, b, k in spans]
                base = [s for s, x in zip(said, spans, strict=True) if x[2] in BASE_KINDS]
                row = (*[sum(x[2] == k for x in spans) for k in BASE_KINDS], hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(said))
                if redact is not None:
                    row += (cover(text, spans, redact) if spans else text,)
                rows.append(row)
            own = [*(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.string()] * 3, strict=False))] if rows else []
            kept = [(f.name, c) for f, c in zip(batch.schema, batch.columns, strict=True) if f.name != "text"]
            if rows:
                yield pa.RecordBatch.from_arrays([*[c for _, c in kept], *own], names=[*[n for n, _ in kept], "n_assign", "n_access", "n_hex", "base_sha256", "spans", *(["redacted"] if redact is not None else [])])

    return run
