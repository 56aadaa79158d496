"""Models as pluggable providers. Every model step has a deterministic offline provider as its default.

A provider is a callable on a batch of strings; it runs inside Arrow batches of a
partition, so it can open one connection per partition and send requests side by side.
"""

from __future__ import annotations

import hashlib
import os
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Complete = Callable[[list[str]], list[str | None]]


@dataclass
class Registry:
    """Named providers; `pick` reads the choice from a setting, and unknown names raise."""

    table: dict[str, Callable] = field(default_factory=dict)

    def register(self, name: str, provider: Callable) -> None:
        self.table[name] = provider

    def pick(self, name: str | None = None, variable: str = "LOREWRIGHT_PROVIDER", default: str = "offline") -> Callable:
        name = name or os.environ.get(variable, default)
        if name not in self.table:
            raise ValueError(f"unknown provider {name!r}; known: {', '.join(sorted(self.table))}")
        return self.table[name]


completions, embeddings = Registry(), Registry()


def retried(one: Callable[[str], str], *, workers: int = 5, tries: int = 3, limited: type[Exception] = TimeoutError) -> Complete:
    """Requests side by side with growing pauses (longer ones after a rate limit); what fails in the end is None."""

    def call(prompt: str) -> str | None:
        for n in range(tries):
            try:
                return one(prompt)
            except limited:
                time.sleep(5 * 2**n)
            except Exception:  # noqa: BLE001  a row that fails must not end the batch
                time.sleep(2**n)
        return None

    def batch(prompts: list[str]) -> list[str | None]:
        with ThreadPoolExecutor(workers) as pool:
            return list(pool.map(call, prompts))

    return batch


def extractive(prompts: list[str]) -> list[str | None]:
    """Offline completion: the first three sentences of the prompt's last paragraph."""
    return [". ".join(p.rstrip().split("\n\n")[-1].split(". ")[:3]) for p in prompts]


@lru_cache(maxsize=1 << 16)
def _word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


def hashed_embedding(texts: list[str], dims: int = 64) -> np.ndarray:
    """Offline embedding: words hashed into signed buckets, scaled to length 1; equal on every machine."""
    out = np.zeros((len(texts), dims), np.float32)
    for i, t in enumerate(texts):
        h = np.fromiter(map(_word_hash, (t or "").lower().split()), np.uint64)
        at, up = (h % np.uint64(dims)).astype(np.int64), h >> np.uint64(63) == 1
        out[i] = np.bincount(at[up], minlength=dims) - np.bincount(at[~up], minlength=dims)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0)


completions.register("offline", extractive)
embeddings.register("offline", hashed_embedding)


def complete(df: DataFrame, prompt: str, out: str = "completion", provider: Complete | None = None) -> DataFrame:
    """Adds a provider's answer to each row; failed rows hold null, and callers fall back to their heuristic."""
    provider = provider or completions.pick()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b[out] = provider(b[prompt].fillna("").tolist())
            yield b

    return df.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {out} string")


def embed(df: DataFrame, text: str, out: str = "embedding", provider: Callable | None = None) -> DataFrame:
    provider = provider or embeddings.pick()

    @F.pandas_udf("array<float>")
    def vectors(x: pd.Series) -> pd.Series:
        return pd.Series(list(provider(x.fillna("").tolist())), dtype=object)

    return df.withColumn(out, vectors(F.col(text)))
