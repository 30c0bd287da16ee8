"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nullwise.session import ensure_checkpoint_dir

#: A word is a maximal run of characters other than these (space, tab to carriage return).
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Characters that str.split() takes for white space and WORD does not.
_WIDER = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Bytes of text that the numpy steps hold at once (a single longer text is one slice).
SLICE_BYTES = 4 << 20
VOCABULARY_DIR = "/opt/tokenizers"


def words(text: str) -> list[str]:
    """The words of a text, the same as WORD.findall(text)."""
    return text.split() if _WIDER.search(text) is None else WORD.findall(text)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all executors share (spark.checkpoint.dir)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs the running stage only, and
    later uses read the columns they need instead of computing them again.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def extended(schema: T.StructType, columns: str) -> T.StructType:
    """A copy of schema with more columns ("name type, name type")."""
    out = T.StructType(list(schema.fields))
    for c in columns.split(", "):
        out = out.add(*c.split())
    return out


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vocabulary(name: str, folder: str | None = None) -> str:
    """Path of a public vocabulary file; the folder is a parameter."""
    return os.path.join(folder or VOCABULARY_DIR, name)


_held: dict = {}


def worker_held(key, make: Callable):
    """make(), held by this process until another key is asked for.

    A Python worker serves one stage after another; what a stage built once
    (a vocabulary, word tables) makes room for what the next one builds.
    """
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def text_slices(batches: Iterator[pa.RecordBatch], text_col: str,
                limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """(rows, texts) with about ``limit`` bytes of text each; nulls stay None."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text_col))
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0), dtype=np.int64)
        start, n = 0, batch.num_rows
        ends = np.cumsum(sizes)
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            part = batch.slice(start, stop - start)
            yield part, part.column(part.schema.get_field_index(text_col)).to_pylist()
            start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits (unsigned, wrapping)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordTable:
    """Codes for distinct words with one packed row of integers per word.

    ``encode`` gives the integers of words not seen before (a tokenizer run
    on single words).  Held by a Python worker between batches; ``room``
    bounds it: when full it starts again empty, which costs time only.
    """

    def __init__(self, encode, room: int = 400_000):
        self.encode, self.room = encode, room
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.values = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 14, np.int64)

    def codes(self, tokens: list[str]) -> np.ndarray:
        """Code of each word; call ``clear_if_full`` between uses of the codes."""
        new = [w for w in dict.fromkeys(tokens) if w not in self.code]
        if new:
            self._add(new)
        return np.fromiter(map(self.code.__getitem__, tokens), np.int64, len(tokens))

    def _add(self, new: list[str]) -> None:
        rows = self.encode(new)
        n = len(self.code)
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        while n + len(new) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        first = self.start[n]
        self.start[n + 1:n + len(new) + 1] = first + np.cumsum(lengths)
        end = int(self.start[n + len(new)])
        while end > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        if end > first:
            self.values[first:end] = np.fromiter(chain.from_iterable(rows), np.int32, int(end - first))
        self.code.update(zip(new, range(n, n + len(new))))

    def clear_if_full(self) -> None:
        if len(self.code) > self.room:
            self.clear()

    def lengths(self, codes: np.ndarray) -> np.ndarray:
        return self.start[codes + 1] - self.start[codes]

    def gather(self, codes: np.ndarray) -> np.ndarray:
        """The integers of all words, one after another."""
        n = self.lengths(codes)
        total = int(n.sum())
        if not total:
            return np.zeros(0, np.int32)
        shift = np.repeat(self.start[codes] - (np.cumsum(n) - n), n)
        return self.values[np.arange(total) + shift]


def crc32_of_id(column: str):
    """crc32 of the id as text (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
