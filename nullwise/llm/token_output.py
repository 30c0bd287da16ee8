"""Token-id output: documents packed into binary id matrices.

Each task tokenises its documents, splits those longer than a sequence
without loss, packs the pieces by best-fit decreasing (segment-tree search
for the fullest sequence that fits) and writes binary files to the shared
folder: the id matrix, the cumulative segment lengths of every row and the
position at which each segment starts (0: positions restart there).  No
token leaves the task that made it, so nothing is shuffled.  A file counts
only if the manifest lists it; files of lost or repeated attempts are left
unread.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stored, text_slices, vocabulary
from .fertility import ByteVocabulary
from .files import open_input, open_output
from .packing import best_fit_decreasing

VOCABULARY, LENGTH = "byte_bpe_multi_50k.tiktoken", 2048
#: Tokens that a task holds before it packs and writes them.
BUFFER = 4_000_000
_PARTS = ("ids", "row_start", "cu_seqlens", "position", "doc_id", "has_id", "piece", "start")


def write_file(path: str, pieces: list[tuple], length: int, pad: int, dtype: str) -> int:
    """Packs pieces (id, piece, start, ids) and writes one file; returns its rows."""
    sizes = np.array([len(p[3]) for p in pieces], np.int64)
    row_of, offset, n = best_fit_decreasing(sizes, length)
    ids = np.full((n, length), pad, dtype)
    order = np.lexsort((offset, row_of))
    cu, starts = [], np.zeros(n + 1, np.int64)
    for i in order:
        ids[row_of[i], offset[i]:offset[i] + sizes[i]] = pieces[i][3]
        if offset[i] == 0:
            cu.append(0)
        cu.append(int(offset[i] + sizes[i]))
        starts[row_of[i] + 1] = len(cu)
    arrays = {"ids": ids, "row_start": starts, "cu_seqlens": np.array(cu, "<i4"),
              "position": np.zeros(len(pieces), "<i4"),  # every segment restarts at 0
              "doc_id": np.array([pieces[i][0] or 0 for i in order], "<i8"),
              "has_id": np.array([pieces[i][0] is not None for i in order]),
              "piece": np.array([pieces[i][1] for i in order], "<i4"),
              "start": np.array([pieces[i][2] for i in order], "<i8")}
    with open_output(path) as out:
        for name in _PARTS:
            np.lib.format.write_array(out, arrays[name], allow_pickle=False)
    return n


def read_file(path: str) -> dict[str, np.ndarray]:
    """The arrays of one file; ``position_ids`` are the positions of all tokens, restarted per segment."""
    with open_input(path) as source:
        out = {name: np.lib.format.read_array(source, allow_pickle=False) for name in _PARTS}
    rows = []
    for a, b in zip(out["row_start"][:-1], out["row_start"][1:]):
        cu = out["cu_seqlens"][a:b]
        filled = np.concatenate([np.arange(n) for n in np.diff(cu)])
        rows.append(np.pad(filled, (0, out["ids"].shape[1] - len(filled))))
    out["position_ids"] = np.array(rows, np.int32).reshape(out["ids"].shape)
    return out


def write_tokens(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                 vocabulary_path: str | None = None, buffer: int = BUFFER) -> DataFrame:
    """Writes the packed files and returns their manifest: file, n_rows, n_pieces.

    Every document ends with the vocabulary's first free id (the end mark,
    also the padding).  A null or empty text is that mark alone.
    """
    path = vocabulary_path or vocabulary(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = ByteVocabulary.load(path)
        end = words.size
        dtype = "<u2" if end < 1 << 16 else "<u4"
        held, tokens = [], 0

        def flush() -> pa.RecordBatch:
            name = f"{folder}/{uuid.uuid4().hex}.bin"
            n = write_file(name, held, length, end, dtype)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([len(held)], pa.int64())],
                                              names=["file", "n_rows", "n_pieces"])

        for part, texts in text_slices(batches, "text"):
            for doc_id, text in zip(part.column(0).to_pylist(), texts):
                ids = np.append(words.encode(text or ""), end).astype(dtype)
                for piece, start in enumerate(range(0, len(ids), length)):
                    held.append((doc_id, piece, start, ids[start:start + length]))
                    tokens += len(held[-1][3])
                    if tokens >= buffer:
                        yield flush()
                        held, tokens = [], 0
        if held:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "file string, n_rows long, n_pieces long")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """One row per piece, from the written files: doc_id, piece, start, length, ids_crc32, file, row, offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                f = read_file(file)
                out = []
                k = 0
                for row, (a, b) in enumerate(zip(f["row_start"][:-1], f["row_start"][1:])):
                    cu = f["cu_seqlens"][a:b].tolist()
                    for lo, hi in zip(cu[:-1], cu[1:]):
                        out.append((int(f["doc_id"][k]) if f["has_id"][k] else None, int(f["piece"][k]), int(f["start"][k]), hi - lo,
                                    zlib.crc32(f["ids"][row, lo:hi].astype("<u4")), row, lo))
                        k += 1
                cols = [pa.array(c, pa.int64()) for c in zip(*out)]
                cols[1] = cols[1].cast(pa.int32())
                yield pa.RecordBatch.from_arrays([*cols, pa.array([file.rpartition("/")[2]] * len(out))],
                                                 names=["doc_id", "piece", "start", "length", "ids_crc32", "row", "offset", "file"])

    files = max(1, manifest.sparkSession.sparkContext.defaultParallelism)
    return manifest.select("file").repartition(files).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, row long, offset long, file string")


def token_output(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Writes the packed files to the shared folder and reads them back, one row per piece.

    Nulls, empty texts and null ids as in ``write_tokens``; repeated rows
    are written each on its own; an empty table writes no file and gives an
    empty table; other columns of docs are neither read nor returned.
    """
    folder = shared_dir(docs.sparkSession, "tokens")
    manifest = stored(write_tokens(docs, folder, id_col, text_col, **options), "manifest")
    return read_tokens(manifest).withColumnRenamed("doc_id", id_col)
