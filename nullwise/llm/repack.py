"""Best-fit packing with certified rounds.

Texts are tokenised where they lie; only (id, piece, length, checksum) rows
are dealt out.  Each partition runs best-fit decreasing and certifies its
bin count against dual-feasible-function lower bounds.  A partition that
meets its bound is final.  One that does not keeps its full bins and
releases the rest; released pieces of all such partitions are exchanged
(dealt anew) and packed again, until nothing is open, the open pieces as a
whole meet their bound, or ``rounds`` is reached.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordTable, stored, text_slices, vocabulary, words, worker_held
from .packing import best_fit_decreasing, bound_of_counts, lower_bound

VOCABULARY, CAPACITY, END_ID = "word_bpe_49k.json", 2048, 0
#: Words that a Python worker remembers, and half as many of their parts (some 200 bytes each); when full it starts again.
WORDS = 300_000
#: Bytes of text whose words a Python worker holds at once (a single longer text is one slice).
SLICE = 1 << 20
#: Pieces that one partition packs (40 bytes each): grows no further with the input.
PIECES, ROUNDS = 50_000, 4
#: Letters whose normal form and lower case are plain, then marks: exactly two pre-tokens of the vocabulary.
_END = np.array([END_ID], "<u4").tobytes()
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")


class WordEncoder:
    """Token ids of single words.

    The vocabulary drops white space and never joins across it, so the ids
    of a text are those of its words in a row.  Plain words (letters, then
    marks) are two pre-tokens, whose ids come from the tokenizer's model and
    are remembered; any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str, room: int = WORDS // 2):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.room, self.known = room, {}
        #: one object per id, whatever the number of remembered parts it is in
        self.number = list(range(self.tokenizer.get_vocab_size()))
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        #: byte -> letter of the byte-level alphabet
        self.letter = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}

    def _learn(self, text: str) -> tuple[int, ...]:
        if len(self.known) > self.room:
            self.known.clear()
        letters = text if text.isascii() else "".join(map(self.letter.__getitem__, text.encode()))
        found = self.known[text] = tuple([self.number[t.id] for t in self.model.tokenize(letters)])
        return found

    def __call__(self, chunks: list[str]) -> list[Sequence[int]]:
        out, odd = [], []
        known, learn, plain_of = self.known.get, self._learn, _PLAIN.fullmatch
        for chunk in chunks:
            marks = ""
            if chunk.isalpha() and chunk.isascii():
                letters = chunk.lower()
            elif plain := plain_of(chunk):
                letters, marks = plain[1].lower(), plain[2]
            else:
                odd.append(len(out))
                out.append([])
                continue
            ids = known(letters) or learn(letters)
            out.append(ids + (known(marks) or learn(marks)) if marks else ids)
        if odd:
            for i, e in zip(odd, self.tokenizer.encode_batch_fast([chunks[i] for i in odd], add_special_tokens=False)):
                out[i] = e.ids
        return out


def encoder_table(path: str) -> WordTable:
    return WordTable(WordEncoder(path), WORDS)


def _tokenised(docs: DataFrame, id_col: str, text_col: str, path: str, capacity: int) -> DataFrame:
    schema = "id long, piece int, start long, length long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(path)
        for part, texts in text_slices(batches, "text", SLICE):
            table.clear_if_full()
            found = [words(t) if t else [] for t in texts]
            codes = table.codes(list(chain.from_iterable(found)))
            ids = table.gather(codes).astype("<u4")
            until = np.concatenate([[0], np.cumsum(table.lengths(codes))])[np.cumsum([0, *map(len, found)])]
            rows, row_of = [], []
            for i, (a, b) in enumerate(zip(until[:-1].tolist(), until[1:].tolist())):
                for piece, start in enumerate(range(a, b + 1, capacity)):
                    cut = ids[start:min(b, start + capacity)]
                    crc = zlib.crc32(cut)
                    ends = start + capacity > b  # the end mark is in this piece
                    rows.append((piece, start - a, len(cut) + ends, zlib.crc32(_END, crc) if ends else crc))
                    row_of.append(i)
            piece, start, length, crc = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(row_of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _table(path: str) -> WordTable:
    return worker_held(("pieces", path), lambda: encoder_table(path))


def _round(open_pieces: DataFrame, n: int, number: int, capacity: int, per_group: int) -> DataFrame:
    """One round of packing: adds sequence_id, offset and open (released for the next round)."""
    groups = -(-n // per_group)
    dealt = open_pieces.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(number)), F.lit(groups)))

    def pack(table: pa.Table) -> pa.Table:
        lengths = table["length"].to_numpy()
        bin_of, offset, bins = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bin_of, weights=lengths, minlength=bins)
        gap = bins > lower_bound(lengths, capacity)
        first = ((number << 20) + table["group"][0].as_py()) << 32
        return table.drop_columns(["group"]).append_column("sequence_id", pa.array(first + bin_of)).append_column(
            "offset", pa.array(offset)).append_column("open", pa.array(gap & (fill[bin_of] < capacity)))

    return dealt.groupBy("group").applyInArrow(
        pack, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, open boolean")


def _bound(pieces: DataFrame, capacity: int) -> int:
    """Lower bound over all rows, from the counts per length (capacity rows at most)."""
    number = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():
        number[r["length"]] = r["count"]
    return bound_of_counts(number, capacity)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                   vocabulary_path: str | None = None, per_group: int = PIECES, rounds: int = ROUNDS) -> DataFrame:
    """Packs every document (its ids, then END_ID) into sequences of ``capacity``.

    One row per piece: id_col, piece, start, length, ids_crc32, sequence_id,
    offset.  Only documents longer than the capacity are cut.  A null or
    empty text is the single END_ID; a null id is kept; repeated rows are
    packed each on its own; an empty table gives an empty table; other
    columns of docs are neither read nor returned.
    """
    path = vocabulary_path or vocabulary(VOCABULARY)
    pieces = stored(_tokenised(docs, id_col, text_col, path, capacity), "pieces")
    columns = ["id", "piece", "start", "length", "ids_crc32"]
    done, current = None, pieces
    n = pieces.count()
    number = 0
    while n:
        packed = stored(_round(current.select(columns), n, number, capacity, per_group), "packed")
        opened = packed.where("open")
        n_open, bins = opened.agg(F.count(F.lit(1)), F.sum((F.col("offset") == 0).cast("int"))).first()
        number += 1
        last = number == rounds or not n_open or n <= per_group or bins == _bound(opened, capacity)
        final = packed if last else packed.where(~F.col("open"))
        done = final if done is None else done.union(final)
        current, n = opened, 0 if last else n_open
    if done is None:
        done = pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    return done.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
