"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language in every task (one array per language,
merged by blocks in a shuffle), over all training rows.  The matrix of log
probabilities (languages x buckets floats) is broadcast; batches of texts
are scored in numpy by summing the rows of their n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id, extended, text_slices

#: Hash buckets of all orders together, orders, Laplace weight, buckets in one merged block.
BUCKETS, ORDERS, SMOOTHING, BLOCK = 1 << 16, (1, 2, 3), 0.5, 1 << 12
#: Float32 bytes of the broadcast matrix that are accepted (languages x BUCKETS x 4).
MATRIX_BYTES = 512 << 20
UNKNOWN = "und"
_WINDOWS = 1 << 20
_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Code point -> lower-case letter, 0 for anything that is no letter."""
    global _letter
    if _letter is None:
        out = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                out[i] = ord(low) if len(low) == 1 else i
        _letter = out
    return _letter


def ngrams(texts: list[str | None], buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text number) of all n-grams, grouped by order, and whether a text has a letter.

    A run of other characters is one boundary mark; a text starts and ends
    with one, so no n-gram spans two texts.
    """
    raw = [("\n" + (t or "") + "\n").encode("utf-32-le", "surrogatepass") for t in texts]
    sizes = np.fromiter((len(r) // 4 for r in raw), np.int64, len(raw))
    code = _letters()[np.frombuffer(b"".join(raw), "<u4")]
    of = np.repeat(np.arange(len(texts)), sizes)
    gap = code == 0
    keep = ~(gap & np.concatenate([[False], gap[:-1] & (of[1:] == of[:-1])]))
    code, of = code[keep].astype(np.uint64), of[keep]
    has_letter = np.bincount(of[code > 0], minlength=len(texts)) > 0
    found, owner = [], []
    for order in orders:
        n = len(code) - order + 1
        if n <= 0:
            continue
        h = np.full(n, order, np.uint64)
        for k in range(order):
            h = (h ^ code[k:n + k]) * np.uint64(0x9E3779B97F4A7C15)
        inside = of[:n] == of[order - 1:]
        if order == 1:
            inside &= code > 0
        found.append((h[inside] >> np.uint64(40)).astype(np.int64) % buckets)
        owner.append(of[:n][inside])
    return (np.concatenate(found) if found else np.zeros(0, np.int64)), (np.concatenate(owner) if owner else np.zeros(0, np.int64)), has_letter


def train(labelled: DataFrame, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> tuple[list[str], np.ndarray]:
    """(languages in order, log probabilities [buckets, languages] with the log prior as last row) from (text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        number: dict[str, int] = {}
        for part, texts in text_slices(batches, "text", 1 << 20):
            langs = part.column(1).to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs) if x == lang]
                table = tables.setdefault(lang, np.zeros(buckets, np.int64))
                table += np.bincount(ngrams(own, buckets, orders)[0], minlength=buckets)
                number[lang] = number.get(lang, 0) + len(own)
        for lang, table in tables.items():
            blocks = [table[a:a + BLOCK] for a in range(0, buckets, BLOCK)] + [np.array([number[lang]])]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(blocks)), pa.array(range(len(blocks)), pa.int32()),
                                              pa.array([b.astype("<i8").tobytes() for b in blocks], pa.binary())], names=["lang", "block", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<i8") for x in table["counts"].to_pylist())
        return pa.table({"lang": table["lang"][:1], "block": table["block"][:1], "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "lang string, block int, counts binary"
    merged = labelled.select("text", "lang").mapInArrow(count, schema).groupBy("lang", "block").applyInArrow(merge, schema)
    rows = merged.collect()  # languages x buckets numbers
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return [], np.zeros((buckets + 1, 0), np.float32)
    counts = np.zeros((len(languages), -(-buckets // BLOCK) * BLOCK))
    prior = np.zeros(len(languages))
    last = -(-buckets // BLOCK)
    for r in rows:
        k, values = languages.index(r["lang"]), np.frombuffer(r["counts"], "<i8")
        if r["block"] == last:
            prior[k] = values[0]
        else:
            counts[k, r["block"] * BLOCK:r["block"] * BLOCK + len(values)] = values
    counts = counts[:, :buckets] + SMOOTHING
    log_p = np.log(counts) - np.log(counts.sum(axis=1, keepdims=True))
    return languages, np.vstack([log_p.T, np.log(prior / prior.sum())]).astype(np.float32)


def log_scores(texts: list[str | None], matrix: np.ndarray, orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """(log score per text and language, whether the text has a letter)."""
    bucket, owner, has_letter = ngrams(texts, len(matrix) - 1, orders)
    total = np.tile(matrix[-1].astype(np.float64), (len(texts), 1))
    step = max(1024, _WINDOWS * 4 // max(4, matrix.shape[1]))
    for a in range(0, len(bucket), step):
        own = owner[a:a + step]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        np.add.at(total, own[first], np.add.reduceat(matrix[bucket[a:a + step]], first, axis=0, dtype=np.float64))
    return total, has_letter


def predict(docs: DataFrame, languages: list[str], matrix: np.ndarray, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (posterior of the prediction), replacing columns of these names."""
    if matrix.nbytes > MATRIX_BYTES:
        raise ValueError(f"the matrix of {len(languages)} languages takes {matrix.nbytes} bytes; use fewer buckets")
    held = docs.sparkSession.sparkContext.broadcast(matrix)
    base = docs.drop("lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for part, texts in text_slices(batches, text_col, 1 << 20):
            if m.shape[1]:
                total, has_letter = log_scores(texts, m)
                best = total.argmax(axis=1)
                share = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            else:
                best = share = has_letter = np.zeros(len(texts), np.int64)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array([languages[b] if ok else UNKNOWN for b, ok in zip(best, has_letter)]),
                 pa.array([float(s) if ok else 0.0 for s, ok in zip(share, has_letter)], pa.float64())],
                names=[*part.schema.names, "lang_pred", "score"])

    return base.mapInArrow(run, extended(base.schema, "lang_pred string, score double"))


def language_id(docs: DataFrame, held_out: Column, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the rows that are not held out and predicts all: docs with held_out, lang_pred, score.

    A null text, or one without a letter, is ``und`` with score 0; so is
    everything when no row can be learned from.  A null language is not
    learned.  Repeated rows count as often as they occur and get the same
    prediction; an empty table gives an empty table.
    """
    labelled = docs.where(~held_out & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    languages, matrix = train(labelled)
    return predict(docs.withColumn("held_out", held_out), languages, matrix, text_col)


def held_out_quarter(id_col: str) -> Column:
    return crc32_of_id(id_col) % 4 == 2
