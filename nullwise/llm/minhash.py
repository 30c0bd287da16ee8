"""MinHash near-duplicate detection with exact confirmation.

Method: one-permutation hashing with optimal densification, banded buckets
and star-shaped candidate edges.

1. One pass over the texts gives each document the size and a 128-bit
   fingerprint of its shingle set and a densified one-permutation signature
   (``bins`` values of 16 bits).  Documents with the same set collapse to
   one class, so a group of exact copies is one node from here on.
2. ``bands`` x ``rows`` signature values make bucket keys; in a bucket each
   class is a candidate of the class with the smallest id (a star: at most
   one pair per class and band, never all pairs).
3. Pairs are confirmed on the full shingle sets, built again from the texts
   of the candidates only; a centre's members are dealt over salted groups
   of bounded total size.  Connected components follow.  First every class
   tries one centre.  Buckets that still span components then get a star
   around a medoid, the member nearest to the bucket's most common
   signature, so a large group of near copies is found through its original
   and is one component before its many other stars would be confirmed.
   After that, every star that still leads out of a component.
4. Exact rest: a star cannot see a link between two members that both
   differ from the centre.  In buckets that still span several components,
   members outside the first component are compared with the others in blocks
   of both sides that hold the full sets (each pair once; pairs inside one
   component are skipped; a pair that shares several buckets is compared in
   the first band alone).  What the signature does not rule out is compared
   on the full sets there and then, and a block returns no more links than
   it has members.

Recall rests on the bands alone: a pair with similarity 0.8 shares no
bucket with probability (1 - 0.8**5)**32 = 3e-6; the signature test of step
4 leaves a margin of four standard deviations and 0.02 (computed miss at
similarity 0.8: at most 1e-6 up to unions of 1,000 shingles).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, stored, text_slices, worker_held
from .graph import connected_components

SHINGLE, BANDS, ROWS, PERCENT = 4, 32, 5, 80
#: Bins of a signature; the first BANDS x ROWS make bucket keys, all of them estimate similarities.
BINS = 256
_WIDTH = BINS + BINS // 16
#: Shingles that one confirmation group holds besides the centre's (8 bytes each).
GROUP_SHINGLES = 400_000
#: Bits of the bitmap of documents that a confirmation needs (8 MB).
MARKS = 1 << 26
#: Uses of documents in pairs (40 bytes each) up to which their table is broadcast.
USES = 400_000
#: Members of a bucket that one medoid is chosen from.
MEDOID_BLOCK = 16_384
#: Shingles of a bucket's members in one block of the exact rest, and of those outside the first component (8 bytes each).
REST_SHINGLES = 1_500_000
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_STEP = 1 << 21


class _Hasher:
    """Word hashes of byte buffers from prefix sums of a polynomial modulo 2**64."""

    def __init__(self):
        rng = np.random.default_rng(20240229)
        value = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        value[ord("A"):ord("Z") + 1] = value[ord("a"):ord("z") + 1]  # lower-cases A-Z
        self.value = value
        base = 0x9E3779B97F4A7C15
        self.bases = base, pow(base, -1, 1 << 64)
        self._grow(_STEP)

    def _grow(self, n: int) -> None:
        self.power, self.inverse = (self._powers(b, n + 1) for b in self.bases)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.ones(1, np.uint64)
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
        return out[:n]

    def words(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(hash, start byte) of every word of raw."""
        if len(raw) > _STEP and (gap := _GAP.search(raw, _STEP)) and gap.start() < len(raw) - 1:  # cut after white space
            head, tail = self.words(raw[:gap.end()]), self.words(raw[gap.end():])
            return np.concatenate([head[0], tail[0]]), np.concatenate([head[1], tail[1] + gap.end()])
        if len(raw) > len(self.power) - 1:
            self._grow(len(raw))
        data = np.frombuffer(raw, np.uint8)
        inside = ~_SPACE[data]
        edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.power[:len(data)], out=total[1:])
        return mix64((total[end] - total[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64)), begin


def shingle_sets(texts: list[str | None], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (empty for null or no words)."""
    hasher = worker_held("hasher", _Hasher)
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    ends = np.cumsum(sizes)
    hashes, at = hasher.words(b" ".join(raw))
    first = np.searchsorted(at, ends - sizes)
    last = np.searchsorted(at, ends)
    factor = np.uint64(0xD6E8FEB86659FD93)
    n = len(hashes) - shingle + 1
    if n > 0:
        grams = hashes[:n].copy()
        for k in range(1, shingle):
            grams = grams * factor + hashes[k:n + k]
        grams = mix64(grams)
    out = []
    for a, b in zip(first, last):
        if b - a >= shingle:
            out.append(np.unique(grams[a:b - shingle + 1]))
        elif b > a:  # fewer words: the whole sequence is one shingle
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in hashes[a:b]:
                    h = h * factor + w
            out.append(mix64(np.array([h])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(s: np.ndarray) -> bytes:
    """128 bits that depend on the set alone."""
    other = mix64(s ^ np.uint64(0xA5A5A5A55A5A5A5A))
    return np.array([np.add.reduce(other, dtype=np.uint64), np.bitwise_xor.reduce(mix64(other + s))], np.uint64).tobytes()


class Densifier:
    """Fills empty bins of a one-permutation sketch (optimal densification).

    An empty bin draws bins from a hash of its own number and the attempt
    until it meets a full one; the draws are the same for all documents, so
    two sets with the same full bins copy from the same places.
    """

    def __init__(self, bins: int):
        self.bins = bins
        self.draws: list[np.ndarray] = []

    def draw(self, attempt: int) -> np.ndarray:
        while len(self.draws) <= attempt:
            seed = np.arange(self.bins, dtype=np.uint64) + np.uint64((len(self.draws) + 1) * 1_000_003)
            self.draws.append((mix64(seed * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.bins)).astype(np.int64))
        return self.draws[attempt]

    def signature(self, s: np.ndarray) -> np.ndarray:
        """``bins`` values of 16 bits, then a bit per bin that was full before densification."""
        h = mix64(s ^ np.uint64(0x5851F42D4C957F2D))
        h.sort()
        bin_of = ((h >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)
        first = np.concatenate([[True], bin_of[1:] != bin_of[:-1]])
        value = np.zeros(self.bins, np.uint16)
        full = np.zeros(self.bins, bool)
        value[bin_of[first]] = (mix64(h[first]) >> np.uint64(48)).astype(np.uint16)
        full[bin_of[first]] = True
        empty = np.flatnonzero(~full)
        attempt = 0
        while len(empty):
            source = self.draw(attempt)[empty]
            hit = full[source]
            value[empty[hit]] = value[source[hit]]
            empty = empty[~hit]
            attempt += 1
        return np.concatenate([value, np.packbits(full).view(np.uint16)])


def _sets(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    schema = "id long, n_shingles long, print binary, signature binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = Densifier(BINS)
        for part, texts in text_slices(batches, "text"):
            sets = shingle_sets(texts, shingle)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([fingerprint(s) if len(s) else None for s in sets], pa.binary()),
                 pa.array([dense.signature(s).tobytes() if len(s) else None for s in sets], pa.binary())],
                names=["id", "n_shingles", "print", "signature"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _bands(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(key, id): one row per class and band; the low bits of a key are the band's number."""
    low = np.uint64((1 << (bands - 1).bit_length()) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, _WIDTH)[:, :bands * rows].reshape(-1, bands, rows)
                number = np.broadcast_to(np.arange(bands, dtype=np.uint64), sig.shape[:2])
                key = number + np.uint64(1)
                for k in range(rows):
                    key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, k])
                key = key & ~low | number
                spread = np.repeat(np.arange(part.num_rows), bands)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).ravel()), part.column(0).take(pa.array(spread))], names=["key", "id"])

    return classes.select("id", "signature").mapInArrow(run, "key long, id long")


def _may_link(a: str, b: str, percent: int):
    """Sizes alone allow the similarity."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _marked(ids: DataFrame) -> np.ndarray:
    """A bitmap of MARKS bits, always of the same size, with the hash of every id set."""
    places = ids.select(F.pmod(F.xxhash64("id"), F.lit(MARKS)).alias("at"))
    words = places.select(F.expr("int(at div 64) as word"), F.expr("shiftleft(1L, int(at % 64)) as bit"))
    table = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # MARKS / 64 rows at most
    marks = np.zeros(MARKS // 64, np.int64)
    marks[table["word"].to_numpy()] = table["bits"].to_numpy()
    return marks


def _sets_of(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, shingles) of the documents whose ``id`` is in ids, and of a few others.

    The sets are built where the texts are read: a bitmap of hashed ids lets
    the others (but a few per cent once millions are wanted) go by.
    """
    marks = docs.sparkSession.sparkContext.broadcast(_marked(ids))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = marks.value
        for batch in batches:
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bits[at >> 6] >> (at & 63) & 1).astype(bool)))
            for part, found in text_slices([batch], "text"):
                full = shingle_sets(found, shingle)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in full], pa.binary())], names=["id", "shingles"])
            pa.default_memory_pool().release_unused()

    marked = texts.select("id", "text", F.pmod(F.xxhash64("id"), F.lit(MARKS)).alias("at")).mapInArrow(sets, "id long, shingles binary")
    return marked.where(F.length("shingles") > 0)


def _confirm(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """(u, v) of the pairs (a, b, nb) whose full sets are similar enough.

    Pairs of one centre a are dealt over groups of about GROUP_SHINGLES.
    """
    load = pairs.groupBy("a").agg(F.ceil(F.sum("nb") / F.lit(GROUP_SHINGLES)).cast("int").alias("salts"))
    dealt = stored(pairs.join(load, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt")), "dealt")
    members = dealt.select(F.col("b").alias("use"), "a", "salt", F.lit(False).alias("centre"))
    centres = dealt.select(F.col("a").alias("use"), "a", "salt", F.lit(True).alias("centre")).distinct()
    uses = stored(members.union(centres), "uses")
    sets = _sets_of(uses.select(F.col("use").alias("id")), docs, id_col, text_col, shingle)
    used = sets.join(F.broadcast(uses) if uses.count() <= USES else uses, F.col("id") == F.col("use"))

    def similar(table: pa.Table) -> pa.Table:
        is_centre = np.array(table["centre"].to_pylist())
        sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        ids, a = table["id"].to_pylist(), table["a"][0].as_py()
        links = set()
        members = [i for i in range(len(sets)) if not is_centre[i]]
        for c in np.flatnonzero(is_centre) if members else ():
            centre = sets[c]
            sizes = np.array([len(sets[i]) for i in members])
            all_of = np.concatenate([sets[i] for i in members])
            at = np.minimum(np.searchsorted(centre, all_of), len(centre) - 1)
            both = np.add.reduceat((centre[at] == all_of).astype(np.int64), np.cumsum(sizes) - sizes)
            good = 100 * both >= percent * (sizes + len(centre) - both)
            links.update(ids[i] for i, g in zip(members, good) if g)
        return pa.table({"u": pa.array([a] * len(links), pa.int64()), "v": pa.array(sorted(links), pa.int64())})

    return used.select("a", "salt", "centre", "id", "shingles").groupBy("a", "salt").applyInArrow(similar, "u long, v long")


def _apart(pairs: DataFrame, component: DataFrame) -> DataFrame:
    """The pairs (a, b, nb) whose ends are in different components so far."""
    of_a = component.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    of_b = component.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    both = pairs.join(of_a, "a", "left").join(of_b, "b", "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "nb")


def _estimate(i: int, j: np.ndarray, sig: tuple[np.ndarray, np.ndarray], n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(similarity estimated over the bins full in either set, four standard deviations of it at the least that links).

    The least values of the full bins are a sample of the union drawn
    without replacement, so the shared ones among them are hypergeometric.
    Sets that link have a union of at most (n_i + n_j) / (1 + percent / 100).
    """
    values, full = sig
    either = np.maximum((full[j] | full[i]).sum(axis=1), 1)
    same = ((values[j] == values[i]) & full[j] & full[i]).sum(axis=1)
    least = percent / 100
    union = np.maximum((n[j] + n[i]) / (1 + least), either)
    spread = least * (1 - least) / either * (union - either) / np.maximum(union - 1, 1)
    return same / either, 4 * np.sqrt(spread) + 0.02


def _candidates(i: int, j: np.ndarray, part, n, sig, percent: int, band: int = 0, rows: int = 1) -> np.ndarray:
    """Of the members j, those in another component than i that size and signature allow.

    Members that share one of the first ``band`` bands with i are left to that band's bucket.
    """
    j = j[part[j] != part[i]]
    j = j[percent * np.maximum(n[j], n[i]) <= 100 * np.minimum(n[j], n[i])]
    if band and len(j):
        before = (sig[0][j, :band * rows] == sig[0][i, :band * rows]).reshape(len(j), band, rows)
        j = j[~before.all(axis=2).any(axis=1)]
    if len(j):
        share, slack = _estimate(i, j, sig, n, percent)
        j = j[share >= percent / 100 - slack]
    return j


def _medoid_star(ids, part, n, sig, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, nb) of a star around the member nearest to the bucket's most common signature, the largest component left aside."""
    label, number = np.unique(part, return_inverse=True)
    size = np.bincount(number)
    if len(label) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    some = np.flatnonzero(number != size.argmax()) if size.max() > 1 else np.arange(len(ids))
    inside = np.sort(sig[0][some], axis=0)
    # the most common value of each bin: the longest run of the sorted column
    run = np.ones(inside.shape, np.int32)
    for k in range(1, len(inside)):
        run[k] = np.where(inside[k] == inside[k - 1], run[k - 1] + 1, 1)
    common = inside[run.argmax(axis=0), np.arange(BINS)]
    medoid = some[(sig[0][some] == common).sum(axis=1).argmax()]
    j = _candidates(medoid, np.arange(len(ids)), part, n, sig, percent)
    return np.minimum(ids[j], ids[medoid]), np.maximum(ids[j], ids[medoid]), np.where(ids[j] > ids[medoid], n[j], n[medoid])


def _signatures(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, which bins were full) of signatures."""
    sig = np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, _WIDTH)
    return np.ascontiguousarray(sig[:, :BINS]), np.unpackbits(np.ascontiguousarray(sig[:, BINS:]).view(np.uint8), axis=1).astype(bool)


def _spanning(buckets: DataFrame, classes: DataFrame, component: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, band, id, part, low, m members, s shingles) of the buckets with several components, ``low`` the first of them;
    and the classes with their components."""
    labelled = classes.join(component.withColumnRenamed("node", "id"), "id", "left").select(
        "id", F.coalesce("component", "id").alias("part"), "n", "signature")
    members = buckets.select("key", "band", "id").join(labelled.select("id", "part", "n"), "id")
    spanning = (members.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("m"),
                                           F.sum("n").alias("s")).where(F.col("low") != F.col("high")).drop("high"))
    return stored(members.join(spanning, "key"), "spanning"), labelled


def _medoid_pairs(buckets: DataFrame, classes: DataFrame, component: DataFrame, tested: DataFrame, percent: int, block: int) -> DataFrame:
    """(a, b, nb): untested pairs of different components around the medoid of a block of a bucket."""
    held, labelled = _spanning(buckets, classes, component)
    sides = held.select("key", "id", F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / block)).cast("int").alias("block")).join(labelled, "id")

    def compare(table: pa.Table) -> pa.Table:
        ids, part, n = (table[c].to_numpy() for c in ("id", "part", "n"))
        found = _medoid_star(ids, part, n, _signatures(table["signature"]), percent)
        return pa.table({name: pa.array(f, pa.int64()) for name, f in zip(("a", "b", "nb"), found)})

    found = sides.groupBy("key", "block").applyInArrow(compare, "a long, b long, nb long").distinct()
    return found.join(tested.select("a", "b"), ["a", "b"], "left_anti")


def _forest(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Links that connect what all of them connect, fewer than there are nodes."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for x, y in links:
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            kept.append((x, y))
    return kept


def rest_pairs(outside: np.ndarray, ids, part, n, sig, percent: int, band: int, rows: int, low: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, candidates j) for the members i outside the bucket's first component (``low``) with all others of the block.

    Two members outside would meet twice; the smaller id takes the pair.
    """
    inner = np.flatnonzero(~outside)
    first = part[inner] == low
    for i in np.flatnonzero(outside):
        j = _candidates(i, inner[first | (ids[inner] > ids[i])], part, n, sig, percent, band, rows)
        if len(j):
            yield i, j


def rest_links(pairs: Iterator[tuple[int, np.ndarray]], ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links among the pairs on full sets, as many as it takes to connect what they connect."""
    links = []
    for i, j in pairs:
        mine = sets[i]
        sizes = np.array([len(sets[k]) for k in j])
        others = np.concatenate([sets[k] for k in j])
        at = np.minimum(np.searchsorted(mine, others), len(mine) - 1)
        both = np.add.reduceat((mine[at] == others).astype(np.int64), np.cumsum(sizes) - sizes)
        links += [(int(ids[i]), int(ids[k])) for k in j[100 * both >= percent * (sizes + len(mine) - both)]]
    return _forest(links)


def _dealt(held: DataFrame, block: int) -> DataFrame:
    """(key, low, band, id, block, over, outside): each block of a bucket's members with each block ``over`` of those
    outside its first component; a block holds about ``block`` shingles of the bucket's s, or of the o outside."""
    blocks, over = (F.ceil(F.col(c) / block).cast("int") for c in ("s", "o"))
    mine = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    inner = held.select("key", "low", "band", "id", mine(blocks).alias("block"), every(over).alias("over"), F.lit(False).alias("outside"))
    outer = held.where(F.col("part") != F.col("low")).select(
        "key", "low", "band", "id", every(blocks).alias("block"), mine(over).alias("over"), F.lit(True).alias("outside"))
    return inner.union(outer)


def _rest(buckets: DataFrame, classes: DataFrame, component: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int,
          percent: int, rows: int, block: int) -> DataFrame:
    """(u, v): links on full sets between components that meet in a bucket, compared in blocks of both sides."""
    held, labelled = _spanning(buckets, classes, component)
    outside = held.where(F.col("part") != F.col("low")).groupBy("key").agg(F.sum("n").alias("o"))
    sets = _sets_of(held.select("id"), docs, id_col, text_col, shingle)
    sides = _dealt(held.join(outside, "key"), block).join(labelled, "id").join(sets, "id")

    def compare(table: pa.Table) -> pa.Table:
        outside = np.array(table["outside"].to_pylist())
        ids, part, n = (table[c].to_numpy() for c in ("id", "part", "n"))
        full = [np.frombuffer(x.as_buffer(), np.uint64) for c in table["shingles"].chunks for x in c]
        pairs = rest_pairs(outside, ids, part, n, _signatures(table["signature"]), percent, table["band"][0].as_py(), rows, table["low"][0].as_py())
        links = rest_links(pairs, ids, full, percent)
        u, v = zip(*links) if links else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return sides.groupBy("key", "block", "over").applyInArrow(compare, "u long, v long")


def minhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                  bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT) -> DataFrame:
    """Near-duplicate classes: id_col, n_shingles, component_id, kept; one row per input row.

    A null or wordless text has n_shingles 0 and is its own component.  A
    row without an id links with nothing: its component_id is that of its
    exact copies if one of them has an id (then it is not kept), else null
    (then it is kept).  Repeated rows (same id and text) get the same
    values.  An empty table gives an empty table; other columns of docs are
    neither read nor returned.
    """
    sets = stored(_sets(docs, id_col, text_col, shingle), "sets")
    with_words = sets.where(F.col("n_shingles") > 0)
    classes = stored(with_words.groupBy("print").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n"),
                                                     F.first("signature").alias("signature")), "classes")
    nodes = classes.where(F.col("id").isNotNull())
    banded = _bands(nodes, bands, rows)
    centres = banded.groupBy("key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("m")).where(F.col("m") > 1).select("key", "a")
    band = F.col("key").bitwiseAND(F.lit((1 << (bands - 1).bit_length()) - 1)).cast("int")
    shared = stored(banded.join(centres, "key").select("key", "id", band.alias("band"), "a"), "buckets")
    sized = shared.where(F.col("id") != F.col("a")).select("a", F.col("id").alias("b")).distinct()
    for end in ("a", "b"):
        sized = sized.join(nodes.select(F.col("id").alias(end), F.col("n").alias(f"n{end}")), end)
    stars = stored(sized.where(_may_link("nb", "na", percent)).select("a", "b", "nb"), "stars")
    tested, links, component = None, None, None

    def confirm(pairs: DataFrame) -> bool:
        """Confirms stored pairs, if any, and brings the components up to date."""
        nonlocal tested, links, component
        if links is not None and pairs.isEmpty():
            return False
        found = stored(_confirm(pairs, docs, id_col, text_col, shingle, percent), "links")
        tested, links = (pairs, found) if links is None else (tested.union(pairs), links.union(found))
        component = stored(connected_components(links), "components")
        return True

    confirm(stored(stars.groupBy("b").agg(F.min(F.struct("a", "nb")).alias("c")).select("c.a", "b", "c.nb"), "pairs"))
    confirm(stored(_medoid_pairs(shared, nodes, component, tested, percent, MEDOID_BLOCK), "pairs"))
    confirm(stored(_apart(stars.join(tested.select("a", "b"), ["a", "b"], "left_anti"), component).distinct(), "pairs"))
    rest = stored(_rest(shared, nodes, component, docs, id_col, text_col, shingle, percent, rows, REST_SHINGLES), "links")
    if not rest.isEmpty():
        component = stored(connected_components(links.union(rest)), "components")
    named = classes.join(component, F.col("id") == F.col("node"), "left").select(
        "print", F.coalesce("component", "id").alias("component_id"))
    out = sets.select("id", "n_shingles", "print").join(named, "print", "left")
    whole = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", whole.alias("component_id"),
                      F.coalesce(F.col("id") == whole, whole.isNull()).alias("kept"))
