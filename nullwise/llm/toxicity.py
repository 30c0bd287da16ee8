"""Toxicity scores from a bidirectional gated recurrent network with attention.

Input of a word: the embedding of its hash next to the mean embedding of its
hashed character 3-grams and beginnings, so unseen words are read by their
spelling.  Two
gated recurrent layers read a window of words in both directions, attention
pools their states and a logistic output scores the window.  A text is cut
into overlapping windows that cover every word; its score is that of its
most toxic window.

The network is trained in numpy on the driver, on a bounded sample of
labelled rows (``SAMPLE_ROWS`` per class, ``SAMPLE_WINDOWS`` evenly spaced
windows of a longer text).  Labels belong to texts, not to windows, so each
epoch trains on the window of a text that currently scores highest (the
first ones are chosen by how much more often their words and 3-grams
occur in toxic texts).  The
weights, a few megabytes, are broadcast; scoring is one narrow pass
in numpy batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id, extended, mix64, stored, text_slices, words

SAMPLE_ROWS, SAMPLE_WINDOWS = 2000, 16
WORD_BUCKETS, GRAM_BUCKETS, WORD_DIM, GRAM_DIM, HIDDEN, ATTENTION = 1 << 14, 1 << 16, 8, 12, 8, 8
PREFIXES = (3, 4, 5, 6, 7, 8)
WINDOW, STRIDE, EPOCHS, MIN_STEPS, BATCH, RATE = 48, 36, 10, 500, 128, 0.02
_CHUNK, _WORDS = 2048, 16_384


def word_features(found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word bucket, character buckets of all words in a row, start of each word's) of lower-cased words.

    The characters of a word are its 3-grams (of bytes, with a space at both
    ends) and its beginnings of PREFIXES bytes.
    """
    raw = [f" {w.lower()} ".encode("utf-8", "replace") for w in found]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    begin = np.cumsum(size) - size
    n_grams = size - 2
    gram = mix64(data[:-2] << np.uint64(16) | data[1:-1] << np.uint64(8) | data[2:])
    place = np.arange(len(data)) - np.repeat(begin, size)
    # hash of a beginning: sum of its bytes, each mixed with its place
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(data ^ mix64(place.astype(np.uint64) + np.uint64(1))))])
    prefix = np.array([mix64((total[begin + np.minimum(size, k + 1)] - total[begin]) + np.uint64(k)) for k in PREFIXES])
    has = np.array([size - 2 >= k for k in PREFIXES])
    counts = n_grams + has.sum(axis=0)
    start = np.cumsum(counts) - counts
    out = np.empty(counts.sum(), np.uint64)
    inside = place < np.repeat(n_grams, size)
    out[(np.repeat(start, size) + place)[inside]] = gram[inside[:len(gram)]]
    for k in range(len(PREFIXES)):  # longer beginnings come later, so those a word has are the first
        out[(start + n_grams + k)[has[k]]] = prefix[k][has[k]]
    word = mix64(total[begin + size] - total[begin]) % np.uint64(WORD_BUCKETS)
    return word.astype(np.int64), (out % np.uint64(GRAM_BUCKETS)).astype(np.int64), start


def window_starts(n: int) -> np.ndarray:
    """Starts of the overlapping windows that cover n words; the last one ends with the text."""
    if n <= WINDOW:
        return np.zeros(min(n, 1), np.int64)
    return np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


class Network:
    """Weights and passes; float32 throughout."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        shape = {"word": (WORD_BUCKETS, WORD_DIM), "gram": (GRAM_BUCKETS, GRAM_DIM), "att": (2 * HIDDEN, ATTENTION),
                 "att_b": (ATTENTION,), "att_v": (ATTENTION,), "out": (2 * HIDDEN,), "out_b": (1,)}
        for d in "fb":
            shape |= {f"w_{d}": (WORD_DIM + GRAM_DIM, 3 * HIDDEN), f"u_{d}": (HIDDEN, 3 * HIDDEN), f"b_{d}": (3 * HIDDEN,)}
        self.p = {k: (rng.standard_normal(s) * (0.1 if k in ("word", "gram") else s[0] ** -0.5)).astype(np.float32) for k, s in shape.items()}
        for k in ("att_b", "out_b", "b_f", "b_b"):
            self.p[k][:] = 0
        self.shift = 0.0

    # -- passes --------------------------------------------------------------

    def inputs(self, features) -> np.ndarray:
        """Input vector of every distinct word."""
        word, gram, start = features
        out = np.empty((len(word), WORD_DIM + GRAM_DIM), np.float32)
        ends = np.append(start, len(gram))
        for a in range(0, len(word), _WORDS):  # bounds the gathered embeddings
            b = min(len(word), a + _WORDS)
            sums = np.add.reduceat(self.p["gram"][gram[ends[a]:ends[b]]], start[a:b] - ends[a], axis=0)
            out[a:b, :WORD_DIM] = self.p["word"][word[a:b]]
            out[a:b, WORD_DIM:] = sums / np.diff(ends[a:b + 1])[:, None].astype(np.float32)
        return out

    def _states(self, x: np.ndarray, u: np.ndarray, mask: np.ndarray | None, keep: list | None = None) -> np.ndarray:
        """States [time, batch, HIDDEN] from projected inputs [time, batch, 3 HIDDEN]."""
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        out = np.empty((*x.shape[:2], HIDDEN), np.float32)
        for t in range(len(x)):
            g = h @ u
            zr = _sigmoid(x[t, :, :2 * HIDDEN] + g[:, :2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[t, :, 2 * HIDDEN:] + r * g[:, 2 * HIDDEN:])
            step = z * (n - h)
            if mask is not None:
                step = step * mask[t][:, None]
            if keep is not None:
                keep.append((h, z, r, n, g[:, 2 * HIDDEN:]))
            h = h + step
            out[t] = h
        return out

    def _pool(self, states: np.ndarray, mask: np.ndarray | None):
        a = np.tanh(states @ self.p["att"] + self.p["att_b"])
        e = a @ self.p["att_v"]
        if mask is not None:
            e = np.where(mask > 0, e, np.float32(-1e9))
        e = np.exp(e - e.max(axis=0))
        share = e / e.sum(axis=0)
        return a, share, np.einsum("tb,tbh->bh", share, states)

    def logits(self, projected: tuple[np.ndarray, np.ndarray], index: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Window logits; index [windows, WINDOW] points at projected words, unused places anywhere."""
        out = np.empty(len(index), np.float32)
        order = np.argsort(lengths, kind="stable")
        for a in range(0, len(order), _CHUNK):
            rows = order[a:a + _CHUNK]
            longest = int(lengths[rows[-1]])
            at = index[rows, :longest].T
            mask = None
            if lengths[rows[0]] < longest:
                mask = (np.arange(longest)[:, None] < lengths[rows]).astype(np.float32)
            forward = self._states(projected[0][at], self.p["u_f"], mask)
            back = self._states(projected[1][at[::-1]], self.p["u_b"], None if mask is None else mask[::-1])[::-1]
            pooled = self._pool(np.concatenate([forward, back], axis=2), mask)[2]
            out[rows] = pooled @ self.p["out"] + self.p["out_b"][0] + np.float32(self.shift)
        return out

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x @ self.p["w_f"] + self.p["b_f"], x @ self.p["w_b"] + self.p["b_b"]

    def gradients(self, features, index: np.ndarray, lengths: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted logistic loss over a batch of windows."""
        p, H = self.p, HIDDEN
        x = self.inputs(features)
        projected = self.project(x)
        longest = int(lengths.max())
        at = index[:, :longest].T
        mask = (np.arange(longest)[:, None] < lengths).astype(np.float32)
        kept = {"f": [], "b": []}
        forward = self._states(projected[0][at], p["u_f"], mask, kept["f"])
        back = self._states(projected[1][at[::-1]], p["u_b"], mask[::-1], kept["b"])
        states = np.concatenate([forward, back[::-1]], axis=2)
        a, share, pooled = self._pool(states, mask)
        d_logit = ((_sigmoid(pooled @ p["out"] + p["out_b"][0]) - target) * weight).astype(np.float32)
        grad = {"out": pooled.T @ d_logit, "out_b": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["out"]
        d_states = share[:, :, None] * d_pooled
        d_share = np.einsum("bh,tbh->tb", d_pooled, states)
        d_e = share * (d_share - (share * d_share).sum(axis=0))
        grad["att_v"] = np.einsum("tb,tba->a", d_e, a)
        d_a = d_e[:, :, None] * p["att_v"] * (1 - a * a)
        grad["att"] = np.einsum("tbh,tba->ha", states, d_a)
        grad["att_b"] = d_a.sum(axis=(0, 1))
        d_states = d_states + d_a @ p["att"].T
        d_x = np.zeros_like(x)
        for d, own, place, m in (("f", d_states[:, :, :H], at, mask), ("b", d_states[::-1, :, H:], at[::-1], mask[::-1])):
            u, carry = p[f"u_{d}"], np.zeros((len(index), H), np.float32)
            d_proj = np.empty((*place.shape, 3 * H), np.float32)
            d_u = np.zeros_like(u)
            for t in range(longest - 1, -1, -1):
                h, z, r, n, g_n = kept[d][t]
                d_h = own[t] + carry
                d_step = d_h * m[t][:, None]
                d_n = d_step * z * (1 - n * n)
                d_z = d_step * (n - h) * z * (1 - z)
                d_r = d_n * g_n * r * (1 - r)
                d_proj[t] = np.concatenate([d_z, d_r, d_n], axis=1)
                d_g = np.concatenate([d_z, d_r, d_n * r], axis=1)
                d_u += h.T @ d_g
                carry = d_h - d_step * z + d_g @ u.T
            grad[f"u_{d}"] = d_u
            per_word = np.zeros((len(x), 3 * H), np.float32)
            np.add.at(per_word, place.ravel(), d_proj.reshape(-1, 3 * H))
            grad[f"w_{d}"] = x.T @ per_word
            grad[f"b_{d}"] = per_word.sum(axis=0)
            d_x += per_word @ p[f"w_{d}"].T
        word, gram, start = features
        grad["word"] = _by_row(word, d_x[:, :WORD_DIM])
        counts = np.diff(np.append(start, len(gram)))
        grad["gram"] = _by_row(gram, np.repeat(d_x[:, WORD_DIM:] / counts[:, None].astype(np.float32), counts, axis=0))
        return grad


def _by_row(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, sums of their values): the gradient of the embeddings that a batch touches."""
    order = np.argsort(row, kind="stable")
    first = np.flatnonzero(np.append(True, row[order][1:] != row[order][:-1]))
    return row[order][first], np.add.reduceat(value[order], first, axis=0)


def _windows(texts: list[list[str] | str], limit: int | None = None):
    """(features of the distinct words, index, lengths, text of each window)."""
    number: dict[str, int] = {}
    put = number.setdefault
    index, lengths, owner = [], [], []
    for i, found in enumerate(texts):
        found = words(found) if isinstance(found, str) else found
        if not found:
            continue
        code = np.array([put(w, len(number)) for w in found], np.int64)
        starts = window_starts(len(code))
        if limit and len(starts) > limit:
            starts = starts[np.linspace(0, len(starts) - 1, limit).astype(int)]
        if len(code) < WINDOW:
            index.append(np.pad(code, (0, WINDOW - len(code)))[None])
        else:
            index.append(code[starts[:, None] + np.arange(WINDOW)])
        lengths.append(np.full(len(starts), min(len(code), WINDOW)))
        owner.append(np.full(len(starts), i))
    if not index:
        return None
    return word_features(list(number)), np.concatenate(index), np.concatenate(lengths), np.concatenate(owner)


def _top_windows(score: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Number of the highest window of each text."""
    order = np.lexsort((score, owner))
    return order[np.append(owner[order][1:] != owner[order][:-1], True)]


def _evidence(features, index, lengths, owner, toxic) -> np.ndarray:
    """Highest evidence, over a window's words, that a word and its 3-grams occur in toxic texts more often (in standard deviations)."""
    n_pos, n_neg = toxic.sum(), (~toxic).sum()
    word, gram, start = features
    inside = np.arange(WINDOW) < lengths[:, None]
    counts = np.diff(np.append(start, len(gram)))
    seen = {True: (np.zeros(WORD_BUCKETS), np.zeros(GRAM_BUCKETS)), False: (np.zeros(WORD_BUCKETS), np.zeros(GRAM_BUCKETS))}
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    for a, b in zip(first, np.append(first[1:], len(owner))):  # texts, one after another: in how many a bucket occurs
        used = np.unique(index[a:b][inside[a:b]])
        n = counts[used]
        spread = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[used], n)
        for table, bucket in zip(seen[bool(toxic[owner[a]])], (word[used], gram[spread])):
            table[np.unique(bucket)] += 1

    def odds(k):
        pos, neg = seen[True][k] / n_pos, seen[False][k] / n_neg
        both = (pos * n_pos + neg * n_neg) / (n_pos + n_neg)
        return (pos - neg) / np.sqrt(both * (1 - both) * (1 / n_pos + 1 / n_neg) + 1e-9)

    word_odds, gram_odds = odds(0)[word], odds(1)[gram]
    each = np.maximum(word_odds, np.maximum.reduceat(gram_odds, start))
    return np.where(inside, each[index], -np.inf).max(axis=1)


def fit(texts: list[list[str] | str], toxic: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Trains on texts (or their words) and labels; reruns give the same weights."""
    net, rng = Network(seed), np.random.default_rng(seed)
    made = _windows(texts)
    toxic = np.asarray(toxic, bool)
    if made is None or toxic.all() or not toxic.any():
        net.p["out"][:] = 0
        net.p["out_b"][:] = 3.0 if len(toxic) and toxic.all() else -3.0
        return net
    features, index, lengths, owner = made
    score = _evidence(features, index, lengths, owner, toxic)
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    steps, weight_of = 0, {True: 0.5 / max(1, toxic.sum()), False: 0.5 / max(1, (~toxic).sum())}
    # a small sample is read more often, for at least MIN_STEPS batches
    rounds = max(epochs, -(-MIN_STEPS // -(-3 * len(np.unique(owner)) // (2 * BATCH))))
    for epoch in range(rounds):
        if epoch > 1 and epoch % 3 == 0:
            score = net.logits(net.project(net.inputs(features)), index, lengths)
        top = _top_windows(score, owner)
        other = rng.choice(len(owner), min(len(owner), len(top) // 2 + 1), replace=False)
        chosen = np.concatenate([top, other[~toxic[owner[other]]]])
        rng.shuffle(chosen)
        for a in range(0, len(chosen), BATCH):
            rows = chosen[a:a + BATCH]
            used, place = np.unique(index[rows], return_inverse=True)
            counts = np.diff(np.append(features[2], len(features[1])))[used]
            spread = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(features[2][used], counts)
            part = features[0][used], features[1][spread], np.cumsum(counts) - counts
            label = toxic[owner[rows]]
            weight = np.where(label, weight_of[True], weight_of[False])
            grad = net.gradients(part, place.reshape(len(rows), WINDOW), lengths[rows], label.astype(np.float32), weight / weight.sum())
            steps += 1
            rate = RATE * (1 - 0.9 * epoch / rounds) * np.sqrt(1 - 0.999 ** steps) / (1 - 0.9 ** steps)
            for k, g in grad.items():
                at, g = g if isinstance(g, tuple) else (slice(None), g)
                m, v = moment[k]
                m_at = m[at] + 0.1 * (g - m[at])
                v_at = v[at] + 0.001 * (g * g - v[at])
                m[at], v[at] = m_at, v_at
                net.p[k][at] -= (rate * m_at / (np.sqrt(v_at) + 1e-7)).astype(np.float32)
    score = net.logits(net.project(net.inputs(features)), index, lengths)
    top = _top_windows(score, owner)
    net.shift = -_threshold(score[top], toxic[owner[top]])
    return net


def _threshold(score: np.ndarray, label: np.ndarray) -> float:
    """Logit halfway between the neighbours where balanced errors are least."""
    order = np.argsort(score)
    s, y = score[order], label[order]
    miss = np.concatenate([[0], np.cumsum(y)]) / max(1, y.sum())  # toxic below the cut
    false = (np.concatenate([[0], np.cumsum(~y)])[-1] - np.concatenate([[0], np.cumsum(~y)])) / max(1, (~y).sum())
    cost = miss + 2 * false
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    k = int(best[len(best) // 2])
    return float(s[0] - 1 if k == 0 else s[-1] + 1 if k == len(s) else (s[k - 1] + s[k]) / 2)


def score_texts(net: Network, texts: list[str | None]) -> np.ndarray:
    """Score of each text in 0..1, over all its windows; 0 without words."""
    out = np.zeros(len(texts))
    made = _windows([words(t) if t else [] for t in texts])
    if made is not None:
        features, index, lengths, owner = made
        logit = net.logits(net.project(net.inputs(features)), index, lengths)
        top = _top_windows(logit, owner)
        out[owner[top]] = 1 / (1 + np.exp(-np.clip(logit[top].astype(np.float64), -60, 60)))
    return out


def training_sample(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = SAMPLE_ROWS, id_col: str = "doc_id",
                    text_col: str = "text", label_col: str = "toxic") -> tuple[list[str], np.ndarray]:
    """Words and labels of at most ``rows`` labelled texts per class, chosen by a hash of the id.

    Of a text with more than SAMPLE_WINDOWS windows the words of evenly
    spaced windows are taken, which bounds what reaches the driver.
    """
    known = labels.where(learn & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(
        F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).alias("label"))
    order = F.xxhash64("id", F.lit(5))
    picked = known.where("label = 1").orderBy(order, "id").limit(rows).union(known.where("label = 0").orderBy(order, "id").limit(rows))
    held = stored(picked, "sample")  # 2 * rows at most, so it is broadcast

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text"):
            out = []
            for text in texts:
                found = words(text) if text else []
                starts = window_starts(len(found))
                if len(starts) > SAMPLE_WINDOWS:
                    found = [w for s in starts[np.linspace(0, len(starts) - 1, SAMPLE_WINDOWS).astype(int)] for w in found[s:s + WINDOW]]
                out.append(" ".join(w[:100] for w in found))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string())], names=["id", "label", "words"])

    joined = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(held), "id")
    found = joined.select("id", F.col("label").cast("int").alias("label"), "text").mapInArrow(cut, "id long, label int, words string")
    got = sorted(found.collect(), key=lambda r: (r["id"], r["words"]))
    return [r["words"] for r in got], np.array([r["label"] == 1 for r in got], bool)


def toxicity(docs: DataFrame, labels: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """docs with score and predicted (1 if score >= 0.5), replacing columns of these names.

    held_out(id_col) says which labels are not learned from.  A text without
    words has score 0; without labels of both classes all texts of words get
    the same low score (high if all labels are 1).  Null labels and ids are
    not learned; repeated rows get the same score and count as often as they
    occur among the sampled texts; an empty table gives an empty table.
    """
    net = fit(*training_sample(docs, labels, ~held_out(id_col), id_col=id_col, text_col=text_col, label_col=label_col))
    return score_documents(docs, net, text_col)


def score_documents(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(net)  # about 4 MB, fixed by the parameters above
    base = docs.drop("score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, text_col, 2 << 20):
            score = score_texts(held.value, texts)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                                             names=[*part.schema.names, "score", "predicted"])

    return base.mapInArrow(run, extended(base.schema, "score double, predicted integer"))


def held_out_fifth(id_col: str) -> Column:
    return crc32_of_id(id_col) % 5 == 0
