import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from nullwise.llm.common import WORD, words
from nullwise.llm import minhash
from nullwise.llm.minhash import BINS, Densifier, _candidates, _dealt, minhash_dedup, rest_links, rest_pairs, shingle_sets


def word_shingles(text, k=4):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return set()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}


def brute(rows):
    """{id: (n, component)} by comparing every pair."""
    sets = {i: word_shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {i: (len(sets[i]), root(i)) for i in sets}


def corpus(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, passage = [], [rng.choice(vocab) for _ in range(60)]
    for _ in range(60):
        rows.append([rng.choice(vocab) for _ in range(rng.choice([1, 3, 4, 6, 30, 120, 500]))])
    for _ in range(30):  # a shared passage in otherwise different texts
        rows.append(passage + [rng.choice(vocab) for _ in range(rng.choice([20, 40, 90]))])
    for base in (rows[5], rows[20], rows[40], passage * 3):
        for k in range(25):  # near copies, some of which only link through the original
            copy = list(base)
            for _ in range(max(1, int(len(copy) * rng.choice([0.005, 0.015, 0.03])))):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append(copy)
    rng.shuffle(rows)
    texts = [" ".join(w) for w in rows]
    texts += [texts[0], texts[0].upper(), texts[1].replace(" ", "\t\n"), "", None, " \n ", "single", "Single"]
    return list(enumerate(texts))


def test_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string").repartition(5)
    got = {r.doc_id: r for r in minhash_dedup(docs).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    for i, (n, c) in want.items():
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, c, i == c), i


def test_edge_cases(spark):
    schema = "doc_id long, text string"
    assert minhash_dedup(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, "q r s t"), (5, None), (6, ""), (7, "x" * 3_000_000 + " y z")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup(spark.createDataFrame(rows, schema)).collect()),
                 key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None))
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (5, 0, 5, True), (6, 0, 6, True), (7, 1, 7, True),
                   (None, 1, None, True), (None, 2, 1, False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abAB \t\n\x0b\x1c\xa0é", max_size=40), max_size=6))
def test_shingle_counts(texts):
    assert [len(s) for s in shingle_sets(texts)] == [len(word_shingles(t)) for t in texts]
    assert [words(t) for t in texts] == [WORD.findall(t) for t in texts]


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    dense = Densifier(256)
    errors = []
    for n in (40, 400):
        base = rng.integers(0, 2**63, n, dtype=np.uint64)
        for _ in range(40):
            other = base.copy()
            other[:n // 9] = rng.integers(0, 2**63, n // 9, dtype=np.uint64)
            truth = len(np.intersect1d(base, other)) / len(np.union1d(base, other))
            errors.append((dense.signature(np.unique(base)) == dense.signature(np.unique(other)))[:256].mean() - truth)
    assert abs(np.mean(errors)) < 0.03


def test_signature_rules_out_no_short_link():
    rng = np.random.default_rng(2)
    dense = Densifier(BINS)
    for shared, only_a, only_b in ((8, 1, 1), (16, 2, 2), (32, 4, 4), (40, 5, 5), (48, 6, 6), (32, 8, 0), (40, 7, 3), (80, 10, 10), (160, 20, 20)):
        lost = 0
        for _ in range(300):
            both, a, b = (rng.integers(0, 2**63, k, dtype=np.uint64) for k in (shared, only_a, only_b))
            raw = np.stack([dense.signature(np.unique(np.concatenate([both, x]))) for x in (a, b)])
            full = np.unpackbits(np.ascontiguousarray(raw[:, BINS:]).view(np.uint8), axis=1).astype(bool)
            ids, n = np.array([1, 2]), np.array([shared + only_a, shared + only_b])
            lost += not len(_candidates(0, np.array([1]), ids, n, (raw[:, :BINS], full), 80))
        assert lost == 0, (shared, only_a, only_b, lost)


def test_blocks_of_a_bucket_are_bounded_and_name_each_pair_once(spark):
    # members 0 to 199 are the first component, the other 800 are apart; all have the same signature
    rows = [(7, 3, i, 0 if i < 200 else i, 0, 1000, 800) for i in range(1000)]
    held = spark.createDataFrame(rows, "key long, band int, id long, part long, low long, s long, o long")
    groups = {}
    for r in _dealt(held, 130).collect():
        groups.setdefault((r.key, r.block, r.over), []).append(r)
    assert len(groups) == 8 * 7 and max(map(len, groups.values())) < 2 * 260
    pairs = []
    for members in groups.values():
        ids, outside = np.array([r.id for r in members]), np.array([r.outside for r in members])
        part = np.where(ids < 200, 0, ids)
        sig = np.zeros((len(ids), BINS), np.uint16), np.ones((len(ids), BINS), bool)
        for i, j in rest_pairs(outside, ids, part, np.full(len(ids), 300), sig, 80, 0, 5, 0):
            pairs += [(min(ids[i], k), max(ids[i], k)) for k in ids[j].tolist()]
    assert len(pairs) == len(set(pairs)) == 200 * 800 + 800 * 799 // 2


def test_links_of_a_block_connect_what_brute_force_connects():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 100, dtype=np.uint64)
    sets = []
    for _ in range(60):
        own = np.concatenate([base[rng.permutation(100)[:rng.integers(80, 97)]], rng.integers(0, 2**63, rng.integers(0, 9), dtype=np.uint64)])
        sets.append(np.unique(own))
    ids = np.arange(60)
    links = rest_links(((i, ids[i + 1:]) for i in range(59)), ids, sets, 80)

    def groups(pairs):
        label = list(range(60))
        for _ in range(60):
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        return label

    truth = [(i, j) for i in range(60) for j in range(i + 1, 60)
             if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
    assert len(truth) > len(links) and set(links) <= set(truth) and groups(links) == groups(truth)


def test_the_exact_rest_in_small_blocks_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "REST_SHINGLES", 300)
    monkeypatch.setattr(minhash, "GROUP_SHINGLES", 200)
    monkeypatch.setattr(minhash, "USES", 0)  # joins by shuffle
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):  # versions of one text, about 0.7 alike, some of them linked
        own = list(words)
        for at in rng.permutation(60)[:rng.integers(1, 4)]:
            own[at] = f"x{rng.integers(0, 3)}"
        rows.append((i, " ".join(own)))
    got = {r.doc_id: r.component_id for r in minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()}
    sets = [{tuple(t.split()[k:k + 4]) for k in range(57)} for _, t in rows]
    label = list(range(120))
    for _ in range(120):
        before = list(label)
        for i in range(120):
            for j in range(i + 1, 120):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    assert got == dict(enumerate(label)) and len(set(label)) > 3
