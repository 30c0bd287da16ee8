import hashlib

import pytest
from pyspark.sql import functions as F

from nullwise.llm import fingerprint as fp
from nullwise.llm.common import WORD

SCHEMA = "doc_id long, text string, print int, _key string"


def plain_fingerprint(text, shingle=fp.SHINGLE):
    words = WORD.findall(text or "")
    if not words:
        return ""
    grams = [" ".join(words[i:i + shingle]) for i in range(max(len(words) - shingle + 1, 1))]
    least = {}
    for h in (hashlib.md5(g.encode()).hexdigest() for g in grams):
        b = int(h[:2], 16)
        least[b] = min(h, least.get(b, h))
    return "".join(least[i if i in least else next(j for j in fp._order(i) if j in least)][-1] for i in range(fp.BINS))


def plain_likeness(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    return max(0.0, (sum(x == y for x, y in zip(a, b)) - 16) / 240.0)


def plain_rows(rows):
    """From (doc_id, text) with distinct ids and none missing."""
    rows = sorted((d, t or "") for d, t in rows)
    for (d, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        a, b = plain_fingerprint(t), plain_fingerprint(edited)
        yield (d, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, plain_likeness(a, b), plain_likeness(a, plain_fingerprint(after)))


def text_of(n, seed):
    return " ".join(f"w{(i * 7919 + seed) % 1009}{'é' if i % 5 == 0 else ''}" for i in range(n))


@pytest.mark.parametrize("range_rows,ranges,cuts", [(1024, 65_536, 1024), (3, 65_536, 1024), (2, 12, 4)])
def test_equals_plain_python(spark, monkeypatch, range_rows, ranges, cuts):
    monkeypatch.setattr(fp, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(fp, "RANGES", ranges)
    monkeypatch.setattr(fp, "CUTS", cuts)
    monkeypatch.setattr(fp, "CHUNK", 64)  # a text of 1,000 words is many chunks
    rows = [(i * i - 40, text_of(n, i % 4)) for i, n in enumerate([0, 1, 4, 5, 6, 40, 200, 1000, 200, 200, 3, 12, 60])]
    rows += [(10_000, None), (10_001, " \t\n "), (10_002, "a\x0bb\x0cc  d e f"), (10_003, "  one word two"), (10_004, text_of(1000, 3))]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA).repartition(5)
    got = sorted(tuple(r) for r in fp.fingerprint_documents(df).collect())
    assert got == sorted(plain_rows(rows))


def test_missing_and_repeated_ids(spark):
    rows = [(5, "same text of a few words", 1, "x")] * 3 + [(None, "no id here", 1, "x"), (None, None, 1, "x"), (7, "same text of a few words", 2, "y")]
    got = fp.fingerprint_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in got) == [(False, 5, 24)] * 3 + [(False, 7, 24), (True, 0, 0), (True, 0, 10)]
    assert len({r.fingerprint for r in got if r.n_chars == 24}) == 1
    assert [r.near_next for r in got if r.doc_id == 5] == [1.0] * 3  # itself again, then the same text of 7


def test_empty_table_and_one_row(spark):
    df = spark.createDataFrame([(1, "alone in the table of five words or more", 1, "x")], SCHEMA)
    row, = fp.fingerprint_documents(df).collect()
    assert row.near_next == 1.0 and row.n_chars == 40
    assert fp.fingerprint_documents(df.where("doc_id > 1")).count() == 0


def test_likeness_estimates_the_similarity(spark):
    base = [f"t{i}" for i in range(2000)]
    rows = []
    for k, cut in enumerate([0, 100, 400, 1000, 2000]):
        rows.append((k, " ".join(base), " ".join(base[cut:] + [f"u{i}" for i in range(cut)])))
    df = spark.createDataFrame(rows, "k int, a string, b string")
    got = [r.x for r in df.select("k", fp.likeness(fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b"))).alias("x")).orderBy("k").collect()]
    for (k, a, b), x in zip(rows, got):
        s, t = ({tuple(z.split()[i:i + 5]) for i in range(1996)} for z in (a, b))
        assert abs(x - len(s & t) / len(s | t)) < 0.1
