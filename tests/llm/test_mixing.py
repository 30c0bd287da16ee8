from collections import defaultdict

import duckdb
import pytest

from nullwise.llm import mixing
from nullwise.llm.common import WORD

ROWS = [(i, " ".join(["w"] * n), s, 0) for i, (n, s) in enumerate(
    [(3, "b"), (4, "a"), (0, "a"), (50, None), (2, "b"), (2, "b"), (7, "é"), (1, "Z"), (900, "a"), (5, None), (5, "b")])]
ROWS += [(20, None, "a", 0), (21, "", "only empty", 0), (22, " \t\n", "only empty", 0), (None, "no id", "a", 0), (30, "same same", "b", 0), (30, "same same", "b", 0)]


def by_hand(sizes):
    """Targets by filling up and resharing until nobody is above three times its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(order)
    while free:
        left = total - sum(target.values())
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            target.update({s: level * weight[s] for s in free})
            break
        target.update({s: 3.0 * sizes[s] for s in over})
        free -= over
    return target


def check(rows, docs):
    sizes = defaultdict(int)
    for _, text, source, *_ in docs:
        sizes[source] += len(WORD.findall(text or ""))
    want = by_hand(sizes)
    taken = defaultdict(int)
    for r in rows:
        s = r["row"]["source"]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert r["size"] == len(WORD.findall(r["row"]["text"] or "")) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    largest = defaultdict(int)
    for r in rows:
        largest[r["row"]["source"]] = max(largest[r["row"]["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * largest[s] + 1
    return {r["row"]["source"]: r["target"] for r in rows}


def test_targets_and_taken(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string, size int").repartition(3)
    check(mixing.mix_sources(df).collect(), ROWS)
    assert mixing.mix_sources(df.limit(0)).collect() == []
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    copies = {(r["row"]["doc_id"]): 0 for r in mixing.mix_sources(df).collect()}
    for r in mixing.mix_sources(df).collect():
        copies[r["row"]["doc_id"]] += r["copies"]
    got = defaultdict(int)
    for r in mixed.collect():
        got[r.doc_id] += 1
    assert dict(got) == {k: v for k, v in copies.items() if v}


def test_ranges_do_not_change_the_mix(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    key = lambda rows: sorted((r["row"]["doc_id"], r["taken"]) for r in rows)
    whole = key(mixing.mix_sources(docs).collect())
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 3)
    assert key(mixing.mix_sources(docs).collect()) == whole


def test_equals_sql(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = sorted(db.sql(mixing.SQL).fetchall())
    got = sorted(tuple(r) for r in mixing.mix_sources(spark.read.parquet(path), keep=["doc_id"]).select(
        "row.doc_id", "size", "source_size", "target", "taken").collect())
    assert got == want
