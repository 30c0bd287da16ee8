import weakref
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nullwise.llm import repack
from nullwise.llm.common import vocabulary, words, worker_held
from nullwise.llm.minhash import _Hasher
from nullwise.llm.packing import best_fit_decreasing, lower_bound
from nullwise.llm.repack import WordEncoder, encoder_table, pack_documents

SAMPLES = ["Hello, World!", "don't stop", "naïve CAFÉ él straße ÑANDÚ", "x<|endoftext|>y <|startoftext|>", "日本語 テキスト", "a1b2 3.14 %%% ***", "ß ẞ İ ǅ Σας",
           "é ́x", "\x1cq\x85r\xa0s", "i'm we'll 'tis", "", "🙂🙂 fin.", "wörter,, (und) [so] \"weiter\"", "Ω Å K ﬁ"]


def plain_bfd(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= x]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - x)
        else:
            rooms.append(capacity - x)
    return len(rooms)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit_decreasing(lengths):
    x = np.array(lengths, np.int64)
    bin_of, offset, n = best_fit_decreasing(x, 50)
    assert n == plain_bfd(lengths, 50)
    spans = defaultdict(list)
    for b, o, size in zip(bin_of, offset, x):
        spans[b].append((o, o + size))
    for s in spans.values():
        s.sort()
        assert s[0][0] == 0 and s[-1][1] <= 50 and all(a[1] == b[0] for a, b in zip(s, s[1:]))
    assert len(spans) == n and -(-sum(lengths) // 50) <= lower_bound(x, 50) <= n


def test_lower_bound_beats_volume():
    assert lower_bound(np.array([30, 30, 30]), 50) == 3  # the volume alone says 2
    assert lower_bound(np.array([], np.int64), 50) == 0


def test_word_encoder_equals_tokenizer():
    from tokenizers import Tokenizer
    import duckdb
    path = vocabulary("word_bpe_49k.json")
    tokenizer, table = Tokenizer.from_file(path), encoder_table(path)
    texts = SAMPLES + [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' WHERE text IS NOT NULL").fetchall()]
    for text, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert table.gather(table.codes(words(text))).tolist() == e.ids, text[:80]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x600, exclude_categories=["Cs"]), max_size=12))
def test_word_encoder_on_any_text(text):
    global _pair
    if "_pair" not in globals():
        from tokenizers import Tokenizer
        path = vocabulary("word_bpe_49k.json")
        _pair = Tokenizer.from_file(path), WordEncoder(path)
    found = words(text)
    assert sum(map(list, _pair[1](found)), []) == _pair[0].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("per_group", [50_000, 40])
def test_pack_documents(spark, per_group):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(None, "no id"), (10**9, None), (10**9 + 1, ""), (10**9 + 2, "word " * 2047), (10**9 + 3, "word " * 2048),
                                   (10**9 + 4, "twice"), (10**9 + 4, "twice")], "doc_id long, text string")
    docs = docs.union(extra).withColumnRenamed("text", "body")
    rows = pack_documents(docs.selectExpr("*", "1 AS length", "2 AS offset"), text_col="body", per_group=per_group).collect()
    bins = defaultdict(list)
    got = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.offset + r.length))
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for spans in bins.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 2048 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    want = defaultdict(list)
    for r in docs.collect():
        ids = np.array(tokenizer.encode(r.body or "", add_special_tokens=False).ids + [0], "<u4")
        want[r.doc_id] += [(k, s, len(ids[s:s + 2048]), zlib.crc32(ids[s:s + 2048])) for k, s in enumerate(range(0, len(ids), 2048))]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    least = lower_bound(np.array([r.length for r in rows]), 2048)
    assert len(bins) <= least * 1.02 + 4


def test_pack_empty(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_worker_holds_the_tables_of_one_step_only():
    """A Python worker that served other stages drops their vocabularies and word tables before pack builds its own."""
    path = vocabulary(repack.VOCABULARY)
    hasher = weakref.ref(worker_held("hasher", _Hasher))
    assert worker_held("hasher", _Hasher) is hasher()
    table = repack._table(path)
    assert hasher() is None and repack._table(path) is table
    learned = table.encode._learn("antidisestablishment")
    assert len(learned) > 1 and all(i is table.encode.number[i] for i in learned)  # no integer objects of its own


def test_pack_holds_the_words_of_small_slices(monkeypatch):
    """However many rows a batch has, the words of a bounded part of its text are held at once."""
    held = []
    table = repack._table(vocabulary(repack.VOCABULARY))
    codes = table.codes
    monkeypatch.setattr(table, "codes", lambda tokens: held.append(sum(map(len, tokens))) or codes(tokens))

    class Docs:  # runs the step in this process
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            text = "some words of a text " * 2_000
            batch = pa.RecordBatch.from_arrays([pa.array(range(100), pa.int64()), pa.array([text] * 100)], names=["id", "text"])
            return sum(b.num_rows for b in run(iter([batch])))

    monkeypatch.setattr(repack.F, "col", lambda name: type("C", (), {"cast": lambda s, t: s, "alias": lambda s, n: s})())
    assert repack._tokenised(Docs(), "id", "text", vocabulary(repack.VOCABULARY), 2048) == 100 * (10_001 // 2048 + 1)
    assert len(held) > 3 and max(held) <= repack.SLICE
