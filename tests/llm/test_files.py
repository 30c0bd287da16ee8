import base64
import hashlib
import io
import zlib
from collections import defaultdict

import numpy as np
import pytest

from nullwise.llm import token_output, warc
from nullwise.llm.common import shared_dir, vocabulary
from nullwise.llm.fertility import ByteVocabulary


def rec(i, body=b"payload"):
    return warc.record(i, f"http://x/{i}", body + str(i).encode(), None)


def ids(events):
    return [int(e[2]["warc-record-id"].strip("<>").removeprefix("urn:page:")) for e in events if e[0] == "record"]


def test_salvage_gzip():
    members = [warc.member(rec(i)) for i in range(5)]
    clean = list(warc.salvage(io.BytesIO(b"".join(members))))
    assert ids(clean) == list(range(5)) and all(e[0] == "record" for e in clean)
    flipped = bytearray(members[2])
    flipped[len(flipped) // 2] ^= 0xFF
    data = members[0] + b"junk \x1f\x8b\x08 junk" + members[1] + bytes(flipped) + members[3] + members[4][:-9]
    events = list(warc.salvage(io.BytesIO(data)))
    assert ids(events) == [0, 1, 3]
    gaps = [(e[1], e[2]) for e in events if e[0] == "gap"]
    a = len(members[0])
    b = a + len(b"junk \x1f\x8b\x08 junk")
    c = b + len(members[1])
    d = c + len(flipped)
    assert gaps == [(a, b), (c, d), (d + len(members[3]), len(data))]
    assert list(warc.salvage(io.BytesIO(b""))) == []
    assert [e[:3] for e in warc.salvage(io.BytesIO(b"x" * 200_000))] == [("gap", 0, 200_000)]
    big = warc.member(rec(7, np.random.default_rng(0).bytes(400_000)))
    assert ids(warc.salvage(io.BytesIO(members[0] + b"\0" * 70_000 + big + members[1]))) == [0, 7, 1]


def test_salvage_plain():
    parts = [rec(i) for i in range(4)]
    assert ids(warc.salvage(io.BytesIO(b"".join(parts)))) == [0, 1, 2, 3]
    wrong = parts[1].replace(b"payload", b"pay1oad")  # the block digest fails
    events = list(warc.salvage(io.BytesIO(parts[0] + wrong + parts[2] + parts[3][:60])))
    assert ids(events) == [0, 2] and [e[3] for e in events if e[0] == "gap"][0] == "block digest"


def test_round_trip(spark):
    rows = [(1, "http://a/\r\nx é", "same"), (9, "http://a/2", "same"), (4, None, "same"), (5, "u", None), (6, "u", ""), (7, "u", "own é \x00"),
            (None, "u", "same"), (9, "http://a/2", "same"), (8, "u", "x" * 3_000_000), (None, "u", "no id")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = defaultdict(list)
    for r in warc.warc_round_trip(pages).collect():
        got[r.page_id].append((r.payload_bytes, r.payload_digest, r.record_type, r.refers_to))

    def say(text, kind, of=None):
        data = (text or "").encode()
        return len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, of

    assert got[1] == [say("same", "revisit", 9)] and got[4] == [say("same", "revisit", 9)]
    assert got[9] == [say("same", "response")] * 2
    assert got[5] == [say("", "revisit", 6)] and got[6] == [say("", "response")]
    assert got[7] == [say("own é \x00", "response")] and got[8] == [say("x" * 3_000_000, "response")]
    assert sorted(got[None]) == sorted([say("same", "revisit", 9), say("no id", "response")])
    assert warc.warc_round_trip(pages.limit(0)).collect() == []
    small = {r.page_id: r.record_type for r in warc.warc_round_trip(pages, min_bytes=5).collect() if r.page_id}
    assert small[1] == "response" and small[5] == "response"


def plain_members(data):
    """Start offsets and records of a file of gzip members, by Python's own decompressor."""
    at = 0
    while at < len(data):
        coder = zlib.decompressobj(31)
        text = coder.decompress(data[at:]) + coder.flush()
        yield at, text
        at = len(data) - len(coder.unused_data)


def test_archives_on_disk_are_gzipped_once_and_salvaged(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    written = warc.write_archives(warc.with_revisits(pages), shared_dir(spark, "warc"))
    manifest = spark.createDataFrame(written.collect(), "file string, n_records long, n_bytes long")
    files = [r.file.removeprefix("file:") for r in manifest.collect()]
    digests = {}
    for r in pages.collect():
        digests[r.page_id] = base64.b32encode(hashlib.sha1((r.html or "").encode()).digest()).decode()
    seen, damaged = {}, {}
    for file in files:
        with open(file, "rb") as f:
            data = f.read()
        members = list(plain_members(data))
        for _, text in members:
            head, _, body = text.partition(b"\r\n\r\n")
            fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
            seen[int(fields[b"WARC-Record-ID"][len(b"<urn:page:"):-1])] = fields[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
            assert int(fields[b"Content-Length"]) == len(body) - 4
        at, text = members[len(members) // 2]
        damaged[file] = at, int(text.split(b"<urn:page:")[1].split(b">")[0])
    assert seen == digests  # every page once, every digest right
    clean = warc.read_archives(manifest).collect()
    assert {r.page_id: r.payload_digest for r in clean} == digests and all(r.kind == "record" for r in clean)
    for file, (at, _) in damaged.items():
        with open(file, "r+b") as f:
            f.seek(at + 30)
            byte = f.read(1)
            f.seek(at + 30)
            f.write(bytes([byte[0] ^ 0xFF]))
    rows = warc.read_archives(manifest).collect()
    assert {r.page_id for r in rows if r.kind == "record"} == set(digests) - {i for _, i in damaged.values()}
    assert sorted((r.file.removeprefix("file:"), r.start) for r in rows if r.kind == "gap") == sorted((f, at) for f, (at, _) in damaged.items())


def test_a_damaged_round_trip_is_not_silent(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "u", f"text {i}") for i in range(20)], "page_id long, url string, html string").coalesce(1)
    read = warc.read_archives

    def damaged(manifest):
        file = manifest.first().file.removeprefix("file:")
        with open(file, "r+b") as f:
            f.seek(40)
            f.write(b"\0\0\0")
        return read(manifest)

    monkeypatch.setattr(warc, "read_archives", damaged)
    with pytest.raises(ValueError, match="19 of 20"):
        warc.warc_round_trip(pages)


def test_token_files(spark):
    vocab = ByteVocabulary.load(vocabulary(token_output.VOCABULARY))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(
        spark.createDataFrame([(None, "no id"), (10**9, None), (10**9 + 1, "")], "doc_id long, text string"))
    folder = shared_dir(spark, "tokens")
    manifest = token_output.write_tokens(docs, folder, length=512, buffer=30_000).collect()
    found = defaultdict(dict)
    for m in manifest:
        f = token_output.read_file(m.file)
        assert f["ids"].shape == (m.n_rows, 512) and len(f["row_start"]) == m.n_rows + 1
        k = 0
        for row, (a, b) in enumerate(zip(f["row_start"][:-1], f["row_start"][1:])):
            cu = f["cu_seqlens"][a:b]
            assert cu[0] == 0 and (np.diff(cu) > 0).all() and cu[-1] <= 512
            for lo, hi in zip(cu[:-1], cu[1:]):
                assert (f["position_ids"][row, lo:hi] == np.arange(hi - lo)).all()
                found[int(f["doc_id"][k]) if f["has_id"][k] else None][int(f["start"][k])] = f["ids"][row, lo:hi]
                k += 1
        assert k == m.n_pieces
    for r in docs.collect():
        whole = np.concatenate([v for _, v in sorted(found[r.doc_id].items())])
        assert whole.tolist() == vocab.encode(r.text or "").tolist() + [vocab.size]
    rows = token_output.token_output(docs).collect()
    one = next(r for r in rows if r.doc_id == 10**9)
    assert (one.piece, one.start, one.length, one.ids_crc32) == (0, 0, 1, zlib.crc32(np.array([vocab.size], "<u4")))
    assert token_output.token_output(docs.limit(0)).collect() == []
