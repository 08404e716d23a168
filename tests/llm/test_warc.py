import struct

import pytest
import zstandard as zstd

from glucolake.llm import warc as W


def frames(dictionary: bytes, *recs: bytes, compress: bool = True) -> bytes:
    c = zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(dictionary)) if dictionary else zstd.ZstdCompressor()
    return W.dictionary_frame(dictionary, compress) + b"".join(map(c.compress, recs))


@pytest.mark.parametrize("compress", [True, False])
def test_dictionary_from_leading_frame(compress):
    made = [W.record(f"urn:record:{i}", "http://a/", f"<p>page {i} with the same words again</p>".encode() * 20) for i in range(200)]
    content = W.trained(made)
    assert content
    back = list(W.records(frames(content, *made, compress=compress)))
    assert [r.record_id for r in back] == [f"urn:record:{i}" for i in range(200)]
    assert back[7].payload == b"<p>page 7 with the same words again</p>" * 20


def test_skippable_frames_between_records_are_passed_over():
    a, b = (zstd.ZstdCompressor().compress(W.record(f"urn:record:{i}", "u", b"x")) for i in (1, 2))
    assert len(list(W.records(a + W.SEPARATOR + struct.pack("<II", 0x184D2A53, 3) + b"abc" + b))) == 2


@pytest.mark.parametrize("broken", [
    lambda r: r.replace(b"Content-Length: 1", b"Content-Length: 2", 1), lambda r: r.replace(b"WARC/1.1", b"WARC/3"), lambda r: r.replace(b"payload", b"paYload"),
    lambda r: r[:-1], lambda r: r.replace(b"WARC-Type", b"No-Type"), lambda r: r.replace(b"WARC-Date:", b"WARC-Date"), lambda r: r.replace(b"HTTP/1.1 200", b"HTTQ"),
])
def test_bad_records_are_refused(broken):
    good = W.record("urn:record:1", "http://a/", b"payload" * 10)
    assert W.parse(good).payload_length == 70
    with pytest.raises(W.ArchiveError):
        list(W.records(frames(b"", broken(good))))


def test_cut_archives_are_refused():
    data = frames(b"", W.record("urn:record:1", "u", b"x" * 1000))
    for cut in (1, 5, len(data) // 2, len(data) - 2):
        with pytest.raises(W.ArchiveError):
            list(W.records(data[:cut]))


def test_round_trip(spark):
    rows = [(5, "u", "same"), (3, "u", "same"), (4, "u", "other\r\n\r\n"), (9, None, None), (8, "v", ""), (None, "w", "same"), (3, "u", "same"), (10, "x", "é" * 70000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, refers_to string")
    got = sorted(map(tuple, W.round_trip(df).collect()), key=str)
    want = []
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    for i, _, h in rows:
        b = (h or "").encode()
        to = first[h or ""]
        want.append((i, len(b), W.digest(b), "response" if i == to else "revisit", None if i == to else to))
    assert got == sorted(want, key=str)
    assert W.round_trip(df.where("false")).count() == 0


def test_payloads_come_back(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    path = W.fresh_path(spark, "test-archives")
    W.write_archives(pages, path)
    back = {r["record_id"]: bytes(r["payload"]) for r in W.read_archives(spark, path, payloads=True).where("payload is not null").collect()}
    for r in pages.collect():
        if f"urn:record:{r['page_id']}" in back:
            assert back[f"urn:record:{r['page_id']}"] == r["html"].encode()
    assert back


def test_archives_roll_over_at_a_bound(spark, monkeypatch):
    """Each archive has its own dictionary and is read by itself."""
    monkeypatch.setattr(W, "ARCHIVE_BYTES", 20_000)
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").coalesce(1)
    path = W.fresh_path(spark, "test-rolled")
    W.write_archives(pages, path)
    files = [bytes(r["content"]) for r in spark.read.format("binaryFile").load(path).collect()]
    assert len(files) > 2 and all(f[:4] == struct.pack("<I", W.DICTIONARY_MAGIC) for f in files)
    read = [r.record_id for f in files for r in W.records(f)]
    assert sorted(read) == sorted(f"urn:record:{r['page_id']}" for r in pages.collect())
    assert max(map(len, files)) < 20_000 + 40_000
