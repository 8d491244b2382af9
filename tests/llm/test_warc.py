import base64
import glob
import hashlib

import pytest

from scriptorium.llm import queries, warc

SF = "/root/testdata/sf0.001"


def plain(rows, least=0):
    out = []
    for page, html in rows:
        payload = (html or "").encode()
        twins = [p for p, h in rows if (h or "").encode() == payload and p is not None]
        top = max(twins, default=None)
        revisit = len(payload) >= least and top is not None and page != top
        out.append((page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def test_query_against_plain(spark):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    got = queries.op6_warc(spark, SF).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


@pytest.mark.parametrize(("least", "hot"), [(0, 1000), (3, 4)])
def test_round_trip(spark, tmp_path, least, hot, monkeypatch):
    monkeypatch.setattr(warc, "HOT", hot)
    rows = [(1, None), (2, ""), (3, "a\r\n\r\nb"), (3, "a\r\n\r\nb"), (9, "same"), (5, "same"), (5, "same"), (7, "é" * 9), (None, "same"), (None, "alone"), (8, "x" * 300_000)]
    frame = spark.createDataFrame([(p, "http://x\r\ny/ é" if p else None, h, b"clash") for p, h in rows], "page_id bigint, url string, html string, payload binary")
    path = str(tmp_path / "a")
    warc.write_archives(frame, path, least)
    got = warc.read_archives(spark, path).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == plain(rows, least)
    for r in got:
        assert r.record_type == "revisit" or (r.page_id, bytes(r.payload).decode()) in [(p, h or "") for p, h in rows]
    data = b"".join(open(f, "rb").read() for f in glob.glob(f"{path}/part-*"))
    records = list(warc.frames(memoryview(data)))
    assert len(records) == len(rows)


def test_archives_are_bounded(spark, tmp_path):
    rows = [(k, "http://x/", hashlib.sha512(bytes([k % 256])).hexdigest() * (37 * k % 5)) for k in range(300)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    path = str(tmp_path / "a")
    warc.write_archives(frame, path, lines=40, most_bytes=6_000)
    parts = [open(f, "rb").read() for f in sorted(glob.glob(f"{path}/part-*"))]
    records = [list(warc.frames(memoryview(p))) for p in parts]
    assert sum(map(len, records)) == 300 and len(parts) > 300 / 40 and max(map(len, records)) < 40
    assert all(p.startswith(warc.skippable(warc.SAMPLE)) for p in parts if p)
    assert any(len(r) < 39 for r in records[:-1])  # full by its bytes
    assert max(map(len, parts)) < 6_000 + 40 * 8 + 2_000
    got = warc.read_archives(spark, path).collect()
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in got) == [(k, h) for k, _, h in rows]


def test_long_payloads(spark, tmp_path):
    rows = [(1, "http://x/", "y" * 5_000_000), (2, "http://x/", " " * 5_000_000), (3, "http://x/", "y" * 5_000_000)]
    path = str(tmp_path / "a")
    warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string"), path, most_bytes=100)
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(spark, path).collect()}
    assert got == {1: (5_000_000, "revisit", 3), 2: (5_000_000, "response", None), 3: (5_000_000, "response", None)}


def test_empty_table(spark, tmp_path):
    frame = spark.createDataFrame([], "page_id bigint, url string, html string")
    warc.write_archives(frame, str(tmp_path / "a"))
    assert warc.read_archives(spark, str(tmp_path / "a")).count() == 0


def test_damage_is_found():
    import zstandard

    raw = warc.record(1, "http://x/", b"payload", None, False)
    frame = zstandard.ZstdCompressor(write_checksum=True).compress(raw)
    assert warc.parse(next(warc.frames(memoryview(frame))))["payload"] == b"payload"
    for cut in (3, 7, len(frame) - 1):
        with pytest.raises(warc.ArchiveError):
            list(warc.frames(memoryview(frame[:cut])))
    with pytest.raises(warc.ArchiveError):
        list(warc.frames(memoryview(frame[:-1] + bytes([frame[-1] ^ 1]))))
    for old, new in ((b"payload\r\n", b"pAyload\r\n"), (b"WARC/1.1", b"WARC/9.9"), (b"WARC-Date", b"WARC-Xate"), (b"payload\r\n", b"payloa\r\n")):
        with pytest.raises(warc.ArchiveError):
            warc.parse(raw.replace(old, new))
    whole = warc.skippable(b"x" * 9)
    with pytest.raises(warc.ArchiveError):
        list(warc.frames(memoryview(whole[:-1])))


def test_compressed_dictionary():
    import zstandard

    dictionary = zstandard.ZstdCompressionDict(warc.SAMPLE, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    frame = zstandard.ZstdCompressor(dict_data=dictionary).compress(warc.SAMPLE * 3)
    data = warc.skippable(zstandard.compress(warc.SAMPLE)) + frame + warc.SEPARATOR.encode() + frame
    assert list(warc.frames(memoryview(data))) == [warc.SAMPLE * 3] * 2
