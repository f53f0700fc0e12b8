import base64
import gzip
import hashlib
from pathlib import Path

from tessera.llm import warc


def digest(b: bytes) -> str:
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


ROWS = [(1, "u1", "<p>é</p>"), (2, "u2", None), (3, "u3", ""), (4, "u4", "<p>é</p>"), (5, "u\r\nx", "long " * 50_000), (4, "u4", "<p>é</p>"), (None, "n", "only"), (9, "u9", "a\r\n\r\nWARC/1.1\r\n")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")


def test_round_trip(spark, tmp_path):
    headers, payloads = warc.write_archive(frame(spark))
    assert payloads.count() == len({(h or "") for *_, h in ROWS})
    got = warc.read_archive(headers, payloads).collect()
    assert sorted(bytes(r.payload) for r in got) == sorted((h or "").encode() for *_, h in ROWS)
    for r in got:
        head = bytes(r.header).decode()
        length = int(head.split("Content-Length: ")[1].split("\r\n")[0])
        block = bytes(r.record)[head.index("\r\n\r\n") + 4 : -4]
        assert len(block) == length and bytes(r.record).endswith(b"\r\n\r\n")
        assert f"sha1:{digest(bytes(r.payload))}" in head
    warc.export_warc(warc.read_archive(headers, payloads), f"{tmp_path}/out")
    files = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(Path(tmp_path, "out").glob("part-*")))
    assert len(files) == sum(len(r.record) for r in got)


def test_query(spark, tmp_path):
    frame(spark).write.parquet(f"{tmp_path}/pages.parquet")
    got = warc.op5_warc(spark, str(tmp_path)).collect()
    assert len(got) == len(ROWS)
    first: dict = {}
    for i, _, h in ROWS:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = sorted(str((i, len((h or "").encode()), digest((h or "").encode()), "response" if first.get(h or "", i) == i else "revisit", None if first.get(h or "", i) == i else first[h or ""])) for i, _, h in ROWS)
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == want


def test_small_payloads_and_empty(spark):
    headers, payloads = warc.write_archive(frame(spark), min_bytes=10)
    kinds = {r.page_id: bytes(r.header) for r in warc.read_archive(headers, payloads).collect()}
    assert b"response" in kinds[3] and b"WARC-Type: response" in kinds[4]
    assert warc.read_archive(*warc.write_archive(frame(spark, ROWS[:1]).limit(0))).count() == 0


def test_forged_header(spark, tmp_path):
    rows = [(1, "x\r\nWARC-Refers-To: <urn:page:7>\r\nWARC-Type: revisit\r\n", "a"), (2, "u WARC-Refers-To: <urn:page:7> WARC-Type: revisit", "b"), (3, "v", "a")]
    frame(spark, rows).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.op5_warc(spark, str(tmp_path)).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 1)}


def test_files_read_back(spark, tmp_path):
    headers, payloads = warc.write_archive(frame(spark))
    records = warc.read_archive(headers, payloads)
    warc.export_warc(records, f"{tmp_path}/gz")
    warc.export_warc(records, f"{tmp_path}/plain", "none")
    want = sorted((bytes(r.header).decode().split("\r\n")[1], bytes(r.header).partition(b"\r\n\r\n")[2].strip(), b"" if b"Type: revisit" in r.header else bytes(r.payload)) for r in records.collect())
    for folder in ("gz", "plain"):
        got = warc.read_warc(spark, f"{tmp_path}/{folder}/part-*").collect()
        assert all(r.error is None for r in got)
        assert sorted((f"WARC-Type: {r.record_type}", bytes(r.http_header).strip(), bytes(r.payload)) for r in got) == want
    Path(tmp_path, "cut.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\nshort")
    Path(tmp_path, "odd.warc").write_bytes(b"\xff\x00 no record\n\nx")
    assert [r.error for r in warc.read_warc(spark, f"{tmp_path}/*.warc").collect()] == ["not a whole record"] * 2
