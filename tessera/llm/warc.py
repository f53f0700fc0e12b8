"""Content-addressed WARC archive.

Payload bytes are stored once, under their SHA-1; exact record headers are
stored apart, one row per record, naming the digest. `write_archive` makes the
two tables, `read_archive` joins them and gives each original record's bytes
again, and `export_warc` writes these as ordinary WARC files, which `read_warc` reads.

The digest is verified: before a payload is shared, every record's bytes are
compared with those stored under its digest, and a difference fails the job
instead of losing a payload. Of records with equal payloads of at least
`min_bytes` the one with the smallest id is the response and the others revisit
it; a smaller payload is always a response (still stored once).

A null payload is empty. Repeated rows of one id repeat: all of them carry the
role of their id. Rows with a null id are responses of their own digest, never
referred to unless no other row has that payload. Other columns are ignored.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import picked, staged, table

RECORD = pa.schema([(n, pa.string()) for n in ("path", "record_type", "record_id", "target_uri", "payload_digest", "refers_to")] + [("http_header", pa.binary()), ("payload", pa.binary()), ("error", pa.string())])
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
#: WARC-Date of a record whose input names none; a fixed value keeps archives reproducible.
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits: five of them, twenty bits, become four letters.

    The lambdas hold the digest and each part's bits, so that each is computed once a row.
    """

    def letters(bits: Column) -> Column:
        return F.concat(*[F.substr(F.lit(BASE32), F.shiftright(bits, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1)) for k in range(4)])

    def whole(hexed: Column) -> Column:
        parts = F.array(*[F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)])
        return F.array_join(F.transform(parts, letters), "")

    return F.transform(F.array(digest), whole)[0]


def sha1_base32(payload: Column) -> Column:
    return base32_of_hex(F.sha1(payload))


def _header_text() -> Column:
    """WARC and HTTP headers of a record; its length is that of the record's block as stored in a WARC file."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    lines = [
        F.concat(F.lit("WARC/1.1"), F.lit(CRLF), F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), F.lit(DATE)),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(F.col("record_type") == "revisit", F.concat(F.lit(f"WARC-Profile: {REVISIT_PROFILE}{CRLF}WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(F.col("payload_bytes"))).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), http)


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """(headers, payloads), both written to the shared folder.

    headers: page_id, payload_digest, header (bytes); payloads: payload_digest,
    payload. One pass finds each digest's owner from digests alone (counted before
    the shuffle, so a hot payload sends one row per task). A second deals the
    payloads by id, never by digest, and parts owners' bytes from copies' bytes;
    only copies, and the payloads that have copies, are then joined by digest to be
    compared, where adaptive execution can split a hot one.
    """
    raw = picked(pages, page_id=id_col, url=url_col, payload=payload_col).withColumn("payload", F.coalesce(F.col("payload").cast("binary"), F.lit(b"")))
    rows = raw.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": sha1_base32(F.col("payload"))})
    owners = rows.groupBy("payload_digest").agg(F.min("page_id").alias("owner"), F.count("*").alias("n"))
    told = rows.drop("payload").join(owners, "payload_digest")
    revisits = (F.col("payload_bytes") >= min_bytes) & (F.col("page_id") != F.col("owner"))
    roles = told.withColumn("record_type", F.when(revisits, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisits, F.col("owner")))
    headers = staged(roles.select("page_id", "payload_digest", F.encode(_header_text(), "UTF-8").alias("header")), "warc-headers")

    # Owners' bytes: joined and made single on the same keys, so dealt out once. Null ids own a digest only among themselves.
    firsts = owners.select(F.col("owner").alias("page_id"), "payload_digest", "n")
    own = rows.join(firsts, ["page_id", "payload_digest"]).dropDuplicates(["page_id", "payload_digest"])
    nameless = rows.filter("page_id is null").join(owners.filter("owner is null"), "payload_digest").dropDuplicates(["payload_digest"])
    kept = [x.select("payload_digest", "n", "payload") for x in (own, nameless)]
    payloads = staged(kept[0].unionByName(kept[1]), "warc-payloads")

    copied = payloads.filter("n > 1").select("payload_digest", F.col("payload").alias("stored"))
    many = owners.filter("n > 1").select("payload_digest", "owner")
    copies = rows.join(many, "payload_digest").filter(~F.col("page_id").eqNullSafe(F.col("owner"))).select("payload_digest", "payload")
    if not copied.isEmpty() and not copies.join(copied, "payload_digest").filter("payload != stored").isEmpty():
        raise ValueError("two payloads have one digest")
    return headers, payloads.drop("n")


def read_archive(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """Each original record: page_id, header, payload, and record, its bytes in a WARC file."""
    found = headers.join(payloads, "payload_digest")
    revisit = F.contains(F.col("header"), F.lit(f"{CRLF}WARC-Type: revisit{CRLF}".encode()))
    body = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    return found.select("page_id", "header", "payload", F.concat("header", body, F.lit((CRLF * 2).encode())).alias("record"))


def export_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """WARC files of UTF-8 records. Every record ends in a line feed, which the text writer adds."""
    whole = F.decode("record", "UTF-8")
    records.select(F.substring(whole, F.lit(1), F.length(whole) - 1).alias("value")).write.option("lineSep", "\n").option("compression", compression).text(path)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            data, rows = io.BytesIO(content), []
            stream = gzip.GzipFile(fileobj=data) if content[:2] == b"\x1f\x8b" else data
            while True:
                lines = []
                while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
                    lines.append(line.decode("utf-8", "replace").rstrip("\r\n"))
                if not lines:
                    if line:
                        continue  # blank lines between records
                    break
                fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                size = int(fields["content-length"]) if fields.get("content-length", "").isdigit() else 0
                block = stream.read(size)
                head, _, payload = block.partition(b"\r\n\r\n")
                error = None if lines[0].startswith("WARC/") and "content-length" in fields and len(block) == size else "not a whole record"
                rows.append((path, fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-payload-digest"), fields.get("warc-refers-to"), head, payload, error))
                if error or len(rows) == 1000:
                    yield pa.RecordBatch.from_pylist([dict(zip(RECORD.names, r, strict=True)) for r in rows], RECORD)
                    rows = []
                if error:
                    break
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(RECORD.names, r, strict=True)) for r in rows], RECORD)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, plain or gzip: path, record_type, record_id, target_uri, payload_digest, refers_to,
    http_header and payload (bytes; a revisit's is empty), error.

    A task reads whole files, so files should be of a part's size, as export_warc's are. What is no record, or cut
    short, gives a row with an error and ends its file; fields that a record lacks are null.
    """
    kinds = ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'string'}" for f in RECORD)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_parsed, kinds)


def parsed_records(records: DataFrame, *kept: str) -> DataFrame:
    """Records (page_id, record: whole bytes) by their own fields: page_id, record_type, refers_to, target_uri, payload (bytes; a revisit's is empty), kept columns.

    The header ends at the first empty line, the block has the bytes that Content-Length says, two line ends close the record, and the
    payload follows the block's own header; a record of which that is not so is an error.
    """
    end = CRLF * 2
    found = records.withColumn("head", F.substring_index(F.decode("record", "UTF-8"), end, 1))
    # Fields begin lines; a URL that spells one has no line ends.
    field = lambda name, value: F.regexp_extract("head", rf"\r\n{name}: {value}(?:\r\n|$)", 1)
    found = found.withColumns({"size": F.octet_length("head"), "stated": field("Content-Length", "([0-9]+)").try_cast("int")})
    whole = F.startswith("head", F.lit("WARC/")) & (F.octet_length("record") == F.col("size") + F.col("stated") + 8)
    block = F.when(F.coalesce(whole, F.lit(False)), F.substring(F.col("record"), F.col("size") + 5, F.col("stated"))).otherwise(F.raise_error(F.lit("not a whole record")).cast("binary"))
    found = found.withColumn("block", block).withColumn("http", F.octet_length(F.substring_index(F.decode("block", "UTF-8"), end, 1)))
    refers = field("WARC-Refers-To", "<urn:page:(-?[0-9]+)>")
    return found.select(
        "page_id",
        field("WARC-Type", "([a-z]+)").alias("record_type"),
        F.when(refers != "", refers.cast("long")).alias("refers_to"),
        field("WARC-Target-URI", "([^\\r]*)").alias("target_uri"),
        F.substring(F.col("block"), F.col("http") + 5, F.octet_length("block")).alias("payload"),
        *kept,
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages archived and read back: every column comes from the records' own bytes, a revisit's payload from the store that its digest names."""
    told = parsed_records(read_archive(*write_archive(table(spark, sf_dir, "pages"))).withColumnRenamed("payload", "stored"), "stored")
    payload = F.when(F.col("record_type") == "revisit", F.col("stored")).otherwise(F.col("payload"))
    return told.withColumn("payload", payload).select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), sha1_base32(F.col("payload")).alias("payload_digest"), "record_type", "refers_to", "target_uri")
