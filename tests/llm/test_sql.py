"""Queries against their SQL, on given tables and on planted rows."""

import random

import duckdb
import pytest

from tests.compare import connect, difference
from tessera.llm.queries import oracle_sql, queries

PII = [
    "", None, "none here", "IBAN DE89370400440532013000 BIC COBADEFFXXX", "pay DE89 3704 0044 0532 0130 00 BIC COBADEFF", "GB82WEST12345698765432 2024 invoice", "xDE89370400440532013000", "DE88370400440532013000",
    "ssn 123-45-6789, 123-45-6789", "123-45-6789 alone", "ssn 000-45-6789 ssn 666-45-6789 ssn 123-00-6789 ssn 123-45-0000 ssn 923-45-6789 ssn 1123-45-6789", "mail a.b+c@x-y.co.uk, e-mail: q@w.e and a@b@c.d", "é" * 60 + " server 10.0.0.256 10.0.0.255 1.2.3.4.5 000001.2.3.4",
    "Card 4111 1111 1111 1111 visa 4111-1111-1111-1112 12345678901234567890 6304000000000000003", "call +49 (30) 123456-78 or +1 2 or Tel. +33 1 23 45 67 89.", "téléphone +33123456789", "card " + "x" * 43 + "4111111111111111 card" + "y" * 44 + " 4111111111111111",
    "mycard 4111111111111111", "a_phone +123456789 phone\n+123456789", "ZZ" + "68" + "A1B2C3D4E5F6", "account NO9386011117947 and BE68539007547034", "DE89370400440532013000 DE89370400440532013000",
]


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_given_tables(spark, name):
    con = connect("/root/testdata/sf0.001")
    said, n = difference(spark, con, "/root/testdata/sf0.001", queries()[name], oracle_sql()[name])
    assert not said and n


def planted(spark, path, rows, kind="documents", schema="doc_id long, text string"):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{kind}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {kind} AS SELECT * FROM read_parquet('{path}/{kind}.parquet/*.parquet')")
    return con


@pytest.mark.parametrize("name", ["op3_lines", "op8_pii", "op10_neardup"])
def test_planted_documents(spark, tmp_path, name):
    rng = random.Random(8)
    passages = [[f"line {p} {k}" if rng.random() < 0.8 else rng.choice(["", " "]) for k in range(rng.randint(2, 6))] for p in range(5)]
    texts = ["\n".join(x for _ in range(rng.randint(1, 5)) for x in rng.choice([*passages, [f"own {rng.random()}", "\t"]])) for _ in range(80)]
    con = planted(spark, tmp_path, list(enumerate(PII + texts)))
    said, n = difference(spark, con, str(tmp_path), queries()[name], oracle_sql()[name])
    assert not said and n == len(PII) + len(texts)


def test_planted_pages(spark, tmp_path):
    rows = [(1, "u1", "<p>é</p>"), (2, None, None), (3, "u3", ""), (4, "u\r\n4", "<p>é</p>"), (9, "u WARC-Refers-To: <urn:page:7>", "x")]
    con = planted(spark, tmp_path, rows, "pages", "page_id long, url string, html string")
    said, n = difference(spark, con, str(tmp_path), queries()["op5_warc"], oracle_sql()["op5_warc"])
    assert not said and n == 5


def test_planted_labels(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice([i, i, i // 2, None]), rng.choice([None, "", "A#", " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.choice([150, 220]))), "same " * 3]), rng.choice([None, "", "en", "de"])) for i in range(150)]
    con = planted(spark, tmp_path, rows, schema="doc_id long, text string, lang string")
    spark.createDataFrame([(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 150, 2)] + [(4, 1, 1)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    con.execute(f"CREATE VIEW labels AS SELECT * FROM read_parquet('{tmp_path}/labels.parquet/*.parquet')")
    said, n = difference(spark, con, str(tmp_path), queries()["op11_filters"], oracle_sql()["op11_filters"])
    assert not said and n == 3 * 600


def test_planted_sources(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.choice([i, i, None, i // 3]), rng.choice([None, "", "ABC é", f"T {i}"]), rng.choice([None, "en"]), rng.choice([None, "", "é", "hot", "hot", "hot", f"s{i % 40}"]), rng.choice([None, i])) for i in range(900)]
    con = planted(spark, tmp_path, rows, schema="doc_id long, text string, lang string, source string, n_chars long")
    said, n = difference(spark, con, str(tmp_path), queries()["op13_merkle"], oracle_sql()["op13_merkle"])
    assert not said and n == 900
