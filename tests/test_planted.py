"""Queries that find nothing, or little, in the given tables: against their SQL on planted rows."""

import random
import sys
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).parent))
from compare import difference  # noqa: E402

from tessera.plans import oracle_sql, queries  # noqa: E402


def same(spark, path, name, tables):
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        if not Path(path, f"{table}.parquet").exists():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/{table}.parquet/*.parquet')")
    said, n = difference(spark, con, str(path), queries()[name], oracle_sql()[name])
    assert not said
    return n


PAGES = [
    (1, "http://a.example.com/law/one", "<TABLE><tr><th>A|b</th><td> x <b>y</b>\n</td></tr><tr><td>only</td></tr><tr></tr></TABLE><p>t</p><table></table><table><tr><td></td></tr></table>"),
    (2, "http://a.example.com/law/two", "<meta name='date' content='2024-02-30'><meta content=\" told \" name='description'><time datetime='2023-05-06T10:00'>x</time>"),
    (3, "http://b.example.com/x", '<meta property="article:published_time" content="2022-01-02T03:04"><script type="application/ld+json">{"datePublished": "2020-01-01"}</script>&amp;lt; &nbsp;a<br>b<style>p{}</style>'),
    (4, "http://b.example.com/x", '<script>x < 1</script  ><!-- a\n<p> -->kept &#39;q&#39;{"datePublished" : "2019-09-09"}'),
    (5, "http://c.example.com", None), (6, "http://c.example.com/q", ""),
]


def test_pages(spark, tmp_path):
    tables = {"pages": (PAGES, "page_id long, url string, html string")}
    assert same(spark, tmp_path, "page_tables", tables) == 2
    assert same(spark, tmp_path, "page_dates", tables) == 6
    assert same(spark, tmp_path, "page_texts", tables) == 6
    assert same(spark, tmp_path, "shared_prefixes", tables) == 2


def test_citations(spark, tmp_path):
    rows = [(1, "Article 5 and ARTICLE  5, art. 12  bis; Section 9 of Law No. 2004-12 and loi n° 98/7."), (2, "decree 12-3 amends act 7/99; articles 4"), (3, ""), (4, None), (5, "décret 2011-115 article 1240 ter")]
    assert same(spark, tmp_path, "cited_numbers", {"documents": (rows, "doc_id long, text string")}) == 8


def vectors(rng):
    """Groups of equal, near (0.8 to 0.99) and unlike vectors."""
    rows = []
    for g in range(25):
        base = [rng.gauss(0, 1) for _ in range(64)]
        for k in range(rng.randrange(1, 6)):
            spread = rng.choice([0.0, 0.05, 0.2, 0.35, 0.45])
            rows.append((base if not spread else [x + rng.gauss(0, spread) for x in base], (g + k) % 4))
    rng.shuffle(rows)
    return [(i, [float(x) for x in v], label) for i, (v, label) in enumerate(rows)]


def test_vectors(spark, tmp_path):
    rows = vectors(random.Random(2))
    tables = {"embeddings": (rows, "vec_id long, embedding array<float>, label int"), "labels": ([(i, i % 2, 0) for i in range(0, len(rows), 3)], "doc_id long, quality int, toxic int")}
    assert same(spark, tmp_path, "similar_vectors", tables) > 20
    assert same(spark, tmp_path, "cross_source_copies", tables) > 10
    assert same(spark, tmp_path, "vector_clusters", tables) == len(rows)
    assert same(spark, tmp_path, "equal_vectors", tables) == len(rows)


def test_contexts(spark, tmp_path):
    rows = [(c, t, "user", "x" * (37 * ((c * 7 + t * 5) % 19))) for c in range(5) for t in range(8)]
    assert same(spark, tmp_path, "packed_contexts", {"conversations": (rows, "conv_id long, turn long, role string, text string")}) == 5
