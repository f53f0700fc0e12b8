"""Queries that differed from their SQL on other tables than the given ones."""

import functools
import operator
import random

import numpy as np
from test_planted import same

from tessera.operators import graph, legal
from tessera.plans import queries, relational


def test_customer_without_orders(spark, tmp_path):
    tables = {"customer": ([(1, 7097.2), (2, 500.0), (3, 20000.0)], "c_custkey long, c_acctbal double"), "orders": ([(10, 2), (11, 2)], "o_orderkey long, o_custkey long")}
    assert same(spark, tmp_path, "risk_scores", tables) == 3


def test_mean_at_the_bar(spark, tmp_path):
    """A mean of exactly 0.05 is not above it, in whatever order doubles would be summed."""
    # As many of 0.03 as of 0.07; doubles are then shuffled until they add up to more.
    orders = (random.Random(seed).sample([0.0, 0.1, 0.03, 0.07, 0.01, 0.09] * 85, 510) for seed in range(300))
    values = next(x for x in orders if functools.reduce(operator.add, x) / 510 > 0.05)
    rows = [(1, x) for x in values] + [(2, 0.06)] * 510 + [(3, 0.09)] * 500
    spark.createDataFrame(rows, "l_suppkey long, l_discount double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in queries()["busy_suppliers"](spark, str(tmp_path)).collect()] == [(2, 510, 0.06)]


def test_mean_between_two_numbers(spark, tmp_path):
    """A mean of 0.0521875 is rounded as the doubles add up in the order of the rows: of these orders some to 0.052187, some to 0.052188."""
    values = sorted(i % 11 / 100 for i in range(640))[15:] + [0.1] * 14 + [0.09]
    orders = [random.Random(seed).sample(values, 640) for seed in range(40)]
    low = [x for x in orders if functools.reduce(operator.add, x) / 640 < 0.0521875]
    high = [x for x in orders if functools.reduce(operator.add, x) / 640 >= 0.0521875]
    rows = [(s, x) for three in zip(low[0], low[1], high[0], strict=True) for s, x in zip((1, None, 2), three, strict=True)] + [(3, 0.06)] * 510 + [(4, None)] * 510
    assert same(spark, tmp_path, "busy_suppliers", {"lineitem": (rows, "l_suppkey long, l_discount double")}) == 4
    found = {r["l_suppkey"]: r["discount"] for r in queries()["busy_suppliers"](spark, str(tmp_path)).collect()}
    assert found == {1: 0.052187, None: 0.052187, 2: 0.052188, 3: 0.06}


def test_sums_in_order(spark, tmp_path):
    values = [random.Random(9).uniform(-1, 1) * 10.0 ** (i % 7) for i in range(1000)]
    spark.createDataFrame([(i % 2, x) for i, x in enumerate(values)] + [(None, 0.5), (None, None), (7, 1.0)], "k long, x double").coalesce(1).write.parquet(f"{tmp_path}/t")
    chosen = spark.createDataFrame([(0,), (1,), (None,)], "k long")
    add = lambda xs: functools.reduce(operator.add, xs, 0.0)
    for run in (64, 1 << 16):
        got = {r["k"]: r["added"] for r in relational.sums_in_order(spark.read.parquet(f"{tmp_path}/t"), chosen, "k", "x", run).collect()}
        assert got == {k: add([add(values[k::2][i : i + run]) for i in range(0, 500, run)]) for k in (0, 1)} | {None: 0.5}


def test_references_are_found_once(spark, tmp_path, monkeypatch):
    calls, plain = [], legal.legal_references
    monkeypatch.setattr(legal, "legal_references", lambda docs: calls.append(1) or plain(docs))
    rows = [(1, "L'article, Loi n° 2004-12 abrogé par la Loi n° 2010-7."), (2, "Voir Loi n° 2004-12."), (3, None)]
    assert same(spark, tmp_path, "repealed_references", {"documents": (rows, "doc_id long, text string")}) == 2
    assert len(calls) == 1


def test_ranks_keep_an_edge_once(spark, monkeypatch):
    """Edges in both directions are written once, with their degrees elsewhere; before, four rows an edge."""
    rows, plain = [(1, 2), (2, 1), (2, 3), (4, 4), (5, None), (None, 5), (None, 6), (None, None), (2, 3)], graph.saved
    edges = spark.createDataFrame(rows, "src long, dst long")
    want = graph.pagerank(edges.union(edges.select("dst", "src")), most=3)
    held = []

    def counted(df):
        kept = plain(df)
        held.append(kept.count() if "src" in kept.columns else 0)
        return kept

    monkeypatch.setattr(graph, "saved", counted)
    got = graph.pagerank(edges, most=3, both=True)
    as_rows = lambda df: sorted(((r["node"], round(r["rank"], 12), round(r["score"], 12)) for r in df.collect()), key=repr)
    assert as_rows(got) == as_rows(want) and len(as_rows(got)) == 7
    assert sum(held) == 6


def test_part_ranks_of_odd_keys(spark, tmp_path):
    rows = [(1, 1), (1, 2), (-3, 2), (0, 0), (None, 2), (7, None), (7, 1), (7, 1)]
    for i, more in enumerate([[], [(1 << 62, 2), (-(1 << 63), 1 << 62)]]):
        spark.createDataFrame(rows + more, "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/{i}/lineitem.parquet")
        names = [(p if p is None else f"p{p}", s if s is None else f"s{s}") for p, s in rows + more]
        want = graph.pagerank(spark.createDataFrame(names + [(s, p) for p, s in names], "src string, dst string"))
        got = queries()["part_ranks"](spark, f"{tmp_path}/{i}").collect()
        assert {r["node"]: (r["rank"], r["score"]) for r in got} == {r["node"]: (round(r["rank"], 8), round(r["score"], 6)) for r in want.collect()}
        assert len(got) == 8 + 3 * i


def test_part_ranks_settle_in_a_large_graph(spark, tmp_path):
    """Of 12,300 nodes a mean rank is below 1e-4, at which turns once ended; ranks are those that no more turns change."""
    draw = random.Random(3)
    pairs = sorted({(p, draw.randrange(300)) for p in range(12000) for _ in range(8)} | {(p, 0) for p in range(0, 12000, 4)})
    spark.createDataFrame(pairs, "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    part, supplier = np.array(pairs).T
    src, dst = np.concatenate([part, supplier + 12000]), np.concatenate([supplier + 12000, part])
    degree, want = np.bincount(src), np.full(12300, 1 / 12300)
    for _ in range(200):
        want = 0.15 / 12300 + 0.85 * np.bincount(dst, weights=(want / degree)[src])
    score = (want - want.min()) / (want.max() - want.min())
    got = {r["node"]: (r["rank"], r["score"]) for r in queries()["part_ranks"](spark, str(tmp_path)).collect()}
    assert len(got) == 12300
    for i in range(12300):
        rank = got[f"p{i}" if i < 12000 else f"s{i - 12000}"]
        assert abs(rank[0] - want[i]) < 6e-9 and abs(rank[1] - score[i]) < 6e-7
