"""Crawl order, sitemaps, derived states, projections, chunks by meaning, common parts, caches and streams against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking, derived, graph, pages, projection, retrieval, routing, selection
from tessera.streaming import jobs


@pytest.mark.parametrize("most", [None, 1, 7, 25])
def test_crawl_order(spark, most):
    rng = random.Random(4)
    links = [(f"u{rng.randrange(40)}", f"u{rng.randrange(60)}") for _ in range(120)]
    known = {f"u{i}" for i in range(0, 60, 3)}
    queue, seen, want = ["u1", "u2"], {"u1", "u2"}, []
    for depth in range(4):
        ahead = []
        for url in queue:
            if most is None or len(want) < most:
                want.append((url, depth, len(want)))
        if most is not None and len(want) >= most:
            break
        for url in queue:
            ahead += sorted({t for s, t in links if s == url} - seen - set(ahead))
        queue = [u for u in ahead if u not in known] + [u for u in ahead if u in known]
        seen |= set(queue)
    got = graph.crawl_order(spark, spark.createDataFrame(links, "source string, target string"), ["u1", "u2"], 3, most, spark.createDataFrame([(u,) for u in known], "url string"))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[2]) == want


def test_sitemaps_through_indexes(spark):
    entry = lambda kind, *urls: "".join(f"<{kind}><loc>{u}</loc></{kind}>" for u in urls)
    files = [("root", entry("sitemap", "a", "b", "missing")), ("a", entry("url", "p1", "p2") + entry("sitemap", "c", "root")), ("b", entry("url", "p2")), ("c", entry("url", "p3", "p1")), ("other", entry("url", "p9")), ("null", None)]
    got = pages.sitemap_closure(spark.createDataFrame(files, "path string, xml string"), ["root"])
    assert {(r.url, r.sitemap, r.depth) for r in got.collect()} == {("p1", "a", 1), ("p2", "a", 1), ("p3", "c", 2)}


def test_derived_states(spark, tmp_path):
    rng, path = random.Random(5), str(tmp_path / "state")
    runs = [(f"j{rng.randrange(30)}", t, rng.random() < 0.3) for t in range(300)]
    schema = "name string, at int, ok boolean"

    def want(some):
        found = {}
        for name, at, ok in some:
            _, success, failures, n = found.get(name, (None, None, 0, 0))
            found[name] = (at, at if ok else success, 0 if ok else failures + 1, n + 1)
        return found

    for end in (100, 200, 300):
        assert derived.write_derived(spark.createDataFrame([*runs[end - 100 : end], (None, 1, True)], schema), path, "name", derived.run_state) == len({r[0] for r in runs[end - 100 : end]})
        assert {r["name"]: (r["last_run"], r["last_success"], r["failures"], r["runs"]) for r in spark.read.parquet(path).collect()} == want(runs[:end])
    files = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "state").rglob("*.parquet")}
    derived.write_derived(spark.createDataFrame([("j3", 999, True)], schema), path, "name", derived.run_state)
    after = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "state").rglob("*.parquet")}
    assert len(set(files.items()) - set(after.items())) == 1
    assert derived.write_derived(spark.createDataFrame([], schema), path, "name", derived.run_state) == 0


def test_projection(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 12)) @ rng.normal(size=(12, 12)) + 3
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r["id"]: r["v"] for r in projection.projected(spark.createDataFrame([*rows, (900, None), (901, [1.0]), (902, [None] * 12)], "id long, v array<double>").repartition(7), 5).collect()}
    centred = x - x.mean(0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    want = centred @ axes[:5].T
    mine = np.asarray([got[i] for i in range(200)])
    assert np.allclose(np.abs(mine), np.abs(want), atol=1e-8) and np.allclose(mine[:, 0] @ want[:, 0], math.copysign(1, mine[:, 0] @ want[:, 0]) * (want[:, 0] @ want[:, 0]))
    assert got[900] is got[901] is got[902] is None
    few = spark.createDataFrame(rows[:15], "id long, v array<double>")
    assert {r["id"]: r["v"] for r in projection.projected(few, 5).collect()} == dict(rows[:15])
    assert projection.projected(few.limit(0), 5).count() == 0


def chunks_of(sentences, size, overlap):
    """The rule, sentence by sentence."""
    def windows(text):
        w, step = text.split(), size - overlap
        return [" ".join(w[i * step : i * step + size]) for i in range((len(w) - 1) // step + 1)] if w else []

    def cos(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0

    if len(sentences) < 3:
        return windows(" ".join(s for s, _ in sentences))
    near = [cos(a[1], b[1]) for a, b in zip(sentences, sentences[1:], strict=False)]
    bar = sum(near) / len(near)
    bar -= math.sqrt(sum((x - sum(near) / len(near)) ** 2 for x in near) / len(near))
    groups = [[sentences[0][0]]]
    for (s, _), x in zip(sentences[1:], near, strict=True):
        groups.append([s]) if x < bar else groups[-1].append(s)
    out, held = [], []
    for g in groups:
        held += g
        n = len(" ".join(held).split())
        if n >= size // 3:
            out += windows(" ".join(held)) if n > int(size * 1.5) else [" ".join(held)]
            held = []
    if held:
        out = [*out[:-1], out[-1] + " " + " ".join(held)] if out else [" ".join(held)]
    return out


def test_chunks_by_meaning(spark):
    rng, rows, want = random.Random(7), [], {}
    for doc in range(40):
        told = [(" ".join(rng.choice("abcdef") * 3 for _ in range(rng.randrange(1, rng.choice([6, 40])))), [float(rng.randrange(3)) for _ in range(4)]) for _ in range(rng.choice([1, 2, 3, 8, 30]))]
        want[doc] = chunks_of(told, 30, 5)
        rows += [(doc, n, s, v) for n, (s, v) in enumerate(told)]
    rng.shuffle(rows)
    got = {}
    for r in chunking.semantic_chunks(spark.createDataFrame(rows, "doc_id int, n int, sentence string, v array<double>"), 30, 5).orderBy("doc_id", "chunk").collect():
        assert r["n_words"] == len(r["content"].split()) and r["chunk"] == len(got.setdefault(r["doc_id"], []))
        got[r["doc_id"]].append(r["content"])
    assert got == want


def test_chunks_by_hand(spark):
    near, far = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, i, f"{c} {c} {c} {c}", v) for i, (c, v) in enumerate([("a", near), ("b", near), ("c", near), ("d", far), ("e", far), ("f", far), ("g", far)])]
    # Similarities 1 1 0 1 1 1: one boundary, before d. Eight of 24 words close a chunk; 12 and 16 are under 36.
    got = chunking.semantic_chunks(spark.createDataFrame(rows, "doc_id int, n int, sentence string, v array<double>"), 24, 0).orderBy("chunk").collect()
    assert [r["content"] for r in got] == ["a a a a b b b b c c c c", "d d d d e e e e f f f f g g g g"]


def test_common_parts(spark):
    urls = ["http://a.org/x/laws/1", "http://a.org/laws/22?q", "http://A.org/old/laws/", "http://b.org/one", "http://b.org/two", "http://c.org/only", "http://d.org/same", "http://d.org/same", "http://e.org/abcd-wxyz", "http://e.org/wxyz-abcd", None]
    got = {(r.host, r.value, r.n_paths) for r in pages.common_substrings(spark.createDataFrame([(u,) for u in urls], "url string")).collect()}
    assert got == {("a.org", "/laws/", 3), ("e.org", "abcd", 2)}


def test_cache_levels(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(6, 16))
    cache = [(f"k{i}", f"t{i}", ["s", "t"][i % 2], ["d", None][i % 5 == 0], (base[i % 6] + rng.normal(size=16) * (0 if i % 4 else 0.3)).tolist(), i) for i in range(60)]
    asked = [(i, f"t{i * 7}", ["s", "t", "z"][i % 3], ["d", "q", None][i % 3], (base[i % 6] + rng.normal(size=16) * [0.8, 0.3, 0][i % 3]).tolist() if i % 11 else None) for i in range(60)]

    def cos(a, b):
        return float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)) if a is not None else 0

    want = {}
    for i, text, scope, domain, v in asked:
        exact = [k for k in cache if k[1] == text and k[2] == scope]
        near = [k for k in cache if k[2] == scope and cos(v, k[4]) >= 0.85]
        part = [k for k in cache if domain and k[3] == domain and cos(v, k[4]) >= 0.7]
        want[i] = (exact[-1][0], "exact") if exact else (near[0][0], "near") if near else (part[0][0], "partial") if part else (None, "none")
    told = selection.cached_answers(spark.createDataFrame(asked, "id int, text string, scope string, domain string, v array<double>"), spark.createDataFrame(cache, "key string, text string, scope string, domain string, v array<double>, at int"), 0.85, 0.7)
    assert {r.id: (r.key, r.how) for r in told.collect()} == want and len({h for _, h in want.values()}) == 4


@pytest.mark.parametrize(("claim", "source", "kind", "want"), [
    ("Article 12", "see ARTICLE 12 of", "article", 1.0), ("loi n 58 of 2017", "the 2017 text, number 58", "law", 0.6), ("loi n 58 of 2017", "the 2017 text, number 58", "source", 0.0), ("art 12", "page 1212", "article", 0.6),
    ("court court court said so", "the court", "source", 1.5), ("a b", "c d", "law", 0.0), ("word other more", "word other less text", "source", 0.0),
])
def test_citation_support(spark, claim, source, kind, want):
    got = spark.createDataFrame([(claim, source, kind)], "a string, b string, k string").select(retrieval.citation_support(F.col("a"), F.col("b"), F.col("k"))).first()[0]
    assert got == pytest.approx(want)


def test_short_chunks_go():
    row = "one two three four five six seven eight nine ten"
    assert [c[2] for c in routing.route(f"--- Page 1 ---\n{row}\n--- Page 2 ---\n{'7 ' * 12}", "page", 100, 0)] == [f"--- Page 1 ---\n{row}\n\n--- Page 2 ---\n{('7 ' * 12).strip()}"]
    assert routing.route("few words", "adaptive", 100, 0) == [("text", None, "few words")]


def test_killed_half_way_each_row_once(spark, tmp_path):
    for k in range(4):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sink, killed = jobs.write_batches(str(tmp_path / "out")), []

    def dies(df, batch):
        sink(df.limit(3) if batch == 2 and not killed else df, batch)
        if batch == 2 and not killed:
            killed.append(batch)
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        jobs.run_available(jobs.source(spark, str(tmp_path / "in"), "id long", 1), str(tmp_path / "c"), dies)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 23
    jobs.run_available(jobs.source(spark, str(tmp_path / "in"), "id long", 1), str(tmp_path / "c"), dies)
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("id").collect()) == list(range(40))


def test_states_expire(spark, tmp_path):
    start, path = 1_700_000_000, str(tmp_path / "e")
    for k, rows in enumerate([[(u, start + u, u) for u in range(20)], [(100, start + 10_000, 50)], [(101, start + 20_000, 50)]]):
        spark.createDataFrame(rows, "event_id long, s long, user_id long").selectExpr("event_id", "timestamp_seconds(s) AS ts", "user_id").coalesce(1).write.mode("append").parquet(path)
        q = jobs.rate_limit(jobs.source(spark, path, "event_id long, ts timestamp, user_id long"), 3, 60, late="10 seconds").writeStream.foreachBatch(lambda df, _: df.count()).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
        if k == 2:
            assert held[-1] <= 2
