"""DuckDB SQL with the same rows as the queries whose rules SQL can state. Quadratic in places: for small tables."""

from __future__ import annotations

from tessera.llm import pii

FEED = "chr(10)"

#: Each two neighbouring lines of text, with the blank lines between them, that occurred before; all lines of such pairs go.
LINES = f"""WITH s AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL), l AS (SELECT doc_id, text, unnest(string_split(text, {FEED})) AS line, generate_subscripts(string_split(text, {FEED}), 1) AS i FROM s),
 p AS (SELECT doc_id, text, i AS low, line AS x, lead(line) OVER w AS y, lead(i) OVER w + 1 AS high FROM l WHERE trim(line, ' ') <> '' WINDOW w AS (PARTITION BY doc_id, text ORDER BY i)),
 o AS (SELECT doc_id, text, low, high, min({{'d': doc_id, 'i': low}}) OVER (PARTITION BY x, y, high - low) AS o FROM p WHERE high IS NOT NULL),
 g AS (SELECT DISTINCT doc_id, text, unnest(range(low, high)) AS i FROM o WHERE doc_id > o.d OR low - o.i >= high - low),
 k AS (SELECT l.doc_id, l.text, string_agg(l.line, {FEED} ORDER BY l.i) FILTER (WHERE g.i IS NULL) AS kept, count(g.i) AS n FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.text = g.text AND l.i = g.i GROUP BY 1, 2)
 SELECT d.doc_id, CASE WHEN n > 0 THEN coalesce(kept, '') ELSE d.text END AS text, coalesce(n, 0) AS n_removed FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id AND d.text = k.text"""

#: Base32 by fives of bits: five hexadecimal digits are four letters.
WARC = """WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS o FROM pages)
 SELECT page_id, strlen(h) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(x, 1 + 5 * (i // 4), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)), '') AS payload_digest,
 CASE WHEN page_id <> o THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> o THEN o END AS refers_to, regexp_replace(url, '[\\r\\n]', '', 'g') AS target_uri FROM p"""

#: All pairs that share a shingle, their exact similarity, and whatever can be reached by links.
NEARDUP = r"""WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM t), c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2), e AS (SELECT a, b FROM p JOIN c x ON a = x.doc_id JOIN c y ON b = y.doc_id WHERE 100 * k >= 80 * (x.n + y.n - k)),
 r AS (SELECT doc_id, doc_id AS o FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.o = e.a), m AS (SELECT doc_id, min(o) AS o FROM r GROUP BY 1)
 SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, m.o AS component_id, d.doc_id IS NOT DISTINCT FROM m.o AS kept FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN m ON d.doc_id = m.doc_id"""

DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
LUHN = f"list_sum(list_transform(range(0, length({DIGITS})), lambda i: CAST(substr({DIGITS}, length({DIGITS}) - i, 1) AS INTEGER) * (1 + i % 2) - CASE WHEN i % 2 = 1 AND substr({DIGITS}, length({DIGITS}) - i, 1) > '4' THEN 9 ELSE 0 END)) % 10 = 0"
#: Kind, pattern and test of a match m. A number of the form of an ssn is a whole run of digits and hyphens.
KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "NOT coalesce(list_bool_or(list_transform(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(ltrim(p, '0') AS BIGINT) > 255, false))), false)"),
    ("card", r"[0-9](?:[ -]?[0-9])+", f"length({DIGITS}) BETWEEN 16 AND 19 AND {LUHN}"),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", f"length({DIGITS}) BETWEEN 8 AND 15"),
    ("ssn", r"[0-9-]+", "regexp_full_match(m, '[0-8][0-9]{2}-[0-9]{2}-[0-9]{4}') AND left(m, 3) NOT IN ('000', '666') AND substr(m, 5, 2) <> '00' AND right(m, 4) <> '0000'"),
    ("word", r"[A-Za-z0-9]+", "regexp_matches(m, '^[A-Z]{2}[0-9]{2}')"),
)


def runs(kind: str, pattern: str, test: str) -> str:
    """doc_id, kind, text, m, low: matches by what lies between them."""
    cut = f"SELECT doc_id, text, unnest(string_split_regex(text, '{pattern}')) AS s, unnest(regexp_extract_all(text, '{pattern}')) AS m, unnest(range(0, len(string_split_regex(text, '{pattern}')))) AS i FROM t"
    at = f"SELECT doc_id, text, m, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i) + coalesce(sum(length(m)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low FROM ({cut})"
    return f"SELECT doc_id, '{kind}' AS kind, text, m, low FROM ({at}) WHERE m IS NOT NULL AND {test}"


def pii_sql() -> str:
    known = "MAP {" + ", ".join(f"'{c}': {n}" for c, n in pii.IBAN_LENGTHS.items()) + "}"
    value = "CASE WHEN c BETWEEN '0' AND '9' THEN CAST(c AS INTEGER) ELSE ord(c) - 55 END"
    mod97 = f"list_reduce(list_prepend(0, list_transform(string_split(substr(c, 5) || left(c, 4), ''), lambda c: {value})), lambda a, v: CASE WHEN v < 10 THEN (a * 10 + v) % 97 ELSE (a * 100 + v) % 97 END) = 1"
    near = " ".join(f"WHEN '{k}' THEN regexp_matches(before, '(?i)[^\\pL\\pN_](?:{p.pattern[5:-3]})(?:[^\\pL\\pN_]|$)')" for k, p in pii.WORDS.items())
    prior = " ".join(f"WHEN '{k}' THEN {x + (pii.CHECKSUM if k in ('card', 'iban') else 0):.1f}" for k, x in pii.PRIOR.items())
    order = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate((*pii.BASE, *pii.ADDED)))
    joined = lambda which="": f"coalesce(string_agg(kind || ':' || low || ':' || high, ',' ORDER BY place, low){which}, '')"
    base = "kind IN ('email', 'ip', 'card', 'phone')"
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {", ".join(f"{k} AS ({runs(k, p, c)})" for k, p, c in KINDS)},
 x AS (SELECT doc_id, low, text, {known}[left(m, 2)] AS k FROM word),
 u AS (SELECT doc_id, low, text, unnest(CASE WHEN k IS NULL THEN range(15, 35) ELSE [k] END) AS n FROM x),
 q AS (SELECT doc_id, low, n, text, regexp_extract(substr(text, CAST(low + 1 AS BIGINT), 80), '^[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}}') AS all_of FROM u),
 z AS (SELECT *, list_filter(range(1, length(all_of) + 1), lambda i: substr(all_of, i, 1) <> ' ')[n] AS len FROM q WHERE all_of <> ''),
 y AS (SELECT doc_id, low, n, text, left(all_of, len) AS m, replace(left(all_of, len), ' ', '') AS c FROM z WHERE len IS NOT NULL AND NOT regexp_matches(substr(text, CAST(low + len + 1 AS BIGINT), 1), '[A-Za-z0-9]')),
 v AS (SELECT doc_id, low, any_value(text) AS text, arg_max(m, n) AS m FROM y WHERE {mod97} GROUP BY 1, 2),
 iban AS (SELECT doc_id, 'iban' AS kind, text, m, low FROM v WHERE NOT EXISTS (SELECT 1 FROM v o WHERE o.doc_id = v.doc_id AND o.low < v.low AND o.low + length(o.m) > v.low)),
 f AS ({" UNION ALL ".join(f"SELECT * FROM {k}" for k in (*pii.BASE, *pii.ADDED))}),
 b AS (SELECT doc_id, kind, CAST(low AS BIGINT) AS low, CAST(low + length(m) AS BIGINT) AS high, CASE kind {order} END AS place, CASE WHEN low <= {pii.CONTEXT} THEN '!' || left(text, CAST(low AS BIGINT)) ELSE substr(text, CAST(low - {pii.CONTEXT} AS BIGINT), {pii.CONTEXT + 1}) END AS before FROM f),
 w AS (SELECT *, least(1.0, CASE kind {prior} END + CASE WHEN CASE kind {near} END THEN {pii.NEARBY} ELSE 0 END) AS score FROM b), g AS (SELECT * FROM w WHERE {base} OR score >= {pii.THRESHOLD}),
 r AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.BASE)}, sha256({joined(f" FILTER ({base})")}) AS base_sha256, {joined()} AS spans, string_agg(printf('%.1f', CAST(score AS DOUBLE)), ',' ORDER BY place, low) AS scores FROM g GROUP BY 1)
 SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.BASE)}, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id"""

#: Every order of five letters, every step of it, over counts by what a document fails.
FILTERS = r"""WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 f AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails FROM t),
 l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY 1),
 c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY 1, 2),
 x(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')), o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
 s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS here, left(filter_order, step - 1) AS earlier FROM o, range(1, 6) r(step)),
 m AS (SELECT part, filter_order, step, here, n, good, toxic, contains(fails, here) AS yes, fails = here AS alone, len(list_intersect(string_split(fails, ''), list_filter(string_split(earlier, ''), lambda y: y <> ''))) > 0 AS gone FROM c, s),
 g AS (SELECT part, filter_order, step, here, coalesce(sum(n) FILTER (NOT yes AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (yes AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (yes AND gone), 0) AS redundant, coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
  coalesce(sum(good) FILTER (yes AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (yes AND NOT gone), 0) AS toxic_lost FROM m GROUP BY 1, 2, 3, 4)
 SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, here) AS BIGINT) AS shapley FROM g"""


def merkle_sql(leaf_levels: int = 5, source_levels: int = 4) -> str:
    """Trees level by level, of up to 16^5 leaves a source and 16^4 sources."""
    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || {x} END" for c, x in [*((c, c) for c in ("doc_id", "source", "lang", "n_chars")), ("text", text)]) + ")"

    def levels(name: str, n: int) -> list[str]:
        return [f"{name}{k} AS (SELECT p, pos // 16 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h, string_agg(h, '' ORDER BY pos) AS cat, any_value((m + 15) // 16) AS m FROM {name}{k - 1} WHERE m > 1 GROUP BY p, pos // 16)" for k in range(1, n + 1)]

    def walk(name: str, nodes: str, pos: str, n: int, extra: str, start: str) -> list[str]:
        steps = [start]
        for k in range(1, n + 1):
            low, high = f"left(n.cat, 64 * (w.{pos} // {16 ** (k - 1)} % 16))", f"substr(n.cat, 64 * (w.{pos} // {16 ** (k - 1)} % 16) + 65)"
            steps.append(f"{name}{k} AS (SELECT w.* REPLACE (CASE WHEN n.cat IS NULL THEN f ELSE sha256({low} || f || {high}) END AS f, CASE WHEN n.cat IS NULL THEN proof ELSE proof || {low} || {high} END AS proof) FROM {name}{k - 1} w LEFT JOIN {nodes}{k} n ON {extra} AND w.{pos} // {16**k} = n.pos)")
        return steps

    bits = "list_reduce(list_prepend(x, [0, 0, 0, 0, 0, 0, 0, 0]), lambda u, v: xor(u >> 1, CASE WHEN u & 1 = 1 THEN 3988292384 ELSE 0 END))".replace("x,", "xor(a, c),", 1)
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, c: {bits}), 4294967295)"
    lowered = leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    parts = [
        f"d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS p, {leaf('text')} AS h, CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN {lowered} END AS changed FROM documents)",
        "a0 AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY p) AS m FROM d)",
        *levels("a", leaf_levels),
        "tops AS (" + " UNION ALL ".join(f"SELECT p, h FROM a{k} WHERE m = 1" for k in range(leaf_levels + 1)) + ")",
        "b0 AS (SELECT '' AS p, p AS source, h, row_number() OVER (ORDER BY p) - 1 AS pos, count(*) OVER () AS m FROM tops)",
        *levels("b", source_levels),
        "root AS (" + " UNION ALL ".join(f"SELECT h AS root FROM b{k} WHERE m = 1" for k in range(source_levels + 1)) + ")",
        *walk("w", "a", "pos", leaf_levels, "w.p = n.p", "w0 AS (SELECT doc_id, p, pos, h AS leaf, coalesce(changed, h) AS f, '' AS proof FROM a0)"),
        *walk("v", "b", "place", source_levels, "true", f"v0 AS (SELECT w.*, b0.pos AS place, b0.h AS subroot FROM w{leaf_levels} w JOIN b0 ON w.p = b0.source)"),
    ]
    return "WITH " + ",\n ".join(parts) + f"\n SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM v{source_levels} CROSS JOIN root"
