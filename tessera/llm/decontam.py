"""Benchmark decontamination by a BM25 inverted index with block-max bounds.

Test items are the indexed documents, training passages the queries. A posting's
impact is its BM25 weight divided by what its item scores against its own text,
so that 1 is the whole item and one bar holds for long and short items. Items
are laid out in blocks of BLOCK; the index keeps each term's largest impact
overall and in each block.

A passage is two neighbouring half-windows of words, so every item of at most a
half-window is whole in one passage. All passages are queried, in batches, with
the bounds of block-max WAND, each of which is safe:

1. the sum of the largest impacts of a passage's terms; below the bar, no item
   can reach it and the passage is done;
2. the same sum in each block, for passages that are left;
3. postings of the blocks that are left give exact scores, and every item at
   the bar or above is retrieved.

A retrieved pair is verified on the words of its passage and the half-windows
around it, and, for a part of a longer item, on as many words more on either side as the item
has there, and a quarter of these: the item's question (its words up to the last sentence) and its
answer (the last sentence, or the last third of a single one) must both have
OVERLAP of their word shingles there.

The number of parts, their mean length and each term's document frequency are counted
over all items. The items may be of any number: they are indexed in shards of
about SHARD items and SHARD_CHARS characters, each broadcast, one pass over the documents a shard; scores
do not depend on the shards. Documents are never shuffled, so neither copies nor
hot passages matter.

Words are what white space parts, in lower case, without other signs than letters
and digits. Items and texts that are null or
have no words match nothing. Repeated rows of an id are one document, repeated rows
of an item one item; rows with a null id are left out. Ties in score need no order, since all
above the threshold are kept. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import picked, slices, staged, table

K1, B = 1.2, 0.75
BLOCK = 16
BAR = 0.6
OVERLAP = 0.8
SHINGLE = 5
SHARD, SHARD_CHARS = 8192, 8_000_000
HALF = 64
#: Words of an item that are indexed at once; a longer item is indexed and found by each of its parts. A tail of under TAIL words goes with the part before it.
PART, TAIL = HALF, 2 * SHINGLE
NEITHER = r"[^\pL\pN]+"
WEIGHTS = np.random.default_rng(20240601).integers(0, 1 << 63, 512, np.uint64) * np.uint64(2) + np.uint64(1)
PRIME, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
SENTENCE_ENDS = ".!?\n"


def string_hashes(texts: pa.Array) -> np.ndarray:
    """A hash per (large) string, from random weights of its bytes by place; 0 for the empty string."""
    texts = pa.concat_arrays([texts])
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8, offsets[-1]) if offsets[-1] else np.zeros(0, np.uint8)
    raw, lengths = raw[offsets[0] :], np.diff(offsets)
    out = np.zeros(len(texts), np.uint64)
    full = lengths > 0
    if full.any():
        first = (offsets[:-1] - offsets[0])[full]
        place = np.arange(len(raw)) - np.repeat(first, lengths[full])
        out[full] = np.add.reduceat((raw + np.uint64(1)) * WEIGHTS[place % len(WEIGHTS)], first)
        out[full] = (out[full] ^ lengths[full].astype(np.uint64)) * MIX
        out[full] ^= out[full] >> np.uint64(31)
    return out


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash per word of the texts, and where each text's words end."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    coded = split.flatten().dictionary_encode()
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(coded):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    hashes = string_hashes(pc.replace_substring_regex(pc.utf8_lower(coded.dictionary), NEITHER, ""))[coded.indices.to_numpy(zero_copy_only=False)]
    real = hashes != 0
    of = np.repeat(np.arange(len(texts)), counts)[real]
    return hashes[real], np.cumsum(np.bincount(of, minlength=len(texts)))


def shingles(h: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Hashes of the word n-grams of one text."""
    if not 0 < n <= len(h):
        return h[:0]
    x = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        x = (x * PRIME + h[j : j + len(x)]) * MIX
        x ^= x >> np.uint64(29)
    return distinct(x)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted; np.unique hashes integers, which takes several times as long here."""
    x = np.sort(x)
    return x[np.flatnonzero(np.append(True, x[1:] != x[:-1]))] if len(x) else x


def spelled(h: np.ndarray) -> tuple[int, np.ndarray]:
    n = min(SHINGLE, len(h))
    return n, shingles(h, n)


def parts(text: str) -> tuple[str, str]:
    """The question and the answer of an item."""
    whole = text.rstrip()
    at = max(whole.rstrip(SENTENCE_ENDS).rfind(c) for c in SENTENCE_ENDS)
    if at >= 0 and any(c.isalnum() for c in whole[: at + 1]):
        return whole[: at + 1], whole[at + 1 :]
    words = whole.split()
    cut = max(1, len(words) - max(1, len(words) // 3)) if len(words) > 1 else len(words)
    return " ".join(words[:cut]), " ".join(words[cut:])


def pieces(h: np.ndarray) -> list[np.ndarray]:
    """The parts of an item's words that are indexed."""
    if not len(h):
        return []
    cuts = list(range(0, len(h), PART))
    if len(cuts) > 1 and len(h) - cuts[-1] < TAIL:
        cuts.pop()
    return [h[a:b] for a, b in zip(cuts, [*cuts[1:], len(h)], strict=True)]


@dataclass
class Statistics:
    """Of all items: parts, their mean length, and in how many parts each term is (terms in order)."""

    n: int
    mean: float
    terms: np.ndarray
    df: np.ndarray


def counted(items: list[tuple[int, str]]) -> Statistics:
    parts_ = [p for _, text in items for p in pieces(word_hashes(pa.array([text]))[0])]
    terms, df = np.unique(np.concatenate([distinct(p) for p in parts_]), return_counts=True) if parts_ else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return Statistics(len(parts_), float(np.mean([len(p) for p in parts_])) if parts_ else 0.0, terms, df)


@dataclass
class Index:
    """Of one shard: terms in order, their bounds, the blocks that hold each term, and postings by term and block."""

    items: np.ndarray  # item id of each indexed part
    terms: np.ndarray
    most: np.ndarray  # by term
    entries: np.ndarray  # by term: where its blocks begin; one more than terms
    blocks: np.ndarray  # by entry
    block_most: np.ndarray  # by entry
    starts: np.ndarray  # by entry: where its postings begin; one more than entries
    slots: np.ndarray  # of postings: the part inside its block
    impacts: np.ndarray
    questions: list[tuple[int, np.ndarray]]  # words a shingle (fewer than SHINGLE if the text has fewer), shingles
    answers: list[tuple[int, np.ndarray]]
    around: list[tuple[int, int]]  # words of the item before the part and after it


def build(items: list[tuple[int, str]], known: Statistics | None = None) -> Index | None:
    """Index of items, with the statistics of all items (theirs if none are given); None if none has words."""
    known = known or counted(items)
    ids, words, questions, answers, around = [], [], [], [], []
    for item, text in items:
        h, _ = word_hashes(pa.array([text]))
        if not len(h):
            continue
        q, a = (spelled(word_hashes(pa.array([x]))[0]) for x in parts(text))
        low = 0
        for piece in pieces(h):
            ids.append(item)
            words.append(piece)
            questions.append(q)
            answers.append(a)
            around.append((low, len(h) - low - len(piece)))
            low += len(piece)
    if not ids:
        return None
    # Like lengths share a block: a common word weighs most in short items, whose blocks are then few.
    order = sorted(range(len(ids)), key=lambda k: len(words[k]))
    ids, words, questions, answers, around = ([x[k] for k in order] for x in (ids, words, questions, answers, around))
    n = len(ids)
    lengths = np.asarray([len(w) for w in words])
    part = np.repeat(np.arange(n), lengths)
    terms, code = np.unique(np.concatenate(words), return_inverse=True)
    cell, tf = np.unique(part * len(terms) + code, return_counts=True)
    part, code = cell // len(terms), cell % len(terms)
    df = known.df[np.searchsorted(known.terms, terms)]
    idf = np.log1p((known.n - df + 0.5) / (df + 0.5))
    weight = idf[code] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[part] / known.mean))
    impact = weight / np.bincount(part, weight, n)[part]
    blocks = -(-n // BLOCK)
    order = np.lexsort((part, code))
    part, code, impact = part[order], code[order], impact[order]
    at = code * blocks + part // BLOCK
    entry = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    block_most = np.maximum.reduceat(impact, entry)
    entries = np.searchsorted(at[entry] // blocks, np.arange(len(terms) + 1))
    most = np.maximum.reduceat(block_most, entries[:-1])
    return Index(np.asarray(ids, np.int64), terms, most, entries, at[entry] % blocks, block_most, np.append(entry, len(at)), part % BLOCK, impact, questions, answers, around)


def spread(begins: np.ndarray, many: np.ndarray) -> np.ndarray:
    """begins[0], begins[0] + 1, ... many[0] of them, then those from begins[1] on."""
    ends = np.cumsum(many)
    return np.repeat(begins - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)


#: Cells (a passage and a block) whose bounds are summed at once.
CELLS = 1 << 22


def retrieve(index: Index, of: np.ndarray, code: np.ndarray, n: int, bar: float = BAR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, part, score) of all pairs that reach the bar. of, code: each passage's distinct terms, by passage."""
    empty = np.zeros(0, np.int64)
    slack = bar - 1e-9
    alive = np.bincount(of, index.most[code], n) >= slack
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    live = alive[of]
    of, code = of[live], code[live]
    if not len(of):
        return empty, empty, np.zeros(0)
    rows = distinct(of)
    of = np.searchsorted(rows, of)
    blocks = int(index.blocks.max()) + 1
    step = max(1, CELLS // blocks)
    for low in range(0, len(rows), step):
        a, b = np.searchsorted(of, (low, low + step))
        o, c = of[a:b] - low, code[a:b]
        many = index.entries[c + 1] - index.entries[c]
        entry = spread(index.entries[c], many)
        cell = np.repeat(o, many) * blocks + index.blocks[entry]
        bound = np.bincount(cell, index.block_most[entry], min(step, len(rows) - low) * blocks)
        live = bound[cell] >= slack
        cell, entry = cell[live], entry[live]
        if not len(cell):
            continue
        cells, cell = np.unique(cell, return_inverse=True)
        many = index.starts[entry + 1] - index.starts[entry]
        posting = spread(index.starts[entry], many)
        score = np.bincount(np.repeat(cell, many) * BLOCK + index.slots[posting], index.impacts[posting], len(cells) * BLOCK)
        hit = np.flatnonzero(score >= slack)
        at = cells[hit // BLOCK]
        found.append((rows[low + at // blocks], at % blocks * BLOCK + hit % BLOCK, score[hit]))
    if not found:
        return empty, empty, np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def matches(index: Index, texts: pa.Array, bar: float = BAR, overlap: float = OVERLAP) -> Iterator[tuple[int, int, float, float, float, int]]:
    """(row, item, score, question's and answer's share, first word of the passage) of verified pairs, the best passage of each."""
    h, ends = word_hashes(texts)
    begins = np.concatenate([[0], ends[:-1]])
    at = np.searchsorted(index.terms, h)
    known = index.terms[np.minimum(at, len(index.terms) - 1)] == h
    halves = np.maximum(1, -(-(ends - begins) // HALF))
    base = np.cumsum(halves) - halves
    row = np.repeat(np.arange(len(ends)), ends - begins)[known]
    half = base[row] + (np.flatnonzero(known) - begins[row]) // HALF
    n, terms = int(halves.sum()), len(index.terms)
    # Bound 1 on half-windows first: a passage's terms are those of its halves.
    cell = distinct(half * terms + at[known])
    half, code = cell // terms, cell % terms
    bound = np.bincount(half, index.most[code], n)
    last = np.zeros(n, bool)
    last[base + halves - 1] = True
    after = np.where(last, 0.0, np.append(bound[1:], 0.0))
    open_ = bound + after >= bar - 1e-9
    first, second = open_[half], np.append(False, open_[:-1] & ~last[:-1])[half]
    cell = distinct(np.concatenate([half[first] * terms + code[first], (half[second] - 1) * terms + code[second]]))
    passage, item, score = retrieve(index, cell // terms, cell % terms, n, bar)
    best: dict[tuple[int, int], tuple[float, float, float, int]] = {}
    of = np.searchsorted(base, passage, "right") - 1
    cache: dict[tuple[int, int, int], np.ndarray] = {}

    def share(r: int, k: int, around: tuple[int, int], n: int, part: np.ndarray) -> float:
        """Of the part's shingles, those in the passage, the half-windows around it and the words of the item's rest; 1 of none."""
        if not len(part):
            return 1.0
        slack = sum(around) // 4
        low = max(int(begins[r]), int(begins[r]) + (k - 1) * HALF - (around[0] + slack if around[0] else 0))
        high = min(int(ends[r]), int(begins[r]) + (k + 3) * HALF + (around[1] + slack if around[1] else 0))
        if (low, high, n) not in cache:
            cache[low, high, n] = shingles(h[low:high], n)
        return float(np.isin(part, cache[low, high, n]).mean())

    for p, r, i, s in zip(passage.tolist(), of.tolist(), item.tolist(), score.tolist(), strict=True):
        k = p - int(base[r])
        q, a = share(r, k, index.around[i], *index.questions[i]), share(r, k, index.around[i], *index.answers[i])
        if q < overlap or a < overlap:
            continue
        key = (r, int(index.items[i]))
        best[key] = max(best.get(key, (0.0, 0.0, 0.0, 0)), (s, q, a, k * HALF))
    for (r, i), (s, q, a, k) in best.items():
        yield r, i, s, q, a, k


def terms_of(items: DataFrame) -> DataFrame:
    """term, n (parts that have it); the parts and words of a task are told with its first term."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = counted([(0, x) for x in batch.column("text").to_pylist()])
            if found.n:
                first = np.arange(len(found.terms)) == 0
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (found.terms.view(np.int64), found.df, np.where(first, found.n, 0), np.where(first, round(found.n * found.mean), 0))], ["term", "n", "parts", "words"])

    return items.select("text").mapInArrow(rows, "term long, n long, parts long, words long")


PAIRS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    bar: float = BAR,
    overlap: float = OVERLAP,
    shard: int = SHARD,
) -> DataFrame:
    """Verified pairs (doc_id, item_id) with their score, overlaps and the passage's first word."""
    spark = docs.sparkSession
    chosen = picked(docs, doc_id=id_col, text=text_col).filter("doc_id is not null")
    tests = picked(items, item_id=item_col, text=item_text_col).filter("item_id is not null and text is not null").distinct()
    tests = staged(tests, "items")
    many, chars = tests.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    shards = max(-(-many // shard), -(-chars // SHARD_CHARS))
    terms = staged(terms_of(tests).groupBy("term").agg(F.sum("n").alias("df"), F.sum("parts").alias("parts"), F.sum("words").alias("words")), "terms")
    n, words = terms.agg(F.sum("parts"), F.sum("words")).first()
    found = None
    for k in range(shards):
        # About `shard` items at a time: their number and length are bounded, whatever the benchmark's size.
        some = tests.filter(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == k)
        mine = some.orderBy("item_id", "text").collect()
        told = terms.join(terms_of(some).select("term").distinct(), "term").select("term", "df").toArrow()
        term, df = told.column("term").to_numpy().view(np.uint64), told.column("df").to_numpy()
        order = np.argsort(term)
        index = build([(r["item_id"], r["text"]) for r in mine], Statistics(n, words / n, term[order], df[order])) if len(term) else None
        if index is None:
            continue
        held = spark.sparkContext.broadcast(index)

        def rows(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                ids = batch.column("doc_id").cast(pa.int64())
                out = list(matches(held.value, batch.column("text"), bar, overlap))
                if out:
                    of, item, *more = zip(*out, strict=True)
                    kinds = (pa.float64(), pa.float64(), pa.float64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), pa.array(item, pa.int64()), *[pa.array(x, t) for x, t in zip(more, kinds, strict=True)]], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])

        pairs = chosen.mapInArrow(rows, PAIRS)
        found = pairs if found is None else found.unionByName(pairs)
    if found is None:
        return spark.createDataFrame([], PAIRS)
    best = F.max(F.struct("score", "question_overlap", "answer_overlap", "first_word")).alias("m")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.*")


def op2_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
