"""Languages of texts by interpolated Kneser-Ney models of characters.

A text is read as letters in lower case, everything else as single spaces. For each
language that labelled rows name, all runs of four symbols are counted over all rows that
may be learned from; lower orders count in how many contexts a run was seen. Discounts come
from the counts of counts. A symbol's probability is the discounted share of its run plus
the context's left-over weight times the probability one order down, to an even share
of all symbols at the end.

The model is kept as sorted arrays of hashes with a column for each language. It is broadcast,
so its size is bounded: hashes have as many bits as let all of them times the languages fit into CELLS,
at every size of the input, and runs that share one share the greater value.

The language with the lowest cross-entropy a symbol wins. One labelled row in HELD_BACK is
not counted and calibrates: the score is the winner's share of exp(-entropy * symbols^a / t), with the a
and t under which those rows are likeliest; a text is `rejected` where its cross-entropy, over
the language's mean, is beyond what all but MISSED of such rows of its length class have.

A text that is null or without a letter is `und` with score 0, not rejected. So is every
text where nothing could be learned. Rows with a null id or a null lang are not learned from;
rows with null ids are not held out. Repeated rows count as often as they occur. Of equal
entropies the first language by name wins. Without rows to calibrate, a = 0.5, t = 0.1 and
nothing is rejected. Texts of any length are read in blocks. Other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import picked, slices, staged, table, texts_of

ORDER = 4
SPACE, START = 32, 1
#: Symbols are 16 bits; letters beyond take one of the 6,400 private ones, which are no letters themselves.
PRIVATE, PRIVATES = 0xE000, 6400
#: Characters handled at once.
BLOCK = 1_000_000
#: Runs and counts that a task holds before it passes them on.
HELD_RUNS = 2_000_000
#: The largest array of the model has at most this many numbers.
CELLS = 1 << 23
HELD_BACK = 16
MISSED = 0.005
UNKNOWN = "und"
POWERS = (0.0, 0.25, 0.5, 0.75, 1.0)
TEMPERATURES = tuple(0.01 * 2**k for k in range(12))
#: Length classes: powers of two of symbols.
CLASSES = 24


@functools.cache
def symbols() -> tuple[np.ndarray, np.ndarray]:
    """A symbol for each code point, and whether a symbol is a letter."""
    of, letter = np.full(0x110000, SPACE, np.uint16), np.zeros(1 << 16, bool)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind in "LM":
            low = ord(chr(point).lower()[0])
            of[point] = symbol = low if low < 1 << 16 else PRIVATE + low % PRIVATES
            letter[symbol] |= kind == "L"
    return of, letter


def runs_of(text: str) -> Iterator[np.ndarray]:
    """For each symbol of the text the run of ORDER symbols that ends there, block by block."""
    of, tail = symbols()[0], np.full(ORDER - 1, START, np.uint16)
    for at in range(0, len(text), BLOCK):
        points = np.frombuffer(text[at : at + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32)
        told = np.concatenate([tail, of[points]])
        keep = np.ones(len(told), bool)
        keep[ORDER - 1 :] = (told[ORDER - 1 :] != SPACE) | (told[ORDER - 2 : -1] != SPACE)
        told = told[keep].astype(np.uint64)
        tail = told[-(ORDER - 1) :].astype(np.uint16)
        yield told[:-3] << np.uint64(48) | told[1:-2] << np.uint64(32) | told[2:-1] << np.uint64(16) | told[3:]


def blocks(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of many texts, about BLOCK at a time, and the text of each."""
    held: list[np.ndarray] = []
    owners: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        for runs in runs_of(text):
            held.append(runs)
            owners.append(i)
            size += len(runs)
            if size >= BLOCK:
                yield np.concatenate(held), np.repeat(owners, [len(x) for x in held])
                held, owners, size = [], [], 0
    if size:
        yield np.concatenate(held), np.repeat(owners, [len(x) for x in held])


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    runs, place = np.unique(np.concatenate([r for r, _ in parts]), return_inverse=True)
    return runs, np.bincount(place, np.concatenate([n for _, n in parts])).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, run, n: summed within the task, passed on where they become many."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def passed() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            runs, n = _summed(parts)
            for at in range(0, len(runs), 200_000):
                some = slice(at, at + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(runs[some]), pa.string()), pa.array(runs[some].view(np.int64)), pa.array(n[some])], ["lang", "run", "n"])

    for batch in slices(batches, "text"):
        names = batch.column("lang").to_pylist()
        known = sorted(set(names))
        code = np.asarray([known.index(x) for x in names])
        for runs, owner in blocks(texts_of(batch, "text")):
            of = code[owner]
            for i in np.unique(of).tolist():
                parts = held.setdefault(known[i], [])
                parts.append(np.unique(runs[of == i], return_counts=True))
                if len(parts) > 8:
                    parts[:] = [_summed(parts)]
        size = sum(len(r) for parts in held.values() for r, _ in parts)
        if size > HELD_RUNS:
            yield from passed()
            held.clear()
    yield from passed()


def counted(rows: DataFrame) -> DataFrame:
    """lang, run, n over all rows of text and lang."""
    return rows.mapInArrow(_count, "lang string, run long, n long").groupBy("lang", "run").agg(F.sum("n").alias("n"))


def level_rows(counts: DataFrame, order: int) -> DataFrame:
    """order, kind, hash, lang, value: discounted shares of runs ('p') and left-over weights of their contexts ('b')."""
    once = counts.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"))
    discount = F.when(F.col("n1") > 0, F.greatest(F.lit(0.1), F.least(F.lit(0.9), F.col("n1") / (F.col("n1") + 2 * F.col("n2"))))).otherwise(0.5)
    of = counts.withColumn("context", F.shiftrightunsigned("run", 16)).join(F.broadcast(once.select("lang", discount.alias("d"))), "lang")
    contexts = of.groupBy("lang", "context").agg(F.sum("n").alias("total"), (F.first("d") * F.count("*") / F.sum("n")).alias("value"))
    shares = of.join(contexts.select("lang", "context", "total"), ["lang", "context"]).select("lang", F.col("run").alias("key"), ((F.col("n") - F.col("d")) / F.col("total")).alias("value"), F.lit("p").alias("kind"))
    return shares.unionByName(contexts.select("lang", F.col("context").alias("key"), "value", F.lit("b").alias("kind"))).withColumn("order", F.lit(order))


#: The constants of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def hashed(keys: np.ndarray) -> np.ndarray:
    """xxhash64 of longs as Spark has it; one to one."""

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return x << np.uint64(by) | x >> np.uint64(64 - by)

    seed = np.uint64((42 + int(P5) + 8) % (1 << 64))
    found = turned(seed ^ turned(keys * P2, 31) * P1, 27) * P1 + P4
    found = (found ^ found >> np.uint64(33)) * P2
    found = (found ^ found >> np.uint64(29)) * P3
    return found ^ found >> np.uint64(32)


@dataclass
class Model:
    """Sorted hashes and values by order and kind."""

    langs: list[str]
    #: Bits of a hash by CELLS, and by how many a smaller bound asks for less.
    bits: int = 64
    shift: int = 0
    even: float = 1e-5
    arrays: dict[tuple[int, str], tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    power: float = 0.5
    temperature: float = 0.1
    means: list[float] = field(default_factory=list)
    bars: list[float] = field(default_factory=list)

    def _values(self, order: int, kind: str, keys: np.ndarray) -> np.ndarray:
        hashes, values = self.arrays[order, kind]
        wanted = hashed(keys) >> np.uint64(64 - self.bits + self.shift)
        place = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
        return np.where((hashes[place] == wanted)[:, None], values[place], np.float32(kind == "b"))

    def entropies(self, runs: np.ndarray) -> np.ndarray:
        """Nats of the last symbol of each run, a column for each language."""
        p = np.full((len(runs), len(self.langs)), self.even)
        for order in range(1, ORDER + 1):
            mine = runs & np.uint64((1 << 16 * order) - 1)
            p = self._values(order, "p", mine) + self._values(order, "b", mine >> np.uint64(16)) * p
        return -np.log(p)

    def weighed(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By text: cross-entropies a symbol, symbols, letters."""
        total, n, letters = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        letter = symbols()[1]
        for runs, owner in blocks(texts):
            coded = pa.array(runs).dictionary_encode()
            each, place = self.entropies(coded.dictionary.to_numpy()), coded.indices.to_numpy()
            for i in range(len(self.langs)):
                total[:, i] += np.bincount(owner, each[place, i], len(texts))
            n += np.bincount(owner, minlength=len(texts))
            letters += np.bincount(owner, letter[runs & np.uint64(0xFFFF)], len(texts)).astype(np.int64)
        return total / np.maximum(n, 1)[:, None], n, letters

    def told(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """By text: language, score, rejected, cross-entropy."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool), np.zeros(len(texts))
        entropy, n, letters = self.weighed(texts)
        best = np.argmin(entropy, 1)
        least = entropy[np.arange(len(texts)), best]
        shares = np.exp(-(entropy - least[:, None]) * (n[:, None] ** self.power / self.temperature))
        score = 1 / shares.sum(1)
        rejected = np.zeros(len(texts), bool)
        if self.bars:
            rejected = least / np.asarray(self.means)[best] > np.asarray(self.bars)[np.minimum(np.log2(np.maximum(n, 1)).astype(int), CLASSES - 1)]
        none = letters == 0
        return [UNKNOWN if x else self.langs[i] for x, i in zip(none, best, strict=True)], np.where(none, 0.0, score), rejected & ~none, np.where(none, 0.0, least)


def bits_for(cells: int, langs: int) -> int:
    """Bits of hashes that times the languages are at most so many: of the input's size nothing is asked."""
    return max(1, int(math.log2(cells / langs)))


def learned(rows: DataFrame, cells: int = CELLS) -> Model:
    """The model of all rows of text and lang."""
    counts = staged(counted(rows), "runs")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    model = Model(langs)
    if not langs:
        return model
    parts, level = [], counts
    for order in range(ORDER, 0, -1):
        parts.append(level_rows(level, order))
        if order > 1:
            shorter = F.col("run").bitwiseAND((1 << 16 * (order - 1)) - 1)
            level = staged(level.groupBy("lang", shorter.alias("run")).agg(F.count("*").alias("n")), f"runs-{order - 1}")
    model.even = 1 / (1 + level.select("run").distinct().count())
    model.bits = bits_for(CELLS, len(langs))
    model.shift = max(0, model.bits - bits_for(cells, len(langs)))
    every = functools.reduce(DataFrame.unionByName, parts)
    key = F.shiftrightunsigned(F.xxhash64("key"), 64 - model.bits + model.shift)
    found = every.groupBy("order", "kind", key.alias("hash"), "lang").agg(F.max("value").alias("value")).toArrow()
    column = {lang: i for i, lang in enumerate(langs)}
    for order in range(1, ORDER + 1):
        for kind in "pb":
            mine = found.filter(pc.and_(pc.equal(found["order"], order), pc.equal(found["kind"], kind)))
            hashes, place = np.unique(mine["hash"].to_numpy().view(np.uint64), return_inverse=True)
            values = np.full((len(hashes), len(langs)), float(kind == "b"), np.float32)
            values[place, [column[x] for x in mine["lang"].to_pylist()]] = mine["value"].to_numpy()
            model.arrays[order, kind] = hashes, values
    return model


def calibrated(model: Model, rows: DataFrame) -> Model:
    """The model with temperature, power and bars from rows of text and lang that it has not counted."""
    if not model.langs:
        return model
    spark, langs = rows.sparkSession, model.langs
    shared = spark.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            entropy, n, letters = shared.value.weighed(texts_of(batch, "text"))
            keep = np.flatnonzero(letters)
            yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(keep)).cast(pa.string()), pa.array(list(entropy[keep]), pa.list_(pa.float64())), pa.array(n[keep])], ["lang", "entropy", "n"])

    place = F.array_position(F.lit(langs), F.col("lang")).cast("int")
    known = staged(rows.filter(F.col("lang").isin(langs)).mapInArrow(weigh, "lang string, entropy array<double>, n long"), "calibration").withColumn("own", F.element_at("entropy", place)).withColumn("least", F.array_min("entropy"))

    def loss(a: float, t: float) -> Column:
        scale = F.pow("n", F.lit(a)) / t
        return F.sum((F.col("own") - F.col("least")) * scale + F.log(F.aggregate("entropy", F.lit(0.0), lambda s, x: s + F.exp(-(x - F.col("least")) * scale))))

    grid = [(a, t) for a in POWERS for t in TEMPERATURES]
    losses = known.agg(*[loss(a, t).alias(f"l{i}") for i, (a, t) in enumerate(grid)]).first()
    if losses[0] is None:
        return model
    model.power, model.temperature = grid[int(np.argmin(losses))]
    right = known.filter("own = least")
    means = {r["lang"]: r["mean"] for r in right.groupBy("lang").agg(F.avg("least").alias("mean")).collect()}
    if not means:
        return model
    usual = float(np.mean(list(means.values())))
    model.means = [means.get(x, usual) for x in langs]
    ratio = F.col("least") / F.element_at(F.lit(model.means), place)
    size = F.least(F.floor(F.log2("n")).cast("int"), F.lit(CLASSES - 1))
    bar = F.percentile_approx(ratio, 1 - MISSED, 10000).alias("bar")
    found = {r["size"]: (r["rows"], r["bar"]) for r in right.rollup(size.alias("size")).agg(F.count("*").alias("rows"), bar).collect()}
    # A class of too few rows for its tail takes the bar of all rows; where these are too few as well nothing is rejected.
    every = found[None][1] if found[None][0] * MISSED >= 1 else math.inf
    model.bars = [found[k][1] if k in found and found[k][0] * MISSED >= 1 else every for k in range(CLASSES)]
    return model


def identified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected, entropy for each row; text alone decides."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            lang, score, rejected, entropy = shared.value.told(texts_of(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected), pa.array(entropy)], ["doc_id", "lang_pred", "score", "rejected", "entropy"])

    return picked(docs, doc_id=id_col, text=text_col).mapInArrow(tell, "doc_id long, lang_pred string, score double, rejected boolean, entropy double")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def fitted(docs: DataFrame, held: Column, cells: int = CELLS) -> Model:
    """The model of the rows that are not held out, one in HELD_BACK of them kept for calibration."""
    rows = picked(docs, doc_id="doc_id", text="text", lang="lang").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held)
    back = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_BACK)) == 0
    return calibrated(learned(rows.filter(~back).select("text", "lang"), cells), rows.filter(back).select("text", "lang"))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identified(docs, fitted(docs, held_out())).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected", "entropy")
