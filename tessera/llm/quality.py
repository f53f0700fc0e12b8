"""Quality filter by importance resampling over hashed n-grams.

Two generative models, bags of hashed word unigrams and bigrams: of raw text,
counted over every document, and of target text, counted over labelled rows of
good quality that are not toxic. A document's log importance weight is its mean
log ratio of the two models times a nominal length, so that its own length
decides nothing; few n-grams are drawn towards the usual ratio of target text.
Divided by a temperature, it is the weight of the draw:
Gumbel noise, drawn from the document's id and the seed, is added, and the k
documents with the largest sums are the sample: draws without replacement in
proportion to tempered importance. Unless given, the temperature puts MARGIN units
of noise between the bar and the LOW quantile of good held-out rows, so that chance decides among documents
near the bar and leaves those alone that are as good as nearly all good rows. `effective_size` says how
many equally weighted documents the draw amounts to.

k is the number of documents whose weight reaches a bar. The bar comes from
labelled rows held out of the target model: it is the value at which the share
of bad rows let through plus COST times the share of good rows lost is least.

Toxic text is rejected by a second model, whatever its quality: in how many labelled
toxic rows each n-gram occurs, against the labelled rows that are not toxic; equal texts
count once. A few insults move the mean of a long text too little, so a document's toxicity is the largest
sum of log ratios over all windows of WINDOW words of its whole text. Ratios under a
floor count nothing, so that many weak signs do not add up in clean text. The floor (of FLOORS) and the
bar come from held-out rows in the same way (toxic ones against good ones), and documents
at that bar or above take no part in the draw.

Only labelled rows are sampled, by hash, FIT_ROWS of them at most. Raw counts,
weights and the cut cover every document; the cut is found from histograms of
sums, so no list of documents reaches the driver.

A null or empty text has no n-grams and the usual weight of target text.
Repeated rows of an id have one noise and share its fate unless their texts
differ; rows of a null id share one noise. Without labels of both kinds nothing is rejected;
without toxic ones nothing is toxic. An empty table gives no rows; other columns keep their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import picked, slices, staged, table

BUCKETS = 1 << 16
#: Buckets of the toxic model are so many times as many: a single n-gram decides there, and one that shares its bucket must be rare.
FINER = 16
WINDOW = 32
FIT_ROWS = 20_000
SMOOTHING = 1.0
NOMINAL = 512
PRIOR_GRAMS = 16
COST = 4.0
SEED = 20240601
BINS = 4096
MARGIN, LOW = 8.0, 0.01
FLOORS = (0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 5.0)
PRIME, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Runs of signs are words of their own.
SIGNS = r"([^\pL\pN\s]+)"


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' words as hashes, which text each belongs to, and the hash of each word and the next."""
    spaced = pc.replace_substring_regex(pc.fill_null(texts, "").cast(pa.large_string()), SIGNS, r" \1 ")
    split = pc.ascii_split_whitespace(spaced)
    coded = split.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.repeat(np.arange(len(texts)), counts)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    real = np.fromiter(map(bool, distinct), bool, len(distinct))[codes] if distinct else np.zeros(0, bool)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    h, of = (hashes[codes[real]], of[real]) if distinct else (np.zeros(0, np.uint64), of[:0])
    pairs = (h[:-1] * PRIME + h[1:]) * MIX if len(h) else h
    return h, of, pairs >> np.uint64(20)


def buckets(texts: pa.Array, size: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The hashed unigrams and bigrams of the texts, and which text each belongs to."""
    h, of, pairs = hashed(texts)
    inside = of[:-1] == of[1:]
    both = np.concatenate([h, pairs[inside]])
    return (both % np.uint64(size)).astype(np.int64), np.concatenate([of, of[:-1][inside]])


def counted(docs: DataFrame, size: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all the texts; `size` numbers, whatever the input."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in slices(batches, "text"):
            total += np.bincount(buckets(batch.column("text"), size)[0], minlength=size)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there])], ["bucket", "n"])

    found = docs.select("text").mapInArrow(rows, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size, np.int64)
    for r in found:
        out[r["bucket"]] = r["n"]
    return out


def counted_rows(fit: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """In how many toxic rows of fit (text, toxic) each bucket occurs, and in how many others."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * size, np.int64)
        for batch in slices(batches, "text"):
            at, of = buckets(batch.column("text"), size)
            of, at = np.divmod(np.unique(of * size + at), size)
            total += np.bincount(at + size * batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)[of], minlength=2 * size)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there])], ["bucket", "n"])

    found = fit.select("text", "toxic").mapInArrow(rows, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * size, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out[size:], out[:size]


def toxic_ratios(toxic: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The log ratio by bucket at two standard errors below its count in toxic rows; 0 where that is no sign of toxic text."""
    sure = np.maximum(toxic - 2 * np.sqrt(toxic), 0)
    return np.maximum(np.log(sure + SMOOTHING) - np.log(others * (toxic.sum() / others.sum()) + SMOOTHING), 0).astype(np.float32)


def worst(texts: pa.Array, ratios: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Each text's largest sum of log ratios over the windows of that many words; 0 without words."""
    h, of, pairs = hashed(texts)
    out = np.zeros(len(texts))
    if not len(h):
        return out
    size = np.uint64(len(ratios))
    value = ratios[(h % size).astype(np.int64)].astype(float)
    value[1:] += np.where(of[1:] == of[:-1], ratios[(pairs % size).astype(np.int64)], 0.0)
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    begins = np.repeat(first, np.diff(np.append(first, len(h))))
    total = np.append(0.0, np.cumsum(value))
    place = np.arange(len(h))
    out[of[first]] = np.maximum.reduceat(total[1:] - total[np.maximum(begins, place + 1 - window)], first)
    return out


def toxicities(held: DataFrame, ratios: np.ndarray, floors: tuple[float, ...] = FLOORS) -> tuple[np.ndarray, np.ndarray]:
    """Whether each of the held-out rows (text, good, toxic) is toxic, and its toxicity at each floor (a row each)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = [np.where(ratios >= floor, ratios, np.float32(0)) for floor in floors]
        for batch in slices(batches, "text"):
            found = np.stack([worst(batch.column("text"), x) for x in each], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, len(floors)), pa.int32()), pa.array(found.ravel()))], ["toxic", "at"])

    got = held.select("text", "toxic").mapInArrow(rows, "toxic boolean, at array<double>").collect()
    return np.asarray([r["toxic"] for r in got], bool), np.asarray([r["at"] for r in got], float).reshape(-1, len(floors))


def log_ratios(target: np.ndarray, raw: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """log p_target / p_raw by bucket; both are smoothed at the size of the smaller model."""
    size = min(target.sum(), raw.sum())
    scaled = [x * (size / max(1, x.sum())) + smoothing for x in (target, raw)]
    return np.log(scaled[0]) - np.log(scaled[1])


def sums(texts: pa.Array, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's total log ratio and number of n-grams."""
    at, of = buckets(texts, len(ratios))
    return np.bincount(of, ratios[at], len(texts)), np.bincount(of, minlength=len(texts))


def weighted(docs: DataFrame, ratios: np.ndarray, toxic: np.ndarray | None, usual: float, nominal: int, kept: list[str]) -> DataFrame:
    """The kept columns of docs, n_grams, log_weight and toxicity (0 without toxic ratios) of their text."""
    schema = ", ".join(f"`{n}` {dict(docs.dtypes)[n]}" for n in kept)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            total, n = sums(batch.column("text"), ratios)
            weight = nominal * (total + PRIOR_GRAMS * usual) / (n + PRIOR_GRAMS)
            bad = np.zeros(len(n)) if toxic is None else worst(batch.column("text"), toxic)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(n, pa.int64()), pa.array(weight), pa.array(bad)], [*kept, "n_grams", "log_weight", "toxicity"])

    return docs.select(*dict.fromkeys([*kept, "text"])).mapInArrow(rows, f"{schema}, n_grams long, log_weight double, toxicity double")


def best_bar(good: np.ndarray, bad: np.ndarray, cost: float = COST) -> float:
    """Between the values where the cost steps, the middle of the best gap; minus infinity without both kinds."""
    return best_step(good, bad, cost)[0]


def best_step(good: np.ndarray, bad: np.ndarray, cost: float = COST) -> tuple[float, float]:
    """The bar and its cost."""
    if not len(good) or not len(bad):
        return -np.inf, np.inf
    at = np.unique(np.concatenate([good, bad]))
    lost = np.searchsorted(np.sort(good), at) / len(good)
    let = 1 - np.searchsorted(np.sort(bad), at) / len(bad)
    costs = cost * lost + let
    i = int(np.argmin(costs))
    return (float((at[i] + at[i - 1]) / 2) if i else -np.inf), float(costs[i])


def gumbel(doc_id: Column, seed: int) -> Column:
    """Standard Gumbel noise from 52 bits of the id's hash."""
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 12).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(unit))


def cut_of(keys: DataFrame, k: int) -> float:
    """The largest value that at least k rows reach. Histograms narrow it down: BINS counts a turn."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("*")).first()
    if not n or k >= n:
        return -np.inf
    if k <= 0:
        return np.inf
    above = 0
    while True:
        width = (high - low) / BINS
        if not low + width > low or not low < high:
            return float(low)
        inside = keys.filter(F.col("key").between(low, high))
        step = F.least(F.floor((F.col("key") - low) / width), F.lit(BINS - 1)).alias("step")
        found = {r["step"]: r for r in inside.groupBy(step).agg(F.count("*").alias("n"), F.min("key").alias("least"), F.max("key").alias("most")).collect()}
        for s in sorted(found, reverse=True):
            if above + found[s]["n"] >= k:
                break
            above += found[s]["n"]
        if found[s]["least"] == found[s]["most"]:
            return float(found[s]["least"])
        low, high = found[s]["least"], found[s]["most"]


@dataclass
class Sampler:
    """What is needed to weigh a document and to tell whether it is in the sample."""

    ratios: np.ndarray
    toxic: np.ndarray | None
    usual: float
    nominal: int
    seed: int
    temperature: float = 1.0
    toxic_bar: float = np.inf
    cut: float = -np.inf

    def keyed(self, docs: DataFrame, kept: list[str]) -> DataFrame:
        """The kept columns of docs (doc_id, text, more) with n_grams, log_weight, toxicity and key."""
        return weighted(docs, self.ratios, self.toxic, self.usual, self.nominal, kept).withColumn("key", F.col("log_weight") / F.lit(self.temperature) + gumbel(F.col("doc_id"), self.seed))

    def sample(self, keyed: DataFrame) -> DataFrame:
        return keyed.filter((F.col("key") >= F.lit(self.cut)) & (F.col("toxicity") < F.lit(self.toxic_bar)))


def fitted(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id_col: str = "doc_id",
    quality_col: str = "quality",
    toxic_col: str = "toxic",
    k: int | None = None,
    size: int = BUCKETS,
    nominal: int = NOMINAL,
    fit_rows: int = FIT_ROWS,
    seed: int = SEED,
    temperature: float | None = None,
) -> tuple[Sampler, DataFrame]:
    """The sampler for docs, and each row's doc_id, n_grams, log_weight, toxicity and key."""
    chosen = picked(docs, doc_id=id_col, text=text_col)
    told = picked(labels, doc_id=label_id_col, quality=quality_col, toxic=toxic_col).filter("doc_id is not null and (quality is not null or toxic is not null)")
    told = told.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    draw = F.xxhash64(F.lit(seed), "doc_id")
    some = told.withColumn("draw", draw).orderBy("draw", "doc_id").limit(fit_rows)
    kinds = [F.coalesce(x, F.lit(False)).alias(n) for n, x in (("good", F.expr("quality = 1 and toxic = 0")), ("bad", F.expr("quality = 0")), ("toxic", F.expr("toxic <> 0")))]
    some = some.select("doc_id", *kinds, (F.pmod("draw", F.lit(4)) == 0).alias("held"))
    # At most fit_rows ids of 24 bytes.
    fit = staged(chosen.join(F.broadcast(some), "doc_id"), "labelled")
    ratios = log_ratios(counted(fit.filter("good and not held"), size), counted(chosen, size))
    in_toxic, in_others = counted_rows(fit.filter("not held").dropDuplicates(["text", "toxic"]), size * FINER)
    toxic, toxic_bar = toxic_ratios(in_toxic, in_others) if in_toxic.any() and in_others.any() else None, np.inf
    if toxic is not None:
        is_toxic, at = toxicities(fit.filter("held and (good or toxic)"), toxic)
        # Toxic text lies above its bar: signs turned, as best_step keeps what is large. Of like floors the smallest.
        steps = [best_step(-at[~is_toxic, f], -at[is_toxic, f]) for f in range(len(FLOORS))]
        floor = int(np.argmin([cost for _, cost in steps]))
        toxic, toxic_bar = np.where(toxic >= FLOORS[floor], toxic, np.float32(0)), -steps[floor][0]
    held = weighted(fit.filter("bad or held"), ratios, None, 0.0, nominal, ["doc_id", "good", "bad", "held"]).groupBy("doc_id", "good", "bad", "held")
    held = held.agg(F.max("log_weight").alias("w"), F.max("n_grams").alias("n")).collect()
    mean = np.asarray([r["w"] / nominal for r in held])
    good, bad, out = (np.asarray([r[x] for r in held], bool) for x in ("good", "bad", "held"))
    good, n = good & out, np.asarray([r["n"] for r in held])
    usual = float(np.median(mean[good])) if good.any() else 0.0
    weights = nominal * (mean + usual * PRIOR_GRAMS / (n + PRIOR_GRAMS))
    bar = best_bar(weights[good], weights[bad])
    if temperature is None:
        gap = float(np.quantile(weights[good], LOW)) - bar if good.any() and np.isfinite(bar) else 0.0
        temperature = max(1.0, gap / MARGIN)
    sampler = Sampler(ratios, toxic, usual, nominal, seed, temperature, toxic_bar)
    scored = staged(sampler.keyed(chosen, ["doc_id"]), "weights")
    drawn = sampler.sample(scored)
    sampler.cut = cut_of(drawn, drawn.filter(F.col("log_weight") >= F.lit(bar)).count() if k is None else k)
    return sampler, scored


def resample(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The sample: doc_id, n_grams, log_weight, key; k rows (all that are not toxic, if these are fewer), or those that the bar gives. Options: those of fitted()."""
    sampler, scored = fitted(docs, labels, **options)
    return sampler.sample(scored).drop("toxicity")


def effective_size(scored: DataFrame, temperature: float) -> float:
    """(sum of w)^2 / (sum of w^2) for the tempered weights w of scored rows: 1 where one document has all the weight."""
    x = F.col("log_weight") / F.lit(temperature)
    most = scored.agg(F.max(x)).first()[0]
    if most is None:
        return 0.0
    w = F.exp(x - F.lit(most))
    one, two = scored.agg(F.sum(w), F.sum(w * w)).first()
    return float(one * one / two)


def sampled_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The sample as rows of docs, whose text and doc_id have these names and whose other columns may have any. Weighs each text again, which is cheaper than a join."""
    sampler, _ = fitted(docs, labels)
    more = {f"more_{i}": c for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    chosen = picked(docs, doc_id="doc_id", text="text", **more)
    names = {c: k for k, c in more.items()} | {"doc_id": "doc_id", "text": "text"}
    return sampler.sample(sampler.keyed(chosen, chosen.columns)).select(*[F.col(names[c]).alias(c) for c in docs.columns])


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampled documents; those that are missing are rejected."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
