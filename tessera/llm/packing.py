"""Best-fit packing of tokenized documents into sequences, after dominance reduction.

Documents become pieces of at most `capacity` tokens (only longer documents are
cut). What a sequence can hold depends on lengths alone, so the packing is solved
on the histogram of lengths, which has at most `capacity` entries however many
documents there are:

1. Martello-Toth reduction fixes sets that dominate every alternative: a piece
   that fills a sequence, or that nothing else fits beside; two pieces that fill
   one exactly; and a piece with its largest partner where no two others fit.
   An optimal packing of the reduced instance stays optimal for the whole.
2. Best-fit decreasing packs the rest, whole groups of like sequences at once.

The solution is a bounded list of slots: so many pieces of this length, at this
offset of these sequences. Each piece finds its slot from its rank among the
pieces of its length. Ranks come from counts per task and length, so a length
that a third of all pieces share never meets in one task.

A null or empty text is one piece: the closing token. Repeated rows are packed
as often as they occur. Null ids are kept. An empty table has no pieces. Other
columns are ignored.
"""

from __future__ import annotations

import functools
import os
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import picked, slices, staged, table

CAPACITY = 2048
END = 0
#: Distinct words whose ids a worker remembers, from task to task; beyond it, it starts anew.
REMEMBERED = 300_000
MARK = "\x01"
SIGNS = ".,!?;:*$%&#"


@functools.cache
def parted() -> str:
    """A letter, then punctuation other than the apostrophe, which contractions need.

    Letters that the tokenizer's normal form or lower case ends with a mark are left
    out: the mark and the punctuation are one piece to its splitter.
    """
    letters = (c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c)[0] == "L")
    ends = "".join(c for c in letters if unicodedata.category(unicodedata.normalize("NFC", c).lower()[-1])[0] != "L")
    return rf"([^\PL{ends}])([{SIGNS}]+)"


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Words:
    """Token ids word by word.

    The vocabulary's normalizer and splitter never look past white space, so a
    text's ids are those of its words, one after the other; each distinct word is
    encoded once. Words still to encode go through the tokenizer as one text with
    a mark after each, which costs much less than a call a word. As it lowers case
    and parts letters from punctuation itself, doing so first changes no id and
    leaves fewer distinct words; texts that could spell an added token are left as
    they are.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self._encode(MARK)
        if len(self.mark) != 1:
            raise ValueError("the mark must be one token")
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.starts = self.lengths = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if MARK not in w]
        odd = [w for w in words if MARK in w]
        ids = np.asarray(self._encode(f" {MARK} ".join([*plain, ""])) if plain else [], np.uint32)
        ends = np.flatnonzero(ids == self.mark[0])
        if len(ends) != len(plain):
            odd, plain, ids, ends = words, [], ids[:0], ends[:0]
        lengths = np.diff(ends, prepend=-1) - 1
        each = [np.asarray(self._encode(w), np.uint32) for w in odd]
        more = np.concatenate([lengths, np.asarray([len(x) for x in each], np.int64)]).astype(np.int64)
        flat = np.concatenate([np.delete(ids, ends) if len(ends) else ids[:0], *each])
        at = len(self.flat)
        for w in (*plain, *odd):
            self.index[w] = len(self.index)
        self.starts = np.concatenate([self.starts, at + np.cumsum(more) - more])
        self.lengths = np.concatenate([self.lengths, more])
        self.flat = np.concatenate([self.flat, flat])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, END after each text, and where each text ends."""
        if len(self.index) > REMEMBERED:
            self.forget()
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), parted(), r"\1 \2")
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        if new := [w for w in distinct if w not in self.index]:
            self._learn(new)
        codes = np.asarray([self.index[w] for w in distinct], np.int64)[words.indices.to_numpy(zero_copy_only=False)] if distinct else np.zeros(0, np.int64)
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(counts)
        lengths = np.insert(self.lengths[codes], ends, 1)
        starts = np.insert(self.starts[codes], ends, len(self.flat))
        flat = np.append(self.flat, np.uint32(END))
        before = np.cumsum(lengths) - lengths
        ids = flat[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))]
        return ids.astype("<u4"), np.cumsum(lengths)[ends + np.arange(len(ends))]


@functools.cache
def words_of(path: str) -> Words:
    """One per worker process, so that its memory of words outlasts a task."""
    return Words(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def token_pieces(docs: DataFrame, id_col: str, text_col: str, path: str, capacity: int) -> DataFrame:
    """A row per piece, with its task and its rank among that task's pieces of its length."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, part = words_of(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in slices(batches, "text"):
            ids, ends = words.encode(batch.column("text"))
            rows, low = [], 0
            for i, end in enumerate(ends.tolist()):
                for k, at in enumerate(range(low, end, capacity)):
                    n = min(capacity, end - at)
                    rows.append((i, k, at - low, n, zlib.crc32(ids[at : at + n]), seen[n]))
                    seen[n] += 1
                low = end
            of, *columns = zip(*rows, strict=True)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            made = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            made.insert(4, pa.array(np.full(len(of), part, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()).take(pa.array(of)), *made], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return picked(docs, doc_id=id_col, text=text_col).mapInArrow(pieces, PIECES)


Pattern = tuple[tuple[int, int], ...]


def reduced(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Martello-Toth dominance, whole lengths at a time; takes what it fixes from counts."""
    fixed: list[tuple[Pattern, int]] = []

    def fix(pattern: Pattern, n: int) -> None:
        if n:
            fixed.append((pattern, n))
            for length, k in pattern:
                counts[length] -= k * n

    fix(((capacity, 1),), int(counts[capacity]))
    # Two pieces that fill a sequence: whatever else would go beside one of them fits where the other stands.
    for length in range(capacity - 1, capacity // 2, -1):
        fix(((length, 1), (capacity - length, 1)), int(min(counts[length], counts[capacity - length])))
    if capacity % 2 == 0:
        fix(((capacity // 2, 2),), int(counts[capacity // 2] // 2))
    # The largest free piece, while at most one other fits beside it: that with its largest partner dominates.
    # A turn uses up a length, or leaves one piece of it, so there are at most two for each length.
    while counts.any():
        length = int(np.flatnonzero(counts)[-1])
        room = capacity - length
        rest = counts[: room + 1].copy()
        if length <= room:
            rest[length] -= 1
        partners = np.flatnonzero(rest)
        if not len(partners):
            fix(((length, 1),), int(counts[length]))
            continue
        smallest, best = int(partners[0]), int(partners[-1])
        second = smallest if rest[smallest] > 1 else int(partners[1]) if len(partners) > 1 else capacity + 1
        if smallest + second <= room:
            break
        # What is taken only makes the two smallest others larger, so the step holds for as many as there are.
        if best == length:
            fix(((length, 2),), int(counts[length] // 2))
        else:
            fix(((length, 1), (best, 1)), int(min(counts[length], counts[best])))
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing, as piece by piece, but a group of like sequences takes pieces of a length at once."""
    room: list[list[tuple[Pattern, int]]] = [[] for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        n = int(counts[length])
        while n:
            r = next((r for r in range(length, capacity) if room[r]), capacity)
            pattern, m = room[r].pop() if r < capacity else ((), -(-n // (capacity // length)))
            each = r // length
            whole = min(m, n // each)
            if whole:
                room[r - each * length].append(((*pattern, (length, each)), whole))
                n -= whole * each
            if m > whole:
                if n:
                    room[r - n * length].append(((*pattern, (length, n)), 1))
                    n, whole = 0, whole + 1
                if m > whole:
                    room[r].append((pattern, m - whole))
    return [x for group in room for x in group if x[0]]


def solve(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Different patterns of (length, pieces) with the number of sequences of each.

    At most eight for each possible length, whatever the counts: reduction fixes up to four (two of them in its
    loop), and best-fit splits one group of like sequences in three for each length.
    """
    counts, total = counts.copy(), Counter()
    for pattern, n in reduced(counts, capacity) + best_fit(counts, capacity):
        total[pattern] += n
    return list(total.items())


def slots(patterns: list[tuple[Pattern, int]]) -> dict[int, np.ndarray]:
    """By length: rows of first rank, first sequence, pieces a sequence, offset."""
    used: dict[int, int] = {}
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for pattern, n in patterns:
        offset = 0
        for length, k in pattern:
            found.setdefault(length, []).append((used.get(length, 0), sequence, k, offset))
            used[length] = used.get(length, 0) + n * k
            offset += length * k
        sequence += n
    return {length: np.asarray(rows, np.int64) for length, rows in found.items()}


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = staged(token_pieces(docs, id_col, text_col, tokenizer_path or vocabulary(), capacity), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    # Bounded by the capacity: one number for each possible length.
    total = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        total[r["length"]] = r["n"]
    found = slots(solve(total, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = pieces.join(offsets, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("earlier")).alias("rank"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                rows, mine = found[n], length == n
                slot = rows[np.searchsorted(rows[:, 0], rank[mine], "right") - 1]
                nth = rank[mine] - slot[:, 0]
                sequence[mine] = slot[:, 1] + nth // slot[:, 2]
                offset[mine] = slot[:, 3] + nth % slot[:, 2] * n
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["rank"]).columns, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
