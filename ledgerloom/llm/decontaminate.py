"""Benchmark decontamination: every passage of a text queries a BM25 index of the test items.

**Index.** Test items are the indexed documents; a posting holds the item and its BM25 weight, divided by
the item's own full score, so that a passage holding every word of an item scores 1. Items lie in blocks,
and each word knows its greatest weight in every block.

**Queries.** A text's passages are windows of twice the longest item's words, each starting half a window after
the last, so that any item lies wholly inside one. For each window and block, the sum of the window's
greatest weights bounds every score in it: most blocks are skipped at once. Words in many items count
once a window in that bound, others each time they occur. In the remaining blocks, WAND moves cursors over the postings of
the window's words, skipping items whose bound stays under the threshold, and yields *all* items at or above it.

**Verification.** An item splits into question and answer (its last sentence). A retrieved item is a leak if enough of the word
trigrams of each, question and answer, stand in the window; a part of one or two words must stand there as a whole.

How it spreads: documents stay where they are read, nothing of them is shuffled. The index goes to the tasks in shards of
about `shard_items` items or `shard_words` words; more items take more passes over the documents. Document
frequencies, average length and the window are taken over all items by Spark, so that results do not depend on the shards.

Defined cases: NULL and empty texts hold no leak; NULL and wordless items are never found; items that repeat are found under
each id; repeated documents give repeated rows; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import base

WORD = re.compile(r"\w+")
SENTENCE_END = re.compile(r"(?<=[.?!])\s+|\n+")


@dataclass(frozen=True)
class Settings:
    """Production parameters."""

    k1: float = 1.2
    b: float = 0.75
    #: Share of an item's full score that retrieves it.
    threshold: float = 0.6
    #: Shares of the question's and the answer's trigrams that make a leak.
    question: float = 0.6
    answer: float = 0.6
    block: int = 8
    least_window: int = 64
    shard_items: int = 1_024
    shard_words: int = 262_144
    #: Words in more than this share of the items always count in a block's bound.
    common: float = 0.08


def grams(words: list[str], n: int = 3) -> set[tuple[str, ...]]:
    """Word n-grams; the whole sequence if it is shorter; none without words."""
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def parts(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer: the last sentence, or the later half of a single one."""
    sentences = [w for s in SENTENCE_END.split(text) if (w := WORD.findall(s.lower()))]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = sentences[0] if sentences else []
    return words[: len(words) // 2], words[len(words) // 2 :]


@dataclass(frozen=True)
class Statistics:
    """Over all items with words: their number, their words, the longest one's words, and how many items hold a word."""

    items: int
    words: int
    longest: int
    frequency: dict[str, int]


@dataclass
class Index:
    """One shard of test items, in blocks, with what retrieval and verification need."""

    settings: Settings
    items: list[int]
    vocabulary: dict[str, int]
    #: For each block, its words' greatest weight and postings: (item number, weight) in order.
    postings: list[dict[int, tuple[float, list[tuple[int, float]]]]]
    #: Greatest weight by word and block; 0 for common words, which have a table of their own.
    block_top: np.ndarray
    common_top: np.ndarray
    #: Row of each word in `common_top`; -1 for other words.
    common_row: np.ndarray
    window: int
    questions: list[set] = field(default_factory=list)
    answers: list[set] = field(default_factory=list)

    @classmethod
    def build(
        cls, rows: list[tuple[int, str]], settings: Settings = Settings(), overall: Statistics | None = None
    ) -> Index | None:
        """An index of the rows; `overall` holds the statistics where they are a part of all items."""
        found = [(i, words, text) for i, text in sorted(rows) if (words := WORD.findall((text or "").lower()))]
        if not found:
            return None
        # Like items share blocks, which makes the blocks' bounds tight; any order is right.
        found.sort(key=lambda x: (x[1][0], x[0]))
        if overall is None:
            lengths = [len(w) for _, w, _ in found]
            held = Counter(w for _, words, _ in found for w in set(words))
            overall = Statistics(len(found), sum(lengths), max(lengths), held)
        total, average, frequency = overall.items, overall.words / overall.items, overall.frequency
        vocabulary = {w: n for n, w in enumerate(sorted({w for _, words, _ in found for w in words}))}
        blocks = -(-total // settings.block)
        postings: list[dict] = [{} for _ in range(blocks)]
        top = np.zeros((len(vocabulary) + 1, blocks), dtype=np.float32)
        for number, (_, words, _) in enumerate(found):
            scale = settings.k1 * (1 - settings.b + settings.b * len(words) / average)
            weight = {
                w: math.log(1 + (total - frequency[w] + 0.5) / (frequency[w] + 0.5)) * c * (settings.k1 + 1) / (c + scale)
                for w, c in Counter(words).items()
            }
            full = sum(weight.values())
            for w, v in weight.items():
                at = vocabulary[w]
                block = number // settings.block
                bound, listed = postings[block].get(at, (0.0, []))
                postings[block][at] = (max(bound, v / full), [*listed, (number, v / full)])
                top[at, block] = max(top[at, block], v / full)
        often = sorted(n for w, n in vocabulary.items() if frequency[w] > max(1, settings.common * total))
        row = np.full(len(vocabulary) + 1, -1)
        row[often] = np.arange(len(often))
        common = top[often].copy()
        top[often] = 0
        split = [parts(text) for _, _, text in found]
        return cls(
            settings, [i for i, _, _ in found], vocabulary, postings, top, common, row,
            2 * max(overall.longest, settings.least_window // 2), [grams(q) for q, _ in split], [grams(a) for _, a in split],
        )

    def find(self, text: str | None) -> list[tuple[int, int, float, float, float]]:
        """(item_id, first word of the best passage, score, question share, answer share) of each leak."""
        words = WORD.findall((text or "").lower())
        if not words:
            return []
        found: dict[int, tuple] = {}
        step = self.window // 2
        # A very long text is bounded in stretches of windows.
        stretch = max(1, 65_536 // step)
        windows = max(1, -(-len(words) // step) - 1)
        for first in range(0, windows, stretch):
            last = min(windows, first + stretch)
            for w, codes, blocks in self._open_blocks(words, first, last, step):
                have: dict[int, set] = {}
                for item, score in self.retrieve(codes, blocks):
                    passage = words[w * step : w * step + self.window]
                    q, a = _share(self.questions[item], passage, have), _share(self.answers[item], passage, have)
                    if q >= self.settings.question and a >= self.settings.answer:
                        best = (score, q, a, -w * step)
                        found[item] = max(found.get(item, best), best)
        return [(self.items[i], -at, min(1.0, s), q, a) for i, (s, q, a, at) in sorted(found.items())]

    def _open_blocks(self, words: list[str], first: int, last: int, step: int) -> Iterator[tuple[int, set[int], list[int]]]:
        """Windows with their words' codes, and the blocks whose bound reaches the threshold."""
        begin, end = first * step, min(len(words), (last - 1) * step + self.window)
        none = len(self.vocabulary)
        own = words[begin:end]
        codes = np.fromiter(map(self.vocabulary.get, own, repeat(none)), dtype=np.int64, count=len(own))
        row = self.common_row[codes]
        # Common words count once in a window: which of them each half window holds.
        often = np.flatnonzero(row >= 0)
        halves = np.zeros((last - first + 1, len(self.common_top)), dtype=bool)
        halves[np.minimum(often // step, last - first), row[often]] = True
        bound = (halves[:-1] | halves[1:]).astype(np.float32) @ self.common_top
        # Other words count each time, which is still a bound.
        places = np.flatnonzero((codes < none) & (row < 0))
        sums = np.zeros((len(places) + 1, self.block_top.shape[1]), dtype=np.float32)
        np.cumsum(self.block_top[codes[places]], axis=0, out=sums[1:])
        starts = np.arange(last - first) * step
        low = np.searchsorted(places, starts)
        high = np.searchsorted(places, starts + self.window)
        # A little under the threshold, for the sums' rounding.
        hit = sums[high] - sums[low] + bound >= self.settings.threshold - 1e-3
        for w in np.flatnonzero(hit.any(axis=1)):
            begin = int(w) * step
            yield first + int(w), set(codes[begin : begin + self.window].tolist()), np.flatnonzero(hit[w]).tolist()

    def retrieve(self, codes: set[int], blocks: list[int]) -> list[tuple[int, float]]:
        """All items of the blocks that score at least the threshold, by WAND within each block."""
        threshold = self.settings.threshold - 1e-9
        out = []
        for block in blocks:
            own = self.postings[block]
            shared = [own[c] for c in (codes & own.keys())]
            if sum(bound for bound, _ in shared) >= threshold:
                out += _wand([[listed[0][0], 0, bound, listed] for bound, listed in shared], threshold)
        return out


def _wand(cursors: list[list], threshold: float) -> list[tuple[int, float]]:
    """Items whose postings' weights reach the threshold; a cursor is (item, place, bound, postings)."""
    out = []
    while cursors:
        cursors.sort(key=lambda c: c[0])
        bound, pivot = 0.0, -1
        for i, c in enumerate(cursors):
            bound += c[2]
            if bound >= threshold:
                pivot = i
                break
        if pivot < 0:
            return out
        item = cursors[pivot][0]
        if cursors[0][0] == item:
            score = sum(c[3][c[1]][1] for c in cursors if c[0] == item)
            if score >= threshold:
                out.append((item, score))
            target = item + 1
        else:
            target = item
        moved = []
        for c in cursors:
            while c[1] < len(c[3]) and c[3][c[1]][0] < target:
                c[1] += 1
            if c[1] < len(c[3]):
                c[0] = c[3][c[1]][0]
                moved.append(c)
        cursors = moved
    return out


def _share(wanted: set, passage: list[str], have: dict[int, set]) -> float:
    """Share of a part's grams in the passage, whose grams of the same length are made once, in `have`."""
    if not wanted:
        return 1.0
    n = len(next(iter(wanted)))
    if n not in have:
        have[n] = grams(passage, n)
    return len(wanted & have[n]) / len(wanted)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of words and distinct words of each item."""
    for b in batches:
        words = [WORD.findall(t.lower()) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("item_id"), b.column("text"), pa.array(map(len, words), pa.int64()),
             pa.array([sorted(set(w)) for w in words], pa.list_(pa.string()))],
            names=["item_id", "text", "n_words", "words"],
        )


def indexes(items: DataFrame, settings: Settings = Settings()) -> Iterator[Index]:
    """Indexes over shards of the items, one after the other, all by the statistics of all items."""
    usable = items.where("text IS NOT NULL AND item_id IS NOT NULL").select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")
    )
    parsed = usable.mapInArrow(_parsed, "item_id long, text string, n_words long, words array<string>").where("n_words > 0")
    n, words, longest = parsed.agg(F.count("*"), F.sum("n_words"), F.max("n_words")).collect()[0]
    if not n:
        return
    shards = max(math.ceil(n / settings.shard_items), math.ceil(words / settings.shard_words))
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).alias("shard")
    held = parsed.select(shard, F.explode("words").alias("word")).groupBy("shard", "word").agg(F.count("*").alias("n"))
    if shards > 1:
        held = base.stored(held, "benchmark-words")
        held = held.drop("n").join(held.groupBy("word").agg(F.sum("n").alias("n")), "word")
        held = base.stored(held.repartition("shard"), "benchmark-frequencies")
    for number in range(shards):
        own = {r.word: r.n for r in held.where(F.col("shard") == number).select("word", "n").collect()}
        rows = [(r.item_id, r.text) for r in usable.where(shard == number).collect()]
        if index := Index.build(rows, settings, Statistics(n, words, longest, own)):
            yield index


LEAKS = "doc_id long, item_id long, first_word long, score double, question_share double, answer_share double"


def leaks(documents: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row for each document and test item it holds."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], LEAKS)
    for index in indexes(items, settings):
        shared = spark.sparkContext.broadcast(index)
        out = out.unionByName(rows.mapInArrow(_finder(shared), LEAKS))
    return out


def _finder(shared):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int64()),
                        ("score", pa.float64()), ("question_share", pa.float64()), ("answer_share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value.find
        for b in batches:
            found = [
                (doc_id, item, at, round(s, 6), round(q, 6), round(a, 6))
                for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)
                for item, at, s, q, a in find(text)
            ]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema
                )

    return run


def without_leaks(documents: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents that hold no test item, with all their columns."""
    spark = documents.sparkSession
    out = documents
    for index in indexes(items, settings):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            find = shared.value.find
            for b in batches:
                text = b.column(b.schema.get_field_index("text")).to_pylist()
                yield b.filter(pa.array([not find(t) for t in text], pa.bool_()))

        out = out.mapInArrow(run, documents.schema)
    return out


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    base.small_batches(spark)
    return leaks(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "benchmark"))
