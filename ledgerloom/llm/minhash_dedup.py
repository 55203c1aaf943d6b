"""Near-duplicate documents: MinHash signatures and a multi-index Hamming join, confirmed on full sets.

A document's set holds its word shingles. Its signature has `symbols` symbols of 16 bits, each from
one minimum. At similarity s, symbols differ in a share of about 1 - s.

**Multi-index join.** The symbols are split into `chunks` chunks. Two signatures that differ in at most
D = 2 * chunks - 1 symbols differ, by the pigeonhole principle, in at most one symbol of some chunk. So each chunk
gives one key for every symbol that may be wrong, made of the others: all pairs within distance D
share a key. With 60 symbols in 12 chunks (D = 23), a pair at similarity 0.8 exceeds the distance with
probability about 3 in 10,000, a pair at 0.85 with less than one in 100,000.

**Without pairing off groups.** Documents of equal sets are one class first. In each bucket of a key, every member
meets the bucket's least one only; confirmed links give components. That leaves pairs of one bucket in different
components. They are all compared next, so nothing is capped: a group of near copies is one component
by then and adds no pair. The distance, and a bound on what the sets can share (from parity bits of
each), are part of the join's condition, so a pair that they rule out never becomes a row.

**Confirming.** Candidate pairs get their texts by two joins, and the full sets (64-bit hashes of shingles)
decide by 100 * intersection >= percent * union.

Defined cases: NULL, empty and blank texts have the empty set, are linked with nothing and are kept; texts
shorter than a shingle have their whole word sequence as the only one; repeated rows are linked; a
NULL doc_id counts as larger than all others, and the component of only such rows has NULL as its id;
rows that repeat a doc_id with another text are nodes of their own; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import base
from ledgerloom.llm.components import components

NO_ID = (1 << 63) - 1
PARITY_BITS = 2_048


@dataclass(frozen=True)
class Settings:
    """Production parameters of the library; the query's contract names its own width."""

    width: int = 5
    percent: int = 80
    chunks: int = 12
    chunk_symbols: int = 5
    #: Words remembered by each worker.
    remembered: int = 500_000

    @property
    def symbols(self) -> int:
        return self.chunks * self.chunk_symbols

    @property
    def distance(self) -> int:
        return 2 * self.chunks - 1

    @property
    def longs(self) -> int:
        return -(-self.symbols // 4)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class _Words(dict):
    """64-bit hashes of words, remembered within a bound."""

    def __init__(self, bound: int):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


class Shingler:
    """Shingle sets and signatures; kept by each worker."""

    _made: dict[Settings, Shingler] = {}

    def __init__(self, settings: Settings):
        self.settings = settings
        self.words = _Words(settings.remembered)
        rng = np.random.default_rng(20_011)
        draw = lambda n: rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.place = draw(settings.width)
        self.times, self.plus = draw(settings.symbols)[:, None], draw(settings.symbols)[:, None]

    @classmethod
    def of(cls, settings: Settings) -> Shingler:
        if settings not in cls._made:
            cls._made[settings] = cls(settings)
        return cls._made[settings]

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of the text's shingles."""
        # Bytes lower only A-Z, and split on the six ASCII blanks.
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        width, n = self.settings.width, len(words)
        if not n:
            return np.empty(0, dtype=np.uint64)
        h = np.fromiter(map(self.words.__getitem__, words), dtype=np.uint64, count=n)
        if n < width:
            short = np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64))
            return _mixed((h * self.place[:n]).sum(dtype=np.uint64, keepdims=True) ^ short)
        total = h[: n - width + 1] * self.place[0]
        for i in range(1, width):
            total += h[i : n - width + 1 + i] * self.place[i]
        return np.unique(_mixed(total))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """The symbols, as unsigned 16-bit numbers, padded to whole longs."""
        least = np.full((self.settings.symbols, 1), np.iinfo(np.uint64).max, dtype=np.uint64)
        for first in range(0, len(shingles), 1024):
            block = shingles[None, first : first + 1024] * self.times + self.plus
            least = np.minimum(least, block.min(axis=1, keepdims=True))
        out = np.zeros(self.settings.longs * 4, dtype=np.uint16)
        out[: self.settings.symbols] = (_mixed(least[:, 0]) >> np.uint64(48)).astype(np.uint16)
        return out

    def parity(self, shingles: np.ndarray) -> np.ndarray:
        """Parity bits of the set: bit i tells whether an odd number of its hashes end in i."""
        odd = np.bincount((shingles & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
        return np.packbits(odd.astype(np.uint8)).view(np.int64)

    def similar(self, a: np.ndarray, b: np.ndarray) -> bool:
        common = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * common >= self.settings.percent * (len(a) + len(b) - common)


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def signatures(documents: DataFrame, settings: Settings) -> DataFrame:
    """id, text hash, set size, class (a 64-bit hash of the set's 128-bit one) and signature of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Shingler.of(settings)
        for b in batches:
            sizes, nodes, signed, parity = [], [], [], []
            for text in b.column("text").to_pylist():
                s = made.shingles(text)
                sizes.append(len(s))
                nodes.append(xxhash.xxh3_64_intdigest(xxhash.xxh3_128_digest(s.tobytes())) - (1 << 63) if len(s) else None)
                signed.append(made.signature(s).view(np.int64) if len(s) else None)
                parity.append(made.parity(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()),
                 pa.array(signed, pa.list_(pa.int64())), pa.array(parity, pa.list_(pa.int64()))],
                names=["id", "text_hash", "n_shingles", "node", "signature", "parity"],
            )

    rows = documents.select(_id().alias("id"), F.xxhash64("text").alias("text_hash"), base.text_of().alias("text"))
    return rows.mapInArrow(run, "id long, text_hash long, n_shingles long, node long, signature array<long>, parity array<long>")


def keyed(nodes: DataFrame, settings: Settings) -> DataFrame:
    """node, key: for each chunk, one key per symbol that may be wrong, of the chunk's other symbols."""
    r = settings.chunk_symbols
    names = _mixed(np.arange(1, settings.symbols + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            longs = np.asarray(b.column("signature").flatten())
            symbols = longs.view(np.uint16).reshape(n, -1)[:, : settings.symbols].astype(np.uint64)
            keys = np.empty((n, settings.symbols), dtype=np.uint64)
            for at in range(settings.symbols):
                chunk = at // r * r
                key = np.full(n, names[at], dtype=np.uint64)
                for other in range(chunk, chunk + r):
                    if other != at:
                        key = _mixed(key ^ symbols[:, other])
                keys[:, at] = key
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(b.column("node").to_numpy(), settings.symbols)), pa.array(keys.reshape(-1).view(np.int64))],
                names=["node", "key"],
            )

    return nodes.select("node", "signature").mapInArrow(run, "node long, key long")


def _distance(a: Column, b: Column, settings: Settings) -> Column:
    """Symbols in which two signatures differ: each 16-bit lane of the difference is folded to one bit."""
    total = F.lit(0)
    for i in range(settings.longs):
        x = F.get(a, i).bitwiseXOR(F.get(b, i))
        for shift in (8, 4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x0001000100010001)))
    return total


def _may_link(a: str, b: str, settings: Settings) -> Column:
    """Near enough by signature, and not ruled out by sizes or parity.

    The smaller set holds at least the whole intersection. Every differing parity bit needs
    an element that only one of the sets has, and of these linked sets have at most (100 - percent) in (100 + percent) of
    their sizes' sum. So neither test loses a link."""
    n, m = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    x, y = F.col(f"{a}.parity"), F.col(f"{b}.parity")
    apart = F.lit(0)
    for i in range(PARITY_BITS // 64):
        apart = apart + F.bit_count(F.get(x, i).bitwiseXOR(F.get(y, i)))
    near = _distance(F.col(f"{a}.signature"), F.col(f"{b}.signature"), settings) <= settings.distance
    return (
        (F.least(n, m) * 100 >= F.greatest(n, m) * settings.percent)
        & (apart * (100 + settings.percent) <= (n + m) * (100 - settings.percent))
        & near
    )


def confirmed(pairs: DataFrame, nodes: DataFrame, documents: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are similar enough."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    places = wanted.join(nodes.select("node", "id", "text_hash"), "node")
    texts = (
        documents.select(_id().alias("id"), F.xxhash64("text").alias("text_hash"), base.text_of().alias("text"))
        .join(places, ["id", "text_hash"])
        .select("node", "text")
        .dropDuplicates(["node"])
    )
    texts = base.stored(texts, "candidate-texts")
    both = (
        pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Shingler.of(settings)
        last, first = None, np.empty(0, dtype=np.uint64)
        for batch in batches:
            same = []
            for a, text_a, text_b in zip(*(batch.column(c).to_pylist() for c in ("a", "text_a", "text_b")), strict=True):
                if a != last:  # rows come sorted by a, which may have many partners
                    last, first = a, made.shingles(text_a)
                same.append(made.similar(first, made.shingles(text_b)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(
                pa.array(same, pa.bool_())
            )

    return base.stored(both.mapInArrow(run, "a long, b long"), "confirmed-links")


def linked(documents: DataFrame, nodes: DataFrame, settings: Settings) -> DataFrame:
    """node, label for every node with a partner: the component's least node."""
    keys = keyed(nodes, settings)
    buckets = keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    members = base.stored(keys.join(buckets.select("key", "least"), "key"), "shared-keys")

    def with_signatures(pairs: DataFrame) -> DataFrame:
        return (
            pairs.alias("p").join(nodes.alias("x"), F.col("p.a") == F.col("x.node"))
            .join(nodes.alias("y"), F.col("p.b") == F.col("y.node"))
            .where(_may_link("x", "y", settings)).select("p.a", "p.b")
        )

    # First everyone with the least member of each bucket.
    met = members.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    met = base.stored(with_signatures(met), "met-pairs")
    links = confirmed(met, nodes, documents, settings)
    labels = components(links)

    # Then, in buckets that hold several components, members of different ones.
    label = F.coalesce("label", "node").alias("label")
    labelled = base.stored(members.join(labels, "node", "left").select("key", "node", label), "labelled-keys")
    mixed = (
        labelled.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("m")).where("l < m").select("key")
    )
    rest = (
        labelled.join(mixed, "key", "left_semi")
        .join(nodes.select("node", "n_shingles", "signature", "parity"), "node")
        .select("key", "node", "label", "n_shingles", "signature", "parity")
    )
    rest = base.stored(rest, "mixed-buckets")
    x, y = rest.alias("x"), rest.alias("y")
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.label") < F.col("y.label"))
    pairs = (
        x.join(y, apart & _may_link("x", "y", settings))
        .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
        .distinct()
        .join(met, ["a", "b"], "left_anti")
    )
    more = confirmed(base.stored(pairs, "other-pairs"), nodes, documents, settings)
    return components(links.unionByName(more))


def deduplicate(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Every row's doc_id and text hash, set size, component id and whether it is kept."""
    rows = base.stored(signatures(documents, settings), "signatures")
    nodes = (
        rows.where("node IS NOT NULL").groupBy("node")
        .agg(F.min(F.struct("id", "text_hash", "n_shingles", "signature", "parity")).alias("r"))
        .select("node", "r.*")
    )
    nodes = base.stored(nodes, "classes")
    labels = linked(documents, nodes, settings)
    named = nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "id")
    least = named.groupBy("label").agg(F.min("id").alias("least"))
    node_ids = named.join(least, "label").select("node", "least")
    return (
        rows.join(node_ids, "node", "left")
        .withColumn("component", F.coalesce("least", "id"))
        .select(
            F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "text_hash", "n_shingles",
            F.nullif("component", F.lit(NO_ID)).alias("component_id"), (F.col("id") == F.col("component")).alias("kept"),
        )
    )


def representatives(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row of each group with all its columns; rows without a word all stay, but for repeated rows."""
    kept = deduplicate(documents, settings).where("kept").select(_id().alias("_id"), "text_hash").distinct()
    rows = documents.withColumns({"_id": _id(), "_text_hash": F.xxhash64("text")})
    same = (F.col("k._id") == F.col("d._id")) & (F.col("k.text_hash") == F.col("d._text_hash"))
    return (
        rows.alias("d").join(kept.alias("k"), same, "left_semi")
        .dropDuplicates(["_id", "_text_hash"]).drop("_id", "_text_hash")
    )


#: The query's contract: sets of four-word shingles.
CONTRACT = Settings(width=4)


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    base.small_batches(spark)
    return deduplicate(base.table(spark, sf_dir, "documents"), CONTRACT).drop("text_hash")


ORACLE = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(
    regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
    lambda x: x <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(
      CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS s
    FROM words)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 80 * (x.n + y.n - c)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a
), least AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN sizes USING (doc_id)
"""
