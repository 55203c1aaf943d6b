"""Byte-level BPE by overlapping chunks, and the way back to bytes.

A text longer than a chunk is cut into chunks that overlap. Each chunk is pre-tokenised by itself, wherever
it runs. A scan of the pattern depends only on where it stands and on what follows, so once the
scans of two neighbouring chunks reach one boundary inside their overlap, they go on alike: there the chunks are stitched,
the left one giving the pieces before and the right one those after. Neighbours without a common boundary (a run
of one class of characters longer than the overlap) are joined and scanned again as one. Then every
piece is encoded by merging its bytes in rank order.

Boundaries near a chunk's end are uncertain, as the pattern may look further than the chunk.
A match counts only if it and the look behind it end before the chunk does.

How it spreads: a text of one chunk is finished in the task that reads it. Chunks of longer texts are dealt
by (text, chunk). Neighbours meet by an equi-join on boundaries only, and stitched pieces are encoded
where they lie. Each worker remembers pieces it has encoded, in a table of bounded size.

Defined cases: NULL and empty texts give no ids (the digests of zero bytes); repeated rows and
doc_ids are encoded row by row through a key made of id and text; an empty table gives an empty result; other columns
of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm import base


@dataclass(frozen=True)
class Settings:
    """Production parameters, in characters; `remembered` in pieces per worker."""

    chunk: int = 32_768
    overlap: int = 512
    remembered: int = 300_000
    #: Longer pieces are encoded without being remembered.
    remembered_length: int = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file: one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: join the adjacent pair of lowest rank, leftmost first, until none has a rank.

    Pairs wait in a heap, links tell neighbours, so a piece of n bytes takes n log n steps."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) < 48:
        return _merge_short(piece, ranks)
    return _merge_long(piece, ranks)


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ranks of all adjacent pairs in a list, which a short piece searches fastest as a whole."""
    get, none = ranks.get, len(ranks) + 256
    edges = list(range(len(piece) + 1))
    pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs and (best := min(pairs)) < none:
        i = pairs.index(best)
        del edges[i + 1], pairs[i]
        if i:
            pairs[i - 1] = get(piece[edges[i - 1] : edges[i + 1]], none)
        if i < len(pairs):
            pairs[i] = get(piece[edges[i] : edges[i + 2]], none)
    return [ranks[piece[a:b]] for a, b in zip(edges, edges[1:], strict=False)]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts here; 0: no part starts here
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, j = heappop(heap)
        middle = end[i]
        # Stale if a part has begun or grown since.
        if not middle or middle >= n or end[middle] != j:
            continue
        end[middle] = 0
        end[i] = j
        if j < n:
            before[j] = i
            if (r := ranks.get(piece[i : end[j]])) is not None:
                heappush(heap, (r, i, end[j]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:j])) is not None:
            heappush(heap, (r, p, j))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Pieces(dict):
    """Encoded pieces by their text, as little-endian 32-bit ids.

    At most `remembered` pieces are held, and as many of the generation before, whose used ones move up."""

    def __init__(self, ranks: dict[bytes, int], settings: Settings):
        super().__init__()
        self.ranks = ranks
        self.settings = settings
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            made = array("I", merge(piece.encode("utf-8"), self.ranks))
            if sys.byteorder == "big":
                made.byteswap()
            ids = made.tobytes()
        if len(piece) <= self.settings.remembered_length:
            if len(self) >= self.settings.remembered:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Coder:
    """Encodes and decodes with one vocabulary; kept by each worker."""

    _made: dict[tuple, Coder] = {}

    def __init__(self, path: str, pattern: str, settings: Settings):
        ranks = read_ranks(path)
        self.find = regex.compile(pattern).findall
        self.iterate = regex.compile(pattern).finditer
        self.encode_piece = Pieces(ranks, settings).__getitem__
        top = max(ranks.values(), default=-1) + 1
        self.tokens: list[bytes] = [b""] * top
        for token, rank in ranks.items():
            self.tokens[rank] = token

    @classmethod
    def of(cls, path: str, pattern: str, settings: Settings) -> Coder:
        key = (path, pattern, settings)
        if key not in cls._made:
            cls._made[key] = cls(path, pattern, settings)
        return cls._made[key]

    def encode(self, text: str) -> bytes:
        # A piece that is not remembered comes back from __missing__ through the same call.
        return b"".join(map(self.encode_piece, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))

    def boundaries(self, chunk: str, last: bool) -> list[int]:
        """Starts of pieces in the chunk, as far as what follows the chunk can't change them."""
        starts, size = [], len(chunk)
        for m in self.iterate(chunk):
            starts.append(m.start())
            # White space may be parted by what follows it, so a match needs a character after it.
            if m.end() >= size and not last:
                break
        if last:
            starts.append(size)
        return starts


def _digests(coder: Coder, ids: bytes) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()


DIGESTS = "doc_id long, row_key long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@dataclass(frozen=True)
class Vocabulary:
    """Where the ranks lie on every machine, and the pattern that parts a text."""

    path: str
    pattern: str
    settings: Settings = Settings()

    def coder(self) -> Coder:
        return Coder.of(self.path, self.pattern, self.settings)


def _rows(documents: DataFrame) -> DataFrame:
    text = base.text_of()
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text).alias("row_key"), text.alias("text")
    )


def _id() -> Column:
    """The id as a join key; the row key tells a missing id from a negative one."""
    return F.coalesce("doc_id", F.lit(-1).cast("long"))


def chunks(documents: DataFrame, settings: Settings) -> DataFrame:
    """Texts longer than a chunk, cut: row_key, number of the chunk, its start, and the chunk with its overlap."""
    size = F.length("text")
    return (
        _rows(documents)
        .where(size > settings.chunk)
        .withColumn("doc_id", _id())
        .withColumn("last", ((size - 1) / settings.chunk).cast("int"))
        .dropDuplicates(["doc_id", "row_key"])
        .select("doc_id", "row_key", "text", "last", F.explode(F.sequence(F.lit(0), "last")).alias("part"))
        .select(
            "doc_id", "row_key", "part", "last",
            F.substring("text", F.col("part") * settings.chunk + 1, F.lit(settings.chunk + settings.overlap)).alias("chunk"),
        )
        .repartition("row_key", "part")
    )


def _pre_tokenised(cut: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The chunks with boundaries in their first and last overlap, relative to where each overlap starts."""
    chunk, overlap = vocabulary.settings.chunk, vocabulary.settings.overlap

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary.coder()
        for b in batches:
            heads, tails = [], []
            for last, part, text in zip(*(b.column(c).to_pylist() for c in ("last", "part", "chunk")), strict=True):
                starts = coder.boundaries(text, last=part == last)
                heads.append([s for s in starts if s <= overlap])
                tails.append([s - chunk for s in starts if s >= chunk])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))],
                names=[*b.schema.names, "head", "tail"],
            )

    return cut.mapInArrow(
        scan, "doc_id long, row_key long, part int, last int, chunk string, head array<int>, tail array<int>"
    )


def stitched(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """row_key, part, text: consecutive stretches of the long texts that begin and end at true boundaries."""
    chunk = vocabulary.settings.chunk
    scanned = base.stored(_pre_tokenised(chunks(documents, vocabulary.settings), vocabulary), "chunks")
    left = scanned.select("doc_id", "row_key", (F.col("part") + 1).alias("part"), "tail")
    # Where each chunk takes over from the one before it; NULL if their scans never met.
    meets = F.array_min(F.array_intersect("tail", "head"))
    seams = (
        scanned.select("doc_id", "row_key", "part", "head")
        .join(left, ["doc_id", "row_key", "part"])
        .select("doc_id", "row_key", "part", meets.alias("begin"))
    )
    ends = seams.select("doc_id", "row_key", (F.col("part") - 1).alias("part"), F.col("begin").alias("end"))
    whole = (
        scanned.select("doc_id", "row_key", "part", "last", "chunk")
        .join(seams, ["doc_id", "row_key", "part"], "left")
        .join(ends, ["doc_id", "row_key", "part"], "left")
    )
    begins = F.coalesce("begin", F.lit(0))
    until = F.when(F.col("part") == F.col("last"), F.length("chunk")).otherwise(F.lit(chunk) + F.coalesce("end", F.lit(0)))
    own = whole.select(
        "doc_id", "row_key", "part",
        # Without a seam the stretch is glued to the one before it.
        ((F.col("part") > 0) & F.col("begin").isNull()).alias("glued"),
        F.substring("chunk", begins + 1, until - begins).alias("text"),
    )
    met = own.groupBy("doc_id", "row_key").agg(F.max("glued").alias("any_glued"))
    kept = base.stored(own.join(met, ["doc_id", "row_key"]), "stretches")
    return kept.where("NOT any_glued").select("doc_id", "row_key", "part", "text").unionByName(_glued(kept.where("any_glued")))


def _glued(stretches: DataFrame) -> DataFrame:
    """Stretches whose scans never met, as one text each; such a run is of one class of characters."""
    order = Window.partitionBy("doc_id", "row_key").orderBy("part")
    return (
        stretches.withColumn("run", F.sum(F.when(F.col("glued"), 0).otherwise(1)).over(order))
        .groupBy("doc_id", "row_key", "run")
        .agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("pieces"))
        .select(
            "doc_id", "row_key", F.col("pieces")[0]["part"].alias("part"),
            F.array_join(F.transform("pieces", lambda x: x["text"]), "").alias("text"),
        )
    )


def encode_short(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Texts of one chunk, digested where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary.coder()
        for b in batches:
            found = [_digests(coder, coder.encode(t)) for t in b.column("text").to_pylist()]
            n, ids, decoded = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("row_key"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "row_key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _rows(documents).where(F.length("text") <= vocabulary.settings.chunk).mapInArrow(run, DIGESTS)


def encode_stretches(stretches: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Ids and decoded bytes of each stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary.coder()
        for b in batches:
            ids = [coder.encode(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "row_key", "part")), pa.array(ids, pa.binary()),
                 pa.array([coder.decode(x) for x in ids], pa.binary())],
                names=["doc_id", "row_key", "part", "ids", "decoded"],
            )

    return stretches.mapInArrow(run, "doc_id long, row_key long, part int, ids binary, decoded binary")


def encode_long(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Long texts: stretches encoded apart, their ids and bytes joined in order for the digests."""
    def joined(name: str) -> Column:
        in_order = F.transform("parts", lambda x: x[name])
        return F.aggregate(in_order, F.lit(b""), lambda a, x: F.concat(a, x))

    parts = encode_stretches(stitched(documents, vocabulary), vocabulary)
    whole = (
        parts.groupBy("doc_id", "row_key")
        .agg(F.array_sort(F.collect_list(F.struct("part", "ids", "decoded"))).alias("parts"))
        .select("doc_id", "row_key", joined("ids").alias("ids"), joined("decoded").alias("decoded"))
        .select(
            "doc_id", "row_key", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
            F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
        )
    )
    rows = _rows(documents).where(F.length("text") > vocabulary.settings.chunk)
    return (
        rows.select("doc_id", _id().alias("id"), "row_key")
        .join(whole.withColumnRenamed("doc_id", "id"), ["id", "row_key"])
        .select("doc_id", "row_key", "n_tokens", "ids_sha256", "decoded_sha256")
    )


def digests(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """One row per document: token count and the digests of its ids and of the decoded bytes."""
    return encode_short(documents, vocabulary).unionByName(encode_long(documents, vocabulary)).drop("row_key")


def production(settings: Settings = Settings()) -> Vocabulary:
    import public_tokenizers

    return Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, settings)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    base.small_batches(spark)
    return digests(base.table(spark, sf_dir, "documents"), production())
