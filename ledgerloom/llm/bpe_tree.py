"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

The file of a public tokenizer names its vocabulary, its merges in order of rank, and added tokens. A text is first parted at its added
tokens, the rest by the byte-level pattern into pieces. The bytes of a piece are symbols in a row; every symbol
holds, as a leaf of a segment tree, the rank of the merge with its right neighbour, or none. Inner nodes
hold the lowest rank below them, so the root tells the next merge, and going down by it, left before right, finds
its leftmost place. A merge changes three leaves: the place itself, the one before, and the symbol that is gone. Each change climbs
as long as a minimum changes, so a piece of n bytes takes at most n log n steps, whatever its
shape, until the root holds no rank. Decoding looks up each id's bytes and joins them; bytes that are no UTF-8 become U+FFFD.

How it spreads: every text is finished in the task that reads it, without a shuffle. Arrow batches are bounded in
rows and bytes, and a text longer than `Settings.stretch` passes through in stretches of pieces, digests
running on. Each worker reads the file once and remembers encoded pieces in a table of bounded size.

Defined cases: NULL and empty texts give no ids (the digests of zero bytes); repeated rows and doc_ids stay, row by row;
a NULL doc_id stays NULL; an empty table gives an empty result; other columns are ignored. The string of an added token in a text
is that token, as the tokenizers library has it by default. A file with a normalizer, another way of parting texts than the byte-level one, or
merging options that are not handled here is refused.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import sys
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import base

#: Letters and numbers (first and last code point) that Unicode has got since version 16, the one of the tokenizers
#: library. There they are neither letters nor numbers.
NEWER = """
558-558 58B-58C 88F-88F C5C-C5C CDC-CDC 208F-208F 209D-209F A7CE-A7CF A7D2-A7D2 A7D4-A7D4 A7DD-A7DD A7E2-A7E2
A7F1-A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A-11B0A 11DB0-11DDB 11DE0-11DE9 11DF1-11DF1
1246F-1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20
18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168-1B168 1D6A6-1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96
1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E-2B81E
2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
#: Fixed value: the pattern of byte-level pre-tokenising, over classes of letters and numbers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?[^\s{letter}{number}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Settings:
    """Production parameters: `remembered` pieces per worker and of what length at most, and characters or pieces of a stretch."""

    remembered: int = 1_000_000
    remembered_length: int = 64
    stretch: int = 1 << 20


# ---- the tree ------------------------------------------------------------------------------


class RankTree:
    """A row of ranks under a binary tree of minima; ``none`` stands for no rank."""

    def __init__(self, ranks: list[int], none: int):
        self.size = 1 << max(len(ranks) - 1, 0).bit_length()
        least = [none] * self.size + ranks + [none] * (self.size - len(ranks))
        for node in range(self.size - 1, 0, -1):
            a, b = least[2 * node], least[2 * node + 1]
            least[node] = a if a <= b else b
        self.least = least

    def set(self, place: int, rank: int) -> None:
        least, node = self.least, place + self.size
        while least[node] != rank:
            least[node] = rank
            node >>= 1
            if not node:
                break
            a, b = least[2 * node], least[2 * node + 1]
            rank = a if a <= b else b

    def leftmost(self) -> int:
        """The first place that holds the lowest rank."""
        least, node, lowest = self.least, 1, self.least[1]
        while node < self.size:
            node *= 2
            if least[node] != lowest:
                node += 1
        return node - self.size


def merged(symbols: list[int], ranks: dict[tuple[int, int], int], joined: list[int]) -> list[int]:
    """The symbols after all merges: lowest rank first, leftmost first among equals."""
    n, none = len(symbols), len(joined)
    if n < 2:
        return symbols
    get = ranks.get
    tree = RankTree([get(pair, none) for pair in zip(symbols, symbols[1:], strict=False)], none)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (rank := tree.least[1]) < none:
        i = tree.leftmost()
        gone = after[i]
        symbols[i], symbols[gone] = joined[rank], -1
        after[i] = j = after[gone]
        if gone < n - 1:
            tree.set(gone, none)
        if j < n:
            before[j] = i
            tree.set(i, get((symbols[i], symbols[j]), none))
        else:
            tree.set(i, none)
        if (h := before[i]) >= 0:
            tree.set(h, get((symbols[h], symbols[i]), none))
    return [s for s in symbols if s >= 0]


# ---- the vocabulary ------------------------------------------------------------------------


def byte_letters() -> list[str]:
    """The character that stands for each byte in the file: itself where it prints, else the next one from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, spare = [], 0x100
    for byte in range(256):
        letters.append(chr(byte if byte in prints else spare))
        spare += byte not in prints
    return letters


class NewerCharacter(Exception):
    """A piece holds a character whose class the fast pattern gets wrong."""


class Pieces(dict):
    """Ids of pieces, as 32-bit integers in a string of bytes; two generations of bounded size."""

    def __init__(self, coder: Coder):
        super().__init__()
        self.coder = coder
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        settings = self.coder.settings
        ids = self.older.get(piece)
        if ids is None:
            if not piece.isascii() and self.coder.newer(piece):
                raise NewerCharacter
            ids = self.coder.piece(piece)
        if len(piece) <= settings.remembered_length:
            if len(self) >= settings.remembered:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Coder:
    """One tokenizer file, ready to encode and decode; kept by each worker."""

    _made: dict[tuple, Coder] = {}

    def __init__(self, path: str, settings: Settings = Settings()):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, parting = spec["model"], spec["pre_tokenizer"] or {}
        added = spec["added_tokens"]
        options = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if (
            model["type"] != "BPE" or any(model.get(o) for o in options) or spec["normalizer"] or spec["decoder"]["type"] != "ByteLevel"
            or parting.get("type") != "ByteLevel" or parting["add_prefix_space"] or not parting["use_regex"]
            or any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added)
        ):
            raise ValueError(f"{path} asks for more than byte-level BPE")
        self.settings = settings
        letters = byte_letters()
        byte_of = {letter: byte for byte, letter in enumerate(letters)}
        vocabulary: dict[str, int] = model["vocab"]
        self.of_byte = [vocabulary[letter] for letter in letters]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.joined = [vocabulary[a + b] for a, b in pairs]
        self.ranks = {(vocabulary[a], vocabulary[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.added = {a["content"]: a["id"] for a in added}
        tokens = [b""] * (max([*vocabulary.values(), *self.added.values()]) + 1)
        for token, number in vocabulary.items():
            tokens[number] = bytes(byte_of[c] for c in token)
        for token, number in self.added.items():
            tokens[number] = token.encode("utf-8")
        self.tokens = pa.array(tokens, pa.large_binary())
        self.decimals = pa.array([b"%d," % number for number in range(len(tokens))], pa.large_binary())

        newer = "".join("{}-{}".format(*(chr(int(end, 16)) for end in span.split("-"))) for span in NEWER.split())
        self.newer = regex.compile(f"[{newer}]").search
        self.fast = regex.compile(PATTERN.format(letter=r"\p{L}", number=r"\p{N}"))
        exact = {"letter": rf"[\p{{L}}--[{newer}]]", "number": rf"[\p{{N}}--[{newer}]]"}
        self.exact = regex.compile(PATTERN.format(**exact), regex.V1)
        by_length = sorted(self.added, key=len, reverse=True)
        self.apart = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")") if by_length else None
        self.known = Pieces(self).__getitem__

    @classmethod
    def of(cls, path: str, settings: Settings) -> Coder:
        key = (path, settings)
        if key not in cls._made:
            cls._made[key] = cls(path, settings)
        return cls._made[key]

    def piece(self, piece: str) -> bytes:
        symbols = list(map(self.of_byte.__getitem__, piece.encode("utf-8")))
        return array("I", merged(symbols, self.ranks, self.joined)).tobytes()

    def _part(self, text: str) -> Iterator[bytes]:
        """Ids of a text without added tokens, in stretches."""
        try:
            if len(text) <= self.settings.stretch:
                yield b"".join(map(self.known, self.fast.findall(text)))
                return
            # Ids before a newer character would be given twice, so it is looked for first.
            if not text.isascii() and self.newer(text):
                raise NewerCharacter
            found = self.fast.finditer(text)
            while stretch := [self.known(m.group()) for m in islice(found, self.settings.stretch)]:
                yield b"".join(stretch)
        except NewerCharacter:
            found = self.exact.finditer(text)
            while stretch := [self.piece(m.group()) for m in islice(found, self.settings.stretch)]:
                yield b"".join(stretch)

    def stretches(self, text: str) -> Iterator[np.ndarray]:
        """The ids of a text, piece by piece of bounded size."""
        parts = [text]
        if self.apart and any(token in text for token in self.added):
            parts = self.apart.split(text)
        for k, part in enumerate(parts):
            if k % 2:
                yield np.array([self.added[part]], dtype=np.uint32)
            elif part:
                for ids in self._part(part):
                    yield np.frombuffer(ids, dtype=np.uint32)

    def encode(self, text: str | None) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint32), *self.stretches(text or "")])

    def _looked_up(self, table: pa.Array, ids: np.ndarray) -> memoryview:
        """The entries of a table, joined: Arrow lays them out one after the other."""
        taken = table.take(pa.array(ids))
        offsets, data = taken.buffers()[1:]
        end = int(np.frombuffer(offsets, dtype=np.int64)[len(taken)])
        return memoryview(data)[:end] if data else memoryview(b"")

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return bytes(self._looked_up(self.tokens, ids)) if len(ids) else b""

    def decode(self, ids: np.ndarray) -> str:
        return self.bytes_of(ids).decode("utf-8", "replace")

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, digest of the ids in decimals, and digest of the text that the ids decode to."""
        count, listed, decoded = 0, hashlib.sha256(), hashlib.sha256()
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in self.stretches(text or ""):
            if not len(ids):
                continue
            decimals = self._looked_up(self.decimals, ids)
            if count:
                listed.update(b",")
            listed.update(decimals[:-1])
            count += len(ids)
            decoded.update(decoder.decode(self.bytes_of(ids)).encode("utf-8"))
        decoded.update(decoder.decode(b"", True).encode("utf-8"))
        return count, listed.hexdigest(), decoded.hexdigest()


assert array("I").itemsize == 4, sys.platform

# ---- over tables ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Tokenizer:
    """A tokenizer file that lies at the same path on every machine."""

    path: str
    settings: Settings = Settings()

    def coder(self) -> Coder:
        return Coder.of(self.path, self.settings)


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), base.text_of().alias("text"))


def encoded(documents: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(doc_id, ids): the ids of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer.coder()
        for b in batches:
            ids = [coder.encode(t).astype(np.int32) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _texts(documents).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(coded: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(doc_id, text): the texts of ids that the tokenizer has; NULL ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer.coder()
        for b in batches:
            texts = [coder.decode(np.array(ids or [], dtype=np.uint32)) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def digests(documents: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """A row per document: its number of ids, and the digests of ids and of what they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer.coder()
        for b in batches:
            found = [coder.digests(t) for t in b.column("text").to_pylist()]
            n, ids, text = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _texts(documents).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def production(settings: Settings = Settings()) -> Tokenizer:
    import public_tokenizers

    return Tokenizer(public_tokenizers.path("byte_bpe_50k.json"), settings)


def op13_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    base.small_batches(spark)
    return digests(base.table(spark, sf_dir, "documents"), production())
