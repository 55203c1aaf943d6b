"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a run of letters forwards and backwards, with a blank on either side, and
labels every byte with a distribution over the learned languages. A text's
distribution is the mean over all its letters' bytes. State starts afresh at each run of letters, so
labels of a run depend on it alone: each worker computes a distinct run once, in batches, and
remembers its summed labels in a table of bounded size, from one task to the next. Runs longer than `span` bytes are cut
between characters.

Training, on the driver: rows whose id's checksum is not divisible by the folds, with a text and a language, sampled
by a hash of the id to about `sample` documents in all, the same number for each language; from them `runs` runs
of letters per language are drawn and the network is fitted in numpy by backpropagation through time.

Defined cases: NULL texts and texts without a letter get `und` with score 0; without a single training row
every text gets `und`; of languages that tie the first by name counts; repeated rows are labelled alike; an empty table gives an empty result; other columns of the input
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import base

#: Runs of letters, as Unicode knows them.
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: Runs looked up at once.
STRETCH = 100_000


@dataclass(frozen=True)
class Settings:
    """Production parameters; `sample` bounds the labelled documents that training gathers."""

    sample: int = 2_000
    runs: int = 6_000
    span: int = 24
    hidden: int = 16
    epochs: int = 6
    batch: int = 256
    rate: float = 0.01
    remembered: int = 1_000_000


def _spans(run: str, span: int) -> list[bytes]:
    """The run's bytes with a blank at either end, cut between characters into stretches of up to ``span`` bytes."""
    raw = b" " + run.encode("utf-8", "replace") + b" "
    out, start = [], 0
    while len(raw) - start > span:
        end = start + span
        # Bytes 10xxxxxx go on with a character; one has four bytes at most.
        while end > start + 1 and raw[end] & 0xC0 == 0x80:
            end -= 1
        out.append(raw[start:end])
        start = end
    return [*out, raw[start:]]


def _padded(spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes by (place, span), padded by 256, and whether each place is in use."""
    lengths = np.array([len(s) for s in spans])
    top = int(lengths.max())
    out = np.full((len(spans), top), 256, dtype=np.int64)
    used = np.arange(top)[None, :] < lengths[:, None]
    out[used] = np.frombuffer(b"".join(spans), dtype=np.uint8)
    return out.T.copy(), used.T.copy()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


class Network:
    """Parameters and passes; a direction has input rows for 257 bytes, recurrent weights and a bias."""

    def __init__(self, languages: list[str], hidden: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        small = lambda *shape: rng.normal(0, 0.25, shape).astype(np.float32)
        self.p = {}
        for d in ("f", "b"):
            self.p[f"x{d}"] = small(257, 3 * hidden)
            self.p[f"u{d}"] = small(hidden, 3 * hidden)
        self.p["w"] = small(2 * hidden, len(languages))
        self.p["c"] = np.zeros(len(languages), dtype=np.float32)

    def _scan(self, d: str, codes: np.ndarray, used: np.ndarray, keep: bool):
        """States at every place of one direction; the backward one is given reversed input."""
        n, h = self.hidden, np.zeros((codes.shape[1], self.hidden), dtype=np.float32)
        x, u = self.p[f"x{d}"], self.p[f"u{d}"]
        states, trail = np.empty((*codes.shape, n), dtype=np.float32), []
        for t in range(len(codes)):
            a = x[codes[t]]
            g = h @ u
            zr = _sigmoid(a[:, : 2 * n] + g[:, : 2 * n])
            z, r = zr[:, :n], zr[:, n:]
            candidate = np.tanh(a[:, 2 * n :] + r * g[:, 2 * n :])
            on = used[t][:, None]
            after = np.where(on, candidate + z * (h - candidate), h)
            if keep:
                trail.append((h, z, r, candidate, g[:, 2 * n :], on))
            h = states[t] = after
        return states, trail

    def labels(self, codes: np.ndarray, used: np.ndarray, keep: bool = False):
        """Distributions over the languages at every place."""
        forward, tf = self._scan("f", codes, used, keep)
        backward, tb = self._scan("b", codes[::-1], used[::-1], keep)
        both = np.concatenate([forward, backward[::-1]], axis=2)
        logits = both @ self.p["w"] + self.p["c"]
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        return e / e.sum(axis=2, keepdims=True), both, tf, tb

    def _unroll(self, d: str, codes: np.ndarray, trail: list, d_states: np.ndarray, grad: dict) -> None:
        """Backpropagation through time of one direction."""
        n, u = self.hidden, self.p[f"u{d}"]
        d_next = np.zeros_like(d_states[0])
        for t in range(len(codes) - 1, -1, -1):
            h, z, r, candidate, gn, on = trail[t]
            total = d_states[t] + d_next
            d_h = np.where(on, total, 0)
            d_c = d_h * (1 - z) * (1 - candidate**2)
            d_z = d_h * (h - candidate) * z * (1 - z)
            d_r = d_c * gn * r * (1 - r)
            d_a = np.concatenate([d_z, d_r, d_c], axis=1)
            d_g = np.concatenate([d_z, d_r, d_c * r], axis=1)
            np.add.at(grad[f"x{d}"], codes[t], d_a)
            grad[f"u{d}"] += h.T @ d_g
            d_next = d_h * z + d_g @ u.T + np.where(on, 0, total)

    def gradients(self, codes: np.ndarray, used: np.ndarray, target: np.ndarray) -> tuple[float, dict]:
        """Mean cross entropy over the used places, and its gradient."""
        probabilities, both, tf, tb = self.labels(codes, used, keep=True)
        count = used.sum()
        own = np.take_along_axis(probabilities, np.broadcast_to(target[None, :, None], (*codes.shape, 1)), 2)[..., 0]
        loss = float(-(np.log(own + 1e-9) * used).sum() / count)
        d_logits = probabilities.copy()
        d_logits[:, np.arange(len(target)), target] -= 1
        d_logits *= (used / count)[..., None].astype(np.float32)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["w"] = np.einsum("tni,tnj->ij", both, d_logits, optimize=True)
        grad["c"] = d_logits.sum(axis=(0, 1))
        d_both = d_logits @ self.p["w"].T
        n = self.hidden
        self._unroll("f", codes, tf, d_both[..., :n], grad)
        self._unroll("b", codes[::-1], tb, d_both[::-1, :, n:], grad)
        return loss, grad

    def key(self) -> str:
        """Tells models apart."""
        parts = (self.p[k].tobytes() for k in sorted(self.p))
        return hashlib.sha256(repr(self.languages).encode() + b"".join(parts)).hexdigest()

    def sums(self, spans: list[bytes]) -> np.ndarray:
        """For each span the labels summed over its places, and the number of places."""
        out = np.empty((len(spans), len(self.languages) + 1), dtype=np.float32)
        order = np.argsort([len(s) for s in spans], kind="stable")
        for first in range(0, len(order), 2048):
            at = order[first : first + 2048]
            codes, used = _padded([spans[i] for i in at])
            labels = self.labels(codes, used)[0] * used[..., None]
            out[at, :-1] = labels.sum(axis=0)
            out[at, -1] = used.sum(axis=0)
        return out


def train(examples: list[tuple[str, str]], settings: Settings = Settings()) -> Network | None:
    """A network fitted to (language, text) examples; None without any run of letters."""
    counts: dict[str, Counter] = {}
    for language, text in sorted(examples):
        counts.setdefault(language, Counter()).update(LETTERS.findall(text.lower()))
    languages = sorted(k for k, v in counts.items() if v)
    if not languages:
        return None
    rng = np.random.default_rng(11)
    spans, targets = [], []
    for number, language in enumerate(languages):
        names = sorted(counts[language])
        weight = np.array([counts[language][x] for x in names], dtype=float)
        for i in rng.choice(len(names), settings.runs, p=weight / weight.sum()):
            cut = _spans(names[i], settings.span)
            spans.append(cut[rng.integers(len(cut))])
            targets.append(number)
    network = Network(languages, settings.hidden)
    target = np.array(targets)
    first = {k: np.zeros_like(v) for k, v in network.p.items()}
    second = {k: np.zeros_like(v) for k, v in network.p.items()}
    step = 0
    for _ in range(settings.epochs):
        order = rng.permutation(len(spans))
        for start in range(0, len(order), settings.batch):
            at = order[start : start + settings.batch]
            codes, used = _padded([spans[i] for i in at])
            _, grad = network.gradients(codes, used, target[at])
            step += 1
            for k, g in grad.items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                scale = settings.rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                network.p[k] -= (scale * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return network


class Labeller:
    """Pools the labels of a text's runs; each worker keeps the one of the last model."""

    _kept: tuple[tuple, Labeller] | None = None

    @classmethod
    def of(cls, key: str, network: Network, settings: Settings) -> Labeller:
        """The worker's own labeller, so that what one task has learnt serves the next."""
        if cls._kept is None or cls._kept[0] != (key, settings):
            cls._kept = ((key, settings), cls(network, settings))
        return cls._kept[1]

    def __init__(self, network: Network, settings: Settings):
        self.network, self.settings = network, settings
        self.index: dict[str, int] = {}
        self.table = np.empty((settings.remembered, len(network.languages) + 1), dtype=np.float32)

    def _learn(self, runs: list[str]) -> None:
        parts = [_spans(r, self.settings.span) for r in runs]
        sums = self.network.sums([s for p in parts for s in p])
        if any(len(p) > 1 for p in parts):
            starts = np.cumsum([0, *(len(p) for p in parts[:-1])])
            sums = np.add.reduceat(sums, starts, axis=0)
        if len(self.index) + len(runs) > len(self.table):
            self.index.clear()
            if len(runs) > len(self.table):
                self.table = np.empty((len(runs), self.table.shape[1]), dtype=np.float32)
        at = len(self.index)
        self.table[at : at + len(runs)] = sums
        self.index.update(zip(runs, range(at, at + len(runs)), strict=True))

    def pooled(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """The texts' distributions, None where there is no letter.

        Runs are taken in stretches, of many short texts or of one long one, and what is new in a stretch is learnt at once.
        """
        totals: list[np.ndarray | None] = [None] * len(texts)
        waiting: list[tuple[int, list[str]]] = []
        size = 0
        for number, text in enumerate(texts):
            runs = LETTERS.findall((text or "").lower())
            for first in range(0, len(runs), STRETCH):
                stretch = runs[first : first + STRETCH]
                if size + len(stretch) > STRETCH:
                    self._add(waiting, totals)
                    waiting, size = [], 0
                waiting.append((number, stretch))
                size += len(stretch)
        self._add(waiting, totals)
        return [None if t is None else t[:-1] / t[-1] for t in totals]

    def _add(self, stretches: list[tuple[int, list[str]]], totals: list[np.ndarray | None]) -> None:
        """Add the labels of stretches of runs to their texts' totals."""
        distinct = set().union(*(runs for _, runs in stretches))
        new = distinct.difference(self.index)
        if new:
            self._learn(sorted(new if len(self.index) + len(new) <= len(self.table) else distinct))
        for number, runs in stretches:
            at = np.array(list(map(self.index.__getitem__, runs)))
            found = self.table.take(at, axis=0).sum(axis=0, dtype=np.float64)
            known = totals[number]
            totals[number] = found if known is None else known + found


def training_rows(documents: DataFrame, settings: Settings = Settings()) -> list[tuple[str, str]]:
    """About `sample` (language, text) rows outside the held-out fold, chosen by a hash of the id."""
    usable = documents.where(~base.held_out(F.col("doc_id"))).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = dict(usable.groupBy("lang").count().collect())
    if not counts:
        return []
    quota = max(20, settings.sample // len(counts))
    scale = 1 << 30
    chosen = F.lit(False)
    for language, n in sorted(counts.items()):
        share = F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < min(scale, scale * quota // n)
        chosen = chosen | ((F.col("lang") == language) & share)
    return [(r.lang, r.text) for r in usable.where(chosen).select("lang", "text").toLocalIterator()]


def identify(documents: DataFrame, network: Network | None, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, the predicted language and its pooled probability."""
    shared = documents.sparkSession.sparkContext.broadcast(network)
    key = network.key() if network else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        labeller = Labeller.of(key, network, settings) if network else None
        for b in batches:
            found = labeller.pooled(b.column("text").to_pylist()) if labeller else [None] * b.num_rows
            best = [UNKNOWN if p is None else network.languages[int(p.argmax())] for p in found]
            score = [0.0 if p is None else float(min(1.0, p.max())) for p in found]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(best, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), base.held_out(F.col("doc_id")).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    base.small_batches(spark)
    documents = base.table(spark, sf_dir, "documents")
    return identify(documents, train(training_rows(documents)))
