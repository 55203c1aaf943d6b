"""Toxicity by weak supervision: a generative label model over many voters, and a linear classifier on its labels.

**Voters.** Each fires or not on a text: fixed word lists, word and word-beginning lists mined from labelled rows, and
patterns (shouting, exclamations, several listed words). None is trusted by itself.

**Label model.** For a hidden label, each voter has a chance of firing that depends on the label and on one other
voter, its parent in a tree over the voters of greatest dependence: so accuracies and correlations are both
estimated, and two lists with the same words do not count twice. Expectation maximisation runs
over the counts of vote patterns of *all* documents, at most two to the number of voters, with labelled rows as
known cases.

**Classifier.** Logistic regression over voters and single words and beginnings, fitted to the model's
posterior labels on a bounded sample, scores every text.

Learning sees labels only of rows whose id's checksum is not divisible by the folds; `sample` bounds the labelled rows
of each class and the unlabelled rows that are gathered on the driver, chosen by a hash of the id.

How it spreads: counting votes and scoring are passes over the documents where they are read; only pattern counts are shuffled,
added up before that.

Defined cases: NULL and empty texts have no votes and get a score like any text without a listed word; without labelled rows the fixed lists
alone stand for known cases; several labels of one id count by the greatest; repeated rows are scored alike; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import base

LETTERS = re.compile(r"[^\W\d_]+")
# Listed words by kind.
LISTS = {
    "insults": "idiot idiots moron morons imbecile fool loser losers clown dumbass jerk scumbag cretin dimwit halfwit",
    "contempt": "stupid dumb pathetic worthless disgusting scum trash garbage filth vermin lowlife useless ugly vile",
    "abuse": "bastard bitch asshole shit fuck fucking damn crap whore slut prick dickhead",
    "threats": "kill murder strangle hang shoot stab destroy exterminate",
    "others": "idiota imbécil estúpido estúpida basura asqueroso patético inútil payaso dummkopf idiotin trottel abschaum "
              "widerlich wertlos erbärmlich müll connard imbécile crétin ordure minable dégoûtant pathétique débile",
}


@dataclass(frozen=True)
class Settings:
    """Production parameters; `sample` bounds each class of labelled rows, and the unlabelled rows, that training gathers."""

    sample: int = 3_000
    #: Chance, over all tried words, that a mined word is there by accident.
    accident: float = 0.05
    features: int = 4_000
    rounds: int = 30
    steps: int = 150
    penalty: float = 1e-3
    remembered: int = 300_000


def parts_of(word: str) -> list[str]:
    """The word and its beginnings of four to six letters, marked by a star."""
    return [word, *(word[:n] + "*" for n in (4, 5, 6) if len(word) > n)]


def _log_chance(with_toxic: int, with_clean: int, share: float) -> float:
    """Log of the chance that so many of a word's documents are toxic by accident, the largest term of it."""
    n = with_toxic + with_clean
    choose = math.lgamma(n + 1) - math.lgamma(with_toxic + 1) - math.lgamma(with_clean + 1)
    return choose + with_toxic * math.log(share) + with_clean * math.log1p(-share)


def mine(rows: list[tuple[str, int]], settings: Settings) -> tuple[list[set[str]], list[str]]:
    """Lists of words and beginnings that go with toxic rows, in four voters; and features worth a weight."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    totals = [0, 0]
    for text, toxic in rows:
        totals[toxic] += 1
        counts[toxic].update({p for w in set(LETTERS.findall(text.lower())) for p in parts_of(w)})
    lists: list[set[str]] = [set(), set(), set(), set()]
    if not all(totals):
        return lists, []
    share = totals[1] / sum(totals)
    usable = [p for p, c in counts[1].items() if c + counts[0][p] >= 3]
    bound = math.log(settings.accident / max(1, len(usable)))
    scored = []
    for p in usable:
        a, b = counts[1][p], counts[0][p]
        if a / totals[1] > 4 * b / totals[0]:
            chance = _log_chance(a, b, share)
            scored.append((chance, p))
            if chance < bound:
                # Words and beginnings, each dealt to two voters by their letters.
                lists[2 * p.endswith("*") + sum(map(ord, p)) % 2].add(p)
    scored.sort()
    return lists, [p for chance, p in scored[: settings.features] if chance < math.log(0.01)]


class _Codes(dict):
    """For each word a code of what it says, 0 for nothing; remembered within a bound."""

    def __init__(self, votes: dict[str, int], weights: dict[str, int], bound: int):
        super().__init__()
        self.votes, self.weights, self.bound = votes, weights, bound
        self.meanings: list[tuple[int, frozenset[int]]] = [(0, frozenset())]
        self.numbers = {self.meanings[0]: 0}

    def __missing__(self, word: str) -> int:
        mask, own = 0, []
        for p in parts_of(word):
            mask |= self.votes.get(p, 0)
            if (f := self.weights.get(p)) is not None:
                own.append(f)
        meaning = (mask, frozenset(own))
        code = self.numbers.get(meaning)
        if code is None:
            code = self.numbers[meaning] = len(self.meanings)
            self.meanings.append(meaning)
        if len(self) >= self.bound:
            self.clear()
        self[word] = code
        return code


class Voters:
    """The voters and single features; `read` gives a text's vote pattern and features."""

    PATTERNS = ("several", "dense", "shouting", "exclaiming")

    def __init__(self, mined: list[set[str]], features: list[str], settings: Settings):
        lists = [set(v.split()) for v in LISTS.values()] + mined
        self.names = [*LISTS, "mined words a", "mined words b", "mined beginnings a", "mined beginnings b", *self.PATTERNS]
        self.fixed = len(LISTS)
        self.listed = len(lists)
        votes: dict[str, int] = {}
        for number, words in enumerate(lists):
            for w in words:
                votes[w] = votes.get(w, 0) | 1 << number
        self.votes, self.features, self.settings = votes, {p: i for i, p in enumerate(features)}, settings
        self._codes: _Codes | None = None

    def __getstate__(self):
        return self.__dict__ | {"_codes": None}

    def read(self, text: str | None) -> tuple[int, set[int]]:
        if self._codes is None:
            self._codes = _Codes(self.votes, self.features, self.settings.remembered)
        raw = text or ""
        words = LETTERS.findall(raw.lower())
        counts = Counter(map(self._codes.__getitem__, words))
        pattern, features, hits, kinds = 0, set(), 0, 0
        for code, n in counts.items():
            if code:
                mask, own = self._codes.meanings[code]
                pattern |= mask
                features |= own
                if mask:
                    hits += n
                    kinds += 1
        big = sum(map(str.isupper, raw))
        flags = (kinds >= 2, 100 * hits >= len(words) > 0, 2 * big > len(raw), raw.count("!!") >= 3)
        for i, flag in enumerate(flags):
            pattern |= flag << (self.listed + i)
        return pattern, features


@dataclass
class LabelModel:
    """Chance of each voter to fire by label and by whether its parent fires, and the share of toxic rows."""

    share: float
    parents: list[int]
    #: [voter, label, parent fires]
    fires: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of the label toxic for rows of 0/1 votes."""
        logs = np.zeros((2, len(patterns)))
        for label in (0, 1):
            logs[label] = math.log(self.share if label else 1 - self.share)
            for j, parent in enumerate(self.parents):
                at = patterns[:, parent] if parent >= 0 else np.zeros(len(patterns), dtype=int)
                p = self.fires[j, label, at]
                logs[label] += np.log(np.where(patterns[:, j] == 1, p, 1 - p))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))

    def accuracies(self, patterns: np.ndarray, weight: np.ndarray) -> list[tuple[float, float]]:
        """Per voter, its chance of firing on toxic and on clean rows."""
        q = self.posterior(patterns)
        return [
            (float((weight * q * v).sum() / max(1e-9, (weight * q).sum())),
             float((weight * (1 - q) * v).sum() / max(1e-9, (weight * (1 - q)).sum())))
            for v in patterns.T
        ]


def _tree(patterns: np.ndarray, weight: np.ndarray, q: np.ndarray) -> list[int]:
    """Each voter's parent (-1: none) in the spanning forest of greatest dependence given the label."""
    m = patterns.shape[1]
    gain = np.zeros((m, m))
    for label_weight in (weight * q, weight * (1 - q)):
        total = label_weight.sum() + 1e-9
        for i in range(m):
            for j in range(i):
                for a in (0, 1):
                    for b in (0, 1):
                        both = label_weight[(patterns[:, i] == a) & (patterns[:, j] == b)].sum() / total
                        pa_ = label_weight[patterns[:, i] == a].sum() / total
                        pb = label_weight[patterns[:, j] == b].sum() / total
                        if both > 0:
                            gain[i, j] += total / weight.sum() * both * math.log(both / (pa_ * pb))
    gain += gain.T
    parents, inside = [-1] * m, {0}
    while len(inside) < m:
        best = max(((gain[i, j], -i, -j) for i in inside for j in range(m) if j not in inside))
        child = -best[2]
        parents[child] = -best[1] if best[0] > 1e-4 else -1
        inside.add(child)
    return parents


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, known: np.ndarray, settings: Settings) -> LabelModel:
    """EM over distinct vote patterns. counts: rows of unknown label; known: [pattern, label] rows of known label."""
    unknown = counts.astype(float)
    anchor = known.astype(float)
    if anchor.sum():
        # Known cases weigh as much as all others together, so that the classes keep their meaning.
        anchor *= max(1.0, unknown.sum() / anchor.sum())
    weight = np.concatenate([unknown, anchor[:, 0], anchor[:, 1]])
    rows = np.concatenate([patterns, patterns, patterns])
    n = len(patterns)
    q = np.concatenate([np.full(n, 0.5), np.zeros(n), np.ones(n)])
    total = anchor.sum(axis=1)
    start = (anchor[:, 1] + 0.01) / (total + 0.02)
    any_listed = patterns.any(axis=1)
    q[:n] = np.where(total > 0, start, np.where(any_listed, 0.5, 0.02))
    model = None
    for _ in range(settings.rounds):
        parents = _tree(rows, weight, q) if model is None else model.parents
        fires = np.empty((patterns.shape[1], 2, 2))
        for j, parent in enumerate(parents):
            at = rows[:, parent] if parent >= 0 else np.zeros(len(rows), dtype=int)
            for label, w in ((0, weight * (1 - q)), (1, weight * q)):
                for state in (0, 1):
                    own = w * (at == state)
                    fires[j, label, state] = (own[rows[:, j] == 1].sum() + 0.05) / (own.sum() + 1.0)
        share = float(np.clip((weight * q).sum() / weight.sum(), 1e-4, 0.9))
        model = LabelModel(share, list(parents), np.clip(fires, 1e-4, 1 - 1e-4))
        q[:n] = model.posterior(patterns)
    return model


def bits(patterns: list[int], count: int) -> np.ndarray:
    return np.array([[p >> j & 1 for j in range(count)] for p in patterns], dtype=int).reshape(-1, count)


@dataclass
class Classifier:
    """Logistic regression over votes and single features."""

    voters: Voters
    bias: float
    vote_weights: np.ndarray
    weights: np.ndarray

    def score(self, text: str | None) -> float:
        pattern, features = self.voters.read(text)
        x = self.bias + sum(w for j, w in enumerate(self.vote_weights) if pattern >> j & 1) + sum(self.weights[f] for f in features)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def fit_classifier(voters: Voters, rows: list[tuple[int, set[int]]], target: np.ndarray, settings: Settings) -> Classifier:
    """Weights by gradient descent with momentum on cross entropy with soft targets."""
    votes = len(voters.names)
    flat = [([j for j in range(votes) if p >> j & 1] + [votes + f for f in sorted(own)]) for p, own in rows]
    at = np.array([i for x in flat for i in x], dtype=np.int64)
    row = np.repeat(np.arange(len(flat)), [len(x) for x in flat])
    size = votes + len(voters.features)
    w, b = np.zeros(size), 0.0
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, settings.steps + 1):
        x = np.bincount(row, weights=w[at], minlength=len(flat)) + b
        error = (1 / (1 + np.exp(-np.clip(x, -60, 60))) - target) / max(1, len(flat))
        g = np.append(np.bincount(at, weights=error[row], minlength=size) + settings.penalty * w / max(1, len(flat)) ** 0.5, error.sum())
        first = 0.9 * first + 0.1 * g
        second = 0.99 * second + 0.01 * g * g
        move = 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return Classifier(voters, float(b), w[:votes], w[votes:])


def _share(column, quota: int, total: int):
    scale = 1 << 30
    return F.pmod(F.xxhash64(column), F.lit(scale)) < min(scale, scale * quota // max(1, total))


def labelled_rows(documents: DataFrame, labels: DataFrame, settings: Settings) -> list[tuple[str, int]]:
    """(text, label) of about `sample` rows of each class outside the held-out fold."""
    spark = documents.sparkSession
    usable = (
        labels.where(~base.held_out(F.col("doc_id"))).where("toxic IS NOT NULL")
        .groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    )
    totals = dict(usable.groupBy("toxic").count().collect())
    chosen = F.lit(False)
    for label, total in totals.items():
        chosen = chosen | ((F.col("toxic") == label) & _share("doc_id", settings.sample, total))
    # A bounded number of ids: the documents are filtered where they are read.
    ids = spark.createDataFrame([tuple(r) for r in usable.where(chosen).collect()], "doc_id long, toxic int")
    rows = documents.select("doc_id", base.text_of().alias("text")).join(F.broadcast(ids), "doc_id")
    return sorted((r.text, r.toxic) for r in rows.select("text", "toxic").toLocalIterator())


def train(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Classifier:
    known = labelled_rows(documents, labels, settings)
    voters = Voters(*mine(known, settings), settings)
    count = len(voters.names)

    total, seen = 0, Counter()
    for r in vote_patterns(documents, voters).groupBy("pattern").count().toLocalIterator():
        seen[r["pattern"]] += r["count"]
        total += r["count"]
    usable = documents.where(~base.held_out(F.col("doc_id"))).where(_share("doc_id", settings.sample, total))
    others = sorted(r.text for r in usable.select(base.text_of().alias("text")).toLocalIterator())

    read_known, read_others = [voters.read(t) for t, _ in known], [voters.read(t) for t in others]
    patterns = sorted({*seen, *(p for p, _ in read_known), 0})
    place = {p: i for i, p in enumerate(patterns)}
    anchors = np.zeros((len(patterns), 2))
    for (p, _), (_, label) in zip(read_known, known, strict=True):
        anchors[place[p], label] += 1
    if not known:
        for p, i in place.items():
            anchors[i, int((p & ((1 << voters.fixed) - 1)).bit_count() >= 1)] += 1
    votes = bits(patterns, count)
    model = fit_label_model(votes, np.array([seen[p] for p in patterns]), anchors, settings)
    posterior = dict(zip(patterns, model.posterior(votes), strict=True))
    # A labelled row's posterior is its label.
    target = [float(label) for _, label in known] + [posterior.get(p, posterior[0]) for p, _ in read_others]
    return fit_classifier(voters, read_known + read_others, np.array(target), settings)


def vote_patterns(documents: DataFrame, voters: Voters) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = shared.value.read
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([read(t)[0] for t in b.column(0).to_pylist()], pa.int64())], names=["pattern"])

    return documents.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "pattern long")


def score(documents: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, held_out, the probability of label 1 and the predicted label."""
    shared = documents.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.score(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(found, pa.float64()),
                 pa.array([int(s >= 0.5) for s in found], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), base.held_out(F.col("doc_id")).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    base.small_batches(spark)
    documents = base.table(spark, sf_dir, "documents")
    return score(documents, train(documents, base.table(spark, sf_dir, "labels")))
