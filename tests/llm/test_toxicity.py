import random

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import toxicity as tx
from tests.llm.support import by_id, documents

LABELS = "doc_id long, quality int, toxic int"


def corpus(seed=1, n=400):
    """A quarter is toxic: half of these by listed words, half by words of an unlisted family."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [f"{rng.choice('abcdefgh')}or{rng.choice('klmnop')}e" for _ in range(60)]
        if i % 4 == 0:
            made = ["idiot", "moron", "worthless"] if i % 8 else [f"zorgx{c}" for c in "abcdef"]
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(made)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = documents(spark, rows, toxic=1, score="x", pattern=3)
    model = tx.train(docs, spark.createDataFrame(labels, LABELS))
    got = by_id(tx.score(docs, model))
    assert all(got[i]["predicted"] == int(i % 4 == 0) for i, _ in rows if got[i]["held_out"])
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())


def test_held_out_labels_teach_nothing(spark):
    rows, labels = corpus(2, 200)
    docs = documents(spark, rows)
    table = spark.createDataFrame(labels, LABELS)
    flipped = table.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (tx.labelled_rows(docs, t, tx.Settings()) for t in (table, flipped))
    assert a == b


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(4)
    n = 20_000
    y = rng.random(n) < 0.2
    fire = lambda p1, p0: rng.random(n) < np.where(y, p1, p0)
    a, b, c = fire(0.8, 0.02), fire(0.7, 0.05), fire(0.5, 0.01)
    twin = np.where(rng.random(n) < 0.95, a, fire(0.5, 0.2))  # says what a says
    votes = np.stack([a, b, c, twin], axis=1).astype(int)
    patterns, place = np.unique(votes, axis=0, return_inverse=True)
    counts = np.bincount(place.ravel(), minlength=len(patterns))
    known = np.zeros((len(patterns), 2))
    for i in range(300):
        known[place.ravel()[i], int(y[i])] += 1
    model = tx.fit_label_model(patterns, counts, known, tx.Settings())
    assert model.parents[3] == 0 or model.parents[0] == 3
    for j, (on_toxic, on_clean) in enumerate(model.accuracies(patterns, counts.astype(float))[:3]):
        assert abs(on_toxic - (0.8, 0.7, 0.5)[j]) < 0.1 and abs(on_clean - (0.02, 0.05, 0.01)[j]) < 0.05
    guess = model.posterior(votes) >= 0.5
    assert (guess == y).mean() > 0.93


def test_edge_cases(spark):
    rows, labels = corpus(3, 80)
    rows += [(500, None), (501, ""), (502, "idiot " * 50_000), (503, "WORDS!! " * 10), (None, "idiot moron")]
    docs = documents(spark, [*rows, rows[0]])
    labels += [(0, 1, 0), (500, 1, None), (None, 1, 1)]
    got = tx.score(docs, tx.train(docs, spark.createDataFrame(labels, LABELS))).collect()
    assert len(got) == len(rows) + 1
    scores = {r.doc_id: r.score for r in got}
    assert abs(scores[500] - scores[501]) < 1e-12 and scores[500] < 0.5 <= scores[502]
    none = spark.createDataFrame([], LABELS)
    unlabelled = {r.doc_id: r.predicted for r in tx.score(docs, tx.train(docs, none)).collect()}
    assert unlabelled[502] == 1 and unlabelled[1] == 0
    empty = documents(spark, [])
    assert tx.score(empty, tx.train(empty, none)).count() == 0
