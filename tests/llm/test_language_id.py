import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import language_id as li
from tests.conftest import SMALL
from tests.llm.support import by_id, documents

FAST = li.Settings(sample=400, runs=1_500, epochs=3)


def test_gradients_equal_differences():
    net = li.Network(["a", "b"], hidden=3, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    codes, used = li._padded([b" ab ", b" c", b" defg"])
    target = np.array([0, 1, 1])
    _, grad = net.gradients(codes, used, target)
    rng = np.random.default_rng(0)
    for name, g in grad.items():
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in g.shape)
            if name[0] == "x":
                at = (int(codes[0, 0]), at[1])
            old = net.p[name][at]
            net.p[name][at] = old + 1e-3
            up = net.gradients(codes, used, target)[0]
            net.p[name][at] = old - 1e-3
            down = net.gradients(codes, used, target)[0]
            net.p[name][at] = old
            assert g[at] == pytest.approx((up - down) / 2e-3, abs=2e-4)


@pytest.fixture(scope="module")
def network(spark):
    return li.train(li.training_rows(spark.read.parquet(f"{SMALL}/documents.parquet"), FAST), FAST)


def test_held_out_accuracy(spark, network):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = li.identify(docs, network, FAST).join(docs.select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").collect()
    assert len(held) > 20 and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in held)


def test_edge_texts(spark, network):
    rows = [(1, None), (2, ""), (3, "123 ### 4"), (4, "the thing and the other"), (5, "ñ" * 50_000), (6, "x " * 100_000),
            (7, "日本語"), (4, "the thing and the other"), (None, "the thing")]
    got = li.identify(documents(spark, rows, score=1, held_out="x"), network, FAST).collect()
    assert len(got) == len(rows)
    undecided = {r.doc_id for r in got if r.lang_pred == "und"}
    assert undecided == {1, 2, 3} and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert {r.lang_pred for r in got} - {"und"} <= set(network.languages)


def test_remembering_does_not_change_labels(network):
    texts = ["alpha beta gamma delta " * 3, "eins zwei drei vier", "alpha zwei gamma"]
    plain = li.Labeller(network, li.Settings(remembered=1000)).pooled(texts)
    tight = li.Labeller(network, li.Settings(remembered=3)).pooled(texts)
    for a, b in zip(plain, tight, strict=True):
        assert np.allclose(a, b, atol=1e-5)


def test_held_out_rows_and_null_languages_teach_nothing(spark):
    docs = documents(spark, [(i, f"text {i}", "en" if i % 2 else None) for i in range(100)])
    held = {r.doc_id for r in docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()}
    taught = {int(t.split()[1]) for _, t in li.training_rows(docs)}
    assert taught and not taught & held and all(i % 2 for i in taught)
    assert li.train([]) is None and li.training_rows(documents(spark, [])) == []
    assert li.identify(docs, None).where("lang_pred <> 'und' or score <> 0").count() == 0


def test_long_runs_are_cut_between_characters():
    for run in ("a" * 100, "ñ" * 40, "日本語" * 30, "x🙂é" * 20, "a", "é" * 11 + "b"):
        for span in (4, 5, 24):
            cut = li._spans(run, span)
            assert b"".join(cut) == b" " + run.encode() + b" "
            assert all(0 < len(c) <= span and c.decode() for c in cut)


def test_a_worker_keeps_what_it_has_learnt_for_the_same_model(network):
    key = network.key()
    kept = li.Labeller.of(key, network, FAST)
    kept.pooled(["alpha beta"])
    assert li.Labeller.of(key, network, FAST) is kept and "alpha" in kept.index
    other = li.Network(network.languages, network.hidden, seed=8)
    assert other.key() != key and li.Labeller.of(other.key(), other, FAST) is not kept


def test_languages_that_tie_go_by_name(spark):
    net = li.Network(["aa", "bb"], hidden=2)
    net.p = {k: np.zeros_like(v) for k, v in net.p.items()}
    (row,) = li.identify(documents(spark, [(1, "word")]), net, FAST).collect()
    assert row.lang_pred == "aa" and row.score == pytest.approx(0.5)


def test_an_empty_table(spark, network):
    assert li.identify(documents(spark, []), network, FAST).count() == 0
