import random
import re
from collections import Counter

from ledgerloom.llm import quality_rules as qr
from tests.llm.support import by_id, documents

BLANK = r"[\x20\x09-\x0D]+"


def words(text):
    return [w for w in re.split(BLANK, text or "") if w]


def base_figures(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "base_failed": len(w) < 50 or len(covered) * 100 > len(w) * 50,
    }


def made(rng, n, vocabulary="abcdefgh"):
    return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\n", "\t", "\x0b", " # ", "é "]) for _ in range(n))


def test_base_figures_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t ", "a", "a b", "a b c", "a a a a a", "x\u00a0y z", "日本 語\n日本 語\n", "w " * 30_000]
    texts += [made(rng, rng.randint(1, 200)) for _ in range(60)]
    texts += [" ".join(f"w{i}" for i in range(n)) for n in (49, 50, 51, 3000)]
    got = by_id(qr.judge(documents(spark, list(enumerate(texts)), words="x", lines=1, h=2)))
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        expected = base_figures(text)
        assert {k: got[i][k] for k in expected} == expected, text and text[:50]


def _body(rng, n=70):
    return " ".join(f"w{rng.randint(0, 10**9)}" for _ in range(n))


def test_shared_lines_are_removed_and_depleted_documents_rejected(spark):
    rng = random.Random(1)
    banner = _body(rng, 60)
    rows = [(i, banner + "\n" + _body(rng, 70 if i else 10)) for i in range(30)]
    rows += [(100 + i, _body(rng), None, "src1") for i in range(5)]
    got = by_id(qr.judge(documents(spark, rows)))
    assert got[0]["words_removed"] == 60 and not got[0]["kept"] and not got[0]["base_failed"]
    assert all(got[i]["words_removed"] == 60 and got[i]["kept"] for i in range(1, 30))
    assert all(got[100 + i]["kept"] and got[100 + i]["words_removed"] == 0 for i in range(5))


def test_lines_that_stand_together_are_counted_by_documents(spark):
    """A menu of twenty lines, a header with a footer: every document counts, not each distinct set of shared lines."""
    rng = random.Random(6)
    menu, frame = [_body(rng, 3) for _ in range(20)], [_body(rng, 40) for _ in range(3)]
    rows = [(i, "\n".join([*menu, _body(rng, 15)]), None, "menu") for i in range(60)]
    rows += [(100 + i, "\n".join([*frame[:2], _body(rng, 30), frame[2]]), None, "frame") for i in range(60)]
    rows += [(200 + i, "\n".join([*menu, _body(rng, 90)]), None, "menu") for i in range(10)]
    got = by_id(qr.judge(documents(spark, rows)))
    assert all(got[i]["words_removed"] == 60 and not got[i]["kept"] and not got[i]["base_failed"] for i in range(60))
    assert all(got[i]["words_removed"] == 120 and not got[i]["kept"] for i in range(100, 160))
    assert all(got[i]["words_removed"] == 60 and got[i]["kept"] for i in range(200, 210))


def test_copies_are_no_evidence(spark):
    """Sixty copies of one document, some with one changed line, lose nothing."""
    rng = random.Random(2)
    lines = [_body(rng, 20) for _ in range(12)]
    rows = [(i, "\n".join(lines)) for i in range(40)]
    rows += [(100 + i, "\n".join([*lines[:5], _body(rng, 20), *lines[6:]])) for i in range(20)]
    got = by_id(qr.judge(documents(spark, rows)))
    assert all(r["kept"] and r["words_removed"] == 0 for r in got.values())


def test_copies_do_not_raise_the_share(spark):
    """A banner in 20 documents, beside 400 copies of another one."""
    rng = random.Random(7)
    banner, copied = _body(rng, 5), _body(rng)
    rows = [(i, f"{banner}\n{_body(rng)}") for i in range(20)] + [(100 + i, copied) for i in range(400)]
    got = by_id(qr.judge(documents(spark, rows)))
    assert all(got[i]["words_removed"] == 5 for i in range(20))
    assert all(got[100 + i]["words_removed"] == 0 for i in range(400))


def test_limits_are_per_host_and_normalised(spark):
    rng = random.Random(3)
    rows = [(i, f"Big   BANNER {'x' * 3}\n{_body(rng)}", None, "a") for i in range(15)]
    rows += [(50 + i, f"big banner xxx\n{_body(rng)}", None, None) for i in range(5)]
    got = by_id(qr.judge(documents(spark, rows)))
    assert all(got[i]["words_removed"] == 3 for i in range(15))
    assert all(got[50 + i]["words_removed"] == 0 for i in range(5))


def test_passing_keeps_columns_and_repeated_rows(spark):
    rng = random.Random(4)
    good = _body(rng)
    rows = [(1, good), (1, good), (2, "short"), (3, None), (None, good + " z")]
    kept = qr.passing(documents(spark, rows, kept="clash", row_key=1))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept", "row_key"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "None"]
    assert qr.passing(documents(spark, [])).count() == 0


def test_frequent_lines_leave_the_texts_of_the_quality_stage(spark):
    import corpus_pipeline

    rng = random.Random(8)
    own = [_body(rng) for _ in range(30)]
    text = lambda i: f"Big  Banner\n\n{own[i][:200]}\n big banner\t\n{own[i][200:]}"
    rows = [(i, text(i)) for i in range(30)] + [(0, text(0)), (None, text(1)), (50, "short"), (51, None), (60, f"{own[0]} z", None, "src1")]
    docs = documents(spark, rows, kept="clash", row_key=1)
    out = corpus_pipeline.quality(spark, docs, "")
    assert out.columns == docs.columns
    left = [(i, f"\n{t[:200]}\n{t[200:]}") for i, t in [*enumerate(own), (0, own[0]), (None, own[1])]] + [(60, f"{own[0]} z")]
    assert sorted((str(r.doc_id), r.text, r.n_chars) for r in out.collect()) == sorted((str(i), t, len(t)) for i, t in left)


def test_plan_has_no_python_and_no_pairing(spark):
    plan = qr.judge(documents(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
