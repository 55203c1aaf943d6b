import random
import re

from ledgerloom.llm import license_scans as ls
from tests.llm.support import by_id, documents

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def base_figures(text):
    w = WORDS.findall(lowered(text))
    at, labels = [], set()
    for phrase, label in ls.BASE:
        p = phrase.split()
        found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return {
        "n_words": len(w), "n_base": len(at), "first_word": min(at, default=None), "last_word": max(at, default=None),
        "base_labels": ",".join(sorted(labels)),
    }


def test_base_figures_equal_brute_force(spark):
    rng = random.Random(9)
    parts = ["MIT", "mit", "License", "license", "apache", "general", "public", "x", "É", "mitt", "licenses"]
    texts = [None, "", " ", "...", "MIT License", "mit\nlicense mit license", "MIT-LICENSE;apache/license",
             "mitlicense", "mit licenseé", "émit license", "mit " * 20_000 + "license", "MIT license " * 3000]
    texts += ["".join(rng.choice(parts) + rng.choice([" ", ". ", "\n", "", "-"]) for _ in range(rng.randint(1, 60)))
              for _ in range(150)]
    got = by_id(ls.scan(documents(spark, list(enumerate(texts)), words="x", line=1, label="y", w="z")))
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        expected = base_figures(text)
        assert {k: got[i][k] for k in expected} == expected, text and text[:80]
        assert set(filter(None, expected["base_labels"].split(","))) <= set(got[i]["labels"].split(","))
        assert 0 <= got[i]["score"] <= 1


def test_notices_are_found_in_place(spark):
    notices = {i: notice for i, (_, notice, _) in enumerate(ls.TEMPLATES)}
    rows = [(i, f"Some words first.\n{n.upper()}.\nAnd after.") for i, n in notices.items()]
    rows += [
        (100, "the software was granted without restriction, a copy of documentation for any person"),
        (101, "Redistribution and use, in source and binary forms, with or WITHOUT modification, are permitted provided that the following..."),
        (102, "permitted are modification without or with forms binary and source in use and redistribution"),
    ]
    got = by_id(ls.scan(documents(spark, rows)))
    for i in notices:
        assert ls.TEMPLATES[i][0] in got[i]["labels"].split(","), notices[i]
        assert got[i]["score"] > 0.9
    assert got[100]["labels"] == "" and got[102]["labels"] == ""
    assert got[101]["labels"] == "bsd"


def test_repeated_rows_ids_and_empty_table(spark):
    rows = [(1, "MIT License"), (1, "MIT License"), (1, "other"), (None, "released under the mit license")]
    got = sorted(((str(r.doc_id), r.labels) for r in ls.scan(documents(spark, rows)).collect()))
    assert got == [("1", ""), ("1", "mit"), ("1", "mit"), ("None", "mit")]
    assert ls.scan(documents(spark, [])).count() == 0


def test_plan_has_no_python_and_no_pairing(spark):
    plan = ls.scan(documents(spark, [(1, "mit license")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_a_file_of_many_notices_gets_every_label(spark):
    text = "\n\n".join(f"Part {i}. {notice}." for i, (_, notice, _) in enumerate(ls.TEMPLATES))
    found = by_id(ls.scan(documents(spark, [(1, text), (2, text * 50)])))
    for i in (1, 2):
        assert {label for label, _, _ in ls.TEMPLATES} <= set(found[i]["labels"].split(","))
