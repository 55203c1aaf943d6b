import random
import re
from itertools import combinations

import numpy as np
import pytest

from ledgerloom.llm import minhash_dedup as md
from ledgerloom.llm.components import components
from tests.llm.support import by_id, documents


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def expected(rows, width=4):
    """Sizes and components by comparing all pairs."""
    sets = {i: shingles(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sets, 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    return {i: (len(sets[i]), top(i), top(i) == i) for i in sets}


def result(df):
    return {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in by_id(df).items()}


def edited(rng, words, share):
    return [f"e{rng.randint(0, 10**6)}" if rng.random() < share else w for w in words]


def corpus(seed, groups=12, copies=8):
    rng = random.Random(seed)
    texts = [None, "", " \n", "a", "A", "a b c", "A  b\tC", "a b c d", "a b c d e", "É b c d", "é b c d", "x " * 3000]
    for _ in range(groups):
        words = [f"w{rng.randint(0, 500)}" for _ in range(rng.randint(5, 150))]
        texts += [" ".join(edited(rng, words, rng.choice([0, 0.005, 0.02, 0.04]))) for _ in range(copies)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    rows = corpus(seed)
    df = documents(spark, rows, node=1, key="k", label="x", id=2, text_hash=7)
    assert result(md.deduplicate(df, md.CONTRACT)) == expected(rows)


def test_group_of_near_copies_with_many_apart(spark):
    """Copies edited so much that only some pairs are linked: components need pairs of one bucket."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(edited(rng, words, rng.choice([0.01, 0.03, 0.05])))) for i in range(160)]
    assert result(md.deduplicate(documents(spark, rows), md.CONTRACT)) == expected(rows)


def test_bounds_never_lose_a_link():
    rng = random.Random(3)
    made = md.Shingler.of(md.CONTRACT)
    missed = 0
    for _ in range(300):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(4, 400))]
        a, b = made.shingles(" ".join(words)), made.shingles(" ".join(edited(rng, words, 0.02)))
        if made.similar(a, b):
            bits = sum(int(x).bit_count() for x in (made.parity(a) ^ made.parity(b)).view(np.uint64))
            assert bits * 180 <= (len(a) + len(b)) * 20
            missed += int((made.signature(a) != made.signature(b)).sum() > md.CONTRACT.distance)
    assert missed == 0


def test_pairs_within_the_distance_share_a_key(spark):
    s = md.Settings()
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 16, s.symbols, dtype=np.uint16)
    rows = [(0, a.view(np.int64).tolist())]
    for i in range(1, 40):
        b = a.copy()
        at = rng.choice(s.symbols, s.distance, replace=False)
        b[at] ^= np.uint16(1)
        rows.append((i, b.view(np.int64).tolist()))
    keys = {}
    for r in md.keyed(spark.createDataFrame(rows, "node long, signature array<long>"), s).collect():
        keys.setdefault(r.node, set()).add(r.key)
    assert all(keys[0] & keys[i] for i in range(1, 40))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 150)] + [(-5, 200), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 150)} | {200: -5}


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(50))
    other = " ".join(f"v{i}" for i in range(50))
    rows = [(5, text), (5, text), (3, text + " z"), (None, text), (None, other), (8, None), (8, None), (9, "")]
    got = sorted(((str(r.doc_id), r.component_id, r.kept) for r in md.deduplicate(documents(spark, rows)).collect()), key=str)
    assert got == sorted([("5", 3, False), ("5", 3, False), ("3", 3, True), ("None", 3, False), ("None", None, True),
                          ("8", 8, True), ("8", 8, True), ("9", 9, True)], key=str)
    kept = md.representatives(documents(spark, rows, k=1, d=2))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "8", "9", "None"]
    assert kept.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert md.deduplicate(documents(spark, [])).count() == 0
