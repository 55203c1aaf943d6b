import math
import random
from collections import Counter

from ledgerloom.llm import decontaminate as dc
from tests.llm.support import documents

ITEMS = "item_id long, text string"


def items(seed=1, n=60):
    rng = random.Random(seed)
    common = ["the", "of", "and", "to"]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else f"w{rng.randint(0, 400)}"
    return [(i, " ".join(word() for _ in range(rng.randint(8, 40))) + ". " + " ".join(word() for _ in range(rng.randint(3, 10))) + ".")
            for i in range(n)]


def scores(rows, passage, s):
    """Normalised BM25 of every item, term by term."""
    found = {i: dc.WORD.findall(t.lower()) for i, t in rows}
    n, average = len(found), sum(map(len, found.values())) / len(found)
    df = Counter(w for ws in found.values() for w in set(ws))
    out = {}
    for i, ws in found.items():
        weight = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (s.k1 + 1)
                  / (c + s.k1 * (1 - s.b + s.b * len(ws) / average)) for w, c in Counter(ws).items()}
        out[i] = sum(v for w, v in weight.items() if w in passage) / sum(weight.values())
    return out


def test_all_items_above_the_threshold_are_retrieved():
    rows, s = items(), dc.Settings(threshold=0.35, block=4)
    index = dc.Index.build(rows, s)
    rng = random.Random(2)
    hits = 0
    for _ in range(120):
        text = [rng.choice(["the", "of", "and", "to", f"w{rng.randint(0, 400)}"]) for _ in range(rng.randint(1, 200))]
        for _, t in rng.sample(rows, rng.randint(0, 3)):
            w = dc.WORD.findall(t.lower())
            text += rng.sample(w, rng.randint(1, len(w)))
        step = index.window // 2
        windows = max(1, -(-len(text) // step) - 1)
        got = {w: (codes, blocks) for w, codes, blocks in index._open_blocks(text, 0, windows, step)}
        for w in range(windows):
            passage = set(text[w * step : w * step + index.window])
            want = {i for i, x in scores(rows, passage, s).items() if x >= s.threshold}
            found = {index.items[i] for i, _ in index.retrieve(*got[w])} if w in got else set()
            assert found == want
            hits += len(want)
    assert hits > 30


def test_planted_items_are_found_and_others_left(spark):
    rows = items(3)
    rng = random.Random(4)
    filler = lambda n: " ".join(rng.choice(["the", "of", f"v{rng.randint(0, 5000)}"]) for _ in range(n))
    docs = [(i, f"{filler(rng.randint(0, 300))}\n{t.upper()}\n{filler(rng.randint(0, 300))}") for i, t in rows]
    docs += [(1000 + i, filler(200)) for i in range(20)]
    docs += [(2000 + i, t.split(". ")[0] + " " + filler(50)) for i, t in rows[:10]]  # questions without answers
    docs += [(3000, None), (3001, ""), (3002, filler(60_000) + " " + rows[0][1])]
    table = spark.createDataFrame([*rows, (77, None), (78, ""), (None, "x y z")], ITEMS)
    got = dc.leaks(documents(spark, docs, item_id=1, score="s"), table)
    found = {(r.doc_id, r.item_id) for r in got.collect()}
    assert found == {(i, i) for i, _ in rows} | {(3002, 0)}
    clean = dc.without_leaks(documents(spark, docs, item_id=1), table)
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in docs} - {i for i, _ in found}
    assert clean.columns[-1] == "item_id"


def test_shards_and_empty_tables(spark):
    rows = items(5, 30)
    docs = documents(spark, [(i, t) for i, t in rows] + [(0, rows[0][1])])
    table = spark.createDataFrame(rows, ITEMS)
    got = sorted((r.doc_id, r.item_id) for r in dc.leaks(docs, table, dc.Settings(shard_items=7)).collect())
    assert got == sorted([(i, i) for i, _ in rows] + [(0, 0)])
    none = spark.createDataFrame([], ITEMS)
    assert dc.leaks(docs, none).count() == 0 and dc.without_leaks(docs, none).count() == 31
    assert dc.leaks(documents(spark, []), table).count() == 0


def test_parts_of_one_or_two_words_are_found(spark):
    rows = items(7, 40) + [
        (100, "what is the capital city of france? Paris."), (101, "who wrote the old song of hills? jane doe."), (102, "why? because light bends over warm sand."),
        (103, "who sings? the tiny brown lark does."), (104, "zebra? Quagga"), (105, "solitary"), (106, "two words"),
    ]
    rng = random.Random(8)
    filler = lambda n: " ".join(f"v{rng.randint(0, 5000)}" for _ in range(n))
    docs = [(i, f"{filler(rng.randint(0, 200))}\n{t}\n{filler(rng.randint(0, 200))}") for i, t in rows]
    # The question without its answer, and an answer's two words apart.
    docs += [(200, rows[40][1].replace("Paris", "Lyon") + filler(90)), (201, rows[41][1].replace("jane doe", "jane x doe") + filler(90))]
    table = spark.createDataFrame(rows, ITEMS)
    found = {(r.doc_id, r.item_id) for r in dc.leaks(documents(spark, docs), table).collect()}
    assert found == {(i, i) for i, _ in rows}
    clean = dc.without_leaks(documents(spark, docs), table)
    assert sorted(r.doc_id for r in clean.collect()) == [200, 201]


def test_results_do_not_depend_on_the_shards(spark):
    rows = items(9, 16)
    rng = random.Random(10)

    def damaged(text):
        return " ".join(w for w in text.split() if rng.random() > 0.25)

    docs = documents(spark, [(i, damaged(rng.choice(rows)[1])) for i in range(150)])
    table = spark.createDataFrame([*rows, (3, rows[3][1]), (50, None), (None, "x y"), (51, "...")], ITEMS)
    found = [
        sorted(map(tuple, dc.leaks(docs, table, dc.Settings(threshold=0.5, question=0.3, answer=0.3, **bound)).collect()))
        for bound in ({"shard_items": 1_024}, {"shard_items": 7}, {"shard_items": 1}, {"shard_words": 90})
    ]
    assert len(found[0]) > 20 and all(f == found[0] for f in found)
