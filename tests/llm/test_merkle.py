import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import merkle
from tests.conftest import SMALL
from tests.llm.support import documents


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, n_chars):
    def f(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    return h(*map(f, (row["doc_id"], row["source"], row["lang"], n_chars, row["text"])))


def tree(nodes):
    """All levels of nodes, lowest first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def brute_force(rows):
    """The contract row by row: (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["n_chars"]), r))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda x: x[:3])
        trees[lang] = tree([x[2] for x in groups[lang]])
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for place, lang in enumerate(langs):
        for i, (_, _, own, r) in enumerate(groups[lang]):
            seen = own
            if r["doc_id"] is not None and r["n_chars"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0:
                seen = leaf(r, r["n_chars"] + 1)
            proof = []
            for levels, at in ((trees[lang], i), (top, place)):
                for level in levels[:-1]:
                    other = level[at ^ 1] if at ^ 1 < len(level) else ""
                    proof.append(other)
                    seen = h(other, seen) if at & 1 else h(seen, other)
                    at >>= 1
            root = top[-1][0]
            out.append((r["doc_id"], own, trees[lang][-1][0], root, h(*proof), seen, seen == root))
    return sorted(out, key=str)


def found(df, levels):
    return sorted((tuple(r) for r in merkle.manifest(df, merkle.Settings(levels=levels)).collect()), key=str)


def compared(df, levels):
    rows = [r.asDict() for r in df.collect()]
    result = found(df, levels)
    assert result == brute_force(rows)
    return result


@pytest.mark.parametrize("levels", [2, 8])
def test_equals_brute_force_on_a_given_table(spark, levels):
    result = compared(spark.read.parquet(f"{SMALL}/documents.parquet"), levels)
    assert 0 < sum(not r[-1] for r in result) < len(result) / 3


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_languages_of_any_size(spark, levels):
    sizes = {"en": 23, "de": 1, None: 4, "fr": 8, "é": 9, "z": 2}
    rows = [(i, f"text {i}", lang) for lang, n in sizes.items() for i in range(1000 * len(lang or ""), 1000 * len(lang or "") + n)]
    df = documents(spark, [(*r, "s") for r in rows]).repartition(6)
    compared(df, levels)


def test_many_languages_are_cut_into_blocks_too(spark):
    df = documents(spark, [(i, "x", f"l{i % 11:02d}", "s") for i in range(40)])
    compared(df, 1)


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [
        (1, None, "en", "s"), (2, "", "en", "s"), (3, "é\n", None, None), (None, "a", "en", "s"), (None, "b", None, "s"),
        (5, "same", "en", "s"), (5, "same", "en", "s"), (5, "other", "en", "s"), (5, "same", "", "s"),
    ]
    # A third of all rows is alike.
    rows += [(77, "copy", "en", "s")] * 8
    df = documents(spark, rows, leaf="x", root=1, place=2, size=3, row=4, range=5, digest="d", block=9).repartition(5)
    compared(df, 2)


def test_a_tampered_row_without_a_count_stays(spark):
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 0]
    df = documents(spark, [(i, None) for i in ids])
    assert all(r[-1] for r in compared(df, 2))
    assert not any(r[-1] for r in compared(df.withColumn("n_chars", F.lit(3)), 2))


def test_small_and_empty_tables(spark):
    (only,) = found(documents(spark, [(4, "x")]), 8)
    assert only[1] == only[2] == only[3] and only[4] == h() and only[6]
    empty = merkle.manifest(documents(spark, []))
    assert empty.count() == 0 and empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_the_sql_says_the_same(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
        result = con.execute(merkle.ORACLE)
        assert [d[0] for d in result.description] == merkle.manifest(df).columns
        assert sorted(result.fetchall(), key=str) == found(df, 8)


def test_a_version_copies_ancestors_only():
    for n in range(1, 17):
        levels = merkle.height(n)
        t = merkle.PersistentTree([h(str(i)) for i in range(n)], levels)
        before = list(zip(t.digests, t.left, t.right, strict=True))
        tops = [t.version(i, h("changed", str(i))) for i in range(n)]
        # Each version adds the leaf and its ancestors; what was there stays as it was.
        assert len(t.digests) == len(before) + n * (levels + 1)
        assert list(zip(t.digests, t.left, t.right, strict=True))[: len(before)] == before
        for i, top in enumerate(tops):
            plain = [h("changed", str(k)) if k == i else h(str(k)) for k in range(n)]
            assert t.digests[top] == tree(plain)[-1][0]
            assert merkle.climbed(plain[i], i, t.siblings(i)) == t.digests[top]


def test_ranks_span_ranges(spark):
    df = spark.range(500).selectExpr("id", "if(id % 3 = 0, NULL, 'a') AS lang").repartition(7)
    rows = merkle.ranked(df, ["lang"], ["id"], "ranks").collect()
    for lang in (None, "a"):
        own = sorted((r["id"], r["place"], r["size"]) for r in rows if r["lang"] == lang)
        assert [x[1] for x in own] == list(range(len(own))) and {x[2] for x in own} == {len(own)}
