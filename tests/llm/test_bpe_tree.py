import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from ledgerloom.llm import base, bpe_tree
from tests.conftest import SMALL
from tests.llm.support import by_id, documents

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def coder():
    return bpe_tree.Coder(PATH)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return {
        "n_tokens": len(ids), "ids_sha256": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
        "decoded_sha256": hashlib.sha256(back.encode()).hexdigest(),
    }


TEXTS = [
    None, "", " ", "a", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "it's we'll I'd they'Re", " " * 300, "x" * 5000,
    "ab " * 200, "\n" * 100 + "x" + " " * 90, "1" * 130 + "a" * 130 + "!" * 130, "🙂" * 120, "a  b   c    d", "\x00\x01\x1c\x7f" * 50,
    "a՘࢏ b\U00010940 1", "\U0001e5f1 xⅤ", "abracadabra" * 3000, "   x", "﻿x�",
]


def test_equals_the_library_on_given_texts(spark, library):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = by_id(bpe_tree.digests(df, bpe_tree.production()))
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    assert len(found) == len(texts)
    for k, text in texts.items():
        assert {c: found[k][c] for c in ("n_tokens", "ids_sha256", "decoded_sha256")} == expected(library, text)


@pytest.mark.parametrize("limits", [{}, {"remembered": 3, "remembered_length": 2}, {"stretch": 7}])
def test_equals_the_library_on_odd_texts(spark, library, limits):
    base.small_batches(spark, 4)
    df = documents(spark, list(enumerate(TEXTS)), ids="x", n_tokens=1)
    tokenizer = bpe_tree.Tokenizer(PATH, bpe_tree.Settings(**limits))
    found = by_id(bpe_tree.digests(df, tokenizer))
    for k, text in enumerate(TEXTS):
        assert {c: found[k][c] for c in ("n_tokens", "ids_sha256", "decoded_sha256")} == expected(library, text), k
    ids = bpe_tree.encoded(df, tokenizer)
    assert {k: r["ids"] for k, r in by_id(ids).items()} == {
        k: library.encode(t or "", add_special_tokens=False).ids for k, t in enumerate(TEXTS)
    }
    assert {k: r["text"] for k, r in by_id(bpe_tree.decoded(ids, tokenizer)).items()} == {k: t or "" for k, t in enumerate(TEXTS)}


def test_repeated_rows_and_missing_ids_stay(spark):
    df = documents(spark, [(1, "same"), (1, "same"), (None, "x"), (1, "other")])
    found = bpe_tree.digests(df, bpe_tree.production()).collect()
    assert sorted(str(r["doc_id"]) for r in found) == ["1", "1", "1", "None"]
    assert bpe_tree.digests(documents(spark, []), bpe_tree.production()).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_round_trips_and_equals_the_library(library, coder, text):
    ids = coder.encode(text)
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert coder.decode(ids) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=30))
def test_any_ids_decode_as_in_the_library(library, coder, ids):
    assert coder.decode(np.array(ids, dtype=np.uint32)) == library.decode(ids, skip_special_tokens=False)


def plain(symbols, ranks, joined):
    """Merge by looking through all pairs each time."""
    symbols = list(symbols)
    while True:
        found = [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in ranks]
        if not found:
            return symbols
        rank, i = min(found)
        symbols[i : i + 2] = [joined[rank]]


def test_the_tree_merges_as_a_plain_search_does():
    rng = random.Random(5)
    for _ in range(300):
        letters, ranks, joined = rng.randint(1, 3), {}, []
        for k in range(rng.randint(0, 12)):
            pair = (rng.randrange(letters + k), rng.randrange(letters + k))
            if pair not in ranks:
                ranks[pair] = len(joined)
                joined.append(letters + k)
        row = [rng.randrange(letters) for _ in range(rng.randint(0, 40))]
        assert bpe_tree.merged(list(row), ranks, joined) == plain(row, ranks, joined)


def test_the_root_gives_the_leftmost_lowest_rank():
    rng = random.Random(6)
    for n in (1, 2, 3, 7, 8, 33):
        row = [rng.randrange(9) for _ in range(n)]
        tree = bpe_tree.RankTree(list(row), 99)
        for _ in range(200):
            place, row_value = rng.randrange(n), rng.choice([*range(9), 99])
            row[place] = row_value
            tree.set(place, row_value)
            assert tree.least[1] == min(row)
            if min(row) < 99:
                assert tree.leftmost() == row.index(min(row))


def test_other_kinds_of_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe_tree.Coder(P.path("word_bpe_49k.json"))
