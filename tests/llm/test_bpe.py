import hashlib
import random

import numpy as np
import pytest

from ledgerloom.llm import bpe
from tests.llm.support import by_id, documents

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def expected(library, text):
    ids = np.array(library.encode_ordinary(text or ""), dtype="<u4").tobytes()
    return {
        "n_tokens": len(ids) // 4, "ids_sha256": hashlib.sha256(ids).hexdigest(),
        "decoded_sha256": hashlib.sha256((text or "").encode()).hexdigest(),
    }


def made(rng, n):
    kinds = ["hello", " world", "  ", "\n", "\n\n", "123", "!!", "'s", "'", "é", "日本語", "🙂", "\u00a0", "x" * 9, "\t", " 's"]
    return "".join(rng.choice(kinds) for _ in range(n))


TEXTS = [
    None, "", " ", "a", "<|endoftext|>", "it's we'll I'd", " " * 300, "x" * 500, "ab " * 200, "\n" * 100 + "x" + " " * 90,
    "1" * 130 + "a" * 130 + "!" * 130, "🙂" * 120, "a  b   c    d", "\x00\x01\x7f" * 50,
]


@pytest.mark.parametrize("chunk,overlap", [(40, 8), (64, 32), (17, 17), (32_768, 512)])
def test_equals_the_library_and_decodes(spark, library, chunk, overlap):
    rng = random.Random(chunk)
    texts = TEXTS + [made(rng, rng.randint(1, 120)) for _ in range(60)]
    vocabulary = bpe.Vocabulary(PATH, P.PATTERN, bpe.Settings(chunk=chunk, overlap=overlap, remembered=50))
    got = by_id(bpe.digests(documents(spark, list(enumerate(texts)), ids="x", part=1, chunk="c", row_key=3), vocabulary))
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        e = expected(library, text)
        assert {k: got[i][k] for k in e} == e, (i, text and text[:60])


def test_long_pieces_merge_alike(library):
    ranks = bpe.read_ranks(PATH)
    rng = random.Random(4)
    for n in (24, 25, 60, 400, 3000):
        for letters in ("a", "ab", "etaoinsh", "abcdefghijklmnopqrstuvwxyz"):
            piece = "".join(rng.choice(letters) for _ in range(n))
            want = library.encode_ordinary(piece)
            assert bpe._merge_long(piece.encode(), ranks) == want
            assert bpe._merge_short(piece.encode(), ranks) == want


def test_very_long_texts(spark, library):
    rng = random.Random(8)
    texts = [made(rng, 60_000), "word " * 50_000, "x" * 120_000, " " * 80_000 + "end"]
    vocabulary = bpe.Vocabulary(PATH, P.PATTERN)
    got = by_id(bpe.digests(documents(spark, list(enumerate(texts))), vocabulary))
    for i, text in enumerate(texts):
        e = expected(library, text)
        assert {k: got[i][k] for k in e} == e


def test_repeated_rows_null_ids_and_empty_table(spark):
    vocabulary = bpe.Vocabulary(PATH, P.PATTERN, bpe.Settings(chunk=10, overlap=4))
    long = "the quick brown fox jumps"
    rows = [(1, long), (1, long), (1, "other text that is long"), (None, long), (2, "x"), (2, "x")]
    got = bpe.digests(documents(spark, rows), vocabulary).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "1", "2", "2", "None"]
    assert bpe.digests(documents(spark, []), vocabulary).count() == 0
