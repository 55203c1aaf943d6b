import random
import shutil
from pathlib import Path

import corpus_pipeline
from ledgerloom.llm import base
from tests.llm.support import documents
from tests.llm.test_bpe import expected as tokens_of
from tests.llm.test_bpe import library  # noqa: F401

SECRET = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


def test_stages_equal_what_is_planted(spark, tmp_path, library):  # noqa: F811
    rng = random.Random(1)
    body = lambda n=80: " ".join(f"{rng.choice('bcdfg')}o{rng.choice('klmnp')}e{rng.randint(0, 999)}" for _ in range(n))
    item = "which bird sings in the early morning over the green hills. the tiny brown lark does."
    clean = [(i, body()) for i in range(8)]
    near = clean[0][1].split()
    near[40] = "changed"
    secret = body()
    rows = [*clean, (20, clean[1][1]), (21, " ".join(near)), (22, "too short"), (23, None), (24, "same words here " * 40),
            (25, f"{body()}\n{item}"), (26, f'{secret} token = "{SECRET}" end'), (26, f'{secret} token = "{SECRET}" end')]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = base.table(spark, str(tmp_path), "documents")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = base.stored(stage(spark, docs, str(tmp_path)), "stage")
        kept.append(sorted(r.doc_id for r in docs.collect()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    first = list(range(8))
    assert kept[0] == [*first, 20, 21, 25, 26, 26]
    assert kept[1] == [*first, 25, 26]
    assert kept[2] == kept[3] == kept[4] == [*first, 26]
    texts = dict(clean) | {26: f'{secret} token = "[secret]" end'}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        e = tokens_of(library, texts[r.doc_id])
        assert {k: r[k] for k in e} == e


def test_everything_else_works_without_the_text_operators(tmp_path):
    """A copy of the repository without them still registers the other queries."""
    import subprocess
    import sys

    root = Path(corpus_pipeline.__file__).parent
    shutil.copytree(root / "ledgerloom", tmp_path / "ledgerloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = 'import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not [k for k in q if k.startswith("op") and k[2].isdigit() or k == "pipeline"]'
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"} | {})
