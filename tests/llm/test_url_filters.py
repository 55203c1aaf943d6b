import random

from pyspark.sql import functions as F

from ledgerloom.llm import url_filters as uf
from tests.llm.support import by_id

PAGES = "page_id long, url string, html string"


def test_contract_rules(spark):
    urls = {
        "https://www.example.com/en/a?x#y": ("www.example.com", "/en/a", "www.example.com/en/", "allow"),
        "https://a.www.example.com/en/": ("a.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "https://EXAMPLE.com/en/": ("example.com", "/en/", "example.com/en/", "block"),
        "https://example.com/en": ("example.com", "/en", "com/", "allow"),
        "https://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://x.net/es/1": ("x.net", "/es/1", "net/es/", "block"),
        "http://x.net/fr/1": ("x.net", "/fr/1", "net/fr/", "block"),
        "http://x.net/de/1": ("x.net", "/de/1", None, "allow"),
        "http://a.com": ("a.com", "", None, "allow"),
        "http://a.com?q": ("a.com", "", None, "allow"),
        "http://a.com/x#?y": ("a.com", "/x", "com/", "allow"),
        "ftp://b.org/p://q": ("b.org", "/p://q", None, "allow"),
        "www.spam-farm.example.org/x": ("", "", None, "allow"),
        "http://www.spam-farm.example.org:80/x": ("www.spam-farm.example.org:80", "/x", None, "block"),
        "http://my-spam-farm.example.org/x": ("my-spam-farm.example.org", "/x", None, "allow"),
        "http://É.Net/fr/": ("É.net", "/fr/", "net/fr/", "block"),
        "": ("", "", None, "allow"),
        "://": ("", "", None, "allow"),
        "http://" + "a." * 50_000 + "net/fr/": ("a." * 50_000 + "net", "/fr/", "net/fr/", "block"),
    }
    rows = [(i, u, None) for i, u in enumerate(urls)] + [(99, None, None), (98, None, "x")]
    pages = spark.createDataFrame(rows, PAGES).withColumns({"host": F.lit("h"), "key": F.lit(1), "verdict": F.lit("v")})
    got = by_id(uf.judge(pages, uf.production_list(spark)), "page_id")
    for i, (u, expected) in enumerate(urls.items()):
        assert tuple(got[i][c] for c in ("host", "path", "rule", "verdict")) == expected, u[:60]
    assert got[99]["host"] == "" and got[99]["verdict"] == "allow"


def test_cascade_is_exact_over_passes_and_levels(spark):
    """A weak filter needs several levels; small passes split the list; membership stays exact."""
    rng = random.Random(3)
    hosts = [f"h{i}.d{i % 700}.org" for i in range(1500)]
    listed = sorted(rng.sample([f"d{i}.org" for i in range(700)], 200) + [f"gone{i}.org" for i in range(50)])
    sizes = uf.Sizes(bits_per_key=5, hashes=3, keys_per_shard=130, pass_bytes=200)
    pages = spark.createDataFrame([(i, f"http://{h}/", None) for i, h in enumerate(hosts)], PAGES)
    keys = spark.createDataFrame([(k,) for k in listed] + [(listed[0],), (None,)], "key string")
    universe = pages.select(F.explode(uf.keys_of(uf.host_of(F.col("url")))).alias("key"))
    cascade = uf.build(universe, keys, sizes)
    assert len(cascade.passes) > 1 and any(len(levels) > 1 for _, levels in cascade.passes)
    got = by_id(uf.judge(pages, keys, sizes=sizes), "page_id")
    assert {i for i, r in got.items() if r["listed"]} == {i for i, h in enumerate(hosts) if h.split(".", 1)[1] in set(listed)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "key string")
    assert uf.judge(spark.createDataFrame([], PAGES), uf.production_list(spark)).count() == 0
    row = uf.judge(spark.createDataFrame([(1, "http://a.org/", None)], PAGES), none).first()
    assert row.verdict == "allow" and not row.listed
