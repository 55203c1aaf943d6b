"""Merkle manifest of a document table, kept as a persistent tree: a tampered leaf makes a new version.

A document's leaf is a digest over its fields. Leaves ascend by doc_id within their language, every two neighbours make a node, up to one subroot a
language; subroots, ordered by language, make the root in the same way. A node without a neighbour is digested alone.

The tree is cut into aligned blocks of 2^`Settings.levels` nodes, so that a node's ancestors within its block depend on
nothing outside. A block is a persistent tree: nodes are never changed, and a tampered leaf makes a version of the
block by copying the leaf's ancestors only, while all other nodes are shared. Block tops are the leaves of
the next blocks. Above its first block a version is a single changed node, and every node beside its way up is an untouched one. So versions go
on where their leaves lie: each block of leaves is met with the siblings on its way to the root, and a version copies
its ancestors along them. No node gathers the versions of all leaves below it.

How it spreads: leaves are written to the shared folder as digests and places, ordered by ranges of (language, doc_id), so that a
language of any size takes many tasks; their ranks come from counts per range and language. Blocks are grouped by
(language, number of the block) and hold at most 2^levels rows. Upper levels have 2^levels times fewer rows each; the languages are one group
more, ranked and cut into blocks in the same way.

Defined cases: a NULL field counts as `-`, so a NULL text differs from an empty one; NULL languages are a group, and come first; NULL doc_ids come first in their language
and are never tampered with. Rows that tie in doc_id are ordered by their leaf, so rows that are alike in all fields change places without effect. A
tampered row whose n_chars is NULL stays as it is and is verified. A single row is its own subroot and root, with
the digest of nothing as its proof. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm import base


@dataclass(frozen=True)
class Settings:
    """Production parameters: levels of a block, and the divisor of the ids that are tampered with."""

    levels: int = 8
    tampered_share: int = 7


# ---- leaves --------------------------------------------------------------------------------


def field(value: Column) -> Column:
    """`-` for NULL, else the number of UTF-8 bytes, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*(field(c) for c in (doc_id, source, lang, n_chars, text))).cast("binary"), 256)


def leaves(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(row, doc_id, lang, leaf, changed): `changed` is the leaf of a tampered row, else NULL.

    What reads it writes it first: ``row`` parts equal rows and is good for one run only.
    """
    doc_id, source, lang, n_chars, text = (F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    tampered = F.crc32(doc_id.cast("string").cast("binary")) % settings.tampered_share == 0
    return documents.select(
        F.monotonically_increasing_id().alias("row"),
        doc_id.cast("long").alias("doc_id"),
        lang.cast("string").alias("lang"),
        leaf_of(doc_id, source, lang, n_chars, text).alias("leaf"),
        F.when(tampered, leaf_of(doc_id, source, lang, n_chars.cast("long") + 1, text)).alias("changed"),
    )


# ---- places --------------------------------------------------------------------------------


def ranked(rows: DataFrame, group: list[str], order: list[str], label: str) -> DataFrame:
    """The rows with their place in their group, from 0, and the group's size; written once.

    ``group`` and ``order`` together tell rows apart. Ranges of the whole order are numbered by themselves; where a
    range's part of a group begins follows from the counts of the ranges before, one row per range and group in it.
    """
    ranges = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    number = F.monotonically_increasing_id()
    numbered = base.stored(
        ranges.select("*", F.spark_partition_id().alias("range"), number.bitwiseAND((1 << 33) - 1).alias("number")), label
    )
    parts = numbered.groupBy(*group, "range").agg(F.count(F.lit(1)).alias("rows"), F.min("number").alias("first"))
    before = Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begins = parts.select(
        *(F.col(c).alias(f"_{c}") for c in group), F.col("range").alias("_range"), "first",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("begin"),
        F.sum("rows").over(Window.partitionBy(*group)).alias("size"),
    )
    same = F.col("range") == F.col("_range")
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    place = (F.col("number") - F.col("first") + F.col("begin")).alias("place")
    return numbered.join(begins, same).select(*rows.columns, place, "size")


# ---- a block as a persistent tree ----------------------------------------------------------


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


class PersistentTree:
    """An aligned block: nodes are only ever added, and a version is the number of its top node.

    A node is its digest and the numbers of its left and right child, -1 for none.
    """

    def __init__(self, leaves_: list[str], levels: int):
        self.digests = list(leaves_)
        self.left = [-1] * len(leaves_)
        self.right = [-1] * len(leaves_)
        self.levels = levels
        row = list(range(len(leaves_)))
        for _ in range(levels):
            row = [self._node(row[i], row[i + 1] if i + 1 < len(row) else -1) for i in range(0, len(row), 2)]
        (self.top,) = row

    def _node(self, left: int, right: int) -> int:
        parts = [self.digests[left]] if right < 0 else [self.digests[left], self.digests[right]]
        return self._add(digest(*parts), left, right)

    def _add(self, value: str, left: int = -1, right: int = -1) -> int:
        self.digests.append(value)
        self.left.append(left)
        self.right.append(right)
        return len(self.digests) - 1

    def _way(self, place: int) -> list[tuple[int, bool]]:
        """Nodes from the top to above the leaf, and whether the way goes right there."""
        way, node = [], self.top
        for level in range(self.levels - 1, -1, -1):
            goes_right = bool(place >> level & 1)
            way.append((node, goes_right))
            node = self.right[node] if goes_right else self.left[node]
        return way

    def version(self, place: int, leaf: str) -> int:
        """A new top with another leaf at the place: copies its ancestors, shares all other nodes."""
        node = self._add(leaf)
        for parent, goes_right in reversed(self._way(place)):
            node = self._node(self.left[parent], node) if goes_right else self._node(node, self.right[parent])
        return node

    def siblings(self, place: int) -> list[str]:
        """The untouched nodes beside the way, lowest first, '' where there is none."""
        found = []
        for parent, goes_right in reversed(self._way(place)):
            other = self.left[parent] if goes_right else self.right[parent]
            found.append(self.digests[other] if other >= 0 else "")
        return found


def climbed(value: str, place: int, siblings: list[str]) -> str:
    """The ancestors of a node of this digest, up along its siblings: the last one's digest."""
    for sibling in siblings:
        if not sibling:
            value = digest(value)
        else:
            value = digest(sibling, value) if place & 1 else digest(value, sibling)
        place >>= 1
    return value


def height(size: int) -> int:
    """Levels above the nodes of a group of this size."""
    return (size - 1).bit_length()


def block_levels(size: int, first: int, levels: int) -> int:
    """Levels of a block whose nodes stand ``first`` levels above the group's leaves, in a group of ``size`` leaves."""
    return max(0, min(levels, height(size) - first))


# ---- levels of blocks ----------------------------------------------------------------------


NODE = "lang string, size long, place long, digest string"
BESIDE = "lang string, size long, place long, siblings array<string>"


def _block(rows: pa.Table, first: int, levels: int) -> tuple[pa.Table, PersistentTree]:
    rows = rows.sort_by("place")
    size = rows.column("size")[0].as_py()
    return rows, PersistentTree(rows.column("digest").to_pylist(), block_levels(size, first, levels))


def _in_blocks(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("place", levels))


def tops(nodes: DataFrame, first: int, settings: Settings) -> DataFrame:
    """The top of each block of nodes, as the nodes of the next level of blocks."""
    levels = settings.levels

    def run(rows: pa.Table) -> pa.Table:
        rows, tree = _block(rows, first, levels)
        return pa.table({
            "lang": rows.column("lang")[:1], "size": rows.column("size")[:1],
            "place": pa.array([rows.column("place")[0].as_py() >> levels], pa.int64()),
            "digest": pa.array([tree.digests[tree.top]]),
        })

    return _in_blocks(nodes, levels).groupBy("lang", "block").applyInArrow(run, NODE)


def beside(nodes: DataFrame, above: DataFrame | None, first: int, settings: Settings) -> DataFrame:
    """Each node with the siblings on its way to its group's root: in its block, then those of its block's top."""
    levels = settings.levels
    mask = (1 << levels) - 1

    def listed(rows: pa.Table, up: list[str]) -> pa.Table:
        rows, tree = _block(rows, first, levels)
        ways = [tree.siblings(p & mask) + up for p in rows.column("place").to_pylist()]
        return pa.table({c: rows.column(c) for c in ("lang", "size", "place")} | {"siblings": pa.array(ways, pa.list_(pa.string()))})

    def topmost(rows: pa.Table) -> pa.Table:
        return listed(rows, [])

    def met(rows: pa.Table, upper: pa.Table) -> pa.Table:
        return listed(rows, upper.column("siblings")[0].as_py())

    blocks = _in_blocks(nodes, levels).groupBy("lang", "block")
    if above is None:
        return blocks.applyInArrow(topmost, BESIDE)
    return blocks.cogroup(above.withColumnRenamed("place", "block").groupBy("lang", "block")).applyInArrow(met, BESIDE)


def ways_up(bottom: DataFrame, largest: int, first: int, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """For groups of nodes that are ``first`` levels up: every node's siblings on its way, and the groups' roots.

    ``largest`` is the size of the largest group, which tells how many levels of blocks there are.
    """
    chain = [bottom]
    level = first
    while level < height(largest):
        chain.append(base.stored(tops(chain[-1], level, settings), "merkle-tops"))
        level += settings.levels
    roots = chain[-1]
    if len(chain) == 1:
        return bottom.select("lang", "size", "place", F.array().cast("array<string>").alias("siblings")), roots
    above = None
    for k in range(len(chain) - 2, -1, -1):
        above = beside(chain[k], above, first + k * settings.levels, settings)
    return base.stored(above, "merkle-ways"), roots


# ---- the manifest --------------------------------------------------------------------------

SCHEMA = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
)


def _languages(subroots: DataFrame, settings: Settings) -> tuple[DataFrame, str]:
    """Per language its subroot, its place, and its siblings on the way to the root; and the root."""
    group = subroots.select(F.lit("").alias("all"), "lang", "digest")
    placed = base.stored(ranked(group, ["all"], ["lang"], "merkle-languages"), "merkle-places")
    count = placed.agg(F.max("size")).first()[0]
    ways, top = ways_up(placed.select(F.col("all").alias("lang"), "size", "place", "digest"), count, 0, settings)
    languages = placed.select("lang", "place", F.col("digest").alias("subroot")).join(
        ways.select("place", F.col("siblings").alias("beyond")), "place"
    )
    return languages.withColumnRenamed("place", "lang_place"), top.first()["digest"]


def manifest(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """A row per document: its leaf, subroot and root, the digest of its proof, and the root that its (tampered) leaf leads to."""
    levels = settings.levels
    written = base.stored(leaves(documents, settings), "merkle-leaves")
    placed = base.stored(ranked(written, ["lang"], ["doc_id", "leaf", "row"], "merkle-ranges"), "merkle-places")
    largest = placed.agg(F.max("size")).first()[0]
    if largest is None:
        return documents.sparkSession.createDataFrame([], SCHEMA)
    nodes = placed.select("lang", "size", "place", F.col("leaf").alias("digest"))
    first_tops = base.stored(tops(nodes, 0, settings), "merkle-tops")
    ways, roots = ways_up(first_tops, largest, levels, settings)
    languages, root = _languages(roots.select("lang", "digest"), settings)
    blocks = (
        ways.join(languages.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")))
        .select("lang", F.col("place").alias("block"), "siblings", "lang_place", "beyond", "subroot")
    )
    return _met(placed, blocks, root, settings)


def _met(placed: DataFrame, blocks: DataFrame, root: str, settings: Settings) -> DataFrame:
    """Blocks of leaves with their way up: proofs, versions of tampered leaves, and where they lead."""
    levels = settings.levels
    mask = (1 << levels) - 1

    def run(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows, tree = _block(rows, 0, levels)
        up = {c: above.column(c)[0].as_py() for c in ("block", "siblings", "lang_place", "beyond", "subroot")}
        proofs, folded = [], []
        for place, leaf, changed in zip(*(rows.column(c).to_pylist() for c in ("place", "digest", "changed")), strict=True):
            own = tree.siblings(place & mask)
            proofs.append(digest(*own, *up["siblings"], *up["beyond"]))
            # A tampered leaf is a version of the block; an original one is folded along its proof.
            top = climbed(leaf, place, own) if changed is None else tree.digests[tree.version(place & mask, changed)]
            subroot = climbed(top, up["block"], up["siblings"])
            folded.append(climbed(subroot, up["lang_place"], up["beyond"]))
        n = rows.num_rows
        return pa.table({
            "doc_id": rows.column("doc_id"), "leaf": rows.column("digest"),
            "subroot": pa.array([up["subroot"]] * n), "root": pa.array([root] * n),
            "proof_sha256": pa.array(proofs), "folded_root": pa.array(folded),
            "verified": pa.array([f == root for f in folded]),
        })

    leaves_ = _in_blocks(placed.select("lang", "size", "place", "doc_id", F.col("leaf").alias("digest"), "changed"), levels)
    return leaves_.groupBy("lang", "block").cogroup(blocks.groupBy("lang", "block")).applyInArrow(run, SCHEMA)


#: The same by levels of the whole table; the checksum is spelled out, as DuckDB has none.
ORACLE = """
WITH RECURSIVE crc_table AS (
    SELECT list(list_reduce(list_prepend(i, range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
    FROM range(256) r(i)
), fields AS (
    SELECT doc_id, lang, n_chars, crc_table.t AS t,
        CAST(doc_id AS VARCHAR) AS d,
        coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-') AS head,
        coalesce(strlen(text) || ':' || text, '-') AS tail
    FROM documents, crc_table
), checked AS (
    SELECT doc_id, lang,
        sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
        sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) AS other,
        xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(d) + 1), lambda i: CAST(ascii(d[i]) AS BIGINT))),
            lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS crc
    FROM fields
), placed AS (
    SELECT doc_id, lang, leaf, CASE WHEN crc % 7 = 0 THEN other ELSE leaf END AS seen,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS size
    FROM checked
), nodes AS (
    SELECT lang, 0 AS level, place, size AS n, leaf AS digest FROM placed
    UNION ALL
    SELECT lang, level + 1, place // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY place))
    FROM nodes WHERE n > 1 GROUP BY lang, level, place // 2, n
), langs AS (
    SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS size
    FROM nodes WHERE n = 1
), uppers AS (
    SELECT 0 AS level, place, size AS n, subroot AS digest FROM langs
    UNION ALL
    SELECT level + 1, place // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY place))
    FROM uppers WHERE n > 1 GROUP BY level, place // 2, n
), lang_steps AS (
    SELECT l.lang, l.subroot, list(CASE WHEN s.digest IS NULL THEN '-' WHEN (l.place >> h.level) & 1 = 1 THEN 'L' || s.digest
        ELSE 'R' || s.digest END ORDER BY h.level) FILTER (WHERE h.level IS NOT NULL) AS steps
    FROM langs l LEFT JOIN (SELECT DISTINCT level FROM uppers WHERE n > 1) h ON true
    LEFT JOIN uppers s ON s.level = h.level AND s.place = xor(l.place >> h.level, 1)
    GROUP BY l.lang, l.subroot
), doc_steps AS (
    SELECT p.lang, p.place, list(CASE WHEN s.digest IS NULL THEN '-' WHEN (p.place >> h.level) & 1 = 1 THEN 'L' || s.digest
        ELSE 'R' || s.digest END ORDER BY h.level) FILTER (WHERE h.level IS NOT NULL) AS steps
    FROM placed p LEFT JOIN (SELECT DISTINCT lang, level FROM nodes WHERE n > 1) h ON h.lang IS NOT DISTINCT FROM p.lang
    LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM p.lang AND s.level = h.level AND s.place = xor(p.place >> h.level, 1)
    GROUP BY p.lang, p.place
), joined AS (
    SELECT p.doc_id, p.leaf, p.seen, l.subroot, (SELECT digest FROM uppers WHERE n = 1) AS root,
        list_concat(coalesce(d.steps, []), coalesce(l.steps, [])) AS steps
    FROM placed p JOIN doc_steps d ON d.lang IS NOT DISTINCT FROM p.lang AND d.place = p.place
    JOIN lang_steps l ON l.lang IS NOT DISTINCT FROM p.lang
), folded AS (
    SELECT doc_id, leaf, subroot, root,
        sha256(array_to_string(list_transform(list_filter(steps, lambda s: s <> '-'), lambda s: s[2:]), '')) AS proof_sha256,
        list_reduce(list_prepend(seen, steps), lambda a, s: sha256(CASE s[1] WHEN 'L' THEN s[2:] || a WHEN 'R' THEN a || s[2:]
            ELSE a END)) AS folded_root
    FROM joined
)
SELECT *, folded_root = root AS verified FROM folded
"""


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(base.table(spark, sf_dir, "documents"))
