"""Quality rules with cross-document line frequency, in DataFrame functions only.

Two parts decide about a document:

* **Base rules** on its own words: too few words, or mostly words inside repeated three-word windows.
* **Line frequency**: lines are normalised (lower case, single spaces), hashed, and the *distinct*
  documents holding a line are counted per host. Lines above the limits are menu, banner or
  licence lines; `cleaned` removes them, and a document that they mostly consist of is rejected.

Copies of one document are not evidence that a line is boilerplate. So lines are counted twice: first in
distinct texts, which gives the *shared* lines (in more texts than the limit), then in distinct documents.
A document counts by the least hash among its own lines, those that are not shared: exact copies have it in
common, near copies mostly do, and lines that always stand together take no part in it. An own line stands in
at most `line_documents` texts, so a line in more than `line_documents` squared texts of documents with own words
always counts as above that limit. A text with too few own words is a near copy (8/9 of the words in common are a similarity
of 0.8, as in near-dedup) and counts by its shared lines, so that all its family counts once. The two limits
are a number of distinct documents and a share of the host's distinct texts, and hold alike at every size.

How it spreads: lines are taken once and written as hashes; distinct counts are Spark's two-step distinct aggregates, so a line
found everywhere is counted where it is read. Lines over a share `s` of a host's documents
number at most (mean lines per document) / `s` for the host; the table is written, and Spark broadcasts it only
when its files are under the session's limit, or sort-merges (with AQE's skew splitting) beyond.

Defined cases: NULL or blank text has no words, fails the base rule and has no lines; NULL host is a
host of its own; repeated doc_ids are judged row by row (a row key is the id, host and text hash);
an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import base


@dataclass(frozen=True)
class Limits:
    """Production parameters."""

    min_words: int = 50
    max_repeat_percent: int = 50
    #: A line is boilerplate if more distinct documents of its host hold it than each of these.
    line_documents: int = 10
    line_share: float = 0.05
    #: A text with a smaller share of own words is a near copy.
    own_share: float = 1 / 9
    #: A document left with a smaller share of its words is rejected.
    min_left_share: float = 0.3


def _line_hash(line: Column) -> Column:
    """60 bits of the digest, which other engines can compute as well."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 15), 16, 10).cast("long")


def _normal(line: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(line, base.BLANKS, " ")))


def _row_hash(text: Column) -> Column:
    return F.xxhash64("doc_id", F.coalesce(F.col("source"), F.lit("")), text)


def _row_key() -> Column:
    return F.xxhash64("doc_id", "host", "text").alias("row_key")


def with_lines(documents: DataFrame) -> DataFrame:
    """doc_id, host, text and `lines`: the normalised lines that hold a word, as (hash, words)."""
    text = base.text_of()
    lines = F.array_remove(F.transform(F.split(text, "\n"), _normal), "")
    return (
        documents.select(
            F.col("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("host"), text.alias("text")
        )
        .withColumn("normal", lines)
        .withColumn(
            "lines",
            F.transform(
                "normal",
                lambda x: F.struct(
                    _line_hash(x).alias("h"),
                    (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("n"),
                ),
            ),
        )
        .drop("normal")
    )


def line_hashes(documents: DataFrame) -> DataFrame:
    """doc_id, row_key, host, text_key (equal for equal sets of lines) and lines."""
    return with_lines(documents).select(
        "doc_id", _row_key(), "host", F.xxhash64(F.array_sort(F.array_distinct("lines.h"))).alias("text_key"), "lines"
    )


def frequent_lines(hashed: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """host, h: lines in more distinct documents of the host than the limits allow, from `line_hashes`."""
    lines = hashed.select("host", "text_key", F.explode("lines").alias("line")).select(
        "host", "text_key", F.col("line.h").alias("h"), F.col("line.n").alias("n")
    )
    shared = (
        lines.groupBy("host", "h").agg(F.countDistinct("text_key").alias("texts"))
        .where(F.col("texts") > limits.line_documents)
        .select("host", "h", F.lit(True).alias("shared"))
    )
    shared = base.stored(shared, "shared-lines")
    own = F.col("shared").isNull()
    texts = (
        lines.join(shared, ["host", "h"], "left")
        .groupBy("host", "text_key")
        .agg(
            F.sum("n").alias("words"), F.sum(F.when(own, F.col("n")).otherwise(0)).alias("own_words"),
            F.min(F.when(own, F.col("h"))).alias("own"), F.collect_set(F.when(~own, F.col("h"))).alias("hashes"),
        )
        .where(F.size("hashes") > 0)
        .withColumn("own", F.when(F.col("own_words") >= limits.own_share * F.col("words"), F.col("own")))
        .withColumns({"least": F.array_min("hashes"), "most": F.array_max("hashes")})
        .select("host", "own", "least", "most", F.explode("hashes").alias("h"))
    )
    # A near copy counts by a shared line other than the counted one; those without any are copies of each other.
    other = F.when(F.col("h") != F.col("least"), F.col("least")).when(F.col("h") != F.col("most"), F.col("most"))
    counted = texts.groupBy("host", "h").agg(
        F.countDistinct(F.coalesce(F.col("own"), other, F.lit(-1))).alias("documents")
    )
    # Copies count once here too, or a host full of them would hide its lines.
    hosts = hashed.groupBy("host").agg(F.countDistinct("text_key").alias("host_documents"))
    return (
        counted.where(F.col("documents") > limits.line_documents)
        .join(hosts, "host")
        .where(F.col("documents") > limits.line_share * F.col("host_documents"))
        .select("host", "h")
    )


def _repeat_words() -> Column:
    """Words covered by three-word windows that occur twice or more, from `words` and `windows`.

    Windows are hashed to 64 bits. Only documents with an equal pair sort (hash, position)."""
    size = F.size("windows")
    placed = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = F.transform(
        F.filter(
            "placed",
            lambda x, k: (
                ((k > 0) & (F.get("placed", k - 1)["h"] == x["h"]))
                | F.coalesce(F.get("placed", k + 1)["h"] == x["h"], F.lit(False))
            ),
        ),
        lambda x: x["i"],
    )
    covered = F.aggregate(
        F.array_sort("repeated"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda a, i: F.struct(
            (a["n"] + F.least(F.lit(3), i - a["last"])).cast("long").alias("n"), i.alias("last")
        ),
        lambda a: a["n"],
    )
    return size, placed, repeated, covered


def measured(documents: DataFrame) -> DataFrame:
    """One row per document with the base figures and its lines."""
    size, placed, repeated, covered = _repeat_words()
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    return (
        with_lines(documents)
        .withColumn("words", base.words_of(F.col("text")))
        .withColumn("n_words", F.size("words").cast("long"))
        .withColumn(
            "windows",
            F.when(
                F.col("n_words") >= 3,
                F.transform(
                    F.sequence(F.lit(0), F.size("words") - 3),
                    lambda i: F.xxhash64(
                        F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)
                    ),
                ),
            ).otherwise(F.array().cast("array<bigint>")),
        )
        .withColumn("raw", F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))))
        .select(
            "doc_id", _row_key(), "n_words",
            F.length(F.regexp_replace("text", base.BLANKS, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            (F.size("raw") - F.size(F.array_distinct("raw"))).cast("long").alias("n_dup_lines"),
            F.when(size == F.size(F.array_distinct("windows")), none).otherwise(placed).alias("placed"),
        )
        .withColumn("repeated", repeated)
        .withColumn("n_repeat_words", covered)
        .drop("placed", "repeated")
    )


def judge(documents: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Every document with its figures, the words lost with frequent lines, and the verdict."""
    hashed = base.stored(line_hashes(documents), "line-hashes")
    frequent = base.stored(frequent_lines(hashed, limits), "frequent-lines")
    removed = (
        hashed.select("doc_id", "row_key", F.posexplode("lines").alias("at", "line"), "host")
        .select("doc_id", "row_key", "at", "host", F.col("line.h").alias("h"), F.col("line.n").alias("n"))
        .join(frequent, ["host", "h"], "left_semi")
        .dropDuplicates(["doc_id", "row_key", "at"])
        .groupBy("doc_id", "row_key")
        .agg(F.sum("n").cast("long").alias("words_removed"), F.array_sort(F.collect_set("h")).alias("removed_lines"))
    )
    left = F.col("n_words") - F.col("words_removed")
    failed = (F.col("n_words") < limits.min_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * limits.max_repeat_percent
    )
    figures = measured(documents).alias("f")
    r = removed.alias("r")
    same = F.col("f.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("f.row_key") == F.col("r.row_key"))
    return (
        figures.join(r, same, "left")
        .select(
            "f.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            F.coalesce("words_removed", F.lit(0)).cast("long").alias("words_removed"),
            F.col("f.row_key").alias("row_key"), "removed_lines",
        )
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (left >= limits.min_left_share * F.col("n_words")))
    )


def passing(documents: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents that are kept, with all their columns."""
    # Written first: a filter pushed into the plan would repeat the figures' expressions inside one another.
    judged = base.stored(judge(documents, limits), "judged")
    kept = judged.where("kept").select("doc_id", "row_key").distinct().alias("k")
    rows = documents.withColumn("_row_key", _row_hash(base.text_of())).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d._row_key") == F.col("k.row_key"))
    return rows.join(kept, same, "left_semi").drop("_row_key")


def cleaned(documents: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents that are kept, with all their columns; frequent lines are taken out of the text and the length follows."""
    judged = base.stored(judge(documents, limits), "judged")
    kept = judged.where("kept").select("doc_id", "row_key", F.col("removed_lines").alias("_removed")).distinct().alias("k")
    rows = documents.withColumn("_row_key", _row_hash(base.text_of())).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d._row_key") == F.col("k.row_key"))
    left = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("_removed", _line_hash(_normal(x))))
    changed = F.col("_removed").isNotNull()
    out = rows.join(kept, same).select("d.*", "k._removed")
    out = out.withColumn("text", F.when(changed, F.array_join(left, "\n")).otherwise(F.col("text")))
    if "n_chars" in documents.columns:
        length = F.length("text").cast(documents.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(changed, length).otherwise(F.col("n_chars")))
    return out.select(*documents.columns)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(base.table(spark, sf_dir, "documents")).drop("row_key", "removed_lines")


ORACLE = """
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS raw
  FROM docs
), windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1
), covered AS (
  SELECT doc_id, count(*) AS n FROM (
    SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM repeated)
  ) GROUP BY doc_id
), line AS (
  SELECT doc_id, host, x AS normal, len(x) - len(replace(x, ' ', '')) + 1 AS n,
         ('0x' || substr(md5(x), 1, 15))::BIGINT AS h
  FROM (
    SELECT doc_id, host, lower(trim(regexp_replace(l, '[\\x20\\x09-\\x0D]+', ' ', 'g'))) AS x
    FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS l FROM docs)
  ) WHERE x <> ''
), ordered AS (
  SELECT doc_id, host, h, row_number() OVER (PARTITION BY doc_id ORDER BY h) AS r
  FROM (SELECT DISTINCT doc_id, host, h FROM line)
), least_two AS (
  SELECT doc_id, min(h) AS a, min(h) FILTER (WHERE r = 2) AS b FROM ordered GROUP BY doc_id
), frequent AS (
  SELECT o.host, o.h
  FROM ordered o JOIN least_two t USING (doc_id)
  JOIN (SELECT host, count(*) AS host_documents FROM docs GROUP BY host) USING (host)
  GROUP BY o.host, o.h, host_documents
  HAVING count(DISTINCT coalesce(CASE WHEN o.h = t.a THEN t.b ELSE t.a END, -1)) > 10
     AND count(DISTINCT coalesce(CASE WHEN o.h = t.a THEN t.b ELSE t.a END, -1)) > 0.05 * host_documents
), removed AS (
  SELECT doc_id, sum(n)::BIGINT AS words_removed FROM line JOIN frequent USING (host, h) GROUP BY doc_id
), figures AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(raw) - len(list_distinct(raw)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words,
         coalesce(words_removed, 0)::BIGINT AS words_removed
  FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN removed USING (doc_id)
)
SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed,
       NOT (n_words < 50 OR n_repeat_words * 100 > n_words * 50)
         AND n_words - words_removed >= 0.3 * n_words AS kept
FROM figures
"""
