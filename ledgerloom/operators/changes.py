"""Keyed batch changes: a ledger and a DataFrame of changes in, the next ledger out.

Shape shared by all of them: fold the changes to one row per key first (partially aggregated, so a
key that holds a third of the feed is reduced in every task before the shuffle), then meet the
ledger in one equi-join on ``id_root``. No join is forced: adaptive execution broadcasts the change
side when its measured size allows, and otherwise sort-merges with skew splitting.
"""

from __future__ import annotations

from collections.abc import Sequence
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.labels import month_number
from ledgerloom.schema import INVESTMENT_TYPES, ISSUE_STATUSES, MONTHLY
from ledgerloom.session import new_workspace

PROGRESS_COLUMNS = [
    "progres_description", "issue_categories", "issue_description", "action_target",
    "head_office_support_desc", "pic", "status_issue",
]


def newest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first under ``order``.

    Spark turns ``row_number() = 1`` into a local top-1 before the shuffle (``WindowGroupLimit``),
    so each task sends at most one row per key however many versions it holds.
    """
    place = "__place"
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(place, F.row_number().over(window)).where(F.col(place) == 1).drop(place)


def dedup_latest(
    rows: DataFrame, key_cols: Sequence[str] = ("id_root",), seq: str | None = None
) -> DataFrame:
    """Newest version per key by ``updated_at``; ``seq`` (insertion order) breaks ties.

    ``key_cols`` can name the wider replacing key (year, region, terminal, id), under which a
    project that moved keeps both rows.
    """
    order = [F.col("updated_at").desc_nulls_last()]
    if seq:
        order.append(F.col(seq).desc_nulls_last())
    return newest_per_key(rows, key_cols, order)


def last_operation(feed: DataFrame, seq: str | None = "seq") -> DataFrame:
    """Last operation per id, by event time and then arrival.

    Events of one transaction share a stamp. Where no arrival order parts them either, a deletion
    gives way: the other operations lead to the source row, which is there or not.
    """
    order = [F.col("timestamp").desc_nulls_last()]
    if seq and seq in feed.columns:
        order.append(F.col(seq).desc_nulls_last())
    order.append(F.coalesce(F.col("operation") == "DELETE", F.lit(False)).asc())
    return newest_per_key(feed.where(F.col("id_root") != ""), ["id_root"], order)


# ---- insert, delete, upsert ----------------------------------------------------------------


def known_keys(led: DataFrame, keys: DataFrame) -> DataFrame:
    """The distinct ids of ``keys`` that the ledger holds.

    The ledger stands on the side that streams past a broadcast, so a small batch of keys costs one
    scan of its id column and no shuffle of it.
    """
    return led.select("id_root").join(keys.select("id_root"), "id_root", "left_semi").distinct()


def _written(rows: DataFrame, label: str) -> DataFrame:
    """Rows that are read again and again, written to the shared folder once."""
    path = new_workspace(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def mark_inserts(led: DataFrame, incoming: DataFrame, order: Sequence[Column] = ()) -> DataFrame:
    """Every incoming row with its ``outcome``: added, or refused as missing (no id), exists or repeated.

    A key the ledger holds refuses all its incoming rows, a key repeated in the batch all but the
    first under ``order``. An unknown investment type becomes NULL. The incoming rows are read once; a key that many of
    them share is found once per task, and its rows are marked where they lie.
    """
    kind = F.col("type_investasi")
    rows = _written(
        incoming.withColumn("type_investasi", F.when(kind.isin(*INVESTMENT_TYPES), kind)).withColumns(
            {"_tie": F.xxhash64(*incoming.columns), "_row": F.monotonically_increasing_id()}
        ),
        "incoming",
    )
    arrival = [*(order or [F.col("updated_at").asc_nulls_last(), F.col("_tie")]), F.col("_row")]
    first = newest_per_key(rows.where(F.col("id_root").isNotNull()), ["id_root"], arrival)
    known = known_keys(led, rows).withColumn("_known", F.lit(True))
    # All that settles a row is gathered by id first, so that the wide rows move once.
    settled = first.select("id_root", F.col("_row").alias("_first")).join(known, "id_root", "left")
    outcome = (
        F.when(F.col("id_root").isNull(), "missing").when(F.col("_known"), "exists")
        .when(F.col("_row") == F.col("_first"), "added").otherwise("repeated")
    )
    return rows.join(settled, "id_root", "left").select(*incoming.columns, outcome.alias("outcome"))


def insert_rows(
    led: DataFrame, incoming: DataFrame, order: Sequence[Column] = ()
) -> tuple[DataFrame, DataFrame]:
    """The ledger with the new rows, and what was refused as (id_root, reason, refused_rows); see :func:`mark_inserts`."""
    marked = _written(mark_inserts(led, incoming, order), "marked")
    refused = marked.where("outcome <> 'added'").groupBy("id_root", F.col("outcome").alias("reason"))
    added = marked.where("outcome = 'added'").drop("outcome")
    return led.unionByName(added), refused.agg(F.count("*").alias("refused_rows"))


def delete_keys(led: DataFrame, keys: DataFrame) -> DataFrame:
    return led.join(keys.select("id_root"), "id_root", "left_anti").select(*led.columns)


def mark_upserts(led: DataFrame, incoming: DataFrame, key_cols: Sequence[str] = ("id_root",)) -> DataFrame:
    """The newest incoming row per key with its ``outcome``: added, replaced, or older than what the ledger holds.

    On equal stamps the incoming row counts. The incoming rows are read once; of the ledger, keys and stamps are.
    """
    return _marked_upserts(led, _written(dedup_latest(incoming, key_cols), "incoming"), key_cols)


def _marked_upserts(led: DataFrame, fresh: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """One written row per key, marked."""

    def same(left: str, right: str) -> Column:
        return F.expr(" AND ".join(f"{left}{k} <=> {right}{k}" for k in key_cols))

    keys = fresh.selectExpr(*(f"{k} AS _new_{k}" for k in key_cols))
    held = led.select(*key_cols, "updated_at").join(keys, same("", "_new_"), "left_semi")
    held = held.selectExpr(*(f"{k} AS _held_{k}" for k in key_cols), "updated_at AS _at", "true AS _is_held")
    outcome = (
        F.when(F.col("_is_held").isNull(), "added")
        .when(F.col("_at").isNull() | (F.col("updated_at") >= F.col("_at")), "replaced").otherwise("older")
    )
    return fresh.join(held, same("", "_held_"), "left").select(*fresh.columns, outcome.alias("outcome"))


def upsert(
    led: DataFrame, incoming: DataFrame, key_cols: Sequence[str] = ("id_root",)
) -> DataFrame:
    """Newest version per key of a ledger's row and the incoming ones; on equal stamps the latter.

    The incoming rows are reduced to one per key; their marks are written as keys alone, and what replaces a row is
    joined to the ledger, so a batch small enough to broadcast leaves the ledger unshuffled. ``led`` holds one row per key.
    """
    fresh = _written(dedup_latest(incoming, key_cols), "incoming")
    marks = _marked_upserts(led, fresh, key_cols).selectExpr(*(f"{k} AS _mark_{k}" for k in key_cols), "outcome")
    marks = _written(marks, "marked")

    def of(outcome: str) -> DataFrame:
        same_mark = F.expr(" AND ".join(f"{k} <=> _mark_{k}" for k in key_cols))
        return fresh.join(marks.where(F.col("outcome") == outcome), same_mark)

    newer = of("replaced").selectExpr(*(f"{c} AS _new_{c}" for c in led.columns), "true AS _is_new")
    same_key = F.expr(" AND ".join(f"{k} <=> _new_{k}" for k in key_cols))
    kept = led.join(newer, same_key, "left").selectExpr(
        *(f"CASE WHEN _is_new THEN _new_{c} ELSE {c} END AS {c}" for c in led.columns)
    )
    return kept.unionByName(of("added").select(*led.columns))


# ---- column updates ------------------------------------------------------------------------


# Per column to set: the SQL condition under which a change sets it, and the SQL value.
Setters = dict[str, tuple[str, str]]


def _fold(changes: DataFrame, setters: Setters, order: Sequence[str]) -> DataFrame:
    """Per key and column, the last value among the changes that set the column.

    The value is boxed in a struct, so that NULL can be one: an unboxed NULL means "leave alone".
    """
    moment = f"struct({', '.join(order)})"
    return changes.groupBy("id_root").agg(
        *(
            F.expr(f"max_by(struct({value} AS v), CASE WHEN {condition} THEN {moment} END) AS new_{c}")
            for c, (condition, value) in setters.items()
        )
    )


def _merge(
    led: DataFrame, changes: DataFrame, setters: Setters, order: Sequence[str], as_of: Column | None
) -> DataFrame:
    """Set what the folded changes hold and stamp the rows they touch."""
    types = dict(led.dtypes)
    now = as_of if as_of is not None else F.current_timestamp()
    joined = led.join(_fold(changes, setters, order), "id_root", "left").withColumn("_now", now)
    touched = " OR ".join(f"new_{c} IS NOT NULL" for c in setters)

    def value(name: str) -> str:
        if name in setters:
            return f"CASE WHEN new_{name} IS NULL THEN {name} ELSE CAST(new_{name}.v AS {types[name]}) END"
        if name == "updated_at":
            return f"CASE WHEN {touched} THEN CAST(_now AS {types[name]}) ELSE updated_at END"
        return name

    return joined.selectExpr(*(f"{value(c)} AS {c}" for c in led.columns))


EVENT_ORDER = ("timestamp", "seq")


def partial_update(
    led: DataFrame,
    changes: DataFrame,
    columns: Sequence[str],
    as_of: Column | None = None,
    order: Sequence[str] = EVENT_ORDER,
) -> DataFrame:
    """Set any columns by key.

    ``set_columns`` (an array of names) says which ones a change carries, so NULL can be set; a
    change that carries none leaves its row and stamp alone.
    """
    setters = {c: (f"array_contains(set_columns, '{c}')", c) for c in columns}
    return _merge(led, changes, setters, order, as_of)


_BAD_STATUS = "status_issue <> '' AND status_issue NOT IN ({})".format(
    ", ".join(f"'{w}'" for w in ISSUE_STATUSES)
)


def bad_status() -> Column:
    return F.expr(_BAD_STATUS)


def progress_rejects(changes: DataFrame) -> DataFrame:
    """Progress changes naming an issue status outside the allowed words."""
    return changes.where(bad_status())


def update_progress(
    led: DataFrame,
    changes: DataFrame,
    as_of: Column | None = None,
    order: Sequence[str] = EVENT_ORDER,
) -> DataFrame:
    """Set the seven progress and issue columns; NULL leaves a column alone.

    Changes with a bad status are left out whole (see :func:`progress_rejects`).
    """
    setters = {c: (f"{c} IS NOT NULL", c) for c in PROGRESS_COLUMNS if c in changes.columns}
    good = changes
    if "status_issue" in changes.columns:
        good = changes.where(f"NOT coalesce({_BAD_STATUS}, false)")
    return _merge(led, good, setters, order, as_of)


def bad_month() -> Column:
    return F.coalesce(month_number(F.col("bulan")), F.lit(0)) == 0


def month_rejects(changes: DataFrame) -> DataFrame:
    """Monthly changes whose month name is unknown or missing."""
    return changes.where(bad_month())


def set_months(
    led: DataFrame,
    changes: DataFrame,
    kind: str,
    as_of: Column | None = None,
    order: Sequence[str] = EVENT_ORDER,
) -> DataFrame:
    """Set (not add to) monthly ``rkap``, ``realisasi`` or ``prognosa`` values.

    ``changes`` holds (id_root, bulan, nilai); the last change per id and month counts, months in
    any case, unknown ones aside (see :func:`month_rejects`).
    """
    numbered = changes.withColumn("_month", month_number(F.col("bulan"))).where("_month > 0")
    setters = {c: (f"_month = {i}", "nilai") for i, c in enumerate(MONTHLY[kind], start=1)}
    return _merge(led, numbered, setters, order, as_of)


def refused_changes(
    led: DataFrame, changes: DataFrame, bad: Column | None = None, bad_reason: str = "bad_value"
) -> DataFrame:
    """Changes that set nothing, with the ``reason``: no id, what ``bad`` finds, or an id that the ledger does not hold."""
    key = F.col("id_root")
    known = known_keys(led, changes.select("id_root").distinct()).withColumn("_known", F.lit(True))
    reason = F.when(F.coalesce(key, F.lit("")) == "", "missing_id")
    if bad is not None:
        reason = reason.when(F.coalesce(bad, F.lit(False)), bad_reason)
    reason = reason.when(F.col("_known").isNull(), "unknown_id")
    return (
        changes.join(known, "id_root", "left").withColumn("reason", reason)
        .where("reason IS NOT NULL").select(*changes.columns, "reason")
    )


# ---- monitoring rows -----------------------------------------------------------------------


def orphans(monitoring: DataFrame, led: DataFrame) -> DataFrame:
    """Monitoring rows whose project is not in the ledger."""
    return delete_keys(monitoring, led)


def cascade_delete(monitoring: DataFrame, deleted: DataFrame) -> DataFrame:
    return delete_keys(monitoring, deleted)


def cascade_rename(rows: DataFrame, renames: DataFrame) -> DataFrame:
    """Follow key renames given as (old_id, new_id); works for the ledger and its children.

    An id that is to get several new names keeps its own; ``rename_rejects`` lists such renames.
    """
    moved = (
        renames.groupBy(F.col("old_id").alias("id_root"))
        .agg(F.min("new_id").alias("new_id"), F.max("new_id").alias("other"))
        .where(F.col("new_id") == F.col("other"))
        .drop("other")
    )
    return (
        rows.join(moved, "id_root", "left")
        .withColumn("id_root", F.coalesce("new_id", "id_root"))
        .select(*rows.columns)
    )


def rename_rejects(renames: DataFrame) -> DataFrame:
    """Renames that are not followed: ids with several new names, with the reason."""
    several = (
        renames.groupBy("old_id")
        .agg(F.min("new_id").alias("least"), F.max("new_id").alias("most"))
        .where(F.col("least") != F.col("most"))
    )
    return renames.join(several, "old_id", "left_semi").withColumn("reason", F.lit("several_names"))


# ---- renames of ledger keys ----------------------------------------------------------------


def _marked_renames(led: DataFrame, renames: DataFrame) -> DataFrame:
    """Distinct renames with what is wrong with each by itself or beside others, and whether its new id is in the ledger."""
    asked = renames.select("old_id", "new_id").distinct()
    ids = asked.select(F.col("old_id").alias("id_root")).union(asked.select("new_id")).distinct()
    known = known_keys(led, ids)
    old, new = (known.select(F.col("id_root").alias(c), F.lit(True).alias(f"{c}_known")) for c in ("old_id", "new_id"))
    blank = (F.coalesce("old_id", F.lit("")) == "") | (F.coalesce("new_id", F.lit("")) == "")
    alone = asked.join(old, "old_id", "left").join(new, "new_id", "left").select(
        "old_id", "new_id", F.coalesce("new_id_known", F.lit(False)).alias("held"),
        F.when(blank, "missing_id").when(F.col("old_id") == F.col("new_id"), "same_name")
        .when(F.col("old_id_known").isNull(), "unknown_id").alias("reason"),
    )
    return _crowded(_crowded(alone, "old_id", "several_names"), "new_id", "shared_name")


def _crowded(renames: DataFrame, column: str, reason: str) -> DataFrame:
    """Mark the good renames that share a value of ``column``."""
    crowd = (
        renames.where("reason IS NULL").groupBy(column).agg(F.count("*").alias("_n")).where("_n > 1").select(column, F.lit(reason).alias("_r"))
    )
    marked = renames.join(crowd, column, "left").withColumn("reason", F.coalesce("reason", "_r"))
    return marked.select("old_id", "new_id", "held", "reason")


def rename_outcomes(led: DataFrame, renames: DataFrame) -> DataFrame:
    """Every distinct rename (old_id, new_id) of ledger keys with the ``reason`` why it can't be followed, NULL where it can.

    All renames happen at once, so chains (A to B while B moves on) and swaps are followed. Refused are renames without an id, to the
    same name, of an id that the ledger does not hold, of one id to several names, of several ids to one name, and those that lead
    to an id that stays, directly (``name_in_use``) or by way of renames that are refused for it (``blocked``).

    What is left by itself is paths and rings. Where a path ends is found by doubling: every round joins what is known so
    far with itself, so a chain of n renames takes log n joins of the renames, whatever the ledger's size.
    """
    marked = _written(_marked_renames(led, renames), "renames")
    good = marked.where("reason IS NULL").select("old_id", "new_id", "held")
    # The end of the way as far as it is known; `open` while the end is renamed itself.
    steps = good.select(F.col("old_id").alias("end"), F.lit(True).alias("open"))
    ways = good.withColumnRenamed("new_id", "end").join(steps, "end", "left").withColumn("open", F.coalesce("open", F.lit(False)))
    ways = _written(ways.select("old_id", "end", "held", "open"), "rename-ways")
    unsettled = ways.where("open").count()
    while unsettled:
        on = ways.selectExpr("old_id AS end", "end AS _end", "held AS _held", "open AS _open")
        ways = _written(
            ways.join(on, "end", "left").selectExpr(
                "old_id", "coalesce(_end, end) AS end", "CASE WHEN open THEN _held ELSE held END AS held",
                "open AND coalesce(_open, false) AS open",
            ),
            "rename-ways",
        )
        before, unsettled = unsettled, ways.where("open").count()
        # Every round settles some of each path; what is left then is rings, which end nowhere.
        if unsettled == before:
            break
    stuck = ways.where("NOT open AND held").select("old_id", F.col("end").alias("_end"))
    last = F.when(F.col("_end") == F.col("new_id"), "name_in_use").otherwise("blocked")
    return marked.join(stuck, "old_id", "left").select(
        "old_id", "new_id", F.coalesce("reason", F.when(F.col("_end").isNotNull(), last)).alias("reason")
    )


def followed(outcomes: DataFrame) -> DataFrame:
    """The renames to follow, for the ledger and its children alike (see :func:`cascade_rename`)."""
    return outcomes.where("reason IS NULL").select("old_id", "new_id")
