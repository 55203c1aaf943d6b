import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.operators import changes as ch
from ledgerloom.operators import compare
from ledgerloom.schema import MONTHS, REALISASI_MONTHS
from ledgerloom.session import new_workspace
from tests.conftest import rows, stamp

NOW = stamp("2025-06-01T00:00:00")


def as_of():
    return F.lit("2025-06-01 00:00:00").cast("timestamp")


OLD = stamp("2025-01-01T00:00:00")


def ledger(make, *keys, **more):
    return make(*({"id_root": k, "updated_at": OLD, "tahun_rkap": 2025, "pic": "old"} | more for k in keys))


# ---- versions ----


def test_newest_version_wins_and_ties_go_to_the_last_inserted(spark):
    versions = spark.createDataFrame(
        [("A", stamp("2025-01-01T00:00:00"), 1, "x"), ("A", stamp("2025-01-02T00:00:00"), 2, "y"),
         ("A", stamp("2025-01-02T00:00:00"), 3, "z"), ("B", None, 4, "n"), ("B", OLD, 5, "m")],
        "id_root string, updated_at timestamp, seq int, v string",
    )
    assert rows(ch.dedup_latest(versions, seq="seq"), "id_root", "v") == [("A", "z"), ("B", "m")]


def test_wider_key_keeps_a_moved_project_twice(spark):
    versions = spark.createDataFrame(
        [("A", "West", OLD), ("A", "East", NOW)], "id_root string, klaster_regional string, updated_at timestamp"
    )
    assert ch.dedup_latest(versions).count() == 1
    assert ch.dedup_latest(versions, ["klaster_regional", "id_root"]).count() == 2


def test_last_operation_by_time_then_arrival(spark):
    events = spark.createDataFrame(
        [("A", NOW, 1, "INSERT"), ("A", OLD, 2, "DELETE"), ("B", OLD, 3, "INSERT"), ("B", OLD, 4, "DELETE"),
         (None, OLD, 5, "DELETE"), ("", OLD, 6, "DELETE")],
        "id_root string, timestamp timestamp, seq int, operation string",
    )
    assert rows(ch.last_operation(events), "id_root", "operation") == [("A", "INSERT"), ("B", "DELETE")]


def test_a_hot_key_is_reduced_before_the_shuffle(spark):
    events = spark.range(3000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'HOT' ELSE concat('K', id) END AS id_root",
        "timestamp_micros(id) AS timestamp", "id AS seq", "'UPDATE' AS operation",
    )
    last = ch.last_operation(events)
    plan = last._jdf.queryExecution().executedPlan().toString()
    # The local top-1 stands below the exchange.
    assert "Partial" in plan.split("Exchange")[-1] and "WindowGroupLimit" in plan.split("Exchange")[-1]
    assert last.count() == 2001
    assert last.where("id_root = 'HOT'").first().seq == 2997


# ---- insert, delete, upsert ----


def test_insert_refuses_known_repeated_and_missing_keys(make):
    led = ledger(make, "A", "B")
    incoming = make(
        {"id_root": "B", "updated_at": NOW}, {"id_root": "B", "updated_at": OLD},
        {"id_root": "C", "updated_at": OLD, "type_investasi": "Unknown"},
        {"id_root": "C", "updated_at": NOW, "type_investasi": "Murni"},
        {"id_root": "D", "updated_at": NOW, "type_investasi": "Murni"}, {"id_root": None},
    )
    after, refused = ch.insert_rows(led, incoming)
    assert rows(after, "id_root", "type_investasi") == [("A", None), ("B", None), ("C", None), ("D", "Murni")]
    assert rows(refused) == [("B", "exists", 2), ("C", "repeated", 1), (None, "missing", 1)]


def test_delete(spark, make):
    keys = spark.createDataFrame([("B",), ("B",), ("Z",)], "id_root string")
    assert rows(ch.delete_keys(ledger(make, "A", "B"), keys), "id_root") == [("A",)]


def test_upsert_is_idempotent_and_ignores_stale_rows(make):
    led = ledger(make, "A", "B")
    incoming = make(
        {"id_root": "A", "updated_at": NOW, "pic": "new"},
        {"id_root": "B", "updated_at": stamp("2024-01-01T00:00:00"), "pic": "stale"},
        {"id_root": "C", "updated_at": NOW, "pic": "new"},
    )
    once = ch.upsert(led, incoming)
    expected = [("A", "new"), ("B", "old"), ("C", "new")]
    assert rows(once, "id_root", "pic") == expected
    assert rows(ch.upsert(once, incoming), "id_root", "pic") == expected


def test_upsert_under_a_wider_key_matches_null_parts(make):
    led = make({"id_root": "A", "entitas_terminal": None, "updated_at": OLD, "pic": "old"})
    incoming = make(
        {"id_root": "A", "entitas_terminal": None, "updated_at": OLD, "pic": "tie"},
        {"id_root": "A", "entitas_terminal": "Pier", "updated_at": NOW, "pic": "moved"},
    )
    after = ch.upsert(led, incoming, ["entitas_terminal", "id_root"])
    assert rows(after, "entitas_terminal", "pic") == [(None, "tie"), ("Pier", "moved")]


def test_a_small_batch_leaves_the_ledger_unshuffled(spark, make):
    led = ledger(make, *(f"K{i}" for i in range(50)))

    def plan_of(after):
        after.collect()
        return after._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]

    upserted = plan_of(ch.upsert(led, ledger(make, "K1")))
    assert "BroadcastHashJoin" in upserted and "SortMergeJoin" not in upserted
    # What is added is settled before, so the ledger's rows only pass through.
    inserted = plan_of(ch.insert_rows(led, ledger(make, "K1"))[0])
    assert "Join" not in inserted and "Exchange" not in inserted
    marked = plan_of(ch.mark_inserts(led, ledger(make, "K1")))
    assert "BroadcastHashJoin" in marked


# ---- column updates ----


def test_partial_update_can_set_null_and_leaves_the_unnamed(spark, make):
    led = ledger(make, "A", "B", "C", jangka_waktu=7)
    changes = spark.createDataFrame(
        [("A", OLD, 1, "first", 30, ["pic", "jangka_waktu"]), ("A", NOW, 2, None, None, ["pic"]),
         ("B", OLD, 3, "ignored", 5, [])],
        "id_root string, timestamp timestamp, seq int, pic string, jangka_waktu int, set_columns array<string>",
    )
    after = ch.partial_update(led, changes, ["pic", "jangka_waktu"], as_of())
    assert rows(after, "id_root", "pic", "jangka_waktu", "updated_at") == [
        ("A", None, 30, NOW), ("B", "old", 7, OLD), ("C", "old", 7, OLD),
    ]
    assert after.schema.names == led.schema.names


def test_progress_leaves_null_and_refuses_bad_status(spark, make):
    led = ledger(make, "A", "B", status_issue="Open", action_target="t")
    changes = spark.createDataFrame(
        [("A", OLD, 1, "Closed", "x"), ("A", NOW, 2, None, None), ("B", OLD, 3, "Later", "y"),
         ("B", NOW, 4, "", None)],
        "id_root string, timestamp timestamp, seq int, status_issue string, action_target string",
    )
    after = ch.update_progress(led, changes, as_of())
    assert rows(after, "id_root", "status_issue", "action_target", "updated_at") == [
        ("A", "Closed", "x", NOW), ("B", "", "t", NOW),
    ]
    assert rows(ch.progress_rejects(changes), "seq") == [(3,)]


def test_months_are_set_not_added_and_unknown_names_go_aside(spark, make):
    led = ledger(make, "A", "B", prognosa_sd_desember=1, rkap=9)
    changes = spark.createDataFrame(
        [("A", OLD, 1, "DESEMBER", Decimal(5)), ("A", NOW, 2, "desember", Decimal(8)),
         ("B", OLD, 3, "december", Decimal(4)), ("B", OLD, 4, None, Decimal(4))],
        "id_root string, timestamp timestamp, seq int, bulan string, nilai decimal(18,2)",
    )
    after = ch.set_months(led, changes, "prognosa", as_of())
    assert rows(after, "id_root", "prognosa_sd_desember", "rkap", "updated_at") == [
        ("A", 8, 9, NOW), ("B", 1, 9, OLD),
    ]
    assert rows(ch.month_rejects(changes), "seq") == [(3,), (4,)]


def test_random_month_changes_match_one_by_one_application(spark, make):
    pick = random.Random(7)
    keys = [f"K{i}" for i in range(12)]
    # A third of all changes hit one key.
    events = [
        ("K0" if i % 3 == 0 else pick.choice(keys), OLD + dt.timedelta(minutes=pick.randrange(40)), i,
         pick.choice(MONTHS), Decimal(pick.randrange(1000)))
        for i in range(600)
    ]
    state = {k: dict.fromkeys(REALISASI_MONTHS) for k in keys}
    for key, _, _, month, value in sorted(events, key=lambda e: (e[1], e[2])):
        state[key][f"realisasi_{month}"] = value
    changes = spark.createDataFrame(
        events, "id_root string, timestamp timestamp, seq int, bulan string, nilai decimal(18,2)"
    ).repartition(4)
    after = ch.set_months(ledger(make, *keys), changes, "realisasi", as_of())
    got = {r.id_root: {c: r[c] for c in REALISASI_MONTHS} for r in after.collect()}
    assert got == state


# ---- children ----


def test_children_follow_deletes_and_renames(spark, make):
    led = ledger(make, "A-001", "B-001")
    children = spark.createDataFrame(
        [(1, "A-001"), (2, "A-001"), (3, "B-001"), (4, "C-001")], "id long, id_root string"
    )
    assert rows(ch.orphans(children, led)) == [(4, "C-001")]
    gone = spark.createDataFrame([("A-001",)], "id_root string")
    assert rows(ch.cascade_delete(children, gone), "id") == [(3,), (4,)]
    renames = spark.createDataFrame([("A-001", "Z-001")], "old_id string, new_id string")
    assert rows(ch.cascade_rename(children, renames)) == [
        (1, "Z-001"), (2, "Z-001"), (3, "B-001"), (4, "C-001"),
    ]
    assert rows(ch.cascade_rename(led, renames), "id_root") == [("B-001",), ("Z-001",)]


# ---- compare ----


def test_diff_sees_a_value_move_between_null_columns(make):
    old = make({"id_root": "A", "pic": "x"}, {"id_root": "B"}, {"id_root": "C"})
    new = make({"id_root": "A", "no_kontrak": "x"}, {"id_root": "B"}, {"id_root": "D"})
    assert rows(compare.diff(old, new)) == [("A", "UPDATE"), ("C", "DELETE"), ("D", "INSERT")]
    assert rows(compare.sync_diff(new, old)) == [("A", "changed"), ("C", "extra"), ("D", "missing")]
    event = compare.change_events(old, new, as_of()).where("id_root = 'C'").first()
    assert event.payload == '{"operation":"DELETE","id_root":"C","timestamp":"2025-06-01T00:00:00.000Z"}'


def test_key_change_shows_as_delete_and_insert(make):
    old, new = make({"id_root": "A", "pic": "x"}), make({"id_root": "B", "pic": "x"})
    assert rows(compare.diff(old, new)) == [("A", "DELETE"), ("B", "INSERT")]


def test_counts(make):
    led = ledger(make, "A", "B", "C")
    assert rows(compare.sync_counts(led, led.where("id_root = 'A'"))) == [(3, 1, 2, False)]
    assert rows(compare.sync_counts(led.where("false"), led.where("false"))) == [(0, 0, 0, True)]


def test_an_id_with_several_new_names_keeps_its_own(spark):
    children = spark.createDataFrame([("X", 1), ("Y", 2)], "id_root string, n int")
    renames = spark.createDataFrame([("X", "Y1"), ("X", "Z1"), ("Y", "W"), ("Y", "W")], "old_id string, new_id string")
    assert rows(ch.cascade_rename(children, renames)) == [("W", 2), ("X", 1)]
    assert rows(ch.rename_rejects(renames), "old_id", "new_id", "reason") == [
        ("X", "Y1", "several_names"), ("X", "Z1", "several_names"),
    ]


def test_changes_that_hit_nothing_are_reported(spark, make):
    led = make({"id_root": "A"}, {"id_root": "B"})
    asked = spark.createDataFrame(
        [("A", "mei", 1), ("A", "meix", 2), ("Z", "mei", 3), (None, "mei", 4), ("", "mei", 5), ("Z", None, 6)],
        "id_root string, bulan string, n int",
    )
    refused = ch.refused_changes(led, asked, ch.bad_month(), "bad_month")
    assert rows(refused, "n", "reason") == [
        (2, "bad_month"), (3, "unknown_id"), (4, "missing_id"), (5, "missing_id"), (6, "bad_month"),
    ]
    assert rows(ch.refused_changes(led, asked), "n") == [(3,), (4,), (5,), (6,)]
    assert ch.refused_changes(led.where("false"), asked.where("false")).count() == 0


def test_renames_that_conflict_are_refused_with_their_reason(spark, make):
    led = make(*({"id_root": k} for k in ("A", "B", "C", "D", "E", "F", "G", "H", "I", "J", "K", "L", "M", "N")))
    asked = [
        ("A", "B"), ("C", "B"),  # share a name: both stay, and so no two rows B
        ("D", "E"), ("E", "D"),  # a swap
        ("F", "G"), ("G", "H"), ("H", "new"),  # a chain into the open
        ("I", "J"), ("J", "K"),  # a chain into K, which stays
        ("L", "l1"), ("L", "l2"), ("M", "L"),  # L stays, as it is to have two names
        ("none", "z"), ("N", "none"),  # nothing to move, so its name is free
        (None, "x"), ("A", None), ("A", ""), ("B", "B"), ("N", "none"),
    ]
    renames = spark.createDataFrame(asked, "old_id string, new_id string").withColumn("note", F.lit("extra"))
    outcomes = ch.rename_outcomes(led, renames)
    reasons = {(r.old_id, r.new_id): r.reason for r in outcomes.collect()}
    assert len(reasons) == outcomes.count() == len(set(asked))
    assert reasons == {
        ("A", "B"): "shared_name", ("C", "B"): "shared_name", ("D", "E"): None, ("E", "D"): None,
        ("F", "G"): None, ("G", "H"): None, ("H", "new"): None, ("I", "J"): "blocked", ("J", "K"): "name_in_use",
        ("L", "l1"): "several_names", ("L", "l2"): "several_names", ("M", "L"): "name_in_use",
        ("none", "z"): "unknown_id", ("N", "none"): None, (None, "x"): "missing_id", ("A", None): "missing_id",
        ("A", ""): "missing_id", ("B", "B"): "same_name",
    }
    after = ch.cascade_rename(led.select("id_root"), ch.followed(outcomes))
    assert rows(after) == [(k,) for k in ("A", "B", "C", "D", "E", "G", "H", "I", "J", "K", "L", "M", "new", "none")]


def test_long_chains_and_rings_of_renames(spark, make):
    keys = [f"k{i:02d}" for i in range(40)]
    led = make(*({"id_root": k} for k in keys))

    def outcome(pairs):
        return {r.old_id: r.reason for r in ch.rename_outcomes(led, spark.createDataFrame(pairs, "old_id string, new_id string")).collect()}

    ring = list(zip(keys[:7], keys[1:7] + keys[:1]))
    chain = list(zip(keys[10:30], keys[11:30] + ["free"]))
    stopped = list(zip(keys[31:39], keys[32:40]))
    found = outcome(ring + chain + stopped)
    assert all(found[a] is None for a, _ in ring + chain)
    assert [found[a] for a, _ in stopped] == ["blocked"] * 7 + ["name_in_use"]
    assert outcome([]) == {}


def test_incoming_rows_are_read_once_and_marked(spark, make):
    path = new_workspace(spark, "sent")
    led = make({"id_root": "A", "updated_at": OLD}, {"id_root": "B", "updated_at": NOW}, {"id_root": "C"})
    make({"id_root": "A", "updated_at": NOW, "pic": "new"}, {"id_root": "A", "updated_at": OLD, "pic": "old"}, {"id_root": "B", "updated_at": OLD},
         {"id_root": "C", "updated_at": OLD}, {"id_root": "D", "updated_at": OLD}, {"id_root": "D", "updated_at": NOW, "pic": "last"}, {}).write.parquet(path)
    sent = spark.read.parquet(path)
    marked = ch.mark_upserts(led, sent.where("id_root IS NOT NULL"))
    assert rows(marked, "id_root", "outcome", "pic") == [
        ("A", "replaced", "new"), ("B", "older", None), ("C", "replaced", None), ("D", "added", "last")]
    inserts = ch.mark_inserts(led, sent)
    assert rows(inserts, "id_root", "outcome", "pic") == [
        ("A", "exists", "new"), ("A", "exists", "old"), ("B", "exists", None), ("C", "exists", None), ("D", "added", None),
        ("D", "repeated", "last"), (None, "missing", None)]
    after, refused = ch.insert_rows(led, sent)
    # The input was read when it was marked; what is made of it reads the marked rows.
    for result in (marked, inserts, after, refused, ch.upsert(led, sent)):
        assert path not in result._jdf.queryExecution().optimizedPlan().toString()
        assert not any(path in f for f in result.inputFiles())


# ---- what moves ----


def test_wide_incoming_rows_move_once_to_be_marked(spark, make, monkeypatch):
    monkeypatch.setattr(ch, "known_keys", lambda led, keys: led.select("id_root").distinct())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        marked = ch.mark_inserts(ledger(make, "K1"), ledger(make, "K1", "K2", "K2"))
        plan = marked._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert len(joins) == 2 and not any("_row" in line for line in joins)
    assert sorted(r["outcome"] for r in marked.collect()) == ["added", "exists", "repeated"]


def test_marks_of_an_upsert_are_written_as_keys(make, monkeypatch):
    written, write = {}, ch._written

    def recording(rows, label):
        written[label] = rows.columns
        return write(rows, label)

    monkeypatch.setattr(ch, "_written", recording)
    after = ch.upsert(ledger(make, "K1"), ledger(make, "K1", "K2"))
    assert rows(after, "id_root") == [("K1",), ("K2",)]
    assert written["marked"] == ["_mark_id_root", "outcome"]
