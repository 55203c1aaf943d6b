"""Data quality: project checks, table constraints and the validation report.

Every rule is a column expression; a row's findings are gathered in one array and exploded, so the
whole table is checked in a single scan with no shuffle (duplicate keys and the reference to the
ledger need one each).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import lenient_total, zero_if_null
from ledgerloom.operators.changes import orphans
from ledgerloom.operators.shape import newest_first
from ledgerloom.schema import (
    INVESTMENT_TYPES,
    ISSUE_STATUSES,
    MONITORING_STATUSES,
    REALISASI_MONTHS,
    RKAP_MONTHS,
    TEXT_LENGTHS,
)

ERROR, WARNING, INFO = "ERROR", "WARNING", "INFO"


@dataclass(frozen=True)
class Rule:
    """SQL of a condition that finds fault, and of the text that says so."""

    name: str
    severity: str
    broken: str
    message: str


def _amount(name: str) -> str:
    return f"format_number({name}, 2)"


# Rules in report order (required, money, dates) over the columns of :func:`_with_amounts`.
# The message texts and the tolerances 0.01 and 1.1.
PROJECT_RULES = [
    Rule(
        "required_id", ERROR, "id_root IS NULL OR id_root = ''",
        "'[ERROR] Required field \\'id_root\\' is missing'",
    ),
    Rule(
        "budget_mismatch", INFO, "_budget > 0 AND _planned > 0 AND _gap > 0.01",
        f"concat('RKAP total (', {_amount('_budget')}, ') doesn\\'t match sum of monthly (', "
        f"{_amount('_planned')}, '), diff: ', {_amount('_gap')})",
    ),
    Rule(
        "over_budget", WARNING, "_budget > 0 AND _actual > _budget",
        f"concat('[WARNING] Realisasi (', {_amount('_actual')}, ') exceeds RKAP (', "
        f"{_amount('_budget')}, ')')",
    ),
    Rule(
        "contract_high", WARNING, "_contract > 0 AND _budget > 0 AND _contract > _budget * 1.1",
        f"concat('[WARNING] Contract value (', {_amount('_contract')}, "
        f"') is significantly higher than RKAP (', {_amount('_budget')}, ')')",
    ),
    Rule(
        "end_before_start", ERROR, "tanggal_selesai < tgl_mulai_kontrak",
        "'[ERROR] Contract end date is before start date'",
    ),
    Rule(
        "start_before_signing", WARNING, "tgl_mulai_kontrak < tanggal_kontrak",
        "'[WARNING] Contract start date is before contract signing date'",
    ),
]


def _with_amounts(led: DataFrame) -> DataFrame:
    return led.withColumns({
        "_budget": zero_if_null(F.col("rkap")),
        "_contract": zero_if_null(F.col("nilai_kontrak")),
        "_planned": lenient_total(RKAP_MONTHS),
        "_actual": lenient_total(REALISASI_MONTHS),
    }).withColumn("_gap", F.expr("abs(_budget - _planned)"))


_IS_VALID = " AND ".join(
    f"NOT coalesce({r.broken}, false)" for r in PROJECT_RULES if r.severity == ERROR
)
_FINDING_COUNT = " + ".join(f"int(coalesce({r.broken}, false))" for r in PROJECT_RULES)


def validate(led: DataFrame) -> DataFrame:
    """The ledger with ``is_valid`` (no finding is an error) and ``finding_count``."""
    return _with_amounts(led).selectExpr(
        *led.columns, f"({_IS_VALID}) AS is_valid", f"{_FINDING_COUNT} AS finding_count"
    )


def issues(led: DataFrame, invalid_only: bool = False) -> DataFrame:
    """One row per finding; ``position`` is the rule's place in report order.

    ``invalid_only`` keeps the printed report's view, which hides findings of valid projects.
    """
    checked = _with_amounts(led)
    if invalid_only:
        checked = checked.where(f"NOT ({_IS_VALID})")
    findings = ", ".join(
        f"CASE WHEN {r.broken} THEN struct({i} AS position, '{r.name}' AS rule, "
        f"'{r.severity}' AS severity, {r.message} AS message) END"
        for i, r in enumerate(PROJECT_RULES)
    )
    return (
        checked.selectExpr("id_root", "updated_at", f"explode(array({findings})) AS finding")
        .where("finding IS NOT NULL")
        .select("id_root", "updated_at", "finding.*")
    )


def report(led: DataFrame, shown: int = 50) -> DataFrame:
    """Report head: projects, valid ones, others, their findings and how many go unshown."""
    bad = ~F.col("is_valid")
    return (
        validate(led)
        .agg(
            F.count("*").alias("total"),
            F.count_if(F.col("is_valid")).alias("valid"),
            F.count_if(bad).alias("with_issues"),
            zero_if_null(F.sum(F.when(bad, F.col("finding_count")))).alias("issue_lines"),
        )
        .withColumn("more", F.greatest(F.col("issue_lines") - shown, F.lit(0).cast("bigint")))
    )


def first_issues(led: DataFrame, shown: int = 50) -> DataFrame:
    """The report's issue lines: the first ones of invalid projects, newest project first."""
    return (
        issues(led, invalid_only=True)
        .orderBy(*newest_first(), "position")
        .limit(shown)
        .select("id_root", "position", "message")
    )


# ---- constraints ---------------------------------------------------------------------------


def _words(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


LEDGER_RULES = {
    "id_root_null": "id_root IS NULL",
    "type_investasi_domain": f"type_investasi NOT IN ({_words(INVESTMENT_TYPES)})",
    "status_issue_domain": f"status_issue NOT IN ({_words(ISSUE_STATUSES)})",
    "latitude_range": "latitude NOT BETWEEN -90 AND 90",
    "longitude_range": "longitude NOT BETWEEN -180 AND 180",
    "jangka_waktu_negative": "jangka_waktu < 0",
    **{f"{c}_length": f"length({c}) > {n}" for c, n in TEXT_LENGTHS.items() if n is not None},
}
MONITORING_RULES = {
    "id_root_null": "id_root IS NULL",
    "id_root_suffix": "id_root NOT LIKE '%-001'",
    "tanggal_null": "tanggal_monitoring IS NULL",
    "progres_fisik_range": "progres_fisik NOT BETWEEN 0 AND 100",
    "progres_keuangan_range": "progres_keuangan NOT BETWEEN 0 AND 100",
    "status_domain": f"status_monitoring NOT IN ({_words(MONITORING_STATUSES)})",
}


def _violations(rows: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """(keys…, rule) for every rule a row breaks; a NULL outcome passes, as a CHECK would."""
    broken = ", ".join(f"CASE WHEN {c} THEN '{name}' END" for name, c in rules.items())
    return rows.selectExpr(*keys, f"explode(array({broken})) AS rule").where("rule IS NOT NULL")


def ledger_violations(led: DataFrame) -> DataFrame:
    """Broken ledger constraints: key, allowed words, lengths, map ranges, duration."""
    repeated = (
        led.where("id_root IS NOT NULL")
        .groupBy("id_root")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .selectExpr("id_root", "'id_root_duplicate' AS rule")
    )
    return _violations(led, ["id_root"], LEDGER_RULES).unionByName(repeated)


def monitoring_violations(monitoring: DataFrame, led: DataFrame) -> DataFrame:
    """Broken monitoring constraints, the reference to the ledger among them."""
    unknown = orphans(monitoring.where("id_root IS NOT NULL"), led).selectExpr(
        "id", "id_root", "'id_root_unknown' AS rule"
    )
    return _violations(monitoring, ["id", "id_root"], MONITORING_RULES).unionByName(unknown)


def violation_counts(violations: DataFrame) -> DataFrame:
    return violations.groupBy("rule").agg(F.count("*").alias("violations"))
