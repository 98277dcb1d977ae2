"""Application payloads: read (S1), notes default (S2), quarantine split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendflow import params as P
from lendflow.session import materialize
from lendflow.sources.schemas import APP_SCHEMA

CORRUPT = "_corrupt_record"
READ_SCHEMA = T.StructType(APP_SCHEMA.fields + [T.StructField(CORRUPT, T.StringType())])


def read_applications(spark: SparkSession, path: str) -> DataFrame:
    """One pretty-printed JSON object per file, the whole directory at once.

    ``multiLine`` is required (otherwise every line is a corrupt record) and the schema is
    explicit (otherwise amounts infer as bigint).  Unparseable files keep their raw text in
    ``_corrupt_record`` and are quarantined, never dropped.
    """
    return (spark.read.schema(READ_SCHEMA).option("multiLine", True)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path))


def with_notes_default(df: DataFrame) -> DataFrame:
    """Absent notes get the default sentence (JSON null and absent both read as null)."""
    return df.withColumn("applicant_notes", F.coalesce(F.col("applicant_notes"), F.lit(P.DEFAULT_NOTES)))


# Fields the assessment cannot run without (the name is masked, so a missing name is not fatal).
NEEDED = (
    "application_id", "gross_annual_income", "declared_living_expenses", "requested_loan_amount",
    "base_interest_rate", "existing_debts_monthly", "cdr_verified_expenses_monthly",
)
NON_NEGATIVE = ("declared_living_expenses", "existing_debts_monthly", "cdr_verified_expenses_monthly")


def reject_reasons(df: DataFrame, p=P.DEFAULT_POLICY) -> F.Column:
    """Array of reasons a row cannot be assessed; empty when it can."""
    checks = []
    if CORRUPT in df.columns:
        checks.append((F.col(CORRUPT).isNotNull(), "malformed_json"))
    checks += [(F.col(c).isNull(), f"missing:{c}") for c in NEEDED]
    checks += [
        (F.col("gross_annual_income") <= 0, "non_positive_income"),
        (F.col("requested_loan_amount") <= 0, "non_positive_loan"),
    ]
    checks += [(F.col(c) < 0, f"negative:{c}") for c in NON_NEGATIVE]
    checks.append(((F.col("base_interest_rate").cast("double") + F.lit(p.buffer)) == 0, "zero_stressed_rate"))
    return F.array_compact(F.array(*[F.when(cond, F.lit(reason)) for cond, reason in checks]))


def quarantine(df: DataFrame, p=P.DEFAULT_POLICY):
    """(valid, rejected).  ``rejected`` carries ``reject_reasons``; valid + rejected = input.

    Both halves come from one tagged DataFrame; callers that consume both should persist the
    input first so it is scanned once."""
    tagged = df.withColumn("reject_reasons", reject_reasons(df, p))
    valid = tagged.filter(F.size("reject_reasons") == 0).drop("reject_reasons")
    if CORRUPT in valid.columns:
        valid = valid.drop(CORRUPT)
    rejected = tagged.filter(F.size("reject_reasons") > 0)
    return valid, rejected


# --- Z2: repeated submissions ----------------------------------------------------------------------
DUPLICATE = "duplicate_submission"


def submission_key() -> F.Column:
    """What makes two submissions the same: the application and everything it says."""
    return F.sha2(F.to_json(F.struct(*APP_SCHEMA.names)), 256)


def split_duplicates(valid: DataFrame, order=()):
    """(first, repeated): the first row (by ``order``) of each submission, and the rest with reject_reasons.
    first + repeated = input; a changed resubmission of an application is not a repeat.

    Rows are numbered and written once.  The first of a submission is a partial aggregate, and rows meet the firsts by
    their number, so a payload sent a million times is neither sorted nor gathered in one task."""
    keyed = materialize(valid.withColumn("submission_key", submission_key())
                        .withColumn("_row", F.monotonically_increasing_id()), "submissions")
    first = keyed.groupBy("submission_key").agg(F.min_by("_row", F.struct(*order, "_row")).alias("_row")).select("_row")
    repeated = keyed.join(first, "_row", "left_anti").withColumn("reject_reasons", F.array(F.lit(DUPLICATE)))
    return keyed.join(first, "_row", "left_semi").drop("_row"), repeated.drop("_row")
