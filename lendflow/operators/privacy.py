"""Masking and re-identification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendflow import params as P
from lendflow.functions.text import is_blank, mask_pii, name_pattern
from lendflow.operators.people import mask_people, people_leaks
from lendflow.session import materialize


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mask_name(name="applicant_name") -> Column:
    """The name column is known PII, so it is replaced whole: ``<PERSON>``, or
    ``[REDACTED_PERSON]`` when there is no usable name.  No substring of the raw name is ever
    emitted (the reference's detect-and-replace could leak partial names)."""
    return F.when(is_blank(name), F.lit(P.REDACTED_PERSON)).otherwise(F.lit(P.MASKED_PERSON))


def mask_text(text, name=None) -> Column:
    """P10: structured PII by tokens, then the row's known name - whole or any of its words, in any
    case - by ``<PERSON>``."""
    return mask_pii(text) if name is None else mask_own_name(mask_pii(text), name)


def mask_own_name(text, name) -> Column:
    """The row's known name, whole or any of its words, in any case, by ``<PERSON>``."""
    nothing = F.lit("(?!)")                      # a pattern in either case: the text stands in the plan once
    return F.regexp_replace(_c(text), F.when(is_blank(name), nothing).otherwise(name_pattern(name)),
                            F.lit(P.MASKED_PERSON))


def mask_applications(apps: DataFrame, directory: DataFrame | None = None) -> DataFrame:
    """Name and notes masked in place, before anything leaves the job.  With a ``directory`` (``real_name``) the
    notes lose every name of it too, whoever's it is; that goes before the own name's single words, which
    would tear other names apart."""
    masked_name = {"applicant_name": mask_name("applicant_name")}
    if directory is None:
        return apps.withColumns({"applicant_notes": mask_text("applicant_notes", "applicant_name"), **masked_name})
    # Written: Catalyst would otherwise paste the patterns into every use of the notes.
    tokens = materialize(apps.withColumn("applicant_notes", mask_text("applicant_notes")), "tokens")
    out = mask_people(tokens, directory, "applicant_notes")
    return out.withColumns({"applicant_notes": mask_own_name("applicant_notes", "applicant_name"), **masked_name})


def reidentify(rows: DataFrame, directory: DataFrame) -> DataFrame:
    """J1 + P12: console names.  Plain equi-join: the directory grows with the book, so Spark
    broadcasts it only when its measured size allows (static estimate, then AQE at runtime).  ``display_name`` = directory name, else the ledger's name,
    else ``Unknown Applicant`` (copilot); ``detail_name`` = directory name else
    ``Unknown Applicant`` (detail view).  An access-controlled view, never written back."""
    j = rows.join(directory.select("application_id", "real_name"), "application_id", "left")
    return j.withColumns({
        "display_name": F.coalesce(F.col("real_name"), F.col("applicant_name"), F.lit(P.UNKNOWN_APPLICANT)),
        "detail_name": F.coalesce(F.col("real_name"), F.lit(P.UNKNOWN_APPLICANT)),
    })


# What the audit looks for.  Wider than the masking patterns and independent of them: any
# address sign between two characters, 13 or more and 8 or more digits that only separators interrupt.
AUDIT_PATTERNS = (
    ("EMAIL", r"[^ ]@[^ ]"),
    ("CARD", r"([0-9][ -]?){13}"),
    ("PHONE", r"([0-9][ ()-]{0,2}){8}"),
)


def _holds_any(text: Column, words: Column) -> Column:
    return F.exists(words, lambda w: text.contains(w))


def leak_audit(rows: DataFrame, directory: DataFrame, text_columns) -> DataFrame:
    """Per text column, rows that still look like holding PII (``AUDIT_PATTERNS``), a word of the
    application's real name (NAME) or any other name of the directory (OTHER_NAME, ``people_leaks``).  The rows and
    their names are written once, as both halves read them.  Patterns and own names take one pass: every (column, kind) check is a ``count_if`` of a single global
    aggregate (partial on the map side); only the small result is unpivoted to
    (column_name, leak_kind, n_rows, n_checked) and meets the other names' counts."""
    j = (rows.select(*dict.fromkeys(["application_id", *text_columns]))
         .join(directory.select("application_id", "real_name"), "application_id", "left"))
    words = F.filter(F.split(F.lower("real_name"), " "), lambda w: F.length(w) > 2)
    j = materialize(j.withColumn("_words", words), "audit")
    checks = []
    for c in text_columns:
        for kind, pattern in AUDIT_PATTERNS:
            checks.append((c, kind, F.col(c).rlike(pattern)))
        checks.append((c, "NAME", _holds_any(F.lower(F.col(c)), F.col("_words"))))
        checks.append((c, "OTHER_NAME", F.lit(False)))
    aggs = [F.count_if(F.coalesce(cond, F.lit(False))).alias(f"_h{i}") for i, (_, _, cond) in enumerate(checks)]
    tot = j.agg(F.count(F.lit(1)).alias("_n"), *aggs)
    out = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(kind).alias("leak_kind"),
                             F.col(f"_h{i}").alias("n_rows"), F.col("_n").alias("n_checked"))
                    for i, (c, kind, _) in enumerate(checks)])
    others = people_leaks(j, directory, text_columns, own="real_name").select(
        "column_name", F.lit("OTHER_NAME").alias("leak_kind"), F.col("n_rows").alias("_others"))
    return (tot.select(F.inline(out)).join(others, ["column_name", "leak_kind"], "left")
            .select("column_name", "leak_kind", F.coalesce("_others", "n_rows").alias("n_rows"), "n_checked"))


def directory_mismatch(apps: DataFrame, directory: DataFrame) -> DataFrame:
    """Applications whose payload name differs from the directory's (null-safe)."""
    j = apps.select("application_id", "applicant_name").join(
        directory.select("application_id", "real_name"), "application_id", "inner")
    return j.filter(~F.col("applicant_name").eqNullSafe(F.col("real_name")))
