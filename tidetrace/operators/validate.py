"""Input checks (VAL1-VAL5). Rows are never dropped silently: each gets a
reject reason, so the caller can split accepted rows from a reject table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidetrace.functions.parse import parse_datetime
from tidetrace.functions.text import is_blank, strip_html, trim_whitespace

REQUIRED_POST_COLUMNS = ("Tweet", "Datetime")

# Narrative length limits and reject reason codes.
NARRATIVE_MIN_CHARS = 3
NARRATIVE_MAX_CHARS = 500
REASONS = ("blank_text", "empty_datetime", "bad_datetime")


def require_columns(df: DataFrame, required: Sequence[str] = REQUIRED_POST_COLUMNS) -> DataFrame:
    """VAL1: one error naming every missing column."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")
    return df


def reject_reason(text: Column, datetime_text: Column) -> Column:
    """VAL2/VAL3 on every row (not only the first five)."""
    return (F.when(is_blank(text), F.lit("blank_text"))
             .when(datetime_text.isNull() | (trim_whitespace(datetime_text) == ""), F.lit("empty_datetime"))
             .when(parse_datetime(datetime_text).isNull(), F.lit("bad_datetime")))


def tag_rejects(df: DataFrame, *, text_col: str = "Tweet", datetime_col: str = "Datetime") -> DataFrame:
    require_columns(df, (text_col, datetime_col))
    dt = F.col(datetime_col)
    dt_text = dt if dict(df.dtypes)[datetime_col] == "string" else dt.cast("string")
    return df.withColumn("reject_reason", reject_reason(F.col(text_col), dt_text))


def split_valid(tagged: DataFrame, *, require_rows: bool = False) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, reject table) from a tagged DataFrame.

    ``require_rows=True`` raises when no row is accepted (VAL2's "no valid
    data" error); it runs one ``limit(1)`` probe, not a full count."""
    good = tagged.where(F.col("reject_reason").isNull()).drop("reject_reason")
    if require_rows and good.limit(1).count() == 0:
        raise ValueError("No valid post data found: every row was rejected (see the reject table)")
    return good, tagged.where(F.col("reject_reason").isNotNull())


def quality_report(tagged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """VAL5: total / valid rows, count per reject reason, and column count."""
    r = F.col("reject_reason")
    aggs = [F.count(F.lit(1)).alias("n_rows"),
            F.count_if(r.isNull()).alias("n_valid")]
    aggs += [F.count_if(r == F.lit(x)).alias(f"n_{x}") for x in REASONS]
    n_cols = len([c for c in tagged.columns if c != "reject_reason"])
    out = tagged.groupBy(*by).agg(*aggs) if by else tagged.agg(*aggs)
    return out.withColumn("n_columns", F.lit(n_cols))


def validate_narratives(df: DataFrame, text_col: str = "text") -> DataFrame:
    """VAL4: a narrative must be a non-empty text of 3..500 characters, and
    keep at least 3 after HTML tags are stripped and whitespace trimmed."""
    t = F.col(text_col)
    clean = trim_whitespace(strip_html(t))
    reason = (F.when(t.isNull() | (t == ""), F.lit("empty"))
               .when(F.length(t) > NARRATIVE_MAX_CHARS, F.lit("too_long"))
               .when(F.length(t) < NARRATIVE_MIN_CHARS, F.lit("too_short"))
               .when(F.length(clean) < NARRATIVE_MIN_CHARS, F.lit("too_short_after_cleaning")))
    return df.withColumn("clean_text", F.when(reason.isNull(), clean)).withColumn("reject_reason", reason)
