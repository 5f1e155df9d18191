"""Text expressions: tokens, HTML stripping, blank tests, file-key cleaning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values (must match the tokenisation rule the fixtures are defined with):
# lower-case, split on runs of space / newline / tab / carriage return, drop empties.
TOKEN_SPLIT = r"[ \n\t\r]+"
HTML_TAG = r"<[^>]*>"
NOT_LETTER_OR_DIGIT = r"[^\p{L}\p{N}]"
NULL_CHANNEL_KEY = "__null__"


def tokens(text: Column) -> Column:
    """ARRAY<STRING> of lower-cased tokens, empties dropped."""
    return F.array_remove(F.split(F.lower(text), TOKEN_SPLIT), F.lit(""))


def squared_norm_of_counts(toks: Column) -> Column:
    """sum over distinct tokens of count(token)^2, computed per row.

    Sort the tokens, then walk the runs: a run growing from r to r+1 adds
    2r+1 to the sum of squares. Keeps the post-side norm free of any shuffle.
    """
    init = F.struct(F.lit(None).cast("string").alias("p"),
                    F.lit(0).cast("long").alias("r"),
                    F.lit(0).cast("long").alias("s"))

    def step(st, x):
        same = st["p"] == x
        return F.when(same, F.struct(x.alias("p"), (st["r"] + 1).alias("r"),
                                     (st["s"] + 2 * st["r"] + 1).alias("s"))) \
                .otherwise(F.struct(x.alias("p"), F.lit(1).cast("long").alias("r"),
                                    (st["s"] + 1).alias("s")))

    return F.aggregate(F.sort_array(toks), init, step, lambda st: st["s"])


def strip_html(text: Column) -> Column:
    return F.regexp_replace(text, HTML_TAG, "")


def trim_whitespace(text: Column) -> Column:
    """Trim every kind of ASCII whitespace (Spark's trim() removes spaces only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    """True when null or without any non-whitespace character."""
    return text.isNull() | ~text.rlike(r"\S")


def channel_key(channel: Column) -> Column:
    """File-safe key: every character that is not a letter or digit becomes '_'."""
    return F.when(channel.isNull(), F.lit(NULL_CHANNEL_KEY)) \
            .otherwise(F.regexp_replace(channel, NOT_LETTER_OR_DIGIT, "_"))


def text_key(text: Column) -> Column:
    """Content key used to reuse embeddings of identical texts."""
    return F.sha2(text, 256)
