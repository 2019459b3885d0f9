"""Scalar text functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as whitespace, in the notation of Java's regular expressions.
SPACE = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Space at either end; the look-behind lets long runs inside a text be tried only once.
_ENDS = f"^[{SPACE}]+|(?<![{SPACE}])[{SPACE}]+$"
WORD = "\\p{L}\\p{N}_"
ARABIC = "\\u0600-\\u06ff\\ufb50-\\ufdff\\ufe70-\\ufeff"
EXCERPT = 100


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _ENDS, "")


def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Compatibility form; the only step without a built-in function, done in Arrow batches."""
    return F.pandas_udf(_nfkc, "string")(text)


def normalize_text(text: Column) -> Column:
    """Compatibility form, lower case, only letters, digits and underscores, single spaces."""
    plain = F.regexp_replace(strip(F.lower(nfkc(text))), f"[^{WORD}{SPACE}]", "")
    return strip(F.regexp_replace(plain, f"[{SPACE}]+", " "))


def content_id(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(16))


def image_filename(example_id: Column) -> Column:
    return F.concat(content_id(example_id), F.lit(".jpg"))


def contains_arabic(text: Column) -> Column:
    return F.coalesce(text.rlike(f"[{ARABIC}]"), F.lit(False))


def check_text(text: Column) -> Column:
    """Struct of flags: text there, not blank, a replacement character in it, Arabic in it, and what is wrong."""
    there, full = text.isNotNull(), F.coalesce(F.length(strip(text)) > 0, F.lit(False))
    return F.struct(
        there.alias("text_exists"),
        full.alias("non_empty"),
        (full & F.coalesce(F.contains(text, F.lit("�")), F.lit(False))).alias("has_replacement_char"),
        (full & contains_arabic(text)).alias("contains_arabic"),
        F.when(~there, "missing").when(~full, "empty").alias("error"),
    )


def excerpt(text: Column, most: int = EXCERPT) -> Column:
    """At most ``most`` characters on one line, with dots where it was cut."""
    line = F.replace(strip(text), F.lit("\n"), F.lit(" "))
    cut = F.regexp_replace(F.substring(line, 1, most), f"(?<![{SPACE}])[{SPACE}]+$", "")
    return F.when(F.length(line) <= most, line).otherwise(F.concat(cut, F.lit("...")))
