"""Row classification and validation reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.images import image_status
from ..functions.schema import HATE_NAMES, LABELS, RAW_FIELDS, filled, unit, valid_multimodal
from ..functions.text import check_text, content_id

_NUMBER = r"^\s*[+-]?((\d+(_\d+)*)?\.?\d+(_\d+)*|\d+(_\d+)*\.)([eE][+-]?\d+)?\s*$|^\s*[+-]?([iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$"
_KINDS_OF_NUMBERS = ("BIGINT", "DOUBLE", "BOOLEAN", "FLOAT")


def _kind(field: str) -> Column:
    return F.expr(f"schema_of_variant(try_variant_get(v, '$.{field}', 'variant'))")


def _text(field: str) -> Column:
    return F.expr(f"try_variant_get(v, '$.{field}', 'string')")


def _is_number(field: str) -> Column:
    """JSON numbers, booleans and strings that spell a number."""
    kind = _kind(field)
    return kind.isin(*_KINDS_OF_NUMBERS) | kind.startswith("DECIMAL") | ((kind == "STRING") & _text(field).rlike(_NUMBER))


def _number(field: str) -> Column:
    boolean = F.when(_kind(field) == "BOOLEAN", F.expr(f"try_variant_get(v, '$.{field}', 'boolean')").cast("double"))
    return F.coalesce(boolean, F.expr(f"try_cast(replace(trim(try_variant_get(v, '$.{field}', 'string')), '_', '') AS double)"))


def classify_raw(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Each raw JSON row with ``status`` (valid, malformed, invalid), ``reasons`` and the parsed fields.

    Malformed: no JSON object, a missing field, text that is no string, a score that is no number.  Invalid: blank text or a
    score out of range.  Nothing is coerced silently; further keys are ignored.
    """
    parsed = rows.withColumn("v", F.try_parse_json(payload))
    is_object = F.coalesce(F.expr("schema_of_variant(v) LIKE 'OBJECT%'"), F.lit(False))
    missing = F.filter(F.array(*[F.when(F.coalesce(_kind(f), F.lit("VOID")) == "VOID", F.lit(f"missing field: {f}")) for f in RAW_FIELDS]), F.isnotnull)
    not_text = F.coalesce(_kind("text") != "STRING", F.lit(False))
    not_number = F.filter(F.array(*[F.when(~_is_number(f), F.lit(f"not a number: {f}")) for f in LABELS]), F.isnotnull)
    no_range = F.filter(F.array(*[F.when(~unit(_number(f)), F.lit(f"out of range: {f}")) for f in LABELS]), F.isnotnull)
    blank = F.array(F.lit("blank text"))
    reasons = (
        F.when(~is_object, F.array(F.lit("no JSON object")))
        .when(F.size(missing) > 0, missing)
        .when(not_text, F.array(F.lit("text is no string")))
        .when(F.size(not_number) > 0, not_number)
        .when(~filled(_text("text")), F.concat(blank, no_range))
        .otherwise(no_range)
    )
    status = (
        F.when(~is_object | (F.size(missing) > 0) | not_text | (F.size(not_number) > 0), "malformed")
        .when(~filled(_text("text")) | (F.size(no_range) > 0), "invalid")
        .otherwise("valid")
    )
    ok = F.col("status") == "valid"
    return (
        parsed.withColumn("status", status).withColumn("reasons", reasons)
        .withColumn("text", F.when(ok, _text("text"))).withColumn("content_id", content_id(F.col("text")))
        .withColumn("labels", F.when(ok, F.struct(*[_number(f).alias(f) for f in LABELS])))
        .drop("v")
    )


def status_counts(classified: DataFrame) -> DataFrame:
    """One row: total, valid, malformed and invalid rows."""
    return classified.agg(
        F.count("*").alias("total_rows"), *[F.count_if(F.col("status") == s).alias(f"{s}_rows") for s in ("valid", "malformed", "invalid")]
    )


def first_examples(classified: DataFrame, status: str, n: int = 20) -> DataFrame:
    """The first ``n`` rows of a status in input order, with their reasons (a report's feature)."""
    return classified.where(F.col("status") == status).select("row_idx", F.array_join("reasons", "; ").alias("reasons")).orderBy("row_idx").limit(n)


def label_distribution(examples: DataFrame, labels: str = "labels") -> DataFrame:
    """Mean and share of at least 0.5 per score; 0 where there are no rows."""
    one = examples.agg(
        *[F.coalesce(F.avg(f"{labels}.{n}"), F.lit(0.0)).alias(f"m_{n}") for n in LABELS],
        *[F.coalesce(F.avg((F.col(f"{labels}.{n}") >= 0.5).cast("double")), F.lit(0.0)).alias(f"f_{n}") for n in LABELS],
    )
    pairs = ", ".join(f"'{n}', m_{n}, f_{n}" for n in LABELS)
    return one.select(F.expr(f"stack({len(LABELS)}, {pairs}) AS (label, mean, fraction_ge_half)"))


def hate_distribution(examples: DataFrame, by: str = "split") -> DataFrame:
    """Counts per label name, total and rate of positives, per split."""
    counts = [F.count_if(F.col("hate_label") == k).alias(n.replace("-", "_")) for k, n in enumerate(HATE_NAMES)]
    return examples.groupBy(by).agg(*counts, F.count("*").alias("total"), F.coalesce(F.avg("hate_label"), F.lit(0.0)).alias("positive_rate"))


def multimodal_report(rows: DataFrame, blobs: DataFrame) -> DataFrame:
    """Counts per split and over all splits (null split_name): text, contract and picture checks in one pass.

    Text is checked before the contract, so a row can fail both; a bad picture does not make a row invalid.
    """
    checked = rows.where(F.col("split").isin("train", "dev", "test")).withColumn("c", check_text(F.col("text"))).withColumn("ok", valid_multimodal())
    status = blobs.select(F.col("path").alias("image_path"), image_status(F.col("content")).alias("image"))
    joined = checked.join(status, "image_path", "left")
    image = F.when(F.col("ok"), F.coalesce("image", F.lit("missing")))
    return (
        joined.withColumn("image", image).rollup("split").agg(
            F.count("*").alias("total_rows"), F.count_if("ok").alias("valid_rows"), F.count_if(~F.col("ok")).alias("malformed_rows"),
            F.count_if(~F.col("c.non_empty") | F.col("c.has_replacement_char")).alias("text_issues"),
            F.avg(F.col("c.contains_arabic").cast("double")).alias("arabic_fraction"),
            *[F.count_if(F.col("image") == s).alias(f"images_{s}") for s in ("ok", "corrupted", "missing")],
            F.coalesce(F.avg(F.when(F.col("ok"), F.col("hate_label"))), F.lit(0.0)).alias("positive_rate"),
        ).withColumnRenamed("split", "split_name")
    )
