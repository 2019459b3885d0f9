"""The pN_ queries: each problem's operator over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import abuse, language, layout_copies, leak_search, lookalike, mixing, mojibake, pii, shared_spans, split_overlap
from .base import read_table
from .oracles import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]


def both_texts(spark: SparkSession, sf_dir: str, with_source: bool = False) -> DataFrame:
    """``tbl, row_idx, text`` (and ``source``) of moderation_examples and multimodal_examples."""
    own = ("row_idx", "text")
    first = read_table(spark, sf_dir, "moderation_examples").select(
        F.lit("moderation_examples").alias("tbl"), *own, *(["source"] if with_source else [])
    )
    source = [F.split("source_img_path", "/")[0].alias("source")] if with_source else []
    second = read_table(spark, sf_dir, "multimodal_examples").select(F.lit("multimodal_examples").alias("tbl"), *own, *source)
    return first.unionByName(second)


_fitted: dict[tuple[str, str, str], object] = {}


def fitted(spark: SparkSession, sf_dir: str, name: str, fit: Callable[[], object]) -> object:
    """A model fitted once per application and folder of tables, for all queries of its problem."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _fitted:
        _fitted[key] = fit()
    return _fitted[key]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = split_overlap.find_overlaps(read_table(spark, sf_dir, "multimodal_examples"), read_table(spark, sf_dir, "image_blobs"))
    return pairs.select(F.least("train_row", "eval_row").alias("row_idx_a"), F.greatest("train_row", "eval_row").alias("row_idx_b"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_overlap.overlap_report(read_table(spark, sf_dir, "multimodal_examples"), read_table(spark, sf_dir, "image_blobs"))


def _delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout_copies.texts_of(read_table(spark, sf_dir, "moderation_examples"), read_table(spark, sf_dir, "raw_rows"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = layout_copies.layout_groups(_delivered(spark, sf_dir))
    return groups.where("row_idx <> first_row_idx").select("first_row_idx", "row_idx").distinct()


def p2_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout_copies.collapse(_delivered(spark, sf_dir))


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read_table(spark, sf_dir, "moderation_examples"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_redacted(spark, sf_dir).select("row_idx", F.explode("kinds").alias("kind")).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.find_garbled(read_table(spark, sf_dir, "multimodal_examples")).select("row_idx", "restored_id").distinct()


def p4_flag_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.garbled_report(
        read_table(spark, sf_dir, "multimodal_examples"), read_table(spark, sf_dir, "text_checks")
    )


def p5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "multimodal_examples").select("row_idx", "text", "lang")
    return language.detect(rows, fitted(spark, sf_dir, "coder", lambda: language.train(rows)))


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "multimodal_examples").select("row_idx", "text", "lang")
    return language.segments(rows, fitted(spark, sf_dir, "coder", lambda: language.train(rows)))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    garbled = p4_found(spark, sf_dir).select("row_idx")
    wrong = language.wrong_labels(p5_languages(spark, sf_dir))
    return wrong.join(garbled, "row_idx", "left_anti").select("row_idx", "lang").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    garbled = p4_found(spark, sf_dir).select(F.lit("multimodal_examples").alias("tbl"), "row_idx")
    return lookalike.find_lookalikes(both_texts(spark, sf_dir), ["tbl", "row_idx"]).join(garbled, ["tbl", "row_idx"], "left_anti")


def p6_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = lookalike.consistent_form(both_texts(spark, sf_dir), ["tbl", "row_idx"])
    return forms.select("tbl", "row_idx", F.left(F.sha2("form", 256), F.lit(16)).alias("form_id"), (F.col("form") != F.col("text")).alias("changed"))


def p7_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    moderation, multimodal = read_table(spark, sf_dir, "moderation_examples"), read_table(spark, sf_dir, "multimodal_examples")
    chain = fitted(spark, sf_dir, "chain", lambda: abuse.train(moderation, multimodal, read_table(spark, sf_dir, "lexicon")))
    rows = both_texts(spark, sf_dir, with_source=True)
    return abuse.score_texts(rows, chain, ["tbl", "row_idx", "source"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_scores(spark, sf_dir).where(F.col(abuse.FINAL) >= abuse.THRESHOLD).select("tbl", "row_idx").distinct()


def p7_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = (F.col(abuse.FINAL) >= abuse.THRESHOLD).cast("long")
    scored = p7_scores(spark, sf_dir).groupBy("tbl", "source")
    return scored.agg(F.count("*").alias("n_rows"), F.sum(flagged).alias("n_flagged"), F.avg(flagged).alias("rate"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = leak_search.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))
    return leaks.select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_search.leak_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_shares(spark, sf_dir).where("NOT reachable").select("source")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = mixing.token_counts(read_table(spark, sf_dir, "documents"))
    return mixing.plan_report(counted, read_table(spark, sf_dir, "mix_targets"))


def p9_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.select_mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.sharing_pairs(read_table(spark, sf_dir, "documents"))


def p10_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.span_classes(read_table(spark, sf_dir, "documents"))


def p10_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_share(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_copies, p3_found, p3_redacted, p4_found, p4_flag_coverage, p5_found, p5_languages, p5_segments, p6_found, p6_forms, p7_found, p7_scores, p7_rates, p8_found, p8_items, p9_found, p9_shares, p9_uses, p10_found, p10_spans, p10_share)}
