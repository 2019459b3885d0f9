"""Row contracts of the two example kinds, as predicates and lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# fixed values: score names in their contract order
LABELS = ("toxicity", "severe_toxicity", "obscene", "threat", "insult", "identity_attack", "sexual_explicit")
RAW_FIELDS = ("text", *LABELS)
SPLITS = ("train", "dev", "test")
# fixed values: names of the integer labels, by code
HATE_NAMES = ("not-hateful", "hateful")
PROP_NAMES = ("not_propaganda", "propaganda")
FINE_NAMES = (
    "sarcasm", "humor", "inciting_violence", "mocking", "other", "exclusion", "dehumanizing", "contempt", "inferiority", "slurs"
)


def unit(score: Column) -> Column:
    """A score within [0, 1]; null and NaN are not."""
    return F.coalesce(score.between(F.lit(0.0), F.lit(1.0)) & ~F.isnan(score), F.lit(False))


def filled(text: Column) -> Column:
    """Text with a character beyond whitespace."""
    return F.coalesce(F.length(strip(text)) > 0, F.lit(False))


def valid_example(labels: str = "labels") -> Column:
    """Contract of a text example: id, non-blank text, source, version, seven scores in range."""
    ok = filled(F.col("text")) & (F.length("content_id") > 0) & (F.length("source") > 0) & (F.length("dataset_version") > 0)
    for name in LABELS:
        ok = ok & unit(F.col(f"{labels}.{name}"))
    return F.coalesce(ok, F.lit(False))


def valid_multimodal() -> Column:
    """Contract of an image-and-text example: non-empty fields, label ranges, a known split."""
    ok = filled(F.col("text")) & F.col("split").isin(*SPLITS)
    for name in ("example_id", "image_path", "source_img_path", "dataset_version"):
        ok = ok & (F.length(name) > 0)
    for name, top in (("hate_label", 1), ("prop_label", 1), ("hate_fine_grained_label", 9)):
        ok = ok & F.col(name).between(0, top)
    return F.coalesce(ok, F.lit(False))


def label_name(code: Column, names: tuple[str, ...]) -> Column:
    """Name of an integer label; null outside its range."""
    return F.when(code.between(0, len(names) - 1), F.element_at(F.array(*map(F.lit, names)), code.cast("int") + 1))
