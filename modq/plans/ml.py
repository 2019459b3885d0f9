"""Term weights and logistic regression (M1-M3) with Spark ML."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import at_least
from ..spread import spread
from .config import settings

TOKEN = r"[\\p{L}\\p{N}_]{2,}"


def with_terms(docs: DataFrame) -> DataFrame:
    """``docs`` with ``terms``: one- and two-word terms in order; null text has none."""
    words = F.expr(f"regexp_extract_all(lower(coalesce(text, '')), '{TOKEN}', 0)")
    # no word array inside a lambda: the optimiser would extract the words anew for every element
    pairs = F.expr("zip_with(slice(w, 1, greatest(size(w) - 1, 0)), slice(w, 2, size(w)), (a, b) -> concat(a, ' ', b))")
    return docs.withColumn("w", words).withColumn("terms", F.concat("w", pairs)).drop("w")


def vocabulary(docs: DataFrame, config: dict | None = None) -> DataFrame:
    """``term, df, cf, idf``: the most frequent terms of the training documents within the document frequency bounds.

    Counts are combined before the one shuffle by term; documents themselves are not shuffled.
    """
    n, t = docs.count(), config or settings()
    terms = with_terms(spread(docs.where("text IS NOT NULL").select("text"))).select("terms")
    in_docs = terms.select(F.explode(F.array_distinct("terms")).alias("term"), F.lit(1).alias("df"), F.lit(0).alias("cf"))
    in_all = terms.select(F.explode("terms").alias("term"), F.lit(0).alias("df"), F.lit(1).alias("cf"))
    stats = in_docs.unionByName(in_all).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    kept = stats.where((F.col("df") >= t["tfidf.min_df"]) & (F.col("df") <= F.lit(t["tfidf.max_df"] * n))).orderBy(F.desc("cf"), "term").limit(t["tfidf.max_features"])
    return kept.withColumn("idf", F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0)


@dataclass
class TermModel:
    """Fitted vocabulary (bounded by ``max_features``) and regression."""

    terms: list[tuple[str, float]]
    regression: LogisticRegressionModel

    def features(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``features``: (1 + ln tf) * idf at length one; documents without any term get the zero vector.

        Counting runs in the JVM; only the sparse vectors of counts pass through Python for their weights.
        """
        idf = np.array([w for _, w in self.terms])

        def weigh(counts: SparseVector) -> SparseVector:
            w = (1.0 + np.log(counts.values)) * idf[counts.indices]
            return SparseVector(counts.size, counts.indices, w / np.sqrt(w @ w) if len(w) else w)

        if not self.terms:
            return docs.withColumn("features", F.udf(lambda: SparseVector(1, [], []), VectorUDT())())
        counter = CountVectorizerModel.from_vocabulary([t for t, _ in self.terms], inputCol="terms", outputCol="counts")
        return counter.transform(with_terms(docs)).withColumn("features", F.udf(weigh, VectorUDT())("counts")).drop("terms", "counts")

    def save(self, folder: str, spark: SparkSession) -> None:
        spark.createDataFrame([(t, w, k) for k, (t, w) in enumerate(self.terms)], "term string, idf double, position int").write.mode("overwrite").parquet(f"{folder}/vocabulary")
        self.regression.write().overwrite().save(f"{folder}/regression")

    @staticmethod
    def load(folder: str, spark: SparkSession) -> "TermModel":
        rows = spark.read.parquet(f"{folder}/vocabulary").orderBy("position").collect()  # bounded by max_features
        return TermModel([(r.term, r.idf) for r in rows], LogisticRegressionModel.load(f"{folder}/regression"))


def fit(docs: DataFrame, config: dict | None = None) -> TermModel:
    """Fit on ``id, text, y`` rows; nothing but these rows shapes vocabulary and weights.

    ``regParam`` is 1 / (C * sum of row weights), which makes the objective that of the usual C; classes are balanced.
    """
    config = config or settings()
    terms = [(r.term, r.idf) for r in vocabulary(docs, config).collect()]  # bounded by max_features
    per = {r.y: r.n for r in docs.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    n = sum(per.values())
    balanced = config["logistic_regression.class_weight"] == "balanced"
    weight = {k: n / (2 * max(c, 1)) if balanced else 1.0 for k, c in per.items()}
    of_row = F.create_map(*[F.lit(x) for k, w in weight.items() for x in (k, w)])[F.col("y")]
    model = LogisticRegression(
        featuresCol="features", labelCol="y", weightCol="row_weight", maxIter=config["logistic_regression.max_iter"],
        regParam=1 / (config["logistic_regression.C"] * max(sum(weight[k] * c for k, c in per.items()), 1.0)), standardization=False,
    )
    blank = TermModel(terms, None)
    rows = blank.features(spread(docs.select("text", "y"))).select("features", "y", of_row.alias("row_weight")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return TermModel(terms, model.fit(rows))
    finally:
        rows.unpersist()


def predict(model: TermModel, docs: DataFrame, threshold: float = 0.5, name: str = "terms-regression", version: str = "v1") -> DataFrame:
    """``id, probability, threshold, label`` with model name and version."""
    p = vector_to_array("probability")[1]
    scored = model.regression.transform(model.features(docs))
    return scored.select("id", p.alias("probability"), F.lit(threshold).alias("threshold"), at_least(p, threshold).alias("label"), F.lit(name).alias("model_name"), F.lit(version).alias("model_version"))
