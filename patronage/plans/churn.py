"""Churn models: boosted trees on point-in-time features, validated in the order of time (CHN-4, CHN-7, CHN-10)."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.operators.scoring import classifier_report
from patronage.sources.landing import work_path

METRICS = ("auc", "precision", "recall", "f1")


def stashed(rows: DataFrame) -> DataFrame:
    """The rows, written once and read again, since every fold reads them."""
    path = work_path(rows.sparkSession, "training")
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def assembled(rows: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="f", handleInvalid="keep").transform(rows.fillna(0, list(columns)))


def fit(rows: DataFrame, columns: list[str], label: str = "churned", rounds: int = 10, depth: int = 3, seed: int = 1) -> GBTClassificationModel:
    labelled = assembled(rows.withColumn("label", F.col(label).cast("double")), columns)
    return GBTClassifier(featuresCol="f", labelCol="label", maxIter=rounds, maxDepth=depth, seed=seed).fit(labelled)


def scored(model: GBTClassificationModel, rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with the ``probability`` of churn."""
    return model.transform(assembled(rows, columns)).withColumn("probability", vector_to_array("probability")[1]).drop("f", "rawPrediction", "prediction")


def time_folds(dates: list, n: int = 5) -> list[tuple[list, list]]:
    """(dates to learn from, dates to test on) of each of ``n`` folds: the tests are the last n blocks of equal length, and all that is earlier is learned from.

    A date is on one side of a fold alone. Fewer than n + 1 dates give as many folds as there are dates after the first.
    """
    dates = sorted(dates)
    n = min(n, len(dates) - 1)
    size = len(dates) // (n + 1) if n > 0 else 0
    cuts = [len(dates) - (n - k) * size for k in range(n)]
    return [(dates[:c], dates[c : c + size]) for c in cuts]


def final_split(counts: dict, share: float = 0.8) -> tuple[list, list]:
    """The dates up to which at most ``share`` of the rows lie, and the later ones; at least one date on both sides."""
    dates, total, sum_, cut = sorted(counts), sum(counts.values()), 0, 0
    for d in dates:
        sum_ += counts[d]
        cut += sum_ <= share * total
    cut = min(max(cut, 1), len(dates) - 1)
    return dates[:cut], dates[cut:]


def figures(rows: DataFrame, label: str, threshold: float) -> tuple[float, ...]:
    """AUC, precision, recall and F1; 0 where there is nothing to divide by."""
    auc = BinaryClassificationEvaluator(rawPredictionCol="probability", labelCol="y").evaluate(rows.withColumn("y", F.col(label).cast("double")))
    report = classifier_report(rows, "probability", label, threshold).first()
    return (float(auc), *[float(report[m] or 0.0) for m in METRICS[1:]])


def cross_validate(rows: DataFrame, columns: list[str], label: str = "churned", date: str = "obs_date", n: int = 5, share: float = 0.8, threshold: float = 0.5, rounds: int = 10) -> DataFrame:
    """Figures of each fold in the order of time, their mean and spread, and of a final model that learns from the earlier ``share`` (CHN-4).

    (fold, train_rows, test_rows, last_learned, first_tested, auc, precision, recall, f1). Rows of two dates at least.
    The driver sees the dates, their counts and the figures alone.
    """
    counts = {r[date]: r["n"] for r in rows.groupBy(date).agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        raise ValueError("observations of two dates are needed")

    def one(name: str, early: list, late: list) -> tuple:
        model = fit(rows.where(F.col(date).isin(early)), columns, label, rounds)
        found = figures(scored(model, rows.where(F.col(date).isin(late)), columns), label, threshold)
        return (name, sum(counts[d] for d in early), sum(counts[d] for d in late), str(early[-1]), str(late[0]), *found)

    out = [one(f"fold {k}", *f) for k, f in enumerate(time_folds(list(counts), n), 1)]
    values = np.array([o[5:] for o in out])
    out += [(name, None, None, None, None, *[float(v) for v in f(values, 0)]) for name, f in (("mean", np.mean), ("std", np.std))]
    out.append(one("final", *final_split(counts, share)))
    return rows.sparkSession.createDataFrame(out, "fold string, train_rows long, test_rows long, last_learned string, first_tested string, auc double, precision double, recall double, f1 double")


def risk_report(found: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Scored customers with the at-risk flag, how sure the score is, and the level of risk (CHN-7)."""
    p = F.col("probability")
    sure = F.when((p < 0.3) | (p > 0.8), "high").when((p < 0.4) | (p > 0.7), "medium").otherwise("low")
    level = F.when(p > 0.8, "critical").when(p > 0.6, "high").when(p > 0.4, "medium").otherwise("low")
    return found.withColumn("at_risk", p >= threshold).withColumn("confidence", sure).withColumn("level", level)


def importances(model: GBTClassificationModel, columns: list[str], spark: SparkSession) -> DataFrame:
    """Features by importance, largest first; equal ones in their order (CHN-10)."""
    found = sorted(zip(columns, (float(v) for v in model.featureImportances.toArray()), strict=True), key=lambda x: -x[1])
    return spark.createDataFrame(found, "feature string, importance double")
