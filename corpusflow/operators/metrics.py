"""Classification metrics from (label, prediction) tables (M1-M9).

Every metric is derived from the confusion counts: one grouped count over
the predictions (classes^2 rows, partial aggregation), after which accuracy,
per-class and averaged numbers are computed on that small table.  Where
the table is read more than once it is materialised first (checkpoint), so
the predictions are computed a single time however many metrics are asked
for.  Division by zero gives 0, like the common metric libraries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _div0(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """M3: counts per (label, pred)."""
    return df.groupBy(label, pred).agg(F.count(F.lit(1)).alias("n"))


def confusion_once(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """The confusion table materialised (classes^2 rows) for repeated reads."""
    from corpusflow.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    return confusion(df, label, pred).checkpoint(eager=True)


def _cnt(cond: Column) -> Column:
    return F.sum(F.when(cond, F.col("n")).otherwise(0))


def accuracy_from(c: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    hit = _cnt(F.col(label) == F.col(pred))
    return c.agg(F.try_divide(hit.cast("double"), F.sum("n").cast("double")).alias("accuracy"))


def per_class_from(c: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    # tp as a conditional sum: a filter on the grouping keys would be pushed
    # below the confusion aggregate and re-run the prediction expression
    sup = c.groupBy(F.col(label).alias("k")).agg(
        F.sum("n").alias("support"), _cnt(F.col(label) == F.col(pred)).alias("tp"))
    pc = c.groupBy(F.col(pred).alias("k")).agg(F.sum("n").alias("predicted"))
    t = sup.join(pc, "k", "full").fillna(0, ["support", "predicted", "tp"])
    p = _div0(F.col("tp"), F.col("predicted"))
    r = _div0(F.col("tp"), F.col("support"))
    return t.withColumn("precision", p).withColumn("recall", r).withColumn(
        "f1", _div0(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def binary_from(c: DataFrame, label: str = "label", pred: str = "pred", positive: int = 1) -> DataFrame:
    s = c.agg(_cnt((F.col(pred) == positive) & (F.col(label) == positive)).alias("_tp"),
              _cnt(F.col(pred) == positive).alias("_pp"), _cnt(F.col(label) == positive).alias("_ap"))
    p = _div0(F.col("_tp"), F.col("_pp"))
    r = _div0(F.col("_tp"), F.col("_ap"))
    return s.select(p.alias("precision"), r.alias("recall"), _div0(2 * p * r, p + r).alias("f1"))


def weighted_from(c: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    t = per_class_from(c, label, pred)
    n = F.sum("support")
    return t.agg(_div0(F.sum(F.col("precision") * F.col("support")), n).alias("precision"),
                 _div0(F.sum(F.col("recall") * F.col("support")), n).alias("recall"),
                 _div0(F.sum(F.col("f1") * F.col("support")), n).alias("f1"))


def macro_from(c: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    t = per_class_from(c, label, pred)
    return t.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))


def accuracy(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """M2 / M8: share of rows with pred == label (from the confusion counts)."""
    return accuracy_from(confusion(df, label, pred), label, pred)


def per_class(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Per-class tp / support / predicted and P, R, F1."""
    return per_class_from(confusion_once(df, label, pred), label, pred)


def binary_prf(df: DataFrame, label: str = "label", pred: str = "pred", positive: int = 1) -> DataFrame:
    """M4: precision / recall / F1 of the positive class."""
    return binary_from(confusion(df, label, pred), label, pred, positive)


def weighted_prf(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """M5: support-weighted precision / recall / F1."""
    return weighted_from(confusion_once(df, label, pred), label, pred)


def macro_prf(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """M6: unweighted mean over the classes present in labels or predictions."""
    return macro_from(confusion_once(df, label, pred), label, pred)


def metrics(df: DataFrame, num_labels: int, label: str = "label", pred: str = "pred",
            mode: str = "full", digits: int = 4) -> DataFrame:
    """M7 / M8: accuracy plus binary (2 labels) or weighted P/R/F1, rounded.

    The confusion table (classes^2 rows) is materialised once, so the
    predictions are computed and read a single time for all the metrics."""
    c = confusion_once(df, label, pred)
    acc = accuracy_from(c, label, pred)
    if mode == "accuracy":
        return acc.select(F.round("accuracy", digits).alias("accuracy"))
    prf = binary_from(c, label, pred) if num_labels == 2 else weighted_from(c, label, pred)
    avg = "binary" if num_labels == 2 else "weighted"
    return acc.crossJoin(F.broadcast(prf)).select(  # two one-row aggregates
        F.lit(avg).alias("average"), *[F.round(c_, digits).alias(c_) for c_ in ("accuracy", "f1", "precision", "recall")])


def throughput(rows: Column, seconds: Column, batch: int) -> dict[str, Column]:
    """M9: rows/s and steps/s (steps = ceil(rows / batch)); zero time -> null."""
    return {"rows_per_s": F.try_divide(rows, seconds),
            "steps_per_s": F.try_divide(F.ceil(rows / batch), seconds)}


# metric functions by name, each (predictions DataFrame) -> one-row DataFrame
METRIC_FUNCTIONS = {
    "accuracy": accuracy,
    "binary": binary_prf,
    "weighted": weighted_prf,
    "macro": macro_prf,
}


def compute_metric(df: DataFrame, name: str, label: str = "label", pred: str = "pred") -> DataFrame:
    """Run a registered metric function by name."""
    if name not in METRIC_FUNCTIONS:
        raise ValueError(f"unknown metric {name!r}; available: {sorted(METRIC_FUNCTIONS)}")
    return METRIC_FUNCTIONS[name](df, label, pred)
