"""Classification and sequence metrics over fixed vocabularies, as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions import numbers as N


def vocabulary(spark: SparkSession, values: Sequence, name: str) -> DataFrame:
    kind = "int" if isinstance(values[0], int) else "string"
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind}")


def vocab_counts(df: DataFrame, label: str, values: Sequence) -> DataFrame:
    """Rows of each vocabulary label, zeros kept."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return vocabulary(df.sparkSession, values, label).join(counts, label, "left").select(label, F.coalesce("n", F.lit(0)).alias("n"))


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Counts of (truth, pred): at most the square of the vocabulary, whatever the input."""
    return df.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))


def prf(df: DataFrame, truth: str, pred: str, values: Sequence) -> DataFrame:
    """(label, tp, fp, fn, support, precision, recall, f1): a row for each vocabulary label, zero where it does not occur."""
    c = confusion(df, truth, pred)
    name = "label"
    sides = c.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.lit("t").alias("side")), F.struct(F.col("p").alias("label"), F.lit("p").alias("side")))).alias("s"), (F.col("t") == F.col("p")).alias("hit"), "n").select("s.*", "hit", "n")
    sums = sides.groupBy(name).agg(
        F.sum(F.when((F.col("side") == "t") & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("side") == "t", F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("side") == "p", F.col("n")).otherwise(0)).alias("predicted"),
    )
    out = vocabulary(df.sparkSession, values, name).join(sums, name, "left").na.fill(0)
    out = out.withColumn("fp", F.col("predicted") - F.col("tp")).withColumn("fn", F.col("support") - F.col("tp"))
    out = out.withColumn("precision", N.ratio(F.col("tp"), F.col("predicted"))).withColumn("recall", N.ratio(F.col("tp"), F.col("support")))
    f1 = N.ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.select(name, "tp", "fp", "fn", "support", "precision", "recall", f1.alias("f1"))


def summary(per_class: DataFrame, rows: Column | None = None) -> DataFrame:
    """Accuracy, macro F1 over the vocabulary, weighted F1, majority share; from ``prf``."""
    total = F.sum("support") if rows is None else rows
    return per_class.agg(
        N.ratio(F.sum("tp"), total).alias("accuracy"), F.avg("f1").alias("macro_f1"), N.ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
        N.ratio(F.max("support"), total).alias("majority_accuracy"),
    )


def class_weights(df: DataFrame, label: str, values: Sequence, power: float, one_in_total: bool = False) -> DataFrame:
    """(total / (classes * n))^power with n at least 1, scaled to mean 1.

    With ``one_in_total`` a label without rows counts as one in the total too and the number of classes is left out; after scaling that makes
    no difference to the weights.
    """
    counts = vocab_counts(df, label, values)
    every = Window.partitionBy()  # one row for each vocabulary label
    least = F.greatest(F.lit(1), F.col("n"))
    share = F.sum(least).over(every) / least if one_in_total else F.sum("n").over(every) / (len(values) * least)
    raw = counts.withColumn("raw", F.pow(share, F.lit(power)))
    return raw.withColumn("weight", F.col("raw") / F.avg("raw").over(every)).drop("raw")


def threshold_sweep(df: DataFrame, score: Column, truth: Column, thresholds: Sequence[float]) -> DataFrame:
    """Precision, recall and F1 at each threshold, in one pass: counts by score step, then by threshold."""
    steps = sorted(set(thresholds))
    flags = [F.sum(((score >= t) & truth).cast("long")).alias(f"tp{i}") for i, t in enumerate(steps)] + [F.sum((score >= t).cast("long")).alias(f"pp{i}") for i, t in enumerate(steps)]
    one = df.agg(F.sum(truth.cast("long")).alias("support"), *flags)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"pp{i}").alias("predicted")) for i, t in enumerate(steps)])
    out = one.select("support", F.explode(rows).alias("r")).select("support", "r.*")
    out = out.withColumn("precision", N.ratio(F.col("tp"), F.col("predicted"))).withColumn("recall", N.ratio(F.col("tp"), F.col("support")))
    return out.withColumn("f1", N.ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The sweep's best row by F1, recall, precision; the lowest threshold on ties."""
    order = F.struct("f1", "recall", "precision", (-F.col("threshold")).alias("low"))
    return sweep.agg(F.max_by(F.struct(*sweep.columns), order).alias("best")).select("best.*")


def require(metrics: dict[str, float], least: dict[str, float]) -> None:
    """Raise where a metric is below what is required."""
    low = {k: (metrics.get(k), v) for k, v in least.items() if metrics.get(k) is None or metrics[k] < v}
    if low:
        raise ValueError("below the required metrics: " + ", ".join(f"{k}={a} < {b}" for k, (a, b) in sorted(low.items())))
