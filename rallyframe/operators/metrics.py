"""Classification metrics over label and prediction columns: one aggregation, then a few rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def _report(df: DataFrame) -> DataFrame:
    cells = confusion(df)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = cells.select(F.explode(F.array(F.struct(F.col("label").alias("class"), F.col("n").alias("truth"), F.lit(0).cast("long").alias("guess"), hit.cast("long").alias("hit")), F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("truth"), F.col("n").alias("guess"), F.lit(0).cast("long").alias("hit")))).alias("x")).select("x.*")
    sums = sides.groupBy("class").agg(F.sum("truth").alias("support"), F.sum("guess").alias("guess"), F.sum("hit").alias("hit"))
    zero = lambda v: F.coalesce(v, F.lit(0.0))
    out = sums.withColumns({"p": zero(F.try_divide("hit", "guess")), "r": zero(F.try_divide("hit", "support"))})
    return out.withColumn("f", zero(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))))


def class_report(df: DataFrame) -> DataFrame:
    """Precision, recall and F1 of every class (0 where there is nothing to divide by)."""
    return _report(df).select("class", "support", F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"), F.round("f", 4).alias("f1"))


def model_scores(df: DataFrame) -> DataFrame:
    """Accuracy and the means over classes."""
    r = lambda c: F.round(F.avg(c), 4)
    return _report(df).agg(F.round(F.sum("hit") / F.sum("support"), 4).alias("accuracy"), r("p").alias("macro_precision"), r("r").alias("macro_recall"), r("f").alias("macro_f1"), F.sum("support").alias("samples"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Each value with its count and percentage."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 2))


def progress(annotations: DataFrame, label: str = "label") -> DataFrame:
    """How many annotations there are and how many have a label (`unlabeled` is none)."""
    done = F.count_if(F.col(label) != "unlabeled")
    return annotations.agg(F.count("*").alias("total"), done.alias("labelled"), (F.count("*") - done).alias("unlabelled"), F.round(100.0 * done / F.count("*"), 1).alias("percent"))
