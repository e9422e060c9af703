"""Evaluation of classifiers from a table of (goal, observation)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, goal: str = "goal", observation: str = "observation") -> DataFrame:
    """Rows (goal, observation, n), the confusion matrix in long form."""
    return df.groupBy(F.col(goal).alias("goal"), F.col(observation).alias("observation")).agg(F.count("*").alias("n"))


def confusion_wide(df: DataFrame, classes: list[str], goal: str = "goal", observation: str = "observation") -> DataFrame:
    """One row a goal, one column a class; the classes are given so that no job has to find them."""
    return df.groupBy(F.col(goal).alias("goal")).pivot(observation, classes).count().na.fill(0)


def class_counts(df: DataFrame, goal: str = "goal", observation: str = "observation") -> DataFrame:
    """Rows (class, tp, fp, fn, tn) for every class that is a goal or an observation.

    A null observation is missing and counts as a false negative of its goal.
    Everything is derived from the confusion matrix, which is small.
    """
    c = confusion(df, goal, observation)
    side = F.explode(
        F.array(
            F.struct(F.col("goal").alias("class"), F.when(F.col("goal").eqNullSafe(F.col("observation")), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(F.col("goal").eqNullSafe(F.col("observation")), 0).otherwise(F.col("n")).alias("fn")),
            F.struct(F.col("observation").alias("class"), F.lit(0).cast("long").alias("tp"), F.when(F.col("goal").eqNullSafe(F.col("observation")), 0).otherwise(F.col("n")).alias("fp"), F.lit(0).cast("long").alias("fn")),
        )
    )
    per = c.select(side.alias("x")).select("x.*").where("class IS NOT NULL").groupBy("class").agg(*(F.sum(k).cast("long").alias(k) for k in ("tp", "fp", "fn")))
    total = c.agg(F.sum("n").cast("long").alias("_n"))
    return per.crossJoin(F.broadcast(total)).withColumn("tn", F.col("_n") - F.col("tp") - F.col("fp") - F.col("fn")).drop("_n")


def class_scores(counts: DataFrame, beta: float = 1.0) -> DataFrame:
    """``counts`` with precision, recall, specificity, accuracy, fscore, tpr, fpr and auc of every class; 0 where a denominator is 0."""

    def ratio(a: str, *b: str) -> F.Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), sum((F.col(x) for x in b[1:]), F.col(b[0]))), F.lit(0.0))

    out = counts.select("*", ratio("tp", "tp", "fp").alias("precision"), ratio("tp", "tp", "fn").alias("recall"), ratio("tn", "tn", "fp").alias("specificity"))
    p, r = F.col("precision"), F.col("recall")
    return out.select(
        "*",
        F.try_divide((F.col("tp") + F.col("tn")).cast("double"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("accuracy"),
        F.coalesce(F.try_divide((1 + beta * beta) * p * r, beta * beta * p + r), F.lit(0.0)).alias("fscore"),
        r.alias("tpr"),
        ratio("fp", "fp", "tn").alias("fpr"),
        ((1 + r - ratio("fp", "fp", "tn")) / 2).alias("auc"),
    )


SCORES = ("precision", "recall", "specificity", "accuracy", "fscore", "auc")


def averages(scores: DataFrame) -> DataFrame:
    """One row: the micro_ scores, weighted by how often a class is the goal, and the macro_ scores, over all classes."""
    goals = F.col("tp") + F.col("fn")
    micro = [F.try_divide(F.sum(F.col(s) * goals), F.sum(goals)).alias(f"micro_{s}") for s in SCORES]
    macro = [F.try_divide(F.sum(F.when(goals > 0, F.col(s)).otherwise(0.0)), F.count("*")).alias(f"macro_{s}") for s in SCORES]
    return scores.agg(F.try_divide(F.sum("tp").cast("double"), F.sum(goals)).alias("overall_accuracy"), *micro, *macro)


def auc_curve(points: DataFrame, by: list[str], x: str = "fpr", y: str = "tpr") -> DataFrame:
    """Rows (by..., auc): trapezoids under the points of each group, with (0, 0) and (1, 1) added."""
    own = points.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    keys = own.select(*by).distinct()
    ends = keys.select(*by, F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("_x")).withColumn("_y", F.col("_x"))
    w = Window.partitionBy(*by).orderBy("_x", "_y")
    step = own.union(ends).select(*by, "_x", "_y", F.lag("_x").over(w).alias("_px"), F.lag("_y").over(w).alias("_py"))
    return step.groupBy(*by).agg(F.sum((F.col("_x") - F.col("_px")) * (F.col("_y") + F.col("_py")) / 2).alias("auc"))


def ordinal_errors(df: DataFrame, goal: str = "goal", observation: str = "observation") -> DataFrame:
    """Rows (observation, n, mae, rmse) grouped by observation, and one of all with a null observation."""
    d = (F.col(goal) - F.col(observation)).cast("double")
    return (
        df.rollup(F.col(observation).alias("observation"))
        .agg(F.count("*").alias("n"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.grouping_id().alias("_g"))
        .where("_g = 1 OR observation IS NOT NULL")
        .drop("_g")
    )
