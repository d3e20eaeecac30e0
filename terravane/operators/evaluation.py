"""Evaluation: precision and recall by threshold from one cumulative pass, chosen thresholds, averages, seeded intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .relational import numbered


def curve(scored: DataFrame, score: str, label: str) -> DataFrame:
    """threshold, tp, fp, precision, recall, f1 at every distinct score: rows are summed by score before any ordering."""
    by_score = scored.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(label).cast("bigint")).alias("p"), F.sum((1 - F.col(label)).cast("bigint")).alias("n"))
    w = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("p").over(Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    summed = by_score.select("threshold", F.sum("p").over(w).alias("tp"), F.sum("n").over(w).alias("fp"), total.alias("_all"))
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp")), F.when(F.col("_all") > 0, F.col("tp") / F.col("_all")).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return summed.select("threshold", "tp", "fp", F.round(precision, 9).alias("precision"), F.round(recall, 9).alias("recall"), F.round(f1, 9).alias("f1"))


def chosen_thresholds(points: DataFrame, auto: float = 0.97, low: float = 0.98) -> DataFrame:
    """best_f1, auto_merge (precision at least `auto`, most recall), low (recall at least `low`, highest threshold): one row."""
    best = F.max(F.struct("f1", "threshold")).getField("threshold").alias("best_f1")
    merge = F.max(F.when(F.col("precision") >= auto, F.struct("recall", "threshold"))).getField("threshold").alias("auto_merge")
    return points.agg(best, merge, F.max(F.when(F.col("recall") >= low, F.col("threshold"))).alias("low"))


def average_precision(points: DataFrame) -> DataFrame:
    w = Window.orderBy(F.desc("threshold"))
    step = points.withColumn("gain", F.col("recall") - F.coalesce(F.lag("recall").over(w), F.lit(0.0)))
    return step.agg(F.round(F.sum(F.col("gain") * F.col("precision")), 6).alias("average_precision"))


def confusion(rows: DataFrame, predicted: str, actual: str) -> DataFrame:
    return rows.groupBy(predicted, actual).agg(F.count(F.lit(1)).alias("n"))


def accuracy(rows: DataFrame, predicted: str, actual: str) -> DataFrame:
    """class (null for all), n, right, accuracy."""
    sets = rows.withColumn("_right", (F.col(predicted) == F.col(actual)).cast("bigint")).rollup(actual)
    return sets.agg(F.count(F.lit(1)).alias("n"), F.sum("_right").alias("right"), F.round(F.avg("_right"), 6).alias("accuracy")).withColumnRenamed(actual, "class")


def recall_at(expected: DataFrame, found: DataFrame, question: str, names: str, texts: str) -> DataFrame:
    """question, hits, expected, recall: expected names that occur, without regard to case, in one of the texts found."""
    joined = expected.join(found, question, "left")
    low = F.transform(F.coalesce(texts, F.array().cast("array<string>")), F.lower)
    hits = F.size(F.filter(names, lambda n: F.exists(low, lambda x: F.contains(x, F.lower(n)))))
    return joined.select(question, hits.alias("hits"), F.size(names).alias("expected"), F.round(hits / F.size(names), 6).alias("recall"))


def gate_metrics(rows: DataFrame, decision: str, expected: str) -> DataFrame:
    """accept_precision, useful_recall, junk_filtered, workload, exact: one row of ratios, null where nothing is counted."""
    d, e = F.col(decision), F.col(expected)
    ratio = lambda a, b: F.round(F.sum(a.cast("bigint")) / F.nullif(F.sum(b.cast("bigint")), F.lit(0)), 6)
    useful = e.isin("accept", "review")
    return rows.agg(
        ratio((d == "accept") & (e == "accept"), d == "accept").alias("accept_precision"),
        ratio(d.isin("accept", "review") & useful, useful).alias("useful_recall"),
        ratio((d == "exclude") & (e == "exclude"), e == "exclude").alias("junk_filtered"),
        F.count_if(d == "review").alias("workload"),
        ratio(d == e, F.lit(True)).alias("exact"),
    )


def bootstrap(rows: DataFrame, value: str, resamples: int = 2000, seed: int = 13, bounds: Sequence[float] = (0.025, 0.975)) -> DataFrame:
    """mean, low, high: Poisson bootstrap of a mean; a row's weight in each resample comes from a hash, so results do not depend on partitions.

    Sums of a resample are kept in arrays and added position by position, so no row is copied for a resample.
    """
    import math

    steps, p, total = [], math.exp(-1), 0.0
    for k in range(8):
        total += p
        steps.append(total)
        p /= k + 1
    unit = lambda i: (F.pmod(F.xxhash64("_row", F.lit(seed), i), F.lit(1 << 31)) / F.lit(float(1 << 31)))
    drawn = lambda i: F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda n, s: n + (unit(i) >= s).cast("int"))
    by_resample = rows.select(F.col(value).cast("double").alias("v"), F.xxhash64(*rows.columns).alias("_row")).select("v", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(resamples - 1)), drawn)).alias("i", "n")).where("n > 0")
    means = by_resample.groupBy("i").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("m"))
    spread = means.agg(F.percentile("m", F.lit(bounds[0])).alias("low"), F.percentile("m", F.lit(bounds[1])).alias("high"))
    return rows.agg(F.avg(value).alias("mean")).join(F.broadcast(spread), F.lit(True))


def stratified_folds(rows: DataFrame, key: str, label: str, folds: int, repeats: int) -> DataFrame:
    """rows once for each repeat, with repeat and fold: each label's rows are dealt out in order of a digest of key and repeat, so every fold has its share of each label.

    A label's rows are numbered by ranges, so a label of any size is spread over many tasks.
    """
    dealt = rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    drawn = dealt.withColumn("_digest", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("repeat").cast("string"))))
    placed = numbered(drawn, ["_digest", key], "_place", ["repeat", label])
    return placed.withColumn("fold", F.pmod(F.col("_place") - 1, F.lit(folds)).cast("int")).drop("_place", "_digest")


def out_of_fold(rows: DataFrame, key: str, label: str, features: Sequence[str], folds: int = 5, repeats: int = 2) -> DataFrame:
    """key, label, repeat, fold, score: every row scored by a scaled logistic regression, classes weighted equally, fitted on the other folds of its repeat."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    dealt = stratified_folds(rows.select(key, label, *features), key, label, folds, repeats)
    share = rows.agg(F.avg(label)).first()[0] or 0.5
    dealt = VectorAssembler(inputCols=list(features), outputCol="_raw").transform(dealt)
    dealt = dealt.withColumn("_weight", F.when(F.col(label) == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9)))
    out = None
    for repeat in range(repeats):
        for fold in range(folds):
            own = dealt.where(F.col("repeat") == repeat)
            train, test = own.where(F.col("fold") != fold), own.where(F.col("fold") == fold)
            scaler = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(train)
            model = LogisticRegression(featuresCol="_x", labelCol=label, weightCol="_weight", regParam=0.01, maxIter=50).fit(scaler.transform(train))
            scored = model.transform(scaler.transform(test)).select(key, label, "repeat", "fold", F.round(vector_to_array("probability")[1], 6).alias("score"))
            out = scored if out is None else out.unionByName(scored)
    return out


def false_merges(scored: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    """Rows at or over the threshold whose label says that they are not the same, worst first by place."""
    wrong = scored.where((F.col(score) >= threshold) & (F.col(label) == 0))
    return numbered(wrong, [F.desc(score), *[c for c in scored.columns if c not in (score, label)]]).withColumn("place", F.col("place").cast("int"))


def sweep(scored: DataFrame, label: str, score: str, steps: Sequence[float]) -> DataFrame:
    """threshold, tp, fp, fn, precision, recall, f1 at every step, from one aggregation over the rows; a step without any row over it keeps its line."""
    at = F.explode(F.transform(F.array(*map(F.lit, steps)), lambda s: F.struct(s.alias("threshold"), (F.col(score) >= s).alias("over"))))
    rows = scored.select(F.col(label).alias("l"), at.alias("a"))
    n = lambda c: F.count_if(c).cast("bigint")
    out = rows.groupBy(F.col("a.threshold").alias("threshold")).agg(n(F.col("a.over") & (F.col("l") == 1)).alias("tp"), n(F.col("a.over") & (F.col("l") == 0)).alias("fp"), n(~F.col("a.over") & (F.col("l") == 1)).alias("fn"))
    p, r = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    return out.select("*", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)), 6).alias("f1"))
