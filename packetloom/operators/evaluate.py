"""Model-quality reports.

Every metric is derived from one small count table (confusion cells or probability steps), so
the scored rows are read once and never compared pairwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from packetloom.functions.values import ratio
from packetloom.operators.reports import share
from packetloom.session import materialise

# The swept decision thresholds and the recall a threshold should keep.
THRESHOLDS = (0.10, 0.20, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90)
WANTED_RECALL = 0.95


def confusion_long(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(label, prediction).agg(F.count("*").alias("count"))


def confusion_wide(df: DataFrame, label: str, prediction: str, classes: list | None = None) -> DataFrame:
    """One column per predicted class, 0-filled; naming the classes avoids an extra pass."""
    cells = confusion_long(df, label, prediction)
    return cells.groupBy(label).pivot(prediction, classes).agg(F.sum("count")).na.fill(0)


def _counts(label: str, prediction: str, n: Column | None = None) -> dict[str, Column]:
    y, p = F.col(label) == 1, F.col(prediction) == 1

    def total(cond: Column) -> Column:
        return F.count_if(cond) if n is None else F.coalesce(F.sum(F.when(cond, n)), F.lit(0))

    return {"tp": total(y & p), "tn": total(~y & ~p), "fp": total(~y & p), "fn": total(y & ~p)}


def _rates(df: DataFrame) -> DataFrame:
    """Quality columns from tp, tn, fp and fn; 0 where a denominator is 0."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    df = df.withColumns({
        "accuracy": ratio(tp + tn, tp + tn + fp + fn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "false_positive_rate": ratio(fp, fp + tn),
        "false_negative_rate": ratio(fn, tp + fn),
    })
    p, r = F.col("precision"), F.col("recall")
    return df.withColumn("f1", ratio(2 * p * r, p + r))


def binary_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return _rates(df.agg(*[c.alias(k) for k, c in _counts(label, prediction).items()]))


def per_class_metrics(df: DataFrame, label: str = "attack_label", prediction: str = "predicted_label") -> DataFrame:
    """Support, tp, fp, fn, precision, recall and F1 of each true class."""
    cells = confusion_long(df, label, prediction)
    same = F.col(label) == F.col(prediction)
    # a cell counts once for its true class and once for its predicted class
    sides = cells.select(
        F.inline(F.array(
            F.struct(F.col(label).alias("class_name"), F.col("count").alias("support"),
                     F.when(same, F.col("count")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp")),
            F.struct(F.col(prediction).alias("class_name"), F.lit(0).cast("long").alias("support"),
                     F.lit(0).cast("long").alias("tp"), F.when(~same, F.col("count")).otherwise(0).alias("fp")),
        ))
    )
    out = sides.groupBy("class_name").agg(F.sum("support").alias("support"), F.sum("tp").alias("tp"),
                                          F.sum("fp").alias("fp"))
    out = out.where("support > 0").withColumn("fn", F.col("support") - F.col("tp"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = out.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    return out.withColumn(
        "f1_score", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    )


def averaged_metrics(per_class: DataFrame) -> DataFrame:
    """Macro and support-weighted averages and the accuracy, from `per_class_metrics`."""
    total = F.sum("support")

    def weighted(c: str) -> Column:
        return ratio(F.sum(F.col("support") * F.col(c)), total)

    return per_class.agg(
        total.alias("samples"),
        ratio(F.sum("tp"), total).alias("accuracy"),
        F.coalesce(F.avg("precision"), F.lit(0.0)).alias("macro_precision"),
        F.coalesce(F.avg("recall"), F.lit(0.0)).alias("macro_recall"),
        F.coalesce(F.avg("f1_score"), F.lit(0.0)).alias("macro_f1"),
        weighted("precision").alias("weighted_precision"),
        weighted("recall").alias("weighted_recall"),
        weighted("f1_score").alias("weighted_f1"),
    )


def confidence_stats(df: DataFrame, confidence: str, label: str, prediction: str) -> DataFrame:
    """Mean, min and max confidence: overall, of correct and of incorrect predictions."""
    outcome = F.when(F.col(label) == F.col(prediction), "correct").otherwise("incorrect")
    parts = df.select(outcome.alias("outcome"), F.col(confidence).alias("c")).rollup("outcome").agg(
        F.count("*").alias("rows"), F.avg("c").alias("mean"), F.min("c").alias("min"), F.max("c").alias("max")
    )
    return parts.withColumn("outcome", F.coalesce("outcome", F.lit("overall")))


def pipeline_metrics(df: DataFrame, label: str = "label", detected: str = "prediction",
                     attack_label: str = "attack_label", predicted_label: str = "predicted_label") -> DataFrame:
    """End-to-end quality over rows that carry both stages' results."""
    right = (F.col(label) == 1) & (F.col(detected) == 1) & (F.col(attack_label) == F.col(predicted_label))
    out = df.agg(
        F.count("*").alias("total_samples"),
        F.count_if(F.col(label) == 1).alias("attack_samples"),
        *[c.alias(k) for k, c in _counts(label, detected).items()],
        F.count_if(right).alias("correct_attack_classifications"),
    )
    good = F.col("correct_attack_classifications")
    return out.select(
        "total_samples",
        ratio(F.col("tn") + good, F.col("total_samples")).alias("overall_pipeline_accuracy"),
        ratio(F.col("tp"), F.col("attack_samples")).alias("attack_detection_accuracy"),
        ratio(good, F.col("tp")).alias("attack_classification_on_detected"),
        ratio(good, F.col("attack_samples")).alias("attack_classification_overall"),
        F.col("tn").alias("correct_benign_decisions"),
        F.col("tp").alias("correct_attack_detections"),
        "correct_attack_classifications",
        F.col("fp").alias("false_alarms"),
        F.col("fn").alias("missed_attacks"),
    )


def ml_evaluators(df: DataFrame, label: str = "label", prediction: str = "prediction",
                  raw: str | None = None) -> DataFrame:
    """The standard evaluator metrics as rows (metric, value).

    Weighted ones come from the class counts; the area metrics from `spark.ml` over `raw`.
    """
    per = per_class_metrics(df, label, prediction)
    names = {"accuracy": "accuracy", "weightedPrecision": "weighted_precision", "weightedRecall": "weighted_recall",
             "f1": "weighted_f1", "weightedFMeasure": "weighted_f1"}
    out = averaged_metrics(per).select(
        F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(v).alias("value")) for k, v in names.items()]))
    )
    if raw:
        from pyspark.ml.evaluation import BinaryClassificationEvaluator

        area = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol=raw)
        rows = [(m, float(area.evaluate(df, {area.metricName: m}))) for m in ("areaUnderROC", "areaUnderPR")]
        out = out.unionByName(df.sparkSession.createDataFrame(rows, "metric string, value double"))
    return out


def threshold_sweep(df: DataFrame, probability: str = "attack_probability", label: str = "label",
                    thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Quality at every threshold from one pass.

    A row is reduced to the number of thresholds it reaches, so the data collapses to
    2 x (thresholds + 1) counts and no row is copied per threshold.
    """
    steps = sorted(thresholds)
    reached = reduce(lambda a, b: a + b, [(F.col(probability) >= t).cast("int") for t in steps])
    cells = df.groupBy(F.coalesce(reached, F.lit(0)).alias("reached"), (F.col(label) == 1).alias("attack")).agg(
        F.count("*").alias("n")
    )
    table = F.array(*[
        F.struct(F.lit(i + 1).alias("step"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(steps)
    ])
    spread = cells.select("reached", "attack", "n", F.inline(table))
    hit, attack, n = F.col("reached") >= F.col("step"), F.col("attack"), F.col("n")

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0))

    return _rates(spread.groupBy("threshold").agg(
        total(attack & hit).alias("tp"), total(~attack & ~hit).alias("tn"),
        total(~attack & hit).alias("fp"), total(attack & ~hit).alias("fn"),
    ))


def select_threshold(sweep: DataFrame, recall: float = WANTED_RECALL) -> DataFrame:
    """Best F1 among thresholds that keep `recall`; best F1 overall when none does."""
    return (
        sweep.withColumn("eligible", F.col("recall") >= recall)
        .orderBy(F.desc("eligible"), F.desc("f1"), "threshold")
        .limit(1)
    )


def feature_importance(model, features: list[str], spark, top: int | None = 20,
                       only: list[str] | None = None) -> DataFrame:
    """Ranked importances of a fitted forest; `only` restricts to some features."""
    scores = [(f, float(s)) for f, s in zip(features, model.featureImportances.toArray())]
    df = spark.createDataFrame([r for r in scores if only is None or r[0] in only], "feature string, importance double")
    df = df.withColumn("rank", F.row_number().over(W.orderBy(F.desc("importance"), "feature")))
    return df.where(F.col("rank") <= top) if top else df


def replay_scorecard(df: DataFrame, run: str = "replay_id", truth: str = "gt_label") -> DataFrame:
    """One row per run over scored rows (`is_attack`, `attack_type`, `severity`, `confidence`,
    optional `inserted` and, constant per run, `processing_seconds`)."""
    real, hit = F.col(truth) != "Benign", F.col("is_attack")
    level = F.upper("severity")
    inserted = F.coalesce(F.sum(F.col("inserted").cast("long")), F.lit(0)) if "inserted" in df.columns \
        else F.lit(0).cast("long")
    spent = F.max("processing_seconds") if "processing_seconds" in df.columns else F.lit(None).cast("double")
    out = df.groupBy(run).agg(
        F.count("*").alias("flows_processed"),
        F.count_if(~real).alias("gt_benign"),
        F.count_if(real).alias("gt_attacks"),
        F.count_if(~hit).alias("pred_benign"),
        F.count_if(hit).alias("pred_attacks"),
        F.count_if(real & hit).alias("tp"), F.count_if(~real & ~hit).alias("tn"),
        F.count_if(~real & hit).alias("fp"), F.count_if(real & ~hit).alias("fn"),
        F.count_if(real & (F.col("attack_type") == F.col(truth))).alias("stage2_correct"),
        inserted.alias("alerts_inserted"),
        *[F.count_if(hit & (level == s)).alias(s.lower()) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")],
        (F.coalesce(F.avg(F.when(hit, F.col("confidence"))), F.lit(0.0)) * 100).alias("average_confidence_percent"),
        spent.alias("_seconds"),
    )
    out = _rates(out).withColumn("stage2_accuracy", ratio(F.col("stage2_correct"), F.col("gt_attacks")))
    return out.withColumn("throughput", F.when(F.col("_seconds") > 0, F.col("flows_processed") / F.col("_seconds"))
                          .otherwise(0.0)).drop("_seconds", "stage2_correct")


def latency_summary(timings: DataFrame, value: str = "latency_ms") -> DataFrame:
    """Mean, min, max and interpolated percentiles of measured durations."""
    from packetloom.plans.quantiles import percentile_array

    probs = {"median": 0.5, "p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    n = timings.agg(F.count(F.col(value).cast("double"))).first()[0]
    out = timings.agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"),
                      percentile_array(timings, value, list(probs.values()), n).alias("p"))
    return out.select("mean", *[F.col("p")[k].alias(name) for k, name in enumerate(probs)], "min", "max")


def class_weights(df: DataFrame, label: str = "label", out: str = "classWeight") -> DataFrame:
    """weight = total / (classes x class count), joined back from the class-count table."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    facts = counts.agg(F.struct(F.sum("_n").alias("total"), F.count("*").alias("classes")).alias("f")).scalar()
    weights = counts.select(
        label, (facts.getField("total").cast("double") / (facts.getField("classes") * F.col("_n"))).alias(out)
    )
    # as a table of known size it is broadcast exactly when it is small; `df` is then not shuffled
    return df.join(materialise(weights, "class-weights"), label)


def compare_predictions(a: DataFrame, b: DataFrame, key: str,
                        fields: tuple[str, ...] = ("is_attack", "attack_type", "severity")) -> DataFrame:
    """Rows whose verdict differs between two scored tables, with both verdicts."""
    left = a.select(key, F.struct(*fields).alias("before"))
    right = b.select(key, F.struct(*fields).alias("after"))
    return left.join(right, key, "full").where(~F.col("before").eqNullSafe(F.col("after")))


def comparison_flag(differences: DataFrame) -> DataFrame:
    return differences.agg(F.count("*").alias("differences")).withColumn("passed", F.col("differences") == 0)


def class_distribution(df: DataFrame, label: str = "stage1_label", attack_label: str = "attack_label") -> DataFrame:
    """Benign first, then attack classes by size; percentages are of all rows."""
    name = F.when(F.col(label) == 0, "Benign").otherwise(F.col(attack_label))
    out = df.groupBy(name.alias("class_name")).agg(F.count("*").alias("count"))
    return out.withColumn("percentage", share("count", 6)).orderBy(
        F.desc(F.col("class_name") == "Benign"), F.desc("count"), "class_name"
    )
