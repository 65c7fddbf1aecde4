"""Two-stage models: a benign/attack detector and an attack classifier."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from packetloom.functions.scoring import severity, severity_by_probability
from packetloom.operators.evaluate import averaged_metrics, class_weights, feature_importance, per_class_metrics
from packetloom.operators.forests import attack_probability, verdict
from packetloom.schemas import DETECTOR_FEATURES, NETWORK_FEATURES, TEMPORAL_FEATURES
from packetloom.session import new_path
from packetloom.sources.tables import load_model, save_model

# Forest settings per model, and the alerting threshold of the one-stage detector.
DETECTOR = dict(numTrees=30, maxDepth=10, maxBins=32, featureSubsetStrategy="sqrt", subsamplingRate=0.7,
                minInstancesPerNode=5, seed=42)
DETECTOR_WEIGHTED = dict(numTrees=100, maxDepth=12, minInstancesPerNode=2, featureSubsetStrategy="sqrt", seed=42)
CLASSIFIER = dict(numTrees=30, maxDepth=10, maxBins=32, featureSubsetStrategy="sqrt", subsamplingRate=0.7,
                  minInstancesPerNode=3, seed=42)
CLASSIFIER_WEIGHTED = dict(numTrees=100, maxDepth=10, minInstancesPerNode=2, featureSubsetStrategy="sqrt", seed=42)
ALERT_THRESHOLD = 0.70


def assemble(features: list[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep")


def index_labels(label: str = "attack_label", out: str = "label", invalid: str = "keep") -> StringIndexer:
    return StringIndexer(inputCol=label, outputCol=out, handleInvalid=invalid)


def _forest(stage: str, label: str, settings: dict, weight: str | None = None) -> RandomForestClassifier:
    named = dict(labelCol=label, featuresCol=f"{stage}_features", predictionCol=f"{stage}_prediction",
                 probabilityCol=f"{stage}_probability", rawPredictionCol=f"{stage}_raw")
    if weight:
        named["weightCol"] = weight
    return RandomForestClassifier(**named, **settings)


def _detached(model: PipelineModel, train: DataFrame) -> PipelineModel:
    """The fitted model without its training summary: a summary holds the session and the
    training plan, which would travel with every task that scores."""
    path = new_path(train.sparkSession, "model")
    save_model(model, path)
    return load_model(path)


def train_detector(train: DataFrame, features: list[str] | None = None, label: str = "stage1_label",
                   weighted: bool = False, **override) -> PipelineModel:
    """Binary forest; with `weighted`, classes count equally and the forest is larger."""
    settings = (DETECTOR_WEIGHTED if weighted else DETECTOR) | override
    if weighted:
        train = class_weights(train, label)
    stages = [assemble(features or DETECTOR_FEATURES, "stage1_features"),
              _forest("stage1", label, settings, "classWeight" if weighted else None)]
    return _detached(Pipeline(stages=stages).fit(train), train)


def train_classifier(train: DataFrame, features: list[str] | None = None, label: str = "attack_label",
                     attack_flag: str | None = "stage1_label", weighted: bool = False, temporal: bool = False,
                     invalid: str = "keep", **override) -> PipelineModel:
    """Multi-class forest over attack rows only, with the label index inside the pipeline."""
    settings = (CLASSIFIER_WEIGHTED if weighted else CLASSIFIER) | override
    if attack_flag:
        train = train.where(F.col(attack_flag) == 1)
    if weighted:
        train = class_weights(train, label)
    features = features or (NETWORK_FEATURES + (TEMPORAL_FEATURES if temporal else []))
    stages = [assemble(features, "stage2_features"), index_labels(label, "stage2_label", invalid),
              _forest("stage2", "stage2_label", settings, "classWeight" if weighted else None)]
    return _detached(Pipeline(stages=stages).fit(train), train)


def class_labels(classifier: PipelineModel) -> list[str]:
    return list(next(s for s in classifier.stages if s.hasParam("stringOrderType")).labels)


def decode_class(index: Column, labels: list[str]) -> Column:
    """Label of a class index; unknown indexes give Unknown."""
    names = F.array(*[F.lit(x) for x in labels])
    return F.coalesce(F.try_element_at(names, index.cast("int") + 1), F.lit("Unknown"))


def index_to_label(labels: list[str], column: str, out: str) -> IndexToString:
    return IndexToString(inputCol=column, outputCol=out, labels=labels)


def _scoring_part(model: PipelineModel) -> PipelineModel:
    """The stages needed to score: everything but the label index."""
    return PipelineModel([s for s in model.stages if not s.hasParam("stringOrderType")])


def detect(df: DataFrame, detector: PipelineModel, threshold: float = ALERT_THRESHOLD) -> DataFrame:
    """Adds `attack_probability` and `is_attack` at a probability threshold."""
    return df.withColumn("attack_probability", attack_probability(detector, df.sparkSession)).withColumn(
        "is_attack", F.col("attack_probability") >= threshold)


def score_two_stage(df: DataFrame, detector: PipelineModel, classifier: PipelineModel,
                    policy: str = "family_confidence", partitions: int | None = None) -> DataFrame:
    """Adds the verdict of both stages; every input column, truth included, rides along.

    Both forests are flat arrays, walked for whole batches in one pass: the second one by detected rows only. Only the features
    leave the JVM; nothing is stored, shuffled, collected or joined back. `partitions` deals the rows anew first, for a scan that
    cannot be split as far as there are cores (a single row group).
    """
    if partitions:
        df = df.repartition(partitions)
    kind = decode_class(F.col("_verdict.kind"), class_labels(classifier))
    scored = df.withColumn("_verdict", verdict(detector, classifier, df.sparkSession)).select(
        *df.columns, "_verdict.is_attack", "_verdict.stage1_confidence", "_verdict.stage2_confidence",
        F.when(F.col("_verdict.is_attack"), kind).otherwise("Benign").alias("attack_type"))
    one, two = F.col("stage1_confidence"), F.col("stage2_confidence")
    scored = scored.withColumn("confidence", F.when(F.col("is_attack"), one * two).otherwise(one))
    level = severity("attack_type", "confidence", policy)
    return scored.withColumn("severity", level)


def detected_only(scored: DataFrame) -> DataFrame:
    return scored.where("is_attack")


def make_alerts(scored: DataFrame, source: str = "BATCH_DETECTION") -> DataFrame:
    """Detected rows with severity by probability and the name of their origin."""
    return detected_only(scored).withColumns({
        "severity": severity_by_probability("attack_probability"), "alert_source": F.lit(source),
    })


def alert_summary(alerts: DataFrame, ports: int = 10) -> DataFrame:
    """Counts by attack type, by severity and of the most hit ports, as (section, name, count)."""
    def part(section: str, c: str) -> DataFrame:
        return alerts.groupBy(F.col(c).cast("string").alias("name")).agg(F.count("*").alias("count")).select(
            F.lit(section).alias("section"), "name", "count")

    top = part("port", "Dst_Port").orderBy(F.desc("count"), "name").limit(ports)
    return part("attack_type", "attack_type").unionByName(part("severity", "severity")).unionByName(top)


def top_alerts(alerts: DataFrame, k: int = 10, tie: str = "alert_id") -> DataFrame:
    return alerts.orderBy(F.desc("attack_probability"), tie).limit(k)


def leakage_report(classifier: PipelineModel, test: DataFrame, features: list[str],
                   label: str = "attack_label") -> tuple[DataFrame, DataFrame]:
    """Importance of the time features and the model's quality on `test`."""
    forest = classifier.stages[-1]
    importance = feature_importance(forest, features, test.sparkSession, top=None, only=TEMPORAL_FEATURES)
    scored = _scoring_part(classifier).transform(test)
    scored = scored.withColumn("predicted_label", decode_class(F.col("stage2_prediction"), class_labels(classifier)))
    return importance, averaged_metrics(per_class_metrics(scored, label, "predicted_label"))
