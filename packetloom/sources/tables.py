"""Scans and sinks for flow, packet, alert and report tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from packetloom.schemas import PACKET_SCHEMA, RAW_COLUMNS, RAW_SCHEMA

BUFFER = ("io.file.buffer.size", 131_072)  # bytes a compressed file is unpacked by at a time


def read_flow_csv(spark: SparkSession, paths: str | list[str], infer: bool = False,
                  schema: T.StructType | None = None) -> DataFrame:
    """Labelled flow files in one multi-path scan; strings unless a schema or `infer` is given."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("multiLine", False)
    if infer:
        return reader.option("inferSchema", True).csv(paths)
    return reader.schema(schema or RAW_SCHEMA).option("enforceSchema", False).csv(paths)


def read_flow_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Daily files whose headers may differ in order or carry extra columns, united strictly by name: one multi-path scan
    for each distinct header line, however many files share it. Of a header no more than the file's first line is read."""
    place = F.col("_metadata.file_path").alias("path")
    files = [unquote(r.path) for r in spark.read.format("binaryFile").load(paths).select(place).distinct().orderBy("path").collect()]
    with ThreadPoolExecutor(16) as several:
        heads = [*several.map(lambda p: spark.read.option(*BUFFER).text(p).first(), files)]
    layouts: dict[str, list[str]] = {}
    for path, head in zip(files, heads):
        if head is not None:
            layouts.setdefault(head.value, []).append(path)
    out = None
    for header in sorted(layouts):
        part = canonicalise(with_source_file(
            spark.read.option("header", True).option("mode", "PERMISSIVE").option(*BUFFER).csv(layouts[header])))
        out = part if out is None else out.unionByName(part, allowMissingColumns=False)
    return out


def read_flows(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def discover(spark: SparkSession, paths: list[str], expected: int | None = None, pattern: str = "*.{csv,csv.gz}") -> DataFrame:
    """Input files below several roots, each once, sorted; fails when the number is not `expected`."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
        .load(paths).select("path", "length", "modificationTime").dropDuplicates(["path"])
    )
    if expected is not None:
        found = files.count()
        if found != expected:
            raise ValueError(f"expected {expected} files, found {found}")
    return files.orderBy("path")


def with_source_file(df: DataFrame, column: str = "source_file") -> DataFrame:
    return df.withColumn(column, F.col("_metadata.file_name"))


def canonicalise(df: DataFrame, columns: list[str] | None = None, keep: tuple[str, ...] = ("source_file",)) -> DataFrame:
    """Strips header names, requires the canonical columns, drops the rest."""
    columns = columns or RAW_COLUMNS
    trimmed = df.toDF(*[c.strip() for c in df.columns])
    missing = [c for c in columns if c not in trimmed.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return trimmed.select(*[F.col(f"`{c}`") for c in columns], *[c for c in keep if c in trimmed.columns])


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode(mode).option("compression", "snappy")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_report(df: DataFrame, root: str, name: str) -> None:
    write_table(df, f"{root.rstrip('/')}/{name}")


def write_metrics(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Evaluation results as JSON or CSV."""
    if fmt not in ("json", "csv"):
        raise ValueError(f"unsupported metrics format {fmt!r}")
    writer = df.write.mode("overwrite")
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path))


def table_check(df: DataFrame, label: str = "Label", source: str = "source_file") -> DataFrame:
    """One row of facts about a table, from a single pass."""
    text = F.trim(F.col(f"`{label}`"))
    source_count = F.count_distinct(F.col(source)) if source in df.columns else F.lit(0).cast("long")
    return df.agg(
        F.count("*").alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.count_if(text == label).alias("header_artifacts"),
        F.count_if(text.isNull() | (text == "")).alias("unlabelled"),
        F.count_distinct(text).alias("labels"),
        source_count.alias("sources"),
    )


def verify_table(spark: SparkSession, path: str, label: str = "Label", rows: int | None = None,
                 columns: int | None = None) -> DataFrame:
    """Re-reads a written table and raises when a hard check fails."""
    table = spark.read.parquet(path)
    facts = table_check(table, label)
    seen = facts.first()
    problems = []
    if rows is not None and seen["rows"] != rows:
        problems.append(f"rows {seen['rows']} != {rows}")
    if columns is not None and seen["columns"] != columns:
        problems.append(f"columns {seen['columns']} != {columns}")
    if seen["header_artifacts"]:
        problems.append(f"{seen['header_artifacts']} header artifacts")
    if seen["unlabelled"]:
        problems.append(f"{seen['unlabelled']} unlabelled rows")
    if problems:
        raise ValueError("; ".join(problems))
    return spark.createDataFrame([seen], facts.schema)


def label_shares(spark: SparkSession, path: str, label: str = "Label") -> DataFrame:
    """Label distribution of a written table: rows and percentage of each label, most frequent first."""
    counts = spark.read.parquet(path).groupBy(F.trim(F.col(f"`{label}`")).alias("label")).agg(F.count("*").alias("rows"))
    total = counts.agg(F.sum("rows")).scalar()
    return counts.withColumn("percentage", F.round(F.col("rows") * 100.0 / total, 4)).orderBy(F.desc("rows"), "label")


def flow_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1,
                glob: str | None = None) -> DataFrame:
    """Files of a folder as a stream of batches."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def read_packets(spark: SparkSession, path: str, streaming: bool = False, glob: str | None = None) -> DataFrame:
    """Packet rows in the fixed packet schema, as a table or a stream."""
    if streaming:
        return flow_stream(spark, path, PACKET_SCHEMA, glob=glob)
    return spark.read.schema(PACKET_SCHEMA).parquet(path)


def record_run(runs: DataFrame, known: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Run summaries keyed by `replay_id`; a known id is kept unless `force`.

    A forced upsert refreshes everything but the first start time.
    """
    if known is None:
        return runs
    if not force:
        return known.unionByName(runs.join(known.select("replay_id"), "replay_id", "left_anti"))
    both = known.withColumn("_v", F.lit(0)).unionByName(runs.withColumn("_v", F.lit(1)))
    rest = [c for c in runs.columns if c not in ("replay_id", "start_time")]
    merged = both.groupBy("replay_id").agg(
        F.min_by("start_time", "_v").alias("start_time"), F.max_by(F.struct(*rest), "_v").alias("_s")
    )
    return merged.select("replay_id", "start_time", "_s.*").select(*runs.columns)


def recent_runs(runs: DataFrame, limit: int = 100) -> DataFrame:
    """Run summaries, newest first."""
    return runs.orderBy(F.desc("start_time"), "replay_id").limit(limit)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str, kind=None):
    from pyspark.ml import PipelineModel

    return (kind or PipelineModel).load(path)
