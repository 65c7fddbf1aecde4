"""Helpers of the operators: tables, schemas, bounded samples of labelled rows, connected classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from packetloom.session import materialise, ship

TRAIN_ROWS = 20_000


def ready(spark: SparkSession) -> SparkSession:
    """Long texts: Arrow batches of fewer rows than Spark's default keep a worker's memory small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plus(schema: StructType, **columns: str) -> StructType:
    """A schema with more columns; `schema` itself stays as it is."""
    more = StructType(list(schema.fields))
    for name, kind in columns.items():
        more = more.add(name, kind)
    return more


def least(df: DataFrame, key: list[str], rows: int) -> DataFrame:
    """The `rows` rows of least hash of their key. Larger tables are first cut by the hash to half as many again, so that
    no task sends a whole sample to the driver; a sample that turns out smaller than `rows` is still the same on every run."""
    h, n = F.xxhash64(*key), df.count()
    if n > 2 * rows:
        df = df.filter(h < F.lit(int(2**64 * 1.5 * rows / n) - 2**63))
    return df.orderBy(h, *key).limit(rows)


def labelled(labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> list[tuple[int, int]]:
    """At most `rows` pairs (doc_id, label), the same ones on every run: those with the least hash of the id.

    A row without id or label is no example. An id with contradicting labels counts with the lower one.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("i"), F.col(label).cast("int").alias("y")).dropna()
    known = known.groupBy("i").agg(F.min("y").alias("y"))
    return [(r.i, r.y) for r in least(known, ["i"], rows).collect()]


def classes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, root): the smallest id reachable over the links (a, b), for the ids of `nodes` (id).

    Only linked ids take part in the rounds. Each round hooks every id to the least root among its neighbours' and then
    shortens paths; links inside one class are dropped, so rounds grow with the logarithm of the longest chain. Each
    round's tables are written to the shared folder.
    """
    links = materialise(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    roots = None
    while not links.isEmpty():
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("up"))
        hook = materialise(hook, "hooks")
        for _ in range(64):  # pointers halve their way each time
            up = hook.select(F.col("id").alias("up"), F.col("up").alias("top"))
            step = materialise(hook.join(up, "up", "left").select(
                "id", F.coalesce("top", "up").alias("up"), (F.coalesce("top", "up") < F.col("up")).alias("moved")), "hooks")
            moved = not step.filter("moved").isEmpty()
            hook = step.select("id", "up")
            if not moved:
                break
        if roots is None:
            roots = hook.select("id", F.col("up").alias("root"))
        else:
            up = hook.select(F.col("id").alias("root"), "up")
            roots = roots.join(up, "root", "left").select("id", F.coalesce("up", "root").alias("root"))
        roots = materialise(roots, "roots")
        a, b = hook.select(F.col("id").alias("a"), F.col("up").alias("a2")), hook.select(F.col("id").alias("b"), F.col("up").alias("b2"))
        links = links.join(a, "a").join(b, "b").filter("a2 <> b2").select(
            F.greatest("a2", "b2").alias("a"), F.least("a2", "b2").alias("b")).distinct()
        links = materialise(links, "links")
    nodes = nodes.select("id")
    if roots is None:
        return nodes.select("id", F.col("id").alias("root"))
    return nodes.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
