"""Shared plumbing: tables in the shared folder, checked inputs, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent and all of Spark runs in this process (tests), a
    temporary folder is made and remembered in the session; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("protolith.scratch.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="protolith-")
            spark.conf.set("protolith.scratch.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back.

    It cuts the lineage: a lost executor costs a re-read, never a recomputation,
    and values that depend on task order are fixed from here on.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/protolith/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame) -> DataFrame:
    """``uid`` and ``row`` (a struct of all columns) of each row, written, so that a row keeps its number."""
    return written(docs.select(F.monotonically_increasing_id().alias("uid"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")), "rows")


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The columns of ``numbered`` rows whose ``uid`` is not in ``gone``.

    ``gone`` is written first, so Spark knows its size: up to spark.sql.autoBroadcastJoinThreshold
    the numbers are broadcast and no text is shuffled, beyond it both sides are shuffled by number.
    """
    return rows.join(written(gone, "gone"), "uid", "left_anti").select("row.*")


def clear_written(spark: SparkSession) -> None:
    """Remove all tables of ``written``. Results that still read them are lost, so only call it when none is in use."""
    _delete(spark, f"{shared_dir(spark)}/protolith")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Written tables of one computation that go when it has its result."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{shared_dir(spark)}/protolith/scratch-{uuid.uuid4().hex}"
        self.count = 0

    def written(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        _delete(self.spark, self.base)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id for each node of an undirected graph.

    ``edges`` has long columns ``u`` and ``v``. Returns ``node`` and
    ``component`` for every node with an edge to another node; null ends and
    self links are ignored. Alternating large-star and small-star rounds: each is
    a minimum per node (combined map-side) joined back to the edges, both read
    from written tables so that a hub's rows can be split by the skew-join rule.
    An empty input gives an empty output. The tables of the rounds are removed at the end.
    """
    scratch = Scratch(edges.sparkSession)
    e = scratch.written(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v"))
        .distinct()
    )
    before = None
    for _ in range(max_rounds):
        # Large star: every larger neighbour of a node links to the node's minimum.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = (
            e.select(F.col("v").alias("u"), F.col("u").alias("v"))
            .join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        e = scratch.written(large)
        # Small star: smaller neighbours and the node itself link to the least of them.
        least = scratch.written(e.groupBy("u").agg(F.min("v").alias("m")))
        small = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = scratch.written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            out = written(stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
            scratch.drop()
            return out
        before = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
