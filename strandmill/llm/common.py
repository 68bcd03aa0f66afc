"""What several operators share: the shared folder, tables read by path, connected components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many more underscores as it takes to be none of the columns'."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a local session leaves it unset (a test), a temporary folder is set for the session; on a cluster, where
    executors would not share that folder, this is an error.
    """
    sc = spark.sparkContext
    set_now = sc._jsc.sc().getCheckpointDir()
    if set_now.isDefined():
        # Spark appends an id of its own to the folder that was set
        return set_now.get()
    path = sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="strandmill-")
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def store(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """Write df once to the shared folder and read it back: cuts the lineage and survives lost executors. Also its path."""
    path = shared_path(df.sparkSession, what)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, what: str) -> DataFrame:
    """As :func:`store`, for tables that stay until the shared folder goes, since results still read them."""
    return store(df, what)[0]


#: Stored tables of at most so many bytes are broadcast; larger ones are shuffled.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, row_bytes: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """A stored table, to be broadcast if its rows, of about so many bytes each, are within the bound."""
    return F.broadcast(df) if df.count() * row_bytes <= most else df


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def give_back() -> None:
    """Return what the allocator keeps of freed batches: the worker stays, beside other stages' tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node, root being the smallest node that can be reached.

    nodes: column ``node``; edges: columns ``u`` and ``v``, undirected, repeats and loops allowed.
    Alternating large-star and small-star rounds over the edge table, each written to the shared folder, so that
    the number of rounds grows with the logarithm of the longest chain. Neither links nor components reach the
    driver: only one fingerprint of the edge table per round does, to see that it no longer changes.
    A node of the result without an edge is its own root.
    """
    spark = edges.sparkSession
    shared_dir(spark)
    e = (
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
        .checkpoint()
    )
    seen = _print_of(e)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        e = _star(_star(e, large=True), large=False).checkpoint()
        now = _print_of(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("connected components did not settle")
    roots = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _print_of(e: DataFrame) -> tuple:
    row = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row.n, row.h


def _star(e: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or, for a small star, smaller) neighbours to the least of its neighbourhood.

    The least neighbour is a partial aggregate joined back, so a hub is never gathered in one task.
    """
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    j = both.join(least, "u")
    if large:
        out = j.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            j.select("u", F.col("m").alias("v"))
        )
    return out.where(F.col("u") != F.col("v")).distinct()
