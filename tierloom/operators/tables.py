"""Written intermediate tables, exact distributed ranks, joins of uneven groups, and connected components."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Only where that is unset and there is no executor but the driver, one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master or 'the cluster'} share")
        at = tempfile.mkdtemp(prefix="tierloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session may be gone; the cluster then cleans its own folder
        pass


def written(df: DataFrame, name: str = "table", by: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder, and read it again.

    Unlike ``checkpoint()`` this evaluates the plan once and stays columnar and compressed. A reader that
    loses its executor reads the files again. The files go when the session's process ends, or by ``done``. ``by``: a
    column of a few values, by which the files are told apart; a task writes them side by side, without a sort.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    setting = "spark.sql.maxConcurrentOutputFileWriters"
    was = spark.conf.get(setting)
    if by:
        spark.conf.set(setting, "16")
    try:
        df.write.parquet(path, partitionBy=by)
    finally:
        if by:
            spark.conf.set(setting, was)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def done(df: DataFrame, part: str = "") -> None:
    """Delete the files of a written table, or of a part of it (column=value), when nothing that isn't written itself needs them."""
    _delete(df.sparkSession, f"{df.written_at}/{part}".rstrip("/"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str = "ranked") -> DataFrame:
    """Add ``rank``, from 0, within ``group`` (columns without nulls), by ``order``; no group is in one task.

    A range shuffle on group and order sorts all rows; a partition's rows are numbered in place, and the
    numbers of rows in the partitions before it, a few per partition, are added. Ties: by the order's rest.
    """
    rows = written(
        df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("_seq", F.monotonically_increasing_id()), name
    )
    rows = rows.withColumn("_part", F.shiftright("_seq", 33))
    runs = rows.groupBy(*group, "_part").agg(F.min("_seq").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return rows.join(runs, [*group, "_part"]).withColumn("rank", F.col("_base") + F.col("_seq") - F.col("_first")).drop("_seq", "_part", "_first", "_n", "_base")


#: Heavy groups at most, if a join doesn't say otherwise.
HEAVY = 1024


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, most: int = HEAVY) -> DataFrame:
    """Join rows with their groups (one row per key, ``size`` rows each of ``total``), however uneven the groups are.

    Heavy are groups with at least one in ``most`` of all rows, so there can't be more than ``most``. Their rows meet a
    broadcast and don't move; the others shuffle by key.
    """
    heavy = F.col(size) * most >= total
    hot, rest = F.broadcast(groups.filter(heavy)), groups.filter(~heavy)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(rest, keys))


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """Connected components: ``u`` and ``root``, the least node of its component, for every node of an edge but the roots.

    Each partition first reduces its edges to a spanning forest (union-find), which keeps what is connected and has
    fewer edges than nodes. Then large stars and small stars alternate, each a group-by and a join, until nothing
    changes; the number of rounds grows as the logarithm of the longest path.
    """

    def forest(batches):
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (up := parent.get(root, root)) != root:
                root = up
            while x != root:
                parent[x], x = root, parent.get(x, x)
            return root

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = find(a), find(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        nodes = list(parent)
        for i in range(0, len(nodes), 65536):
            some = [(x, find(x)) for x in nodes[i : i + 65536]]
            some = [(x, r) for x, r in some if x != r]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in some], pa.int64()), pa.array([r for _, r in some], pa.int64())], ["a", "b"])

    now = written(edges.select(F.col(u).alias("a"), F.col(v).alias("b")).mapInArrow(forest, "a bigint, b bigint").distinct(), "forest")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    was = None
    while (at := state(now)) != was:
        was = at
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        near = large.join(least, "a")
        small = near.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = written(small.distinct(), "stars")
    return now.select(F.col("a").alias(u), F.col("b").alias("root"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until the frame has no column of that name, in any case."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out
