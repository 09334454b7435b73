"""Tables written to shared storage, by which loops cut their lineage.

An executor's loss must not lose a round's result, so rounds go to a folder
that all executors share, never to their own disks.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where it is unset, a temporary folder is made for a local master; on a
    cluster that is an error, as a folder of one machine would be lost.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="lexiweave-")
        sc.setCheckpointDir(_local_dirs[sc.applicationId])
    return _local_dirs[sc.applicationId]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already; the folder is a temporary one
        pass


def buckets_for(rows: int, rows_per_bucket: int) -> int:
    """So many buckets that one holds rows_per_bucket at most on average: a power of two, so that growth seldom changes it."""
    return 1 << max(0, -(-rows // rows_per_bucket) - 1).bit_length()


class Scratch:
    """The written tables of one run of an operator.

    ``write`` materialises a frame and returns a reader of the files. ``drop``
    removes tables that later ones have replaced. What is left goes when the
    process ends, since a returned frame may still read it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/lexiweave/{name}-{uuid.uuid4().hex[:12]}"
        self.paths: dict[str, str] = {}
        self.tables: dict[str, str] = {}
        atexit.register(_remove, spark, self.root)

    def write(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        path = f"{self.root}/{name}"
        w = df.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def write_bucketed(self, df: DataFrame, name: str, key: str, buckets: int, parts: str | None = None) -> DataFrame:
        """Like write, in buckets by the hash of ``key`` and folders by the column ``parts``: a join on the key reads each bucket where it lies.

        Rows should already lie in as many partitions by the key, else each
        task writes a file for each bucket.
        """
        path, own = f"{self.root}/{name}", f"lexiweave_{uuid.uuid4().hex}"
        w = df.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path)
        (w.partitionBy(parts) if parts else w).saveAsTable(own)
        self.paths[name], self.tables[name] = path, own
        return self.spark.table(own)

    def unbucketed(self, name: str) -> DataFrame:
        """A table of write_bucketed read as plain files: a union of bucketed tables claims a partitioning that it does not keep in Spark 4.1."""
        return self.spark.read.schema(self.spark.table(self.tables[name]).schema).parquet(self.paths[name])

    def drop(self, *names: str) -> None:
        for n in names:
            if n in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(n)}")
            if n in self.paths:
                _remove(self.spark, self.paths.pop(n))
