"""Session set-up, table access and lineage cutting shared by all operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def build_session(cpus: str | int = "*", app: str = "lumenmesh", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster, pass your own session instead."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table of a data directory. TIMESTAMP_NTZ columns stay as they are stored."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by spark.checkpoint.dir.

    Where the session names none, a temporary folder of this machine is made and set if the master is local;
    on a cluster its executors would each write to a disk of their own, so there it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lumenmesh-")
        atexit.register(shutil.rmtree, where.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage.

    Unlike an executor-local cache they survive the loss of any executor. `drop` removes one as soon
    as no later step reads it, so an iterative operator keeps only its last rounds on disk. What a result
    still reads has to outlive this object: `clean` removes it once results are written, and so does the
    end of the Python process that made it.
    """

    made: ClassVar[dict[str, SparkSession]] = {}

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def cut(self, df: DataFrame, by: str | None = None) -> tuple[DataFrame, str]:
        """(the table as read again, its path); with `by`, in a folder for each value of that column."""
        self.n += 1
        path = f"{self.root}/t{self.n}"
        self.made[self.root] = self.spark
        (df.write if by is None else df.write.partitionBy(by)).parquet(path)
        kept = df.schema if by is None else T.StructType([f for f in df.schema if f.name != by] + [df.schema[by]])
        return self.spark.read.schema(kept).parquet(path), path

    def home(self) -> str:
        """The folder itself, for tables that are written otherwise; it is cleaned like the others."""
        self.made[self.root] = self.spark
        return self.root

    def drop(self, path: str) -> None:
        _delete(self.spark, path)

    @classmethod
    def clean(cls, spark: SparkSession) -> None:
        """Removes all tables of a session; results that are not written yet can't be read after this."""
        for root in [r for r, s in cls.made.items() if s is spark]:
            _delete(spark, root)
            del cls.made[root]


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean_at_exit() -> None:
    for spark in {id(s): s for s in Scratch.made.values()}.values():
        try:
            Scratch.clean(spark)
        except Exception:  # noqa: BLE001 - the session may have ended before
            pass


atexit.register(_clean_at_exit)


def hot_keys(df: DataFrame, keys: list[str], threshold: int, max_hot: int = 10_000, total: int | None = None) -> DataFrame:
    """Keys with so many rows that their group must be split: (*keys, n_salts).

    The threshold rises with the number of rows so that fewer than `max_hot` keys can reach it; the
    result therefore has a proven size bound and may be broadcast. Counts are pre-aggregated.
    """
    rows = df.count() if total is None else total
    limit = max(threshold, -(-rows // max_hot))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > limit).select(*keys, F.ceil(F.col("n") / limit).cast("int").alias("n_salts"))



def hot_list(df: DataFrame, keys: list[str], threshold: int, max_hot: int = 10_000) -> DataFrame | None:
    """`hot_keys`, worked out at once; None if there are none, which counts by hash tell without a shuffle of the keys.

    A key that is hot makes its hash bucket at least as full; only the rows of such buckets are counted by key.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(1 << 16)).alias("bucket")
    counts, _ = Scratch(df.sparkSession, "buckets").cut(df.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")))
    rows = counts.agg(F.sum("n")).first()[0] or 0
    full = counts.where(F.col("n") > max(threshold, -(-rows // max_hot))).select("bucket")
    if full.isEmpty():
        return None
    some = df.select(*keys, bucket).join(F.broadcast(full), "bucket", "left_semi")
    hot, _ = Scratch(df.sparkSession, "hot").cut(hot_keys(some, keys, threshold, max_hot, total=rows))
    return None if hot.isEmpty() else hot
