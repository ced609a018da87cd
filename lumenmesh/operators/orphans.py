"""References to records that do not exist, tracked by keyed state that is kept incrementally.

A ledger holds, per (ref_table, ref_key), the parent index (the points in time at which the parent's newest
version changed), how many references point there in each period, and the references found to be orphans.
Each batch of new references and parents advances it:

* new references probe the index, which the batch's own parents have joined: what was seen at their time;
* parents that arrive resolve the references that wait for them: missing ones turn out to be late;
* deletions reopen: a key whose newest version is gone leaves its references pending, which the periodic
  snapshot counts.

State is only appended to: a batch adds a folder to each table, so no batch rewrites what is kept, and one
that is run again replaces its own folders. References and points of a key come together; those of a hot key
go by days, and the references of its crowded days over salts, to which its points of the day are copied.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Scratch, hot_keys, hot_list

#: Columns of both inputs. References: ref_table, ref_id, ref_key, t. Parents: ref_table, ref_key, t, version (orders a
#: parent's states; the largest seen counts), alive.
KEY = ["ref_table", "ref_key"]
#: At most so many keys are treated as hot and broadcast.
MAX_HOT = 10_000
TOP = "struct<version: bigint, alive: boolean>"


def period_of(t: str = "t") -> F.Column:
    return F.date_format(t, "yyyy-MM")


def clean_refs(refs: DataFrame) -> DataFrame:
    return refs.select(*KEY, F.col("ref_id").cast("bigint").alias("ref_id"), "t").where("ref_key is not null and t is not null")


def change_points(parents: DataFrame, hot_rows: int = 100_000) -> DataFrame:
    """(ref_table, ref_key, t, top): the times at which a key's newest (version, alive) may change.

    Of keys with very many deliveries only those remain that change it within a day: folded to one row per
    key and time before they meet, with a day of a key as the largest group.
    """
    p = parents.where("ref_key is not null and t is not null").select(*KEY, "t", F.struct(F.col("version").cast("bigint").alias("version"), F.coalesce("alive", F.lit(True)).alias("alive")).alias("top"))
    if (hot := hot_list(p, KEY, hot_rows, MAX_HOT)) is None:
        return p
    hot = F.broadcast(hot.select(*KEY))
    many = p.join(hot, KEY, "left_semi").groupBy(*KEY, "t").agg(F.max("top").alias("top"))
    before = F.max("top").over(Window.partitionBy(*KEY, F.to_date("t")).orderBy("t").rowsBetween(Window.unboundedPreceding, -1))
    many = many.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("top") > F.col("_b"))).drop("_b")
    return p.join(hot, KEY, "left_anti").union(many)


def _cause(ever: F.Column, now: F.Column) -> F.Column:
    return F.when(~ever, "missing").when(now.isNull(), "late").when(~now["alive"], "deleted").alias("cause")


def judge(refs: DataFrame, points: DataFrame, hot_rows: int = 100_000) -> DataFrame:
    """refs with their cause: missing (no parent is ever seen), late (none was seen by then), deleted (the newest
    version seen by then is not alive), or null where there is none.

    Points at the very time of a reference count as seen. The references and points of a key meet in one
    group; keys with more than `hot_rows` of both go by days and salts.
    """
    refs, points = refs.select(*KEY, "ref_id", "t"), points.select(*KEY, "t", "top")
    hot = hot_list(refs.select(*KEY).union(points.select(*KEY)), KEY, hot_rows, MAX_HOT)
    split = []
    if hot is not None:
        some = F.broadcast(hot.select(*KEY))
        split = [_judge_split(*(df.join(some, KEY, "left_semi") for df in (refs, points)), hot_rows)]
        refs, points = (df.join(some, KEY, "left_anti") for df in (refs, points))
    events = refs.select(*KEY, "t", F.lit(1).alias("step"), "ref_id", F.lit(None).cast(TOP).alias("top")).union(points.select(*KEY, "t", F.lit(0), F.lit(None).cast("bigint"), "top"))
    # at one time parents come before references
    w = Window.partitionBy(*KEY)
    now = F.max("top").over(w.orderBy("t", "step").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seen = events.select(*KEY, "ref_id", "t", "step", now.alias("now"), F.max("top").over(w).isNotNull().alias("ever")).where("step = 1")
    return reduce(DataFrame.union, split, seen.select(*KEY, "ref_id", "t", _cause(F.col("ever"), F.col("now"))))


def _judge_split(refs: DataFrame, points: DataFrame, hot_rows: int) -> DataFrame:
    """`judge` of hot keys: the state at the start of each day of a key is carried to it; the references of a crowded day are spread over salts."""
    day = F.to_date("t").alias("day")
    refs, points = refs.select("*", day), points.select("*", day)
    folded = points.groupBy(*KEY, "day").agg(F.max("top").alias("top"))
    days = refs.groupBy(*KEY, "day").agg(F.count(F.lit(1)).alias("n"))
    by_day = folded.select(*KEY, "day", "top", F.lit(0).cast("bigint").alias("n")).union(days.select(*KEY, "day", F.lit(None).cast(TOP), "n"))
    w = Window.partitionBy(*KEY).orderBy("day")
    ever = F.max("top").over(Window.partitionBy(*KEY)).isNotNull().alias("ever")
    carried = by_day.groupBy(*KEY, "day").agg(F.max("top").alias("top"), F.sum("n").alias("n")).select(*KEY, "day", "n", F.max("top").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("top"), ever).where("n > 0").drop("n")
    hot = F.broadcast(hot_keys(refs, [*KEY, "day"], hot_rows, MAX_HOT))
    n = F.coalesce("n_salts", F.lit(1))
    salts = F.explode(F.sequence(F.lit(0), n - 1)).alias("salt")
    keyed = refs.join(hot, [*KEY, "day"], "left").select(*KEY, "day", "ref_id", "t", F.pmod(F.xxhash64("ref_id", "t"), n).cast("int").alias("salt"))
    points = points.join(hot, [*KEY, "day"], "left").select(*KEY, "day", "t", "top", salts)
    carried = carried.join(hot, [*KEY, "day"], "left").select(*KEY, "day", "top", "ever", salts)
    none = lambda t: F.lit(None).cast(t)
    events = (
        keyed.select(*KEY, "day", "salt", F.lit(2).alias("step"), "t", "ref_id", none(TOP).alias("top"), none("boolean").alias("ever"))
        .union(points.select(*KEY, "day", "salt", F.lit(1), "t", none("bigint"), "top", none("boolean")))
        .union(carried.select(*KEY, "day", "salt", F.lit(0), none(refs.schema["t"].dataType), none("bigint"), "top", "ever"))
    )
    # nulls sort first, so the carried state opens each day
    w = Window.partitionBy(*KEY, "day", "salt").orderBy("t", "step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = events.select(*KEY, "step", "ref_id", "t", F.max("top").over(w).alias("now"), F.max("ever").over(w).alias("ever")).where("step = 2")
    return seen.select(*KEY, "ref_id", "t", _cause(F.col("ever"), F.col("now")))


class Ledger:
    """The kept state, in a folder: tables `points`, `counts` and `found`, with a folder for each batch.

    found has every reference whose cause became another one in a batch; a null cause is that of an orphan
    that a parent delivered out of time has resolved. Batches must come in order of time for references that
    were no orphans: they are not looked at again. One after the first, with the state before it missing, is
    an error.
    """

    TABLES = ("points", "counts", "found")

    def __init__(self, spark: SparkSession, root: str, hot_rows: int = 100_000):
        self.spark, self.root, self.hot_rows = spark, root, hot_rows

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str, batch: int) -> str:
        return f"{self.root}/{name}/batch={batch}"

    def _has(self, name: str, batch: int) -> bool:
        p, fs = self._fs(f"{self._path(name, batch)}/_SUCCESS")
        return fs.exists(p)

    def table(self, name: str, upto: int) -> DataFrame:
        """What the batches up to one have added, with their number."""
        schema = {"points": f"ref_table string, ref_key string, t {self.time}, top {TOP}", "counts": "ref_table string, ref_key string, period string, n_refs bigint", "found": f"ref_table string, ref_key string, ref_id bigint, t {self.time}, cause string"}[name]
        parts = []
        for b in range(upto + 1):
            if not self._has(name, b):
                raise FileNotFoundError(f"the state of batch {b} is missing: {self._path(name, b)}")
            parts.append(self._path(name, b))
        if not parts:
            return self.spark.createDataFrame([], schema + ", batch int")
        return self.spark.read.schema(schema + ", batch int").option("basePath", f"{self.root}/{name}").parquet(*parts)

    def advance(self, refs: DataFrame, parents: DataFrame, batch: int, count: bool = True) -> None:
        """Takes in a batch of references and parents; nulls in key or time are ignored, a null alive is alive.

        Without `count` the batch adds nothing to the periodic counts.
        """
        refs = clean_refs(refs)
        self.time = refs.schema["t"].dataType.simpleString()
        put = lambda df, name: df.write.mode("overwrite").parquet(self._path(name, batch))
        index, found = (self.table(n, batch - 1).drop("batch" if n == "points" else "") for n in ("points", "found"))
        put(change_points(parents, self.hot_rows), "points")
        counted = refs if count else refs.limit(0)
        put(counted.groupBy(*KEY, period_of().alias("period")).agg(F.count(F.lit(1)).alias("n_refs")), "counts")
        new = self.spark.read.schema(index.schema).parquet(self._path("points", batch))
        if batch == 0:
            put(judge(refs, new, self.hot_rows).where("cause is not null").distinct(), "found")
            return
        waiting = current(found).where("cause = 'missing'").join(new.select(*KEY).distinct(), KEY, "left_semi").select(*KEY, "ref_id", "t")
        judged = refs.union(waiting)
        # the index is narrowed to the keys at issue first if they are few beside it
        if index.count() > 10 * judged.count():
            index = index.join(judged.select(*KEY).distinct(), KEY, "left_semi")
        was = waiting.withColumn("was", F.lit("missing"))
        changed = judge(judged, index.union(new), self.hot_rows).distinct().join(was.distinct(), [*KEY, "ref_id", "t"], "left")
        put(changed.where("not (cause <=> was)").drop("was"), "found")

    def orphans(self, upto: int) -> DataFrame:
        """(ref_table, ref_key, ref_id, t, cause) of all orphans as they stand after a batch."""
        return current(self.table("found", upto)).where("cause is not null")

    def snapshot(self, upto: int) -> DataFrame:
        """(ref_table, n_refs, n_pending) at the end of a batch: a reference is pending if its parent is not there or gone."""
        top = self.table("points", upto).groupBy(*KEY).agg(F.max("top").alias("top"))
        n = self.table("counts", upto).groupBy(*KEY).agg(F.sum("n_refs").alias("n_refs"))
        waits = F.when(F.col("top").isNull() | ~F.col("top.alive"), F.col("n_refs")).otherwise(0)
        return n.join(top, KEY, "left").groupBy("ref_table").agg(F.sum("n_refs").alias("n_refs"), F.sum(waits).alias("n_pending"))

    def periods(self, upto: int) -> DataFrame:
        """(ref_table, period, n_new, n_changed, n_pending): the snapshots of all periods, see `pending_counts`."""
        folded = self.table("points", upto).groupBy(*KEY, period_of().alias("period")).agg(F.max("top").alias("top"))
        rows = folded.select(*KEY, "period", "top", F.lit(0).cast("bigint").alias("n_refs")).union(self.table("counts", upto).select(*KEY, "period", F.lit(None).cast(TOP), "n_refs"))
        rows = rows.groupBy(*KEY, "period").agg(F.max("top").alias("top"), F.sum("n_refs").alias("n_refs"))
        w = Window.partitionBy(*KEY).orderBy("period")
        sofar = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ended = F.max("top").over(sofar)
        s = rows.select("ref_table", "ref_key", "period", "n_refs", F.sum("n_refs").over(sofar).alias("so_far"), ended.alias("ended"))
        s = s.withColumn("waiting", F.when(F.col("ended").isNull() | ~F.col("ended.alive"), F.col("so_far")).otherwise(0))
        s = s.select("ref_table", "period", "n_refs", (F.col("waiting") - F.coalesce(F.lag("waiting").over(w), F.lit(0))).alias("change"))
        per = s.groupBy("ref_table", "period").agg(F.sum("n_refs").alias("n_new"), F.sum("change").alias("n_changed"))
        return per.select("*", F.sum("n_changed").over(Window.partitionBy("ref_table").orderBy("period")).alias("n_pending"))


def current(found: DataFrame) -> DataFrame:
    """The last cause of each reference in a ledger's table of what was found."""
    return found.groupBy(*KEY, "ref_id", "t").agg(F.max_by(F.struct("cause"), "batch").alias("c")).select(*KEY, "ref_id", "t", "c.cause")


def replay(refs: DataFrame, parents: DataFrame, hot_rows: int = 100_000, batches: int = 2, count: bool = True) -> tuple[Ledger, int]:
    """(ledger, last batch): takes the whole past in, in slices of equal length of time, from an empty ledger.

    Both inputs are read once for each slice, so they should be tables rather than costly plans.
    """
    spark = refs.sparkSession
    low, high = refs.agg(F.min("t"), F.max("t")).first() if batches > 1 else (None, None)
    if low is None or low == high:
        batches = 1
    cuts = [low + (high - low) * k / batches for k in range(1, batches)]
    ledger = Ledger(spark, f"{Scratch(spark, 'orphans').home()}/ledger", hot_rows)
    for k in range(batches):
        some = lambda df: reduce(DataFrame.where, ([F.col("t") >= F.lit(cuts[k - 1])] if k else []) + ([F.col("t") < F.lit(cuts[k])] if k < batches - 1 else []), df)  # noqa: B023, E731
        ledger.advance(some(refs), some(parents), k, count)
    return ledger, batches - 1


def orphans(refs: DataFrame, parents: DataFrame, hot_rows: int = 100_000, batches: int = 2) -> DataFrame:
    """Distinct (ref_table, ref_id, ref_key, cause, ref_month) of references that were orphans at their time.

    cause as in `judge`. References with a null key or time, and parents with a null key or time, are
    ignored; a parent with a null alive counts as alive. Repeated rows change nothing, ties in time count
    the parent as seen. Empty inputs: without references nothing, without parents all are missing. Extra
    columns are ignored. The past is taken in by batches; their number changes nothing in the result.
    """
    ledger, last = replay(refs, parents, hot_rows, batches, count=False)
    return ledger.orphans(last).select("ref_table", "ref_id", "ref_key", "cause", period_of().alias("ref_month")).distinct()


def pending_counts(refs: DataFrame, parents: DataFrame, batches: int = 2) -> DataFrame:
    """(ref_table, period, n_new, n_changed, n_pending): the periodic snapshot of waiting references.

    n_new: references made in the period; n_changed: by how much the number of references that wait for
    a parent changed; n_pending: how many wait at its end. A reference waits while no parent was seen or
    the newest version is not alive. Repeated references count each time. Nulls as in `orphans`.
    """
    ledger, last = replay(refs, parents, batches=batches)
    return ledger.periods(last)
