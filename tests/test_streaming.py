import pytest

from lumenmesh.streaming.ledger import OrphanLedger

EVENT = "kind string, ref_table string, ref_key string, ref_id bigint, version bigint, alive boolean"


def test_ledger_follows_a_stream(spark, tmp_path):
    batches = [
        [("ref", "t", "a", 1, None, None), ("ref", "t", "b", 2, None, None), ("parent", "t", "c", None, 1, True), ("ref", "t", "c", 3, None, None), ("ref", "t", None, 9, None, None)],
        [("parent", "t", "a", None, 1, True), ("parent", "t", "c", None, 2, False), ("ref", "t", "c", 4, None, None)],
        [("parent", "t", "c", None, 3, None), ("ref", "u", "c", 5, None, None)],
    ]
    ledger = OrphanLedger(spark, "x", f"file://{tmp_path}/s")
    pending = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))
        ledger.follow(stream, str(tmp_path / "ck")).awaitTermination(60)
        pending.append({r["ref_table"]: (r["n_refs"], r["n_pending"]) for r in ledger.snapshot(k).collect()})
    assert pending == [{"t": (3, 2)}, {"t": (4, 3)}, {"t": (4, 1), "u": (1, 1)}]
    told = {(r["ref_table"], r["ref_id"], r["ref_key"], r["cause"], r["batch"]) for r in ledger.table("found", 2).collect()}
    assert told == {("t", 1, "a", "missing", 0), ("t", 2, "b", "missing", 0), ("t", 1, "a", "late", 1), ("t", 4, "c", "deleted", 1), ("u", 5, "c", "missing", 2)}
    now = {(r["ref_table"], r["ref_id"], r["cause"]) for r in ledger.orphans(2).collect()}
    assert now == {("t", 1, "late"), ("t", 2, "missing"), ("t", 4, "deleted"), ("u", 5, "missing")}
    ledger.apply(spark.createDataFrame(batches[2], EVENT), 2)
    assert {r["ref_table"]: r["n_pending"] for r in ledger.snapshot(2).collect()} == {"t": 1, "u": 1}
    with pytest.raises(FileNotFoundError):
        OrphanLedger(spark, "x", f"file://{tmp_path}/lost").apply(spark.createDataFrame(batches[2], EVENT), 2)
