"""Bursts of requests become one batch each."""

import json
import time

from graphquarry.streaming.requests import REQUEST, gathered

STORE = "spark.sql.streaming.stateStore.providerClass"


def test_a_burst_is_one_batch_of_its_union(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()

    def land(name, *rows):
        (tmp_path / name).write_text("\n".join(json.dumps(dict(zip(("root", "full", "rebuild", "path"), r))) for r in rows))
        (tmp_path / name).rename(landing / name)

    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        land("1.json", ("a", False, False, "x"), ("a", None, None, "y"), ("a", False, False, "x"), ("b", False, True, None), (None, True, True, "z"))
        land("2.json", ("a", True, False, "w"))
        source = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).json(str(landing))  # two batches of the stream
        running = gathered(source, 25_000).writeStream.format("memory").queryName("batches").outputMode("append").trigger(processingTime="500 milliseconds").option("checkpointLocation", str(tmp_path / "c")).start()
        seen = lambda: sorted((tuple(r) for r in spark.table("batches").collect()), key=str)
        first = sorted([("a", 0, True, False, p) for p in "wxy"] + [("b", 0, True, True, None)], key=str)
        until = time.time() + 200
        while len(seen()) < len(first) and time.time() < until:
            time.sleep(0.5)
        assert seen() == first
        land("3.json", ("a", False, False, "x"))
        want = sorted([*first, ("a", 1, False, False, "x")], key=str)
        while seen() != want and time.time() < until + 60:
            time.sleep(0.5)
        assert seen() == want
    finally:
        for q in spark.streams.active:
            q.stop()
        spark.conf.set(STORE, before)
