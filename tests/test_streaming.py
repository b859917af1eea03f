"""Ordered emission from map state: order, restarts from the checkpoint, reports of lost indices."""

import json
import time

from seqweft.streaming import windows


def test_order_restart_and_lost_indices(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, seen, lost = tmp_path / "in", [], []
    source.mkdir()

    def run(name, rows, n, reports=0):
        """The n rows that come out, in their order; timers make batches without end, so the query is stopped then."""
        (source / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(("p", "i", "v"), r, strict=True))) for r in rows))
        stream = spark.readStream.schema("p string, i long, v array<int>").json(str(source))
        out = windows.in_order_timed(stream, "p", "i", "v", patience_ms=8_000)
        q = out.writeStream.foreachBatch(lambda df, _: [(lost if r.lost else seen).append(tuple(r)) for r in df.collect()]).option("checkpointLocation", str(tmp_path / "cp")).start()
        end = time.time() + 60
        while (len(seen) < n or len(lost) < reports) and time.time() < end and q.isActive:
            time.sleep(0.1)
        q.stop()
        made, seen[:] = list(seen), []
        return made

    try:
        assert run("a", [("x", 2, [2]), ("x", 0, [0]), ("y", 1, [1]), ("x", None, [9])], 1) == [("x", 0, [0], False)]
        # a new query goes on from the checkpoint; 0 has passed
        assert run("b", [("x", 1, [1]), ("x", 4, [4]), ("x", 0, [7])], 2) == [("x", 1, [1], False), ("x", 2, [2], False)]
        assert run("c", [("z", 0, None)], 1, 2) == [("z", 0, None, False)]
        assert {("x", 3, None, True), ("y", 0, None, True)} <= set(lost) and len(set(lost)) == len(lost)
        assert run("d", [("x", 3, [3])], 2) == [("x", 3, [3], False), ("x", 4, [4], False)]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
