"""Streams that go on after failures, and the controller over epochs out of order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeworks.operators import control
from cladeworks.streaming import controller_stream, sinks

EPOCHS = "run bigint, epoch bigint, train_loss double, val_loss double, mrr double"


@pytest.fixture()
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", controller_stream.STORE)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def history(spark, runs=3, epochs=12):
    rng = np.random.default_rng(3)
    rows = [(r, e, float(1 / (e + 1)), float(1 / (e + 1) + rng.random() * 0.8), float(rng.random())) for r in range(runs) for e in range(epochs) if (r, e) != (1, 4)]
    rows[2] = (*rows[2][:2], None, *rows[2][3:])
    return spark.createDataFrame(rows, EPOCHS)


def pick(df):
    return sorted((r.run, r.epoch, r.phase, r.action, r.patience, r.rollbacks) for r in df.collect())


def test_epochs_out_of_order_equal_the_replay(rocks, tmp_path):
    """Epochs come backwards inside each batch and between batches, some of them twice, in batches of which one fails after it has written."""
    rows = history(rocks)
    timed = controller_stream.ended(controller_stream.timed_epochs(rows), "6 seconds")
    # the files are read in the order in which they are written
    for part in ("epoch in (5, 2, 3)", "epoch in (0, 1, 4, 6, 2)", "epoch in (9, 7)", "epoch in (8, 10, 7, 9)", "epoch = 11 or run is null"):
        timed.where(part).orderBy(F.desc("epoch")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    failing = {"left": 2}

    def start():
        stream = rocks.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = controller_stream.stream_controller(stream, lateness="6 seconds")

        def batch(frame, number):
            sinks.write_batch(frame, number, str(tmp_path / "out"))
            if number in (2, 5) and failing["left"]:
                failing["left"] -= 1
                raise RuntimeError("lost after the write")

        return out.writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()

    for _ in range(3):
        try:
            start().awaitTermination(120)
        except Exception as error:
            assert "lost after the write" in str(error)
    assert failing["left"] <= 1
    assert pick(sinks.read_batches(rocks, str(tmp_path / "out"), control.REPLAY)) == pick(control.controller_replay(rows))


def test_the_query_equals_the_replay(spark):
    from cladeworks.plans import control_plans, extra_plans

    small = "/root/testdata/sf0.001"
    assert pick(extra_plans.stream_controller(spark, small)) == pick(control_plans.controller_replay(spark, small))


def events(spark, path, *rows):
    spark.createDataFrame(rows, "kind string, n int").coalesce(1).write.mode("append").parquet(path)


def test_events_are_there_once_after_failures(spark, tmp_path):
    path, seen, broken = str(tmp_path / "in"), [], {"left": 2}
    for n in range(3):
        events(spark, path, ("a", n), ("b", 10 + n))

    def fails(rows, number):
        if broken["left"]:
            broken["left"] -= 1
            raise RuntimeError("handler is down")
        seen.extend((number, r.n) for r in rows.collect())

    others = []

    def start():
        stream = spark.readStream.schema("kind string, n int").option("maxFilesPerTrigger", 1).parquet(path)
        return sinks.run(stream, str(tmp_path / "out"), str(tmp_path / "cp"), handlers={"a": fails, "b": lambda rows, number: others.extend((number, r.n) for r in rows.collect())})

    for _ in range(2):  # the handler of a fails on the first batch, twice; b gets its rows all the same
        with pytest.raises(Exception, match="handler is down"):
            start().awaitTermination(120)
    start().awaitTermination(120)
    rows = sinks.read_batches(spark, str(tmp_path / "out"), "kind string, n int").collect()
    assert sorted((r.kind, r.n) for r in rows) == [("a", n) for n in range(3)] + [("b", 10 + n) for n in range(3)]
    assert sorted(seen) == [(n, x) for n, (x,) in enumerate(sorted((x,) for _, x in seen))] and len(seen) == 3
    assert len(others) == 5 and len(set(others)) == 3  # a repeat has the same number
    events(spark, path, ("a", 3))
    start().awaitTermination(120)
    assert sinks.read_batches(spark, str(tmp_path / "out"), "kind string, n int").count() == 7 and seen[-1] == (3, 3)


def test_idle_runs_give_their_state_up(rocks, tmp_path):
    rows = controller_stream.timed_epochs(history(rocks, 1, 4))
    late = rocks.createDataFrame([(2, 500, 0.1, 0.1, 0.1), (2, 900, 0.1, 0.1, 0.1)], EPOCHS)
    for frame in (rows, controller_stream.timed_epochs(late.where("epoch = 500")), controller_stream.timed_epochs(late.where("epoch = 900")), rows.withColumn("ts", F.timestamp_seconds(F.lit(2000)))):
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = rocks.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = controller_stream.stream_controller(stream, lateness="1 second", idle=60)
    sinks.run(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = pick(sinks.read_batches(rocks, str(tmp_path / "out"), control.REPLAY))
    assert [x[:2] for x in got if x[0] == 0] == [(0, e) for e in range(4)] and (2, 500) in [x[:2] for x in got]
