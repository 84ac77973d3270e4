from pyspark.sql import functions as F

from blobloom.operators import codec
from blobloom.plans.engine import Engine
from blobloom.streaming import train

SCHEMA = "event_type string, data binary"


def parts(spark, folder, n=4):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_type", F.encode("props", "UTF-8").alias("data"))
    e.repartition(n).write.parquet(folder)
    return e


def table(df):
    return {tuple(r) for r in df.select("event_type", "prev", "next", "cnt").collect()}


def test_live_counts_equal_batch(spark, tmp_path):
    e = parts(spark, str(tmp_path / "in"))
    stream = train.live(train.records(spark, str(tmp_path / "in"), SCHEMA, 1), ["event_type"])
    q = stream.writeStream.format("memory").queryName("cells").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert table(spark.table("cells")) == table(train.live(e, ["event_type"]))


def test_folded_batches_are_idempotent(spark, tmp_path):
    e = parts(spark, str(tmp_path / "in"))
    store = train.CellStore(spark, str(tmp_path / "cells"), ["event_type"])
    train.into(train.records(spark, str(tmp_path / "in"), SCHEMA, 1), store, str(tmp_path / "ck")).awaitTermination()
    want = table(train.live(e, ["event_type"]))
    assert table(store.cells()) == want
    first = spark.read.parquet(str(tmp_path / "in")).limit(0)
    train.into(train.records(spark, str(tmp_path / "in"), SCHEMA, 1), store, str(tmp_path / "ck")).awaitTermination()  # nothing new
    assert table(store.cells()) == want
    assert first.count() == 0


def test_streamed_state_equals_a_session_s(spark, tmp_path):
    e = parts(spark, str(tmp_path / "in"))
    engine, at = Engine(spark), str(tmp_path / "a")
    files = e.withColumn("path", F.concat(F.lit("/"), F.monotonically_increasing_id().cast("string"))).withColumnRenamed("data", "content")
    engine.train(files, at, "/whole", "blocksort")
    a = engine.archives.provide(at)
    for _ in range(2):  # the second has nothing new
        train.into_state(train.records(spark, str(tmp_path / "in"), SCHEMA, 1), a, "/streamed", "blocksort", str(tmp_path / "ck")).awaitTermination()
        x, y = a.read_mstate("/whole").first(), a.read_mstate("/streamed").first()
        assert x.batches == y.batches == e.filter("data <> X''").count() and y.last_batch == 3
        assert (codec.unpack_cells(bytes(x.model)) == codec.unpack_cells(bytes(y.model))).all()
    # a batch that comes again changes nothing
    assert a.fold_training("/streamed", 1, [{"prev": 1, "next": 2, "cnt": 32}, {"prev": -1, "next": -1, "cnt": 1}], 3) is None
    engine.encode(files.select("path", "content").limit(20), at, "blocksort", mstate_addr="/streamed")
    back = {r.path: bytes(r.content) for r in engine.decode_files(at, files.select("path")).collect()}
    assert len(back) == 20
