import random

import numpy as np
from pyspark.sql import functions as F

from blobloom.operators import entropy, kernels, models, sequence


def blob_frame(spark, blobs):
    return spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(blobs)], "k int, data binary")


BLOBS = [b"banana", b"Some data to write to a file", b"\xff" * 20, bytes(i % 256 for i in range(600)), b"a"]


def test_chunk(spark):
    rows = sequence.chunk(blob_frame(spark, [b"abcdefg", b"", b"xyz"]), 3).orderBy("k", "seq").collect()
    assert [(r.k, r.seq, bytes(r.data)) for r in rows] == [(0, 0, b"abc"), (0, 1, b"def"), (0, 2, b"g"), (2, 0, b"xyz")]


def test_bwt_forms_agree(spark):
    df = blob_frame(spark, BLOBS)
    a = {r.k: (bytes(r.data), r.bw_index) for r in sequence.bwt(df).collect()}
    b = {r.k: (bytes(r.data), r.bw_index) for r in sequence.bwt_columns(df, ["k"]).collect()}
    assert a == b == {i: kernels.bwt(x) for i, x in enumerate(BLOBS)}


def test_inverse_of_both(spark):
    df = blob_frame(spark, BLOBS)
    t = sequence.bwt(df).withColumn("data", sequence.mtf_udf("data"))
    back = sequence.inverse_bwt(t.withColumn("data", sequence.unmtf_udf("data"))).collect()
    assert {r.k: bytes(r.data) for r in back} == dict(enumerate(BLOBS))


def test_mtf_closed_form(spark):
    r = random.Random(3)
    blobs = [bytes(r.randrange(n) for _ in range(120)) for n in (3, 20, 256)] + BLOBS
    got = sequence.mtf_columns(sequence.symbols(blob_frame(spark, blobs), ["k"]), ["k"]).select("k", "pos", "rank").collect()
    out = {}
    for x in got:
        out.setdefault(x["k"], {})[x["pos"]] = x["rank"]
    assert {k: bytes(v[i] for i in range(len(v))) for k, v in out.items()} == {i: kernels.mtf(b) for i, b in enumerate(blobs)}


def test_collect_symbols(spark):
    df = blob_frame(spark, BLOBS)
    got = sequence.collect_symbols(sequence.symbols(df, ["k"]), ["k"]).collect()
    assert {r.k: bytes(r.data) for r in got} == dict(enumerate(BLOBS))


def test_delta_wraps(spark):
    v = [2147483647, -2147483648, 5, 5, -1]
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(v)], "k int, i int, v int")
    d = df.select("k", "i", sequence.delta(["k"], ["i"], "v").alias("d"))
    assert [r.d for r in d.orderBy("i").collect()] == [2147483647, 1, -2147483643, 0, -6]
    back = d.select("i", sequence.undelta(["k"], ["i"], "d").alias("v"))
    assert [r.v for r in back.orderBy("i").collect()] == v


def test_zigzag_vector(spark):
    g = spark.createDataFrame([(0, 4, 3), (1, 1, 1), (2, 1, 5), (3, 17, 32), (4, 32, 17), (5, 0, 3)], "k int, w int, h int")
    rows = sequence.zigzag(g, ["k"]).collect()
    want = [(0, 0), (1, 0), (0, 1), (0, 2), (1, 1), (2, 0), (3, 0), (2, 1), (1, 2), (2, 2), (3, 1), (3, 2)]
    assert [(r.x, r.y) for r in sorted((r for r in rows if r.k == 0), key=lambda r: r["at"])] == want
    for k, w, h in ((3, 17, 32), (4, 32, 17)):
        cells = [(r.x, r.y) for r in sorted((r for r in rows if r.k == k), key=lambda r: r["at"])]
        assert cells == sorted(((x, y) for x in range(w) for y in range(h)), key=lambda c: (sum(c), c[1] if sum(c) % 2 else c[0]))
        assert sorted(r["at"] for r in rows if r.k == k) == list(range(w * h))


def test_training_merges(spark):
    df = blob_frame(spark, [b"\x61\x6e\x00\x63\x02\x00"])
    cells = models.train(models.pairs(sequence.symbols(df, ["k"]), ["k"]), ["k"])
    twice = models.merge(cells, cells, keys=["k"])
    assert {r.cnt for r in cells.collect()} == {32} and {r.cnt for r in twice.collect()} == {64}
    full = models.dense(twice, ["k"], 2)
    assert {r.cnt for r in full.collect()} == {66, 2}
    n = models.normalise(models.dense(cells, ["k"]), ["k", "prev"]).filter("prev = 97 and next = 110").first()
    assert (n.ls, n.bs) == (1922361, 6408025)
    back = models.inverse_lookup(spark.createDataFrame([(0, 97, 6408025), (0, 97, 6408024), (0, 97, 0)], "k int, prev int, point long"), models.normalise(models.dense(cells, ["k"]), ["k", "prev"]), ["k", "prev"])
    assert {r.point: r.next for r in back.collect()} == {6408025: 110, 6408024: 109, 0: 0}


def test_paeth_columns(spark):
    p = [[10, 12, 15], [11, 13, 16], [9, 14, 20]]
    df = spark.createDataFrame([(0, x, y, v) for y, row in enumerate(p) for x, v in enumerate(row)], "k int, x int, y int, v int")
    got = models.paeth_residual(df, ["k"]).orderBy("y", "x").collect()
    assert [r.residual for r in got] == [10, 2, 3, 1, 1, 1, 254, 3, 4]
    pred = models.paeth_predict(df, ["k"]).orderBy("y", "x").collect()
    assert [r.predicted for r in pred][:4] == [0, 10, 12, 10]


def test_first_order_update(spark):
    cells = spark.createDataFrame([(0, 1, 2, 32), (0, 3, 4, 64)], "k int, prev int, next int, cnt long")
    ch = spark.createDataFrame([(0, 1, 2, 32)], "k int, prev int, next int, delta long")
    assert [tuple(r) for r in models.update(cells, ["k"], ch, "revert").collect()] == [(0, 3, 4, 64)]
    assert sorted(r.cnt for r in models.update(cells, ["k"], ch.withColumn("delta", F.lit(9).cast("long")), "set").collect()) == [9, 64]


def test_rans_forms_agree(spark):
    rows = [(0, [(65536, 7 << 16), (58255, 0), (1922362, 3786575)]), (1, [(65536, 0)] * 300), (2, [])]
    df = spark.createDataFrame(rows, "k int, i array<struct<ls: bigint, bs: bigint>>")
    got = df.select("k", entropy.encode(F.col("i")).alias("a"), entropy.encode_udf(F.col("i.ls"), F.col("i.bs")).alias("b")).collect()
    for r in got:
        assert r.a == r.b == kernels.rans_encode(*(np.array([x[c] for x in rows[r.k][1]], np.int64) for c in (0, 1))).tolist()


def test_first_order_instructions(spark):
    df = blob_frame(spark, BLOBS)
    syms = sequence.symbols(df.withColumn("data", sequence.mtf_udf("data")), ["k"])
    model = models.normalise(models.dense(models.train(models.pairs(syms, ["k"]), ["k"]), ["k"]), ["k", "prev"])
    got = {r.k: r.w for r in entropy.instructions(syms, model, ["k"], ["k"]).select("k", entropy.encode(F.col("seq")).alias("w")).collect()}
    for i, b in enumerate(BLOBS):
        s = kernels.mtf(b)
        assert got[i] == kernels.rans_encode(*kernels.order1_instructions(s, kernels.bigrams(s))).tolist()


def test_bwt_columns_without_shuffle(spark):
    """Suffixes are ordered where their block lies: a row a suffix would be the block's square on disk."""
    df = blob_frame(spark, BLOBS)
    out = sequence.bwt_columns(df, ["k"])
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.k: (bytes(r.data), r.bw_index) for r in out.collect()} == {i: kernels.bwt(b) for i, b in enumerate(BLOBS) if b}


def test_blocks_are_coded_in_slices(spark, monkeypatch):
    """Blocks have the words of each coded alone, under the table of their whole blob; blobs are coded some at a time, null and empty ones not at all."""
    rng = np.random.default_rng(1)
    blobs = [rng.integers(0, 1 + i % 256, i * 7 % 1500).astype(np.uint8).tobytes() for i in range(300)]
    df = spark.createDataFrame([*enumerate(map(bytearray, blobs)), (999, None)], "k int, data binary").coalesce(1)
    monkeypatch.setattr(entropy, "SLICE", 10_000)
    out = entropy.encode_blocks(df, ["k"], "data", 256)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.k, r.seq): r.w for r in out.collect()}
    want = {}
    for i, b in enumerate(blobs):
        s = np.frombuffer(b, np.uint8)
        f = kernels.frequency_table(np.bincount(s, minlength=256))
        c = np.cumsum(f) - f
        for q in range(0, len(s), 256):
            want[i, q // 256] = kernels.rans_encode(f[s[q : q + 256]], c[s[q : q + 256]]).tolist()
    assert got == want


def rasters(spark):
    """Texts as rasters of 32 samples a row, by windows over pixels and by arrays."""
    from blobloom.functions import bits

    blobs = [bytes(np.random.default_rng(k).integers(0, 256, n).tolist()) for k, n in enumerate((0, 1, 31, 32, 33, 64, 100, 777))]
    df = spark.createDataFrame([*enumerate(map(bytearray, blobs)), (99, None)], "k int, data binary")
    syms = sequence.symbols(df, ["k"])
    plain = syms.select("k", (F.col("pos") % 32).alias("x"), F.floor(F.col("pos") / 32).cast("int").alias("y"), F.col("sym").alias("v"))
    return plain, models.raster_of_arrays(df, ["k"], bits.byte_values(F.col("data")), 32)


def same_rows(a, b, *columns):
    assert "Exchange" not in b._jdf.queryExecution().executedPlan().toString()
    a, b = (sorted(tuple(r) for r in d.select("k", "x", "y", *columns).collect()) for d in (a, b))
    assert len(a) == 1038 and a == b


def test_residuals_without_shuffle(spark):
    plain, arrays = rasters(spark)
    same_rows(models.paeth_residual(plain, ["k"]), models.paeth_residual(arrays, ["k"]), "residual")


def test_predictions_without_shuffle(spark):
    plain, arrays = rasters(spark)
    same_rows(models.paeth_predict(plain, ["k"]), models.paeth_predict(arrays, ["k"]), "predicted")


def test_static_instructions_without_windows(spark):
    plain, arrays = rasters(spark)
    for order in (1, 2):
        model = models.inject(models.locality_counts(plain.withColumn("ch", F.lit(0)), ["k"], order)).cache()
        a, b = (models.static_precode(p.withColumn("ch", F.lit(0)), model, ["k"], order) for p in (plain, arrays))
        assert "Window" not in models.static_precode(arrays.withColumn("ch", F.lit(0)), spark.createDataFrame([], model.schema), ["k"], order)._jdf.queryExecution().executedPlan().toString()
        a, b = (sorted(tuple(r) for r in d.select("k", "x", "y", "ls", "bs").collect()) for d in (a, b))
        assert len(a) == 1038 and a == b
