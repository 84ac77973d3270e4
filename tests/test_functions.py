from pyspark.sql import functions as F
import pytest

from blobloom.errors import ValidationError
from blobloom.functions import bits, paths


def one(spark, value, schema, expr):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("path", "ok"),
    [("/a/b", True), ("/", True), ("/a/", True), ("a", False), ("/a b", False), ("/a//b", False), ("/a\\b", False), ("/a\0b", False), (None, False)],
)
def test_path_validity(spark, path, ok):
    assert one(spark, path, "v string", paths.is_valid) is ok
    if path is not None and not ok:
        with pytest.raises(ValidationError):
            paths.require_valid(path)


def test_path_parts(spark):
    r = spark.sql("select '/a//b/c/' v").select(paths.parts(F.col("v")), paths.normal(F.col("v")), paths.ancestors(F.col("v")), paths.parent(F.col("v")), paths.leaf(F.col("v"))).first()
    assert list(r) == [["a", "b", "c"], "/a/b/c", ["/", "/a", "/a/b", "/a/b/c"], "/a/b", "c"]
    assert paths.normal_of("//a/") == "/a"


@pytest.mark.parametrize(("n", "value", "width"), [(0, 0, 1), (1, 5, 3), (2, 26, 5), (3, 27, 5), (5, 117, 7), (8, 488, 9)])
def test_elias_gamma(spark, n, value, width):
    df = spark.createDataFrame([(n,)], "v long").withColumn("c", bits.elias_gamma(F.col("v")))
    r = df.select("c", bits.elias_gamma_width(F.col("v")), bits.elias_gamma_decode(F.col("c"))).first()
    assert (int(r[0], 2), len(r[0]), r[1], r[2]) == (value, width, width, n)


def test_bytes(spark):
    data = bytes(range(256)) + b"\r\n"
    assert one(spark, bytearray(data), "v binary", bits.byte_values) == list(data)
    assert one(spark, bytearray(b""), "v binary", bits.byte_values) == []
    assert one(spark, None, "v binary", bits.byte_values) is None
    assert bytes(one(spark, 7, "v long", bits.u64_bytes)) == (7).to_bytes(8, "little")
    assert bytes(one(spark, [1, 0xFFFFFFFF], "v array<bigint>", bits.words_bytes)) == bytes.fromhex("00000001ffffffff")
    assert one(spark, bytearray(bytes.fromhex("00000001ffffffff0a")), "v binary", bits.bytes_words) == [1, 0xFFFFFFFF]
    assert bytes(one(spark, ["101", "0", "111111"], "v array<string>", bits.pack_bits)) == bytes([0b10101111, 0b11000000])
    key = F.lit(b"abc")
    assert bytes(one(spark, bytearray(data), "v binary", lambda c: bits.token_xor(bits.token_xor(c, key), key))) == data


@pytest.mark.parametrize(("text", "n"), [("3b", 3), ("2kb", 2048), ("1mb", 1 << 20), ("5gb", 5 << 30), ("7tb", 0), ("x", 0), ("kb", 0)])
def test_size_strings(spark, text, n):
    assert one(spark, text, "v string", bits.parse_size) == n


def test_log_and_unary(spark):
    assert [one(spark, n, "v long", bits.floor_log2) for n in (0, 1, 2, 255, 256)] == [0, 0, 1, 7, 8]
    assert one(spark, 4, "v long", bits.unary) == "1110"
    assert one(spark, 4, "v long", lambda c: bits.unary_decode(bits.unary(c))) == 4


def test_params_and_names(spark):
    import hashlib

    import pytest

    from blobloom.functions import bits
    from blobloom.operators import models

    rows = [(1, {}), (2, {"a": ""}), (3, {"chunk_width": "64", "é ü": "ß\n", "z": "1" * 300}), (4, None)]
    d = spark.createDataFrame(rows, "k int, m map<string,string>")
    got = {r.k: r.back for r in d.select("k", bits.params_of_bytes(bits.params_bytes(F.col("m"))).alias("back")).collect()}
    assert got == dict(rows)
    names = spark.createDataFrame([("/a/é",), ("/",)], "p string").select("p", bits.lock_name(F.col("p")).alias("n")).collect()
    assert all(r.n == hashlib.sha512(r.p.encode()).hexdigest() for r in names)
    assert d.filter(bits.require(F.col("k") > 0, "k")).count() == 4
    with pytest.raises(Exception, match="internal error: k is small"):
        d.select(bits.require(F.col("k") > 2, "k is small")).collect()
    assert spark.range(1).select(models.initial(5).alias("x")).first().x == [1] * 5
