"""Bytes, words and variable-length bit codes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_values(data: Column) -> Column:
    """Array of a binary's bytes, 0 to 255."""
    chars = F.split(F.decode(data, "ISO-8859-1"), "")
    return F.when(F.octet_length(data) > 0, F.transform(chars, lambda c: F.ascii(c))).when(
        data.isNotNull(), F.array().cast("array<int>")
    )


def floor_log2(n: Column) -> Column:
    """Whole part of the binary logarithm of a positive integer; 0 for 0."""
    return F.length(F.bin(n)) - 1


def elias_gamma(n: Column) -> Column:
    """Bit string: "0" for 0, else k ones, a zero and the k binary digits of n."""
    k = F.length(F.bin(n))
    return F.when(n == 0, F.lit("0")).otherwise(F.concat(F.repeat(F.lit("1"), k), F.lit("0"), F.bin(n)))


def elias_gamma_width(n: Column) -> Column:
    return F.when(n == 0, F.lit(1)).otherwise(1 + 2 * F.length(F.bin(n)))


def elias_gamma_decode(code: Column) -> Column:
    """Value of one code at the start of a bit string."""
    k = F.length(F.regexp_extract(code, "^(1*)", 1))
    digits = F.substring(code, k + 2, k)
    return F.when(k == 0, F.lit(0).cast("long")).otherwise(F.conv(digits, 2, 10).cast("long"))


def unary(n: Column) -> Column:
    """n - 1 ones and a zero, for n of 1 or more."""
    return F.concat(F.repeat(F.lit("1"), (n - 1).cast("int")), F.lit("0"))


def unary_decode(code: Column) -> Column:
    return F.length(F.regexp_extract(code, "^(1*)", 1)) + 1


def pack_bits(codes: Column) -> Column:
    """Binary of an array of bit strings, joined and padded with zeros to whole bytes."""
    joined = F.array_join(codes, "")
    bytes_ = F.ceil(F.length(joined) / 8).cast("int")
    padded = F.rpad(joined, (bytes_ * 8).cast("int"), "0")
    hex_ = F.transform(
        F.sequence(F.lit(0), bytes_ - 1), lambda i: F.lpad(F.conv(F.substring(padded, i * 8 + 1, 8), 2, 16), 2, "0")
    )
    return F.when(bytes_ > 0, F.unhex(F.array_join(hex_, ""))).otherwise(F.unhex(F.lit("")))


def u64_bytes(n: Column) -> Column:
    """Eight little-endian bytes."""
    h = F.lpad(F.hex(n), 16, "0")
    return F.unhex(F.concat(*[F.substring(h, 15 - 2 * i, 2) for i in range(8)]))


def u64_of_bytes(data: Column) -> Column:
    """Inverse of ``u64_bytes`` for values below 2^63."""
    h = F.hex(data)
    return F.conv(F.concat(*[F.substring(h, 15 - 2 * i, 2) for i in range(8)]), 16, 10).cast("long")


def words_bytes(words: Column) -> Column:
    """Big-endian bytes of an array of 32-bit words."""
    return F.unhex(F.array_join(F.transform(words, lambda w: F.lpad(F.hex(w), 8, "0")), ""))


def bytes_words(data: Column) -> Column:
    """32-bit words of big-endian bytes; an incomplete last word is dropped."""
    n = F.floor(F.octet_length(data) / 4).cast("int")
    h = F.hex(data)
    return F.when(n > 0, F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.substring(h, i * 8 + 1, 8), 16, 10).cast("long")
    )).otherwise(F.array().cast("array<bigint>"))


def token_xor(data: Column, key: Column) -> Column:
    """Bytes of a long, little-endian, XORed with a repeating key; its own inverse. Not for secrecy."""
    d, k = byte_values(data), byte_values(key)
    out = F.transform(d, lambda x, i: x.bitwiseXOR(F.element_at(k, (i % F.size(k) + 1).cast("int"))))
    return F.unhex(F.array_join(F.transform(out, lambda v: F.lpad(F.hex(v), 2, "0")), ""))


def parse_size(text: Column) -> Column:
    """Bytes of "<number>(b|kb|mb|gb)"; 0 for anything else."""
    unit = F.regexp_extract(text, r"^(\d+)(b|kb|mb|gb)$", 2)
    n = F.coalesce(F.regexp_extract(text, r"^(\d+)(b|kb|mb|gb)$", 1).try_cast("long"), F.lit(0).cast("long"))
    scale = F.when(unit == "kb", 10).when(unit == "mb", 20).when(unit == "gb", 30).otherwise(0)
    return F.when(unit == "", F.lit(0).cast("long")).otherwise(n * F.pow(F.lit(2), scale).cast("long"))


def params_bytes(params: Column) -> Column:
    """Map of strings as bytes: count, then length, key, length, value of each entry in order of keys; 64-bit lengths."""
    entries = F.sort_array(F.map_entries(params))

    def sized(s: Column) -> Column:
        return F.concat(F.lpad(F.hex(F.octet_length(s).cast("long")), 16, "0"), F.hex(F.encode(s, "UTF-8")))

    body = F.transform(entries, lambda e: F.concat(sized(e["key"]), sized(e["value"])))
    return F.unhex(F.concat(F.lpad(F.hex(F.size(entries).cast("long")), 16, "0"), F.array_join(body, "")))


def params_of_bytes(data: Column) -> Column:
    """Map of strings that ``params_bytes`` has packed."""
    h = F.hex(data)
    number = lambda at: F.conv(F.substring(h, at, F.lit(16)), 16, 10).cast("int")
    text = lambda at, n: F.decode(F.unhex(F.substring(h, at, n * 2)), "UTF-8")
    empty = F.array().cast("array<struct<key:string,value:string>>")

    def step(acc: Column, _: Column) -> Column:
        k_at = acc["at"] + 16
        v_at = k_at + number(acc["at"]) * 2 + 16
        k_len, v_len = number(acc["at"]), number(v_at - 16)
        pair = F.struct(text(k_at, k_len).alias("key"), text(v_at, v_len).alias("value"))
        return F.struct((v_at + v_len * 2).alias("at"), F.array_append(acc["out"], pair).alias("out"))

    n = number(F.lit(1))
    turns = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    done = F.aggregate(turns, F.struct(F.lit(17).alias("at"), empty.alias("out")), step)
    return F.when(data.isNotNull(), F.map_from_entries(done["out"]))


def lock_name(path: Column, width: int = 512) -> Column:
    """Name of the lock of a path: its SHA-2 digest of ``width`` bits in hex."""
    return F.sha2(path.cast("binary"), width)


def require(condition: Column, message: str) -> Column:
    """True, or an error where the condition isn't."""
    return F.when(condition, F.lit(True)).otherwise(F.raise_error(F.lit(f"internal error: {message}")).cast("boolean"))
