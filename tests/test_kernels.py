"""Fixed vectors and round trips of the per-blob kernels."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blobloom.operators import kernels as K

TEXT = b"Some data to write to a file"


@pytest.mark.parametrize(
    ("data", "index", "last"),
    [(TEXT, 7, b"eoeaeao td lmt friottSwai   "), (b"\xff" * 20, 20, b"\xff" * 20), (b"banana", 4, b"annbaa"), (b"\xff" * 2000, 2000, b"\xff" * 2000)],
)
def test_bwt_vectors(data, index, last):
    assert K.bwt(data) == (last, index)


@pytest.mark.parametrize(
    ("data", "out"),
    [
        (TEXT, [101, 111, 1, 99, 1, 1, 2, 35, 116, 103, 2, 110, 111, 4, 3, 106, 115, 110, 8, 5, 0, 93, 119, 11, 5, 8, 0, 0]),
        (b"\xff" * 20, [255] + [0] * 19),
        (b"banana", [97, 110, 0, 99, 2, 0]),
    ],
)
def test_mtf_vectors(data, out):
    assert list(K.mtf(K.bwt(data)[0])) == out


@pytest.mark.parametrize(
    ("data", "words"),
    [
        (TEXT, [0x6E658DB9, 0x438B34E1, 0x6164FAD3, 0xEF1F1711]),
        (b"\xff" * 20, [0x03FFB616, 0x000C59C0]),
        (b"banana", [0x7E61B5A8, 0x0062E065]),
        (b"\xff" * 2000, [0x1BFFFF5C, 0x0031C434]),
    ],
)
def test_rans_vectors(data, words):
    s = K.mtf(K.bwt(data)[0])
    got = K.rans_encode(*K.order1_instructions(s, K.bigrams(s)))
    assert got.tolist() == words


def test_ramp_vector():
    data = bytes(i % 256 for i in range(4096))
    last, index = K.bwt(data)
    s = K.mtf(last)
    assert index == 16
    assert len(K.rans_encode(*K.order1_instructions(s, K.bigrams(s)))) == 133


def code(data):
    last, index = K.bwt(data)
    s = K.mtf(last)
    n = K.bigrams(s)
    words = K.rans_encode(*K.order1_instructions(s, n))
    return K.unbwt(K.unmtf(K.order1_decode(words, len(s), n)), index)


@given(st.binary(max_size=300))
@settings(max_examples=60, deadline=None)
def test_round_trip(data):
    assert code(data) == data


def test_large_ramp_round_trip():
    data = bytes(i % 256 for i in range(1 << 18))
    assert code(data) == data


def test_model_vectors():
    m = K.bigrams(bytes([97, 110, 0, 99, 2, 0]))
    assert [int(m[p, n]) for p, n in ((97, 110), (110, 0), (0, 99), (99, 2), (2, 0))] == [33] * 5
    assert m.sum() == 65536 + 5 * 32
    f, c = K.normalise(m)
    assert (f.sum(axis=1) == 1 << 24).all()
    assert (f[97, 0], f[97, 110], f[97, 111], f[97, 255]) == (58255, 1922361, 58254, 58254)
    assert c[97, 110] == 6408025
    assert (f[5] == 65536).all() and c[5, 128] == 8388608


def test_frequency_table_vectors():
    z = np.zeros(256, np.int64)
    assert (K.frequency_table(z) == 65536).all()
    z[65] = 32
    f = K.frequency_table(z)
    assert (f[0], f[65], f[66]) == (58255, 1922362, 58255)


def test_paeth_vector_and_inverse():
    p = np.array([[10, 12, 15], [11, 13, 16], [9, 14, 20]])
    assert K.paeth_residual(p, 8).tolist() == [[10, 2, 3], [1, 1, 1], [254, 3, 4]]
    for bits, shape in ((8, (3, 3)), (8, (1, 40)), (8, (40, 1)), (16, (23, 31)), (4, (17, 5))):
        v = np.random.default_rng(1).integers(0, 1 << bits, shape)
        assert (K.paeth_restore(K.paeth_residual(v, bits), bits) == v).all()


def test_many_sequences_in_step():
    r = np.random.default_rng(2)
    ls, bs = [], []
    for n in (0, 1, 2, 50, 300):
        f = K.frequency_table(r.integers(0, 50, 256))
        s = r.integers(0, 256, n)
        ls.append(f[s])
        bs.append((np.cumsum(f) - f)[s])
    got = K.rans_encode_many(ls, bs)
    assert [g.tolist() for g in got] == [K.rans_encode(a, b).tolist() for a, b in zip(ls, bs)]
