"""Per-blob kernels for what is inherently sequential, on numpy arrays.

They run inside Arrow batches, one blob at a time; nothing here touches Spark.
"""

from __future__ import annotations

import numpy as np

ALPHABET = 256
SCALE = 24
TOTAL = 1 << SCALE
LOW = 1 << 31
WORD = (1 << 32) - 1


#: Symbols that the first sort of suffixes compares at once, nine bits each: zero stands behind the end.
FIRST = 7


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Start of each suffix of ``s`` in order, by prefix doubling from the first seven symbols."""
    n = len(s)
    v = np.concatenate([s.astype(np.int64) + 1, np.zeros(FIRST, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(FIRST):
        key = key << 9 | v[k : k + n]
    k = FIRST
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]])[:n])
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        second = np.full(n, -1, np.int64)
        second[: max(0, n - k)] = rank[k:]
        key = rank * (n + 1) + second + 1
        k *= 2


def bwt(data: bytes) -> tuple[bytes, int]:
    """Last column of the sorted rotations of data and a sentinel, without the sentinel, and the sentinel's place."""
    s = np.frombuffer(data, np.uint8)
    if not len(s):
        return b"", 0
    order = suffix_order(s)
    at = int(np.flatnonzero(order == 0)[0])
    rest = np.delete(order, at)
    return bytes([s[-1]]) + s[rest - 1].tobytes(), at + 1


def unbwt(last: bytes, index: int) -> bytes:
    n = len(last)
    if not n:
        return b""
    col = np.empty(n + 1, np.int64)
    body = np.frombuffer(last, np.uint8).astype(np.int64) + 1
    col[:index], col[index], col[index + 1 :] = body[:index], 0, body[index:]
    step = np.argsort(col, kind="stable")  # row of the rotation that starts one later
    # follow all rows by pointer doubling: position k of the text is k steps from the sentinel's row
    seq = np.array([index], np.int64)
    jump = step.copy()
    while len(seq) < n:
        seq = np.concatenate([seq, jump[seq]])
        jump = jump[jump]
    first = np.sort(col)
    return (first[seq[:n]] - 1).astype(np.uint8).tobytes()


def mtf(data: bytes) -> bytes:
    """Ranks of symbols, most recent first; within a run they are zeros and need no work."""
    s = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    table = bytearray(range(ALPHABET))
    heads = bytearray(len(at))
    for i, c in enumerate(s[at].tobytes()):
        k = table.index(c)
        heads[i] = k
        if k:
            del table[k]
            table.insert(0, c)
    out = np.zeros(len(s), np.uint8)
    out[at] = np.frombuffer(bytes(heads), np.uint8)
    return out.tobytes()


def unmtf(data: bytes) -> bytes:
    s = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(np.concatenate([[True], s[1:] != 0])) if len(s) else np.zeros(0, np.int64)
    table = bytearray(range(ALPHABET))
    heads = bytearray(len(at))
    for i, k in enumerate(s[at].tobytes()):
        c = table[k]
        heads[i] = c
        if k:
            del table[k]
            table.insert(0, c)
    return np.repeat(np.frombuffer(bytes(heads), np.uint8), np.diff(np.append(at, len(s)))).tobytes()


def bigrams(symbols: bytes, step: int = 32) -> np.ndarray:
    """256 x 256 counts of first-order contexts: one, and ``step`` for each pair of neighbours."""
    out = np.ones(ALPHABET * ALPHABET, np.int64)
    s = np.frombuffer(symbols, np.uint8).astype(np.int64)
    if len(s) > 1:
        out += step * np.bincount(s[:-1] * ALPHABET + s[1:], minlength=ALPHABET * ALPHABET)
    return out.reshape(ALPHABET, ALPHABET)


def _leftover(v: np.ndarray) -> np.ndarray:
    rest = TOTAL - v.sum(axis=-1, keepdims=True)
    return v + rest // ALPHABET + (np.arange(ALPHABET) < rest % ALPHABET)


def normalise(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to sum to 2^24 with no zero, and their exclusive running sums."""
    total = np.maximum(counts.sum(axis=-1, keepdims=True), 1)
    f = _leftover(1 + counts * (TOTAL - ALPHABET) // total)
    return f, np.cumsum(f, axis=-1) - f


def frequency_table(counts: np.ndarray) -> np.ndarray:
    """As ``normalise``, of counts plus one."""
    total = ALPHABET + counts.sum(axis=-1, keepdims=True)
    return _leftover(1 + (counts + 1) * (TOTAL - ALPHABET) // total)


def rans_encode(ls: np.ndarray, bs: np.ndarray) -> np.ndarray:
    """Words of a sequence of (frequency, cumulative frequency); coded from the end."""
    x = LOW
    words = []
    push = words.append
    for f, c in zip(reversed(ls.tolist()), reversed(bs.tolist()), strict=True):
        if x >= f << 39:
            push(x & WORD)
            x >>= 32
        x = (x // f << SCALE) + c + x % f
    push(x >> 32)
    push(x & WORD)
    return np.array(words[::-1], np.uint32)


def rans_encode_many(ls: list[np.ndarray], bs: list[np.ndarray]) -> list[np.ndarray]:
    """``rans_encode`` of several sequences in step: one vector operation codes a symbol of each."""
    n = np.array([len(x) for x in ls], np.int64)
    longest = int(n.max(initial=0))
    f, c = np.ones((longest, len(ls)), np.uint64), np.zeros((longest, len(ls)), np.uint64)
    for k, (a, b) in enumerate(zip(ls, bs, strict=True)):
        f[: len(a), k], c[: len(b), k] = a, b
    x = np.full(len(ls), LOW, np.uint64)
    words, used = np.zeros((len(ls), longest + 2), np.uint32), np.zeros(len(ls), np.int64)
    for t in range(longest - 1, -1, -1):
        on = n > t
        full = np.flatnonzero(on & (x >= f[t] << np.uint64(39)))
        words[full, used[full]] = x[full] & np.uint64(WORD)
        used[full] += 1
        x[full] >>= np.uint64(32)
        x = np.where(on, (x // f[t] << np.uint64(SCALE)) + c[t] + x % f[t], x)
    at = np.arange(len(ls))
    words[at, used], words[at, used + 1] = x >> np.uint64(32), x & np.uint64(WORD)
    return [words[k, : used[k] + 2][::-1] for k in range(len(ls))]


def order1_instructions(symbols: bytes, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frequency, cumulative) of each symbol after the one before it, under dense ``counts``; the first is uniform.

    Only contexts that occur are normalised.
    """
    s = np.frombuffer(symbols, np.uint8).astype(np.int64)
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ls, bs = np.empty(len(s), np.int64), np.empty(len(s), np.int64)
    ls[0], bs[0] = 1 << 16, s[0] << 16
    contexts = np.flatnonzero(np.bincount(s[:-1], minlength=ALPHABET))
    row = np.zeros(ALPHABET, np.int64)
    row[contexts] = np.arange(len(contexts))
    f, c = normalise(counts[contexts])
    ls[1:], bs[1:] = f[row[s[:-1]], s[1:]], c[row[s[:-1]], s[1:]]
    return ls, bs


def order1_decode(words: np.ndarray, n: int, counts: np.ndarray) -> bytes:
    if not n:
        return b""
    from bisect import bisect_right

    w = words.tolist()
    x, at = w[0] + (w[1] << 32), 2
    mask = TOTAL - 1
    rows: list = [None] * ALPHABET
    out = bytearray(n)
    prev = -1
    for i in range(n):
        low = x & mask
        if prev < 0:
            s, fs, cs = low >> 16, 1 << 16, low >> 16 << 16
        else:
            row = rows[prev]
            if row is None:
                f, c = normalise(counts[prev])
                row = rows[prev] = (c.tolist(), f.tolist())
            s = bisect_right(row[0], low) - 1
            fs, cs = row[1][s], row[0][s]
        x = fs * (x >> SCALE) + low - cs
        if x < LOW:
            x = (x << 32) + w[at]
            at += 1
        out[i] = s
        prev = s
    return bytes(out)


def paeth_residual(plane: np.ndarray, bits: int) -> np.ndarray:
    """Residual of the absolute-difference predictor (left, up, upper left) of a plane."""
    v = plane.astype(np.int64)
    pred = np.zeros_like(v)
    pred[0, 1:] = v[0, :-1]
    pred[1:, 0] = v[:-1, 0]
    a, b, c = v[1:, :-1], v[:-1, 1:], v[:-1, :-1]
    pred[1:, 1:] = _nearest(a, b, c)
    return (v - pred) % (1 << bits)


def _nearest(a, b, c):
    d = np.abs(a + b - c)
    da, db, dc = np.abs(a - d), np.abs(b - d), np.abs(c - d)
    return np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))


def paeth_restore(residual: np.ndarray, bits: int) -> np.ndarray:
    """Inverse of ``paeth_residual``: anti-diagonals depend only on the two before them."""
    r = residual.astype(np.int64)
    h, w = r.shape
    v = np.zeros_like(r)
    mask = (1 << bits) - 1
    v[0] = np.cumsum(r[0]) & mask
    v[:, 0] = np.cumsum(r[:, 0]) & mask
    for s in range(2, h + w - 1):
        y = np.arange(max(1, s - w + 1), min(h - 1, s - 1) + 1)
        if not len(y):
            continue
        x = s - y
        v[y, x] = (r[y, x] + _nearest(v[y, x - 1], v[y - 1, x], v[y - 1, x - 1])) & mask
    return v


def precode_chunk(chunk: np.ndarray, order: int, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """(frequency, cumulative) of each byte of a chunk under adaptive local contexts, in raster order."""
    h, w = chunk.shape
    v = chunk.tolist()
    counts: dict[int, np.ndarray] = {}
    ls, bs = np.empty((h, w), np.int64), np.empty((h, w), np.int64)

    def of(context: int) -> np.ndarray:
        if context not in counts:
            counts[context] = np.zeros(ALPHABET, np.int64)
        return counts[context]

    for y in range(h):
        for x in range(w):
            s = v[y][x]
            context = v[y][x - 1] if x else v[y - 1][x] if y and order > 1 else -1
            if context < 0:
                ls[y, x], bs[y, x] = 1 << 16, s << 16
                continue
            row = of(context)
            f = frequency_table(row)
            ls[y, x], bs[y, x] = f[s], f[:s].sum()
            row[s] += rate
            if x and y:
                if order > 1:
                    of(v[y - 1][x])[s] += rate
                if order > 2:
                    of(v[y - 1][x - 1])[s] += rate >> 1
    return ls, bs


def precode_residual(chunk: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``precode_chunk``, for the low bytes of deep samples: one adaptive distribution a chunk."""
    counts = np.zeros(ALPHABET, np.int64)
    counts[0] = 1
    s = chunk.reshape(-1)
    ls, bs = np.empty(len(s), np.int64), np.empty(len(s), np.int64)
    for i, c in enumerate(s.tolist()):
        if i:
            f = frequency_table(counts)
            ls[i], bs[i] = f[c], f[:c].sum()
        else:
            ls[i], bs[i] = 1 << 16, c << 16
        counts[c] += 2 * rate
    return ls.reshape(chunk.shape), bs.reshape(chunk.shape)


class RansReader:
    """Decodes symbols one by one, each under the frequencies it is asked with."""

    def __init__(self, words: np.ndarray):
        self.w = words.tolist()
        self.x, self.at = self.w[0] + (self.w[1] << 32), 2

    def __call__(self, f: np.ndarray | None) -> int:
        low = self.x & (TOTAL - 1)
        if f is None:
            s, fs, cs = low >> 16, 1 << 16, low >> 16 << 16
        else:
            c = np.cumsum(f)
            s = int(np.searchsorted(c, low, side="right"))
            fs, cs = int(f[s]), int(c[s] - f[s])
        self.x = fs * (self.x >> SCALE) + low - cs
        if self.x < LOW:
            self.x = (self.x << 32) + self.w[self.at]
            self.at += 1
        return s
