import numpy as np
import pytest

from blobloom.errors import InvalidInput
from blobloom.operators import codec, color, raster
from blobloom.sources import png


@pytest.mark.parametrize(
    ("pixel", "out"),
    [((255, 0, 0), (127, 1, 255)), ((0, 255, 0), (255, 0, 1)), ((0, 0, 255), (63, 255, 127)), ((10, 20, 30), (20, 20, 0)), ((200, 100, 50), (176, 106, 153))],
)
def test_ycocg(spark, pixel, out):
    df = spark.createDataFrame([pixel], "c0 int, c1 int, c2 int")
    there = color.transform(df, "ycocg")
    assert tuple(there.first()) == out
    assert tuple(color.transform(there, "rgb").first()) == pixel
    assert tuple(color.transform(color.transform(df, "ycocg", None), "rgb", None).first()) == pixel


def test_undefined_colour(spark):
    with pytest.raises(InvalidInput):
        color.transform(spark.createDataFrame([(1, 2, 3)], "c0 int, c1 int, c2 int"), "ycbcr")


def image(color_type, depth, w, h, seed=0):
    n = png.CHANNELS[color_type]
    v = np.random.default_rng(seed).integers(0, 1 << depth, (n, h, w))
    v[:, :, w // 2 :] = v[:, :, :1]  # something to predict
    palette = bytes(range(3 * (1 << depth))) if color_type == 3 else b""
    return png.Image(w, h, depth, color_type, 0, n, palette, v)


CASES = [(0, 8), (2, 8), (6, 8), (3, 4), (4, 8), (0, 1), (0, 2), (0, 16), (2, 16), (6, 16)]


@pytest.mark.parametrize(("color_type", "depth"), CASES)
def test_png_round_trip(color_type, depth):
    a = image(color_type, depth, 13, 7)
    b = png.decode(png.encode(a))
    assert (a.planes == b.planes).all() and a[:7] == b[:7]


@pytest.mark.parametrize(("color_type", "depth"), CASES)
def test_raster_codec_inverts(color_type, depth):
    a = image(color_type, depth, 21, 9)
    c = codec.resolve("raster")
    e = c.encode(png.encode(a), None, {"chunk_width": "8", "chunk_height": "4"})
    back = png.decode(c.decode(e.data, e.header, 0, None))
    assert (back.planes == a.planes).all() and back[:7] == a[:7]


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("chunk", [(8, 4), (64, 64), (5, 16)])
def test_raster_codec_of_many_images(order, chunk):
    """Images coded in step have the words of each coded alone, whatever their sizes and kinds; and come back."""
    from blobloom.operators import kernels

    r = np.random.default_rng(7)
    images = [image(*CASES[k % len(CASES)], int(r.integers(1, 40)), int(r.integers(1, 70)), k) for k in range(40)]
    c = codec.resolve("raster")
    params = {"chunk_width": str(chunk[0]), "chunk_height": str(chunk[1]), "locality_context_order": str(order)}
    files = [png.encode(i) for i in images]
    coded = list(c.encode_many(iter(files), None, params))
    for i, e in zip(images, coded, strict=True):
        words = kernels.rans_encode(*raster.precode(i, *chunk, order, 32)[1:])
        assert e.data == words.astype(">u4").tobytes()
    assert list(c.decode_many([e.data for e in coded], [e.header for e in coded])) == files


def test_row_filters_and_interlace():
    """All five row filters and the seven passes, built by hand."""
    import zlib

    rng = np.random.default_rng(5)
    v = rng.integers(0, 256, (11, 10)).astype(np.uint8)

    def filtered(rows):
        out, before = b"", np.zeros(rows.shape[1], int)
        for y, row in enumerate(rows.astype(int)):
            left = np.concatenate([[0], row[:-1]])
            diag = np.concatenate([[0], before[:-1]])
            kind = y % 5
            if kind == 4:
                p = left + before - diag
                d = [abs(p - left), abs(p - before), abs(p - diag)]
                pred = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], before, diag))
            else:
                pred = [0 * row, left, before, (left + before) // 2][kind]
            out += bytes([kind]) + ((row - pred) % 256).astype(np.uint8).tobytes()
            before = row
        return out

    def build(raw, interlace):
        def piece(kind, body):
            return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")

        head = (10).to_bytes(4, "big") + (11).to_bytes(4, "big") + bytes([8, 0, 0, 0, interlace])
        return png.SIGNATURE + piece(b"IHDR", head) + piece(b"IDAT", zlib.compress(raw)) + piece(b"IEND", b"")

    assert (png.decode(build(filtered(v), 0)).planes[0] == v).all()
    raw = b"".join(filtered(v[y::dy, x::dx]) for x, y, dx, dy in png.PASSES if v[y::dy, x::dx].size)
    assert (png.decode(build(raw, 1)).planes[0] == v).all()


def test_bad_png():
    for data in (b"", b"not a png", png.SIGNATURE, png.encode(image(0, 8, 4, 4))[:-30]):
        with pytest.raises(InvalidInput):
            png.decode(data)


def test_pixel_source(spark):
    a = image(2, 8, 5, 4)
    files = spark.createDataFrame([("/x.png", bytearray(png.encode(a)))], "path string, content binary")
    rows = png.read_pixels(files, ["path"]).collect()
    got = np.zeros((3, 4, 5), int)
    for r in rows:
        got[r.ch, r.y, r.x] = r.v
    assert (got == a.planes).all() and len(rows) == 60


def test_palette_is_not_filtered():
    a = image(3, 4, 6, 6)
    assert (raster.prepare(a) == a.planes).all()


def test_png_files_through_engine(spark, tmp_path):
    from blobloom.plans.engine import Engine

    a = image(2, 8, 70, 66)  # more than one chunk each way
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(png.encode(a))
    files = png.read_files(spark, str(tmp_path / "in")).selectExpr("'/img/a.png' path", "content")
    e = Engine(spark)
    e.encode(files, str(tmp_path / "arc"), "raster")
    back = e.decode_files(str(tmp_path / "arc"), files.select("path")).first()
    assert (png.decode(bytes(back.content)).planes == a.planes).all()


def test_static_precode(spark):
    """Instructions under an injected model against plain loops, with deep samples and both orders."""
    from pyspark.sql import functions as F

    from blobloom.operators import kernels, models

    r = np.random.default_rng(4)
    planes = {(i, c): r.integers(0, 9, (5, 7)) for i in range(2) for c in range(2)}
    rows = [(i, c, y, x, int(v[y, x]), int(v[y, x] * 3 % 5)) for (i, c), v in planes.items() for y in range(5) for x in range(7)]
    p = spark.createDataFrame(rows, "img int, ch int, y int, x int, v int, r int")
    low = models.inject_order0(p.groupBy("ch", F.col("r").alias("next")).agg(F.count(F.lit(1)).alias("cnt")))
    for order in (1, 2):
        counts, zero = {}, {c: np.zeros(256, np.int64) for c in range(2)}
        context = lambda v, y, x: v[y, x - 1] if x else v[y - 1, x] if y and order > 1 else None  # noqa: E731, B023
        for (i, c), v in planes.items():
            for y in range(5):
                for x in range(7):
                    zero[c][v[y, x] * 3 % 5] += 1
                    k = context(v, y, x)
                    if k is not None:
                        counts.setdefault((c, k), np.zeros(256, np.int64))[v[y, x]] += 1
        table = {k: kernels.frequency_table(n) for k, n in counts.items()}
        flat = {c: kernels.frequency_table(n) for c, n in zero.items()}
        model = models.inject(models.locality_counts(p, ["img"], order))
        for q in models.static_precode(p, model, ["img"], order, low).collect():
            v, k = planes[q.img, q.ch], context(planes[q.img, q.ch], q.y, q.x)
            want = (1 << 16, q.v << 16) if k is None else (table[q.ch, k][q.v], table[q.ch, k][: q.v].sum())
            assert (q.ls, q.bs) == want and (q.r_ls, q.r_bs) == (flat[q.ch][q.r], flat[q.ch][: q.r].sum())
