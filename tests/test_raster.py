"""Golden vectors, round trips, and plans."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenframe.functions import identify, output, raster
from lumenframe.functions.geometry import Blur, Crop, Geometry, GeometryError, ResizeTarget, Unsharp, parsed
from lumenframe.operators import kernels
from lumenframe.plans import pipeline
from lumenframe.sources import codecs, names, png
from lumenframe.sources.image import eight, widened

#: Source size, geometry and the size that must come of them (golden
#: vectors that FIXTURES.md section 2 lists with their source).
GOLDEN_SIZES = [
    ("800x600", "100x100", "100x75"),
    ("100x75", "800x800", "800x600"),
    ("600x800", "100x100", "75x100"),
    ("800x800", "100x100", "100x100"),
    ("64x100", "200", "200x313"),
    ("64x100", "x200", "128x200"),
    ("100x100", "120x120<", "120x120"),
    ("100x100", "50x50<", "100x100"),
    ("120x120", "100x100>", "100x100"),
    ("50x50", "100x100>", "50x50"),
    ("100x50", "50x50>", "50x25"),
    ("50x100", "50x50>", "25x50"),
    ("800x600", "50%", "400x300"),
    ("800x600", "x50%", "800x300"),
    ("1000x1000", "4.5%", "45x45"),
    ("1000x1000", "4x30%", "40x300"),
    ("100x100", "900@", "30x30"),
    ("100x100", "900@<", "100x100"),
    ("100x100", "900@>", "30x30"),
    ("200x150", "100^", "133x100"),
    ("150x200", "100^", "100x133"),
    ("50x25", "100^", "200x100"),
    ("25x50", "-5", "25x50"),
    ("25x50", "x-5!", "25x50"),
    ("25x50", "100x-5", "100x200"),
    ("25x50", "100x-5!", "100x50"),
    ("25x50", "-50%", "25x50"),
]
#: The same from the sizing rules, worked out by hand.
OWN_SIZES = [
    ("640x480", "320", "320x240"),
    ("640x480", "x120", "160x120"),
    ("640x480", "320x120", "160x120"),
    ("640x480", "50x50!", "50x50"),
    ("640x480", "50x!", "50x480"),
    ("640x480", "25%", "160x120"),
    ("3x3", "1x9", "1x1"),
    ("1000x10", "50x50", "50x1"),
    ("640x480", "1000x1000>", "640x480"),
    ("640x480", "320x240<", "640x480"),
    ("640x480", "64x64^", "85x64"),
    ("100x400", "10000@", "50x200"),
]


def test_golden_sizes(spark):
    pair = lambda s: tuple(map(int, s.split("x")))
    for old, geom, new in GOLDEN_SIZES + OWN_SIZES:
        w, h = pair(old)
        made = spark.range(1).select(*[c.alias(n) for c, n in zip(ResizeTarget.parse(geom).size(F.lit(w), F.lit(h)), "wh")]).first()
        assert tuple(made) == pair(new), (old, geom)


def test_geometry_grammar(spark):
    assert Geometry.parse("5x10+15+20") == Geometry(5, 10, 15, 20)
    assert Geometry.parse("5x+15+20") == Geometry(5, None, 15, 20) and Geometry.parse("-15+20") == Geometry(None, None, -15, 20)
    bad = ["", "5+15+20", "abc", "é", "1x2x3", "5x5 "]
    for text in bad:
        with pytest.raises(GeometryError):
            Geometry.parse(text)
    rows = spark.createDataFrame([(t,) for t in [*bad, "40!x50", "5."]], "s string").select("s", parsed(F.col("s"))["error"].alias("e")).collect()
    assert [r.e for r in rows] == [True] * len(bad) + [False, False]
    assert ResizeTarget.parse("!40!x!50!") == ResizeTarget("exact", 40, 50) and ResizeTarget.parse("200x500@").width == 200
    assert ResizeTarget.parse("%") == ResizeTarget.parse("^") == ResizeTarget.parse("-50+50") == ResizeTarget()
    assert Blur.parse("5") == Blur(1.2) and Blur.parse("x1337") == Blur(1337) and Unsharp.parse("42x2.1+7+11") == Unsharp(42, 2.1, 7, 11)
    assert Unsharp.parse("42+7+11") == Unsharp(42, 0, 7, 11) and Crop.parse_on_load("1x2+3+4") == Crop(1, 2, 3, 4)


@given(st.integers(0, 10**6), st.integers(0, 10**6), st.integers(-99, 99), st.integers(-99, 99))
@settings(deadline=None, max_examples=50)
def test_geometry_round_trip(w, h, x, y):
    assert Geometry.parse(f"{w}x{h}{x:+d}{y:+d}") == Geometry(w, h, x, y)


def test_templates():
    assert identify.tokens("%wx%h") == [("var", "w"), ("text", "x"), ("var", "h")]
    assert identify.tokens(r"%%\%\n10%x10") == [("text", "%%\n10%x10")]
    for bad in ("%a", "\\", "x%"):
        with pytest.raises(identify.TemplateError):
            identify.tokens(bad)


def test_names(spark):
    here = {"file.png": False, "d[1x1]": True, "d": False}.get
    got = names.input_name("jpg:file.png[1x2+3+4]", here)
    assert (got.location, got.format, got.modifier) == ("file.png", "jpeg", Crop(1, 2, 3, 4))
    assert names.input_name("d[1x1]", here).location == "d"
    assert all(names.input_name(n, here).location == "-" for n in ("", "-", "png:", "png:-", "[1x1]", "png:-[1x1]"))
    assert names.bracketed("abc[d[e]f]") == ("abc[d", "e]f") and names.bracketed("abc[def]ghi") is None and names.bracketed("abc]") is None
    assert names.output_name("png:-", lambda p: False) == ("-", "png") and names.output_name("png:-", lambda p: True)[1] is None
    cases = {"filename.txt": "filename-1.txt", "archive.tar.gz": "archive.tar-1.gz", "nodotfile": "nodotfile-1", "a/b/.hidd.en": "a/b/.hidd-1.en"}
    rows = spark.createDataFrame(list(cases.items()), "p string, want string").select("want", output.suffixed(F.col("p"), F.lit(1)).alias("got")).collect()
    assert all(r.got == r.want for r in rows)


def pictures():
    """Noise, and a smooth picture with few colours, in all channel counts and depths."""
    rng = np.random.default_rng(1)
    y, x = np.mgrid[0:13, 0:18]
    for c in (1, 2, 3, 4):
        for bits in (8, 16):
            yield rng.integers(0, 1 << bits, (5, 7, c)), bits
            yield np.stack([(x * (k + 1) + y) % 9 * 20 * (257 if bits == 16 else 1) for k in range(c)], axis=2), bits


def test_codecs_round_trip():
    for px, bits in pictures():
        c = px.shape[2]
        for f in (*png.FILTERS, "adaptive"):
            d = codecs.decode(codecs.encode("png", px, bits, codecs.Settings(6, f, None, b"MM", b"icc")))[1]
            assert (d.pixels == px).all() and (d.bits, d.exif, d.icc) == (bits, b"MM", b"icc")
        name, d = codecs.decode(codecs.encode("tiff", px, bits, codecs.Settings(icc=b"profile")))
        assert name == "tiff" and (d.pixels == px).all() and (d.bits, d.icc) == (bits, b"profile")
        if c in (1, 3):
            assert (codecs.decode(codecs.encode("pnm", px, bits))[1].pixels == px).all()
        wide = widened(px, bits)
        assert (codecs.decode(codecs.encode("ff", px, bits))[1].pixels == wide).all()
        full = eight(px, bits)
        for name in ("qoi", "tga", "ico", "bmp", "pcx", "webp"):
            got = codecs.decode(codecs.encode(name, px, bits, codecs.Settings(quality=100.0)))
            assert got[0] == name
            want = full if got[1].pixels.shape[2] == 4 else full[..., :1] if got[1].pixels.shape[2] == 1 else full[..., :3]
            assert (got[1].pixels == want).all(), (name, px.shape, bits)
        got = codecs.decode(codecs.encode("gif", px, bits))[1].pixels
        shown = full[..., 3] >= 128
        assert (got[..., 3] == 255 * shown).all() and (got[shown][:, :3] == full[shown][:, :3]).all()
        if c in (1, 3):
            soft = codecs.decode(codecs.encode("jpeg", px, bits, codecs.Settings(quality=100.0, exif=b"MM", icc=b"p")))[1]
            assert (soft.exif, soft.icc) == (b"MM", b"p") and np.abs(soft.pixels - (px if bits == 8 else (px + 128) // 257)).max() <= 3


def test_webp_of_other_writers():
    """Parts of the format that our writer doesn't use, put together by hand."""
    from lumenframe.sources import webp

    def file(*pairs, cells):
        out = webp.Writer()
        out.put(*pairs)
        cells(out)
        body = b"\x2f" + out.bytes()
        chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) % 2)
        return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk

    single = lambda s: ((1, 1), (0, 1), (1, 1), (s, 8))
    size = lambda w, h: ((w - 1, 14), (h - 1, 14), (0, 1), (0, 3))

    # Two colours packed eight to a cell: 0b00010110 of ten cells in a row, then 0b10.
    def indexed(out):
        table = np.array([[[255, 10, 20, 30], [0, 5, 6, 7]]])  # the second is a difference
        out.put((0, 1))
        out.cells(table)
        out.put((0, 1), (0, 1), (0, 1))
        out.cells(np.array([[[255, 0, 0b00010110, 0], [255, 0, 0b10, 0]]]))

    got = webp.decode(file(*size(10, 1), (1, 1), (3, 2), (1, 8), cells=indexed)).pixels[0]
    one, two = [10, 20, 30], [15, 26, 37]
    assert got.tolist() == [two if b == "1" else one for b in "0110100001"]

    # A literal, then a copy of five cells at distance 1: length prefix 4 with one extra bit 0 is 5.
    def copied(out):
        out.put((0, 1), (0, 1))
        lengths = [1 if s in (9, 256 + 4) else 0 for s in range(280)]
        out.put((0, 1), (15, 4), *[(4 if s < 16 else 0, 3) for s in webp.LENGTH_ORDER], (0, 1))
        four = webp.canonical([4] * 16)
        out.put(*[(four[n], 4) for n in lengths])
        out.put(*single(8), *single(7), *single(255), *single(1))
        out.put((0, 1), (1, 1), (0, 1))  # green 9; the copy, no extra bit set; distance code 2 is the left cell

    assert webp.decode(file(*size(6, 1), (0, 1), cells=copied)).pixels.tolist() == [[[8, 9, 7]] * 6]

    # Every prediction mode undoes what it did, cell by cell.
    rng = np.random.default_rng(2)
    px = rng.integers(0, 256, (9, 8, 4))
    for mode in range(14):
        rows, rest = px.tolist(), np.zeros_like(px)
        for y in range(9):
            for x in range(8):
                right = rows[y - 1][x + 1] if x < 7 else rows[y][0]
                guess = [255, 0, 0, 0] if x == y == 0 else rows[0][x - 1] if y == 0 else rows[y - 1][0] if x == 0 else webp.predicted(mode, rows[y][x - 1], rows[y - 1][x], rows[y - 1][x - 1], right)
                rest[y, x] = (px[y, x] - guess) % 256
        assert (webp.unpredicted(rest.copy(), np.full((3, 2), mode), 2) == px).all(), mode


def test_gif_of_many_colors():
    y, x = np.mgrid[0:200, 0:300]
    px = np.stack([x * 255 // 299, y * 255 // 199, (x + y) % 256], axis=2)
    got = codecs.decode(codecs.encode("gif", px, 8))[1].pixels
    assert len(np.unique(got.reshape(-1, 4), axis=0)) <= 256 and np.abs(got[..., :3] - px).mean() < 25
    noise = np.random.default_rng(3).integers(0, 256, (90, 111, 1))  # fills the code table several times
    assert (codecs.decode(codecs.encode("gif", noise, 8))[1].pixels[..., :1] == noise).all()


def java_image(spark, data):
    """RGBA by the image library of the JVM, which shares no code with ours."""
    jvm = spark._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))
    if image is None:
        return None
    w, h = image.getWidth(), image.getHeight()
    if image.getRaster().getNumBands() == 1 and image.getColorModel().getNumComponents() == 1:  # its RGB would be made lighter
        return np.array([[image.getRaster().getSample(x, y, 0) for x in range(w)] for y in range(h)])[..., None]
    argb = np.array(list(image.getRGB(0, 0, w, h, None, 0, w)), np.int64).reshape(h, w) & 0xFFFFFFFF
    return np.stack([argb >> 16 & 255, argb >> 8 & 255, argb & 255, argb >> 24], axis=2)


def java_file(spark, px, name, interlaced=False):
    """A file that the JVM's library writes."""
    jvm, (h, w, _) = spark._jvm, px.shape
    image = jvm.java.awt.image.BufferedImage(w, h, 1)
    for y in range(h):
        for x in range(w):
            image.setRGB(x, y, int(px[y, x, 0] << 16 | px[y, x, 1] << 8 | px[y, x, 2]))
    out = jvm.java.io.ByteArrayOutputStream()
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName(name).next()
    how = writer.getDefaultWriteParam()
    if interlaced:
        how.setProgressiveMode(1)
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), how)
    stream.flush()
    return bytes(out.toByteArray())


def test_other_programs_read_our_files(spark):
    y, x = np.mgrid[0:19, 0:26]
    px = np.stack([(x * 9) % 256, (y * 13) % 256, (x + y) * 5 % 256], axis=2)
    for name in ("png", "bmp", "gif"):
        assert (java_image(spark, codecs.encode(name, px // 64 * 64, 8))[..., :3] == px // 64 * 64).all(), name
    tiff_seen = java_image(spark, codecs.encode("tiff", px, 8))
    assert tiff_seen is None or (tiff_seen[..., :3] == px).all()
    for data in (codecs.encode("jpeg", px, 8, codecs.Settings(quality=q)) for q in (30.0, 92.0, None)):
        assert np.abs(java_image(spark, data)[..., :3] - codecs.decode(data)[1].pixels).max() <= 6
    gray = codecs.encode("jpeg", px[..., :1], 8)
    assert np.abs(java_image(spark, gray)[..., :1] - codecs.decode(gray)[1].pixels).max() <= 4


def test_we_read_other_programs_files(spark):
    y, x = np.mgrid[0:21, 0:34]
    px = np.stack([128 + 100 * np.sin(x / 9), 128 + 90 * np.cos(y / 7), 5 * (x + y) % 256], axis=2).astype(np.int64)
    for name, interlaced in (("png", False), ("png", True), ("bmp", False), ("tiff", False)):
        assert (codecs.decode(java_file(spark, px, name, interlaced))[1].pixels[..., :3] == px).all(), name
    gif_data = java_file(spark, px // 64 * 64, "gif")
    assert (codecs.decode(gif_data)[1].pixels[..., :3] == java_image(spark, gif_data)[..., :3]).all()
    smooth = px.copy()
    smooth[..., 2] = 128 + 50 * np.sin((x + y) / 20)
    for progressive in (False, True):  # both have halved chroma planes
        data = java_file(spark, smooth, "jpeg", progressive)
        assert (b"\xff\xc2" in data) == progressive
        assert np.abs(codecs.decode(data)[1].pixels - java_image(spark, data)[..., :3]).mean() < 3
        rough = java_file(spark, px, "jpeg", progressive)
        assert np.abs(codecs.decode(rough)[1].pixels[..., 1] - java_image(spark, rough)[..., 1]).mean() < 8
    straight, waves = (codecs.decode(java_file(spark, px, "jpeg", p))[1].pixels for p in (False, True))
    assert (straight == waves).all()  # the same coefficients, sent in another order


def test_damaged_files_are_errors():
    px = np.arange(60).reshape(4, 5, 3)
    for name in ("png", "jpeg", "gif", "tiff", "qoi", "tga", "pcx", "ico", "webp"):
        data = codecs.encode(name, px, 8, codecs.Settings(quality=100.0))
        with pytest.raises(Exception):  # noqa: B017  each format has its own
            codecs.decode(data[: len(data) // 2], name)
    with pytest.raises(codecs.CodecError):
        codecs.decode(b"nothing known")
    codecs.register("own", lambda data: codecs.Decoded(np.zeros((1, 1, 1), np.int64), 8, "L8"))
    assert codecs.decode(b"x", "own")[1].color_type == "L8"
    del codecs.DECODERS["own"]


def test_kernels_keep_constants():
    flat = np.full((6, 9, 1), 77)
    for name in kernels.KERNELS:
        x, y = (kernels.resample_weights(old, new, name) for old, new in ((9, 4), (6, 13)))
        assert (kernels.separable(flat, x, y, 4, 13, 255) == 77).all(), name
    assert (kernels.resample_weights(8, 8, "Nearest")) == tuple((i, i, kernels.SCALE) for i in range(8))


@pytest.fixture(scope="module")
def sample_png(tmp_path_factory):
    path = tmp_path_factory.mktemp("img") / "sample.png"
    rng = np.random.default_rng(2)
    path.write_bytes(codecs.encode("png", rng.integers(0, 256, (12, 16, 3)), 8))
    return str(path)


def run(spark, argv, **more):
    return pipeline.execute(spark, pipeline.parse(argv), **more)


def test_command_lines(spark, sample_png, tmp_path):
    out = str(tmp_path / "o.png")
    assert pipeline.save(run(spark, [sample_png, "-resize", "5x5", out])) == [out]
    text = run(spark, [out, "-identify", "null:"]).texts[0].first().text
    assert " PNG 5x4 5x4+0+0 8-bit sRGB" in text
    three = run(spark, [sample_png, "-negate", sample_png, sample_png, "-combine", out])
    assert three.images.first().color_type == "Rgb8"
    assert run(spark, [sample_png, "-colorspace", "gray", "-combine", out]).images.first().color_type == "L8"
    assert run(spark, [sample_png] * 4 + ["-combine", out]).images.first().color_type == "Rgba8"
    with pytest.raises(Exception, match="more images than channels"):
        run(spark, [sample_png, sample_png, "+combine", "gray", out]).images.collect()
    copy = str(tmp_path / "c.png")
    pipeline.save(run(spark, [sample_png, "-write", copy, "-resize", "50%x50%", out]))
    sizes = [codecs.decode(open(p, "rb").read())[1].pixels.shape[:2] for p in (copy, out)]
    assert sizes == [(12, 16), (6, 8)]
    names_ = pipeline.save(run(spark, [sample_png, sample_png, str(tmp_path / "n.png")]))
    assert [n.rpartition("/")[2] for n in names_] == ["n-1.png", "n-2.png"]
    for bad in ([], ["-flip"], ["-combine", "x.png"], [sample_png, "-nope", "x.png"]):
        with pytest.raises(pipeline.UsageError):
            pipeline.parse(bad)


def test_formats_of_outputs(spark, sample_png, tmp_path, monkeypatch, capfdbinary):
    """Prefix, then extension, then the input's format; standard input and output."""
    import io
    import sys

    sniffed = lambda p: codecs.sniff(open(p, "rb").read())
    for target, want in (("noext", "png"), ("a.tif", "tiff"), ("a.gif", "gif"), ("a.jpg", "jpeg"), ("qoi:x.png", "qoi"), ("a.unknown", "png"), ("b.tga", "tga")):
        prefix, _, bare = target.rpartition(":")
        path = f"{prefix}{':' if prefix else ''}{tmp_path / bare}"
        assert pipeline.save(run(spark, [sample_png, path])) == [str(tmp_path / bare)]
        assert sniffed(tmp_path / bare) == want
    with pytest.raises(Exception, match="no encoder for"):
        pipeline.save(run(spark, ["null:", str(tmp_path / "none")]))
    with pytest.raises(Exception, match="no encoder for AVIF"):
        pipeline.save(run(spark, [sample_png, str(tmp_path / "a.avif")]))
    data = open(sample_png, "rb").read()

    class Stdin:
        buffer = io.BytesIO(data)

    monkeypatch.setattr(sys, "stdin", Stdin)
    assert pipeline.save(run(spark, ["-", "-negate", str(tmp_path / "in.png")])) == [str(tmp_path / "in.png")]
    assert (255 - codecs.decode(open(tmp_path / "in.png", "rb").read())[1].pixels == codecs.decode(data)[1].pixels).all()
    capfdbinary.readouterr()
    pipeline.save(run(spark, [sample_png, "-"]))
    assert (codecs.decode(capfdbinary.readouterr().out)[1].pixels == codecs.decode(data)[1].pixels).all()


def test_many_inputs_are_one_scan(spark, sample_png, tmp_path):
    odd = tmp_path / "odd [1] {x} é.png"
    odd.write_bytes(open(sample_png, "rb").read())
    result = run(spark, [sample_png, str(odd), sample_png, "-flip", str(tmp_path / "m.png")])
    assert result.images._jdf.queryExecution().optimizedPlan().toString().count("binaryFile") == 1
    rows = result.images.orderBy("seq").select("seq", "filename").collect()
    assert [(r.seq, r.filename) for r in rows] == [(0, sample_png), (1, str(odd)), (2, sample_png)]
    plan = result.outputs[0]._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan
    assert [n.rpartition("/")[2] for n in pipeline.save(result)] == ["m-1.png", "m-2.png", "m-3.png"]
    mixed = run(spark, [sample_png, "null:", f"{sample_png}[8x8]", str(tmp_path / "x.png")]).images.orderBy("seq").collect()
    assert [(r.seq, r.width, r.height) for r in mixed] == [(0, 16, 12), (1, 1, 1), (2, 8, 6)]


def test_numbers_and_names_of_options():
    assert [pipeline.number(t) for t in (" 75 ", "-1.5", ".5", "1e2", "+7.")] == [75, -1.5, 0.5, 100, 7]
    for bad in ("1_0", "", "x", "٣", "1 2"):
        with pytest.raises(pipeline.UsageError):
            pipeline.number(bad)
    assert "mean" in pipeline.GRAY_METHODS and "luminosity" not in pipeline.GRAY_METHODS
    crop = Crop.parse("2.5x3.5+0.5+2.5")
    assert (crop.width, crop.height, crop.x, crop.y) == (3, 4, 1, 3)


def exif_block(order, entries):
    body = len(entries).to_bytes(2, order)
    for tag, kind, n, value in entries:
        body += tag.to_bytes(2, order) + kind.to_bytes(2, order) + n.to_bytes(4, order) + value
    return (b"II*\0" if order == "little" else b"MM\0*") + (8).to_bytes(4, order) + body + b"\0\0\0\0"


def test_orientation_alone_is_reset(spark):
    """Other tags stay; a pattern like the tag inside a value isn't one."""
    rows, want = [], []
    for order in ("little", "big"):
        short = lambda v: v.to_bytes(2, order) + b"\0\0"
        trap = (0x0112).to_bytes(2, order) + (3).to_bytes(2, order)
        for o in (1, 6, 8, 9):
            entries = lambda v: exif_block(order, [(0x010F, 4, 1, trap), (0x0112, 3, 1, short(v)), (0x0128, 3, 1, short(2))])
            rows.append((len(rows), entries(o)))
            want.append((o if o <= 8 else 1, entries(o if o in (1, 9) else 1)))
        rows.append((len(rows), exif_block(order, [(0x0128, 3, 1, short(6))])))
        want.append((1, rows[-1][1]))
    for broken in (b"", b"MM", b"junk that is long enough to be read", None, b"MM\0*\xff\xff\xff\xff" + b"\0" * 30):
        rows.append((len(rows), broken))
        want.append((1, broken))
    df = spark.createDataFrame([(k, 0, "f", "L8", "png", 2, 1, "L8", e, None, [5, 9]) for k, e in rows], ", ".join(f"{c} {t}" for c, t in zip(raster.COLUMNS, ["long"] * 2 + ["string"] * 3 + ["long"] * 2 + ["string"] + ["binary"] * 2 + ["array<int>"], strict=True)))
    found = {r.image_id: r.o for r in df.select("image_id", raster.exif_orientation(F.col("exif")).alias("o")).collect()}
    turned = {r.image_id: r for r in raster.auto_orient(df).collect()}
    for (k, _), (o, block) in zip(rows, want):
        assert found[k] == o and (None if turned[k].exif is None else bytes(turned[k].exif)) == block
        assert (turned[k].width, turned[k].height) == ((1, 2) if o >= 5 else (2, 1))


def test_conversions(spark):
    rows = [(0, "La16", [65535, 65535, 129, 0]), (1, "Rgb8", [1, 2, 3, 4, 5, 6]), (2, "Rgba16", [257, 514, 771, 65535, 0, 0, 0, 65535]), (3, "Rgba8", [1, 2, 3, 255, 4, 5, 6, 255]), (4, "L16", [128, 129])]
    df = spark.createDataFrame([(k, 0, "f", t, "png", 2, 1, t, None, None, px) for k, t, px in rows], ", ".join(f"{c} {t}" for c, t in zip(raster.COLUMNS, ["long"] * 2 + ["string"] * 3 + ["long"] * 2 + ["string"] + ["binary"] * 2 + ["array<int>"], strict=True)))
    got = {r.image_id: (r.color_type, r.px) for r in raster.rgb8_maybe_alpha(df).collect()}
    assert got == {0: ("Rgba8", [255, 255, 255, 255, 1, 1, 1, 0]), 1: ("Rgb8", [1, 2, 3, 4, 5, 6]), 2: ("Rgb8", [1, 2, 3, 0, 0, 0]), 3: ("Rgba8", rows[3][2]), 4: ("Rgb8", [0, 0, 0, 1, 1, 1])}
    back = {r.image_id: (r.color_type, r.px) for r in raster.converted(df, F.lit("La8")).collect()}
    assert back[1] == ("La8", [1, 255, 4, 255]) and back[0] == ("La8", [255, 255, 1, 0])
    assert {r.color_type for r in raster.converted(df, F.lit("Rgba16")).collect()} == {"Rgba16"}


def test_diffusion_by_definition():
    from lumenframe.operators import monochrome

    rng, f = np.random.default_rng(4), np.float32
    tile = rng.integers(0, 256, (16, 16)).astype(np.uint8)
    for h, w in ((9, 21), (1, 5), (6, 1), (20, 20)):
        luma = rng.integers(0, 256, (h, w))
        errors, want = np.zeros((h + 1, w + 2), f), np.zeros((h, w), int)
        for y in range(h):
            for x in range(w):
                own = f(luma[y, x])
                now = own + errors[y, x + 1]
                jitter = (f(tile[y % 16, x % 16]) / f(255) - f(0.5)) * f(100)
                new = f(255) if now > f(127.5) + jitter * (f(1) - min(f(1), abs(own - f(127.5)) / f(127.5))) else f(0)
                want[y, x] = new
                rest = now - new
                errors[y, x + 2] += rest * f(0.5)
                errors[y + 1, x] += rest * f(0.25)
                errors[y + 1, x + 1] += rest * f(0.25)
        assert (monochrome.diffuse(luma, tile) == want).all()


def test_noise_tile_is_blue():
    from lumenframe.operators import monochrome

    tile = monochrome.noise_tile(64)
    assert (np.bincount(tile.ravel(), minlength=256) == 16).all()
    power = np.abs(np.fft.fft2(tile - tile.mean()))
    far = np.hypot(*np.meshgrid(np.fft.fftfreq(64), np.fft.fftfreq(64)))
    assert power[(far > 0) & (far < 0.1)].mean() < 0.1 * power[far > 0.3].mean()


def test_resampling_by_definition():
    """Blocks of weights against one sum a cell, in 8 and 16 bits."""
    rng = np.random.default_rng(6)
    for bits, (h, w, c), (nh, nw), name in ((8, (70, 90, 3), (33, 41), "Lanczos3"), (16, (50, 37, 4), (80, 66), "MitchellNetravalli"), (8, (65, 33, 1), (65, 1), "Box")):
        px, top = rng.integers(0, 1 << bits, (h, w, c)), (1 << bits) - 1
        x, y = kernels.resample_weights(w, nw, name), kernels.resample_weights(h, nh, name)
        rows, out = np.zeros((h, nw, c), np.int64), np.zeros((nh, nw, c), np.int64)
        for i, s, weight in x:
            rows[:, i] += weight * px[:, s]
        rows = kernels.shifted(rows, top)
        for i, s, weight in y:
            out[i] += weight * rows[s]
        assert (kernels.separable(px, x, y, nw, nh, top) == kernels.shifted(out, top)).all()


def test_rewrites_change_nothing(spark, sample_png):
    argv = [sample_png, "-flip", "-flip", "-negate", "-crop", "5x5+1+2", "-resize", "100%", "-flop", "x.png"]
    plan = pipeline.parse(argv)
    assert len(pipeline.optimised(plan.steps)) < len(plan.steps)
    a, b = (pipeline.execute(spark, plan, rewrite=r).images.first() for r in (True, False))
    assert (a.px, a.width, a.height) == (b.px, b.width, b.height)


def test_stream_of_files(spark, sample_png, tmp_path):
    import os

    from lumenframe.streaming.images import run_once, stream_files

    seen = []
    run_once(stream_files(spark, os.path.dirname(sample_png)), lambda df, k: seen.append(df.count()), str(tmp_path / "c")).awaitTermination()
    assert sum(seen) == 1


def test_identify_needs_no_pixels(spark):
    emb = spark.createDataFrame([(1, [0.1] * 64, 1)], "vec_id long, embedding array<float>, label int")
    plan = raster.from_embeddings(emb).select(identify.text().alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "transform" not in plan
