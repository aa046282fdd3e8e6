"""Plot data, images and strings by small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewise.functions import arrays, strings
from gatewise.operators import images, plotdata
from gatewise.operators.catalog import Graph, Population
from gatewise.operators.gates import Region
from gatewise.operators.populations import Objects


def test_right_closed_bins(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.1, 1.0, 1.5, 2.0, 10.0, 10.1, -0.1, float("nan"), None)], "v double")
    got = [r[0] for r in df.select(plotdata.right_closed(F.col("v"), 0.0, 10.0, 10)).collect()]
    assert got == [1, 1, 1, 2, 2, 10, None, None, None, None]


def test_heights_and_smoothing():
    counts = [1, 3, 6]
    assert plotdata.heights(counts, 0, 3, "percent") == [10.0, 30.0, 60.0]
    assert plotdata.heights(counts, 0, 3, "density") == pytest.approx([0.1, 0.3, 0.6]) and plotdata.heights(counts, 0, 3, "mids") == [0.5, 1.5, 2.5]
    wide = plotdata.smoothed([0] * 20 + [100] + [0] * 20, 0, 41, 5)
    assert wide.argmax() == 20 and wide.sum() <= 101
    assert wide.sum() == pytest.approx(100) and plotdata.smoothed([0] * 60 + [5, 9, 7] + [0] * 60, 0, 123).sum() == pytest.approx(21)
    top = plotdata.smoothed([0, 0, 3, 8, 2, 0], 0, 6, scale="most", most=8.0)
    assert top.max() == 8.0 and top[[0, 1, 5]].tolist() == [0, 0, 0] and plotdata.smoothed([0, 0], 0, 2, scale="most").tolist() == [0, 0]
    assert plotdata.height_range(counts, 0, 3) == (0.0, 6.0) and plotdata.height_range([0, 0], 0, 2) == (0.0, 0.0)


def test_viewports(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(11)], "object_number long, a double")
    o = Objects.of(df).add_regions(Region("r", "line", (-10.0, float("inf")))).add_pops(Population("P", region="r", fx="a"))
    g = Graph("histogram", "a", regions=("r",), limits=(2.0, 5.0, 0.0, 1.0))
    rows = plotdata.plot_rows(o, g)
    assert plotdata.viewport(rows, g)["x"] == pytest.approx((-0.7, 10.7))
    assert plotdata.viewport(rows, g, "max", [o.catalog.regions["r"]])["x"] == pytest.approx((-11.4, 11.4))
    assert plotdata.viewport(rows, g, "given")["x"] == (2.0, 5.0)
    assert plotdata.viewport(rows.limit(0), Graph("histogram", "a"))["x"] == (-1.0, 1.0)
    nodes, edges = plotdata.network(o)
    assert nodes.count() == 2 and edges.collect() == [("All", "P")]
    assert plotdata.sibling_graph(o, "P").regions == ("r",) and plotdata.auto_graph(o, ["P"]).f1 == "a"
    assert plotdata.grid(5, 2) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]


def test_density_image(spark):
    df = spark.createDataFrame([(5.0, 5.0)] * 50 + [(1.0, 1.0)], "x double, y double")
    at = plotdata.CoordMap((0.0, 10.0), (0.0, 10.0), 20, 20)
    image = plotdata.density_image(plotdata.pixel_bins(df, F.col("x"), F.col("y"), at), at, levels=64)
    assert image.shape == (21, 21) and np.unravel_index(image.argmax(), image.shape) == (10, 10) and image.max() == 63
    assert plotdata.gaussian(5, 1).sum() == pytest.approx(1)


RNG = np.random.default_rng(0)
IMAGE = RNG.integers(-300, 5000, (7, 10))


@pytest.mark.parametrize("image", [IMAGE, np.zeros((1, 1), int), np.array([[2**30, -(2**30)]]), np.arange(12).reshape(3, 4)])
def test_difference_codec(image):
    assert np.array_equal(images.delta_decode(images.delta_encode(image), *image.shape), image)


def test_codecs_by_hand():
    # first row 1, 2; second 1, 1: differences 1, 1 / 0, -1 in one group each, low half first
    assert images.delta_decode(bytes([0x11, 0x70]), 2, 2).tolist() == [[1, 2], [1, 1]]
    assert images.run_decode(bytes([0, 1, 2, 0, 1, 2]), 2, 3).tolist() == [[0, 0, 2], [1, 1, 1]]
    assert images.run_decode(bytes([0, 1, 2, 0, 1, 2]), 2, 3, 5).tolist() == [[-1, -1, -1], [1, 1, 1]]
    assert images.plain_decode(bytes([255, 1]), 1, 2).tolist() == [[-1, 1]]
    assert images.plain_decode(bytes([0, 128, 1, 0]), 1, 2).tolist() == [[-32768, 1]]
    long_run = np.repeat([1, 0], [700, 5]).reshape(5, 141)
    assert np.array_equal(images.run_decode(images.run_encode(long_run), 5, 141), long_run)
    for bad in (lambda: images.run_decode(b"\0\1", 3, 3), lambda: images.delta_decode(b"\1", 5, 5), lambda: images.plain_decode(b"abc", 1, 2), lambda: images.decode(b"", 1, 1, 5)):
        with pytest.raises(ValueError):
            bad()


def test_affine_and_resize():
    a = np.arange(20.0).reshape(4, 5)
    same = np.array([[1, 0, 0], [0, 1, 0]])
    for order in (1, 2, 3):
        assert np.allclose(images.affine(a, same, order=order), a)
    assert np.array_equal(images.align(a, 1.0, 0.0, bg=-1.0)[:, :4], a[:, 1:]) and (images.align(a, 1.0, 0.0, bg=-1.0)[:, 4] == -1).all()
    assert np.allclose(images.align(a, 0.5, 0.0)[:, :4], a[:, :4] + 0.5)
    assert images.rescale(a, 2.0).shape == (8, 10) and images.rescale(a, 0.5, keep_size=True).shape == a.shape
    assert images.resize(a, 2, 3).tolist() == [[6, 7, 8], [11, 12, 13]]
    assert images.resize(a, 6, 8, 9.0)[1:5, 1:6].tolist() == a.tolist() and images.resize(a, 6, 8, 9.0)[0, 0] == 9
    assert images.resize(a, 3, 4, front=True)[0, 0] == 6 and images.resize(a, 3, 4)[0, 0] == 0


def test_array_columns_match_kernels(spark):
    a = IMAGE.astype(float)
    df = spark.createDataFrame([(a.ravel().tolist(), (IMAGE % 3).ravel().tolist())], "p array<double>, m array<int>")
    p = F.col("p")
    one = lambda c: np.array(df.select(c).first()[0])
    for h, w, front in ((3, 4, False), (3, 4, True), (9, 13, False), (9, 13, True), (4, 20, False), (0, 3, False)):
        assert np.array_equal(one(arrays.resized(p, 7, 10, h, w, 5.0, front)), images.resize(a, h, w, 5.0, front=front).ravel())
    assert np.allclose(one(arrays.normalized(p, 100.0, 3000.0, 0.7)), images.normalize(a, 100, 3000, 0.7).ravel())
    lo, hi = arrays.quantile_range(p, 0.1, 0.9)
    assert np.allclose(one(F.array(lo, hi)), np.quantile(a, [0.1, 0.9]))
    assert np.array_equal(one(arrays.cleansed(p, F.col("m"), 1.5)), images.cleanse(a, IMAGE % 3, 1.5).ravel())
    m = IMAGE % 3
    for kind, want in (("none", m * 0), ("clipped", m > 1), ("masked", m != 1), ("MC", m != 1)):
        assert np.array_equal(one(arrays.removal_mask(F.col("m"), kind, F.array("m"))), want.ravel())
    with pytest.raises(ValueError):
        arrays.composite([(0.5, p)])


def test_encoders_and_colours():
    unit = images.normalize(IMAGE.astype(float))
    assert images.bmp(unit)[:2] == b"BM" and len(images.bmp(unit)) == 54 + 7 * 32
    assert images.png(unit)[1:4] == b"PNG" and images.tiff(unit)[:4] == b"II*\0"
    rgb = images.hsv_to_rgb(unit, 1 / 3, 1.0)
    assert rgb.shape == (7, 10, 3) and np.allclose(rgb[..., 1], unit) and np.allclose(rgb[..., 0], 0)
    assert images.palette(np.array([[0.0, 1.0]]), np.eye(3)).tolist() == [[[1, 0, 0], [0, 0, 1]]]
    marked = images.mark(np.zeros((3, 3)), np.ones((2, 2)), np.ones((2, 2)), 2, 2)
    assert marked.sum() == 1


def test_tables_of_images(spark):
    df = spark.createDataFrame([(1, 2, 3, [1.0] * 6), (2, None, None, None)], "id int, height int, width int, pixels array<double>")
    got = {r["id"]: r for r in images.image_map(df, lambda a: images.resize(a, 4, 4), ["id"]).collect()}
    assert (got[1]["height"], got[1]["width"], sum(got[1]["pixels"])) == (4, 4, 6.0) and got[2]["pixels"] is None
    assert images.tensor(df.filter("id = 1"), "id", 2, 3).shape == (1, 2, 3)
    assert images.encoded(df, "png", ["id"]).filter("id = 1").first()["data"][1:4] == b"PNG"


def test_strings(spark):
    df = spark.createDataFrame([("/a/b.c/File.one.TXT", ["x", "A", "B", "A"], -65536)], "p string, t array<string>, c int")
    p, t = F.col("p"), F.col("t")
    one = lambda c: df.select(c).first()[0]
    assert one(strings.filled_template("%d|%p|%s|%e|%o.%c", p, F.lit(7), F.lit("Ch1"))) == "/a/b.c|b.c|File.one|txt|7.Ch1"
    assert one(strings.resized(F.lit("ab"), 5, "centre")) == " ab  " and one(strings.resized(F.lit("abcdef"), 3)) == "abc"
    assert one(strings.sequence_position(t, ["A", "B"])) == 2 and one(strings.sequence_replaced(t, ["A", "B"], ["C"])) == ["x", "C", "A"]
    assert one(strings.hex_color(F.col("c"))) == "#FF0000" and one(strings.color_number(F.lit("#FF0000"))) == -65536
    assert one(strings.escaped_xml(F.lit("<a & 'b'>"))) == "&lt;a &amp; &apos;b&apos;&gt;" and one(strings.contains_any(p, ["b.c", "zz"]))
    assert one(strings.fcs_name(F.lit("FL1 < CD4 >"))[1]) == "CD4" and one(strings.number_text(F.lit(float("nan")))) == "NaN"


def test_scale_bar_lies_inside_the_image():
    x = images.scale_bar(np.zeros((5, 8)), 3, 0.5, top=2, left=4)
    assert np.array_equal(np.argwhere(x == 0.5), [(i, j) for i in (2, 3) for j in (4, 5, 6)]) and x.sum() == 3.0
    assert images.scale_bar(np.zeros((3, 4)), 9, top=2, left=2).sum() == 2.0  # what lies outside is cut off
