"""Arrays, TIFF, analysis files with image rows, reports and keyword rules."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_masks import catalog
from test_ranged import RUN, written

from gatewise.operators import images
from gatewise.operators.catalog import Catalog, Feature, Population, ReportRow
from gatewise.operators.gates import Region
from gatewise.operators.populations import Objects
from gatewise.operators.stats import report
from gatewise.sources import container, daf, fcs_rules, files
from gatewise.sources.run import Run


def tiles(spark, n, channels, h=3, w=4):
    rng = np.random.default_rng(n)
    x = rng.integers(0, 4000, (n, h, w, channels)).astype(float)
    rows = [(7 * i + 1, c, h, w, x[i, :, :, c].ravel().tolist()) for i in range(n) for c in range(channels)]
    return x, spark.createDataFrame(rows, "object_id long, channel int, height int, width int, pixels array<double>").repartition(5)


def test_arrays_are_written_in_chunks(spark, tmp_path):
    x, df = tiles(spark, 23, 2)
    folder = str(tmp_path / "x.zarr")
    assert images.write_tensor(df, "object_id", 3, 4, folder, chunk_bytes=5 * 3 * 4 * 2 * 8) == (23, 3, 4, 2)
    assert sorted(p.name for p in (tmp_path / "x.zarr").iterdir() if not p.name.endswith("crc")) == [".zarray", "0.0.0.0", "1.0.0.0", "2.0.0.0", "3.0.0.0", "4.0.0.0"]
    assert np.array_equal(images.read_tensor(folder), x)
    assert np.array_equal(images.read_tensor(folder, 8, 13), x[8:13])
    about = json.loads((tmp_path / "x.zarr/.zarray").read_text())
    assert (about["shape"], about["chunks"], about["dtype"]) == ([23, 3, 4, 2], [5, 3, 4, 2], "<f8")
    one = images.write_tensor(df.filter("channel = 1"), "object_id", 3, 4, str(tmp_path / "one"), None, "<u2")
    assert one == (23, 3, 4, 1) and np.array_equal(images.read_tensor(str(tmp_path / "one"))[..., 0], x[..., 1])


def test_arrays_of_uneven_images(spark, tmp_path):
    _, df = tiles(spark, 4, 2)
    with pytest.raises(Exception, match="object 8: not 2 channels"):
        images.write_tensor(df.filter("object_id <> 8 or channel = 0"), "object_id", 3, 4, str(tmp_path / "a"))
    with pytest.raises(Exception, match="not 2 channels of 4 x 4"):
        images.write_tensor(df, "object_id", 4, 4, str(tmp_path / "b"))
    assert images.write_tensor(df.limit(0), "object_id", 3, 4, str(tmp_path / "c")) == (0, 3, 4, 1)
    assert images.read_tensor(str(tmp_path / "c")).shape == (0, 3, 4, 1)


@pytest.mark.parametrize("order", ["<", ">"])
def test_containers_as_tiff(spark, tmp_path, order):
    path, objects = written(tmp_path, 9)
    strips = container.read_strips(spark, path, 1)
    container.write_tiff(strips, str(tmp_path / "out"), 4, order).collect()
    again = container.read_strips(spark, str(tmp_path / "out/*.tif"), 1)
    got = images.decoded(again, ["object_id", "kind"]).collect() if order == "<" else None
    if got:
        assert {(r["object_id"], r["kind"]): r["pixels"] for r in got} == {(i, k): a.ravel().tolist() for i, x, m in objects for k, a in (("img", x), ("msk", m))}
    pages = []
    for p in sorted((tmp_path / "out").glob("*.tif")):
        data, before = p.read_bytes(), len(pages)
        for _, t, wrong in container.directories(data):
            assert wrong is None and t[258] == (16,) and t[259] == (1,)
            pages.append(np.frombuffer(data, order + "u2", t[257][0] * t[256][0], t[273][0]).reshape(t[257][0], t[256][0]))
        if order == "<":
            assert all(np.array_equal(a, b) for a, b in zip(images.tiff_read(data), pages[before:], strict=True))
    whole = [a for _, x, m in objects for a in (x, m)]
    assert len(pages) == 18 and all(any(np.array_equal(p, a) for a in whole) for p in pages)


def test_negative_pixels_wrap(spark):
    x = np.array([[-1, 5], [70000, -32768]])
    assert images.raw16(images.delta_encode(x), 2, 2, images.DELTA) == np.array([65535, 5, 4464, 32768], "<u2").tobytes()


@pytest.mark.parametrize("binary", [True, False])
def test_pairs_of_analysis_files_and_containers(spark, tmp_path, binary):
    for name, n in (("a.cif", 7), ("b.cif", 9)):
        written(tmp_path, n, name=name)
    dirs = container.read_directories(spark, str(tmp_path / "*.cif"))
    rows = container.image_rows(dirs)
    df = rows.select("import_file", F.col("id").alias("Object Number"), (F.col("id") * 2.0).alias("twice"))
    objects = Objects(df, Catalog().add_features(Feature("Object Number"), Feature("twice")), "Object Number", "import_file")
    made = daf.write_daf(objects, str(tmp_path / "out"), binary, images=rows).collect()
    assert {(r["file"], r["rows"]) for r in made} == {("a.daf", 7), ("b.daf", 9)}
    again = daf.read_images(spark, str(tmp_path / "out/*.daf"))
    stem = F.regexp_replace("import_file", r"\.\w+$", "")
    sums = lambda x: {tuple(r) for r in x.select(stem, "checksum").collect()}
    assert sums(daf.checksum(again)) == sums(container.checksum(dirs.filter("problem is null")))
    keep = ["id", "imgIFD", "mskIFD", "w", "l", "bgmean"]
    assert {str(tuple(r)) for r in again.select(stem, *keep).collect()} == {str(tuple(r)) for r in rows.select(stem, *keep).collect()}
    assert daf.read_daf(spark, str(tmp_path / "out/b.daf")).df.filter("twice = 16.0").count() == 1


def test_objects_with_images_from_one_call(spark, tmp_path):
    cat = catalog()
    rows = [(i, *(float(i * k % 11) for k in (1, 2, 3, 4)), 2, 3, [i, 1, 2, 3, 4, 5], [0, 1, 0, 1, 0, 2]) for i in range(30)]
    names = "`Object Number` long, Intensity_M01_Ch01 double, Intensity_M02_Ch02 double, bright double, `Spot Count_spots` double, height int, width int, pixels array<long>, mask array<long>"
    objects = Objects(spark.createDataFrame(rows, names).coalesce(1), cat, "Object Number")
    files.write(objects, str(tmp_path), "container", about=RUN).collect()
    back = files.read(spark, f"{tmp_path}/*.cif")
    assert back.catalog == cat and back.id_col == "object_number"
    got = {r["object_number"]: r for r in back.df.collect()}
    assert len(got) == 30 and all(got[i]["bright"] == rows[i][3] and (got[i]["w"], got[i]["l"]) == (3, 2) and got[i]["imgIFD"] < got[i]["mskIFD"] for i in range(30))
    assert sorted(r["object_number"] for r in back.objects_in("in").collect()) == [i for i in range(30) if 5 <= i * 2 % 11 <= 9]
    strips = container.read_strips(spark, f"{tmp_path}/*.cif", 1, back.objects_in("in").withColumnRenamed("object_number", "object_id").select("import_file", "object_id"), ("img",))
    assert sorted(r["pixels"][0] for r in images.decoded(strips, ["object_id"]).collect()) == [i for i in range(30) if 5 <= i * 2 % 11 <= 9]
    plain, _ = written(tmp_path, 3, name="z.rif", about=None)
    assert files.read(spark, plain).df.count() == 3


def test_reports_in_analysis_files(spark, tmp_path):
    from dataclasses import replace

    rows = (ReportRow("n", "Count", "in"), ReportRow("share", "%", "in", population2="All"), ReportRow("mean", "Mean", "in", "a"))
    cat = Catalog().add_features(Feature("Object Number"), Feature("a")).add_regions(Region("r", "line", (2.0, 5.0))).add_pops(Population("in", region="r", fx="a"))
    cat = replace(cat, reports=rows)
    objects = Objects(spark.createDataFrame([(i, float(i)) for i in range(8)], "`Object Number` long, a double").coalesce(1), cat, "Object Number")
    daf.write_daf(objects, str(tmp_path)).collect()
    path = next(str(p) for p in tmp_path.glob("*.daf"))
    assert daf.read_report(spark, path) == rows
    got = {r["name"]: r["value"] for r in report(daf.read_daf(spark, path)).collect()}
    assert got == {r["name"]: r["value"] for r in report(objects, rows).collect()} == {"n": 4.0, "share": 50.0, "mean": 3.5}
    renamed = cat.rename_pops({"in": "within"}).rename_features({"a": "b"})
    assert renamed.reports[1:] == (ReportRow("share", "%", "within", population2="All"), ReportRow("mean", "Mean", "within", "b"))
    template = tmp_path / "x.ast"
    template.write_text(daf.write_template(cat).replace("<Assay", "<AssayTemplate").replace("</Assay>", "</AssayTemplate>"))
    assert files.read(spark, str(template)).catalog == cat


GOOD = {"$VERSION": "FCS3.1", "$BEGINANALYSIS": "0", "$ENDANALYSIS": "0", "$BEGINSTEXT": "0", "$ENDSTEXT": "0", "$BEGINDATA": "256", "$ENDDATA": "511", "$BYTEORD": "1,2,3,4", "$DATATYPE": "F", "$MODE": "L", "$NEXTDATA": "0", "$PAR": "2", "$TOT": "4"} | {f"$P{i}{k}": v for i, n in ((1, "a"), (2, "b")) for k, v in {"N": n, "B": "32", "R": "9", "E": "0,0"}.items()}
V32 = {"$VERSION": "FCS3.2", "$CYT": "c"}
#: What is changed (None: left out), and the one problem that comes of it.
BROKEN = [
    *(({k: None}, (k, "missing")) for k in ("$BYTEORD", "$NEXTDATA", "$TOT", "$MODE", "$BEGINSTEXT", "$ENDANALYSIS", "$BEGINDATA", "$P1B", "$P2R", "$P1E")),
    (V32 | {"$CYT": None, "$MODE": None}, ("$CYT", "missing")),
    ({"$DATATYPE": "X"}, ("$DATATYPE", "unknown")),
    ({"$DATATYPE": "A"}, ("$DATATYPE", "deprecated")),
    ({"$MODE": "Q"}, ("$MODE", "unknown")),
    ({"$MODE": "U"}, ("$MODE", "deprecated")),
    (V32, ("$MODE", "deprecated")),
    ({"$BYTEORD": "2,1"}, ("$BYTEORD", "unknown")),
    ({"$TOT": "0"}, ("$TOT", "is 0")),
    ({"$P3N": "c"}, ("$PnN", "not as many as $PAR")),
    ({"$P2N": "a"}, ("$PnN", "names repeat")),
    ({"$P2N": "b,c"}, ("$P2N", "has a comma")),
    ({"OWN": ""}, ("OWN", "empty")),
    ({"O\nWN": "1"}, ("O\nWN", "bad character in the name")),
    ({"$P1B": "x"}, ("$P1B", "no number")),
    ({"$P1B": "64"}, ("$P1B", "must be 32 for floats")),
    (V32 | {"$MODE": None, "$P1DATATYPE": "I", "$P1B": "12"}, ("$P1B", "not divisible by 8")),
    (V32 | {"$MODE": None, "$P1DATATYPE": "D"}, ("$P1B", "must be 64 for doubles")),
    (V32 | {"$MODE": None, "$P1DATATYPE": "Z"}, ("$P1DATATYPE", "unknown")),
    ({"$P1R": "x"}, ("$P1R", "no number")),
    ({"$P1E": "0"}, ("$P1E", "not two numbers")),
    ({"$P1E": "4,1"}, ("$P1E", "must be 0,0 for floating point data")),
    ({"$DATATYPE": "I", "$P1E": "4,0"}, ("$P1E", "one number is 0")),
    ({"$P1G": "x"}, ("$P1G", "no number")),
    ({"$P1G": "-1"}, ("$P1G", "not above 0")),
    (V32 | {"$MODE": None, "$P1G": "2"}, ("$P1G", "is for integers only")),
    ({"$DATATYPE": "I", "$P1E": "4,1", "$P1G": "2"}, ("$P1G", "with logarithmic amplification")),
    ({"$SPILLOVER": "2,a,b,1,0,0"}, ("$SPILLOVER", "no matrix")),
    ({"$SPILLOVER": "2,a,z,1,0,0,1"}, ("$SPILLOVER", "unknown parameter")),
]


def test_each_rule_of_keywords(spark):
    rows = [(-1, GOOD), (-2, GOOD | {"$SPILLOVER": "2,a,b,1,0,0,1", "$P1G": "1"}), (-3, {k: v for k, v in GOOD.items() if k != "$MODE"} | V32), (-4, {k: GOOD[k] for k in ("$BYTEORD", "$DATATYPE", "$MODE", "$NEXTDATA", "$PAR", "$TOT", "$P1B", "$P2B", "$P1R", "$P2R")} | {"$VERSION": "FCS2.0"})]
    rows += [(i, {k: v for k, v in (GOOD | change).items() if v is not None}) for i, (change, _) in enumerate(BROKEN)]
    got = {r["i"]: [tuple(p) for p in r["p"]] for r in spark.createDataFrame(rows, "i int, t map<string,string>").select("i", fcs_rules.problems(F.col("t")).alias("p")).collect()}
    assert [got[i] for i in (-1, -2, -3, -4)] == [[]] * 4
    for i, (_, problem) in enumerate(BROKEN):
        assert got[i] == [problem], (i, problem)
    pairs = [("$TOT", " 4 "), ("A", "1"), ("A", "2"), ("/B", "x"), ("C", "/x")]
    df = spark.createDataFrame([(GOOD, pairs)], "t map<string,string>, p array<struct<keyword:string,value:string>>")
    assert [tuple(x) for x in df.select(fcs_rules.problems(F.col("t"), F.col("p"), F.lit("/"))).first()[0]] == [("$TOT", "number padded with other than 0"), ("/B", "begins with the delimiter"), ("C", "begins with the delimiter"), ("A", "repeated")]


def described_file(tmp_path, name, order, ids, shift=0, features=True):
    """A container whose directories have fields of several types, and a matrix of two features."""
    cat = Catalog({"a": Feature("a"), "b": Feature("b")})
    rng = np.random.default_rng(shift)
    strips, pixels = [], {}
    for i in ids:
        image, mask = rng.integers(0, 4000, (3, 4)), rng.integers(0, 3, (3, 4))
        pixels[i] = image.ravel().tolist()
        more = {container.SPEED: [0.5 + i], container.CAMERA_LINE: 7 * i, 33019: (3, 3, b"\1\0\2\0\xff\1"), 33021: (5, 1, b"\3\0\0\0\4\0\0\0"), 33022: b"text of a strip"}
        for kind, x, way, code in ((container.IMAGE, image, images.DELTA, images.delta_encode), (container.MASK, mask, images.RUNS, images.run_encode)):
            strips.append((i, kind, 3, 4, way, code(x), more))
    matrix = np.array([[i + shift, 2 * i] for i in ids], float) if features else None
    about = Run((True,), definitions=daf.write_template(cat)).tags() | {33077: (8, 2, b"\xfe\xff\3\0")}
    path = tmp_path / name
    path.write_bytes(container.encode_strips(strips, matrix, order, about))
    return str(path), pixels


def test_fields_features_and_origins_go_with_their_objects(spark, tmp_path):
    one, first = described_file(tmp_path, "a.cif", ">", [0, 1, 2, 3])
    two, second = described_file(tmp_path, "b.cif", "<", [4, 9, 30], 100)
    wanted = spark.createDataFrame([("a.cif", 1), ("a.cif", 3), ("b.cif", 9), ("b.cif", 30)], "import_file string, object_id long")
    done = container.merge_files(spark, [one, two], str(tmp_path / "out"), wanted).collect()
    assert sum(r["rows"] for r in done) == 4
    container.merge_files(spark, str(tmp_path / "out/*.cif"), str(tmp_path / "again")).collect()
    again = str(tmp_path / "again/*.cif")
    assert container.stored_names(spark, again) == ["a", "b"]
    dirs = container.read_directories(spark, again)
    past = {r["object_id"]: (r["origin_files"][0], r["origin_ids"][0]) for r in dirs.filter("object_id is not null").collect()}
    assert sorted(past.values()) == [("a.cif", 1), ("a.cif", 3), ("b.cif", 9), ("b.cif", 30)]
    assert {len(r["origin_ids"]) for r in dirs.filter("object_id is not null").collect()} == {2}
    values = container.read_features(spark, again, ["a", "b"], directories=dirs).collect()
    assert {past[r["object_number"]]: (r["a"], r["b"]) for r in values} == {("a.cif", 1): (1, 2), ("a.cif", 3): (3, 6), ("b.cif", 9): (109, 18), ("b.cif", 30): (130, 60)}
    strips = container.read_strips(spark, again, 1, tags=True)
    pixels = {past[r["object_id"]]: r["pixels"] for r in images.decoded(strips.filter("kind = 'img'"), ["object_id"]).collect()}
    assert pixels == {("a.cif", 1): first[1], ("a.cif", 3): first[3], ("b.cif", 9): second[9], ("b.cif", 30): second[30]}
    for r in strips.collect():
        kept = {f["tag"]: (f["type"], f["count"], bytes(f["value"])) for f in r["fields"]}
        assert (kept[33019], kept[33021], kept[33022]) == ((3, 3, b"\1\0\2\0\xff\1"), (5, 1, b"\3\0\0\0\4\0\0\0"), (2, 16, b"text of a strip\0"))
    speed = {past[r["object_id"]]: (r["speed"], r["camera_line"]) for r in dirs.filter("kind = 'msk'").collect()}
    assert speed == {k: (0.5 + k[1], 7.0 * k[1]) for k in past.values()}
    for r in container.read_first(spark, again).collect():
        assert dict(r["numbers"])[33077] == [-2.0, 3.0]
    back = files.read(spark, again)
    assert sorted((r["a"], r["b"]) for r in back.df.collect()) == [(1, 2), (3, 6), (109, 18), (130, 60)] and back.df.filter("imgIFD > 0").count() == 4


def test_tiff_pages_keep_fields(spark, tmp_path):
    path, _ = described_file(tmp_path, "a.cif", ">", [0, 1])
    container.write_tiff(container.read_strips(spark, path, 1, tags=True), str(tmp_path / "out"), order=">").collect()
    pages = container.read_strips(spark, str(tmp_path / "out/*.tif"), 1, tags=True).collect()
    assert len(pages) == 4
    for r in pages:
        kept = {f["tag"]: (f["type"], f["count"], bytes(f["value"])) for f in r["fields"]}
        assert kept[33019] == (3, 3, b"\1\0\2\0\xff\1") and kept[container.BITS][2] == b"\x10\0"


def test_features_that_differ_are_left_out(spark, tmp_path):
    one, _ = described_file(tmp_path, "a.cif", "<", [0, 1])
    two, _ = described_file(tmp_path, "b.cif", "<", [0, 1], features=False)
    assert container.stored_names(spark, [one, two]) == [] and container.stored_names(spark, one) == ["a", "b"]
    container.merge_files(spark, [one, two], str(tmp_path / "out")).collect()
    out = str(tmp_path / "out/*.cif")
    assert container.stored_names(spark, out) == [] and container.read_offsets(spark, out).filter("kind = 'img'").count() == 4


def test_rows_of_features_find_their_ids(spark, tmp_path):
    """Ids below the number of rows are rows; others take them in order. Files of one name lie in two folders."""
    for sub, ids in (("x", [0, 2, 3, 1]), ("y", [50, 7, 20])):
        (tmp_path / sub).mkdir()
        described_file(tmp_path / sub, "a.cif", "<", sorted(ids))
    paths = [str(tmp_path / "x/a.cif"), str(tmp_path / "y/a.cif")]
    dirs = container.read_directories(spark, paths)
    got = sorted((r["object_number"], r["a"]) for r in container.read_features(spark, paths, ["a", "b"], directories=dirs).collect())
    assert got == [(i, float(i)) for i in (0, 1, 2, 3, 7, 20, 50)]
    whole = tmp_path / "x/a.cif"
    data = bytearray(whole.read_bytes())
    (at, tags, _), *_ = container.directories(bytes(data))
    field = next(p for p in range(at + 2, at + 2 + 12 * 30, 12) if int.from_bytes(data[p : p + 2], "little") == container.FEATURES)
    data[field + 2 : field + 8] = (1).to_bytes(2, "little") + (8 + 4 * 8).to_bytes(4, "little")  # as bytes instead of a place
    whole.write_bytes(bytes(data))
    assert sorted((r["object_number"], r["b"]) for r in container.read_features(spark, str(whole), ["a", "b"]).collect()) == [(i, 2.0 * i) for i in range(4)]


def test_rules_of_keywords_compute_shared_values_once(spark, sf_dir):
    """A row's version is read once, not once for each rule, and rows are dealt to tasks first."""
    from gatewise.plans import registry

    plan = registry.QUERIES["fcs_problems"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 1
    assert "RepartitionByExpression" in plan
