"""Byte ranges, descriptions of runs and checks of containers."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_files import fcs_file, par

from gatewise.operators import images
from gatewise.operators.masks import Mask, default_image
from gatewise.sources import container, fcs, files
from gatewise.sources.ranged import Ranged
from gatewise.sources.run import Run, read_assist, read_run, with_shifts


def test_slices_read_their_own_bytes(spark, tmp_path):
    data = os.urandom(100_000)
    (tmp_path / "x").write_bytes(data)
    counted = spark.sparkContext.accumulator(0)
    r = Ranged(f"file:{tmp_path}/x", 512, counted)
    assert len(r) == len(data)
    assert r[0:10] == data[:10] and r[100:200] == data[100:200] and counted.value == 512
    assert r[1000:90_000] == data[1000:90_000] and counted.value == 512 + 89_000
    assert r[99_990:200_000] == data[99_990:] and r[5:5] == b"" and r[200_000:200_010] == b""


def test_events_are_read_by_many_tasks(spark, tmp_path):
    x = np.arange(60_000, dtype="<f4").reshape(-1, 3)
    path = tmp_path / "x.fcs"
    path.write_bytes(fcs_file("FCS3.1", [par(n, 32, 9) for n in "abc"], len(x), x.tobytes(), kind="F"))
    df = fcs.read_fcs(spark, str(path), part_bytes=12_000)
    assert df.rdd.getNumPartitions() == 20
    got = df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()
    assert {r["n"] for r in got} <= {1000 * k for k in range(1, 21)} and len(got) > 1
    assert [r[2:] for r in df.orderBy("object_number").collect()] == [(i, *row) for i, row in enumerate(x.tolist())]
    two = fcs.read_fcs(spark, str(path), part_bytes=12_000, columns=["c", "a"])
    assert two.columns[3:] == ["c", "a"] and two.filter("object_number = 19999").first()[3:] == (59_999.0, 59_997.0)
    with pytest.raises(ValueError, match="unknown parameters"):
        fcs.read_fcs(spark, str(path), columns=["d"])


def test_keywords_leave_events_alone(spark, tmp_path):
    path = tmp_path / "x.fcs"
    path.write_bytes(fcs_file("FCS3.1", [par("a", 32, 9)], 500_000, bytes(2_000_000), kind="F"))
    counted = spark.sparkContext.accumulator(0)
    heads = fcs.read_heads(spark, str(path), counted)
    assert heads.first()["rows"] == 500_000 and counted.value < 20_000


def test_files_with_other_modes_are_told(spark, tmp_path):
    path = tmp_path / "x.fcs"
    path.write_bytes(fcs_file("FCS3.1", [par("a", 8, 256)], 1, b"\1", extra={"$MODE": "C"}))
    assert fcs.read_keywords(spark, str(path)).count() == 1
    with pytest.raises(Exception, match="not list mode"):
        fcs.read_fcs(spark, str(path)).collect()


def test_a_file_beyond_four_gigabytes(spark, tmp_path):
    """A sparse file: nearly all of it is never written."""
    rows, path = 700_000_000, tmp_path / "x.fcs"
    body = "|" + "".join(f"{k}|{v}|" for k, v in {"$DATATYPE": "F", "$MODE": "L", "$BYTEORD": "1,2,3,4", "$PAR": "2", "$TOT": rows, "$NEXTDATA": 0, "$BEGINDATA": 4096, "$ENDDATA": 4095 + 8 * rows, "$P1N": "a", "$P1B": 32, "$P1R": 9, "$P1E": "0,0", "$P2N": "b", "$P2B": 32, "$P2R": 9, "$P2E": "0,0"}.items())
    with open(path, "wb") as f:
        f.write(b"FCS3.1    " + b"".join(b"%8d" % v for v in (58, 57 + len(body), 0, 0, 0, 0)) + body.encode())
        f.seek(4096 + 8 * (rows - 1))
        f.write(struct.pack("<ff", 1.5, 2.5))
    heads = fcs.read_heads(spark, str(path)).first()
    assert (heads["rows"], heads["error"]) == (rows, None)
    df = fcs.read_fcs(spark, str(path), part_bytes=1 << 27)
    assert df.rdd.getNumPartitions() == -(-rows // ((1 << 27) // 8))
    data, text = Ranged(str(path)), dict(heads["keywords"])
    lay = fcs.layout(data, 0, text)
    end = fcs.decode(data[lay.start + (rows - 1) * 8 : lay.start + rows * 8], lay, text)
    assert end.tolist() == [[1.5, 2.5]]


RUN = Run(
    (True, False, True, True), (False, False, True, False), magnification=60.0, lasers=((True, 0.125), (False, 2.0)), crosstalk=((1.0, 0.25), (0.0, 1.0)),
    images=tuple(default_image(c, c == 3) for c in (1, 3, 4)), masks=(Mask("MC", "M01|Or|M03|Or|M04"), Mask("Fill(M01)", "Fill|M01")), assist={"XOffsets60x_Gen2_0_11": "0.5 0 -1.25 0", "YOffsets60x_Gen2_0_11": "1 0 2 0", "ChannelWidth": "90"}, date="today", instrument="one",
)


def written(tmp_path, n=5, order="<", name="x.cif", about=RUN, size=(4, 6)):
    rng = np.random.default_rng(n)
    objects = [(i, rng.integers(0, 4000, size), rng.integers(0, 3, size)) for i in range(n)]
    path = tmp_path / name
    path.write_bytes(container.encode(objects, None, order, about.tags() if about else None))
    return str(path), objects


@pytest.mark.parametrize("order", ["<", ">"])
def test_description_of_a_run(spark, tmp_path, order):
    path, _ = written(tmp_path, order=order)
    r = read_run(spark, path).first()
    assert (r["kind"], r["objects"], r["date"], r["instrument"], r["magnification"], r["channel_width"]) == ("rif", 5, "today", "one", 60.0, 90.0)
    assert r["channels_in_use"] == [True, False, True, True] and r["brightfield"] == [False, False, True, False] and r["brightfield_on"]
    assert [(x["powered"], x["power"], x["installed"]) for x in r["illumination"]] == [(True, 0.12, None), (False, 2.0, None)]
    assert r["crosstalk"] == [[1.0, 0.25], [0.0, 1.0]]
    assert [(i["name"], i["channel"], i["color"], i["xmin"], i["xmax"]) for i in r["images"]] == [("Ch01", 1, "DarkOrchid", 0, 4095), ("Ch03", 3, "White", 450, 1000), ("Ch04", 4, "DarkOrange", 0, 4095)]
    assert r["images"][1]["gamma"] == pytest.approx(np.log(127 / 255) / np.log(275 / 550))
    assert [(m["name"], m["def"]) for m in r["masks"]] == [("MC", "M01|Or|M03|Or|M04"), ("Fill(M01)", "Fill|M01")]
    assert (r["offsets_x"], r["offsets_y"]) == ([0.5, 0, -1.25, 0], [1, 0, 2, 0])
    assert {(x["test"], x["value"]) for x in read_assist(spark, path).collect()} == set(RUN.assist.items())


def test_a_file_without_description(spark, tmp_path):
    path, _ = written(tmp_path, about=None)
    r = read_run(spark, path).first()
    assert len(r["images"]) == 12 and r["masks"][0]["def"].startswith("M01|Or|M02") and r["crosstalk"] is None and r["channels_in_use"] == []
    with pytest.raises(Exception, match="give their number"):
        container.read_strips(spark, path).collect()


def test_strips_take_channels_from_the_file_and_only_wanted_bytes(spark, tmp_path):
    path, objects = written(tmp_path, 3)
    got = images.decoded(container.read_strips(spark, path), ["object_id", "kind"]).collect()
    assert len(got) == 18
    for r in got:
        whole = objects[r["object_id"]][1 if r["kind"] == "img" else 2]
        assert np.array_equal(np.array(r["pixels"]).reshape(4, 2), whole[:, 2 * r["channel"] : 2 * r["channel"] + 2])
    large, objects = written(tmp_path, 60, name="l.cif", size=(60, 90))
    size = os.path.getsize(large)
    counted = spark.sparkContext.accumulator(0)
    directories = container.read_directories(spark, large, counted)
    walked = counted.value
    assert directories.count() == 121 and walked < size // 1.5
    wanted = spark.createDataFrame([(7,), (41,)], "object_id long")
    one = container.read_strips(spark, large, 3, wanted, ("img",), directories, counted)
    assert sorted(r["object_id"] for r in one.collect()) == [7, 41]
    assert counted.value - walked < size // 20


def test_shifts_of_channels_in_use(spark, tmp_path):
    path, _ = written(tmp_path, 1)
    strips = container.read_strips(spark, path, kinds=("img",))
    r = with_shifts(strips, read_run(spark, path)).first()
    assert (r["dx"], r["dy"], r["channels"]) == ([0.5, -1.25, 0.0], [1.0, 2.0, 0.0], 3)


def test_merges_keep_the_run_and_choose_by_file(spark, tmp_path):
    one, first = written(tmp_path, 4, name="a.cif")
    two, second = written(tmp_path, 6, name="b.cif")
    wanted = spark.createDataFrame([("a.cif", 2), ("b.cif", 2), ("b.cif", 5)], "import_file string, object_id long")
    container.merge_files(spark, [one, two], str(tmp_path / "out"), wanted).collect()
    out = str(tmp_path / "out/*.cif")
    r = read_run(spark, out).first()
    assert (r["kind"], r["merged"], r["magnification"], r["crosstalk"]) == ("merged rif", ["a.cif", "b.cif"], 60.0, [[1.0, 0.25], [0.0, 1.0]])
    got = images.decoded(container.read_strips(spark, out, 1, kinds=("img",)), ["object_id"]).collect()
    assert {r["object_id"]: r["pixels"] for r in got} == {0: first[2][1].ravel().tolist(), 1: second[2][1].ravel().tolist(), 2: second[5][1].ravel().tolist()}


def test_probe_of_sound_and_broken_files(spark, tmp_path):
    path, _ = written(tmp_path, 6)
    data = open(path, "rb").read()
    assert tuple(container.probe(spark, path).first()) == ("x.cif", 1, 6, 6, [])
    places = [(at, t) for at, t, _ in container.directories(data)]

    def broken(name, change):
        bad = bytearray(data)
        change(bad)
        (tmp_path / name).write_bytes(bad)
        r = container.probe(spark, str(tmp_path / name)).first()
        return r["test"], [tuple(p) for p in r["problems"]]

    link = lambda k: places[k][0] + 2 + 12 * struct.unpack_from("<H", data, places[k][0])[0]
    field = lambda k, tag: next(places[k][0] + 2 + 12 * i + 8 for i in range(20) if struct.unpack_from("<H", data, places[k][0] + 2 + 12 * i)[0] == tag)
    assert broken("cycle.cif", lambda b: struct.pack_into("<I", b, link(4), places[1][0])) == (1, [("cycle", places[1][0])])
    assert broken("far.cif", lambda b: struct.pack_into("<I", b, link(4), len(data) + 9)) == (1, [("directory outside the file", len(data) + 9)])
    assert broken("strip.cif", lambda b: struct.pack_into("<I", b, field(12, container.STRIP_BYTES), 1 << 20)) == (1, [("strip outside the file", places[12][0])])
    assert broken("twice.cif", lambda b: struct.pack_into("<I", b, field(3, container.STRIP), places[1][1][container.STRIP][0]))[1] != []
    assert broken("masks.cif", lambda b: struct.pack_into("<I", b, field(2, container.KIND), container.IMAGE))[0] == 0
    assert broken("none.cif", lambda b: struct.pack_into("<I", b, field(1, container.KIND), container.MASK))[0] == -1
    unknown = tmp_path / "unknown.cif"
    bad = bytearray(data)
    struct.pack_into("<I", bad, field(0, container.COUNT), 0)
    unknown.write_bytes(bad)
    r = container.probe(spark, str(unknown)).first()
    assert r["objects"] == 0 and 4 <= r["estimated"] <= 40
    assert files.read(spark, path).df.count() == 6 and container.read_offsets(spark, path).count() == 13
