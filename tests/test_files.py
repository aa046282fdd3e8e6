"""File formats: bytes made by hand or by the encoders, read through Spark."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewise.operators import images
from gatewise.operators.catalog import Catalog, Feature, Graph, Population
from gatewise.operators.gates import Region
from gatewise.operators.populations import Strategy
from gatewise.sources import container, daf, fcs, fcs_rules, files, gatingml


def fcs_file(version, pars, rows, data, extra=None, order="1,2,3,4", kind="I", following=0, sep="/"):
    text = {"$DATATYPE": kind, "$MODE": "L", "$BYTEORD": order, "$PAR": str(len(pars)), "$TOT": str(rows), "$NEXTDATA": str(following)}
    for i, p in enumerate(pars, 1):
        text |= {f"$P{i}{k}": v for k, v in p.items()}
    text |= extra or {}
    body = (sep + "".join(f"{k}{sep}{v.replace(sep, sep * 2)}{sep}" for k, v in text.items())).encode()
    start = 58 + len(body)
    head = version.encode() + b"    " + b"".join(b"%8d" % v for v in (58, start - 1, start, start + len(data) - 1, 0, 0))
    return head + body + data


def par(name, bits, top, **more):
    return {"N": name, "B": str(bits), "R": str(top), "E": "0,0"} | more


def write(path, data):
    path.write_bytes(data)
    return str(path)


def collected(df):
    return [tuple(r) for r in df.orderBy("import_subfile", "object_number").collect()]


def test_integers_of_mixed_widths_and_masks(spark, tmp_path):
    data = b"".join(struct.pack("<BH", a, b) + bytes((c & 255, c >> 8 & 255, c >> 16)) + struct.pack("<I", d) for a, b, c, d in ((1, 2, 3, 4), (255, 65535, 70000, 2**31)))
    pars = [par("a", 8, 256), par("b", 16, 1024), par("c", 24, 2**24), par("d", 32, 2**32)]
    path = write(tmp_path / "x.fcs", fcs_file("FCS3.1", pars, 2, data))
    rows = collected(fcs.read_fcs(spark, path))
    assert [r[3:] for r in rows] == [(1, 2, 3, 4), (255, 1023, 70000, 2**31)]
    assert rows[1][:3] == ("x.fcs", 1, 1)


@pytest.mark.parametrize("order,code", [("1,2,3,4", "<"), ("4,3,2,1", ">")])
@pytest.mark.parametrize("kind,size", [("F", "f"), ("D", "d"), ("I", "I")])
def test_byte_orders(spark, tmp_path, order, code, kind, size):
    values = np.array([[1, 250], [3, 70000]], code + {"f": "f4", "d": "f8", "I": "u4"}[size])
    bits = {"f": 32, "d": 64, "I": 32}[size]
    path = write(tmp_path / "x.fcs", fcs_file("FCS3.0", [par("a", bits, 2**20), par("b", bits, 2**20)], 2, values.tobytes(), order=order, kind=kind))
    assert [r[3:] for r in collected(fcs.read_fcs(spark, path))] == [(1, 250), (3, 70000)]


def test_odd_byte_order(spark, tmp_path):
    data = bytes((2, 1, 4, 3))  # byte 2 of the number comes first
    path = write(tmp_path / "x.fcs", fcs_file("FCS2.0", [par("a", 32, 2**32)], 1, data, order="2,1,4,3"))
    assert collected(fcs.read_fcs(spark, path))[0][3] == 1 | 2 << 8 | 3 << 16 | 4 << 24


def test_scaling_and_gain(spark, tmp_path):
    pars = [par("log", 16, 1024, E="4,1"), par("bad", 16, 1024, E="2,0"), par("gain", 16, 1024, G="2")]
    path = write(tmp_path / "x.fcs", fcs_file("FCS3.1", pars, 1, struct.pack("<HHH", 512, 512, 10)))
    log, bad, gain = collected(fcs.read_fcs(spark, path))[0][3:]
    assert (log, bad, gain) == pytest.approx((100.0, 10.0, 5.0))
    assert collected(fcs.read_fcs(spark, path, scale=False))[0][3:] == (512, 512, 10)


def test_ascii_mixed_types_and_escapes(spark, tmp_path):
    path = write(tmp_path / "a.fcs", fcs_file("FCS3.0", [par("a", "*", 9), par("b", "*", 9)], 2, b"1,2\n3 4", kind="A"))
    assert [r[3:] for r in collected(fcs.read_fcs(spark, path))] == [(1, 2), (3, 4)]
    pars = [par("a", 32, 9, DATATYPE="F", S="x/y"), par("b", 16, 1024, DATATYPE="I")]
    path = write(tmp_path / "b.fcs", fcs_file("FCS3.2", pars, 1, struct.pack("<fH", 1.5, 7), extra={"$CYT": "c"}))
    df = fcs.read_fcs(spark, path)
    assert df.columns[3:] == ["a < x/y >", "b"] and collected(df)[0][3:] == (1.5, 7)


def test_chained_data_sets_and_merge(spark, tmp_path):
    one = fcs_file("FCS3.0", [par("a", 8, 256)], 2, b"\1\2", following=9999)
    one = fcs_file("FCS3.0", [par("a", 8, 256)], 2, b"\1\2", following=len(one)).ljust(len(one))
    two = fcs_file("FCS3.0", [par("a", 8, 256), par("b", 8, 256)], 1, b"\3\4")
    path = write(tmp_path / "x.fcs", one + two)
    assert [r[1:] for r in collected(fcs.read_fcs(spark, path))] == [(1, 0, 1, None), (1, 1, 2, None), (2, 0, 3, 4)]
    assert [r[1:] for r in collected(fcs.read_fcs(spark, path, dataset=[2]))] == [(2, 0, 3, 4)]


def test_keyword_rules(spark):
    text = {"$VERSION": "FCS3.1", "$PAR": "2", "$DATATYPE": "F", "$P1N": "a", "$P2N": "a", "$P1E": "4,1"}
    found = [tuple(x) for x in spark.createDataFrame([(text,)], "t map<string,string>").select(fcs_rules.problems(F.col("t"))).first()[0]]
    assert ("$TOT", "missing") in found and ("$PnN", "names repeat") in found and ("$P1E", "must be 0,0 for floating point data") in found


def test_fcs_writer(spark, tmp_path):
    df = spark.range(10, numPartitions=2).select("id", F.when(F.col("id") == 3, F.lit(float("inf"))).otherwise(F.col("id") / 2).alias("half < h|s >"))
    made = fcs.write_fcs(df, str(tmp_path / "out"), rows_per_file=3).collect()
    assert sorted(r["rows"] for r in made) == [2, 2, 3, 3]
    back = fcs.read_fcs(spark, str(tmp_path / "out/*.fcs"))
    assert {(r["id"], r["half < h|s >"]) for r in back.collect()} == {(i, 0.0 if i == 3 else i / 2) for i in range(10)}
    heads = fcs.read_keywords(spark, str(tmp_path / "out/*.fcs"))
    assert heads.filter("size(problems) > 0").count() == 0


def strategy():
    cat = Catalog().add_regions(Region("l", "line", (1.0, float("inf"))), Region("p", "poly", (0.0, 4.0, 2.0), (0.0, 0.0, 3.0), xtrans="1000"), Region("o", "oval", (1.0, 3.0), (2.0, 8.0)), Region("r", "rect", (0.0, 1.0), (0.0, 2.0)))
    cat = cat.add_pops(
        Population("L", region="l", fx="a"),
        Population("P", base="L", region="p", fx="a", fy="b"),
        Population("O", region="o", fx="a", fy="b"),
        Population("R", region="r", fx="a", fy="b"),
        Population("C", definition="L|And|Not|(|P|Or|O|)"),
        Population("T", ids=(1, 5)),
    )
    return cat.add_group(Region("q", "rect", (2.0, 3.0), (5.0, 6.0)), "quad", fx="a", fy="b").add_group(Region("d", "line", (2.0, 3.0)), "dual", fx="a")


def test_gatingml_roundtrip():
    cat, spill = strategy(), {"a": {"a": 1.0, "b": 0.1}, "b": {"a": 0.0, "b": 1.0}}
    again = gatingml.parse(gatingml.render(Strategy(cat, spill)))
    assert again.spillover == spill
    assert again.catalog.regions == cat.regions
    for name, p in cat.pops.items():
        q = again.catalog.pops[name]
        assert (p.type, p.base or "All", p.region, p.fx, p.fy, p.definition, p.ids) == (q.type, q.base or "All", q.region, q.fx, q.fy, q.definition, q.ids)


FOREIGN = """<gating:Gating-ML xmlns:gating="http://www.isac-net.org/std/Gating-ML/v2.0/gating" xmlns:data-type="http://www.isac-net.org/std/Gating-ML/v2.0/datatypes">
<gating:RectangleGate gating:id="R"><gating:dimension gating:min="5"><data-type:fcs-dimension data-type:name="a"/></gating:dimension></gating:RectangleGate>
<gating:EllipsoidGate gating:id="E" gating:parent_id="R"><gating:dimension><data-type:fcs-dimension data-type:name="a"/></gating:dimension><gating:dimension><data-type:fcs-dimension data-type:name="b"/></gating:dimension>
<gating:mean><gating:coordinate data-type:value="10"/><gating:coordinate data-type:value="20"/></gating:mean><gating:covarianceMatrix><gating:row><gating:entry data-type:value="4"/><gating:entry data-type:value="0"/></gating:row>
<gating:row><gating:entry data-type:value="0"/><gating:entry data-type:value="9"/></gating:row></gating:covarianceMatrix><gating:distanceSquare data-type:value="1"/></gating:EllipsoidGate>
<gating:QuadrantGate gating:id="Q"><gating:divider gating:id="x"><data-type:fcs-dimension data-type:name="a"/><gating:value>3</gating:value></gating:divider><gating:divider gating:id="y"><data-type:fcs-dimension data-type:name="b"/><gating:value>4</gating:value></gating:divider>
<gating:Quadrant gating:id="PN"><gating:position gating:divider_ref="x" gating:location="5"/><gating:position gating:divider_ref="y" gating:location="1"/></gating:Quadrant></gating:QuadrantGate>
<gating:BooleanGate gating:id="B"><gating:and><gating:gateReference gating:ref="R"/><gating:gateReference gating:ref="E" gating:use-as-complement="true"/></gating:and></gating:BooleanGate>
</gating:Gating-ML>"""


def test_foreign_gatingml():
    with pytest.raises(ValueError, match="along the axes"):
        gatingml.parse(FOREIGN.replace('"0"/></gating:row>', '"1"/></gating:row>'))
    cat = gatingml.parse(FOREIGN).catalog
    assert cat.regions["R"].x == (5.0, float("inf")) and cat.pops["E"].base == "R"
    assert cat.regions["E"].x == (8.0, 12.0) and cat.regions["E"].y == (17.0, 23.0)
    assert cat.regions["PN"].x == (3.0, float("inf")) and 3.99 < cat.regions["PN"].y[1] < 4 and cat.pops["B"].definition == "R|And|(|Not|E|)"


def daf_catalog():
    cat = Catalog().add_features(Feature("Object Number"), Feature("a"), Feature("b"), Feature("ab", "combined", "a|*|b"))
    cat = cat.add_regions(Region("r", "line", (1.0, 2.0))).add_pops(Population("in", region="r", fx="ab"), Population("t", ids=(0, 2)), Population("c", definition="in|Or|t"))
    return cat.add_graphs(Graph("histogram", "a", shown=("in",), regions=("r",)))


@pytest.mark.parametrize("binary", [True, False])
def test_daf(spark, tmp_path, binary):
    x = np.array([[0, 1.0, 1.5], [1, float("nan"), 2.0], [2, 3.0, 4.0]])
    rows = [dict(id=i, imgIFD=100 + i, mskIFD=200, spIFD=0, w=3.0, l=4.0, fs=1.0, cl=7, ct=8, objCenterX=0.5, objCenterY=0.25, bgstd=[1.0], bgmean=[2.0], satcount=[], satpercent=[0.0]) for i in range(3)]
    path = write(tmp_path / "x.daf", daf.encode(daf_catalog(), ["Object Number", "a", "b"], x, binary, rows))
    objects = daf.read_daf(spark, path)
    assert objects.catalog == daf_catalog()
    got = {r["Object Number"]: r["ab"] for r in objects.values().collect()}
    assert got[0] == 1.5 and got[2] == 12 and np.isnan(got[1])
    assert sorted(r["Object Number"] for r in objects.objects_in("c").collect()) == [0, 2]
    if binary:
        images_df = daf.read_images(spark, path)
        assert images_df.filter("id = 2").first()["bgmean"] == [2.0]
        assert daf.checksum(images_df).first()["checksum"] == 303


def test_template():
    cat = daf_catalog()
    assert daf.read_template(daf.write_template(cat)) == cat


@pytest.mark.parametrize("order", ["<", ">"])
def test_container(spark, tmp_path, order):
    rng = np.random.default_rng(1)
    objects = [(i, rng.integers(-50, 4000, (5, 8)), rng.integers(0, 3, (5, 8))) for i in (3, 1, 2)]
    path = write(tmp_path / "x.cif", container.encode(objects, np.array([[1.5, 2], [3, 4], [5, 6]]), order))
    offsets = container.read_offsets(spark, path)
    assert [(r["kind"], r["object_id"]) for r in offsets.orderBy("position").collect()] == [("first", None), ("img", 3), ("msk", 3), ("img", 1), ("msk", 1), ("img", 2), ("msk", 2)]
    assert {(r["object_id"], r["new_id"]) for r in container.subset_ids(offsets, [1, 3]).collect()} == {(1, 0), (3, 1)}
    strips = container.read_strips(spark, path, channels=2, objects=[1, 3])
    got = images.decoded(strips, ["object_id", "kind"]).collect()
    assert len(got) == 8
    for r in got:
        i, image, mask = next(o for o in objects if o[0] == r["object_id"])
        whole = image if r["kind"] == "img" else mask
        assert np.array_equal(np.array(r["pixels"]).reshape(5, 4), whole[:, 4 * r["channel"] : 4 * r["channel"] + 4])
    assert [tuple(r)[1:] for r in container.read_features(spark, path, ["u", "v"]).orderBy("object_number").collect()] == [(0, 1.5, 2), (1, 3, 4), (2, 5, 6)]


def test_definitions_alone_in_files(spark, tmp_path):
    cat, spill = strategy(), {"a": {"a": 1.0, "b": 0.1}, "b": {"a": 0.0, "b": 1.0}}
    files.write_gates(Strategy(cat, spill), str(tmp_path / "deep/x.xml"))
    again = files.read(spark, str(tmp_path / "deep/x.xml"))
    assert again.spillover == spill and again.catalog.regions == cat.regions
    files.write_gates(Strategy(cat), f"file:{tmp_path}/x.ist")
    back = files.read(spark, str(tmp_path / "x.ist")).catalog
    assert back.warnings == () and set(back.regions) == set(cat.regions)
    for k, r in cat.regions.items():  # groups stay whole; of their bounds the divider alone matters
        found = back.regions[k]
        assert found.sync == r.sync and found.x[0] == r.x[0] and (found.y[0] == r.y[0] or r.type == "line")
        assert r.sync or found == r
    with pytest.raises(ValueError, match="no spillover"):
        files.write_gates(Strategy(cat, spill), str(tmp_path / "x.ast"))
    with pytest.raises(ValueError, match="written as ast"):
        files.write_gates(Strategy(cat), str(tmp_path / "x.fcs"))
