"""Mask language and the cascade of definitions."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from gatewise.functions.channels import default_feature_name, family_kind
from gatewise.operators import masks as M
from gatewise.operators.catalog import Catalog, Feature, Graph, Population
from gatewise.operators.gates import Region
from gatewise.operators.masks import Call, Logic, Mask, Masks, Ref, default_image
from gatewise.operators.populations import Objects
from gatewise.sources import daf

NAMES = {
    "Dilate|M02|3": "Dilate(M02, 3)",
    "Spot|M02|Ch02|0|5.50|3|1": "Spot(M02, Ch02, Bright, 5.5, 3, 1)",
    "Spot|M02|Ch02|1|3|1": "Spot(M02, Ch02, Dark, 3, 1)",
    "Intensity|M02|Ch02|100|4095": "Intensity(M02, Ch02, 100-4095)",
    "Range|M02|0|5000|0.25|1": "Range(M02, 0-5000, 0.2-1)",
    "Watershed|M02|Ch02|0|0|3|2": "Watershed(M02)",
    "Watershed|M02|Ch02|1|0|3|2": "Watershed(M02, Ch02, IW, 3, 2)",
    "Watershed|M02|Ch02|1|1|3|2": "Watershed(M02, Ch02, IW, Inv, 3, 2)",
    "Component|M02|Ch02|Ch03|0|0|1|4095": "Component(1, Area, M02, Descending)",
    "Component|M02|Ch02|Ch03|20|1|2|4095": "Component(2, Intensity, M02, Ch02, Ascending)",
    "Component|M02|Ch02|Ch03|29|0|1|4095": "Component(1, Bright Detail Similarity R3, M02, Ch02, Ch03, Descending)",
    "LevelSet|M02|Ch02|3|2.4": "LevelSet(M02, Ch02, Middle, 2)",
    "M01|Or|M02": "M01 Or M02",
    "(|M01|Or|M02|)|And|Not|M03": "( M01 Or M02 ) And Not M03",
}


@pytest.mark.parametrize("definition", NAMES)
def test_default_names(definition):
    assert M.default_name(M.parse(definition)) == NAMES[definition]


NUMBERS = {"integer": lambda a: st.sampled_from(sorted(a.words)) if a.words else st.integers(int(a.low or 0), int(a.high or 4095)), "numeric": lambda a: st.integers(int(a.low * 10**a.digits), int(a.high * 10**a.digits)).map(lambda v: v / 10**a.digits)}
LOSSY = ("Component", "Watershed")


def calls(inner, functions):
    one = lambda f: st.tuples(*(inner if a.kind == "mask" else st.sampled_from(["Ch01", "Ch02"]).map(Ref) if a.kind == "image" else NUMBERS[a.kind](a) for a in M.FUNCTIONS[f])).map(lambda args: Call(f, args))
    return st.sampled_from(functions).flatmap(one)


MASK = st.recursive(st.sampled_from(["M01", "M02", "own"]).map(Ref), lambda inner: calls(inner, [f for f in M.FUNCTIONS if f not in LOSSY]), max_leaves=6)
LOGIC = st.lists(MASK, min_size=2, max_size=4).map(lambda ms: Logic(tuple(x for i, m in enumerate(ms) for x in ([m] if not i else ["And" if i % 2 else "Or", "Not", m]))))


@given(st.one_of(calls(MASK, list(M.FUNCTIONS)), LOGIC))
def test_what_is_printed_is_parsed(tree):
    assert M.parse(M.text(tree), ["own"]) == tree


@given(MASK.filter(lambda t: isinstance(t, Call)))
def test_names_tell_nested_definitions(tree):
    assert M.parse_name(M.default_name(tree), ["own"]) == tree


@pytest.mark.parametrize("definition", ["Dilate|M02", "Dilate|M02|20", "Dilate|M02|x", "Dilate|gone|1", "Skeleton|M02|Ch02|2", "M01|And", "M01|M02", "(|M01", "Or|M01", "M01|)", "Nothing(M01)", "Fill|Watershed(M01)", ""])
def test_what_is_no_mask(definition):
    with pytest.raises(ValueError):
        M.parse(definition)


def images(*channels):
    return tuple(default_image(c) for c in channels)


def test_masks_of_masks_follow():
    given_ = [Mask("MC", "M01|Or|M02"), Mask("Dilate(M02, 3)", "Dilate|M02|3"), Mask("mine", "Erode|Dilate(M02, 3)|1"), Mask("Fill(Erode(Dilate(M02, 3), 1))", "Fill|Erode(Dilate(M02, 3), 1)"), Mask("Fill(mine)", "Fill|mine"), Mask("Morphology(Fill(mine), Ch02)", "Morphology|Fill(mine)|Ch02"), Mask("None", "")]
    table = Masks(given_, images(1, 2))
    assert [n for n in table.masks if table.custom(n)] == ["MC", "mine", "None"]
    assert table.expanded("Morphology(Fill(mine), Ch02)") == Call("Morphology", (Call("Fill", (Ref("mine"),)), Ref("Ch02")))
    new, names = table.redefined({"mine": "yours", "M02": "M01"}, {"Ch02": "Ch01"})
    assert {m.name: m.definition for m in new} == {"MC": "M01|Or|M02", "None": "", "Dilate(M01, 3)": "Dilate|M01|3", "yours": "Erode|Dilate(M01, 3)|1", "Fill(Erode(Dilate(M01, 3), 1))": "Fill|Erode(Dilate(M01, 3), 1)", "Fill(yours)": "Fill|yours", "Morphology(Fill(yours), Ch01)": "Morphology|Fill(yours)|Ch01"}
    assert names["Morphology(Fill(mine), Ch02)"] == "Morphology(Fill(yours), Ch01)"
    assert Masks(new, images(1, 2)).redefined(all_default=True)[1]["yours"] == "Erode(Dilate(M01, 3), 1)"
    assert {m.name for m in table.needed(["Fill(mine)"])} == {"MC", "None", "Fill(mine)", "mine", "Dilate(M02, 3)"}


def test_bad_tables_of_masks():
    with pytest.raises(ValueError, match="unknown mask 'M03'"):
        Masks([Mask("a", "Fill|M03")], images(1))
    with pytest.raises(ValueError, match="unknown image"):
        Masks([Mask("a", "Inspire|M01|Ch09")], images(1))
    with pytest.raises(ValueError, match="cycle"):
        Masks([Mask("a", "Fill|b"), Mask("b", "Fill|a")], images(1))


def test_feature_names():
    assert default_feature_name("Intensity|MC|Ch02") == "Intensity_MC_Ch02"
    assert default_feature_name("Delta Centroid X|M01|Ch01|M02|Ch02|true") == "Delta Centroid X_M01_Ch01_M02_Ch02_IntensityWeighted"
    assert default_feature_name("H Energy Mean|M01|Ch01|Granularity:|1|20") == "H Energy Mean_M01_Ch01"
    assert default_feature_name("Spot Count|M01|True|8|4") == "Spot Count_M01"
    assert default_feature_name("Spot Count|M01|True|8|2") == "Spot Count_M01_True_8_2"
    assert default_feature_name("a|/|(|b|+|c|)", True) == "a / ( b + c )"
    assert family_kind("Bkgd Mean|Ch02") == "image" and family_kind("H Energy Std|M01|Ch01|3") == "mask, image, scalar" and family_kind("Nothing") is None


def catalog():
    cat = Catalog().add_images(*images(1, 2, 3)).add_masks(Mask("MC", "M01|Or|M02|Or|M03"), Mask("Dilate(M02, 3)", "Dilate|M02|3"), Mask("spots", "Spot|Dilate(M02, 3)|Ch02|0|5|3|1"), Mask("unused", "Fill|M03"))
    cat = cat.add_features(
        Feature("Object Number"),
        Feature("Intensity_M01_Ch01"),
        Feature("Intensity_M02_Ch02"),
        Feature("bright", definition="Max Pixel|Dilate(M02, 3)|Ch02"),
        Feature("Spot Count_spots", definition="Spot Count|spots|True|8|4"),
        Feature("Intensity_M02_Ch02 / Intensity_M01_Ch01", "combined", "Intensity_M02_Ch02|/|Intensity_M01_Ch01"),
        Feature("ratio", "combined", "bright|/|Intensity_M02_Ch02"),
    )
    cat = cat.add_regions(Region("r", "line", (5.0, 9.0)), Region("q", "line", (0.0, 2.0))).add_pops(Population("in", region="r", fx="Intensity_M02_Ch02"), Population("low", base="in", region="q", fx="Intensity_M02_Ch02 / Intensity_M01_Ch01"))
    return cat.add_graphs(Graph("scatter", "Intensity_M01_Ch01", "Intensity_M02_Ch02", shown=("in",)))


ROWS = [(i, float(i % 7 + 1), float(i % 11), float(i), float(i % 3)) for i in range(40)]
COLUMNS = "`Object Number` long, Intensity_M01_Ch01 double, Intensity_M02_Ch02 double, bright double, `Spot Count_spots` double"


def members(objects, names):
    return {n: sorted(r["Object Number"] for r in objects.objects_in(n).collect()) for n in names}


def test_swap_moves_all_that_depends(spark):
    objects = Objects(spark.createDataFrame(ROWS, COLUMNS), catalog(), "Object Number")
    change = objects.catalog.swap_channels(1, 2)
    cat = change.catalog
    assert list(cat.features) == ["Object Number", "Intensity_M02_Ch02", "Intensity_M01_Ch01", "bright", "Spot Count_spots", "Intensity_M01_Ch01 / Intensity_M02_Ch02", "ratio"]
    assert cat.features["bright"].definition == "Max Pixel|Dilate(M01, 3)|Ch01" and cat.features["ratio"].definition == "bright|/|Intensity_M01_Ch01"
    assert {m.name: m.definition for m in cat.masks} == {"MC": "M01|Or|M02|Or|M03", "Dilate(M01, 3)": "Dilate|M01|3", "spots": "Spot|Dilate(M01, 3)|Ch01|0|5|3|1"}
    assert (cat.pops["in"].fx, cat.pops["low"].fx) == ("Intensity_M01_Ch01", "Intensity_M01_Ch01 / Intensity_M02_Ch02")
    assert (cat.graphs[0].f1, cat.graphs[0].f2) == ("Intensity_M02_Ch02", "Intensity_M01_Ch01")
    assert members(objects.redefined(change), ["in", "low"]) == members(objects, ["in", "low"])
    got = {r["Object Number"]: (r["Intensity_M01_Ch01"], r["Intensity_M02_Ch02"]) for r in objects.redefined(change).df.collect()}
    assert got == {r[0]: (r[2], r[1]) for r in ROWS}
    again = cat.swap_channels(1, 2).catalog
    assert again.pops == objects.catalog.pops and {f: x.definition for f, x in again.features.items()} == {f: x.definition for f, x in objects.catalog.features.items()}


def test_switch_merges_what_becomes_equal(spark):
    objects = Objects(spark.createDataFrame(ROWS, COLUMNS), catalog(), "Object Number")
    change = objects.catalog.switch_channel(2, 1)
    assert change.columns["Intensity_M01_Ch01"] == "Intensity_M02_Ch02" and "Intensity_M02_Ch02" not in change.catalog.features
    assert members(objects.redefined(change), ["in"]) == members(objects, ["in"])
    far = objects.catalog.switch_channel(2, 9)
    assert [i.name for i in far.catalog.images] == ["Ch01", "Ch02", "Ch03", "Ch09"] and far.catalog.images[3].color == "White"
    assert far.catalog.masks[0].definition == "M01|Or|M02|Or|M03|Or|M09" and far.catalog.pops["in"].fx == "Intensity_M09_Ch09"
    with pytest.raises(ValueError):
        objects.catalog.switch_channel(2, 2)


def test_images_masks_and_default_names():
    cat = catalog()
    named = cat.redefine(images={"Ch02": "CD4"}, masks={"spots": "dots"}).catalog
    assert named.features["bright"].definition == "Max Pixel|Dilate(M02, 3)|CD4" and named.pops["in"].fx == "Intensity_M02_CD4"
    assert "Spot Count_dots" in named.features and [i.name for i in named.images] == ["Ch01", "CD4", "Ch03"]
    plain = cat.with_default_names().catalog
    assert "Max Pixel_Dilate(M02, 3)_Ch02" in plain.features and plain.features["Max Pixel_Dilate(M02, 3)_Ch02 / Intensity_M02_Ch02"].type == "combined"
    assert "Spot Count_Spot(Dilate(M02, 3), Ch02, Bright, 5, 3, 1)" in plain.features


def test_masks_and_images_in_analysis_files():
    cat = catalog()
    assert daf.read_template(daf.write_template(cat)) == cat
