"""Catalog edits, memberships, statistics, merges and ids."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewise.operators import merge
from gatewise.operators import quantiles
from gatewise.operators.catalog import Catalog, Feature, Graph, Population, ordered
from gatewise.operators.gates import Region
from gatewise.operators.populations import Objects, Strategy, apply_strategy, member, rebuilt_ids
from gatewise.operators.stats import ReportRow, feature_stats, pop_stats, report


@pytest.fixture(scope="module")
def objects(spark):
    rows = [(i, float(i), float(i % 3), "f" + str(i % 2)) for i in range(20)] + [(20, float("nan"), 1.0, "f0"), (21, None, 2.0, "f1"), (22, float("inf"), 0.0, "f0")]
    df = spark.createDataFrame(rows, "object_number long, a double, b double, file string")
    o = Objects.of(df, file_col="file", features=("a", "b")).add_features(Feature("sum", "combined", "a|+|b"), Feature("twice", "combined", "sum|*|2"))
    o = o.add_regions(Region("low", "line", (0.0, 9.0)), Region("one", "line", (1.0, 1.0)))
    return o.add_pops(Population("L", region="low", fx="a"), Population("One", base="L", region="one", fx="b"), Population("mix", definition="L|And|Not|One"))


def ids(objects, pop):
    return sorted(r["object_number"] for r in objects.objects_in(pop).collect())


def test_memberships(objects):
    assert ids(objects, "L") == list(range(10))
    assert ids(objects, "One") == [1, 4, 7]
    assert ids(objects, "mix") == [0, 2, 3, 5, 6, 8, 9]
    assert ids(objects.add_pops(Population("T", base="L", ids=(1, 15))), "T") == [1]
    table = objects.df.filter("object_number in (2, 3)").select("object_number")
    assert ids(objects.add_pops(Population("T", ids=table)), "T") == [2, 3]
    assert objects.any_of(["One", "mix"]).count() == 10


def test_values_are_ordered_by_dependency(objects):
    r = objects.values(["twice"]).filter("object_number = 4").first()
    assert (r["sum"], r["twice"]) == (5.0, 10.0)


def test_samples_are_stable(objects):
    one, two = (ids(objects.add_sample("L", 4, "s", seed=3), "s") for _ in range(2))
    assert one == two and len(one) == 4 and set(one) <= set(range(10))
    assert len(ids(objects.add_sample("One", 50, "s"), "s")) == 3


def test_files_become_populations(objects):
    o = objects.add_file_pops(["f0", "f1"])
    assert ids(o, "f1") == [i for i in range(22) if i % 2]


def test_cycles_and_unknown_names():
    with pytest.raises(ValueError, match="cycle"):
        ordered({"a": 1, "b": 2}, {"a": ["b"], "b": ["a"]}.get)
    with pytest.raises(ValueError, match="unknown"):
        Catalog().add_regions(Region("r", "line", (0.0, 1.0))).add_pops(Population("x", base="y", region="r", fx="a"))
    with pytest.raises(ValueError, match="unknown token"):
        Catalog().add_pops(Population("x", definition="y"))
    with pytest.raises(ValueError):
        Population("t", ids=())
    assert ordered({"c": 0, "a": 0, "b": 0}, {"c": ["b"], "b": ["a"], "a": []}.get) == ["a", "b", "c"]


def test_additions_warn_about_names_that_exist(objects):
    cat = objects.catalog.add_pops(Population("L", definition="One"))
    assert cat.pops["L"].type == "G" and any("'L'" in w for w in cat.warnings)


def test_removal_cascades(objects):
    cat = objects.catalog.add_graphs(Graph("histogram", "b"), Graph("histogram", "a", shown=("One",)))
    what = cat.removal(features=["b"])
    assert what.features == ("b", "sum", "twice") and what.regions == ("one",) and what.pops == ("One", "mix") and what.graphs == (0,)
    left = cat.remove(what)
    assert set(left.pops) == {"All", "L"} and left.graphs[0].shown == ()
    assert "b" not in objects.remove(features=["b"], list_only=False).df.columns
    assert cat.removal(pops=["All"]).pops == ()
    quad = cat.add_group(Region("q", "rect", (1.0, 2.0), (1.0, 2.0)), "quad", fx="a", fy="b")
    assert len(quad.removal(regions=["q_2"]).regions) == 4


def test_renames(objects):
    cat = objects.catalog.add_pops(Population("low & One", base="One", region="low", fx="a"), Population("low", base="All", region="low", fx="a"))
    new = cat.rename_pops({"One": "Uno", "L": "Low|x"})
    assert set(new.pops) == {"All", "Low|x", "Uno", "mix", "low & Uno", "low"}
    assert new.pops["mix"].definition == "Low|x|And|Not|Uno" and new.pops["Uno"].base == "Low|x"
    with pytest.raises(ValueError):
        cat.rename_pops({"All": "x"})
    moved = objects.rename_features({"a": "area"})
    assert moved.catalog.features["sum"].definition == "area|+|b" and moved.catalog.pops["L"].fx == "area"
    assert sorted(r[0] for r in moved.objects_in("L").select("object_number").collect()) == list(range(10))


def test_modify_regions_moves_the_group(objects):
    cat = objects.catalog.add_group(Region("d", "line", (5.0, 9.0)), "dual", fx="a")
    new = cat.modify_regions(d_1=Region("d_1", "line", (7.0, 9.0)))
    assert new.regions["d_2"].x[0] == 7.0 and new.regions["d_2"].sync_part == 2
    new = cat.modify_regions(low=Region("LOW", "line", (0.0, 1.0)))
    assert new.pops["L"].region == "LOW"
    with pytest.raises(ValueError):
        cat.modify_regions(low=Region("low", "rect", (0.0, 1.0), (0.0, 1.0)))


def test_hierarchy_views(objects):
    cat = objects.catalog
    assert cat.levels() == {"All": 0, "L": 1, "One": 2, "mix": 3} and cat.levels(deepest=False)["mix"] == 2
    assert cat.tree().splitlines()[:2] == ["All", "  |-- L"]
    assert cat.siblings(["L"], same_base=True) == ["L"] and cat.siblings(["One"]) == ["One"]


def test_pop_stats(objects):
    got = {r["population"]: r for r in pop_stats(objects).collect()}
    assert got["One"]["count"] == 3 and got["One"]["perc_parent"] == 30.0 and got["One"]["perc_tot"] == pytest.approx(300 / 23)
    empty = objects.add_regions(Region("none", "line", (99.0, 98.0))).add_pops(Population("E", region="none", fx="a"), Population("F", base="E", region="low", fx="a"))
    assert math.isnan({r["population"]: r for r in pop_stats(empty).collect()}["F"]["perc_parent"])


def test_feature_stats(objects):
    got = {r["population"]: r for r in feature_stats(objects, ["a"]).collect()}
    r, v = got["All"], list(map(float, range(20)))
    assert (r["n"], r["n_nan"], r["min"], r["max"]) == (20, 3, 0.0, 19.0)
    assert (r["q1"], r["median"], r["q3"]) == tuple(np.quantile(v, [0.25, 0.5, 0.75]))
    assert r["sd"] == pytest.approx(statistics.stdev(v)) and r["mad"] == pytest.approx(1.4826 * 5)


def test_report_rules(objects):
    o = objects.add_regions(Region("few", "line", (3.0, 3.0)), Region("none", "line", (99.0, 98.0))).add_pops(Population("1", region="few", fx="a"), Population("0", region="none", fx="a"))
    rows = [ReportRow("sd1", "stddev", "1", "a"), ReportRow("mean inf", "Mean", "All", "a"), ReportRow("none", "Mean", "0", "a"), ReportRow("count", "Count", "0"), ReportRow("ml", "Objects/mL", "All"), ReportRow("nan", "NaN", "All", "a"), ReportRow("who", "Mean", "nobody", "a"), ReportRow("med", "Median", "All", "a")]
    got = {r["name"]: r["value"] for r in report(o, rows).collect()}
    assert got["sd1"] == 0 and got["count"] == 0 and got["nan"] == 3 and got["med"] == 10.0
    assert all(math.isnan(got[k]) for k in ("mean inf", "none", "ml", "who"))
    with pytest.raises(ValueError):
        ReportRow("x", "Sum", "All")


@pytest.mark.parametrize("accuracy", [10_000, 40])
@pytest.mark.parametrize("few", [1 << 16, -1])
def test_order_statistics_of_odd_data(spark, monkeypatch, accuracy, few):
    """Also with a rough sketch, whose bounds hold many values, and without the driver's short way."""
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    monkeypatch.setattr(quantiles, "MARGIN", 3 / accuracy)
    monkeypatch.setattr(quantiles, "BINS", 8)
    rng = np.random.default_rng(2)
    groups = {"skew": np.exp(rng.normal(0, 30, 3001)), "ties": rng.integers(0, 3, 2000).astype(float), "one": np.array([5.0]), "two": np.array([-1.0, 4.0]), "wide": np.array([-1.7e308, 1.7e308, 0.0, 1.0, 1e-300]), "signs": rng.normal(0, 1, 999), "same": np.full(500, 2.5), None: rng.normal(3, 1, 40)}
    df = spark.createDataFrame([(k, float(x), float(x) if i % 2 else None) for k, v in groups.items() for i, x in enumerate(v)], "key string, v double, w double").repartition(3)
    df = df.select(F.struct("key").alias("g"), "v", "w")
    probs = [0.25, 0.5, 0.9]
    first = df.groupBy("g").agg(F.array(F.count("v"), F.count("w")).alias("counts"), F.array(*(quantiles.sketch(F.col(c), probs) for c in "vw")).alias("sketches"))
    got = {r["g"]["key"]: r["found"] for r in quantiles.order_statistics(df, first, ["v", "w"], probs, spread=True).collect()}
    for k, v in groups.items():
        for c, x in enumerate((v, v[1::2])):
            assert (c in got[k]) == (len(x) > 0)
            if len(x) and k != "wide":
                assert got[k][c]["q"] == pytest.approx(list(np.quantile(x, probs)), rel=1e-12)
                assert got[k][c]["mad"] == pytest.approx(np.median(np.abs(x - np.median(x))), rel=1e-12)
    assert got["wide"][0]["q"][1] == 1e-300 and got["wide"][0]["mad"] == 1.0


def test_stats_by_group(spark):
    """Groups of any kind keep their type; a null one is a group; empty tables give none (or NaN)."""
    df = spark.createDataFrame([(i, float(i * i % 17), None if i % 5 == 0 else i % 5) for i in range(60)], "object_number long, a double, grp int")
    o = Objects.of(df, features=("a",))
    got = {r["grp"]: r for r in feature_stats(o, ["a"], by="grp").collect()}
    assert set(got) == {None, 1, 2, 3, 4}
    for g, r in got.items():
        v = [float(i * i % 17) for i in range(60) if (None if i % 5 == 0 else i % 5) == g]
        assert (r["q1"], r["median"], r["q3"]) == tuple(np.quantile(v, [0.25, 0.5, 0.75])) and r["n"] == 12
        assert r["mad"] == pytest.approx(1.4826 * np.median(np.abs(v - np.median(v))))
    rows = [ReportRow("n", "Count", "All"), ReportRow("m", "Median", "All", "a")]
    assert {(r["grp"], r["name"]) for r in report(o, rows, by="grp").collect()} == {(g, n) for g in got for n in "nm"}
    empty = Objects.of(df.limit(0), features=("a",))
    (r,) = feature_stats(empty, ["a"]).collect()
    assert r["n"] == 0 and math.isnan(r["median"]) and feature_stats(empty, ["a"], by="grp").count() == 0
    assert {r["name"]: math.isnan(r["value"]) for r in report(empty, rows).collect()} == {"n": False, "m": True}


def test_rebuilt_ids(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), f"f{i % 2}", int(rng.integers(0, 2)), None if i % 17 == 0 else int(rng.integers(0, 2))) for i in range(300)]
    df = spark.createDataFrame(rows, "pos long, file string, a int, b int")
    got = {r["pos"]: r["object_number"] for r in rebuilt_ids(df, ["a", "b"], "pos", "file", span=16).collect()}
    for f in ("f0", "f1"):
        n, last = 0, None
        for pos, _, a, b in (r for r in rows if r[1] == f):
            n += last is not None and last != (a, b)
            last = (a, b)
            assert got[pos] == n


def test_merges(spark):
    one = spark.createDataFrame([(1, 2.0)], "id int, own double")
    two = spark.createDataFrame([(3, "x")], "id int, other string")
    out = merge.merge_by_name({"1": one, "2": two})
    assert out.columns == ["own", "other", "id", "import_file"] and out.filter("own is null").count() == 1
    with pytest.raises(ValueError):
        merge.merge_by_position({"1": one, "2": two.select("id")})


def test_factor_codes_and_groups(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), (None, 2), ("b", 1), ("c", None)], "x string, y int")
    got = [(r["x"], r["code"]) for r in merge.factor_codes(df, "x").collect()]
    assert sorted(got, key=str) == sorted([("b", 2), ("a", 1), (None, 4), ("b", 2), ("c", 3)], key=str)
    assert merge.tuple_groups(df, ["x", "y"]).count() == 2 and merge.tuple_groups(df, ["x", "y"], keep_null=True).count() == 4


def test_compensation(spark):
    m = {"a": {"a": 1.0, "b": 0.25}, "b": {"a": 0.5, "b": 1.0}}
    assert merge.parse_spillover(merge.format_spillover(m)) == m
    truth = np.array([[3.0, 5.0]])
    seen = truth @ np.array([[1.0, 0.25], [0.5, 1.0]])
    df = spark.createDataFrame([(float(seen[0, 1]), float(seen[0, 0]))], "b double, a double")
    r = merge.compensate(df, m).first()
    assert (r["a"], r["b"]) == pytest.approx((3.0, 5.0))


def test_strategy_errors_and_empty_tags(objects):
    cat = Catalog().add_regions(Region("z", "line", (0.0, 1.0))).add_pops(Population("z", region="z", fx="missing"))
    with pytest.raises(ValueError, match="missing features"):
        apply_strategy(objects, Strategy(cat))
    tags = Strategy(Catalog().add_pops(Population("t", ids=(900,))))
    assert apply_strategy(objects, tags).objects_in("t").count() == 0
    assert apply_strategy(objects, tags, empty_as_all=True).objects_in("t").count() == 23


def test_gates_reach_the_scan(spark, tmp_path, objects):
    objects.df.write.parquet(str(tmp_path / "o"))
    o = Objects(spark.read.parquet(str(tmp_path / "o")), objects.catalog, objects.id_col)
    plan = o.members(["L"]).filter(member("L")).select("object_number")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [IsNotNull(a), GreaterThanOrEqual(a,0.0), LessThanOrEqual(a,9.0)]" in plan
    assert "ReadSchema: struct<object_number:bigint,a:double>" in plan


def test_few_and_many_values_between_bounds_finish_alike(spark, sf_dir, monkeypatch):
    from gatewise.operators import quantiles
    from gatewise.plans import statistics

    def results():
        out = [statistics.stats_feature(spark, sf_dir), statistics.stats_report(spark, sf_dir), statistics.stats_report_by_file(spark, sf_dir)]
        return [sorted(map(str, df.collect())) for df in out]

    few = results()
    monkeypatch.setattr(quantiles, "FEW", -1)
    assert results() == few
