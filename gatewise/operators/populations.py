"""Object tables with a catalog: features and population memberships as columns."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import expressions
from ..functions.transforms import parse, transform
from .catalog import ALL, Catalog, Feature, Population, Redefinition, Removal
from .gates import EPSILON, gate

MARK = "pop::"


def member(name: str) -> Column:
    """The membership column of a population."""
    return F.col(f"`{MARK}{name.replace('`', '``')}`")


def named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def first_hashed(rows: DataFrame, order: Column, ties: Sequence[Column], n: int) -> DataFrame:
    """The ``n`` rows that come first by the hash ``order`` (long), then ``ties``.

    Counts of 65,536 ranges of hashes say which of them are in whole; only the last
    one is put in order, so no task holds ``n`` rows.
    """
    at = rows.withColumn("_order", order).withColumn("_range", F.shiftright("_order", 48))
    upto = F.sum("count").over(Window.orderBy("_range"))  # a row per range
    counts = at.groupBy("_range").count().select("_range", upto.alias("upto"))
    last = counts.agg(F.min(F.when(F.col("upto") >= n, F.col("_range"))).alias("_last"), F.coalesce(F.max(F.when(F.col("upto") < n, F.col("upto"))), F.lit(0)).alias("_ahead"))
    placed = at.join(F.broadcast(last))  # one row
    whole = placed.filter(F.col("_last").isNull() | (F.col("_range") < F.col("_last")))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_order", *ties))
    edge = placed.filter(F.col("_range") == F.col("_last")).withColumn("_place", place).filter(F.col("_place") <= n - F.col("_ahead"))
    return whole.select(*(named(c) for c in rows.columns)).unionByName(edge.select(*(named(c) for c in rows.columns)))


@dataclass(frozen=True)
class Objects:
    """Rows of objects and their definitions.

    ``id_col`` (0-based) names an object, together with ``file_col`` where
    several files are merged. All features are read as doubles. ``eps``: which points
    lie on polygons' sides, as in ``gate``.
    """

    df: DataFrame
    catalog: Catalog = field(default_factory=Catalog)
    id_col: str = "object_number"
    file_col: str | None = None
    eps: float | None = EPSILON

    @classmethod
    def of(cls, df: DataFrame, id_col: str = "object_number", file_col: str | None = None, features: Sequence[str] | None = None) -> Objects:
        """Numeric columns, or the named ones, as single features."""
        numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
        names = features or [n for n, t in df.dtypes if (t in numeric or t.startswith("decimal")) and n not in (id_col, file_col)]
        return cls(df, Catalog().add_features(*(Feature(n) for n in names)), id_col, file_col)

    def edit(self, catalog: Catalog) -> Objects:
        return replace(self, catalog=catalog)

    def add_features(self, *features: Feature) -> Objects:
        """Defines features; ``single`` and ``computed`` ones must be columns."""
        have = set(self.df.columns)
        if missing := [f.name for f in features if f.type != "combined" and f.name not in have]:
            raise ValueError(f"no column for features {missing}")
        return self.edit(self.catalog.add_features(*features))

    def add_regions(self, *regions) -> Objects:
        return self.edit(self.catalog.add_regions(*regions))

    def add_pops(self, *pops: Population) -> Objects:
        for p in pops:
            if missing := {p.fx, p.fy} - {""} - set(self.catalog.features):
                raise ValueError(f"population {p.name!r}: unknown features {sorted(missing)}")
        return self.edit(self.catalog.add_pops(*pops))

    def remove(self, features: Iterable[str] = (), regions: Iterable[str] = (), pops: Iterable[str] = (), list_only: bool = True) -> Removal | Objects:
        """What would go (``list_only``), or the table without it. The id stays."""
        what = self.catalog.removal(features, regions, pops, protected=(self.id_col,))
        if list_only:
            return what
        gone = [named(f) for f in what.features if f in self.df.columns]
        return replace(self, df=self.df.drop(*gone), catalog=self.catalog.remove(what))

    def rename_features(self, names: dict[str, str]) -> Objects:
        taken = {n: k for n, k in names.items() if k not in self.df.columns}
        return replace(self, df=self.df.withColumnsRenamed(taken), catalog=self.catalog.rename_features(names))

    def redefined(self, change: Redefinition) -> Objects:
        """The table with the features that ``change`` (``catalog.redefine``,
        ``switch_channel``, ``swap_channels`` or ``with_default_names``) names, each with the
        values of the feature that it comes from. The id stays."""
        stored = {n for n, f in self.catalog.features.items() if f.type != "combined" and n in self.df.columns}
        rest = [named(c) for c in self.df.columns if c not in stored or c in (self.id_col, self.file_col)]
        own = [named(old).alias(new) for new, old in change.columns.items() if old in stored and new not in (self.id_col, self.file_col)]
        return replace(self, df=self.df.select(*rest, *own), catalog=change.catalog)

    # ---- columns -------------------------------------------------------------

    def values(self, names: Iterable[str] | None = None, base: DataFrame | None = None) -> DataFrame:
        """The table with the combined features it lacks (those that ``names``
        need, or all), one projection per depth of dependency."""
        cat, df = self.catalog, self.df if base is None else base
        need = set(cat.features if names is None else (n for n in names if n in cat.features))
        order = cat.feature_order()
        for name in reversed(order):
            if name in need:
                need |= set(cat.feature_parents(name))
        depth: dict[str, int] = {}
        for name in order:
            if name in need and cat.features[name].type == "combined":
                depth[name] = 1 + max((depth.get(p, 0) for p in cat.feature_parents(name)), default=0)
        columns = {n: named(n).cast("double") for n in cat.features}
        for level in sorted(set(depth.values())):
            df = df.withColumns({n: expressions.feature(cat.features[n].definition, columns) for n, d in depth.items() if d == level})
        return df

    def members(self, names: Iterable[str] | None = None, keep: Iterable[str] = ()) -> DataFrame:
        """The table with a boolean column ``pop::name`` for each population in
        ``names`` (or all) and the combined features they or ``keep`` need.

        Gates run in one projection per depth of the hierarchy, on transformed
        axes that are computed once. Tagged tables of ids join on the object.
        """
        cat = self.catalog
        cat.check()
        wanted = list(cat.pops) if names is None else list(names)
        if unknown := [n for n in wanted if n not in cat.pops]:
            raise ValueError(f"unknown populations {unknown}")
        need = set(wanted)
        for name in reversed(cat.pop_order()):
            if name in need:
                need |= set(cat.pop_parents(name))
        pops = [cat.pops[n] for n in cat.pop_order() if n in need]
        axes = {a for p in pops for a in (p.fx, p.fy) if a}
        df = self.values(axes | set(keep))
        before = df.columns
        scaled: dict[tuple[str, str], str] = {}
        for p in pops:
            if p.type == "G" and cat.regions[p.region].type in ("oval", "poly"):
                r = cat.regions[p.region]
                for a, t in ((p.fx, r.xtrans), (p.fy, r.ytrans)):
                    if parse(t)[0] != "return":
                        scaled.setdefault((a, t), f"axis::{len(scaled)}")
        if scaled:
            df = df.withColumns({c: transform(named(a).cast("double"), t) for (a, t), c in scaled.items()})
        for p in pops:
            if isinstance(p.ids, DataFrame):
                df = self._tagged(df, p)
        level = {n: d for n, d in cat.levels().items() if n in need}
        for d in sorted(set(level.values())):
            df = df.withColumns({MARK + p.name: self._belongs(p, scaled) for p in pops if level[p.name] == d})
        return df.select(*(named(c) for c in before if not c.startswith(MARK)), *(member(n) for n in wanted))

    def _belongs(self, p: Population, scaled: dict) -> Column:
        if p.type == "B":
            return F.lit(True)
        base = member(p.base) if p.base not in ("", ALL) else F.lit(True)
        if p.type == "C":
            return base & expressions.boolean(p.definition, {n: member(n) if n != ALL else F.lit(True) for n in self.catalog.pops})
        if p.type == "T":
            if p.column:
                own = F.coalesce(named(p.column).cast("boolean"), F.lit(False))
            elif isinstance(p.ids, tuple):
                own = F.coalesce(named(self.id_col).isin(*p.ids), F.lit(False))
            else:
                own = named(f"tag::{p.name}")
            return base & own
        region = self.catalog.regions[p.region]
        x, y = (named(a).cast("double") if a else None for a in (p.fx, p.fy))
        held = [scaled.get(at) for at in ((p.fx, region.xtrans), (p.fy, region.ytrans))]
        tx, ty = (named(c) if c else None for c in held)
        return base & gate(region, x, y, self.eps, tx=tx, ty=ty)

    def _tagged(self, df: DataFrame, p: Population) -> DataFrame:
        keys = [c for c in (self.file_col, self.id_col) if c and c in p.ids.columns]
        ids = p.ids.select(*(named(k).alias(f"{k}::tag") for k in keys)).distinct().withColumn(f"tag::{p.name}", F.lit(True))
        on = reduce(lambda a, b: a & b, (named(k) == named(f"{k}::tag") for k in keys))
        out = df.join(ids, on, "left").drop(*(named(f"{k}::tag") for k in keys))
        return out.withColumn(f"tag::{p.name}", F.coalesce(named(f"tag::{p.name}"), F.lit(False)))

    # ---- questions -----------------------------------------------------------

    def objects_in(self, pop: str) -> DataFrame:
        """Ids of a population."""
        keys = [c for c in (self.file_col, self.id_col) if c]
        return self.members([pop]).filter(member(pop)).select(*(named(k) for k in keys))

    def any_of(self, pops: Sequence[str]) -> DataFrame:
        """Rows in at least one of the populations."""
        return self.members(pops).filter(reduce(lambda a, b: a | b, map(member, pops))).drop(*(MARK + p for p in pops))

    def copy_pops(self, into: Objects, pops: Sequence[str], shift: int = 0, suffix: str = "") -> Objects:
        """Populations of this table as tagged ones of another, ids moved by ``shift``."""
        found = [Population(f"{p}{suffix}", ids=self.objects_in(p).select((named(self.id_col) + shift).alias(into.id_col))) for p in pops]
        return into.add_pops(*found)

    def add_sample(self, pop: str, size: int, name: str | None = None, seed: int = 1) -> Objects:
        """A tagged population of ``size`` objects of ``pop`` without repeats, the
        first of a seeded hashed order (all if there are fewer)."""
        keys = [named(c) for c in (self.file_col, self.id_col) if c]
        ids = first_hashed(self.objects_in(pop).distinct(), F.xxhash64(*keys, F.lit(seed)), keys, size)
        return self.add_pops(Population(name or f"sample_{size} {pop}", base=pop, ids=ids))

    def add_file_pops(self, values: Sequence[str]) -> Objects:
        """One tagged population per file of a merged table."""
        df = self.df.withColumns({f"from::{v}": F.coalesce(named(self.file_col) == v, F.lit(False)) for v in values})
        return replace(self, df=df).add_pops(*(Population(v, column=f"from::{v}") for v in values))

    def rebuilt_ids(self, changing: Sequence[str], order: str, name: str = "object_number") -> DataFrame:
        """Unique 0-based ids per file: the count of rows so far in which any of
        ``changing`` differs from the row before, in the order of ``order`` (long)."""
        return rebuilt_ids(self.df, changing, order, self.file_col, name)


def rebuilt_ids(df: DataFrame, changing: Sequence[str], order: str, file_col: str | None = None, name: str = "object_number", span: int = 1 << 17) -> DataFrame:
    """See ``Objects.rebuilt_ids``. Rows fall into spans of ``order``; each span is
    numbered in a task of its own, and only one row per span (its first and last
    values and its count) is put in sequence, so no task holds a file."""
    key = [named(file_col)] if file_col else []
    part = F.floor(named(order) / span).cast("long")
    now = F.struct(*(named(c).alias(f"v{i}") for i, c in enumerate(changing)))
    rows = df.withColumn("_part", part).withColumn("_now", now)
    inside = Window.partitionBy(*key, "_part").orderBy(named(order))
    before = F.lag("_now").over(inside)
    rows = rows.withColumn("_step", F.when(before.isNull() | before.eqNullSafe(F.col("_now")), 0).otherwise(1))
    rows = rows.withColumn("_in", F.sum("_step").over(inside))
    ends = rows.groupBy(*key, "_part").agg(F.min_by("_now", named(order)).alias("first"), F.max_by("_now", named(order)).alias("last"), F.sum("_step").alias("steps"))
    along = Window.partitionBy(*key).orderBy("_part")
    last = F.lag("last").over(along)
    ends = ends.withColumn("enter", F.when(last.isNull() | last.eqNullSafe(F.col("first")), 0).otherwise(1))
    ends = ends.withColumn("ahead", F.sum(F.col("enter") + F.col("steps")).over(along) - F.col("steps"))
    ends = ends.select(*key, "_part", "ahead")
    joined = rows.join(ends, [*([file_col] if file_col else []), "_part"])
    return joined.withColumn(name, (F.col("_in") + F.col("ahead")).cast("long")).drop("_part", "_now", "_step", "_in", "ahead")


@dataclass(frozen=True)
class Strategy:
    """Gates to reuse: spillover, regions, populations and graphs."""

    catalog: Catalog
    spillover: dict[str, dict[str, float]] | None = None


def apply_strategy(objects: Objects, strategy: Strategy, keep: Sequence[str] = (), empty_as_all: bool = False) -> Objects:
    """``objects`` compensated and gated by ``strategy``; populations in ``keep``
    stay those of ``objects``. With ``empty_as_all`` a tagged population that
    matches no object becomes all objects."""
    from .merge import compensate

    cat = strategy.catalog
    gone = cat.removal(pops=[p for p in keep if p in objects.catalog.pops and p in cat.pops])
    dropped = set(gone.pops) - set(keep)
    pops = {n: p for n, p in cat.pops.items() if n not in set(keep) & set(objects.catalog.pops) and n not in dropped}
    pops |= {n: objects.catalog.pops[n] for n in keep if n in objects.catalog.pops}
    regions = objects.catalog.regions | cat.regions
    missing = sorted({a for p in pops.values() for a in (p.fx, p.fy) if a} - set(objects.catalog.features) - set(cat.features))
    if missing:
        raise ValueError(f"missing features {missing}")
    features = objects.catalog.features | {n: f for n, f in cat.features.items() if f.type == "combined"}
    out = replace(objects, catalog=Catalog(features, regions, pops, cat.graphs))
    if strategy.spillover:
        out = replace(out, df=compensate(out.df, strategy.spillover))
    if empty_as_all:
        for p in pops.values():
            if p.type == "T" and p.name not in keep and out.objects_in(p.name).isEmpty():
                pops[p.name] = Population(p.name, base=p.base, definition=ALL)
        out = out.edit(replace(out.catalog, pops=pops))
    out.catalog.check()
    return out
