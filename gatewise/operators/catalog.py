"""Definitions of features, regions, populations and graphs, and their edits.

A catalog never changes; every edit gives a new one. Removals and renames
cascade to all that depends on what they touch.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from ..functions.channels import default_feature_name, feature_parts
from ..functions.expressions import ARITHMETIC, LOGIC, names_in, tokens
from .gates import Region, expand, sync_problems
from .masks import Image, Mask, Masks, default_image

ALL = "All"


@dataclass(frozen=True)
class Feature:
    """``single`` (a column of the table; its definition may tell family, mask and
    image), ``combined`` (an expression) or ``computed`` (a column added by the caller)."""

    name: str
    type: str = "single"
    definition: str = ""

    def __post_init__(self):
        if not self.name or self.type not in ("single", "combined", "computed"):
            raise ValueError(f"feature {self.name!r}: bad name or type {self.type!r}")
        if self.type == "combined" and not self.definition:
            raise ValueError(f"feature {self.name!r}: a combined feature needs a definition")


@dataclass(frozen=True)
class Population:
    """``B`` all rows, ``G`` a region over fx (and fy), ``C`` a boolean definition,
    ``T`` tagged rows: ids (a short tuple), a table of ids, or a boolean column."""

    name: str
    base: str = ALL
    region: str = ""
    fx: str = ""
    fy: str = ""
    definition: str = ""
    ids: tuple[int, ...] | DataFrame | None = None
    column: str = ""
    color: str = "White"
    light_color: str = "Black"
    style: str = "Simple Dot"

    def __post_init__(self):
        if not self.name:
            raise ValueError("a population needs a name")
        if sum(map(bool, (self.region, self.definition, self.ids is not None, self.column))) > 1:
            raise ValueError(f"population {self.name!r}: give one of region, definition, ids and column")
        if self.region and not self.fx:
            raise ValueError(f"population {self.name!r}: a region needs fx")
        if isinstance(self.ids, tuple):
            if not self.ids:
                raise ValueError(f"population {self.name!r}: no ids")
            if len(set(self.ids)) < len(self.ids) or min(self.ids) < 0:
                raise ValueError(f"population {self.name!r}: ids are repeated or negative")

    @property
    def type(self) -> str:
        return "G" if self.region else "C" if self.definition else "T" if self.ids is not None or self.column else "B"


@dataclass(frozen=True)
class Graph:
    """What a plot shows: histogram (f1) or scatter and density (f1, f2)."""

    type: str
    f1: str
    f2: str = ""
    base: tuple[str, ...] = (ALL,)
    regions: tuple[str, ...] = ()
    shown: tuple[str, ...] = ()
    xtrans: str = "P"
    ytrans: str = "P"
    bins: int = 0
    limits: tuple[float, float, float, float] | None = None
    title: str = ""
    x: int = 0
    y: int = 0

    def __post_init__(self):
        if self.type not in ("histogram", "scatter", "density"):
            raise ValueError(f"unknown graph type {self.type!r}")
        if (self.type == "histogram") == bool(self.f2):
            raise ValueError(f"a {self.type} takes {'one feature' if self.type == 'histogram' else 'two features'}")
        if self.bins and not 8 <= self.bins <= 1024:
            raise ValueError("bins: 0, or 8 to 1024")
        if self.type == "density" and len(self.base) > 1:
            object.__setattr__(self, "base", self.base[:1])


@dataclass(frozen=True)
class ReportRow:
    """``statistic`` of ``population`` (and ``population2``) for ``feature``."""

    name: str
    statistic: str
    population: str
    feature: str = ""
    population2: str = ""

    def __post_init__(self):
        if self.statistic not in STATISTICS:
            raise ValueError(f"statistics {self.statistic!r} is not allowed; known: {', '.join(STATISTICS)}")


#: The statistics of reports.
STATISTICS = ("Count", "Mean", "%Total", "%Gated", "%", "Objects/mL", "RD - Mean", "Median", "CV", "stddev", "NaN", "MAD", "min", "RD - Median", "Variance", "max", "geomean", "Mode")


@dataclass(frozen=True)
class Removal:
    """What a removal takes away."""

    features: tuple[str, ...] = ()
    regions: tuple[str, ...] = ()
    pops: tuple[str, ...] = ()
    graphs: tuple[int, ...] = ()


@dataclass(frozen=True)
class Redefinition:
    """A catalog after a change of channels, images or masks, and from which feature
    each of its stored features takes its values."""

    catalog: Catalog
    columns: dict[str, str]


@dataclass(frozen=True)
class Catalog:
    features: dict[str, Feature] = field(default_factory=dict)
    regions: dict[str, Region] = field(default_factory=dict)
    pops: dict[str, Population] = field(default_factory=lambda: {ALL: Population(ALL, base="")})
    graphs: tuple[Graph, ...] = ()
    images: tuple[Image, ...] = ()
    masks: tuple[Mask, ...] = ()
    reports: tuple[ReportRow, ...] = ()
    #: What edits left out, for the caller to read.
    warnings: tuple[str, ...] = ()

    # ---- dependencies ------------------------------------------------------

    def feature_parents(self, name: str) -> list[str]:
        f = self.features[name]
        return names_in(f.definition, list(self.features), ARITHMETIC) if f.type == "combined" else []

    def pop_parents(self, name: str) -> list[str]:
        p = self.pops[name]
        if p.type == "B":
            return []
        if p.type == "C":
            return names_in(p.definition, list(self.pops), LOGIC) + [p.base] * (p.base not in ("", ALL))
        return [p.base]

    def feature_order(self) -> list[str]:
        return ordered(self.features, self.feature_parents)

    def pop_order(self) -> list[str]:
        return ordered(self.pops, self.pop_parents)

    def levels(self, deepest: bool = True) -> dict[str, int]:
        """Depth of each population below those without parents."""
        out: dict[str, int] = {}
        for name in self.pop_order():
            above = [out[p] for p in self.pop_parents(name)]
            out[name] = 1 + (max if deepest else min)(above) if above else 0
        return out

    def tree(self) -> str:
        """The hierarchy as indented text, by base."""
        children: dict[str, list[str]] = {}
        for name in self.pop_order():
            p = self.pops[name]
            children.setdefault("" if p.type == "B" else p.base or ALL, []).append(name)
        lines: list[str] = []

        def draw(name: str, depth: int) -> None:
            lines.append("  " * depth + ("" if not depth else "|-- ") + name)
            for child in children.get(name, []):
                draw(child, depth + 1)

        for root in children.get("", []):
            draw(root, 0)
        return "\n".join(lines)

    def edges(self) -> list[tuple[str, str]]:
        """(from, to) of the population network."""
        return [(p, name) for name in self.pop_order() for p in self.pop_parents(name)]

    def _axes(self, p: Population) -> tuple:
        r = self.regions[p.region]
        return p.fx, p.fy, r.xtrans, r.ytrans if p.fy else "", bool(p.fy)

    def siblings(self, names: Iterable[str], same_base: bool | None = None) -> list[str]:
        """Graphical populations on the axes of ``names``: of the same base (True),
        another one (False), or both, closed under the relation (None)."""
        graphical = [p for p in self.pops.values() if p.type == "G"]
        found = [n for n in dict.fromkeys(names) if self.pops[n].type == "G"]
        if same_base is not None:
            own = [self.pops[n] for n in found]
            return [p.name for p in graphical if any(self._axes(p) == self._axes(q) and (p.base == q.base) == same_base for q in own if same_base or p.name != q.name)]
        while True:
            more = [p.name for p in graphical if p.name not in found and any(self._axes(p) == self._axes(self.pops[n]) for n in found)]
            if not more:
                return found
            found += more

    # ---- additions ---------------------------------------------------------

    def _add(self, kind: str, items: Iterable, key) -> Catalog:
        have, notes = dict(getattr(self, kind)), list(self.warnings)
        for x in items:
            if key(x) in have:
                notes.append(f"{kind}: {key(x)!r} is there already and was not added")
            else:
                have[key(x)] = x
        return replace(self, **{kind: have}, warnings=tuple(notes))

    def add_features(self, *features: Feature) -> Catalog:
        out = self._add("features", features, lambda f: f.name)
        out.feature_order()
        return out

    def add_regions(self, *regions: Region) -> Catalog:
        out = self._add("regions", regions, lambda r: r.label)
        if wrong := sync_problems(list(out.regions.values())):
            keep = {k: replace(r, sync="") if r.sync and r.sync_name in wrong else r for k, r in out.regions.items()}
            out = replace(out, regions=keep, warnings=(*out.warnings, *(f"group {k!r} dissolved: {v}" for k, v in wrong.items())))
        return out

    def add_group(self, region: Region, kind: str, base: str = ALL, fx: str = "", fy: str = "") -> Catalog:
        """The parts of a dual or quad region and, given fx, their populations."""
        parts = expand(region, kind, [r.sync_name for r in self.regions.values()])
        out = self.add_regions(*parts)
        return out.add_pops(*(Population(r.label if base == ALL else f"{r.label} & {base}", base, region=r.label, fx=fx, fy=fy) for r in parts)) if fx else out

    def add_pops(self, *pops: Population) -> Catalog:
        out = self._add("pops", pops, lambda p: p.name)
        out.check()
        return out

    def add_graphs(self, *graphs: Graph) -> Catalog:
        return replace(self, graphs=(*self.graphs, *(g for x in graphs if (g := self.drawable(x)))))

    def check(self) -> None:
        """Raises on unknown names and cycles."""
        self.pop_order()
        for p in self.pops.values():
            if p.type == "G" and p.region not in self.regions:
                raise ValueError(f"population {p.name!r}: unknown region {p.region!r}")
            if p.type == "G" and self.regions[p.region].type != "line" and not p.fy:
                raise ValueError(f"population {p.name!r}: region {p.region!r} needs fy")

    def drawable(self, g: Graph) -> Graph | None:
        """``g`` without parts that are gone; None if it can't be drawn at all."""
        base = tuple(b for b in g.base if b in self.pops)
        if not base or (self.features and not {g.f1, *([g.f2] if g.f2 else [])} <= set(self.features)):
            return None
        return replace(g, base=base, regions=tuple(r for r in g.regions if r in self.regions), shown=tuple(p for p in g.shown if p in self.pops))

    # ---- removals ----------------------------------------------------------

    def removal(self, features: Iterable[str] = (), regions: Iterable[str] = (), pops: Iterable[str] = (), protected: Iterable[str] = ()) -> Removal:
        """What would go with these names: combined features, regions used on
        removed axes, group peers, populations on them and all that depend on those."""
        gone_f = {f for f in features if f in self.features and f not in set(protected)}
        for name in self.feature_order():
            if gone_f & set(self.feature_parents(name)):
                gone_f.add(name)
        gone_r = {r for r in regions if r in self.regions}
        gone_r |= {p.region for p in self.pops.values() if p.type == "G" and gone_f & {p.fx, p.fy}}
        groups = {self.regions[r].sync_name for r in gone_r if self.regions[r].sync}
        gone_r |= {r.label for r in self.regions.values() if r.sync and r.sync_name in groups}
        gone_p = {p for p in pops if p in self.pops and p != ALL}
        gone_p |= {p.name for p in self.pops.values() if p.type == "G" and (p.region in gone_r or gone_f & {p.fx, p.fy})}
        for name in self.pop_order():
            if gone_p & set(self.pop_parents(name)):
                gone_p.add(name)
        left = self._without(gone_f, gone_r, gone_p)
        graphs = tuple(i for i, g in enumerate(self.graphs) if not left.drawable(g) or {g.f1, g.f2} & gone_f)
        order = lambda have, gone: tuple(n for n in have if n in gone)
        return Removal(order(self.features, gone_f), order(self.regions, gone_r), order(self.pops, gone_p), graphs)

    def _without(self, f: Iterable[str], r: Iterable[str], p: Iterable[str]) -> Catalog:
        keep = lambda have, gone: {k: v for k, v in have.items() if k not in set(gone)}
        return replace(self, features=keep(self.features, f), regions=keep(self.regions, r), pops=keep(self.pops, p))

    def remove(self, what: Removal) -> Catalog:
        out = self._without(what.features, what.regions, what.pops)
        left = [g for i, g in enumerate(self.graphs) if i not in set(what.graphs)]
        return replace(out, graphs=tuple(g for x in left if (g := out.drawable(x))))

    def remove_graphs(self, places: Iterable[int]) -> Catalog:
        """Without the graphs at these places (from 0)."""
        gone = set(places)
        if bad := [i for i in gone if not 0 <= i < len(self.graphs)]:
            raise ValueError(f"no graphs at {sorted(bad)}")
        return replace(self, graphs=tuple(g for i, g in enumerate(self.graphs) if i not in gone))

    # ---- changes -----------------------------------------------------------

    def modify_regions(self, **changes: Region) -> Catalog:
        """New definitions by label; the type stays; peers of a group follow with
        vertices, transforms and colours; a new label is taken over by populations."""
        out = dict(self.regions)
        for label, new in changes.items():
            old = self.regions[label]
            if new.type != old.type:
                raise ValueError(f"region {label!r}: the type can't change")
            for other in self.regions.values():
                if other.label == label:
                    out[label] = replace(new, sync=old.sync)
                elif old.sync and other.sync_name == old.sync_name:
                    out[other.label] = replace(new, label=other.label, sync=other.sync)
        names = {k: r.label for k, r in out.items() if k != r.label}
        return replace(self, regions={r.label: r for r in out.values()})._relabel(names)

    def _relabel(self, names: Mapping[str, str]) -> Catalog:
        pops = {k: replace(p, region=names.get(p.region, p.region)) for k, p in self.pops.items()}
        graphs = tuple(replace(g, regions=tuple(names.get(r, r) for r in g.regions)) for g in self.graphs)
        out = replace(self, pops=pops, graphs=graphs)
        out.check()
        return out

    def modify_pops(self, **changes: Population) -> Catalog:
        """New definitions by name; type and name stay."""
        pops = dict(self.pops)
        for name, new in changes.items():
            if new.type != pops[name].type or new.name != name:
                raise ValueError(f"population {name!r}: name and type can't change here")
            pops[name] = new
        out = replace(self, pops=pops)
        out.check()
        return out

    def rename_pops(self, names: Mapping[str, str]) -> Catalog:
        """Renames populations in bases, definitions and graphs. A graphical
        population called ``region & base`` takes the new name of its base."""
        names = dict(names)
        if ALL in names or ALL in names.values():
            raise ValueError(f"{ALL!r} can't be renamed or given as a name")
        if unknown := set(names) - set(self.pops):
            raise ValueError(f"unknown populations {sorted(unknown)}")
        for name in self.pop_order():
            p = self.pops[name]
            if p.type == "G" and name not in names and p.base in names and name == f"{p.region} & {p.base}":
                names[name] = f"{p.region} & {names[p.base]}"
        if len({names.get(n, n) for n in self.pops}) < len(self.pops):
            raise ValueError("two populations would have one name")
        pops = {}
        for name, p in self.pops.items():
            definition = "|".join(names.get(t, t) for t in tokens(p.definition, list(self.pops), LOGIC)) if p.definition else ""
            pops[names.get(name, name)] = replace(p, name=names.get(name, name), base=names.get(p.base, p.base), definition=definition)
        swap = lambda xs: tuple(names.get(x, x) for x in xs)
        graphs = tuple(replace(g, base=swap(g.base), shown=swap(g.shown)) for g in self.graphs)
        reports = tuple(replace(r, population=names.get(r.population, r.population), population2=names.get(r.population2, r.population2)) for r in self.reports)
        out = replace(self, pops=pops, graphs=graphs, reports=reports)
        out.check()
        return out

    def rename_features(self, names: Mapping[str, str]) -> Catalog:
        """Renames features in definitions, populations and graphs; a feature whose
        new name another has already is dropped."""
        features: dict[str, Feature] = {}
        for name, f in self.features.items():
            definition = "|".join(names.get(t, t) for t in tokens(f.definition, list(self.features), ARITHMETIC, numbers=True)) if f.type == "combined" else f.definition
            new = names.get(name, name)
            if new not in features and not (new != name and new in self.features and new not in names):
                features[new] = replace(f, name=new, definition=definition)
        pops = {k: replace(p, fx=names.get(p.fx, p.fx), fy=names.get(p.fy, p.fy)) for k, p in self.pops.items()}
        graphs = tuple(replace(g, f1=names.get(g.f1, g.f1), f2=names.get(g.f2, g.f2)) for g in self.graphs)
        reports = tuple(replace(r, feature=names.get(r.feature, r.feature)) for r in self.reports)
        return replace(self, features=features, pops=pops, graphs=graphs, reports=reports)

    # ---- images and masks ----------------------------------------------------

    def add_images(self, *images: Image) -> Catalog:
        out = replace(self, images=tuple(sorted((*self.images, *images), key=lambda i: i.channel)))
        for what in ("name", "channel"):
            if len({getattr(i, what) for i in out.images}) < len(out.images):
                raise ValueError(f"two images have one {what}")
        return out

    def add_masks(self, *masks: Mask) -> Catalog:
        """Masks over the images of the catalog; all must be well defined."""
        have = {m.name for m in self.masks}
        notes = tuple(f"masks: {m.name!r} is there already and was not added" for m in masks if m.name in have)
        out = replace(self, masks=(*self.masks, *(m for m in masks if m.name not in have)), warnings=(*self.warnings, *notes))
        out.mask_table()
        return out

    def mask_table(self) -> Masks:
        return Masks(self.masks, self.images)

    def definition_of(self, name: str) -> list[str]:
        """Family, masks, images and scalars of a single feature, from its definition
        or, without one, from its name."""
        f = self.features[name]
        if f.definition:
            return f.definition.split("|")
        masks = {m.name for m in self.masks} | {f"M{i.channel:02d}" for i in self.images}
        return [x for x in feature_parts(name, masks, {i.name for i in self.images}) if x]

    def redefine(self, images: Mapping[str, str] | None = None, masks: Mapping[str, str] | None = None, all_default: bool = False, merge: bool = True) -> Redefinition:
        """Other names for images and masks, in all that depends on them: masks of
        masks, single features, combined features, populations and graphs.

        Features and masks with default names take the names that their new
        definitions give (``all_default``: so do all others). Of features that get one
        name, one that was changed stays; ``merge`` False makes that an error.
        """
        images = dict(images or {})
        table = self.mask_table()
        new_masks, mask_names = table.redefined(masks, images, all_default)
        leaf = {**images, **mask_names}
        names: dict[str, str] = {}
        made: dict[str, Feature] = {}
        for name in self.feature_order():
            f = self.features[name]
            if f.type == "combined":
                old = tokens(f.definition, list(self.features), ARITHMETIC, numbers=True)
                parts = [names.get(t, t) for t in old]
                default = default_feature_name("|".join(old), True)
            else:
                old = self.definition_of(name)
                parts = [leaf.get(t, t) for t in old]
                default = default_feature_name("|".join(old))
            definition = "|".join(parts)
            follows = (all_default and f.type == "combined") or name == default or (all_default and bool(f.definition))
            names[name] = default_feature_name(definition, f.type == "combined") if follows else name
            made[name] = replace(f, name=names[name], definition=definition if f.definition else "")
        features, columns = {}, {}
        for name in self.features:  # of two with one name the changed one stays
            new = names[name]
            if new in features and not merge:
                raise ValueError(f"two features would be named {new!r}")
            changed = new != name or made[name].definition != self.features[name].definition
            if new not in features or changed:
                features[new] = made[name]
                columns[new] = name
        columns = {k: v for k, v in columns.items() if features[k].type != "combined"}
        pops = {k: replace(p, fx=names.get(p.fx, p.fx), fy=names.get(p.fy, p.fy)) for k, p in self.pops.items()}
        graphs = tuple(replace(g, f1=names.get(g.f1, g.f1), f2=names.get(g.f2, g.f2)) for g in self.graphs)
        reports = tuple(replace(r, feature=names.get(r.feature, r.feature)) for r in self.reports)
        out = replace(self, features=features, pops=pops, graphs=graphs, reports=reports, masks=new_masks, images=tuple(replace(i, name=images.get(i.name, i.name)) for i in self.images))
        out.feature_order()
        return Redefinition(out, columns)

    def with_default_names(self) -> Redefinition:
        """Every mask and feature by the name that its definition gives it."""
        return self.redefine(all_default=True)

    def _with_channels(self, channels: Iterable[int], brightfield: bool, mode: int) -> Catalog:
        """The catalog with default images for channels that it lacks, which join the mask of all channels."""
        out = self
        for c in channels:
            if c not in {i.channel for i in out.images}:
                out = out.add_images(default_image(c, brightfield, mode))
        if out.images != self.images:
            every = "|Or|".join(f"M{i.channel:02d}" for i in out.images)
            out = replace(out, masks=tuple(replace(m, definition=every) if m.name == "MC" else m for m in out.masks))
        return out

    def _moved(self, channels: Mapping[int, int], brightfield: bool, mode: int) -> Redefinition:
        cat = self._with_channels(sorted({*channels, *channels.values()}), brightfield, mode)
        image = {i.channel: i.name for i in cat.images}
        leaf = {image[a]: image[b] for a, b in channels.items()}
        own = {f"M{a:02d}": f"M{b:02d}" for a, b in channels.items()}
        # Images keep their names and places: what refers to them moves.
        done = cat.redefine(leaf, own)
        out = replace(done.catalog, images=cat.images)
        used = {t for n, f in out.features.items() if f.type != "combined" for t in out.definition_of(n)}
        return Redefinition(replace(out, masks=out.mask_table().needed(used)), done.columns)

    def switch_channel(self, source: int, target: int, brightfield: bool = True, mode: int = 1) -> Redefinition:
        """All that refers to channel ``source`` refers to ``target``; what was there under
        the same name gives way. Channels without an image get a default one."""
        if source == target:
            raise ValueError("two different channels are needed")
        return self._moved({source: target}, brightfield, mode)

    def swap_channels(self, one: int, other: int, brightfield: bool = True, mode: int = 1) -> Redefinition:
        """Channels ``one`` and ``other`` in each other's place, in all that refers to them."""
        if one == other:
            raise ValueError("two different channels are needed")
        return self._moved({one: other, other: one}, brightfield, mode)


def ordered(items: Mapping[str, object], parents) -> list[str]:
    """Names with all parents ahead, otherwise in the given order. Unknown parents
    and cycles are errors."""
    out: dict[str, None] = {}
    for start in items:
        stack, path = [(start, None)], []
        while stack:
            name, below = stack[-1]
            if name in out:
                stack.pop()
                continue
            if below is None:
                if name in path:
                    raise ValueError(f"cycle through {' > '.join([*path[path.index(name):], name])}")
                if name not in items:
                    raise ValueError(f"unknown name {name!r}" + (f" in {path[-1]!r}" if path else ""))
                path.append(name)
                stack[-1] = (name, True)
                stack += [(p, None) for p in reversed(parents(name)) if p not in out]
            else:
                path.pop()
                out[name] = None
                stack.pop()
    return list(out)
