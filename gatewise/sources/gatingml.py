"""GatingML 2.0: regions, populations and spectrum matrices to and from XML.

What the standard has no place for (transforms, group marks, colours) goes into
``custom_info``.
"""

from __future__ import annotations

import json
import math
import xml.etree.ElementTree as ET

from ..operators.catalog import ALL, Catalog, Population
from ..operators.gates import Region, half, quarter
from ..operators.populations import Strategy

BASE = "http://www.isac-net.org/std/Gating-ML/v2.0/"
G, D, T = f"{{{BASE}gating}}", f"{{{BASE}datatypes}}", f"{{{BASE}transformations}}"
for prefix, name in (("gating", "gating"), ("data-type", "datatypes"), ("transforms", "transformations")):
    ET.register_namespace(prefix, BASE + name)


def _custom(node: ET.Element) -> dict:
    found = node.find(f"{D}custom_info")
    try:
        return json.loads(found.text) if found is not None and found.text else {}
    except ValueError:
        return {}


def _dimensions(node: ET.Element, kind: str = "dimension") -> list[tuple[str, ET.Element]]:
    out = []
    for d in node.findall(G + kind):
        name = d.find(f"{D}fcs-dimension")
        if name is None:
            name = d.find(f"{D}new-dimension")
        if name is None:
            raise ValueError(f"a {kind} has no name")
        out.append((name.get(f"{D}name") or name.get(f"{D}transformation-ref"), d))
    if not 1 <= len(out) <= 2:
        raise ValueError(f"{len(out)} dimensions; one or two can be used")
    return out


def _values(node: ET.Element) -> list[float]:
    return [float(c.get(f"{D}value")) for c in node.findall(f"{G}coordinate")]


def _gate(node: ET.Element) -> list[tuple[Region | None, Population]]:
    kind, name, base = node.tag.removeprefix(G), node.get(f"{G}id"), node.get(f"{G}parent_id") or ALL
    more = _custom(node)
    look = {k: more[k] for k in ("xtrans", "ytrans", "sync", "color", "lightcolor") if k in more}
    label = more.get("region", name)
    if kind == "BooleanGate":
        op = next(c for c in node if c.tag in (G + "and", G + "or", G + "not"))
        refs = []
        for r in op.findall(f"{G}gateReference"):
            used = r.get(f"{G}ref")
            refs.append(f"(|Not|{used}|)" if r.get(f"{G}use-as-complement") == "true" else used)
        word = op.tag.removeprefix(G).capitalize()
        if word == "Not" and len(refs) != 1:
            raise ValueError(f"gate {name!r}: not takes one operand")
        return [(None, Population(name, definition=more.get("definition") or (f"Not|{refs[0]}" if word == "Not" else f"|{word}|".join(refs))))]
    if kind == "RectangleGate":
        dims = _dimensions(node)
        bounds = [(float(d.get(f"{G}min", -math.inf)), float(d.get(f"{G}max", math.inf))) for _, d in dims]
        x, y = (more[k] if k in more else b for k, b in zip(("x", "y"), [*bounds, (0.0, 0.0)][:2]))
        shape = Region(label, "line" if len(dims) == 1 else "rect", tuple(map(float, x)), tuple(map(float, y)), **look)
    elif kind == "PolygonGate":
        dims = _dimensions(node)
        points = [_values(v) for v in node.findall(f"{G}vertex")]
        shape = Region(label, "poly", tuple(p[0] for p in points), tuple(p[1] for p in points), **look)
    elif kind == "EllipsoidGate":
        dims = _dimensions(node)
        mean = _values(node.find(f"{G}mean"))
        cov = [[float(e.get(f"{D}value")) for e in r.findall(f"{G}entry")] for r in node.find(f"{G}covarianceMatrix").findall(f"{G}row")]
        if len(mean) != 2 or abs(cov[0][1]) > 1e-9 * math.sqrt(cov[0][0] * cov[1][1]):
            raise ValueError(f"gate {name!r}: only ellipses along the axes can be used")
        far = float(node.find(f"{G}distanceSquare").get(f"{D}value"))
        rx, ry = math.sqrt(cov[0][0] * far), math.sqrt(cov[1][1] * far)
        x, y = (mean[0] - rx, mean[0] + rx), (mean[1] - ry, mean[1] + ry)
        shape = Region(label, "oval", tuple(more.get("x", x)), tuple(more.get("y", y)), **look)
    elif kind == "QuadrantGate":
        dims = _dimensions(node, "divider")
        at = {d.get(f"{G}id"): float(d.find(f"{G}value").text) for _, d in dims}
        ids = [d.get(f"{G}id") for _, d in dims]
        (x0, y0), out = (at[i] for i in ids), []
        for q in node.findall(f"{G}Quadrant"):
            side = {p.get(f"{G}divider_ref"): float(p.get(f"{G}location")) for p in q.findall(f"{G}position")}
            right, upper = side[ids[0]] >= x0, side[ids[1]] >= y0
            part = {(False, True): 1, (True, True): 2, (True, False): 3, (False, False): 4}[right, upper]
            qid = q.get(f"{G}id")
            region = Region(qid, "rect", (x0, x0), (y0, y0), sync=f"quad_{name}|{part}")
            if len(node.findall(f"{G}Quadrant")) != 4:  # no whole group: a rectangle that ends just below the divider
                bounds = [(lo, math.nextafter(hi, -math.inf) if math.isfinite(hi) else hi) for lo, hi in quarter(x0, y0, part)]
                region = Region(qid, "rect", *bounds)
            out.append((region, Population(qid, base, region=qid, fx=dims[0][0], fy=dims[1][0])))
        return out
    else:
        raise ValueError(f"unknown gate {kind!r}")
    return [(shape, Population(name, base, region=label, fx=dims[0][0], fy=dims[1][0] if len(dims) == 2 else ""))]


def parse(text: str | bytes) -> Strategy:
    """The regions, populations and spillover of a GatingML document."""
    root = ET.fromstring(text)
    spill = None
    for m in root.iter(f"{T}spectrumMatrix"):
        flu, det = ([d.get(f"{D}name") for d in m.find(T + k).iter(f"{D}fcs-dimension")] for k in ("fluorochromes", "detectors"))
        rows = [[float(c.get(f"{T}value")) for c in r.findall(f"{T}coefficient")] for r in m.findall(f"{T}spectrum")]
        if m.get(f"{T}matrix-inverted-already") == "true":
            import numpy as np

            rows = np.linalg.inv(np.array(rows)).tolist()
        names = det if set(det) else flu
        spill = {a: dict(zip(names, r)) for a, r in zip(names, rows)}
    regions, pops = {}, {}
    for node in root:
        if node.tag.startswith(G) and node.tag.endswith("Gate"):
            for region, pop in _gate(node):
                if region is not None:
                    regions.setdefault(region.label, region)
                pops[pop.name] = pop
    tags = _custom(root).get("tagged", {})
    pops |= {n: Population(n, ids=tuple(ids)) for n, ids in tags.items()}
    return Strategy(Catalog().add_regions(*regions.values()).add_pops(*pops.values()), spill)


def read_gating(spark, path: str) -> Strategy:
    """A strategy from a file in any store that Spark reads."""
    return parse(bytes(spark.read.format("binaryFile").load(path).first()["content"]))


def _dimension(parent: ET.Element, name: str, lo: float | None = None, hi: float | None = None) -> None:
    d = ET.SubElement(parent, f"{G}dimension", {f"{G}compensation-ref": "uncompensated"})
    if lo is not None and lo > -math.inf:
        d.set(f"{G}min", repr(lo))
    if hi is not None and hi < math.inf:
        d.set(f"{G}max", repr(hi))
    ET.SubElement(d, f"{D}fcs-dimension", {f"{D}name": name})


def _point(parent: ET.Element, tag: str, values: tuple[float, ...], entry: str = "coordinate") -> None:
    v = ET.SubElement(parent, G + tag)
    for x in values:
        ET.SubElement(v, G + entry, {f"{D}value": repr(float(x))})


def render(strategy: Strategy) -> str:
    """The GatingML document of a strategy. Boolean definitions become gates on
    references where they are one operator over names; the text itself is kept
    in ``custom_info``, as are short lists of tagged ids."""
    from ..functions.expressions import LOGIC, tokens

    cat = strategy.catalog
    root = ET.Element(f"{G}Gating-ML")
    tags = {p.name: list(p.ids) for p in cat.pops.values() if isinstance(p.ids, tuple)}
    if tags:
        ET.SubElement(root, f"{D}custom_info").text = json.dumps({"tagged": tags})
    if strategy.spillover:
        m = ET.SubElement(root, f"{T}spectrumMatrix", {f"{T}id": "spill", f"{T}matrix-inverted-already": "false"})
        for k in ("fluorochromes", "detectors"):
            at = ET.SubElement(m, T + k)
            for n in strategy.spillover:
                ET.SubElement(at, f"{D}fcs-dimension", {f"{D}name": n})
        for row in strategy.spillover.values():
            s = ET.SubElement(m, f"{T}spectrum")
            for n in strategy.spillover:
                ET.SubElement(s, f"{T}coefficient", {f"{T}value": repr(float(row[n]))})
    for name in cat.pop_order():
        p = cat.pops[name]
        ids = {f"{G}id": name} | ({f"{G}parent_id": p.base} if p.base not in ("", ALL) else {})
        if p.type == "C":
            node = ET.SubElement(root, f"{G}BooleanGate", ids)
            found = tokens(p.definition, list(cat.pops), LOGIC)
            words = {t for t in found if t in ("And", "Or")}
            op = "not" if found[0] == "Not" else (words.pop().lower() if len(words) == 1 else "and")
            at = ET.SubElement(node, G + op)
            for t in dict.fromkeys(t for t in found if t in cat.pops):
                ET.SubElement(at, f"{G}gateReference", {f"{G}ref": t})
            ET.SubElement(node, f"{D}custom_info").text = json.dumps({"definition": p.definition})
        if p.type != "G":
            continue
        r = cat.regions[p.region]
        more = {"region": r.label, "xtrans": r.xtrans, "ytrans": r.ytrans, "sync": r.sync, "color": r.color, "lightcolor": r.lightcolor}
        if r.type in ("line", "rect"):
            node = ET.SubElement(root, f"{G}RectangleGate", ids)
            bx, by = (min(r.x), max(r.x)), (min(r.y), max(r.y))
            if r.sync_kind == "dual":
                bx = half(r.x[0], r.sync_part)
            if r.sync_kind == "quad":
                bx, by = quarter(r.x[0], r.y[0], r.sync_part)
            _dimension(node, p.fx, *bx)
            if r.type == "rect":
                _dimension(node, p.fy, *by)
            more |= {"x": r.x, "y": r.y}
        elif r.type == "poly":
            node = ET.SubElement(root, f"{G}PolygonGate", ids)
            _dimension(node, p.fx)
            _dimension(node, p.fy)
            for x, y in zip(r.x, r.y):
                _point(node, "vertex", (x, y))
        else:
            node = ET.SubElement(root, f"{G}EllipsoidGate", ids)
            _dimension(node, p.fx)
            _dimension(node, p.fy)
            rx, ry = (r.x[1] - r.x[0]) / 2, (r.y[1] - r.y[0]) / 2
            _point(node, "mean", (r.x[0] + rx, r.y[0] + ry))
            c = ET.SubElement(node, f"{G}covarianceMatrix")
            _point(c, "row", (rx * rx, 0.0), "entry")
            _point(c, "row", (0.0, ry * ry), "entry")
            ET.SubElement(node, f"{G}distanceSquare", {f"{D}value": "1"})
            more |= {"x": r.x, "y": r.y}
        ET.SubElement(node, f"{D}custom_info").text = json.dumps(more)
    return ET.tostring(root, encoding="unicode")
