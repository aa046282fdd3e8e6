"""Analysis files (DAF): an XML head with definitions and, after it, features and
image rows in binary (or in the XML itself).

Read through ``binaryFile`` like FCS files. The head's definitions become a
catalog; features a table with a double per feature.
"""

from __future__ import annotations

import math
import re
import struct
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import ALL, Catalog, Feature, Graph, Population, ReportRow
from ..operators.gates import Region, half, quarter
from ..operators.populations import Objects
from .fcs import BLOCK, _files, _short
from .parts import write_parts
from .run import add_definitions, image_definitions, mask_definitions

OBJECT = "Object Number"
#: What ends the head of an analysis file, or of a template.
END, TEMPLATE_END = b"</Assay>", b"</AssayTemplate>"
CHANNEL_LISTS = ("bgstd", "bgmean", "satcount", "satpercent")


def split(data: bytes) -> tuple[ET.Element, bytes]:
    """The parsed head and what follows it."""
    at = data.find(END)
    if at < 0:
        raise ValueError("no analysis file: </Assay> is missing")
    at += len(END)
    return ET.fromstring(data[:at]), data[at:]


def _number(x: str) -> float:
    try:
        return float(x)
    except ValueError:
        return math.nan


def feature_values(root: ET.Element, tail: bytes, order: str = "<") -> np.ndarray:
    """objects x features, in the order of the definitions."""
    if root.get("binaryfeatures", "").lower() != "true":
        found = sorted(root.iter("UDFValues"), key=lambda v: int(v.get("fid")))
        return np.array([[_number(x) for x in v.get("fv").split("|")] for v in found]).T
    _, n, rows = struct.unpack_from(order + "III", tail, 3)
    step = 4 + 8 * rows
    blocks = {struct.unpack_from(order + "I", tail, 15 + i * step)[0]: np.frombuffer(tail, order + "f8", rows, 19 + i * step) for i in range(n)}
    return np.column_stack([blocks[k] for k in sorted(blocks)]) if blocks else np.zeros((rows, 0))


def image_rows(root: ET.Element, tail: bytes, order: str = "<") -> Iterator[dict]:
    """Per object: id, offsets, size, camera fields, centre and channel lists."""
    if root.get("binaryfeatures", "").lower() != "true":
        for so in root.iter("SO"):
            a = so.attrib
            yield {k: float(v) for k, v in a.items() if k not in CHANNEL_LISTS} | {k: [_number(x) for x in a.get(k, "").split("|") if x] for k in CHANNEL_LISTS}
        return
    _, n, rows = struct.unpack_from(order + "III", tail, 3)
    at = 15 + n * (4 + 8 * rows)
    count, at = struct.unpack_from(order + "I", tail, at)[0], at + 4
    names = ("id", "imgIFD", "mskIFD", "spIFD", "w", "l", "fs", "cl", "ct", "objCenterX", "objCenterY")
    fixed = struct.Struct(order + "IQQQdddIIdd")
    for _ in range(count):
        row = dict(zip(names, map(float, fixed.unpack_from(tail, at))))
        at += fixed.size
        for k in CHANNEL_LISTS:
            m = struct.unpack_from(order + "I", tail, at)[0]
            row[k] = list(struct.unpack_from(f"{order}{m}d", tail, at + 4))
            at += 4 + 8 * m
        yield row


def definitions(root: ET.Element) -> Catalog:
    """Images, masks, features, regions, populations and graphs of a head."""
    cat = Catalog().add_images(*image_definitions(root)).add_masks(*mask_definitions(root))
    for u in root.iter("UDF"):
        kind = u.get("type", "single")
        told = u.get("def", "")
        cat = cat.add_features(Feature(u.get("name"), kind, told if kind == "combined" or told != u.get("name") else ""))
    if OBJECT not in cat.features:
        cat = cat.add_features(Feature(OBJECT))
    regions = []
    for r in root.iter("Region"):
        points = [(float(a.get("x")), float(a.get("y"))) for a in r.iter("axy") if a.get("x") not in (None, "NaN")]
        xs, ys = zip(*points)
        trans = [r.get(f"{a}trans") or r.get(f"{a}logrange") or "P" for a in "xy"]
        sync = r.get("sync", "")
        part = int(sync.rpartition("|")[2]) if sync else 0
        if sync.startswith("dual"):  # written bounds are those of the part; the divider is the one that others share
            xs = (max(xs) if part == 1 else min(xs),) * 2
        elif sync:
            xs, ys = (max(xs) if part in (1, 4) else min(xs),) * 2, (min(ys) if part in (1, 2) else max(ys),) * 2
        regions.append(Region(r.get("label"), r.get("type"), xs, ys, *trans, sync=sync, color=r.get("color", "White"), lightcolor=r.get("lightcolor", "Black")))
    cat = cat.add_regions(*regions)  # at once, as groups must be whole
    pops = []
    for p in root.iter("Pop"):
        kind, name = p.get("type"), p.get("name")
        look = {"color": p.get("color", "White"), "light_color": p.get("lightModeColor", "Black"), "style": p.get("style", "Simple Dot")}
        if name == ALL or kind == "B":
            continue
        base = p.get("base") or ALL
        if kind == "G":
            pops.append(Population(name, base, region=p.get("region"), fx=p.get("fx"), fy=p.get("fy", ""), **look))
        elif kind == "C":
            pops.append(Population(name, definition=p.get("definition"), **look))
        else:
            pops.append(Population(name, base if base != name else ALL, ids=tuple(int(float(o.get("O"))) for o in p.iter("ob")), **look))
    cat = cat.add_pops(*pops)
    cat = replace(cat, reports=report_rows(root))
    for g in root.iter("Graph"):
        names = lambda tag: tuple(x.get("name") for x in g.iter(tag))
        cat = cat.add_graphs(Graph(g.get("type"), g.get("f1"), g.get("f2", ""), names("BasePop") or (ALL,), names("GraphRegion"), names("ShownPop"), g.get("xlogrange", "P"), g.get("ylogrange", "P"), title=g.get("title", "")))
    return cat


def report_rows(root: ET.Element) -> tuple[ReportRow, ...]:
    """The columns of statistics reports that a head defines."""
    found = [x for tag in ("StatisticsReportColumn", "StatisticColumn") for x in root.iter(tag)]
    return tuple(ReportRow(x.get("name", ""), x.get("statistics", ""), x.get("population1") or x.get("population", ""), x.get("feature", ""), x.get("population2", "")) for x in found)


def add_reports(root: ET.Element, rows: tuple[ReportRow, ...]) -> None:
    """The same as XML."""
    at = ET.SubElement(root, "StatisticsReports") if rows else root
    for r in rows:
        ET.SubElement(at, "StatisticsReportColumn", {"name": r.name, "type": "Statistics", "population1": r.population, "population2": r.population2, "feature": r.feature, "statistics": r.statistic})


def read_report(spark: SparkSession, path: str) -> tuple[ReportRow, ...]:
    """The report that an analysis file or template defines, for ``stats.report``."""
    return report_rows(ET.fromstring(read_heads(spark, path).first()["head"]))


def read_heads(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """import_file, head (XML without feature values and image rows): a row per file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads = []
            for c in b.column("content"):
                data = c.as_py()
                end = TEMPLATE_END if data.find(TEMPLATE_END) >= 0 else END
                head = data[: data.find(end) + len(end)].decode("utf-8", "replace")
                heads.append(re.sub(r"<(UDFValues|SO) [^>]*/>", "", head))
            yield pa.RecordBatch.from_arrays([pa.array(map(_short, b.column("path").to_pylist())), pa.array(heads)], names=["import_file", "head"])

    return _files(spark, paths).mapInArrow(run, "import_file string, head string")


def read_daf(spark: SparkSession, path: str, order: str = "<") -> Objects:
    """One file's objects with its definitions; combined features are computed
    from them. Missing or repeated object numbers are numbered anew."""
    root = ET.fromstring(read_heads(spark, path).first()["head"])
    cat = definitions(root)
    names = [u.get("name") for u in root.iter("UDF")]
    stored = [n for n in names if cat.features[n].type != "combined"]
    out = [*([OBJECT] if OBJECT not in stored else []), *stored]
    schema = ", ".join(f"`{n.replace('`', '``')}` " + ("long" if n == OBJECT else "double") for n in out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                x = feature_values(*split(content.as_py()), order)
                place = {n: i for i, n in enumerate(names)}
                ids = x[:, place[OBJECT]] if OBJECT in place else np.arange(len(x), dtype=float)
                if not np.isfinite(ids).all() or len(np.unique(ids)) < len(ids):
                    ids = np.arange(len(x), dtype=float)
                for i in range(0, len(x), BLOCK):
                    cols = [pa.array(ids[i : i + BLOCK].astype(np.int64)) if n == OBJECT else pa.array(np.ascontiguousarray(x[i : i + BLOCK, place[n]])) for n in out]
                    yield pa.RecordBatch.from_arrays(cols, names=out)

    return Objects(_files(spark, path).mapInArrow(run, schema), cat, OBJECT)


IMAGE_SCHEMA = "import_file string, id long, imgIFD long, mskIFD long, spIFD long, w double, l double, fs double, cl double, ct double, objCenterX double, objCenterY double, bgstd array<double>, bgmean array<double>, satcount array<double>, satpercent array<double>"


def read_images(spark: SparkSession, paths: str | list[str], order: str = "<") -> DataFrame:
    """The image rows of analysis files, a row per object."""
    names = [f.split()[0] for f in IMAGE_SCHEMA.split(", ")]
    kinds = [pa.string(), *[pa.int64()] * 4, *[pa.float64()] * 7, *[pa.list_(pa.float64())] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                held = []
                for row in image_rows(*split(content.as_py()), order):
                    held.append([_short(path), *(int(row[n]) if n in ("id", "imgIFD", "mskIFD", "spIFD") else row.get(n) for n in names[1:])])
                    if len(held) == BLOCK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)

    return _files(spark, paths).mapInArrow(run, IMAGE_SCHEMA)


def checksum(images: DataFrame) -> DataFrame:
    """Per file the sum of the image offsets of objects 0 to 4, which pairs an
    analysis file with its container."""
    return images.groupBy("import_file").agg(F.sum(F.when(F.col("id") < 5, F.col("imgIFD"))).alias("checksum"))


def _text(v: float) -> str:
    return "NaN" if v is None or math.isnan(v) else repr(float(v)).upper().replace("INF", "Inf")


def head_xml(cat: Catalog, stored: list[str], rows: int, binary: bool) -> ET.Element:
    root = ET.Element("Assay", {"binaryfeatures": "True" if binary else "False"})
    ET.SubElement(root, "SOD", {"objcount": str(rows)})
    add_definitions(root, cat.images, cat.masks)
    at = ET.SubElement(root, "DefinedFeatures")
    for n in [*stored, *(f for f in cat.features if f not in stored)]:
        f = cat.features[n]
        ET.SubElement(at, "UDF", {"name": n, "type": f.type, "def": f.definition or n, "userfeaturetype": "Combined" if f.type == "combined" else "No Parameters"})
    at = ET.SubElement(root, "Regions")
    for r in cat.regions.values():
        node = ET.SubElement(at, "Region", {"label": r.label, "type": r.type, "xtrans": r.xtrans, "ytrans": r.ytrans, "color": r.color, "lightcolor": r.lightcolor} | ({"sync": r.sync} if r.sync else {}))
        xs, ys = r.x, r.y
        if r.sync_kind == "dual":
            xs = half(r.x[0], r.sync_part)
        elif r.sync_kind == "quad":
            xs, ys = quarter(r.x[0], r.y[0], r.sync_part)
        for x, y in zip(xs, ys):
            ET.SubElement(node, "axy", {"x": _text(x), "y": _text(y)})
    at = ET.SubElement(root, "Pops")
    for p in cat.pops.values():
        node = ET.SubElement(at, "Pop", {"name": p.name, "type": p.type, "base": p.base, "color": p.color, "lightModeColor": p.light_color, "style": p.style})
        for k, v in (("region", p.region), ("fx", p.fx), ("fy", p.fy), ("definition", p.definition)):
            if v:
                node.set(k, v)
        for o in p.ids if isinstance(p.ids, tuple) else ():
            ET.SubElement(node, "ob", {"O": str(o)})
    at = ET.SubElement(root, "Graphs")
    for g in cat.graphs:
        node = ET.SubElement(at, "Graph", {"type": g.type, "f1": g.f1, "f2": g.f2, "xlogrange": g.xtrans, "ylogrange": g.ytrans, "title": g.title})
        for tag, names in (("BasePop", g.base), ("GraphRegion", g.regions), ("ShownPop", g.shown)):
            for n in names:
                ET.SubElement(node, tag, {"name": n})
    add_reports(root, cat.reports)
    return root


def encode(cat: Catalog, stored: list[str], x: np.ndarray, binary: bool = True, images: list[dict] | None = None, order: str = "<") -> bytes:
    """An analysis file of a table that fits in one task (files hold one run)."""
    root = head_xml(cat, stored, len(x), binary)
    if not binary:
        at = ET.SubElement(root, "FeatureValues")
        for i in range(x.shape[1]):
            ET.SubElement(at, "UDFValues", {"fid": str(i), "fv": "|".join(map(_text, x[:, i]))})
        at = ET.SubElement(root, "Images") if images else at
        for r in images or []:
            whole = {k: str(int(r[k])) for k in ("id", "imgIFD", "mskIFD", "spIFD", "cl", "ct")}
            ET.SubElement(at, "SO", whole | {k: _text(r[k]) for k in ("w", "l", "fs", "objCenterX", "objCenterY")} | {k: "|".join(map(_text, r[k])) for k in CHANNEL_LISTS})
        return ET.tostring(root)
    out = [ET.tostring(root), b"\0\0\0", struct.pack(order + "III", 1, x.shape[1], len(x))]
    for i in range(x.shape[1]):
        out += [struct.pack(order + "I", i), np.ascontiguousarray(x[:, i]).astype(order + "f8").tobytes()]
    out.append(struct.pack(order + "I", len(images or [])))
    for r in images or []:
        out.append(struct.pack(order + "IQQQdddIIdd", int(r["id"]), *(int(r[k]) for k in ("imgIFD", "mskIFD", "spIFD")), *(r[k] for k in ("w", "l", "fs")), int(r["cl"]), int(r["ct"]), r["objCenterX"], r["objCenterY"]))
        for k in CHANNEL_LISTS:
            out.append(struct.pack(f"{order}I{len(r[k])}d", len(r[k]), *r[k]))
    return b"".join(out)


def write_daf(objects: Objects, folder: str, binary: bool = True, rows_per_file: int = 1 << 18, images: DataFrame | None = None) -> DataFrame:
    """Analysis files of all objects with their definitions: file, rows. Each part of
    the table gives a file for each ``rows_per_file`` objects.

    ``images``: image rows (IMAGE_SCHEMA, as ``container.image_rows`` gives them), joined by
    id. Where the objects come from several files (``file_col``), there is then an
    analysis file for each of them, with the image rows of that file."""
    cat = objects.catalog
    stored = [n for n, f in cat.features.items() if f.type != "combined"]
    quoted = lambda n: F.col("`" + n.replace("`", "``") + "`")
    values = [quoted(n).cast("double").alias(f"c{i}") for i, n in enumerate(stored)]
    with_images = images is not None

    def put(table: pa.Table) -> bytes:
        x = np.column_stack([np.asarray(table.column(f"c{i}").to_numpy(), float) for i in range(len(stored))])
        return encode(cat, stored, x, binary, table.column("image").to_pylist() if with_images else None)

    if images is None:
        return write_parts(objects.df.select(*values), folder, "daf", put, rows_per_file)
    keys = {"_id": objects.id_col} | ({"_file": objects.file_col} if objects.file_col else {})
    left = objects.df.select(*(quoted(c).alias(k) for k, c in keys.items()), *values)
    right = images.select(*(F.col(c).alias(k) for k, c in (("_id", "id"), ("_file", "import_file")) if k in keys), F.struct(*(c for c in images.columns if c != "import_file")).alias("image"))
    # As the number of rows of a file says how many image rows follow, each object has one.
    rows = left.join(right, list(keys)).withColumn("_id", F.col("_id").cast("long"))
    if objects.file_col:
        rows = rows.repartition("_file").sortWithinPartitions("_file", "_id")
    else:
        rows = rows.sortWithinPartitions("_id")
    return write_parts(rows, folder, "daf", put, rows_per_file, "_file" if objects.file_col else None)


def write_template(cat: Catalog) -> str:
    """Definitions alone, as XML."""
    return ET.tostring(head_xml(cat, [n for n, f in cat.features.items() if f.type != "combined"], 0, False), encoding="unicode")


def read_template(text: str) -> Catalog:
    return definitions(ET.fromstring(text))
