"""The description of a run that a container's first directory holds: channels in use,
lights, magnification, crosstalk, displays, images and masks, tests of the instrument."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import gamma_of
from ..operators.masks import Image, Mask, default_image
from . import container

KINDS = ("rif", "sub rif", "merged rif", "cif", "cif of sub rif", "cif of merged rif", "non xif", "sub cif", "merged cif")
LIGHT = "struct<installed:boolean,wavelength:int,powered:boolean,power:double,least:double,most:double>"
IMAGE = "struct<name:string,color:string,channel:int,xmin:int,xmax:int,xmid:int,ymid:int,scalemin:int,scalemax:int>"
RUN = f"path string, import_file string, kind string, objects long, date string, instrument string, software_raw string, software string, channel_width double, channels_in_use array<boolean>, brightfield array<boolean>, brightfield_on boolean, brightfield_intensity double, illumination array<{LIGHT}>, collection_mode double, magnification double, core_mode double, ev_mode double, crosstalk array<array<double>>, images array<{IMAGE}>, masks array<struct<type:string,name:string,def:string>>, displays array<map<string,string>>, origin array<string>, merged array<string>, assist map<string,string>, offsets_x array<double>, offsets_y array<double>"


@dataclass(frozen=True)
class Run:
    """A run to be written with a container."""

    channels_in_use: tuple[bool, ...]
    brightfield: tuple[bool, ...] = ()
    magnification: float = 40.0
    collection_mode: int = 1
    #: By laser: (on, watts).
    lasers: tuple[tuple[bool, float], ...] = ()
    crosstalk: tuple[tuple[float, ...], ...] = ()
    images: tuple[Image, ...] = ()
    masks: tuple[Mask, ...] = ()
    assist: dict[str, str] = field(default_factory=dict)
    date: str = ""
    instrument: str = ""
    channel_width: int = 0
    #: All definitions as XML (``daf.write_template``), in place of images and masks alone.
    definitions: str = ""

    def tags(self) -> container.Tags:
        """What ``container.write_images`` and ``write_strips`` take as ``about``."""
        bits = lambda xs: " ".join(str(int(x)) for x in xs)
        root = ET.Element("Assay")
        light = ET.SubElement(root, "Illumination")
        for i, (on, watts) in enumerate(self.lasers, 1):
            ET.SubElement(light, f"ExLaser{i}PowerOn").text = str(int(on))
            ET.SubElement(light, f"ExLaser{i}IntensityWatts").text = repr(float(watts))
        for name, value in (("BfLedIndicators_0_11", bits(self.brightfield)), ("BFOnOff", str(int(any(self.brightfield)))), ("BFIntensity", "0"), ("CollectionMode", str(self.collection_mode))):
            ET.SubElement(light, name).text = value
        ET.SubElement(ET.SubElement(root, "Fluidics"), "CoreMode").text = "0"
        imaging = ET.SubElement(root, "Imaging")
        for name, value in (("ChannelInUseIndicators_0_11", bits(self.channels_in_use)), ("Magnification", repr(float(self.magnification))), ("EVModeEnabled", "0")):
            ET.SubElement(imaging, name).text = value
        if self.definitions:
            ET.SubElement(imaging, "DafFile").text = self.definitions
        elif self.images or self.masks:
            inner = ET.Element("Assay")
            add_definitions(inner, self.images, self.masks)
            ET.SubElement(imaging, "DafFile").text = ET.tostring(inner, encoding="unicode")
        ET.SubElement(root, "Display")
        tests = ET.Element("Instrument")
        inner = ET.SubElement(tests, "ASSISTDb")
        for name, value in self.assist.items():
            ET.SubElement(inner, name).text = value
        out: container.Tags = {container.ACQUISITION: ET.tostring(root), container.ASSIST: ET.tostring(tests), container.DATE: self.date.encode(), container.INSTRUMENT: self.instrument.encode(), container.CHANNEL_WIDTH: self.channel_width}
        if self.crosstalk:
            out[container.CROSSTALK] = [x for row in self.crosstalk for x in row]
        return out


def add_definitions(root: ET.Element, images: tuple[Image, ...], masks: tuple[Mask, ...]) -> None:
    """Image and mask definitions as the XML of analysis files (channels from 0)."""
    if images:
        at = ET.SubElement(root, "Images")
        for i in images:
            ET.SubElement(at, "image", {"name": i.name, "color": i.color, "physicalChannel": str(i.channel - 1)} | {k: str(getattr(i, k)) for k in NUMBERS} | {"tokens": "", "baseimage": "", "function": "", "saturation": i.saturation})
    if masks:
        at = ET.SubElement(root, "masks")
        for m in masks:
            ET.SubElement(at, "mask", {"type": m.type, "name": m.name, "def": m.definition})


NUMBERS = ("xmin", "xmax", "xmid", "ymid", "scalemin", "scalemax")


def image_definitions(root: ET.Element) -> tuple[Image, ...]:
    found = [Image(x.get("name"), int(x.get("physicalChannel")) + 1, x.get("color", ""), *(int(float(x.get(k, 0))) for k in NUMBERS), saturation=x.get("saturation", "Cyan")) for x in root.iter("image")]
    return tuple(sorted(found, key=lambda i: i.channel))


def mask_definitions(root: ET.Element) -> tuple[Mask, ...]:
    return tuple(Mask(x.get("name"), x.get("def", ""), x.get("type", "C")) for x in root.iter("mask"))


def _xml(text: bytes | None) -> ET.Element:
    return ET.fromstring(text) if text else ET.Element("none")


def _leaves(node: ET.Element | None) -> dict[str, str]:
    """The text of each element without children, by its name."""
    return {} if node is None else {x.tag: (x.text or "").strip() for x in node.iter() if len(x) == 0 and x is not node}


def _numbers(text: str | None) -> list[float]:
    return [float(x) for x in (text or "").split()]


def _one(text: str | None) -> float | None:
    return _numbers(text)[0] if _numbers(text) else None


def _lasers(acquired: dict[str, str], installed: dict[str, str]) -> list[dict]:
    """A record per laser, in order of the numbers in their names."""

    def by_number(have: dict[str, str], what: str, skip: str) -> list[float | None]:
        names = [n for n in have if "ExLaser" in n and what in n and not re.search(skip, n)]
        return [_one(have[n]) for n in sorted(names, key=lambda n: int("0" + re.sub(r"\D+", "", n)))]

    on = by_number(acquired, "PowerOn", "Filter")
    like = lambda xs: xs if len(xs) == len(on) else [None] * len(on)
    power = like(by_number(acquired, "IntensityWatts", "Filter"))
    present = like(by_number(installed, "Present", "Filter|LAF"))
    wave, least, most = (like(by_number(installed, k, "^$")) for k in ("Wavelength", "MinPower", "MaxPower"))
    yes = lambda x: None if x is None else x != 0
    return [{"installed": yes(present[i]), "wavelength": None if wave[i] is None else int(wave[i]), "powered": yes(on[i]), "power": None if power[i] is None else round(power[i], 2), "least": least[i], "most": most[i]} for i in range(len(on))]


def file_kind(numbers: dict[int, list[float]], texts: dict[int, bytes]) -> str:
    """What a container was made from, by which tags it has."""
    if container.COUNT not in numbers:
        return "non xif"
    if container.MERGED_CIF in numbers or container.MERGED_CIF in texts:
        return "merged cif"
    if container.SUBSET not in numbers:
        return "rif"
    if container.MERGED not in texts:
        return "cif"
    merged = bool(texts[container.MERGED])
    if numbers[container.SUBSET][0] == 0:
        return "merged rif" if merged else "sub rif"
    if numbers[container.SUBSET][0] == numbers[container.COUNT][0]:
        return "cif of merged rif" if merged else "cif of sub rif"
    return "sub cif"


def embedded(texts: dict[int, bytes]) -> ET.Element:
    """The definitions that a first directory holds, as the head of an analysis file."""
    inner = _xml(texts.get(container.ACQUISITION)).findtext(".//Imaging/DafFile")
    return ET.fromstring(inner) if inner else ET.Element("none")


def described(numbers: dict[int, list[float]], texts: dict[int, bytes], acquisition: bool = False) -> dict:
    """The record of a first directory; ``acquisition``: crosstalk as set while acquiring."""
    acquired, instrument = _xml(texts.get(container.ACQUISITION)), _xml(texts.get(container.ASSIST))
    light, imaging, fluid = (_leaves(acquired if acquired.tag == k else acquired.find(f".//{k}")) for k in ("Illumination", "Imaging", "Fluidics"))
    text = lambda tag: texts.get(tag, b"").decode("utf-8", "replace")
    width = numbers.get(container.CHANNEL_WIDTH, [0.0])[0] or _one(instrument.findtext(".//ChannelWidth"))
    cross, side = numbers.get(container.CROSSTALK, []), 0
    in_use = [x != 0 for x in _numbers(imaging.get("ChannelInUseIndicators_0_11"))]
    if acquisition and imaging.get("InspireCrossTalkMatrix"):
        cross, side = _numbers(imaging["InspireCrossTalkMatrix"]), len(in_use)
    side = side or int(len(cross) ** 0.5)
    bright = [x != 0 for x in _numbers(light.get("BfLedIndicators_0_11"))]
    mode = _one(light.get("CollectionMode"))
    shown = embedded(texts)
    images = image_definitions(shown) or tuple(default_image(i, bright[i - 1] if i <= len(bright) else False, 1 if mode is None else int(mode)) for i in range(1, 13))
    masks = mask_definitions(shown) or (Mask("MC", "|Or|".join(f"M{i.channel:02d}" for i in images)),)
    assist = {x.tag: " ".join((x.itertext())).strip() for x in (instrument.find(".//ASSISTDb") if instrument.tag != "ASSISTDb" else instrument) or ()}
    magnification = _one(imaging.get("Magnification"))
    scale = {20: "20x", 60: "60x"}.get(magnification, "")
    split = lambda tag: [x for x in text(tag).split("|") if x]
    return {
        "kind": file_kind(numbers, texts), "objects": int(numbers.get(container.COUNT, [0])[0]), "date": text(container.DATE), "instrument": text(container.INSTRUMENT), "software_raw": text(container.SOFTWARE_RAW), "software": text(container.SOFTWARE),
        "channel_width": width, "channels_in_use": in_use, "brightfield": bright, "brightfield_on": bool(_one(light.get("BFOnOff"))), "brightfield_intensity": _one(light.get("BFIntensity")),
        "illumination": _lasers(light, _leaves(instrument.find("Illumination"))), "collection_mode": mode, "magnification": magnification, "core_mode": _one(fluid.get("CoreMode")), "ev_mode": _one(imaging.get("EVModeEnabled")),
        "crosstalk": [cross[i : i + side] for i in range(0, len(cross), side)] if side else None,
        "images": [{"name": i.name, "color": i.color, "channel": i.channel} | {k: getattr(i, k) for k in NUMBERS} for i in images], "masks": [{"type": m.type, "name": m.name, "def": m.definition} for m in masks],
        "displays": [list(x.attrib.items()) for k in ("ChannelPresets", "ImageDisplaySettings", "ViewingModes") for x in shown.iter(k)],
        "origin": split(container.ORIGIN), "merged": split(container.MERGED), "assist": list(assist.items()),
        "offsets_x": _numbers(assist.get(f"XOffsets{scale}_Gen2_0_11")), "offsets_y": _numbers(assist.get(f"YOffsets{scale}_Gen2_0_11")),
    }


def read_run(spark: SparkSession, paths: str | list[str], acquisition: bool = False, counted: Accumulator | None = None) -> DataFrame:
    """The description of each file's run, from its first directory alone: RUN, with the
    display exponent ``gamma`` of each image. Without a description there are
    defaults for images and masks, and nulls or empty lists."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    firsts = container.read_first(spark, paths, counted=counted)
    schema = to_arrow_schema(StructType.fromDDL(RUN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                row = {"path": r["path"], "import_file": r["import_file"]} | described(dict(r["numbers"]), dict(r["texts"]), acquisition)
                yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], names=schema.names)

    out = firsts.mapInArrow(run, RUN)
    wide = lambda i: F.struct(*(i[k] for k in ("name", "color", "channel", *NUMBERS)), gamma_of(*(i[k].cast("double") for k in ("xmin", "xmax", "xmid", "ymid"))).alias("gamma"))
    return out.withColumn("images", F.transform("images", wide))


def read_assist(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """import_file, test, value: the tests of the instrument that files hold."""
    return read_run(spark, paths).select("import_file", F.explode("assist").alias("test", "value"))


def with_shifts(strips: DataFrame, runs: DataFrame) -> DataFrame:
    """``strips`` (path, channels) with dx, dy: for each channel in use, in order, the
    spatial offset that ``operators.images.align`` takes; NaN where a file has none."""
    used = F.transform(F.filter(F.sequence(F.lit(1), F.size("channels_in_use")), lambda i: F.element_at("channels_in_use", i)), lambda i: i)
    # A file without channels in use has an empty list.
    used = F.when(F.size("channels_in_use") > 0, used).otherwise(F.array().cast("array<int>"))
    at = lambda c: F.transform(used, lambda i: F.coalesce(F.try_element_at(c, i), F.lit(float("nan"))))
    return strips.join(runs.select("path", at("offsets_x").alias("dx"), at("offsets_y").alias("dy")), "path", "left")
