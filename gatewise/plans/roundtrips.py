"""Queries that write objects and images in every file format and read them again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import strings
from ..operators import images as kernels
from ..operators.catalog import Feature, Graph, Population
from ..operators.gates import Region
from ..operators.populations import Objects, member
from ..operators.stats import pop_stats as count_pops
from ..operators.store import new_path
from ..sources import container, daf, fcs, fcs_rules, files
from .common import query, table
from .gating import HIERARCHY_SQL, hierarchy
from .images import WIDTH, _images

_PART = "SELECT p_partkey, p_size::DOUBLE AS p_size, p_retailprice, p_retailprice / p_size AS unit FROM part"


def _parts(spark, sf_dir) -> Objects:
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    objects = Objects.of(df.withColumn(daf.OBJECT, F.col("p_partkey")), id_col=daf.OBJECT, features=(daf.OBJECT, "p_size", "p_retailprice"))
    return objects.add_features(Feature("unit", "combined", "p_retailprice|/|p_size"))


def _daf(spark, sf_dir, binary: bool):
    folder = new_path(spark, "daf")
    daf.write_daf(_parts(spark, sf_dir), folder, binary, rows_per_file=1500).collect()
    again = files.read(spark, f"{folder}/*.daf")
    return again.values(["unit"]).select(F.col(f"`{daf.OBJECT}`").alias("p_partkey"), "p_size", "p_retailprice", "unit")


@query(_PART)
def daf_binary(spark, sf_dir):
    """Objects and definitions as analysis files with a binary tail, read again; the combined feature is computed anew."""
    return _daf(spark, sf_dir, True)


@query(_PART)
def daf_xml(spark, sf_dir):
    """The same with all values in XML."""
    return _daf(spark, sf_dir, False)


@query("SELECT p_size::BIGINT AS p_size, count(*) AS n, sum(p_partkey)::BIGINT AS keys FROM part GROUP BY ALL")
def file_kinds(spark, sf_dir):
    """Objects written and read by the kind of file alone."""
    folder = new_path(spark, "kinds")
    files.write(_parts(spark, sf_dir), folder, "fcs").collect()
    df = files.read(spark, f"{folder}/*.fcs").df
    return df.groupBy(F.col("p_size").cast("long").alias("p_size")).agg(F.count("*").alias("n"), F.sum(F.col(f"`{daf.OBJECT}`").cast("long")).alias("keys"))


#: Data types of list-mode files: bits, byte order, range mask, scaling.
FCS_TYPES = {"I8": ("I", 8, "1,2,3,4"), "I16": ("I", 16, "2,1"), "I24": ("I", 24, "1,2,3"), "I32": ("I", 32, "4,3,2,1"), "F": ("F", 32, "4,3,2,1"), "D": ("D", 64, "8,7,6,5,4,3,2,1"), "A": ("A", 0, "1,2,3,4"), "log": ("I", 16, "1,2"), "gain": ("I", 16, "1,2"), "mask": ("I", 16, "1,2")}


def fcs_bytes(values: list[int], name: str) -> bytes:
    """A file of one parameter in one of FCS_TYPES."""
    kind, bits, order = FCS_TYPES[name]
    end = "big" if order[0] > order[-1] else "little"
    if kind == "A":
        data = " ".join(map(str, values)).encode() + b" "
    elif kind == "I":
        data = b"".join((v % (1 << bits)).to_bytes(bits // 8, end) for v in values)
    else:
        data = np.array(values, (">" if end == "big" else "<") + ("f4" if kind == "F" else "f8")).tobytes()
    text = {"$BYTEORD": order, "$DATATYPE": kind, "$MODE": "L", "$NEXTDATA": "0", "$PAR": "1", "$TOT": str(len(values)), "$P1N": "v", "$P1B": "*" if kind == "A" else str(bits), "$P1R": "64" if name == "mask" else "1024" if name == "log" else str(1 << (bits or 16)), "$P1E": "4,1" if name == "log" else "0,0"}
    if name == "gain":
        text["$P1G"] = "4"
    body = "|" + "".join(f"{k}|{v}|" for k, v in text.items())
    start = 58 + len(body)
    return b"FCS3.0    " + b"".join(b"%8d" % v for v in (58, start - 1, start, start + len(data) - 1, 0, 0)) + body.encode() + data


_FCS_SQL = {"log": "pow(10.0::DOUBLE, 4 * v / 1024.0::DOUBLE)", "gain": "v / 4.0::DOUBLE", "mask": "(v % 64)::DOUBLE", "I8": "(v % 256)::DOUBLE"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS type, v, round({_FCS_SQL.get(k, 'v::DOUBLE')}, 6) AS read FROM (SELECT DISTINCT (p_size * 20 - 1)::BIGINT AS v FROM part)" for k in FCS_TYPES))
def fcs_types(spark, sf_dir):
    """Whole numbers of every width, byte order, floats, doubles, text, log and gain scaling, range masks."""
    kinds = spark.createDataFrame([(k,) for k in FCS_TYPES], "type string")
    values = table(spark, sf_dir, "part").select((F.col("p_size") * 20 - 1).cast("long").alias("v")).distinct()
    rows = kinds.join(values.agg(F.array_sort(F.collect_list("v")).alias("values")))  # one row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for kind, values in zip(b.column("type").to_pylist(), b.column("values").to_pylist()):
                read = fcs.events(fcs_bytes(values, kind))[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(values)), pa.array(values, pa.int64()), pa.array(np.round(read, 6))], names=["type", "v", "read"])

    return rows.mapInArrow(run, "type string, v long, read double")


_WHOLE = "list_transform(embedding, lambda v: round(v::DOUBLE * 4000)::INT)"


def _whole(spark, sf_dir):
    pixels = F.transform("pixels", lambda v: F.round(v * 4000).cast("long"))
    rows = _images(spark, sf_dir).select(F.col("vec_id").alias("object_id"), "height", "width", pixels.alias("pixels"))
    return rows.withColumn("mask", F.transform("pixels", lambda v: (v > 0).cast("long") + (v > 200).cast("long")))


def _pixels(strips):
    found = kernels.decoded(strips, ["object_id", "kind"])
    return found.select("object_id", "kind", "pixels")


@query(f"SELECT vec_id AS object_id, 'img' AS kind, {_WHOLE} AS pixels FROM embeddings UNION ALL SELECT vec_id, 'msk', list_transform({_WHOLE}, lambda v: (v > 0)::INT + (v > 200)::INT) FROM embeddings")
def container_roundtrip(spark, sf_dir):
    """Images and masks written to containers and every pixel read again."""
    folder = new_path(spark, "containers")
    container.write_images(_whole(spark, sf_dir), folder, 200).collect()
    return _pixels(container.read_strips(spark, f"{folder}/*.cif", 1))


def _in_order(spark, sf_dir, name: str, **options) -> str:
    """Images in containers that lie in order of their ids; the folder."""
    folder, rows = new_path(spark, name), _whole(spark, sf_dir)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    container.write_images(rows.repartitionByRange(n, "object_id").sortWithinPartitions("object_id"), folder, **options).collect()
    return folder


@query(f"SELECT row_number() OVER (ORDER BY vec_id) - 1 AS object_id, {_WHOLE} AS pixels FROM embeddings WHERE vec_id % 7 = 3")
def container_subset(spark, sf_dir):
    """Containers cut down to some objects, with new ids, strips copied as they are."""
    first, second = _in_order(spark, sf_dir, "whole"), new_path(spark, "subset")
    wanted = _whole(spark, sf_dir).filter("object_id % 7 = 3").select("object_id")
    container.merge_files(spark, f"{first}/*.cif", second, wanted, 100).collect()
    return _pixels(container.read_strips(spark, f"{second}/*.cif", 1, kinds=("img",))).select("object_id", "pixels")


@query(f"SELECT row_number() OVER (ORDER BY part, vec_id) - 1 AS object_id, {_WHOLE} AS pixels FROM (SELECT 0 AS part, * FROM embeddings UNION ALL SELECT 1, * FROM embeddings WHERE label % 2 = 1)")
def container_merge(spark, sf_dir):
    """Two sets of containers joined: ids from 0 on over both, in order of files, every pixel."""
    place = new_path(spark, "sets")
    rows = _whole(spark, sf_dir)
    odd = table(spark, sf_dir, "embeddings").filter("label % 2 = 1").select(F.col("vec_id").alias("object_id"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name, part in (("a", rows), ("b", rows.join(odd, "object_id", "left_semi"))):
        container.write_images(part.repartitionByRange(n, "object_id").sortWithinPartitions("object_id"), f"{place}/{name}").collect()
    out = new_path(spark, "joined")
    container.merge_files(spark, [f"{place}/a/*.cif", f"{place}/b/*.cif"], out).collect()
    return _pixels(container.read_strips(spark, f"{out}/*.cif", 1, kinds=("img",))).select("object_id", "pixels")


@query("SELECT vec_id AS id, 8.0::DOUBLE AS w, (len(embedding) // 8)::DOUBLE AS l, true AS img_at, true AS same_sum FROM embeddings")
def container_checksum(spark, sf_dir):
    """Containers and their analysis files with image rows: each row points to its image's directory in
    the container, and the checksums of both files agree."""
    folder, out = _in_order(spark, sf_dir, "pairs"), new_path(spark, "analysis")
    dirs = container.read_directories(spark, f"{folder}/*.cif")
    rows = container.image_rows(dirs)
    objects = Objects.of(rows.select("import_file", F.col("id").alias(daf.OBJECT)), daf.OBJECT, "import_file", (daf.OBJECT,))
    daf.write_daf(objects, out, images=rows).collect()
    again = daf.read_images(spark, f"{out}/*.daf").withColumn("stem", F.regexp_replace("import_file", r"\.\w+$", ""))
    sums = container.checksum(dirs).select(F.regexp_replace("import_file", r"\.\w+$", "").alias("stem"), F.col("checksum").alias("of_images"))
    both = daf.checksum(again.drop("import_file").withColumnRenamed("stem", "import_file")).join(sums, F.col("import_file") == F.col("stem")).select("stem", F.col("checksum").eqNullSafe(F.col("of_images")).alias("same_sum"))
    found = dirs.filter("kind = 'img'").select(F.col("object_id").alias("id"), "offset")
    return again.join(both, "stem").join(found, "id").select("id", "w", "l", (F.col("imgIFD") == F.col("offset")).alias("img_at"), "same_sum")


@query(f"SELECT vec_id AS object_id, channel, list_transform(list_filter(range(len(p)), lambda i: (i % 8) // 2 = channel), lambda i: p[i + 1]) AS pixels, 60.0::DOUBLE AS magnification, [0.5::DOUBLE, -1.25, 0.25, 0.0][channel + 1] AS dx FROM (SELECT vec_id, {_WHOLE} AS p FROM embeddings), range(4) t(channel)")
def run_description(spark, sf_dir):
    """Channels, magnification and spatial offsets from the description in the containers, channel by channel."""
    from ..sources.run import Run, read_run, with_shifts

    about = Run((True, True, False, True, True), magnification=60.0, assist={"XOffsets60x_Gen2_0_11": "0.5 -1.25 9 0.25 0", "YOffsets60x_Gen2_0_11": "0 0 9 0 0"})
    folder = _in_order(spark, sf_dir, "runs", about=about.tags())
    runs = read_run(spark, f"{folder}/*.cif")
    strips = with_shifts(container.read_strips(spark, f"{folder}/*.cif", kinds=("img",)), runs).join(runs.select("path", "magnification"), "path")
    tiles = kernels.decoded(strips, ["object_id"])
    more = strips.select("object_id", "dx", "magnification")
    return tiles.join(more, "object_id").select("object_id", "channel", "pixels", "magnification", F.element_at("dx", F.col("channel") + 1).alias("dx"))


@query(f"SELECT vec_id AS object_id, label::DOUBLE AS label, {_WHOLE} AS pixels, label >= 3 AS high FROM embeddings")
def container_objects(spark, sf_dir):
    """Objects with features, gates and images through containers: one call reads them, a population chooses strips."""
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(daf.OBJECT), F.col("label").cast("double").alias("label"))
    df = _whole(spark, sf_dir).join(labels, F.col("object_id") == F.col(f"`{daf.OBJECT}`")).drop("object_id")
    objects = Objects.of(df, daf.OBJECT, features=(daf.OBJECT, "label"))
    objects = objects.add_regions(Region("r", "line", (3.0, float("inf")))).add_pops(Population("high", region="r", fx="label"), Population("low", definition="Not|high"))
    folder = new_path(spark, "objects")
    files.write(objects, folder, "container").collect()
    back = files.read(spark, f"{folder}/*.cif")
    dirs = container.read_directories(spark, f"{folder}/*.cif")
    values = back.members(["high"]).select(F.col(f"`{daf.OBJECT}`").cast("long").alias("id"), "label", member("high").alias("high"))
    chosen = [back.objects_in(p).select("import_file", F.col("object_number").alias("object_id")) for p in ("high", "low")]
    strips = [container.read_strips(spark, f"{folder}/*.cif", 1, c, ("img",), dirs) for c in chosen]
    return _pixels(strips[0].unionByName(strips[1])).join(values, F.col("object_id") == F.col("id")).select("object_id", "label", "pixels", "high")


@query(f"SELECT vec_id, [vec_id, row_number() OVER (ORDER BY vec_id) - 1] AS origins, label::DOUBLE AS label, {_WHOLE} AS pixels FROM embeddings WHERE vec_id % 7 = 3")
def container_origins(spark, sf_dir):
    """Containers cut down, then joined again: where each object comes from, its features and its pixels."""
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(daf.OBJECT), F.col("label").cast("double").alias("label"))
    df = _whole(spark, sf_dir).join(labels, F.col("object_id") == F.col(f"`{daf.OBJECT}`")).drop("object_id")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = df.repartitionByRange(n, F.col(f"`{daf.OBJECT}`")).sortWithinPartitions(F.col(f"`{daf.OBJECT}`"))
    place = new_path(spark, "origins")
    files.write(Objects.of(df, daf.OBJECT, features=(daf.OBJECT, "label")), f"{place}/first", "container").collect()
    wanted = labels.select(F.col(f"`{daf.OBJECT}`").alias("object_id")).filter("object_id % 7 = 3")
    container.merge_files(spark, f"{place}/first/*.cif", f"{place}/second", wanted, 100).collect()
    container.merge_files(spark, f"{place}/second/*.cif", f"{place}/third").collect()
    out = f"{place}/third/*.cif"
    dirs = container.read_directories(spark, out)
    past = dirs.filter("kind = 'img'").select("object_id", F.col("origin_ids")[0].alias("vec_id"), F.col("origin_ids").alias("origins"))
    values = container.read_features(spark, out, container.stored_names(spark, out), directories=dirs).select(F.col("object_number").alias("object_id"), "label")
    pixels = _pixels(container.read_strips(spark, out, 1, kinds=("img",), directories=dirs)).select("object_id", "pixels")
    return pixels.join(past, "object_id").join(values, "object_id").select("vec_id", "origins", "label", "pixels")


@query(f"SELECT vec_id, kind, {_WHOLE} AS img, list_transform({_WHOLE}, lambda v: CASE WHEN kind = 'msk' THEN (v > 0)::INT + (v > 200)::INT ELSE v & 65535 END) AS pixels FROM embeddings, (VALUES ('img'), ('msk')) t(kind)")
def container_tiff(spark, sf_dir):
    """Containers as TIFF of 16-bit pixels, every pixel read from the files beside the one written."""
    folder, out = _in_order(spark, sf_dir, "encoded"), new_path(spark, "tiff")
    container.write_tiff(container.read_strips(spark, f"{folder}/*.cif", 1), out).collect()
    got = _pixels(container.read_strips(spark, f"{out}/*.tif", 1)).withColumn("pixels", F.transform("pixels", lambda v: v.bitwiseAND(65535)))
    return got.join(_whole(spark, sf_dir).select("object_id", F.transform("pixels", lambda v: v.cast("int")).alias("img")), "object_id").select(F.col("object_id").alias("vec_id"), "kind", "img", "pixels")


@query(f"SELECT row_number() OVER (ORDER BY vec_id) - 1 AS rank, {_WHOLE} AS pixels FROM embeddings")
def image_array(spark, sf_dir):
    """All images as one array in chunks that tasks write; each chunk read by a task."""
    folder = new_path(spark, "array")
    rows = _whole(spark, sf_dir)
    height = rows.agg(F.max("height")).first()[0]
    n, *_ = kernels.write_tensor(rows, "object_id", height, WIDTH, folder, None, "<i4", 1 << 14)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in b.column("id").to_pylist():
                x = kernels.read_tensor(folder, first, first + 64)
                yield pa.RecordBatch.from_arrays([pa.array(range(first, first + len(x)), pa.int64()), pa.array(list(x.reshape(len(x), -1)), pa.list_(pa.int32()))], names=["rank", "pixels"])

    return spark.range(0, n, 64).mapInArrow(run, "rank long, pixels array<int>")


@query("SELECT p_partkey, p_size::DOUBLE AS p_size, p_retailprice::FLOAT::DOUBLE AS p_retailprice FROM part")
def fcs_ranges(spark, sf_dir):
    """Files of many rows read in small ranges, and of each row the wanted parameters alone."""
    folder = new_path(spark, "ranges")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    fcs.write_fcs(part, folder).collect()
    df = fcs.read_fcs(spark, f"{folder}/*.fcs", columns=["p_size", "p_partkey", "p_retailprice"], part_bytes=1 << 12)
    return df.select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_size", "p_retailprice")


_UNIT = "list_transform(embedding, lambda v: CASE WHEN v::DOUBLE <= -0.2 THEN 0.0 WHEN v::DOUBLE >= 0.2 THEN 1.0 ELSE (v::DOUBLE + 0.2) / 0.4 END)"


@query(f"SELECT vec_id, kind, list_transform({_UNIT}, lambda v: round(v * scale)) AS samples FROM embeddings, (VALUES ('uint8', 255.0::DOUBLE), ('uint16', 65535.0::DOUBLE), ('int16', 32767.0::DOUBLE)) t(kind, scale)")
def tiff_samples(spark, sf_dir):
    """Images as multi-page TIFF, plain and deflated, of several sample types: every sample."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("pixels"))
    kinds = ("uint8", "uint16", "int16")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, px in zip(b.column("vec_id").to_pylist(), b.column("pixels")):
                unit = kernels.normalize(px.values.to_numpy(zero_copy_only=False).reshape(-1, WIDTH), -0.2, 0.2)
                for k, kind in enumerate(kinds):
                    pages = kernels.tiff_read(kernels.tiff_pages([unit, np.stack([unit, 1 - unit], axis=-1)], kind, bool(k % 2)))
                    assert np.array_equal(pages[0], pages[1][:, :, 0])
                    yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([kind]), pa.array([pages[0].astype(float).ravel()], pa.list_(pa.float64()))], names=["vec_id", "kind", "samples"])

    return rows.mapInArrow(run, "vec_id long, kind string, samples array<double>")


@query(f"SELECT vec_id, list_transform({_UNIT}, lambda v: round(v * 255)::INT) AS gray FROM embeddings")
def bitmap_pixels(spark, sf_dir):
    """Images as bitmaps in Base64, each pixel read from the file by place."""
    rows = _images(spark, sf_dir)
    unit = F.transform("pixels", lambda v: F.when(v <= -0.2, 0.0).when(v >= 0.2, 1.0).otherwise((v + 0.2) / 0.4))
    text = strings.base64_text(F.col("data"))
    files_ = kernels.encoded(rows.withColumn("pixels", unit), "bmp", ["vec_id"]).join(rows.select("vec_id", "height"), "vec_id").select("vec_id", "height", F.hex(strings.base64_bytes(text)).alias("h"))
    # Rows lie from the bottom up behind 54 bytes, three bytes a pixel.
    place = lambda i: 2 * (54 + 3 * ((F.col("height") - 1 - F.floor(i / WIDTH)) * WIDTH + i % WIDTH)) + 1
    gray = F.transform(F.sequence(F.lit(0), F.col("height") * WIDTH - 1), lambda i: F.conv(F.substring("h", place(i).cast("int"), F.lit(2)), 16, 10).cast("int"))
    return files_.select("vec_id", gray.alias("gray"))


_P = "list_transform(embedding, lambda v: v::DOUBLE)"


@query(f"SELECT vec_id, flatten(list_transform(range(2 * (len(p) // 8)), lambda r: list_transform(range(16), lambda c: p[(r // 2) * 8 + c // 2 + 1]))) AS pixels FROM (SELECT vec_id, {_P} AS p FROM embeddings)")
def img_enlarge(spark, sf_dir):
    """Twice the size, by the nearest pixel."""
    half = np.array([[0.5, 0, 0], [0, 0.5, 0]])
    return kernels.image_map(_images(spark, sf_dir), lambda a: kernels.affine(a, half, 2 * a.shape[0], 2 * a.shape[1], 1), ["vec_id"]).select("vec_id", "pixels")


@query(f"SELECT vec_id, list_transform(range((len(p) // 16) * 4), lambda i: round((p[(i // 4) * 16 + (i % 4) * 2 + 1] + p[(i // 4) * 16 + (i % 4) * 2 + 2] + p[(i // 4) * 16 + (i % 4) * 2 + 9] + p[(i // 4) * 16 + (i % 4) * 2 + 10]) / 4 + 1, 6)) AS pixels FROM (SELECT vec_id, {_P} AS p FROM embeddings)")
def img_reduce(spark, sf_dir):
    """Half the size, bilinear: means of four pixels (plus 1)."""
    out = kernels.image_map(_images(spark, sf_dir), lambda a: kernels.rescale(a, 0.5), ["vec_id"])
    return out.select("vec_id", F.transform("pixels", lambda v: F.round(v + 1, 6)).alias("pixels"))


_M = "CASE WHEN r + {0} < len(m) // 8 AND c + {1} < 8 THEN m[(r + {0}) * 8 + c + {1} + 1] ELSE 0 END"
_SHIFTED = f"floor((({_M.format(0, 0)}) * 0.25 + ({_M.format(0, 1)}) * 0.75) * 0.75 + (({_M.format(1, 0)}) * 0.25 + ({_M.format(1, 1)}) * 0.75) * 0.25)"


@query(f"SELECT vec_id, flatten(list_transform(range(len(m) // 8), lambda r: list_transform(range(8), lambda c: {_SHIFTED}::DOUBLE))) AS pixels FROM (SELECT vec_id, list_transform({_P}, lambda v: (v > 0)::INT + (v > 0.05)::INT + (v > 0.1)::INT) AS m FROM embeddings)")
def mask_align(spark, sf_dir):
    """Masks shifted by parts of a pixel: bilinear, with the fraction cut off; background outside."""
    rows = _images(spark, sf_dir).withColumn("pixels", F.transform("pixels", lambda v: (v > 0).cast("double") + (v > 0.05).cast("double") + (v > 0.1).cast("double")))
    return kernels.image_map(rows, lambda a: kernels.align_mask(a, 0.75, 0.25), ["vec_id"]).select("vec_id", "pixels")


@query(f"SELECT vec_id, flatten(list_transform(range(len(p) // 8), lambda r: p[r * 8 + 1 : r * 8 + 8] || CASE WHEN r < len(p) // 16 THEN list_transform(p[r * 16 + 1 : r * 16 + 8], lambda v: -v) ELSE [9.0::DOUBLE, 9.0::DOUBLE, 9.0::DOUBLE, 9.0::DOUBLE, 9.0::DOUBLE, 9.0::DOUBLE, 9.0::DOUBLE, 9.0::DOUBLE] END)) AS pixels FROM (SELECT vec_id, {_P} AS p FROM embeddings)")
def img_sheet(spark, sf_dir):
    """An image beside its odd rows with the other sign, filled up below."""
    return kernels.image_map(_images(spark, sf_dir), lambda a: kernels.sheet([a, -a[: 2 * (a.shape[0] // 2) : 2]], 2, 9.0), ["vec_id"]).select("vec_id", "pixels")


def _half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Numbers from 0 on, rounded as in SQL, where halves go up; numpy takes them to the even digit."""
    scaled = x * 10.0**digits
    whole = np.floor(scaled)
    return (whole + (scaled - whole >= 0.5)) / 10.0**digits


@query(f"SELECT vec_id, list_transform({_UNIT}, lambda v: [round(v * 0.6, 6) + 0.0, round(v, 6) + 0.0, round(v * 0.36, 6) + 0.0]) AS rgb FROM embeddings")
def img_color(spark, sf_dir):
    """Brightness in one hue (1.625 / 6, saturation 0.64)."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("pixels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            images = b.column("pixels")
            pixels = images.flatten()
            null, v = pixels.is_null().to_numpy(zero_copy_only=False), pixels.to_numpy(zero_copy_only=False)
            # SQL orders NaN above all numbers.
            unit = kernels.normalize(np.where(np.isnan(v), np.inf, v), -0.2, 0.2)
            rgb = _half_up(kernels.hsv_to_rgb(unit, 1.625 / 6, 0.64), 6)
            colors = pa.ListArray.from_arrays(np.arange(0, rgb.size + 1, 3, dtype=np.int32), pa.array(rgb.ravel(), mask=np.repeat(null, 3)))
            ends = np.cumsum(images.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int32)
            out = pa.ListArray.from_arrays(np.append(np.int32(0), ends), colors, mask=images.is_null())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), out], names=["vec_id", "rgb"])

    return rows.mapInArrow(run, "vec_id long, rgb array<array<double>>")


@query("SELECT n_nationkey, struct.u AS u, struct.i AS i FROM (SELECT n_nationkey, {'u': CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey::HUGEINT ELSE 18446744073709551616 - n_nationkey END::DECIMAL(20, 0)::VARCHAR, 'i': CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey ELSE -n_nationkey END::BIGINT} AS struct FROM nation)")
def numbers_64(spark, sf_dir):
    """Signed 64-bit numbers read as unsigned, and back."""
    from ..functions import numbers

    x = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey")).otherwise(-F.col("n_nationkey")).cast("long")
    u = numbers.uint64(x)
    return table(spark, sf_dir, "nation").select("n_nationkey", u.cast("string").alias("u"), numbers.int64(u).alias("i"))


@query(" UNION ALL ".join(f"SELECT '{p}' AS population, count(*) FILTER ({HIERARCHY_SQL[p]}) AS count FROM lineitem" for p in ("All", "Rect", "Poly", "Oval", "Cheap", "Rest")))
def daf_definitions(spark, sf_dir):
    """Regions, populations, graphs and combined features through analysis files, applied to the objects read from them."""
    objects = hierarchy(spark, sf_dir)
    objects = objects.remove(pops=["Tagged"], list_only=False)
    objects = objects.edit(objects.catalog.add_graphs(Graph("scatter", "l_quantity", "l_extendedprice", shown=("Rect", "Poly"), regions=("rect",)), Graph("histogram", "unit price", shown=("Cheap",))))
    folder = new_path(spark, "definitions")
    daf.write_daf(objects, folder).collect()
    again = files.read(spark, f"{folder}/*.daf")
    assert again.catalog.graphs == objects.catalog.graphs and again.catalog.pops == objects.catalog.pops and again.catalog.regions == objects.catalog.regions
    return count_pops(again).select("population", "count")


@query("SELECT count(*) AS objects, 1 AS least_test, 0 AS problems, (count(*) + 99) // 100 >= 1 AS estimated FROM embeddings")
def container_probe(spark, sf_dir):
    """Containers checked directory by directory: objects declared in all, no cycle, overlap or strip outside a file."""
    found = container.probe(spark, f"{_in_order(spark, sf_dir, 'probed', objects_per_file=100)}/*.cif")
    return found.agg(F.sum("objects").alias("objects"), F.min("test").alias("least_test"), F.sum(F.size("problems")).cast("int").alias("problems"), F.every(F.col("estimated") >= F.col("objects")).alias("estimated"))


_KEYS = {"$BYTEORD": "1,2,3,4", "$DATATYPE": "I", "$MODE": "L", "$NEXTDATA": "0", "$PAR": "1", "$BEGINDATA": "1", "$ENDDATA": "2", "$BEGINSTEXT": "0", "$ENDSTEXT": "0", "$BEGINANALYSIS": "0", "$ENDANALYSIS": "0", "$P1N": "a", "$P1B": "16", "$P1R": "1024"}


@query("SELECT p_partkey, list_sort(list_filter([CASE WHEN p_size % 5 = 0 THEN '$TOT is 0' END, CASE WHEN p_size % 3 = 1 THEN '$P1E one number is 0' END, CASE WHEN (p_size % 3 = 2 AND p_size % 4 <> 1) OR (p_size % 3 = 1 AND p_size % 4 = 0) THEN '$P1G with logarithmic amplification' END, CASE WHEN p_size % 4 = 0 THEN '$P1G not above 0' END, CASE WHEN p_size % 7 = 0 THEN '$MODE unknown' END], lambda x: x IS NOT NULL)) AS problems FROM part")
def fcs_problems(spark, sf_dir):
    """Keywords of a data set for each row against the rules of their version."""
    e = F.get(F.array(F.lit("0,0"), F.lit("4,0"), F.lit("4,1")), F.col("p_size") % 3)
    mode = F.when(F.col("p_size") % 7 == 0, "Q").otherwise("L")
    given = {**{k: F.lit(v) for k, v in _KEYS.items()}, "$VERSION": F.lit("FCS3.0"), "$TOT": (F.col("p_size") % 5).cast("string"), "$P1E": e, "$P1G": F.when(F.col("p_size") % 3 == 2, F.col("p_size") % 4).when(F.col("p_size") % 4 == 0, 0).otherwise(1).cast("string"), "$MODE": mode}
    keys = F.create_map(*(x for k, v in given.items() for x in (F.lit(k), v)))
    found = fcs_rules.problems(F.col("keys"))
    told = F.array_sort(F.transform(found, lambda p: F.concat(p["keyword"], F.lit(" "), p["problem"])))
    # The rules cost far more than the rows, of which one task would read a hundred thousands.
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition("p_partkey")
    return rows.select("p_partkey", keys.alias("keys")).select("p_partkey", told.alias("problems"))
