"""Image containers (RIF / CIF): a TIFF whose first directory describes the run and
whose others hold an image and a mask for each object in turn.

The chain of directories is a linked list, so one task walks a file, reading
directories alone; strips and features are then read in byte ranges by many tasks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.store import saved
from .parts import write_parts
from .ranged import GAP, PART_BYTES, Ranged, listed, short

#: Field type: size in bytes and struct code.
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d")}
WIDTH, LENGTH, COMPRESSION, STRIP, STRIP_BYTES = 256, 257, 259, 273, 279
KIND, OBJECT_ID, COUNT, FEATURES, FEATURES_OLD = 33002, 33003, 33018, 33080, 33083
BG_MEAN, BG_STD, SAT_COUNT, SAT_PERCENT = 33052, 33053, 33054, 33055
SPEED, CAMERA_LINE, CAMERA_TIMER, CENTRE_X, CENTRE_Y, CHANNELS = 33012, 33016, 33017, 33071, 33072, 33000
BITS, PHOTOMETRIC, SAMPLES, STRIP_ROWS, SAMPLE_FORMAT = 258, 262, 277, 278, 339
SHORT = (COMPRESSION, BITS, PHOTOMETRIC, SAMPLES, SAMPLE_FORMAT)
FIRST, IMAGE, MASK = 1, 2, 3
DATE, INSTRUMENT, CHANNEL_WIDTH, CROSSTALK, ORIGIN, ACQUISITION, MERGED_CIF, MERGED, ASSIST, SOFTWARE, SOFTWARE_RAW, SUBSET = 33004, 33006, 33009, 33020, 33026, 33027, 33029, 33030, 33064, 33066, 33069, 33070
#: Where an object was before files were joined or cut down: its ids and files, oldest first.
ORIGIN_IDS, ORIGIN_FILES = 33093, 33094
#: Fields that a writer sets anew, of strips and of the first directory; others are carried over.
PLACED = frozenset({WIDTH, LENGTH, COMPRESSION, STRIP, STRIP_BYTES, KIND, OBJECT_ID})
COUNTED = frozenset({KIND, COUNT, FEATURES, FEATURES_OLD, 33081, 33082, MERGED_CIF, MERGED, SUBSET})
TEXTS = frozenset({DATE, INSTRUMENT, ORIGIN, ACQUISITION, MERGED, ASSIST, SOFTWARE, SOFTWARE_RAW})


def byte_order(data: bytes) -> str:
    if data[:4] == b"II*\0":
        return "<"
    if data[:4] == b"MM\0*":
        return ">"
    raise ValueError("no container: the TIFF mark is missing")


#: A field as it is in the file: type, count and its bytes, the lowest first.
Field = tuple[int, int, bytes]


def _entries(data: bytes | Ranged, at: int, order: str, wanted: frozenset[int] | None = None) -> tuple[list[tuple[int, int, int, bytes]], int]:
    """Tag, type, count and bytes of the fields of a directory, and where the next one is.
    Feature matrices are left where they are: their field is the place."""
    head = data[at : at + 2]
    n = struct.unpack(order + "H", head)[0] if len(head) == 2 else 0
    body = data[at + 2 : at + 6 + 12 * n]
    if len(head) < 2 or len(body) < 12 * n + 4:
        raise ValueError(f"the directory at {at} ends outside the file")
    out = []
    for p in range(0, 12 * n, 12):
        tag, kind, count = struct.unpack_from(order + "HHI", body, p)
        if kind not in TYPES or (wanted is not None and tag not in wanted):
            continue
        if tag in (FEATURES, FEATURES_OLD):
            kind, count = 4, 1
        size = TYPES[kind][0] * count
        if size <= 4:
            value = body[p + 8 : p + 8 + size]
        else:
            place = struct.unpack_from(order + "I", body, p + 8)[0]
            value = data[place : place + size]
        if len(value) == size:
            out.append((tag, kind, count, value))
    return out, struct.unpack_from(order + "I", body, 12 * n)[0]


def directory(data: bytes | Ranged, at: int, order: str, wanted: frozenset[int] | None = None) -> tuple[dict[int, tuple], int]:
    """Values of each (or each ``wanted``) tag of the directory at ``at``, and where the
    next one is. A directory that passes the file's end is an error; a field that does is left out."""
    found, following = _entries(data, at, order, wanted)
    tags: dict[int, tuple] = {}
    for tag, kind, count, value in found:
        code = TYPES[kind][1]
        tags[tag] = (value.rstrip(b"\0"),) if code == "s" else struct.unpack(f"{order}{count * len(code)}{code[0]}", value)
    return tags, following


def in_order(value: bytes, kind: int, order: str) -> bytes:
    """Bytes of a field between ``order`` and lowest first, either way."""
    unit = struct.calcsize("<" + TYPES[kind][1][0])
    return value if order == "<" or unit == 1 else np.frombuffer(value, f"u{unit}").byteswap().tobytes()


def fields(data: bytes | Ranged, at: int, order: str, without: frozenset[int] = frozenset()) -> dict[int, Field]:
    """Every field of a directory as it is, but for some tags."""
    return {tag: (kind, count, in_order(value, kind, order)) for tag, kind, count, value in _entries(data, at, order)[0] if tag not in without}


def directories(data: bytes | Ranged, wanted: frozenset[int] | None = None) -> Iterator[tuple[int, dict[int, tuple], str | None]]:
    """Place, tags and what is wrong (a cycle, an end outside the file; the chain
    ends there) of each directory."""
    order = byte_order(data[:4])
    head = data[4:8]
    at, seen = struct.unpack(order + "I", head)[0] if len(head) == 4 else 0, set()
    while at:
        if at in seen:
            yield at, {}, "cycle"
            return
        seen.add(at)
        try:
            tags, following = directory(data, at, order, wanted)
        except ValueError:
            yield at, {}, "directory outside the file"
            return
        yield at, tags, None
        at = following


def kind_of(tags: dict[int, tuple]) -> str:
    return {FIRST: "first", IMAGE: "img", MASK: "msk"}.get(tags.get(KIND, (0,))[0], "other")


OFFSETS = ("import_file", "position", "offset", "kind", "object_id", "width", "height", "compression")
DIRECTORIES = "path string, import_file string, length long, position long, offset long, kind string, object_id long, width int, height int, compression int, strip long, strip_bytes long, bg_mean array<double>, bg_std array<double>, sat_count array<double>, sat_percent array<double>, speed double, camera_line double, camera_timer double, centre_x double, centre_y double, problem string, origin_ids array<long>, origin_files array<string>"
LISTS = {"bg_mean": BG_MEAN, "bg_std": BG_STD, "sat_count": SAT_COUNT, "sat_percent": SAT_PERCENT}
SINGLE = {"speed": SPEED, "camera_line": CAMERA_LINE, "camera_timer": CAMERA_TIMER, "centre_x": CENTRE_X, "centre_y": CENTRE_Y}
WALKED = frozenset({KIND, OBJECT_ID, WIDTH, LENGTH, COMPRESSION, STRIP, STRIP_BYTES, *LISTS.values(), *SINGLE.values(), ORIGIN_IDS, ORIGIN_FILES})


def read_directories(spark: SparkSession, paths: str | list[str], counted: Accumulator | None = None) -> DataFrame:
    """A row per directory (DIRECTORIES), as a saved table: strips aren't read."""
    names = [f.split()[0] for f in DIRECTORIES.split(", ")]
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), *[pa.int32()] * 3, *[pa.int64()] * 2, *[pa.list_(pa.float64())] * 4, *[pa.float64()] * 5, pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, length in zip(b.column("path").to_pylist(), b.column("length").to_pylist()):
                rows = []
                for k, (at, t, wrong) in enumerate(directories(Ranged(path, counted=counted), WALKED)):
                    one = lambda tag: t.get(tag, (None,))[0]  # noqa: B023, E731
                    past = [[x.decode("utf-8", "replace") for x in (one(tag) or b"").split(b">") if x] for tag in (ORIGIN_IDS, ORIGIN_FILES)]
                    rows.append((path, short(path), length, k, at, kind_of(t), *map(one, (OBJECT_ID, WIDTH, LENGTH)), one(COMPRESSION), one(STRIP), one(STRIP_BYTES), *([float(x) for x in t.get(c, ())] for c in LISTS.values()), *(None if one(c) is None else float(one(c)) for c in SINGLE.values()), wrong, [int(x) for x in past[0]], past[1]))
                    if len(rows) == 1 << 14:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return saved(listed(spark, paths).mapInArrow(run, DIRECTORIES), "directories")


def read_offsets(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """import_file, position in the chain, offset, kind (first, img, msk), object_id
    and size of every directory."""
    return read_directories(spark, paths).filter("problem is null").select(*OFFSETS)


def probe(spark: SparkSession, paths: str | list[str], directories: DataFrame | None = None) -> DataFrame:
    """Whether files are sound: import_file, test (1: image and mask follow the first
    directory; 0: no mask; -1: no container), objects (declared), estimated
    (from the file's length where none are declared) and problems, an array of
    (problem, offset): cycle, directory outside the file, strip outside the file, overlap."""
    dirs = read_directories(spark, paths) if directories is None else directories
    declared = read_first(spark, paths, frozenset({COUNT})).select("path", F.coalesce(F.element_at("numbers", COUNT)[0].cast("long"), F.lit(0)).alias("objects"))
    end = F.col("strip") + F.col("strip_bytes")
    outside = F.when(end > F.col("length"), "strip outside the file")
    wrong = dirs.select("path", F.coalesce("problem", outside).alias("problem"), F.col("offset").alias("offset")).filter("problem is not null")
    # Strips in order of place, in ranges of the file: each looks at the furthest end before it there, and
    # ranges at the furthest end of those before them.
    strips = dirs.filter("strip_bytes > 0").select("path", "offset", "strip", end.alias("end"), F.floor(F.col("strip") / PART_BYTES).alias("range"))
    within = Window.partitionBy("path", "range").orderBy("strip", "offset").rowsBetween(Window.unboundedPreceding, -1)
    ranges = strips.groupBy("path", "range").agg(F.max("end").alias("furthest"))
    ahead = ranges.select("path", "range", F.max("furthest").over(Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("ahead"))
    overlap = strips.withColumn("before", F.max("end").over(within)).join(ahead, ["path", "range"])
    wrong = wrong.unionByName(overlap.filter(F.greatest("before", "ahead") > F.col("strip")).select("path", F.lit("overlap").alias("problem"), "offset"))
    wrong = wrong.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("problem", "offset"))).alias("problems"))
    at = lambda k, c: F.max(F.when(F.col("position") == k, F.col(c)))
    first = dirs.filter("position < 4").groupBy("path").agg(F.max("import_file").alias("import_file"), F.max("length").alias("length"), *(at(k, c).alias(f"{c}{k}") for k in range(4) for c in ("kind", "offset")))
    test = F.when((F.col("kind0") != "first") | F.coalesce(F.col("kind1") != "img", F.lit(True)), -1).when(F.coalesce(F.col("kind2") == "msk", F.lit(False)), 1).otherwise(0)
    step = F.coalesce(F.abs(F.col("offset2") - F.col("offset1")), F.lit(0)) + F.coalesce(F.abs(F.col("offset3") - F.col("offset2")), F.lit(0))
    out = first.join(declared, "path").join(wrong, "path", "left").withColumn("test", test)
    guess = F.when(step > 0, F.ceil(F.col("length") * F.when(F.col("test") == 0, 2).otherwise(1) / step))
    estimated = F.when(F.col("objects") > 0, F.col("objects")).otherwise(F.coalesce(guess, F.lit(0)))
    none = F.array().cast("array<struct<problem:string,offset:bigint>>")
    return out.select("import_file", "test", "objects", estimated.cast("long").alias("estimated"), F.coalesce("problems", none).alias("problems"))


def image_rows(directories: DataFrame) -> DataFrame:
    """A row per object from ``read_directories``, as analysis files hold them
    (``daf.IMAGE_SCHEMA``): where image and mask are, size, camera fields, centre, lists of
    channels. What a file doesn't tell is 0, or an empty list."""
    at = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    zero = lambda c, kind="double": F.coalesce(c, F.lit(0)).cast(kind)
    names = {"w": "width", "l": "height", "fs": "speed", "cl": "camera_line", "ct": "camera_timer", "objCenterX": "centre_x", "objCenterY": "centre_y"}
    lists = {"bgstd": "bg_std", "bgmean": "bg_mean", "satcount": "sat_count", "satpercent": "sat_percent"}
    found = directories.filter("kind in ('img', 'msk') and object_id is not null").groupBy("import_file", F.col("object_id").alias("id"))
    none = F.array().cast("array<double>")
    return found.agg(
        zero(at("img", "offset"), "long").alias("imgIFD"), zero(at("msk", "offset"), "long").alias("mskIFD"), F.lit(0).cast("long").alias("spIFD"),
        *(zero(at("img", c)).alias(n) for n, c in names.items()), *(F.coalesce(at("img", c), none).alias(n) for n, c in lists.items()),
    )


STRIPS = "import_file string, object_id long, kind string, offset long, width int, height int, channels int, compression int, bg_mean array<double>, bg_std array<double>, data binary, path string"
FIELDS = "fields array<struct<tag:int,type:int,count:long,value:binary>>"


def read_strips(spark: SparkSession, paths: str | list[str], channels: int | None = None, objects: list[int] | DataFrame | None = None, kinds: tuple[str, ...] = ("img", "msk"), directories: DataFrame | None = None, counted: Accumulator | None = None, tags: bool = False) -> DataFrame:
    """The still encoded strip of each image and mask, ready for
    ``operators.images.decoded``. ``objects``: wanted ids, or a table with object_id (and
    import_file, to choose by file); only their bytes are read. The number of
    ``channels`` comes from each file's description of the run, unless it is given. With ``tags``, the tasks also read
    the directories of their strips: fields (FIELDS), all but PLACED, for ``write_strips`` and ``write_tiff``."""
    names = [f.split()[0] for f in STRIPS.split(", ")]
    types = (pa.string(), pa.int64(), pa.string(), pa.int64(), *[pa.int32()] * 4, *[pa.list_(pa.float64())] * 2, pa.binary(), pa.string())
    if tags:
        names, types = [*names, "fields"], (*types, pa.list_(pa.struct([("tag", pa.int32()), ("type", pa.int32()), ("count", pa.int64()), ("value", pa.binary())])))
    dirs = read_directories(spark, paths, counted) if directories is None else directories
    keep = dirs.filter(F.col("kind").isin(*kinds) & F.col("strip").isNotNull() & F.col("strip_bytes").isNotNull())
    if isinstance(objects, DataFrame):
        keys = [c for c in ("import_file", "object_id") if c in objects.columns]
        keep = keep.join(objects.select(*keys).distinct(), keys, "left_semi")
    elif objects is not None:
        keep = keep.filter(F.col("object_id").isin(*objects))
    if channels is None:
        from .run import read_run

        used = read_run(spark, paths, counted=counted).select("path", F.size(F.filter("channels_in_use", lambda x: x)).alias("channels"))
        keep = keep.join(used, "path", "left").withColumn("channels", F.when(F.col("channels") > 0, F.col("channels")).otherwise(F.raise_error(F.concat(F.col("path"), F.lit(": no channels in its description; give their number"))).cast("int")))
    else:
        keep = keep.withColumn("channels", F.lit(channels))
    total = keep.agg(F.sum("strip_bytes")).first()[0] or 0
    n = -(-int(total) // PART_BYTES) or 1
    keep = keep.repartitionByRange(n, "path", "strip").sortWithinPartitions("path", "strip")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = data = None
        for b in batches:
            rows, out, held = b.to_pylist(), [], 0
            for i, r in enumerate(rows):
                if r["path"] != path:
                    path, data, heads = r["path"], Ranged(r["path"], 0, counted), Ranged(r["path"], counted=counted) if tags else b""
                    order = byte_order(heads[:4]) if tags else ""
                    window, upto = b"", -1
                if r["strip"] + r["strip_bytes"] > upto:
                    # As far as the next strips follow closely, they are read together.
                    begin = upto = r["strip"]
                    for x in rows[i:]:
                        end = x["strip"] + x["strip_bytes"]
                        if x["path"] != path or x["strip"] > upto + GAP or (end > begin + PART_BYTES and upto > begin):
                            break
                        upto = max(upto, end)
                    window = data[begin:upto]
                strip = window[r["strip"] - begin : r["strip"] - begin + r["strip_bytes"]]
                row = (r["import_file"], r["object_id"], r["kind"], r["offset"], r["width"], r["height"], r["channels"], r["compression"] or 1, r["bg_mean"], r["bg_std"], strip, path)
                out.append((*row, [(t, *f) for t, f in fields(heads, r["offset"], order, PLACED).items()]) if tags else row)
                held += len(strip)
                if held > PART_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), types)], names=names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), types)], names=names)

    return keep.drop("length", "position", "problem", "sat_count", "sat_percent", "origin_ids", "origin_files", *SINGLE).mapInArrow(run, f"{STRIPS}, {FIELDS}" if tags else STRIPS)


FIRSTS = "path string, import_file string, byte_order string, numbers map<int,array<double>>, texts map<int,binary>"


def read_first(spark: SparkSession, paths: str | list[str], wanted: frozenset[int] | None = None, counted: Accumulator | None = None) -> DataFrame:
    """The first directory of each file: path, import_file, byte_order and its tags' values, numbers or text."""
    names = ["path", "import_file", "byte_order", "numbers", "texts"]
    kinds = (pa.string(), pa.string(), pa.string(), pa.map_(pa.int32(), pa.list_(pa.float64())), pa.map_(pa.int32(), pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                data = Ranged(path, counted=counted)
                order = byte_order(data[:4])
                at = struct.unpack(order + "I", data[4:8])[0]
                try:
                    tags = directory(data, at, order, wanted)[0]
                except ValueError:
                    tags = {}
                # Texts have type 2, or type 1 and 7 (bytes) for descriptions.
                texts = {k: v[0] if isinstance(v[0], bytes) else bytes(v) for k, v in tags.items() if v and (isinstance(v[0], bytes) or k in TEXTS)}
                numbers = {k: [float(x) for x in v] for k, v in tags.items() if k not in texts}
                row = (path, short(path), order, list(numbers.items()), list(texts.items()))
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, kinds)], names=names)

    return listed(spark, paths).mapInArrow(run, FIRSTS)


def subset_ids(offsets: DataFrame, objects: DataFrame | list[int]) -> DataFrame:
    """Offsets of the wanted objects with new ids from 0, in the old order."""
    from ..operators.merge import ranks

    keep = offsets.filter(F.col("object_id").isin(*objects)) if isinstance(objects, list) else offsets.join(objects.select("object_id").distinct(), "object_id", "left_semi")
    new = ranks(keep.select("object_id").distinct(), "object_id", "new_id")
    return keep.join(new, "object_id").withColumn("new_id", F.col("new_id") - 1)


def _matrix(data: bytes | Ranged, n_names: int) -> tuple[str, int, int]:
    """Byte order, place and rows of the feature matrix that the first directory
    points to: two counts, then 32-bit floats row by row."""
    order = byte_order(data[:4])
    tags, _ = directory(data, struct.unpack(order + "I", data[4:8])[0], order, frozenset({FEATURES, FEATURES_OLD, COUNT}))
    at = tags[FEATURES][0] if FEATURES in tags else tags[FEATURES_OLD][0]
    if FEATURES in tags:  # places have 32 bits; a matrix lies at the end of a larger file
        at += len(data) >> 32 << 32
    rows, n = (int(v) for v in struct.unpack(order + "ff", data[at : at + 8]))
    if COUNT in tags and tags[COUNT][0] != rows:
        raise ValueError(f"{rows} rows of features for {tags[COUNT][0]} objects")
    if n != n_names:
        raise ValueError(f"{n} features, {n_names} names")
    return order, at + 8, rows


def features(data: bytes, names: list[str]) -> np.ndarray:
    """The feature matrix of a whole file."""
    order, at, rows = _matrix(data, len(names))
    return np.frombuffer(data, order + "f4", rows * len(names), at).reshape(rows, len(names)).astype(float)


def read_features(spark: SparkSession, paths: str | list[str], names: list[str], counted: Accumulator | None = None, directories: DataFrame | None = None) -> DataFrame:
    """import_file, object_number and the stored features, read in ranges of rows. An
    object's number is its row in the file; with ``directories`` (``read_directories``), its id:
    the row where a file's ids are below its number of rows, else the ids take the rows in their order."""
    out = _feature_rows(spark, paths, names, counted)
    if directories is not None:
        out = _with_ids(out, directories)
    return out.drop("_path", "_total")


def _with_ids(rows: DataFrame, directories: DataFrame) -> DataFrame:
    """``rows`` of ``_feature_rows`` with ids of objects instead of numbers of rows."""
    from ..operators.merge import ranks
    from ..operators.populations import named

    key = F.struct("path", "object_id").alias("_key")
    places = ranks(directories.filter("kind in ('img', 'msk') and object_id is not null").select(key).distinct(), "_key", "_rank")
    places = saved(places.select(F.col("_key.path").alias("_path"), F.col("_key.object_id").alias("_id"), "_rank"), "ids")
    first = places.groupBy("_path").agg(F.min("_rank").alias("_first"), F.max("_id").alias("_last"))
    numbered = places.join(first, "_path").select("_path", "_id", (F.col("_rank") - F.col("_first")).alias("object_number"))
    found = rows.join(first.select("_path", "_last"), "_path", "left").join(numbered, ["_path", "object_number"], "left")
    own = F.col("_id").isNull() | (F.col("_last") < F.col("_total"))
    return found.withColumn("object_number", F.when(own, F.col("object_number")).otherwise(F.col("_id"))).select(*map(named, rows.columns))


def _feature_rows(spark: SparkSession, paths: str | list[str], names: list[str], counted: Accumulator | None = None) -> DataFrame:
    """What ``read_features`` gives, with _path and the file's number of rows, _total."""
    schema = "import_file string, object_number long" + "".join(f", `{n.replace('`', '``')}` double" for n in names) + ", _path string, _total long"
    step, per = 4 * len(names), max(1, PART_BYTES // (4 * len(names)))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                data = Ranged(path, counted=counted)
                order, at, rows = _matrix(data, len(names))
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (path, order, at, rows)], names=["path", "order", "at", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                first = r["range"] * per
                n = min(per, r["rows"] - first)
                raw = Ranged(r["path"], 0, counted)[r["at"] + first * step : r["at"] + (first + n) * step]
                x = np.frombuffer(raw, r["order"] + "f4").reshape(-1, len(names)).astype(float)
                cols = [pa.array([short(r["path"])] * len(x)), pa.array(np.arange(first, first + len(x))), *(pa.array(np.ascontiguousarray(x[:, i])) for i in range(len(names)))]
                cols += [pa.array([r["path"]] * len(x)), pa.array([r["rows"]] * len(x), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["import_file", "object_number", *names, "_path", "_total"])

    found = saved(listed(spark, paths).mapInArrow(heads, "path string, order string, at long, rows long").filter("rows > 0"), "heads")
    ranges = found.withColumn("range", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / per))))
    n = found.agg(F.sum(F.floor((F.col("rows") - 1) / per) + 1)).first()[0] or 1
    return ranges.repartition(int(n)).mapInArrow(run, schema)


def stored_names(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """Names of the features that the files store, from their own definitions: none
    where a file stores none, or not all store the same."""
    from . import daf, run

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                root = run.embedded(dict(r["texts"]))
                known = daf.definitions(root).features if {FEATURES, FEATURES_OLD} & set(dict(r["numbers"])) else {}
                names = [u.get("name") for u in root.iter("UDF") if u.get("name") in known and known[u.get("name")].type != "combined"]
                yield pa.RecordBatch.from_arrays([pa.array([names], pa.list_(pa.string()))], names=["names"])

    firsts = read_first(spark, paths, frozenset({FEATURES, FEATURES_OLD, ACQUISITION}))
    found = firsts.mapInArrow(named, "names array<string>").distinct().limit(2).collect()
    return list(found[0]["names"]) if len(found) == 1 else []


#: Values of tags that a writer is given: numbers, text, reals, or fields as they were.
Tags = dict[int, int | bytes | list[float] | Field]


def encode(objects: list[tuple[int, np.ndarray, np.ndarray]], matrix: np.ndarray | None = None, order: str = "<", about: Tags | None = None) -> bytes:
    """A container of (id, image, mask): differences for images, runs for masks."""
    from ..operators.images import DELTA, RUNS, delta_encode, run_encode

    strips = []
    for oid, image, mask in objects:
        strips.append((oid, IMAGE, *image.shape, DELTA, delta_encode(image)))
        strips.append((oid, MASK, *mask.shape, RUNS, run_encode(mask)))
    return encode_strips(strips, matrix, order, about)


def encode_strips(strips: list[tuple], matrix: np.ndarray | None = None, order: str = "<", about: Tags | None = None, run: bool = True) -> bytes:
    """A container of (id, kind, height, width, compression, strip and, if any, more
    tags) in this order; ``about``: tags of the run for the first directory, which is
    left out without ``run``."""
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + b"\0\0\0\0")
    link = 4

    def put(tags: Tags) -> None:
        nonlocal link
        fields = []
        for tag, value in sorted(tags.items()):
            if isinstance(value, int):
                kind, n, data = (3, 1, struct.pack(order + "HH", value, 0)) if tag in SHORT else (4, 1, struct.pack(order + "I", value))
            elif isinstance(value, tuple):
                kind, n, data = value[0], value[1], in_order(value[2], value[0], order)
            elif isinstance(value, bytes):
                kind, n, data = 2, len(value) + 1, value + b"\0"
            else:
                kind, n, data = 12, len(value), struct.pack(f"{order}{len(value)}d", *value)
            if len(data) > 4:
                data, place = struct.pack(order + "I", len(out)), data
                out.extend(place)
            fields.append(struct.pack(order + "HHI", tag, kind, n) + data.ljust(4, b"\0"))
        struct.pack_into(order + "I", out, link, len(out))
        out.extend(struct.pack(order + "H", len(fields)) + b"".join(fields))
        link = len(out)
        out.extend(b"\0\0\0\0")

    if not run:
        about, matrix = None, None
    first: Tags = {**(about or {}), KIND: FIRST, COUNT: len({s[0] for s in strips})}
    if matrix is not None:
        first[FEATURES] = len(out)
        out.extend(struct.pack(order + "ff", *matrix.shape) + np.asarray(matrix, order + "f4").tobytes())
    if run:
        put(first)
    for oid, kind, height, width, compression, data, *more in strips:
        at = len(out)
        out.extend(data)
        put({WIDTH: width, LENGTH: height, COMPRESSION: compression, STRIP: at, STRIP_BYTES: len(data), KIND: kind, OBJECT_ID: oid, **(more[0] if more else {})})
    return bytes(out)


def write_images(df: DataFrame, folder: str, objects_per_file: int = 1 << 14, about: Tags | None = None, features: list[str] | None = None) -> DataFrame:
    """Containers of objects (object_id, height, width, pixels, mask: whole numbers): file, rows.
    ``about``: tags of the run (``run.Run.tags``); ``features``: columns stored with them,
    in the order of the definitions that the run holds."""
    values = [F.col("`" + n.replace("`", "``") + "`").cast("double") for n in features or ()]
    stored = bool(values)

    def put(table: pa.Table) -> bytes:
        rows = sorted(table.to_pylist(), key=lambda r: r["object_id"])  # a file's ids take its rows of features in order
        matrix = np.array([r["features"] for r in rows], float) if stored else None
        return encode([(r["object_id"], *(np.array(r[c], np.int64).reshape(r["height"], r["width"]) for c in ("pixels", "mask"))) for r in rows], matrix, about=about)

    return write_parts(df.select("object_id", "height", "width", "pixels", "mask", F.array(*values).alias("features")), folder, "cif", put, objects_per_file)


def write_tiff(strips: DataFrame, folder: str, pages_per_file: int = 1 << 12, order: str = "<") -> DataFrame:
    """TIFF files of decoded pixels (16 bits, a strip a page) from still encoded strips: file,
    rows. Pages are by file, object and kind; each keeps its object, kind and channel lists as
    tags, and all others if the strips were read with ``tags``."""
    from ..operators.images import PLAIN, raw16

    numbers = F.when(F.col("kind") == "img", IMAGE).otherwise(MASK)
    rows = strips.select("path", "object_id", numbers.alias("number"), "height", "width", "compression", "data", "bg_mean", "bg_std", *(["fields"] if "fields" in strips.columns else []))
    rows = rows.repartition("path", "object_id").sortWithinPartitions("path", "object_id", "number")

    def put(table: pa.Table) -> bytes:
        pages = []
        for b in table.to_batches():
            for r in b.to_pylist():
                more = {BITS: 16, PHOTOMETRIC: 1, SAMPLES: 1, SAMPLE_FORMAT: 1, STRIP_ROWS: r["height"]} | {t: list(r[c]) for t, c in ((BG_MEAN, "bg_mean"), (BG_STD, "bg_std")) if r[c]}
                more = _kept(r) | more
                pages.append((r["object_id"], r["number"], r["height"], r["width"], PLAIN, raw16(r["data"], r["height"], r["width"], r["compression"], order), more))
        return encode_strips(pages, None, order, run=False)

    return write_parts(rows, folder, "tif", put, pages_per_file)


def _kept(r: dict) -> Tags:
    """The fields that a strip was read with."""
    return {f["tag"]: (f["type"], f["count"], f["value"]) for f in r.get("fields") or ()}


def _past(r: dict) -> Tags:
    """The fields that a strip was read with; where it comes from is added to where it was before."""
    tags = _kept(r)
    for tag, now in ((ORIGIN_IDS, r.get("origin_id")), (ORIGIN_FILES, r.get("origin_file"))):
        if now is not None:
            before = tags[tag][2].rstrip(b"\0") + b">" if tag in tags else b""
            tags[tag] = before + str(now).encode()
    return tags


def write_strips(strips: DataFrame, folder: str, objects_per_file: int = 1 << 14, about: Tags | None = None) -> DataFrame:
    """Containers of still encoded strips (as ``read_strips`` gives them, object_id no
    longer repeated between files): file, rows; the image and mask of an object are one row. Kept, if
    the columns are there: fields (FIELDS), origin_id and origin_file (added to those of
    before), features (an array on image strips; null: unknown values)."""
    numbers = F.when(F.col("kind") == "img", IMAGE).when(F.col("kind") == "msk", MASK).alias("number")
    more = [c for c in ("fields", "origin_id", "origin_file") if c in strips.columns]
    stored = "features" in strips.columns
    parts = F.struct(numbers, *("height", "width", "compression", "data", "bg_mean", "bg_std", *more))
    values = F.max(F.when(F.col("kind") == "img", F.col("features"))).alias("features") if stored else F.lit(None).alias("features")
    rows = strips.filter("kind in ('img', 'msk')").groupBy("object_id").agg(F.array_sort(F.collect_list(parts)).alias("strips"), values)

    def put(table: pa.Table) -> bytes:
        out, rows = [], table.to_pylist()
        for r in rows:
            for x in r["strips"]:
                lists = {t: list(x[c]) for t, c in ((BG_MEAN, "bg_mean"), (BG_STD, "bg_std")) if x[c]}
                out.append((r["object_id"], x["number"], x["height"], x["width"], x["compression"], x["data"], lists | _past(x)))
        width = max((len(r["features"]) for r in rows if r["features"]), default=0)
        matrix = np.array([r["features"] or [np.nan] * width for r in rows], float) if stored else None
        return encode_strips(out, matrix, about=about)

    return write_parts(rows.sortWithinPartitions("object_id"), folder, "cif", put, objects_per_file)


def renumbered(strips: DataFrame) -> DataFrame:
    """Strips of one or several files with object ids from 0 over all, by path, then id."""
    from ..operators.merge import ranks

    key = F.struct("path", "object_id")
    new = ranks(strips.select(key.alias("_key")).distinct(), "_key", "_new")
    out = strips.withColumn("_key", key).join(new, "_key")
    return out.withColumn("object_id", F.col("_new") - 1).drop("_key", "_new")


def _run_tags(spark: SparkSession, path: str) -> Tags:
    """The fields of a file's first directory, but for those that a writer sets anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                data = Ranged(path)
                order = byte_order(data[:4])
                found = fields(data, struct.unpack(order + "I", data[4:8])[0], order, COUNTED)
                cols = zip(*((t, *f) for t, f in found.items())) if found else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["tag", "type", "count", "value"])

    return {r["tag"]: (r["type"], r["count"], bytes(r["value"])) for r in listed(spark, path).mapInArrow(run, "tag int, type int, count long, value binary").collect()}


def merge_files(spark: SparkSession, paths: str | list[str], folder: str, objects: list[int] | DataFrame | None = None, objects_per_file: int = 1 << 14) -> DataFrame:
    """Containers joined, or cut down to ``objects`` (ids, or a table of object_id and, to
    choose by file, import_file), as new files with new ids from 0: file, rows (objects).

    Strips are copied as they are, with all fields of their directories; each says which
    file and id it comes from (origin_ids, origin_files of ``read_directories``). Features go
    with their objects where all files store the same ones. The run's description comes from the first file
    (by path), with the names of all (at most 64 of them) and whether objects were left out."""
    firsts = listed(spark, paths).orderBy("path")
    head = firsts.first()
    if head is None:
        raise ValueError(f"no files at {paths}")
    files = [short(r["path"]) for r in firsts.limit(64).collect()]
    about = _run_tags(spark, head["path"]) | {MERGED: "|".join(files).encode() if len(files) > 1 else b"", SUBSET: 0}
    dirs = read_directories(spark, paths)
    strips = read_strips(spark, paths, 1, objects, directories=dirs, tags=True)
    strips = strips.withColumn("origin_id", F.col("object_id")).withColumn("origin_file", F.col("import_file"))
    names = stored_names(spark, paths)
    if names:
        from ..operators.populations import named

        values = _with_ids(_feature_rows(spark, paths, names), dirs)
        wide = F.array(*map(named, names)).alias("features")
        values = values.select(F.col("_path").alias("path"), F.col("object_number").alias("object_id"), F.lit("img").alias("kind"), wide)
        strips = strips.join(values, ["path", "object_id", "kind"], "left")
    return write_strips(renumbered(strips), folder, objects_per_file, about)


def checksum(offsets: DataFrame) -> DataFrame:
    """Per file the sum of the image offsets of objects 0 to 4: what ``daf.checksum``
    of its analysis file has to be."""
    image = F.when((F.col("kind") == "img") & (F.col("object_id") < 5), F.col("offset"))
    return offsets.groupBy("import_file").agg(F.sum(image).alias("checksum"))
