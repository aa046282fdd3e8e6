"""FCS 2.0 to 3.2: keywords, list-mode events with scaling, and a writer.

A first pass reads headers and TEXT alone, a row per data set; events are then cut
into ranges of whole rows, which tasks read and decode by themselves. A file's
data sets follow each other through ``$NEXTDATA``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Accumulator, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import finite_or
from ..operators.store import saved
from .parts import place_of, put_whole
from .ranged import PART_BYTES, Ranged, listed, short

BLOCK = 1 << 16
WIDTHS = (8, 16, 32, 64)


def header(data: bytes, at: int = 0) -> tuple[str, list[int]]:
    """Version and the offsets of TEXT, DATA and ANALYSIS (start, end each)."""
    version = data[at : at + 6].decode("ascii", "replace")
    if not re.fullmatch(r"FCS\d\.\d", version):
        raise ValueError(f"no FCS file: it starts with {version!r}")
    fields = [data[at + 10 + 8 * i : at + 18 + 8 * i].decode("ascii", "replace").strip() for i in range(6)]
    return version, [int(x) if x.lstrip("+-").isdigit() else 0 for x in fields]


def text_pairs(data: bytes, encoding: str = "utf-8", empty: bool = False) -> list[tuple[str, str]]:
    """Keywords of a TEXT segment as they stand there; its first character parts them,
    and doubled stands for itself (unless ``empty`` values are allowed)."""
    text = data.decode(encoding, "replace")
    sep, body = text[:1], text[1:]
    if not sep:
        return []
    if empty:
        parts = body.split(sep)
    else:
        parts = [p.replace("\0", sep) for p in body.replace(sep + sep, "\0").split(sep)]
    parts = parts[:-1] if parts and not parts[-1].strip() else parts
    return list(zip(parts[::2], parts[1::2]))


def split_text(data: bytes, encoding: str = "utf-8", empty: bool = False) -> dict[str, str]:
    """Keywords of a TEXT segment, in upper case and without white space around."""
    return {k.strip().upper(): v.strip() for k, v in text_pairs(data, encoding, empty)}


def raw_pairs(data: bytes | Ranged, at: int = 0) -> tuple[str, list[tuple[str, str]]]:
    """Delimiter and pairs of a data set's own TEXT, repeated ones included."""
    ends = header(data, at)[1]
    text = data[at + ends[0] : at + ends[1] + 1]
    return text[:1].decode("utf-8", "replace"), [(k.upper(), v) for k, v in text_pairs(text)]


def _int(text: dict[str, str], key: str, other: int = 0) -> int:
    value = text.get(key, "").strip()
    return int(float(value)) if re.fullmatch(r"[+-]?\d+(\.\d*)?", value) else other


def keywords(data: bytes, at: int = 0, empty: bool = False) -> dict[str, str]:
    """All keywords of a data set; those of a supplemental TEXT only add."""
    version, ends = header(data, at)
    text = split_text(data[at + ends[0] : at + ends[1] + 1], empty=empty)
    a, b = _int(text, "$BEGINSTEXT"), _int(text, "$ENDSTEXT")
    if b > a > 0 and a != ends[0]:
        first = data[at + ends[0] : at + ends[0] + 1]
        more = data[at + a : at + b + 1]
        text = split_text(more if more[:1] == first else first + more, empty=empty) | text
    return {"$VERSION": version} | text


def datasets(data: bytes) -> Iterator[tuple[int, dict[str, str]]]:
    """Place and keywords of each data set of a file."""
    at, seen = 0, set()
    while at not in seen and at + 58 <= len(data):
        seen.add(at)
        text = keywords(data, at)
        yield at, text
        step = _int(text, "$NEXTDATA")
        if step <= 0:
            return
        at += step


def labels(text: dict[str, str]) -> list[str]:
    """``name < stain >`` of each parameter."""
    out = []
    for i in range(1, _int(text, "$PAR") + 1):
        name, stain = text.get(f"$P{i}N", f"P{i}"), text.get(f"$P{i}S", "")
        out.append(f"{name} < {stain} >" if stain else name)
    return out


def _segment(data: bytes, at: int, text: dict[str, str]) -> tuple[int, int]:
    version, ends = header(data, at)
    start, end = ends[2], ends[3]
    if float(version[3:]) >= 3 and _int(text, "$ENDDATA") > 0:
        start, end = _int(text, "$BEGINDATA"), _int(text, "$ENDDATA")
    return at + start, at + end + 1


def _kinds(text: dict[str, str], n: int) -> list[str]:
    whole = text.get("$DATATYPE", "").upper()
    kinds = [whole] * n
    if float(text["$VERSION"][3:]) >= 3.2:
        kinds = [text.get(f"$P{i + 1}DATATYPE", whole).upper() for i in range(n)]
    if any(k not in ("A", "I", "F", "D") for k in kinds) or ("A" in kinds and set(kinds) != {"A"}):
        raise ValueError(f"data types {kinds} can't be read")
    return kinds


class Layout(NamedTuple):
    """Where a data set's events lie: ``step`` bytes a row, or 0 where rows have no fixed width."""

    start: int
    end: int
    step: int
    rows: int
    kinds: list[str]
    bits: list[int]
    order: list[int]


def layout(data: bytes | Ranged, at: int, text: dict[str, str]) -> Layout:
    if text.get("$MODE", "L").upper() != "L":
        raise ValueError(f"mode {text['$MODE']} is not list mode")
    n, rows = _int(text, "$PAR"), _int(text, "$TOT", -1)
    start, end = _segment(data, at, text)
    kinds = _kinds(text, n)
    if kinds[:1] == ["A"]:
        widths = [text.get(f"$P{i + 1}B", "*").strip() for i in range(n)]
        bits = [8 * int(w) for w in widths] if all(w.isdigit() for w in widths) else []
        order = []
    else:
        given = [32 if k == "F" else 64 if k == "D" else _int(text, f"$P{i + 1}B", 32) for i, k in enumerate(kinds)]
        wide = [next((w for w in WIDTHS if b <= w), 64) for b in given]
        fits = lambda bs: all(b % 8 == 0 for b in bs) and (rows < 0 or abs(rows * sum(bs) // 8 - (end - start)) <= 1)
        bits = wide if fits(wide) or not fits(given) else given
        order = [int(x) - 1 for x in text.get("$BYTEORD", "1,2,3,4").split(",")]
    step = sum(bits) // 8
    rows = (end - start) // step if step and rows < 0 else rows
    if step and order and start + rows * step > len(data):
        raise ValueError("the data segment ends outside the file")
    return Layout(start, end, step, rows, kinds, bits, order)


def decode(raw: bytes, lay: Layout, text: dict[str, str], scale: bool = True, wanted: list[int] | None = None) -> np.ndarray:
    """rows x parameters (or the ``wanted`` ones) of whole rows' bytes, as doubles."""
    wanted = list(range(len(lay.kinds))) if wanted is None else wanted
    if lay.kinds[:1] == ["A"]:
        out = _ascii(raw, lay)[:, wanted]
    else:
        raw = np.frombuffer(raw, np.uint8)
        raw = raw[: len(raw) // lay.step * lay.step].reshape(-1, lay.step) if lay.step else raw.reshape(0, 1)
        ends = np.cumsum([0, *lay.bits]) // 8
        out = np.empty((len(raw), len(wanted)))
        for k, i in enumerate(wanted):
            out[:, k] = _numbers(raw[:, ends[i] : ends[i + 1]], lay.kinds[i], lay.order, text.get(f"$P{i + 1}R", ""))
    return _scaled(out, text, lay.kinds, scale, wanted)


def _numbers(part: np.ndarray, kind: str, order: list[int], top: str) -> np.ndarray:
    width = part.shape[1]
    if sorted(order) == list(range(width)):
        part = part[:, np.argsort(order)]  # byte k of the number, from the lowest
    elif order[0] > order[-1]:
        part = part[:, ::-1]
    if kind in "FD":
        return np.ascontiguousarray(part).view("<f4" if kind == "F" else "<f8")[:, 0]
    value = np.zeros(len(part), np.uint64)
    for k in range(width):
        value |= part[:, k].astype(np.uint64) << np.uint64(8 * k)
    most = float(top or 0)
    mask = int(np.ceil(np.log2(most))) if most > 0 else 8 * width
    return value & np.uint64((1 << mask) - 1) if mask < 8 * width else value


def events(data: bytes | Ranged, at: int = 0, scale: bool = True) -> np.ndarray:
    """rows x parameters of one data set, as doubles."""
    text = keywords(data, at)
    lay = layout(data, at, text)
    end = lay.start + lay.rows * lay.step if lay.step else lay.end
    return decode(data[lay.start : end], lay, text, scale)


def _ascii(data: bytes, lay: Layout) -> np.ndarray:
    n = len(lay.kinds)
    if lay.step:
        cuts = np.cumsum([0, *lay.bits]) // 8
        rows = len(data) // lay.step
        return np.array([[float(data[r * lay.step + a : r * lay.step + b] or b"nan") for a, b in zip(cuts, cuts[1:])] for r in range(rows)]).reshape(rows, n)
    values = np.array(re.split(rb"[\s,]+", data.strip()), dtype=object).astype(float)
    return values[: len(values) // n * n].reshape(-1, n)


def _scaled(x: np.ndarray, text: dict[str, str], kinds: list[str], scale: bool, wanted: list[int]) -> np.ndarray:
    """Logarithmic amplification of integers, then linear gain."""
    version = float(text["$VERSION"][3:])
    for k, i in enumerate(wanted if scale else []):
        kind = kinds[i]
        amp = text.get(f"$P{i + 1}E", "")
        f = [float(v) for v in amp.split(",") if re.fullmatch(r"\s*[+-]?\d+\.?\d*([eE][+-]?\d+)?\s*", v)]
        top = float(text.get(f"$P{i + 1}R", 0) or 0)
        if kind == "I" and len(f) == 2 and f[0] and top:
            x[:, k] = (f[1] or 1.0) * 10 ** (f[0] * x[:, k] / top)
        gain = float(text.get(f"$P{i + 1}G", 0) or 0)
        if gain > 0 and (not amp or f == [0.0, 0.0]) and (kind == "I" or version < 3.2):
            x[:, k] /= gain
    return x


# ---- Spark -------------------------------------------------------------------


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select("path", "content")


_short = short
HEADS = "path string, import_file string, import_subfile int, at long, keywords map<string,string>, labels array<string>, delimiter string, pairs array<struct<keyword:string,value:string>>, step long, rows long, error string"


def read_heads(spark: SparkSession, paths: str | list[str], counted: Accumulator | None = None) -> DataFrame:
    """A row per data set, from headers and TEXT alone: path, import_file, import_subfile
    (from 1), at (where it begins), keywords, labels, delimiter, pairs (keywords as they
    stand in the file), step (bytes of a row, 0 if that varies), rows, and why its
    events can't be read, if so."""
    names = ["path", "import_file", "import_subfile", "at", "keywords", "labels", "delimiter", "pairs", "step", "rows", "error"]
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.list_(pa.string()), pa.string(), pa.list_(pa.struct([("keyword", pa.string()), ("value", pa.string())])), pa.int64(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                data, found = Ranged(path, counted=counted), []
                for k, (at, text) in enumerate(datasets(data), 1):
                    delimiter, pairs = raw_pairs(data, at)
                    row = (path, short(path), k, at, list(text.items()), labels(text), delimiter, [dict(zip(("keyword", "value"), p)) for p in pairs])
                    try:
                        lay = layout(data, at, text)
                        found.append((*row, lay.step, lay.rows, None))
                    except ValueError as e:
                        found.append((*row, 0, 0, str(e)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=names)

    return listed(spark, paths).mapInArrow(run, HEADS)


def read_keywords(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """import_file, import_subfile (from 1), keywords, labels, problems (by
    ``fcs_rules.problems``): a row per data set."""
    from .fcs_rules import problems

    return read_heads(spark, paths).select("import_file", "import_subfile", "keywords", "labels", problems(F.col("keywords"), F.col("pairs"), F.col("delimiter")).alias("problems"))


def read_fcs(spark: SparkSession, paths: str | list[str], dataset: list[int] | None = None, scale: bool = True, columns: list[str] | None = None, part_bytes: int = PART_BYTES, counted: Accumulator | None = None) -> DataFrame:
    """Rows of all files merged by name: import_file, import_subfile,
    object_number (0-based in its data set) and a double per parameter; parameters
    that a data set lacks are null. ``dataset``: wanted numbers (from 1); ``columns``:
    wanted parameters, the only ones decoded.

    Events are read in ranges of ``part_bytes`` (at least a row), each by one task, so a
    file may have any size; a data set of text without fixed widths is one range.
    """
    heads = saved(read_heads(spark, paths, counted), "heads")
    if dataset:
        heads = heads.filter(F.col("import_subfile").isin(*dataset))
    found = heads.select("import_file", "import_subfile", F.posexplode("labels").alias("at", "name")).groupBy("name").agg(F.min(F.struct("import_file", "import_subfile", "at")).alias("first"))
    names = [r["name"] for r in found.orderBy("first").collect()]  # a row per distinct parameter
    if columns is not None:
        if unknown := set(columns) - set(names):
            raise ValueError(f"unknown parameters {sorted(unknown)}")
        names = list(columns)
    clash = {"import_file", "import_subfile", "object_number"} & set(names)
    if clash:
        raise ValueError(f"parameters are named like provenance columns: {sorted(clash)}")
    schema = "import_file string, import_subfile int, object_number long" + "".join(", `{}` double".format(n.replace("`", "``")) for n in names)
    all_names = ["import_file", "import_subfile", "object_number", *names]
    per = F.when(F.col("step") > 0, F.greatest(F.floor(F.lit(part_bytes) / F.col("step")), F.lit(1)))
    last = F.when(per.isNull() | (F.col("rows") <= 0), 0).otherwise(F.floor((F.col("rows") - 1) / per)).cast("long")
    ranges = heads.select("path", "import_file", "import_subfile", "at", "keywords", "error", per.alias("per"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("range"))
    n = heads.agg(F.sum(last + 1)).first()[0] or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                if r["error"]:
                    raise ValueError(f"{r['path']}: {r['error']}")
                data, text = Ranged(r["path"], 58, counted), dict(r["keywords"])
                lay, place = layout(data, r["at"], text), {n: i for i, n in enumerate(labels(text))}
                own = [m for m in names if m in place]
                first = r["range"] * r["per"] if r["per"] else 0
                upto = min(lay.rows, first + r["per"]) if r["per"] else 0
                raw = data[lay.start + first * lay.step : lay.start + upto * lay.step] if r["per"] else data[lay.start : lay.end]
                blocks = range(0, len(raw), BLOCK * lay.step) if r["per"] else (0,)
                for at in blocks:
                    x = decode(raw[at : at + BLOCK * lay.step] if r["per"] else raw, lay, text, scale, [place[m] for m in own])
                    k, row = len(x), first + (at // lay.step if r["per"] else 0)
                    cols = [pa.array([r["import_file"]] * k, pa.string()), pa.array(np.full(k, r["import_subfile"], np.int32)), pa.array(np.arange(row, row + k))]
                    cols += [pa.array(np.ascontiguousarray(x[:, own.index(m)])) if m in place else pa.nulls(k, pa.float64()) for m in names]
                    yield pa.RecordBatch.from_arrays(cols, names=all_names)

    return ranges.repartition(int(n)).mapInArrow(run, schema)


def encode(x: np.ndarray, names: list[str], extra: dict[str, str] | None = None, sep: str = "|") -> bytes:
    """An FCS 3.0 file of little-endian 32-bit floats; what isn't finite becomes 0."""
    x = np.where(np.isfinite(x), x, 0.0).astype("<f4").reshape(-1, len(names))
    text = {"$BEGINANALYSIS": "0", "$ENDANALYSIS": "0", "$BEGINSTEXT": "0", "$ENDSTEXT": "0", "$BYTEORD": "1,2,3,4", "$DATATYPE": "F", "$MODE": "L", "$NEXTDATA": "0", "$PAR": str(len(names)), "$TOT": str(len(x))}
    for i, name in enumerate(names, 1):
        short, _, stain = name.partition(" < ")
        top = x[:, i - 1].max() if len(x) else 1
        text |= {f"$P{i}N": short, f"$P{i}B": "32", f"$P{i}E": "0,0", f"$P{i}R": str(int(np.ceil(max(top, 1))))}
        if stain:
            text[f"$P{i}S"] = stain.removesuffix(" >")
    text |= extra or {}
    body = "".join(f"{k}{sep}{str(v).replace(sep, sep + sep)}{sep}" for k, v in text.items())
    # Offsets have a fixed width, so the text's length is known ahead.
    places = f"$BEGINDATA{sep}{{:020d}}{sep}$ENDDATA{sep}{{:020d}}{sep}"
    length = len((sep + places.format(0, 0) + body).encode())
    start = 58 + length
    end = start + max(x.nbytes, 1) - 1
    segment = (sep + places.format(start, end) + body).encode()
    in_head = (start, end) if end < 10**8 else (0, 0)
    head = b"FCS3.0    " + b"".join(b"%8d" % v for v in (58, start - 1, *in_head, 0, 0))
    return head + segment + x.tobytes()


def write_fcs(df: DataFrame, folder: str, features: list[str] | None = None, pops: dict[str, Column] | None = None, rows_per_file: int = 1 << 20, keywords: dict[str, str] | None = None) -> DataFrame:
    """Numeric columns (and populations as 0 / 1) as FCS files in ``folder``, a
    local path or URI that every executor reaches; names come from the partition,
    so a task that is run again writes the same files.

    Returns file, rows. Spread rows by ``df.repartition`` beforehand; a single
    file needs a table of one partition and at most ``rows_per_file`` rows.
    """
    names = features or [c for c, t in df.dtypes if t not in ("string", "binary") and not t.startswith(("array", "map", "struct"))]
    quoted = [F.col("`" + c.replace("`", "``") + "`").cast("double") for c in names]
    cols = [finite_or(c, 0.0).alias(n) for c, n in zip(quoted, names)] + [F.coalesce(c.cast("double"), F.lit(0.0)).alias(p) for p, c in (pops or {}).items()]
    heads = [*names, *(pops or {})]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = place_of(folder)
        store.create_dir(base, recursive=True)
        part, held, n, k = TaskContext.get().partitionId(), [], 0, 0
        done: list[tuple[str, int]] = []

        def put() -> None:
            nonlocal held, n, k
            name = f"{base}/part-{part:05d}-{k:03d}.fcs"
            put_whole(store, name, encode(np.concatenate(held), heads, keywords))
            done.append((name.rsplit("/", 1)[-1], n))
            held, n, k = [], 0, k + 1

        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]).astype(np.float32)
            while len(x):
                take = x[: rows_per_file - n]
                held.append(take)
                n, x = n + len(take), x[len(take) :]
                if n == rows_per_file:
                    put()
        if n:
            put()
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in done], pa.string()), pa.array([r for _, r in done], pa.int64())], names=["file", "rows"])

    return df.select(*cols).mapInArrow(run, "file string, rows long")
