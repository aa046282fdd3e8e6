"""Per-object image kernels: codecs, affine resampling, colours, encoders.

An image row has height, width and pixels (flat, row-major). Kernels work on
2-D numpy arrays; ``image_map`` runs one over the rows of a table, batch by batch.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- codecs ------------------------------------------------------------------


def split_channels(image: np.ndarray, channels: int) -> list[np.ndarray]:
    """Side-by-side tiles of equal width."""
    w = image.shape[1] // channels
    return [image[:, i * w : (i + 1) * w] for i in range(channels)]


def plain_decode(data: bytes, height: int, width: int) -> np.ndarray:
    """Unpacked little-endian pixels of 8, 16, 24 or 32 bits, read as signed."""
    size = len(data) // (height * width)
    if size not in (1, 2, 3, 4) or size * height * width != len(data):
        raise ValueError(f"{len(data)} bytes are no {height} x {width} image")
    raw = np.frombuffer(data, np.uint8).reshape(-1, size).astype(np.int64)
    v = raw @ (1 << (8 * np.arange(size)))
    return (v - ((v >> (8 * size - 1)) << (8 * size))).reshape(height, width)


#: Values that each removal mode marks with -1 (mode 4 keeps only the background).
RUN_REMOVAL: dict[int, Callable[[np.ndarray], np.ndarray]] = {
    0: lambda v: v,
    1: lambda v: np.where(v > 1, -1, v),
    2: lambda v: np.where(v == 2, -1, v),
    3: lambda v: np.where(v == 3, -1, v),
    4: lambda v: np.where(v == 0, 1, -1),
    5: lambda v: np.where(v != 1, -1, v),
}


def run_decode(data: bytes, height: int, width: int, removal: int = 0) -> np.ndarray:
    """Run-length pairs (value, length - 1)."""
    pairs = np.frombuffer(data, np.uint8)[: len(data) // 2 * 2].reshape(-1, 2).astype(np.int64)
    out = np.repeat(RUN_REMOVAL[removal](pairs[:, 0]), pairs[:, 1] + 1)
    if len(out) != height * width:
        raise ValueError(f"runs hold {len(out)} of {height * width} pixels")
    return out.reshape(height, width)


def run_encode(mask: np.ndarray) -> bytes:
    v = np.asarray(mask, np.uint8).ravel()
    cut = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
    lens = np.diff(np.append(cut, len(v)))
    out = bytearray()
    for value, n in zip(v[cut].tolist(), lens.tolist()):
        out += bytes((value, 255)) * (n // 256)
        if n % 256:
            out += bytes((value, n % 256 - 1))
    return bytes(out)


def delta_decode(data: bytes, height: int, width: int) -> np.ndarray:
    """Groups of 4 bits, low half first: 3 bits of a number, and one that says
    whether more follow; numbers are differences along both axes."""
    raw = np.frombuffer(data, np.uint8)
    half = np.stack([raw & 15, raw >> 4], axis=1).ravel().astype(np.int64)
    ends = np.flatnonzero(half & 8 == 0)[: height * width]
    if len(ends) < height * width:
        raise ValueError(f"data end after {len(ends)} of {height * width} pixels")
    starts = np.append(0, ends[:-1] + 1)
    place = np.arange(ends[-1] + 1) - np.repeat(starts, ends - starts + 1)
    value = np.add.reduceat((half[: ends[-1] + 1] & 7) << (3 * place), starts)
    value -= ((half[ends] & 4) >> 2) << (3 * (ends - starts + 1))
    return value.reshape(height, width).cumsum(axis=0).cumsum(axis=1)


def delta_encode(image: np.ndarray) -> bytes:
    d = np.asarray(image, np.int64)
    d = np.diff(np.diff(d, axis=1, prepend=0), axis=0, prepend=0).ravel()
    halves: list[int] = []
    for v in d.tolist():
        n = max(1, -(-((v if v >= 0 else ~v).bit_length() + 1) // 3))
        halves += [((v >> (3 * i)) & 7) | (8 if i < n - 1 else 0) for i in range(n)]
    if len(halves) % 2:
        halves.append(0)
    pair = np.array(halves, np.uint8).reshape(-1, 2)
    return (pair[:, 0] | (pair[:, 1] << 4)).tobytes()


PLAIN, DELTA, RUNS = 1, 30817, 30818


def decode(data: bytes, height: int, width: int, compression: int, removal: int = 0) -> np.ndarray:
    if compression == PLAIN:
        return plain_decode(data, height, width)
    if compression == DELTA:
        return delta_decode(data, height, width)
    if compression == RUNS:
        return run_decode(data, height, width, removal)
    raise ValueError(f"unknown compression {compression}")


def raw16(data: bytes, height: int, width: int, compression: int, order: str = "<", removal: int = 0) -> bytes:
    """A strip as unpacked pixels of 16 bits in a byte order; negative ones wrap around."""
    return (decode(data, height, width, compression, removal) & 0xFFFF).astype(f"{order}u2").tobytes()


# ---- geometry ----------------------------------------------------------------


def background(shape: tuple[int, int], bg: float, sd: float, rng: np.random.Generator | None) -> np.ndarray:
    return np.full(shape, float(bg)) if rng is None else rng.normal(bg, sd, shape)


def resize(image: np.ndarray, height: int, width: int, bg: float = 0.0, sd: float = 0.0, rng: np.random.Generator | None = None, front: bool = False) -> np.ndarray:
    """Centre crop, then padding with background; 0 leaves a side as it is."""
    for axis, n in ((0, height), (1, width)):
        over = image.shape[axis] - n
        if n and over > 0:
            at = over // 2 + (front and over % 2)
            image = image.take(range(at, at + n), axis=axis)
    h, w = max(height, image.shape[0]), max(width, image.shape[1])
    if (h, w) == image.shape:
        return image
    out = background((h, w), bg, sd, rng)
    top, left = ((n - m) // 2 + (front and (n - m) % 2) for n, m in zip((h, w), image.shape))
    out[top : top + image.shape[0], left : left + image.shape[1]] = image
    return out


def affine(image: np.ndarray, matrix: np.ndarray, height: int = 0, width: int = 0, order: int = 2, bg: float = 0.0, sd: float = 0.0, rng: np.random.Generator | None = None) -> np.ndarray:
    """Pixels at ``matrix`` (2 x 3: target to source, pixel centres) by nearest (1),
    bilinear (2) or bicubic (3) interpolation; outside lies background."""
    h, w = height or image.shape[0], width or image.shape[1]
    m = np.asarray(matrix, float)
    cx, cy = np.meshgrid(np.arange(w) + 0.5, np.arange(h) + 0.5)
    x, y = (m[i, 0] * cx + m[i, 1] * cy + m[i, 2] for i in (0, 1))
    bkg = background((h, w), bg, sd, rng)

    def at(fy: np.ndarray, fx: np.ndarray) -> np.ndarray:
        ok = (fy >= 0) & (fy < image.shape[0]) & (fx >= 0) & (fx < image.shape[1])
        return np.where(ok, image[np.clip(fy, 0, image.shape[0] - 1), np.clip(fx, 0, image.shape[1] - 1)], bkg)

    if order not in (2, 3):
        return at(np.floor(y).astype(int), np.floor(x).astype(int))
    x, y = x - 0.5, y - 0.5
    fx, fy = np.floor(x).astype(int), np.floor(y).astype(int)
    sx, sy = x - fx, y - fy
    if order == 2:
        top = at(fy, fx) * (1 - sx) + at(fy, fx + 1) * sx
        low = at(fy + 1, fx) * (1 - sx) + at(fy + 1, fx + 1) * sx
        return top * (1 - sy) + low * sy
    wx, wy = _cubic(sx), _cubic(sy)
    return sum(wx[j] * sum(wy[i] * at(fy + i - 1, fx + j - 1) for i in range(4)) for j in range(4))


def _cubic(s: np.ndarray, a: float = -0.5) -> list[np.ndarray]:
    """Weights of the four neighbours at distance 1 + s, s, 1 - s and 2 - s."""
    near = lambda t: (a + 2) * t**3 - (a + 3) * t**2 + 1
    far = lambda t: a * t**3 - 5 * a * t**2 + 8 * a * t - 4 * a
    return [far(1 + s), near(s), near(1 - s), far(2 - s)]


def rescale(image: np.ndarray, scale: float, keep_size: bool = False, **fill) -> np.ndarray:
    """Enlarged or shrunk (bilinear)."""
    if not (np.isfinite(scale) and scale > 0):
        raise ValueError("scale is a positive number")
    h, w = int(image.shape[0] * scale), int(image.shape[1] * scale)
    out = affine(image, np.array([[1 / scale, 0, 0], [0, 1 / scale, 0]]), h, w, 2, **fill)
    return resize(out, *image.shape, **fill) if keep_size else out


def align(image: np.ndarray, dx: float, dy: float, **fill) -> np.ndarray:
    """Shifted by parts of pixels; NaN shifts leave it as it is."""
    if np.isnan(dx) != np.isnan(dy):
        raise ValueError("one shift is missing")
    if np.isnan(dx) or (dx == 0 and dy == 0):
        return image
    return affine(image, np.array([[1, 0, dx], [0, 1, dy]]), order=2, **fill)


def align_mask(mask: np.ndarray, dx: float, dy: float, bg: int = 0) -> np.ndarray:
    """As ``align``, with the fraction cut off, so that whole numbers stay whole."""
    if np.isnan(dx) != np.isnan(dy):
        raise ValueError("one shift is missing")
    if np.isnan(dx) or (dx == 0 and dy == 0):
        return mask
    return np.trunc(affine(mask, np.array([[1, 0, dx], [0, 1, dy]]), order=2, bg=bg)).astype(mask.dtype)


def beside(images: list[np.ndarray], bg: float = 0.0) -> np.ndarray:
    """Images next to each other, from the top; lower ones are filled up below."""
    height = max(i.shape[0] for i in images)
    return np.concatenate([np.pad(i, ((0, height - i.shape[0]), (0, 0)), constant_values=bg) for i in images], axis=1)


def below(images: list[np.ndarray], bg: float = 0.0) -> np.ndarray:
    """Images under each other, from the left."""
    return beside([i.T for i in images], bg).T


def sheet(images: list[np.ndarray], columns: int, bg: float = 0.0) -> np.ndarray:
    """Images in rows of ``columns``."""
    return below([beside(images[i : i + columns], bg) for i in range(0, len(images), columns)], bg)


def cleanse(image: np.ndarray, mask: np.ndarray, bg: float = 0.0, sd: float = 0.0, rng: np.random.Generator | None = None) -> np.ndarray:
    return np.where(mask != 0, background(image.shape, bg, sd, rng), image)


def normalize(image: np.ndarray, lo: float = 0.0, hi: float = 4095.0, gamma: float = 1.0) -> np.ndarray:
    part = (image - lo) / (hi - lo or 1.0)
    return np.where(image <= lo, 0.0, np.where(image >= hi, 1.0, np.clip(part, 0, 1) ** gamma))


def mark(image: np.ndarray, stamp: np.ndarray, mask: np.ndarray, top: int, left: int, invert: bool = False) -> np.ndarray:
    """``stamp`` written into the image under ``mask``; what lies outside is cut."""
    out = image.copy()
    h, w = mask.shape
    y, x = np.nonzero(mask)
    ok = (y + top >= 0) & (y + top < out.shape[0]) & (x + left >= 0) & (x + left < out.shape[1])
    y, x = y[ok], x[ok]
    out[y + top, x + left] = 1 - out[y + top, x + left] if invert else np.broadcast_to(stamp, (h, w))[y, x]
    return out


def scale_bar(image: np.ndarray, pixels: int, value: float = 1.0, top: int = 0, left: int = 0, thick: int = 2) -> np.ndarray:
    return mark(image, np.full((thick, pixels), value), np.ones((thick, pixels)), top, left)


def transform(image: np.ndarray, mask: np.ndarray | None = None, shift: tuple[float, float] = (0.0, 0.0), size: tuple[int, int] = (0, 0), limits: tuple[float, float] = (0.0, 4095.0), gamma: float = 1.0, bg: float = 0.0, sd: float = 0.0, seed: int | None = None) -> np.ndarray:
    """The usual chain: align, cleanse under the mask, resize, normalise. Limits
    inside ]0, 1[ are quantiles. Noise only with a seed."""
    rng = None if seed is None else np.random.default_rng(seed)
    out = align(np.asarray(image, float), *shift, bg=bg, sd=sd, rng=rng)
    if mask is not None:
        out = cleanse(out, mask, bg, sd, rng)
    out = resize(out, *size, bg=bg, sd=sd, rng=rng)
    lo, hi = limits
    if 0 < lo < 1 and 0 < hi < 1:
        lo, hi = np.quantile(out, [lo, hi])
    return normalize(out, lo, hi, gamma)


# ---- colour ------------------------------------------------------------------


def hsv_to_rgb(value: np.ndarray, hue: float, saturation: float) -> np.ndarray:
    """height x width x 3 of a brightness image in one hue (0 to 1)."""
    i, f = divmod(hue * 6, 1)
    p, q, t = value * (1 - saturation), value * (1 - saturation * f), value * (1 - saturation * (1 - f))
    r, g, b = ((value, t, p), (q, value, p), (p, value, t), (p, q, value), (t, p, value), (value, p, q))[int(i) % 6]
    return np.stack([r, g, b], axis=-1)


def palette(image: np.ndarray, colors: np.ndarray) -> np.ndarray:
    """Colours (n x 3, 0 to 1) by brightness."""
    return np.asarray(colors)[np.minimum((image * len(colors)).astype(int), len(colors) - 1)]


# ---- encoders ----------------------------------------------------------------


def as_bytes(image: np.ndarray) -> np.ndarray:
    rgb = image if image.ndim == 3 else np.repeat(image[..., None], 3, axis=2)
    return np.clip(np.rint(rgb * 255), 0, 255).astype(np.uint8)


def bmp(image: np.ndarray) -> bytes:
    """A 24-bit bitmap of an image in [0, 1]."""
    px = as_bytes(image)[::-1, :, ::-1]
    h, w, _ = px.shape
    rows = np.zeros((h, -(-w * 3 // 4) * 4), np.uint8)
    rows[:, : w * 3] = px.reshape(h, -1)
    head = struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0)
    return head + rows.tobytes()


def png(image: np.ndarray) -> bytes:
    px = as_bytes(image)
    h, w, _ = px.shape
    lines = np.concatenate([np.zeros((h, 1), np.uint8), px.reshape(h, -1)], axis=1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


#: Sample types by name: TIFF sample format and the scale of [0, 1] images.
SAMPLES = {"uint8": (1, 255), "int8": (2, 127), "uint16": (1, 65535), "int16": (2, 32767), "uint32": (1, 4294967295), "int32": (2, 2147483647), "float": (3, 1), "double": (3, 1)}


def tiff(image: np.ndarray, kind: str = "uint16", deflate: bool = False) -> bytes:
    """A TIFF of a grey image in [0, 1]: height x width (x channels, in one strip)."""
    return tiff_pages([image], kind, deflate)


def tiff_pages(images: list[np.ndarray], kind: str = "uint16", deflate: bool = False) -> bytes:
    """A TIFF with a page for each image."""
    sample, scale = SAMPLES[kind]
    dtype = np.dtype({"float": "<f4", "double": "<f8"}.get(kind, kind)).newbyteorder("<")
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link = 4
    for image in images:
        data = np.ascontiguousarray((image * scale).astype(dtype) if sample == 3 else np.rint(image * scale).astype(dtype))
        body = zlib.compress(data.tobytes()) if deflate else data.tobytes()
        at = len(out)
        out += body + b"\0" * (len(body) % 2)
        channels = image.shape[2] if image.ndim == 3 else 1
        tags = [(256, 4, image.shape[1]), (257, 4, image.shape[0]), (258, 3, dtype.itemsize * 8), (259, 3, 8 if deflate else 1), (262, 3, 1), (273, 4, at), (277, 3, channels), (278, 4, image.shape[0]), (279, 4, len(body)), (339, 3, sample)]
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags)
        link = len(out)
        out += struct.pack("<I", 0)
    return bytes(out)


def tiff_read(data: bytes) -> list[np.ndarray]:
    """The samples of each page of a little-endian TIFF with one strip a page."""
    out, at = [], struct.unpack_from("<I", data, 4)[0]
    while at:
        n = struct.unpack_from("<H", data, at)[0]
        t = {tag: value for tag, _, _, value in (struct.unpack_from("<HHII", data, at + 2 + 12 * i) for i in range(n))}
        body = data[t[273] : t[273] + t[279]]
        name = {1: "u", 2: "i", 3: "f"}[t[339]] + str(t[258] // 8)
        x = np.frombuffer(zlib.decompress(body) if t[259] == 8 else body, "<" + name)
        out.append(x.reshape(t[257], t[256], *([t[277]] if t[277] > 1 else [])))
        at = struct.unpack_from("<I", data, at + 2 + 12 * n)[0]
    return out


ENCODERS = {"bmp": bmp, "png": png, "tiff": tiff}


# ---- over tables ---------------------------------------------------------------


def image_map(df: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], id_cols: list[str], pixels: str = "pixels") -> DataFrame:
    """id columns, height, width, pixels after ``kernel`` (2-D to 2-D); rows without
    pixels stay null."""
    ids = [f"`{n}` {df.schema[n].dataType.simpleString()}" for n in id_cols]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, w, px in zip(b.column("height").to_pylist(), b.column("width").to_pylist(), b.column(pixels)):
                flat = px.values.to_numpy(zero_copy_only=False) if px.is_valid else None
                out.append(None if flat is None or not h or not w else kernel(flat.reshape(h, w)))
            cols = [b.column(n) for n in id_cols]
            cols += [pa.array([None if x is None else x.shape[k] for x in out], pa.int32()) for k in (0, 1)]
            cols.append(pa.array([None if x is None else np.asarray(x, np.float64).ravel() for x in out], pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(cols, names=[*id_cols, "height", "width", "pixels"])

    return df.select(*id_cols, "height", "width", pixels).mapInArrow(run, ", ".join([*ids, "height int", "width int", "pixels array<double>"]))


def decoded(df: DataFrame, id_cols: list[str], removal: int = 0) -> DataFrame:
    """Rows height, width, channels, compression, data (binary) to one row per
    channel: id columns, channel (from 0), height, width, pixels."""
    ids = [f"`{n}` {df.schema[n].dataType.simpleString()}" for n in id_cols]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, r in enumerate(b.select(["height", "width", "channels", "compression", "data"]).to_pylist()):
                if r["data"] is None:
                    continue
                image = decode(r["data"], r["height"], r["width"], r["compression"], removal)
                for k, tile in enumerate(split_channels(image, r["channels"])):
                    at.append(i)
                    rows.append((k, *tile.shape, tile.ravel().astype(np.int32)))
            take = pa.array(at, pa.int64())
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()))
            cols = [b.column(n).take(take) for n in id_cols] + [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(cols, names=[*id_cols, "channel", "height", "width", "pixels"])

    return df.select(*id_cols, "height", "width", "channels", "compression", "data").mapInArrow(run, ", ".join([*ids, "channel int", "height int", "width int", "pixels array<int>"]))


def encoded(df: DataFrame, kind: str, id_cols: list[str], **options) -> DataFrame:
    """id columns and data: each image (0 to 1) as a png, bmp or tiff file."""
    ids, encode = [f"`{n}` {df.schema[n].dataType.simpleString()}" for n in id_cols], ENCODERS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = zip(b.column("height").to_pylist(), b.column("width").to_pylist(), b.column("pixels"))
            out = [encode(px.values.to_numpy(zero_copy_only=False).astype(float).reshape(h, w), **options) if px.is_valid else None for h, w, px in sizes]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in id_cols), pa.array(out, pa.binary())], names=[*id_cols, "data"])

    return df.select(*id_cols, "height", "width", "pixels").mapInArrow(run, ", ".join([*ids, "data binary"]))


def tensor(df: DataFrame, id_col: str, height: int, width: int, scale: int = 1) -> np.ndarray:
    """object x height x width array of a *selected* set of equal images, by id;
    the caller bounds the selection, as the array is built on the driver. ``write_tensor``
    takes any number."""
    table = df.select(id_col, "pixels").orderBy(id_col).toArrow()
    flat = table.column("pixels").combine_chunks().values.to_numpy(zero_copy_only=False)
    return (flat * scale).reshape(table.num_rows, height, width)


def write_tensor(df: DataFrame, id_col: str, height: int, width: int, folder: str, channel_col: str | None = "channel", dtype: str = "<f8", chunk_bytes: int = 1 << 24) -> tuple[int, int, int, int]:
    """An object x height x width x channel array, by id, as a Zarr store (version 2, not
    compressed) in ``folder``; its shape.

    Objects are ranked in ranges and dealt to chunks of about ``chunk_bytes``; a task puts together
    and writes each chunk, so the driver holds the shape alone. Rows are an object's
    channels (from 0) or, without ``channel_col``, objects; every object has all
    channels, in the same size. Missing pixels are an error; the last chunk is filled up with zeros.
    """
    from ..sources.parts import place_of, put_whole
    from .merge import ranks

    one = F.lit(0) if channel_col is None else F.col(channel_col)
    rows = df.select(F.col(id_col).alias("_id"), one.cast("int").alias("_channel"), "height", "width", "pixels")
    channels = (rows.agg(F.max("_channel")).first()[0] or 0) + 1
    each = height * width * channels * np.dtype(dtype).itemsize
    per = max(1, chunk_bytes // max(1, each))
    # An object's channels are few, and one row.
    whole = rows.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("_channel", "height", "width", "pixels"))).alias("tiles"))
    ranked = whole.join(ranks(rows.select("_id").distinct(), "_id", "_rank"), "_id")
    ranked = ranked.withColumn("_rank", F.col("_rank") - 1).withColumn("_chunk", F.floor(F.col("_rank") / per))
    dealt = ranked.repartition("_chunk").sortWithinPartitions("_chunk", "_rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = place_of(folder)
        store.create_dir(base, recursive=True)
        chunk, block, n = None, None, 0

        def put() -> pa.RecordBatch:
            put_whole(store, f"{base}/{chunk}.0.0.0", block.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([n])], names=["chunk", "rows"])

        for b in batches:
            for k, rank, tiles, name in zip(*(b.column(c).to_pylist() for c in ("_chunk", "_rank")), b.column("tiles"), b.column("_id").to_pylist()):
                if k != chunk:
                    if n:
                        yield put()
                    chunk, block, n = k, np.zeros((per, height, width, channels), dtype), 0
                found = {c: tiles.values.field(c) for c in ("_channel", "height", "width", "pixels")}
                sizes = {*zip(found["height"].to_pylist(), found["width"].to_pylist())}
                if found["_channel"].to_pylist() != list(range(channels)) or sizes != {(height, width)} or found["pixels"].null_count:
                    raise ValueError(f"object {name}: not {channels} channels of {height} x {width} pixels")
                for c, pixels in enumerate(found["pixels"]):
                    block[rank - k * per, :, :, c] = pixels.values.to_numpy(zero_copy_only=False).reshape(height, width)
                n += 1
        if n:
            yield put()

    total = dealt.select("_id", "_chunk", "_rank", "tiles").mapInArrow(run, "chunk long, rows long").agg(F.sum("rows")).first()[0] or 0
    store, base = place_of(folder)
    store.create_dir(base, recursive=True)
    shape = (int(total), height, width, channels)
    about = {"zarr_format": 2, "shape": shape, "chunks": (per, height, width, channels), "dtype": dtype, "compressor": None, "fill_value": 0, "order": "C", "filters": None}
    with store.open_output_stream(f"{base}/.zarray") as f:
        f.write(json.dumps(about).encode())
    return shape


def read_tensor(folder: str, first: int = 0, upto: int | None = None) -> np.ndarray:
    """Objects ``first`` to ``upto`` of a store of ``write_tensor``; the caller bounds them."""
    from ..sources.parts import place_of

    store, base = place_of(folder)
    with store.open_input_file(f"{base}/.zarray") as f:
        about = json.loads(f.read())
    n, per = about["shape"][0], about["chunks"][0]
    upto = n if upto is None else min(upto, n)
    out = np.zeros((max(0, upto - first), *about["shape"][1:]), about["dtype"])
    for k in range(first // per, -(-upto // per) if upto > first else 0):
        with store.open_input_file(f"{base}/{k}.0.0.0") as f:
            block = np.frombuffer(f.read(), about["dtype"]).reshape(about["chunks"])
        a, b = max(first, k * per), min(upto, (k + 1) * per)
        out[a - first : b - first] = block[a - k * per : b - k * per]
    return out
