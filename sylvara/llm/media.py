"""Media columns: Netpbm and BMP to and from numpy arrays, area resizing, NPY tiles, difference hashes."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .memory import tidy_batches
from .pieces import slices
from .words import text_buffers

PART = 1 << 20  # bytes of texts or files that a worker turns into columns at once
PIXELS = 64  # across; a row of 64 RGB pixels holds 192 bytes
TILE = (8, 9)


def encode_pnm(image: np.ndarray) -> bytes:
    """Binary PGM of a (h, w) array, PPM of a (h, w, 3) array, both of uint8."""
    kind = b"P6" if image.ndim == 3 else b"P5"
    return b"%s\n%d %d\n255\n" % (kind, image.shape[1], image.shape[0]) + np.ascontiguousarray(image, np.uint8).tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """24-bit bottom-up BMP of a (h, w, 3) uint8 array."""
    high, wide = image.shape[:2]
    room = (3 * wide + 3) // 4 * 4
    body = np.zeros((high, room), np.uint8)
    body[:, : 3 * wide] = image[::-1, :, ::-1].reshape(high, 3 * wide)
    return b"BM" + struct.pack("<IHHI", 54 + body.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, wide, high, 1, 24, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()


def _pnm_header(raw: bytes, count: int) -> tuple[list[int], int]:
    """The next count numbers after the magic, comments skipped, and where the single white space after them ends."""
    found, at = [], 2
    while len(found) < count:
        if at >= len(raw):
            raise ValueError("PNM header ends early")
        c = raw[at : at + 1]
        if c == b"#":
            end = raw.find(b"\n", at)
            at = len(raw) if end < 0 else end + 1
        elif c.isspace():
            at += 1
        elif c.isdigit():
            end = at
            while raw[end : end + 1].isdigit():
                end += 1
            if end - at > 9:
                raise ValueError("PNM header has too large a number")
            found.append(int(raw[at:end]))
            at = end
        else:
            raise ValueError("PNM header is malformed")
    return found, at + 1


def _decode_pnm(raw: bytes) -> np.ndarray:
    kind = raw[:2]
    bitmap = kind in (b"P1", b"P4")
    (wide, high, *top), at = _pnm_header(raw, 2 if bitmap else 3)
    top = 1 if bitmap else top[0]
    if not 0 < top < 65536:
        raise ValueError("PNM maximum out of range")
    depth = 3 if kind in (b"P3", b"P6") else 1
    count, across = wide * high * depth, (wide + 7) // 8
    if not count:
        raise ValueError("PNM without pixels")
    least = {b"P4": across * high, b"P5": count * (1 + (top > 255)), b"P6": count * (1 + (top > 255))}.get(kind, count)
    if least > len(raw) - min(at, len(raw)) + (kind in (b"P1", b"P2", b"P3")):
        raise ValueError("PNM has too few samples")
    if kind == b"P1":
        values = np.frombuffer(raw[at - 1 :], np.uint8)
        values = (values[(values == 48) | (values == 49)][:count] - 48) ^ 1
    elif kind == b"P4":
        values = np.unpackbits(np.frombuffer(raw, np.uint8, across * high, at).reshape(high, across), axis=1)[:, :wide].reshape(-1) ^ 1
    elif kind in (b"P2", b"P3"):
        values = np.array(raw[at - 1 :].split()[:count], dtype=np.int64)
    else:
        values = np.frombuffer(raw, np.uint8 if top < 256 else ">u2", count, at)
    if len(values) != count:
        raise ValueError("PNM has too few samples")
    if kind not in (b"P1", b"P4") and not 0 <= int(values.min()) <= int(values.max()) <= top:
        raise ValueError("PNM has a sample beyond its maximum")
    if top != 255 and not bitmap:
        values = (values.astype(np.uint32) * 255 + top // 2) // top
    if bitmap:
        values = values * np.uint8(255)
    shape = (high, wide, 3) if depth == 3 else (high, wide)
    return np.asarray(values, np.uint8).reshape(shape)


def _decode_bmp(raw: bytes) -> np.ndarray:
    start, head, wide, high, planes, bits, packed = struct.unpack_from("<IIiiHHI", raw, 10)
    if head < 40 or (packed, bits) not in ((0, 8), (0, 24), (0, 32), (3, 32)):
        raise ValueError("BMP of this kind is not supported")
    flip, high = high > 0, abs(high)
    if wide < 1 or high < 1:
        raise ValueError("BMP without pixels")
    room = (bits // 8 * wide + 3) // 4 * 4
    if start > len(raw) or room * high > len(raw) - start:
        raise ValueError("BMP has too few samples")
    body = np.frombuffer(raw, np.uint8, room * high, start).reshape(high, room)
    if bits == 8:
        colours = struct.unpack_from("<I", raw, 46)[0] or 256
        if colours > 256 or 14 + head + 4 * colours > len(raw):
            raise ValueError("BMP has an unsound palette")
        palette = np.frombuffer(raw, np.uint8, 4 * colours, 14 + head).reshape(-1, 4)
        image = palette[body[:, :wide]][:, :, 2::-1]
    else:
        place = [2, 1, 0]
        if packed == 3:  # each mask must be one byte of the four
            place = [[0xFF, 0xFF00, 0xFF0000, 0xFF000000].index(x) for x in struct.unpack_from("<III", raw, 54)]
        image = body[:, : bits // 8 * wide].reshape(high, wide, bits // 8)[:, :, place]
    return np.ascontiguousarray(image[::-1] if flip else image)


def decode(raw: bytes) -> np.ndarray:
    """A uint8 array (h, w) or (h, w, 3) of a Netpbm (P1 to P6) or BMP file; ValueError if it is neither."""
    if raw[:2] == b"BM":
        return _decode_bmp(raw)
    if len(raw) > 2 and raw[:1] == b"P" and raw[1:2] in b"123456":
        return _decode_pnm(raw)
    raise ValueError("neither Netpbm nor BMP")


def _at(integral: np.ndarray, cells: int, axis: int) -> np.ndarray:
    """The integral image between its grid points: it is linear there."""
    n = integral.shape[axis] - 1
    place = np.arange(cells + 1) * (n / cells)
    low = np.minimum(place.astype(np.int64), n - 1)
    part = (place - low).reshape([-1 if k == axis else 1 for k in range(integral.ndim)])
    return integral.take(low, axis) * (1 - part) + integral.take(low + 1, axis) * part


def area_resize(image: np.ndarray, high: int, wide: int) -> np.ndarray:
    """Mean of the area that each of high x wide cells covers, by an integral image; float64."""
    for axis, cells in ((0, high), (1, wide)):
        total = np.zeros([n + (k == axis) for k, n in enumerate(image.shape)])
        np.cumsum(image, axis=axis, dtype=np.float64, out=total[(slice(None),) * axis + (slice(1, None),)])
        edge = _at(total, cells, axis)
        image = np.diff(edge, axis=axis) * (cells / image.shape[axis])
    return image


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image.sum(axis=2, dtype=np.uint16) / 3.0


def tile(image: np.ndarray, high: int = TILE[0], wide: int = TILE[1]) -> np.ndarray:
    return np.clip(np.rint(area_resize(grey(image), high, wide)), 0, 255).astype(np.uint8)


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def difference_hash(small: np.ndarray) -> str:
    """A bit per neighbouring pair across: whether the right one is darker; hexadecimal."""
    return np.packbits(small[:, 1:] < small[:, :-1]).tobytes().hex()


def _columns(docs: DataFrame, names: list[str]) -> list:
    return [docs[c].alias(f"c{k}") for k, c in enumerate(names)]


def _run(docs: DataFrame, names: list[str], value, made: list[tuple[str, str, pa.DataType]], each) -> DataFrame:
    """each(bytes or str slices) -> lists, one per made column, over parts of Arrow batches; names are carried along.

    A worker holds what is made of PART bytes, or of one larger value, beside the batch itself."""
    fields = [T.StructField(c, docs.schema[c].dataType) for c in names] + [T.StructField(n, T._parse_datatype_string(t)) for n, t, _ in made]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(names), PART):
                got = each(part.column("v"))
                arrays = [part.column(f"c{k}") for k in range(len(names))] + [pa.array(x, t) for x, (_, _, t) in zip(got, made, strict=True)]
                yield pa.record_batch(arrays, names=[f.name for f in fields])

    return docs.select(*_columns(docs, names), value.alias("v")).mapInArrow(tidy_batches(work), T.StructType(fields))


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Iterable[str] = (), form: str = "ppm") -> DataFrame:
    """(id_col, carry..., n_bytes, media): each text's UTF-8 bytes, padded with blanks to a positive
    multiple of 192, as the samples of a lossless picture 64 pixels wide, PPM or (form="bmp") BMP.
    Null and empty text is one row of blanks.  Ids may repeat or be null; an empty table gives no rows."""

    def each(column):
        data, offsets = text_buffers(column)
        sizes, media = np.diff(offsets).tolist(), []
        for k, n in enumerate(sizes):
            pixels = np.full(max(192, (n + 191) // 192 * 192), 32, np.uint8)
            pixels[:n] = data[offsets[k] : offsets[k + 1]]
            image = pixels.reshape(-1, PIXELS, 3)
            media.append(encode_bmp(image) if form == "bmp" else encode_pnm(image))
        return sizes, media

    return _run(docs, [id_col, *carry], F.col(text_col).cast("string"), [("n_bytes", "long", pa.int64()), ("media", "binary", pa.binary())], each)


def read_media(df: DataFrame, media_col: str = "media", carry: Iterable[str] = ()) -> DataFrame:
    """(carry..., high, wide, payload, tile, dhash, problem) of a column of Netpbm or BMP files.

    payload is the samples in row order, red before green before blue; tile an NPY file of the grey
    picture area-resized to 8 x 9; dhash its difference hash.  A null or unreadable file has null
    columns and the reason in problem."""

    def each(column):
        out: list[list] = [[] for _ in range(6)]
        for raw in column:
            try:
                image = decode(raw.as_buffer().to_pybytes()) if raw.is_valid else None
                if image is None:
                    row = (None,) * 5 + ("no file",)
                else:
                    small = tile(image)
                    row = (image.shape[0], image.shape[1], image.tobytes(), npy(small), difference_hash(small), None)
            except (ValueError, struct.error, IndexError, ArithmeticError, MemoryError) as problem:
                row = (None,) * 5 + (str(problem) or type(problem).__name__,)
            for x, y in zip(out, row, strict=True):
                x.append(y)
        return out

    made = [("high", "int", pa.int32()), ("wide", "int", pa.int32()), ("payload", "binary", pa.binary()), ("tile", "binary", pa.binary()), ("dhash", "string", pa.string()), ("problem", "string", pa.string())]
    return _run(df, list(carry), F.col(media_col), made, each)
