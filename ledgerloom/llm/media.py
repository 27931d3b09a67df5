"""Media columns: Netpbm and BMP bytes as numpy arrays, resized by integral images, as NPY tiles with difference hashes.

Cases: bytes that are no such image decode to null with the reason in ``error``,
so that one broken file doesn't end a job; a null text is the empty one, whose
payload is one row of spaces; equal texts give equal values, and so do repeated rows; columns of other names
are not read; an empty table gives an empty result. The image of a very long text is held whole, one at a
time; its grey values and sums are made by bands of rows.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._common import slices, utf8

#: Bytes of payload in one row of pixels: 64 pixels of three samples.
ROW = 192
#: Height and width of a tile; a difference hash compares its neighbours in a row.
TILE = (8, 9)
#: Rows that are turned to grey and summed at once.
BAND = 4096


def encode_pnm(image: np.ndarray) -> bytes:
    """Binary PGM or PPM of 8-bit samples, height by width, or by three."""
    kind = "P6" if image.ndim == 3 else "P5"
    return f"{kind}\n{image.shape[1]} {image.shape[0]}\n255\n".encode() + np.ascontiguousarray(image, np.uint8).tobytes()


def _fields(data: bytes, at: int, n: int) -> tuple[list[int], int]:
    """``n`` decimal numbers of a Netpbm header, past comments, and where the next byte stands."""
    out = []
    while len(out) < n:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = at + 1 if data[at : at + 1] != b"#" else data.index(b"\n", at) + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        out.append(int(data[at:end]))
        at = end
    return out, at


def decode_pnm(data: bytes) -> np.ndarray:
    """P1 to P6 as samples of 8 or 16 bits; bitmaps as 0 for black and 255 for white."""
    kind = int(data[1:2])
    (width, height, *most), at = _fields(data, 2, 2 if kind in (1, 4) else 3)
    top = most[0] if most else 1
    if not 0 < top < 65536:
        raise ValueError("largest sample out of range")
    shape = (height, width, 3) if kind in (3, 6) else (height, width)
    count = int(np.prod(shape))
    if kind == 1:
        bits = np.frombuffer(bytes(c for c in data[at:] if c in b"01"), np.uint8)[:count] - 48
        return ((1 - bits.reshape(shape)) * 255).astype(np.uint8)
    if kind in (2, 3):
        return np.array(data[at:].split()[:count], np.int64).reshape(shape).astype(np.uint8 if top < 256 else np.uint16)
    at += 1
    if kind == 4:
        stride = -(-width // 8)
        rows = np.frombuffer(data, np.uint8, height * stride, at).reshape(height, stride)
        return ((1 - np.unpackbits(rows, axis=1)[:, :width]) * 255).astype(np.uint8)
    return np.frombuffer(data, np.uint8 if top < 256 else ">u2", count, at).reshape(shape)


def encode_bmp(image: np.ndarray) -> bytes:
    """24-bit BMP of an RGB image."""
    height, width = image.shape[:2]
    stride = -(-width * 3 // 4) * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * 3] = image[::-1, :, ::-1].reshape(height, width * 3)
    head = np.array([40, width, height], "<i4").tobytes() + np.array([1, 24], "<u2").tobytes() + np.array([0, rows.size, 2835, 2835, 0, 0], "<u4").tobytes()
    return b"BM" + np.array([54 + rows.size, 0, 54], "<u4").tobytes() + head + rows.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits a pixel as RGB."""
    start, size = (int(x) for x in np.frombuffer(data, "<u4", 2, 10))
    width, height = (int(x) for x in np.frombuffer(data, "<i4", 2, 18))
    bits = int(np.frombuffer(data, "<u2", 1, 28)[0])
    packing, colours = int(np.frombuffer(data, "<u4", 1, 30)[0]), int(np.frombuffer(data, "<u4", 1, 46)[0])
    if packing not in (0, 3) or bits not in (1, 4, 8, 24, 32):
        raise ValueError("kind of BMP not supported")
    stride = -(-width * bits // 32) * 4
    rows = np.frombuffer(data, np.uint8, abs(height) * stride, start).reshape(abs(height), stride)
    rows = rows if height < 0 else rows[::-1]
    if bits >= 24:
        n = bits // 8
        return rows[:, : width * n].reshape(abs(height), width, n)[:, :, 2::-1]
    palette = np.frombuffer(data, np.uint8, 4 * (colours or 1 << bits), 14 + size).reshape(-1, 4)[:, 2::-1]
    if bits == 8:
        return palette[rows[:, :width]]
    each = np.unpackbits(rows, axis=1).reshape(abs(height), -1, bits)
    return palette[(each * (1 << np.arange(bits)[::-1])).sum(axis=2)[:, :width]]


def decode(data: bytes) -> np.ndarray:
    """The samples of a Netpbm or BMP file."""
    if data[:2] == b"BM":
        return decode_bmp(data)
    if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
        return decode_pnm(data)
    raise ValueError("neither Netpbm nor BMP")


def grey(image: np.ndarray) -> np.ndarray:
    """Luma of an image in thousandths, so that sums stay whole numbers."""
    if image.ndim == 2:
        return image.astype(np.int64) * 1000
    return image.astype(np.int64) @ np.array([299, 587, 114])


def resize_area(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean luma of each target cell's area, fractions of pixels included, from the rows of one integral image that cells end on.

    The integral image is summed band by band; only its rows beside the cuts are kept.
    """
    cuts = np.linspace(0, image.shape[0], height + 1)
    low = np.minimum(cuts.astype(int), image.shape[0] - 1)
    needed = np.unique(np.r_[low, low + 1])
    kept, carry = np.zeros((len(needed), image.shape[1])), np.zeros(image.shape[1], np.int64)
    for at in range(0, image.shape[0], BAND):
        sums = np.cumsum(grey(image[at : at + BAND]), axis=0) + carry
        inside = (needed > at) & (needed <= at + len(sums))
        kept[inside] = sums[needed[inside] - at - 1]
        carry = sums[-1]
    table = np.c_[np.zeros(len(needed)), np.cumsum(kept, axis=1)]

    def between(table: np.ndarray, cuts: np.ndarray, low: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The integral up to each cut of the first axis, between rows by their share."""
        part = (cuts - low).reshape(-1, 1)
        return table[at] * (1 - part) + table[at + 1] * part

    rows = between(table, cuts, low, np.searchsorted(needed, low))
    across = np.linspace(0, image.shape[1], width + 1)
    left = np.minimum(across.astype(int), image.shape[1] - 1)
    corners = between(rows.T, across, left, left).T
    area = image.shape[0] / height * image.shape[1] / width
    return np.diff(np.diff(corners, axis=0), axis=1) / area


def tile_of(image: np.ndarray, shape: tuple[int, int] = TILE) -> np.ndarray:
    """An image's grey tile of 8-bit samples."""
    return np.clip(np.rint(resize_area(image, *shape) / 1000), 0, 255).astype(np.uint8)


def npy(array: np.ndarray) -> bytes:
    """An array as the bytes of an NPY file."""
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def difference_hash(tile: np.ndarray) -> str:
    """One bit for each sample that is darker than its right neighbour, in hex."""
    return np.packbits(tile[:, :-1] < tile[:, 1:]).tobytes().hex()


def tiles(media: DataFrame, id_col: str, data_col: str, shape: tuple[int, int] = TILE) -> DataFrame:
    """Per row of a binary column: height, width, channels, the NPY tile, its difference hash, or an error."""
    rows = media.select(F.col(id_col).alias("id"), F.col(data_col).alias("data"))
    names = [id_col, "height", "width", "channels", "tile_npy", "dhash", "error"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "data"):
            out = []
            for data in batch.column(1).to_pylist():
                try:
                    image = decode(data or b"")
                    tile = tile_of(image, shape)
                    out.append((*image.shape[:2], 1 if image.ndim == 2 else image.shape[2], npy(tile), difference_hash(tile), None))
                except (ValueError, IndexError) as error:
                    out.append((None, None, None, None, None, str(error)))
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()]
            columns = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    schema = media.select(F.col(id_col)).schema.add("height", "integer").add("width", "integer").add("channels", "integer")
    return rows.mapInArrow(read, schema.add("tile_npy", "binary").add("dhash", "string").add("error", "string"))


def payload(text: bytes | None) -> bytes:
    """A text's bytes, spaces added up to whole rows of pixels, one row at least."""
    raw = text or b""
    return raw + b" " * (-len(raw) % ROW or (0 if raw else ROW))


def stored_form(text: bytes | None) -> bytes:
    """A text's payload as an image file: BMP for an even number of pixel rows, PPM for an odd one."""
    image = np.frombuffer(payload(text), np.uint8).reshape(-1, ROW // 3, 3)
    return encode_pnm(image) if len(image) % 2 else encode_bmp(image)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its text as an image file in column ``media``, and its unpadded length."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = utf8(batch, "text")
            files, sizes = [stored_form(t) for t in texts], [len(t or b"") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], [id_col, "n_bytes", "media"])

    return rows.mapInArrow(store, docs.select(F.col(id_col)).schema.add("n_bytes", "long").add("media", "binary"))


#: What ``read_back`` finds in a stored file.
FOUND = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string", "tile_npy": "binary"}


def read_back(data: bytes) -> tuple:
    """The columns of ``FOUND`` for a stored image file: of the samples that it decodes to, of its bytes, and its tile with difference hash."""
    image = decode(data)
    samples, tile = image.tobytes(), tile_of(image)
    return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(tile), npy(tile)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_bytes, and what its stored form, decoded again, gives; one pass over the texts."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = utf8(batch, "text")
            out = list(zip(*[(len(t or b""), *read_back(stored_form(t))) for t in texts], strict=True)) or [[]] * (1 + len(FOUND))
            kinds = [pa.int64(), *({"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[k] for k in FOUND.values())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, kind) for x, kind in zip(out, kinds, strict=True))], [id_col, "n_bytes", *FOUND])

    schema = docs.select(F.col(id_col)).schema.add("n_bytes", "long")
    for name, kind in FOUND.items():
        schema = schema.add(name, kind)
    return rows.mapInArrow(digest, schema)
