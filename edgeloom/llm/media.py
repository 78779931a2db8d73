"""Media columns: Netpbm and BMP images to numpy, area resize by integral images, NPY tiles with difference hashes."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import small_batches

#: Rows of pixels whose prefix sums are held at a time.
BAND = 4096


def encode_netpbm(pixels: np.ndarray) -> bytes:
    """P5 of (h, w), P6 of (h, w, 3); 8-bit samples."""
    kind = b"P5" if pixels.ndim == 2 else b"P6"
    return b"%s\n%d %d\n255\n" % (kind, pixels.shape[1], pixels.shape[0]) + pixels.astype(np.uint8).tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 with up to 8 bits a sample (bitmaps: 0 black, 255 white), comments allowed.  Samples are returned as stored."""
    kind, at, fields = data[:2], 2, []
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    while len(fields) < (2 if kind in (b"P1", b"P4") else 3):
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("damaged Netpbm header")
        fields.append(int(data[at:end]))
        at = end
    width, height = fields[:2]
    if len(fields) > 2 and not 0 < fields[2] < 256:
        raise ValueError("only 8-bit samples are supported")
    channels = 3 if kind in (b"P3", b"P6") else 1
    count = width * height * channels
    if kind in (b"P5", b"P6"):
        flat = np.frombuffer(data, dtype=np.uint8, count=count, offset=at + 1)
    elif kind == b"P4":
        stride = (width + 7) // 8
        flat = np.frombuffer(data, dtype=np.uint8, count=stride * height, offset=at + 1).reshape(height, stride)
        return (1 - np.unpackbits(flat, axis=1)[:, :width]) * np.uint8(255)
    elif kind == b"P1":
        flat = (1 - np.frombuffer(bytes(c for c in data[at:] if c in b"01")[:count], dtype=np.uint8) + 48).astype(np.uint8) * np.uint8(255)
    else:
        flat = np.array(data[at:].split()[:count], dtype=np.uint8)
    return flat.reshape((height, width, 3) if channels == 3 else (height, width))


def encode_bmp(pixels: np.ndarray) -> bytes:
    """8 bits with a grey palette for (h, w), 24 bits for (h, w, 3); rows bottom up, padded to four bytes."""
    height, width = pixels.shape[:2]
    grey = pixels.ndim == 2
    rows = pixels.reshape(height, -1) if grey else pixels[:, :, ::-1].reshape(height, -1)
    rows = np.pad(rows[::-1], ((0, 0), (0, -rows.shape[1] % 4))).astype(np.uint8).tobytes()
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4)
    palette[:, 3] = 0
    table = palette.tobytes() if grey else b""
    head = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8 if grey else 24, 0, len(rows), 2835, 2835, 256 if grey else 0, 0)
    return b"BM" + struct.pack("<IHHI", 54 + len(table) + len(rows), 0, 0, 54 + len(table)) + head + table + rows


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits.  A palette of greys gives (h, w), everything else (h, w, 3)."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    start, size = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    width, height, _, depth, packed = struct.unpack_from("<iiHHI", data, 18)
    colours = struct.unpack_from("<I", data, 46)[0] or 256
    if packed or depth not in (8, 24, 32):
        raise ValueError("only uncompressed BMP of 8, 24 or 32 bits is supported")
    stride = (width * depth // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, dtype=np.uint8, count=stride * abs(height), offset=start).reshape(abs(height), stride)[:, : width * depth // 8]
    rows = rows[::-1] if height > 0 else rows
    if depth == 8:
        palette = np.frombuffer(data, dtype=np.uint8, count=4 * colours, offset=14 + size).reshape(-1, 4)[:, 2::-1]
        grey = (palette[:, :1] == palette).all()
        return (palette[:, 0] if grey else palette)[rows]
    return rows.reshape(abs(height), width, depth // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's exact area, from the integral image at the cells' (fractional) corners.

    The integral is built in bands of rows: only its values at the target's column bounds are kept.
    """
    grey = pixels if pixels.ndim == 2 else pixels.astype(np.float64) @ np.array([0.299, 0.587, 0.114])
    h, w = grey.shape
    x = np.linspace(0, w, width + 1)
    xi = np.minimum(x.astype(np.int64), w - 1)
    sums = np.zeros((h + 1, width + 1))
    for at in range(0, h, BAND):
        band = grey[at : at + BAND].astype(np.float64)
        run = np.concatenate([np.zeros((len(band), 1)), np.cumsum(band, axis=1)], axis=1)
        sums[at + 1 : at + 1 + len(band)] = run[:, xi] + (x - xi) * (run[:, xi + 1] - run[:, xi])
    np.cumsum(sums, axis=0, out=sums)
    y = np.linspace(0, h, height + 1)
    yi = np.minimum(y.astype(np.int64), h - 1)
    corner = sums[yi] + (y - yi)[:, None] * (sums[yi + 1] - sums[yi])
    return np.diff(np.diff(corner, axis=0), axis=1) / ((h / height) * (w / width))


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits of 8 x 9 area means: 1 where a cell is darker than its right neighbour; 16 hex digits."""
    small = np.round(area_resize(pixels, 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(pixels: np.ndarray, side: int) -> bytes:
    """Area-resized tile of side x side 8-bit greys, as an NPY file."""
    out = io.BytesIO()
    np.lib.format.write_array(out, np.clip(np.rint(area_resize(pixels, side, side)), 0, 255).astype(np.uint8), version=(1, 0))
    return out.getvalue()


def tiles(images: DataFrame, id_col: str = "id", image_col: str = "image", side: int = 32) -> DataFrame:
    """``id, height, width, tile`` (NPY bytes) and ``dhash`` of every image; null and undecodable images give nulls."""
    kind = images.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for image in batch.column(1):
                try:
                    p = decode(image.as_py() or b"")
                    rows.append((p.shape[0], p.shape[1], npy_tile(p, side), difference_hash(p)))
                except (ValueError, IndexError, struct.error):
                    rows.append((None,) * 4)
            c = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(c, (pa.int32(), pa.int32(), pa.binary(), pa.string())))], names=["id", "height", "width", "tile", "dhash"])

    return small_batches(images.select(F.col(id_col).alias("id"), image_col)).mapInArrow(run, f"id {kind}, height int, width int, tile binary, dhash string")


#: Payloads are padded to a multiple of this; it is also the width of the stored picture.
UNIT = 576


def store_text(text: bytes) -> bytes:
    """P5 picture of ``UNIT`` columns whose samples are the text and bytes of 255 up to a positive multiple of ``UNIT``."""
    padded = text + b"\xff" * ((-len(text)) % UNIT or (0 if text else UNIT))
    return b"P5\n%d %d\n255\n" % (UNIT, len(padded) // UNIT) + padded


def text_media(docs: DataFrame, tile_side: int = 16) -> DataFrame:
    """Each whole text stored as a picture, read back and described.

    ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature``; ``feature`` is the
    difference hash, a colon, and the start of the SHA-256 of the NPY tile.  Null texts are empty ones.  Equal texts have
    equal values.  An empty table gives an empty result; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1):
                raw = text.as_py() or b""
                media = store_text(raw)
                pixels = decode(media)
                payload = pixels.tobytes()
                feature = f"{difference_hash(pixels)}:{hashlib.sha256(npy_tile(pixels, tile_side)).hexdigest()[:16]}"
                rows.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            columns = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=["doc_id", *names])

    return small_batches(docs.select("doc_id", F.col("text").cast("binary").alias("text"))).mapInArrow(
        run, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    )
