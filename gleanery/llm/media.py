"""Media columns: Netpbm and BMP images decoded to numpy arrays, resized by area, written as NPY tiles with difference
hashes.

Decoders take whole files: PGM and PPM (binary P5, P6 and plain P2, P3; comments; 8-bit samples) and uncompressed BMP of
8 bits with a palette, 24 or 32 bits, bottom-up or top-down. What isn't such a file, is cut short, or holds samples beyond
its greatest value or its palette raises ValueError, and gives no tile in `tiles`. Arrays are uint8, height x width x channels.

Resizing is by area: an output sample is the mean of what its rectangle covers, with fractions of border samples, read
off an integral image. The integral image is made for bands of rows, and only its rows at the output's edges are kept,
so that memory doesn't grow with the image.

A null and an empty byte string are no images. Ids may be null or repeat; each row gives its own tiles.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gleanery.llm._common import encoded, map_batches

#: Samples on a tile's side.
SIDE = 64
#: Rows of an image whose integral is made at a time.
BAND = 8192


def decode(data: bytes) -> np.ndarray:
    """Height x width x channels, uint8."""
    if data[:2] == b"BM":
        return _decode_bmp(data)
    if re.match(rb"P[2356]\s", data):
        return _decode_netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def _decode_netpbm(data: bytes) -> np.ndarray:
    head = re.match(rb"P([2356])" + rb"(?:\s|#[^\n]*\n)+(\d+)" * 3 + rb"\s", data)
    if not head:
        raise ValueError("no Netpbm header")
    width, height, most = map(int, head.groups()[1:])
    kind = int(head[1])
    channels = 3 if kind in (3, 6) else 1
    n = width * height * channels
    if not 0 < most < 256 or not n:
        raise ValueError("not 8-bit samples, or no samples")
    if kind < 4:
        samples = _plain_samples(data[head.end() :], n)
    else:
        samples = np.frombuffer(data, np.uint8)[head.end() :][:n]
    if len(samples) != n:
        raise ValueError("too few samples")
    if samples.max() > most:
        raise ValueError("a sample above the greatest value")
    if most != 255:
        samples = (samples.astype(np.uint16) * 255 // most).astype(np.uint8)
    return samples.astype(np.uint8, copy=False).reshape(height, width, channels)


def _plain_samples(text: bytes, n: int) -> np.ndarray:
    """The first n samples of a plain file, in which a line may end with a comment."""
    samples = re.sub(rb"#[^\n]*", b"", text).split()[:n]
    if any(len(x) > 3 or not x.isdigit() for x in samples):
        raise ValueError("no sample of 8 bits")
    return np.array(list(map(int, samples)), np.int64).clip(0, 256).astype(np.uint16)


def _decode_bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise ValueError("no BMP header")
    start, head, width, height, _, bits, compression, _, _, _, colours = struct.unpack("<10xIIiiHHIIiiI", data[:50])
    if compression or bits not in (8, 24, 32) or width <= 0 or height == 0:
        raise ValueError("a BMP of another kind")
    row = (width * bits // 8 + 3) // 4 * 4
    if start < 54 or len(data) < start + row * abs(height):
        raise ValueError("too few samples")
    rows = np.frombuffer(data, np.uint8, row * abs(height), start).reshape(abs(height), row)[:, : width * bits // 8]
    if height > 0:
        rows = rows[::-1]
    if bits == 8:
        n = colours if 0 < colours <= 256 else 256
        palette = np.frombuffer(data, np.uint8)[14 + head :][: 4 * n]
        if len(palette) < 4 * n or rows.max() >= n:
            raise ValueError("a sample beyond the palette")
        return palette.reshape(n, 4)[:, 2::-1][rows]
    return rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1]


def encode_netpbm(image: np.ndarray) -> bytes:
    """P5 or P6."""
    height, width, channels = image.shape
    return b"P%d\n%d %d\n255\n" % (5 if channels == 1 else 6, width, height) + np.ascontiguousarray(image).tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """24 bits, bottom-up."""
    height, width, _ = image.shape
    row = (width * 3 + 3) // 4 * 4
    rows = np.zeros((height, row), np.uint8)
    rows[:, : width * 3] = image[::-1, :, ::-1].reshape(height, -1)
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + rows.size, 0, 0, 54, 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def _integral_at(image: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums over the rows above each edge (edges may lie within rows), band by band."""
    whole, part = np.floor(edges).astype(np.int64), edges - np.floor(edges)
    out = np.zeros((len(edges), *image.shape[1:]))
    kind = np.int64 if image.dtype.kind == "u" else np.float64
    above = np.zeros(image.shape[1:], kind)
    for at in range(0, len(image), BAND):
        band = np.cumsum(image[at : at + BAND], axis=0, dtype=kind)
        here = (whole > at) & (whole <= at + len(band))
        out[here] = above + band[whole[here] - at - 1]
        above = above + band[-1]
    inside = (part > 0) & (whole < len(image))
    out[inside] += part[inside].reshape(-1, *[1] * (image.ndim - 1)) * image[whole[inside]]
    return out


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """By area; float64, height x width x channels. Of the second axis only the row sums are left, which are few."""
    rows = np.diff(_integral_at(image, np.arange(height + 1) * image.shape[0] / height), axis=0)
    both = np.diff(_integral_at(rows.transpose(1, 0, 2), np.arange(width + 1) * image.shape[1] / width), axis=0)
    return both.transpose(1, 0, 2) * (height * width / (image.shape[0] * image.shape[1]))


def difference_hash(image: np.ndarray) -> str:
    """64 bits as hex: whether each sample of the image at 8 x 9, in grey, is below its right neighbour."""
    grey = resize(image, 8, 9).mean(axis=2)
    # rounded, so that sums in another order don't flip a bit between equal neighbours
    grey = np.round(grey, 6)
    return np.packbits(grey[:, :-1] < grey[:, 1:]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(array), allow_pickle=False)
    return out.getvalue()


def cut(image: np.ndarray, side: int) -> Iterator[tuple[int, int, bytes, str]]:
    """Tiles of an image, row by row: their places, NPY files and difference hashes. Border tiles are smaller."""
    for y in range(0, len(image), side):
        for x in range(0, image.shape[1], side):
            tile = image[y : y + side, x : x + side]
            yield y // side, x // side, npy(tile), difference_hash(tile)


def joined(parts: list[tuple[int, int, bytes, str]]) -> np.ndarray:
    """The image that cut() gave these tiles of."""
    arrays: dict[int, list[np.ndarray]] = {}
    for y, _, data, _ in sorted(parts, key=lambda p: p[:2]):
        arrays.setdefault(y, []).append(np.load(io.BytesIO(data), allow_pickle=False))
    return np.concatenate([np.concatenate(row, axis=1) for row in arrays.values()])


def tiles(df: DataFrame, side: int = SIDE, id_column: str = "media_id", data_column: str = "data") -> DataFrame:
    """Tiles of every image: media_id, tile_y, tile_x, npy, dhash. Border tiles are smaller; nulls and what can't be
    decoded give no tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string())
        for rows in batches:
            for key, data in zip(rows.column(0), rows.column(1), strict=True):
                try:
                    parts = cut(decode(data.as_py() or b""), side)
                except ValueError:
                    continue
                while out := [(key.as_py(), *p) for p in islice(parts, 256)]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["media_id", "tile_y", "tile_x", "npy", "dhash"])

    return df.select(id_column, data_column).mapInArrow(run, "media_id long, tile_y int, tile_x int, npy binary, dhash string")


def write_tiles(df: DataFrame, path: str, **options) -> None:
    """Tiles as Parquet, NPY files in their column `npy`."""
    tiles(df, **options).write.mode("overwrite").parquet(path)


def media_of(text: str | None, kind: str | None = None) -> tuple[int, bytes]:
    """A text's UTF-8 as an image 64 samples of 3 bytes wide, filled up with spaces to whole rows and one row at least:
    its bytes unpadded, and the file. Its kind is ppm or bmp; where none is named the text's checksum chooses."""
    raw = encoded(text)
    rows = max(1, -(-len(raw) // 192))
    image = np.frombuffer(raw.ljust(rows * 192), np.uint8).reshape(rows, 64, 3)
    kind = kind or ("ppm", "bmp")[zlib.crc32(raw) % 2]
    return len(raw), encode_bmp(image) if kind == "bmp" else encode_netpbm(image)


def features(media: bytes) -> tuple[bytes, str]:
    """What a stored image holds: its samples, read back from its NPY tiles, and a feature: the image's difference hash, the
    digest of its thumbnail (the image at 8 x 8, rounded) and that of its tiles with their hashes."""
    image = decode(media)
    parts = list(cut(image, SIDE))
    thumbnail = npy(np.rint(np.round(resize(image, 8, 8), 6)).astype(np.uint8))
    digest = hashlib.sha256()
    for y, x, data, dhash in parts:
        digest.update(b"%d,%d,%s," % (y, x, dhash.encode()) + hashlib.sha256(data).digest())
    return joined(parts).tobytes(), f"{difference_hash(image)}-{hashlib.sha256(thumbnail).hexdigest()[:16]}-{digest.hexdigest()[:16]}"


def store_texts(df: DataFrame, kind: str | None = None) -> DataFrame:
    """Every text stored as an image, cut into NPY tiles and read back from them: doc_id, n_bytes, payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256, feature. Null text counts as empty: one row of spaces. Equal texts
    give equal values; null and repeated doc_ids are kept."""

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        out: tuple[list, ...] = ([], [], [], [], [], [], [])
        for text in rows.column(1):
            n, media = media_of(text.as_py(), kind)
            payload, feature = features(media)
            values = n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature
            for column, value in zip(out, values, strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        return pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names)

    return map_batches(df.select("doc_id", "text"), batch, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
