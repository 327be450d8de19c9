"""Media columns: Netpbm and BMP to numpy arrays, integral-image resizing, NPY tiles, difference hashes.

``decode`` reads P1 to P6 (plain and raw, 8 bit) and uncompressed 8, 24 and 32 bit BMP.
``area_resize`` averages exact source areas with a summed-area table, so its cost does not
depend on the scale. ``features`` turns a column of encoded images into an NPY tile and a
64-bit difference hash for each row; rows that can't be decoded keep null features and a
reason. Null media: null features, reason ``null``. No shuffle: one pass over the rows.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skein.llm.arrays import lean

ROW_BYTES = 192


class Undecodable(ValueError):
    """The bytes are no image of a supported kind."""


def _header(raw: bytes, want: int) -> tuple[list[int], int]:
    """``want`` integers after the magic, comments skipped; and where the samples begin."""
    found: list[int] = []
    i = 2
    while len(found) < want:
        while i < len(raw) and raw[i] in b" \t\n\r\v\f":
            i += 1
        if i < len(raw) and raw[i] == 35:
            end = raw.find(b"\n", i)
            i = len(raw) if end < 0 else end + 1
            continue
        j = i
        while j < len(raw) and 48 <= raw[j] <= 57:
            j += 1
        if j == i:
            raise Undecodable("netpbm header")
        found.append(int(raw[i:j]))
        i = j
    return found, i + 1


def decode_netpbm(raw: bytes) -> np.ndarray:
    """(height, width, channels) uint8; bitmaps become 0 (ink) and 255."""
    kind = raw[:2]
    if len(raw) < 3 or kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise Undecodable("not netpbm")
    bitmap = kind in (b"P1", b"P4")
    numbers, at = _header(raw, 2 if bitmap else 3)
    width, height = numbers[:2]
    top = 1 if bitmap else numbers[2]
    if width < 1 or height < 1 or not 1 <= top <= 255:
        raise Undecodable("netpbm size or depth")
    channels = 3 if kind in (b"P3", b"P6") else 1
    n = width * height * channels
    if kind == b"P4":
        stride = (width + 7) // 8
        if len(raw) - at < stride * height:
            raise Undecodable("truncated")
        rows = np.frombuffer(raw, np.uint8, stride * height, at).reshape(height, stride)
        return ((1 - np.unpackbits(rows, axis=1)[:, :width]) * np.uint8(255))[:, :, None]
    if kind == b"P1":
        bits = np.frombuffer(raw, np.uint8, offset=min(at - 1, len(raw)))
        bits = bits[(bits == 48) | (bits == 49)]
        if len(bits) < n:
            raise Undecodable("truncated")
        return ((49 - bits[:n]) * np.uint8(255)).reshape(height, width, 1)
    if kind in (b"P2", b"P3"):
        try:
            flat = np.array(raw[at - 1 :].split()[:n], dtype=np.int64)
        except ValueError as e:
            raise Undecodable("netpbm samples") from e
    else:
        if len(raw) - at < n:
            raise Undecodable("truncated")
        flat = np.frombuffer(raw, np.uint8, n, at)
    if len(flat) < n or (n and int(flat.max()) > top):
        raise Undecodable("netpbm samples")
    if top != 255:
        flat = (flat.astype(np.int64) * 255 + top // 2) // top
    return flat.astype(np.uint8, copy=False).reshape(height, width, channels)


def decode_bmp(raw: bytes) -> np.ndarray:
    """(height, width, 3) uint8 RGB, top row first."""
    if len(raw) < 54 or raw[:2] != b"BM":
        raise Undecodable("not bmp")
    at, size, width, height, planes, bits, packed = struct.unpack_from("<IIiiHHI", raw, 10)
    colours = struct.unpack_from("<I", raw, 46)[0]
    if size < 40 or planes != 1 or packed or bits not in (8, 24, 32) or width < 1 or not height:
        raise Undecodable("bmp variant")
    rows, stride = abs(height), (width * bits + 31) // 32 * 4
    if len(raw) - at < stride * rows:
        raise Undecodable("truncated")
    grid = np.frombuffer(raw, np.uint8, stride * rows, at).reshape(rows, stride)[:, : width * bits // 8]
    if bits == 8:
        n = colours or 256
        if len(raw) < 14 + size + 4 * n or int(grid.max()) >= n:
            raise Undecodable("bmp palette")
        table = np.frombuffer(raw, np.uint8, 4 * n, 14 + size).reshape(n, 4)[:, 2::-1]
        image = table[grid]
    else:
        image = grid.reshape(rows, width, bits // 8)[:, :, 2::-1]
    return np.ascontiguousarray(image[::-1] if height > 0 else image)


def decode(raw: bytes) -> np.ndarray:
    return decode_bmp(raw) if raw[:2] == b"BM" else decode_netpbm(raw)


def encode_ppm(image: np.ndarray) -> bytes:
    height, width, _ = image.shape
    return b"P6\n%d %d\n255\n" % (width, height) + image.tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    height, width, _ = image.shape
    stride = (width * 3 + 3) // 4 * 4
    grid = np.zeros((height, stride), np.uint8)
    grid[:, : width * 3] = image[::-1, :, ::-1].reshape(height, width * 3)
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + grid.size, 0, 0, 54, 40, width, height, 1, 24, 0, grid.size, 2835, 2835, 0, 0)
    return head + grid.tobytes()


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the exact source area of each target pixel, by a summed-area table.

    An area's border may cut through source pixels; the table is read there by linear
    interpolation, which equals weighting the cut pixels by the part inside.
    """
    h, w, c = image.shape
    total = np.zeros((h + 1, w + 1, c))
    np.cumsum(image, axis=0, dtype=np.float64, out=total[1:, 1:])
    np.cumsum(total[1:, 1:], axis=1, out=total[1:, 1:])

    def cut(table: np.ndarray, n: int, m: int) -> np.ndarray:
        edge = np.arange(m + 1) * n / m
        low = np.minimum(edge.astype(np.int64), n - 1)
        part = (edge - low).reshape(-1, 1, 1)
        return table[low] * (1 - part) + table[low + 1] * part

    rows = cut(total, h, height)
    grid = cut(rows.transpose(1, 0, 2), w, width).transpose(1, 0, 2)
    area = grid[1:, 1:] - grid[:-1, 1:] - grid[1:, :-1] + grid[:-1, :-1]
    return np.clip(np.rint(area / (h * w / (height * width))), 0, 255).astype(np.uint8)


def difference_hash(image: np.ndarray, side: int = 8) -> str:
    """Whether each cell of a ``side`` x ``side + 1`` grey reduction is darker than its right neighbour."""
    small = area_resize(image, side, side + 1).astype(np.int64)
    grey = small[:, :, 0] if small.shape[2] == 1 else small @ np.array([299, 587, 114])
    return np.packbits(grey[:, :-1] < grey[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, side: int) -> bytes:
    """The image reduced to ``side`` x ``side``, as the bytes of an NPY file."""
    out = io.BytesIO()
    np.save(out, area_resize(image, side, side), allow_pickle=False)
    return out.getvalue()




def features(df: DataFrame, media: str = "media", key: str = "id", side: int = 16) -> DataFrame:
    """key, height, width, channels, tile (NPY bytes), dhash, reason for each encoded image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = [_describe(x, side) for x in part.column(1).to_pylist()]
                out = {n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(_FEATURES)}
                yield pa.RecordBatch.from_arrays([part.column(0), *out.values()], ["key", *out])

    kind = dict(df.dtypes)[key]
    return df.selectExpr(f"`{key}` AS key", f"`{media}` AS media").mapInArrow(
        lean(run), f"key {kind}, height int, width int, channels int, tile binary, dhash string, reason string"
    )


_FEATURES = (("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("tile", pa.binary()), ("dhash", pa.string()), ("reason", pa.string()))


def _describe(raw: bytes | None, side: int) -> tuple:
    if raw is None:
        return None, None, None, None, None, "null"
    try:
        image = decode(raw)
    except Undecodable as e:
        return None, None, None, None, None, str(e)
    return *image.shape, npy_tile(image, side), difference_hash(image), None


def payload(text: str | None) -> tuple[bytes, int]:
    """A text's UTF-8 bytes, padded with spaces to whole image rows, and their number before."""
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % ROW_BYTES if raw else ROW_BYTES), len(raw)


def text_media(df: DataFrame, key: str = "doc_id", text: str = "text", side: int = 16) -> DataFrame:
    """Store each text as a binary PPM, read the stored bytes back and describe them.

    The payload is an RGB image 64 pixels wide; what the digests cover is what the
    decoder gave back. ``tile`` holds the NPY bytes of the resized image. Null text
    counts as empty; equal texts give equal values; repeated keys give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for text in part.column(1):
                    raw, n = payload(text.as_py())
                    media = encode_ppm(np.frombuffer(raw, np.uint8).reshape(-1, ROW_BYTES // 3, 3))
                    image = decode(media)
                    back = image.tobytes()
                    rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image), npy_tile(image, side)))
                out = {n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(_TEXT)}
                yield pa.RecordBatch.from_arrays([part.column(0), *out.values()], [key, *out])

    kind = dict(df.dtypes)[key]
    return df.selectExpr(f"`{key}`", f"`{text}`").mapInArrow(
        lean(run),
        f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary",
    )


_TEXT = (("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("tile", pa.binary()))
