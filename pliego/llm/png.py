"""Operator 10: media columns. Payloads stored as PNG images, read back and hashed.

A text becomes an 8-bit greyscale image of WIDTH samples a line. The writer emits the
signature and the chunks IHDR, IDAT (zlib) and IEND with their checksums; the reader tests
every checksum, inflates, and undoes the five line filters with numpy. The feature is a
64-bit hash of low cosine frequencies: the image's 32 x 32 block means are transformed, and
each of the 8 x 8 lowest coefficients gives a bit, set above their median.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import batch_bytes, bounded

#: Payload lengths are a positive multiple of UNIT; the payload is filled up with FILL.
UNIT, FILL, WIDTH = 576, 255, 24
#: Fixed value: the eight bytes that begin every PNG file.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
_SIDE, _LOW = 32, 8


class DamagedImage(ValueError):
    """The bytes are no PNG that this reader understands, or a checksum fails."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def write_png(samples: np.ndarray) -> bytes:
    """PNG bytes of a uint8 array (lines, samples); each line predicts from the one above."""
    height, width = samples.shape
    lines = np.empty((height, width + 1), np.uint8)
    lines[:, 0] = 2
    lines[0, 1:] = samples[0]
    np.subtract(samples[1:], samples[:-1], out=lines[1:, 1:])
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale PNG without interlacing."""
    if data[:8] != SIGNATURE:
        raise DamagedImage("no signature")
    at, header, packed = 8, None, []
    while True:
        if at + 12 > len(data):
            raise DamagedImage("cut off")
        (length,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + length]
        if len(body) < length or data[at + 8 + length : at + 12 + length] != struct.pack(">I", zlib.crc32(data[at + 4 : at + 8 + length])):
            raise DamagedImage(f"checksum of {kind!r}")
        at += 12 + length
        if kind == b"IHDR":
            if length != 13:
                raise DamagedImage("header")
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
    if header is None or header[2:] != (8, 0, 0, 0, 0):
        raise DamagedImage("format")
    width, height = header[:2]
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise DamagedImage("zlib stream") from e
    if len(raw) != height * (width + 1):
        raise DamagedImage("length")
    return unfiltered(np.frombuffer(raw, np.uint8).reshape(height, width + 1))


def unfiltered(lines: np.ndarray) -> np.ndarray:
    """Undo the filter named in each line's first byte (one byte a sample)."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise DamagedImage("filter")
    y = 0
    while y < len(out):
        kind = kinds[y]
        last = y + 1
        while last < len(out) and kinds[last] == kind:
            last += 1
        above = out[y - 1] if y else np.zeros(out.shape[1], np.uint8)
        if kind == 1:
            np.cumsum(out[y:last], axis=1, dtype=np.uint8, out=out[y:last])
        elif kind == 2:
            out[y] += above
            np.cumsum(out[y:last], axis=0, dtype=np.uint8, out=out[y:last])
        elif kind in (3, 4):
            for line in range(y, last):
                _sequential(out[line], above, kind)
                above = out[line]
        y = last
    return out


def _sequential(line: np.ndarray, above: np.ndarray, kind: int) -> None:
    left, corner = 0, 0
    for x, (value, up) in enumerate(zip(line.tolist(), above.tolist())):
        if kind == 3:
            guess = (left + up) // 2
        else:
            near = (abs(up - corner), abs(left - corner), abs(left + up - 2 * corner))
            guess = (left, up, corner)[near.index(min(near))]
        left, corner = (value + guess) & 255, up
        line[x] = left


def payload_image(text: bytes) -> np.ndarray:
    size = max(1, -(-len(text) // UNIT)) * UNIT
    samples = np.full(size, FILL, np.uint8)
    samples[: len(text)] = np.frombuffer(text, np.uint8)
    return samples.reshape(-1, WIDTH)


def _cosines(count: int, size: int) -> np.ndarray:
    return np.cos(np.pi / size * (np.arange(size) + 0.5) * np.arange(count)[:, None])


_BASIS = _cosines(_LOW, _SIDE)


def _means(size: int) -> tuple[np.ndarray, np.ndarray]:
    edges = np.arange(_SIDE) * size // _SIDE
    ends = np.maximum((np.arange(_SIDE) + 1) * size // _SIDE, edges + 1)
    return edges, ends


def cosine_hash(samples: np.ndarray) -> str:
    """16 hex digits from the 8 x 8 lowest frequencies of the 32 x 32 block means.

    Sums are of whole numbers and coefficients are rounded before the comparison, so equal
    images give equal hashes on any machine.
    """
    for axis in (0, 1):
        lo, hi = _means(samples.shape[axis])
        total = np.insert(np.cumsum(samples, axis=axis, dtype=np.float64), 0, 0, axis=axis)
        width = (hi - lo).reshape((-1, 1) if axis == 0 else (1, -1))
        samples = (np.take(total, hi, axis) - np.take(total, lo, axis)) / width
    low = np.round(_BASIS @ samples @ _BASIS.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def _stored_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "media"]
    for batch in batches:
        data, offsets = batch_bytes(batch.column("text"))
        bounds = offsets.tolist()
        lo = 0
        while lo < len(batch):  # a few MB of images at a time
            hi = lo + 1
            while hi < len(batch) and bounds[hi + 1] - bounds[lo] < 4 << 20:
                hi += 1
            media = [write_png(payload_image(data[bounds[i] : bounds[i + 1]].tobytes())) for i in range(lo, hi)]
            sizes = np.diff(offsets[lo : hi + 1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names)
            lo = hi


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        out: list[list] = [[] for _ in types]
        for cell in batch.column("media"):
            if not cell.is_valid:
                raise DamagedImage("no image")
            media = cell.as_buffer().to_pybytes()
            samples = read_png(media)
            payload = samples.tobytes()
            row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(samples))
            for x, value in zip(out, row):
                x.append(value)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(x, t) for x, t in zip(out, types))], names)


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each row's text as a PNG in a binary column.

    A null text counts as empty and is stored as one unit of fill; null ids and repeated
    rows stay; an empty table gives an empty result; other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(_stored_rows, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """Checks and features of stored media, from the stored bytes alone.

    A null or damaged image raises DamagedImage: what was stored must come back whole.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.mapInArrow(_feature_rows, schema)
