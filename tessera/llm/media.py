"""Media columns: PNG images of binary payloads, read back through their chunks, with perceptual hashes.

An image is 8-bit grey, 64 samples wide, each row filtered by what leaves the least in it, and stored in a binary column of
a written table; what is reported comes from the bytes read back from there.  The reader walks the chunks, tests every CRC-32, inflates the image data and
undoes the five row filters with numpy; the feature is the sign pattern of the lowest 8 x 8 terms of a cosine transform
over the image averaged to 32 x 32.

Rows: a null text counts as empty and gives one row of zero samples; equal texts give equal values; repeated rows and null
doc_ids are carried; an empty table gives no row.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialize

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
SIDE, KEPT = 32, 8


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(samples: bytes, width: int = WIDTH, row_filter: int | None = None, level: int = 6) -> bytes:
    """A grey image of ``samples``, as many rows as they fill; ``row_filter`` 0 to 4 for every row, or None to choose by row.

    The choice is among 0, 1 and 2: the one whose row has the least sum of absolute signed differences, the first of equals.
    """
    x = np.frombuffer(samples, np.uint8).reshape(-1, width)
    rows = np.empty((len(x), width + 1), np.uint8)
    left, up = np.zeros_like(x), np.zeros_like(x)
    left[:, 1:], up[1:] = x[:, :-1], x[:-1]
    if row_filter is None:
        each = np.stack([x, x - left, x - up])
        best = np.abs(each.view(np.int8).astype(np.int16)).sum(axis=2).argmin(axis=0)
        rows[:, 0], rows[:, 1:] = best, each[best, np.arange(len(x))]
    else:
        rows[:, 0] = row_filter
        if row_filter == 4:
            corner = np.zeros_like(x)
            corner[1:, 1:] = x[:-1, :-1]
            guess = paeth(left, up, corner)
        else:
            guess = (0, left, up, ((left.astype(np.uint16) + up) // 2).astype(np.uint8))[row_filter]
        rows[:, 1:] = x - guess
    head = struct.pack(">IIBBBBB", width, len(x), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of left, up and corner, the one nearest to left + up - corner; ties in that order."""
    p = a.astype(np.int16) + b - c
    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c)).astype(np.uint8)


def unfilter(rows: np.ndarray) -> np.ndarray:
    """Samples of filtered rows; the first column is each row's filter.

    Runs of unfiltered and of left-filtered rows are undone at once, up-filtered runs by a sum down the columns; the two
    filters that look left and up go diagonal by diagonal over the run of rows that use them.
    """
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    if (kinds > 4).any():
        raise ValueError("unknown row filter")
    cut = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(rows)], strict=True):
        if a == b:
            continue
        above = out[a - 1] if a else np.zeros(out.shape[1], np.uint8)
        if kinds[a] == 1:
            out[a:b] = np.add.accumulate(out[a:b], axis=1, dtype=np.uint8)
        elif kinds[a] == 2:
            out[a] += above
            out[a:b] = np.add.accumulate(out[a:b], axis=0, dtype=np.uint8)
        elif kinds[a] >= 3:
            h, w = b - a, out.shape[1]
            full = np.zeros((h + 1, w + 1), np.uint8)
            full[0, 1:], full[1:, 1:] = above, out[a:b]
            for d in range(h + w - 1):
                i = np.arange(max(0, d - w + 1), min(h, d + 1)) + 1
                j = d - i + 2
                left, up, corner = full[i, j - 1], full[i - 1, j], full[i - 1, j - 1]
                full[i, j] += ((left.astype(np.uint16) + up) // 2).astype(np.uint8) if kinds[a] == 3 else paeth(left, up, corner)
            out[a:b] = full[1:, 1:]
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Samples of an 8-bit grey image without interlace; ValueError if a chunk, a checksum or a length is wrong."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, body, ended = 8, None, [], False
    while at + 12 <= len(data) and not ended:
        (n,) = struct.unpack_from(">I", data, at)
        kind, content = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if at + 12 + n > len(data) or zlib.crc32(kind + content) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError(f"chunk {kind!r} is damaged")
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", content)
        elif kind == b"IDAT":
            body.append(content)
        ended = kind == b"IEND"
    if not head or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("chunks are missing or of another kind of image")
    width, height = head[:2]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if len(raw) != height * (width + 1):
        raise ValueError("too few or too many samples")
    return unfilter(raw.reshape(height, width + 1))


def averaged(x: np.ndarray, side: int) -> np.ndarray:
    """Means of the image over a ``side`` by ``side`` grid of areas; rows and columns are shared out by their overlap."""
    for axis in (0, 1):
        n = x.shape[axis]
        total = np.concatenate([np.zeros_like(np.take(x, [0], axis), dtype=float), np.cumsum(x, axis=axis, dtype=float)], axis=axis)
        at = np.linspace(0, n, side + 1)
        low = np.minimum(at.astype(int), n - 1)
        part = (at - low).reshape(-1, 1) if axis == 0 else (at - low).reshape(1, -1)
        edge = np.take(total, low, axis) * (1 - part) + np.take(total, low + 1, axis) * part
        x = np.diff(edge, axis=axis) * (side / n)
    return x


def cosine_basis(side: int = SIDE, kept: int = KEPT) -> np.ndarray:
    k, n = np.arange(kept)[:, None], np.arange(side)[None]
    return np.cos(np.pi * k * (2 * n + 1) / (2 * side))


def cosine_hash(x: np.ndarray) -> str:
    """16 hex digits: which of the lowest cosine terms exceed their median, the constant term left out of it."""
    basis = cosine_basis()
    terms = (basis @ averaged(x, SIDE) @ basis.T).ravel().round(6)
    bits = terms > np.median(terms[1:])
    return np.packbits(bits).tobytes().hex()


def payload(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, those bytes up to a positive multiple of the width)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def described(png: bytes) -> dict:
    """What a stored image holds."""
    image = decode_png(png)
    back = image.tobytes()
    return {
        "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-64:]),
        "media_bytes": len(png), "media_sha256": hashlib.sha256(png).hexdigest(), "feature": cosine_hash(image),
    }


def store(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Write every document as an image: a table (doc_id, n_bytes, media binary) in ``folder`` or in the shared folder."""

    def make():
        def write(c: dict[str, list]) -> dict[str, list]:
            both = [payload(t) for t in c["text"]]
            return {"doc_id": c["doc_id"], "n_bytes": [n for n, _ in both], "media": [encode_png(p) for _, p in both]}

        return write

    return materialize(map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, n_bytes long, media binary"), "media", folder)


def describe(stored: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of stored images."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [x.split()[0] for x in schema.split(", ")][2:]

    def make():
        def read(c: dict[str, list]) -> dict[str, list]:
            rows = [described(bytes(m)) for m in c["media"]]
            return {"doc_id": c["doc_id"], "n_bytes": c["n_bytes"]} | {n: [r[n] for r in rows] for n in names}

        return read

    return map_rows(stored.select("doc_id", "n_bytes", "media"), make, schema)
