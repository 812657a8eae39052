"""Image files as rows: decoders by file suffix, on Spark's binaryFile source.

Built in: .npy, .png (gray or RGB, 8 or 16 bits, not interlaced), and .dcm/.dicom with uncompressed
pixels in little-endian order. Others are registered in DECODERS by their users. A file that can't be
read is a row with its error.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, image_id string, h int, w int, data binary, pixel_spacing_mm double, photometric string, manufacturer string, error string"
_TYPE = pa.schema([("path", pa.string()), ("image_id", pa.string()), ("h", pa.int32()), ("w", pa.int32()), ("data", pa.binary()), ("pixel_spacing_mm", pa.float64()), ("photometric", pa.string()), ("manufacturer", pa.string()), ("error", pa.string())])


def png(body: bytes) -> tuple[np.ndarray, dict]:
    """Pixels as they are stored; colours as their mean."""
    if body[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, packed, head = 8, b"", None
    while at < len(body):
        size, kind = struct.unpack(">I4s", body[at : at + 8])
        part = body[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            packed += part
        at += size + 12
    w, h, bits, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if channels is None or bits not in (8, 16) or interlaced:
        raise ValueError(f"PNG of colour type {colour}, {bits} bits, interlaced {interlaced}: not supported")
    step = channels * bits // 8
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + w * step)
    out = np.zeros((h, w * step), np.uint8)
    above = np.zeros(w * step, np.int64)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        if kind == 2:
            line = line + above
        elif kind == 1:
            line = np.cumsum(line.reshape(-1, step), axis=0).ravel()
        elif kind in (3, 4):
            for x in range(len(line)):
                a, b, c = (line[x - step] if x >= step else 0), above[x], (above[x - step] if x >= step else 0)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[x] = (line[x] + guess) & 255
        above = line & 255
        out[y] = above
    pixels = (out.reshape(h, w, channels, 2).astype(np.uint16) @ np.array([256, 1], np.uint16)) if bits == 16 else out.reshape(h, w, channels)
    return pixels[..., : 3 if channels > 2 else 1].astype(np.float32).mean(axis=2), {}


# Fixed values of DICOM: transfer syntaxes that can be read here, tags, and types with long lengths.
IMPLICIT, EXPLICIT = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1"
TAGS = {(0x0002, 0x0010): "syntax", (0x0008, 0x0070): "manufacturer", (0x0018, 0x1164): "imager_spacing", (0x0028, 0x0004): "photometric", (0x0028, 0x0010): "rows", (0x0028, 0x0011): "columns", (0x0028, 0x0030): "spacing", (0x0028, 0x0100): "bits", (0x0028, 0x0103): "signed", (0x0028, 0x1052): "intercept", (0x0028, 0x1053): "slope"}
PIXELS = (0x7FE0, 0x0010)
LONG = {b"OB", b"OW", b"OF", b"SQ", b"UT", b"UN", b"OD", b"OL", b"UC", b"UR", b"OV", b"SV", b"UV"}


def dicom_header(body: bytes) -> tuple[dict[str, bytes], bytes | None]:
    """The values of TAGS, and the pixel data if it follows."""
    if body[128:132] != b"DICM":
        raise ValueError("not a DICOM file")
    at, found, implicit = 132, {}, False
    while at + 8 <= len(body):
        tag = struct.unpack("<HH", body[at : at + 4])
        if implicit and tag[0] != 2:
            size, at = struct.unpack("<I", body[at + 4 : at + 8])[0], at + 8
        elif body[at + 4 : at + 6] in LONG:
            size, at = struct.unpack("<I", body[at + 8 : at + 12])[0], at + 12
        else:
            size, at = struct.unpack("<H", body[at + 6 : at + 8])[0], at + 8
        if tag == PIXELS:
            return found, body[at : at + size] if size != 0xFFFFFFFF else None
        if size == 0xFFFFFFFF:  # a sequence of open length: up to its delimiter
            end = body.find(b"\xfe\xff\xdd\xe0\x00\x00\x00\x00", at)
            if end < 0:
                raise ValueError("a sequence has no end")
            at = end + 8
            continue
        if tag in TAGS:
            found[TAGS[tag]] = body[at : at + size]
        at += size
        if tag == (0x0002, 0x0010):
            syntax = found["syntax"].rstrip(b"\0 ").decode()
            if syntax not in (IMPLICIT, EXPLICIT):
                raise ValueError(f"transfer syntax {syntax} needs a decoder of its own")
            implicit = syntax == IMPLICIT
    return found, None


def dicom(body: bytes, force_invert: bool | None = None) -> tuple[np.ndarray, dict]:
    """Pixels after slope and intercept; MONOCHROME1 turned round as max - x, unless force_invert says otherwise."""
    head, data = dicom_header(body)
    text = lambda k: head[k].decode("latin-1").strip("\0 ") if head.get(k) else None
    short = lambda k: struct.unpack("<H", head[k][:2])[0] if k in head else 0
    h, w, bits = short("rows"), short("columns"), short("bits")
    if data is None or not h or bits not in (8, 16):
        raise ValueError("no pixels that can be read")
    x = np.frombuffer(data, f"<{'i' if short('signed') else 'u'}{bits // 8}", h * w).reshape(h, w).astype(np.float32)
    x = x * float(text("slope") or 1) + float(text("intercept") or 0)
    if force_invert if force_invert is not None else text("photometric") == "MONOCHROME1":
        x = x.max() - x
    spacing = text("spacing") or text("imager_spacing")
    return x, {"pixel_spacing_mm": float(spacing.split("\\")[-1]) if spacing else None, "photometric": text("photometric"), "manufacturer": text("manufacturer")}


def npy(body: bytes) -> tuple[np.ndarray, dict]:
    return np.load(io.BytesIO(body), allow_pickle=False), {}


#: Suffix to a function of a file's bytes that gives the pixels and what else is known.
DECODERS: dict[str, Callable[[bytes], tuple[np.ndarray, dict]]] = {"npy": npy, "png": png, "dcm": dicom, "dicom": dicom}


def read_images(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ("npy", "png", "dcm", "dicom")) -> DataFrame:
    """The files below folder with one of suffixes, decoded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content").where(f"lower(element_at(split(path, '[.]'), -1)) in ({', '.join(repr(s) for s in suffixes)})")
    decoders = dict(DECODERS)

    def row(path: str, body: bytes) -> dict:
        name, _, kind = path.rsplit("/", 1)[-1].rpartition(".")
        try:
            x, more = decoders[kind.lower()](body)
            x = np.squeeze(x)
            if x.ndim != 2:
                raise ValueError(f"an image has two axes, not {x.ndim}")
            return {"path": path, "image_id": name, "h": x.shape[0], "w": x.shape[1], "data": x.astype("<f4").tobytes(), **more}
        except Exception as e:  # noqa: BLE001  one bad file must not end the job
            return {"path": path, "image_id": name, "error": f"{type(e).__name__}: {e}"[:500]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1).to_pylist()[0]
                yield pa.RecordBatch.from_pylist([row(one["path"], one["content"])], schema=_TYPE)

    return files.mapInArrow(run, SCHEMA)
