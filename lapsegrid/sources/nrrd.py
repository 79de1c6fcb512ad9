"""NRRD volumes of one channel: a text header, then raw or gzip samples, planes as pages."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Sample types by their names in the header.
TYPES = {
    "signed char": "i1", "int8": "i1", "int8_t": "i1", "uchar": "u1", "unsigned char": "u1", "uint8": "u1", "uint8_t": "u1", "short": "i2", "short int": "i2", "signed short": "i2",
    "int16": "i2", "int16_t": "i2", "ushort": "u2", "unsigned short": "u2", "unsigned short int": "u2", "uint16": "u2", "uint16_t": "u2", "int": "i4", "signed int": "i4", "int32": "i4", "int32_t": "i4",
    "uint": "u4", "unsigned int": "u4", "uint32": "u4", "uint32_t": "u4", "float": "f4", "double": "f8",
}


def header(data: bytes) -> tuple[dict[str, str], int]:
    """(fields, where the samples begin) of a file with its samples inside. Other files raise ValueError."""
    if not data.startswith(b"NRRD000"):
        raise ValueError("not an NRRD")
    fields, at = {}, data.find(b"\n") + 1
    while True:
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("a damaged NRRD")
        line, at = data[at:end].rstrip(b"\r").decode("latin-1"), end + 1
        if not line:
            return fields, at
        if not line.startswith("#") and ":=" not in line:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()


def planes(data: bytes) -> Iterator[np.ndarray]:
    """Planes of a volume in order; the first axis of the header runs along a row. Samples of whole numbers are kept as such."""
    fields, at = header(data)
    try:
        sizes = [int(n) for n in fields["sizes"].split()]
        kind = TYPES[fields["type"].lower()]
        encoding = fields["encoding"].lower()
    except (KeyError, ValueError) as e:
        raise ValueError("a damaged NRRD") from e
    if not 2 <= len(sizes) <= 3 or min(sizes) < 1 or encoding not in ("raw", "gzip", "gz") or {"data file", "datafile", "line skip", "byte skip"} & {k for k, v in fields.items() if v != "0"}:
        raise ValueError("only volumes of two or three axes with raw or gzip samples in the same file are read")
    try:
        raw = data[at:] if encoding == "raw" else gzip.decompress(data[at:])
    except (OSError, EOFError, zlib.error) as e:
        raise ValueError("a damaged NRRD") from e
    width, height, depth = (*sizes, 1)[:3]
    order = ">" if fields.get("endian", "little").lower() == "big" else "<"
    size = width * height * int(kind[1])
    if len(raw) < size * depth:
        raise ValueError("a damaged NRRD")
    for z in range(depth):
        yield np.frombuffer(raw, dtype=order + kind, count=width * height, offset=z * size).reshape(height, width)


def volume(images: list[np.ndarray], kind: str = "uint16", encoding: str = "gzip") -> bytes:
    """An NRRD of planes of equal size."""
    body = b"".join(np.ascontiguousarray(im).astype("<" + TYPES[kind]).tobytes() for im in images)
    h, w = images[0].shape
    lines = ["NRRD0004", f"type: {kind}", "dimension: 3", f"sizes: {w} {h} {len(images)}", "endian: little", f"encoding: {encoding}", "", ""]
    return "\n".join(lines).encode() + (gzip.compress(body) if encoding == "gzip" else body)


def decode_planes(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, page, width, height, px array<double>) of ``files`` (keys, content): a row per plane, handed on one by one (SRC7)."""
    kinds = dict(files.dtypes)

    def decode(batches):
        for batch in batches:
            for k, content in enumerate(batch.column("content")):
                for page, image in enumerate(planes(content.as_py())):
                    own = {c: batch.column(c).slice(k, 1) for c in keys}
                    px = pa.array([image.astype(np.float64).ravel()], pa.list_(pa.float64()))
                    yield pa.record_batch({**own, "page": pa.array([page], pa.int32()), "width": pa.array([image.shape[1]], pa.int32()), "height": pa.array([image.shape[0]], pa.int32()), "px": px})

    return files.select(*keys, "content").mapInArrow(decode, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", page int, width int, height int, px array<double>")
