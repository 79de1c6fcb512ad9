"""Grey TIFF stacks of 8 or 16 bit: strips or tiles, plain, PackBits, LZW or deflate, with or without predictor, also BigTIFF.
Stacks are written whole, or page by page by a task that never holds more than two."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsegrid.operators.segment import bounded_frames, images_of

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 16: 8}
_CODES = {1: "B", 3: "H", 4: "I", 16: "Q"}


def _values(data: bytes, order: str, kind: int, n: int, field: bytes) -> list[int]:
    size = _SIZES[kind] * n
    raw = field[:size] if size <= len(field) else data[(at := struct.unpack(order + ("I" if len(field) == 4 else "Q"), field)[0]) : at + size]
    if len(raw) != size:
        raise ValueError("a damaged TIFF")
    return list(struct.unpack(order + _CODES[kind] * n, raw))


def unpacked_bits(data: bytes) -> bytes:
    """PackBits: runs of literal bytes and repeated ones."""
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += 2 + n
        else:
            if n > 128:
                out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2 if n > 128 else 1
    return b"".join(out)


def unpacked_lzw(data: bytes) -> bytes:
    """LZW as TIFF has it: most significant bit first, codes of 9 to 12 bits that grow one early, 256 clears, 257 ends."""
    out: list[bytes] = []
    table: list[bytes] = []
    last, width, bits, held = b"", 9, 0, 0
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 256:
            table, last, width = [bytes([k]) for k in range(256)] + [b"", b""], b"", 9
            continue
        if code == 257:
            break
        if not table or code > len(table) or (code == len(table) and not last):
            raise ValueError("a damaged TIFF")
        own = table[code] if code < len(table) else last + last[:1]
        out.append(own)
        if last:
            table.append(last + own[:1])
        last = own
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


#: How compressed bytes are unpacked, by the number of the compression.
UNPACK = {1: bytes, 5: unpacked_lzw, 8: zlib.decompress, 32773: unpacked_bits, 32946: zlib.decompress}


def _block(data: bytes, order: str, bits: int, shape: tuple[int, int], method: int, predictor: int) -> np.ndarray:
    """One strip or tile."""
    try:
        raw = UNPACK[method](data)
    except zlib.error as e:
        raise ValueError("a damaged TIFF") from e
    size = shape[0] * shape[1] * bits // 8
    if len(raw) < size:
        raise ValueError("a damaged TIFF")
    out = np.frombuffer(raw[:size], dtype=f"{order}u{bits // 8}").reshape(shape).astype(np.int64)
    return np.cumsum(out, axis=1) & ((1 << bits) - 1) if predictor == 2 else out


def pages(data: bytes) -> Iterator[np.ndarray]:
    """Pages of a TIFF in order, decoded one at a time. Files that are damaged or of another kind raise ValueError."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    magic = struct.unpack_from(order + "H", data, 2)[0] if order and len(data) >= 8 else 0
    if magic not in (42, 43):
        raise ValueError("not a TIFF")
    big = magic == 43
    word, many_word, entry = ("Q", "Q", 20) if big else ("I", "H", 12)
    try:
        (at,) = struct.unpack_from(order + word, data, 8 if big else 4)
        seen = set()
        while at:
            if at in seen:
                raise ValueError("a damaged TIFF")
            seen.add(at)
            (n,) = struct.unpack_from(order + many_word, data, at)
            body = at + struct.calcsize(order + many_word)
            tags = {}
            for k in range(n):
                tag, kind, many = struct.unpack_from(order + "HH" + word, data, body + entry * k)
                if kind in _CODES:
                    end = body + entry * (k + 1)
                    tags[tag] = _values(data, order, kind, many, data[end - (8 if big else 4) : end])
            yield _page(data, order, tags)
            (at,) = struct.unpack_from(order + word, data, body + entry * n)
    except (struct.error, KeyError, IndexError) as e:
        raise ValueError("a damaged TIFF") from e


def _page(data: bytes, order: str, tags: dict[int, list[int]]) -> np.ndarray:
    width, height, bits = tags[256][0], tags[257][0], tags.get(258, [1])[0]
    method, predictor = tags.get(259, [1])[0], tags.get(317, [1])[0]
    if method not in UNPACK or predictor not in (1, 2) or bits not in (8, 16) or tags.get(277, [1])[0] != 1:
        raise ValueError("only grey pages of 8 or 16 bit in a known compression are read")
    out = np.zeros((height, width), dtype=np.int64)
    if 322 in tags:  # tiles, padded at the right and below
        w, h = tags[322][0], tags[323][0]
        across = -(-width // w)
        for k, (o, c) in enumerate(zip(tags[324], tags[325], strict=True)):
            y, x = k // across * h, k % across * w
            tile = _block(data[o : o + c], order, bits, (h, w), method, predictor)
            out[y : y + h, x : x + w] = tile[: height - y, : width - x]
        return out
    rows = min(tags.get(278, [height])[0], height) or 1
    for k, (o, c) in enumerate(zip(tags[273], tags[279], strict=True)):
        y = k * rows
        out[y : y + rows] = _block(data[o : o + c], order, bits, (min(rows, height - y), width), method, predictor)
    return out


def stack(images: list[np.ndarray], bits: int = 16) -> bytes:
    """A little-endian multi-page TIFF; values are clamped to the range."""
    out, at = [b"II*\0"], 8
    body = []
    for k, image in enumerate(images):
        raw = np.clip(image, 0, (1 << bits) - 1).astype(f"<u{bits // 8}").tobytes()
        raw += b"\0" * (len(raw) % 2)
        fields = [(256, 4, image.shape[1]), (257, 4, image.shape[0]), (258, 3, bits), (259, 3, 1), (262, 3, 1), (273, 4, at), (277, 3, 1), (278, 4, image.shape[0]), (279, 4, image.size * bits // 8)]
        directory = at + len(raw)
        at = directory + 2 + 12 * len(fields) + 4
        entries = b"".join(struct.pack("<HHI", t, kind, 1) + struct.pack("<I" if kind == 4 else "<HH", *((v,) if kind == 4 else (v, 0))) for t, kind, v in fields)
        body.append((directory, raw, struct.pack("<H", len(fields)) + entries, k + 1 < len(images)))
    out.append(struct.pack("<I", body[0][0] if body else 0))
    for k, (_, raw, entries, more) in enumerate(body):
        out += [raw, entries, struct.pack("<I", body[k + 1][0] if more else 0)]
    return b"".join(out)


def decode_frames(files: DataFrame, keys: list[str], first: int | None = None) -> DataFrame:
    """(keys, page, width, height, px) of ``files`` (keys, content): one row per page, handed on one by one;
    ``first`` stops after that many. Pixels go to the JVM from the decoded buffer."""
    kinds = dict(files.dtypes)
    kind = pa.list_(pa.int32())

    def decode(batches):
        for batch in batches:
            for k, content in enumerate(batch.column("content")):
                for page, image in enumerate(pages(content.as_py())):
                    if first is not None and page >= first:
                        break
                    px = pa.ListArray.from_arrays(pa.array([0, image.size], pa.int32()), pa.array(image.ravel().astype(np.int32)))
                    own = {c: batch.column(c).slice(k, 1) for c in keys}
                    yield pa.record_batch({**own, "page": pa.array([page], pa.int32()), "width": pa.array([image.shape[1]], pa.int32()), "height": pa.array([image.shape[0]], pa.int32()), "px": px.cast(kind)})

    return files.select(*keys, "content").mapInArrow(decode, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", page int, width int, height int, px array<int>")


def files_of(spark: SparkSession, folder: str, glob: str = "*.[tT][iI][fF]") -> DataFrame:
    """(path, name, content) of image files. Contents are read only where they are used."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def read_frames(spark: SparkSession, folder: str, first: int | None = None, glob: str = "*.[tT][iI][fF]") -> DataFrame:
    """(path, frame, width, height, px): one row per page; ``first`` stops after that many."""
    return decode_frames(files_of(spark, folder, glob), ["path"], first).withColumnRenamed("page", "frame")


def write_stacks(files: DataFrame, keys: list[str], path: str) -> None:
    """Write TIFFs (keys, content) as files under a folder per key, through the commit protocol of Spark's text
    writer, to any file system. The newline that it adds lies behind the last page, where readers don't look."""
    rows = files.select(*keys, F.col("content").cast("string").alias("value"))
    rows.write.partitionBy(*keys).option("maxRecordsPerFile", 1).text(path)


def _big_page(image: np.ndarray, bits: int, at: int, more: bool) -> bytes:
    """A directory and the pixels of a page of a BigTIFF, at the place ``at`` of the file; the next one begins behind a byte of padding."""
    raw = np.clip(image, 0, (1 << bits) - 1).astype(f"<u{bits // 8}").tobytes()
    fields = [(256, 4, image.shape[1]), (257, 4, image.shape[0]), (258, 3, bits), (259, 3, 1), (262, 3, 1), (273, 16, 0), (277, 3, 1), (278, 4, image.shape[0]), (279, 16, len(raw))]
    size = 8 + 20 * len(fields) + 8
    fields[5] = (273, 16, at + size)
    entries = b"".join(struct.pack("<HHQQ", t, kind, 1, v) for t, kind, v in fields)
    return struct.pack("<Q", len(fields)) + entries + struct.pack("<Q", at + size + len(raw) + 1 if more else 0) + raw


def write_long_stacks(frames: DataFrame, keys: list[str], path: str, bits: int = 16) -> None:
    """Write a BigTIFF per key under a folder per key, its frames in order, whatever their number (SNK1, SNK2). A stack's pages
    go through one task in turn, which holds two of them; they are sorted by Spark, which spills. A page is a line of Spark's text
    writer, and the newline after it is padding between pages, which their directories count in."""
    bounded_frames(frames.sparkSession)
    kinds = dict(frames.dtypes)
    dealt = frames.select(*keys, "frame", "width", "px").repartition(*keys).sortWithinPartitions(*keys, "frame")

    def build(batches):
        held = at = None  # the page that waits to know whether another follows, and its place

        def row(own, place, content):
            return pa.record_batch({**own, "place_": pa.array([place], pa.int64()), "value": pa.array([content], pa.binary())})

        for batch in batches:
            values = [batch.column(k).to_pylist() for k in keys]
            for k, image in enumerate(images_of(batch)):
                own, key = {c: batch.column(c).slice(k, 1) for c in keys}, tuple(v[k] for v in values)
                if held is not None:
                    page = _big_page(held[2], bits, at, held[1] == key)
                    yield row(held[0], at, page)
                    at += len(page) + 1
                if held is None or held[1] != key:
                    yield row(own, 0, struct.pack("<2sHHHQ", b"II", 43, 8, 0, 17))
                    at = 17
                held = (own, key, np.array(image))
        if held is not None:
            yield row(held[0], at, _big_page(held[2], bits, at, False))

    pieces = dealt.mapInArrow(build, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", place_ long, value binary")
    lines = pieces.sortWithinPartitions(*keys, "place_").select(*keys, F.col("value").cast("string").alias("value"))
    lines.write.partitionBy(*keys).text(path)


def stacks(frames: DataFrame, keys: list[str], bits: int = 16) -> DataFrame:
    """(keys, content): a TIFF per key, its frames in order. A key is one stack, which fits a task."""
    kinds = dict(frames.dtypes)

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame")
        images = [np.asarray(p).reshape(-1, w) for p, w in zip(rows["px"], rows["width"], strict=True)]
        return pd.DataFrame({**{k: [rows[k].iloc[0]] for k in keys}, "content": [stack(images, bits)]})

    return frames.select(*keys, "frame", "width", "px").groupBy(*keys).applyInPandas(build, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", content binary")
