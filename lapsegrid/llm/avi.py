"""Media columns: AVI motion-JPEG, intra frames only.

A payload becomes the 8-bit samples of grey frames, 64 samples wide. Frames are lossless
JPEG (ITU-T T.81 process 14: SOF3, left predictor) inside a RIFF AVI with an idx1 index,
so reading back is exact. Every line is a restart interval: the lines of all frames in a
batch are entropy-coded, and decoded, side by side in numpy.

Shots are cut where the histogram of a frame differs from the one before by more than an
adaptive threshold, the mean and spread of the differences just before it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lapsegrid.llm.common import bounded_batches, columns

WIDTH, HEIGHT, FPS = 64, 16, 10
#: Lines that are coded at once.
LINES = 8192
#: Shot detection: histogram bins, differences looked back on, spreads above their mean, least difference.
BINS, LOOKBACK, SPREADS, LEAST_CUT, FIRST_CUT = 16, 8, 3.0, 0.10, 0.30
#: Huffman code lengths of the difference categories 0 to 8; the code of all ones stays free.
LENGTHS = {7: 2, 2: 3, 3: 3, 4: 3, 5: 3, 0: 4, 1: 4, 6: 4, 8: 5}


# -- JPEG -----------------------------------------------------------------
def huffman_segment() -> bytes:
    """DHT segment of the one table."""
    by_length = [[c for c, n in LENGTHS.items() if n == k] for k in range(1, 17)]
    body = bytes([0]) + bytes(map(len, by_length)) + bytes(c for own in by_length for c in own)
    return b"\xff\xc4" + struct.pack(">H", len(body) + 2) + body


def codes_of(dht: bytes) -> dict[int, tuple[int, int]]:
    """category -> (code, length) of a DHT body (table byte, 16 counts, symbols)."""
    counts, symbols = dht[1:17], iter(dht[17:])
    out, code = {}, 0
    for n, many in enumerate(counts, 1):
        for _ in range(many):
            out[next(symbols)] = (code, n)
            code += 1
        code <<= 1
    return out


HEAD = (
    b"\xff\xd8" + huffman_segment()
    + b"\xff\xc3" + struct.pack(">HBHHB3B", 11, 8, HEIGHT, WIDTH, 1, 1, 0x11, 0)
    + b"\xff\xdd" + struct.pack(">HH", 4, WIDTH)
    + b"\xff\xda" + struct.pack(">HB2B3B", 8, 1, 1, 0, 1, 0, 0)
)


@lru_cache(1)
def _encoder() -> tuple[np.ndarray, np.ndarray]:
    """For differences -255..255: the left-aligned 16-bit code with its extra bits, and its length."""
    codes = codes_of(huffman_segment()[4:])
    value, length = np.zeros(511, dtype=">u2"), np.zeros(511, dtype=np.uint8)
    for d in range(-255, 256):
        category = abs(d).bit_length()
        code, n = codes[category]
        extra = d if d >= 0 else d + (1 << category) - 1
        value[d + 255] = ((code << category) | extra) << (16 - n - category)
        length[d + 255] = n + category
    return value, length


@lru_cache(8)
def _decoder(dht: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit window: the difference and the bits it takes (0: not a code)."""
    diff, length = np.zeros(1 << 16, dtype=np.int32), np.zeros(1 << 16, dtype=np.int64)
    for category, (code, n) in codes_of(dht).items():
        if category > 8:
            raise ValueError("not 8-bit samples")
        for extra in range(1 << category):
            low = ((code << category) | extra) << (16 - n - category)
            value = extra if not category or extra >> (category - 1) else extra - (1 << category) + 1
            diff[low : low + (1 << (16 - n - category))] = value
            length[low : low + (1 << (16 - n - category))] = n + category
    return diff, length


def encode_lines(samples: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Scan data of whole frames, lines of WIDTH samples; and where each frame's data ends.

    Lines end with a restart marker, the last of a frame with the end of image.
    """
    value, length = _encoder()
    diff = np.diff(samples.astype(np.int16), axis=1, prepend=np.int16(128)) + 255
    bits = np.empty((len(samples), WIDTH + 1), dtype=np.uint8)
    bits[:, :-1] = length[diff]
    total = bits[:, :-1].sum(axis=1, dtype=np.int64)
    bits[:, -1] = -total % 8
    code = np.full(bits.shape, 0xFFFF, dtype=">u2")
    code[:, :-1] = value[diff]
    flat = np.unpackbits(code.view(np.uint8).reshape(-1, 2), axis=1)
    data = np.packbits(flat[np.arange(16) < bits.reshape(-1, 1)])
    size = (total + bits[:, -1]) // 8
    line = np.repeat(np.arange(len(samples)), size)
    full = data == 0xFF
    at = np.arange(len(data)) + np.cumsum(full) - full + 2 * line
    stuffed = np.bincount(line, full, len(samples)).astype(np.int64)
    ends = np.cumsum(size + stuffed + 2)
    out = np.zeros(ends[-1] if len(ends) else 0, dtype=np.uint8)
    out[at] = data
    row = np.arange(len(samples)) % HEIGHT
    out[ends - 2] = 0xFF
    out[ends - 1] = np.where(row == HEIGHT - 1, 0xD9, 0xD0 + row % 8)
    return out.tobytes(), ends[HEIGHT - 1 :: HEIGHT]


@lru_cache(64)
def read_head(head: bytes) -> tuple[bytes, int, int]:
    """(DHT body, width, height) of a lossless JPEG up to the end of its SOS segment."""
    at, dht, size, every = 2, b"", None, 0
    if head[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    while at < len(head):
        mark, n = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body = head[at + 4 : at + 2 + n]
        if mark == 0xC4:
            dht = body
        elif mark == 0xC3:
            size = struct.unpack_from(">BHHB", body)
        elif mark == 0xDD:
            every = struct.unpack(">H", body)[0]
        elif mark == 0xDA and body[3] != 1:
            raise ValueError("only the left predictor is known")
        at += 2 + n
    if not size or size[0] != 8 or size[3] != 1 or every != size[2] or not dht:
        raise ValueError("only grey 8-bit lossless frames with a restart on each line are known")
    return dht, size[2], size[1]


def head_size(frame: bytes) -> int:
    """Bytes before the scan data."""
    at = 2
    while frame[at + 1] != 0xDA:
        at += 2 + struct.unpack_from(">H", frame, at + 2)[0]
    return at + 2 + struct.unpack_from(">H", frame, at + 2)[0]


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """Samples of frames that share one head, as (frame, line, sample)."""
    size = head_size(frames[0])
    dht, width, height = read_head(frames[0][:size])
    if any(f[:size] != frames[0][:size] for f in frames):
        raise ValueError("frames differ in their heads")
    diff, length = _decoder(dht)
    raw = np.frombuffer(b"".join(f[size:] for f in frames), dtype=np.uint8)
    after = np.append(raw[1:], 0)
    ends = np.flatnonzero((raw == 0xFF) & (((after >= 0xD0) & (after <= 0xD7)) | (after == 0xD9)))
    keep = np.ones(len(raw), dtype=bool)
    keep[1:] &= ~((raw[:-1] == 0xFF) & (raw[1:] == 0))
    place = np.cumsum(keep) - keep
    begins = np.concatenate(([0], ends[:-1] + 2))
    data = np.concatenate((raw[keep], np.zeros(3, dtype=np.uint8))).astype(np.uint32)
    window = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    at, limit = place[begins] * 8, place[ends] * 8
    out = np.empty((len(ends), width), dtype=np.uint8)
    value = np.full(len(ends), 128, dtype=np.int32)
    for k in range(width):
        bits = (window[at >> 3] >> (8 - (at & 7)).astype(np.uint32)) & 0xFFFF
        value = value + diff[bits]
        at = at + length[bits]
        out[:, k] = value
    if (at > limit).any() or (limit - at >= 8).any() or len(ends) != height * len(frames):
        raise ValueError("damaged scan data")
    return out.reshape(len(frames), height, width)


# -- AVI ------------------------------------------------------------------
def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def avi(frames: list[bytes], payload: bytes) -> bytes:
    """A RIFF AVI of JPEG frames; the payload's length and CRC-32 stand in the INFO list."""
    largest = max(map(len, frames), default=0)
    head = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, len(frames), 0, 1, largest, WIDTH, HEIGHT, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    form = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", WIDTH * HEIGHT, 0, 0, 0, 0)
    lists = chunk(b"LIST", b"hdrl" + chunk(b"avih", head) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", form)))
    lists += chunk(b"LIST", b"INFO" + chunk(b"ICMT", b"payload %d %08x\0" % (len(payload), zlib.crc32(payload))))
    movie, index, at = [], [], 4
    for f in frames:
        movie.append(chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(movie[-1])
    return chunk(b"RIFF", b"AVI " + lists + chunk(b"LIST", b"movi" + b"".join(movie)) + chunk(b"idx1", b"".join(index)))


def chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, first byte of the body, size) of the chunks in a RIFF span."""
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        yield name, at + 8, size
        at += 8 + size + size % 2


@dataclass
class Movie:
    frames: list[bytes]
    payload: int
    crc32: int
    seconds: float
    """Per frame."""

    def restored(self, samples: np.ndarray) -> bytes:
        """The payload in the decoded samples, checked."""
        payload = samples.tobytes()[: self.payload]
        if zlib.crc32(payload) != self.crc32:
            raise ValueError("damaged payload")
        return payload


def read_avi(data: bytes) -> Movie:
    """Frames by the idx1 index, the payload length and the frame duration."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI")
    movie, index, payload, crc, seconds = 0, None, 0, 0, 1 / FPS
    for name, at, size in chunks(data, 12, 8 + struct.unpack_from("<I", data, 4)[0]):
        kind = data[at : at + 4]
        if name == b"LIST" and kind == b"movi":
            movie = at
        elif name == b"LIST" and kind == b"INFO":
            texts = {n: data[a : a + s] for n, a, s in chunks(data, at + 4, at + size)}
            _, size_text, crc_text = texts[b"ICMT"].rstrip(b"\0").split()
            payload, crc = int(size_text), int(crc_text, 16)
        elif name == b"LIST" and kind == b"hdrl":
            seconds = next(struct.unpack_from("<I", data, a)[0] for n, a, _ in chunks(data, at + 4, at + size) if n == b"avih") / 1e6
        elif name == b"idx1":
            index = [struct.unpack_from("<4sIII", data, at + k) for k in range(0, size, 16)]
    if index is None:
        raise ValueError("no index")
    return Movie([data[movie + off + 8 : movie + off + 8 + size] for _, _, off, size in index], payload, crc, seconds)


# -- shots ----------------------------------------------------------------
def clips(frames: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) frame of each shot."""
    n = len(frames)
    if not n:
        return []
    level = (np.arange(n)[:, None] * BINS + (frames.reshape(n, -1) >> 4)).ravel()
    histogram = np.bincount(level, minlength=n * BINS).reshape(n, BINS) / frames[0].size
    cuts = []
    if n > 1:
        d = np.abs(np.diff(histogram, axis=0)).sum(axis=1) / 2
        usual = np.minimum(d, FIRST_CUT)  # a cut must not hide the next one
        sums, squares = np.concatenate(([0], np.cumsum(usual))), np.concatenate(([0], np.cumsum(usual**2)))
        t = np.arange(len(d))
        low = np.maximum(0, t - LOOKBACK)
        many = t - low
        mean = (sums[t] - sums[low]) / np.maximum(many, 1)
        spread = np.sqrt(np.maximum((squares[t] - squares[low]) / np.maximum(many, 1) - mean**2, 0))
        least = np.where(many < 2, FIRST_CUT, np.maximum(LEAST_CUT, mean + SPREADS * spread))
        cuts = (np.flatnonzero(d > least) + 1).tolist()
    return [(a, b - 1) for a, b in zip([0, *cuts], [*cuts, n], strict=True)]


# -- columns --------------------------------------------------------------
def padded(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, payload): UTF-8 filled with zero bytes to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * (WIDTH - len(raw) % WIDTH if len(raw) % WIDTH or not raw else 0)


def encode_payload(payload: bytes) -> bytes:
    """The AVI of one payload (a multiple of WIDTH bytes)."""
    lines = -(-len(payload) // (WIDTH * HEIGHT)) * HEIGHT
    samples = np.frombuffer(payload + b"\0" * (lines * WIDTH - len(payload)), dtype=np.uint8).reshape(-1, WIDTH)
    frames = []
    for at in range(0, lines, LINES):
        data, ends = encode_lines(samples[at : at + LINES])
        begin = 0
        for end in ends.tolist():
            frames.append(HEAD + data[begin:end])
            begin = end
    return avi(frames, payload)


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """As encode_payload for each, with the lines of small payloads coded together."""
    out: list[bytes | None] = [None] * len(payloads)
    group: list[tuple[int, int]] = []
    parts: list[bytes] = []
    held = 0

    def close():
        nonlocal held
        if group:
            data, ends = encode_lines(np.frombuffer(b"".join(parts), dtype=np.uint8).reshape(-1, WIDTH))
            ends, begin, k = ends.tolist(), 0, 0
            for place, many in group:
                frames = []
                for end in ends[k : k + many]:
                    frames.append(HEAD + data[begin:end])
                    begin = end
                k += many
                out[place] = avi(frames, payloads[place])
        group.clear()
        parts.clear()
        held = 0

    for place, p in enumerate(payloads):
        many = -(-len(p) // (WIDTH * HEIGHT))
        if many * HEIGHT > LINES:
            out[place] = encode_payload(p)
            continue
        if held + many * HEIGHT > LINES:
            close()
        group.append((place, many))
        parts.append(p + b"\0" * (many * WIDTH * HEIGHT - len(p)))
        held += many * HEIGHT
    close()
    return out


def decode_many(media: list[bytes]) -> Iterator[tuple[Movie, np.ndarray]]:
    """Movie and samples of each medium; frames of several small media are decoded together."""
    movies = [read_avi(m) for m in media]
    k = 0
    while k < len(movies):
        group, frames = [], []
        while k < len(movies) and (not group or (len(frames) + len(movies[k].frames)) * HEIGHT <= 4 * LINES):
            group.append(movies[k])
            frames += movies[k].frames
            k += 1
        step = 4 * LINES // HEIGHT
        samples = np.concatenate([decode_frames(frames[a : a + step]) for a in range(0, len(frames), step)])
        at = 0
        for m in group:
            yield m, samples[at : at + len(m.frames)]
            at += len(m.frames)


def _encode(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [padded(t) for (t,) in columns(batch, "text")]
        media = encode_many([p for _, p in made])
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_bytes": pa.array([n for n, _ in made], pa.int64()), "media": pa.array(media, pa.binary())})


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as an AVI. Null texts are empty."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_encode, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, media binary")


def _features(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        media = batch.column("media").to_pylist()
        rows = []
        for raw, (movie, samples) in zip(media, decode_many(media), strict=True):
            payload = movie.restored(samples)
            cuts = clips(samples)
            timed = (f"{a}-{b}@{a * movie.seconds:.6f}-{(b + 1) * movie.seconds:.6f}" for a, b in cuts)
            feature = f"frames={len(samples)};seconds={len(samples) * movie.seconds:.6f};clips=" + ",".join(timed)
            rows.append((movie.payload, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(raw), hashlib.sha256(raw).hexdigest(), feature))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        made = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), *made], names=names)


def features(media: DataFrame) -> DataFrame:
    """Digests and shots of stored media (doc_id, n_bytes, media), read back from their bytes."""
    kind = dict(media.dtypes)["doc_id"]
    return media.mapInArrow(_features, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def clip_rows(media: DataFrame) -> DataFrame:
    """Timed clips of stored media: doc_id, clip, start_s, end_s, first_frame, n_frames, level (mean sample)."""
    kind = dict(media.dtypes)["doc_id"]

    def cut(batches):
        for batch in batches:
            rows = []
            for doc, (movie, samples) in zip(batch.column("doc_id").to_pylist(), decode_many(batch.column("media").to_pylist()), strict=True):
                for k, (a, b) in enumerate(clips(samples)):
                    rows.append((doc, k, a * movie.seconds, (b + 1) * movie.seconds, a, b - a + 1, float(samples[a : b + 1].mean())))
            if rows:
                kinds = [batch.schema.field("doc_id").type, pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.float64()]
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "clip", "start_s", "end_s", "first_frame", "n_frames", "level"])

    return media.mapInArrow(cut, f"doc_id {kind}, clip int, start_s double, end_s double, first_frame int, n_frames int, level double")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature: number of frames, seconds, and the clips as frames and, after
    the at sign, seconds, all from the stored header and frames.

    Map only. Null texts are empty, null ids pass through, repeated rows stay and have equal values, texts
    of any length are one medium; other columns are ignored; an empty table gives an empty result."""
    return features(to_media(docs))
