"""Image files of all known kinds against encoders of this test, damaged files, long stacks and wide text."""

import gzip
import struct
import zlib

import numpy as np
import pytest

from lapsegrid.operators import stack, tables
from lapsegrid.sources import nrrd, tiff


def packbits(data):
    """Runs of three and more as repeats, the rest as literals."""
    out, k = b"", 0
    while k < len(data):
        n = 1
        while k + n < len(data) and n < 128 and data[k + n] == data[k]:
            n += 1
        if n >= 3:
            out, k = out + bytes([257 - n]) + data[k : k + 1], k + n
            continue
        end = k
        while end < len(data) and end - k < 128 and data[end : end + 3] != data[end : end + 1] * 3:
            end += 1
        end = max(end, k + 1)
        out, k = out + bytes([end - k - 1]) + data[k:end], end
    return out + b"\x80"


def lzw(data):
    """Codes as bit strings, from the definition."""
    codes, bits, word = {bytes([k]): k for k in range(256)}, [(256, 9)], b""
    width, n = 9, 258
    for byte in data:
        new = word + bytes([byte])
        if new in codes:
            word = new
            continue
        bits.append((codes[word], width))
        codes[new] = n
        n += 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        if n == 4095:
            bits.append((256, width))
            codes, width, n = {bytes([k]): k for k in range(256)}, 9, 258
        word = bytes([byte])
    if word:
        bits.append((codes[word], width))
        n += 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
    bits.append((257, width))
    text = "".join(format(c, f"0{w}b") for c, w in bits)
    text += "0" * (-len(text) % 8)
    return bytes(int(text[k : k + 8], 2) for k in range(0, len(text), 8))


PACK = {1: bytes, 5: lzw, 8: zlib.compress, 32773: packbits}


def one_page(image, bits=16, method=1, order="<", rows=None, tile=None, predictor=1, big=False):
    """A TIFF of one page."""
    h, w = image.shape
    kind = np.dtype(f"{order}u{bits // 8}")

    def block(part):
        if predictor == 2:
            part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1) & ((1 << bits) - 1)
        return PACK[method](part.astype(kind).tobytes())

    if tile:
        wide = np.zeros((-(-h // tile) * tile, -(-w // tile) * tile), dtype=np.int64)
        wide[:h, :w] = image
        blocks = [block(wide[y : y + tile, x : x + tile]) for y in range(0, h, tile) for x in range(0, w, tile)]
    else:
        rows = rows or h
        blocks = [block(image[y : y + rows]) for y in range(0, h, rows)]
    word, n_word, head = ("Q", "Q", 16) if big else ("I", "H", 8)
    size = struct.calcsize(word)
    offsets = np.cumsum([head, *(len(b) for b in blocks)]).tolist()
    body = b"".join(blocks)
    lists = offsets[-1]
    fields = [(256, 3, [w]), (257, 3, [h]), (258, 3, [bits]), (259, 3, [method]), (277, 3, [1]), (317, 3, [predictor])]
    places, counts = (324, 325) if tile else (273, 279)
    fields += [(322, 3, [tile]), (323, 3, [tile])] if tile else [(278, 3, [rows])]
    fields += [(places, 16 if big else 4, offsets[:-1]), (counts, 16 if big else 4, [len(b) for b in blocks])]
    extra, entries = b"", b""
    for tag, kind_, values in sorted(fields):
        raw = struct.pack(order + {3: "H", 4: "I", 16: "Q"}[kind_] * len(values), *values)
        if len(raw) > size:
            extra, raw = extra + raw, struct.pack(order + word, lists + len(extra))
        entries += struct.pack(order + "HH" + word, tag, kind_, len(values)) + raw.ljust(size, b"\0")
    start = lists + len(extra)
    first = struct.pack(order + "HHHQ", 43, 8, 0, start) if big else struct.pack(order + "HI", 42, start)
    return {"<": b"II", ">": b"MM"}[order] + first + body + extra + struct.pack(order + n_word, len(fields)) + entries + struct.pack(order + word, 0)


@pytest.mark.parametrize("method", PACK)
@pytest.mark.parametrize("form", [{}, {"rows": 3}, {"tile": 16}, {"order": ">"}, {"predictor": 2}, {"bits": 8}, {"big": True, "rows": 5}, {"tile": 16, "predictor": 2, "bits": 8, "order": ">"}])
def test_pages_of_every_form(method, form):
    rng = np.random.default_rng(2)
    image = np.where(rng.random((21, 37)) < 0.5, 7, rng.integers(0, 1 << form.get("bits", 16), (21, 37)))
    (got,) = tiff.pages(one_page(image, method=method, **form))
    assert np.array_equal(got, image)


def test_long_lzw_strips_clear_their_table():
    image = np.random.default_rng(1).integers(0, 256, (200, 200))
    assert np.array_equal(next(tiff.pages(one_page(image, 8, 5))), image)
    assert np.array_equal(next(tiff.pages(one_page(image * 0, 8, 5))), image * 0)


@pytest.mark.parametrize("method", [5, 8, 32773])
def test_damaged_files_raise(method):
    good = one_page(np.arange(600).reshape(20, 30), method=method)
    broken = [good[:8] + b"\xff" * 60 + good[68:]] if method != 32773 else []  # any bytes are PackBits
    for bad in (b"", b"II*\0", good[: len(good) // 2], b"XX" + good[2:], *broken):
        with pytest.raises(ValueError):
            list(tiff.pages(bad))
    loop = tiff.stack([np.ones((2, 2), dtype=int)])
    with pytest.raises(ValueError):
        list(tiff.pages(loop[:-4] + struct.pack("<I", struct.unpack_from("<I", loop, 4)[0])))


@pytest.mark.parametrize("kind", ["uint8", "uint16", "int16", "int32", "float", "double"])
@pytest.mark.parametrize("encoding", ["raw", "gzip"])
def test_nrrd_round_trip(kind, encoding):
    images = list(np.random.default_rng(0).integers(0, 100, (3, 4, 5)))
    assert np.array_equal(np.stack(list(nrrd.planes(nrrd.volume(images, kind, encoding)))), images)


def test_nrrd_headers_and_damage():
    body = np.arange(6, dtype=">u2").tobytes()
    head = b"NRRD0005\n# a comment\nkey:=value\ntype: ushort\ndimension: 2\nsizes: 3 2\nendian: big\nencoding: raw\n\n"
    assert next(nrrd.planes(head + body)).tolist() == [[0, 1, 2], [3, 4, 5]]
    for bad in (b"", b"NRRD0004\ntype: short", head + body[:-1], head.replace(b"3 2", b"x"), head.replace(b"raw", b"bzip2") + body, head.replace(b"raw", b"gzip") + gzip.compress(body)[:-9]):
        with pytest.raises(ValueError):
            list(nrrd.planes(bad))


def test_long_stacks_and_decoded_planes(spark, tmp_path):
    rng = np.random.default_rng(3)
    images = {k: rng.integers(0, 70_000, (n, 6, 9)) for k, n in (("a", 40), ("b", 1), (None, 3))}
    rows = [(k, t, 9, im.ravel().tolist()) for k, v in images.items() for t, im in enumerate(v)]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(k, int(t), int(w), [int(x) for x in px]) for k, t, w, px in rows], "name string, frame int, width int, px array<int>")
    tiff.write_long_stacks(frame.repartition(7), ["name"], str(tmp_path / "long"))
    for k, v in images.items():
        files = list((tmp_path / "long" / f"name={k or '__HIVE_DEFAULT_PARTITION__'}").glob("part-*"))
        assert len(files) == 1
        assert np.array_equal(np.stack(list(tiff.pages(files[0].read_bytes()))), np.minimum(v, 65535))
    files = spark.createDataFrame([("v", nrrd.volume(list(images["a"][:2] % 99)))], "name string, content binary")
    got = nrrd.decode_planes(files, ["name"]).orderBy("page").collect()
    assert [(r.name, r.page, r.width, r.height) for r in got] == [("v", 0, 9, 6), ("v", 1, 9, 6)] and got[1].px == (images["a"][1] % 99).ravel().tolist()


def test_wide_text_equals_the_pivot_and_takes_five_thousand_frames(spark, tmp_path):
    rows = [(w, f, float(w * f)) for w in range(5) for f in range(w % 3, 24, 1 + w % 2)] + [(7, None, 1.0), (8, 3, None), (8, 3, 2.0)]
    long = spark.createDataFrame(rows, "well int, frame int, value double")
    tables.write_wide(long, ["well"], str(tmp_path / "text"), last=23)
    lines = sorted(x for p in (tmp_path / "text").glob("part-*") for x in p.read_text().splitlines())
    pivot = tables.wide(long.where("frame is not null and value is not null"), ["well"], list(range(24)), "value").collect()
    want = sorted("\t".join([str(r.well), *(repr(r[f"f{k}"]) for k in range(1, 25))]) for r in pivot)
    assert [x for x in lines if not x.startswith("7")] == want
    assert [x.split("\t")[1:] for x in lines if x.startswith("7")] == [["-1000.0"] * 24]
    many = spark.range(5000).selectExpr("'w' as well", "cast(id as int) as frame", "cast(id as double) as value")
    tables.write_wide(many, ["well"], str(tmp_path / "many"))
    (line,) = (x for p in (tmp_path / "many").glob("part-*") for x in p.read_text().splitlines())
    assert line.split("\t") == ["w", *map(str, map(float, range(5000)))]


def test_scatter_tiles(spark):
    rng = np.random.default_rng(6)
    counts = [(int(a), int(b), int(n)) for a, b, n in zip(rng.integers(0, 5300, 400), rng.integers(0, 5300, 400), rng.integers(1, 90_000, 400), strict=True)]
    counts = list({(a, b): (a, b, n) for a, b, n in counts}.values())
    want = {(a, b): n % 65536 for a, b, n in counts if a < 5000 and b < 5000 and n % 65536}
    got = {}
    for r in stack.count_tiles(spark.createDataFrame(counts, "c1 int, c2 int, n long"), []).collect():
        px = np.array(r.px).reshape(r.height, r.width)
        got |= {(r.left + int(x), r.top + int(y)): int(px[y, x]) for y, x in np.argwhere(px)}
    assert got == want
