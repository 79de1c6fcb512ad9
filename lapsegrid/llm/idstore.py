"""Token-id files: each document compressed on its own with a shared zstandard dictionary.

A file holds a head (magic, file number, number of documents, SHA-256 of the dictionary,
bytes per id), one zstandard frame per document, and an index of document ids, token
counts and offsets, so that one short document is read without the others. Files are
written by Spark's text writer, one file image per row, through its commit protocol to
any file system; the newline it adds is the last byte of the format.

With the word tokenizer that SHAPE describes, words are encoded apart: it drops white space and
never joins across it, so a text's ids are those of its white-space separated words in turn. Whether
a file is of that shape is read from the file; any other tokenizer encodes whole texts.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapsegrid.llm.common import bounded_batches, columns, new_path, remove, staged

END_ID = 1
LEVEL = 3
#: The dictionary: its bytes, and about how many short documents it is trained on.
DICTIONARY_BYTES, DICTIONARY_DOCS, SHORT_BYTES = 32 << 10, 2000, 16 << 10
#: Bytes of a file (it ends with the document that reaches this), and of a partition, which writes many.
FILE_BYTES, PART_BYTES = 8 << 20, 2 << 30
#: What a tokenizer file says if its words can be encoded apart.
SHAPE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "truncation": None, "padding": None,
}
#: Stems that a worker remembers, in each of two generations, and the bytes of the longest.
CACHE_WORDS, CACHE_MARKS, LONG = 300_000, 1000, 100
#: Words of a text joined at once, and unseen stems encoded as one text.
RUN, TOGETHER = 1 << 18, 64
MAGIC = b"LGIDS01\n"
_HEAD = struct.Struct("<8sQQ32sB")
_FOOT = struct.Struct("<QI8s")
# White space of the tokenizer's regular expressions; Arrow splits there, and at U+001C to U+001F.
_SPACE = re.compile("[" + "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]+")
_NOT_SPACE = "[\x1c-\x1f]"
# A word of letters that normalisation only lower-cases, then perhaps marks: one pre-token each.
_LETTERS = "".join(map(chr, (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100))))
_MARKS = ".,;:!?*#&$%|"
_STEM = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"


def _strings(found: pa.Array) -> list[str]:
    return found.to_numpy(zero_copy_only=False).tolist()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """White-space separated words as the tokenizer sees them, and where each text's begin
    (one more for the end). Empty words may occur. Null is empty."""
    texts = texts.fill_null("")
    if pc.any(pc.match_substring_regex(texts, _NOT_SPACE)).as_py():
        lists = pa.array([_SPACE.split(t) for t in texts.to_pylist()], pa.list_(pa.string()))
    else:
        lists = pc.utf8_split_whitespace(texts)
    sizes = pc.list_value_length(lists).to_numpy()
    return lists.flatten(), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def apart(path: str) -> bool:
    """Whether the tokenizer in the file encodes white-space separated words apart: SHAPE, a BPE
    model whose words end in a mark of their own, and added tokens without white space in them."""
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    model = said["model"]
    plain = (model.get("type", "BPE"), model.get("end_of_word_suffix"), model.get("dropout"), model.get("byte_fallback", False)) == ("BPE", "</w>", None, False)
    added = all(not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in said["added_tokens"])
    return plain and added and all(said[k] == v for k, v in SHAPE.items())


class Encoder:
    """Ids of texts as little-endian bytes. A batch's distinct words are cut into stems and
    marks by Arrow; only distinct stems are looked up one by one. They are remembered in two
    generations: a stem met again moves to the young one, the old one is dropped when that is full."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.apart = apart(path)
        #: The same model for stems, which are normal already and hold one pre-token each.
        self.stems = Tokenizer.from_file(path)
        self.stems.normalizer = normalizers.Sequence([])
        self.stems.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True
        self.marks: dict[str, bytes] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, stems: list[str], others: list[str]) -> None:
        """Encode unseen lower-case stems and other words. Stems go many to a text, each ending
        with an id that closes a word, which tells them apart again."""
        groups = range(0, len(stems), TOGETHER)
        texts = [" ".join(stems[k : k + TOGETHER]) for k in groups]
        for k, e in zip(groups, self.stems.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            own, ids = stems[k : k + TOGETHER], np.array(e.ids, dtype=self.kind)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(own) == len(ends):
                raw, begin = ids.tobytes(), 0
                for w, end in zip(own, (ends * self.kind.itemsize).tolist(), strict=True):
                    self.young[w] = raw[begin:end]
                    begin = end
            else:  # not a vocabulary of closed words
                self.young.update({w: self._one(w) for w in own})
        for w, e in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False), strict=True):
            self.young[w] = np.array(e.ids, dtype=self.kind).tobytes()

    def _one(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def _look_up(self, keys: pa.Array) -> list[bytes]:
        """Ids of distinct stems and other words."""
        names, young, old = _strings(keys), self.young, self.old
        found = list(map(young.get, names))
        missing = [k for k, ids in enumerate(found) if ids is None]
        known = {names[k]: ids for k in missing if (ids := old.get(names[k])) is not None}
        young.update(known)
        unseen = keys.take(pa.array([k for k in missing if names[k] not in known], pa.int64()))
        stem = pc.match_substring_regex(unseen, _STEM)
        self.learn(_strings(unseen.filter(stem)), _strings(unseen.filter(pc.invert(stem))))
        for k in missing:
            found[k] = young[names[k]]
        for w in _strings(unseen.filter(pc.greater(pc.binary_length(unseen), LONG))):
            del young[w]
        if len(young) > CACHE_WORDS:
            self.old, self.young = young, {}
        return found

    def words(self, distinct: pa.Array) -> list[bytes]:
        """Ids of distinct words: those of the lower-cased stem, then those of its marks."""
        stems = pc.utf8_rtrim(distinct, _MARKS)
        plain = pc.match_substring_regex(stems, _STEM)
        keys = pc.if_else(plain, pc.utf8_lower(stems), distinct).dictionary_encode()
        out = list(map(self._look_up(keys.dictionary).__getitem__, keys.indices.to_numpy().tolist()))
        marked = pc.and_(plain, pc.greater(pc.binary_length(distinct), pc.binary_length(stems)))
        marks = pc.utf8_ltrim(distinct.filter(marked), _LETTERS).dictionary_encode()
        ids = []
        for m in _strings(marks.dictionary):
            if m not in self.marks:
                if len(self.marks) >= CACHE_MARKS:
                    self.marks.clear()
                self.marks[m] = self._one(m)
            ids.append(self.marks[m])
        for k, m in zip(np.flatnonzero(marked.to_numpy(zero_copy_only=False)).tolist(), marks.indices.to_numpy().tolist(), strict=True):
            out[k] += ids[m]
        return out

    def encode_all(self, texts: pa.Array, end: int = END_ID) -> list[bytes]:
        """Ids of whole texts with the end id, as bytes. Null is empty."""
        if not self.apart:
            found = self.tokenizer.encode_batch_fast(_strings(texts.fill_null("")), add_special_tokens=False)
            return [np.array([*e.ids, end], dtype=self.kind).tobytes() for e in found]
        collects = gc.isenabled()
        gc.disable()  # many lists, no cycles
        try:
            words, starts = split_words(texts)
            coded = words.dictionary_encode()
            ids, place = self.words(coded.dictionary), coded.indices.to_numpy()
            last = np.array([end], dtype=self.kind).tobytes()
            out = []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                runs = [b"".join(map(ids.__getitem__, place[k : min(k + RUN, b)].tolist())) for k in range(a, b, RUN)]
                out.append(b"".join([*runs, last]))
            return out
        finally:
            pa.default_memory_pool().release_unused()
            if collects:
                gc.enable()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# -- dictionary -----------------------------------------------------------
def train_dictionary(docs: DataFrame, tokenizer: str) -> bytes:
    """Train the shared dictionary on a bounded sample: about DICTIONARY_DOCS documents of
    up to SHORT_BYTES, picked and ordered by a hash. Few samples give their plain bytes."""
    many = max(1, docs.count() // DICTIONARY_DOCS)
    short = docs.where((F.pmod(F.xxhash64("doc_id"), F.lit(many)) == 0) & (F.octet_length("text") <= SHORT_BYTES))
    rows = short.select(F.xxhash64("doc_id", "text").alias("h"), "text").orderBy("h", "text").limit(2 * DICTIONARY_DOCS).collect()
    samples = encoder(tokenizer).encode_all(pa.array([r.text for r in rows], pa.string()))
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _dictionary(data: bytes):
    return zstandard.ZstdCompressionDict(data) if data else None


# -- writing --------------------------------------------------------------
def _encode(tokenizer: str, dictionary: bytes):
    def encode(batches):
        own = encoder(tokenizer)
        shared = _dictionary(dictionary)
        if shared:
            shared.precompute_compress(level=LEVEL)  # else each call digests it anew
        zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        for batch in batches:
            ids = own.encode_all(batch.column("text"))
            size = own.kind.itemsize
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id").cast(pa.int64()), "n_tokens": pa.array([len(x) // size for x in ids], pa.int64()),
                    "crc": pa.array([zlib.crc32(x) for x in ids], pa.int64()), "frame": pa.array([zstd.compress(x) for x in ids], pa.binary()),
                }
            )

    return encode


def file_image(number: int, rows: list[tuple], digest: bytes, width: int) -> bytes:
    """A file of (doc_id, n_tokens, frame) rows."""
    frames = [f for _, _, f in rows]
    known = np.array([d is not None for d, _, _ in rows], dtype=np.uint8)
    ids = np.array([d or 0 for d, _, _ in rows], dtype="<i8")
    tokens = np.array([n for _, n, _ in rows], dtype="<u8")
    ends = _HEAD.size + np.cumsum([len(f) for f in frames], dtype="<u8")
    index = known.tobytes() + ids.tobytes() + tokens.tobytes() + ends.astype("<u8").tobytes()
    body = _HEAD.pack(MAGIC, number, len(rows), digest, width) + b"".join(frames)
    return body + index + _FOOT.pack(len(body), zlib.crc32(index), MAGIC)


def _files(digest: bytes, width: int):
    def build(batches):
        number, rows, held = TaskContext.get().partitionId() << 24, [], 0
        for batch in batches:
            for row in columns(batch, "doc_id", "n_tokens", "frame"):
                rows.append(row)
                held += len(row[2])
                if held >= FILE_BYTES:
                    yield pa.record_batch({"image": pa.array([file_image(number, rows, digest, width)], pa.binary())})
                    number, rows, held = number + 1, [], 0
        if rows:
            yield pa.record_batch({"image": pa.array([file_image(number, rows, digest, width)], pa.binary())})

    return build


def write(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Write the id files of ``docs`` (integer doc_ids) under ``path``, documents in ascending doc_id
    order across files; ties by length and content, null ids first. A partition of the sort is as large
    as PART_BYTES on large inputs and writes file after file, so their number follows the cluster's work, not the files'."""
    spark = docs.sparkSession
    bounded_batches(spark)
    dictionary = train_dictionary(docs, tokenizer)
    digest, width = hashlib.sha256(dictionary).digest(), encoder(tokenizer).kind.itemsize
    as_text = F.col("image").cast("string")
    image = spark.createDataFrame([(bytearray(dictionary),)], "image binary")
    image.select(as_text).coalesce(1).write.text(f"{path}/dictionary")
    rows = staged(docs.select("doc_id", "text").mapInArrow(_encode(tokenizer, dictionary), "doc_id long, n_tokens long, crc long, frame binary"), "id-frames", "none")
    total = rows.agg(F.sum(F.octet_length("frame"))).first()[0] or 0
    order = ["doc_id", "n_tokens", "crc"]
    parts = min(-(-total // FILE_BYTES), max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES)))
    dealt = rows.repartitionByRange(max(1, parts), *order).sortWithinPartitions(*order)
    images = dealt.select("doc_id", "n_tokens", "frame").mapInArrow(_files(digest, width), "image binary")
    images.select(as_text).write.option("maxRecordsPerFile", 1).text(f"{path}/files")
    remove(rows)


# -- reading --------------------------------------------------------------
class IdFile:
    """Random access to the documents of a file image."""

    def __init__(self, data: bytes, dictionary: bytes):
        self.data = memoryview(data)
        magic, self.number, self.n, digest, width = _HEAD.unpack_from(data)
        at, crc, tail = _FOOT.unpack_from(data, len(data) - 1 - _FOOT.size)
        index = self.data[at : len(data) - 1 - _FOOT.size]
        if magic != MAGIC or tail != MAGIC or data[-1:] != b"\n" or zlib.crc32(index) != crc:
            raise ValueError("damaged id file")
        if hashlib.sha256(dictionary).digest() != digest:
            raise ValueError("another dictionary")
        n = self.n
        known, ids = np.frombuffer(index, np.uint8, n), np.frombuffer(index, "<i8", n, n)
        self.doc_ids = [int(d) if k else None for k, d in zip(known, ids, strict=True)]
        self.n_tokens, ends = np.frombuffer(index, "<u8", n, 9 * n).astype(np.int64), np.frombuffer(index, "<u8", n, 17 * n)
        self.bounds = [_HEAD.size, *ends.tolist()]
        self.kind = np.dtype(f"<u{width}")
        self.zstd = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def ids(self, k: int) -> np.ndarray:
        """Ids of document k; no other document is decompressed."""
        found = np.frombuffer(self.zstd.decompress(self.data[self.bounds[k] : self.bounds[k + 1]]), dtype=self.kind)
        if len(found) != self.n_tokens[k]:
            raise ValueError("damaged document")
        return found


def read_dictionary(spark: SparkSession, path: str) -> bytes:
    """The dictionary, at most DICTIONARY_BYTES (the newline after it is the writer's)."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/dictionary").select("content").collect()
    return bytes(next(r.content for r in rows if r.content))[:-1]


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents under ``path``: file, place, doc_id, local_start, n_tokens, ids_crc32."""
    bounded_batches(spark)
    dictionary = read_dictionary(spark, path)

    def parse(batches):
        for batch in batches:
            for (content,) in columns(batch, "content"):
                own = IdFile(content, dictionary)
                crc = [zlib.crc32(own.ids(k).astype("<u4").tobytes()) for k in range(own.n)]
                start = np.cumsum(own.n_tokens) - own.n_tokens
                yield pa.record_batch(
                    {
                        "file": pa.array(np.full(own.n, own.number, dtype=np.int64)), "place": pa.array(np.arange(own.n)), "doc_id": pa.array(own.doc_ids, pa.int64()),
                        "local_start": pa.array(start), "n_tokens": pa.array(own.n_tokens), "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/files").where("length > 0")
    return files.select("content").mapInArrow(parse, "file long, place long, doc_id long, local_start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the id files of ``docs`` and read them back: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts hold the end id alone. Repeated rows and null ids are documents
    like any other; texts of any length are one document. Other columns are ignored; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    path = new_path(spark, "ids")
    write(docs, path, tokenizer)
    rows = staged(read(spark, path), "id-rows").withColumn("part", F.shiftrightunsigned("file", 24))
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row per partition written
    sums = np.cumsum([0, *(r.n for r in parts)]).tolist()
    offsets = spark.createDataFrame([(r.part, n) for r, n in zip(parts, sums, strict=False)], "part long, ahead long")
    before = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = rows.groupBy("part", "file").agg(F.sum("n_tokens").alias("n")).select("part", "file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    begins = files.join(F.broadcast(offsets), "part").select("file", (F.col("before") + F.col("ahead")).alias("begin"))
    return rows.join(begins, "file").select("doc_id", (F.col("begin") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
