"""Token ids in files of zstd-compressed planes, with a chunk index.

A store is a folder with one `.planes` file per range of documents and the table `manifest`. A file holds:

    magic, chunks, index, [offset of the index, its length: 2 x uint64], magic

A chunk is a block of `block` ids (the last one of a file is shorter) as unsigned 32-bit numbers, transposed into planes:
the four byte planes, or the 32 bit planes, each compressed on its own. The index (compressed JSON) has the offset, the
number of ids and the plane lengths of each chunk, and the id and number of tokens of each document.
"""

from __future__ import annotations

import json
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.llm.common import small_batches

MAGIC, TAIL = b"KLPLANE1", struct.Struct("<QQ8s")
BLOCK, LEVEL, END_ID = 1 << 16, 3, 2
#: Two white spaces in a row, or the sign that cuts words here: such texts are encoded in one go.
_ODD_SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]{2}|\x1F"
_CUT = "\x1f"
#: Words whose parts are found here: a blank, then Latin letters, digits and signs, with white space between them at most.
_LATIN = r"[!-~\x{A1}-\x{AC}\x{AE}-\x{24F}]"
_PLAIN_WORD = rf"^ {_LATIN}([\n\t]?{_LATIN})*$"
#: The pattern by which byte-level tokenizers split texts (a fixed value).
_PARTS = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Bytes of texts encoded at once, strings given to the library at once, and bytes of words that an encoder remembers.
_AT_ONCE, _BATCH, _REMEMBER = 20 << 20, 5000, 40 << 20
_IDS = pa.list_(pa.uint32())


def _byte_signs() -> np.ndarray:
    """The sign that byte-level vocabularies have for each byte: itself if it is printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in shown]
    signs = np.arange(256, dtype="<u2")
    signs[others] = 256 + np.arange(len(others))
    return signs


def _strings(column: pa.Array, signs: np.ndarray | None = None) -> list[str]:
    """The strings of a column; with signs, those of their UTF-8 bytes."""
    if not len(column):
        return []
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    octets = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = (ends - ends[0]).tolist()
    if signs is None:
        octets = octets.tobytes()
        return [octets[a:b].decode() for a, b in pairwise(ends)]
    mapped = signs[octets].tobytes().decode("utf-16-le")
    return [mapped[a:b] for a, b in pairwise(ends)]


class Encoder:
    """Whole texts to ids with the tokenizers library.

    A byte-level tokenizer that splits before each blank encodes the words of a text on their own: the words of many texts
    are cut and numbered as one column, the distinct ones that are not remembered are encoded, and the ids are taken by
    number. Plain words are cut into the parts of the tokenizer's pattern here, and the library's model merges each
    distinct part; all others take the library's whole way. What is remembered is two Arrow columns of at most `_REMEMBER`
    bytes; beyond that, words that have not been met again go. A text with two white spaces in a row, and any other
    tokenizer, is encoded in one go.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            about = json.load(f)
        kind, model, added = about.get("pre_tokenizer") or {}, about["model"], about.get("added_tokens", [])
        self.by_word = kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space") and kind.get("use_regex", True) and not about.get("normalizer") and not any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added)
        self.by_part = self.by_word and model.get("type") == "BPE" and not model.get("dropout")
        self.added = "|".join("\\Q" + t["content"].replace("\\E", "") + "\\E" for t in added)
        self.words, self.ids, self.again = pa.array([], pa.string()), pa.array([], _IDS), np.zeros(0, np.bool_)
        self.signs = _byte_signs()

    def _encode(self, texts: list[str]) -> pa.ListArray:
        values, ends = array("I"), [0]
        for at in range(0, len(texts), _BATCH):
            for e in self.tokenizer.encode_batch_fast(texts[at : at + _BATCH], add_special_tokens=False):
                values.extend(e.ids)
                ends.append(len(values))
        return _lists(values, ends)

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text, of strings without nulls."""
        odd = _matches(texts, _ODD_SPACE) if self.by_word else np.ones(len(texts), np.bool_)
        whole = self._encode(texts.filter(pa.array(odd)).to_pylist())
        if odd.all():
            return whole
        cut = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(~odd)), " ", f"{_CUT} "), _CUT)
        words = self._word_ids(cut.flatten())
        ends = words.offsets.to_numpy()[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        return _merged(odd, whole, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.values))

    def _word_ids(self, words: pa.Array) -> pa.ListArray:
        coded = words.dictionary_encode()
        distinct, number = coded.dictionary, coded.indices
        at = pc.index_in(distinct, value_set=self.words)
        new = distinct.filter(at.is_null())
        ids = self._new_ids(new)
        place = at.fill_null(-1).to_numpy().astype(np.int64)
        self.again[place[place >= 0]] = True
        place[place < 0] = len(self.words) + np.arange(len(new))
        self.words, self.ids = pa.concat_arrays([self.words, new]), pa.concat_arrays([self.ids, ids])
        self.again = np.r_[self.again, np.zeros(len(new), np.bool_)]
        own = self.ids.take(pa.array(place)).take(number)
        if self.words.nbytes + self.ids.nbytes > _REMEMBER:
            self._forget()
        return own

    def _forget(self) -> None:
        """Keeps the words that were met again, or none if these are too many."""
        kept = pa.array(self.again)
        self.words, self.ids = self.words.filter(kept), self.ids.filter(kept)
        if self.words.nbytes + self.ids.nbytes > _REMEMBER // 2:
            self.words, self.ids = self.words[:0], self.ids[:0]
        self.again = np.zeros(len(self.words), np.bool_)

    def _new_ids(self, words: pa.Array) -> pa.ListArray:
        plain = _matches(words, _PLAIN_WORD) if self.by_part else np.zeros(len(words), np.bool_)
        if self.added and plain.any():
            plain &= ~_matches(words, self.added)
        whole = self._encode(_strings(words.filter(pa.array(~plain))))
        if not plain.any():
            return whole
        parts = pa.array(_PARTS.findall("".join(_strings(words.filter(pa.array(plain))))))
        heads = np.flatnonzero(pc.starts_with(parts, " ").to_numpy(zero_copy_only=False))  # a word's only blank is its first sign
        coded = parts.dictionary_encode()
        values, ends = array("I"), [0]
        for tokens in map(self.tokenizer.model.tokenize, _strings(coded.dictionary, self.signs)):
            values.extend([t.id for t in tokens])
            ends.append(len(values))
        ids = _lists(values, ends).take(coded.indices)
        ends = ids.offsets.to_numpy()[np.r_[heads, len(parts)]]
        return _merged(~plain, whole, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids.values))


def _matches(column: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(column, pattern).to_numpy(zero_copy_only=False)


def _lists(values: array, ends: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(values, np.uint32) if values else [], pa.uint32()))


def _merged(first: np.ndarray, a: pa.ListArray, b: pa.ListArray) -> pa.ListArray:
    """The rows of a where `first` says so, else those of b, each in their order."""
    if not len(a):
        return b
    order = np.empty(len(first), np.int64)
    order[first], order[~first] = np.arange(len(a)), len(a) + np.arange(len(b))
    return pa.concat_arrays([a, b]).take(pa.array(order))


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder of this process, so that tasks that a worker runs in turn share what it remembers."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(octets[:, k]).tobytes() for k in range(4)]
    return [np.packbits(row).tobytes() for row in np.ascontiguousarray(np.unpackbits(octets, axis=1, bitorder="little").T)]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    if not bits:
        octets = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        rows = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes])
        octets = np.packbits(rows.T, axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view("<u4").ravel()


class FileWriter:
    def __init__(self, out, block: int, bits: bool, level: int):
        self.out, self.block, self.bits = out, block, bits
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.parts: list[np.ndarray] = []
        self.held = self.total = 0
        self.chunks: list[list] = []
        self.doc_ids: list[int | None] = []
        self.tokens: list[int] = []
        self.at = out.write(MAGIC)

    def add(self, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> None:
        """The ids of some documents, one after the other, and their numbers."""
        self.doc_ids += doc_ids
        self.tokens += counts.tolist()
        self.parts.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.block:
            ids = np.concatenate(self.parts)
            whole = len(ids) // self.block * self.block
            for k in range(0, whole, self.block):
                self._chunk(ids[k : k + self.block])
            self.parts, self.held = [ids[whole:].copy()], len(ids) - whole

    def _chunk(self, ids: np.ndarray) -> None:
        planes = [self.zstd.compress(p) for p in to_planes(ids, self.bits)]
        self.chunks.append([self.at, len(ids), [len(p) for p in planes]])
        for p in planes:
            self.at += self.out.write(p)

    def close(self) -> int:
        if self.held:
            self._chunk(np.concatenate(self.parts))
        index = self.zstd.compress(json.dumps({"bits": self.bits, "chunks": self.chunks, "doc_ids": self.doc_ids, "tokens": self.tokens}).encode())
        self.out.write(index)
        self.out.write(TAIL.pack(self.at, len(index), MAGIC))
        self.out.close()
        return self.at + len(index) + TAIL.size


def read_index(file, size: int) -> dict:
    file.seek(size - TAIL.size)
    at, length, magic = TAIL.unpack(file.read(TAIL.size))
    if magic != MAGIC:
        raise ValueError("not a file of planes, or one cut short")
    file.seek(at)
    return json.loads(zstandard.ZstdDecompressor().decompress(file.read(length)))


def read_chunk(file, index: dict, k: int) -> np.ndarray:
    """The ids of one chunk: the index makes any chunk readable on its own."""
    at, n, lengths = index["chunks"][k]
    file.seek(at)
    data, ends = file.read(sum(lengths)), np.cumsum(lengths).tolist()
    unpack = zstandard.ZstdDecompressor().decompress
    return from_planes([unpack(data[e - length : e]) for e, length in zip(ends, lengths, strict=True)], n, index["bits"])


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _by_bytes(batches: Iterator[pa.RecordBatch], most: int = _AT_ONCE) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts of the batches, dealt anew: so many bytes of text at once, or a single text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = min(batch.num_rows, max(at + (not held), int(np.searchsorted(ends, before + most - size, "right"))))
            if to > at:
                held.append(batch.slice(at, to - at))
                size += int(ends[to - 1]) - before
                at = to
            if at < batch.num_rows:
                whole = pa.Table.from_batches(held).combine_chunks()
                yield whole.column(0).chunk(0), whole.column(1).chunk(0)
                held, size = [], 0
    if held:
        whole = pa.Table.from_batches(held).combine_chunks()
        yield whole.column(0).chunk(0), whole.column(1).chunk(0)


def write_tokens(docs: DataFrame, uri: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, block: int = BLOCK, bits: bool = False, level: int = LEVEL) -> DataFrame:
    """Encodes whole texts and writes their ids in ascending order of the id (bigint); returns the manifest.

    uri: a folder that all executors reach and pyarrow opens. Texts are dealt once, by ranges of (id, hash of the text),
    so that one id with very many rows is dealt out too. A null text counts as empty; an empty text has only end_id; null
    ids come first; rows with equal ids are ordered by the hash of their text, and repeated rows each stay. Other columns
    are not read. Each task attempt writes a file of its own name, and the manifest names those of the attempts that
    succeeded, so a lost executor leaves at most unused files. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, writer = TaskContext.get(), None
        for ids, texts in _by_bytes(batches):
            if writer is None:
                encoder = encoder_of(tokenizer_path)
                files, root = _open(uri)
                files.create_dir(root, recursive=True)
                name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.planes"
                writer = FileWriter(files.open_output_stream(f"{root}/{name}"), block, bits, level)
            coded = encoder.encode(texts)
            ends = coded.offsets.to_numpy()
            flat = np.insert(coded.values.to_numpy()[: ends[-1]], ends[1:], end_id)
            writer.add(ids.to_pylist(), np.diff(ends).astype(np.int64) + 1, flat)
        if writer is not None:
            size = writer.close()
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_arrays([pa.array([context.partitionId()], pa.int32()), pa.array([name]), pa.array([size], pa.int64()), pa.array([len(writer.tokens)], pa.int64()), pa.array([writer.total], pa.int64())], ["part", "file", "bytes", "n_docs", "n_ids"])

    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    dealt = keyed.repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "text")
    parts = dealt.mapInArrow(run, "part int, file string, bytes bigint, n_docs bigint, n_ids bigint")
    with small_batches(spark):
        parts.write.mode("overwrite").parquet(f"{uri}/manifest")
    return manifest(spark, uri)


def manifest(spark: SparkSession, uri: str) -> DataFrame:
    """One row per file, with the number of ids in the files before it. Its window is over files, not documents."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.parquet(f"{uri}/manifest").withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def read_tokens(spark: SparkSession, uri: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids of each document, read back from the files."""
    files = manifest(spark, uri)
    n = max(1, min(20_000, spark.read.parquet(f"{uri}/manifest").count()))
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size, start in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                store, root = _open(uri)
                with store.open_input_file(f"{root}/{name}") as file:
                    yield from _documents(file, size, start, with_ids)

    return files.select("file", "bytes", "start").repartition(n).mapInArrow(run, schema)


def _documents(file, size: int, start: int, with_ids: bool, rows: int = 2000, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    index = read_index(file, size)
    held, chunk, out, kept = np.empty(0, np.uint32), 0, [], 0

    def batch() -> pa.RecordBatch:
        columns = [pa.array(c, pa.int64()) for c in list(zip(*out, strict=True))[:4]]
        if with_ids:
            columns.append(pa.array([r[4] for r in out], pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    for doc, n in zip(index["doc_ids"], index["tokens"], strict=True):
        crc, parts, need = 0, [], n
        while need:
            if not len(held):
                held = read_chunk(file, index, chunk)
                chunk += 1
            piece, held = held[:need], held[need:]
            crc, need = zlib.crc32(piece.tobytes(), crc), need - len(piece)
            if with_ids:
                parts.append(piece)
        out.append((doc, start, n, crc, np.concatenate(parts).astype(np.int64) if parts else []))
        start, kept = start + n, kept + n * with_ids
        if len(out) >= rows or kept >= most:
            yield batch()
            out, kept = [], 0
    if out:
        yield batch()
