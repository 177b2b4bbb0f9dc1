"""Token ids in files of fixed-width bit packing, written and read back.

A file holds the documents of one id range in ascending doc_id order. Each id takes the least number of bits that the
vocabulary needs; blocks of `block_ids` ids start on a byte, so each block is unpacked on its own with numpy, and any id is
found from its position alone.

Layout (little-endian): magic "TLPACK1\\0"; u32 bits; u32 ids in a block; u64 documents; u64 ids; doc_ids i64[documents];
ends u64[documents] (ids up to and with each document's last); u64 block offsets[blocks + 1], from the file's start; blocks.

Files are written into a folder that driver and executors share, under a name of their own, and then renamed: a task that
runs twice leaves one whole file. A range's next file begins when the one before it has `roll_bytes` of blocks, so what a task
holds is bounded by that and the longest text. Null or empty texts hold the end id alone. No documents: no files. doc_id is
taken to be unique and of any integer type; repeated ids are kept as rows of their own, in the order of their texts; rows
without one are left out. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import itertools
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe_automaton import byte_labels
from .common import cut, new_folder, slices, texts_of, with_range
from .presplit import UNKNOWN, PieceTable, classes, code_points, encode

MAGIC = b"TLPACK1\0"
HEAD = struct.Struct("<8sIIQQ")
#: Pieces of text repeat; a worker holds the ids of so many of them.
MOST_PIECES = 300_000
#: Bytes of blocks from which on a file is closed; tasks that read files.
ROLL_BYTES, MOST_TASKS = 32 << 20, 100_000


def bits_for(vocab_size: int) -> int:
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(planes.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (planes.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class PackWriter:
    """Takes documents one by one; holds packed blocks and one block of ids."""

    def __init__(self, bits: int, block_ids: int):
        self.bits, self.block_ids = bits, block_ids
        self.doc_ids: list[int] = []
        self.ends: list[int] = []
        self.sizes: list[int] = []
        self.blocks, self.rest, self.held, self.total = io.BytesIO(), [], 0, 0

    @property
    def packed(self) -> int:
        """Bytes of the blocks packed so far."""
        return self.blocks.tell()

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.total += len(ids)
        self.doc_ids.append(doc_id)
        self.ends.append(self.total)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= 16 * self.block_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        stop = len(ids) if last else len(ids) // self.block_ids * self.block_ids
        for a in range(0, stop, self.block_ids):
            self.sizes.append(self.blocks.write(pack(ids[a : min(stop, a + self.block_ids)], self.bits)))
        self.rest, self.held = [ids[stop:]], len(ids) - stop

    def save(self, fs: pafs.FileSystem, path: str) -> int:
        self._flush(True)
        n = len(self.doc_ids)
        first = HEAD.size + 16 * n + 8 * (len(self.sizes) + 1)
        offsets = first + np.concatenate([[0], np.cumsum(self.sizes, dtype=np.int64)])
        spare = f"{path}.{uuid.uuid4().hex}"
        with fs.open_output_stream(spare) as out:
            out.write(HEAD.pack(MAGIC, self.bits, self.block_ids, n, self.total))
            out.write(np.array(self.doc_ids, "<i8").tobytes() + np.array(self.ends, "<u8").tobytes() + offsets.astype("<u8").tobytes())
            out.write(self.blocks.getbuffer())
        fs.move(spare, path)
        return self.total


class PackReader:
    """Random access to one file: documents by their place in it, read block by block."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        magic, self.bits, self.block_ids, self.n_docs, self.n_ids = HEAD.unpack(self.file.read(HEAD.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        self.doc_ids = np.frombuffer(self.file.read(8 * self.n_docs), "<i8")
        self.ends = np.frombuffer(self.file.read(8 * self.n_docs), "<u8").astype(np.int64)
        self.offsets = np.frombuffer(self.file.read(8 * (-(-self.n_ids // self.block_ids) + 1)), "<u8").astype(np.int64)
        self._held: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint32))

    def block(self, i: int) -> np.ndarray:
        if self._held[0] != i:
            self.file.seek(int(self.offsets[i]))
            data = self.file.read(int(self.offsets[i + 1] - self.offsets[i]))
            self._held = i, unpack(data, min(self.block_ids, self.n_ids - i * self.block_ids), self.bits)
        return self._held[1]

    def ids(self, start: int, end: int) -> np.ndarray:
        parts = [self.block(i)[max(0, start - i * self.block_ids) : end - i * self.block_ids] for i in range(start // self.block_ids, -(-end // self.block_ids))]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def document(self, place: int) -> np.ndarray:
        return self.ids(int(self.ends[place - 1]) if place else 0, int(self.ends[place]))


class Encoder:
    """The tokenizers library over pieces that its byte-level pattern cuts (see presplit); each piece is encoded once while it
    is held. Texts with the string of a special token, or with characters that this Python's Unicode tables lack, go to the
    library whole, and so do all texts if the file asks for another way of splitting.
    """

    def __init__(self, file_text: str):
        self.library = Tokenizer.from_str(file_text)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        spec = json.loads(file_text)
        pre = spec["pre_tokenizer"] or {}
        self.by_piece = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and spec["model"]["type"] == "BPE"
        self.label, self.model = dict(enumerate(byte_labels())), self.library.model
        self.table = PieceTable(lambda pieces: [self._piece(p) for p in pieces], MOST_PIECES)

    @property
    def vocab_size(self) -> int:
        return self.library.get_vocab_size(with_added_tokens=True)

    def _piece(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.label))]

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        newer = [not t.isascii() and bool((classes()[code_points(t)] == UNKNOWN).any()) for t in texts]
        whole = [not self.by_piece or odd or any(s in t for s in self.special) for t, odd in zip(texts, newer, strict=True)]
        cut = iter(encode([t for t, w in zip(texts, whole, strict=True) if not w], True, self.table))
        rest = iter(self.library.encode_batch_fast([t for t, w in zip(texts, whole, strict=True) if w], add_special_tokens=False))
        return [np.array(next(rest).ids, "<i4") if w else next(cut) for w in whole]


_encoders: dict[str, Encoder] = {}


def _encoder(file_text: str) -> Encoder:
    key = hashlib.sha256(file_text.encode()).hexdigest()
    if key not in _encoders:
        _encoders[key] = Encoder(file_text)
    return _encoders[key]


def write_files(docs: DataFrame, tokenizer_file: str, folder: str, end_id: int | None = 0, block_ids: int = 4096, rows_per_file: int = 2048, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Encodes docs(doc_id, text) into files in folder (a URI that pyarrow opens); returns file, n_docs, n_ids, start, one row
    for each file. The driver holds one number for each id range, of which there are 65536 at most (see with_range)."""
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        encoder = _encoder(shared.value)
        tail = np.array([] if end_id is None else [end_id], "<i4")
        writer, now, part_no, done = None, None, 0, []

        def close() -> None:
            name = f"range-{now:06d}-{part_no:06d}.tlpack"
            done.append((f"{folder}/{name}", now, part_no, len(writer.doc_ids), writer.save(fs, f"{path}/{name}")))

        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                encoded = encoder.texts(texts_of(part.column("text")))
                for r, doc_id, data in zip(part.column("range_id").to_pylist(), part.column("doc_id").to_pylist(), encoded, strict=True):
                    if r != now or writer.packed >= roll_bytes:
                        if writer:
                            close()
                        part_no = part_no + 1 if r == now else 0
                        writer, now = PackWriter(bits_for(encoder.vocab_size), block_ids), r
                    writer.add(doc_id, np.concatenate([data, tail]))
        if writer:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else [[]] * 5, (pa.string(), *[pa.int64()] * 4), strict=True)], ["file", "range_id", "part", "n_docs", "n_ids"])

    ranged = with_range(docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", rows_per_file)
    dealt = ranged.repartition("range_id").sortWithinPartitions("range_id", "doc_id", "text")
    files = cut(dealt.mapInArrow(run, "file string, range_id long, part long, n_docs long, n_ids long"))
    ranges = sorted((r["range_id"], r["n"]) for r in files.groupBy("range_id").agg(F.sum("n_ids").alias("n")).collect())
    before = spark.createDataFrame(list(zip([r for r, _ in ranges], itertools.accumulate([n for _, n in ranges], initial=0), strict=False)), "range_id long, before long")
    within = F.coalesce(F.sum("n_ids").over(Window.partitionBy("range_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.join(F.broadcast(before), "range_id").select("file", "n_docs", "n_ids", (F.col("before") + within).alias("start"))


def read_documents(files: DataFrame) -> DataFrame:
    """doc_id, start, ids, read from files(file, start) with PackReader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                fs, path = pafs.FileSystem.from_uri(file)
                reader = PackReader(fs, path)
                place = 0
                while place < reader.n_docs:
                    base = int(reader.ends[place - 1]) if place else 0
                    stop = max(place + 1, int(np.searchsorted(reader.ends, base + (1 << 18), "right")))
                    ids = reader.ids(base, int(reader.ends[stop - 1]))
                    at = np.concatenate([[0], reader.ends[place:stop] - base])
                    lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array(reader.doc_ids[place:stop]), pa.array(start + base + at[:-1]), lists], ["doc_id", "start", "ids"])
                    place = stop

    return files.repartition(max(1, min(files.count(), MOST_TASKS)), "file").mapInArrow(run, "doc_id long, start long, ids array<int>")


def digest(read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what was read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("ids").flatten().to_numpy(zero_copy_only=False).astype("<u4")
            at = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(batch.column("ids")).to_numpy(zero_copy_only=False))])
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def pack_folder(spark) -> str:
    return new_folder(spark, "tokens")


