"""Token ids in binary files, as a Spark data source named `token_files`.

    spark.dataSource.register(TokenFiles)
    encoded.write.format("token_files").mode("append").save(path)   # columns doc_id long, ids binary; in their order
    spark.read.format("token_files").load(path)                     # doc_id, start, n_tokens, ids

Each task writes one file: a header, the ids of its documents one after the other in blocks of Simple-8b words
(see simple8b), and an index: where each block's words and escapes begin, and each document's id and length. The
trailer has the sizes of these parts. Files get names of their own for each attempt, and only the driver's commit
lists them, in the order of partitions, in `manifest.json`; what lost tasks leave isn't listed and never read. The
manifest also has the number of ids in all files before, so that a document's start needs no other file.

A reading task takes one file and decodes only a bounded run of blocks at a time. Files are reached through
pyarrow's file systems (local and shared folders, hdfs, s3, gs).
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from storyloom.llm import simple8b
from storyloom.llm._common import quoted, rows
from storyloom.llm.byte_units import encoder

MAGIC = b"IDS8B\x00\x00\x01"
MANIFEST = "manifest.json"
SCHEMA = "doc_id long, start long, n_tokens long, ids binary"
_INPUT = "doc_id long, ids binary"
#: Sizes of the parts and the crc32 of the words, then MAGIC again.
_TRAILER = struct.Struct("<6Q8s")
#: Ids coded, or decoded, at once: a whole number of blocks.
RUN = 512 * simple8b.BLOCK


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:") and not path.startswith("file://"):
        path = f"file://{path.removeprefix('file:')}"
    return fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    partition: int
    name: str
    ids: int
    docs: int


class FileWriter:
    """One file, written from the front; only the index waits for the end."""

    def __init__(self, out) -> None:
        self.out, self.held, self.pending = out, [], 0
        self.n, self.words, self.crc = 0, 0, 0
        self.word_offsets, self.escape_offsets, self.escapes = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], []
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        out.write(MAGIC + struct.pack("<Q", simple8b.BLOCK))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        for at in range(0, len(ids), 4 * RUN):
            self.held.append(ids[at : at + 4 * RUN])
            self.pending += len(self.held[-1]) // 4
            if self.pending >= RUN:
                self._flush(RUN)

    def _flush(self, most: int) -> None:
        joined = np.frombuffer(b"".join(self.held), "<u4")
        now, rest = joined[:most], joined[most:]
        self.held, self.pending = [rest.tobytes()], len(rest)
        coded = simple8b.encode(now.astype(np.uint64))
        data = coded.words.astype("<u8").tobytes()
        self.out.write(data)
        self.crc = zlib.crc32(data, self.crc)
        self.word_offsets.append(self.words + coded.word_offsets[1:])
        self.escape_offsets.append(sum(map(len, self.escapes)) + coded.escape_offsets[1:])
        self.escapes.append(coded.escapes)
        self.n += len(now)
        self.words += len(coded.words)

    def close(self) -> None:
        while self.pending:
            self._flush(RUN)
        escapes = np.concatenate([np.zeros(0, np.uint64), *self.escapes])
        nulls = np.packbits(np.array([d is None for d in self.doc_ids], bool))
        parts = [escapes, np.concatenate(self.word_offsets), np.concatenate(self.escape_offsets), np.array([d or 0 for d in self.doc_ids], np.int64), np.array(self.lengths, np.int64)]
        for part in parts:
            self.out.write(part.astype(part.dtype.newbyteorder("<")).tobytes())
        self.out.write(nulls.tobytes())
        self.out.write(_TRAILER.pack(self.n, self.words, len(escapes), len(parts[1]) - 1, len(self.lengths), self.crc, MAGIC))


class FileReader:
    """One file's index, and its ids from any place on."""

    def __init__(self, file) -> None:
        self.file = file
        size = file.seek(0, 2)
        head = len(MAGIC) + 8
        if size < head + _TRAILER.size:
            raise ValueError("not a file of token ids")
        file.seek(0)
        begin = file.read(head)
        file.seek(size - _TRAILER.size)
        self.n, self.words, n_escapes, blocks, docs, self.crc, magic = _TRAILER.unpack(file.read(_TRAILER.size))
        if begin != MAGIC + struct.pack("<Q", simple8b.BLOCK) or magic != MAGIC or size != head + 8 * (self.words + n_escapes + 2 * (blocks + 1) + 2 * docs) + -(-docs // 8) + _TRAILER.size:
            raise ValueError("a broken file of token ids")
        self.head = head
        file.seek(head + 8 * self.words)
        read = lambda kind, count: np.frombuffer(file.read(8 * count), kind)
        self.escapes, self.word_offsets, self.escape_offsets = read("<u8", n_escapes), read("<i8", blocks + 1), read("<i8", blocks + 1)
        self.doc_ids, self.lengths = read("<i8", docs), read("<i8", docs)
        self.nulls = np.unpackbits(np.frombuffer(file.read(-(-docs // 8)), np.uint8))[:docs].astype(bool)

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids from start to end; only the blocks that hold them are read."""
        if start >= end:
            return np.zeros(0, "<u4")
        first, last = start // simple8b.BLOCK, -(-end // simple8b.BLOCK)
        words, escapes = self.word_offsets[first : last + 1], self.escape_offsets[first : last + 1]
        self.file.seek(self.head + 8 * int(words[0]))
        held = np.frombuffer(self.file.read(8 * int(words[-1] - words[0])), "<u8")
        base = first * simple8b.BLOCK
        coded = simple8b.Coded(min(self.n, last * simple8b.BLOCK) - base, held, self.escapes[escapes[0] : escapes[-1]], words, escapes)
        return simple8b.decode(coded)[start - base : end - base].astype("<u4")

    def documents(self) -> Iterator[tuple[slice, np.ndarray, list[bytes]]]:
        """Runs of documents of about RUN ids (one at least): which ones, where each starts in the file, and their ids."""
        ends = np.cumsum(self.lengths)
        at = 0
        while at < len(ends):
            start = int(ends[at - 1]) if at else 0
            until = max(at + 1, int(np.searchsorted(ends, start + RUN, "right")))
            until = min(until, at + 10_000)
            ids = self.ids(start, int(ends[until - 1])).tobytes()
            starts = ends[at:until] - self.lengths[at:until]
            yield slice(at, until), starts, [ids[4 * (a - start) : 4 * (b - start)] for a, b in zip(starts.tolist(), ends[at:until].tolist())]
            at = until


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = _place(self.path)
        store.create_dir(folder, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.ids"
        with store.open_output_stream(f"{folder}/{name}") as out:
            file = FileWriter(out)
            for batch in iterator:
                for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                    file.add(doc_id, ids.as_py() or b"")
            file.close()
        return Written(part, name, file.n, len(file.lengths))

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _place(self.path)
        store.create_dir(folder, recursive=True)
        manifest = f"{folder}/{MANIFEST}"
        there = store.get_file_info(manifest).type == fs.FileType.File
        if there and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"{self.path} has token files already; their order is fixed, so they can only be overwritten")
        old = _manifest(store, folder)["files"] if there else []
        files, start = [], 0
        for m in sorted((m for m in messages if m), key=lambda m: m.partition):
            if m.docs:
                files.append({"name": m.name, "start": start, "ids": m.ids, "docs": m.docs})
                start += m.ids
        with store.open_output_stream(manifest) as out:
            out.write(json.dumps({"block": simple8b.BLOCK, "ids": start, "files": files}).encode())
        for name in [f["name"] for f in old] + [m.name for m in messages if m and not m.docs]:
            store.delete_file(f"{folder}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = _place(self.path)
        for m in messages:
            if m and store.get_file_info(f"{folder}/{m.name}").type == fs.FileType.File:
                store.delete_file(f"{folder}/{m.name}")


def _manifest(store: fs.FileSystem, folder: str) -> dict:
    with store.open_input_file(f"{folder}/{MANIFEST}") as file:
        return json.loads(file.read())


class _Part(InputPartition):
    def __init__(self, name: str, start: int) -> None:
        self.name, self.start = name, start


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        files = _manifest(*_place(self.path))["files"]
        return [_Part(f["name"], f["start"]) for f in files] or [_Part("", 0)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        store, folder = _place(self.path)
        with store.open_input_file(f"{folder}/{partition.name}") as opened:
            file = FileReader(opened)
            for which, starts, ids in file.documents():
                doc_ids = pa.array(file.doc_ids[which], pa.int64(), mask=file.nulls[which])
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(starts + partition.start, pa.int64()), pa.array(file.lengths[which], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])


class TokenFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        if [f.dataType.simpleString() for f in schema] != ["bigint", "binary"]:
            raise ValueError(f"token files are written from the columns {_INPUT}")
        return _Writer(self.options["path"], overwrite)

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"])


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): each document's ids and the end id, as little-endian unsigned 32-bit numbers, in ascending order.

    Null ids come first; rows of one id are in the order of their texts' hashes; repeated rows are encoded each. A null
    text is empty: the end id alone. Texts are read whole. Further columns, whatever their names, are not looked at.
    Partitions are ranges of ids, cut further by text and row, so that even a row repeated very often is dealt out.
    """
    given = docs.select(quoted(docs, doc_id).cast("long").alias("doc_id"), quoted(docs, text).alias("text"))
    keyed = given.withColumns({"print": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange("doc_id", "print", "row").sortWithinPartitions("doc_id", "print", "row").select("doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer)
        for batch in rows(batches, 1000, 1):
            ids = [known.encode(t).astype("<u4").tobytes() + end for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return ordered.mapInArrow(run, _INPUT)


def write_documents(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes docs as token files under path, and returns what reading these gives: (doc_id, start, n_tokens, ids).

    start counts the ids of all documents before. Documents are as encode_documents() has them; none give a
    manifest without files. path must be empty or new, and in a store that the driver and all executors reach.
    """
    spark = docs.sparkSession
    spark.dataSource.register(TokenFiles)
    encode_documents(docs, tokenizer, end_id, doc_id, text).write.format("token_files").mode("append").save(path)
    return spark.read.format("token_files").load(path)
