"""Token ids in files of independent zstandard frames with a trailing seek table.

A file is a run of zstandard frames, then two skippable frames, so any
zstandard tool can decompress it whole. Each frame holds whole documents and is
compressed by itself:

    u32 number of documents, u32 bytes per id (2 or 4)
    i64 doc_id of each, u8 1 if that doc_id is null, u64 number of ids of each
    the ids, little-endian

The first skippable frame is the directory: for each frame its first and last
doc_id, documents and ids. The last one is the seek table of the public
seekable format: compressed size, decompressed size and the low 32 bits of the
XXH64 of the content of each frame, then the number of frames, a descriptor
byte and a magic number. A reader reads the two tables from the end, and then
only the frames that hold the documents asked for; each is checked.

Files are written in ascending order of doc_id (nulls first) by tasks that own
a range of ids each. A file gets its name when it is complete, and a task that
is run again writes the same names.
"""

from __future__ import annotations

import os
import struct
import uuid
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import islice
from typing import BinaryIO, NamedTuple
from urllib.parse import unquote, urlsplit
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thermoband.llm.common import slices, tokenizer_file, word_encoder
from thermoband.session import durable, remove_folder, shared_dir

END = 2
FRAME_BYTES = 1 << 18
#: Size at which a file is closed; a task never holds more than a frame of it.
FILE_BYTES = 1 << 28
#: Documents read between two batches of rows.
READ_ROWS = 4096
LEVEL = 3
#: Of the public seekable format (fixed values).
SEEKABLE, SKIPPABLE, DIRECTORY, CHECKSUMS = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50, 0x80
LOWEST = -(1 << 63)


class Document(NamedTuple):
    doc_id: int | None
    ids: np.ndarray


class FrameWriter:
    """One file, written to `out` frame by frame; of the documents it holds one frame at a time."""

    def __init__(self, width: int, out: BinaryIO) -> None:
        self.width, self.out, self.size = width, out, 0
        self.seek: list[tuple[int, int, int]] = []
        self.directory: list[tuple[int, int, int, int]] = []
        self.held: list[Document] = []
        self.held_bytes = 0
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.held.append(Document(doc_id, ids))
        self.held_bytes += len(ids) * self.width
        if self.held_bytes >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        names = [LOWEST if d.doc_id is None else d.doc_id for d in self.held]
        sizes = [len(d.ids) for d in self.held]
        content = b"".join((
            struct.pack("<II", len(names), self.width),
            np.array(names, "<i8").tobytes(),
            bytes(d.doc_id is None for d in self.held),
            np.array(sizes, "<u8").tobytes(),
            np.concatenate([d.ids for d in self.held]).astype(f"<u{self.width}").tobytes(),
        ))
        frame = self.compressor.compress(content)
        self.out.write(frame)
        self.size += len(frame)
        self.seek.append((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.directory.append((names[0], names[-1], len(names), sum(sizes)))
        self.held, self.held_bytes = [], 0

    def finish(self) -> None:
        self.flush()
        directory = b"".join(struct.pack("<qqIQ", *x) for x in self.directory)
        self.out.write(struct.pack("<II", DIRECTORY, len(directory)) + directory)
        table = b"".join(struct.pack("<III", *x) for x in self.seek) + struct.pack("<IBI", len(self.seek), CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class FrameReader:
    """Documents of one file, from any seekable source; reads the tables first, then only the frames needed."""

    def __init__(self, source: BinaryIO) -> None:
        self.source = source
        end = source.seek(0, os.SEEK_END)
        frames, descriptor, magic = struct.unpack("<IBI", self._read(end - 9, 9))
        if magic != SEEKABLE or descriptor != CHECKSUMS:
            raise ValueError("no seek table at the end of the file")
        table = end - 9 - 12 * frames
        self.seek = list(struct.iter_unpack("<III", self._read(table, 12 * frames)))
        size = struct.calcsize("<qqIQ") * frames
        self.directory = list(struct.iter_unpack("<qqIQ", self._read(table - 8 - size, size)))
        self.starts = np.concatenate([[0], np.cumsum([x[0] for x in self.seek], dtype=np.int64)])

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def frame(self, k: int) -> Iterator[Document]:
        packed, size, check = self.seek[k]
        content = zstandard.ZstdDecompressor().decompress(self._read(int(self.starts[k]), packed), max_output_size=size)
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        n, width = struct.unpack_from("<II", content)
        names = np.frombuffer(content, "<i8", n, 8)
        nulls = np.frombuffer(content, "u1", n, 8 + 8 * n)
        ends = np.cumsum(np.frombuffer(content, "<u8", n, 8 + 9 * n), dtype=np.int64)
        ids = np.frombuffer(content, f"<u{width}", -1, 8 + 17 * n)
        for name, null, start, end in zip(names, nulls, [0, *ends[:-1]], ends, strict=True):
            yield Document(None if null else int(name), ids[start:end].astype("<u4"))

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[Document]:
        """All documents, or those with an id in `wanted`."""
        if wanted is None:
            for k in range(len(self.seek)):
                yield from self.frame(k)
            return
        names = sorted(set(wanted))
        for k, (first, last, _, _) in enumerate(self.directory):
            at = bisect_left(names, first)
            if at < len(names) and names[at] <= last:
                here = set(names)
                yield from (d for d in self.frame(k) if d.doc_id in here)


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store that a path lies in, and the path there."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return pyarrow.fs.LocalFileSystem(), unquote(parts.path)
    return pyarrow.fs.FileSystem.from_uri(path)


class NewFile:
    """A file below `folder` that gets its name when it is complete. A task that is run again replaces what it has written before."""

    def __init__(self, folder: str, name: str) -> None:
        self.store, root = _store(folder)
        self.store.create_dir(root, recursive=True)
        self.begun, self.name = f"{root}/.{name}.{uuid.uuid4().hex}", f"{root}/{name}"
        self.out = self.store.open_output_stream(self.begun)

    def done(self) -> None:
        self.out.close()
        if self.store.get_file_info(self.name).type != pyarrow.fs.FileType.NotFound:
            self.store.delete_file(self.name)  # of a lost attempt, with the same content
        self.store.move(self.begun, self.name)


def write_frames(
    docs: DataFrame, folder: str, tokenizer: str = "word_bpe_49k.json", end: int = END, file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Write the ids of all documents, each with `end`, below `folder`; one row per file: file, n_docs, n_ids.

    A null text counts as empty. Rows with equal ids are kept each; a null
    doc_id sorts first. Other columns are not read. An empty table writes no
    files. The files are written when this returns.
    """
    spark = docs.sparkSession
    file = tokenizer_file(spark, tokenizer)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(file.value)
        width = 2 if max(encode.library.get_vocab_size(), end + 1) <= 1 << 16 else 4
        last = np.array([end], "<u4")
        part, number = TaskContext.get().partitionId(), 0
        manifest, file_, writer = [], None, None

        def done() -> None:
            nonlocal number, writer
            if writer:
                writer.finish()
                file_.done()
                manifest.append((name_of(number), sum(x[2] for x in writer.directory), sum(x[3] for x in writer.directory)))
                number, writer = number + 1, None

        def name_of(number: int) -> str:
            return f"ids-{part:08d}-{number:06d}.zst"

        for rows in slices(batches):
            for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                if writer is None:
                    file_ = NewFile(folder, name_of(number))
                    writer = FrameWriter(width, file_.out)
                writer.add(doc_id, np.concatenate([np.frombuffer(encode(text), "<u4"), last]))
                if writer.size >= file_bytes:
                    done()
        done()
        names, n_docs, n_ids = zip(*manifest, strict=True) if manifest else ([], [], [])
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(n_docs, pa.int64()), pa.array(n_ids, pa.int64())], ["file", "n_docs", "n_ids"]
        )

    ranged = (
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("copy")
        )
        .repartitionByRange("doc_id", "tie", "copy")
        .sortWithinPartitions("doc_id", "tie", "copy")
        .select("doc_id", "text")
    )
    return durable(ranged.mapInArrow(write, "file string, n_docs bigint, n_ids bigint"))


def _read_file(name: str, reader: FrameReader, wanted: list[int] | None) -> Iterator[pa.RecordBatch]:
    """The rows of a file, some thousand at a time."""
    place, total = 0, 0
    documents = ((d.doc_id, len(d.ids), crc32(d.ids.tobytes())) for d in reader.documents(wanted))
    while some := list(islice(documents, READ_ROWS)):
        names, sizes, checks = zip(*some, strict=True)
        before = np.cumsum([total, *sizes])
        known = before[:-1].tolist() if wanted is None else [None] * len(some)
        columns = range(place, place + len(some)), names, known, sizes, checks
        place, total = place + len(some), int(before[-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(some), pa.string()), *(pa.array(x, pa.int64()) for x in columns)],
            ["file", "place", "doc_id", "before", "n_tokens", "ids_crc32"],
        )


def read_frames(spark: SparkSession, folder: str, wanted: list[int] | None = None) -> DataFrame:
    """One row per document of the files below `folder`: file, place (in its file), doc_id, before (ids before it
    in its file), n_tokens, ids_crc32. The tasks open the files and read their tables and then one frame after the
    other; with `wanted` only the frames that may hold those ids are read (`before` is then null)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inside = _store(path)
                with store.open_input_file(inside) as source:
                    yield from _read_file(path.rpartition("/")[2], FrameReader(source), wanted)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "ids-*.zst").load(folder).select("path")
    return files.mapInArrow(
        read, "file string, place bigint, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint"
    )


def round_trip(docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write `docs` as token files and read them back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Without a `folder` the files lie in the shared folder and are removed when
    they have been read. File names ascend with doc_id, so the start of a file
    is the sum of the files before it; that window runs over one row per file.
    """
    spark = docs.sparkSession
    target = folder or f"{shared_dir(spark).rstrip('/')}/ids-{uuid.uuid4().hex}"
    manifest = write_frames(docs, target, **options)
    if manifest.isEmpty():
        empty = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
        return spark.createDataFrame([], empty)
    order = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("file", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("file_start"))
    rows = read_frames(spark, target).join(starts, "file").select(
        "doc_id", (F.col("file_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )
    if folder:
        return rows
    kept = durable(rows)
    remove_folder(spark, target)
    return kept
