"""Token ids in files of length-delimited binary records, with an index for shuffled reads.

A record is the length of its data (unsigned 64-bit), the masked checksum of these 8 bytes, the data, and the
masked checksum of the data; all integers are little-endian. The checksum is crc32 as zlib has it, and its
mask rotates it right by 15 bits and adds a constant, so that a checksum of data that holds
checksums stays sound. The data are one byte of flags (1: has a doc_id; 2: ids take 4 bytes instead of 2), the doc_id
as signed 64-bit integer, and the ids. ``NAME.index`` holds the offset of every record of ``NAME.records`` and the
file's size, as unsigned 64-bit integers.

Files are in ascending order of doc_id, and so are the records in them. A task writes a file of its own
name and then renames it, so a repeated task leaves the same files. Any store that pyarrow opens by its
address can hold them; they are read back by Spark.

Cases: a null text is an empty one, with the end id alone. Rows without doc_id come first, by text hash. Repeated
rows are written each; a repeated doc_id is ordered by text hash. Extra columns are not read. No rows
give no files. A wrong checksum or a cut file raises an error.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailquarry.llm.common import documents_of, in_arrow, slices, texts_of
from mailquarry.llm.tokens import encoder
from mailquarry.sinks.facts import new_table_path, staged

#: Text bytes for a file; its ids take about two thirds of that.
SHARD_BYTES = 16 << 20
SLICE_BYTES = 6 << 20
#: Files whose ids are summed in one task.
RUN = 10_000
MASK = 0xA282EAD8
HEAD, SUM = struct.Struct("<Q"), struct.Struct("<I")
HAS_ID, WIDE = 1, 2
DATA_HEAD = struct.Struct("<Bq")


def checksum(data: bytes) -> bytes:
    crc = zlib.crc32(data)
    return SUM.pack(((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF)


def framed(data: bytes) -> bytes:
    head = HEAD.pack(len(data))
    return b"".join((head, checksum(head), data, checksum(data)))


def serialized(doc_id: int | None, ids: np.ndarray) -> bytes:
    """The data of a record; 2 bytes an id where all fit."""
    wide = len(ids) and int(ids.max()) > 0xFFFF
    flags = (HAS_ID if doc_id is not None else 0) | (WIDE if wide else 0)
    return DATA_HEAD.pack(flags, doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()


def parsed(data: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = DATA_HEAD.unpack_from(data)
    ids = np.frombuffer(data, dtype="<u4" if flags & WIDE else "<u2", offset=DATA_HEAD.size)
    return (doc_id if flags & HAS_ID else None), ids.astype("<u4")


def record_at(content: bytes, offset: int) -> tuple[bytes, int]:
    """The data of the record at an offset, and the offset of the next one."""
    start = offset + HEAD.size + SUM.size
    head = content[offset: offset + HEAD.size]
    if len(content) < start or content[offset + HEAD.size: start] != checksum(head):
        raise ValueError(f"no record at offset {offset}")
    end = start + HEAD.unpack(head)[0]
    data = content[start:end]
    if content[end: end + SUM.size] != checksum(data):
        raise ValueError(f"broken record at offset {offset}")
    return data, end + SUM.size


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder)


def _moved(store: fs.FileSystem, source: str, target: str) -> None:
    if store.get_file_info(target).type != fs.FileType.NotFound:
        store.delete_file(target)
    store.move(source, target)


def write_records(docs: DataFrame, tokenizer: str, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the files to ``folder`` and returns (shard, records, ids, bytes) of each."""
    rows = documents_of(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("n")).first()["n"] or 0
    shards = max(1, -(-int(size) // shard_bytes))
    ordered = rows.repartitionByRange(shards, "doc_id", "hash").sortWithinPartitions("doc_id", "hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        store, path = _opened(folder)
        name, own = f"{path}/shard-{shard:06d}", None
        offsets, n_ids = [0], 0
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                if own is None:
                    store.create_dir(path, recursive=True)
                    own = f"{name}.{uuid.uuid4().hex}"
                    file = store.open_output_stream(f"{own}.data")
                ends, ids = encoder(tokenizer).encode(texts_of(part))
                for at, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    record = framed(serialized(doc_id, ids[ends[at]: ends[at + 1]]))
                    file.write(record)
                    offsets.append(offsets[-1] + len(record))
                n_ids += len(ids)
        if own is None:
            return
        file.close()
        with store.open_output_stream(f"{own}.offsets") as index:
            index.write(np.array(offsets, dtype="<u8").tobytes())
        _moved(store, f"{own}.offsets", f"{name}.index")
        _moved(store, f"{own}.data", f"{name}.records")
        yield pa.RecordBatch.from_pydict({"shard": [shard], "records": [len(offsets) - 1], "ids": [n_ids], "bytes": [offsets[-1]]})

    return staged(in_arrow(ordered, run, "shard long, records long, ids long, bytes long"), "llm-shards")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, nth, before, doc_id, ids) of every record: its number in the file, the ids of the file before it,
    and its ids as little-endian unsigned 32-bit integers."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.records").load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard = int(batch.column("path")[row].as_py().rpartition("shard-")[2].removesuffix(".records"))
                content = memoryview(batch.column("content")[row].as_buffer()).cast("B")  # the file, in place
                at, nth, before, found = 0, 0, 0, []
                while at < len(content):
                    data, at = record_at(content, at)
                    doc_id, ids = parsed(data)
                    found.append((shard, nth, before, doc_id, ids.tobytes()))
                    nth, before = nth + 1, before + len(ids)
                    if len(found) == 1000 or at == len(content):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), [pa.int64()] * 4 + [pa.binary()], strict=True)],
                            names=["shard", "nth", "before", "doc_id", "ids"])
                        found = []

    return in_arrow(files, run, "shard long, nth long, before long, doc_id long, ids binary")


def read_at(folder: str, shard: int, nth: int) -> tuple[int | None, np.ndarray]:
    """One record by the index, as a shuffled reader takes it."""
    store, path = _opened(folder)
    with store.open_input_file(f"{path}/shard-{shard:06d}.index") as index:
        index.seek(8 * nth)
        start, end = struct.unpack("<QQ", index.read(16))
    with store.open_input_file(f"{path}/shard-{shard:06d}.records") as file:
        file.seek(start)
        return parsed(record_at(file.read(end - start), 0)[0])


def placed(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record of the files; start is the ids of all records before it.

    The ids before a file are summed in two steps, over the files of a run and over the runs, so no task has a row for every file.
    """
    rows = staged(read_records(spark, folder).select(
        "shard", "doc_id", "before", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")), "llm-records-read")
    files = rows.groupBy("shard").agg(F.sum("n_tokens").alias("ids")).withColumn("run", F.floor(F.col("shard") / RUN))
    runs = files.groupBy("run").agg(F.sum("ids").alias("run_ids"))
    runs = runs.select("run", (F.sum("run_ids").over(Window.orderBy("run")) - F.col("run_ids")).alias("run_before"))
    inside = F.sum("ids").over(Window.partitionBy("run").orderBy("shard")) - F.col("ids")
    earlier = files.withColumn("inside", inside).join(runs, "run").select("shard", (F.col("inside") + F.col("run_before")).alias("earlier"))
    return rows.join(earlier, "shard").select("doc_id", (F.col("before") + F.col("earlier")).alias("start"), "n_tokens", "ids_crc32")


def new_folder(spark: SparkSession) -> str:
    return new_table_path(spark, "llm-records")
