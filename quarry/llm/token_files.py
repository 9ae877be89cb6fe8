"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds, in this order: one frame for each document (its ids, little-endian, with the frame's own content checksum); a
skippable frame with the index (document identifiers, token counts and bits that tell which identifiers are missing); a skippable frame with the seek table in the public
seekable format: compressed size, decompressed size and checksum (low half of XXH64) of every frame, then the number of
frames, a descriptor byte and a magic number. A reader finds any document from the end of the file and decompresses it alone.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches, only, scratch, slices, utf8
from .tokenize import IdEncoder, kept, vocabulary_path

#: Fixed values of the public seekable format.
SEEK_MAGIC, TABLE_FRAME, INDEX_FRAME = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50
WITH_CHECKSUMS = 0x80
#: A null identifier is sorted as the first one; which documents have none is kept beside.
NO_ID = -(1 << 63)
SHARD_BYTES = 16 << 20


def qualified(spark: SparkSession, path: str) -> str:
    """The path with scheme and authority as Spark takes it, so that executors write where Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return (pafs.LocalFileSystem(), path) if "://" not in path else pafs.FileSystem.from_uri(path)


def seek_table(sizes: list[tuple[int, int, int]]) -> bytes:
    body = b"".join(struct.pack("<III", *s) for s in sizes) + struct.pack("<IBI", len(sizes), WITH_CHECKSUMS, SEEK_MAGIC)
    return struct.pack("<II", TABLE_FRAME, len(body)) + body


def index_frame(ids: list[int], missing: list[bool], counts: list[int], width: int) -> bytes:
    body = struct.pack("<BI", width, len(ids)) + np.array(ids, "<i8").tobytes() + np.array(counts, "<i8").tobytes() + np.packbits(np.array(missing, bool)).tobytes()
    return struct.pack("<II", INDEX_FRAME, len(body)) + body


class TokenFile:
    """Random access to one token file, given a function that returns size bytes from a place, and the file's length."""

    def __init__(self, read_at, length: int):
        self.read_at = read_at
        n, _, magic = struct.unpack("<IBI", read_at(length - 9, 9))
        if magic != SEEK_MAGIC:
            raise ValueError("not a token file: no seek table at its end")
        table = np.frombuffer(read_at(length - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        ends = np.cumsum(table[:, 0])
        self.sizes, self.begins = table[:-1], np.concatenate(([0], ends[:-1]))[:-1]
        index = read_at(int(ends[-2]) if n > 1 else 0, int(table[-1, 0]))
        self.width, count = struct.unpack_from("<BI", index, 8)
        self.doc_ids = np.frombuffer(index, "<i8", count, 13)
        self.counts = np.frombuffer(index, "<i8", count, 13 + 8 * count)
        self.missing = np.unpackbits(np.frombuffer(index, np.uint8, -1, 13 + 16 * count), count=count).astype(bool)
        self.reader = zstandard.ZstdDecompressor()

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document; both checksums of its frame are verified."""
        packed, plain, checksum = (int(x) for x in self.sizes[k])
        data = self.reader.decompress(self.read_at(int(self.begins[k]), packed), max_output_size=plain)
        if len(data) != plain or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
            raise ValueError(f"document {self.doc_ids[k]}: checksum differs")
        return np.frombuffer(data, f"<u{self.width}").astype("<u4")


def open_token_file(path: str) -> TokenFile:
    """Random access by path; only the end of the file and requested frames are read."""
    system, place = open_fs(path)
    file = system.open_input_file(place)

    def read_at(offset: int, size: int) -> bytes:
        file.seek(offset)
        return file.read(size)

    return TokenFile(read_at, file.size())


def write_token_files(docs: DataFrame, out: str, tokenizer: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", n_shards: int | None = None, shard_bytes: int = SHARD_BYTES, width: int = 2) -> DataFrame:
    """Encode every whole text and write token files in ascending identifier order; returns the written files, lazily.

    Null texts are empty, null identifiers come first; equal identifiers stay beside each other in the order of their frames'
    bytes. end_id is appended to each document. Documents are encoded and compressed where they are read, and only frames are
    shuffled, by ranges of the identifier; each task writes files of about shard_bytes under a temporary name and renames
    them, so that a task that runs again leaves the same files. Result: file, shard, part, n_docs, n_ids. An empty table
    writes no file.
    """
    spark = docs.sparkSession
    out = qualified(spark, out)
    n_shards = n_shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = only(docs, id_col, text_col).select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).alias("text"), F.col(id_col).cast("long").isNull().alias("missing"))
    bound_batches(spark)
    shares = [i / n_shards for i in range(1, n_shards)]
    bounds = np.array(docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * n_shards)).alias("b")).first()["b"] or [] if shares else [], np.int64)
    system, _ = open_fs(out)
    tail = b"" if end_id is None else np.array([end_id], f"<u{width}").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = kept(IdEncoder, tokenizer, f"<u{width}"), zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for i, j in slices(offsets, 4 << 20):
                doc_ids = batch.column(0).slice(i, j - i)
                data = [d + tail for d in encoder.encode([t or "" for t in batch.column(1).slice(i, j - i).to_pylist()])]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.searchsorted(bounds, doc_ids.to_numpy(), side="left").astype(np.int32)), doc_ids, batch.column(2).slice(i, j - i),
                    pa.array([len(d) // width for d in data], pa.int64()),
                    pa.array([xxhash.xxh64_intdigest(d) & 0xFFFFFFFF for d in data], pa.int64()),
                    pa.array([packer.compress(d) for d in data], pa.binary()),
                ], ["shard", "doc_id", "missing", "n", "checksum", "frame"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = open_fs(out)
        system.create_dir(folder, recursive=True)
        frames, sizes, ids, absent, counts, part, shard, held = [], [], [], [], [], 0, None, 0

        def flush():
            nonlocal frames, sizes, ids, absent, counts, part, held
            if not ids:
                return
            index = index_frame(ids, absent, counts, width)
            name = f"shard-{shard:07d}-{part:05d}.tokens"
            temporary = f"{folder}/_{name}.{uuid.uuid4().hex}"
            with system.open_output_stream(temporary) as f:
                for frame in frames:
                    f.write(frame)
                f.write(index)
                f.write(seek_table([*sizes, (len(index), 0, 0)]))
            system.move(temporary, f"{folder}/{name}")
            row = pa.RecordBatch.from_pydict({"file": [name], "shard": pa.array([shard], pa.int32()), "part": pa.array([part], pa.int32()), "n_docs": [len(ids)], "n_ids": [sum(counts)]})
            frames, sizes, ids, absent, counts, held, part = [], [], [], [], [], 0, part + 1
            return row

        for batch in batches:
            for s, doc_id, missing, n, checksum, frame in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if s != shard or held >= shard_bytes:
                    if row := flush():
                        yield row
                    if s != shard:
                        shard, part = s, 0
                frames.append(frame)
                sizes.append((len(frame), n * width, checksum))
                ids.append(doc_id)
                absent.append(missing)
                counts.append(n)
                held += len(frame)
        if row := flush():
            yield row

    frames = docs.mapInArrow(encode, "shard int, doc_id long, missing boolean, n long, checksum long, frame binary").repartitionById(n_shards, F.col("shard")).sortWithinPartitions("shard", "doc_id", F.desc("missing"), "frame")
    return frames.mapInArrow(write, "file string, shard int, part int, n_docs long, n_ids long")


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """Every document of the token files in a folder: file, doc_id, place (ids before it in the file), n_tokens, ids_crc32 and, if wanted, ids.

    Checksums of all frames are verified. A folder without files gives no rows.
    """
    schema = "file string, doc_id long, place long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                data = memoryview(content.as_buffer())
                file = TokenFile(lambda at, size, data=data: bytes(data[at : at + size]), len(data))
                places = np.concatenate(([0], np.cumsum(file.counts)))
                for i in range(0, len(file.doc_ids), 2000):
                    ids = [file.ids(k) for k in range(i, min(i + 2000, len(file.doc_ids)))]
                    j = i + len(ids)
                    columns = [
                        pa.array([path.as_py().rpartition("/")[2]] * len(ids)), pa.array(file.doc_ids[i:j], mask=file.missing[i:j]), pa.array(places[i:j]), pa.array(file.counts[i:j]),
                        pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                    ]
                    if with_ids:
                        columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(zip(["file", "doc_id", "place", "n_tokens", "ids_crc32", "ids"], [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())], strict=True))[: len(columns)]))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tokens").load(folder).select("path", "content")
    return files.mapInArrow(parse, schema)


def token_files(docs: DataFrame, out: str, tokenizer: str, end_id: int | None = None, with_ids: bool = True, **options) -> DataFrame:
    """Write docs as token files under out and read them back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, file, ids.

    An error is raised if Spark does not see every file of the manifest, so no document is lost unnoticed.
    """
    spark = docs.sparkSession
    out = qualified(spark, out)
    manifest = f"{out}/manifest"
    write_token_files(docs, f"{out}/files", tokenizer, end_id, **options).write.parquet(manifest)
    files = spark.read.parquet(manifest)
    system, place = open_fs(f"{out}/files")
    system.create_dir(place, recursive=True)
    seen = spark.read.format("binaryFile").option("pathGlobFilter", "*.tokens").load(f"{out}/files").select(F.element_at(F.split("path", "/"), -1).alias("file"))
    if missing := files.join(seen, "file", "left_anti").agg(F.count("*").alias("n"), F.min("file").alias("file")).first()["n"]:
        raise RuntimeError(f"{missing} token files were written but cannot be read under {out}/files")
    # One row a file, not a document: the running sum over shards is small.
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("shard")) - F.col("n"))
    within = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("part")) - F.col("n_ids")
    starts = files.join(shards.select("shard", "before"), "shard").select("file", (F.col("before") + within).alias("base"))
    rows = read_token_files(spark, f"{out}/files", with_ids).join(starts, "file")
    return rows.withColumn("start", F.col("base") + F.col("place")).drop("base", "place")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1 over all documents: doc_id, start, n_tokens, ids_crc32, from files that were written and read back (see `token_files`)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = token_files(docs, scratch(spark, "tokens"), vocabulary_path("word_bpe_49k.json"), end_id=2, with_ids=False)
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")
