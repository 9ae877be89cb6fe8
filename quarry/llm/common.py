"""Shared helpers: scratch folders, Arrow access, vectorised word hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
MULT = U64(0x9E3779B97F4A7C15)
MIX_A = U64(0xBF58476D1CE4E5B9)
MIX_B = U64(0x94D049BB133111EB)

#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z is lower-cased.
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[0x30:0x3A] = True
ALNUM_WORD[0x61:0x7B] = True
ALNUM_WORD[0x80:] = True
#: Bytes of words `[^\x20\x09-\x0D]+`.
SPACED_WORD = np.ones(256, bool)
SPACED_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


#: Rows that Spark hands to a Python worker at once hold about so many bytes, unless the session sets another bound.
BATCH_BYTES, BATCH_CONF, BATCH_DEFAULT = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
_PATHS: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint directory set on the context.

    Where neither is set, a session in one process (as in tests) gets a temporary folder; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Bound the batches of Python workers by bytes where the session does not: a worker's memory follows their size."""
    if spark.conf.get(BATCH_CONF) == BATCH_DEFAULT:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def scratch(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder."""
    bound_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _PATHS.append(path)
    return path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables of the shared folder that nothing will read again."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        if path in _PATHS:
            _PATHS.remove(path)


def clear(spark: SparkSession, keep: DataFrame | None = None) -> None:
    """Delete all tables that operators have written in the shared folder, but for those that `keep` reads.

    Results are lazy and read their stages: call it when they have been written.
    """
    kept = keep.inputFiles() if keep is not None else []
    remove(spark, *[p for p in _PATHS if not any(p.rpartition("/")[2] in f for f in kept)])


def stage(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns and nothing else, so that further columns with any name cannot clash."""
    return df.select(*[df[f"`{c}`"] for c in columns])


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and the n+1 offsets; null counts as empty."""
    array = array.cast(pa.large_string()) if not pa.types.is_large_string(array.type) else array
    if array.null_count:
        array = array.fill_null("")
    _, ends, data = array.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    if data is None or not len(array):
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    flat = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return flat, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `most` bytes, or one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U64(30))
    h = h * MIX_A
    h ^= h >> U64(27)
    h *= MIX_B
    h ^= h >> U64(31)
    return h


#: Words longer than this are hashed one by one.
LONG_WORD = 1024
_POWERS = np.cumprod(np.full(LONG_WORD, MULT, U64))
_VALUES = mix(np.arange(1, 257, dtype=U64) * MIX_B)


def words(flat: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of all words; no word crosses two texts."""
    inside = table[flat]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[cuts] = inside[cuts]
    last[cuts[1:] - 1] = inside[cuts[1:] - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, whatever its length."""
    if not len(starts):
        return np.zeros(0, U64)
    begin = np.zeros(len(flat), np.int32)
    begin[starts] = starts
    np.maximum.accumulate(begin, out=begin)
    np.subtract(np.arange(len(flat), dtype=np.int32), begin, out=begin)
    np.minimum(begin, LONG_WORD - 1, out=begin)
    terms = _POWERS[begin]
    terms *= _VALUES[flat]
    terms *= table[flat]
    out = mix(np.add.reduceat(terms, starts) + (ends - starts).astype(U64) * MIX_B)
    for k in np.flatnonzero(ends - starts > LONG_WORD):
        out[k] = xxhash.xxh3_64_intdigest(flat[starts[k] : ends[k]].tobytes())
    return out


def list_array(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    """Values cut into lists of the given lengths."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), values)


def buckets(spark: SparkSession, n_bytes: int, each: int) -> int:
    """Partitions so that each holds about `each` bytes; no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // each))


def bounded_sample(rows: DataFrame, id_col: str, class_col: str, most: int) -> DataFrame:
    """At most `most` rows of each class, chosen by a hash of the identifier: those below the class's cut-off.

    Classes are counted first, and rows are thinned by the hash to about twice the bound; only the hashes of those, not the
    rows, come together to find the cut-off. Rows that share the hash at the cut-off stay or go together.
    """
    counts = rows.groupBy(class_col).agg(F.count("*").alias("_n"))
    place = F.xxhash64(F.col(id_col).cast("string")).bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
    thin = rows.join(F.broadcast(counts), class_col).withColumn("_place", place).filter(F.col("_place") * F.col("_n") < F.lit(2.0 * most + 50))
    cut = thin.groupBy(class_col).agg(F.array_sort(F.collect_list("_place")).alias("_all")).select(class_col, F.coalesce(F.get("_all", F.lit(most)), F.lit(2.0)).alias("_cut"))
    return thin.join(F.broadcast(cut), class_col).filter(F.col("_place") < F.col("_cut")).drop("_n", "_place", "_cut")


#: A key with more than one row in so many is joined by broadcast; there are fewer such keys than this number.
SHARES = 10_000


def join_by_key(rows: DataFrame, per_key: DataFrame, keys: list[str], n_rows: int, weight: str) -> DataFrame:
    """Inner join of rows with a table of one row per key, however many rows a key has.

    weight is the column of per_key with the key's number of rows, n_rows the number of all rows. Keys that hold more than
    1/SHARES of all rows are fewer than SHARES, whatever the data: they are broadcast, and their rows stay where they are.
    All other rows are shuffled by the keys.
    """
    limit = n_rows // SHARES
    hot, cold = per_key.filter(F.col(weight) > limit), per_key.filter(F.col(weight) <= limit)
    split = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(split.join(cold, keys))
