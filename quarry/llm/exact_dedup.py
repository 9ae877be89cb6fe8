"""Exact deduplication by a stateful stream whose keyed state lives on disk (RocksDB) and never expires.

A store is a folder with a log of all contents that were ever read and the stream's checkpoint with its keyed state. Each call
appends its documents to the log and runs the stream over the new files, so a copy is found whenever its original came.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_by_key, only, scratch, stage

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # no space set aside for the logs of many small stores
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",  # one bound for all stores of an executor
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}
#: Bits of the filter of hit digests, and bits of each of its rows: 8 MB in all, whatever the data.
FILTER_BITS, ROW_BITS = 1 << 26, 1 << 15


def normalised(text: Column) -> Column:
    """Null as empty; each run of blank characters as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def content_log(docs: DataFrame, batch: int, id_col: str = "doc_id", text_col: str = "text", digest_of=digest) -> DataFrame:
    """One row per document for the log: stable identifier, batch, digest, SHA-256 and the normalised text itself."""
    rows = only(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("body"))
    return rows.select("doc_id", F.lit(batch).alias("batch"), digest_of(F.col("body")).alias("digest"), F.sha2("body", 256).alias("text_sha256"), "body")


def located(log: DataFrame) -> DataFrame:
    """Rows of the log with their content locator: the file of the log and the row in it from which the bytes can be read."""
    return log.withColumn("locator", F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")))


def first_row() -> Column:
    """Of the rows of a key that with the smallest identifier; null ones come last, and of equal ones that of the first batch."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "batch", "locator"))


def deduplicate_stream(stream: DataFrame, state_path: str):
    """Run a stream of (digest, doc_id, batch, locator) rows into keyed state: per digest the first row and how many there were.

    State has no watermark, so no key ever expires; it is held in RocksDB on the executors' disks, with its change log in
    state_path, from which a restart goes on. Rows of one key are combined before they are shuffled. Returns the started query.
    """
    state = stream.groupBy("digest").agg(first_row().alias("first"), F.count("*").alias("n"))
    return state.writeStream.format("noop").outputMode("update").option("checkpointLocation", state_path).trigger(availableNow=True).start()


def read_state(spark: SparkSession, state_path: str) -> DataFrame:
    """What the keyed state retains: digest, keep_id, keep_locator and the number of rows seen."""
    state = spark.read.format("statestore").load(state_path)
    return state.select(F.col("key.digest").alias("digest"), F.col("value.min.doc_id").alias("keep_id"), F.col("value.min.locator").alias("keep_locator"), F.col("value.count").alias("seen"))


def append(docs: DataFrame, store: str, id_col: str = "doc_id", text_col: str = "text", digest_of=digest) -> DataFrame:
    """Append docs to the log of a store and return the whole log; an empty store gets its first batch."""
    spark = docs.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/log")
    known = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    last = spark.read.parquet(f"{store}/log").agg(F.max("batch")).first()[0] if known else None
    rows = content_log(docs, 0 if last is None else last + 1, id_col, text_col, digest_of)
    rows.write.mode("append").option("compression", "zstd").parquet(f"{store}/log")
    return spark.read.schema(rows.schema).parquet(f"{store}/log")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_of=digest, store: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, and locator and keep_locator in the log.

    With a store (a folder that all executors share) that earlier calls have filled, their rows are part of the groups and of
    the result too, for a new row may take the place of an older one; without it the store is a new one.

    Texts are equal when identical after each run of [\\x20\\x09-\\x0D] becomes one space; null counts as empty. The row with
    the smallest identifier stays; null identifiers come after all others, and of rows that repeat an identifier and its text
    one stays, of an earlier batch if there is one. Digests go through `deduplicate_stream`; every hit, that is each row of a
    digest seen more than once, then has its full bytes compared under that digest. Where bytes differ, rows are grouped by
    the bytes themselves. An empty table gives no rows. Further columns are ignored.
    """
    spark = docs.sparkSession
    store = store or scratch(spark, "dedup")
    log = append(docs, store, id_col, text_col, digest_of)
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    try:
        for k, v in STATE_CONF.items():
            spark.conf.set(k, v)
        stream = located(spark.readStream.schema(log.schema).parquet(f"{store}/log")).drop("body", "text_sha256")
        deduplicate_stream(stream, f"{store}/state").awaitTermination()
        seen = stage(read_state(spark, f"{store}/state"), "dedup-seen")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    clash = clashes(log, seen.filter("seen > 1").select("digest"))
    small = located(log).drop("body")
    plain = join_by_key(small, seen, ["digest"], small.count(), "seen")
    if clash is not None:
        plain = plain.join(clash, "digest", "left_anti")
    plain = plain.select("doc_id", "keep_id", F.col("seen").alias("group_size"), (F.col("locator") == F.col("keep_locator")).alias("kept"), "text_sha256", "locator", "keep_locator")
    return plain if clash is None else plain.unionByName(by_bytes(log, clash))


def among(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key may be among keys: all that are, and few others unless keys are very many.

    The filter is a bitmap of hashes in rows of ROW_BITS bits, FILTER_BITS in all; it is the same plan at every size.
    """
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    bits = keys.select(place.alias("_place")).groupBy(F.floor(F.col("_place") / F.lit(ROW_BITS)).alias("_row"))
    bits = bits.agg(F.bitmap_construct_agg(F.col("_place") % F.lit(ROW_BITS)).alias("_bits"))
    own = rows.withColumn("_place", place)
    both = own.join(F.broadcast(bits), F.floor(own["_place"] / F.lit(ROW_BITS)) == bits["_row"])
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_place") % F.lit(ROW_BITS) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return both.filter(byte.bitwiseAND(F.pow(F.lit(2), F.col("_place") % 8).cast("int")) != 0).select(*rows.columns)


def clashes(log: DataFrame, hits: DataFrame) -> DataFrame | None:
    """Digests of hits under which not all bytes are the same; None if there are none.

    Rows of one digest are compared within each task before the shuffle, so that a large group of copies moves as one text a task.
    """
    rows = among(log.select("digest", "body"), hits, "digest")
    found = rows.groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high")).filter("low != high").select("digest")
    found = stage(found, "dedup-clash")
    return None if found.isEmpty() else found


def by_bytes(log: DataFrame, clash: DataFrame) -> DataFrame:
    """The exact way for digests that stand for more than one text: group by the text itself."""
    rows = stage(located(log).join(clash, "digest", "left_semi"), "dedup-bytes")
    groups = rows.groupBy("body").agg(first_row().alias("first"), F.count("*").alias("group_size"))
    rows = rows.join(groups, "body").withColumn("keep_locator", F.col("first.locator"))
    return rows.select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("locator") == F.col("keep_locator")).alias("kept"), "text_sha256", "locator", "keep_locator")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8 over all documents: doc_id, keep_id, group_size, kept, text_sha256 (see `exact_dedup`)."""
    rows = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
