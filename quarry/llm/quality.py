"""Quality classifier by compression: which of two zstandard dictionaries, of good and of bad text, makes a text smaller."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MULT, U64, bound_batches, bounded_sample, mix, only, slices, utf8

#: A text is compressed in pieces of so many bytes, so that the dictionaries, not the text's own past, decide all along it.
PIECE = 512
#: Bounds of the fit, for each label: documents whose pieces train a dictionary, pieces that are sampled from all of theirs,
#: and documents that calibrate.
MOST_DOCS, MOST_PIECES, MOST_CALIBRATION = 3000, 20_000, 2000
#: Text that is compressed at once.
SLICE_BYTES = 1 << 20
DICTIONARY_BYTES, LEVEL = 64 << 10, 3
#: Every text counts as so many bytes more of the usual difference: a text of a few words says little about itself.
PSEUDO_BYTES = 64


@dataclass
class CompressionModel:
    """Two dictionaries and the logistic curve from the normalised size difference to the chance of label 1."""

    good: bytes
    bad: bytes
    slope: float = 0.0
    bias: float = 0.0
    usual: float = 0.0

    def scorer(self):
        packers = []
        for data in (self.good, self.bad):
            dictionary = zstandard.ZstdCompressionDict(data) if data else None
            if dictionary:
                dictionary.precompute_compress(level=LEVEL)
            packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False) if dictionary else zstandard.ZstdCompressor(level=LEVEL))
        return packers

    def difference(self, saved, n_bytes):
        """The normalised size difference: bytes saved for each byte of text."""
        return (saved + PSEUDO_BYTES * self.usual) / (n_bytes + PSEUDO_BYTES)

    def score(self, saved: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
        """The chance of label 1."""
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(saved, n_bytes) + self.bias, -50, 50)))

    def compare(self, texts: pa.Array, packers) -> tuple[np.ndarray, np.ndarray]:
        """Bytes saved and bytes of every whole text."""
        flat, offsets = utf8(texts)
        parts = [savings(flat[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], packers) for i, j in slices(offsets, SLICE_BYTES)]
        return np.concatenate(parts) if parts else np.zeros(0), np.diff(offsets).astype(float)


def savings(flat: np.ndarray, offsets: np.ndarray, packers) -> np.ndarray:
    """Bytes that the dictionary of good text saves over that of bad text, summed over each text's pieces."""
    lengths = np.diff(offsets)
    counts = -(-lengths // PIECE)
    owner = np.repeat(np.arange(len(lengths)), counts)
    begins = offsets[:-1][owner] + PIECE * (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts))
    ends = np.minimum(begins + PIECE, offsets[1:][owner])
    out = []
    segments = np.stack((begins, ends - begins), axis=1).astype("<u8").tobytes()
    for packer in packers:
        if len(owner):
            packed = packer.multi_compress_to_buffer(zstandard.BufferWithSegments(flat.tobytes(), segments), threads=1)
            sizes = np.fromiter((len(x) for x in packed), np.int64, len(owner))
        else:
            sizes = np.zeros(0, np.int64)
        out.append(np.bincount(owner, sizes, len(lengths)))
    good, bad = out
    return (bad - good).astype(float)


def compare_sizes(docs: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, saved, n_bytes and score for every row and its whole text."""
    docs = only(docs, id_col, text_col)
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers = model.scorer()
        for batch in batches:
            saved, n_bytes = model.compare(batch.column(1), packers)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(saved), pa.array(n_bytes), pa.array(model.score(saved, n_bytes))], ["id", "saved", "n_bytes", "score"])

    return docs.mapInArrow(run, T.StructType([docs.schema[0], *[T.StructField(c, T.DoubleType()) for c in ("saved", "n_bytes", "score")]]))


def sample_pieces(rows: DataFrame, most: int) -> DataFrame:
    """(label, piece): about `most` pieces of each label at most, sampled from all pieces of all whole texts of (id, label, text).

    Which pieces are taken is told by a hash of the identifier and the piece's number, however rows are dealt out.
    """
    pieces = F.ceil(F.octet_length("text") / F.lit(PIECE))
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.sum(pieces).alias("n")).collect()}
    share = {k: min(1.0, most / n) if n else 1.0 for k, n in totals.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = utf8(batch.column(2))
            labels, pieces = [], []
            for k, (key, label) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                begins = np.arange(offsets[k], offsets[k + 1], PIECE)
                place = mix(U64(xxhash.xxh3_64_intdigest(str(key))) + np.arange(1, len(begins) + 1, dtype=U64) * MULT)
                for b in begins[(place >> U64(11)).astype(float) < share[label] * 2.0**53]:
                    labels.append(label)
                    pieces.append(flat[b : min(b + PIECE, offsets[k + 1])].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(pieces, pa.binary())], ["label", "piece"])

    return rows.mapInArrow(run, "label int, piece binary")


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and bias of a lightly regularised logistic curve, by Newton steps; with targets drawn in from 0 and 1 (Platt)."""
    n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(float(np.std(x)), 1e-9)
    z, w = np.stack((x / scale, np.ones(len(x))), axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))
        gradient = z.T @ (weight * (p - target)) + 1e-3 * w
        hessian = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_docs: int = MOST_DOCS, most_calibration: int = MOST_CALIBRATION, most_pieces: int = MOST_PIECES) -> CompressionModel:
    """Fit on a bounded sample of labelled rows: for each label at most most_docs documents for the dictionaries, of whose whole
    texts about most_pieces pieces are taken evenly, and others, at most most_calibration whole texts, for the curve.

    Labels other than 0 and 1, null labels and documents with both labels are left out. However few pieces a label has, they
    are its dictionary; if all its documents are among those for the curve, their pieces are taken. Without both labels, or
    where no text of one has a byte, the score is the share of label 1 (0.5 without any). The two samples are parted by a hash,
    so each holds about its share of the bound, the two together never more than their sum. If all documents for the curve have
    one label, the curve is steep and unshifted: a text nearer to good text scores above 0.5, an empty one exactly 0.5.
    """
    ids = only(labels, id_col, label_col).filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    ids = ids.groupBy(id_col).agg(F.min(label_col).alias("label"), F.max(label_col).alias("other")).filter("label = other").select(id_col, F.col("label").cast("int").alias("label"))
    sampled = bounded_sample(ids, id_col, "label", most_docs + most_calibration)
    fold = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("fold")), F.lit(most_docs + most_calibration)) < most_docs
    sampled = sampled.withColumn("train", fold)
    rows = only(docs, id_col, text_col).withColumnRenamed(text_col, "text").join(F.broadcast(sampled), id_col)
    counts = {r["label"]: r["count"] for r in ids.groupBy("label").count().collect()}
    texts = rows.select(F.col(id_col).cast("string").alias("id"), "label", "text")
    samples = usable_pieces(texts.filter(rows["train"]), most_pieces)
    if not all(samples.values()) and min(counts.get(0, 0), counts.get(1, 0)):
        spare = usable_pieces(texts, most_pieces)
        samples = {k: s or spare[k] for k, s in samples.items()}
    if not all(samples.values()):
        share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
        return CompressionModel(b"", b"", 0.0, float(np.log(share / (1 - share))))
    trained = {k: dictionary(s) for k, s in samples.items()}
    model = CompressionModel(trained[1], trained[0])
    held = rows.filter("NOT train").select("label", "text")
    points = compare_sizes(held.withColumnRenamed("label", "id"), model, "id", "text").toPandas().sort_values(["id", "saved", "n_bytes"])
    y = points["id"].to_numpy(float)
    if 0 < y.sum() < len(y):
        share = counts[1] / (counts[0] + counts[1])
        saved, n_bytes = points["saved"].to_numpy(), points["n_bytes"].to_numpy()
        weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
        model.usual = float((weight @ (saved / np.maximum(n_bytes, 1))) / weight.sum())
        model.slope, model.bias = fit_logistic(model.difference(saved, n_bytes), y, weight)
    else:
        model.slope = 100.0
    return model


def usable_pieces(rows: DataFrame, most: int) -> dict[int, list[bytes]]:
    """The sampled pieces of each label: those of 8 bytes or more, or shorter ones where it has no others."""
    pieces = sample_pieces(rows, most).toPandas().sort_values(["label", "piece"])
    found = {k: pieces["piece"][pieces["label"] == k].tolist() for k in (0, 1)}
    return {k: [p for p in s if len(p) >= 8] or s for k, s in found.items()}


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; the samples themselves where they are too few or too much alike to train on."""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def classify(docs: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """id_col, score (0 to 1, the chance of label 1) and predicted for every row; null and empty texts get the score of the usual difference."""
    rows = compare_sizes(docs, model, id_col, text_col)
    return rows.select(F.col(rows.columns[0]).alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_predicted(docs: DataFrame, model: CompressionModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least the threshold; nothing is shuffled or joined."""
    place = docs.columns.index(text_col)
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers = model.scorer()
        for batch in batches:
            yield batch.filter(pa.array(model.score(*model.compare(batch.column(place), packers)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id", folds: int = 3, fold: int = 1):
    """Whether crc32 of the identifier as text leaves the remainder `fold`."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2 over all documents: doc_id, held_out, score, predicted; learned from labelled documents outside the held-out fold (see `fit`, `classify`)."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels.filter(~held_out()))
    return classify(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
