"""Language identification: blended-spectrum presence kernels, Nyström landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, MULT, U64, bound_batches, bounded_sample, mix, only, slices, utf8
from .quality import held_out

#: Spectrum: all byte n-grams of 1 to 3, over lower-cased A-Z.
LENGTHS = (1, 2, 3)
#: Bounds of the fit: documents of each language, excerpts that are sampled from all of theirs, and landmarks in all.
MOST_DOCS, MOST_EXCERPTS, LANDMARKS = 600, 1800, 256
#: Excerpts are of these lengths in turn, so that the model meets short and long texts.
EXCERPT_BYTES = (24, 80, 250, 800, 2500)
RIDGE = 1e-3
#: Texts that are scored by one matrix product.
ROWS = 128
#: Where the codes of each length begin.
BASES = {n: sum(256**k for k in range(1, n)) for n in LENGTHS}


def codes(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-gram codes (shorter ones first) and the text of each; none crosses two texts."""
    low = LOWER[flat].astype(np.int32)
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    found, owners, code = [], [], low
    for n in LENGTHS:
        if n > 1:
            code = (code[:-1] << 8) | low[n - 1 :]
        if not len(code):
            break
        whole = owner[: len(code)] == owner[n - 1 :]
        found.append(code[whole] + BASES[n])
        owners.append(owner[: len(code)][whole])
    return (np.concatenate(found), np.concatenate(owners)) if found else (np.zeros(0, np.int32), np.zeros(0, np.int32))


@dataclass
class KernelModel:
    """All n-grams of the excerpts, the presence vectors of the landmarks and the dual weights of the ridge solution.

    The kernel is linear in presence, so landmarks and dual weights make one matrix of n-grams x languages for scoring.
    """

    languages: list[str] = field(default_factory=list)
    grams: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    landmarks: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    dual: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    sharpness: float = 4.0

    def table(self) -> np.ndarray:
        """Column of each code: one entry for every possible n-gram of up to three bytes."""
        table = np.full(sum(256**n for n in LENGTHS), -1, np.int32)
        table[self.grams] = np.arange(len(self.grams), dtype=np.int32)
        return table

    def weights(self) -> np.ndarray:
        """n-grams x languages: presence by landmarks is the kernel, the kernel by dual weights the margin."""
        return self.landmarks.T @ self.dual

    def margins(self, flat: np.ndarray, offsets: np.ndarray, table: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """texts x languages, by a matrix product of normalised presence and weights."""
        return unit(presence(flat, offsets, table, len(self.grams))) @ weights + self.bias

    def predict(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = np.exp(self.sharpness * (margins - margins.max(axis=1, keepdims=True)))
        best = margins.argmax(axis=1)
        return best, (e / e.sum(axis=1, keepdims=True))[np.arange(len(best)), best]


def presence(flat: np.ndarray, offsets: np.ndarray, table: np.ndarray, n: int) -> np.ndarray:
    """texts x n-grams: 1 where the n-gram occurs."""
    x = np.zeros((len(offsets) - 1, n), np.float32)
    code, owner = codes(flat, offsets)
    column = table[code]
    known = column >= 0
    x[owner[known], column[known]] = 1
    return x


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


def excerpts(rows: DataFrame, most: int) -> DataFrame:
    """(label, piece): about `most` excerpts of each label at most, sampled from all excerpts of all whole texts of (id, label, text).

    A text is cut from its beginning to its end into excerpts of EXCERPT_BYTES in turn, with the turn that a hash of its
    identifier tells; which excerpts are taken is told by a hash too, so the sample does not depend on how rows are dealt out.
    """
    cycle = sum(EXCERPT_BYTES)
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.sum(F.ceil(F.octet_length("text") / F.lit(cycle)) * len(EXCERPT_BYTES)).alias("n")).collect()}
    share = {k: min(1.0, most / n) if n else 1.0 for k, n in totals.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = utf8(batch.column(2))
            labels, pieces = [], []
            for k, (key, label) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                seed, n = xxhash.xxh3_64_intdigest(str(key)), int(offsets[k + 1] - offsets[k])
                sizes = np.roll(EXCERPT_BYTES, seed % len(EXCERPT_BYTES))
                begins = np.concatenate(([0], np.cumsum(np.tile(sizes, n // cycle + 1))))
                begins = begins[begins < n]
                place = mix(U64(seed) + np.arange(1, len(begins) + 1, dtype=U64) * MULT)
                ends = np.append(begins[1:], n)
                for e in np.flatnonzero((place >> U64(11)).astype(float) < share[label] * 2.0**53):
                    labels.append(label)
                    pieces.append(flat[offsets[k] + begins[e] : offsets[k] + ends[e]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(pieces, pa.binary())], ["label", "piece"])

    return rows.mapInArrow(run, "label string, piece binary")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_docs: int = MOST_DOCS, landmarks: int = LANDMARKS, most_excerpts: int = MOST_EXCERPTS) -> KernelModel:
    """Fit on about most_excerpts excerpts of the whole texts of at most most_docs documents of each language.

    Null languages, null identifiers and texts without letters are left out.
    """
    known = only(docs, id_col, lang_col).filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    ids = bounded_sample(known, id_col, lang_col, most_docs).select(id_col).distinct()
    rows = only(docs, id_col, text_col, lang_col).join(F.broadcast(ids), id_col).filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    texts = rows.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("label"), F.col(text_col).alias("text"))
    pieces = excerpts(texts, most_excerpts).toPandas().sort_values(["label", "piece"]).drop_duplicates()
    if not len(pieces):
        return KernelModel()
    order = np.random.default_rng(7).permutation(len(pieces))
    labels, data = pieces["label"].to_numpy()[order], pieces["piece"].to_numpy()[order]
    languages = sorted(set(labels))
    flat, offsets = np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(d) for d in data])))
    model = KernelModel(languages, np.unique(codes(flat, offsets)[0]))
    table, sizes = model.table(), np.diff(offsets)
    chosen = []  # long excerpts make landmarks, as many of each language
    for lang in languages:
        own = np.flatnonzero(labels == lang)
        chosen += own[np.argsort(-sizes[own], kind="stable")][: max(1, landmarks // len(languages))].tolist()
    model.landmarks = unit(presence(np.frombuffer(b"".join(data[chosen]), np.uint8), np.concatenate(([0], np.cumsum(sizes[chosen]))), table, len(model.grams)))
    blocks = []
    for i in range(0, len(data), ROWS):
        part = slice(i, min(i + ROWS, len(data)))
        x = presence(flat[offsets[part.start] : offsets[part.stop]], offsets[part.start : part.stop + 1] - offsets[part.start], table, len(model.grams))
        blocks.append(unit(x) @ model.landmarks.T)
    k_mm, k_nm = model.landmarks @ model.landmarks.T, np.concatenate(blocks)
    values, vectors = np.linalg.eigh(k_mm.astype(np.float64) + 1e-6 * np.eye(len(chosen)))
    root = vectors / np.sqrt(np.maximum(values, 1e-9))  # Nyström map: features = kernel rows times this
    z = k_nm @ root
    y = np.where(labels[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    weight = 1 / np.array([np.sum(labels == lang) for lang in labels])  # languages count alike
    weight *= len(labels) / weight.sum()
    zm, ym = (weight @ z) / weight.sum(), (weight @ y) / weight.sum()
    zc = z - zm
    beta = np.linalg.solve((zc * weight[:, None]).T @ zc + RIDGE * len(z) * np.eye(z.shape[1]), (zc * weight[:, None]).T @ (y - ym))
    model.dual, model.bias = (root @ beta).astype(np.float32), (ym - zm @ beta).astype(np.float32)
    margins = k_nm @ model.dual + model.bias
    best = margins.argmax(axis=1)
    truth = np.array([languages.index(x) for x in labels])
    scales = 2.0 ** np.arange(0, 6)

    def loss(s: float) -> float:
        e = s * (margins - margins.max(axis=1, keepdims=True))
        return float(-(e[np.arange(len(best)), truth] - np.log(np.exp(e).sum(axis=1))).mean())

    model.sharpness = float(min(scales, key=loss))
    return model


def identify(docs: DataFrame, model: KernelModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred and score (0 to 1) for every row and its whole text; null texts and texts without letters are `und` with score 0.

    A model that has learned no language calls every text `und`.
    """
    docs = only(docs, id_col, text_col)
    bound_batches(docs.sparkSession)
    rows = docs.select(id_col, text_col, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table, weights = (model.table(), model.weights()) if model.languages else (None, None)
        names = np.array([*model.languages, "und"], dtype=object)
        for batch in batches:
            flat, offsets = utf8(batch.column(1))
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            best, score = np.full(len(letters), len(model.languages)), np.zeros(len(letters))
            for a, b in slices(offsets, 1 << 20):
                for i in range(a, b if model.languages else a, ROWS):
                    j = min(b, i + ROWS)
                    best[i:j], score[i:j] = model.predict(model.margins(flat[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], table, weights))
            best, score = np.where(letters, best, len(model.languages)), np.where(letters, score, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(score.astype(float))], ["id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[0].dataType.simpleString()}, lang_pred string, score double")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7 over all documents: doc_id, held_out, lang_pred, score; learned from documents outside the held-out fold (see `fit`, `identify`)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.filter(~held_out(folds=4, fold=2)))
    return identify(docs, model).select("doc_id", held_out(folds=4, fold=2).alias("held_out"), "lang_pred", "score")
