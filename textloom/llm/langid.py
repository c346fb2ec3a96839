"""Language identification by a blended spectrum kernel, Nyström landmarks and one-versus-rest kernel ridge regression.

A text is the set of its character 1-, 2- and 3-grams over a folded alphabet of 64 signs. The kernel of two texts is the mean
over the orders of ``|common grams| / sqrt(|grams of one| * |grams of the other|)``. A bounded sample of labelled texts gives
``landmarks`` texts, whose kernel matrix is whitened into features, and ``per_lang * languages`` rows for ridge regressions,
one for each language against the rest. Scoring is, for a batch of texts, their presence matrix over the landmarks' grams
times the landmarks' matrix, times the weights.

The sample is bounded by ``most_rows``, or two rows for each language, whatever the table (the rows of least hash in each of
``per_lang`` buckets of a language). Every language is learned. There are ``landmarks`` landmarks, or one for each language, and at
most ``most_landmarks``: of more languages those of least hash give one. The regressions are solved for ``block`` languages at a
time; the model that goes to the executors has a number for each landmark and language, so it grows with the languages (2 KB
each at 256 landmarks), of which the labels of a corpus have thousands at most. Texts are read whole.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is every text if nothing is labelled.
Rows without a language or an id aren't learned from; a null id isn't held out. Repeated rows are predicted alike. An empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

ORDERS, BITS = (1, 2, 3), 6
STARTS = (0, 64, 64 + 4096)
SLOTS = 64 + 4096 + 262144
LETTERS = [*range(1, 27), *range(29, 64)]


@lru_cache(maxsize=1)
def alphabet() -> np.ndarray:
    """Code point -> sign: 0 white space, 1-26 a to z, 27 digits, 28 the rest, 29-63 other letters by their number."""

    def sign(c: int) -> int:
        x = chr(c)
        if x.isspace():
            return 0
        if not x.isalpha():
            return 27 if x.isdigit() else 28
        low = ord(x.lower()[0])
        return low - 96 if 97 <= low <= 122 else 29 + low * 2654435761 % 2**32 // 128 % 35

    return np.array([sign(c) for c in range(0x110000)], np.uint8)


def grams(text: str) -> list[np.ndarray]:
    """The slots of the grams of each order, with repeats."""
    signs = alphabet()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)
    pairs = signs[:-1] << BITS | signs[1:]
    return [signs, pairs + STARTS[1], (pairs[:-1] << BITS | signs[2:]) + STARTS[2]]


class Presence:
    """A reused array of which grams a text has."""

    def __init__(self) -> None:
        self.has = np.zeros(SLOTS, bool)

    def of(self, text: str) -> Iterator[tuple[np.ndarray, list[int]]]:
        """The presence of every slot, while it is looked at, and the number of grams of each order."""
        found = grams(text)
        for g in found:
            self.has[g] = True
        yield self.has, [int(np.count_nonzero(self.has[a:b])) for a, b in zip(STARTS, [*STARTS[1:], SLOTS])]
        for g in found:
            self.has[g] = False


@dataclass(frozen=True)
class Model:
    langs: list[str]
    slots: np.ndarray
    landmarks: np.ndarray  # slots x landmarks, scaled by the landmarks' sizes
    weights: np.ndarray  # landmarks x languages
    bias: np.ndarray


def landmark_matrix(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The slots that any landmark has, and a column for each landmark that a text's scaled presence is multiplied with."""
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=SLOTS) for p in packed])
    slots = np.flatnonzero(bits.any(axis=0))
    order = np.digitize(slots, STARTS[1:])
    sizes = np.stack([bits[:, a:b].sum(axis=1) for a, b in zip(STARTS, [*STARTS[1:], SLOTS])], axis=1)
    return slots, (bits[:, slots] / np.sqrt(np.maximum(sizes, 1))[:, order] / len(ORDERS)).T.astype(np.float32)


def kernel(texts: list[str], slots: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """texts x landmarks."""
    presence, order = Presence(), np.digitize(slots, STARTS[1:])
    rows = np.empty((len(texts), len(slots)), np.float32)
    for row, text in zip(rows, texts):
        for has, sizes in presence.of(text):
            row[:] = has[slots] / np.sqrt(np.maximum(sizes, 1)).astype(np.float32)[order]
    return rows @ landmarks


def held_out(folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, landmarks: int = 96, most_rows: int = 2048, ridge: float = 1e-3, most_landmarks: int = 512, block: int = 256) -> Model | None:
    """Learn from doc_id, text and lang of rows that aren't held out."""
    spark = docs.sparkSession
    known = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0))
    known = known.select("doc_id", "lang", "text")
    langs = sorted(r.lang for r in known.select("lang").distinct().collect())
    if not langs:
        return None
    per_lang = max(2, most_rows // len(langs))
    marked = set(sorted(langs, key=lambda x: zlib.crc32(x.encode()))[:most_landmarks])
    hashed = known.select("lang", "doc_id", F.xxhash64("doc_id").alias("h"))
    chosen = hashed.groupBy("lang", F.pmod("h", F.lit(per_lang)).alias("bucket")).agg(F.min(F.struct("h", "doc_id")).alias("least"))
    picked = sorted((r.lang, r.least.h, r.least.doc_id) for r in chosen.collect())
    rank, rows = {}, []
    for lang, _, doc_id in picked:
        rank[lang] = rank.get(lang, -1) + 1
        rows.append((doc_id, lang, lang in marked and rank[lang] < max(1, landmarks // len(langs))))
    ids = spark.createDataFrame(rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, landmark boolean")
    # rows that repeat an id and a language are one row of the sample, so it is bounded whatever repeats
    sample = known.join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("doc_id", "lang", "landmark").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = written(sample, "lang-sample")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        presence = Presence()
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bits": pa.array([np.packbits(has).tobytes() for t in batch.column(0).to_pylist() for has, _ in presence.of(t)], pa.binary())})

    packed = sorted(bytes(r.bits) for r in sample.filter("landmark").select("text").mapInArrow(pack, "bits binary").collect())
    slots, matrix = landmark_matrix(packed)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = kernel(batch.column(1).to_pylist(), slots, matrix).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(k, pa.list_(pa.float32()))], ["lang", "k"])

    seen = sorted((r.lang, r.k) for r in sample.select("lang", "text").mapInArrow(rows_of, "lang string, k array<float>").collect())
    k, names = np.array([x for _, x in seen], np.float64), [x for x, _ in seen]
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=SLOTS)[slots] for p in packed])
    order = np.digitize(slots, STARTS[1:])
    size = np.stack([np.maximum(bits[:, order == n].sum(axis=1), 1) for n in range(len(ORDERS))], axis=1)
    own = (bits / np.sqrt(size)[:, order]) @ matrix.astype(np.float64)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    good = values > 1e-8 * values[-1]
    whiten = vectors[:, good] / np.sqrt(values[good])
    phi = k @ whiten
    at = np.searchsorted(langs, names)
    share = len(names) / np.bincount(at, minlength=len(langs))[at]  # every language weighs as much
    share /= share.mean()
    mean = np.average(phi, axis=0, weights=share)
    centred = phi - mean
    weighted = (centred * share[:, None]).T
    matrix_of = weighted @ centred + ridge * len(names) * np.eye(phi.shape[1])
    weights, bias = [], []
    for a in range(0, len(langs), block):
        target = np.where(at[:, None] == np.arange(a, min(a + block, len(langs))), 1.0, -1.0)
        goal = np.average(target, axis=0, weights=share)
        beta = np.linalg.solve(matrix_of, weighted @ (target - goal))
        weights.append(whiten @ beta)
        bias.append(goal - mean @ beta)
    return Model(langs, slots, matrix, np.hstack(weights), np.concatenate(bias))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score; the language is predicted from the text alone."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            at = [i for i, t in enumerate(texts) if t and model is not None and any(c.isalpha() for c in t)]
            if at:
                s = kernel([texts[i] for i in at], model.slots, model.landmarks).astype(np.float64) @ model.weights + model.bias
                p = np.exp(3 * (s - s.max(axis=1, keepdims=True)))
                p /= p.sum(axis=1, keepdims=True)
                for i, best, row in zip(at, s.argmax(axis=1), p):
                    langs[i], scores[i] = model.langs[best], float(row[best])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs))
