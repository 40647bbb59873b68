"""Operator 13: language identification by nearest centroids of TF-IDF character n-grams, with distance-based rejection.

Features: letters in lower case, every run of other characters as one blank; n-grams of 1 to 3 characters hashed to FEATURES
cells; weight (1 + ln count) * idf, scaled to length 1. Document frequencies are counted over all documents that may be
learned from. Centroids are fitted on a bounded sample: at most SAMPLE documents per language, those with the smallest hashes
of their ids; spherical k-means finds CENTROIDS of them per language, one Spark job per round.

A text gets the language of the centroid with the largest cosine. Its ``rejected`` flag says that the cosine is below what
all but REJECT of the sample's documents of its length class (a power of two of n-grams) reach, times SLACK: the text looks like no
learned language, though the nearest one is still named. The score is the softmax share of the nearest language at TEMPERATURE
times, if rejected, the ratio of the cosine to that bound.

Whole texts are read, long ones in slices that overlap by two characters. What goes out with the tasks is the model: FEATURES
numbers per centroid, whatever the corpus.

Cases: null texts and texts without a letter are ``und`` with score 0 and not rejected; null and repeated ids are rows of
their own, null ids are neither held out nor learned from; texts that are learned from without letters count for nothing;
without any labelled text all rows are ``und``; languages tie by code point order; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import freed, lookup_join, pick, staged
from gridloom.llm.tokens import byte_batches

FEATURES = 2**14
CENTROIDS = 3
ROUNDS = 4
#: Documents per language that centroids are fitted on.
SAMPLE = 2000
REJECT = 0.005
SLACK = 0.9
TEMPERATURE = 0.03
SLICE = 1 << 20
UNKNOWN = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """By code point: its lower-case letter, 0 for all that are no letters."""
    if not _letters:
        _letters.append(np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in range(0x110000)], dtype=np.uint32))
    return _letters[0]


def counts(text: str) -> np.ndarray | None:
    """Number of n-grams per cell; None if the text has no letter."""
    total, any_letter, carry = None, False, np.zeros(1, dtype=np.uint64)
    for at in range(0, len(text), SLICE):
        codes = letters()[np.frombuffer(text[at : at + SLICE].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].astype(np.uint64)
        final = at + SLICE >= len(text)
        codes = np.concatenate([carry, codes, np.zeros(1 if final else 0, dtype=np.uint64)])
        keep = np.ones(len(codes), dtype=bool)
        keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0)
        codes = codes[keep]
        any_letter |= bool(codes.any())
        new = 1 if at == 0 else min(2, len(carry))  # places that an earlier slice has counted
        two = codes[:-1] | codes[1:] << np.uint64(21)
        three = two[:-1] | codes[2:] << np.uint64(42)
        one = codes[new:]
        grams = np.concatenate([one[one > 0], two[max(0, new - 1) :], three[max(0, new - 2) :]])
        part = np.bincount((grams * _MIX >> np.uint64(64 - FEATURES.bit_length() + 1)).astype(np.int64), minlength=FEATURES)
        total = part if total is None else total + part
        carry = codes[-2:]
    return total if any_letter else None


def vector(n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells and weights of length 1."""
    ids = np.flatnonzero(n)
    w = (1.0 + np.log(n[ids])) * idf[ids]
    return ids, w / math.sqrt(float(w @ w))


def length_class(grams: int) -> int:
    return int(grams).bit_length()


def may_learn(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(False))


def _frequencies(batches):
    df, n = np.zeros(FEATURES, dtype=np.int64), 0
    for batch in byte_batches(batches, 0):
        for text in batch.column(0).to_pylist():
            found = counts(text)
            if found is not None:
                df += found > 0
                n += 1
    ids = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(ids, -1), pa.int32()), pa.array(np.append(df[ids], n), pa.int64())], names=["cell", "n"])


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """idf per cell over all rows of ``texts`` (text). A task sends at most FEATURES rows; their sums come to the driver."""
    found = texts.mapInArrow(_frequencies, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    df, total = np.zeros(FEATURES), 0
    for r in found:
        if r["cell"] < 0:
            total = r["n"]
        else:
            df[r["cell"]] = r["n"]
    return (np.log((1.0 + total) / (1.0 + df)) + 1.0).astype(np.float32)


def _vectors(idf: np.ndarray):
    def run(batches):
        for batch in byte_batches(batches, 1):
            langs, cells, weights, grams, hashes = [], [], [], [], []
            for lang, text, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = counts(text)
                if n is not None:
                    ids, w = vector(n, idf)
                    langs.append(lang)
                    cells.append(ids)
                    weights.append(w)
                    grams.append(int(n.sum()))
                    hashes.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(cells, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.float64())), pa.array(grams, pa.int64()), pa.array(hashes, pa.int64())], names=["lang", "cells", "weights", "grams", "h"])

    return run


class Model:
    """Languages in code point order, CENTROIDS or fewer rows of ``centroids`` for each, idf, and the least cosine by length class."""

    def __init__(self, langs: list[str], owner: np.ndarray, centroids: np.ndarray, idf: np.ndarray, least: dict[int, float] | None = None):
        self.langs, self.owner, self.idf, self.least = langs, owner, idf, least or {}
        self.by_cell = np.ascontiguousarray(centroids.T.astype(np.float32))

    def cosines(self, ids: np.ndarray, w: np.ndarray) -> np.ndarray:
        return w.astype(np.float32) @ self.by_cell[ids]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        n = counts(text) if text and self.langs else None
        if n is None:
            return UNKNOWN, 0.0, False
        cos = self.cosines(*vector(n, self.idf))
        best = np.full(len(self.langs), -1.0)
        np.maximum.at(best, self.owner, cos)
        top = int(best.argmax())
        share = 1.0 / float(np.exp((best - best[top]) / TEMPERATURE).sum())
        bound = self._bound(length_class(int(n.sum())))
        rejected = bool(best[top] < bound)
        return self.langs[top], min(1.0, max(0.0, share * (float(best[top]) / bound if rejected else 1.0))), rejected

    def _bound(self, cls: int) -> float:
        """That of the class, or of the nearest shorter one; half of the shortest one's below all."""
        shorter = [c for c in self.least if c <= cls]
        return self.least[max(shorter)] if shorter else 0.5 * self.least[min(self.least)] if self.least else 0.0


def _sample(docs: DataFrame, size: int) -> DataFrame:
    """At most ``size`` rows (lang, text, h) per language. A share of each language that surely holds them is drawn by hash
    first, so the window that numbers them sees a bounded number of rows per language."""
    sizes = staged(docs.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")), "langs")
    drawn = lookup_join(docs, sizes, "lang", "inner").withColumn("_u", F.pmod("h", F.lit(2**40)) / float(2**40))
    near = drawn.filter(F.col("_u") * F.col("_n") <= 1.5 * size + 200)
    return near.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_u", "h"))).filter(F.col("_r") <= size).select("lang", "text", "h")


def _grouping(model: Model):
    """Per task one dense sum for each centroid that it assigns vectors to."""

    def run(batches):
        sums = np.zeros((len(model.owner), FEATURES))
        n = np.zeros(len(model.owner), dtype=np.int64)
        own = {lang: np.flatnonzero(model.owner == i) for i, lang in enumerate(model.langs)}
        for batch in batches:
            for lang, ids, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, w, mine = np.array(ids), np.array(w), own[lang]
                at = mine[int(model.cosines(ids, w)[mine].argmax())]
                sums[at, ids] += w
                n[at] += 1
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), pa.array([sums[i].tobytes() for i in used], pa.binary())], names=["centroid", "n", "s"])

    return run


def _added(pdf):
    import pandas as pd

    total = np.sum([np.frombuffer(s) for s in sorted(pdf["s"])], axis=0)
    return pd.DataFrame({"centroid": pdf["centroid"].iloc[:1], "n": [pdf["n"].sum()], "s": [total.tobytes()]})


def _cosines(model: Model):
    def run(batches):
        own = {lang: np.flatnonzero(model.owner == i) for i, lang in enumerate(model.langs)}
        for batch in batches:
            found = [(length_class(g), float(model.cosines(np.array(ids), np.array(w))[own[lang]].max())) for lang, ids, w, g in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int32()), pa.array([x for _, x in found], pa.float64())], names=["cls", "cos"])

    return run


def fit(docs: DataFrame, centroids: int = CENTROIDS, sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """A model from the rows of ``docs`` (doc_id, text, lang) that may be learned from."""
    d = pick(docs, doc_id="long", text="string", lang="string").filter(may_learn(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    d = d.select("lang", "text", F.xxhash64(F.lit(13), "doc_id").alias("h"))
    idf = inverse_frequencies(d.select("text"))
    vectors = staged(_sample(d, sample).mapInArrow(_vectors(idf), "lang string, cells array<int>, weights array<double>, grams long, h long"), "vectors")
    order = Window.partitionBy("lang").orderBy(F.col("grams") < 100, "h")  # at most ``sample`` rows; longer texts first
    seeds = vectors.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= centroids).orderBy("lang", "_r").collect()
    langs = sorted({r["lang"] for r in seeds})
    owner = np.array([langs.index(r["lang"]) for r in seeds], dtype=np.int64)
    points = np.zeros((len(seeds), FEATURES))
    for i, r in enumerate(seeds):
        points[i, r["cells"]] = r["weights"]
    model = Model(langs, owner, points, idf)
    for _ in range(rounds if langs else 0):
        sums = vectors.select("lang", "cells", "weights").mapInArrow(_grouping(model), "centroid int, n long, s binary")
        for r in sums.groupBy("centroid").applyInPandas(_added, "centroid int, n long, s binary").collect():  # one row per centroid
            total = np.frombuffer(r["s"])
            points[r["centroid"]] = total / math.sqrt(float(total @ total))
        model = Model(langs, owner, points, idf)
    near = vectors.select("lang", "cells", "weights", "grams").mapInArrow(_cosines(model), "cls int, cos double")
    least = {r["cls"]: SLACK * r["q"] for r in near.groupBy("cls").agg(F.percentile("cos", F.lit(REJECT)).alias("q")).collect()} if langs else {}
    freed(vectors)
    return Model(langs, owner, points, idf, least)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected for each row of ``docs``. A map, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in byte_batches(batches, 1):
            found = [shared.value.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op13_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return identify(docs, fit(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
