"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of character n-grams (code points of the lower-cased text, a space before and after
it), each named by a 32-bit hash. From the labelled rows a feature's ratio r = log of (share of label 1 rows with
it / share of label 0 rows with it), smoothed by one row; logistic regression is fitted on the features times r.
The strongest features are kept and fitted again, so that a text of any length is scored by a scan for few n-grams.

The fit uses a bounded sample of labelled rows (`POSITIVES`, `NEGATIVES`, the first in the order of a hash of
the id), and of each of them at most `TEXT_FEATURES` features, those of the lowest hashes over its whole text: a very long text
takes part with as many as any other, and takes no other text's place. Every row is scored over its whole text. Labels, language, source and
id are not inputs of a score.

Defined results: null and empty texts score by the bias alone; repeated rows score alike; labels that are null, or of
rows that are missing, are not used; labels that contradict for an id count as 1; a fit without features (no row of one of the labels, or no n-gram in enough
rows) tells no texts apart and calls none toxic: every score is the share of label 1, 0.49 at most; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import fresh, names_free, row_ranges, strings, table, uniform

SIZES = (4, 6, 8)
#: Most labelled rows of each label that the fit uses.
POSITIVES, NEGATIVES = 1500, 2500
#: Most features (distinct n-grams) of one text that the fit takes in: some 5,000 characters have as many.
TEXT_FEATURES = 1 << 14
#: The highest score of a fit without features.
UNSURE = 0.49
#: Features of the final model, at most, and documents of the sample that a feature needs.
FEATURES, LEAST = 5_000, 3
FOLDS = 5
CHUNK = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22


def held_out(id_col: Column) -> Column:
    """The rows whose labels are never learnt from."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


# --- features ----------------------------------------------------------------------------------------------------


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, each between spaces, and their offsets."""
    padded = [f" {t.lower()} " for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in padded]))).astype(np.int64)
    return np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def grams(points: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...] = SIZES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: 32-bit hash and start of every n-gram that lies in one text."""
    for n in sizes:
        if len(points) < n:
            continue
        m = len(points) - n + 1
        h = np.full(m, np.uint64(n), np.uint64)
        for k in range(n):
            h *= _ODD
            h += points[k : k + m]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        inside = np.ones(m, bool)
        for k in range(1, n):
            crossing = offsets[1:-1] - k
            inside[crossing[(crossing >= 0) & (crossing < m)]] = False
        yield (h >> np.uint64(32)).astype(np.uint32), inside


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, int, list[str]]]:
    column = batch.column(name)
    _, offsets = strings(column)
    for a, b in row_ranges(offsets, CHUNK):
        yield a, b, [x or "" for x in column.slice(a, b - a).to_pylist()]


def _featured(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, _, texts in _texts(batch, "text"):
                for t in texts:
                    points, offsets = _points([t])
                    own = [h[inside] for h, inside in grams(points, offsets)]
                    # Hashes are uniform, so the lowest are as good a sample of the whole text's n-grams as any, and texts share it.
                    found.append(np.unique(np.concatenate(own))[:most].astype("<u4").tobytes() if own else b"")
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.binary())], names=["label", "features"])

    return run


# --- fit ---------------------------------------------------------------------------------------------------------


def _descend(rows: np.ndarray, cols: np.ndarray, scale: np.ndarray, y: np.ndarray, n_cols: int, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression by full-batch Adam on the entries (rows, cols), column c scaled by scale[c]; both labels weigh alike."""
    n = len(y)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, n - y.sum()))
    w, b = np.zeros(n_cols), 0.0
    m, v, mb, vb = np.zeros(n_cols), np.zeros(n_cols), 0.0, 0.0
    value = scale[cols]
    for t in range(1, steps + 1):
        z = np.bincount(rows, weights=w[cols] * value, minlength=n) + b
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gw = np.bincount(cols, weights=g[rows] * value, minlength=n_cols) + l2 * w
        gb = g.sum()
        rate = 0.05 / (1 + t / steps)
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-10)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-10)
    return w * scale, b


def _entries(features: list[np.ndarray], names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and place in names of each feature of a document that is among names."""
    rows, cols = [], []
    for i, f in enumerate(features):
        at = np.searchsorted(names, f)
        at[at == len(names)] = 0
        at = at[names[at] == f] if len(names) else at[:0]
        rows.append(np.full(len(at), i, np.int32))
        cols.append(at.astype(np.int32))
    return np.concatenate(rows), np.concatenate(cols)


def promising(documents: Callable[[], Iterable[tuple[int, np.ndarray]]], most: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each document's label and its features in the buckets of hashes that tell the labels apart most. The documents are gone
    through twice; counts per bucket take a fixed memory, which the names and counts of all features would not."""
    counts, n = np.zeros((2, 1 << _BITS), np.int32), [0, 0]
    shift = np.uint32(32 - _BITS)
    for one, f in documents():
        counts[one][np.unique(f >> shift)] += 1
        n[one] += 1
    n0, n1 = max(1, n[0]), max(1, n[1])
    strength = np.log(((counts[1] + np.float32(1)) / np.float32(n1 + 2)) / ((counts[0] + np.float32(1)) / np.float32(n0 + 2)))
    np.abs(strength, out=strength)
    strength *= np.sqrt(counts[1] / np.float32(n1) + counts[0] / np.float32(n0))
    del counts
    kept = strength > (np.partition(strength, -most)[-most] if most < len(strength) else 0)
    del strength
    for one, f in documents():
        yield one, f[kept[f >> shift]]


def log_count_ratios(y: np.ndarray, features: list[np.ndarray], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the features in at least so many rows, the rows and the label 1 rows with each, and the log of its share of label 1
    rows over its share of label 0 rows, one row more with and one without it in either."""
    n1, n0 = y.sum(), len(y) - y.sum()
    names, df = np.unique(np.concatenate(features), return_counts=True)
    names, df = names[df >= least], df[df >= least]
    found, n = np.unique(np.concatenate([f for f, one in zip(features, y, strict=True) if one]), return_counts=True)
    there = np.isin(found, names)
    df1 = np.zeros(len(names))
    df1[np.searchsorted(names, found[there])] = n[there]
    return names, df, df1, np.log(((df1 + 1) / (n1 + 2)) / ((df - df1 + 1) / (n0 + 2)))


def fit(labels: np.ndarray, features: list[np.ndarray], most: int = FEATURES, least: int = LEAST, l2: float = 1e-3, steps: int = 80) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted feature hashes, their weights and the bias."""
    y = np.asarray(labels, np.float64)
    none = (np.zeros(0, np.uint32), np.zeros(0))
    if not len(y) or y.min() == y.max():
        return *none, unsure(y)
    n1, n0 = y.sum(), len(y) - y.sum()
    names, df, df1, ratio = log_count_ratios(y, features, least)
    # Those that tell the labels apart most, by ratio and by how often they occur in either; after a fit, by weight.
    strength, weights, bias = np.abs(ratio) * np.sqrt(df1 / n1 + (df - df1) / n0), np.zeros(0), 0.0
    for keep in (most * 4, most):
        chosen = np.sort(np.argsort(-strength, kind="stable")[:keep])
        chosen = chosen[strength[chosen] > 0]
        names, df, ratio = names[chosen], df[chosen], ratio[chosen]
        weights, bias = _descend(*_entries(features, names), ratio, y, len(names), l2, steps)
        strength = np.abs(weights) * np.sqrt(df)
    return (names, weights, float(bias)) if len(names) else (*none, unsure(y))


def unsure(y: np.ndarray) -> float:
    """The bias of a fit without features."""
    share = min(float(y.mean()) if len(y) else 0.0, UNSURE)
    return float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -20, 20))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, positives: int, negatives: int) -> DataFrame:
    """At most the given rows of each label, outside the held-out fold: id and label."""
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    rows = rows.filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label")).withColumn("u", uniform("toxicity-1", F.col("id")))
    ones, zeros = (rows.filter(F.col("label") == k).orderBy("u", "id").limit(n) for k, n in ((1, positives), (0, negatives)))
    return ones.unionByName(zeros).select(F.col("id").cast("string").alias("id"), "label", "u")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positives: int = POSITIVES, negatives: int = NEGATIVES, text_features: int = TEXT_FEATURES) -> tuple[np.ndarray, np.ndarray, float]:
    names_free(docs, id_col, text_col)
    names_free(labels, id_col, label_col)
    # The sample has at most positives + negatives rows, whatever the input: it may be broadcast.
    chosen = sample(docs, labels, id_col, label_col, positives, negatives)
    rows = docs.select(F.col(id_col).cast("string").alias("doc"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("doc") == F.col("id"))
    # The sample's features are fitted by one task: they are bounded, and the driver gets the model alone.
    kept = rows.select("text", "label").mapInArrow(_featured(text_features), "label int, features binary").withColumn("all", F.lit(0))
    found = kept.groupBy("all").applyInArrow(_fitted, "names binary, weights binary, bias double").first()
    if found is None:
        return np.zeros(0, np.uint32), np.zeros(0), unsure(np.zeros(0))
    return np.frombuffer(bytes(found["names"]), "<u4"), np.frombuffer(bytes(found["weights"]), "<f8"), found["bias"]


def _fitted(rows: pa.Table) -> pa.Table:
    documents = [(y, np.frombuffer(x.as_buffer(), "<u4")) for y, x in zip(rows.column("label").to_pylist(), rows.column("features"), strict=True)]
    # In an order of their own, so that a fit does not depend on how the rows were dealt out.
    documents.sort(key=lambda x: (x[0], len(x[1]), x[1][:64].tobytes()))
    few = list(promising(lambda: documents, FEATURES * 16))
    names, weights, bias = fit(np.array([y for y, _ in few]), [f for _, f in few])
    return pa.table({"names": pa.array([names.astype("<u4").tobytes()], pa.binary()), "weights": pa.array([weights.astype("<f8").tobytes()], pa.binary()), "bias": pa.array([bias], pa.float64())})


# --- scores ------------------------------------------------------------------------------------------------------


def score_texts(texts: list[str], names: np.ndarray, weights: np.ndarray, bias: float, seen: np.ndarray | None = None) -> np.ndarray:
    if seen is None:
        seen = seen_bits(names)
    points, offsets = _points(texts)
    z = np.full(len(texts), bias)
    shift = np.uint32(32 - _BITS)
    for h, inside in grams(points, offsets):
        at = np.flatnonzero(seen[h >> shift] & inside)
        key = h[at]
        where = np.searchsorted(names, key)
        where[where == len(names)] = 0
        hit = names[where] == key if len(names) else np.zeros(len(key), bool)
        at, where = at[hit], where[hit]
        row = np.searchsorted(offsets, at, "right") - 1
        once = np.unique(row * len(names) + where)
        z += np.bincount(once // len(names), weights=weights[once % len(names)], minlength=len(texts)) if len(once) else 0
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def seen_bits(names: np.ndarray) -> np.ndarray:
    seen = np.zeros(1 << _BITS, bool)
    seen[names >> np.uint32(32 - _BITS)] = True
    return seen


def with_score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text", name: str = "score") -> DataFrame:
    """All columns of docs and the score; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES entries at most

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights, bias = shared.value
        seen = seen_bits(names)
        for batch in batches:
            z = [score_texts(texts, names, weights, bias, seen) for _, _, texts in _texts(batch, text_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(z) if z else np.zeros(0))], names=[*batch.schema.names, name])


    return docs.mapInArrow(scored, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that are not predicted toxic."""
    (name,) = fresh(docs, "_toxicity")
    return with_score(docs, train(docs, labels), name=name).filter(F.col(name) < threshold).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = with_score(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
