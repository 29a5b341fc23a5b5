"""Shapley values of fitted trees: how much each feature moves each row's prediction, by the trees' own counts.

Where features of a set are not known, a tree follows both branches in the proportion of its training weight (path-dependent values). A leaf is a box in
its path's features with a value, so its part in a feature's value is a sum over subsets of its path, which depends on their sizes alone: the
coefficients of a product of one linear factor a feature. The cost is leaves times the square of their depth, however many
features a model has. Nodes come from the model as it is saved; rows are worked on in Arrow batches, and no row meets another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.supervised import FEATURES
from tidemark.sources.files import shared_folder

#: Leaves times rows that are worked on at once.
CELLS = 1 << 20


@dataclass
class Boxes:
    """Leaves whose paths have d different features: value, and for each of them feature, bounds (lo, hi] and share of the training weight."""

    value: np.ndarray
    feature: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    share: np.ndarray


def saved_nodes(model: PipelineModel) -> list[dict]:
    """The nodes of all trees of a pipeline's last stage: depth and number of trees bound them, whatever the model was fitted on."""
    spark = SparkSession.active()
    path = f"{shared_folder(spark)}/trees-{model.uid}"
    model.stages[-1].write().overwrite().save(path)
    d, s = F.col("nodeData"), F.col("nodeData.split")
    rows = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), d["id"].alias("id"), d["prediction"].alias("prediction"), d["impurityStats"].alias("stats"), d["leftChild"].alias("left"), d["rightChild"].alias("right"), s["featureIndex"].alias("feature"), s["leftCategoriesOrThreshold"].alias("cut"), s["numCategories"].alias("categories"))
    found = [r.asDict() for r in rows.collect()]
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return found


def boxes(nodes: list[dict], weights: list[float], by_class: bool) -> list[Boxes]:
    """The leaves of all trees by the number of features on their paths. With by_class a node's statistics are the weights of its classes, and its value is
    the share of class 1; otherwise they begin with its weight, and its value is its prediction."""
    leaves: dict[int, list] = {}
    trees: dict[int, dict[int, dict]] = {}
    for n in nodes:
        trees.setdefault(n["tree"], {})[n["id"]] = n
    weight_of = lambda n: sum(n["stats"]) if by_class else n["stats"][0]
    for t, own in trees.items():
        todo = [(0, {})]
        while todo:
            at, path = todo.pop()
            n = own[at]
            if n["left"] < 0:
                value = n["stats"][1] / max(sum(n["stats"]), 1e-300) if by_class else n["prediction"]
                leaves.setdefault(len(path), []).append((value * weights[t], path))
                continue
            if n["categories"] != -1:
                raise ValueError("only numeric features have Shapley values here")
            f, cut = n["feature"], n["cut"][0]
            lo, hi, share = path.get(f, (-math.inf, math.inf, 1.0))
            for child, box in ((n["left"], (lo, min(hi, cut))), (n["right"], (max(lo, cut), hi))):
                todo.append((child, {**path, f: (*box, share * weight_of(own[child]) / max(weight_of(n), 1e-300))}))
    out = []
    for d, found in sorted(leaves.items()):
        part = lambda k: np.array([[b[k] for b in path.values()] for _, path in found], float).reshape(len(found), d)  # noqa: E731, B023
        out.append(Boxes(np.array([v for v, _ in found]), np.array([list(path) for _, path in found], int).reshape(len(found), d), part(0), part(1), part(2)))
    return out


def expected(leaves: list[Boxes]) -> float:
    """The mean prediction by the trees' counts, from which the values of a row lead to its own."""
    return float(sum((b.value * b.share.prod(axis=1)).sum() for b in leaves))


def between_cuts(x: np.ndarray, leaves: list[Boxes]) -> tuple[np.ndarray, np.ndarray]:
    """The first of the rows of each kind, and the kind of each row. Rows of a kind lie between the same cuts in all features, so no tree tells them apart;
    no number lies behind all cuts."""
    kinds = np.zeros(x.shape, np.int64)
    for f in range(x.shape[1]):
        ends = [v[b.feature == f] for b in leaves if b.feature.size for v in (b.lo, b.hi)]
        cuts = np.unique(np.concatenate([np.zeros(0), *ends]))
        kinds[:, f] = np.searchsorted(cuts[np.isfinite(cuts)], x[:, f], "left")
    _, first, kind = np.unique(kinds, axis=0, return_index=True, return_inverse=True)
    return first, kind.ravel()


def shapley(x: np.ndarray, leaves: list[Boxes]) -> np.ndarray:
    """Rows by features: values that add up to the row's prediction less the expected one. Each kind of rows is worked on once."""
    if not len(x):
        return np.zeros(x.shape)
    first, kind = between_cuts(x, leaves)
    return _shapley(x[first], leaves)[kind]


def _shapley(x: np.ndarray, leaves: list[Boxes]) -> np.ndarray:
    out = np.zeros(x.shape)
    for b in leaves:
        n, d = b.feature.shape
        if d == 0:
            continue
        sizes = np.array([math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)])
        step = max(1, CELLS // max(n, 1))
        for r in range(0, len(x), step):
            rows = x[r : r + step]
            # By Spark's rule a value that is no number goes right: it is inside unless a bound holds it on the left.
            inside = [((~(rows[:, b.feature[:, k]] <= b.lo[:, k]) | np.isneginf(b.lo[:, k])) & ((rows[:, b.feature[:, k]] <= b.hi[:, k]) | np.isinf(b.hi[:, k]))).astype(float) for k in range(d)]
            for i in range(d):
                # Coefficient k: over all subsets of k other features, those inside times the shares of the rest.
                coefficient = [np.ones((len(rows), n))]
                for j in range(d):
                    if j == i:
                        continue
                    z, o = b.share[:, j], inside[j]
                    grown = [c * z for c in coefficient] + [np.zeros((len(rows), n))]
                    for k, c in enumerate(coefficient):
                        grown[k + 1] += c * o
                    coefficient = grown
                part = sum(w * c for w, c in zip(sizes, coefficient, strict=True)) * (inside[i] - b.share[:, i]) * b.value
                for f in np.unique(b.feature[:, i]):
                    out[r : r + step, f] += part[:, b.feature[:, i] == f].sum(axis=1)
    return out


def model_leaves(model: PipelineModel) -> list[Boxes]:
    """For a forest values are the share of label 1, for boosting the raw margin (the probability is 1 / (1 + exp(-2 margin)))."""
    last = model.stages[-1]
    by_class = last.hasParam("subsamplingRate") and not last.hasParam("stepSize")
    weights = list(last.treeWeights)
    return boxes(saved_nodes(model), [w / sum(weights) for w in weights] if by_class else weights, by_class)


def shapley_values(model: PipelineModel, df: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """df with phi_<feature>, phi_base (the same in all rows) and phi_sum, their sum: what the trees say of the row. Null features count as no number, as
    the model takes them."""
    leaves = model_leaves(model)
    base = expected(leaves)
    shared = df.sparkSession.sparkContext.broadcast(leaves)  # bounded by depth and number of trees
    names = [f"phi_{f}" for f in features]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            phi = shapley(rows[list(features)].to_numpy(float), shared.value)
            yield pd.concat([rows, pd.DataFrame(phi, columns=names, index=rows.index).assign(phi_base=base, phi_sum=base + phi.sum(axis=1))], axis=1)

    schema = StructType(list(df.schema.fields))
    for name in (*names, "phi_base", "phi_sum"):
        schema = schema.add(name, "double")
    return df.mapInPandas(run, schema)


def ranked(values: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """feature, mean_abs and mean of its values over all rows, and place by the first; one pass, a row a feature."""
    sums = values.agg(*[x for f in features for x in (F.avg(F.abs(f"phi_{f}")).alias(f"a_{f}"), F.avg(f"phi_{f}").alias(f"m_{f}"))])
    rows = sums.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.round(f"a_{f}", 6).alias("mean_abs"), F.round(f"m_{f}", 6).alias("mean")) for f in features])).alias("x")).select("x.*")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("mean_abs"), "feature")))  # a row a feature
