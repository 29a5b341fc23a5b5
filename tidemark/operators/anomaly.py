"""Unsupervised models: isolation forest over messages, density clusters over users."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.operators.graph import components
from tidemark.sources.files import scratch, stored

# What messages and users are compared by.
MESSAGE_FEATURES = ("sentiment_polarity", "sentiment_subjectivity", "urgency_score", "readability_flesch", "lexical_diversity", "function_word_ratio", "noun_ratio", "verb_ratio", "caps_ratio", "exclamation_ratio")
USER_FEATURES = ("avg_drift_score", "max_drift_score", "flagged_message_rate")


def standardized(df: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """s_<feature>: null as 0, mean 0 and population deviation 1; constant features become 0."""
    df = df.na.fill(0.0, list(features))
    moments = df.agg(*[x for f in features for x in (F.avg(f).alias(f"_m_{f}"), F.stddev_pop(f).alias(f"_s_{f}"))])
    out = df.join(F.broadcast(moments))  # one row
    out = out.withColumns({f"s_{f}": F.coalesce((F.col(f) - F.col(f"_m_{f}")) / F.nullif(f"_s_{f}", F.lit(0.0)), F.lit(0.0)) for f in features})
    return out.drop(*[f"_{k}_{f}" for f in features for k in "ms"])


# --- isolation forest --------------------------------------------------------------------------------------------


def _path_norm(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n keys."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow_tree(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature (-1 in a leaf), cut, left child (right is next to it) and path length of each node."""
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    feature, cut, child, depth = [-1], [0.0], [0], [0.0]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        node, rows, d = todo.pop()
        spread = np.flatnonzero(x[rows].max(axis=0) > x[rows].min(axis=0)) if len(rows) > 1 else []
        if d >= limit or not len(spread):
            depth[node] = d + float(_path_norm(len(rows)))
            continue
        f = int(rng.choice(spread))
        at = rng.uniform(x[rows, f].min(), x[rows, f].max())
        left = x[rows, f] <= at
        feature[node], cut[node], child[node] = f, at, len(feature)
        for part in (rows[left], rows[~left]):
            todo.append((len(feature), part, d + 1))
            feature.append(-1), cut.append(0.0), child.append(0), depth.append(0.0)
    return np.array(feature), np.array(cut), np.array(child), np.array(depth)


def forest_scores(x: np.ndarray, trees: list[tuple], rows: int) -> np.ndarray:
    """2 ** -(mean path / norm): near 1 for rows that are cut off early."""
    total = np.zeros(len(x))
    for feature, cut, child, depth in trees:
        node = np.zeros(len(x), int)
        while (inner := feature[node] >= 0).any():
            i = np.flatnonzero(inner)
            n = node[i]
            node[i] = child[n] + (x[i, feature[n]] > cut[n])
        total += depth[node]
    return 2.0 ** -(total / len(trees) / max(float(_path_norm(rows)), 1e-9))


#: A model is a table: the nodes of all trees.
NODES = "tree long, node int, feature int, cut double, child int, depth double, rows long"


def fit_forest(df: DataFrame, features: tuple[str, ...], settings: Settings, id_col: str = "id") -> DataFrame:
    """The nodes of the trees, each of which is grown by a task of its own from its rows of a sample that is uniform over rows, in the order of a hash of the
    id: tree t has the rows from t times `tree_rows` on, beginning anew at the end. A written table."""
    cap = settings.trees * settings.tree_rows
    values = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"x{k}") for k, f in enumerate(features)]
    xs = [f"x{k}" for k in range(len(features))]
    with scratch() as work:
        sample = stored(df.select(F.xxhash64(F.lit(settings.seed), id_col).alias("k"), *values).orderBy("k", *xs).limit(cap))
        n = sample.count()
        if not n:
            return work.keep(stored(sample.sparkSession.createDataFrame([], NODES)))
        # At most trees x tree_rows rows, whatever the table is.
        numbered = sample.withColumn("j", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("k", *xs)) - 1).drop("k")
        rows = min(settings.tree_rows, n)
        places = sample.sparkSession.range(settings.trees * rows).select(F.floor(F.col("id") / rows).alias("tree"), (F.col("id") % n).alias("of"))
        dealt = places.join(numbered, F.col("of") == F.col("j")).select("tree", "j", *xs)
        return work.keep(stored(dealt.groupBy("tree").applyInPandas(_grown(xs, settings.seed), NODES)))


def _grown(xs: list[str], seed: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("j")
        tree = int(rows["tree"].iloc[0])
        feature, cut, child, depth = grow_tree(rows[xs].to_numpy(float), np.random.default_rng((seed, tree)))
        return pd.DataFrame({"tree": tree, "node": np.arange(len(feature)), "feature": feature, "cut": cut, "child": child, "depth": depth, "rows": len(rows)})

    return run


def save_forest(nodes: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(path)


def load_forest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NODES).parquet(path)


def _trees(nodes: DataFrame) -> tuple[list[tuple], int]:
    """The model in arrays: twice as many nodes at most as trees have rows."""
    rows = nodes.orderBy("tree", "node").toPandas()
    return [tuple(t[c].to_numpy() for c in ("feature", "cut", "child", "depth")) for _, t in rows.groupby("tree")], int(rows["rows"].max()) if len(rows) else 0


def isolation_forest(df: DataFrame, features: tuple[str, ...] = MESSAGE_FEATURES, settings: Settings | None = None, id_col: str = "id", model: DataFrame | None = None) -> DataFrame:
    """anomaly_score and is_anomaly, which holds for the given share of rows; by a model that was saved, if one is given."""
    s = settings or Settings()
    features = tuple(f for f in features if f in df.columns)
    trees, rows = _trees(fit_forest(df, features, s, id_col) if model is None else model)
    if not trees:
        return df.withColumns({"anomaly_score": F.lit(0.0), "is_anomaly": F.lit(False)})
    shared = df.sparkSession.sparkContext.broadcast((trees, rows))  # bounded by trees and their rows

    def score(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        trees, rows = shared.value
        for columns in parts:
            yield pd.Series(forest_scores(np.column_stack([c.to_numpy(float) for c in columns]), trees, rows))

    from pyspark.sql.functions import pandas_udf

    scorer = pandas_udf(score, "double")
    scorer.func.__annotations__ = {}
    # Written: the cut and the rows read one pass over the trees.
    scored = stored(df.withColumn("_raw", scorer(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])))
    cut_at = scored.agg(F.percentile_approx("_raw", 1 - s.contamination, 10_000).alias("_at"))
    out = scored.join(F.broadcast(cut_at))  # one row
    return out.withColumns({"anomaly_score": F.col("_raw") - F.col("_at"), "is_anomaly": F.col("_raw") > F.col("_at")}).drop("_raw", "_at")


# --- density clusters --------------------------------------------------------------------------------------------
# Points lie in cells so small that all points of a cell are neighbours, so a cell with enough points is all core points and one cluster.
# Only the few points of the other cells look around themselves, and clusters are joined cell by cell: no pairs of points are written.

#: Core points of a cell that are compared with as many of another at once.
POINTS = 2000


def _side(dims: tuple[str, ...], eps: float) -> float:
    return eps / math.sqrt(len(dims)) * (1 - 1e-9)


def _cells(n: int) -> list[str]:
    return [f"c{k}" for k in range(n)]


def _located(users: DataFrame, dims: tuple[str, ...], eps: float) -> DataFrame:
    """user, standardised coordinates x0, x1, ... and cell c0, c1, ..."""
    points = standardized(users, dims).select("user", *[F.col(f"s_{d}").alias(f"x{k}") for k, d in enumerate(dims)])
    return stored(points.withColumns({f"c{k}": F.floor(F.col(f"x{k}") / _side(dims, eps)) for k in range(len(dims))}))


def _around(rows: DataFrame, n: int, half: bool = False) -> DataFrame:
    """Each row in each cell that may hold points within eps of its own, d0, d1, ...; half of them if pairs of cells are wanted once, without the own."""
    reach = range(-math.ceil(math.sqrt(n)), math.ceil(math.sqrt(n)) + 1)
    steps = [o for o in itertools.product(reach, repeat=n) if sum(max(abs(x) - 1, 0) ** 2 for x in o) <= n and (not half or o > (0,) * n)]
    rows = rows.withColumn("_o", F.explode(F.array(*[F.array(*map(F.lit, o)) for o in steps])))
    return rows.withColumns({f"d{k}": F.col(f"c{k}") + F.col("_o")[k] for k in range(n)}).drop("_o")


def _distance(a: str, b: str, n: int) -> Column:
    square = lambda k: F.pow(F.col(f"{a}{k}") - F.col(f"{b}{k}"), F.lit(2))
    return F.sqrt(sum((square(k) for k in range(1, n)), square(0)))


def _in_cells(left: DataFrame, right: DataFrame, n: int) -> DataFrame:
    """Rows of left with the rows of right in the cell d0, d1, ...; right's columns get a leading r."""
    other = right.select(*[F.col(c).alias(f"r{c}") for c in right.columns])
    on = F.lit(True)
    for k in range(n):
        on = on & (F.col(f"d{k}") == F.col(f"rc{k}"))
    return left.join(other, on)


def core_points(points: DataFrame, n: int, eps: float, least: int) -> tuple[DataFrame, DataFrame]:
    """The core points (with enough neighbours, themselves included), and the others, which all lie in cells of few points."""
    sizes = points.groupBy(*_cells(n)).agg(F.count("*").alias("n"))
    placed = stored(points.join(sizes, _cells(n)))
    few = placed.filter(F.col("n") < least)
    near = _in_cells(_around(few, n), points, n).filter(_distance("x", "rx", n) <= eps)
    enough = stored(near.groupBy(F.col("user").alias("_u")).agg(F.count("*").alias("_near")).filter(F.col("_near") >= least).select("_u"))
    some = few.join(enough, F.col("user") == F.col("_u"), "left_semi")
    return stored(placed.filter(F.col("n") >= least).unionByName(some).drop("n")), stored(few.join(enough, F.col("user") == F.col("_u"), "left_anti").drop("n"))


def dbscan_noise(users: DataFrame, dims: tuple[str, ...] = USER_FEATURES, settings: Settings | None = None) -> DataFrame:
    """is_noise: no core point within eps."""
    s, n = settings or Settings(), len(dims)
    core, others = core_points(_located(users, dims, s.dbscan_eps), n, s.dbscan_eps, s.dbscan_least)
    border = _in_cells(_around(others, n), core, n).filter(_distance("x", "rx", n) <= s.dbscan_eps)
    near = core.select("user").unionByName(border.select("user").distinct()).withColumn("_near", F.lit(True))
    return users.join(near, "user", "left").withColumn("is_noise", F.col("_near").isNull()).drop("_near")


def labelled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and label, the least node of its component, for all nodes."""
    found = components(edges).withColumnRenamed("node", "of")
    return nodes.join(found, F.col("node") == F.col("of"), "left").select("node", F.coalesce("label", "node").alias("label"))


def _touching(n: int, eps: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """The pair of cells, if any of the points of one is within eps of any of the other's."""
        x = rows[[f"x{k}" for k in range(n)]].to_numpy()
        a, b = x[rows["first"].to_numpy()], x[~rows["first"].to_numpy()]
        for k in range(0, len(a), 256):  # ends with the first that is near
            square = (a[k : k + 256, None, 0] - b[None, :, 0]) ** 2
            for d in range(1, n):
                square = square + (a[k : k + 256, None, d] - b[None, :, d]) ** 2
            if (np.sqrt(square) <= eps).any():
                return rows[["a", "b"]].head(1)
        return rows[["a", "b"]].head(0)

    return run


def cell_links(pairs: DataFrame, members: DataFrame, n: int, eps: float, block: int | None = None) -> DataFrame:
    """The pairs (a, b) of cells in which a core point of one lies within eps of one of the other. Only points within eps of the other cell's
    box are compared, in blocks of a bounded number of them."""
    block = block or POINTS
    outside = lambda k, side: F.greatest(F.col(f"lo_{side}{k}") - F.col(f"x{k}"), F.col(f"x{k}") - F.col(f"hi_{side}{k}"), F.lit(0.0))
    sides = []
    for own, other in (("a", "b"), ("b", "a")):
        gap = F.sqrt(sum((F.pow(outside(k, other), F.lit(2)) for k in range(1, n)), F.pow(outside(0, other), F.lit(2))))
        rows = pairs.join(members, F.col(own) == F.col("cell")).filter(gap <= eps * (1 + 1e-9))
        rows = rows.withColumn(f"block_{own}", F.pmod(F.xxhash64("user"), F.ceil(F.col(f"n_{own}") / block)))
        rows = rows.withColumn(f"block_{other}", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(f"n_{other}") / block) - 1)))
        sides.append(rows.select("a", "b", "block_a", "block_b", F.lit(own == "a").alias("first"), *[f"x{k}" for k in range(n)]))
    both = sides[0].unionByName(sides[1])
    schema = pairs.select("a", "b").schema
    return both.groupBy("a", "b", "block_a", "block_b").applyInPandas(_touching(n, eps), schema).distinct()


def dbscan(users: DataFrame, dims: tuple[str, ...] = USER_FEATURES, settings: Settings | None = None) -> DataFrame:
    """cluster (-1 for noise) and is_outlier_cluster. A cell of core points is in one cluster; cells are joined where their first core points
    are near, and the clusters that this makes are joined where any core points of neighbouring cells are. A border point joins the
    least cluster near it; clusters are numbered by their first core point."""
    s = settings or Settings()
    with scratch() as work:
        root = work.keep(_rooted(users, dims, s.dbscan_eps, s.dbscan_least))
    number = root.select("root").distinct().select(F.col("root"), (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("root")) - 1).alias("cluster"))  # a row a cluster
    out = users.join(root.join(number, "root").drop("root"), "user", "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))
    return out.withColumn("is_outlier_cluster", F.col("cluster") == -1)


def _rooted(users: DataFrame, dims: tuple[str, ...], eps: float, least: int) -> DataFrame:
    """user and root, the first core point of the cluster, for all users in one; a written table."""
    n = len(dims)
    core, others = core_points(_located(users, dims, eps), n, eps, least)
    xs = [f"x{k}" for k in range(n)]
    ends = [f(x).alias(f"{name}_{k}") for k, x in enumerate(xs) for name, f in (("lo", F.min), ("hi", F.max))]
    cells = core.groupBy(*_cells(n)).agg(F.min(F.struct("user", *xs)).alias("first"), F.count("*").alias("n"), *ends)
    cells = stored(cells.select(*_cells(n), "first.*", "n", *[f"{e}_{k}" for k in range(n) for e in ("lo", "hi")]).withColumn("cell", F.monotonically_increasing_id()))
    pairs = _in_cells(_around(cells, n, half=True), cells, n)
    boxes = [F.col(f"{r}{e}_{k}").alias(f"{e}_{x}{k}") for k in range(n) for e in ("lo", "hi") for r, x in (("", "a"), ("r", "b"))]
    pairs = stored(pairs.select(F.col("cell").alias("a"), F.col("rcell").alias("b"), (_distance("x", "rx", n) <= eps).alias("sure"), F.col("n").alias("n_a"), F.col("rn").alias("n_b"), *boxes))
    nodes, sure = cells.select(F.col("cell").alias("node")), pairs.filter("sure").select("a", "b")
    labels = labelled(nodes, sure)
    members = core.join(cells.select(*_cells(n), "cell"), _cells(n))
    la, lb = (labels.select(F.col("node").alias(f"of_{x}"), F.col("label").alias(f"label_{x}")) for x in "ab")
    unsure = stored(pairs.filter(~F.col("sure")).join(la, F.col("a") == F.col("of_a")).join(lb, F.col("b") == F.col("of_b")).filter("label_a <> label_b").drop("of_a", "of_b"))
    near = cell_links(unsure.drop("label_a", "label_b"), members.select("user", "cell", *xs), n, eps).select(F.col("a").alias("x"), F.col("b").alias("y"))
    # The second time clusters are linked, not cells.
    found = unsure.join(near, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y"))).select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
    again = labelled(labels.select(F.col("label").alias("node")).distinct(), found)
    up = again.select(F.col("node").alias("of"), F.col("label").alias("root"))
    labels = labels.join(up, F.col("label") == F.col("of")).select(F.col("node").alias("of_cell"), F.col("root").alias("of_root"))
    # Clusters go by their least user, of whatever type users are.
    named = labels.join(cells.select("cell", "user"), F.col("of_cell") == F.col("cell")).groupBy(F.col("of_root").alias("of")).agg(F.min("user").alias("root"))
    labels = labels.join(named, F.col("of_root") == F.col("of")).select("of_cell", "root")
    rooted = stored(members.join(labels, F.col("cell") == F.col("of_cell")).select("user", *xs, *_cells(n), "root"))
    border = _in_cells(_around(others, n), rooted, n).filter(_distance("x", "rx", n) <= eps).groupBy("user").agg(F.min("rroot").alias("root"))
    return stored(rooted.select("user", "root").unionByName(border))
