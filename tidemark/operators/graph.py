"""Connected components of graphs of any depth, by stars.

A round is a large-star step, in which every node ties its larger neighbours to the least of its neighbourhood, and a small-star step, in which
it ties its smaller ones and itself to the least of them. Neither changes which nodes are connected, and the rounds grow with the logarithm
of the depth, not with the depth. Before a round's links are written each task contracts what it holds, in blocks of a bounded number
of links: the links of a block become one star for each of its components. Rounds are written tables, so that plans do not
grow with the rounds and Spark knows their sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.files import forget, scratch, stored

#: Links that a task contracts at once.
BLOCK = 1 << 20


def least_of_component(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 ... n - 1 and links (a, b) the least node of each one's component."""
    parent = np.arange(n)
    while True:
        x, y = parent[a], parent[b]
        if np.array_equal(x, y):
            return parent
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def _contracted(block: int):
    def stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = least_of_component(place[: len(a)], place[len(a) :], len(names))
        moved = np.flatnonzero(root != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[root[moved]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for part in (batch.slice(i, block) for batch in batches for i in range(0, batch.num_rows, block)):
            held.append((part.column("a").to_numpy(), part.column("b").to_numpy()))
            n += part.num_rows
            if n >= block:
                yield stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield stars(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _stars(links: DataFrame, large: bool, block: int) -> DataFrame:
    """One step over links (a, b) with a > b, contracted and written. Neighbourhoods are joined with their least node, never gathered."""
    own = links.select("a", "b")
    turned = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    around = own.unionByName(turned) if large else own
    least = around.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("m")).select("of", F.least("of", "m").alias("m"))
    # In the large step the larger neighbours of a node are at b of the turned links; in the small one its smaller ones are at b, and it ties itself as well.
    side = turned if large else own
    tied = side.join(least, F.col("a") == F.col("of"))
    new = tied.select(F.col("b").alias("x"), "m")
    if not large:
        new = new.unionByName(least.select(F.col("of").alias("x"), "m"))
    new = new.filter("x <> m").select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b")).distinct()
    return stored(new.mapInArrow(_contracted(block), "a long, b long").distinct())


def components(edges: DataFrame, block: int = BLOCK, rounds: list | None = None) -> DataFrame:
    """node and label, the least node of its component, for every node of the edges (a, b) that has another one; read from a written table. Null ends
    and loops link nothing. Into `rounds`, if given, goes a number for each round: its links."""
    ends = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    with scratch() as work:
        links = stored(ends.mapInArrow(_contracted(block), "a long, b long").distinct())
        while not _all_stars(links):
            if rounds is not None:
                rounds.append(links.count())
            between = _stars(links, True, block)
            forget(links)
            links = _stars(between, False, block)
            forget(between)
        work.keep(links)
    centre = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(centre.select("node", F.col("node").alias("label")))


def _all_stars(links: DataFrame) -> bool:
    """Whether each node has one smaller neighbour, or only larger ones: then that neighbour is the least of its component."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    other = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)")
    return not other.limit(1).count()


def roots(parents: DataFrame) -> DataFrame:
    """node and label, the root of its tree, for rows (a, b) that give each node b one smaller node a: each round looks twice as far. A written table."""
    with scratch() as work:
        now = stored(parents.select(F.col("b").alias("node"), F.col("a").alias("label"), F.lit(True).alias("moved")))
        while now.filter("moved").limit(1).count():
            up = now.select(F.col("node").alias("of"), F.col("label").alias("up"))
            before, now = now, stored(now.join(up, F.col("label") == F.col("of"), "left").select("node", F.coalesce("up", "label").alias("label"), F.col("up").isNotNull().alias("moved")))
            forget(before)
        return work.keep(stored(now.select("node", "label")))
