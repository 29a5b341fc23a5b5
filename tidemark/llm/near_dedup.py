"""Near-duplicate classes by DartMinHash over weighted word shingles.

A text is the multiset of its five-word shingles (a shorter text is one shingle of all its words), and the similarity
of two texts is the weighted Jaccard index of those. Each element throws hashed darts into its region, its weight times
a range of ranks: the region is cut into unit cells, each of which holds a Poisson number of darts with
a place, a rank and a coordinate, all hashes of element and cell. A dart within the element's weight counts, and each
coordinate of the signature keeps its earliest dart; if a coordinate stays empty the range of ranks is doubled. Bands
of coordinates are joined, and candidates are checked exactly.

Texts with equal words are one node with one text before anything is joined, so groups of copies never meet in a band. Within a bucket
of a band every node is first compared with one leader (the node's most frequent one, then its other ones), links are
merged to components, and only buckets whose nodes still differ in component are compared throughout, exactly and in
blocks that emit nothing but links: no bucket emits its pairs, and no candidate between different texts is left untested.
Blocks hold hashed shingles, packed once, and are bounded in rows and in shingles; a bucket of several blocks sends each of
them to those it has to meet.

Defined results: null text has no words; all texts without words are one class; a class's id is its smallest doc_id, null
ids last; repeated rows share their class, and one of them is kept; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.graph import components, roots

from .common import ahead, cut, fresh, mix, names_free, prefix_hash, root_of, row_ranges, scratch, span_hash, stored, strings, table, words_in
from .exact_dedup import one_of_repeated

WORDS, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 shares a band of 5 with probability 1 - (1 - 0.8**5)**20 = 0.9997.
BANDS, BAND = 20, 5
COORDINATES = BANDS * BAND
CHUNK = 1 << 20
#: A block of a bucket has at most so many nodes and, but for its last one, so many shingles; columns of the matrices that compare blocks.
BLOCK, SHINGLES, COLUMNS = 512, 1 << 19, 4096
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])
_A, _B, _C = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


# --- shingles ----------------------------------------------------------------------------------------------------


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and weight of each distinct shingle."""
    starts, ends, rows = words_in(data, offsets)
    if not len(starts):
        return rows, rows.astype(np.uint64), rows
    word = span_hash(prefix_hash(data), starts, ends)
    at = np.flatnonzero(rows[words - 1 :] == rows[: len(rows) - words + 1]) if len(rows) >= words else np.zeros(0, np.int64)
    h = np.zeros(len(at), np.uint64)
    for k in range(words):
        h = mix(h + word[at + k])
    n = np.bincount(rows, minlength=len(offsets) - 1)
    first = np.cumsum(n) - n
    found, of = [h], [rows[at]]
    for k in range(1, words):
        short = np.flatnonzero(n == k)
        h = np.full(len(short), np.uint64(k))
        for i in range(k):
            h = mix(h + word[first[short] + i])
        found.append(h)
        of.append(short)
    h, row = np.concatenate(found), np.concatenate(of)
    key = mix(h ^ mix(row.astype(np.uint64) + _A))
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    weight = np.diff(np.append(new, len(key)))
    keep = order[new]
    return row[keep], h[keep], weight


# --- signatures --------------------------------------------------------------------------------------------------


def _throw(row: np.ndarray, element: np.ndarray, weight: np.ndarray, low: np.ndarray, high: np.ndarray, out: np.ndarray, k: int) -> None:
    """Adds the darts with ranks in [low, high) of their row to the earliest ones in out."""
    layers = np.ceil(weight).astype(np.int64)
    begin = np.floor(low).astype(np.int64)[row]
    ranks = np.maximum(np.ceil(high).astype(np.int64)[row] - begin, 0)
    cells = layers * ranks
    which = np.repeat(np.arange(len(row)), cells)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(cells) - cells, cells)
    layer, rank = nth // ranks[which], nth % ranks[which] + begin[which]
    cell = mix(element[which] + layer.astype(np.uint64) * _A + mix(rank.astype(np.uint64) * _B + _C))
    darts = np.searchsorted(_POISSON, (cell >> np.uint64(11)).astype(np.float64) * 2.0**-53)
    own = np.repeat(np.arange(len(cell)), darts)
    d = np.arange(len(own)) - np.repeat(np.cumsum(darts) - darts, darts)
    dart = mix(cell[own] + (d.astype(np.uint64) + np.uint64(1)) * _C)
    at = rank[own] + (dart >> np.uint64(11)).astype(np.float64) * 2.0**-53
    of = row[which[own]]
    more = mix(dart + _A)
    inside = (at >= low[of]) & (at < high[of])
    part = layer[own] + (more >> np.uint64(40)).astype(np.float64) * 2.0**-24 < weight[which[own]]
    ok = np.flatnonzero(inside & part)
    at, more, of = at[ok], more[ok], of[ok]
    # Rank above, name below: the least is the earliest dart, and equal values are the same dart.
    packed = ((at * 2.0**28).astype(np.uint64) << np.uint64(24)) | (more & np.uint64(0xFFFFFF))
    np.minimum.at(out, of * k + ((more >> np.uint64(24)) % np.uint64(k)).astype(np.int64), packed)


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int = COORDINATES) -> np.ndarray:
    """The earliest dart of each of k coordinates, for n rows of weighted elements; rows without elements keep the largest value."""
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * k, none)
    total = np.bincount(row, weights=weight, minlength=n)
    some = total > 0
    low, high = np.zeros(n), np.where(some, k * (math.log(k) + 2) / np.maximum(total, 1e-9), 0)
    while len(row):
        _throw(row, element, weight.astype(np.float64), low, high, out, k)
        empty = (out.reshape(n, k) == none).any(axis=1) & some
        if not empty.any():
            break
        left = empty[row]
        row, element, weight = row[left], element[left], weight[left]
        low, high = np.where(empty, high, 0), np.where(empty, 2 * high, 0)
    return out.reshape(n, k)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    n, k = signature.shape
    parts = signature.reshape(n, bands, k // bands)
    h = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * _B), (n, bands)).copy()
    for i in range(k // bands):
        h = mix(h + parts[:, :, i])
    return h


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = strings(batch.column("text"))
        whole = data.tobytes()
        for a, b in row_ranges(offsets, CHUNK):
            own = offsets[a : b + 1] - offsets[a]
            row, element, weight = shingles(data[offsets[a] : offsets[b]], own)
            some = np.bincount(row, minlength=b - a) > 0
            keys = band_keys(signatures(row, element, weight, b - a))[some]
            content = [hashlib.blake2b(b" ".join(whole[offsets[i] : offsets[i + 1]].split()), digest_size=16).digest() for i in range(a, b)]
            ends = pa.array(np.concatenate(([0], np.cumsum(np.where(some, BANDS, 0)))).astype(np.int32))
            size = np.bincount(row, weights=weight, minlength=b - a).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).slice(a, b - a) for c in ("id", "text_key", "text")], pa.array(content, pa.binary()), pa.array(size), pa.ListArray.from_arrays(ends, pa.array(keys.ravel().view(np.int64)))],
                names=["id", "text_key", "text", "content", "size", "bands"],
            )


# --- exact check -------------------------------------------------------------------------------------------------


def similarities(left: tuple[np.ndarray, np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """Weighted Jaccard index of each of n pairs of shingle multisets; 1 for two empty ones."""
    key = np.concatenate([mix(h ^ mix(r.astype(np.uint64) + _A)) for r, h, _ in (left, right)])
    row, weight = np.concatenate([left[0], right[0]]), np.concatenate([left[2], right[2]])
    order = np.argsort(key)
    key, row, weight = key[order], row[order], weight[order]
    both = np.flatnonzero(key[1:] == key[:-1])
    common = np.bincount(row[both], weights=np.minimum(weight[both], weight[both + 1]), minlength=n)
    total = np.bincount(row, weights=weight, minlength=n) - common
    return np.where(total > 0, common / np.maximum(total, 1), 1.0)


def _linked(least: float, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (da, oa), (db, ob) = strings(batch.column("text_a")), strings(batch.column("text_b"))
            good = []
            for a, b in row_ranges(oa + ob, CHUNK):
                left = shingles(da[oa[a] : oa[b]], oa[a : b + 1] - oa[a])
                right = shingles(db[ob[a] : ob[b]], ob[a : b + 1] - ob[a])
                good.append(similarities(left, right, b - a) >= least - 1e-12)
            mask = pa.array(np.concatenate(good) if good else np.zeros(0, bool))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in names], names=names)

    return run


def links(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The rows of pairs, with nodes a and b and other longs, whose texts are similar enough."""
    one, two = (texts.select(F.col("node").alias(f"node_{x}"), F.col("text").alias(f"text_{x}")) for x in "ab")
    both = pairs.join(one, F.col("a") == F.col("node_a")).join(two, F.col("b") == F.col("node_b"))
    return cut(both.select(*pairs.columns, "text_a", "text_b").mapInArrow(_linked(least, pairs.columns), ", ".join(f"{c} long" for c in pairs.columns)))


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of links that join the same labels as all links (a, b) do, fewer than there are labels."""
    if not len(a):
        return np.zeros(0, np.int64)
    n = int(max(a.max(), b.max())) + 1
    link = np.full((n, n), -1, np.int64)
    link[a, b] = link[b, a] = np.arange(len(a))
    fresh, keep = np.ones(n, bool), []
    for seed in range(n):
        todo = [seed] if fresh[seed] else []
        fresh[seed] = False
        while todo:
            x = todo.pop()
            new = np.flatnonzero((link[x] >= 0) & fresh)
            fresh[new] = False
            keep.append(link[x, new])
            todo.extend(new.tolist())
    return np.concatenate(keep)


def bag(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of the occurrences of shingles: the n-th of equal ones in a row has a hash of its own, so that multisets are sets."""
    row, h, weight = shingles(text, offsets)
    nth = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
    row, h = np.repeat(row, weight), mix(np.repeat(h, weight) + nth.astype(np.uint64) * _B)
    order = np.argsort(row, kind="stable")
    return row[order], h[order]


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = strings(batch.column("text"))
        for a, b in row_ranges(offsets, CHUNK):
            row, h = bag(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            ends = np.searchsorted(row, np.arange(b - a + 1))
            packed = [h[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), pa.array(packed, pa.binary())], names=["node", "bag"])


def linked_labels(label: np.ndarray, bags: list[bytes], least: float, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of labels that similar rows join, a spanning set of them; with `first`, only rows before it meet those from it on. Intersections of
    all pairs come at once, as a product of 0/1 matrices whose columns are the occurrences of shingles that several rows have."""
    n = len(label)
    size = np.array([len(x) // 8 for x in bags])
    row, h = np.repeat(np.arange(n), size), np.frombuffer(b"".join(bags), np.uint64)
    _, column, count = np.unique(h, return_inverse=True, return_counts=True)
    many = count > 1
    place, keep = np.cumsum(many) - 1, many[column]
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common, total = np.zeros((n, n), np.float32), int(many.sum())
    for begin in range(0, total, COLUMNS):
        a, b = np.searchsorted(column, [begin, begin + COLUMNS])
        part = np.zeros((n, min(COLUMNS, total - begin)), np.float32)
        part[row[a:b], column[a:b] - begin] = 1
        common += part @ part.T
    both = size[:, None] + size[None, :] - common
    good = (common >= (least - 1e-9) * both) & (label[:, None] < label[None, :])
    if first is not None:
        good[:first, :first] = good[first:, first:] = False
    x, y = np.nonzero(good)
    keep = spanning(*np.unique(label, return_inverse=True)[1][[x, y]])
    return label[x[keep]], label[y[keep]]


_PACKED = "a long, b long, key long, own long, data binary, labels binary, sizes binary"


def _packed(least: float):
    def run(rows: pa.Table) -> pa.Table:
        """Links within a block, as pairs of labels; and the block itself if its key has others."""
        label, bags = rows.column("label").to_numpy(), rows.column("bag").to_pylist()
        large = rows.column("large")[0].as_py()
        a, b = (np.zeros(0, np.int64),) * 2 if large else linked_labels(label, bags, least)  # those of one component need not meet
        more = rows.column("blocks")[0].as_py() > 1
        none = [None] * len(a)
        block = {
            "key": rows.column("key")[0].as_py(),
            "own": rows.column("own")[0].as_py(),
            "data": b"".join(bags),
            "labels": label.astype("<i8").tobytes(),
            "sizes": np.array([len(x) for x in bags], "<i8").tobytes(),
        }
        kinds = {"key": pa.int64(), "own": pa.int64()}
        columns = {"a": pa.array([*a.tolist(), *[None] * more], pa.int64()), "b": pa.array([*b.tolist(), *[None] * more], pa.int64())}
        return pa.table(columns | {c: pa.array([*none, *[v] * more], kinds.get(c, pa.binary())) for c, v in block.items()})

    return run


def _met(least: float):
    def run(rows: pa.Table) -> pa.Table:
        """Links between two blocks of a key."""
        label, bags, first = [], [], None
        for r in rows.to_pylist():
            at = np.concatenate(([0], np.cumsum(np.frombuffer(r["sizes"], "<i8"))))
            bags += [r["data"][x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
            label.append(np.frombuffer(r["labels"], "<i8"))
            first = first or len(bags)
        a, b = linked_labels(np.concatenate(label), bags, least, first)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def links_in_blocks(member: DataFrame, texts: DataFrame, least: float, block: int = BLOCK, most: int = SHINGLES) -> DataFrame:
    """Pairs (a, b) of labels that similar nodes of one key join, for rows (key, node, size, label). The nodes of a key are cut into blocks;
    those outside its largest component meet all blocks, each two in a group of their own: a group is bounded in rows and
    shingles, packed blocks travel rather than texts, and only links are emitted."""
    per = member.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy(F.col("key").alias("of_key"))
    per = per.agg(F.count("*").alias("labels"), F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("n")).filter("labels > 1")
    rows = member.join(cut(per.select("of_key", "n", F.col("main.label").alias("main"))), F.col("key") == F.col("of_key"))
    # A node costs its shingles, or its share of a block's rows.
    cost = F.greatest(F.col("size"), F.ceil(F.lit(most) / F.lit(block))).cast("long")
    rows = cut(rows.select("key", "node", "label", (F.col("label") == F.col("main")).alias("large"), cost.alias("cost"), F.pmod(F.xxhash64("node"), root_of(F.col("n"))).alias("at")))
    rows = ahead(rows, ["key", "large"], "at", ["node"], "before", "cost").withColumn("nth", F.floor(F.col("before") / most))
    # Blocks 0 .. few - 1 hold the nodes outside the key's largest component, the others those inside.
    blocks = F.coalesce(F.max(F.when(F.col("large"), F.col("nth"))), F.lit(-1)) + 1
    few = F.coalesce(F.max(F.when(~F.col("large"), F.col("nth"))), F.lit(-1)) + 1
    rows = cut(rows.select("key", "node", "label", "large", "nth"))
    count = cut(rows.groupBy(F.col("key").alias("of_key")).agg(few.alias("few"), blocks.alias("many")))
    wanted = rows.select("node").distinct()
    bags = stored(texts.join(wanted, "node").select("node", "text").mapInArrow(_bags, "node long, bag binary"))
    rows = rows.join(count, F.col("key") == F.col("of_key")).withColumn("own", F.col("nth") + F.when(F.col("large"), F.col("few")).otherwise(F.lit(0)))
    # Two blocks, one of either kind, that fit one go as one: nearly all keys are small.
    one = (F.col("few") == 1) & (F.col("many") == 1)
    rows = rows.withColumn("own", F.when(one, F.lit(0)).otherwise(F.col("own"))).withColumn("large", F.col("large") & ~one)
    rows = rows.withColumn("blocks", F.when(one, F.lit(1)).otherwise(F.col("few") + F.col("many")))
    rows = rows.join(bags.withColumnRenamed("node", "of_node").hint("merge"), F.col("node") == F.col("of_node"))
    packed = stored(rows.select("key", "own", "label", "large", "blocks", "bag").groupBy("key", "own").applyInArrow(_packed(least), _PACKED))
    found = packed.filter("a is not null").select("a", "b")
    whole = packed.filter("a is null").join(count.hint("merge"), F.col("key") == F.col("of_key")).drop("a", "b")
    others = F.when(F.col("own") < F.col("few"), F.col("few") + F.col("many")).otherwise(F.col("few"))
    whole = whole.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), others - 1))).filter("own <> other")
    whole = whole.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "data", "labels", "sizes")
    met = whole.groupBy("key", "low", "high").applyInArrow(_met(least), "a long, b long")
    return cut(found.unionByName(met).distinct())


# --- labels ------------------------------------------------------------------------------------------------------


def composed(labels: DataFrame, new: DataFrame) -> DataFrame:
    """Labels of all nodes that are not their own, after further labels of labels."""
    up = new.select(F.col("node").alias("of"), F.col("label").alias("up"))
    moved = labels.join(up, F.col("label") == F.col("of"), "left").select("node", F.coalesce("up", "label").alias("label"))
    return stored(moved.unionByName(new))


def _with_label(rows: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    own = labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    return rows.join(own, F.col(node) == F.col("_node"), "left").withColumn(name, F.coalesce("_label", node)).drop("_node", "_label")


# --- the operator ------------------------------------------------------------------------------------------------


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, block: int = BLOCK, most: int = SHINGLES) -> DataFrame:
    """Per row: id, text_key, class_id, class_size, kept (one row of each class)."""
    names_free(docs, id_col, text_col)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col)).alias("text_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = plain.mapInArrow(_sign, "id long, text_key long, text string, content binary, size long, bands array<long>")
    rows = stored(signed.withColumn("tag", F.monotonically_increasing_id()), compression="zstd")
    with scratch() as work:
        classed = work.keep(_classed(rows, least, block, most))
    least_id = F.min(F.struct("void", "id", "node"))
    classes = classed.groupBy("label").agg(least_id.alias("c"), F.sum("rows").alias("class_size")).select(F.col("label").alias("of_label"), F.col("c.id").alias("class_id"), F.col("c.node").alias("kept_tag"), "class_size")
    found = classed.join(classes, F.col("label") == F.col("of_label")).select("content", "class_id", "kept_tag", "class_size")
    # One content may be a third of all rows: an inner sort-merge join, which adaptive execution splits.
    return rows.select("id", "text_key", "content", "tag").join(found.hint("merge"), "content").select("id", "text_key", "class_id", "class_size", (F.col("tag") == F.col("kept_tag")).alias("kept"))


def _classed(rows: DataFrame, least: float, block: int, most: int) -> DataFrame:
    """content, node, id, void, rows and label of each node of the signed rows; a written table."""
    # Nodes: the first row (smallest id) of each word sequence.
    first = F.min(F.struct(F.col("id").isNull().cast("int").alias("void"), "id", "tag"))
    groups = rows.groupBy("content").agg(first.alias("first"), F.count("*").alias("rows"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = stored(groups.select("content", F.col("first.tag").alias("node"), F.col("first.id").alias("id"), F.col("first.void").alias("void"), "rows", "size", "bands"))
    banded = nodes.select("node", "size", F.explode("bands").alias("key"))
    shared = cut(banded.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("of_key"), "leader"))
    # Merge joins throughout: both sides grow with the input, and a hot key between two shuffles is split by adaptive execution.
    met = stored(banded.join(shared.hint("merge"), F.col("key") == F.col("of_key")).select("key", "node", "size", "leader"))
    star = cut(met.filter("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("n")))
    wanted = met.select("node").distinct()
    texts = stored(rows.select("tag", "text").join(wanted.hint("merge"), F.col("tag") == F.col("node")).select("node", "text"), compression="zstd").hint("merge")
    best = star.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), "leader")).alias("x")).select(F.col("node").alias("b"), F.col("x.leader").alias("a"))
    labels = roots(links(best.select("a", "b"), texts, least))
    # The node's other leaders, where the components still differ.
    rest = star.select(F.col("leader").alias("a"), F.col("node").alias("b")).join(best, ["a", "b"], "left_anti")
    rest = cut(_with_label(_with_label(rest, labels, "a", "la"), labels, "b", "lb").filter("la <> lb"))
    edges = links(rest.select("a", "b", "la", "lb"), texts, least)
    edges = cut(edges.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
    hooked = roots(edges.groupBy("b").agg(F.min("a").alias("a")))
    labels = composed(labels, hooked)
    left = _with_label(_with_label(edges, hooked, "a", "la"), hooked, "b", "lb").filter("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    # Buckets that still hold several components: their nodes are compared exactly, in blocks.
    member = cut(_with_label(met.select("key", "node", "size"), labels, "node", "label"))
    left = left.unionByName(links_in_blocks(member, texts, least, block, most))
    labels = composed(labels, components(left).filter("node <> label"))
    return stored(_with_label(nodes.select("content", "node", "id", "void", "rows"), labels, "node", "label"))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, with all its columns."""
    key, of_id, of_key = fresh(docs, "_key", "_of_id", "_of_key")
    stay = near_classes(docs, id_col, text_col).filter("kept").select(F.col("id").alias(of_id), F.col("text_key").alias(of_key))
    rows = docs.withColumn(key, text_key(F.col(text_col)))
    rows = rows.join(stay, F.col(id_col).eqNullSafe(F.col(of_id)) & (F.col(key) == F.col(of_key)), "left_semi")
    return one_of_repeated(rows, id_col, key).drop(key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept")


#: The classes by comparing all texts that share a shingle.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d),
g AS (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS s, count(*) AS n FROM p GROUP BY 1, 2),
t AS (SELECT doc_id, sum(n) AS total FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n)) AS common FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN t tx ON x = tx.doc_id JOIN t ty ON y = ty.doc_id WHERE 5 * common >= 4 * (tx.total + ty.total - common)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
k AS (SELECT x AS doc_id, min(y) AS class_id FROM r GROUP BY x)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, doc_id = class_id AS kept FROM k
"""
