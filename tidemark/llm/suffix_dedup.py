"""Removal of repeated passages by sorting suffixes: deep-shallow sorting on a sparse set of suffixes.

Each byte that a `LENGTH`-byte string covers is removed if that string also starts in a document with a smaller id.

Two strings of that length are equal only if their minimizers are: the k-byte anchor with the least hash among all in the string,
the first of equals. One pass names the anchors of every text (one for some 15 bytes); their hashes are brought together and
those of two documents or more are shared. Only strings at shared anchors are candidates. Their suffixes, cut at the string's
length, are sorted deep-shallow: buckets are sorted by a three-way multikey quicksort to a shallow depth of 16 bytes, and the groups that
still agree by blind tries, whose nodes keep only the position of the symbol at which their strings branch. Equal strings share a leaf,
and the least id among them stays.

Whatever a task can settle is settled before a shuffle: of the anchors and candidate strings that several documents of a
batch share, only those of its least id are sent on, and a task remembers (in bounded memory) what it found shared and what
it has sent of that, so that later batches send only smaller ids. So a passage in a third of all documents is sent about once a
task, not once a document or a batch. Shuffled rows are packs of arrays, dealt out by hash into as many partitions as the bytes of
the text ask for, so that a task's arrays have a bounded size at every size of the input.

Defined results: null text is empty; ids that are null count as larger than all others (as the largest 64-bit number), and documents with equal ids
(repeated rows) remove nothing from each other; texts under the length keep all; removed bytes may split a
character, as texts are bytes here; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, names_free, powers, prefix_hash, row_ranges, shuffle_width, stored, strings, table

LENGTH = 50
#: Bytes of an anchor.
ANCHOR = 20
#: Bytes of text for a partition of the packs, of a run that is hashed at once (its arrays fit a cache), and of
#: candidates that are settled before they are sent on.
PART, CHUNK, SETTLED = 128 << 20, 1 << 18, 2 << 20
#: Strings that are sorted at once.
SORTED = 1 << 20
#: Symbols of 8 bytes to which quicksort goes.
SHALLOW = 2
#: Shared anchors and strings that a task remembers; what is not remembered is sent again, no more than that.
HOT, CARRIED = 1 << 18, 1 << 15
NO_ID = (1 << 63) - 1
_SLOT = 24  # bits for a place in a run; longer documents are cut into runs that overlap

#: Packs between the steps: kind 0 of anchors and 2 of candidates, by their hash; 1 of places and 3 of spans, by document.
PACKED = "kind int, bucket int, data binary, hashes binary, counts binary, places binary, ids binary, keys binary"
ANSWER = "id long, text_key long, data binary"


# --- anchors -----------------------------------------------------------------------------------------------------


def minimizers(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of every string of the length that lies in one row, the place of its anchor, and the hashes of all anchors."""
    n = len(data) - anchor + 1
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    prefix = prefix_hash(data)
    _, inverse = powers(len(prefix))
    hashes = mix((prefix[anchor:] - prefix[:-anchor]) * inverse[:n])
    least = (hashes & np.uint64((1 << 64) - (1 << _SLOT))) | np.arange(n, dtype=np.uint64)
    width, wanted = 1, length - anchor + 1
    while width * 2 <= wanted:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < wanted:
        least = np.minimum(least[: len(least) - (wanted - width)], least[wanted - width :])
    inside = np.zeros(len(least) + 1, np.int64)
    whole = np.flatnonzero(np.diff(offsets) >= length)
    np.add.at(inside, offsets[whole], 1)
    np.add.at(inside, offsets[whole + 1] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    return starts, (least[starts] & np.uint64((1 << _SLOT) - 1)).astype(np.int64), hashes


def runs(data: np.ndarray, offsets: np.ndarray, most: int = CHUNK, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, offsets, rows and places of the rows' bytes in their texts; a long text comes in pieces that overlap by length - 1."""
    for a, b in row_ranges(offsets, most):
        size = int(offsets[b] - offsets[a])
        if b - a == 1 and size > most:
            for at in range(0, max(size - length + 1, 1), most):
                piece = data[offsets[a] + at : min(offsets[b], offsets[a] + at + most + length - 1)]
                yield piece, np.array([0, len(piece)]), np.array([a]), np.array([at])
        else:
            yield data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], np.arange(a, b), np.zeros(b - a, np.int64)


def _pack(**columns: list) -> pa.RecordBatch:
    kinds = {"kind": pa.int32(), "bucket": pa.int32()}
    names = [x.split()[0] for x in PACKED.split(", ")]
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(x, [None] * n), kinds.get(x, pa.binary())) for x in names], names=names)


def planes(x: np.ndarray, keep: int = 8) -> bytes:
    """The bytes of the numbers, all lowest ones first, so that a general compressor sees the zeros of the high ones together."""
    width = x.dtype.itemsize
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, width).T[:keep]).tobytes()


def unplaned(raw: bytes, kind: str, keep: int = 8) -> np.ndarray:
    width = np.dtype(kind).itemsize
    part = np.frombuffer(raw, np.uint8).reshape(min(keep, width), -1)
    out = np.zeros((part.shape[1], width), np.uint8)
    out[:, : len(part)] = part.T
    return out.view(kind).ravel()


def heads(*sorted_columns: np.ndarray) -> np.ndarray:
    """The first entry of each run of equal ones."""
    n = len(sorted_columns[0])
    new = np.ones(n, bool)
    new[1:] = False
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _documents(row: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> dict[str, bytes]:
    """Ids, keys and entries of the documents of a pack, whose entries are in row order."""
    new = heads(row)
    of = row[new]
    return {"ids": planes(ids[of]), "keys": planes(keys[of]), "counts": planes(np.diff(np.append(new, len(row))).astype("<u4"))}


def _answers(kind: int, parts: int, ids: np.ndarray, keys: np.ndarray, row: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Packs of the values of each document (its row in ids and keys), dealt out by document."""
    if not len(row):
        return
    bucket = (mix(ids[row].astype(np.uint64)) % np.uint64(parts)).astype(np.int32)
    order = np.lexsort((row, bucket))
    bucket, row, values = bucket[order], row[order], values[order]
    new = heads(bucket)
    out = {c: [] for c in ("data", "ids", "keys", "counts")}
    for a, b in zip(new, np.append(new[1:], len(row)), strict=True):
        for c, v in (("data", planes(values[a:b])), *_documents(row[a:b], ids, keys).items()):
            out[c].append(v)
    yield _pack(kind=[kind] * len(new), bucket=bucket[new].tolist(), **out)


def _answers_of(kind: int, parts: int, ids: np.ndarray, keys: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The same for values with the id and key of each."""
    if len(ids):
        order = np.lexsort((keys, ids))
        ids, keys, values = ids[order], keys[order], values[order]
        new = heads(ids, keys)
        yield from _answers(kind, parts, ids[new], keys[new], np.repeat(np.arange(len(new)), np.diff(np.append(new, len(ids)))), values)


def _gathered(kind: int, form: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All packs of a partition's documents: a row for each with its values."""
        ids, keys, values = [], [], []
        for batch in batches:
            for r, i, k in _entries(batch, kind):
                ids.append(i)
                keys.append(k)
                values.append(unplaned(r["data"], form))
        if not ids:
            return
        ids, keys, values = map(np.concatenate, (ids, keys, values))
        order = np.lexsort((keys, ids))
        ids, keys, values = ids[order], keys[order], values[order]
        new = heads(ids, keys)
        stop = np.append(new[1:], len(ids))
        for k in range(0, len(new), 5000):
            part = slice(k, k + 5000)
            yield pa.RecordBatch.from_arrays([pa.array(ids[new[part]]), pa.array(keys[new[part]]), pa.array([values[a:b].tobytes() for a, b in zip(new[part], stop[part], strict=True)], pa.binary())], names=["id", "text_key", "data"])

    return run


def _dealt(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by bucket, and first entry and bucket of each."""
    bucket = ((hashes >> np.uint64(20)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    new = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    return order, new, bucket[new]


def _share(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At each entry: whether its hash stands under several ids, and whether its id is the least of them."""
    shared, least = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    if not len(hashes):
        return shared, least
    order = np.argsort(hashes)
    h, d = hashes[order], ids[order]
    new = heads(h)
    n = np.diff(np.append(new, len(h)))
    lo, hi = np.minimum.reduceat(d, new), np.maximum.reduceat(d, new)
    shared[order] = np.repeat(lo != hi, n)
    least[order] = d == np.repeat(lo, n)
    return shared, least


class Shared:
    """Hashes that a task has found under several ids, with the least of the ids that it has sent."""

    def __init__(self, most: int = HOT) -> None:
        self.hashes, self.ids, self.most = np.zeros(0, np.uint64), np.zeros(0, np.int64), most

    def least(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are known, and the least id sent for each."""
        if not len(self.hashes):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.hashes[at] == hashes, self.ids[at]

    def add(self, hashes: np.ndarray, ids: np.ndarray) -> None:
        known, _ = self.least(hashes)
        room = np.flatnonzero(~known)[: max(0, self.most - len(self.hashes))]
        known[room] = True
        h, i = np.concatenate((self.hashes, hashes[known])), np.concatenate((self.ids, ids[known]))
        order = np.lexsort((i, h))
        order = order[heads(h[order])] if len(order) else order
        self.hashes, self.ids = h[order], i[order]


def _anchors(parts: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Shared()
        for batch in batches:
            data, offsets = strings(batch.column("text"))
            ids, keys = (batch.column(c).to_numpy() for c in ("id", "text_key"))
            found = []
            for piece, own, rows, at in runs(data, offsets, CHUNK, length):
                _, place, hashes = minimizers(piece, own, length)
                place = place[heads(place)] if len(place) else place  # anchors only move to the right
                row = np.searchsorted(own, place, "right") - 1
                found.append((hashes[place], rows[row], place - own[row] + at[row]))
            if not any(len(f[0]) for f in found):
                continue
            hashes, row, place = (np.concatenate([f[k] for f in found]) for k in range(3))
            shared, sent = _share(hashes, ids[row])
            met, least = memory.least(hashes)
            # Settled here: those that others of the task share need no answer, those of its least id still answer others.
            shared |= met
            sent &= ~met | (ids[row] < least)
            yield from _answers(1, parts, ids, keys, row[shared], place[shared].astype("<u4"))
            hashes, row, place, known = hashes[sent], row[sent], place[sent], shared[sent]
            memory.add(hashes[known], ids[row[known]])
            order, new, buckets = _dealt(hashes, parts)
            out = {c: [] for c in ("hashes", "places", "data", "ids", "keys", "counts")}
            for a, b in zip(new, np.append(new[1:], len(order)), strict=True):
                e = order[a:b]
                # The bucket and 40 bits name an anchor: what else shares them is a candidate more, no more than that.
                for c, v in (("hashes", planes(hashes[e], 5)), ("places", planes(place[e].astype("<u4"))), ("data", known[e].tobytes()), *_documents(row[e], ids, keys).items()):
                    out[c].append(v)
            if len(new):
                yield _pack(kind=[0] * len(new), bucket=buckets.tolist(), **out)

    return run


def _passed(batch: pa.RecordBatch, kind: int) -> Iterator[pa.RecordBatch]:
    own = batch.filter(pc.equal(batch.column("kind"), kind))
    if len(own):
        yield own


def _entries(batch: pa.RecordBatch, kind: int) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """Each pack with the id and key of each of its entries."""
    for r in batch.filter(pc.equal(batch.column("kind"), kind)).to_pylist():
        n = unplaned(r["counts"], "<u4")
        yield r, np.repeat(unplaned(r["ids"], "<i8"), n), np.repeat(unplaned(r["keys"], "<i8"), n)


def _meet(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All packs of a partition: the places of the anchors whose hash several documents share."""
        hashes, ids, keys, places, known = [], [], [], [], []
        for batch in batches:
            yield from _passed(batch, 1)
            for r, i, k in _entries(batch, 0):
                hashes.append(unplaned(r["hashes"], "<u8", 5))
                places.append(unplaned(r["places"], "<u4"))
                known.append(np.frombuffer(r["data"], bool))
                ids.append(i)
                keys.append(k)
        if hashes:
            hashes, ids, keys, places, known = map(np.concatenate, (hashes, ids, keys, places, known))
            shared, _ = _share(hashes, ids)
            wanted = shared & ~known
            yield from _answers_of(1, parts, ids[wanted], keys[wanted], places[wanted])

    return run


# --- deep-shallow sorting ----------------------------------------------------------------------------------------


def _symbols(text: np.ndarray, starts: np.ndarray, k: np.ndarray, length: int) -> np.ndarray:
    """The k-th 8-byte symbol of each suffix, as a number in the order of its bytes; cut at the length."""
    raw = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
    s = raw[starts + 8 * k].byteswap()
    over = 8 * (k + 1) - length
    if np.any(over > 0):
        bits = np.uint64(8) * np.maximum(over, 0).astype(np.uint64)
        s = (s >> bits) << bits
    return s


def multikey_quicksort(text: np.ndarray, starts: np.ndarray, order: np.ndarray, new: np.ndarray, depth: int, length: int) -> None:
    """Sorts the suffixes of each group by their first `depth` symbols, in place: order holds the groups one after another, new says where
    one begins. All groups are partitioned at once, each around the median of three of its symbols, into those below it, those equal
    to it, which go on with their next symbol, and those above it."""
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(order)))
    first, size = first[size > 1], size[size > 1]
    level, symbol = np.zeros(len(first), np.int64), None
    while len(first):
        base = np.cumsum(size) - size
        group = np.repeat(np.arange(len(first)), size)
        place = np.arange(len(group)) + (first - base)[group]
        if symbol is None:
            symbol = _symbols(text, starts[order[place]], level[group], length)
        a, b, c = symbol[base], symbol[base + size // 2], symbol[base + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[group]
        part = 3 * group + (symbol >= pivot) + (symbol > pivot)
        count = np.bincount(part, minlength=3 * len(first))
        begin = np.cumsum(count) - count
        to = np.empty(len(part), np.int64)
        for side in range(3):
            at = np.flatnonzero(part % 3 == side)
            own = np.cumsum(count[side::3]) - count[side::3]
            to[at] = np.arange(len(at)) + (begin[side::3] - own)[group[at]]
        moved, sorted_symbol = np.empty(len(part), order.dtype), np.empty(len(part), symbol.dtype)
        moved[to], sorted_symbol[to] = order[place], symbol
        order[place] = moved
        begin = np.repeat(first - base, 3) + begin
        new[begin[count > 0]] = True
        level = np.repeat(level, 3)
        level[1::3] += 1
        goes = (count > 1) & (level < depth)
        stays = np.repeat(goes, count)
        deeper = np.repeat(np.arange(len(count)) % 3 == 1, count)[stays]
        symbol, first, size, level = sorted_symbol[stays], begin[goes], count[goes], level[goes]
        if deeper.any():
            group = np.repeat(np.arange(len(first)), size)
            at = np.flatnonzero(deeper)
            place = at + (first - (np.cumsum(size) - size))[group[at]]
            symbol[at] = _symbols(text, starts[order[place]], level[group[at]], length)


class BlindTries:
    """A blind trie for each of many groups of suffixes. An inner node keeps only the position of the symbol by which its suffixes differ,
    an edge that symbol; a suffix is searched blindly by those, compared once with the leaf that it reaches, and inserted at the
    first symbol in which the two differ. All groups are searched at once, and of the suffixes that want the same new leaf
    one is inserted and the others are searched again, so copies cost one search and one comparison each."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, group: np.ndarray, depth: int, length: int) -> None:
        self.text, self.starts, self.group, self.length = text, starts, group, length
        self.depth, self.end = depth, -(-length // 8)
        head = heads(group)
        #: A reference to node v is v, to leaf x is -1 - x. The root of a group is its first suffix as a leaf.
        self.root, self.leaf = -1 - np.arange(len(head)), head
        self.at = np.full(len(starts), -1)
        self.at[head] = np.arange(len(head))
        self.position = np.zeros(0, np.int64)
        self.edge_node, self.edge_symbol, self.edge_child = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._index()
        todo, rounds = np.flatnonzero(self.at < 0), 0
        while len(todo):
            todo, rounds = self._insert(todo), rounds + 1
            if rounds > 10 * self.end + 50:
                raise ValueError("two edges of a trie agree in 64 bits")

    def _symbol(self, members: np.ndarray, k: np.ndarray) -> np.ndarray:
        return _symbols(self.text, self.starts[members], k, self.length)

    def _name(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        return mix(symbol + mix(node.astype(np.uint64) + np.uint64(1)))

    def _index(self) -> None:
        name = self._name(self.edge_node, self.edge_symbol)
        self.by_name = np.argsort(name)
        self.names = name[self.by_name]
        self.any_child = np.zeros(len(self.position), np.int64)
        self.any_child[self.edge_node] = self.edge_child

    def _edge(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The edge of each node by the symbol, -1 where it has none."""
        at = np.searchsorted(self.names, self._name(node, symbol))
        at[at == len(self.names)] = 0
        edge = self.by_name[at]
        return np.where((self.edge_node[edge] == node) & (self.edge_symbol[edge] == symbol), edge, -1)

    def _search(self, members: np.ndarray) -> np.ndarray:
        """The leaf that a blind search reaches: where no edge fits, it goes on by any."""
        here = self.root[self.group[members]]
        inner = np.flatnonzero(here >= 0)
        while len(inner):
            node = here[inner]
            edge = self._edge(node, self._symbol(members[inner], self.position[node]))
            here[inner] = np.where(edge >= 0, self.edge_child[edge], self.any_child[node])
            inner = inner[here[inner] >= 0]
        return -1 - here

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The first symbol from the depth on in which two suffixes differ, the end if they are equal."""
        differ, left = np.full(len(a), self.end), np.arange(len(a))
        for k in range(self.depth, self.end):
            other = self._symbol(a[left], k) != self._symbol(b[left], k)
            differ[left[other]] = k
            left = left[~other]
        return differ

    def _insert(self, todo: np.ndarray) -> np.ndarray:
        leaf = self._search(todo)
        differ = self._common(todo, self.leaf[leaf])
        same = differ == self.end
        self.at[todo[same]] = leaf[same]
        todo, leaf, differ = todo[~same], leaf[~same], differ[~same]
        if not len(todo):
            return todo
        # Down to the first node that branches at the differing symbol or behind it, or the leaf.
        here, by = self.root[self.group[todo]], np.full(len(todo), -1)
        while True:
            above = np.flatnonzero(here >= 0)
            above = above[self.position[here[above]] < differ[above]]
            if not len(above):
                break
            by[above] = self._edge(here[above], self._symbol(todo[above], self.position[here[above]]))
            here[above] = self.edge_child[by[above]]
        node = here.copy()
        # Where none branches at that symbol a node goes into the edge, one for each edge at a time, the highest first.
        branches = self.position[np.maximum(here, 0)] if len(self.position) else np.full(len(here), -1)
        inside = np.flatnonzero((here < 0) | (branches != differ))
        inside = inside[np.lexsort((differ[inside], here[inside]))]
        lead = inside[heads(here[inside])] if len(inside) else inside
        made = len(self.position) + np.arange(len(lead))
        self.position = np.concatenate((self.position, differ[lead]))
        top = by[lead] < 0
        self.root[self.group[todo[lead[top]]]] = made[top]
        self.edge_child[by[lead[~top]]] = made[~top]
        if len(inside):
            of = np.cumsum(np.append(False, here[inside][1:] != here[inside][:-1]))
            fits = differ[inside] == differ[lead][of]
            node[inside] = np.where(fits, made[of], -1)
        old = self._symbol(self.leaf[leaf[lead]], differ[lead])
        # A leaf for each new symbol at a node.
        wants = np.flatnonzero(node >= 0)
        symbol = self._symbol(todo[wants], differ[wants])
        sort = np.lexsort((symbol, node[wants]))
        first = sort[heads(node[wants][sort], symbol[sort])]
        leaves = len(self.leaf) + np.arange(len(first))
        self.leaf = np.concatenate((self.leaf, todo[wants[first]]))
        self.at[todo[wants[first]]] = leaves
        self.edge_node = np.concatenate((self.edge_node, made, node[wants[first]]))
        self.edge_symbol = np.concatenate((self.edge_symbol, old, symbol[first]))
        self.edge_child = np.concatenate((self.edge_child, here[lead], -1 - leaves))
        self._index()
        return todo[self.at[todo] < 0]

    def ranks(self) -> np.ndarray:
        """The rank of each suffix's leaf within its trie, in the order of the strings."""
        leaves, nodes = np.ones(len(self.leaf), np.int64), np.zeros(len(self.position), np.int64)
        position = self.position[self.edge_node]
        get = lambda child, of_nodes, of_leaves: np.where(child >= 0, of_nodes[np.maximum(child, 0)] if len(of_nodes) else 0, of_leaves[np.maximum(-1 - child, 0)])
        for k in range(self.end - 1, self.depth - 1, -1):
            e = np.flatnonzero(position == k)
            np.add.at(nodes, self.edge_node[e], get(self.edge_child[e], nodes, leaves))
        node_rank, leaf_rank = np.zeros(len(nodes), np.int64), np.zeros(len(leaves), np.int64)
        for k in range(self.depth, self.end):
            e = np.flatnonzero(position == k)
            if not len(e):
                continue
            e = e[np.lexsort((self.edge_symbol[e], self.edge_node[e]))]
            child, node = self.edge_child[e], self.edge_node[e]
            n = get(child, nodes, leaves)
            before = np.cumsum(n) - n
            new = heads(node)
            before = before - np.repeat(before[new], np.diff(np.append(new, len(e)))) + node_rank[node]
            inner = child >= 0
            node_rank[child[inner]], leaf_rank[-1 - child[~inner]] = before[inner], before[~inner]
        return leaf_rank[self.at]


def deep_shallow(text: np.ndarray, starts: np.ndarray, length: int = LENGTH, bucket: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, cut at the length, and for each a number that equal ones share. The text is padded by 8 bytes or more.
    They are bucketed by their first two bytes, or by given numbers that equal suffixes share and whose order then comes first; buckets are
    sorted to a shallow depth by a multikey quicksort, and groups that still agree by blind tries."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if bucket is None:
        bucket = (text[starts].astype(np.uint16) << 8) | (text[starts + 1] if length > 1 else 0)
    order = np.argsort(bucket, kind="stable" if bucket.dtype == np.uint16 else None)
    new = np.zeros(n, bool)
    new[heads(bucket[order])] = True
    shallow, end = min(SHALLOW, -(-length // 8)), -(-length // 8)
    multikey_quicksort(text, starts, order, new, shallow, length)
    if shallow < end:
        group = np.cumsum(new) - 1
        deep = np.flatnonzero(np.bincount(group)[group] > 1)
        if len(deep):
            g = group[deep]
            rank = BlindTries(text, starts[order[deep]], np.cumsum(np.append(False, g[1:] != g[:-1])), shallow, length).ranks()
            inner = np.argsort((g << 32) | rank, kind="stable")
            order[deep] = order[deep][inner]
            rank = rank[inner]
            new[deep[1:]] |= rank[1:] != rank[:-1]
    return order, np.cumsum(new) - 1


def settle(ids: np.ndarray, order: np.ndarray, group: np.ndarray) -> np.ndarray:
    """At each string: whether one under a smaller id is equal to it."""
    covered = np.zeros(len(order), bool)
    if len(order):
        own, new = ids[order], heads(group)
        covered[order] = own > np.repeat(np.minimum.reduceat(own, new), np.diff(np.append(new, len(order))))
    return covered


# --- candidates --------------------------------------------------------------------------------------------------


def _spans(row: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and (start, end), two 32-bit numbers as one, of the runs of bytes that strings at these places (by row, place) cover."""
    if not len(row):
        return row, np.zeros(0, "<u8")
    new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (place[1:] > place[:-1] + length))))
    last = np.append(new[1:], len(row)) - 1
    return row[new], np.stack([place[new], place[last] + length], 1).astype("<u4").reshape(-1).view("<u8")


def _wanted(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For about SETTLED bytes at once: their text, and start, row, place in the row, anchor and its hash of each candidate."""
    data, offsets = strings(batch.column("text"))
    places = batch.column("places").to_pylist()
    held, size = [], 0

    def joined() -> tuple[np.ndarray, ...]:
        base = np.cumsum([0] + [len(h[0]) for h in held])
        text = np.concatenate([h[0] for h in held] + [np.zeros(16, np.uint8)])
        start, anchor = (np.concatenate([h[k] + b for h, b in zip(held, base, strict=False)]) for k in (1, 4))
        return text, start, *(np.concatenate([h[k] for h in held]) for k in (2, 3)), anchor, np.concatenate([h[5] for h in held])

    for piece, own, rows, at in runs(data, offsets, CHUNK, length):
        start, anchor, hashes = minimizers(piece, own, length)
        marked = np.zeros(len(piece) + 1, bool)
        for r, begin, end, skip in zip(rows, own[:-1], own[1:], at, strict=True):
            p = np.frombuffer(places[r], "<u4").astype(np.int64) - skip
            marked[begin + p[(p >= 0) & (p < end - begin)]] = True
        wanted = marked[anchor]
        start, anchor = start[wanted], anchor[wanted]
        of = np.searchsorted(own, start, "right") - 1
        held.append((piece, start, rows[of], start - own[of] + at[of], anchor, hashes[anchor]))
        size += len(piece)
        if size >= SETTLED:
            yield joined()
            held, size = [], 0
    if held:
        yield joined()


class Carried:
    """Strings that several documents of a task share, each with the least id that it was sent under, for the next sort of the task."""

    def __init__(self, length: int, most: int = CARRIED) -> None:
        self.most, self.width = most, 8 * -(-length // 8)
        self.text, self.ids, self.bucket = np.zeros((0, self.width), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def keep(self, text: np.ndarray, starts: np.ndarray, ids: np.ndarray, bucket: np.ndarray, order: np.ndarray, group: np.ndarray) -> None:
        new = heads(group)
        size = np.diff(np.append(new, len(order)))
        often = np.flatnonzero(size > 2)
        often = often[np.argsort(-size[often], kind="stable")[: self.most]]
        sort = np.lexsort((ids[order], group))
        least = order[sort[new[often]]]
        self.text = text[starts[least][:, None] + np.arange(self.width)]
        self.ids, self.bucket = ids[least], bucket[least]


def _candidates(parts: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = Carried(length)
        for batch in batches:
            ids, keys = (batch.column(c).to_numpy() for c in ("id", "text_key"))
            squeeze = zstandard.ZstdCompressor(3).compress  # the shuffle's own codec does half as well on such text
            for text, start, row, place, anchor, hashes in _wanted(batch, length):
                if not len(start):
                    continue
                # Equal strings have equal anchors at equal places: those are the buckets.
                bucket = mix(hashes + (anchor - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                all_text = np.concatenate((text, carried.text.ravel(), np.zeros(16, np.uint8)))
                all_start = np.concatenate((start, len(text) + carried.width * np.arange(len(carried.ids))))
                all_ids, all_bucket = np.concatenate((ids[row], carried.ids)), np.concatenate((bucket, carried.bucket))
                order, group = deep_shallow(all_text, all_start, length, all_bucket)
                covered = settle(all_ids, order, group)[: len(start)]
                carried.keep(all_text, all_start, all_ids, all_bucket, order, group)
                r, spans = _spans(row[covered], place[covered], length)
                yield from _answers(3, parts, ids, keys, r, spans)
                # Those of the least id among their equals go on, as runs of strings at one anchor that follow each other.
                left = ~covered
                start, anchor, row, place, hashes = start[left], anchor[left], row[left], place[left], hashes[left]
                if not len(start):
                    continue
                new = heads(anchor, row, start - np.arange(len(start)))
                n = np.diff(np.append(new, len(start)))
                order, begin, buckets = _dealt(hashes[new], parts)
                out = {c: [] for c in ("hashes", "places", "data", "ids", "keys", "counts")}
                for a, b in zip(begin, np.append(begin[1:], len(order)), strict=True):
                    e = order[a:b]
                    size = n[e] + length - 1
                    flat = np.repeat(start[new[e]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    for c, v in (("hashes", planes((n[e] | (hashes[new[e]] & np.uint64(0xFF)).astype(np.int64) << 16).astype("<u4"), 3)), ("places", planes(place[new[e]].astype("<u4"))), ("data", squeeze(text[flat].tobytes())), *_documents(row[new[e]], ids, keys).items()):
                        out[c].append(v)
                yield _pack(kind=[2] * len(begin), bucket=buckets.tolist(), **out)

    return run


def _sort(parts: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All candidate strings of a partition, sorted; the bytes that strings of smaller ids cover."""
        got = {c: [] for c in ("n", "place", "id", "key", "text")}
        for batch in batches:
            yield from _passed(batch, 3)
            for r, i, k in _entries(batch, 2):
                for c, v in (("n", unplaned(r["hashes"], "<u4", 3)), ("place", unplaned(r["places"], "<u4")), ("id", i), ("key", k), ("text", np.frombuffer(zstandard.decompress(r["data"]), np.uint8))):
                    got[c].append(v)
        if not got["n"]:
            return
        n, place, ids, keys, text = (np.concatenate(got[c]) for c in ("n", "place", "id", "key", "text"))
        del got
        # Entries of equal anchors share a slot, and slots are sorted one after another, about SORTED strings at once.
        n, slot = (n & 0xFFFF).astype(np.int64), n >> 16
        text = np.concatenate((text, np.zeros(16, np.uint8)))
        begin = np.cumsum(n + length - 1) - (n + length - 1)
        sizes = np.bincount(slot, weights=n, minlength=256)
        step, found = np.floor((np.cumsum(sizes) - sizes) / SORTED), []
        for k in np.unique(step[sizes > 0]):
            mine = np.flatnonzero(step[slot] == k)
            entry = np.repeat(mine, n[mine])
            nth = np.arange(len(entry)) - np.repeat(np.cumsum(n[mine]) - n[mine], n[mine])
            covered = settle(ids[entry], *deep_shallow(text, begin[entry] + nth, length))
            found.append(_spans(entry[covered], (place[entry] + nth)[covered], length))
        r, spans = (np.concatenate([f[k] for f in found]) for k in range(2))
        yield from _answers_of(3, parts, ids[r], keys[r], spans)

    return run


# --- removal -----------------------------------------------------------------------------------------------------

REMOVED = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of bytes under overlapping or touching (start, end) pairs."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    top = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.concatenate(([True], spans[1:, 0] > top[:-1])))
    return np.stack([spans[new, 0], top[np.append(new[1:], len(spans)) - 1]], 1)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = strings(batch.column("text"))
        rows = []
        for k, spans in enumerate(batch.column("spans").to_pylist()):
            whole = data[offsets[k] : offsets[k + 1]]
            gone = merged(np.frombuffer(spans or b"", "<u4").astype(np.int64).reshape(-1, 2))
            kept, at = hashlib.sha256(), 0
            for a, b in gone.tolist():
                kept.update(whole[at:a])
                at = b
            kept.update(whole[at:])
            rows.append((len(whole), int((gone[:, 1] - gone[:, 0]).sum()), len(gone), kept.hexdigest()))
        n = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *n, pa.array([r[3] for r in rows], pa.string())], names=[x.split()[0] for x in REMOVED.split(", ")])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text_key, text. The key tells rows of equal ids apart: a hash of the text for these, 0 for all others, which packs well."""
    names_free(docs, id_col, text_col)
    number = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    repeated = stored(docs.groupBy(number.alias("again")).agg(F.count("*").alias("n")).filter("n > 1").select("again"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(number.alias("id"), text.alias("text")).join(repeated, F.col("id") == F.col("again"), "left")
    return rows.select("id", F.when(F.col("again").isNotNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long")).alias("text_key"), "text")


def _spans_of(rows: DataFrame, length: int) -> DataFrame:
    parts = shuffle_width(rows.sparkSession, rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0, PART)
    anchors = rows.mapInArrow(_anchors(parts, length), PACKED).repartitionById(parts, "bucket")
    places = anchors.mapInArrow(_meet(parts), PACKED).repartitionById(parts, "bucket").mapInArrow(_gathered(1, "<u4"), ANSWER)
    places = places.select(F.col("id").alias("of_id"), F.col("text_key").alias("of_key"), F.col("data").alias("places"))
    marked = rows.join(places, (F.col("id") == F.col("of_id")) & (F.col("text_key") == F.col("of_key")))
    packs = marked.select("id", "text_key", "text", "places").mapInArrow(_candidates(parts, length), PACKED).repartitionById(parts, "bucket")
    spans = packs.mapInArrow(_sort(parts, length), PACKED).repartitionById(parts, "bucket").mapInArrow(_gathered(3, "<u8"), ANSWER)
    return spans.select(F.col("id").alias("of_id"), F.col("text_key").alias("of_key"), F.col("data").alias("spans"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """id, text, and spans: packed pairs of 32-bit (start, end), null where nothing is removed."""
    rows = _keyed(docs, id_col, text_col)
    both = rows.join(_spans_of(rows, length), (F.col("id") == F.col("of_id")) & (F.col("text_key") == F.col("of_key")), "left")
    return both.select("id", "text", "spans")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = strings(batch.column("text"))
        out = []
        for k, spans in enumerate(batch.column("spans").to_pylist()):
            whole, at = data[offsets[k] : offsets[k + 1]].tobytes(), 0
            parts = []
            for a, b in merged(np.frombuffer(spans or b"", "<u4").astype(np.int64).reshape(-1, 2)).tolist():
                parts.append(whole[at:a])
                at = b
            out.append(b"".join([*parts, whole[at:]]))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], names=["id", "kept"])


def kept_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row: id and the bytes that stay; a cut may split a character."""
    return repeated_spans(docs, id_col, text_col, length).mapInArrow(_kept, "id long, kept binary").withColumn("id", F.nullif("id", F.lit(NO_ID)))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256."""
    found = repeated_spans(docs, id_col, text_col, length).mapInArrow(_removed, REMOVED)
    return found.withColumn("id", F.nullif("id", F.lit(NO_ID)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


#: Texts as hexadecimal digits, two a byte.
SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM p),
m AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING count(*) > 1),
c AS (SELECT w.doc_id, i FROM w JOIN m ON w.s = m.s WHERE first < w.doc_id),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS starts FROM c),
r AS (SELECT doc_id, i, sum(starts) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g),
s AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY doc_id, k),
q AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM s),
k AS (SELECT q.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS tail, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM q JOIN d ON q.doc_id = d.doc_id GROUP BY q.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
