"""Spelling variants: words one edit apart, by dynamic programming over sorted lists.

Words are maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased. To have variants in any corpus, one run in 31 loses a letter,
as a checksum of its document's id and itself has it (`slips`). The vocabulary has all results of at least 7 code points and 2 occurrences.

Two words one edit apart, the shorter of m code points, agree in their first floor(m / 2) code points or in their last m - floor(m / 2), so the
vocabulary is dealt out by length class, beginning and end; a pair that agrees in both belongs to its beginning. A group that is
too large is dealt out once more by the same rule, applied to what its words do not share yet, until it fits: the last step leaves one open place, so the
alphabet bounds it.

In a group, what its words do not share is put in order, with the length of the common prefix (LCP) of neighbours. Every word then goes through the list
level by level: words of a range with a common prefix share one row of its edit matrix, of which a band of three cells is kept. A range is
split where LCPs end, each part reuses the row of the range, and a part whose band exceeds one edit is skipped with all its words. Rows of
all words of many groups are computed at once. Only counts and best neighbours leave a group, never its pairs.

A word's form is its neighbour of most occurrences (ties: the least in code-point order) if it has ten times the word's own, and roots are
found by pointer jumping over forms: the number of rounds is the logarithm of a chain, and chains grow tenfold at each step.

Defined results: null and empty texts have no words; a null id counts as the empty text; repeated rows count each; very long words are
words like others; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import names_free, row_ranges, stored, strings, table

LEAST_LENGTH, LEAST_COUNT, TIMES, SLIP = 7, 2, 10, 31
CHUNK = 1 << 20
#: Distinct words that a task holds before it hands on their counts; rows that are compared at once; rows of a group before it is dealt out again.
HELD, ROWS, MOST = 1 << 17, 1 << 14, 20_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_NONE = 1 << 30

# --- vocabulary --------------------------------------------------------------------------------------------------


def slipped(word: str, start: int, slip: int = SLIP) -> str:
    """The word, or the word without a letter if the checksum of the id's and its bytes says so; start is the checksum of the id's bytes."""
    h = zlib.crc32(word.encode(), start)
    if slip and h % slip == 0:
        k = h % len(word)
        return word[:k] + word[k + 1 :]
    return word


def _counted(least: int, slip: int):
    run_of = re.compile(f"[a-zÀ-ÿ]{{{least},}}")  # a shorter run gives no word, and a match is a whole run

    def hand_on(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            data, offsets = strings(batch.column("text"))
            ids = batch.column("id").to_pylist()
            for a, b in row_ranges(offsets, CHUNK):
                low = _LOWER[data[offsets[a] : offsets[b]]].tobytes()
                for i in range(a, b):
                    text = low[offsets[i] - offsets[a] : offsets[i + 1] - offsets[a]].decode("utf-8", "replace")
                    start = zlib.crc32(f"{'' if ids[i] is None else ids[i]}:".encode())
                    for word, n in Counter(run_of.findall(text)).items():
                        word = slipped(word, start, slip)
                        if len(word) >= least:
                            held[word] += n
                    if len(held) >= HELD:
                        yield hand_on(held)
                        held = Counter()
        yield hand_on(held)

    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, count: int = LEAST_COUNT, slip: int = SLIP) -> DataFrame:
    """word and n, as a written table."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = rows.mapInArrow(_counted(least, slip), "word string, n long")
    return stored(words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= count))


# --- groups ------------------------------------------------------------------------------------------------------

_MEMBER = ("m", "a", "b", "below", "key", "word", "n", "rest")


def _members(rows: DataFrame) -> DataFrame:
    """Rows (word, n, m, a, b, below) with their group's key, of class, beginning and end, and what the word does not share."""
    size = F.length("word")
    begin, end = F.substring("word", 1, F.col("a")), F.substring("word", size - F.col("b") + 1, F.col("b"))
    rows = rows.withColumn("key", F.concat_ws("|", F.col("m").cast("string"), begin, F.when(F.col("b") > 0, end).otherwise(F.lit(""))))
    return rows.withColumn("rest", F.substring("word", F.col("a") + 1, size - F.col("a") - F.col("b"))).select(*_MEMBER)


def _dealt(rows: DataFrame) -> DataFrame:
    """Each row in the two parts of its group: r code points are not shared yet, and a pair agrees in x more at the beginning or in r - x at the end."""
    r = F.col("m") - F.col("a") - F.col("b")
    x = F.floor(r / 2).cast("int")
    parts = F.array(
        F.struct((F.col("a") + x).alias("a"), F.col("b").alias("b"), F.col("below").alias("below")),
        F.struct(F.col("a").alias("a"), (F.col("b") + r - x).cast("int").alias("b"), (F.col("a") + x).alias("below")),
    )
    return _members(rows.select("word", "n", "m", F.explode(parts).alias("p")).select("word", "n", "m", "p.*"))


def members(words: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """The words in the groups of their length and of the length before: pairs of equal length m, and of m and m + 1, are in class m."""
    classes = F.filter(F.array(F.length("word"), F.length("word") - 1), lambda m: m >= least)
    zero = F.lit(0)
    return _dealt(words.select("word", "n", F.explode(classes).alias("m"), zero.alias("a"), zero.alias("b"), F.lit(_NONE).alias("below")))


# --- the sorted list ---------------------------------------------------------------------------------------------


def common_prefixes(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """How many leading code points the strings of each two places share."""
    out = np.zeros(len(one), np.int64)
    left, d = np.arange(len(one)), 0
    while len(left):
        left = left[(size[one[left]] > d) & (size[two[left]] > d)]
        left = left[flat[begin[one[left]] + d] == flat[begin[two[left]] + d]]
        d += 1
        out[left] = d
    return out


def near_in_lists(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (q, w) of all strings of one group that are exactly one edit apart. Strings (code points in flat) are in order within their
    group, and differ there."""
    n = len(size)
    first = np.concatenate(([True], group[1:] != group[:-1]))
    lcp = np.concatenate(([0], common_prefixes(flat, begin, size, np.arange(n - 1), np.arange(1, n))))
    lcp[first] = -1
    heads = np.flatnonzero(first)
    ends = np.append(heads[1:], n)
    of = np.cumsum(first) - 1
    q = np.flatnonzero((ends - heads)[of] > 1)
    lo, hi = heads[of[q]], ends[of[q]]
    # Cells of the row d of the edit matrix: j = d - 1, d and d + 1 code points of q; 2 stands for more than one edit.
    below, level, above = np.full(len(q), 2, np.int8), np.zeros(len(q), np.int8), np.ones(len(q), np.int8)
    found_q, found_w = [], []

    def other(j: int, of: np.ndarray, c: np.ndarray) -> np.ndarray:
        """1 where the j-th code point of q is not c, or is not there."""
        inside = (size[of] > j) if j >= 0 else np.zeros(len(of), bool)
        return (~inside | (flat[np.where(inside, begin[of] + j, 0)] != c)).astype(np.int8)

    d = 0
    while len(q):
        cuts = np.flatnonzero(lcp <= d)
        a, b = np.searchsorted(cuts, lo), np.searchsorted(cuts, hi)
        count = b - a
        from_ = np.repeat(np.arange(len(q)), count)
        at = np.arange(len(from_)) - np.repeat(np.cumsum(count) - count, count) + a[from_]
        part = cuts[at]
        goes_on = size[part] > d  # a string that ends here is no range below
        from_, at, part = from_[goes_on], at[goes_on], part[goes_on]
        hi = np.append(cuts, n)[at + 1]
        q, lo = q[from_], part
        c = flat[begin[part] + d]
        below, level, above = below[from_], level[from_], above[from_]
        new_below = np.minimum(below + other(d - 1, q, c), level + 1)
        new_level = np.minimum(np.minimum(level + other(d, q, c), above + 1), new_below + 1)
        new_above = np.minimum(above + other(d + 1, q, c), new_level + 1)
        length = size[q]
        new_below[length < d] = new_level[length < d + 1] = new_above[length < d + 2] = 2
        d += 1
        over = length - d + 1  # the cell of the whole q, if it lies in the band
        cell = np.where(over == 0, new_below, np.where(over == 1, new_level, np.where(over == 2, new_above, 2)))
        hit = np.flatnonzero((size[lo] == d) & (cell == 1))
        found_q.append(q[hit]), found_w.append(lo[hit])
        alive = np.flatnonzero((np.minimum(np.minimum(new_below, new_level), new_above) <= 1) & ((hi - lo > 1) | (size[lo] > d)))
        q, lo, hi, below, level, above = q[alive], lo[alive], hi[alive], new_below[alive], new_level[alive], new_above[alive]
    none = [np.zeros(0, np.int64)]
    return np.concatenate(found_q + none), np.concatenate(found_w + none)


def _near(rows: pa.Table) -> pa.RecordBatch:
    """word, n_near, form_n and form of the words of whole groups, ordered by key and rest."""
    group = pc.run_end_encode(rows.column("key").combine_chunks()).run_ends.to_numpy()
    group = np.repeat(np.arange(len(group)), np.diff(group, prepend=0))
    rest = rows.column("rest").combine_chunks()
    size = pc.utf8_length(rest).to_numpy().astype(np.int64)
    begin = np.cumsum(size) - size
    data, _ = strings(rest)
    flat = np.append(np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), np.uint32(0))
    q, w = near_in_lists(flat, begin, size, group)
    m, a, b, below, n = (rows.column(c).to_numpy() for c in ("m", "a", "b", "below", "n"))
    open_ = (m - a - b).astype(np.int64)
    good = np.minimum(size[q], size[w]) == open_[q]  # two words of m + 1 belong to the next class
    good &= (below[q] == _NONE) | (a[q] + common_prefixes(flat, begin, size, q, w) < below[q])
    q, w = q[good], w[good]
    words = rows.column("word").combine_chunks()
    rank = np.empty(len(words), np.int64)
    rank[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
    order = np.lexsort((rank[w], -n[w], q))
    q, w = q[order], w[order]
    head = np.flatnonzero(np.concatenate((np.ones(min(len(q), 1), bool), q[1:] != q[:-1])))
    counts = np.diff(np.append(head, len(q)))
    return pa.RecordBatch.from_arrays([words.take(pa.array(q[head])), pa.array(counts.astype(np.int64)), pa.array(n[w[head]]), words.take(pa.array(w[head]))], names=["word", "n_near", "form_n", "form"])


def _near_of_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Takes so many rows at once that their groups are whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(x.num_rows for x in held) >= ROWS:
            rows = pa.Table.from_batches(held).combine_chunks()
            keys = rows.column("key")
            last = pc.equal(keys, keys[-1])
            whole = rows.num_rows - pc.sum(last).as_py()
            if whole:
                yield _near(rows.slice(0, whole))
            held = rows.slice(whole).to_batches()
    if held:
        yield _near(pa.Table.from_batches(held).combine_chunks())


def neighbours(words: DataFrame, least: int = LEAST_LENGTH, most: int = MOST) -> DataFrame:
    """word, n_near, form_n and form (the near word of most occurrences) of every word with a near one, as a written table."""
    rows, parts = members(words, least), []
    while True:
        large = stored(rows.groupBy("key").agg(F.count("*").alias("_n")).filter((F.col("_n") > most)).select(F.col("key").alias("of_key")))
        can = F.col("m") - F.col("a") - F.col("b") > 1
        if not large.limit(1).count():
            parts.append(rows)
            break
        # A group is named by its class and what it shares, so no key comes again; one with one open place is left as it is.
        again = stored(rows.join(large.hint("merge"), F.col("key") == F.col("of_key"), "left_semi").filter(can))
        left = rows.join(large.hint("merge"), F.col("key") == F.col("of_key"), "left_anti")
        parts += [left, rows.join(large.hint("merge"), F.col("key") == F.col("of_key"), "left_semi").filter(~can)]
        if not again.limit(1).count():
            break
        rows = _dealt(again.select("word", "n", "m", "a", "b", "below"))
    found = None
    for part in parts:
        near = part.repartition("key").sortWithinPartitions("key", "rest").mapInArrow(_near_of_groups, "word string, n_near long, form_n long, form string")
        found = near if found is None else found.unionByName(near)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("x"))
    return stored(near.select("word", "n_near", (-F.col("x.less")).alias("form_n"), F.col("x.form").alias("form")))


def rooted(forms: DataFrame) -> DataFrame:
    """word and root for rows (word, form): forms of forms, each round twice as far, until nothing changes; a written table."""
    now = stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while now.filter("moved").limit(1).count():
        up = now.select(F.col("word").alias("of"), F.col("root").alias("up"))
        now = stored(now.join(up.hint("merge"), F.col("root") == F.col("of"), "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")))
    return now.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, count: int = LEAST_COUNT, times: int = TIMES, slip: int = SLIP, most: int = MOST) -> DataFrame:
    """Per word: n, n_near, form and form_n (null without), root."""
    names_free(docs, id_col, text_col)
    words = vocabulary(docs, id_col, text_col, least, count, slip)
    near = neighbours(words, least, most).withColumnRenamed("word", "of").withColumnRenamed("form", "best").withColumnRenamed("form_n", "best_n")
    is_form = F.col("best_n") >= times * F.col("n")
    both = words.join(near.hint("merge"), F.col("word") == F.col("of"), "left")
    both = stored(both.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")))
    roots = rooted(both.filter("form is not null")).withColumnRenamed("word", "of").hint("merge")
    return both.join(roots, F.col("word") == F.col("of"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


#: Words one edit apart by all words less a letter: equal to the other word, or to the other word less a letter at the same place.
SQL = r"""
WITH RECURSIVE r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
), g AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY ALL
), h AS (
  SELECT run, n, xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(regexp_extract_all(hex(encode(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', run))), '..'),
           lambda p: list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda k: (('0x' || p)::BIGINT >> k) & 1)))),
           lambda c, x: xor(c >> 1, 3988292384::BIGINT * (xor(c, x) & 1)))) AS h FROM g
), w AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM h
), v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)
), e AS (
  SELECT DISTINCT a.word AS x, b.word AS y, b.n FROM d a JOIN d b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.less = v.word
  UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.less = v.word
), k AS (SELECT x, count(*) AS n_near FROM e GROUP BY x
), t AS (SELECT x, y, n, row_number() OVER (PARTITION BY x ORDER BY n DESC, y) AS place FROM e
), f AS (
  SELECT word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN t.n >= 10 * v.n THEN y END AS form, CASE WHEN t.n >= 10 * v.n THEN t.n END AS form_n
  FROM v LEFT JOIN k ON word = k.x LEFT JOIN t ON word = t.x AND place = 1
), o AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, o.root FROM f JOIN o ON f.form = o.word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN o USING (word)
"""
