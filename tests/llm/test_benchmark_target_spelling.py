"""Decontamination, importance resampling and spelling variants against brute force."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.test_operators import SCHEMA, nasty_rows
from tidemark.llm import decontamination, importance, spelling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEN = "one Two three four five six seven eight nine ten"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def nasty(spark):
    """With further columns whose names the operators use inside."""
    more = "words array<int>, hashes string, fp long, at int, score long, rank long, word string, form string, m int, key string"
    rows = [*nasty_rows(), (20, TEN + " tail", "en", "s1", 1), (21, "head " + TEN + " " + TEN, "en", "s1", 1), (22, "ten", "en", "s1", 1), (23, "É é ÉÉ éé " * 9, "en", "s1", 1)]
    return spark.createDataFrame([(*r, 1, "d", 2, "z", 3, [1], 0.5, 9, [1], "h", 1, 2, 3, 4, "w", "f", 5, "k") for r in rows], f"{SCHEMA}, {more}")


@pytest.fixture(scope="module")
def items(spark):
    rows = [
        (1, TEN, "x"), (2, TEN.upper() + "!", "x"), (3, None, "x"), (4, " .,; ", "x"), (5, "", "x"), (6, "tok10 tok11", "x"), (None, "tok20", "x"), (7, "tok1 tok2 tok4", "x"),
        (8, " ".join(f"tok{k}" for k in range(30, 60)), "x"), (9, "word0x0", "x"), (10, "a a a a a a a a a a a a", "x"), (8, "ten", "x"), (11, "É é ÉÉ éé É é ÉÉ éé É é ÉÉ", "x"),
    ]
    return spark.createDataFrame(rows, "item_id long, text string, wid string")


# --- decontamination


def brute_hits(docs, benchmark):
    windows = collections.defaultdict(set)
    for item, text in benchmark:
        w = words(text)
        n = min(len(w), 10)
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add("null" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (t := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[t]
        out.append((doc, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def found_hits(df):
    return sorted(((r["id"], r["n_words"], r["n_hit"], tuple(r["items"] or ())) for r in df.collect()), key=str)


@pytest.mark.parametrize("most", [decontamination.MOST_FINGERPRINTS, 0])
def test_decontamination(nasty, items, most):
    want = brute_hits([(r["doc_id"], r["text"]) for r in nasty.select("doc_id", "text").collect()], [(r[0], r[1]) for r in items.collect()])
    assert found_hits(decontamination.contamination(nasty, items, most=most)) == want
    assert sum(r[2] > 0 for r in want) > 5


def test_decontamination_of_empty_tables(nasty, items):
    rows = decontamination.contamination(nasty, items.filter("false")).collect()
    assert len(rows) == nasty.count() and not any(r["n_hit"] for r in rows)
    assert decontamination.contamination(nasty.filter("false"), items).collect() == []


def test_clean_documents(nasty, items):
    kept = decontamination.clean_of(nasty, items)
    assert kept.columns == nasty.columns
    bad = {(d, n, h) for d, n, h, _ in brute_hits([(r["doc_id"], r["text"]) for r in nasty.select("doc_id", "text").collect()], [(r[0], r[1]) for r in items.collect()]) if h}
    assert kept.count() == nasty.count() - len([1 for r in found_hits(decontamination.contamination(nasty, items)) if r[2]])
    assert not {r["doc_id"] for r in kept.select("doc_id").collect()} & {d for d, _, _ in bad if d is not None and d > 19}


def test_spans_that_overlap_are_counted_once(spark):
    df = spark.createDataFrame([([(0, 10), (3, 10), (20, 1), (20, 10), (5, 2)],), ([],)], "s array<struct<at:int,length:int>>")
    assert [r[0] for r in df.select(decontamination.covered(F.col("s"))).collect()] == [23, 0]


def test_decontamination_is_native(nasty, items):
    plan = decontamination.contamination(nasty, items)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- importance


@given(st.lists(st.binary(max_size=90), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_composed_checksums(parts):
    a, b = parts[0], b"".join(parts[1:])
    got = importance.composed(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([len(b)]))
    assert int(got[0]) == zlib.crc32(a + b" " + b)


def brute_features(text, buckets=10_000):
    w = words(text)
    return [zlib.crc32(x.encode()) % buckets for x in w] + [zlib.crc32(f"{x} {y}".encode()) % buckets for x, y in zip(w, w[1:])]


@pytest.mark.parametrize("most", [importance.MOST_WORDS, 5, 0])
def test_the_dictionary_changes_no_feature(most):
    texts = [f"{TEN} é {k} {'x' * (k * 9)}, {TEN.upper()}{chr(10)}tail{k % 3}" for k in range(40)] + ["", " ", "a", "a  b", "x" * 70_000 + " y " + "z" * 300]
    dictionary, got = importance.Dictionary(most), []
    for k in range(0, len(texts), 4):
        raw = [t.encode() for t in texts[k : k + 4]]
        row, bucket, n = importance.features(dictionary, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        got += [(sorted(bucket[row == i].tolist()), n[i]) for i in range(len(raw))]
    assert got == [(sorted(brute_features(t)), len(words(t))) for t in texts]
    assert len(dictionary.automaton) <= most


def brute_draw(docs, target, percent=25, least=20):
    s, t = collections.Counter(), collections.Counter()
    for _, x in docs:
        s.update(brute_features(x))
    for x in target:
        t.update(brute_features(x))
    all_s, all_t = float(sum(s.values())), float(sum(t.values()))
    gain = {k: math.floor(1000 * math.log(((t[k] + 1.0) * (all_s + 10000)) / ((s[k] + 1.0) * (all_t + 10000)))) for k in range(10_000)}
    rows = []
    for doc, x in docs:
        f = brute_features(x)
        weight = sum(gain[k] for k in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append((doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x))))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = [(*r[:4], k + 1) for k, r in enumerate(able[: percent * len(able) // 100])]
    return sorted(drawn + [(*r[:4], None) for r in able[len(drawn) :]] + [(*r[:4], None) for r in rows if r[4] < least], key=str)


def test_importance(nasty, items):
    got = importance.resampled(nasty, items, percent=60)
    want = brute_draw([(r["doc_id"], r["text"]) for r in nasty.select("doc_id", "text").collect()], [r["text"] for r in items.collect()], 60)
    assert sorted((tuple(r) for r in got.select("id", "n_features", "weight", "score", "rank").collect()), key=str) == want
    assert importance.resampled(nasty.filter("false"), items).collect() == []
    assert importance.resampled(nasty, items.filter("false")).count() == nasty.count()


# --- spelling


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def brute_variants(docs, slip=31):
    n = collections.Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % slip == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and edits(v, w) == 1] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n.get(form[w]), root))
    return sorted(out)


def spelt():
    """Many neighbours of all kinds at every place, chains of forms, letters beyond ASCII, runs of one letter."""
    rows, base = [], ["abcdefgh", "aaaaaaa", "aaaaaaaa", "éàüößñçh", "zzzzzzzz", "variante", "b" * 300]
    for k, w in enumerate(base):
        rows.append((w, 120))
        for i in range(0, len(w), 1 if len(w) < 20 else 60):
            rows += [(w[:i] + "q" + w[i:], 3), (w[:i] + "x" + w[i + 1 :], 12 if i == k else 2), (w[:i] + w[i + 1 :], 2), (w[:i] + "xy" + w[i + 1 :], 2)]
    return rows


@pytest.mark.parametrize("most", [spelling.MOST, 3, 1])
def test_spelling(spark, nasty, most):
    text = [(100 + k, " ".join([w.upper() if k % 2 else w] * n)) for k, (w, n) in enumerate(spelt())]
    docs = nasty.select("doc_id", "text", "word", "key", "m").unionByName(spark.createDataFrame(text, "doc_id long, text string").selectExpr("doc_id", "text", "'w' AS word", "'k' AS key", "1 AS m"))
    want = brute_variants([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()])
    got = spelling.variants(docs, most=most).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert sorted(map(tuple, got)) == want
    assert sum(r[3] is not None for r in want) > 20 and max(r[2] for r in want) > 10


def test_spelling_of_an_empty_table(nasty):
    assert spelling.variants(nasty.filter("false")).collect() == []
    assert spelling.variants(nasty.filter("doc_id < 4")).collect() == []


def test_roots_of_a_long_chain(spark):
    chain = [(f"w{k:04d}", f"w{k + 1:04d}") for k in range(300)]
    got = spelling.rooted(spark.createDataFrame(chain, "word string, form string"))
    assert {r["root"] for r in got.collect()} == {"w0300"} and got.count() == 300


@given(st.lists(st.text("abé", min_size=1, max_size=5), min_size=2, max_size=25, unique=True))
@settings(max_examples=80, deadline=None)
def test_near_in_lists(found):
    found.sort()
    size = np.array([len(w) for w in found])
    flat = np.append(np.frombuffer("".join(found).encode("utf-32-le"), np.uint32), np.uint32(0))
    q, w = spelling.near_in_lists(flat, np.cumsum(size) - size, size, np.zeros(len(found), int))
    assert sorted(zip(q.tolist(), w.tolist())) == [(i, j) for i, a in enumerate(found) for j, b in enumerate(found) if edits(a, b) == 1]
