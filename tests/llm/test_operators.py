"""Every operator against brute force, on the smallest tables and on rows made to hurt."""

import collections
import hashlib
import itertools
import json
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import chat, exact_dedup, line_rules, mixing, near_dedup, packing, registry, sharding, suffix_dedup, token_counts, toxicity
from tidemark.llm.common import cut, mark, numbered, tokenizer_file, uniform_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{k % 977}x{k * k % 313}" for k in range(60_000))
SHARED = "a passage of more than fifty bytes that several documents repeat word for word, ünïcödé too. "


def nasty_rows():
    """Nulls, empty and blank texts, a very long text, ties, repeated rows, near copies and awkward characters."""
    base = " ".join(f"tok{k}" for k in range(200))
    near = base.replace("tok100 ", "other ")
    rows = [
        (1, None, "en", "s1", 0), (2, "", "en", None, 0), (3, " \t\n\r\x0b\x0c ", None, "s1", 7), (None, "no id at all here", "en", "s2", 1),
        (4, LONG, "en", "s1", 1), (5, LONG, "en", "s2", 1), (6, "same  text\nhere", "en", "s2", 1), (7, "same text here", "en", "s2", 1),
        (7, "same text here", "en", "s2", 1), (8, "sametext here ", "de", "s1", 1), (9, base, "en", "s1", 1), (10, near, "en", "s3", 1),
        (11, SHARED * 3 + "tail eleven", "en", "s3", 1), (12, "head twelve " + SHARED + "x", "en", "", 1), (13, "<|endoftext|> é ́ \U0001f600 </s>[INST]", "en", "s3", 1),
        (14, "one two three four", "en", "s3", 1), (15, "one two three four", "en", "s1", 1), (2**40, "a", "en", "s1", 1), (-5, "line\nline\nline\n" * 30, "en", "s1", 1),
        (16, "x" * 5000, "en", "s1", 1), (17, "x" * 4000, "en", "s2", 1),
    ]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, digest string, tag int, size string, _key int, node array<int>, u double, n int"


@pytest.fixture(scope="module")
def nasty(spark):
    """With further columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 1, "d", 2, "z", 3, [1], 0.5, 9) for r in nasty_rows()], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def words(t):
    return WORD.findall(t or "")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, sf, name):
    got = registry.QUERIES[name](spark, sf)
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(registry.ORACLES[name])
    cols, names = sorted(got.columns), [c[0] for c in want.description]
    assert cols == sorted(names)
    rows = lambda t, own: sorted(str([r[own.index(c)] for c in cols]) for r in t)
    assert rows(got.collect(), got.columns) == rows(want.fetchall(), names)


# --- exact dedup


def best(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0))
    return {k: (None if min(v)[1] else min(v)[2], len(v)) for k, v in groups.items()}


def test_exact_dedup(nasty, nothing):
    got = exact_dedup.exact_dedup(nasty, exact_dedup.first_arrival(), segment=4).toPandas()
    want = best([(r[0], r[1]) for r in nasty_rows()])
    assert len(got) == len(nasty_rows()) and got.kept.sum() == len(want)
    for r in nasty_rows():
        key = re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")
        mine = got[got.digest.map(bytes) == hashlib.sha256(key.encode()).digest()]
        assert set(mine.group_size) == {want[key][1]}
        assert {None if np.isnan(x) else int(x) for x in mine.keep_id.astype(float)} == {want[key][0]}
        assert mine.kept.sum() == 1
    stay = exact_dedup.keep_first(nasty)
    assert stay.columns == nasty.columns and stay.count() == len(want)
    assert exact_dedup.exact_dedup(nothing, exact_dedup.first_arrival()).count() == 0


@settings(deadline=None, max_examples=20)
@given(st.integers(1, 3000), st.integers(0, 2**32))
def test_perfect_hash_is_a_bijection(n, seed):
    keys = np.random.default_rng(seed).integers(0, 256, (n, 32), np.uint8)
    levels, slots = exact_dedup.build_hash(keys)
    assert sorted(slots) == list(range(n))
    assert (exact_dedup.look_up(levels, keys) == slots).all()


def test_members_are_checked_byte_by_byte(spark):
    old = spark.createDataFrame([(i, f"old {i}") for i in range(50)], "doc_id long, text string")
    new = spark.createDataFrame([(100 + i, f"new {i}") for i in range(50)] + [(200, "old 7 ")], "doc_id long, text string")
    rows = exact_dedup.digest_rows(old.unionByName(new))
    index = exact_dedup.build_history(exact_dedup.distinct_digests(rows.filter("id < 100"), 3))
    got = exact_dedup.merge_batch(exact_dedup.distinct_digests(rows.filter("id >= 100"), 3), index).toPandas()
    assert collections.Counter(got.origin) == {"history": 49, "repeat": 1, "new": 50}
    assert got[got.origin == "repeat"].id.tolist() == [200]  # longer than the stored winner


# --- near dedup


def near_truth(rows, least=0.8):
    def bag(t):
        w = words(t)
        return collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)])

    bags = [bag(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        common = sum((bags[a] & bags[b]).values())
        if common >= least * (sum(bags[a].values()) + sum(bags[b].values()) - common):
            root[find(b)] = find(a)
    classes = collections.defaultdict(list)
    for k in range(len(rows)):
        classes[find(k)].append(k)
    return sorted(sorted(str(rows[k][0]) for k in c) for c in classes.values())


def test_near_dedup(nasty, nothing):
    got = near_dedup.near_classes(nasty).toPandas()
    classes = collections.defaultdict(list)
    for r in got.itertuples():
        classes["none" if np.isnan(float(r.class_id or np.nan)) else int(r.class_id)].append("None" if np.isnan(float(r.id if r.id is not None else np.nan)) else str(int(r.id)))
    assert sorted(sorted(c) for c in classes.values()) == near_truth([(r[0], r[1]) for r in nasty_rows()])
    assert got.kept.sum() == len(classes) and (got.groupby("class_id", dropna=False).kept.sum() == 1).all()
    assert near_dedup.first_of_each(nasty).count() == len(classes)
    assert near_dedup.near_classes(nothing).count() == 0


def test_near_dedup_of_a_loose_group(spark):
    """Many copies of one text, each changed on its own, so that most pairs are no links: classes are those of brute force."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(120):
        w = list(base)
        for at in rng.choice(150, rng.integers(1, 6), replace=False):
            w[at] = f"new{i}_{at}"
        rows.append((i, " ".join(w)))
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert sorted(sorted(map(str, g.id)) for _, g in got.groupby("class_id")) == near_truth(rows)


    small = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string"), block=8, most=2000).toPandas()  # many blocks
    assert sorted(sorted(map(str, g.id)) for _, g in small.groupby("class_id")) == near_truth(rows)


def test_near_dedup_of_repeated_rows(spark, monkeypatch):
    """A thousand equal rows are one node with one text, wherever texts are joined or compared."""
    base = " ".join(f"w{k}" for k in range(200))
    rows = [(None, base)] * 1000 + [(1, base.replace("w100 ", "other ")), (2, "something else altogether of six words")]
    seen, plain = [], near_dedup.links

    def spy(pairs, texts, least):
        seen.append((texts.count(), texts.select("node").distinct().count()))
        return plain(pairs, texts, least)

    monkeypatch.setattr(near_dedup, "links", spy)
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).toPandas()
    assert len(got) == 1002 and got.kept.sum() == 2 and sorted(got.class_size.unique()) == [1, 1001]
    assert seen and all(x == (2, 2) for x in seen)


def test_near_dedup_of_very_long_texts(spark):
    """Near copies of megabytes each are compared in blocks of a bounded number of shingles."""
    rng = np.random.default_rng(2)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 200_000)]
    rows = []
    for i in range(6):
        w = list(base)
        for at in rng.choice(len(w), 2000 + 1500 * i, replace=False):
            w[at] = f"n{i}"
        rows.append((i, " ".join(w)))
    t = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_classes(t, most=1 << 16).toPandas()
    assert sorted(sorted(map(str, g.id)) for _, g in got.groupby("class_id")) == near_truth(rows)


def test_blocks_emit_what_joins_the_same_components():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 40, 60), rng.integers(0, 40, 60)
    keep = near_dedup.spanning(a, b)

    def parts(pairs):
        root = list(range(40))
        for x, y in pairs:
            root = [root[y] if r == root[x] else r for r in root]
        return [[i for i in range(40) if root[i] == root[k]] for k in range(40)]

    assert parts(zip(a, b, strict=True)) == parts(zip(a[keep], b[keep], strict=True)) and len(keep) < 40


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    h = rng.integers(1, 2**63, 300).astype(np.uint64)
    w = rng.integers(1, 5, 300)
    v = np.where(rng.random(300) < 0.2, np.maximum(w - 1, 0), w)
    row = np.concatenate([np.zeros(300, int), np.ones((v > 0).sum(), int)])
    s = near_dedup.signatures(row, np.concatenate([h, h[v > 0]]), np.concatenate([w, v[v > 0]]), 2, 2000)
    assert abs((s[0] == s[1]).mean() - np.minimum(w, v).sum() / np.maximum(w, v).sum()) < 0.04


# --- mixing


def test_mixing(nasty, nothing, docs):
    for table in (nasty, docs):
        got = mixing.mix_sources(table).toPandas()
        size = collections.Counter()
        for r in table.select("source", "text").collect():
            size[r[0]] += len(words(r[1]))
        order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + ([None] if None in size else [])
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
        target, capped = {}, set()
        while True:
            free = [s for s in order if s not in capped]
            left = sum(size.values()) - sum(3 * size[s] for s in capped)
            target = {s: 3.0 * size[s] if s in capped else left * weight[s] / sum(weight[f] for f in free) for s in order}
            over = [s for s in free if target[s] > 3 * size[s]]
            if not over:
                break
            capped |= set(over)
        assert (got.copies * got["size"] <= 3 * got["size"]).all()
        for s, g in got.groupby(got.source.map(lambda x: x if isinstance(x, str) else None), dropna=False):
            s = s if isinstance(s, str) else None
            assert np.allclose(g.target, target[s], rtol=1e-9)
            assert abs((g.copies * g["size"]).sum() - target[s]) <= max(g["size"].max(), 1)
        again = mixing.mix_sources(table, few=0).toPandas()  # joined with salt
        assert sorted(map(str, got[["id", "size", "copies"]].to_numpy())) == sorted(map(str, again[["id", "size", "copies"]].to_numpy()))
    mixed = mixing.mixed_documents(nasty)
    assert mixed.columns == nasty.columns and mixed.count() == mixing.mix_sources(nasty).agg({"copies": "sum"}).first()[0]
    assert mixing.mix_sources(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0


def test_mixing_meets_targets_with_null_and_repeated_ids(spark):
    text = "ten words of text that are all the same here"
    null = spark.createDataFrame([(None, text, f"s{i % 3}") for i in range(3000)], "doc_id long, text string, source string").repartition(5)
    rows = [(i if i > 400 else 7, text if i <= 400 else text[: 6 + i % 38], "abc"[i % 3]) for i in range(3000)]
    for t in (null, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)):
        got = mixing.mix_sources(t).toPandas()
        for _, g in got.groupby("source"):
            assert abs((g.copies * g["size"]).sum() - g.target.iloc[0]) <= 10 and g.copies.max() - g.copies.min() <= 1
        mixed = mixing.mixed_documents(t).groupBy("source").count().toPandas().set_index("source")["count"]
        assert mixed.to_dict() == got.groupby("source").copies.sum().to_dict()


def test_inclusion_follows_the_probabilities(spark):
    """Many sources of the same texts are many draws: each size class is drawn as often as its p says, and so is each document."""
    texts = [" ".join(["w"] * n) for n in (1, 2, 3, 5, 9, 14, 20, 33, 47, 70, 120, 260)] * 6
    docs = spark.createDataFrame([(i, t, f"{s:03}") for s in range(210) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = mixing.mix_sources(docs).toPandas()
    got["drawn"] = got.copies - np.floor(got.target / got.source_size)
    got["rate"] = (got.target / got.source_size).round(6)
    assert got.rate.nunique() == 3 and got[got.p < 1].groupby("rate").p.nunique().min() > 2  # unequal within a source
    for _, g in got[got.p < 1].groupby(["rate", "size"]):
        p, n = g.p.iloc[0], len(g)
        assert g.p.nunique() == 1 and abs(g.drawn.mean() - p) <= 3 * np.sqrt(p * (1 - p) / n) + 0.02  # the cut in words has a bias of a document
    for _, g in got[got.p < 1].groupby(["rate", "id"]):
        p, n = g.p.iloc[0], len(g)
        assert abs(g.drawn.mean() - p) <= 4.5 * np.sqrt(p * (1 - p) / n) + 0.02
    assert (got[got.p >= 1].drawn == 1).all()
    for _, g in got.groupby("source"):
        assert abs((g.p * g["size"]).sum() + (np.floor(g.target / g.source_size) * g["size"]).sum() - g.target.iloc[0]) < 1e-6


def test_rows_that_agree_are_numbered_apart(spark):
    rows = cut(spark.createDataFrame([(None, "s")] * 5000 + [(1, "s"), (1, "t")], "id long, source string").repartition(7))
    got = numbered(rows, ["id", "source"], "nth")
    marked = got.withColumn("u", uniform_of(mark("x", *[got[c] for c in ("id", "source", "nth")]))).toPandas()
    assert sorted(marked[marked.id.isna()].nth) == list(range(5000)) and marked.u.nunique() == 5002
    assert np.bincount((marked.u * np.ceil(np.sqrt(5002))).astype(int)).max() < 3 * np.sqrt(5002)  # no bucket takes them all


# --- line rules


def base_rules(t):
    w = words(t)
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(win)
    covered = {j for i, x in enumerate(win) if n[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_line_rules(spark, nasty, nothing, docs):
    for table in (nasty, docs):
        rows = table.select("doc_id", "text").collect()
        want = collections.Counter((str(r[0]), *base_rules(r[1])) for r in rows)
        got = line_rules.line_verdicts(table).toPandas()
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        ids = ["None" if np.isnan(float(x if x is not None else np.nan)) else str(int(x)) for x in got.id]
        assert collections.Counter((i, *map(int, r)) for i, r in zip(ids, got[names].to_numpy(), strict=True)) == want
    assert line_rules.line_verdicts(nothing).count() == 0


def test_frequent_lines_go_and_depleted_documents_are_rejected(spark):
    own = lambda i: " ".join(f"own{i}w{k}" for k in range(70))
    menu = "Home  About 12 Contact"
    rows = [(i, f"{own(i)}\n{menu if i % 2 else menu.upper().replace('12', '99')}", "h1") for i in range(30)]
    rows += [(100 + i, "\n".join([menu] * 20) + f"\nleft {i}", "h1") for i in range(5)] + [(200 + i, own(0) + "\ncopied text", "h2") for i in range(60)]
    rows += [(300 + i, own(300 + i), "h2") for i in range(10)]
    t = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = line_rules.line_verdicts(t).toPandas().set_index("id")
    assert got.kept[list(range(30))].all() and (got.removed_words[list(range(30))] == 4).all()
    assert not got.kept[[100 + i for i in range(5)]].any()
    assert got.kept[[200 + i for i in range(60)]].all()  # copies of one text are one document
    clean = {r.doc_id: r.text for r in line_rules.cleaned_documents(t).collect()}
    assert clean[3] == own(3) and 100 not in clean


def test_lines_of_copies_and_of_large_hosts_go_on_request(spark):
    letters = str.maketrans("0123456789", "abcdefghij")  # digits are all the same in a normal line
    own = lambda i: " ".join(f"o{i}w{k}".translate(letters) for k in range(60))
    menu = "\n".join(" ".join(f"menu{k}{j}".translate(letters) for j in range(5)) for k in range(14))
    rows = [(i, own(0), "copied") for i in range(60)]
    rows += [(100 + i, own(100 + i) + f"\n{menu}" * (i < 30), "large") for i in range(400)]
    t = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = line_rules.line_verdicts(t, most=25, copies=True).toPandas().set_index("id")
    assert not got.kept[list(range(60))].any() and not got.kept[[100 + i for i in range(30)]].any()
    assert got.kept[[130 + i for i in range(370)]].all()
    assert set(r.doc_id for r in line_rules.cleaned_documents(t, most=25, copies=True).collect()) == {130 + i for i in range(370)}
    found = line_rules.frequent_lines(line_rules.scan(t), most=25).collect()
    assert [(r.of_host, r.docs) for r in found] == [("large", 30)] * 14  # by content, the copies are one document


# --- chat


def digest_of(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_chat(spark):
    rows = [
        (1, 1, "assistant", "b </s> [INST] <\\s> [\\/INST]"), (1, 0, "user", None), (2, 0, "[INST]", ""), (None, 3, None, "x"),
        (3, None, "assistant", "tie"), (3, 0, "user", "z"), (3, 0, "user", "a"), (3, 0, "user", "a"), (4, 0, "assistant", "\U0001f600é" * 1000),
    ]
    t = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, rendered string")
    got = {r.conv_id: r for r in chat.read_back(chat.in_order(t)).collect()}
    assert got[1].turns_sha256 == digest_of([("user", ""), ("assistant", rows[0][3])]) and got[1].loss_chars == len(rows[0][3])
    assert got[3].turns_sha256 == digest_of([("assistant", "tie"), ("user", "a"), ("user", "a"), ("user", "z")])
    assert got[2].n_turns == 1 and got[2].loss_chars == 0 and got[None].turns_sha256 == digest_of([("", "x")])
    assert got[4].loss_sha256 == hashlib.sha256(rows[-1][3].encode()).hexdigest() and got[4].loss_chars == 2000
    assert chat.masked_turns(t).filter("loss_start is not null").count() == 3
    assert chat.read_back(chat.in_order(t.limit(0))).count() == 0


PIECES = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "<", "[", "\\", "/s>", "INST]", "a", "\n", "<\\s>", "[\\\\/INST]", "é"]), max_size=8).map("".join)


@settings(deadline=None, max_examples=400)
@given(PIECES, PIECES)
def test_chat_round_trip(role, text):
    read = chat.parse(chat.BOS + chat.render(role, text) + chat.render("user", "next"))
    assert [x[:2] for x in read] == [(role, text), ("user", "next")]


@settings(deadline=None, max_examples=200)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), PIECES), max_size=6), st.integers(0, 2**20))
def test_a_conversation_is_read_from_pieces_that_end_anywhere(turns, seed):
    import random

    stream, rng, reader = "".join(chat.render(r, t) for r, t in turns), random.Random(seed), chat._Reader(1)
    while stream:
        n = rng.randint(1, 9)
        reader.feed(stream[:n])
        stream = stream[n:]
    loss = "".join(t for r, t in turns if r == "assistant")
    assert reader.row()[1:5] == (len(turns), digest_of(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_escapes_only_conflicts():
    assert chat.render("user", "plain < [ text") == "[INST]user[/INST]plain < [ text</s>"


def test_chat_query(spark, sf):
    got = chat.query(spark, sf)
    rows = collections.defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        rows[r.conv_id].append((r.turn, r.role, r.text or ""))
    own = "</s>[INST] ok [/INST]"
    rows[-7] = [(0, "user", own), (1, "assistant", own)]
    for r in got.collect():
        turns = [(x[1], x[2]) for x in sorted(rows.pop(r.conv_id))]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), digest_of(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert not rows


# --- toxicity


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = toxicity.query(spark, sf).join(labels, "doc_id").filter("held_out").toPandas()
    hit, toxic, called = ((scored.predicted == 1) & (scored.toxic == 1)).sum(), (scored.toxic == 1).sum(), (scored.predicted == 1).sum()
    assert hit / called > 0.95 and hit / toxic > 0.75
    assert docs.count() > 0


def plain_grams(text, sizes=(4, 6, 8)):
    t = f" {text.lower()} "
    return {t[k : k + n] for n in sizes for k in range(len(t) - n + 1)}


def named(grams):
    """32-bit hashes of n-grams, one at a time in plain integers."""
    out = {}
    for g in grams:
        h = len(g)
        for c in g:
            h = (h * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
        h ^= h >> 29
        out[g] = (h * 0xBF58476D1CE4E5B9 % 2**64) >> 32
    return out


def test_toxicity_equals_a_plain_model(spark):
    """N-grams, log-count ratios and scores by plain sets, counts and sums."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdeé"), 5))
    texts = [" ".join(word() for _ in range(rng.integers(0, 25))) + (" vile Insult" if i % 3 == 0 else " kind words") for i in range(90)]
    y = np.array([i % 3 == 0 for i in range(90)], float)
    features = []
    for t in texts:
        points, offsets = toxicity._points([t])
        got = np.unique(np.concatenate([h[inside] for h, inside in toxicity.grams(points, offsets)]))
        assert set(got.tolist()) == set(named(plain_grams(t)).values())
        features.append(got)
    names, df, df1, ratio = toxicity.log_count_ratios(y, features, 3)
    with_gram = collections.Counter(h for t in texts for h in set(named(plain_grams(t)).values()))
    with_toxic = collections.Counter(h for t, one in zip(texts, y, strict=True) if one for h in set(named(plain_grams(t)).values()))
    assert names.tolist() == sorted(h for h, n in with_gram.items() if n >= 3)
    for h, n, n1, r in zip(names.tolist(), df, df1, ratio, strict=True):
        assert (n, n1) == (with_gram[h], with_toxic[h])
        assert r == pytest.approx(np.log(((n1 + 1) / 32) / ((n - n1 + 1) / 62)))
    model = names, weights, bias = toxicity.fit(y, features, most=300)
    strong = named({"vile", "insult"[:4]})
    assert all(weights[np.searchsorted(names, h)] > 0 for h in strong.values() if h in names)
    # Every weight is a coefficient times its ratio, so its sign is the ratio's wherever the fit agrees with the counts.
    own = dict(zip(*log_ratio_of(toxicity.log_count_ratios(y, features, 3)), strict=True))
    assert np.mean([np.sign(w) == np.sign(own[h]) for h, w in zip(names.tolist(), weights, strict=True) if abs(w) > 1e-3]) > 0.8
    more = [*texts, "", None, "VILE insult", "x" * 100]
    docs = spark.createDataFrame(list(enumerate(more)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in toxicity.with_score(docs, model).collect()}
    for i, t in enumerate(more):
        present = set(named(plain_grams(t or "")).values())
        z = bias + sum(w for h, w in zip(names.tolist(), weights, strict=True) if h in present)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def log_ratio_of(found):
    return found[0].tolist(), found[3].tolist()


@pytest.mark.parametrize("label", [0, 1])
def test_one_long_text_takes_no_other_text_out_of_the_fit(spark, label):
    """A text of megabytes that comes first in the order of the sample, in either label."""
    first = min((k for k in range(60, 400) if zlib.crc32(str(k).encode()) % 5), key=lambda k: int(hashlib.md5(f"toxicity-1/{k}".encode()).hexdigest()[:12], 16))
    rows = [(i, ("vile insult " if i % 2 else "kind words ") * 5) for i in range(60)] + [(first, "long " + "".join(f"{k:x} " for k in range(400_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(first, label)], "doc_id long, toxic int")
    for most in (toxicity.TEXT_FEATURES, 40):
        model = toxicity.train(docs, labels, text_features=most)
        got = {r.doc_id: r.score for r in toxicity.with_score(docs, model).collect()}
        assert len(got) == 61 and all((got[i] > 0.5) == bool(i % 2) for i in range(60))


def test_a_fit_without_features_calls_nothing_toxic(spark):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(40)], "doc_id long, text string")
    for rows in ([(i, 1) for i in range(40)], [(i, 0) for i in range(40)], [(1, 1), (2, 0), (3, 1)], []):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        assert toxicity.clean_documents(docs, labels).count() == 40


def test_toxicity_edges(spark, nasty, nothing):
    labels = spark.createDataFrame([(9, 1, 1, "x"), (10, 0, 0, "x"), (11, None, 0, "x"), (12, 1, None, "x"), (None, 1, 1, "x"), (14, 0, 1, "x"), (999, 0, 1, "x")], "doc_id long, quality int, toxic int, text string")
    model = toxicity.train(nasty, labels)
    got = toxicity.with_score(nasty, model).toPandas()
    assert len(got) == len(nasty_rows()) and got.score.between(0, 1).all()
    assert toxicity.clean_documents(nasty, labels).columns == nasty.columns
    empty = toxicity.train(nothing, labels)
    assert toxicity.with_score(nothing, empty).count() == 0
    assert toxicity.with_score(nasty, toxicity.train(nasty, labels.limit(0))).filter("score >= 0.5").count() == 0


def test_toxicity_reruns_agree(spark, sf):
    a, b = (toxicity.query(spark, sf).toPandas().sort_values("doc_id").score.to_numpy() for _ in range(2))
    assert np.array_equal(a, b)


# --- sharding


def test_sharding(nasty, nothing, docs):
    for table in (nasty, docs):
        got = sharding.interleave(table).toPandas()
        counts = got.groupby("shard")["slot"]
        n = counts.count().reindex(range(16), fill_value=0)
        assert n.max() - n.min() <= 1
        assert all(sorted(g) == list(range(len(g))) for _, g in counts)
        raw = collections.Counter((len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in table.select("doc_id", "text").collect())
        assert collections.Counter(zip(got["size"], got.checksum, strict=True)) == raw
        again = sharding.interleave(table, few=0).toPandas()
        key = lambda x: sorted(map(str, x[["id", "checksum", "shard", "slot"]].to_numpy().tolist()))
        assert key(got) == key(again)
    assert sharding.interleave(nothing).count() == 0
    null = spark_rows(nasty.sparkSession, 3000)
    got = sharding.interleave(null).toPandas()
    assert sorted(got.groupby("shard").slot.count()) == [187] * 8 + [188] * 8 and not got.duplicated(["shard", "slot"]).any()


def spark_rows(spark, n):
    """Rows without ids, all with one text, of two sources."""
    return spark.createDataFrame([(None, "same text", "ab"[i % 3 == 0]) for i in range(n)], "doc_id long, text string, source string").repartition(5)


def test_every_shard_has_the_mixture(spark):
    rows = [(i, "t", "big" if i % 4 else "small") for i in range(3200)]
    got = sharding.interleave(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    share = got.assign(small=got.source == "small").groupby("shard").small.sum()
    assert share.between(49, 51).all()


# --- tokens


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file(name))


def test_token_counts(spark, nasty, nothing, docs, tmp_path):
    plain = library(token_counts.TOKENIZER)
    cache = str(tmp_path / "cache")
    for table in (docs, nasty):
        want = collections.Counter((str(r[0]), len((r[1] or "").encode()), len(plain.encode(r[1] or "", add_special_tokens=False).ids)) for r in table.select("doc_id", "text").collect())
        got = token_counts.count_tokens(table, cache).collect()
        assert collections.Counter((str(r[0]), r.n_bytes, r.n_tokens) for r in got) == want
    kept = spark.read.parquet(cache)
    assert kept.count() == kept.select("content").distinct().count()
    before = kept.count()
    one, two = (token_counts.count_tokens(t, cache) for t in (docs, docs.withColumn("text", F.concat("text", F.lit(" more")))))
    assert one.unionByName(two).count() == 2 * docs.count()  # results of several batches in one plan
    before = spark.read.parquet(cache).count()
    token_counts.count_tokens(docs, cache).count()
    assert spark.read.parquet(cache).count() == before  # hits add nothing
    assert token_counts.count_tokens(nothing, str(tmp_path / "none")).count() == 0


def test_token_query_counts_every_row(spark, sf, docs):
    """Both batches of the query, against the library: the second one's rows are there although the first has read the cache before it grew."""
    plain = library(token_counts.TOKENIZER)
    want = {r.doc_id: (len((r.text or "").encode()), len(plain.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect()}
    got = token_counts.query(spark, sf).collect()
    assert len(got) == len(want) and {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)


def test_token_cache_with_repeated_entries_and_two_writers(spark, nasty, tmp_path):
    cache, plain = str(tmp_path / "cache"), library(token_counts.TOKENIZER)
    for _ in range(2):  # two writers that began with an empty cache
        token_counts.count_tokens(nasty, str(tmp_path / "other")).count()
        spark.read.parquet(str(tmp_path / "other")).write.mode("append").parquet(cache)
    kept = spark.read.parquet(cache)
    before = kept.count()
    assert before == 2 * kept.select("content").distinct().count()
    more = nasty.unionByName(nasty.limit(1).withColumn("doc_id", F.lit(77).cast("long")).withColumn("text", F.lit("one text more")))
    got = token_counts.count_tokens(more, cache).collect()
    assert len(got) == len(nasty_rows()) + 1 and [r.n_tokens for r in got if r.id == 77] == [len(plain.encode("one text more").ids)]
    assert spark.read.parquet(cache).count() == before + 1  # only what was missing is appended


def test_repeated_rows_are_encoded_once(spark, tmp_path):
    rows = [(None, "a text of null ids")] * 300 + [(5, "repeated rows")] * 200 + [(i, f"copies of one content {i // 50}".replace(" ", " \t"[i % 2])) for i in range(100, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    known = token_counts.known_counts(spark, str(tmp_path / "none"), "x")
    made = token_counts.encoded(docs, token_counts.digests(docs, "doc_id", "text"), known, token_counts.TOKENIZER, "doc_id", "text")
    assert made.count() == made.select("content").distinct().count() == 4


TEXTS = st.one_of(st.text(max_size=60), st.lists(st.sampled_from(["[UNK]", "<unk>", "[CLS]", "[MASK]", "<s>", "</s>", "<|endoftext|>", "[PAD]", " ", "\n", "a", "é", "word", "\u00a0", "\u2003", "12"]), max_size=10).map("".join))


@settings(deadline=None, max_examples=300)
@given(st.lists(TEXTS, min_size=1, max_size=5))
def test_word_counts_add_up(texts):
    import pyarrow as pa

    counts, plain = _counts()
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    assert counts.counts(pa.array(texts)).tolist() == [len(plain.encode(t, add_special_tokens=False).ids) for t in texts]


def test_ids_equal_the_libraries_on_many_texts(spark):
    """All documents of a larger table, and random Unicode with special strings, through both tokenizers."""
    import random

    import pyarrow as pa

    rng = random.Random(7)
    odd = ["<|endoftext|>", "[UNK]", "<s>", " ", "\n", "\t", "'s", "1234", "\u00a0", "ß", "日本", "\U0001f600", "e\u0301", "_", "https://a.b/c?d=1"]
    texts = ["".join(rng.choice(odd) if rng.random() < 0.4 else chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x2FFF), rng.randint(0x1F300, 0x1F6FF)])) for _ in range(rng.randint(0, 60))) for _ in range(6000)]
    texts += [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    words, plain = token_counts.WordCounts(token_counts.TOKENIZER), library(token_counts.TOKENIZER)
    assert words.counts(pa.array(texts)).tolist() == [len(plain.encode(t, add_special_tokens=False).ids) for t in texts]
    fast, whole = packing.Encoder(), library("byte_bpe_50k.json")
    assert all(fast.ids(t) == whole.encode(t, add_special_tokens=False).ids for t in texts)


_KEPT = []


def _counts():
    if not _KEPT:
        _KEPT.extend((token_counts.WordCounts(token_counts.TOKENIZER, 50), library(token_counts.TOKENIZER)))
    return _KEPT


# --- packing


def check_packed(table, got, length=1024):
    plain = library("byte_bpe_50k.json")
    want = collections.Counter()
    for r in table.select("doc_id", "text").collect():
        want[(str(r[0]), tuple([*plain.encode(r[1] or "", add_special_tokens=False).ids, 0]))] += 1
    parts = collections.defaultdict(list)
    for r in got:
        parts[r.sequence_id].append(r)
    for k, ps in parts.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == length or k == max(parts) and at <= length
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[str(r.doc_id)].append(r)
    for doc, ids in want:
        mine = [p for p in pieces[doc] if p.doc_tokens == len(ids)]
        assert sum(p.length for p in mine) == len(ids) * sum(n for (d, i), n in want.items() if d == doc and len(i) == len(ids))
        for p in mine:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) or sum(d == doc for d, _ in want) > 1


def test_packing(nasty, nothing, docs):
    for table in (docs, nasty):
        check_packed(table, packing.pack(table, window=4096).collect())
    assert packing.pack(nothing).count() == 0
    null = spark_rows(nasty.sparkSession, 3000)
    check_packed(null, packing.pack(null).collect())


def test_windows_hold_the_mixture(spark):
    rows = [(i, "some words of text " * (5 + i % 7), "abc"[i % 3]) for i in range(600)]
    t = packing.tokenized(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = t.join(packing.layout(t, {"a": 2, "b": 1, "c": 1}, window=2000), "tag").toPandas()
    totals = got.groupby("source").n.sum()
    full = got[got.window < min(totals[s] / (2000 * w) for s, w in (("a", 0.5), ("b", 0.25), ("c", 0.25))) - 1]
    sums = full.groupby(["window", "source"]).n.sum().unstack().cumsum()
    for s, w in (("a", 0.5), ("b", 0.25), ("c", 0.25)):
        owed = 2000 * w * (sums.index + 1) - sums[s]
        assert (owed >= -1e-6).all() and (owed <= got.n.max()).all()  # deficits are carried and never exceed a document
    with pytest.raises(ValueError):
        packing.layout(t, {"a": 0})


def test_sequences_hold_the_mixture(spark):
    rows = [(i, "some words of text " * 6, f"s{i % 20:02}") for i in range(3000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    held = got.assign(source=got.doc_id % 20).groupby("sequence_id").source.nunique()
    assert len(held) > 64 and held.iloc[:-1].min() == 20


@settings(deadline=None, max_examples=200)
@given(st.one_of(st.text(max_size=80), st.lists(st.sampled_from(["<|endoftext|>", " ", "\n", "a", "é", "<|", "'s", "12"]), max_size=10).map("".join)))
def test_encoder_equals_the_library(text):
    text = text.encode("utf-8", "replace").decode()
    fast, plain = _encoder()
    assert fast.ids(text) == plain.encode(text, add_special_tokens=False).ids


_ENCODER = []


def _encoder():
    if not _ENCODER:
        _ENCODER.extend((packing.Encoder(), library("byte_bpe_50k.json")))
    return _ENCODER


# --- suffixes


def removed(rows, length=50):
    order = lambda i: 2**63 - 1 if i is None else i
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            first[s] = min(first.get(s, 2**63), order(i))
    out = collections.Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < order(i):
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[(str(i), len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())] += 1
    return out


def suffix_rows(df):
    return collections.Counter((str(r.id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_suffix_dedup(nasty, nothing, docs):
    for table in (nasty, docs):
        assert suffix_rows(suffix_dedup.remove_repeats(table)) == removed([(r[0], r[1]) for r in table.select("doc_id", "text").collect()])
    assert suffix_dedup.remove_repeats(nothing).count() == 0


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text("ab", max_size=40), min_size=1, max_size=6), st.sampled_from([(8, 3), (10, 4), (21, 6)]))
def test_deep_shallow_orders_suffixes(texts, sizes):
    length, anchor = sizes
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    starts, anchors, _ = suffix_dedup.minimizers(data, offsets, length, anchor)
    assert starts.tolist() == [o + k for o, t in zip(offsets, texts, strict=False) for k in range(len(t) - length + 1)]
    assert all(s <= a <= s + length - anchor for s, a in zip(starts, anchors, strict=True))
    padded = np.concatenate((data, np.zeros(16, np.uint8)))
    order, group = suffix_dedup.deep_shallow(padded, starts, length)
    strings = [bytes(data[starts[k] : starts[k] + length]) for k in order]
    assert strings == sorted(strings)
    assert [a == b for a, b in itertools.pairwise(strings)] == [bool(a == b) for a, b in itertools.pairwise(group)]


@settings(deadline=None, max_examples=150)
@given(st.lists(st.text("ab", min_size=40, max_size=60), max_size=5), st.lists(st.sampled_from(["a" * 17, "abcdefgh" * 2, "x"]), min_size=1, max_size=40), st.integers(0, 9), st.sampled_from([9, 16, 24, 33, 50]))
def test_both_phases_sort(texts, heads, seed, length):
    rng = np.random.default_rng(seed)
    texts = texts + [h + "".join(rng.choice(list("ab"), 50)) for h in heads] + texts[:2]
    data = np.concatenate((np.frombuffer("".join(texts).encode(), np.uint8), np.zeros(16, np.uint8)))
    starts = (np.cumsum([0] + [len(t) for t in texts])[:-1]).astype(np.int64)
    cut_at = lambda k, n: bytes(data[starts[k] : starts[k] + n]).ljust(n, b"\0")[:n]
    # The quicksort, from one group of all, orders by its depth and marks every change of those bytes.
    depth = -(-length // 8)
    for symbols in range(1, depth + 1):
        order, new = np.arange(len(starts)), np.zeros(len(starts), bool)
        new[0] = True
        suffix_dedup.multikey_quicksort(data, starts, order, new, symbols, length)
        seen = [cut_at(k, min(8 * symbols, length)) for k in order]
        assert seen == sorted(seen) and new.tolist() == [True] + [a != b for a, b in itertools.pairwise(seen)]
    # Tries over groups that agree in a first symbol: leaves are distinct strings, ranks are in their order.
    groups = collections.defaultdict(list)
    for k in range(len(starts)):
        groups[cut_at(k, 8)].append(k)
    members = [k for g in groups.values() for k in g]
    number = np.repeat(np.arange(len(groups)), [len(g) for g in groups.values()])
    tries = suffix_dedup.BlindTries(data, starts[members], number, 1, length)
    ranks = tries.ranks()
    for g in range(len(groups)):
        own = np.flatnonzero(number == g)
        seen = [cut_at(members[k], length) for k in own]
        assert [sorted(set(seen)).index(x) for x in seen] == ranks[own].tolist()
    assert len(tries.position) < len(tries.leaf) == len({cut_at(k, length) for k in range(len(starts))})


def test_a_passage_of_all_documents_is_sent_once_a_task():
    import pyarrow as pa

    passage = "".join(chr(97 + (k * k * 7 + k // 3) % 26) for k in range(200))
    rng = np.random.default_rng(1)
    rows = [(i, "".join(rng.choice(list("abcdefghij"), 120)) + passage) for i in rng.permutation(4000).tolist()]
    batches = [pa.RecordBatch.from_pydict({"id": pa.array([r[0] for r in part], pa.int64()), "text_key": pa.array([0] * len(part), pa.int64()), "text": [r[1] for r in part]}) for part in (rows[k : k + 20] for k in range(0, 4000, 20))]
    hashes = collections.Counter()
    for out in suffix_dedup._anchors(4, 50)(iter(batches)):
        for r, _, _ in suffix_dedup._entries(out, 0):
            hashes.update(suffix_dedup.unplaned(r["hashes"], "<u8", 5).tolist())
    assert 1 <= max(hashes.values()) <= 25  # 4000 documents in 200 batches: the first two, and each lesser id that comes later
    text = pa.array([r[1] for r in rows[:20]])
    data, offsets = suffix_dedup.strings(text)
    place = np.unique(suffix_dedup.minimizers(data, offsets)[1])
    entries = 0
    for batch in batches:
        places = []
        for t in batch.column("text").to_pylist():
            p = np.unique(suffix_dedup.minimizers(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[1])
            places.append(p[p >= 100].astype("<u4").tobytes())
        whole = pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.binary())], names=[*batch.schema.names, "places"])
        batches[entries] = whole
        entries += 1
    strings = 0
    for out in suffix_dedup._candidates(4, 50)(iter(batches)):
        for r, _, _ in suffix_dedup._entries(out, 2):
            strings += int((suffix_dedup.unplaned(r["hashes"], "<u4", 3) & 0xFFFF).sum())
    assert len(place) and strings < 4000 * 60  # of 151 strings of the passage in every document some 25 times are sent on


def test_long_texts_come_in_pieces(monkeypatch, spark):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    text = "".join(chr(97 + (k * k * 7 + k // 3) % 26) for k in range(2000))
    rows = [(1, text), (2, "zz" + text[500:1700] + "yy"), (3, text[:40])]
    data = np.frombuffer(text.encode(), np.uint8)
    starts = [p + a[0] for b, o, r, a in suffix_dedup.runs(data, np.array([0, len(data)]), 300) for p in suffix_dedup.minimizers(b, o)[0]]
    assert starts == list(range(1951))
    assert suffix_rows(suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == removed(rows)


def test_kept_bytes(docs):
    want = suffix_rows(suffix_dedup.remove_repeats(docs))
    got = collections.Counter(hashlib.sha256(bytes(r.kept)).hexdigest() for r in suffix_dedup.kept_bytes(docs).collect())
    assert got == collections.Counter(k[4] for k in want.elements())


def test_sequences_hold_the_ids(docs):
    plain = library("byte_bpe_50k.json")
    pieces = packing.pack(docs, with_ids=True)
    got = {r.sequence_id: np.frombuffer(bytes(r.ids), "<u4") for r in packing.sequences(pieces).collect()}
    assert all(len(x) == 1024 for k, x in got.items() if k < max(got))
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for p in pieces.limit(40).collect():
        ids = [*plain.encode(text[p.doc_id], add_special_tokens=False).ids, 0]
        assert got[p.sequence_id][p.offset : p.offset + p.length].tolist() == ids[p.start : p.start + p.length]


def test_shards_are_written(spark, docs, nasty, tmp_path):
    import glob

    import pyarrow.parquet as pq

    sharding.write_shards(docs, str(tmp_path / "shards"))
    got = spark.read.parquet(str(tmp_path / "shards"))
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in docs.collect()} and got.groupBy("shard").count().count() == 16
    place = {(r.shard, r.slot): r.id for r in sharding.interleave(docs).collect()}
    for k in range(16):  # read file by file, the rows come in the order of the slots
        ids = [i for f in sorted(glob.glob(str(tmp_path / f"shards/shard={k}/*.parquet"))) for i in pq.ParquetFile(f).read(["doc_id"]).column(0).to_pylist()]
        assert ids == [place[(k, j)] for j in range(len(ids))]
    for n, t in enumerate((nasty, spark_rows(spark, 300))):
        sharding.write_shards(t, str(tmp_path / f"more{n}"))
        again = spark.read.parquet(str(tmp_path / f"more{n}"))
        assert again.count() == t.count() and set(again.columns) == {*t.columns, "shard"}
        assert sorted(map(str, again.select(*t.columns).collect())) == sorted(map(str, t.collect()))


# --- pipeline


def test_pipeline(spark, sf):
    import corpus_pipeline
    from tidemark.llm.common import stored

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf))
        seen[name] = docs
        assert docs.columns == columns or name == "packing"
    rows = {n: [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()] for n, d in seen.items() if n != "packing"}
    kept = best(rows["toxicity"])
    assert sorted(i for i, _ in rows["exact dedup"]) == sorted(v[0] for v in kept.values())
    assert len(near_truth(rows["near dedup"])) == len(rows["near dedup"]) == len(near_truth(rows["exact dedup"]))
    assert {i for i, _ in rows["mixing"]} <= {i for i, _ in rows["near dedup"]}
    check_packed(seen["mixing"], seen["packing"].collect())
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES])


def test_pipeline_edges(spark, nasty, nothing, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(9, 0, 1), (10, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for table in (nasty, nothing):
        docs, rows = table, {}
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == table.columns or name == "packing"
            rows[name] = [r.asDict() for r in docs.collect()]
        whole = [r.asDict() for r in table.collect()]
        # Two labelled rows tell nothing apart: none is toxic.
        assert len(rows["toxicity"]) == len(whole)
        plain = lambda r: re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")
        assert sorted(map(plain, rows["exact dedup"])) == sorted({plain(r) for r in whole})
        near = {str(r["doc_id"]) for r in rows["near dedup"]}
        assert near <= {str(r["doc_id"]) for r in rows["exact dedup"]} and len(near) == len(rows["near dedup"]) and (len(near) > 8) == bool(whole)
        mixed = {str(r["doc_id"]) for r in rows["mixing"]}
        assert mixed <= near and bool(mixed) == bool(whole)
        assert {str(r["doc_id"]) for r in rows["packing"]} == mixed
