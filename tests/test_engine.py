"""The drift engine on small literal rows."""

import json
import math
import re
import statistics

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.config import ESCALATE, MANIPULATION_LEXICON, MONITOR, NO_ACTION, URGENCY_PHRASES, Settings
from tidemark.functions import automaton, tagging
from tidemark.functions import text as T
from tidemark.functions.hashing import hmac_sha256, pseudonym
from tidemark.operators import anomaly, audit, baseline, drift, fairness, graph, monitor, network, policy, privacy, profile, ranks, retrieval, serve, shapley, supervised, trend
from tidemark.plans import catalog, drift_queries, pipeline
from tidemark.sources import files, messages, sinks, synthetic

S = Settings()


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "t string").select(*columns).first()


def series(spark, values, user="u"):
    return spark.createDataFrame([(user, k, k, float(v)) for k, v in enumerate(values)], "user string, date long, id long, value double")


def z_values(spark, values, window):
    return [r.z_value for r in baseline.with_z(series(spark, values), ("value",), window).orderBy("id").collect()]


# --- baselines


def test_rolling_mean_and_eviction(spark):
    r = baseline.rolling_stats(series(spark, [2, 4, 6]), "value", 3).orderBy("id").collect()[-1]
    assert r.rolling_mean == 4.0
    assert baseline.rolling_stats(series(spark, [1, 2, 3]), "value", 2).orderBy("id").collect()[-1].rolling_mean == 2.5


def test_constant_window_has_no_drift(spark):
    assert z_values(spark, [5, 5, 5, 9], 3) == [None, None, None, 0.0]


def test_z_sign_and_full_windows_only(spark):
    got = z_values(spark, [1, 2, 3, 4, 5, 100, -100], 5)
    assert got[:5] == [None] * 5 and got[5] > 0 > got[6]


def test_z_replays_a_plain_window(spark):
    values = [((k * 37) % 11) + (k % 3) * 0.5 for k in range(60)]
    want = [None if k < 7 else (v - statistics.fmean(p)) / statistics.pstdev(p) for k, v in enumerate(values) for p in [values[max(0, k - 7) : k]]]
    assert z_values(spark, values, 7) == pytest.approx(want, abs=1e-9)


def test_z_ignores_shift_and_scale(spark):
    values = [((k * 29) % 13) * 1.0 for k in range(40)]
    assert z_values(spark, values, 6) == pytest.approx(z_values(spark, [3 * v - 8 for v in values], 6), abs=1e-9)


def test_snapshot(spark):
    r = baseline.snapshot(series(spark, [100, 1, 2, 3]), "value", 3).first()
    assert (r.n, r["mean"], r["std"]) == (3, 2.0, 0.8165)


# --- text


def test_phrases(spark):
    c = F.col("t")
    r = one(spark, "This is URGENT, please wire transfer now", T.phrase_hits(c, ("urgent", "wire transfer")).alias("n"), T.phrase_score(c).alias("s"))
    assert r.n == 2 and r.s == round(2 / len(URGENCY_PHRASES) * 5, 4)
    assert one(spark, "see you at lunch", T.phrase_score(c).alias("s")).s == 0.0
    assert one(spark, " ".join(URGENCY_PHRASES), T.phrase_score(c).alias("s")).s == 1.0
    assert one(spark, None, T.phrase_score(c).alias("s")).s == 0.0


def test_phrase_scan_finds_overlaps_and_nested_phrases(spark):
    r = one(spark, "aaa gift card", T.phrase_scan(F.col("t"), ("aa", "gift card", "card", "?.")).alias("x")).x
    assert sorted((p.phrase, p.end_index) for p in r) == [("aa", 1), ("aa", 2), ("card", 12), ("gift card", 12)]


def test_categories(spark):
    c = F.col("t")
    scores = T.category_scores(c)
    assert set(scores) == set(MANIPULATION_LEXICON) and len(scores) == 5
    r = one(spark, "This is a direct order from the CEO.", *[v.alias(k) for k, v in scores.items()], T.manipulation_score(c).alias("all"))
    assert r.authority_spoofing == 0.7143 and r["all"] == round(0.7143 / 5, 4) and r.isolation_secrecy == 0
    assert one(spark, "", T.manipulation_score(c).alias("s")).s == 0.0
    own = {"test_category": ("special phrase",)}
    assert one(spark, "a Special Phrase", T.manipulation_score(c, own).alias("s")).s == 1.0
    found = one(spark, "i trust you: special phrase", T.category_scan(c, own).alias("x")).x
    assert [p.phrase for p in found["test_category"]] == ["special phrase"]


@given(st.lists(st.text("abé ", min_size=1, max_size=4), min_size=1, max_size=9), st.lists(st.one_of(st.none(), st.text("abé ", max_size=25)), min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_one_scan_finds_what_searches_find(phrases, texts):
    """Nested, overlapping and repeated phrases, in rows that lie next to each other in one buffer, and in a slice of them."""
    import pyarrow as pa

    phrases = automaton.distinct_phrases(tuple(phrases))
    for column, own in ((pa.array(texts, pa.string()), texts), (pa.array(["ab", *texts], pa.string()).slice(1), texts)):
        row, phrase, end = automaton.matches(column, phrases)
        got = sorted(zip(row.tolist(), [phrases[k] for k in phrase], end.tolist()))
        assert got == sorted((i, p, k + len(p) - 1) for i, t in enumerate(own) for p in phrases for k in range(len(t or "")) if (t or "").startswith(p, k))


def test_a_scan_takes_as_long_for_many_phrases(spark):
    import time

    import pyarrow as pa

    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("etaoinshr"), 7))
    column = pa.array([" ".join(word() for _ in range(400)) for _ in range(300)])
    took = {}
    for n in (20, 2000):
        phrases = automaton.distinct_phrases(tuple(f"{word()} {word()}" for _ in range(n)))
        automaton.matches(column, phrases)
        took[n] = min(_timed(time, automaton.matches, column, phrases) for _ in range(5))
    assert took[2000] < 4 * took[20]  # a search for each would take a hundred times as long


def _timed(time, f, *args):
    began = time.perf_counter()
    f(*args)
    return time.perf_counter() - began


def test_a_large_lexicon_is_scored_as_a_small_one(spark):
    c, many = F.col("t"), tuple(f"phrase number {k}" for k in range(200)) + URGENCY_PHRASES
    r = one(spark, "Phrase Number 17, urgent: gift card, gift card", T.phrase_hits(c, many).alias("n"), T.category_scan(c, {"a": many, "b": ("number", "gift card"), "c": ()}).alias("x"))
    # "phrase number 1" stands in "phrase number 17".
    assert r.n == 4 and [m.phrase for m in r.x["a"]] == ["phrase number 1", "phrase number 17", "urgent", "gift card", "gift card"] and len(r.x["b"]) == 3 and r.x["c"] == []


def test_surface_features(spark):
    c, tk = F.col("t"), T.tokens(F.col("t"))
    r = one(spark, "Don't SHOUT, été... ok?!", tk.alias("tk"), T.caps_ratio(c).alias("caps"), T.exclamation_ratio(c).alias("ex"), T.ellipsis_count(c).alias("el"), T.char_ratio(c, ",").alias("co"), T.function_word_ratio(tk).alias("fw"))
    assert r.tk == ["don't", "shout", "t", "ok"] and r.caps == 0.25 and r.ex == round(100 / 24, 4) and r.el == 1 and r.co == round(1 / 24, 4) and r.fw == 0
    assert one(spark, "", T.lexical_diversity(tk).alias("d"), T.readability_flesch(c, tk).alias("f"))[:] == (0.0, 0.0)


def test_shares_round_half_away_from_zero(spark):
    r = spark.range(1).select(T.share(F.lit(9), F.lit(32), 4).alias("a"), T.share(F.lit(-9), F.lit(32), 4).alias("b"), T.share(F.lit(1), F.lit(0), 4).alias("c")).first()
    assert r[:] == (0.2813, -0.2813, 0.0)


def test_recipients(spark):
    df = spark.createDataFrame([("a@x; b@x", None, "c@x,,a@x ")], "to string, cc string, bcc string")
    assert df.select(T.recipients(F.col("to"), F.col("cc"), F.col("bcc")).alias("r")).first().r == ["a@x", "b@x", "c@x", "a@x"]


# --- drift


def scored(spark, zs):
    names = tuple(zs) or ("urgency_score",)
    row = [float(zs[n]) if zs.get(n) is not None else None for n in names]
    df = spark.createDataFrame([("u", *row)], "user string, " + ", ".join(f"z_{n} double" for n in names))
    return drift.with_drift(df, names, S).first()


def test_drift_scores(spark):
    assert scored(spark, {})[-3:] == (0.0, [], 0)
    r = scored(spark, {"urgency_score": 5.0, "sentiment_polarity": 0.1})
    assert r.flagged_features == ["urgency_score"] and r.drift_score == round((2 * 5 + 1.5 * 0.1) / 3.5, 4)
    assert scored(spark, {"urgency_score": 1e5}).drift_score == 10.0
    assert scored(spark, {"urgency_score": None, "unknown": -3.0}).drift_score == 3.0
    assert scored(spark, {"urgency_score": 3.1, "social_engineering_score": 2.6, "sentiment_polarity": -2.8, "readability_flesch": 0.4}).n_flagged == 3


def test_top_users(spark):
    risk = spark.createDataFrame([("a", 0.1), ("b", 0.9), ("c", 0.5), ("d", 0.5)], "user string, avg_drift_score double")
    assert [r.user for r in drift.top_users(risk, 3).collect()] == ["b", "c", "d"]
    with pytest.raises(ValueError):
        drift.top_users(risk, 0)


# --- privacy


def test_pseudonyms(spark):
    import hashlib
    import hmac

    for user in ("alice", "bob", "ünïcode", ""):
        want = hmac.new(b"salt", user.encode(), hashlib.sha256).hexdigest()
        assert one(spark, user, hmac_sha256(F.col("t"), "salt").alias("h"), pseudonym(F.col("t"), "salt").alias("p"))[:] == (want, "emp_" + want[:12])
    long = "k" * 100
    assert one(spark, "x", hmac_sha256(F.col("t"), long).alias("h")).h == hmac.new(long.encode(), b"x", hashlib.sha256).hexdigest()


def test_consent(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "user string, n int")
    ledger = privacy.default_ledger(rows)
    assert privacy.consent_gate(rows, privacy.revoke(ledger, "b").filter("consented")).collect()[0].user == "a"
    assert privacy.consent_gate(rows, ledger.limit(0), required=False).count() == 2
    assert privacy.consent_gate(rows, ledger.limit(0)).count() == 0


# --- network


def contacts(rows, window):
    past, out = {}, []
    for user, _, _, recipients in rows:
        p = past.setdefault(user, [])
        out.append((len(set(p)), sum((p.count(c) / len(p)) ** 2 for c in set(p))))
        past[user] = [*p, *recipients][-window:]
    return out


def test_network_window_counts_entries(spark):
    rows = [("u" if k % 3 else "v", k, k, [(k * 7 + j) % 6 for j in range((k * 5) % 4)]) for k in range(120)]
    got = network.with_network(spark.createDataFrame(rows, "user string, date long, id long, recipients array<long>"), 7).orderBy("id").collect()
    want = contacts(rows, 7)
    assert [r.contact_degree for r in got] == [w[0] for w in want]
    assert [r.interaction_concentration for r in got] == pytest.approx([w[1] for w in want])


def test_narrowing_circle(spark):
    rows = [("u", k, k, [k % 5]) for k in range(10)] + [("u", 10 + k, 10 + k, [0]) for k in range(11)]
    got = network.with_network(spark.createDataFrame(rows, "user string, date long, id long, recipients array<long>"), 10).orderBy("id").collect()
    assert (got[10].contact_degree, round(got[10].interaction_concentration, 9)) == (5, 0.2)
    assert (got[20].contact_degree, got[20].interaction_concentration) == (1, 1)


# --- trends, policy, monitoring


def trend_of(spark, values):
    df = series(spark, values).withColumnRenamed("value", "drift_score")
    return trend.trajectory(df, S).first()


def test_trends(spark):
    creep = np.linspace(0.1, 0.9, 20)
    r = trend_of(spark, creep)
    assert r.trend_slope == round(float(np.polyfit(range(20), creep, 1)[0]), 5) and not (r.acceleration > 1e-4)
    spike = [0.1] * 15 + list(np.linspace(0.1, 0.9, 5))
    assert trend_of(spark, spike).accelerating
    assert trend_of(spark, [1, 2, 3]).trend_slope == 0 and trend_of(spark, [2.0] * 9).trend_slope == 0


def test_a_flat_half_has_no_slope(spark):
    """Noise below rounding in one half is no slope: the acceleration is that of the other alone."""
    flat = [1.0 + 1e-9 * (k % 2) * k for k in range(10)]
    rows = [("u", k, k, v) for k, v in enumerate(flat + [1.0 + 0.5 * k for k in range(10)])]
    got = trend.trajectory(spark.createDataFrame(rows, "user string, date long, id long, drift_score double")).first()
    assert got.acceleration == pytest.approx(0.5, abs=1e-12) and got.accelerating


def test_suppression(spark):
    rows = [("a", 0.9, 3), ("b", 1.0, 4), ("c", 0.95, 2), ("d", 0.1, 0)]
    risk = spark.createDataFrame(rows, "user string, avg_drift_score double, n_flagged_messages int")
    calm, shift = ({r.user: r for r in policy.suppress(risk, x, S).collect()} for x in (False, True))
    sd, mean = statistics.stdev(r[1] for r in rows), statistics.fmean(r[1] for r in rows)
    assert all(calm[u].cohort_z_score == pytest.approx((x - mean) / sd, abs=1e-4) for u, x, _ in rows)
    assert not any(r.suppressed_correlated_event for r in calm.values())
    assert {u for u, r in shift.items() if r.suppressed_correlated_event} == {"a", "b", "c"}
    assert policy.suppress(risk.limit(0), True, S).count() == 0
    assert policy.suppress(risk.limit(1), False, S).first().cohort_z_score == 0


def test_recommendations(spark):
    rows = [("low", 0.5, 0.0), ("watch", 2.6, 0.1), ("high", 5.0, 0.3), ("often", 0.1, 0.0)]
    risk = spark.createDataFrame(rows, "user string, avg_drift_score double, flagged_message_rate double")
    flags = spark.createDataFrame([("often", 3)], "user string, repeat_flags long")
    got = {r.user: r for r in policy.recommend(risk, flags, S).collect()}
    assert [got[u].recommendation for u in ("low", "watch", "high", "often")] == [NO_ACTION, MONITOR, ESCALATE, ESCALATE]
    assert all(r.requires_human_review for r in got.values())


def test_shifts(spark):
    rows = [("f", 1, 1.0, 0.5), ("f", 2, 2.5, 0.5), ("g", 1, 1.0, 0.0), ("g", 2, 9.0, 0.0), ("h", 1, 1.0, 2.0), ("h", 2, 2.0, 2.0)]
    stats = spark.createDataFrame(rows, "feature string, seq int, mean double, std double")
    got = {r.feature: r.alert for r in monitor.shifts(stats, "seq", S).collect()}
    assert got == {"f": True, "h": False} and monitor.org_shift(stats, "seq", S)


def test_quartile_bins_equal_pandas(spark):
    import pandas as pd

    values = [float((k * k) % 23) for k in range(500)]
    df = spark.createDataFrame([("p", v) for v in values], "proxy string, value double")
    got = {r.value: r.bin for r in fairness.quartile_bins(df).collect()}
    want = pd.qcut(pd.Series(values), 4, labels=False, duplicates="drop") + 1
    assert all(got[v] == b for v, b in zip(values, want, strict=True))


# --- audit


def test_audit_chain(spark, tmp_path):
    log = audit.AuditLog(str(tmp_path / "audit"))
    assert log.verify(spark)
    for k in range(6):
        log.append("drift_flagged", f"emp_{k}", {"score": k, "name": "é"})
    log.append_all([("a", None, {}), ("b", "emp_1", {"x": 1})])
    assert log.verify(spark)
    segments = sorted((tmp_path / "audit").glob("*.jsonl"))
    whole = [p.read_text() for p in segments]
    assert len(segments) == 7 and len(whole[6].splitlines()) == 2
    segments[2].unlink()
    assert not log.verify(spark)  # an entry is missing
    segments[2].write_text(json.dumps(json.loads(whole[2]) | {"actor": "other"}) + "\n")
    assert not log.verify(spark)  # an entry was changed
    segments[2].write_text(whole[2])
    assert log.verify(spark)
    segments[6].unlink()
    assert not log.verify(spark)  # a cut tail shows against the stored head
    segments[6].write_text(whole[6])
    (tmp_path / "audit" / audit.HEAD).write_text(json.dumps({"seq": 6, "entry_hash": json.loads(whole[5])["entry_hash"]}))
    assert log.verify(spark)  # a break between segment and head leaves the head behind
    audit.AuditLog(str(tmp_path / "audit")).append("again", None, {})
    assert log.verify(spark)


_WRITER = """
import sys
sys.path.insert(0, {root!r})
from tidemark.operators.audit import AuditLog
log = AuditLog({path!r})
for k in range({n}):
    log.append("written", "emp_1", {{"k": k}}, actor={actor!r})
"""


def test_several_writers_keep_one_chain(spark, tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    path, n = (tmp_path / "audit").as_uri(), 400
    jobs = [subprocess.Popen([sys.executable, "-c", _WRITER.format(root=str(Path(__file__).resolve().parents[1]), path=path, n=n, actor=a)]) for a in ("one", "two")]
    assert [j.wait(120) for j in jobs] == [0, 0]
    rows = messages.read_audit(spark, path).collect()
    assert sorted(r.seq for r in rows) == list(range(1, 2 * n + 1))
    for a in ("one", "two"):
        assert [json.loads(r.details)["k"] for r in sorted(rows, key=lambda r: r.seq) if r.actor == a] == list(range(n))
    assert audit.AuditLog(path).verify(spark)
    broken = messages.read_audit(spark, path).withColumn("actor", F.when(F.col("seq").isin(1, 300, 800), "x").otherwise(F.col("actor")))
    found = audit.verify_chain(broken.repartition(5)).first()
    assert (found.n_entries, found.n_broken, found.valid, found.last_seq) == (800, 3, False, 800)


def test_reports_go_to_any_uri(spark, tmp_path):
    from decimal import Decimal

    rows = spark.createDataFrame([("p", Decimal("1.25"), True)], "proxy string, disparity_ratio decimal(10,2), flagged boolean")
    bins = spark.createDataFrame([("p", 1, 0.5)], "proxy string, bin int, rate double")
    sinks.write_bias_report(rows, bins, (tmp_path / "a b" / "rep").as_uri())
    assert json.loads((tmp_path / "a b" / "rep" / "bias_audit.json").read_text())["proxies"][0]["disparity_ratio"] == 1.25
    sinks.write_attribution(rows, (tmp_path / "x" / "ranking.json").as_uri())
    assert json.loads((tmp_path / "x" / "ranking.json").read_text())[0]["proxy"] == "p"
    for k in range(2):
        sinks.write_table(spark.range(3 + k), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4 and {p.name for p in tmp_path.iterdir()} == {"a b", "x", "t"}


def _files_read(df):
    """What the scan of a table has read, by its own count."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "Adaptive" in plan.getClass().getSimpleName() else plan
    leaf = plan.collectLeaves().head()
    return leaf.metrics().get("numFiles").get().value()


def test_a_look_up_reads_one_file_of_all(spark, tmp_path):
    rows = spark.range(6000).select(F.concat(F.lit("u"), F.col("id") % 700).alias("user"), "id").unionByName(spark.range(3000).select(F.lit("hot").alias("user"), "id"))
    sinks.write_table(rows, str(tmp_path / "t"), by_user=True)
    table = spark.read.parquet(str(tmp_path / "t"))
    total = sum(1 for _ in (tmp_path / "t").rglob("*.parquet"))
    assert total >= 60 and table.count() == 9000
    for user, n in (("u17", 9), ("hot", 3000), ("nobody", 0)):
        found = sinks.of_user(table, user)
        assert found.count() == n and _files_read(sinks.of_user(table, user)) <= 1
    assert sinks.of_user(rows, "u17").count() == 9
    whole = spark.createDataFrame([(k % 5, k) for k in range(50)], "user long, id long")
    sinks.write_table(whole, str(tmp_path / "n"), by_user=True)
    assert sinks.of_user(spark.read.parquet(str(tmp_path / "n")), "3").count() == 10


def test_folders_of_other_file_systems(spark, tmp_path, monkeypatch):
    """The way through Hadoop's file systems, here the local one."""
    folder = files.Folder((tmp_path / "f").as_uri())
    monkeypatch.setattr(folder, "local", None)
    assert folder.names() == [] and folder.read("a.txt") is None
    assert folder.create("a.txt", "é one") and not folder.create("a.txt", "two") and folder.read("a.txt") == "é one"
    folder.write("a.txt", "three")
    folder.write("b.jsonl", "four")
    assert folder.read("a.txt") == "three" and folder.names(".jsonl") == ["b.jsonl"] and folder.names() == ["a.txt", "b.jsonl"]


# --- models


def plain_clusters(pts):
    x = (pts - pts.mean(0)) / np.where(pts.std(0) > 0, pts.std(0), 1)
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= S.dbscan_eps
    core, label, c = near.sum(1) >= S.dbscan_least, {}, -1
    for k in range(len(x)):
        if core[k] and k not in label:
            c, todo = c + 1, [k]
            while todo:
                p = todo.pop()
                if p not in label:
                    label[p] = c
                    todo += [q for q in np.flatnonzero(near[p] & core)]
    return {k: label.get(k, min((label[q] for q in np.flatnonzero(near[k] & core)), default=-1)) for k in range(len(x))}


def as_users(spark, pts):
    return spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(pts)], "user long, avg_drift_score double, max_drift_score double, flagged_message_rate double")


def test_dbscan_equals_a_plain_one(spark, monkeypatch):
    rng = np.random.default_rng(4)
    blobs = np.concatenate([rng.normal(0, 0.3, (30, 3)), rng.normal(4, 0.3, (12, 3)), [[20, 20, 20], [-20, 9, 1]]])
    hot = np.concatenate([np.zeros((200, 3)), rng.normal(0, 3, (60, 3)), np.full((40, 3), 1.0)])  # a cell of copies
    line = np.stack([np.arange(60) * 0.5, np.zeros(60), np.zeros(60)], 1)
    monkeypatch.setattr(anomaly, "POINTS", 7)
    for pts in (blobs, np.concatenate([hot, line + 20])):
        want = plain_clusters(pts)
        got = {r.user: r.cluster for r in anomaly.dbscan(as_users(spark, pts), settings=S).collect()}
        assert got == want
    assert {r.user for r in anomaly.dbscan_noise(as_users(spark, blobs), settings=S).filter("is_noise").collect()} == {k for k, c in plain_clusters(blobs).items() if c < 0}
    assert anomaly.dbscan(as_users(spark, blobs).limit(0), settings=S).count() == 0


def test_dbscan_of_users_by_name(spark):
    pts = np.concatenate([np.random.default_rng(k).normal(6 * k, 0.3, (9, 3)) for k in range(3)])
    users = as_users(spark, pts).withColumn("user", F.concat(F.lit("u"), F.format_string("%03d", "user")))
    assert {int(r.user[1:]): r.cluster for r in anomaly.dbscan(users, settings=S).collect()} == plain_clusters(pts)


def test_components_of_a_long_path_take_few_rounds(spark):
    n, rounds = 10_000, []
    path = spark.range(n - 1).select((F.col("id") * 7919 % n).alias("a")).withColumn("b", F.col("a") + 1)
    links = path.repartition(6).unionByName(spark.createDataFrame([(20_000, 20_000), (None, 3), (30_001, 30_000), (30_000, 30_001)], "a long, b long"))
    got = graph.components(links, block=7, rounds=rounds)
    assert len(rounds) < 30 and max(rounds) <= n + 1
    stats = got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()
    assert stats < 64  # sizes of written tables, not products of estimates
    want = plain_components([tuple(r) for r in links.filter("a <> b").collect()])
    assert {r.node: r.label for r in got.collect()} == want


def plain_components(links):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in list(up)}


@pytest.mark.parametrize("seed", range(4))
def test_components_of_random_graphs(spark, seed):
    rng = np.random.default_rng(seed)
    links = [tuple(map(int, x)) for x in rng.integers(0, 400, (150 + 60 * seed, 2))] + [(9, int(x)) for x in range(300, 400) if seed % 2]
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    got = {r.node: r.label for r in graph.components(df, block=3).collect()}
    assert got == plain_components([x for x in links if x[0] != x[1]])


def test_tables_of_one_piece_of_work_go_with_it(spark):
    import threading

    found, barrier = {}, threading.Barrier(2)

    def work(k):
        with files.scratch() as mine:
            first, second = files.stored(spark.range(10 + k)), files.checkpointed(spark.range(5 + k))
            kept = mine.keep(files.stored(first.union(second)))
            paths = [p for _, p in mine.tables]
            barrier.wait()
        found[k] = (paths, kept.count())

    threads = [threading.Thread(target=work, args=(k,)) for k in range(2)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert {k: n for k, (_, n) in found.items()} == {0: 15, 1: 17}
    assert len({p for paths, _ in found.values() for p in paths}) == 4
    assert not any(files.exists(spark, p) for paths, _ in found.values() for p in paths)


def test_neighbouring_cells_meet_in_blocks(spark):
    rng = np.random.default_rng(8)
    a, b = rng.uniform(0, 1, (50, 3)), rng.uniform(0, 1, (60, 3)) + [1.4, 0, 0]
    members = spark.createDataFrame([(k, "ab"[k >= 50], *map(float, p)) for k, p in enumerate(np.concatenate([a, b]))], "user long, cell string, x0 double, x1 double, x2 double")
    box = [(f"{e}_{c}{k}", float(f(p[:, k]))) for c, p in (("a", a), ("b", b)) for k in range(3) for e, f in (("lo", np.min), ("hi", np.max))]
    pairs = spark.createDataFrame([("a", "b", 50, 60, *[v for _, v in box])], "a string, b string, n_a long, n_b long, " + ", ".join(f"{n} double" for n, _ in box))
    least = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1)).min()
    for eps in (least - 1e-6, least + 1e-6):
        assert anomaly.cell_links(pairs, members, 3, eps, block=8).count() == (eps > least)


def test_isolation_scores_equal_a_plain_walk(spark):
    """Paths and scores of a fixed forest, one row and one node at a time, with the textbook's mean path."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (64, 3))
    trees = [anomaly.grow_tree(x[rng.choice(64, 16, replace=False)], rng) for _ in range(20)]
    c = lambda n: 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n
    for feature, cut, child, depth in trees:  # leaves: the depth at which they are, and what their rows would still take
        at = {0: 0}
        for node in range(len(feature)):
            if feature[node] >= 0:
                at[child[node]] = at[child[node] + 1] = at[node] + 1
            else:
                assert any(abs(depth[node] - at[node] - c(n)) < 1e-9 for n in range(1, 17)) and at[node] <= 4
    want = []
    for row in x:
        total = 0.0
        for feature, cut, child, depth in trees:
            node = 0
            while feature[node] >= 0:
                node = child[node] + int(row[feature[node]] > cut[node])
            total += depth[node]
        want.append(2 ** -(total / 20 / c(16)))
    assert anomaly.forest_scores(x, trees, 16) == pytest.approx(want, abs=1e-12)


def test_quantiles_equal_numpys(spark):
    rng = np.random.default_rng(2)
    for values in (rng.normal(0, 1, 997).tolist(), [1.0] * 50 + [2.0], [3.0], [0.5, None, 4.0]):
        t = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
        got = ranks.exact_quantiles(t, "v", (0.0, 0.25, 0.5, 0.9, 1.0)).first()
        assert list(got) == pytest.approx(np.quantile([v for v in values if v is not None], [0, 0.25, 0.5, 0.9, 1]).tolist(), abs=1e-12)
    assert ranks.exact_quantiles(spark.createDataFrame([], "v double"), "v", (0.5,)).first().q0 is None


def test_isolation_forest_flags_the_odd_share(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, (380, 2)), rng.normal(9, 1, (20, 2))])
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(x)], "id long, a double, b double")
    got = anomaly.isolation_forest(df, ("a", "b"), Settings(trees=60)).toPandas().set_index("id")
    assert 15 <= got.is_anomaly.sum() <= 21 and got.is_anomaly[380:].sum() >= 15


def test_isolation_forest_samples_rows_not_values(spark, tmp_path):
    """Half of the rows are copies: a tree whose rows mirror that has its first cut between 0 and the largest value, and a leaf of some half of its rows."""
    df = spark.createDataFrame([(k, 0.0 if k % 2 else float(k)) for k in range(4000)], "id long, a double")
    for seed in range(3):
        nodes = anomaly.fit_forest(df, ("a",), Settings(seed=seed, trees=4, tree_rows=100))
        assert {r.tree: r.rows for r in nodes.select("tree", "rows").distinct().collect()} == dict.fromkeys(range(4), 100)
        # 50 of 100 equal rows still take their mean path where the tree ends: about 4.5 + 2.2 levels more than a leaf of one row.
        ends = nodes.filter("feature < 0").groupBy("tree").agg(F.max("depth").alias("deepest")).collect()
        assert all(r.deepest > 7.5 for r in ends)


def test_a_saved_isolation_forest_scores_alike(spark, tmp_path):
    df = spark.createDataFrame([(k, float(k * k % 91), float(k % 7)) for k in range(300)], "id long, a double, b double")
    small = Settings(trees=20, tree_rows=64)
    nodes = anomaly.fit_forest(df, ("a", "b"), small)
    anomaly.save_forest(nodes, str(tmp_path / "forest"))
    loaded = anomaly.load_forest(spark, str(tmp_path / "forest"))
    runs = [{r.id: r.anomaly_score for r in anomaly.isolation_forest(df, ("a", "b"), small, model=m).collect()} for m in (None, nodes, loaded)]
    assert runs[0] == runs[1] == runs[2] and len(set(runs[0].values())) > 30
    assert anomaly.isolation_forest(df.limit(0), ("a", "b"), small).count() == 0


def test_evaluation(spark):
    rows = [(1, 0.9), (1, 0.4), (0, 0.6), (0, 0.1), (0, 0.4)]
    df = spark.createDataFrame(rows, "label int, probability double").withColumn("predicted", (F.col("probability") >= 0.5).cast("int"))
    c = supervised.confusion(df).first()
    assert (c.tp, c.fp, c.fn, c.tn, c.precision, c.recall, c.accuracy) == (1, 1, 1, 2, 0.5, 0.5, 0.6)
    pairs = [(1.0 if a > b else 0.5 if a == b else 0.0) for la, a in rows for lb, b in rows if la == 1 and lb == 0]
    assert supervised.roc_auc(df).first().auc == pytest.approx(sum(pairs) / len(pairs))
    assert supervised.roc_auc(df.filter("label = 1")).first().auc is None
    assert supervised.confusion(df.limit(0)).first().f1 == 0


# --- retrieval and serving


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "cats and dogs"), (2, "dogs chase cars"), (3, "the stock market")], "chunk_id long, text string")
    asked = spark.createDataFrame([(0, "dogs chase")], "question_id int, text string")
    got = retrieval.tfidf_top(docs, asked, 4).orderBy("place").collect()
    assert [r.chunk_id for r in got] == [2, 1]
    n, df = 3, {"dogs": 2, "chase": 1, "cars": 1}
    idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items()}
    q, d = math.hypot(idf["dogs"], idf["chase"]), math.sqrt(sum(v * v for v in idf.values()))
    assert got[0].score == pytest.approx((idf["dogs"] ** 2 + idf["chase"] ** 2) / (q * d))


def test_markdown_chunks(spark):
    text = "# One\n" + "x" * 50 + "\n## Two\nshort\n#### not a heading of a section " + "y" * 40
    rows = messages.markdown_chunks(spark.createDataFrame([("f", text)], "source string, text string")).collect()
    assert [r.chunk.split("\n")[0] for r in rows] == ["# One", "## Two"]


def test_service(spark, tmp_path):
    risk = spark.createDataFrame([("emp_test01", 5.0, 6.0, 50, 9, 0.3), ("emp_low", 0.5, 2.0, 50, 1, 0.02)], "user string, avg_drift_score double, max_drift_score double, n_messages int, n_flagged_messages int, flagged_message_rate double")
    rows = spark.createDataFrame([("emp_test01", k, k, 1.0, 1, ["urgency_score"], 0.1, 0.2, "secret") for k in range(20)], "user string, id long, date long, drift_score double, n_flagged int, flagged_features array<string>, sentiment_polarity double, urgency_score double, content string")
    s = serve.Service(risk, rows, audit.AuditLog(str(tmp_path / "log")))
    assert s.investigate("nobody")["error"] and s.investigate("nobody")["requires_human_review"]
    high, low = s.investigate("emp_test01"), s.investigate("emp_low")
    assert high["recommendation"] == ESCALATE and low["recommendation"] == NO_ACTION and high["requires_human_review"]
    assert [r["id"] for r in high["recent_messages"]] == list(range(5, 20))
    assert "content" not in s.messages("emp_test01").columns
    assert s.riskiest(1)[0]["user"] == "emp_test01" and s.assistant("top_risky_users", {"k": 1})["data"][0]["user"] == "emp_test01"
    for k in (0, -1):
        with pytest.raises(ValueError):
            s.riskiest(k)
    assert s.explain("emp_low")["reason"] and "unknown" in s.assistant("dance")["text"]
    with pytest.raises(serve.NotReady):
        serve.Service(None, None).riskiest()
    assert s.log.verify(spark)
    assert serve.role_of("t", {"t": "analyst"}) == "analyst"
    with pytest.raises(serve.Denied):
        serve.check_permission("analyst", "revoke_consent")
    for call in (lambda: s.audit_log_is_valid(spark, "analyst"), lambda: s.revoke_consent(rows, str(tmp_path / "l"), "u", "analyst"), lambda: s.user("emp_low", "guest"), lambda: s.messages("emp_low", "guest")):
        with pytest.raises(serve.Denied):
            call()
    assert s.audit_log_is_valid(spark, "admin")
    guarded = serve.Service(risk, rows, secret="known")
    with pytest.raises(serve.Denied):
        guarded.assistant("top_risky_users")
    assert guarded.assistant("top_risky_users", secret="known")["data"]


def test_investigations_read_prior_flags_from_the_own_log(spark, tmp_path):
    risk = spark.createDataFrame([("emp_low", 0.5, 2.0, 50, 1, 0.02)], "user string, avg_drift_score double, max_drift_score double, n_messages int, n_flagged_messages int, flagged_message_rate double")
    s = serve.Service(risk, None, audit.AuditLog(str(tmp_path / "log")))
    assert s.investigate("emp_low")["recommendation"] == NO_ACTION
    for _ in range(3):
        s.log.append("drift_flagged", "emp_low", {"drift_score": 3.0})
    found = s.investigate("emp_low")
    assert found["repeat_flags"] == 3 and found["recommendation"] == ESCALATE and "prior flags" in found["steps"]
    assert serve.Service(risk, None).investigate("emp_low")["steps"].count("prior flags") == 0  # without a log none were read
    assert s.assistant("investigate_user", {"user_pseudonym": "emp_low"})["data"]["repeat_flags"] == 3


def test_cef(spark):
    df = spark.createDataFrame([("emp_a", 3.4, 0.22, 87), ("emp_b", 99.0, 0.0, 1), ("emp_c", 1.25, 0.0, 1)], "user string, avg_drift_score double, flagged_message_rate double, n_messages int")
    lines = {r.user: r.line for r in sinks.cef_lines(df).collect()}
    assert "|7|suser=emp_a " in lines["emp_a"] and "|10|" in lines["emp_b"] and "|2|" in lines["emp_c"]
    with pytest.raises(NotImplementedError):
        sinks.send_syslog(df, "host")


# --- sources


def test_prepare(spark):
    rows = [("1", "01/02/2010 03:04:05", "u", "x"), ("2", "bad", "u", "x"), ("3", "01/02/2010 03:04:05", "u", " "), ("4", "01/02/2010 03:04:05", None, "x")]
    raw = spark.createDataFrame([(*r, "", "", "1", "0") for r in rows], "id string, date string, user string, content string, to_addr string, from_addr string, size string, attachments string")
    got = messages.prepare(raw).collect()
    assert [r.id for r in got] == ["1"] and got[0].activity == "send" and str(got[0].date) == "2010-01-02 03:04:05"
    with pytest.raises(ValueError, match="content"):
        messages.require(raw.drop("content"))
    assert messages.sample(raw, 2).count() == 2 and messages.sample(raw, 9).count() == 4


def test_csv_source(spark, tmp_path):
    path = str(tmp_path / "any.csv")
    synthetic.messages(spark, users=4).toPandas().to_csv(path, index=False)
    assert messages.discover_csv(spark, str(tmp_path)) == path
    got = messages.first_available(spark, [("csv", {"path": str(tmp_path / "absent.csv")}), ("csv", {"path": path})])
    assert got.count() == synthetic.messages(spark, users=4).count()
    assert messages.read_table(spark, str(tmp_path / "none")) is None


def test_paths_with_a_scheme(spark, tmp_path):
    """Ledgers, labels and message files are found by URI as by path, and a ledger that cannot be found is an error."""
    for folder in (str(tmp_path), f"file://{tmp_path}"):
        sinks.write_ledger(spark.createDataFrame([("a", True, "t", "s"), ("b", False, "t", "s")], messages.CONSENT), f"{folder}/ledger")
        assert [r.user for r in messages.read_consent(spark, f"{folder}/ledger").collect()] == ["a"]
        spark.createDataFrame([("a", 1)], messages.LABELS).write.mode("overwrite").option("header", True).csv(f"{folder}/labels")
        assert messages.read_labels(spark, f"{folder}/labels").count() == 1 and messages.read_labels(spark, f"{folder}/none") is None
        (tmp_path / "email.csv").write_text("id,date\n")
        assert messages.discover_csv(spark, folder) == f"{folder}/email.csv" and messages.discover_csv(spark, f"{folder}/none") is None
        with pytest.raises(FileNotFoundError):
            messages.read_consent(spark, f"{folder}/absent")
    assert messages.read_consent(spark, None).count() == 0


def test_a_broken_off_replacement_loses_no_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    sinks.write_ledger(spark.createDataFrame([("a", True, "t", "s")], messages.CONSENT), path)
    (tmp_path / "ledger").rename(tmp_path / "ledger.before")  # as after a crash between the two renames
    assert messages.read_consent(spark, path).count() == 1


def test_the_shared_folder_is_never_a_guess_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                class Found:
                    def getCheckpointDir(self):
                        class None_:
                            def isDefined(self):
                                return False

                        return None_()

                return Found()

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        files.shared_folder(Session())


def test_database_samples_are_uniform_over_partitions(spark):
    """Partitions of very different sizes, as connections of a database give them: every row is as likely to be drawn as any other."""
    asked, found = [], np.zeros(200)
    table = spark.createDataFrame([(k,) for k in range(200)], "id long").repartition(1).filter("id < 10").union(spark.createDataFrame([(k,) for k in range(10, 200)], "id long").repartition(3))

    def read(options):
        asked.append(options)
        return table

    options = {"url": "jdbc:x", "dbtable": "mail", "partitionColumn": "id", "lowerBound": "0", "upperBound": "200", "numPartitions": "4", "cap": "40"}
    for seed in range(60):
        rows = [r.id for r in messages.database_sample(spark, {**options, "seed": str(seed)}, read).collect()]
        assert len(set(rows)) == 40
        found[rows] += 1
    assert all("query" not in o and "cap" not in o and o["numPartitions"] == "4" for o in asked)
    # 60 draws of one row in five: 12 expected; the first ten rows lie in a partition of their own.
    assert 12 - 4 < found[:10].mean() < 12 + 4 and 1 <= found.min() and found.max() <= 26
    assert messages.database_sample(spark, {"dbtable": "mail", "cap": "0"}, read).count() == 200
    plan = messages.database_sample(spark, options, read)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" in plan and "Exchange" not in plan.split("TakeOrdered")[0]


def test_validate(spark):
    ok = spark.createDataFrame([(1, "u", None)], "id int, user string, content string").withColumn("date", F.current_timestamp())
    assert len(profile.validate(ok)) == 2
    for bad in (ok.drop("user"), ok.limit(0), ok.withColumn("date", F.lit("x"))):
        with pytest.raises(ValueError):
            profile.validate(bad)


def test_pipeline(spark):
    rows = messages.prepare(synthetic.messages(spark, users=8))
    r = pipeline.run(rows, rows.select("user").distinct().filter("user <> 'user001'"), Settings(window=10), models=False)
    assert not {"content", "to", "cc", "bcc", "from"} & set(r.scored.columns)
    risk = r.risk.collect()
    assert len(risk) == 7 and all(x.user.startswith("emp_") and 0 <= x.avg_drift_score <= 10 for x in risk)


def test_message_pipeline_runs_over_the_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("trim(text) <> '' AND trim(source) <> ''")
    got = catalog.QUERIES["message_pipeline"](spark, sf).collect()
    assert sum(r.n_messages for r in got) == docs.count() > 0 and len(got) == docs.select("source").distinct().count()


def test_pipeline_over_synthetic_messages_with_models(spark):
    risk = pipeline.run(messages.prepare(synthetic.messages(spark, users=20)), None, Settings(window=10, trees=50)).risk.collect()
    assert len(risk) == 20 and all(r.cluster >= -1 for r in risk)


def test_other_back_ends_and_warnings(spark):
    rows = messages.prepare(synthetic.messages(spark, users=3))
    own = Settings(window=5, salt="secret", scorer=lambda tk: (F.lit(0.25), F.lit(0.5)), tagger=lambda tk: {f"{k}_ratio": F.lit(0.1) for k in ("noun", "verb", "adj", "adv")})
    got = pipeline.featured(rows, None, own).select("sentiment_polarity", "sentiment_subjectivity", "noun_ratio").distinct().collect()
    assert [tuple(r) for r in got] == [(0.25, 0.5, 0.1)]
    assert not pipeline.unsafe(own) and pipeline.unsafe(Settings(salt="dev-salt-change-me"))


def test_run_and_persist(spark, tmp_path):
    rows = messages.prepare(synthetic.messages(spark, users=8))
    log = audit.AuditLog(str(tmp_path / "audit.jsonl"))
    for _ in range(2):
        r = pipeline.run_and_persist(spark, rows, str(tmp_path / "out"), labels=synthetic.labels(spark, 8), settings=Settings(window=10, trees=20), log=log)
    snapshots = messages.read_snapshots(spark, str(tmp_path / "out/snapshots"))
    assert snapshots.count() == 2 and log.verify(spark) and r.risk.count() == 8
    assert messages.read_audit(spark, str(tmp_path / "audit.jsonl"), 3).count() == 3
    assert json.loads((tmp_path / "out/reports/bias_audit.json").read_text())["proxies"]
    service = serve.Service(r.risk, r.scored, log)
    assert service.newest_snapshot(snapshots)["moved"] == [] and service.audit_log_is_valid(spark, "admin")
    sinks.write_ledger(privacy.default_ledger(r.risk), str(tmp_path / "ledger"))
    stored = spark.read.schema(messages.CONSENT).option("header", True).csv(str(tmp_path / "ledger"))
    service.revoke_consent(stored, str(tmp_path / "ledger"), r.risk.first().user, "admin")
    assert spark.read.schema(messages.CONSENT).option("header", True).csv(str(tmp_path / "ledger")).filter("not consented").count() == 1


def test_models_are_saved(spark, tmp_path):
    rows = [(k, float(k % 7), float(k), k, k % 5, (k % 5) / 10, int(k > 30)) for k in range(40)]
    df = spark.createDataFrame(rows, "user long, avg_drift_score double, max_drift_score double, n_messages long, n_flagged_messages long, flagged_message_rate double, label int")
    assert supervised.stratified_split(df).filter("is_test").groupBy("label").count().count() == 2
    model = supervised.fit(df, rounds=10)
    supervised.save(model, str(tmp_path / "model"))
    a, b = (x.orderBy("user").select("probability", "predicted").collect() for x in (supervised.predict(model, df), supervised.predict_saved(str(tmp_path / "model"), df)))
    assert a == b
    assert supervised.write_metrics(str(tmp_path), "forest", supervised.predict(model, df))["auc"] > 0.9
    ranking = supervised.attribution(model, df)
    sinks.write_attribution(ranking, str(tmp_path / "attribution.json"))
    assert ranking.count() == 5


def test_model_queries_fit_the_whole_models(spark, sf, monkeypatch):
    fits, fit = [], supervised.fit

    def small(df, kind, settings=None, rounds=None):
        fits.append((kind, rounds))
        return fit(df, kind, settings=settings, rounds=2)

    monkeypatch.setattr(supervised, "fit", small)
    for name in ("random_forest", "gradient_boosting", "attribution"):
        catalog.QUERIES[name](spark, sf)
    assert fits == [("forest", None), ("boosting", None), ("forest", None)]


def test_rows_of_a_fit_are_spread_by_their_number(spark, monkeypatch):
    """All rows of a fit lay in one task in each of its rounds; spread out, they give the same boosted trees."""
    rows = [(k, float(k % 13), float(k % 7), float(k * 5 % 11), int(k % 13 + k % 7 > 9)) for k in range(450)]
    names = ("a", "b", "c")
    df = spark.createDataFrame(rows, "user long, a double, b double, c double, label int").coalesce(1)
    parts, whole = [], supervised.Pipeline.fit

    def seen(self, dataset, params=None):
        parts.append([len(x) for x in dataset.select("user").rdd.glom().collect()])
        return whole(self, dataset, params)

    monkeypatch.setattr(supervised.Pipeline, "fit", seen)
    found = []
    for most in (1000, 100):
        monkeypatch.setattr(supervised, "ROWS_A_TASK", most, raising=False)
        model = supervised.fit(df, "boosting", names, rounds=5)
        found.append([r.probability for r in supervised.predict(model, df).orderBy("user").collect()])
    assert len(parts[0]) == 1 and len(parts[1]) == 5 and sum(parts[1]) == 450 and max(parts[1]) < 200
    assert found[0] == pytest.approx(found[1], abs=1e-9)


def test_streams_of_contacts_and_days(spark, tmp_path):
    from tidemark.streaming.baseline import daily_counts, stream_contacts

    rows = [(int(k % 3 == 0), k, k, [(k * 7 + j) % 6 for j in range((k * 5) % 4)]) for k in range(60)]
    df = spark.createDataFrame(rows, "user long, date long, id long, recipients array<long>")
    df.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run = stream_contacts(live, 7).writeStream.format("memory").queryName("contacts_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = {r.id: (r.contact_degree, r.interaction_concentration) for r in spark.table("contacts_out").collect()}
    assert all(got[r.id] == pytest.approx((r.contact_degree, r.interaction_concentration)) for r in network.with_network(df, 7).collect())
    days = spark.createDataFrame([(f"2020-01-0{d} 10:00:00",) for d in (1, 1, 2, 9)], "d string").select(F.to_timestamp("d").alias("date"))
    days.write.parquet(str(tmp_path / "days"))
    run = daily_counts(spark.readStream.schema(days.schema).parquet(str(tmp_path / "days"))).writeStream.format("memory").queryName("days_out").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(r.n for r in spark.table("days_out").collect()) == [1, 1, 2]


def test_streams_of_several_features_equal_the_batch(spark, tmp_path):
    """Two features with gaps, users that are texts: the stream's z are those of the batch form."""
    from tidemark.streaming.baseline import stream_baseline

    rows = [(f"u{k % 3}", k, float((k * 7) % 11) if k % 17 else None, float(k % 5 > 1)) for k in range(120)]
    df = spark.createDataFrame(rows, "user string, id long, urgency_score double, noun_ratio double").withColumn("date", F.timestamp_seconds(F.col("id") * 60))
    both = ("urgency_score", "noun_ratio")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run = stream_baseline(live, 6, S, both).writeStream.format("memory").queryName("z_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = {r.id: r for r in spark.table("z_out").collect()}
    want = {r.id: r for r in drift.with_drift(baseline.with_z(df, both, 6), both, S).collect() if r.z_urgency_score is not None or r.z_noun_ratio is not None}
    assert got.keys() == want.keys() and len(got) > 90
    for k, w in want.items():
        for f in both:
            a, b = got[k][f"z_{f}"], w[f"z_{f}"]
            assert (b is None and (a is None or math.isnan(a))) or a == pytest.approx(b, abs=1e-9)
        assert got[k].drift_score == pytest.approx(w.drift_score, abs=1e-4)


def test_idle_state_goes_with_the_watermark(spark, tmp_path):
    """A user who comes back after the idle time starts anew; without an idle time the old window still counts."""
    from tidemark.streaming.baseline import stream_baseline

    day = 86_400
    parts = [[("a", d * 60, k) for k, d in enumerate(range(5))], [("b", 10 * day, 10)], [("b", 20 * day, 11)], [("b", 21 * day, 12)], [("a", 22 * day, 13)]]
    folder = tmp_path / "in"
    for k, rows in enumerate(parts):
        part = spark.createDataFrame([(u, i, float(i % 3)) for u, _, i in rows], "user string, id long, value double")
        at = {i: t for _, t, i in rows}
        times = spark.createDataFrame(list(at.items()), "id long, t long")
        part.join(times, "id").withColumn("date", F.timestamp_seconds("t")).select("user", "id", "value", "date").coalesce(1).write.mode("append").parquet(str(folder))
        import time

        time.sleep(1.1)  # files are read in the order of their times
    schema = spark.read.parquet(str(folder)).schema
    for idle, back in ((3 * day, set()), (None, {13})):
        live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        name = f"idle_{idle is None}"
        run = stream_baseline(live, 5, S, idle_seconds=idle).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        run.awaitTermination()
        assert {r.id for r in spark.table(name).collect()} == back


def test_stream_of_files(spark, tmp_path):
    synthetic.messages(spark, users=3).write.option("header", True).csv(str(tmp_path / "mail"))
    run = messages.stream_messages(spark, str(tmp_path / "mail")).select("id").writeStream.format("memory").queryName("mail_out").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("mail_out").count() == synthetic.messages(spark, users=3).count()


def test_answers(spark):
    docs = spark.createDataFrame([("guide.md", "Escalations are reviewed by a human before anything happens.")], "source string, chunk string")
    log = spark.createDataFrame([(1, "t", "consent_revoked", None, "admin", '{"a": 1}', "", "")], messages.AUDIT)
    passages = retrieval.corpus(docs, log)
    got = retrieval.answer("who reviews escalations", passages)
    assert got["sources"][0]["source"] == "guide.md" and not got["generated"]
    assert retrieval.answer("who reviews escalations", passages, generator=lambda q, p: "a human")["answer"] == "a human"
    assert "Details: a=1." in passages.filter("source = 'audit_log'").first().text


# --- registered queries


def test_stream_equals_batch(spark, sf):
    a, b = (catalog.QUERIES[n](spark, sf).select("id", F.round("z", 6).alias("z")).orderBy("id").collect() for n in ("stream_baseline", "baseline_z"))
    assert a == b


def test_daily_volume_counts_all_events_and_fills_gaps(spark, tmp_path):
    days = (1, 1, 2, 5, 5, 5)
    rows = [(k, k + 2, f"2020-01-0{d} 10:00:00") for k, d in enumerate(days)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, t string").select("event_id", "user_id", F.to_timestamp("t").alias("ts"), F.lit(1.0).alias("value"))
    df.write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.QUERIES["daily_volume"](spark, str(tmp_path)).orderBy("day").collect()
    assert [(r.day[-2:], r.n) for r in got] == [("01", 2), ("02", 1), ("03", 0), ("04", 0), ("05", 3)]


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), con.execute(catalog.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    key = [c for c in cols if got[c].dtype != float] + [c for c in cols if got[c].dtype == float]
    a, b = (x[cols].sort_values(key).reset_index(drop=True) for x in (got, want))
    for c in cols:
        assert a[c].dtype == b[c].dtype
        if a[c].dtype == float:
            assert np.allclose(a[c], b[c], rtol=0, atol=2e-6, equal_nan=True)
        else:
            assert a[c].astype(str).tolist() == b[c].astype(str).tolist()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_training_text_operators():
    import re
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    for f in (root / "tidemark").rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"(?m)^\s*(from|import) .*\bllm\b", f.read_text()), f


# --- Shapley values


def _by_enumeration(trees, x, n_features):
    """Shapley values by all subsets of features; trees are nested (feature, cut, left weight, right weight, left, right) or numbers."""
    from itertools import combinations

    def value(t, known):
        if not isinstance(t, tuple):
            return t
        f, cut, wl, wr, a, b = t
        if f in known:
            return value(a if x[f] <= cut else b, known)
        return (wl * value(a, known) + wr * value(b, known)) / (wl + wr)

    out = []
    for i in range(n_features):
        rest, total = [f for f in range(n_features) if f != i], 0.0
        for k in range(n_features):
            for s in combinations(rest, k):
                w = math.factorial(k) * math.factorial(n_features - 1 - k) / math.factorial(n_features)
                total += w * sum(value(t, {*s, i}) - value(t, set(s)) for t in trees)
        out.append(total)
    return out


def _nested(nodes, tree, at, by_class):
    own = {n["id"]: n for n in nodes if n["tree"] == tree}

    def of(k):
        n = own[k]
        if n["left"] < 0:
            return n["stats"][1] / sum(n["stats"]) if by_class else n["prediction"]
        w = [sum(own[c]["stats"]) if by_class else own[c]["stats"][0] for c in (n["left"], n["right"])]
        return (n["feature"], n["cut"][0], *w, of(n["left"]), of(n["right"]))

    return of(at)


@pytest.mark.parametrize("kind", ["forest", "boosting"])
def test_shapley_values_equal_all_subsets_and_add_up(spark, kind):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(150, 5)), 1)
    y = ((x[:, 0] * x[:, 1] > 0) | (x[:, 3] > 1)).astype(int)
    names = ("a", "b", "c", "d", "e")
    df = spark.createDataFrame([(i, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y))], "user long, a double, b double, c double, d double, e double, label int")
    model = supervised.fit(df, kind, names, rounds=6)
    rows = shapley.shapley_values(model, df, names).toPandas().sort_values("user")
    nodes, weights = shapley.saved_nodes(model), list(model.stages[-1].treeWeights)
    if kind == "forest":
        weights = [w / sum(weights) for w in weights]
    scale = lambda t, w: t * w if not isinstance(t, tuple) else (*t[:4], scale(t[4], w), scale(t[5], w))
    trees = [scale(_nested(nodes, k, 0, kind == "forest"), w) for k, w in enumerate(weights)]
    for i in range(0, 150, 15):
        assert np.allclose(rows.iloc[i][[f"phi_{f}" for f in names]].to_numpy(float), _by_enumeration(trees, x[i], 5), atol=1e-9)
    p = supervised.predict(model, df).toPandas().sort_values("user").probability.to_numpy()
    said = rows.phi_sum.to_numpy()
    assert np.allclose(said if kind == "forest" else 1 / (1 + np.exp(-2 * said)), p, atol=1e-9)
    order = shapley.ranked(shapley.shapley_values(model, df, names), names).orderBy("place").collect()
    assert {r.feature for r in order[:3]} == {"a", "b", "d"} and len(order) == 5


# --- bounded streams


def _run_stream(df, name, folder, mode="append"):
    run = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder / f"check_{name}")).trigger(availableNow=True).start()
    run.awaitTermination()


def _plain_lru(rows, window, capacity):
    """z by a plain cache of windows: (user, id, value) in order."""
    from collections import OrderedDict

    cache, out = OrderedDict(), {}
    for user, i, value in rows:
        past = cache.pop(user, [])
        if len(past) == window:
            sd = statistics.pstdev(past)
            out[i] = (value - statistics.fmean(past)) / sd if min(past) < max(past) else 0.0
        cache[user] = [*past, value][-window:]
        if len(cache) > capacity:
            cache.popitem(last=False)
    return out


@pytest.mark.parametrize("capacity", [2, 50])
def test_state_of_the_least_recently_seen_user_goes(spark, tmp_path, capacity):
    from tidemark.streaming.bounded import bounded_baseline

    rng = np.random.default_rng(2)
    users = [str(rng.choice(list("abc" if k % 40 < 30 else "abcdef"))) for k in range(160)]
    rows = [(u, k, float((k * 7) % 11)) for k, u in enumerate(users)]
    for k in range(4):
        part = spark.createDataFrame(rows[40 * k : 40 * k + 40], "user string, id long, value double").withColumn("date", F.timestamp_seconds("id"))
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
        import time

        time.sleep(1.1)  # files are read in the order of their times
    schema = spark.read.parquet(str(tmp_path / "in" / "p0")).schema
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    _run_stream(bounded_baseline(live, 3, S, capacity=capacity, shards=1), f"lru_{capacity}", tmp_path)
    got = {r.id: r.z_value for r in spark.table(f"lru_{capacity}").collect()}
    want = _plain_lru(rows, 3, capacity)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_a_stream_goes_on_where_a_batch_has_ended(spark, tmp_path):
    from tidemark.streaming.bounded import bounded_baseline, last_values

    both = ("urgency_score", "noun_ratio")
    rows = [(f"u{k % 4}", k, float((k * 7) % 11) if k % 17 else None, float(k % 5 > 1)) for k in range(160)]
    df = spark.createDataFrame(rows, "user string, id long, urgency_score double, noun_ratio double").withColumn("date", F.timestamp_seconds(F.col("id") * 60))
    df.filter("id >= 80").repartition(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    _run_stream(bounded_baseline(live, 6, S, both, shards=3, start=last_values(df.filter("id < 80"), 6, both)), "went_on", tmp_path)
    got = {r.id: r for r in spark.table("went_on").collect()}
    want = {r.id: r for r in drift.with_drift(baseline.with_z(df, both, 6), both, S).filter("id >= 80").collect() if r.z_urgency_score is not None or r.z_noun_ratio is not None}
    assert got.keys() == want.keys() and len(got) > 60
    assert all(got[k].drift_score == pytest.approx(w.drift_score, abs=1e-4) and (w.z_noun_ratio is None or got[k].z_noun_ratio == pytest.approx(w.z_noun_ratio, abs=1e-9)) for k, w in want.items())


def test_stream_of_contacts_by_name(spark, sf, tmp_path):
    """Users and recipients that are texts, over the orders as messages; expiry."""
    from tidemark.sources.adapters import purchases
    from tidemark.streaming.baseline import stream_contacts

    df = purchases(spark, sf).withColumn("user", F.concat(F.lit("c"), "user")).withColumn("recipients", F.transform("recipients", lambda x: F.concat(F.lit("s"), x))).withColumn("date", F.col("date").cast("timestamp"))
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    _run_stream(stream_contacts(live, 5), "named_contacts", tmp_path)
    got = {r.id: (r.contact_degree, r.interaction_concentration) for r in spark.table("named_contacts").collect()}
    want = {r.id: (r.contact_degree, r.interaction_concentration) for r in network.with_network(df, 5).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    _run_stream(stream_contacts(live, 5, idle_seconds=3600), "contacts_idle", tmp_path)
    assert spark.table("contacts_idle").count() == len(want)



def _in_batches(spark, folder, parts):
    """A stream that reads the parts one after the other."""
    import time

    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{folder}/p{k}")
        time.sleep(1.1)  # files are read in the order of their times
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_streams_keep_users_in_shards(spark, tmp_path):
    """Python runs once a shard, whose state is one row, not once a user; users, ids and contacts that are missing change nothing for the others."""
    from tidemark.streaming.baseline import stream_baseline, stream_contacts

    big, rng = 2**53, np.random.default_rng(3)
    user = lambda k: None if k % 41 == 40 else big + k % 41
    rows = [(user(k), big + k, float((k * 7) % 11), [big + int(x) for x in rng.integers(0, 5, k % 4)]) for k in range(800)]
    df = spark.createDataFrame(rows, "user long, id long, value double, recipients array<long>").withColumn("date", F.timestamp_seconds(F.col("id") - big))
    live = _in_batches(spark, tmp_path / "in", [df.filter(F.col("id") < big + 300), df.filter(F.col("id") >= big + 300)])
    forms = {"shards_c": (stream_contacts(live, 7, shards=4), network.with_network(df, 7)), "shards_z": (stream_baseline(live, 5, S, shards=4), baseline.with_z(df, ("value",), 5).filter("z_value is not null"))}
    for name, (stream, batch) in forms.items():
        run = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        run.awaitTermination()
        assert 2 <= run.lastProgress["stateOperators"][0]["numRowsTotal"] <= 5  # four shards, and one of no user
        cols = [c for c in spark.table(name).columns if c not in ("drift_score", "date")]
        got, want = ({r.id: r for r in t.select(*cols).collect()} for t in (spark.table(name), batch))
        assert got.keys() == want.keys() and len(got) > 500
        assert all(got[k].user == w.user and list(got[k])[2:] == pytest.approx(list(w)[2:], abs=1e-9) for k, w in want.items())
    odd = spark.createDataFrame([(1, None, 0, [big, None]), (1, big, 1, [big + 1]), (1, big + 1, 2, []), (2, big + 2, 0, [5]), (2, big + 3, 1, [5])], "user long, id long, date long, recipients array<long>")
    _run_stream(stream_contacts(_in_batches(spark, tmp_path / "odd", [odd]), 9, shards=1), "odd_contacts", tmp_path)
    assert {r.id: r.contact_degree for r in spark.table("odd_contacts").collect()} == {None: 0, big: 2, big + 1: 3, big + 2: 0, big + 3: 1}


def test_idle_users_go_from_a_shard_that_is_in_use(spark, tmp_path):
    from tidemark.streaming.baseline import stream_contacts

    day = 86_400
    parts = [[("a", 0, 0), ("b", 0, 1)], [("b", 2 * day, 2)], [("b", 4 * day, 3)], [("b", 6 * day, 4)], [("b", 6 * day + 9, 7)], [("a", 7 * day, 5), ("b", 7 * day, 6)]]
    rows = [spark.createDataFrame(p, "user string, t long, id long").select("user", F.timestamp_seconds(F.col("t") + 100 * day).alias("date"), "id", F.array("id").alias("recipients")) for p in parts]
    live = _in_batches(spark, tmp_path / "in", rows)
    for idle, left in ((3 * day, 0), (None, 1)):
        _run_stream(stream_contacts(live, 5, idle_seconds=idle, shards=1), f"idle_shard_{idle is None}", tmp_path)
        got = {r.id: r.contact_degree for r in spark.table(f"idle_shard_{idle is None}").collect()}
        assert got == {0: 0, 1: 0, 2: 1, 3: 2, 4: 3, 5: left, 6: 5, 7: 4}


# --- words in their order


def _plain_tags(words):
    """The best of all sequences of tags, by trying each; the first of equals from the last word back."""
    import itertools as it

    n = len(tagging.TAGS)
    score = lambda seq: sum(tagging.emission(w)[t] for w, t in zip(words, seq)) + tagging.FIRST[seq[0]] + sum(tagging.FOLLOWS[a][b] for a, b in zip(seq, seq[1:]))
    return max(score(s) for s in it.product(range(n), repeat=len(words))), score


def test_the_decoder_finds_a_best_sequence():
    rng = np.random.default_rng(1)
    vocabulary = ["the", "dog", "is", "quickly", "running", "beautiful", "nation", "walks", "not", "a", "red", "to", "x"]
    texts = [[str(w) for w in rng.choice(vocabulary, n)] for n in (1, 2, 3, 4, 5, 5, 5, 0, 6)]
    names = sorted({w for t in texts for w in t})
    scores = np.array([tagging.emission(w) for w in names])
    flat = np.array([names.index(w) for t in texts for w in t])
    offsets = np.cumsum([0, *map(len, texts)])
    got = tagging.decoded(flat, offsets, scores)
    for k, t in enumerate(texts):
        if t:
            best, score = _plain_tags(t)
            assert score(got[offsets[k] : offsets[k + 1]].tolist()) == best


def test_tags_and_sentiment_in_context(spark):
    tk = F.col("t")
    rows = spark.createDataFrame([(0, "the dog is running quickly".split()), (1, []), (2, None), (3, "not good".split()), (4, "i don't think that was very bad".split()), (5, "slightly sad but really happy".split())], "id int, t array<string>")
    polarity, subjectivity = tagging.sentiment_in_context(F.coalesce(tk, F.array().cast("array<string>")))
    kinds = tagging.viterbi_ratios(F.coalesce(tk, F.array().cast("array<string>")))
    got = {r.id: r for r in rows.select("id", polarity.alias("p"), subjectivity.alias("s"), *[c.alias(n) for n, c in kinds.items()]).collect()}
    assert (got[0].noun_ratio, got[0].verb_ratio, got[0].adv_ratio) == (0.2, 0.4, 0.2)
    assert (got[1].noun_ratio, got[1].p, got[2].p) == (0, 0, 0)
    assert (got[3].p, got[5].p) == (-1.0, 0.5)
    assert got[4].p == -1.0 and got[4].s == round(1 / 7, 4)  # the negation is four words away


def test_security_lines_have_exact_digits(spark):
    df = spark.createDataFrame([(1, 0.47435, 0.03125, 64), (2, 0.09375, 0.0, 1)], "user int, avg_drift_score double, flagged_message_rate double, n_messages long")
    lines = {r.user: r.line for r in sinks.cef_lines(df).collect()}
    assert "cs1=0.4743 " in lines[1] and "cs2=0.0312 " in lines[1] and "cs1=0.0938 " in lines[2] and "cs2=0.0000 " in lines[2]


def test_doubles_are_rounded_as_the_sql_rounds_them(spark):
    import duckdb

    values = [58.005, -58.005, 1.005, 2.675, 0.125, -0.125, 57.994999]
    got = [r.x for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").orderBy("k").select(T.rounded(F.col("v"), 2).alias("x")).collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 2)", [v]).fetchone()[0] for v in values] and got[0] == 58.01


def test_short_windows_agree_with_the_sql_to_the_last_bit(spark):
    import duckdb

    rng = np.random.default_rng(3)
    rows = [(u, k, None if rng.random() < 0.03 else int(v) / 10) for u in range(3) for k, v in enumerate(rng.integers(0, 10, 700))]
    df = spark.createDataFrame(rows, "user int, id long, x double")
    got = {(r.user, r.id): r.z_x for r in baseline.with_z(df, ("x",), 5, ("id",)).collect()}
    con = duckdb.connect()
    con.register("t", df.toPandas())
    z = drift_queries._Z.format(f="x", n=5)
    want = con.execute(f'SELECT "user", id, {z} FROM (SELECT "user", id, CASE WHEN isnan(x) THEN NULL ELSE x END AS x FROM t) WINDOW w AS (PARTITION BY "user" ORDER BY id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)').fetchall()
    assert len(want) == len(got) and all(got[u, i] == z for u, i, z in want) and sum(z is not None for *_, z in want) > 1000


def test_endings_are_counted_as_patterns_find_them(spark):
    words = [*"ly fly only nation nations ing king er or her word it ity city ness less lessness ship ic al all y e a' o'er quickly' 'ing ious ful wonderful ise rise ify modify ish ist ism ance ence ment ed".split()]
    rows = [(0, words), (1, []), (2, ["y"]), (3, ["l"]), (4, ["y", "ly"]), (5, None), (6, words[::-1])]
    df = spark.createDataFrame(rows, "id int, tk array<string>").coalesce(1)
    got = {r.id: r for r in df.select("id", *[x.alias(k) for k, x in T.pos_ratios(F.col("tk")).items()]).collect()}
    for k, tk in rows:
        kinds = [next((name for name, e in T.POS_ENDINGS.items() if re.search(e, w)), "other") for w in tk or []]
        for name in T.POS_ENDINGS:
            assert got[k][f"{name}_ratio"] == pytest.approx(kinds.count(name) / max(len(kinds), 1), abs=5.1e-5), (k, name)
    plan = df.select(*T.pos_ratios(F.col("tk")).values())._jdf.queryExecution().optimizedPlan().toString()
    assert "rlike" not in plan.lower()  # no expression for each word and ending


def test_texts_are_worked_on_before_they_are_brought_together_by_user(spark):
    rows = messages.prepare(synthetic.messages(spark, users=3))
    plan = pipeline.featured(rows, None, Settings(window=5)).select("id", "noun_ratio", "contact_degree")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and plan.rindex("Window") < plan.index("[^a-z']+")  # from the top down: windows, below them the texts


def test_rows_between_the_same_cuts_are_worked_on_once(monkeypatch):
    box = lambda f, lo, hi, share, value: shapley.Boxes(np.array([value]), np.array([[f]]), np.array([[lo]]), np.array([[hi]]), np.array([[share]]))
    leaves = [box(0, -math.inf, 1.0, 0.25, 4.0), box(0, 1.0, math.inf, 0.75, 8.0), box(1, -math.inf, 2.0, 0.5, 1.0), box(1, 2.0, math.inf, 0.5, 3.0)]
    x = np.array([[a, b] for a in (0.5, 1.0, 1.5, math.nan, math.inf) for b in (-math.inf, 2.0, 2.5, 9.0)] * 50)
    worked, own = [], shapley._shapley
    monkeypatch.setattr(shapley, "_shapley", lambda rows, trees: (worked.append(len(rows)), own(rows, trees))[1])
    assert np.array_equal(shapley.shapley(x, leaves), own(x, leaves)) and worked == [4]
    assert shapley.shapley(x[:0], leaves).shape == (0, 2)
