"""Queries of baselines, drift, networks, trends, policy, monitoring and fairness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.functions import text as T
from tidemark.operators import audit, baseline, drift, fairness, monitor, network, policy, retrieval, serve, trend
from tidemark.plans.registry import Register
from tidemark.plans.text_queries import CAPS, DIVERSITY, FUNCTION_RATIO, WORD_LENGTH
from tidemark.sources import sinks
from tidemark.sources.adapters import documents, events, purchases, table

Q = Register()
S = Settings()
#: Windows for the tables: events have 49 or more a user, documents few a source on the smallest scale.
W, DOC_W, NET_W = 30, 5, 10
DOC_FEATURES = ("lexical_diversity", "function_word_ratio", "avg_word_length", "caps_ratio")


def scored_events(spark: SparkSession, sf: str) -> DataFrame:
    return drift.with_drift(baseline.with_z(events(spark, sf), ("value",), W), ("value",), S)


def risk_of_events(spark: SparkSession, sf: str) -> DataFrame:
    return drift.user_risk(scored_events(spark, sf))


def scored_documents(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf).withColumn("tk", T.tokens(F.col("content")))
    tk, c = F.col("tk"), F.col("content")
    d = d.select("user", "id", T.lexical_diversity(tk).alias("lexical_diversity"), T.function_word_ratio(tk).alias("function_word_ratio"), T.avg_word_length(tk).alias("avg_word_length"), T.caps_ratio(c).alias("caps_ratio"), T.readability_flesch(c, tk).alias("readability_flesch"))
    return drift.with_drift(baseline.with_z(d, DOC_FEATURES, DOC_W, ("id",)), DOC_FEATURES, S)


_Z = "CASE WHEN count({f}) OVER w = {n} THEN CASE WHEN min({f}) OVER w = max({f}) OVER w THEN 0::DOUBLE ELSE ({f} - avg({f}) OVER w) / stddev_pop({f}) OVER w END END"
_EV = f"""
WITH ev AS (SELECT user_id AS "user", ts AS date, event_id AS id, value FROM events),
ez AS (SELECT *, {_Z.format(f="value", n=W)} AS z FROM ev WINDOW w AS (PARTITION BY "user" ORDER BY date, id ROWS BETWEEN {W} PRECEDING AND 1 PRECEDING)),
ed AS (SELECT *, CASE WHEN z IS NULL THEN 0::DOUBLE ELSE round(least(abs(z), 10::DOUBLE), 4) END AS drift_score, CAST(coalesce(abs(z) >= 2.5, false) AS INTEGER) AS n_flagged FROM ez),
ur AS (SELECT "user", avg(drift_score) AS avg_drift_score, max(drift_score) AS max_drift_score, count(*) AS n_messages, count(*) FILTER (n_flagged > 0) AS n_flagged_messages,
       round(count(*) FILTER (n_flagged > 0)::DOUBLE / count(*), 4) AS flagged_message_rate FROM ed GROUP BY "user")
"""

_NUM = " + ".join(f"CASE WHEN z_{f} IS NOT NULL THEN {S.weights.get(f, 1.0)}::DOUBLE * least(abs(z_{f}), 10::DOUBLE) ELSE 0 END" for f in DOC_FEATURES)
_DEN = " + ".join(f"CASE WHEN z_{f} IS NOT NULL THEN {S.weights.get(f, 1.0)}::DOUBLE ELSE 0 END" for f in DOC_FEATURES)
_DOC = rf"""
WITH d AS (SELECT source AS "user", doc_id AS id, text, regexp_extract_all(lower(text), '[a-z'']+') AS tk FROM documents),
f AS (SELECT "user", id,
  {DIVERSITY} AS lexical_diversity, {FUNCTION_RATIO} AS function_word_ratio, {WORD_LENGTH} AS avg_word_length, {CAPS} AS caps_ratio,
  CASE WHEN len(tk) > 0 THEN round(206.835::DOUBLE - 1.015::DOUBLE * (len(tk)::DOUBLE / greatest(len(regexp_extract_all(text, '[.!?]+')), 1))
    - 84.6::DOUBLE * (list_sum(list_transform(tk, lambda t: greatest(len(regexp_extract_all(t, '[aeiouy]+')), 1)))::DOUBLE / len(tk)), 2) ELSE 0 END AS readability_flesch FROM d),
z AS (SELECT *, {", ".join(_Z.format(f=f, n=DOC_W) + f" AS z_{f}" for f in DOC_FEATURES)} FROM f WINDOW w AS (PARTITION BY "user" ORDER BY id ROWS BETWEEN {DOC_W} PRECEDING AND 1 PRECEDING)),
dd AS (SELECT *, CASE WHEN {_DEN} > 0 THEN round(({_NUM}) / ({_DEN}), 4) ELSE 0 END AS drift_score,
  list_filter([{", ".join(f"CASE WHEN abs(z_{f}) >= 2.5 THEN '{f}' END" for f in DOC_FEATURES)}], lambda x: x IS NOT NULL) AS flagged FROM z)
"""


@Q.add(f"""SELECT event_id AS id, round(avg(value) OVER w, 6) AS rolling_mean, round(stddev_pop(value) OVER w, 6) AS rolling_std, count(value) OVER w AS rolling_n
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW)""")
def rolling_stats(spark: SparkSession, sf: str) -> DataFrame:
    return baseline.rolling_stats(events(spark, sf), "value", W).select("id", T.rounded(F.col("rolling_mean"), 6).alias("rolling_mean"), T.rounded(F.col("rolling_std"), 6).alias("rolling_std"), "rolling_n")


@Q.add(_EV + 'SELECT id, "user", round(z, 6) AS z FROM ez WHERE z IS NOT NULL')
def baseline_z(spark: SparkSession, sf: str) -> DataFrame:
    return baseline.with_z(events(spark, sf), ("value",), W).filter("z_value is not null").select("id", "user", T.rounded(F.col("z_value"), 6).alias("z"))


@Q.add(f"""WITH r AS (SELECT user_id AS "user", value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events)
SELECT "user", count(*) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std FROM r WHERE nth <= {W} GROUP BY "user\"""")
def baseline_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return baseline.snapshot(events(spark, sf), "value", W)


@Q.add(_DOC + "SELECT id, \"user\", drift_score FROM dd")
def drift_score(spark: SparkSession, sf: str) -> DataFrame:
    return scored_documents(spark, sf).select("id", "user", "drift_score")


@Q.add(_DOC + "SELECT id, array_to_string(flagged, ',') AS flagged_features, CAST(len(flagged) AS BIGINT) AS n_flagged FROM dd")
def flagged_features(spark: SparkSession, sf: str) -> DataFrame:
    return scored_documents(spark, sf).select("id", F.array_join("flagged_features", ",").alias("flagged_features"), F.col("n_flagged").cast("long").alias("n_flagged"))


@Q.add(_EV + 'SELECT "user", round(avg_drift_score, 6) AS avg_drift_score, max_drift_score, n_messages, n_flagged_messages, flagged_message_rate FROM ur')
def user_risk(spark: SparkSession, sf: str) -> DataFrame:
    return risk_of_events(spark, sf).select("user", T.rounded(F.col("avg_drift_score"), 6).alias("avg_drift_score"), "max_drift_score", "n_messages", "n_flagged_messages", "flagged_message_rate")


@Q.add(_DOC + """SELECT "user", round(avg(drift_score), 6) AS avg_drift_score, count(*) FILTER (len(flagged) > 0) AS n_flagged_messages,
  array_to_string(list_sort(list_distinct(flatten(list(flagged)))), ',') AS features FROM dd GROUP BY "user\"""")
def user_risk_features(spark: SparkSession, sf: str) -> DataFrame:
    """The rollup with the features that were flagged."""
    r = drift.user_risk(scored_documents(spark, sf))
    return r.select("user", T.rounded(F.col("avg_drift_score"), 6).alias("avg_drift_score"), "n_flagged_messages", F.array_join("features", ",").alias("features"))


@Q.add(_EV + 'SELECT "user", round(avg_drift_score, 6) AS avg_drift_score FROM ur ORDER BY ur.avg_drift_score DESC, "user" LIMIT 10')
def topk_users(spark: SparkSession, sf: str) -> DataFrame:
    return drift.top_users(risk_of_events(spark, sf), 10).select("user", T.rounded(F.col("avg_drift_score"), 6).alias("avg_drift_score"))


@Q.add(_EV + 'SELECT arg_max("user", avg_drift_score) AS "user", round(max(avg_drift_score), 6) AS avg_drift_score FROM ur')
def argmax_user(spark: SparkSession, sf: str) -> DataFrame:
    return risk_of_events(spark, sf).agg(F.max_by("user", "avg_drift_score").alias("user"), T.rounded(F.max("avg_drift_score"), 6).alias("avg_drift_score"))


@Q.add(_EV + 'SELECT id, "user", drift_score FROM ed ORDER BY drift_score DESC, "user", id LIMIT 10')
def flagged_top_rows(spark: SparkSession, sf: str) -> DataFrame:
    return drift.flagged_rows(scored_events(spark, sf)).select("id", "user", "drift_score")


@Q.add(_EV + """, r AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY date DESC, id DESC) AS nth FROM ed) SELECT id, "user", drift_score FROM r WHERE nth <= 15""")
def recent_messages(spark: SparkSession, sf: str) -> DataFrame:
    return serve.recent_messages(scored_events(spark, sf)).select("id", "user", "drift_score")


@Q.add(_DOC + 'SELECT drift_score, CAST(len(flagged) AS INTEGER) AS n_flagged, readability_flesch, lexical_diversity FROM dd')
def column_allowlist(spark: SparkSession, sf: str) -> DataFrame:
    return serve.allow_listed(scored_documents(spark, sf)).drop("flagged_features")


@Q.add(_EV + """SELECT "user", 'CEF:0|Tidemark|DriftEngine|1.0|LINGUISTIC_DRIFT|Insider-risk linguistic drift flagged|' || CAST(greatest(0, least(10, CAST(round_even(avg_drift_score * 2, 0) AS INTEGER))) AS VARCHAR)
  || '|suser=' || CAST("user" AS VARCHAR) || ' cs1Label=avgDriftScore cs1=' || printf('%.4f', avg_drift_score) || ' cs2Label=flaggedMessageRate cs2=' || printf('%.4f', flagged_message_rate) || ' cnt=' || CAST(n_messages AS VARCHAR) AS line FROM ur""")
def cef_lines(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.cef_lines(risk_of_events(spark, sf))


# --- networks ----------------------------------------------------------------------------------------------------

_NET = f"""
WITH l AS (SELECT l_orderkey, list(l_suppkey ORDER BY l_linenumber, l_suppkey) AS x FROM lineitem GROUP BY l_orderkey),
m AS (SELECT o_custkey AS "user", o_orderdate AS date, o_orderkey AS id, coalesce(x, []) AS r FROM orders LEFT JOIN l ON o_orderkey = l_orderkey),
k AS (SELECT *, coalesce(sum(CAST(len(r) > 0 AS INTEGER)) OVER (PARTITION BY "user" ORDER BY date, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS kp FROM m),
h AS (SELECT *, coalesce(flatten(list(r) OVER (PARTITION BY "user" ORDER BY kp RANGE BETWEEN {NET_W} PRECEDING AND 1 PRECEDING))[-{NET_W}:], []) AS h FROM k),
e AS (SELECT "user", date, id, unnest(r) AS contact, unnest(range(0, len(r))) AS place FROM m)
"""


@Q.add(_NET + """SELECT id, "user", CAST(len(list_distinct(h)) AS DOUBLE) AS contact_degree,
  CASE WHEN len(h) > 0 THEN round(list_sum(list_transform(list_distinct(h), lambda x: pow(len(list_filter(h, lambda y: y = x))::DOUBLE / len(h), 2))), 6) ELSE 0 END AS interaction_concentration FROM h""")
def network_window(spark: SparkSession, sf: str) -> DataFrame:
    n = network.with_network(purchases(spark, sf), NET_W)
    return n.select("id", "user", "contact_degree", T.rounded(F.col("interaction_concentration"), 6).alias("interaction_concentration"))


@Q.add('SELECT o_custkey AS "user", count(DISTINCT l_suppkey) AS contacts, count(*) AS entries FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey')
def lifetime_degree(spark: SparkSession, sf: str) -> DataFrame:
    return network.lifetime_degree(purchases(spark, sf))


@Q.add('SELECT o_custkey AS "user", l_suppkey AS contact, count(*) AS entries FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, l_suppkey')
def lifetime_contacts(spark: SparkSession, sf: str) -> DataFrame:
    return network.lifetime(purchases(spark, sf))


@Q.add(_NET + f"""
, n AS (SELECT "user", contact, row_number() OVER (PARTITION BY "user" ORDER BY date DESC, id DESC, place DESC) AS nth FROM e),
c AS (SELECT "user", contact, count(*) AS entries FROM n WHERE nth <= {NET_W} GROUP BY "user", contact),
p AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY entries DESC, contact) AS place FROM c)
SELECT "user", contact, entries, place FROM p WHERE place <= 5""")
def top_contacts(spark: SparkSession, sf: str) -> DataFrame:
    return network.top_contacts(purchases(spark, sf), NET_W).withColumn("place", F.col("place").cast("long"))


# --- trends and policy -------------------------------------------------------------------------------------------


@Q.add(_EV + """
, x AS (SELECT "user", drift_score AS y, row_number() OVER (PARTITION BY "user" ORDER BY date, id) - 1 AS x, count(*) OVER (PARTITION BY "user") AS n FROM ed),
s AS (SELECT "user", count(*) AS n_points, regr_slope(y, x) AS whole, min(y) AS whole_lo, max(y) AS whole_hi, arg_min(y, x) AS whole_y0, regr_slope(y, x) FILTER (x < n // 2) AS early, min(y) FILTER (x < n // 2) AS early_lo, max(y) FILTER (x < n // 2) AS early_hi, arg_min(y, x) FILTER (x < n // 2) AS early_y0, regr_slope(y, x) FILTER (x >= n // 2) AS late, min(y) FILTER (x >= n // 2) AS late_lo, max(y) FILTER (x >= n // 2) AS late_hi, arg_min(y, x) FILTER (x >= n // 2) AS late_y0 FROM x GROUP BY "user"),
f AS (SELECT *, n_points < 5 OR (whole_hi - whole_y0 <= 1e-8 + 1e-5 * abs(whole_y0) AND whole_y0 - whole_lo <= 1e-8 + 1e-5 * abs(whole_y0)) AS flat, CASE WHEN (early_hi - early_y0 <= 1e-8 + 1e-5 * abs(early_y0) AND early_y0 - early_lo <= 1e-8 + 1e-5 * abs(early_y0)) THEN 0 ELSE coalesce(early, 0) END AS first, CASE WHEN (late_hi - late_y0 <= 1e-8 + 1e-5 * abs(late_y0) AND late_y0 - late_lo <= 1e-8 + 1e-5 * abs(late_y0)) THEN 0 ELSE coalesce(late, 0) END AS last FROM s),
g AS (SELECT "user", n_points, CASE WHEN flat THEN 0 ELSE coalesce(whole, 0) END AS slope, CASE WHEN flat THEN 0 ELSE last - first END AS rise FROM f)
SELECT "user", round(slope, 5) AS trend_slope, round(rise, 5) AS acceleration, slope >= 0.02 AND rise > 0 AS accelerating, n_points FROM g""")
def trajectory(spark: SparkSession, sf: str) -> DataFrame:
    return trend.trajectory(scored_events(spark, sf), S)


_COHORT = _EV + """
, c AS (SELECT avg(avg_drift_score) AS m, stddev_samp(avg_drift_score) AS s FROM ur),
z AS (SELECT "user", n_flagged_messages, round((avg_drift_score - m) / CASE WHEN s > 0 THEN s ELSE 1e-9 END, 4) AS cohort_z_score FROM ur, c)
SELECT "user", cohort_z_score, cohort_z_score >= {gate} AS escalation_recommended, {shift} AND n_flagged_messages > 0 AND NOT cohort_z_score >= {gate} AS suppressed_correlated_event FROM z"""
_SUPPRESSED = ("user", "cohort_z_score", "escalation_recommended", "suppressed_correlated_event")


@Q.add(_COHORT.format(gate=1.5, shift="false"))
def cohort_suppression(spark: SparkSession, sf: str) -> DataFrame:
    return policy.suppress(risk_of_events(spark, sf), False, S).select(*_SUPPRESSED)


@Q.add(_COHORT.format(gate=2.25, shift="true"))
def cohort_suppression_shift(spark: SparkSession, sf: str) -> DataFrame:
    return policy.suppress(risk_of_events(spark, sf), True, S).select(*_SUPPRESSED)


_FLAGS = "SELECT user_id AS \"user\", event_type FROM (SELECT user_id, event_type FROM events ORDER BY event_id DESC LIMIT 100)"


@Q.add(f"SELECT \"user\", count(*) FILTER (event_type = 'error') AS repeat_flags FROM ({_FLAGS}) GROUP BY \"user\"")
def prior_flag_counts(spark: SparkSession, sf: str) -> DataFrame:
    return policy.prior_flags(_log_of_events(spark, sf))


def _log_of_events(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "drift_flagged").otherwise(F.col("event_type"))
    return table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("user_pseudonym"), kind.alias("event_type"))


@Q.add(_EV + f""", p AS (SELECT "user", count(*) FILTER (event_type = 'error') AS repeat_flags FROM ({_FLAGS}) GROUP BY "user")
SELECT ur."user", coalesce(repeat_flags, 0) AS repeat_flags, CASE WHEN avg_drift_score >= 3 OR flagged_message_rate > 0.15 OR coalesce(repeat_flags, 0) >= 3 THEN 'escalate_for_manual_review'
  WHEN avg_drift_score >= 2.5 THEN 'continue_monitoring' ELSE 'no_action_needed' END AS recommendation FROM ur LEFT JOIN p ON ur."user" = p."user\"""")
def rule_recommendation(spark: SparkSession, sf: str) -> DataFrame:
    found = policy.recommend(risk_of_events(spark, sf), policy.prior_flags(_log_of_events(spark, sf)), S)
    return found.select("user", "repeat_flags", "recommendation")


# --- monitoring and fairness -------------------------------------------------------------------------------------


@Q.add(_EV + """SELECT round(avg(avg_drift_score), 6) AS mean_avg_drift, round(avg(CAST(n_flagged_messages > 0 AS DOUBLE)), 6) AS share_users_flagged, round(quantile_cont(avg_drift_score, 0.9), 6) AS p90_avg_drift FROM ur""")
def monitor_summary(spark: SparkSession, sf: str) -> DataFrame:
    r = monitor.risk_summary(risk_of_events(spark, sf))
    return r.select(*[T.rounded(F.col(c), 6).alias(c) for c in r.columns])


_STATS = ("lexical_diversity", "readability_flesch", "drift_score")


@Q.add(_DOC + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(avg({f}), 6) AS mean, round(stddev_samp({f}), 6) AS std FROM dd" for f in _STATS))
def monitor_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    s = monitor.feature_stats(scored_documents(spark, sf), _STATS)
    return s.select("feature", T.rounded(F.col("mean"), 6).alias("mean"), T.rounded(F.col("std"), 6).alias("std"))


@Q.add(_EV + """
, s AS (SELECT date_trunc('week', date) AS week, unnest(['value', 'drift_score']) AS feature, unnest([avg(value), avg(drift_score)]) AS mean, unnest([stddev_samp(value), stddev_samp(drift_score)]) AS std FROM ed GROUP BY 1),
l AS (SELECT *, lag(mean) OVER (PARTITION BY feature ORDER BY week) AS before FROM s)
SELECT feature, strftime(week, '%Y-%m-%d') AS week, round(abs(mean - before) / CASE WHEN std IS NOT NULL THEN greatest(std, 1e-9) END, 6) AS shift, coalesce(abs(mean - before) / CASE WHEN std IS NOT NULL THEN greatest(std, 1e-9) END >= 2, false) AS alert
FROM l WHERE before IS NOT NULL AND (std IS NULL OR std <> 0)""")
def org_shift(spark: SparkSession, sf: str) -> DataFrame:
    weekly = scored_events(spark, sf).withColumn("week", F.date_trunc("week", "date"))
    s = monitor.shifts(monitor.feature_stats(weekly, ("value", "drift_score"), ("week",)), "week", S)
    return s.select("feature", F.date_format("week", "yyyy-MM-dd").alias("week"), T.rounded(F.col("shift"), 6).alias("shift"), "alert")


@Q.add("""
WITH e AS (SELECT list_distinct(quantile_cont(n_chars::DOUBLE, [0, 0.25, 0.5, 0.75, 1])) AS edges FROM documents)
SELECT doc_id, CAST(greatest(1, len(list_filter(edges, lambda x: x < n_chars))) AS INTEGER) AS bin FROM documents, e""")
def qcut_bins(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "documents").select("doc_id", F.lit("n_chars").alias("proxy"), F.col("n_chars").cast("double").alias("value"))
    return fairness.quartile_bins(v).select("doc_id", "bin")


_BIAS = _DOC + """
, v AS (SELECT drift_score, len(flagged) AS n_flagged, unnest(['avg_word_length', 'lexical_diversity', 'readability_flesch']) AS proxy, unnest([avg_word_length, lexical_diversity, readability_flesch]) AS value FROM dd),
e AS (SELECT proxy, list_distinct(quantile_cont(value, [0, 0.25, 0.5, 0.75, 1])) AS edges, count(*) AS n FROM v WHERE value <> 0 GROUP BY proxy),
b AS (SELECT v.proxy, greatest(1, len(list_filter(edges, lambda x: x < value))) AS bin, drift_score, n_flagged FROM v JOIN e ON v.proxy = e.proxy WHERE value <> 0 AND n >= 20 AND len(edges) > 2),
r AS (SELECT proxy, bin, count(*) AS n, avg(drift_score) AS mean_drift, avg(CAST(n_flagged > 0 AS DOUBLE)) AS flag_rate FROM b GROUP BY proxy, bin)
"""


@Q.add(_BIAS + "SELECT proxy, CAST(bin AS INTEGER) AS bin, n, round(mean_drift, 6) AS mean_drift, round(flag_rate, 6) AS flag_rate FROM r")
def bias_bins(spark: SparkSession, sf: str) -> DataFrame:
    b = fairness.bias_bins(scored_documents(spark, sf), settings=S)
    return b.select("proxy", "bin", "n", T.rounded(F.col("mean_drift"), 6).alias("mean_drift"), T.rounded(F.col("flag_rate"), 6).alias("flag_rate"))


@Q.add(_BIAS + """, a AS (SELECT proxy, count(*) AS bins, max(flag_rate) AS hi, min(flag_rate) AS lo FROM r GROUP BY proxy)
SELECT proxy, bins, CASE WHEN lo > 0 THEN round(hi / lo, 3) END AS disparity_ratio, coalesce(CASE WHEN lo > 0 THEN round(hi / lo, 3) END >= 1.5, false) AS flagged FROM a""")
def bias_audit(spark: SparkSession, sf: str) -> DataFrame:
    return fairness.bias_audit(scored_documents(spark, sf), settings=S).select("proxy", "bins", "disparity_ratio", "flagged")


# --- audit -------------------------------------------------------------------------------------------------------


@Q.add("""
WITH RECURSIVE c AS (
  SELECT n_nationkey::BIGINT AS seq, n_name, n_regionkey, repeat('0', 64) AS prev_hash,
         sha256('actor=system' || chr(10) || 'details={}' || chr(10) || 'event_type=' || n_name || chr(10) || 'prev_hash=' || repeat('0', 64) || chr(10) || 'seq=0' || chr(10) || 'timestamp=t' || chr(10) || 'user_pseudonym=emp_' || n_regionkey) AS entry_hash
  FROM nation WHERE n_nationkey = 0
  UNION ALL
  SELECT n.n_nationkey::BIGINT, n.n_name, n.n_regionkey, c.entry_hash,
         sha256('actor=system' || chr(10) || 'details={}' || chr(10) || 'event_type=' || n.n_name || chr(10) || 'prev_hash=' || c.entry_hash || chr(10) || 'seq=' || n.n_nationkey || chr(10) || 'timestamp=t' || chr(10) || 'user_pseudonym=emp_' || n.n_regionkey)
  FROM nation n JOIN c ON n.n_nationkey = c.seq + 1
), t AS (SELECT seq, prev_hash, entry_hash, CASE WHEN seq = 7 THEN '{"changed":1}' ELSE '{}' END AS details, n_name, n_regionkey FROM c WHERE seq <> 15
), l AS (SELECT *, lag(entry_hash, 1, repeat('0', 64)) OVER (ORDER BY seq) AS before,
         sha256('actor=system' || chr(10) || 'details=' || details || chr(10) || 'event_type=' || n_name || chr(10) || 'prev_hash=' || prev_hash || chr(10) || 'seq=' || seq || chr(10) || 'timestamp=t' || chr(10) || 'user_pseudonym=emp_' || n_regionkey) AS computed FROM t)
SELECT seq, entry_hash, computed = entry_hash AS hash_ok, prev_hash = before AS link_ok FROM l
""")
def audit_chain_verify(spark: SparkSession, sf: str) -> DataFrame:
    """A chain over the 25 nations with one changed entry and one that is missing."""
    rows, last = [], audit.START
    for r in table(spark, sf, "nation").orderBy("n_nationkey").collect():  # a dimension of 25 rows
        e = {"seq": r["n_nationkey"], "timestamp": "t", "event_type": r["n_name"], "user_pseudonym": f"emp_{r['n_regionkey']}", "actor": "system", "details": "{}", "prev_hash": last}
        e["entry_hash"] = last = audit.entry_hash(e)
        rows.append(e)
    rows[7]["details"] = '{"changed":1}'
    names = ("seq", "timestamp", "event_type", "user_pseudonym", "actor", "details", "prev_hash", "entry_hash")
    log = spark.createDataFrame([tuple(e[n] for n in names) for e in rows if e["seq"] != 15], "seq long, timestamp string, event_type string, user_pseudonym string, actor string, details string, prev_hash string, entry_hash string")
    return audit.links(log)


_ENTRY = "sha256('actor=system' || chr(10) || 'details=' || {details} || chr(10) || 'event_type=' || event_type || chr(10) || 'prev_hash=' || {prev} || chr(10) || 'seq=' || seq || chr(10) || 'timestamp=' || date || chr(10) || 'user_pseudonym=emp_' || user_id)"


@Q.add(f"""
WITH e AS (SELECT event_id + 1 AS seq, event_type, user_id, strftime(ts, '%Y-%m-%d') AS date, CAST(value AS VARCHAR) AS value FROM events),
o AS (SELECT seq + 1 AS of, {_ENTRY.format(details="'{}'", prev="repeat('0', 64)")} AS own FROM e WHERE seq % 2 = 1),
l AS (SELECT e.*, coalesce(own, repeat('0', 64)) AS prev_hash, CASE WHEN seq % 97 = 0 THEN '{{"changed":1}}' ELSE '{{}}' END AS details FROM e LEFT JOIN o ON seq = of),
h AS (SELECT *, {_ENTRY.format(details="'{}'", prev="prev_hash")} AS entry_hash, {_ENTRY.format(details="details", prev="prev_hash")} AS computed FROM l)
SELECT seq, entry_hash, computed = entry_hash AS hash_ok, prev_hash = lag(entry_hash, 1, repeat('0', 64)) OVER (ORDER BY seq) AS link_ok FROM h
""")
def audit_links(spark: SparkSession, sf: str) -> DataFrame:
    """All events as a log in which every other entry begins a chain anew, so that links are broken there, and some entries were changed."""
    e = table(spark, sf, "events")
    rows = e.select((F.col("event_id") + 1).alias("seq"), F.date_format("ts", "yyyy-MM-dd").alias("timestamp"), "event_type", F.concat(F.lit("emp_"), F.col("user_id").cast("string")).alias("user_pseudonym"), F.lit("system").alias("actor"), F.lit("{}").alias("details"))
    first = rows.filter(F.col("seq") % 2 == 1).withColumn("prev_hash", F.lit(audit.START)).withColumn("entry_hash", audit.hash_of())
    before = first.select((F.col("seq") + 1).alias("of"), F.col("entry_hash").alias("prev_hash"))
    second = rows.filter(F.col("seq") % 2 == 0).join(before, F.col("seq") == F.col("of"), "left").drop("of")
    second = second.withColumn("prev_hash", F.coalesce("prev_hash", F.lit(audit.START))).withColumn("entry_hash", audit.hash_of())
    log = first.unionByName(second).withColumn("details", F.when(F.col("seq") % 97 == 0, F.lit('{"changed":1}')).otherwise(F.col("details")))
    return audit.links(log)


@Q.add("""SELECT 'audit_log' AS source, 'Audit log entry at ' || strftime(ts, '%Y-%m-%d') || ': event ''' || event_type || ''' recorded by actor ''system'' for ' || CASE WHEN user_id % 5 = 0 THEN 'no user (system-level event)' ELSE 'emp_' || user_id END
  || '. Details: ' || CASE WHEN event_id % 3 = 0 THEN 'none' ELSE 'score=' || event_id || ', why=test' END || '.' AS text FROM events""")
def audit_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Audit entries as passages for retrieval."""
    e = table(spark, sf, "events")
    details = F.when(F.col("event_id") % 3 == 0, "{}").otherwise(F.format_string('{"score":%d,"why":"test"}', "event_id"))
    user = F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("emp_"), F.col("user_id").cast("string")))
    log = e.select(F.date_format("ts", "yyyy-MM-dd").alias("timestamp"), "event_type", F.lit("system").alias("actor"), user.alias("user_pseudonym"), details.alias("details"))
    return retrieval.audit_sentences(log)
