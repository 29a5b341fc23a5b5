"""Queries of clusters, anomalies, supervised models, evaluation, retrieval, streams and the whole pipeline."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import NEGATIVE_WORDS, POSITIVE_WORDS, Settings
from tidemark.functions import text as T
from tidemark.operators import anomaly, baseline, drift, retrieval, shapley, supervised
from tidemark.plans import drift_queries as D
from tidemark.plans import pipeline
from tidemark.plans.registry import Register
from tidemark.plans.text_queries import DIVERSITY, FLESCH, FUNCTION_RATIO, KIND, PROSE, PROSE_LEXICON, _list, _score_sql, _share_sql, share_sql
from tidemark.sources import files, messages
from tidemark.sources.adapters import documents, events, mails, purchases, table, texts
from tidemark.sources.files import checkpointed, stored
from tidemark.streaming.baseline import stream_baseline as stream_of
from tidemark.streaming.baseline import stream_contacts
from tidemark.streaming.bounded import bounded_baseline, last_values

Q = Register()
S = Settings()

_POINTS = D._EV + """
, m AS (SELECT avg(avg_drift_score) m1, stddev_pop(avg_drift_score) s1, avg(max_drift_score) m2, stddev_pop(max_drift_score) s2, avg(flagged_message_rate) m3, stddev_pop(flagged_message_rate) s3 FROM ur),
pt AS (SELECT "user" AS u, coalesce((avg_drift_score - m1) / nullif(s1, 0), 0) AS x, coalesce((max_drift_score - m2) / nullif(s2, 0), 0) AS y, coalesce((flagged_message_rate - m3) / nullif(s3, 0), 0) AS z FROM ur, m),
nb AS (SELECT a.u AS a, b.u AS b FROM pt a JOIN pt b ON sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) <= 0.8),
core AS (SELECT b AS u FROM nb GROUP BY b HAVING count(*) >= 3)
"""


def _users(spark: SparkSession, sf: str) -> DataFrame:
    return D.risk_of_events(spark, sf).select("user", "avg_drift_score", "max_drift_score", "flagged_message_rate")


@Q.add(_POINTS + "SELECT u AS \"user\", NOT EXISTS (SELECT 1 FROM nb JOIN core ON nb.b = core.u WHERE nb.a = pt.u) AS is_noise FROM pt")
def dbscan_noise(spark: SparkSession, sf: str) -> DataFrame:
    return anomaly.dbscan_noise(_users(spark, sf), settings=S).select("user", "is_noise")


@Q.add(_POINTS.replace("WITH ev", "WITH RECURSIVE ev") + """
, ce AS (SELECT a, b FROM nb WHERE a IN (SELECT u FROM core) AND b IN (SELECT u FROM core)),
reach AS (SELECT u AS a, u AS b FROM core UNION SELECT r.a, ce.b FROM reach r JOIN ce ON r.b = ce.a),
lb AS (SELECT a AS u, min(b) AS root FROM reach GROUP BY a),
pr AS (SELECT pt.u, (SELECT min(lb.root) FROM nb JOIN lb ON nb.b = lb.u WHERE nb.a = pt.u) AS root FROM pt),
num AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT root FROM lb))
SELECT pr.u AS "user", CAST(coalesce(cluster, -1) AS INTEGER) AS cluster, cluster IS NULL AS is_outlier_cluster FROM pr LEFT JOIN num ON pr.root = num.root""")
def dbscan_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return anomaly.dbscan(_users(spark, sf), settings=S).select("user", F.col("cluster").cast("int").alias("cluster"), "is_outlier_cluster")


@Q.add("""
WITH r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS nth, count(*) OVER (PARTITION BY toxic) AS n FROM labels)
SELECT doc_id AS "user", CAST(toxic AS INTEGER) AS label, nth <= floor(n * 0.25) AS is_test FROM r""")
def strat_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").select(F.col("doc_id").alias("user"), F.col("toxic").cast("int").alias("label"))
    return supervised.stratified_split(rows).select("user", "label", "is_test")


_SCORED = "WITH s AS (SELECT toxic AS label, (n_chars % 100) / 100.0::DOUBLE AS p FROM documents JOIN labels USING (doc_id))"


def _scored_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    p = (F.col("n_chars") % 100) / F.lit(100.0)
    return rows.select(F.col("toxic").alias("label"), p.alias("probability"), (p >= 0.5).cast("int").alias("predicted"))


@Q.add(_SCORED + """, c AS (SELECT count(*) FILTER (label = 1 AND p >= 0.5) AS tp, count(*) FILTER (label <> 1 AND p >= 0.5) AS fp, count(*) FILTER (label = 1 AND p < 0.5) AS fn, count(*) FILTER (label <> 1 AND p < 0.5) AS tn FROM s)
SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn)::DOUBLE / (tp + fp + fn + tn) ELSE 0 END AS accuracy FROM c""")
def confusion_prf(spark: SparkSession, sf: str) -> DataFrame:
    return supervised.confusion(_scored_labels(spark, sf))


@Q.add(_SCORED + """, g AS (SELECT p, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM s GROUP BY p),
b AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT sum(pos * (below + neg / 2.0::DOUBLE)) / nullif(sum(pos) * sum(neg), 0)::DOUBLE AS auc, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM b""")
def auc_rank(spark: SparkSession, sf: str) -> DataFrame:
    return supervised.roc_auc(_scored_labels(spark, sf))


_TERMS = r"""SELECT * FROM (SELECT {key} AS k, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM {table}) WHERE NOT list_contains({stop}, term)"""


@Q.add(f"""
WITH t AS ({_TERMS.format(key="doc_id", table="documents", stop=_list(retrieval.STOP_WORDS))}),
tf AS (SELECT k, term, count(*)::DOUBLE AS tf FROM t GROUP BY k, term), n AS (SELECT count(*) AS n FROM documents),
i AS (SELECT term, ln((1.0::DOUBLE + max(n)) / (1.0::DOUBLE + count(*))) + 1.0::DOUBLE AS idf FROM tf, n GROUP BY term),
w AS (SELECT k, tf.term, tf * idf AS w FROM tf JOIN i ON tf.term = i.term), nw AS (SELECT k, sqrt(sum(w * w)) AS norm FROM w GROUP BY k),
qt AS ({_TERMS.format(key="item_id", table="benchmark", stop=_list(retrieval.STOP_WORDS))}), qf AS (SELECT k AS q, term, count(*)::DOUBLE AS tf FROM qt GROUP BY k, term),
qw AS (SELECT q, qf.term, tf * idf AS w FROM qf JOIN i ON qf.term = i.term), qn AS (SELECT q, sqrt(sum(w * w)) AS norm FROM qw GROUP BY q),
s AS (SELECT qw.q, w.k, sum(qw.w / qn.norm * w.w / nw.norm) AS score FROM qw JOIN w ON qw.term = w.term JOIN qn ON qw.q = qn.q JOIN nw ON w.k = nw.k GROUP BY qw.q, w.k),
p AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, k) AS place FROM s WHERE score > 0)
SELECT q AS question_id, k AS chunk_id, CAST(place AS INTEGER) AS place, round(score, 6) AS score FROM p WHERE place <= 4""")
def tfidf_topk(spark: SparkSession, sf: str) -> DataFrame:
    corpus = texts(spark, sf, "doc_id", "text").withColumnRenamed("doc_id", "chunk_id")
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    return retrieval.tfidf_top(corpus, asked, stop=retrieval.STOP_WORDS).select("question_id", "chunk_id", "place", F.round("score", 6).alias("score"))


@Q.add()
def isolation_forest(spark: SparkSession, sf: str) -> DataFrame:
    """Odd documents by all ten features of a message."""
    d = documents(spark, sf).withColumn("tk", T.tokens(F.col("content")))
    found = T.feature_columns(F.col("content"), F.col("tk"))
    rows = stored(d.select("id", *[found[f].alias(f) for f in anomaly.MESSAGE_FEATURES]))
    return anomaly.isolation_forest(rows, settings=S).select("id", "anomaly_score", "is_anomaly")


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Users with a label that depends on their events."""
    risk = D.risk_of_events(spark, sf).select("user", *supervised.FEATURES)
    spread = events(spark, sf).groupBy("user").agg((F.stddev_pop("value") > 50).cast("int").alias("is_malicious_insider"))
    return supervised.training_rows(risk, spread.withColumn("is_malicious_insider", F.coalesce("is_malicious_insider", F.lit(0)) * (F.col("user") % 2).cast("int")))


def _fitted(spark: SparkSession, sf: str, kind: str) -> tuple:
    rows = checkpointed(supervised.stratified_split(_labelled(spark, sf)))
    return supervised.fit(rows.filter(~F.col("is_test")), kind, settings=S), rows


@Q.add()
def random_forest(spark: SparkSession, sf: str) -> DataFrame:
    model, rows = _fitted(spark, sf, "forest")
    return supervised.predict(model, rows).select("user", "label", "is_test", "probability", "predicted")


@Q.add()
def gradient_boosting(spark: SparkSession, sf: str) -> DataFrame:
    model, rows = _fitted(spark, sf, "boosting")
    return supervised.predict(model, rows).select("user", "label", "is_test", "probability", "predicted")


@Q.add()
def attribution(spark: SparkSession, sf: str) -> DataFrame:
    model, rows = _fitted(spark, sf, "forest")
    return supervised.attribution(model, rows, settings=S)


@Q.add()
def shapley_values(spark: SparkSession, sf: str) -> DataFrame:
    """What moves each user's probability, feature by feature, in the forest of random_forest."""
    model, rows = _fitted(spark, sf, "forest")
    return shapley.shapley_values(model, rows).select("user", "phi_base", "phi_sum", *[f"phi_{f}" for f in supervised.FEATURES])


@Q.add()
def shapley_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Features by their mean absolute Shapley value, in the trees of gradient_boosting."""
    model, rows = _fitted(spark, sf, "boosting")
    return shapley.ranked(shapley.shapley_values(model, rows))


@Q.add(D._EV + "SELECT id, \"user\", round(z, 6) AS z, drift_score FROM ed WHERE z IS NOT NULL")
def stream_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream, to its end: the same rows as the batch form."""
    name = f"stream_{uuid.uuid4().hex}"
    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    shape = spark.readStream.schema(schema).parquet(path if files.is_folder(spark, path) else sf + "/[e]vents.parquet")
    rows = shape.select(F.col("user_id").alias("user"), F.col("ts").cast("timestamp").alias("date"), F.col("event_id").alias("id"), "value")
    out = f"{files.shared_folder(spark)}/{name}"
    run = stream_of(rows, D.W, S).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("id", "user", F.round("z_value", 6).alias("z"), "drift_score")


@Q.add(D._EV + "SELECT id, \"user\", round(z, 6) AS z, drift_score FROM ed WHERE z IS NOT NULL")
def stream_after_batch(spark: SparkSession, sf: str) -> DataFrame:
    """The first half of the events' time as a batch, the second as a stream that begins with the batch's last windows: the same rows as one batch of all."""
    rows = events(spark, sf).withColumn("date", F.col("date").cast("timestamp"))
    middle = rows.agg(F.timestamp_seconds(((F.min("date").cast("double") + F.max("date").cast("double")) / 2).cast("long")).alias("at")).first()["at"]
    first = rows.filter(F.col("date") < F.lit(middle))
    early = drift.with_drift(baseline.with_z(first, ("value",), D.W), ("value",), S).filter("z_value is not null").select("id", "user", "z_value", "drift_score")
    start = last_values(first, D.W)
    out = f"{files.shared_folder(spark)}/after_{uuid.uuid4().hex}"
    rows.filter(F.col("date") >= F.lit(middle)).write.parquet(f"{out}/second")
    live = spark.readStream.schema(spark.read.parquet(f"{out}/second").schema).parquet(f"{out}/second")
    late = bounded_baseline(live, D.W, S, capacity=1_000_000, shards=int(spark.conf.get("spark.sql.shuffle.partitions")), start=start)
    late.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    both = early.unionByName(spark.read.parquet(f"{out}/rows").select("id", "user", "z_value", "drift_score"))
    return both.select("id", "user", F.round("z_value", 6).alias("z"), "drift_score")


@Q.add(D.Q.oracles["network_window"])
def stream_network(spark: SparkSession, sf: str) -> DataFrame:
    """The orders as a stream of messages, to its end: the same rows as network_window."""
    out = f"{files.shared_folder(spark)}/network_{uuid.uuid4().hex}"
    purchases(spark, sf).write.parquet(f"{out}/orders")
    live = spark.readStream.schema(spark.read.parquet(f"{out}/orders").schema).parquet(f"{out}/orders")
    stream_contacts(live, D.NET_W).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("id", "user", "contact_degree", F.round("interaction_concentration", 6).alias("interaction_concentration"))


@Q.add()
def message_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """The whole batch pipeline over the documents as messages: user risk with trend, cluster and policy."""
    risk = pipeline.run(messages.prepare(mails(spark, sf)), None, S).risk
    return risk.select("user", F.round("avg_drift_score", 6).alias("avg_drift_score"), "n_messages", "n_flagged_messages", "trend_slope", "cluster", "cohort_z_score", "escalation_recommended")


#: Phrases that the tables have, so that every feature moves.
_SPOKEN = Settings(urgency=PROSE, lexicon=PROSE_LEXICON)
_TERMS_OF = {
    "urgency_score": _score_sql(PROSE),
    "social_engineering_score": "round((" + " + ".join(_score_sql(p) for p in PROSE_LEXICON.values()) + f") / {len(PROSE_LEXICON)}, 4)",
    "sentiment_polarity": share_sql(f"({_share_sql(POSITIVE_WORDS)} - {_share_sql(NEGATIVE_WORDS)})", f"({_share_sql(POSITIVE_WORDS)} + {_share_sql(NEGATIVE_WORDS)})"),
    "sentiment_subjectivity": share_sql(f"({_share_sql(POSITIVE_WORDS)} + {_share_sql(NEGATIVE_WORDS)})", "len(tk)"),
    "function_word_ratio": FUNCTION_RATIO,
    "lexical_diversity": DIVERSITY,
    "readability_flesch": FLESCH,
    "noun_ratio": share_sql("len(list_filter(kinds, lambda x: x = 'noun'))", "len(kinds)"),
    "verb_ratio": share_sql("len(list_filter(kinds, lambda x: x = 'verb'))", "len(kinds)"),
    "contact_degree": "CAST(len(list_distinct(h)) AS DOUBLE)",
    "interaction_concentration": "CASE WHEN len(h) > 0 THEN list_sum(list_transform(list_distinct(h), lambda x: pow(len(list_filter(h, lambda y: y = x))::DOUBLE / len(h), 2))) ELSE 0::DOUBLE END",
}
_OVER = " + ".join(f"CASE WHEN z_{f} IS NOT NULL THEN {S.weights[f]}::DOUBLE * least(abs(z_{f}), 10::DOUBLE) ELSE 0 END" for f in pipeline.TRACKED)
_UNDER = " + ".join(f"CASE WHEN z_{f} IS NOT NULL THEN {S.weights[f]}::DOUBLE ELSE 0 END" for f in pipeline.TRACKED)


@Q.add(f"""
WITH d AS (SELECT source AS "user", doc_id AS id, text, lower(text) AS low, lang || '@example.org' AS contact, regexp_extract_all(lower(text), '[a-z'']+') AS tk FROM documents),
c AS (SELECT *, list_transform(tk, lambda t: {KIND}) AS kinds,
  list_filter(coalesce(list(contact) OVER (PARTITION BY "user" ORDER BY id ROWS BETWEEN {S.window} PRECEDING AND 1 PRECEDING), []), lambda x: x IS NOT NULL) AS h FROM d WHERE "user" IS NOT NULL AND text IS NOT NULL AND trim(text) <> ''),
f AS (SELECT "user", id, {", ".join(f"{sql} AS {name}" for name, sql in _TERMS_OF.items())} FROM c),
z AS (SELECT *, {", ".join(D._Z.format(f=f, n=S.window) + f" AS z_{f}" for f in pipeline.TRACKED)} FROM f WINDOW w AS (PARTITION BY "user" ORDER BY id ROWS BETWEEN {S.window} PRECEDING AND 1 PRECEDING))
SELECT id, CASE WHEN {_UNDER} > 0 THEN round(({_OVER}) / ({_UNDER}), 4) ELSE 0 END AS drift_score,
  CAST({" + ".join(f"CAST(coalesce(abs(z_{f}) >= 2.5, false) AS INTEGER)" for f in pipeline.TRACKED)} AS BIGINT) AS n_flagged FROM z""")
def message_drift(spark: SparkSession, sf: str) -> DataFrame:
    """The drift of every document as a message, by all eleven features with their weights."""
    scored = pipeline.score(messages.prepare(mails(spark, sf)), None, _SPOKEN)
    return scored.select("id", "drift_score", F.col("n_flagged").cast("long").alias("n_flagged"))
