"""Queries of sources, privacy, text features and exploration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import FUNCTION_WORDS, MANIPULATION_LEXICON, NEGATIVE_WORDS, POSITIVE_WORDS, URGENCY_PHRASES, Settings
from tidemark.functions import tagging
from tidemark.functions import text as T
from tidemark.functions.hashing import pads, pseudonym
from tidemark.operators import privacy, profile
from tidemark.plans.registry import Register
from tidemark.sources import messages, synthetic
from tidemark.sources.adapters import consent, events, table, texts

Q = Register()

#: Phrases that the driver's prose has; the default lexicon's do not occur in it.
PROSE = ("of the", "in the", "and the", "to the", "the in")
PROSE_LEXICON = {"places": ("in the", "at the", "on the"), "links": ("and the", "of the"), "absent": ("wire transfer", "gift card")}


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def share_sql(part: str, whole: str, digits: int = 4) -> str:
    """The SQL of functions.text.share."""
    scale = 10**digits
    return f"CASE WHEN {whole} > 0 THEN sign({part}) * ((2 * {scale} * abs({part}) + {whole})::BIGINT // (2 * {whole})::BIGINT)::DOUBLE / {scale} ELSE 0 END"


def _score_sql(phrases: tuple[str, ...], low: str = "low") -> str:
    hits = f"len(list_filter({_list(phrases)}, lambda p: contains({low}, p)))"
    return f"least({share_sql(f'({hits} * 5)', str(len(phrases)))}, 1.0::DOUBLE)"


DIVERSITY = share_sql("len(list_distinct(tk))", "len(tk)")
WORD_LENGTH = share_sql("coalesce(list_sum(list_transform(tk, lambda t: length(t))), 0)", "len(tk)", 2)
CAPS = share_sql(r"(length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')))", "length(text)")
FUNCTION_RATIO = share_sql(f"len(list_filter(tk, lambda t: list_contains({_list(FUNCTION_WORDS)}, t)))", "len(tk)")
_TOKENS = """WITH d AS (SELECT doc_id, source, text, lower(text) AS low, regexp_extract_all(lower(text), '[a-z'']+') AS tk FROM documents)
"""


@Q.add("SELECT event_id AS id, user_id AS \"user\", value FROM events ORDER BY md5(CAST(event_id AS VARCHAR)), event_id LIMIT 500")
def sample_hash_topk(spark: SparkSession, sf: str) -> DataFrame:
    return messages.sample(events(spark, sf), 500).select("id", "user", "value")


@Q.add("""
WITH r AS (SELECT event_id AS id, user_id, CASE WHEN event_id % 7 = 0 THEN 'no date' ELSE strftime(ts, '%m/%d/%Y %H:%M:%S') END AS date,
                  CASE WHEN event_id % 11 = 0 THEN ' ' WHEN event_id % 13 = 0 THEN NULL ELSE props END AS content FROM events)
SELECT id, CAST(user_id AS VARCHAR) AS "user", strftime(try_strptime(date, '%m/%d/%Y %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS date, content, 'send' AS activity
FROM r WHERE try_strptime(date, '%m/%d/%Y %H:%M:%S') IS NOT NULL AND trim(content) <> ''
""")
def ingest_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Renamed, backfilled, leniently parsed and filtered rows."""
    e = table(spark, sf, "events")
    raw = e.select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_id") % 7 == 0, "no date").otherwise(F.date_format("ts", messages.DATE_FORMAT)).alias("date"),
        F.col("user_id").cast("string").alias("user_code"),
        F.lit("").alias("to_addr"),
        F.lit("").alias("from_addr"),
        F.lit(0).alias("size"),
        F.lit(0).alias("attachments"),
        F.when(F.col("event_id") % 11 == 0, " ").when(F.col("event_id") % 13 == 0, None).otherwise(F.col("props")).alias("content"),
    )
    return messages.prepare(raw).select("id", "user", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), "content", "activity")


@Q.add("SELECT count(*) AS n_rows, count(*) FILTER (value IS NULL) AS null_content, count(DISTINCT user_id) AS n_users, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_date, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_date FROM events")
def validate_profile(spark: SparkSession, sf: str) -> DataFrame:
    out = profile.validation_profile(events(spark, sf), "value")
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_date", "last_date")})


@Q.add("SELECT event_id AS id, user_id AS \"user\", value FROM events WHERE user_id % 10 <> 0")
def consent_gate(spark: SparkSession, sf: str) -> DataFrame:
    return privacy.consent_gate(events(spark, sf), consent(spark, sf).filter("consented")).select("id", "user", "value")


@Q.add('SELECT DISTINCT user_id AS "user", user_id % 10 <> 0 AND user_id <> 7 AS consented FROM events')
def consent_revoke(spark: SparkSession, sf: str) -> DataFrame:
    return privacy.revoke(consent(spark, sf), 7)


_INNER, _OUTER = pads("dev-salt-change-me")


@Q.add(f"""
SELECT c_custkey, 'emp_' || substr(sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(c_name)))), 1, 12) AS pseudonym FROM customer
""")
def pseudonymize_hmac(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", pseudonym(F.col("c_name"), "dev-salt-change-me").alias("pseudonym"))


@Q.add("SELECT source, count(*) AS n, CAST(sum(coalesce(toxic, 0)) AS BIGINT) AS positives FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def label_left_join(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source")
    rows = docs.join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.coalesce("toxic", F.lit(0))).alias("positives"))


@Q.add(_TOKENS + f"""SELECT doc_id, CAST(len(tk) AS BIGINT) AS n_tokens, {DIVERSITY} AS lexical_diversity, {WORD_LENGTH} AS avg_word_length FROM d""")
def tokens_diversity(spark: SparkSession, sf: str) -> DataFrame:
    d = texts(spark, sf, "doc_id", "text").select("doc_id", T.tokens(F.col("text")).alias("tk"))
    tk = F.col("tk")
    return d.select("doc_id", F.size(tk).cast("long").alias("n_tokens"), T.lexical_diversity(tk).alias("lexical_diversity"), T.avg_word_length(tk).alias("avg_word_length"))


@Q.add(f"""SELECT doc_id, CAST(length(text) AS BIGINT) AS message_length, {CAPS} AS caps_ratio, {share_sql("((length(text) - length(replace(text, '!', ''))) * 100)", "length(text)")} AS exclamation_ratio FROM documents""")
def surface_features(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("text")
    return texts(spark, sf, "doc_id", "text").select("doc_id", F.length(c).cast("long").alias("message_length"), T.caps_ratio(c).alias("caps_ratio"), T.exclamation_ratio(c).alias("exclamation_ratio"))


@Q.add(f"WITH d AS (SELECT doc_id, lower(text) AS low FROM documents) SELECT doc_id, {_score_sql(PROSE)} AS prose_score, {_score_sql(URGENCY_PHRASES)} AS urgency_score FROM d")
def phrase_score(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("text")
    return texts(spark, sf, "doc_id", "text").select("doc_id", T.phrase_score(c, PROSE).alias("prose_score"), T.phrase_score(c).alias("urgency_score"))


@Q.add(f"""WITH d AS (SELECT doc_id, lower(text) AS low FROM documents), p AS (SELECT doc_id, low, unnest({_list(PROSE)}) AS phrase FROM d),
s AS (SELECT doc_id, low, phrase, unnest(range(1, length(low) - length(phrase) + 2)) AS i FROM p WHERE contains(low, phrase))
SELECT doc_id, phrase, CAST(i + length(phrase) - 2 AS BIGINT) AS end_index FROM s WHERE substr(low, i, length(phrase)) = phrase""")
def phrase_scan(spark: SparkSession, sf: str) -> DataFrame:
    d = texts(spark, sf, "doc_id", "text").select("doc_id", F.explode(T.phrase_scan(F.col("text"), PROSE)).alias("x"))
    return d.select("doc_id", "x.phrase", F.col("x.end_index").cast("long").alias("end_index"))


_SCANNED = " UNION ALL ".join(f"SELECT '{name}' AS category, unnest({_list(phrases)}) AS phrase" for name, phrases in {**PROSE_LEXICON, **MANIPULATION_LEXICON}.items())


@Q.add(f"""WITH l AS ({_SCANNED}), p AS (SELECT doc_id, lower(text) AS low, category, phrase FROM documents, l WHERE contains(lower(text), phrase)),
s AS (SELECT *, unnest(range(1, length(low) - length(phrase) + 2)) AS i FROM p)
SELECT doc_id, category, phrase, CAST(i + length(phrase) - 2 AS BIGINT) AS end_index FROM s WHERE substr(low, i, length(phrase)) = phrase""")
def category_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Every match of every category's phrases, found by one scan of a text for all of them."""
    d = texts(spark, sf, "doc_id", "text").select("doc_id", F.explode(T.category_scan(F.col("text"), {**PROSE_LEXICON, **MANIPULATION_LEXICON})).alias("category", "found"))
    return d.select("doc_id", "category", F.explode("found").alias("x")).select("doc_id", "category", "x.phrase", F.col("x.end_index").cast("long").alias("end_index"))


_CATS = {**PROSE_LEXICON, **MANIPULATION_LEXICON}


@Q.add("WITH d AS (SELECT doc_id, lower(text) AS low FROM documents), s AS (SELECT doc_id, " + ", ".join(f"{_score_sql(p)} AS {n}" for n, p in _CATS.items()) + " FROM d) SELECT *, round((" + " + ".join(PROSE_LEXICON) + f") / {len(PROSE_LEXICON)}, 4) AS prose_mean, round((" + " + ".join(MANIPULATION_LEXICON) + f") / {len(MANIPULATION_LEXICON)}, 4) AS social_engineering_score FROM s")
def category_scores(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("text")
    scores = {**T.category_scores(c, PROSE_LEXICON), **T.category_scores(c)}
    return texts(spark, sf, "doc_id", "text").select("doc_id", *[x.alias(n) for n, x in scores.items()], T.manipulation_score(c, PROSE_LEXICON).alias("prose_mean"), T.manipulation_score(c).alias("social_engineering_score"))


FLESCH = r"""CASE WHEN len(tk) > 0 THEN round(206.835::DOUBLE - 1.015::DOUBLE * (len(tk)::DOUBLE / greatest(len(regexp_extract_all(text, '[.!?]+')), 1))
  - 84.6::DOUBLE * (list_sum(list_transform(tk, lambda t: greatest(len(regexp_extract_all(t, '[aeiouy]+')), 1)))::DOUBLE / len(tk)), 2) ELSE 0 END"""


@Q.add(_TOKENS + f"SELECT doc_id, {FLESCH} AS readability_flesch FROM d")
def flesch_regex(spark: SparkSession, sf: str) -> DataFrame:
    d = texts(spark, sf, "doc_id", "text").select("doc_id", "text", T.tokens(F.col("text")).alias("tk"))
    return d.select("doc_id", T.readability_flesch(F.col("text"), F.col("tk")).alias("readability_flesch"))


@Q.add(_TOKENS + f"SELECT doc_id, {FUNCTION_RATIO} AS function_word_ratio FROM d")
def function_words(spark: SparkSession, sf: str) -> DataFrame:
    d = texts(spark, sf, "doc_id", "text").select("doc_id", T.tokens(F.col("text")).alias("tk"))
    return d.select("doc_id", T.function_word_ratio(F.col("tk")).alias("function_word_ratio"))


def _ratio_sql(char: str) -> str:
    return share_sql(f"(length(text) - length(replace(text, '{char}', '')))", "length(text)")


@Q.add(f"SELECT doc_id, {_ratio_sql(',')} AS comma_ratio, {_ratio_sql('.')} AS period_ratio, {_ratio_sql('?')} AS question_ratio, CAST(len(regexp_extract_all(text, '\\.\\.\\.')) AS BIGINT) AS ellipsis_count FROM documents")
def punctuation(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("text")
    return texts(spark, sf, "doc_id", "text").select("doc_id", *[T.char_ratio(c, x).alias(f"{n}_ratio") for n, x in (("comma", ","), ("period", "."), ("question", "?"))], T.ellipsis_count(c).cast("long").alias("ellipsis_count"))


def _share_sql(words: tuple[str, ...]) -> str:
    return f"len(list_filter(tk, lambda t: list_contains({_list(words)}, t)))"


@Q.add(_TOKENS + f""", s AS (SELECT doc_id, {_share_sql(POSITIVE_WORDS)} AS g, {_share_sql(NEGATIVE_WORDS)} AS b, len(tk) AS n FROM d)
SELECT doc_id, {share_sql("(g - b)", "(g + b)")} AS sentiment_polarity, {share_sql("(g + b)", "n")} AS sentiment_subjectivity FROM s""")
def sentiment(spark: SparkSession, sf: str) -> DataFrame:
    d = texts(spark, sf, "doc_id", "text").select("doc_id", T.tokens(F.col("text")).alias("tk"))
    polarity, subjectivity = T.sentiment(F.col("tk"))
    return d.select("doc_id", polarity.alias("sentiment_polarity"), subjectivity.alias("sentiment_subjectivity"))


KIND = "CASE " + " ".join(f"WHEN regexp_matches(t, '{e}') THEN '{k}'" for k, e in T.POS_ENDINGS.items()) + " ELSE 'other' END"


@Q.add(_TOKENS + f", s AS (SELECT doc_id, list_transform(tk, lambda t: {KIND}) AS k FROM d) SELECT doc_id, " + ", ".join(share_sql(f"len(list_filter(k, lambda x: x = '{p}'))", "len(k)") + f" AS {p}_ratio" for p in ("noun", "verb", "adj", "adv")) + " FROM s")
def pos_ratios(spark: SparkSession, sf: str) -> DataFrame:
    d = texts(spark, sf, "doc_id", "text").select("doc_id", T.tokens(F.col("text")).alias("tk"))
    return d.select("doc_id", *[x.alias(n) for n, x in T.pos_ratios(F.col("tk")).items()])


@Q.add("""
WITH m AS (SELECT c_custkey AS id, c_name || '@a.org; ' || CAST(c_nationkey AS VARCHAR) || '@b.org,' AS "to", CASE WHEN c_custkey % 3 = 0 THEN ' ; ' ELSE c_mktsegment || '@c.org' END AS cc, CAST(NULL AS VARCHAR) AS bcc FROM customer),
r AS (SELECT id, list_filter(list_transform(regexp_split_to_array(concat_ws(';', "to", cc, bcc), '[;,]'), lambda x: trim(x)), lambda x: x <> '') AS r FROM m)
SELECT id, CAST(len(r) AS BIGINT) AS n, array_to_string(r, '|') AS recipients FROM r
""")
def recipient_parse(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.concat("c_name", F.lit("@a.org; "), F.col("c_nationkey").cast("string"), F.lit("@b.org,")).alias("to"),
        F.when(F.col("c_custkey") % 3 == 0, " ; ").otherwise(F.concat("c_mktsegment", F.lit("@c.org"))).alias("cc"),
        F.lit(None).cast("string").alias("bcc"),
    )
    r = m.select("id", T.recipients(F.col("to"), F.col("cc"), F.col("bcc")).alias("r"))
    return r.select("id", F.size("r").cast("long").alias("n"), F.array_join("r", "|").alias("recipients"))


@Q.add("""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(html, '<h[1-3][^>]*>', chr(10) || '# ', 'g'), '<[^>]*>', '', 'g') AS t FROM pages),
s AS (SELECT page_id, string_split(regexp_replace(t, chr(10) || '(#{1,3} )', chr(1) || '\\1', 'g'), chr(1)) AS x FROM p),
c AS (SELECT page_id, unnest(range(0, len(x))) AS chunk_no, unnest(x) AS chunk FROM s)
SELECT page_id AS source, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(length(trim(chunk)) AS BIGINT) AS n_chars, md5(trim(chunk)) AS chunk_md5 FROM c WHERE length(trim(chunk)) >= 40
""".replace("\\\\1", "\\1"))
def markdown_chunks(spark: SparkSession, sf: str) -> DataFrame:
    text = F.regexp_replace(F.regexp_replace("html", "<h[1-3][^>]*>", "\n# "), "<[^>]*>", "")
    c = messages.markdown_chunks(table(spark, sf, "pages").select(F.col("page_id").alias("source"), text.alias("text")))
    return c.select("source", F.col("chunk_no").cast("long").alias("chunk_no"), F.length("chunk").cast("long").alias("n_chars"), F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@Q.add("WITH m AS (SELECT min(n_chars)::DOUBLE AS lo, max(n_chars)::DOUBLE AS hi FROM documents) SELECT CAST(least(floor((n_chars - lo) / ((hi - lo) / 25)), 24) AS INTEGER) AS bin, count(*) AS n FROM documents, m GROUP BY 1")
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    return profile.histogram(table(spark, sf, "documents"), F.col("n_chars"), 25)


@Q.add("SELECT unnest(['doc_id', 'quality', 'toxic']) AS column_name, unnest([count(*) FILTER (l.doc_id IS NULL), count(*) FILTER (quality IS NULL), count(*) FILTER (toxic IS NULL)]) AS nulls FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def null_profile(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels")
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("_id")).join(labels, F.col("_id") == F.col("doc_id"), "left")
    return profile.null_profile(rows.select("doc_id", "quality", "toxic"))


@Q.add("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return profile.value_counts(table(spark, sf, "events"), "event_type")


@Q.add("SELECT count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, max(value) AS max FROM events")
def describe(spark: SparkSession, sf: str) -> DataFrame:
    out = profile.describe(events(spark, sf), "value")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "q25", "q50", "q75")})


@Q.add("""
WITH c AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM c),
u AS (SELECT DISTINCT user_id FROM c)
SELECT u.user_id AS "user", strftime(r.day, '%Y-%m-%d') AS day, coalesce(n, 0) AS n FROM u CROSS JOIN r LEFT JOIN c ON r.day = c.day AND u.user_id = c.user_id
""")
def daily_volume_zero_filled(spark: SparkSession, sf: str) -> DataFrame:
    """Of every user, who has days without events."""
    out = profile.daily_volume(events(spark, sf), by=("user",))
    return out.select("user", F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


@Q.add("""
WITH c AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1), r AS (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM c)
SELECT strftime(r.day, '%Y-%m-%d') AS day, coalesce(n, 0) AS n FROM r LEFT JOIN c ON r.day = c.day
""")
def daily_volume(spark: SparkSession, sf: str) -> DataFrame:
    """Of all events."""
    return profile.daily_volume(events(spark, sf)).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


def _roll(name: str, sides: int | str, of: str = "n || '/' || k") -> str:
    """The SQL of sources.synthetic.dice."""
    return f"(('0x' || substr(md5('{Settings().seed}/{name}/' || {of}), 1, 12))::BIGINT % {sides})"


def _pick(values: tuple[str, ...], name: str) -> str:
    return f"{_list(values)}[{_roll(name, len(values))} + 1]"


@Q.add(f"""
WITH u AS (SELECT n, 60 + {_roll("total", 81, "n")} AS total FROM range(60) t(n)),
r AS (SELECT n, total, unnest(range(total)) AS k FROM u),
m AS (SELECT *, printf('user%03d', n + 1) AS name, n >= 57 AND k > total * 0.66 AND {_roll("risk", 100)} < 35 AS late FROM r)
SELECT printf('m%05d-%05d', n, k) AS id, strftime(to_timestamp(1262304000 + k * 14400 + {_roll("t", 7200)}) AT TIME ZONE 'UTC', '%m/%d/%Y %H:%M:%S') AS date, name AS "user", printf('PC-%04d', n) AS pc,
  printf('user%03d@example.org', {_roll("to", 60)} + 1) AS "to", '' AS cc, '' AS bcc, name || '@example.org' AS "from", 'send' AS activity, CAST({_roll("size", 50000)} + 500 AS VARCHAR) AS size, '0' AS attachments,
  replace(CASE WHEN late THEN {_pick(synthetic.RISKY, "risky")} ELSE {_pick(synthetic.CALM, "calm")} END, '{{doc}}', {_pick(synthetic.THINGS, "doc")}) AS content
FROM m""")
def synthetic_messages(spark: SparkSession, sf: str) -> DataFrame:
    return synthetic.messages(spark, seed=Settings().seed)


REMARKS = ("this is good", "not good, and never a very nice win", "really bad", "I don't think that it is bad", "somewhat happy but so sad", "nothing went wrong", "")
_SAID = f"{_list(REMARKS)}[doc_id % {len(REMARKS)} + 1]"
_BEFORE = "list_contains({words}, CASE WHEN i > {k} THEN tk[i - {k}] ELSE '' END)"
_VALUE = (
    "CASE WHEN " + _BEFORE.format(words=_list(tagging.INTENSIFIERS), k=1) + " THEN 3 WHEN " + _BEFORE.format(words=_list(tagging.DAMPERS), k=1) + " THEN 1 ELSE 2 END"
    + f" * CASE WHEN list_contains({_list(POSITIVE_WORDS)}, tk[i]) THEN 1 ELSE -1 END * CASE WHEN "
    + " OR ".join(_BEFORE.format(words=_list(tagging.NEGATORS), k=k) for k in (1, 2, 3)) + " THEN -1 ELSE 1 END"
)


@Q.add(f"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text || ' ' || {_SAID}), '[a-z'']+') AS tk FROM documents),
v AS (SELECT doc_id, tk, list_transform(list_filter(range(1, len(tk) + 1), lambda i: list_contains({_list(POSITIVE_WORDS + NEGATIVE_WORDS)}, tk[i])), lambda i: {_VALUE}) AS x FROM d),
s AS (SELECT doc_id, len(tk) AS n, len(x) AS polar, coalesce(list_sum(x), 0)::BIGINT AS total, coalesce(list_sum(list_transform(x, lambda y: abs(y))), 0)::BIGINT AS whole FROM v)
SELECT doc_id, {share_sql("total", "whole")} AS polarity, {share_sql("polar", "n")} AS subjectivity FROM s""")
def sentiment_context(spark: SparkSession, sf: str) -> DataFrame:
    """Sentiment with negation and intensity. The documents' prose has hardly a polar word, so each is followed by a remark that depends on its id."""
    d = texts(spark, sf, "doc_id", "text").withColumn("said", F.element_at(F.array(*[F.lit(x) for x in REMARKS]), (F.pmod("doc_id", F.lit(len(REMARKS))) + 1).cast("int")))
    d = d.select("doc_id", T.tokens(F.concat_ws(" ", "text", "said")).alias("tk"))
    polarity, subjectivity = tagging.sentiment_in_context(F.col("tk"))
    return d.select("doc_id", polarity.alias("polarity"), subjectivity.alias("subjectivity"))


@Q.add()
def pos_viterbi(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of parts of speech by the decoder."""
    d = texts(spark, sf, "doc_id", "text").select("doc_id", T.tokens(F.col("text")).alias("tk"))
    return d.select("doc_id", *[c.alias(n) for n, c in tagging.viterbi_ratios(F.col("tk")).items()])
