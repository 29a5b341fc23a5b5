"""Mixing sources to target weights by Pareto order sampling [native].

Every source gets a target of words by its weight, at most `most` times what it has; the excess is shared out again
by weight among the others. A source's rate f = target / size gives each of its documents floor(f) certain whole copies.
What is left of the target is filled by one more copy of some documents, drawn with unequal inclusion probabilities:
p = min(1, c * bits) for a document whose size has so many binary digits, so that longer documents, of which a mix loses more
by leaving them out, are likelier; c is such that the words expected are those that are left. Documents with p = 1 are certain.
Each of the others has the Pareto rank [u / (1 - u)] / [p / (1 - p)], random odds over inclusion odds, and those of the lowest
ranks are drawn as long as they stay below what is left; a sample is fixed in words, not in documents. The rest that no
whole document in turn fits is filled by the one open document whose size is nearest to it.

u depends on id, source, text and the number of the row among those that agree in these, so rows with null ids and
repeated rows are drawn one by one. Ranks are cut into as many buckets as the square root of a source's rows, and only sums
per bucket are accumulated over a source, so that even a source with a third of all rows is never ordered in one task.

Defined results: null text has no words; a null source is a source of its own, the last; a document without
words is copied like any other and takes 0 words; which of several equal rows get a copy more is the same in all reruns as far as
they can be told apart; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import FEW, counted, cut, fresh, looked_up, mark, names_free, numbered, root_of, stored, table, uniform_of

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
SEED = "mix-2"


def word_count(text: Column) -> Column:
    # By a split, which is as fast as a count of matches.
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(words)).cast("long")


def text_key(text: Column) -> Column:
    return F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def sizes_of(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    names_free(docs, id_col, text_col, source_col)
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), text_key(F.col(text_col)).alias("key"))


def targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Per source: size, rows and target. A table of the sources alone, which one task may order."""
    by_name = Window.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1))
    # Sources in the order in which they meet their limit; a source is limited if those before it and it leave more a weight.
    by_limit = every.orderBy("limit_at", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    s = s.withColumn("nth", F.row_number().over(by_name) - 1).withColumn("weight", weight)
    s = s.withColumn("limit_at", F.col("source_size") * F.lit(float(most)) / F.col("weight"))
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(every)).withColumn("weights", F.sum("weight").over(every))
    s = s.withColumn("held", F.coalesce(F.sum(F.col("source_size") * F.lit(float(most))).over(before), F.lit(0.0)))
    s = s.withColumn("gone", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("share", (F.col("total") - F.col("held")) / (F.col("weights") - F.col("gone")))
    s = s.withColumn("limited", F.col("share") > F.col("limit_at"))
    s = s.withColumn("level", F.max(F.when(~F.col("limited"), F.col("share"))).over(every))
    return s.select("source", "source_size", "source_rows", F.when(F.col("limited"), F.col("source_size") * F.lit(float(most))).otherwise(F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight")).alias("target"))


def probabilities(rows: DataFrame, per: DataFrame) -> DataFrame:
    """Per source and number of binary digits of a size: the source's columns, the probability p of one copy more, and the words `wanted`
    of the documents with p < 1. Some 40 rows a source."""
    c = rows.groupBy("source", "bits").agg(F.sum("size").alias("words"))
    c = looked_up(c, per, ["source"], F.col("bits"))
    # Classes in the order in which they meet p = 1; a class is certain if those before it and it leave so much.
    by_limit = Window.partitionBy("source").orderBy(F.col("bits").desc())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("source")
    weight = F.col("words") * F.col("bits")
    c = c.withColumn("weights", F.sum(weight).over(every)).withColumn("held", F.coalesce(F.sum("words").over(before), F.lit(0)))
    c = c.withColumn("rest", F.col("weights") - F.coalesce(F.sum(weight).over(before), F.lit(0)))
    c = c.withColumn("share", F.when(F.col("rest") > 0, (F.col("left") - F.col("held")) / F.col("rest")).otherwise(F.lit(0.0)))
    c = c.withColumn("certain", F.col("share") * F.col("bits") >= 1)
    c = c.withColumn("level", F.greatest(F.max(F.when(~F.col("certain"), F.col("share"))).over(every), F.lit(0.0)))
    c = c.withColumn("wanted", F.col("left") - F.coalesce(F.sum(F.when(F.col("certain"), F.col("words"))).over(every), F.lit(0)))
    p = F.when(F.col("certain"), F.lit(1.0)).otherwise(F.coalesce("level", F.lit(0.0)) * F.col("bits"))
    return c.select("source", "bits", "source_size", "source_rows", "target", "sure", "wanted", p.alias("p"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: str = SEED, few: int = FEW) -> DataFrame:
    """Per row: id, source, key, size, source_size, target, p, copies."""
    rows = cut(sizes_of(docs, id_col, text_col, source_col))
    rows = numbered(rows, ["id", "source", "key"], "nth").withColumn("bits", F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(F.lit(0)))
    rows = rows.withColumn("mark", mark(seed, F.col("id"), F.col("source"), F.col("key"), F.col("nth"))).withColumn("u", uniform_of(F.col("mark")))
    per = targets(rows, weights, most).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0)))
    per = per.withColumn("sure", F.floor("rate"))
    per = cut(per.withColumn("left", F.greatest(F.col("target") - F.col("sure") * F.col("source_size"), F.lit(0.0))).drop("rate"))
    ranked = looked_up(rows, cut(probabilities(rows, per)), ["source", "bits"], F.col("mark"), few=few)
    drawn = (F.col("p") > 0) & (F.col("p") < 1)
    ranked = ranked.withColumn("rank", F.when(drawn, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))))
    # The bucket is that of the bounded rank: the ranks around 1, where a sample ends, are spread over many.
    ranked = cut(ranked.withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * root_of(F.col("source_rows")))))
    sums = ranked.filter("rank is not null").groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.max("wanted").alias("wanted"))
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # One bucket of each source holds the end of its sample; the rows of the other buckets need no order.
    ends = cut(sums.filter((F.col("before") < F.col("wanted")) & (F.col("before") + F.col("words") >= F.col("wanted"))).select("source", "bucket", "before"))
    cutting = looked_up(ranked, ends, ["source", "bucket"], F.col("mark"), few=few)
    order = Window.partitionBy("source").orderBy("rank", "mark").rowsBetween(Window.unboundedPreceding, -1)
    cutting = cutting.withColumn("so_far", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    # Words so far grow with the rank, so one document crosses the target; those before it are the sample.
    last = cutting.filter((F.col("so_far") < F.col("wanted")) & (F.col("so_far") + F.col("size") >= F.col("wanted")))
    end = cut(last.select("source", F.struct("rank", "mark").alias("end"), (F.col("wanted") - F.col("so_far")).alias("lacks")))
    out = looked_up(ranked, end, ["source"], F.col("mark"), "left", few)
    out = out.withColumn("here", F.struct("rank", "mark")).withColumn("open", F.col("rank").isNotNull() & F.col("end").isNotNull() & (F.col("here") >= F.col("end")))
    # What the sample still lacks is filled with the one open document that fits it best, the first in rank of equals.
    fit = F.abs(F.col("size") - F.col("lacks"))
    fill = out.filter(F.col("open") & (fit < F.col("lacks"))).groupBy("source").agg(F.min(F.struct(fit.alias("fit"), "rank", "mark")).alias("fill"))
    fill = cut(fill.select("source", F.col("fill.mark").alias("fill")))
    out = looked_up(out, fill, ["source"], F.col("mark"), "left", few)
    once = (F.col("p") >= 1) | (drawn & (F.col("wanted") > 0) & (~F.col("open") | F.coalesce(F.col("mark") == F.col("fill"), F.lit(False))))
    return out.select("id", "source", "key", "size", "source_size", "target", "p", (F.col("sure") + once.cast("long")).alias("copies"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents that the mix takes, a row for each copy, with all their columns. Rows equal in id, source and text share their copies."""
    of_id, of_key, of_source, copies, of_rows, nth, key = fresh(docs, "_of_id", "_of_key", "_of_source", "_copies", "_rows", "_nth", "_key")
    mix = mix_sources(docs, id_col, text_col, source_col)
    mix = mix.groupBy(F.col("id").alias(of_id), F.col("key").alias(of_key), F.col("source").alias(of_source)).agg(F.sum("copies").alias(copies), F.count("*").alias(of_rows)).filter(F.col(copies) > 0)
    mix = stored(mix)
    rows = docs.withColumn(key, text_key(F.col(text_col)))
    on = F.col(id_col).eqNullSafe(F.col(of_id)) & (F.col(key) == F.col(of_key)) & F.col(source_col).eqNullSafe(F.col(of_source))
    alone = rows.join(mix.filter(F.col(of_rows) == 1), on)
    several = counted(rows.join(mix.filter(F.col(of_rows) > 1), on), [of_id, of_key, of_source], nth)
    own = F.floor(F.col(copies) / F.col(of_rows)) + (F.col(nth) < F.col(copies) % F.col(of_rows)).cast("long")
    several = several.withColumn(copies, own).filter(F.col(copies) > 0)
    every = [*docs.columns, copies]
    return alone.select(*every).unionByName(several.select(*every)).withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mix_sources(table(spark, sf_dir, "documents"))
    return mix.select(F.col("id").alias("doc_id"), "size", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH k AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(text, '')) AS key FROM documents
), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, key) - 1 AS nth, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS bits FROM k
), v AS (SELECT *, md5(concat_ws('/', 'mix-2', coalesce(CAST(doc_id AS VARCHAR), '~'), coalesce(source, '~'), key, CAST(nth AS VARCHAR))) AS mark FROM n
), d AS (SELECT *, (('0x' || substr(mark, 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u FROM v
), s AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size,
         [5::DOUBLE, 2::DOUBLE, 1::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS weight
  FROM d GROUP BY source
), c AS (SELECT *, source_size * 3::DOUBLE / weight AS limit_at FROM s
), e AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
         coalesce(sum(source_size * 3::DOUBLE) OVER b, 0::DOUBLE) AS held, coalesce(sum(weight) OVER b, 0::DOUBLE) AS gone
  FROM c WINDOW b AS (ORDER BY limit_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (SELECT *, (total - held) / (weights - gone) AS share FROM e
), g AS (SELECT *, share > limit_at AS limited, max(CASE WHEN share <= limit_at THEN share END) OVER () AS level FROM f
), t AS (SELECT source, source_size, CASE WHEN limited THEN source_size * 3::DOUBLE ELSE coalesce(level, 0) * weight END AS target FROM g
), r AS (SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 1::DOUBLE END) AS sure FROM t
), o AS (SELECT *, greatest(target - sure * source_size, 0::DOUBLE) AS rest FROM r
), h AS (SELECT source, bits, sum(size)::BIGINT AS words FROM d GROUP BY source, bits
), i AS (
  SELECT h.*, o.rest AS wanted_all, coalesce(sum(words) OVER b, 0)::BIGINT AS held,
         (sum(words * bits) OVER (PARTITION BY h.source) - coalesce(sum(words * bits) OVER b, 0))::BIGINT AS weights
  FROM h JOIN o ON h.source IS NOT DISTINCT FROM o.source
  WINDOW b AS (PARTITION BY h.source ORDER BY bits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), j AS (SELECT *, CASE WHEN weights > 0 THEN (wanted_all - held) / weights::DOUBLE ELSE 0::DOUBLE END AS share FROM i
), l AS (
  SELECT *, share * bits >= 1 AS certain, greatest(max(CASE WHEN NOT share * bits >= 1 THEN share END) OVER (PARTITION BY source), 0::DOUBLE) AS level,
         wanted_all - coalesce(sum(CASE WHEN share * bits >= 1 THEN words END) OVER (PARTITION BY source), 0)::BIGINT AS wanted FROM j
), p AS (SELECT source, bits, wanted, CASE WHEN certain THEN 1::DOUBLE ELSE coalesce(level, 0) * bits END AS p FROM l
), x AS (
  SELECT d.doc_id, d.source, d.size, d.mark, o.source_size, o.target, o.sure, p.p, p.wanted, p.p > 0 AND p.p < 1 AS drawn,
         CASE WHEN p.p > 0 AND p.p < 1 THEN (d.u / (1 - d.u)) / (p.p / (1 - p.p)) END AS rank
  FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.bits = p.bits
), w AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source, drawn ORDER BY rank, mark ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS so_far FROM x
), y AS (
  SELECT *, drawn AND so_far + size >= wanted AS open, max(CASE WHEN drawn AND so_far < wanted AND so_far + size >= wanted THEN wanted - so_far END) OVER (PARTITION BY source) AS lacks FROM w
), z AS (
  SELECT *, open AND abs(size - lacks) < lacks AND row_number() OVER (PARTITION BY source, open ORDER BY abs(size - lacks), rank, mark) = 1 AS fills FROM y
)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(size * (sure + CASE WHEN p >= 1 OR drawn AND wanted > 0 AND (NOT open OR fills) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM z
"""
