"""Supervised models over user features, and their evaluation."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.operators.ranks import ahead, fresh, in_ranges, root_of, uniform
from tidemark.sources.files import Folder, checkpointed

FEATURES = ("avg_drift_score", "max_drift_score", "n_messages", "n_flagged_messages", "flagged_message_rate")
#: Rows that a task of a fit holds. Trees are grown in rounds of small jobs, so few tasks are best until the rows outgrow them.
ROWS_A_TASK = 50_000


def training_rows(risk: DataFrame, labels: DataFrame, label: str = "is_malicious_insider") -> DataFrame:
    return risk.join(labels.select("user", F.col(label).cast("int").alias("label")), "user").na.fill(0.0)


def stratified_split(df: DataFrame, key: str = "user", label: str = "label", test: float = 0.25) -> DataFrame:
    """is_test for the first rows of each label by a hash of the key: reruns agree. Labels are ranked in two steps."""
    mark, n, bucket, of, nth = fresh(df, "_mark", "_n", "_bucket", "_of", "_nth")
    rows = checkpointed(df.withColumn(mark, F.md5(F.col(key).cast("string"))))
    sizes = rows.groupBy(F.col(label).alias(of)).agg(F.count("*").alias(n))  # a row per label
    rows = rows.join(F.broadcast(sizes), F.col(label).eqNullSafe(F.col(of))).withColumn(bucket, F.floor(uniform(F.col(mark)) * root_of(F.col(n))))
    ranked = ahead(rows, [label], bucket, [mark, key], nth)
    return ranked.withColumn("is_test", F.col(nth) < F.floor(F.col(n) * test)).drop(mark, n, bucket, of, nth)


def weighted(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows of each label weigh as much as those of the other."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = df.agg(F.count("*").alias("_all"), F.count_distinct(label).alias("_k"))
    return df.join(F.broadcast(counts), label).join(F.broadcast(total)).withColumn("weight", F.col("_all") / (F.col("_k") * F.col("_n"))).drop("_n", "_all", "_k")  # two rows and one


def spread(df: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """The rows in as many partitions as their number asks for, whatever the cluster, each in a fixed order; as they are if one holds them all. What
    comes out of a shuffle is merged by bytes, and a few bytes a row would leave all rows to one task in every round."""
    n = df.count()
    if n <= ROWS_A_TASK:
        return df
    by = [c for c in ("user", *features, "label") if c in df.columns]
    return df.repartition(-(-n // ROWS_A_TASK), *by).sortWithinPartitions(*by)


def fit(df: DataFrame, kind: str = "forest", features: tuple[str, ...] = FEATURES, settings: Settings | None = None, rounds: int | None = None) -> PipelineModel:
    s = settings or Settings()
    if kind == "forest":
        model = RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=rounds or 200, maxDepth=6, seed=s.seed)
    elif kind == "boosting":
        model = GBTClassifier(labelCol="label", weightCol="weight", maxIter=rounds or 200, maxDepth=4, stepSize=0.1, seed=s.seed)
    else:
        raise ValueError(f"unknown model: {kind}")
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"), model]).fit(spread(weighted(df), features))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def predict_saved(path: str, df: DataFrame) -> DataFrame:
    """Probabilities by a model that was saved."""
    return predict(PipelineModel.load(path), df)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """probability of label 1, and the prediction at one half."""
    drop = [c for c in ("features", "rawPrediction", "prediction") if c not in df.columns]
    out = model.transform(df).withColumn("probability", vector_to_array("probability")[1]).drop(*drop)
    return out.withColumn("predicted", (F.col("probability") >= 0.5).cast("int"))


def confusion(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Counts, precision, recall, F1 and accuracy; divisions by zero give 0."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    out = df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    part = lambda a, b: F.when(b > 0, a.cast("double") / F.nullif(b, F.lit(0))).otherwise(F.lit(0.0))
    out = out.withColumns({"precision": part(F.col("tp"), F.col("tp") + F.col("fp")), "recall": part(F.col("tp"), F.col("tp") + F.col("fn"))})
    out = out.withColumn("f1", part(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
    return out.withColumn("accuracy", part(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")))


def roc_auc(df: DataFrame, label: str = "label", score: str = "probability", by: tuple[str, ...] = ()) -> DataFrame:
    """Area under the ROC curve by average ranks, of all rows or of each group, null with a single class. Rows are first summed per distinct score; scores
    are dealt out by ranges, so that none of the tasks orders them all."""
    per = in_ranges(df.groupBy(*by, score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")), *by, score)
    below = ahead(per, list(by), "_part", [score], "below", "n")
    sums = below.groupBy(*by).agg(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2.0)).alias("u"), F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"))
    return sums.select(*by, (F.col("u") / F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0))).alias("auc"), "n_pos", "n_neg")


def attribution(model: PipelineModel, df: DataFrame, features: tuple[str, ...] = FEATURES, settings: Settings | None = None) -> DataFrame:
    """Features ranked by the loss of AUC when their values are shuffled, with the model's own importances. All copies of the rows, one with each
    feature shuffled, are made, scored and ranked in one pass: rows take the values of the rows that have their number in another random order."""
    s, n = settings or Settings(), df.count()
    own = model.stages[-1].featureImportances.toArray()

    def placed(rows: DataFrame) -> DataFrame:
        order = F.md5(F.concat_ws("/", (F.lit(s.seed) + F.col("_k")).cast("string"), F.col("user").cast("string")))
        rows = rows.withColumn("_u", order)
        return ahead(rows.withColumn("_b", F.floor(uniform(F.col("_u")) * root_of(F.lit(n)))), ["_k"], "_b", ["_u", "user"], "_i").drop("_u", "_b")

    values = F.explode(F.array(*[F.struct(F.lit(k + 1).alias("_k"), F.col(f).cast("double").alias("_v")) for k, f in enumerate(features)])).alias("x")
    other = placed(df.select("user", values).select("user", "x.*")).select(F.col("_k").alias("_of"), F.col("_i").alias("_at"), "_v")
    copies = placed(df.withColumn("_k", F.lit(0))).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(len(features)))))
    both = copies.join(other, (F.col("_k") == F.col("_of")) & (F.col("_i") == F.col("_at")), "left")
    both = both.withColumns({f: F.when(F.col("_k") == k + 1, F.col("_v")).otherwise(F.col(f)) for k, f in enumerate(features)}).drop("_v", "_of", "_at", "_i")
    auc = {r["_k"]: r["auc"] or 0.0 for r in roc_auc(predict(model, both), by=("_k",)).collect()}  # a row a feature
    rows = [(f, round(float(auc.get(0, 0.0) - auc.get(k + 1, 0.0)), 5), round(float(own[k]), 5)) for k, f in enumerate(features)]
    return df.sparkSession.createDataFrame(sorted(rows, key=lambda r: (-r[1], -r[2], r[0])), "feature string, auc_drop double, importance double")


def write_metrics(folder: str, name: str, scored: DataFrame) -> dict:
    """JSON and Markdown of the evaluation, a few numbers."""
    found = {**confusion(scored).first().asDict(), **roc_auc(scored).first().asDict()}
    out = Folder(folder)
    out.write(f"{name}_metrics.json", json.dumps(found, indent=2, default=float))
    out.write(f"{name}_metrics.md", "\n".join([f"# {name}", "", "| metric | value |", "|-|-|", *[f"| {k} | {v} |" for k, v in found.items()]]) + "\n")
    return found
