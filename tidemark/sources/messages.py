"""Message sources: readers, repair of columns, lenient parsing, bounded samples."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import DATE_FORMAT, REQUIRED_COLUMNS, STORED_NAMES, Settings
from tidemark.sources import files

MESSAGE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "date", "user", "pc", "to", "cc", "bcc", "from", "activity", "size", "attachments", "content")]
)
LABELS = "user string, is_malicious_insider int"
CONSENT = "user string, consented boolean, consented_on string, scope string"
AUDIT = "seq long, timestamp string, event_type string, user_pseudonym string, actor string, details string, prev_hash string, entry_hash string"


def load_messages(spark: SparkSession, kind: str, **options: str) -> DataFrame:
    """Messages from a jdbc, csv, parquet or synthetic source, with repaired columns and parsed dates, ordered by nothing. Of a database
    table (jdbc, dbtable) a uniform sample of `cap` rows at most, drawn there; of files a sample is drawn with `sample`."""
    if kind == "synthetic":
        from tidemark.sources.synthetic import messages

        return prepare(messages(spark, **options))
    if kind == "csv":
        return prepare(spark.read.schema(MESSAGE).option("header", True).csv(options["path"]))
    if kind == "parquet":
        return prepare(spark.read.parquet(options["path"]))
    if kind == "jdbc":
        return prepare(database_sample(spark, options))
    raise ValueError(f"unknown source: {kind}")


def database_sample(spark: SparkSession, options: dict[str, str], read: Callable[[dict[str, str]], DataFrame] | None = None) -> DataFrame:
    """A uniform random sample of `cap` rows (the setting's number by default; 0 reads all) of dbtable, or of a query whole. Every partition of the read
    (Spark's partitionColumn, lowerBound, upperBound, numPartitions: as many connections) keeps the rows of the least random keys in a heap of
    `cap` rows, and the heaps are merged: any row is as likely to be in the sample as any other, however the table is cut, and the database
    sorts nothing. `seed` changes the sample; it is the same again where the database gives the rows of a partition in the same order."""
    given = dict(options)
    cap, seed = int(given.pop("cap", Settings().ingest_cap)), int(given.pop("seed", Settings().seed))
    rows = (read or (lambda o: spark.read.format("jdbc").options(**o).load()))(given)
    return least_keyed(rows, cap, seed) if cap and "dbtable" in given else rows


def least_keyed(rows: DataFrame, cap: int, seed: int) -> DataFrame:
    """The `cap` rows of the least random keys: a heap in each task, and one of their heaps."""
    return rows.withColumn("_key", F.rand(seed)).orderBy("_key").limit(cap).drop("_key")


def first_available(spark: SparkSession, sources: Iterable[tuple[str, dict]]) -> DataFrame:
    """The first source that can be read."""
    errors = []
    for kind, options in sources:
        try:
            return load_messages(spark, kind, **options)
        except Exception as e:  # the next one is tried, the last one raises
            errors.append(f"{kind}: {str(e).splitlines()[0][:200]}")
    raise ValueError("no source can be read: " + "; ".join(errors))


def discover_csv(spark: SparkSession, folder: str, names: tuple[str, ...] = ("email.csv", "emails.csv", "r4.2_email.csv", "email_sample.csv")) -> str | None:
    """A message file in the folder by its name, else by its header."""
    found = {p.rsplit("/", 1)[-1]: p for p in files.listed(spark, folder, ".csv")}
    for name in names:
        if name in found:
            return found[name]
    for p in found.values():
        if set(REQUIRED_COLUMNS) <= set(spark.read.option("header", True).csv(p).columns):
            return p
    return None


def with_names(df: DataFrame, names: dict[str, str] = STORED_NAMES) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def with_defaults(df: DataFrame, defaults: dict[str, object] | None = None) -> DataFrame:
    given = {"activity": "send"} if defaults is None else defaults
    return df.withColumns({k: F.lit(v) for k, v in given.items() if k not in df.columns}) if any(k not in df.columns for k in given) else df


def require(df: DataFrame, columns: Iterable[str] = REQUIRED_COLUMNS) -> DataFrame:
    lacks = sorted(set(columns) - set(df.columns))
    if lacks:
        raise ValueError(f"columns are missing: {', '.join(lacks)}")
    return df


def parsed(date: Column, form: str = DATE_FORMAT) -> Column:
    """The timestamp, null where the text is none."""
    return F.try_to_timestamp(date, F.lit(form))


def drop_unusable(df: DataFrame, drop_blank: bool = True) -> DataFrame:
    df = df.na.drop(subset=["date", "user", "content"])
    return df.filter((F.trim("user") != "") & (F.trim("content") != "")) if drop_blank else df


def prepare(df: DataFrame, drop_blank: bool = True) -> DataFrame:
    df = require(with_defaults(with_names(df)))
    if dict(df.dtypes)["date"] == "string":
        df = df.withColumn("date", parsed(F.col("date")))
    return drop_unusable(df, drop_blank)


def sample(df: DataFrame, cap: int, id_col: str = "id") -> DataFrame:
    """A uniform sample of fixed size that reruns agree on: the first rows by a hash of the id, kept in a bounded heap."""
    return df.orderBy(F.md5(F.col(id_col).cast("string")), id_col).limit(cap)


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A persisted table, None where it has not been written."""
    return spark.read.parquet(path) if files.exists(spark, path) else None


def read_labels(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.schema(LABELS).option("header", True).csv(path) if files.exists(spark, path) else None


def read_consent(spark: SparkSession, path: str | None) -> DataFrame:
    """Users that agreed; nobody where no ledger is named. A ledger that is named and cannot be found is an error: taken for an empty one
    it would shut out everybody without a word."""
    if path is None:
        return spark.createDataFrame([], "user string")
    files.recover(spark, path)
    if not files.exists(spark, path):
        raise FileNotFoundError(f"there is no consent ledger at {path}")
    return spark.read.schema(CONSENT).option("header", True).csv(path).filter("consented").select("user")


def read_audit(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """The audit log, or its newest entries in their order."""
    log = spark.read.schema(AUDIT).json(path)
    return log if last is None else log.orderBy(F.desc("seq")).limit(last).orderBy("seq")


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """All monitoring snapshots that were appended to the path."""
    stats = T.MapType(T.StringType(), T.StructType([T.StructField(n, T.DoubleType()) for n in ("mean", "std")]))
    summary = T.StructType([T.StructField(n, T.DoubleType()) for n in ("mean_avg_drift", "share_users_flagged", "p90_avg_drift")])
    schema = T.StructType([T.StructField("timestamp", T.StringType()), T.StructField("n_messages", T.LongType()), T.StructField("n_users", T.LongType()), T.StructField("feature_distributions", stats), T.StructField("risk_summary", summary)])
    return spark.read.schema(schema).json(path)


def stream_messages(spark: SparkSession, path: str, files: int = 1, schema: T.StructType = MESSAGE) -> DataFrame:
    """Messages of a growing folder of CSV files, a bounded number of files at a time, repaired and parsed."""
    return prepare(spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files).csv(path))


def markdown_chunks(documents: DataFrame, source: str = "source", text: str = "text", least: int = 40) -> DataFrame:
    """Sections of Markdown texts, split before headings of up to three levels."""
    parts = documents.select(source, F.posexplode(F.split(F.col(text), "\\n(?=#{1,3} )")).alias("chunk_no", "chunk"))
    return parts.withColumn("chunk", F.trim("chunk")).filter(F.length("chunk") >= least)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source"), F.col("value").alias("text"))
    return markdown_chunks(rows)
