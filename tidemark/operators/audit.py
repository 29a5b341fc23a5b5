"""A hash-chained audit log: any number of writers append to one chain, verification is parallel."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.ranks import in_ranges
from tidemark.sources.files import Folder

START = "0" * 64
FIELDS = ("actor", "details", "event_type", "prev_hash", "seq", "timestamp", "user_pseudonym")
HEAD = "_head.json"


def _segment(number: int) -> str:
    return f"{number:012d}.jsonl"


def entry_hash(entry: dict) -> str:
    """SHA-256 over the fields in the order of their names, each on a line; details are canonical JSON."""
    return hashlib.sha256("\n".join(f"{k}={'' if entry.get(k) is None else entry[k]}" for k in FIELDS).encode()).hexdigest()


class AuditLog:
    """Numbered segments of JSON lines in a folder of any file system, and the head that they have reached at least, so that cut-off tails show. A segment
    is made whole under the next free number; a writer who finds the number taken goes on from what the other has written. So any
    number of writers keep one chain, and a break leaves a chain without a gap, whose head may be behind but never ahead."""

    def __init__(self, path: str) -> None:
        self.path, self.folder, self._seen = str(path), Folder(str(path)), (0, 0, START)

    def append(self, event_type: str, user_pseudonym: str | None, details: dict, actor: str = "system") -> dict:
        return self.append_all([(event_type, user_pseudonym, details)], actor)[0]

    def append_all(self, events: list[tuple[str, str | None, dict]], actor: str = "system") -> list[dict]:
        """Entries that follow each other, as one segment."""
        while True:
            number, seq, last = self._end()
            entries = []
            for event_type, who, details in events:
                seq += 1
                entry = {"seq": seq, "timestamp": datetime.now(timezone.utc).isoformat(), "event_type": event_type, "user_pseudonym": who, "actor": actor, "details": json.dumps(details, sort_keys=True, default=str), "prev_hash": last}
                last = entry["entry_hash"] = entry_hash(entry)
                entries.append(entry)
            if self.folder.create(_segment(number + 1), "".join(json.dumps(e) + "\n" for e in entries)):
                self._seen = (number + 1, seq, last)
                if seq > self._head()[0]:
                    self.folder.write(HEAD, json.dumps({"seq": seq, "entry_hash": last}))
                return entries

    def _end(self) -> tuple[int, int, str]:
        """Number of the last segment, and seq and hash of the last entry: from what is known on, segment by segment; by the listing at first."""
        if not self._seen[0]:
            names = self.folder.names(".jsonl")
            if names:
                self._seen = self._read(int(names[-1].split(".")[0]))
        while (found := self._read(self._seen[0] + 1)) is not None:
            self._seen = found
        return self._seen

    def _read(self, number: int) -> tuple[int, int, str] | None:
        text = self.folder.read(_segment(number))
        if text is None:
            return None
        last = json.loads(text.splitlines()[-1])
        return number, last["seq"], last["entry_hash"]

    def _head(self) -> tuple[int, str]:
        text = self.folder.read(HEAD)
        if not text:
            return 0, START
        h = json.loads(text)
        return h["seq"], h["entry_hash"]

    def verify(self, spark: SparkSession) -> bool:
        """Whether all entries are as they were written, in one chain that reaches the head."""
        from tidemark.sources.messages import read_audit

        seq, head = self._head()
        if not self.folder.names(".jsonl"):
            return seq == 0
        log = read_audit(spark, self.path)
        row = verify_chain(log).first()
        reached = seq == 0 or log.filter((F.col("seq") == seq) & (F.col("entry_hash") == head)).limit(1).count() == 1
        return bool(row["valid"]) and reached


def hash_of() -> Column:
    parts = [F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit(""))) for k in FIELDS]
    return F.sha2(F.encode(F.concat_ws("\n", *parts), "UTF-8"), 256)


def links(log: DataFrame) -> DataFrame:
    """hash_ok and link_ok of each entry. Entries are dealt out by ranges of their numbers, checked against the one before in their range, and each
    range's first one against the last of the range before: no task holds the log, and what is dealt out are hashes, not details."""
    own = in_ranges(log.select("seq", "prev_hash", "entry_hash", hash_of().alias("computed")), "seq")
    ends = own.groupBy(F.col("_part").alias("_of")).agg(F.max_by("entry_hash", F.struct("seq", "entry_hash")).alias("_last"))
    ends = ends.withColumn("_before", F.lag("_last", 1, START).over(Window.partitionBy(F.lit(1)).orderBy("_of"))).drop("_last")  # a row a range
    inside = F.lag("entry_hash").over(Window.partitionBy("_part").orderBy("seq", "entry_hash"))
    both = own.withColumn("_inside", inside).join(ends, F.col("_part") == F.col("_of"))
    return both.select("seq", "entry_hash", (F.col("computed") == F.col("entry_hash")).alias("hash_ok"), (F.col("prev_hash") == F.coalesce("_inside", "_before")).alias("link_ok"))


def verify_chain(log: DataFrame) -> DataFrame:
    good = F.coalesce(F.col("hash_ok") & F.col("link_ok"), F.lit(False))
    return links(log).agg(F.count("*").alias("n_entries"), F.count_if(~good).alias("n_broken"), F.coalesce(F.bool_and(good), F.lit(True)).alias("valid"), F.max("seq").alias("last_seq"), F.max_by("entry_hash", "seq").alias("last_hash"))
