"""Chat formatting by a grammar round trip.

The template is  conversation = "<s>" turn*,  turn = "[INST]" role "[/INST]" text "</s>".  Every turn is rendered, read
again by a deterministic parser and compared with its source; while they differ, more of its content is escaped:
first nothing, then the control strings, then also what already looks escaped. An escaped string has one
backslash more behind its first character (`</s>` -> `<\\/s>`), and the parser takes one away, so every text comes back.

Rendering is row by row, before the only shuffle. Turns are then dealt out by conversation and sorted, and a task reads
them as a stream: a conversation of any length needs no memory beyond a turn. Digests over a conversation are
sequential by nature, so one conversation is read by one task.

Defined results: null text and null role are empty; null turn numbers come first; turns that agree in number are
ordered by role and a digest of the text, repeated rows stay; a null conv_id is a conversation of its own; without an assistant
turn the masked text is empty; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import names_free, table

BOS, HEAD, NECK, TAIL = "<s>", "[INST]", "[/INST]", "</s>"
_PLAIN = re.compile(r"<(/?s>)|\[(/?INST\])")
_ESCAPED = re.compile(r"(<)\\(\\*/?s>)|(\[)\\(\\*/?INST\])")
_ALL = re.compile(r"(<)(\\*/?s>)|(\[)(\\*/?INST\])")
TRAINED = "assistant"


def _once(pattern: re.Pattern, text: str) -> str:
    return pattern.sub(lambda m: (m[1] or m[3]) + "\\" + (m[2] or m[4]), text)


def _plain(text: str) -> str:
    return _PLAIN.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: (m[1] or m[3]) + (m[2] or m[4]), text)


#: What is escaped, from nothing to all that the parser could misread.
LEVELS = (lambda t: t, _plain, lambda t: _once(_ALL, t))


def read_turns(stream: str) -> tuple[list[tuple[str, str, int, int]], int] | None:
    """The whole turns at the start of a stream, each with role, text, and start and end of the text in it, and where what follows begins: a
    turn that has not ended yet. None if the stream isn't in the grammar."""
    turns, at = [], 0
    while at < len(stream):
        if not stream.startswith(HEAD, at):
            return (turns, at) if HEAD.startswith(stream[at:]) else None
        tail = stream.find(TAIL, at + len(HEAD))
        if tail < 0:
            break
        neck = stream.find(NECK, at + len(HEAD), tail)
        if neck < 0:
            return None
        head, body = stream[at + len(HEAD) : neck], stream[neck + len(NECK) : tail]
        if any(c in head or c in body for c in (BOS, HEAD, NECK)):
            return None
        turns.append((unescape(head), unescape(body), neck + len(NECK), tail))
        at = tail + len(TAIL)
    return turns, at


def parse(rendered: str) -> list[tuple[str, str, int, int]] | None:
    """The turns of a text, with or without the start of a conversation; None if it isn't in the grammar."""
    skip = len(BOS) if rendered.startswith(BOS) else 0
    read = read_turns(rendered[skip:])
    if read is None or read[1] < len(rendered) - skip:
        return None
    return [(role, text, a + skip, b + skip) for role, text, a, b in read[0]]


def render(role: str, text: str) -> str:
    """One turn, with as much escaped as it takes for the parser to give back the same role and text."""
    for level in LEVELS:
        out = HEAD + level(role) + NECK + level(text) + TAIL
        read = parse(out)
        if read is not None and len(read) == 1 and read[0][:2] == (role, text):
            return out
    raise ValueError("a turn does not survive the round trip")


def _rendered(role: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([render(r or "", t or "") for r, t in zip(role, text, strict=True)])


def rendered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and the rendered turn, row by row."""
    names_free(conversations, "conv_id", "turn", "role", "text")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("rendered", F.pandas_udf(_rendered, "string")("role", "text"))


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Reader:
    """Reads one conversation's output as a stream, in pieces that may end anywhere: turns are told apart by the grammar, and what a piece
    leaves unfinished is held until the next."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.turns, self.loss, self.size, self.begun = conv, 0, 0, 0, False
        self.all, self.masked, self.held = hashlib.sha256(), hashlib.sha256(), ""
        self.feed(BOS)

    def feed(self, piece: str) -> None:
        self.size += len(piece)
        self.held += piece
        if not self.begun:
            if not self.held.startswith(BOS):
                return
            self.begun, self.held = True, self.held[len(BOS) :]
        read = read_turns(self.held)
        if read is None:
            raise ValueError("the output is not in the grammar")
        self.held = self.held[read[1] :]
        for role, text, _, _ in read[0]:
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if role == TRAINED:
                self.loss += len(text)
                self.masked.update(text.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        if self.held:
            raise ValueError("the output ends within a turn")
        return self.conv, self.turns, self.all.hexdigest(), self.loss, self.masked.hexdigest(), self.size


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, reader = [x.split()[0] for x in READ.split(", ")], None

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string() if "sha256" in n else pa.int64() for n in names]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names=names)

    for batch in batches:
        done = []
        for conv, piece in zip(batch.column("conv_id").to_pylist(), batch.column("rendered").to_pylist(), strict=True):
            if reader is None or reader.conv != conv:
                if reader is not None:
                    done.append(reader.row())
                reader = _Reader(conv)
            reader.feed(piece)
        yield out(done)
    if reader is not None:
        yield out([reader.row()])


def in_order(conversations: DataFrame) -> DataFrame:
    """Rendered turns, each conversation within one partition and in order: BOS and these make the formatted text."""
    rows = rendered_turns(conversations).withColumn("tie", F.md5(F.encode("text", "UTF-8"))).drop("text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "tie").select("conv_id", "turn", "rendered")


def read_back(turns: DataFrame) -> DataFrame:
    """Counts and digests of each conversation, from the output alone."""
    return turns.select("conv_id", "rendered").mapInArrow(_read, READ)


def masked_turns(conversations: DataFrame) -> DataFrame:
    """For training: per turn the rendered text and the loss span [loss_start, loss_end) in it, null where there is none."""
    def spans(pieces: pd.Series) -> pd.DataFrame:
        found = [parse(p)[0] for p in pieces]
        return pd.DataFrame({"loss_start": pd.array([f[2] if f[0] == TRAINED else None for f in found], "Int64"), "loss_end": pd.array([f[3] if f[0] == TRAINED else None for f in found], "Int64")})

    loss = F.pandas_udf(spans, "loss_start long, loss_end long")("rendered")
    return in_order(conversations).withColumn("loss", loss).select("conv_id", "turn", "rendered", "loss.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(in_order(rows))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, md5(text)) AS all_text,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, md5(text)), '') AS loss,
         3 + sum(17 + length(role) + length(text) + len(regexp_extract_all(role || chr(10) || text, '<\\*/?s>|\[\\*/?INST\]'))) AS size
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(all_text) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(size AS BIGINT) AS formatted_chars FROM t
"""
