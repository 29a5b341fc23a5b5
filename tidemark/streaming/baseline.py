"""The streaming twin of the rolling baseline: per user, the last values are the state.

Users are dealt out to a fixed number of shards by a hash. Python runs once a shard in a batch of rows, not once a user, and the state of a shard is
the windows of its users, so a batch reads and writes the windows of all users of the shards that it touches. The number of shards is fixed when a
stream begins, as shards are the keys of its state: more of them mean more calls and less state a call.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Callable, Iterator
from itertools import accumulate
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import Settings

SHARDS = 4096
#: Types of which pandas makes floats where one of a column's values is missing.
WHOLE = ("tinyint", "smallint", "int", "bigint")


def rolling_z(values: np.ndarray, past: np.ndarray, window: int) -> np.ndarray:
    """z of each row of values (rows by features) against the `window` rows before it, of past and values; NaN where they are fewer or one
    of them has no value, 0 where they are all the same."""
    rows = np.concatenate((past, values))
    out = np.full(values.shape, np.nan)
    first = max(window - len(past), 0)  # the first row that has a whole window before it
    if first >= len(values):
        return out
    windows = np.lib.stride_tricks.sliding_window_view(rows[len(past) + first - window : -1], window, axis=0)
    x = values[first:]
    with np.errstate(invalid="ignore", divide="ignore"):
        z = (x - windows.mean(axis=2)) / windows.std(axis=2)
    constant = (windows.min(axis=2) == windows.max(axis=2)) & ~np.isnan(x)
    out[first:] = np.where(constant, 0.0, z)
    return out


def drift_scores(z: np.ndarray, weights: np.ndarray, clip: float) -> np.ndarray:
    """The weighted mean of clipped absolute z in each row, over those that are there; 0 without any."""
    there = ~np.isnan(z)
    total = (there * weights).sum(axis=1)
    scaled = 1e4 * np.where(total > 0, (np.minimum(np.abs(np.where(there, z, 0.0)), clip) * weights).sum(axis=1) / np.maximum(total, 1e-300), 0.0)
    return (np.floor(scaled) + (scaled - np.floor(scaled) >= 0.5)) / 1e4  # half away from zero, as the batch form rounds


def _instant(kind: str) -> Column:
    """`date` as a number, in the same order."""
    if kind == "date":
        return F.unix_date("date")
    return F.unix_micros(F.col("date").cast("timestamp")) if kind.startswith("timestamp") else F.col("date")


def _by_shard(rows: DataFrame, columns: list[Column], read: Callable, work: Callable, out: Callable, schema: str, past: str, shards: int, late: str, idle_seconds: int | None) -> DataFrame:
    """What `out` makes of a shard's rows, in the order of (user, date, id), and of the results of their users. `read` takes an array from those
    rows; `work` gets a user's part of it and the user's state, and gives results and the state to keep, a flat list of the type `past`. With idle_seconds
    a user's state goes when the watermark has passed the user's last row by so much, unless rows of the user are in the same batch."""
    if shards < 1:
        raise ValueError("shards must be positive")
    kinds = dict(rows.dtypes)

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        held, found, made = {}, [], None
        if state.exists:
            users, sizes, values, until = state.get
            held = {u: (values[end - n : end], t) for u, n, end, t in zip(users, sizes, accumulate(sizes), until, strict=True)}
        now = 0 if idle_seconds is None else state.getCurrentWatermarkMs()
        present = set()
        if not state.hasTimedOut:
            got = pd.concat(list(chunks), ignore_index=True)
            got["code"], names = pd.factorize(got["user"])
            got = got.sort_values(["code", "at", "no_id", "id"], ignore_index=True)
            names = [*names.tolist(), None]  # code -1: no user
            codes = got["code"].to_numpy()
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]).tolist()
            at, data = got["at"].to_numpy(), read(got)
            for lo, hi in zip(starts, [*starts[1:], len(got)], strict=True):
                user = names[codes[lo]]
                results, kept = work(data[lo:hi], held[user][0] if user in held else [])
                found.append(results)
                # Missing times are last, and are no time to wait from.
                last = 0 if idle_seconds is None else max([int(t) // 1000 for t in at[lo:hi] if t == t], default=0)
                held[user] = (kept, max(last, now) + (idle_seconds or 0) * 1000)
                present.add(user)
            if got["no_id"].any():
                got["id"] = got["id"].astype(object).mask(got["no_id"], None)
            made = out(got, found)
        if idle_seconds is not None:
            held = {u: x for u, x in held.items() if u in present or x[1] >= now}
        if held:
            state.update((list(held), [len(x) for x, _ in held.values()], [v for x, _ in held.values() for v in x], [t for _, t in held.values()]))
            if idle_seconds is not None:
                state.setTimeoutTimestamp(max(min(t for _, t in held.values()), now + 1))
        else:
            state.remove()
        if made is not None:
            yield made

    user, kind = F.col("user"), kinds["id"]
    # Rows without a user are a shard of their own: elsewhere pandas would make floats of the other users' numbers. Of ids it would, too.
    shard = F.when(user.isNull(), -1).otherwise(F.pmod(F.xxhash64(user), F.lit(shards))).cast("int").alias("shard")
    no_id = F.col("id").isNull().alias("no_id") if kind in WHOLE else F.lit(False).alias("no_id")
    number = F.coalesce("id", F.lit(0).cast(kind)).alias("id") if kind in WHOLE else F.col("id")
    live = rows.withWatermark("date", late) if idle_seconds is not None else rows
    dates = ["date"] if idle_seconds is not None else []  # rows are late by this column
    live = live.select(shard, "user", _instant(kinds["date"]).alias("at"), no_id, number, *columns, *dates)
    kept = f"users array<{kinds['user']}>, sizes array<int>, past array<{past}>, until array<bigint>"
    return live.groupBy("shard").applyInPandasWithState(step, schema, kept, "append", "NoTimeout" if idle_seconds is None else "EventTimeTimeout")


def stream_baseline(events: DataFrame, window: int, settings: Settings | None = None, features: tuple[str, ...] = ("value",), late: str = "1 day", idle_seconds: int | None = None, shards: int = SHARDS) -> DataFrame:
    """user, date, id, z_<feature> and drift_score of each event of a stream (user, date, id and the features) against the user's last values
    before it; rows without any z are left out. The state of a user is a window of values. With idle_seconds it goes when the
    watermark has passed the user's last event by so much, and rows later than the watermark are dropped; without, it stays for ever. Rows
    of a batch come in chunks and are put in order first; rows that come later than their successors are scored when they come."""
    s, kinds = settings or Settings(), dict(events.dtypes)
    weights = np.array([s.weights.get(f, 1.0) for f in features])
    inner = [f"v{k}" for k in range(len(features))]
    schema = ", ".join([f"user {kinds['user']}", "at bigint", f"id {kinds['id']}", *[f"z_{f} double" for f in features], "drift_score double"])

    def read(rows: pd.DataFrame) -> np.ndarray:
        return rows[inner].to_numpy(float)

    def work(values: np.ndarray, past: list) -> tuple:
        before = np.asarray(past, float).reshape(-1, len(features))
        return rolling_z(values, before, window), np.concatenate((before, values))[-window:].ravel().tolist()

    def out(rows: pd.DataFrame, found: list) -> pd.DataFrame:
        z = np.concatenate(found)
        kept = np.flatnonzero((~np.isnan(z)).any(axis=1))
        first = rows.loc[kept, ["user", "at", "id"]].to_dict("series")
        return pd.DataFrame({**first, **{f"z_{f}": z[kept, k] for k, f in enumerate(features)}, "drift_score": drift_scores(z[kept], weights, s.clip_at)})

    rows = events.select("user", F.col("date").cast("timestamp").alias("date"), "id", *features)
    scored = _by_shard(rows, [F.col(f).cast("double").alias(v) for f, v in zip(features, inner, strict=True)], read, work, out, schema, "double", shards, late, idle_seconds)
    return scored.withColumn("at", F.timestamp_micros("at")).withColumnRenamed("at", "date")


class Contacts:
    """The last entries of a user, how often each contact is among them, and the sum of the squares of those counts, kept up to date entry by entry."""

    def __init__(self, past: list, window: int) -> None:
        self.window, self.entries, self.counts, self.squares = window, deque(), Counter(), 0
        self.add(past)

    def add(self, contacts: list) -> None:
        for c in contacts:
            self.entries.append(c)
            self.squares += 2 * self.counts[c] + 1
            self.counts[c] += 1
            if len(self.entries) > self.window:
                old = self.entries.popleft()
                self.squares -= 2 * self.counts[old] - 1
                self.counts[old] -= 1
                if not self.counts[old]:
                    del self.counts[old]

    def features(self) -> tuple[float, float]:
        n = len(self.entries)
        return float(len(self.counts)), self.squares / (n * n) if n else 0.0


def stream_contacts(messages: DataFrame, window: int, late: str = "1 day", idle_seconds: int | None = None, shards: int = SHARDS) -> DataFrame:
    """contact_degree and interaction_concentration of each message (user, date, id, recipients; users and recipients of any type) of a stream; the
    state is the user's last contacts. With idle_seconds it goes when the watermark has passed the user's last message by so much; `date` must
    then be a timestamp."""
    kinds = dict(messages.dtypes)
    contact = kinds["recipients"].removeprefix("array<").removesuffix(">")
    to = F.col("recipients")
    if contact in WHOLE:  # as texts, numbers stay exact beside missing ones
        to, contact = to.cast("array<string>"), "string"

    def read(rows: pd.DataFrame) -> np.ndarray:
        return rows["recipients"].to_numpy()

    def work(messages: np.ndarray, past: list) -> tuple:
        held, found = Contacts(past, window), []
        for contacts in messages:
            found.append(held.features())
            held.add([] if contacts is None else np.asarray(contacts).tolist())
        return found, list(held.entries)

    def out(rows: pd.DataFrame, found: list) -> pd.DataFrame:
        both = np.array([x for results in found for x in results], float)
        return pd.DataFrame({"user": rows["user"], "id": rows["id"], "contact_degree": both[:, 0], "interaction_concentration": both[:, 1]})

    schema = f"user {kinds['user']}, id {kinds['id']}, contact_degree double, interaction_concentration double"
    rows = messages.select("user", "date", "id", "recipients")
    return _by_shard(rows, [to.alias("recipients")], read, work, out, schema, contact, shards, late, idle_seconds)


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events of each day, final once the watermark has passed it."""
    return events.withWatermark("date", late).groupBy(F.window("date", "1 day")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "n")
