"""Baselines of a stream in bounded state, and streams that go on where a batch has ended.

Users are dealt out to a fixed number of shards by a hash. A shard keeps the windows of at most `capacity` users: when another one comes, the one
not seen for longest goes, and starts anew if it comes back. Windows are a map state with an optional time to live, so a batch of
events reads and writes those of its own users alone; the order in which users were last seen is a list of at most `capacity` names.
The last windows of a batch (`last_values`) are the initial state of a stream.

The state store must be RocksDB (`spark.sql.streaming.stateStore.providerClass`), which keeps it on disk.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.config import Settings
from tidemark.streaming.baseline import drift_scores, rolling_z

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_disk_state(spark: SparkSession) -> None:
    """Has the session keep its streams' state in RocksDB, unless a deployment has chosen a store itself."""
    if not spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("RocksDBStateStoreProvider"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)


def last_values(df: DataFrame, window: int, features: tuple[str, ...] = ("value",), order: tuple[str, ...] = ("date", "id")) -> DataFrame:
    """user, past and seen: the values of each user's last rows, row after row, oldest first (null as NaN), and the time of the last one."""
    w = Window.partitionBy("user").orderBy(*[F.desc(c) for c in order])
    last = df.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") <= window)
    row = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features])
    rows = last.groupBy("user").agg(F.sort_array(F.collect_list(F.struct((-F.col("_nth")).alias("k"), row.alias("x")))).alias("rows"), F.max(order[0]).alias("seen"))
    return rows.select("user", F.flatten(F.transform("rows", lambda r: r["x"])).alias("past"), "seen")


class _Windows(StatefulProcessor):
    def __init__(self, kind: str, window: int, features: tuple[str, ...], weights: np.ndarray, clip: float, capacity: int, live_ms: int | None) -> None:
        self.kind, self.window, self.features, self.weights, self.clip, self.capacity, self.live_ms = kind, window, features, weights, clip, capacity, live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.order = handle.getValueState("order", f"users array<{self.kind}>")
        self.past = handle.getMapState("past", f"user {self.kind}", "past array<double>", self.live_ms)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        rows = initialState.sort_values(["seen", "user"]).tail(self.capacity)
        had = list(self.order.get()[0]) if self.order.exists() else []
        for user, past in zip(rows["user"], rows["past"], strict=True):
            self.past.updateValue((user,), (np.asarray(past, float).tolist(),))
        self.order.update(([*had, *rows["user"].tolist()],))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows)).sort_values(["date", "id"], ignore_index=True)
        seen = OrderedDict.fromkeys(list(self.order.get()[0]) if self.order.exists() else [])
        values, users = rows[list(self.features)].to_numpy(float), rows["user"].tolist()
        z, held, changed = np.full(values.shape, np.nan), {}, set()
        for at, user in self._stretches(users, seen):
            z[at], held[user] = self._scored(user, values[at], held), self._next(user, values[at], held)
            changed.add(user)
            seen[user] = None
            seen.move_to_end(user)
            if len(seen) > self.capacity:
                gone, _ = seen.popitem(last=False)
                held[gone] = None
                changed.add(gone)
        for user in changed:
            if held[user] is not None:
                self.past.updateValue((user,), (held[user].ravel().tolist(),))
            elif self.past.containsKey((user,)):
                self.past.removeKey((user,))
        self.order.update((list(seen),))
        there = ~np.isnan(z)
        kept = np.flatnonzero(there.any(axis=1))
        out = rows.loc[kept, ["user", "date", "id"]].to_dict("series")
        names = {f"z_{f}": z[kept, k] for k, f in enumerate(self.features)}
        yield pd.DataFrame({**out, **names, "drift_score": drift_scores(z[kept], self.weights, self.clip)})

    def _stretches(self, users: list, seen: OrderedDict) -> Iterator[tuple[np.ndarray, object]]:
        """Rows that may be scored together: all of a user if nobody has to go, in the order of their last rows; else one by one."""
        if len(seen.keys() | set(users)) <= self.capacity:
            places: OrderedDict = OrderedDict()
            for i, user in enumerate(users):
                places.setdefault(user, []).append(i)
                places.move_to_end(user)
            yield from ((np.array(at), user) for user, at in places.items())
        else:
            yield from ((np.array([i]), user) for i, user in enumerate(users))

    def _window(self, user, held: dict) -> np.ndarray:
        if user not in held:
            found = self.past.getValue((user,)) if self.past.containsKey((user,)) else None
            held[user] = None if found is None else np.asarray(found[0], float).reshape(-1, len(self.features))
        return np.zeros((0, len(self.features))) if held[user] is None else held[user]

    def _scored(self, user, values: np.ndarray, held: dict) -> np.ndarray:
        return rolling_z(values, self._window(user, held), self.window)

    def _next(self, user, values: np.ndarray, held: dict) -> np.ndarray:
        return np.concatenate((self._window(user, held), values))[-self.window :]

    def close(self) -> None:
        pass


def bounded_baseline(events: DataFrame, window: int, settings: Settings | None = None, features: tuple[str, ...] = ("value",), capacity: int = 512, shards: int = 200, live_seconds: int | None = None, start: DataFrame | None = None) -> DataFrame:
    """user, date, id, z_<feature> and drift_score of each event of a stream against the user's last values before it, as stream_baseline has them, in the
    state of at most `capacity` users in each of the shards. With live_seconds a window goes that long after it was last written. `start`
    (of last_values) is the state to begin with: its latest users, up to the capacity of their shard."""
    if capacity < 1 or shards < 1:
        raise ValueError("capacity and shards must be positive")
    s, kinds = settings or Settings(), dict(events.dtypes)
    use_disk_state(events.sparkSession)
    shard = F.pmod(F.xxhash64("user"), F.lit(shards)).cast("int").alias("shard")
    rows = events.select(shard, "user", "date", "id", *features)
    work = _Windows(kinds["user"], window, features, np.array([s.weights.get(f, 1.0) for f in features]), s.clip_at, capacity, None if live_seconds is None else live_seconds * 1000)
    schema = ", ".join([f"user {kinds['user']}", "date timestamp", f"id {kinds['id']}", *[f"z_{f} double" for f in features], "drift_score double"])
    given = None if start is None else start.select(shard, F.col("user").cast(kinds["user"]).alias("user"), "past", "seen").groupBy("shard")
    return rows.groupBy("shard").transformWithStateInPandas(work, schema, "append", "None" if live_seconds is None else "ProcessingTime", initialState=given)
