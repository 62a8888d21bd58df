"""Session summaries and violation samples over a stream of frames."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from annolytics import settings
from annolytics.functions.detections import violations
from annolytics.operators.ranking import first_per_group
from annolytics.operators.sessions import finish_summary, summary_aggregates, violation_rates
from annolytics.taxonomy import Taxonomy


def running_summary(
    frames: DataFrame, taxonomy: Taxonomy, gap: str | None = "1 day", lateness: str = "10 minutes"
) -> DataFrame:
    """The session summary as a streaming aggregate.

    With `gap`, a session also ends after that long without frames, and its state is dropped once
    the watermark has passed; `ts` must then be a TIMESTAMP.  With None, a session and its state stay
    open until the query is stopped.
    """
    keys = ["session_id"]
    if gap is None:
        grouped = frames.groupBy("session_id")
    else:
        window = F.session_window("ts", gap).alias("session")
        grouped = frames.withWatermark("ts", lateness).groupBy("session_id", window)
        keys.append("session")
    return finish_summary(grouped.agg(*summary_aggregates(taxonomy)), taxonomy, keys)


def ended_sessions(
    frames: DataFrame, taxonomy: Taxonomy, gap: str = "1 day", lateness: str = "1 hour"
) -> DataFrame:
    """Summaries of sessions that have ended, each once: no frame came for `gap`, and the watermark has
    passed that point, so no later frame can join.  To be written in append mode; the state holds
    open sessions only.  session_id, started, ended (one `gap` after the last frame), then the
    columns of the summary.  Frames without a time are dropped."""
    found = running_summary(frames, taxonomy, gap, lateness)
    facts = [c for c in found.columns if c not in ("session_id", "session")]
    return found.select(
        "session_id", F.col("session.start").alias("started"), F.col("session.end").alias("ended"), *facts
    )


def running_rates(frames: DataFrame, width: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Violations per event-time window; closed windows leave the state."""
    return violation_rates(frames.withWatermark("ts", lateness), width)


def write_revisions(stream: DataFrame, folder: str, checkpoint: str, mode: str = "update"):
    """Start writing every micro-batch's changed rows below `folder`, one sub-folder per batch; a
    retried batch replaces its own folder.  Stops by itself when all available input is read."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/revision={batch_id}")

    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )


def latest_rows(revisions: DataFrame, keys: list[str]) -> DataFrame:
    """The newest revision of every key."""
    return first_per_group(revisions, keys, ["revision"], 1, descending=True).drop("rank", "revision")


def latest_groups(revisions: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the newest revision of every key, for streams that emit a changed key whole: rows
    that a later revision no longer has are gone."""
    newest = revisions.groupBy(*keys).agg(F.max("revision").alias("newest"))
    named = newest.withColumnsRenamed({key: f"newest_{key}" for key in keys})
    same = F.col("revision") == F.col("newest")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"newest_{key}"))
    return revisions.join(named, same, "left_semi").drop("revision")


class FirstViolations(StatefulProcessor):
    """Keeps the first `k` violation frames of a session, and emits them whenever they change."""

    def __init__(self, k: int, ttl_ms: int | None) -> None:
        self._k, self._ttl_ms = k, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = "frame long, violations string"
        if self._ttl_ms is None:
            self._kept = handle.getListState("first", schema)
        else:
            self._kept = handle.getListState("first", schema, self._ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = [tuple(row) for row in self._kept.get()] if self._kept.exists() else []
        merged = set(known)
        for frame in rows:
            merged.update(zip(frame["frame"].astype(int).tolist(), frame["violations"].tolist()))
            merged = set(sorted(merged)[: self._k])  # bounded whatever arrives
        first = sorted(merged)
        if first != sorted(known):
            self._kept.put(first)
            yield pd.DataFrame(
                {
                    "session_id": [key[0]] * len(first),
                    "frame": [frame for frame, _ in first],
                    "violations": [text for _, text in first],
                }
            )

    def close(self) -> None:
        pass


def first_violations(
    frames: DataFrame,
    k: int = settings.VIOLATION_SAMPLES,
    ttl_ms: int | None = None,
) -> DataFrame:
    """Streaming twin of `operators.sessions.violation_frames`: session_id, frame, violations (JSON).
    A changed session is emitted as a whole, so `latest_groups` by session_id gives the result.

    Rows are thinned before the shuffle: of every Arrow batch, at most `k` frames per session can be
    among the first `k`.  The state of a session without frames for `ttl_ms` of processing time is
    dropped; with None it is kept for ever.
    """
    schema = "session_id long, frame long, violations string"
    # The list state needs this provider; the setting applies to streams started from here on.
    frames.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    bad = frames.select(
        "session_id", "frame", F.to_json(violations(F.col("detections"))).alias("violations")
    ).where(F.col("violations") != "[]")

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.sort_values("frame").groupby("session_id", sort=False).head(k)

    return (
        bad.mapInPandas(thin, schema)
        .groupBy("session_id")
        .transformWithStateInPandas(
            statefulProcessor=FirstViolations(k, ttl_ms),
            outputStructType=T.StructType.fromDDL(schema),
            outputMode="Update",
            timeMode="None" if ttl_ms is None else "ProcessingTime",
        )
    )


def merge_stretches(stretches: Iterable[tuple], gap_ms: int, k: int) -> list[tuple]:
    """Join (first ms, last ms, frames) that lie less than `gap_ms` apart, in any order of arrival.  The
    frames, (number, violations), are the `k` smallest of all that were joined, so a stretch stays
    bounded."""
    merged: list[tuple] = []
    for first, last, found in sorted(stretches):
        if merged and first - merged[-1][1] < gap_ms:
            start, end, known = merged[-1]
            merged[-1] = (start, max(end, last), sorted({*known, *found})[:k])
        else:
            merged.append((first, last, sorted(set(found))[:k]))
    return merged


def _packed(found: Iterable[tuple]) -> str:
    return json.dumps([list(pair) for pair in found])


def _unpacked(text: str) -> list[tuple]:
    return [tuple(pair) for pair in json.loads(text)]


def _ids(sessions: pd.Series) -> Iterator[int | None]:
    return (None if session != session else int(session) for session in sessions.tolist())


class EndedViolations(StatefulProcessor):
    """Keeps the open stretches of a range of sessions, each with its first `k` violation frames, and emits
    a stretch when the watermark is `gap` past its last frame.

    State, timers and rows pass between Python and the JVM once a range and batch, not once a session.
    """

    def __init__(self, k: int, gap_ms: int) -> None:
        self._k, self._gap_ms = k, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getListState("open", "session_id long, first long, last long, frames string")

    def _known(self) -> dict[int | None, list[tuple]]:
        known: dict[int | None, list[tuple]] = {}
        for session, first, last, found in self._open.get() if self._open.exists() else []:
            known.setdefault(session, []).append((first, last, _unpacked(found)))
        return known

    def _keep(self, known: dict[int | None, list[tuple]]) -> None:
        """Store the stretches, and wake up when the first of them may end."""
        rows = [
            (session, first, last, _packed(found))
            for session, stretches in known.items()
            for first, last, found in stretches
        ]
        end = min((row[2] for row in rows), default=0) + self._gap_ms
        there = False
        for timer in list(self._handle.listTimers()):
            at = timer[0] if isinstance(timer, tuple) else timer
            if rows and at == end:
                there = True
            else:
                self._handle.deleteTimer(at)
        if not rows:
            self._open.clear()
            return
        self._open.put(rows)
        if not there:
            self._handle.registerTimer(end)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self._known()
        for batch in rows:
            new: dict[int | None, list[tuple]] = {}
            facts = zip(batch["first"].tolist(), batch["last"].tolist(), map(_unpacked, batch["frames"]))
            for session, stretch in zip(_ids(batch["session"]), facts):
                new.setdefault(session, []).append(stretch)
            for session, found in new.items():
                known[session] = merge_stretches([*known.get(session, []), *found], self._gap_ms, self._k)
        self._keep(known)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows, still = [], {}
        for session, stretches in self._known().items():
            for first, last, found in stretches:
                if last + self._gap_ms <= now:
                    rows.extend((session, last + self._gap_ms, number, text) for number, text in found)
                else:
                    still.setdefault(session, []).append((first, last, found))
        self._keep(still)
        if rows:
            emitted = pd.DataFrame(rows, columns=["session_id", "ended_ms", "frame", "violations"])
            yield emitted.astype({"session_id": "Int64"})

    def close(self) -> None:
        pass


def ended_violations(
    frames: DataFrame,
    k: int = settings.VIOLATION_SAMPLES,
    gap: timedelta = timedelta(days=1),
    lateness: str = "1 hour",
    together: int = 1,
) -> DataFrame:
    """The first `k` violation frames of every ended stretch, each stretch emitted once, in append mode:
    session_id, ended (`gap` after the last of its violation frames), frame, violations (JSON).

    A session's violation frames less than `gap` apart make one stretch.  It ends when the
    watermark, `lateness` behind the newest violation frame of the stream, has passed its end, and its state goes
    then; frames that come later than that are dropped.  Frames without a time are dropped, too.
    Every Arrow batch is joined to stretches before the shuffle, so a hot session is thinned there.  State is
    kept by ranges of `together` ids, under the least of them; more make fewer, larger states.
    """
    gap_ms = round(gap.total_seconds() * 1000)
    schema = "session long, seen timestamp, first long, last long, frames string"
    frames.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    bad = frames.where("ts IS NOT NULL").select(
        "session_id",
        F.unix_millis("ts").alias("ms"),
        "frame",
        F.to_json(violations(F.col("detections"))).alias("violations"),
    ).where(F.col("violations") != "[]")

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            single: dict[int | None, list[tuple]] = {}
            for session, ms, *pair in zip(_ids(batch["session_id"]), *(batch[c].tolist() for c in ("ms", "frame", "violations"))):
                single.setdefault(session, []).append((ms, ms, [tuple(pair)]))
            rows = [
                (session, first, last, _packed(found))
                for session, frames in single.items()
                for first, last, found in merge_stretches(frames, gap_ms, k)
            ]
            if rows:
                out = pd.DataFrame(rows, columns=["session", "first", "last", "frames"])
                out.insert(1, "seen", pd.to_datetime(out["last"], unit="ms", utc=True))
                yield out

    emitted = (
        bad.mapInPandas(thin, schema)
        .withWatermark("seen", lateness)
        .withColumn("session_id", F.col("session") - F.pmod("session", F.lit(together)))
        .groupBy("session_id")
        .transformWithStateInPandas(
            statefulProcessor=EndedViolations(k, gap_ms),
            outputStructType=T.StructType.fromDDL("session_id long, ended_ms long, frame long, violations string"),
            outputMode="Append",
            timeMode="EventTime",
        )
    )
    return emitted.select("session_id", F.timestamp_millis("ended_ms").alias("ended"), "frame", "violations")
