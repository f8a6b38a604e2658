"""Live versions of run collapse, light detection and dwell.

State is kept per key and time slice (five minutes by default), not per key: rows wait in their slice, in whatever order they
come, until the watermark has passed its end; then the slice is sent and its state goes. One very busy participant is spread
over many states. Rows without a time belong to no slice. Rows later than the delay are left out and counted by
:func:`late_rows`. The slices are put together by the ordinary batch functions at the end of this module.

:func:`closed_runs` and :func:`light_alerts` answer sooner: they keep the rows that the watermark has not passed yet and a short
summary per key of all before. Keys are dealt to a fixed number of states by a hash, as a call of Python for each key takes far
longer than the work on its rows. A timer of the state wakes it when the watermark passes its next row, so a run is sent as soon
as a row of another label is settled. Waiting rows are bounded by the delay, and of those for alerts only the ones that may still
decide are kept; a key is one task, so very busy keys are better served by slices.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SLICE_SECONDS = 300
#: States that the keys are dealt to where each key has a summary of its own.
SHARES = 1024


def _slices(key: str, seconds: int) -> list[Column]:
    return [F.col(key), F.window("ts", f"{seconds} seconds").alias("window")]


def _slice_number(seconds: int) -> Column:
    return F.floor(F.unix_micros("window.start") / F.lit(seconds * 1_000_000)).cast("long").alias("slice")


def live_runs(codes: DataFrame, delay: str = "10 minutes", seconds: int = SLICE_SECONDS) -> DataFrame:
    """Pieces of runs per participant and time slice, from rows (participant_id, ts, seq, code).

    Out: participant_id, slice, piece, code, n_frames, last_piece, sent when the watermark passes the slice. Rows of a
    slice are put in the order of ts and seq first, so the order in which they come does not matter.
    """
    kept = codes.withWatermark("ts", delay).groupBy(*_slices("participant_id", seconds)).agg(
        F.sort_array(F.collect_list(F.struct("ts", "seq", "code"))).alias("rows"))

    def code(place: Column | int) -> Column:
        return F.get(F.col("rows"), place)["code"]

    starts = F.filter(F.sequence(F.lit(0), F.size("rows") - 1), lambda i: (i == 0) | ~code(i).eqNullSafe(code(i - 1)))
    cut = kept.select("participant_id", _slice_number(seconds), "rows", starts.alias("starts"))
    pieces = cut.select("participant_id", "slice", "rows", "starts", F.posexplode("starts").alias("piece", "start"))
    following = F.coalesce(F.get(F.col("starts"), F.col("piece") + 1), F.size("rows"))
    return pieces.select(
        "participant_id", "slice", "piece", code(F.col("start")).alias("code"),
        (following - F.col("start")).cast("long").alias("n_frames"), (F.col("piece") == F.size("starts") - 1).alias("last_piece"))


def live_lights(brightness: DataFrame, threshold: float = 50.0, delay: str = "10 minutes",
                seconds: int = SLICE_SECONDS) -> DataFrame:
    """Light changes per recording and time slice, from rows (recording_id, ts, brightness).

    Out: recording_id, slice, first_dark, first_bright, first_after_dark, sent when the watermark passes the slice.
    Rows without a brightness are neither dark nor bright.
    """
    dark, bright = F.when(F.col("brightness") < threshold, F.col("ts")), F.when(F.col("brightness") >= threshold, F.col("ts"))
    kept = brightness.withWatermark("ts", delay).groupBy(*_slices("recording_id", seconds)).agg(
        F.min(dark).alias("first_dark"), F.min(bright).alias("first_bright"), F.collect_list(bright).alias("bright"))
    after = F.array_min(F.filter("bright", lambda ts: ts > F.col("first_dark")))
    return kept.select("recording_id", _slice_number(seconds), "first_dark", "first_bright", after.alias("first_after_dark"))


_WAITING = "ts array<long>, seq array<long>, key array<string>, value array<string>"


def _plain(value: object) -> str | None:
    return None if value is None or value != value else str(value)


def _settled(pdfs: Iterator[pd.DataFrame], state: GroupState) -> tuple[list[tuple], list[tuple], dict[str | None, tuple]]:
    """Rows (ts in microseconds, seq, key, value) that the watermark has passed, in order; those still waiting; summaries by key."""
    held = state.get if state.exists else ([],) * 5
    rows, summaries = list(zip(*held[:4], strict=True)), dict(zip(held[4], zip(*held[5:]), strict=True))
    if not state.hasTimedOut:
        for p in pdfs:
            rows += zip(p["ts"].tolist(), p["seq"].tolist(), map(_plain, p["key"].tolist()), map(_plain, p["value"].tolist()), strict=True)
    rows.sort(key=itemgetter(0, 1))
    passed = bisect_right(rows, state.getCurrentWatermarkMs() * 1000, key=itemgetter(0))
    return rows[:passed], rows[passed:], summaries


def _keep(state: GroupState, waiting: list[tuple], summaries: dict[str | None, tuple], fields: int) -> None:
    """Keeps the waiting rows and the summaries, with a timer at the first of the rows."""
    def columns(rows: Iterable[tuple], n: int) -> list[list]:
        return [list(column) for column in zip(*rows)] or [[] for _ in range(n)]

    state.update((*columns(waiting, 4), list(summaries), *columns(summaries.values(), fields)))
    if waiting:
        state.setTimeoutTimestamp(max(waiting[0][0] // 1000, state.getCurrentWatermarkMs() + 1))


def _per_share(rows: DataFrame, key: str, value: str, delay: str, step: Callable, out: str, summary: str) -> DataFrame:
    """Rows (key, ts, seq, value) of the keys of a share go to ``step`` together; keys are text there and get their type back."""
    kind = rows.schema[key].dataType
    timed = rows.where(F.col("ts").isNotNull()).withWatermark("ts", delay).select(
        F.col("ts").alias("event_time"), F.pmod(F.xxhash64(key), F.lit(SHARES)).cast("int").alias("share"),
        F.col(key).cast("string").alias("key"), F.unix_micros("ts").alias("ts"), "seq", F.col(value).alias("value"))
    found = timed.groupBy("share").applyInPandasWithState(
        step, f"{key} string, {out}", f"{_WAITING}, known array<string>, {summary}", "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumn(key, F.col(key).cast(kind))


def closed_runs(codes: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Runs per participant from rows (participant_id, ts, seq, code), each sent when a settled row of another code follows.

    Out: participant_id, code, start_frame, end_frame, n_frames. Frames are numbered in the order of ts and seq, whatever the
    order in which rows come inside the delay. The last run of a participant stays open. Rows without a time are left out."""
    def step(share: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows, waiting, runs = _settled(pdfs, state)
        sent = []
        for _, _, key, value in rows:
            code, start, frames = runs.get(key, (value, 0, 0))
            if value != code:
                sent.append((key, code, start, frames - 1, frames - start))
                code, start = value, frames
            runs[key] = (code, start, frames + 1)
        _keep(state, waiting, runs, 3)
        if sent:
            yield pd.DataFrame(sent, columns=["participant_id", "code", "start_frame", "end_frame", "n_frames"])

    return _per_share(codes.select("participant_id", "ts", F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), F.col("code").cast("string").alias("code")),
                      "participant_id", "code", delay, step, "code string, start_frame long, end_frame long, n_frames long",
                      "code array<string>, start array<long>, frames array<long>")


def _deciding(waiting: list[tuple], seen: dict[str | None, tuple]) -> list[tuple]:
    """Of the waiting rows, in order, those that an alert may still hang on, whatever rows come inside the delay.

    Of a recording these are its first dark row, if no settled one is known, and the bright ones up to the first after it."""
    dark = {key: dark_at for key, (dark_at, _) in seen.items()}
    done = {key for key, (_, on_at) in seen.items() if on_at is not None}
    kept = []
    for row in waiting:
        ts, _, key, light = row
        if light is None or key in done or light == "dark" and key in dark:
            continue
        if light == "dark":
            dark[key] = ts
        elif key in dark and ts > dark[key]:
            done.add(key)
        kept.append(row)
    return kept


def light_alerts(brightness: DataFrame, threshold: float = 50.0, delay: str = "10 minutes") -> DataFrame:
    """The first bright moment after the first dark one of each recording, sent once, as soon as it is settled.

    In: recording_id, ts, brightness; out: recording_id, lights_on. Rows without a brightness are neither dark nor bright."""
    def step(share: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows, waiting, seen = _settled(pdfs, state)
        found = []
        for ts, _, key, light in rows:
            dark_at, on_at = seen.get(key, (None, None))
            if on_at is None and light == "dark" and dark_at is None:
                seen[key] = (ts, None)
            elif on_at is None and light == "bright" and dark_at is not None and ts > dark_at:
                seen[key] = (dark_at, ts)
                found.append((key, pd.Timestamp(ts, unit="us", tz="UTC")))
        _keep(state, _deciding(waiting, seen), seen, 2)
        if found:
            yield pd.DataFrame(found, columns=["recording_id", "lights_on"])

    # Of rows of one time the dark one goes first: it decides whether later ones are after it.
    light = F.when(F.col("brightness") < threshold, "dark").when(F.col("brightness") >= threshold, "bright")
    rows = brightness.select("recording_id", "ts", F.when(light == "dark", 0).otherwise(1).cast("long").alias("seq"), light.alias("light"))
    return _per_share(rows, "recording_id", "light", delay, step, "lights_on timestamp", "dark_at array<long>, on_at array<long>")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came later than the delay, over the progress reports that the query still holds."""
    return sum(state["numRowsDroppedByWatermark"] for report in query.recentProgress for state in report["stateOperators"])


def rolling_dwell(codes: DataFrame, delay: str = "10 minutes", window: str = "10 minutes") -> DataFrame:
    """Frames per participant and label in tumbling windows of event time."""
    return (
        codes.withWatermark("ts", delay).groupBy(F.window("ts", window), "participant_id", "code")
        .agg(F.count(F.lit(1)).alias("n_frames"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "participant_id", "code", "n_frames")
    )


def stitch_runs(pieces: DataFrame) -> DataFrame:
    """Runs from the pieces of complete slices: participant_id, code, start_frame, end_frame, n_frames.

    Only the first and last piece of a slice can go on in a neighbour, so the step across slices sees at most
    two rows per slice; frame numbers come from sums per slice.
    """
    sizes = pieces.groupBy("participant_id", "slice").agg(F.sum("n_frames").alias("n"))
    across = Window.partitionBy("participant_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("participant_id", "slice", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("before"))
    inside = Window.partitionBy("participant_id", "slice").orderBy("piece")
    placed = (
        pieces.withColumn("upto", F.sum("n_frames").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(starts, ["participant_id", "slice"])
        .withColumn("end_frame", F.col("before") + F.col("upto") - 1)
        .withColumn("start_frame", F.col("end_frame") - F.col("n_frames") + 1)
        .withColumn("opens", F.col("piece") == 0)
    )
    columns = ["participant_id", "code", "start_frame", "end_frame", "n_frames"]
    inner = placed.filter(~F.col("opens") & ~F.col("last_piece")).select(*columns)
    along = Window.partitionBy("participant_id").orderBy("start_frame")
    edges = (
        placed.filter(F.col("opens") | F.col("last_piece"))
        .withColumn("continues", F.col("opens") & F.lag(F.lit(True)).over(along).isNotNull() & F.col("code").eqNullSafe(F.lag("code").over(along)))
        .withColumn("run", F.sum(F.when(F.col("continues"), 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("participant_id", "run")
        .agg(F.min("code").alias("code"), F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"),
             F.sum("n_frames").alias("n_frames"))
        .select(*columns)
    )
    return inner.unionByName(edges)


def first_light(summaries: DataFrame) -> DataFrame:
    """First bright moment after the first dark one of each recording, from slice summaries."""
    slices = summaries.groupBy("recording_id", "slice").agg(
        F.min("first_dark").alias("first_dark"), F.min("first_bright").alias("first_bright"),
        F.min("first_after_dark").alias("first_after_dark"))
    dark = slices.filter(F.col("first_dark").isNotNull()).groupBy("recording_id").agg(F.min("slice").alias("dark_slice"))
    candidate = F.when(F.col("slice") == F.col("dark_slice"), F.col("first_after_dark")).when(
        F.col("slice") > F.col("dark_slice"), F.col("first_bright"))
    return slices.join(dark, "recording_id").withColumn("candidate", candidate).groupBy("recording_id").agg(
        F.min("candidate").alias("lights_on")).filter(F.col("lights_on").isNotNull())
