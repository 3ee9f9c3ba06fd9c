"""Sliding request rates per key over a log: counts, limit flags and allow/deny decisions."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator, Mapping, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plumbline.functions.fixed import RATE_LIMIT_DEFAULT, RATE_LIMITS, RATE_WINDOW_SECONDS
from plumbline.functions.kinds import ref
from plumbline.operators.ordering import directional_fill, running_sum
from plumbline.session import checkpointed, stored

# Requests of a pair that are decided in one piece.
SLICE_ROWS = 100_000
# Requests that a stream gathers before it puts them into the state of their pair.
CHUNK_ROWS = 200_000
MICROS = 1_000_000


def limit_for(request_class: Column, limits: Mapping[str, int] = RATE_LIMITS, default: int = RATE_LIMIT_DEFAULT) -> Column:
    out = F.lit(default)
    for name, value in limits.items():
        out = F.when(request_class == name, F.lit(value)).otherwise(out)
    return out


def _prepared(log: DataFrame, key: str, ts: str, request_class: str | None, limits, default) -> DataFrame:
    """Add the time in microseconds, the pair of caller and class that is limited, and its limit."""
    parts = [ref(key), ref(request_class)] if request_class else [ref(key)]
    top = limit_for(ref(request_class), limits, default) if request_class else F.lit(default)
    return log.withColumns(
        {
            "__at": F.unix_micros(ref(ts).cast("timestamp")),
            "__pair": F.to_json(F.array(*[p.cast("string") for p in parts])),
            "max_requests": top,
        }
    )


def _sliding_sum(rows: DataFrame, weight: Column, low: int, high: int, name: str) -> DataFrame:
    """Add the sum of ``weight`` over the rows of the same pair whose time lies in ``[t + low, t + high]``.

    A row is active for the requests between ``at - high`` and ``at - low``; a running sum of its
    coming and going needs one sorted pass, however many rows a window holds. All that comes, goes and
    asks is dealt to buckets of about equal numbers of rows by ranges of pair and time, and a table
    with one row per pair and bucket carries the sums on, so one busy pair is spread over many tasks.
    """
    at, start, end = F.col("__at"), F.col("__at") - high, F.col("__at") - low
    payload = F.struct(*[ref(c) for c in rows.columns])
    nothing = F.lit(None).cast(T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields]))
    entry = lambda t, w, p: F.struct(t.alias("t"), w.cast("bigint").alias("w"), p.alias("row"))
    moves = F.array(entry(start, weight, nothing), entry(end + 1, -weight, nothing))
    asked = F.array(entry(at, F.lit(0), payload))
    events = rows.select("__pair", F.explode(F.concat(F.when(weight != 0, moves).otherwise(F.slice(moves, 1, 0)), asked)).alias("e")).select("__pair", "e.*")
    summed = running_sum(events, "w", "t", ["__pair"], name)
    return summed.filter(F.col("row").isNotNull()).select("row.*", name)


def rate_flags(
    log: DataFrame,
    key: str,
    ts: str,
    request_class: str | None = None,
    window: int = RATE_WINDOW_SECONDS,
    limits: Mapping[str, int] = RATE_LIMITS,
    default: int = RATE_LIMIT_DEFAULT,
) -> DataFrame:
    """Requests of the pair in the last ``window`` seconds (ends included) and whether they exceed the limit."""
    span = window * MICROS
    rows = _prepared(log, key, ts, request_class, limits, default)
    counted = _sliding_sum(rows, F.lit(1), -span, 0, "in_window")
    return counted.withColumn("exceeded", F.col("in_window") > F.col("max_requests")).drop("__at", "__pair")


def rate_decisions(
    log: DataFrame,
    key: str,
    ts: str,
    tie: str,
    request_class: str | None = None,
    window: int = RATE_WINDOW_SECONDS,
    limits: Mapping[str, int] = RATE_LIMITS,
    default: int = RATE_LIMIT_DEFAULT,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Allowed or denied per request, where denied requests do not count against the limit.

    A request whose whole window holds no more requests than the limit is allowed whatever was
    decided before. Only the others, together with the requests in their windows, have to be
    taken in order. They are numbered within their pair and cut into slices; a slice turns the
    allowed times before it into those after it, see :func:`_slice_starts`. Once it is known with
    which times each slice begins, all slices are decided by themselves.
    """
    span = window * MICROS
    rows = _prepared(log, key, ts, request_class, limits, default)
    # A request leaves the window after exactly ``window`` seconds, hence the open end.
    counted = _sliding_sum(rows, F.lit(1), -span + 1, 0, "__count")
    ahead = checkpointed(_sliding_sum(counted, (F.col("__count") > F.col("max_requests")).cast("int"), 0, span - 1, "__over_ahead"))
    calm = ahead.filter("__over_ahead = 0").withColumn("allowed", F.lit(True))
    names = [*log.columns, "max_requests"]
    busy = directional_fill(ahead.filter("__over_ahead > 0"), [], ["__at", tie], ["__pair"], index="__place")
    busy = stored(busy.withColumn("__slice", F.floor(F.col("__place") / slice_rows)), "busy")
    starts = _slice_starts(busy, span)
    spots = starts.mapInArrow(_allowed_places(span, slice_rows), "pair string, spot bigint")
    met = busy.join(spots, (F.col("__pair") == F.col("pair")) & (F.col("__place") == F.col("spot")), "left")
    decided = met.withColumn("allowed", F.col("spot").isNotNull())
    return calm.select(*[ref(c) for c in names], "allowed").unionByName(decided.select(*[ref(c) for c in names], "allowed"))


def _walk(times: list[int], recent: list[int], top: int, span: int) -> tuple[list[int], list[int]]:
    """The places of the allowed times of a slice, and the allowed times that its last request still sees.

    Denied requests are leapt over: after ``top`` allowed ones the next is the first that comes a window after the oldest.
    """
    recent, places, at = list(recent), [], 0
    while at < len(times) and top > 0:
        if len(recent) >= top:
            at = max(at, bisect_left(times, recent[-top] + span, at))
            if at == len(times):
                break
        places.append(at)
        recent.append(times[at])
        at += 1
    return places, _seen(recent, times[-1], top, span)


def _seen(recent: list[int], now: int, top: int, span: int) -> list[int]:
    return [t for t in recent[-top:] if t > now - span] if top > 0 else []


_STATES = "pair string, slice bigint, first bigint, top int, entry array<bigint>, exit array<bigint>"


def _slice_starts(busy: DataFrame, span: int) -> DataFrame:
    """Slices ``pair, slice, top, times`` with ``entry``, the allowed times that a slice begins with.

    First every slice is walked as if nothing had been allowed before it. Where the slice before ends otherwise, it is
    walked again from that end; slices in a row that have to be walked again are one run, which a task reads slice by slice
    and leaves at its end. That is repeated until every slice begins as the one before it ends. A pause of a window, or a
    slice that forgets how it began, ends a run, so most runs are short; a pair that stays above its limit without a
    pause may be one run, of eight bytes for each request, whose denied requests are leapt over.
    """
    spark = busy.sparkSession
    slices = stored(
        busy.groupBy(F.col("__pair").alias("pair"), F.col("__slice").alias("slice")).agg(F.min("max_requests").alias("top"), F.sort_array(F.collect_list("__at")).alias("times")), "rate-slices"
    )

    def walked(runs: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, state = None, []
            for batch in batches:
                for r in batch.to_pylist():
                    if not runs or (r["pair"], r["run"]) != current:
                        current, state = (r["pair"], r.get("run")), r.get("start") or []
                    entry = _seen(state, r["times"][0], r["top"], span)
                    _, state = _walk(r["times"], entry, r["top"], span)
                    row = {"pair": r["pair"], "slice": r["slice"], "first": r["times"][0], "top": r["top"], "entry": entry, "exit": state}
                    yield pa.RecordBatch.from_pylist([row], _ARROW_STATES)

        return run

    states = stored(slices.mapInArrow(walked(False), _STATES), "rate-states")
    in_pair = Window.partitionBy("pair").orderBy("slice")
    while True:
        before = F.coalesce(F.lag("exit").over(in_pair), F.array().cast("array<bigint>"))
        seen = F.filter(F.col("before"), lambda t: t > F.col("first") - span)
        checked = states.withColumn("before", before).withColumn("start", seen).withColumn("off", F.col("start") != F.col("entry"))
        # A run goes on as long as slices are off; it is named by the slices of its pair that are not.
        run = F.count_if(~F.col("off")).over(in_pair.rowsBetween(Window.unboundedPreceding, 0))
        off = stored(checked.withColumn("run", run).filter("off").select("pair", "slice", "run", "start"), "rate-runs")
        if off.isEmpty():
            break
        again = slices.join(off, ["pair", "slice"]).repartition("pair", "run").sortWithinPartitions("pair", "run", "slice")
        new = again.mapInArrow(walked(True), _STATES)
        kept = states.join(off, ["pair", "slice"], "left_anti").select(*states.columns)
        states = stored(kept.unionByName(new), "rate-states")
    return slices.join(states.select("pair", "slice", "entry"), ["pair", "slice"])


_ARROW_STATES = pa.schema([("pair", pa.string()), ("slice", pa.int64()), ("first", pa.int64()), ("top", pa.int32()), ("entry", pa.list_(pa.int64())), ("exit", pa.list_(pa.int64()))])


def _allowed_places(span: int, slice_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                places, _ = _walk(r["times"], r["entry"], r["top"], span)
                spots = pa.array([r["slice"] * slice_rows + p for p in places], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r["pair"]] * len(places), pa.string()), spots], names=["pair", "spot"])

    return run


def rate_counts_stream(
    log: DataFrame, key: str, ts: str, window: str = "60 seconds", slide: str = "10 seconds", lateness: str = "2 minutes", limit: int = RATE_LIMIT_DEFAULT
) -> DataFrame:
    """Streaming counts per key in sliding windows; rows later than ``lateness`` are dropped."""
    timed = log.withColumn("__ts", ref(ts).cast("timestamp")).withWatermark("__ts", lateness)
    counts = timed.groupBy(F.window("__ts", window, slide).alias("w"), ref(key)).agg(F.count(F.lit(1)).alias("requests"))
    return counts.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), ref(key), "requests",
        (F.col("requests") > limit).alias("exceeded"),
    )


def rate_decisions_stream(
    log: DataFrame,
    key: str,
    ts: str,
    tie: str,
    request_class: str | None = None,
    window: int = RATE_WINDOW_SECONDS,
    limits: Mapping[str, int] = RATE_LIMITS,
    default: int = RATE_LIMIT_DEFAULT,
    lateness: str = "2 minutes",
) -> DataFrame:
    """Streaming decisions ``pair, at, tie, max_requests, allowed`` in the order of event times, as :func:`rate_decisions` makes them.

    A request waits in the state of its pair until the watermark has passed its time, so that it makes no difference how the
    input is dealt over files and micro-batches. A timer at the least waiting time then decides what is due, in order, one
    window length after the other, so that no more requests of a pair than come within one are in memory. Times
    that are later than the watermark are left out. The state of a pair holds its waiting requests and at most as many
    allowed times as its limit; a second timer removes it one window after its last request. Run the stream with
    :func:`plumbline.streaming.files.run_to_end`, which also takes what still waits when the input ends.

    Needs the RocksDB state store.
    """
    span = window * MICROS
    timed = _prepared(log, key, ts, request_class, limits, default).select(
        F.col("__pair").alias("pair"), F.timestamp_micros("__at").alias("time"), F.col("__at").alias("at"), ref(tie).cast("string").alias("tie"), "max_requests"
    )
    return timed.withWatermark("time", lateness).groupBy("pair").transformWithState(
        _Decisions(span), T.StructType.fromDDL(DECIDED), "Append", "EventTime"
    )


DECIDED = "pair string, at bigint, tie string, max_requests int, allowed boolean"


class _Decisions(StatefulProcessor):
    """Requests of a pair in the order of their times, decided when the watermark has passed them."""

    def __init__(self, span: int):
        self.span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Waiting requests of one window length in chunks, named by their least time and the order of arrival.
        self.waiting = handle.getMapState("waiting", "least bigint, arrival bigint", "at array<bigint>, tie array<string>, max_requests array<int>")
        self.arrivals = handle.getValueState("arrivals", "n bigint")
        self.recent = handle.getValueState("recent", "times array<bigint>")

    def _wait(self, chunks: Iterable[Sequence[tuple]]) -> None:
        """Keep requests ``(at, tie, max_requests)``, each chunk of which lies in one window length."""
        n = self.arrivals.get()[0] if self.arrivals.exists() else 0
        for n, chunk in enumerate(chunks, n + 1):
            self.waiting.updateValue((min(c[0] for c in chunk), n), tuple(map(list, zip(*chunk))))
        self.arrivals.update((n,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        least, slots, held = None, defaultdict(list), 0
        for r in rows:
            at = r["at"]
            if at // 1000 <= mark and mark > 0:
                continue
            slots[at // self.span].append((at, r["tie"], r["max_requests"]))
            least, held = at if least is None else min(least, at), held + 1
            if held >= CHUNK_ROWS:
                self._wait(slots.values())
                slots, held = defaultdict(list), 0
        if held:
            self._wait(slots.values())
        if least is not None:
            self.handle.registerTimer(least // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Decide what is due, with the waiting requests of one window length in memory at a time."""
        mark = timerValues.getCurrentWatermarkInMs()
        chunks = sorted(tuple(c) for c in self.waiting.keys())
        recent = list(self.recent.get()[0]) if self.recent.exists() else []
        decided = Row("pair", "at", "tie", "max_requests", "allowed")
        for _, names in groupby(chunks, key=lambda c: c[0] // self.span):
            names = list(names)
            if names[0][0] // 1000 >= mark:
                self.handle.registerTimer(names[0][0] // 1000 + 1)
                break
            found = [request for name in names for request in zip(*self.waiting.getValue(name))]
            found.sort(key=lambda f: (f[0], _in_order(f[1])))
            due = bisect_left(found, mark * 1000, key=lambda f: f[0])
            for at, tie, top in found[:due]:
                recent = _seen(recent, at, top, self.span)
                allowed = len(recent) < top
                if allowed:
                    recent.append(at)
                yield decided(key[0], at, tie, top, allowed)
            for name in names:
                self.waiting.removeKey(name)
            if due < len(found):
                self._wait([found[due:]])
                self.handle.registerTimer(found[due][0] // 1000 + 1)
                break
        recent = [t for t in recent if t // 1000 + self.span // 1000 + 1 > mark]
        if recent:
            self.recent.update((recent,))
            self.handle.registerTimer(recent[-1] // 1000 + self.span // 1000 + 1)
        elif self.recent.exists():
            self.recent.clear()

    def close(self) -> None:
        pass


def _in_order(tie: str | None):
    """Numbers written as text in the order of numbers, before other texts; null first."""
    if tie is None:
        return (0, 0, "")
    try:
        return (1, float(tie), tie)
    except ValueError:
        return (2, 0, tie)
