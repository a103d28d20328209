"""Streams: landing of payloads, counts per window, service maps, traces, increments of metrics, their first series, and alert rules from logs to events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ListState
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.predicates import Term, log_filter, span_is_error
from ..functions.time import timestamp
from ..operators import trees
from ..operators.alerts import rule_hits, tick_slot
from ..schema import HOUR, NANOS
from ..sources import folders
from ..sources.payloads import flatten_logs
from ..sources.storage import hourly


def land_logs(payloads: DataFrame, path: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    """Flatten a stream of payloads (payload, received) into hourly Parquet, each row once.

    There is no watermark: a row belongs to the hour of its own time, however late it comes.
    """
    rows = hourly(flatten_logs(payloads), "logs")
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).partitionBy("date", "hour").outputMode("append").trigger(**trigger).start(path)


def window_counts(logs: DataFrame, terms: list[Term], window: str, every: str, grace: str = "5 minutes") -> DataFrame:
    """window_end, service_name, logs: matching logs of sliding windows. Rows later than the grace are not counted."""
    rows = logs.filter(log_filter(terms)).withColumn("at", timestamp("time_unix_nano")).withWatermark("at", grace)
    counts = rows.groupBy(F.window("at", window, every).alias("w"), "service_name").agg(F.count(F.lit(1)).alias("logs"))
    return counts.select(F.col("w.end").alias("window_end"), "service_name", "logs")


def service_edges(spans: DataFrame, within: str = "1 hour", grace: str = "5 minutes") -> DataFrame:
    """from_service, to_service, failed, at of calls between services in a stream of spans, each once both of its spans are there.

    A call starts within ``within`` of its caller; the state of older spans is dropped once the grace is over as well.
    """
    rows = spans.select("trace_id", "span_id", "parent_span_id", "service_name", span_is_error().alias("failed"), timestamp("start_time_unix_nano").alias("at")).withWatermark("at", grace)
    callers = rows.select(F.col("trace_id").alias("of_trace"), F.col("span_id").alias("caller"), F.col("service_name").alias("from_service"), F.col("at").alias("called_at"))
    near = (F.col("at") >= F.col("called_at") - F.expr(f"interval {within}")) & (F.col("at") <= F.col("called_at") + F.expr(f"interval {within}"))
    same = (F.col("trace_id") == F.col("of_trace")) & (F.col("parent_span_id") == F.col("caller"))
    calls = rows.filter("parent_span_id <> ''").join(callers, same & near)
    return calls.filter(F.col("from_service") != F.col("service_name")).select("from_service", F.col("service_name").alias("to_service"), "failed", "at")


def land_edges(spans: DataFrame, path: str, checkpoint: str, trigger: dict, within_ns: int = HOUR, grace_ns: int = 300 * NANOS) -> StreamingQuery:
    """Keep a service map up to date: each batch of spans adds its calls by pair of services and hour. A batch that is repeated replaces itself.

    The calls are those of ``service_edges``. A batch meets itself and the spans that later ones can still belong to, which are kept as files
    beside ``path`` (those of this and the last batch); the memory of the tasks bounds neither a batch nor what is kept.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark, kept = batch.sparkSession, f"{path}-recent/batch="
        came = batch.select("trace_id", "span_id", "parent_span_id", "service_name", F.coalesce(span_is_error(), F.lit(False)).alias("failed"), F.col("start_time_unix_nano").alias("t"), F.lit(False).alias("known"))
        if folders.exists(spark, f"{kept}{number - 1}"):
            known = spark.read.schema(came.schema).parquet(f"{kept}{number - 1}").withColumn("known", F.lit(True))
            over = known.agg(F.max("t")).first()[0]  # the newest span is always kept
            came = known.unionByName(came.filter(F.col("t") >= over - grace_ns) if over is not None else came)
        caller = [F.col(c).alias(f"of_{c}") for c in ("trace_id", "span_id", "service_name", "t", "known")]
        near = (F.col("trace_id") == F.col("of_trace_id")) & (F.col("parent_span_id") == F.col("of_span_id")) & (F.abs(F.col("t") - F.col("of_t")) <= within_ns)
        calls = came.filter("parent_span_id <> ''").join(came.select(*caller), near).filter("service_name <> of_service_name and not (known and of_known)")
        pair = [F.col("of_service_name").alias("from_service"), F.col("service_name").alias("to_service"), F.date_trunc("hour", timestamp("t")).alias("hour")]
        calls.groupBy(*pair).agg(F.count(F.lit(1)).alias("requests"), F.count_if("failed").alias("errors")).write.mode("overwrite").parquet(f"{path}/batch={number}")
        newest = came.agg(F.max("t")).first()[0]
        came.filter(F.col("t") >= (newest or 0) - grace_ns - within_ns).write.mode("overwrite").parquet(f"{kept}{number}")
        folders.delete(spark, f"{kept}{number - 2}")

    return spans.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**trigger).start()


_OPS = {">": np.greater, ">=": np.greater_equal, "<": np.less, "<=": np.less_equal}


def _moved(status: str, since: int, tick: int, high: bool, hold: int) -> tuple[str, int, str | None]:
    """Status and since when after a tick with a value, and the event if there is one."""
    if not high:
        return ("ok", since if status == "ok" else tick, "resolved" if status == "firing" else None)
    if status == "ok":
        status, since = "pending", tick
    if status == "pending" and tick - since >= hold:
        return "firing", tick, "firing"
    return status, since, None


class AlertStates(StatefulProcessor):
    """ok, pending, firing and resolved for each rule and group, from values in order of time; emits the events.

    A tick (``every`` ns after the one before) at which a group has no value ends its state; if it was firing it is resolved, with its
    last value. A later value tells so at once, otherwise the watermark does. Ticks not after the last one are left out.
    """

    def __init__(self, every: int):
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string, since bigint, last bigint, value double")

    def _gone(self, key: tuple) -> list[tuple]:
        status, _, last, value = self.state.get()
        self.state.clear()
        return [(*key, "resolved", last + self.every, value)] if status == "firing" else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        events = []
        for row in pd.concat(list(rows)).sort_values("tick").itertuples(index=False):
            if self.state.exists():
                last = self.state.get()[2]
                if row.tick <= last:
                    continue
                self.handle.deleteTimer((last + self.every) // 1_000_000)
                if row.tick - last > self.every:
                    events += self._gone(key)
            status, since, *_ = self.state.get() if self.state.exists() else ("ok", row.tick)
            status, since, event = _moved(status, since, row.tick, row.breached, row.hold)
            if event:
                events.append((*key, event, row.tick, row.value))
            self.state.update((status, int(since), int(row.tick), float(row.value)))
            self.handle.registerTimer((int(row.tick) + self.every) // 1_000_000)
        yield pd.DataFrame(events, columns=_EVENT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        yield pd.DataFrame(self._gone(key) if self.state.exists() else [], columns=_EVENT)

    def close(self) -> None:
        pass


_EVENT = ["rule_id", "group", "event", "at", "value"]


def alert_events(values: DataFrame, every: int, grace: str = "5 minutes") -> DataFrame:
    """Events of a stream of values (rule_id, group, tick, value, breached, hold: ns that a breach must last) that come ``every`` ns."""
    timed = values.withColumn("tick_at", timestamp("tick")).withWatermark("tick_at", grace)
    return timed.groupBy("rule_id", "group").transformWithStateInPandas(
        AlertStates(every), "rule_id string, `group` string, event string, at bigint, value double", outputMode="Append", timeMode="EventTime"
    )


class RuleStates(StatefulProcessor):
    """A rule and group from counts of matching logs to events: a ring of counts by slot, and a timer for the next tick.

    At a tick (each multiple of ``every`` ns) that the watermark has passed, the value is the sum of the slots in the window before it. A group
    without logs there has no value: a firing one is resolved with its last value, and nothing of it is kept until a log comes
    again. A rule without groups (``always``) has a value at every tick from the first log on, 0 if need be.
    """

    def __init__(self, every: int, slot: int):
        self.every, self.slot = every, slot

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "state", "next bigint, status string, since bigint, value double, slots array<bigint>, counts array<bigint>, `window` bigint, op string, threshold double, hold bigint, always boolean"
        )

    def _until(self, slot: int) -> int:
        """The first tick whose window can hold a slot."""
        return -(-(slot + self.slot) // self.every) * self.every

    def _timer(self, before: int | None, after: int | None) -> None:
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before // 1_000_000)
            if after is not None:
                self.handle.registerTimer(after // 1_000_000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        came = pd.concat(list(rows))
        known = came.iloc[-1]
        old = self.state.get() if self.state.exists() else None
        kept = dict(zip(old[4], old[5], strict=True)) if old else {}
        for slot, n in came.groupby("slot")["n"].sum().items():
            if n:
                kept[int(slot)] = kept.get(int(slot), 0) + int(n)
        first = self._until(int(came["slot"].min()))
        due = min(old[0], first) if old else first
        status, since, value = old[1:4] if old else ("ok", due, 0.0)
        rule = (int(known["window"]), str(known["op"]), float(known["threshold"]), int(known["hold"]), bool(known["always"]))
        self.state.update((due, status, since, value, [*kept], [*kept.values()], *rule))
        self._timer(old[0] if old else None, due)
        yield pd.DataFrame([], columns=_EVENT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        events = self._ticks(key, timerValues.getCurrentWatermarkInMs() * 1_000_000) if self.state.exists() else []
        yield pd.DataFrame(events, columns=_EVENT)

    def _ticks(self, key: tuple, now: int) -> list[tuple]:
        """All ticks up to ``now``."""
        due, status, since, value, slots, counts, window, op, threshold, hold, always = self.state.get()
        begun, events = due, []
        order = np.argsort(np.asarray(slots, np.int64))
        at, upto = np.asarray(slots, np.int64)[order], np.concatenate(([0], np.cumsum(np.asarray(counts, np.int64)[order])))
        while due is not None and due <= now:
            low, high = np.searchsorted(at, (due - window, due - self.slot + 1))
            n = float(upto[high] - upto[low])
            if n or always:
                breached = bool(_OPS[op](n, threshold)) if op in _OPS else False
                status, since, event = _moved(status, since, due, breached, hold)
                value = n
                due_next = due + self.every
            else:
                event, status, since = ("resolved" if status == "firing" else None), "ok", due
                due_next = self._until(int(at[high])) if high < len(at) else None
            if event:
                events.append((*key, event, due, value))
            due = due_next
        if due is None:
            self.state.clear()
        else:
            left = at >= due - window
            self.state.update((due, status, since, value, at[left].tolist(), np.diff(upto)[left].tolist(), window, op, threshold, hold, always))
            self.handle.registerTimer(due // 1_000_000)
        return events

    def close(self) -> None:
        pass


def rule_events(logs: DataFrame, rules: DataFrame, every: int, grace_ns: int = 5 * 60 * 10**9) -> DataFrame:
    """rule_id, group, event, at, value: what the enabled log ``rules`` (a table) make of a stream of ``logs``, evaluated every ``every`` ns of event time.

    A tick is evaluated once the grace is over; later logs are not counted. Matches are counted by rule, group and slot in each batch of rows
    before they are shuffled, so that of a busy group a task gets a row per batch and slot. Rules without groups are told of the time
    by every batch, matching or not. Equal to ``alert_backtest`` over ``log_rule_ticks`` of the same logs, up to the last tick evaluated.
    """
    slot = tick_slot(rules, every)
    always = rules.filter("enabled and kind = 'logs' and size(group_by) = 0").selectExpr("id", "window_seconds * 1000000000L", "op", "threshold", "for_seconds * 1000000000L").collect()  # a row per rule
    hits = rule_hits(logs, rules, all_logs=bool(always)).withColumn("slot", F.expr(f"time_unix_nano div {slot}L * {slot}L")).drop("time_unix_nano")
    idle = [(rule[0], "", *rule[1:]) for rule in always]
    ungrouped, columns = [rule[0] for rule in always], ["rule_id", "group", "window", "op", "threshold", "hold", "slot", "n"]

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            found = batch.dropna(subset=["rule_id"])
            out = [found.groupby([*columns[:-1]], as_index=False).size().rename(columns={"size": "n"})] if len(found) else []
            if idle:
                ends = sorted({int(batch["slot"].min()), int(batch["slot"].max())})
                out.append(pd.DataFrame([(*rule, end, 0) for rule in idle for end in ends], columns=columns))
            if out:
                both = pd.concat(out, ignore_index=True)
                yield both.assign(always=both["rule_id"].isin(ungrouped))[[*columns, "always"]]

    counts = hits.mapInPandas(counted, "rule_id string, `group` string, `window` bigint, op string, threshold double, hold bigint, slot bigint, n bigint, always boolean")
    # a slot's time is its end, so that none is left out before a tick that counts it has been evaluated
    timed = counts.withColumn("ends", F.timestamp_micros(F.expr(f"(slot + {slot}L) div 1000L"))).withWatermark("ends", f"{(grace_ns + slot) // 1_000_000} milliseconds")
    return timed.groupBy("rule_id", "group").transformWithStateInPandas(
        RuleStates(every, slot), "rule_id string, `group` string, event string, at bigint, value double", outputMode="Append", timeMode="EventTime"
    )


_POINT_NAMES = ["start_time_unix_nano", "time_unix_nano", "value", "count", "sum", "explicit_bounds", "bucket_counts"]
#: Groups of series by a hash, each with one state, and the most points in one piece.
PARTS, PIECE = 256, 100_000


def _piece(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _table(piece: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(piece)).read_all()


def _pieces(table: pa.Table) -> list[bytes]:
    return [_piece(table.slice(k, PIECE)) for k in range(0, len(table), PIECE)]


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, newest, points: the rows of a task in pieces, so that no row of its own goes through the stateful step."""

    def pieces(kept: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(kept)
        rows = rows.take(np.argsort(rows["part"].to_numpy(), kind="stable"))
        parts, first = np.unique(rows["part"].to_numpy(), return_index=True)
        cut = [rows.slice(k, n).drop_columns("part") for k, n in zip(first, np.diff(np.r_[first, len(rows)]), strict=True)]
        newest = pa.array([pc.max(x["time_unix_nano"]).as_py() for x in cut], pa.int64())
        return pa.record_batch({"part": pa.array(parts, pa.int64()), "newest": newest, "points": pa.array(map(_piece, cut), pa.binary())})

    kept, size = [], 0
    for batch in batches:
        kept.append(batch)
        size += len(batch)
        if size >= PIECE:
            yield pieces(kept)
            kept, size = [], 0
    if size:
        yield pieces(kept)


def _in_order(points: pa.Table, keys: list[str]) -> pa.Table:
    """Points by series and time; those of one time by start, then value or count and sum and buckets, as in the batch operators."""
    names = [*keys, "time_unix_nano", "start_time_unix_nano", "value", "count", "sum"]
    above = lambda c: pc.fill_null(pc.is_nan(points[c]), False)  # noqa: E731  (NaN is above all others, as in Spark)
    columns = [*(points[c] for c in names[:-3]), above("value"), points["value"], points["count"], above("sum"), points["sum"]]
    order = pa.table(columns, [f"c{k}" for k in range(len(columns))])
    points = points.take(pc.sort_indices(order, sort_keys=[(c, "ascending") for c in order.column_names], null_placement="at_start"))
    alike = ~_differs(points, names)
    if not alike.any() or not (alike & pc.is_valid(points["bucket_counts"]).to_numpy()).any():
        return points
    buckets, place = points["bucket_counts"].to_pylist(), np.arange(len(points))
    first = np.flatnonzero(~alike)
    for low, high in zip(first, np.r_[first[1:], len(points)], strict=True):
        if high - low > 1:
            place[low:high] = sorted(range(low, high), key=lambda k: [(x is not None, x or 0) for x in buckets[k] or []])
    return points.take(place)


def _differs(points: pa.Table, names: list[str]) -> np.ndarray:
    """Whether a row is other than the one before it in any of the columns ``names``; null is like null."""
    out = np.zeros(len(points), bool)
    out[:1] = True
    for name in names:
        number = points[name].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        out[1:] |= number[1:] != number[:-1]
    return out


def _less(now: pa.Table, before: pa.Table) -> pa.Table:
    """``now`` with what each point adds to the one of ``before`` in its place: all of it after a reset (another start, or a lower value or count)."""
    is_so = lambda x: pc.fill_null(x, False)
    going_on = is_so(pc.equal(now["start_time_unix_nano"], before["start_time_unix_nano"]))
    value, old = now["value"], before["value"]
    lower = pc.or_(pc.less(value, old), pc.and_(pc.is_nan(old), pc.invert(pc.is_nan(value))))
    grown = pc.if_else(pc.or_(pc.invert(going_on), is_so(lower)), value, pc.subtract(value, old))
    counted = pc.and_(going_on, is_so(pc.greater_equal(now["count"], before["count"])))
    less = lambda c: pc.if_else(counted, pc.subtract(now[c], before[c]), now[c])
    buckets, old = now["bucket_counts"].combine_chunks(), before["bucket_counts"].combine_chunks()
    same = pc.and_(counted, is_so(pc.equal(pc.list_value_length(buckets), pc.list_value_length(old)))).to_numpy()
    if same.any():
        mine, other = buckets.filter(pa.array(same)), old.filter(pa.array(same))
        offsets = np.r_[0, np.cumsum(pc.list_value_length(mine).to_numpy())].astype(np.int32)
        rest = pa.ListArray.from_arrays(offsets, pc.subtract(mine.flatten(), other.flatten()), type=buckets.type)
        buckets = pa.concat_arrays([buckets, rest]).take(pa.array(np.where(same, len(buckets) + np.cumsum(same) - 1, np.arange(len(buckets)))))
    for name, column in (("value", grown), ("count", less("count")), ("sum", less("sum")), ("bucket_counts", buckets)):
        at = now.schema.get_field_index(name)
        now = now.set_column(at, now.schema.field(at), column)
    return now


class Increments(StatefulProcessor):
    """Points of a part of all cumulative series in order of time, however they come, each as what it adds to the one before in its series.

    Points wait in pieces until the watermark has passed their time; then no earlier one is taken. The last ones that left are
    kept, so that resets are seen across batches. A series without a point for more than ``idle`` ns begins anew, and is forgotten. What a
    series costs is rows of a table, not calls to the state store.
    """

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.about = handle.getValueState("about", "timer bigint, done bigint")  # ms; of points up to done all have left
        self.last = handle.getListState("last", "points binary")
        self.waiting = handle.getListState("waiting", "points binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        timer, done = self.about.get() if self.about.exists() else (None, None)
        came = pa.concat_tables([_table(piece) for part in rows for piece in part["points"]])
        micros = came["time_unix_nano"].to_numpy() // 1000
        if done is not None:
            came, micros = came.filter(pa.array(micros > done * 1000)), micros[micros > done * 1000]
        if len(came):
            self.waiting.appendList([(piece,) for piece in _pieces(came)])
            first = _before(micros.min())
            if timer is None or first < timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(first)
                self.about.update((first, done))
        yield pd.DataFrame([], columns=["points"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        known = lambda state: [_table(piece) for (piece,) in state.get()] if state.exists() else []
        waiting, last, out, timer = known(self.waiting), known(self.last), [], []
        if waiting:
            points = pa.concat_tables(waiting)
            ready = points["time_unix_nano"].to_numpy() // 1000 <= now * 1000
            rest = points.filter(pa.array(~ready))
            if ready.any():
                told, last = self._told(pa.concat_tables([*last, points.filter(pa.array(ready))]), sum(map(len, last)))
                out, last = _pieces(told), [last]
                self._put(self.waiting, rest)
            if len(rest):
                timer.append(_before(rest["time_unix_nano"].to_numpy().min() // 1000))
        if last:
            left = pa.concat_tables(last)
            forget = (left["time_unix_nano"].to_numpy() + self.idle) // 1_000_000
            left = left.filter(pa.array(forget > now))
            self._put(self.last, left)
            if len(left) and not timer:
                timer.append(int(forget[forget > now].min()))
        for at in timer:
            self.handle.registerTimer(at)
        self.about.update((timer[0] if timer else None, now))
        yield pd.DataFrame({"points": out}, columns=["points"])

    def _told(self, points: pa.Table, known: int) -> tuple[pa.Table, pa.Table]:
        """What all but the first ``known`` points add, and the last point of each series."""
        keys = [c for c in points.column_names if c not in _POINT_NAMES]
        mark = points.append_column("told", pa.array(np.arange(len(points)) < known))
        points = _in_order(mark, keys)
        begins = _differs(points, keys) if keys else np.arange(len(points)) == 0
        time, told = points["time_unix_nano"].to_numpy(), points["told"].to_numpy()
        points = points.drop_columns("told")
        follows = ~begins & ~told & (np.diff(time, prepend=time[:1]) <= self.idle)
        at = np.flatnonzero(follows)
        return _less(points.take(at), points.take(at - 1)), points.take(np.flatnonzero(np.r_[begins[1:], True]))

    @staticmethod
    def _put(state: ListState, points: pa.Table) -> None:
        if len(points):
            state.put([(piece,) for piece in _pieces(points)])
        else:
            state.clear()

    def close(self) -> None:
        pass


def _before(micros: int) -> int:
    """The timer (ms) that expires with the first watermark that has passed a time: one expires when the watermark is above it."""
    return int(-(-int(micros) // 1000) - 1)


def live_increments(points: DataFrame, keys: list[str], grace: str = "5 minutes", idle: str = "1 day") -> DataFrame:
    """``keys`` and the columns of a point, of a stream of cumulative ``points``: each as what it adds to the one before in its series.

    ``keys`` tell series apart and are carried along (so may be constants of a series, as a service). ``value`` is a counter's increment; count, sum
    and bucket_counts are those of histograms. A series' first point adds nothing and is left out. Points that come in any order within the
    grace give the increments of ``metrics.counter_increments`` and ``metrics.distribution_increments``; later ones are left out, unless none of their
    part of the series has been told of beyond them. Delta points and summaries need no state: they are increments. What waits of one of ``PARTS`` groups of series has to fit a task.
    """
    names = [f"k{n}" for n in range(len(keys))]
    part = F.pmod(F.xxhash64(*keys), F.lit(PARTS)).alias("part")
    rows = points.select(part, *(F.col(k).alias(name) for name, k in zip(names, keys, strict=True)), *_POINT_NAMES)
    kinds = dict(rows.drop("part").dtypes)
    seconds = points.sparkSession.sql(f"SELECT unix_micros(timestamp_seconds(0) + interval {idle}) * 1000").first()[0]
    pieces = rows.mapInArrow(_by_part, "part bigint, newest bigint, points binary").withColumn("at", timestamp("newest")).withWatermark("at", grace)
    found = pieces.groupBy("part").transformWithStateInPandas(Increments(seconds), "points binary", outputMode="Append", timeMode="EventTime")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in batch.column("points").to_pylist():
                yield from _table(piece).to_batches()

    return found.mapInArrow(opened, ", ".join(f"{name} {kind}" for name, kind in kinds.items())).withColumnsRenamed(dict(zip(names, keys, strict=True)))


_SPAN = "span_id string, parent_span_id string, service_name string, name string, start_time_unix_nano bigint, end_time_unix_nano bigint, status_code string, status_message string"
_SPAN_NAMES = [c.split()[0] for c in _SPAN.split(", ")]
_TRACE = (
    "trace_id string, revision int, root_service string, root_name string, start bigint, duration bigint, spans bigint, errors bigint, services array<string>, "
    "origins array<struct<span_id:string,service_name:string,name:string,status_message:string,start_time_unix_nano:bigint>>"
)
_TRACE_NAMES = [c.split()[0] for c in _TRACE.split(", ")]


#: Groups of traces by a hash, each with one state: what a trace costs is rows of a table, not calls to the state store.
BUCKETS = 1024


def _packed(rows: pd.DataFrame) -> bytes:
    return _piece(pa.Table.from_pandas(rows, preserve_index=False))


def _unpacked(data: bytes) -> pd.DataFrame:
    return _table(data).to_pandas()


_NO_TRACES = pd.DataFrame({"trace_id": pd.Series(dtype=str), **{c: pd.Series(dtype="int64") for c in ("newest", "revision", "born", "spans")}, "told": pd.Series(dtype=bool)})


class Traces(StatefulProcessor):
    """The spans of a bucket of traces, each trace told of when no more have come for ``quiet`` ns, and again if some come later; forgotten after ``keep`` ns without any.

    New spans are only appended to the state as one piece. When the first trace is due, the pieces that came since and, if a trace is told of again, those of before are
    read; a span that comes again replaces itself. What is forgotten leaves the pieces once it is over half of them; until then pieces older than a trace's
    beginning (``born``, counted in forgettings) are not its own.
    """

    def __init__(self, quiet: int, keep: int):
        self.quiet, self.keep = quiet, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.about = handle.getValueState("about", "traces binary, timer bigint, age bigint, kept bigint")
        self.fresh = handle.getListState("fresh", "spans binary")
        self.told = handle.getListState("told", "age bigint, spans binary")

    def _known(self) -> tuple[pd.DataFrame, int | None, int, int]:
        if not self.about.exists():
            return _NO_TRACES, None, 0, 0
        traces, *rest = self.about.get()
        return _unpacked(traces), *rest

    def _due(self, traces: pd.DataFrame) -> pd.Series:
        return (traces["newest"] + np.where(traces["told"], self.keep, self.quiet)) // 1_000_000

    def _set(self, traces: pd.DataFrame, timer: int | None, age: int, kept: int) -> None:
        at = int(self._due(traces).min())
        if timer is not None and timer != at:
            self.handle.deleteTimer(timer)
        if timer != at:
            self.handle.registerTimer(at)
        self.about.update((_packed(traces), at, age, kept))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        traces, timer, age, kept = self._known()
        came = pd.concat(list(rows), ignore_index=True)
        self.fresh.appendValue((_packed(came[["trace_id", *_SPAN_NAMES]]),))
        seen = came.groupby("trace_id", as_index=False).agg(newest=("arrived", "max")).assign(revision=0, born=age, spans=0, told=False)
        both = pd.concat([traces, seen], ignore_index=True) if len(traces) else seen
        columns = dict(newest=("newest", "max"), revision=("revision", "max"), born=("born", "min"), spans=("spans", "max"), told=("told", "min"))
        self._set(both.groupby("trace_id", as_index=False).agg(**columns), timer, age, kept)
        yield pd.DataFrame([], columns=_TRACE_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        out = pd.DataFrame([], columns=_TRACE_NAMES)
        if self.about.exists():
            traces, timer, age, kept = self._known()
            now = timerValues.getCurrentWatermarkInMs()
            due = ~traces["told"] & ((traces["newest"] + self.quiet) // 1_000_000 <= now)
            if due.any():
                out, traces, more = self._tell(traces, due, age)
                kept += more
            gone = traces["told"] & ((traces["newest"] + self.keep) // 1_000_000 <= now)
            if gone.any():
                traces, age = traces[~gone].reset_index(drop=True), age + 1
                if 2 * traces["spans"].sum() < kept:
                    kept = self._rid(traces, age)
            if len(traces):
                self._set(traces, None if timer <= now else timer, age, kept)
            else:
                for state in (self.about, self.fresh, self.told):
                    state.clear()
        yield out

    def _pieces(self, traces: pd.DataFrame) -> list[pd.DataFrame]:
        """The spans told of before, of ``traces`` alone."""
        born = traces.set_index("trace_id")["born"]
        pieces = ((age, _unpacked(spans)) for age, spans in self.told.get()) if self.told.exists() else ()
        return [p[p["trace_id"].map(born).le(age)] for age, p in pieces]

    def _tell(self, traces: pd.DataFrame, due: pd.Series, age: int) -> tuple[pd.DataFrame, pd.DataFrame, int]:
        fresh = pd.concat([_unpacked(spans) for (spans,) in self.fresh.get()], ignore_index=True)
        mine = fresh["trace_id"].isin(traces.loc[due, "trace_id"])
        came, rest = fresh[mine], fresh[~mine]
        again = traces[due & (traces["revision"] > 0)]
        traces = traces.assign(told=traces["told"] | due, revision=traces["revision"] + due, spans=traces["spans"] + traces["trace_id"].map(came["trace_id"].value_counts()).fillna(0).astype("int64"))
        out = _told(pd.concat([*(self._pieces(again) if len(again) else ()), came]), traces.set_index("trace_id")["revision"])
        self.told.appendValue((age, _packed(came)))
        self.fresh.put([(_packed(rest),)]) if len(rest) else self.fresh.clear()
        return out, traces, len(came)

    def _rid(self, traces: pd.DataFrame, age: int) -> int:
        """Leave in the pieces what is not forgotten."""
        left = [p for p in self._pieces(traces) if len(p)]
        self.told.put([(age, _packed(pd.concat(left)))]) if left else self.told.clear()
        return sum(map(len, left))

    def close(self) -> None:
        pass


def _told(spans: pd.DataFrame, revisions: pd.Series) -> pd.DataFrame:
    """A row for each trace of ``spans``."""
    s = spans.drop_duplicates(["trace_id", "span_id"], keep="last").sort_values(["trace_id", "start_time_unix_nano", "span_id"], ignore_index=True)
    trace = trees.trace_numbers(pa.array(s["trace_id"], pa.string()))
    first = np.flatnonzero(np.diff(trace, prepend=-1))
    span, parent = trees.span_numbers(trace, pa.array(s["span_id"], pa.string()), pa.array(s["parent_span_id"], pa.string()))
    failed = (s["status_code"] == "Error").to_numpy()
    origin = failed & ~trees.above(span, parent, failed)[span]
    root, at = first.copy(), np.flatnonzero((s["parent_span_id"] == "").to_numpy())[::-1]
    root[trace[at]] = at  # the first of them comes last
    start, end = s["start_time_unix_nano"].to_numpy(), np.maximum.reduceat(s["end_time_unix_nano"].to_numpy(), first)
    named = pd.DataFrame({"trace": trace, "service": s["service_name"]}).drop_duplicates().sort_values(["trace", "service"])
    services = [list(x) for x in np.split(named["service"].to_numpy(object), np.flatnonzero(np.diff(named["trace"].to_numpy())) + 1)]
    origins: list[list[dict]] = [[] for _ in first]
    shown = ["span_id", "service_name", "name", "status_message", "start_time_unix_nano"]
    for n, o in zip(trace[origin], s.loc[origin, shown].to_dict("records"), strict=True):
        origins[n].append(o)
    ids = s["trace_id"].to_numpy(object)[first]
    return pd.DataFrame(
        {
            "trace_id": ids, "revision": revisions.reindex(ids).to_numpy(), "root_service": s["service_name"].to_numpy(object)[root], "root_name": s["name"].to_numpy(object)[root], "start": start[first],
            "duration": end - start[first], "spans": np.diff(np.r_[first, len(s)]), "errors": np.add.reduceat(failed.astype("int64"), first), "services": services, "origins": origins,
        }
    )


def live_traces(spans: DataFrame, quiet: str = "30 seconds", keep: str = "1 hour", grace: str = "10 seconds", arrived: str = "start_time_unix_nano") -> DataFrame:
    """trace_id, revision, and what ``traces.search_traces`` and ``traces.error_origins`` tell of the trace, in a stream of spans.

    A trace is told of once no span of it has come for ``quiet``, by the time in ``arrived`` (ns; best when a span was received, since then spans that are late by
    their own time are not left out). Spans that come after that make it told again, as the next revision, for as long as ``keep`` after
    the last one; the highest revision holds. In state are the ids, names and times of a trace's spans, no attributes; those of one of ``BUCKETS`` groups of traces have to fit a task.
    """
    lengths = [spans.sparkSession.sql(f"SELECT unix_micros(timestamp_seconds(0) + interval {x}) * 1000").first()[0] for x in (quiet, keep)]
    rows = spans.select("trace_id", *_SPAN_NAMES, F.col(arrived).alias("arrived"), timestamp(arrived).alias("at")).withWatermark("at", grace)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("trace_id"), F.lit(BUCKETS)))
    return rows.groupBy("bucket").transformWithStateInPandas(Traces(*lengths), _TRACE, outputMode="Append", timeMode="EventTime")


def latest_traces(told: DataFrame) -> DataFrame:
    """The highest revision of each trace in what ``live_traces`` has written."""
    rest = [c for c in told.columns if c not in ("trace_id", "revision")]
    return told.groupBy("trace_id").agg(F.max_by(F.struct("revision", *rest), "revision").alias("t")).select("trace_id", "t.*")


#: Parts into which the series of a metric are split by a hash.
SALTS = 64
#: The part that tells of the time alone.
_CLOCK = -1
_FIRST = "metric_name string, salt int, series_id bigint, first bigint"
_FIRST_NAMES = [c.split()[0] for c in _FIRST.split(", ")]


class FirstSeries(StatefulProcessor):
    """The first ``limit`` series of a part of a metric, told in order of their first points once the watermark has passed these.

    In state are the ids told and, of those that wait, as many as can still be told; once ``limit`` have been told, nothing but that.
    """

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "full boolean, told array<bigint>, firsts array<bigint>, waiting array<bigint>, timer bigint")

    def _set(self, told: list[int], waiting: dict[int, int], timer: int | None) -> None:
        left = sorted((first, series) for series, first in waiting.items())[: self.limit - len(told)]
        if len(told) >= self.limit:
            self.state.update((True, [], [], [], None))
            return
        at = left[0][0] // 1_000_000 + 1 if left else None
        if timer is not None and timer != at:
            self.handle.deleteTimer(timer)
        if at is not None and timer != at:
            self.handle.registerTimer(at)
        self.state.update((False, told, [f for f, _ in left], [s for _, s in left], at))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        full, told, firsts, ids, timer = self.state.get() if self.state.exists() else (False, [], [], [], None)
        if not full and key[1] != _CLOCK:
            known, waiting = set(told), dict(zip(ids, firsts, strict=True))
            now = timerValues.getCurrentWatermarkInMs() * 1_000_000
            for part in rows:
                for series, first in zip(part["series_id"].tolist(), part["first"].tolist(), strict=True):
                    if series not in known:
                        waiting[series] = min(waiting.get(series, first), first) if first >= now or series in waiting else now
            self._set(list(told), waiting, timer)
        yield pd.DataFrame([], columns=_FIRST_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        out = []
        if self.state.exists() and not self.state.get()[0]:
            _, told, firsts, ids, timer = self.state.get()
            now = timerValues.getCurrentWatermarkInMs()
            due = [(f, s) for f, s in zip(firsts, ids, strict=True) if f // 1_000_000 < now]
            out = [(*key, s, f) for f, s in due]
            told, waiting = [*told, *(s for _, s in due)], {s: f for f, s in list(zip(firsts, ids, strict=True))[len(due) :]}
            self._set(told, waiting, None if timer is not None and timer <= now else timer)
        yield pd.DataFrame(out, columns=_FIRST_NAMES)

    def close(self) -> None:
        pass


def first_series(points: DataFrame, limit: int, grace: str = "5 minutes") -> DataFrame:
    """metric_name, salt, series_id, first: of each part of a metric in a stream of ``points`` its first ``limit`` series. ``admitted`` makes one limit of these.

    A series that is among a metric's first is among those of its part, so no more than ``SALTS`` times the limit is ever told of a
    metric. Each task reduces its rows to the first ``limit`` series of a part before they are shuffled. A series whose first point is later
    than the grace counts from when it came.
    """
    salt = F.pmod(F.xxhash64("series_id"), F.lit(SALTS)).cast("int")
    rows = points.filter("metric_name is not null and series_id is not null").select("metric_name", salt.alias("salt"), "series_id", F.col("time_unix_nano").alias("first"), F.col("time_unix_nano").alias("newest"))
    part, columns = ["metric_name", "salt"], [*_FIRST_NAMES, "newest"]

    def merged(frames: list[pd.DataFrame]) -> pd.DataFrame:
        both = pd.concat(frames, ignore_index=True).groupby([*part, "series_id"], as_index=False).agg(first=("first", "min"), newest=("newest", "max"))
        return both.sort_values(["first", "series_id"]).groupby(part).head(limit)

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, size, newest = [], 0, None
        for batch in batches:
            if len(batch):
                newest = max(newest or 0, int(batch["newest"].max()))
                kept.append(batch)
                if sum(map(len, kept)) > max(2 * size, 50_000):
                    kept = [merged(kept)]
                    size = len(kept[0])
        if kept:
            yield merged(kept)[columns]
            yield pd.DataFrame([("", _CLOCK, 0, newest, newest)], columns=columns)  # the time, whatever was left out

    firsts = rows.mapInPandas(reduced, f"{_FIRST}, newest bigint").withColumn("at", timestamp("newest")).withWatermark("at", grace)
    return firsts.groupBy("metric_name", "salt").transformWithStateInPandas(FirstSeries(limit), _FIRST, outputMode="Append", timeMode="EventTime")


def admitted(told: DataFrame, limit: int) -> DataFrame:
    """metric_name, series_id of the first ``limit`` series of each metric, from what ``first_series`` has written; equal to those of ``metrics.cardinality_guard``.

    A later series is told of no sooner than an earlier one, so whatever has been written so far is a beginning of the whole. A metric has at most ``SALTS``
    times the limit rows here.
    """
    rank = F.row_number().over(Window.partitionBy("metric_name").orderBy("first", "series_id"))
    return told.withColumn("rank", rank).filter(F.col("rank") <= limit).select("metric_name", "series_id")
