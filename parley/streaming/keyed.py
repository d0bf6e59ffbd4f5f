"""Streams with state and event-time timers of their own, per key.

State is in RocksDB and travels with its rows in Arrow batches. Keys are dealt into groups by
their hash, and a group's keys share one state and one call to Python, as a call for each key would
cost far more than its rows. What a key holds ends with its last timer, so that state is bounded by
what is still open: bursts not yet settled, promises not yet kept, calls not yet done. Times are in
microseconds inside the state, timers in milliseconds.
"""

from __future__ import annotations

import bisect
import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parley.operators import calls

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _micros(interval: str) -> int:
    """Length of an interval such as `30 minutes` or `24 HOURS`."""
    number, unit = interval.split()
    return int(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.lower().rstrip("s")] * 1_000_000


def _after(micros: int) -> int:
    """The first millisecond at which a watermark has reached an instant."""
    return -(-micros // 1000)


def _int(text: str | None) -> int | None:
    return None if text is None else int(text)


def _texts(column: pd.Series) -> list[str | None]:
    return [x if isinstance(x, str) else None for x in column.tolist()]


#: (key, held, rows, watermark in ms) to (what to hold or None, timer in ms or None, rows given out)
Step = Callable[[object, tuple | None, list[tuple], int], tuple[tuple | None, int | None, list[tuple]]]


#: groups that keys are dealt into; fixed for a checkpoint, since a group's number is its key in the state store.
#: A group's new rows and what its keys hold are in memory at once, so larger streams need more
GROUPS = 1024


class _Group:
    """``step`` on every key of a group that has rows or whose timer the watermark has reached."""

    def __init__(self, step: Step):
        self.step = step

    def __call__(self, held: bytes | None, rows: dict[object, list[tuple]], now: int) -> tuple[bytes | None, int | None, list[tuple]]:
        """What the group holds from now on, its first timer, and the rows given out; ``rows`` are the new ones by key."""
        # what each key holds, with its timer
        keys: dict[object, tuple[tuple, int | None]] = pickle.loads(held) if held else {}
        due = [k for k, (_, timer) in keys.items() if timer is not None and timer <= now and k not in rows]
        given: list[tuple] = []
        for key in (*rows, *due):
            rest, timer, out = self.step(key, keys[key][0] if key in keys else None, rows.get(key, []), now)
            given += out
            if rest is not None:
                keys[key] = rest, timer
            else:
                keys.pop(key, None)
        timers = [timer for _, timer in keys.values() if timer is not None]
        return pickle.dumps(keys) if keys else None, min(timers, default=None), given


def _stateful(rows: DataFrame, key: str, at: str, columns: list[str], out: str, mode: str, step: Step, groups: int = GROUPS) -> DataFrame:
    """``step`` on every key that has rows or whose timer the watermark has reached.

    The key and ``columns`` reach it as texts, since a null would make a number of pandas a double.
    """
    names = [f.split()[0] for f in out.split(", ")]
    named = str if isinstance(rows.schema[key].dataType, Ty.StringType) else int
    group_of = _Group(step)

    def run(_: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.getCurrentWatermarkMs()
        new: dict[object, list[tuple]] = {}
        for f in () if held.hasTimedOut else frames:
            for k, *r in zip(*(_texts(f[c]) for c in ("__key", *columns))):
                new.setdefault(named(k), []).append(tuple(r))
        rest, timer, given = group_of(bytes(held.get[0]) if held.exists else None, new, now)
        if rest is not None:
            held.update((rest,))
            if timer is not None:
                # fires once the watermark is beyond it
                held.setTimeoutTimestamp(max(timer - 1, now))
        elif held.exists:
            held.remove()
        if given:
            yield pd.DataFrame(given, columns=names, dtype=object)

    group = F.pmod(F.xxhash64(key), F.lit(groups)).alias("__group")
    some = rows.select(group, F.col(key).cast("string").alias("__key"), at, *(F.col(c).cast("string").alias(c) for c in columns))
    return some.groupBy("__group").applyInPandasWithState(run, out, "held binary", mode, GroupStateTimeout.EventTimeTimeout)


class _Debounce:
    """Waits until no arrival has come for the gap, then names the last one.

    Holds the bursts not settled: first and last time, and the last arrival.
    """

    def __init__(self, gap: int):
        self.gap = gap

    def _merged(self, bursts: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        out: list[tuple[int, int, int]] = []
        for first, last, raw_id in sorted(bursts):
            if out and first - out[-1][1] <= self.gap:
                begun, *end = out.pop()
                out.append((begun, *max(tuple(end), (last, raw_id))))
            else:
                out.append((first, last, raw_id))
        return out

    def _due(self, burst: tuple[int, int, int]) -> int:
        return _after(burst[1] + self.gap + 1)

    def __call__(self, key, held, rows: list[tuple], now: int):
        bursts = self._merged([tuple(b) for b in (held[0] if held else ())] + [(int(at), int(at), int(raw_id)) for raw_id, at in rows])
        settled = [b for b in bursts if self._due(b) <= now]
        rest = bursts[len(settled):]
        given = [(key, raw_id, last, last + self.gap) for _, last, raw_id in settled]
        # a timer for the first of them
        return ((rest,), self._due(rest[0]), given) if rest else (None, None, given)


def settled_arrivals(arrivals: DataFrame, gap: str = "1 minute", lateness: str = "10 minutes", groups: int = GROUPS) -> DataFrame:
    """(external_ref, raw_id, last_at, settled_at): arrivals that nothing of their thread followed within ``gap``.

    ``arrivals`` has external_ref, raw_id and received_at. Each arrival puts the thread's
    timer off; it fires on event time, and what fired is no longer held.
    """
    use_rocksdb(arrivals.sparkSession)
    named = arrivals.withWatermark("received_at", lateness)
    # names the event time, so that rows without a key still move the watermark
    named = named.where("external_ref IS NOT NULL OR received_at IS NULL")
    rows = named.select("external_ref", "raw_id", "received_at", F.unix_micros("received_at").alias("at"))
    out = "external_ref string, raw_id long, last_at long, settled_at long"
    marks = _stateful(rows, "external_ref", "received_at", ["raw_id", "at"], out, "append", _Debounce(_micros(gap)), groups)
    return marks.withColumns({c: F.timestamp_micros(c) for c in ("last_at", "settled_at")})


class _Promises:
    """Matches the promises made to a customer with the next contact of the same agent, in event time.

    Holds promises and contacts alike: agent, time, follow-up id, due time, whether it was missed, and contact id.
    """

    def __init__(self, grace: int, expiry: int, forget: int | None):
        self.grace, self.expiry, self.forget = grace, expiry, forget

    def _lapse(self, at: int, due: int | None) -> int:
        return due if due is not None else at + self.expiry

    def _next(self, line: list[tuple]) -> int | None:
        """The first instant at which something of ``line`` becomes certain."""
        times = []
        for _, at, number, due, missed, _ in line:
            if number is None:
                times.append(at)
            elif not missed:
                times.append(self._lapse(at, due) + 1)
            elif self.forget is not None:
                times.append(self._lapse(at, due) + self.forget + 1)
        return _after(min(times)) if times else None

    def __call__(self, key, held, rows: list[tuple], watermark: int):
        now = watermark * 1000
        new = [(int(agent), int(at), _int(number), _int(due), False, contact) for agent, at, number, due, contact in rows]
        given = [self._row(key, agent, number, at, due, "open") for agent, at, number, due, _, _ in new if number is not None]
        # a promise still to come is made after the settled contacts, which so are needed no more
        contacts: dict[int, list[tuple[int, str]]] = {}
        promises, rest = [], []
        for r in [tuple(r) for r in (held[0] if held else ())] + new:
            if r[2] is not None:
                promises.append(r)
            elif r[1] <= now:
                contacts.setdefault(r[0], []).append((r[1], r[5]))
            else:
                rest.append(r)
        for met in contacts.values():
            met.sort()
        for agent, at, number, due, missed, _ in promises:
            line = contacts.get(agent, [])
            i = bisect.bisect_right(line, at, key=lambda c: c[0])
            lapse = self._lapse(at, due)
            if i < len(line):
                met, by = line[i]
                deadline = due if due is not None else at + self.grace
                given.append(self._row(key, agent, number, at, due, "fulfilled" if met <= deadline else "late", met, by))
                continue
            if lapse < now and not missed:
                missed = True
                given.append(self._row(key, agent, number, at, due, "missed"))
            if not (missed and self.forget is not None and lapse + self.forget < now):
                rest.append((agent, at, number, due, missed, None))
        return ((rest,), self._next(rest), given) if rest else (None, None, given)

    def _row(self, key, agent: int, number: int, at: int, due: int | None, status: str, met: int | None = None, by: str | None = None) -> tuple:
        return number, key, agent, at, due, status, met, by


OUTCOME = "follow_up_id long, customer_id long, agent_id long, promised_at timestamp, due_at timestamp, status string, fulfilled_at timestamp, fulfilled_in string"


def promise_timer(line: DataFrame, grace: str = "24 hours", expiry: str = "48 hours", lateness: str = "1 day", forget: str | None = None, groups: int = GROUPS) -> DataFrame:
    """Changes of status of promises, by the rule of ``promises.close_promises``, in the order they become certain.

    ``line`` has promises and contacts in one stream: customer_id, agent_id, at, and either
    follow_up_id with due_at or contact_id. A promise comes out as open, then as fulfilled
    or late once the watermark has passed its next contact, or as missed once it has passed
    its lapse; a missed one comes out again as late if a contact follows. Held are open and
    missed promises, and contacts only until the watermark has passed them. ``forget`` ends
    the wait of a missed promise so long after its lapse; without it the wait is open.
    """
    use_rocksdb(line.sparkSession)
    rows = line.withWatermark("at", lateness).where("customer_id IS NOT NULL AND agent_id IS NOT NULL OR at IS NULL")
    rows = rows.select("customer_id", "agent_id", F.col("at").alias("event_at"), F.unix_micros("at").alias("at"), "follow_up_id", F.unix_micros("due_at").alias("due_at"), "contact_id")
    step = _Promises(_micros(grace), _micros(expiry), _micros(forget) if forget else None)
    columns = ["agent_id", "at", "follow_up_id", "due_at", "contact_id"]
    changes = _stateful(rows, "customer_id", "event_at", columns, OUTCOME.replace("timestamp", "long"), "update", step, groups)
    return changes.withColumns({c: F.timestamp_micros(c) for c in ("promised_at", "due_at", "fulfilled_at")})


#: order of the changes of one promise within a micro-batch
SETTLED = "CASE status WHEN 'open' THEN 0 WHEN 'missed' THEN 1 ELSE 2 END"


def promise_line(promises: DataFrame, contacts: DataFrame) -> DataFrame:
    """Promises and contacts as one stream, as ``promise_timer`` takes it."""
    made = promises.select("customer_id", "agent_id", F.col("promised_at").alias("at"), "follow_up_id", "due_at", F.lit(None).cast("string").alias("contact_id"))
    met = contacts.select("customer_id", "agent_id", F.col("started_at").alias("at"), F.lit(None).cast("long").alias("follow_up_id"), F.lit(None).cast("timestamp").alias("due_at"), F.col("interaction_id").cast("string").alias("contact_id"))
    return made.unionByName(met)


class _CallState:
    """The fold of ``calls.job_state_fold``, one call at a time; a call that is over is forgotten after a while.

    Holds the last step with its time and number, whether the call is done or red, its retries, the last error with its
    time and number, and the time of its last row.
    """

    def __init__(self, max_retries: int, keep: int):
        self.max_retries, self.keep = max_retries, keep

    def __call__(self, key, held, rows: list[tuple], now: int):
        step, step_at, step_id, done, red, retries, error, error_at, error_id, updated = held or (None, None, None, False, False, 0, None, None, None, None)
        for number, named, failure, at in rows:
            at = int(at)
            order = (at, int(number))
            if named != calls.LISTED and (step_at is None or order > (step_at, step_id)):
                step, step_at, step_id = named, *order
            if failure is not None and (error_at is None or order > (error_at, error_id)):
                error, error_at, error_id = failure, *order
            done, red = done or named == calls.DONE, red or named == calls.GATE_RED
            retries += named in calls.FAILURES
            updated = at if updated is None else max(updated, at)
        dead = red or retries >= self.max_retries
        status = calls.DONE if done else calls.DEAD if dead else step or calls.LISTED
        given = [(key, status, retries, error, updated)] if rows else []
        timer = _after(updated + self.keep) if done or dead else None
        if timer is not None and timer <= now:
            return None, None, given
        return (step, step_at, step_id, done, red, retries, error, error_at, error_id, updated), timer, given


CALL_STATE = "uniqueid string, status string, retries int, last_error string, updated_at timestamp"
#: a call that the table knows as over is not opened by what comes after its state was forgotten; an evaluation outranks a dead letter
OPEN_CALL = f"old.status NOT IN ('{calls.DONE}', '{calls.DEAD}') OR new.status = '{calls.DONE}' OR old.status = new.status"


def call_states(events: DataFrame, max_retries: int = calls.MAX_RETRIES, keep: str = "30 days", lateness: str = "1 day", groups: int = GROUPS) -> DataFrame:
    """New state of each call that a micro-batch names; state is held for open calls, and ``keep`` longer for those that are over."""
    use_rocksdb(events.sparkSession)
    rows = events.withWatermark("logged_at", lateness).where("uniqueid IS NOT NULL OR logged_at IS NULL")
    rows = rows.select("uniqueid", "event_id", "step", "error", "logged_at", F.unix_micros("logged_at").alias("at"))
    step = _CallState(max_retries, _micros(keep))
    out = CALL_STATE.replace("timestamp", "long")
    return _stateful(rows, "uniqueid", "logged_at", ["event_id", "step", "error", "at"], out, "update", step, groups).withColumn("updated_at", F.timestamp_micros("updated_at"))
