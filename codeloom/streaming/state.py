"""Stateful operators on keyed streams: per-key state in the state store, event-time timers.

A processor sees one key's rows of a micro-batch batch by batch, in no order. ``InOrder`` brings them into
the order (t, event_id) without holding more than one batch and one time slot of them: what does
not fit one batch is parked in the state store by slot and taken out again slot by slot. Rows of
later micro-batches that are older than what a key has decided already are decided when they come,
at the key's newest time (``late`` below), so a decision once given is never revised.

State that cannot matter any more goes by an event-time timer, when the watermark passes it.
"""

import numpy as np
import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

CHUNK = 4096  # numbers in one entry of a queue
SLOTS = 256  # time slots a key's rows of one micro-batch are parked in, about


class StoredQueue:
    """First-in first-out queue of numbers in the state store; memory holds its two end chunks.

    A map from chunk number to numbers, and where the queue begins and ends; the numbers of a queue of
    one chunk are kept with the latter, so that a short queue is read and written in one call of the
    store each. ``save`` must be called when the rows of a key are done.
    """

    def __init__(self, handle, name):
        self.chunks = handle.getMapState(f"{name}_chunks", "chunk long", "numbers array<bigint>")
        self.ends = handle.getValueState(f"{name}_ends", "first long, at long, last long, size long, numbers array<bigint>")

    def load(self):
        self.first, self.at, self.last, self.size, numbers = self.ends.get() or (0, 0, 0, 0, [])
        one = self.first == self.last
        self.head = list(numbers) if one else self.read(self.first)
        self.tail = self.head if one else self.read(self.last)

    def read(self, chunk):
        return list(self.chunks.getValue((chunk,))[0]) if self.chunks.containsKey((chunk,)) else []

    def __len__(self):
        return self.size

    def oldest(self):
        return self.head[self.at]

    def append(self, number):
        if len(self.tail) >= CHUNK:
            if self.last != self.first:
                self.chunks.updateValue((self.last,), (self.tail,))
            self.last, self.tail = self.last + 1, []
            if self.at == len(self.head):
                self.pass_head()
        self.tail.append(number)
        self.size += 1

    def pop(self):
        self.at, self.size = self.at + 1, self.size - 1
        if self.at == len(self.head) and self.first != self.last:
            self.pass_head()

    def pass_head(self):
        if self.chunks.containsKey((self.first,)):
            self.chunks.removeKey((self.first,))
        self.first, self.at = self.first + 1, 0
        self.head = self.tail if self.first == self.last else self.read(self.first)

    def save(self):
        if self.first == self.last:
            self.ends.update((self.first, 0, self.last, self.size, self.head[self.at :]))
            return
        for chunk, numbers in {self.first: self.head, self.last: self.tail}.items():
            self.chunks.updateValue((chunk,), (numbers,))
        self.ends.update((self.first, self.at, self.last, self.size, []))

    def clear(self):
        self.chunks.clear()
        self.ends.clear()


class InOrder(StatefulProcessor):
    """Base of processors that decide a key's rows one after another.

    Subclasses define ``values`` (names and types of the columns they need besides t and event_id),
    ``open``, ``load``, ``step`` (one row; gives an output row or None), ``save`` (gives the time at
    which the state may go) and ``clear``. ``out`` names the output columns.
    """

    values = ()
    out = ()

    def init(self, handle):
        self.handle = handle
        fields = ", ".join(f"{name} array<{kind}>" for name, kind in (("t", "bigint"), ("event_id", "bigint"), *self.values))
        self.parked = handle.getMapState("parked", "slot long, part long", fields)
        self.newest = handle.getValueState("newest", "t long, due long")  # and when the timer is due
        self.open(handle)

    def close(self):
        pass

    def columns(self):
        return ["t", "event_id", *[name for name, _ in self.values]]

    @staticmethod
    def ordered(frame):
        return frame.iloc[np.lexsort((frame["event_id"].to_numpy(), frame["t"].to_numpy()))]

    def slots(self, frames):
        """Frames of increasing time slots, each in order; at most one batch and one slot in memory."""
        first = next(frames, None)
        second = next(frames, None)
        if second is None:
            if first is not None and len(first):
                yield self.ordered(first)
            return
        width, parts = None, {}
        for frame in self.chain(first, second, frames):
            if not len(frame):
                continue
            t = frame["t"].to_numpy(np.int64)
            if width is None:
                width = max(1, int(t.max() - t.min()) // SLOTS)
            for slot, own in frame.groupby(t // width, sort=False):
                part = parts[slot] = parts.get(slot, -1) + 1
                self.parked.updateValue((int(slot), part), tuple(own[c].tolist() for c in self.columns()))
        for slot in sorted(parts):
            pieces = []
            for part in range(parts[slot] + 1):
                pieces.append(pd.DataFrame(dict(zip(self.columns(), self.parked.getValue((int(slot), part))))))
                self.parked.removeKey((int(slot), part))
            yield self.ordered(pd.concat(pieces, ignore_index=True))

    @staticmethod
    def chain(first, second, rest):
        yield first
        yield second
        yield from rest

    def handleInputRows(self, key, rows, timerValues):
        late, timer = self.newest.get() or (None, None)
        newest = late
        self.load()
        for frame in self.slots(iter(rows)):
            found = []
            for row in zip(*[frame[c].tolist() for c in self.columns()]):
                t = row[0] if late is None else max(row[0], late)
                newest = t if newest is None else max(newest, t)
                value = self.step(t, row)
                if value is not None:
                    found.append((*key, *value))
            if found:
                yield pd.DataFrame(found, columns=self.out)
        if newest is None:
            return
        due = max(self.save(newest) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1)
        self.newest.update((newest, due))
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.newest.clear()
        self.clear()
        yield pd.DataFrame([], columns=self.out)


class RateLimit(InOrder):
    """(key, event_id, allowed): fewer than ``limit`` allowed rows in the last ``period``; the allowed times are state."""

    def __init__(self, key, limit, period):
        self.limit, self.period = limit, period
        self.out = [key, "event_id", "allowed"]

    def open(self, handle):
        self.times = handle.getValueState("times", "t array<bigint>")

    def load(self):
        self.queue = list((self.times.get() or ([],))[0])

    def step(self, t, row):
        while self.queue and t - self.queue[0] >= self.period:
            self.queue.pop(0)
        allowed = len(self.queue) < self.limit
        if allowed:
            self.queue.append(t)
        return row[1], allowed

    def save(self, newest):
        self.times.update((self.queue,))
        return newest + self.period

    def clear(self):
        self.times.clear()


class Throttle(InOrder):
    """(key, event_id, delay): the wait until fewer than ``limit`` arrivals lie in the last ``window``.

    All arrivals in the window are state, in a stored queue; memory holds two chunks of it.
    """

    def __init__(self, key, limit, window):
        self.limit, self.window = limit, window
        self.out = [key, "event_id", "delay"]

    def open(self, handle):
        self.queue = StoredQueue(handle, "arrivals")

    def load(self):
        self.queue.load()

    def step(self, t, row):
        while len(self.queue) and t - self.queue.oldest() >= self.window:
            self.queue.pop()
        wait = self.window - (t - self.queue.oldest()) if len(self.queue) >= self.limit else 0
        self.queue.append(t)
        return row[1], wait

    def save(self, newest):
        self.queue.save()
        return newest + self.window

    def clear(self):
        self.queue.clear()


class SessionGate(InOrder):
    """(key, event_id, t) of the requests of signed-in users.

    ``kind`` is "in", "out" or "request". A user without any row for ``idle`` is signed out, and the user's
    state goes once the watermark has passed that time.
    """

    values = (("kind", "string"),)

    def __init__(self, key, idle):
        self.idle = idle
        self.out = [key, "event_id", "t"]

    def open(self, handle):
        self.status = handle.getValueState("status", "kind string, seen long")

    def load(self):
        self.kind, self.seen = self.status.get() or ("out", None)

    def step(self, t, row):
        if self.seen is not None and t - self.seen >= self.idle:
            self.kind = "out"
        self.seen = t
        if row[2] != "request":
            self.kind = row[2]
        elif self.kind == "in":
            return row[1], row[0]

    def save(self, newest):
        self.status.update((self.kind, self.seen))
        return newest + self.idle

    def clear(self):
        self.status.clear()


def decided(rows, key, processor, fields, delay="1 hour"):
    """Runs a processor over a stream with (key, t, event_id, at, its values), event time ``at``.

    Any key type; a missing key is a key like any other. Needs the RocksDB state store.
    """
    store = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", store)
    kinds = {"bigint": T.LongType(), "boolean": T.BooleanType()}
    fields = [T.StructField(name, kinds[kind]) for name, kind in (field.split() for field in fields.split(", "))]
    names = [key, "at", *processor.columns()]
    grouped = rows.withWatermark("at", delay).select(*names).groupBy(key)
    schema = T.StructType([rows.schema[key], *fields])
    return grouped.transformWithStateInPandas(processor, schema, "append", "eventTime")
