"""Tick outcomes of one symbol, in order of arrival. Runs in Python workers. Times are microseconds."""

from __future__ import annotations

from collections import deque

ACCEPT, DUPLICATE, GAP, OUT_OF_ORDER = "ACCEPT", "DUPLICATE", "GAP", "OUT_OF_ORDER"
WINDOW = 500


class Seen:
    """The last `size` distinct keys."""

    def __init__(self, keys=(), size: int = WINDOW):
        self.size, self.order = size, deque(keys)
        self.keys = set(self.order)

    def add(self, key) -> bool:
        """Whether key is new; then it is kept, and the oldest goes if there are too many."""
        if key in self.keys:
            return False
        if len(self.order) >= self.size:
            self.keys.discard(self.order.popleft())
        self.order.append(key)
        self.keys.add(key)
        return True


class Guard:
    """The highest sequence id, the last time, and the last WINDOW ids; times have a window of their own, for ticks without an id."""

    def __init__(self, last_seq=None, last_ts=None, ids=(), times=(), window: int = WINDOW):
        self.last_seq, self.last_ts = last_seq, last_ts
        self.ids, self.times = Seen(ids, window), Seen(times, window)

    def evaluate(self, ts, seq=None) -> tuple[str, int]:
        """(outcome, size of the gap). A tick without a time is accepted and leaves no trace, as nothing can be said of its order."""
        if ts is None:
            return ACCEPT, 0
        if seq is None:
            if not self.times.add(ts):
                return DUPLICATE, 0
            if self.last_ts is not None and ts <= self.last_ts:
                return OUT_OF_ORDER, 0
            self.last_ts = ts
            return ACCEPT, 0
        if not self.ids.add(seq):
            return DUPLICATE, 0
        if self.last_seq is None or seq > self.last_seq:
            gap = 0 if self.last_seq is None else seq - self.last_seq - 1
            self.last_seq, self.last_ts = seq, ts
            return (GAP, gap) if gap else (ACCEPT, 0)
        if self.last_ts is None or ts >= self.last_ts:
            self.last_ts = ts
            return ACCEPT, 0
        return OUT_OF_ORDER, 0


def label(batches):
    """Arrow batches in order of symbol and arrival, with columns outcome and gap. Holds the state of one symbol."""
    import pyarrow as pa

    symbol, g = None, None
    for b in batches:
        out = []
        for name, ts, seq in zip(b["symbol"].to_pylist(), b["exchange_ts"].cast(pa.int64()).to_pylist(), b["sequence_id"].to_pylist()):
            if g is None or name != symbol:
                symbol, g = name, Guard()
            out.append(g.evaluate(ts, seq))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([o for o, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())], names=[*b.schema.names, "outcome", "gap"])
