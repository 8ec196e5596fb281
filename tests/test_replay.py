"""What a replay of ordered streams hands to its state."""

import numpy as np
import pandas as pd

from mktlens.streaming.ordered import BOOK, RECORD, TICK, TRADE, Silence

SF = "/root/testdata/sf0.001"
LIMITS = {BOOK: 10_000, TRADE: 15_000}
WIDTH = 600_000


class Handle:
    """State and timers of one key, with the calls that reach them."""

    def __init__(self) -> None:
        self.states, self.timers, self.calls = {}, [], 0

    def getMapState(self, name, *kinds):
        return self

    def getValueState(self, name, kind):
        handle = self

        class Value:
            def get(self):
                return handle.states.get(name)

            def exists(self):
                return name in handle.states

            def update(self, value):
                handle.states[name] = value

        return Value()

    def containsKey(self, key):
        self.calls += 1
        return key in self.states

    def getValue(self, key):
        self.calls += 1
        return self.states.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.states[key] = value

    def removeKey(self, key):
        del self.states[key]

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.append(ms)


class Timer:
    def __init__(self, ms: int) -> None:
        self.ms = ms

    def getExpiryTimeInMs(self) -> int:
        return self.ms


def frames(us: np.ndarray, kind: np.ndarray, size: int) -> list[pd.DataFrame]:
    rows = pd.DataFrame({"kind": kind.astype(np.int32), "id": np.arange(len(us)), "ts": pd.to_datetime(us, unit="us"), "value": 1.0})
    return [rows[k : k + size] for k in range(0, len(rows), size)]


def silence(handle: Handle) -> Silence:
    out = Silence(LIMITS, WIDTH)
    out.init(handle)
    return out


def told(us: np.ndarray, kind: np.ndarray, end_ms: int) -> set[tuple]:
    """Silences by hand."""
    out = set()
    for k, name in Silence.NAMES.items():
        at = np.unique(us[kind == k]).tolist()
        out |= {(name, a, a + 1000 * LIMITS[k]) for a, b in zip(at, [*at[1:], None]) if (a + 1000 * LIMITS[k] < 1000 * end_ms if b is None else b - a > 1000 * LIMITS[k])}
    if us[kind == TRADE].min() < us[kind == BOOK].min():
        out.add(("orderbook", None, int(us[kind == TRADE].min())))
    return out


def test_silences_of_a_thinned_replay():
    rng = np.random.default_rng(1)
    for k in range(20):
        day = 1_704_067_200_000_000
        # crowds and gaps of just under, just at and just over the limits
        us = day + np.cumsum(rng.choice([0, 1, 500_000, 9_999_999, 10_000_000, 10_000_001, 15_000_000, 15_000_001, 700_000_000], 3000, p=[0.2, 0.2, 0.4, *[0.03] * 5, 0.05]))
        kind, deal = rng.choice([BOOK, TRADE], len(us)), rng.permutation(len(us))
        handle = Handle()
        processor = silence(handle)
        for part in np.array_split(deal, 3):
            list(processor.handleInputRows(("t",), iter(frames(us[part], kind[part], 100)), None))
        list(processor.handleInputRows(("t",), iter(frames(us[:1], np.array([TICK]), 1)), None))
        end = int(us.max() // 1_000_000 + 3600) // 600 * WIDTH
        out = []
        for ms in sorted(set(handle.timers)):
            if ms <= end:
                out += [tuple(None if pd.isna(x) else x for x in row[1:]) for frame in processor.handleExpiredTimer(("t",), None, Timer(ms)) for row in frame.itertuples(index=False)]
        assert set(out) == told(us, kind, end) and len(out) == len(set(out)), k


def test_state_grows_with_buckets_and_not_with_rows():
    handle = Handle()
    processor = silence(handle)
    us = 1_704_067_200_000_000 + np.random.default_rng(2).integers(0, 10 * 1000 * WIDTH, 40_000)
    for part in np.array_split(us, 4):
        list(processor.handleInputRows(("t",), iter(frames(part, np.full(len(part), TRADE), 500)), None))
    assert handle.calls <= 4 * 10 * 3 + 10, handle.calls  # for each of ten buckets a read and a write by micro-batch, and timers
    # two rows for each stretch of a limit
    assert max(len(bytes(v[0])) for k, v in handle.states.items() if isinstance(k, tuple)) <= 2 * WIDTH // LIMITS[TRADE] * RECORD.itemsize


def test_mids_without_levels_are_those_of_the_metrics(spark):
    from mktlens.operators.features import book_metrics
    from mktlens.sources import views as V

    metrics = book_metrics(V.book_levels(spark, SF)).where("mid is not null").select("token_id", "snapshot_id", "ts", "mid")
    mids = sorted(map(tuple, V.book_mids(spark, SF).collect()))
    assert mids == sorted(map(tuple, metrics.collect())) and mids
