"""The kimi wire fold asks its state store for little: one timer, and each key read and written once."""

from collections import Counter
from datetime import UTC, datetime, timedelta
from types import SimpleNamespace

import pandas as pd

from tidemark.streaming import wire


class Store:
    """Counts the calls of one state."""

    def __init__(self, calls):
        self.calls, self.rows, self.value, self.map = calls, [], None, {}

    def __getattr__(self, name):
        does = {
            "get": lambda: iter(list(self.rows)) if self.value is None else self.value, "exists": lambda: self.value is not None, "clear": self.rows.clear, "put": lambda rows: self.rows.__setitem__(slice(None), rows),
            "appendList": self.rows.extend, "update": lambda v: setattr(self, "value", v), "containsKey": self.map.__contains__, "getValue": self.map.get, "updateValue": self.map.__setitem__,
        }[name]
        return lambda *a: (self.calls.update([name]), does(*a))[1]


def test_state_calls_follow_keys_not_items():
    calls, timers = Counter(), []
    store = lambda *_: Store(calls)
    fold = wire._Fold()
    fold.init(SimpleNamespace(getListState=store, getValueState=store, getMapState=store, registerTimer=timers.append))
    at = lambda i: datetime(2024, 1, 1, tzinfo=UTC) + timedelta(seconds=i)
    row = lambda i, kind, **more: {c: None for c in wire._WAITING} | {"line": i, "item": 0, "kind": kind, "ts": at(i)} | more
    rows = [row(0, "tool", tool="Shell", call_id="a", arguments="{")] + [row(i, "fragment", arguments="x") for i in range(1, 100)] + [row(100, "result", call_id="a", output=["out"])]
    mark = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    for some in (rows[1::2], rows[::2]):
        assert list(fold.handleInputRows(("s",), iter([pd.DataFrame(some)]), mark(0))) == []
    assert len(timers) == 2 and min(timers) == int(at(0).timestamp() * 1000)
    (made,) = fold.handleExpiredTimer(("s",), mark(int(at(200).timestamp() * 1000)), None)
    assert made[["pos", "version", "arguments"]].values.tolist() == [[1, 101, "{" + "x" * 99]] and made.outputs[0] == ["out"]
    assert sum(calls.values()) < 12 and not fold.early.rows
