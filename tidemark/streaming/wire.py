"""Messages of kimi wire records as they arrive.

The state of a session is where its fold stands: the message that is open, the
call that takes fragments, and the calls that may still get results.  Items wait
until the watermark has passed them and are then taken in order of their lines,
so records that come late, but not later than ``late``, are folded where they
belong; later ones are left out.  A change gives the changed part with a higher
version; ``messages`` puts the newest parts together, equal to what
``transcripts.kimi_wire_messages`` makes of the whole file.

The state store must be RocksDB (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.sources.transcripts import kimi_wire_items

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_ITEM = "line long, item long, kind string, role string, text string, tool string, call_id string, arguments string, output array<string>, at long, message_id string, ts timestamp"
PARTS = "session string, seq long, pos long, version long, role string, message_id string, at long, kind string, text string, tool string, call_id string, arguments string, outputs array<string>"
_PART = PARTS.removeprefix("session string, ")
_NAMES = [c.split()[0] for c in PARTS.split(", ")]
_WAITING = [c.split()[0] for c in _ITEM.split(", ")]


_EPOCH, _MS = datetime(1970, 1, 1, tzinfo=UTC), timedelta(milliseconds=1)


def _stamp(row: tuple) -> int:
    at = row[-1]
    return ((at if at.tzinfo else at.replace(tzinfo=UTC)) - _EPOCH) // _MS


class _Held:
    """A map state while a session is at work: each key is read once at most and written once; a new session has nothing to read."""

    def __init__(self, state, empty: bool) -> None:
        self.state, self.empty, self.known, self.changed = state, empty, {}, {}

    def get(self, key) -> tuple | None:
        if key not in self.known:
            self.known[key] = self.state.getValue((key,)) if not self.empty and self.state.containsKey((key,)) else None
        return self.known[key]

    def put(self, key, value: tuple) -> None:
        self.known[key] = self.changed[key] = value

    def write(self) -> None:
        for key, value in self.changed.items():
            self.state.updateValue((key,), value)


class _Fold(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.early = handle.getListState("early", _ITEM)
        self.place = handle.getValueState("place", "pos long, current long, opened long")
        self.calls = handle.getMapState("calls", "call_id string", "pos long, hidden boolean")
        self.parts = handle.getMapState("parts", "pos long", _PART)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = [tuple(r) for some in rows for r in self._plain(some)]
        yield from self._take(key[0], [tuple(r) for r in self.early.get()], fresh, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._take(key[0], [tuple(r) for r in self.early.get()], [], timerValues)

    def close(self) -> None:
        pass

    @staticmethod
    def _plain(some: pd.DataFrame) -> Iterator[tuple]:
        for row in some[_WAITING].itertuples(index=False, name=None):
            yield tuple(list(x) if name == "output" and x is not None else None if x is None or (not isinstance(x, (list, str)) and pd.isna(x)) else x.to_pydatetime() if name == "ts" else x for name, x in zip(_WAITING, row, strict=True))

    def _take(self, session: str, early: list[tuple], fresh: list[tuple], timers) -> Iterator[pd.DataFrame]:
        """Folds what the watermark has passed; the others wait, under one timer at the first of them."""
        mark = timers.getCurrentWatermarkInMs()
        items = [(_stamp(r), r) for r in (*early, *fresh)]
        ready = sorted((r for at, r in items if at <= mark), key=lambda r: r[:2])
        waiting = [(at, r) for at, r in items if at > mark]
        if not ready:
            if fresh:
                self.early.appendList(fresh)
        elif early:
            self.early.clear()
        if ready and waiting:
            self.early.put([r for _, r in waiting])
        if waiting and (ready or fresh):
            self.handle.registerTimer(min(at for at, _ in waiting))
        if not ready:
            return
        changed: dict[tuple[int, int], tuple] = {}
        place = self.place.get() if self.place.exists() else None
        self.held_calls, self.held_parts = _Held(self.calls, place is None), _Held(self.parts, place is None)
        pos, current, opened = place or (0, None, None)
        for row in ready:
            pos, current, opened = self._step(dict(zip(_WAITING, row, strict=True)), pos + 1, current, opened, changed)
        self.place.update((pos, current, opened))
        self.held_calls.write()
        self.held_parts.write()
        if changed:
            yield pd.DataFrame([(session, *p) for p in changed.values()], columns=_NAMES)

    def _step(self, x: dict, pos: int, current: int | None, opened: int | None, changed: dict) -> tuple[int, int | None, int | None]:
        kind, call = x["kind"], (x["call_id"] or "").strip()

        def write(part: list) -> None:
            part[2] += 1
            changed[part[1], 0] = tuple(part)
            if part[6] == "tool":
                self.held_parts.put(part[1], tuple(part))

        def new(message: int, role: str, kind: str, text: str | None) -> list:
            tool = kind == "tool"
            return [message, pos, 0, role, x["message_id"], x["at"], kind, text, x["tool"], x["call_id"], (x["arguments"] or "") if tool else None, None]

        if kind in ("reset", "turn"):
            if kind == "turn":
                write(new(pos, x["role"], kind, x["text"]))
            return pos, None, None
        if kind == "hidden":
            if call:
                last = self.held_calls.get(call) or (None, False)
                self.held_calls.put(call, (last[0], True))
            return pos, current, None
        if kind == "fragment":
            if opened is not None:
                part = list(self.held_parts.get(opened))
                part[10] += x["arguments"] or ""
                part[11] = list(part[11]) if part[11] is not None else []
                write(part)
            return pos, current, opened
        if kind == "result":
            last = self.held_calls.get(call) if call else None
            said = list(x["output"] or [])
            if last is not None and last[1]:
                return pos, current, opened
            if last is None or last[0] is None:
                for text in said:
                    write(new(pos, "tool", "text", text))
            else:
                part = list(self.held_parts.get(last[0]))
                part[11] = [*(part[11] if part[11] is not None else []), *said]
                write(part)
            return pos, current, opened
        current = pos if current is None else current
        write(new(current, x["role"], kind, x["text"]))
        if kind == "tool":
            if call:
                last = self.held_calls.get(call)
                self.held_calls.put(call, (pos, last is not None and last[1]))
            opened = pos
        return pos, current, opened


def wire_parts(records: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Changed parts (session, seq, pos, version, ...) of a stream of records (path, line, record).

    An item without a time of its own counts as of the epoch: it is taken at once
    or, behind the watermark, left out."""
    items = kimi_wire_items(records)
    timed = items.withColumn("ts", F.timestamp_millis(F.coalesce("at", F.lit(0)))).withWatermark("ts", late)
    return timed.select("session", *_WAITING).groupBy("session").transformWithStateInPandas(_Fold(), PARTS, "append", "EventTime")


def messages(parts: DataFrame) -> DataFrame:
    """(session, seq, role, mode, message_id, at, parts) from all parts that a stream gave: of each part the newest version."""
    newest = parts.groupBy("session", "pos").agg(F.max_by(F.struct(*[c for c in _NAMES if c not in ("session", "pos")]), "version").alias("p")).select("session", "pos", "p.*")
    part = F.struct("pos", "kind", "text", "tool", "call_id", "arguments", "outputs", "at")
    return newest.groupBy("session", "seq").agg(
        F.min_by("role", "pos").alias("role"), F.when(F.some(F.col("kind") == "tool"), "tool").alias("mode"), F.min_by("message_id", "pos").alias("message_id"), F.min_by("at", "pos").alias("at"), F.array_sort(F.collect_list(part)).alias("parts"))
