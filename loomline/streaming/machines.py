"""The line machines on streams: a run's lines come in batches, its mode and open block are state, items leave at once."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.machines import Step

#: Of a stream's result: `n` counts a run's items from 0; kind is item, note (the line that ends a run) or cut (what was
#: open when no line came for so long).
RESULT = "run string, n long, kind string, text string"
#: Lines of an open block from which on, at a batch's end, they leave a run's value for a list of texts, which is not written anew each
#: time. All of them stay.
LONG = 1000
_OUT = Row("run", "n", "kind", "text")


class LineMachine(StatefulProcessor):
    """One run's machine: typed state in the state store, so that a query that is started again goes on in its mode. All of it but
    long blocks is one value, read once and written once a batch: each access is a message to the executor and back, which
    costs more than a run's lines."""

    def __init__(self, steps: list[Step], first: str, wait_ms: int):
        self.steps = [(s.mode, s.pattern, s.to, s.do) for s in steps]
        self.first, self.wait_ms = first, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "mode string, n long, block array<string>, long boolean")
        self.earlier = handle.getListState("earlier", "text string")
        self.compiled = [(mode, re.compile(pattern), to, do) for mode, pattern, to, do in self.steps]

    def _set_timer(self, now: int) -> None:
        if self.wait_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(now + self.wait_ms)

    def _whole(self, block: list[str], long: bool) -> str:
        """The text of a block that ends, with what a long one had before."""
        before = [text for (text,) in self.earlier.get()] if long else []
        if long:
            self.earlier.clear()
        return "\n".join([*before, *block])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        mode, n, block, long = self.state.get() or (self.first, 0, [], False)
        block, out = list(block), []

        def item(text: str, kind: str = "item") -> None:
            nonlocal n
            out.append(_OUT(key[0], n, kind, text))
            n += kind == "item"

        lines = sorted(((r.seq, r.line) for r in rows), key=lambda r: (r[0] is None, r[0] or 0))
        for line in (raw.strip() for _, raw in lines if raw is not None):
            for needs, pattern, to, do in self.compiled:
                if needs and needs != mode or not pattern.search(line):
                    continue
                mode = to or mode
                if do in ("open", "close", "end") and (block or long):
                    item(self._whole(block, long))
                    block, long = [], False
                if do == "keep":
                    item(line)
                elif do in ("open", "add"):
                    block.append(line)
                elif do == "end":
                    item(line, "note")
                break
        open_ = bool(block) or long
        if len(block) >= LONG:
            self.earlier.appendValue(("\n".join(block),))
            block, long = [], True
        self.state.update((mode, n, block, long))
        if open_:
            self._set_timer(timerValues.getCurrentProcessingTimeInMs())
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mode, n, block, long = self.state.get() or (self.first, 0, [], False)
        if block or long:
            self.state.update((mode, n, [], False))
            yield _OUT(key[0], n, "cut", self._whole(block, long))

    def close(self) -> None:
        pass


def machine_stream(lines: DataFrame, steps: list[Step], first: str = "start", wait_ms: int = 0) -> DataFrame:
    """RESULT rows of a stream of lines (run, seq, line). The lines of a run must come in order from batch to batch;
    within a batch they are put in order. With wait_ms a block that stays open so long leaves as it is. The state store
    must be RocksDB's (spark.sql.streaming.stateStore.providerClass)."""
    processor = LineMachine(steps, first, wait_ms)
    return lines.groupBy("run").transformWithState(processor, RESULT, "Append", "ProcessingTime" if wait_ms else "None")
