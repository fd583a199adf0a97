"""Pieces of flows, cut at the ends of time blocks, put together again on streams.

Session windows are kept per 5-tuple and block, so a micro-batch compares the sessions of one block and not of all the time a
5-tuple was active. A piece farther than the idle time from both ends of its block is a flow and passes. Only the others meet
those of the blocks beside; a piece that the next block may carry on waits until the watermark has passed all of that block, so
at most one row a 5-tuple is held.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Groups that 5-tuples are dealt to by their hash; most 5-tuples have few packets, and a call for each would take longer than its work.
GROUPS = 256
#: Rows that come out at once.
SLICE_ROWS = 5_000

KEY = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]
SUMS = ["first_us", "last_us", "bytes_sent", "bytes_recv", "packets_sent", "packets_recv", "flag_bits", "first", "sized"]


def _joined(a: tuple, b: tuple) -> tuple:
    """The sums of two pieces of one flow."""
    return (min(a[0], b[0]), max(a[1], b[1]), *(x + y for x, y in zip(a[2:6], b[2:6])), a[6] | b[6], min(a[7], b[7]), a[8] or b[8])


class FlowPieces(StatefulProcessor):
    """Flows from the pieces of the 5-tuples of one group."""

    output = (
        "src_ip string, dst_ip string, src_port int, dst_port int, protocol string, first_us bigint, last_us bigint, bytes_sent bigint, "
        "bytes_recv bigint, packets_sent bigint, packets_recv bigint, flag_bits int, first bigint, sized boolean"
    )

    def __init__(self, idle_us: int, block_us: int):
        self.idle_us, self.block_us = idle_us, block_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one value, as a nested value is converted field by field on each way
        self.held = handle.getValueState("held", "flows binary")

    def _load(self) -> dict[tuple, tuple]:
        return pickle.loads(bytes(self.held.get()[0])) if self.held.exists() else {}

    def _keep(self, held: dict[tuple, tuple]) -> None:
        if held:
            self.held.update((pickle.dumps(held),))
        else:
            self.held.clear()

    def _wake(self, last_us: int) -> int:
        """The watermark that has passed all of the block after that of ``last_us``."""
        return last_us // self.block_us * self.block_us + 2 * self.block_us + self.idle_us

    def _out(self, flows: list[tuple]) -> Iterator[pd.DataFrame]:
        for i in range(0, len(flows), SLICE_ROWS):
            yield pd.DataFrame(flows[i : i + SLICE_ROWS], columns=KEY + SUMS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        near: list[tuple] = []
        for pdf in rows:
            pdf = pdf[KEY + SUMS]
            at_ends = (pdf["first_us"] % self.block_us < self.idle_us) | (pdf["last_us"] % self.block_us + self.idle_us >= self.block_us)
            near += pdf[at_ends].itertuples(index=False, name=None)
            whole = pdf[~at_ends]
            if len(whole):
                yield whole
        if near:
            yield from self._out(self._join(near, timerValues.getCurrentWatermarkInMs() * 1000))

    def _join(self, near: list[tuple], passed: int) -> list[tuple]:
        """The flows that are complete; what may go on is held.

        Pieces of a block come by the order of their ends, so only the last run of a 5-tuple may go on.
        """
        held, done = self._load(), []
        before = len(held)
        pieces = defaultdict(list)
        for r in near:
            pieces[r[: len(KEY)]].append(r[len(KEY) :])
        changed = False
        for flow, parts in pieces.items():
            if flow in held:
                parts.append(held.pop(flow))
                changed = True
            parts.sort()
            run = parts[0]
            for part in parts[1:]:
                if part[0] - run[1] > self.idle_us:
                    done.append(flow + run)
                    run = part
                else:
                    run = _joined(run, part)
            if run[1] % self.block_us + self.idle_us >= self.block_us and self._wake(run[1]) > passed:
                held[flow] = run
                self.handle.registerTimer(-(-self._wake(run[1]) // 1000))
            else:
                done.append(flow + run)
        if changed or len(held) != before:
            self._keep(held)
        return done

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000
        held = self._load()
        due = {flow: run for flow, run in held.items() if self._wake(run[1]) <= passed}
        if due:
            self._keep({flow: run for flow, run in held.items() if flow not in due})
            yield from self._out([flow + run for flow, run in due.items()])

    def close(self) -> None:
        pass
