"""Sentences of a stream of pieces, with the state of each document kept by Spark's ``transformWithState``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.abbreviations import DEFAULT
from ..plans.rules import AHEAD, reach, spoken_places

SENTENCE = "doc_id long, start long, end long, sentence string"
#: Spark keeps state of this kind in RocksDB alone.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Tails(StatefulProcessor):
    """Puts pieces in order, scores what they add, and keeps the unfinished sentence.

    State of a document: the pieces that wait for one before them, by part, and one row
    with the next part, the unfinished sentence, where it begins, how much of it is
    scored and the characters before it.  Both go when the document ends.
    """

    def __init__(self, abbreviations: frozenset[str], threshold: float, idle: int | None):
        self.known, self.threshold, self.idle = abbreviations, threshold, idle
        self.behind = reach(abbreviations)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "part int", "text string, last boolean")
        self.open = handle.getValueState("open", "next int, tail string, at long, done int, before string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self._state()
        for batch in rows:
            for part, text in zip(batch["part"].tolist(), batch["text"].tolist(), strict=True):
                # a part that was read before comes again when a source repeats itself
                if part >= state["next"]:
                    ends = text is None or text != text
                    self.waiting.updateValue((int(part),), ("" if ends else text, ends))
        ended = False
        while not ended and self.waiting.containsKey((state["next"],)):
            text, ended = self.waiting.getValue((state["next"],))
            self.waiting.removeKey((state["next"],))
            state["tail"] += text
            state["next"] += 1
        yield self._sentences(key, state, ended)
        if ended:
            self._forget()
            return
        if self.idle is not None:
            self._stop_timers()
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        self.open.update(tuple(state.values()))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self._state()
        # nobody will bring what is missing: the pieces that wait follow in their order
        for _, (text, _) in sorted((k[0], v) for k, v in self.waiting.iterator()):
            state["tail"] += text
        yield self._sentences(key, state, True)
        self._forget()

    def close(self) -> None:
        pass

    def _state(self) -> dict:
        held = self.open.get() if self.open.exists() else (0, "", 0, 0, "")
        return dict(zip(("next", "tail", "at", "done", "before"), held, strict=True))

    def _forget(self) -> None:
        self.open.clear()
        self.waiting.clear()
        self._stop_timers()

    def _stop_timers(self) -> None:
        # without idle the query has no timers that could be asked for
        for timer in list(self.handle.listTimers()) if self.idle is not None else []:
            self.handle.deleteTimer(timer)

    def _sentences(self, key: tuple, state: dict, ended: bool) -> pd.DataFrame:
        tail, before, rows, start = state["tail"], state["before"], [], 0
        # the last characters wait for those that decide about them
        upto = len(tail) if ended else max(len(tail) - AHEAD, state["done"])
        for end in spoken_places(before + tail, len(before) + state["done"], len(before) + upto, self.known, self.threshold):
            end -= len(before)
            rows.append((key[0], state["at"] + start, state["at"] + end, tail[start:end]))
            start = end
        if ended and start < len(tail):
            rows.append((key[0], state["at"] + start, state["at"] + len(tail), tail[start:]))
            start = len(tail)
        state |= {"tail": tail[start:], "at": state["at"] + start, "done": max(upto - start, 0), "before": (before + tail[:start])[-self.behind :]}
        return pd.DataFrame(rows, columns=["doc_id", "start", "end", "sentence"])


def tail_stream(pieces: DataFrame, abbreviations: list[str] | None = None, threshold: float = 0.5, idle: int | None = None) -> DataFrame:
    """(doc_id, start, end, sentence) from a stream of pieces (doc_id, part, text).

    Parts are numbered from 0 and may come in any order and in any micro-batch; a piece
    whose text is null ends its document.  With idle, a document that got no piece for
    so many milliseconds ends as well: pieces that wait for a missing one then follow
    each other in their order.  What has ended leaves no state behind.  The session
    must keep state in RocksDB (``STORE``); it is set here where nothing else is set.
    """
    conf = pieces.sparkSession.conf
    if not conf.get(STORE[0], "").endswith("RocksDBStateStoreProvider"):
        conf.set(*STORE)
    made = Tails(frozenset(DEFAULT if abbreviations is None else abbreviations), threshold, idle)
    return pieces.select("doc_id", "part", "text").groupBy("doc_id").transformWithStateInPandas(made, SENTENCE, "append", "None" if idle is None else "processingTime")
