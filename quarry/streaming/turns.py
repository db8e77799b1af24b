"""Turns of conversations in the order in which they were asked, from a stream that brings them late and interleaved.

A turn waits in its conversation's state until the watermark has passed it, so that every turn before it has come; then an
event-time timer lets it go with the turn before it. What is kept of a conversation beyond that is its last turn, and that goes when
nothing has followed it for a while. What a turn then means (`resolved`) is one expression, for streams and tables alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import Row

from quarry.functions.text import ascii_words

TURN = "a string, entities array<string>, years array<string>, ms long"
TURNS = "conv_id long, turn long, a string, entities array<string>, years array<string>, at timestamp"
OUT = "conv_id long, turn long, a string, entities array<string>, years array<string>, previous string, before_entities array<string>, before_years array<string>"
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: How long a conversation's last turn is remembered, in event time.
IDLE_MS = 24 * 3600 * 1000


class InOrder(StatefulProcessor):
    """Each turn with the one before it. A turn that comes twice keeps its last wording."""

    def __init__(self, idle_ms: int = IDLE_MS):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "turn long", TURN)
        self.last = handle.getValueState("last", TURN)

    def handleInputRows(self, key, rows, timerValues):
        for r in rows:
            ms = int(r.at.timestamp() * 1000)
            self.waiting.updateValue((r.turn,), (r.a, r.entities, r.years, ms))
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((tuple(v)[3], tuple(k)[0], tuple(v)) for k, v in list(self.waiting.iterator()) if tuple(v)[3] <= now)
        last = tuple(self.last.get()) if self.last.exists() else None
        if last and last[3] + self.idle_ms <= now:
            self.last.clear()
            last = None
        for ms, turn, own in due:
            if last and last[3] + self.idle_ms <= ms:
                last = None
            yield Row(conv_id=key[0], turn=turn, a=own[0], entities=own[1], years=own[2], previous=last and last[0], before_entities=last and last[1], before_years=last and last[2])
            self.waiting.removeKey((turn,))
            last = own
        if due:
            self.last.update(last)
            self.handle.registerTimer(last[3] + self.idle_ms)

    def close(self) -> None:
        pass


def in_order(turns: DataFrame, lateness: str, idle_ms: int = IDLE_MS) -> DataFrame:
    """A stream of turns (TURNS) to a stream of turns with the one before (OUT). lateness: how far behind a turn may come; later ones are dropped."""
    rows = turns.withWatermark("at", lateness).groupBy("conv_id")
    return rows.transformWithState(InOrder(idle_ms), OUT, "Append", "EventTime")


def resolved(entity: str) -> tuple[Column, Column]:
    """inherits, resolved over a, entities, years, previous, before_entities, before_years. entity: the pattern of all names.

    `And X?` after a question with one entity or one year asks the same of X; anything else stands alone.
    """
    inherits = F.col("previous").isNotNull() & (F.char_length("a") < 60) & F.col("a").rlike(ascii_words("(?i)^(?:and|what about|how about)\\b"))
    one = lambda c: (F.size(c) == 1) & (F.size("before_" + c) == 1)
    entities = F.regexp_replace("previous", F.lit(ascii_words(entity)), F.get("entities", F.lit(0)))
    years = F.regexp_replace("previous", F.lit("20[0-9]{2}"), F.get("years", F.lit(0)))
    return inherits, F.when(inherits & one("entities"), entities).when(inherits & one("years"), years).otherwise(F.col("a"))
