"""Retention as a stream with state: each row has an expiry of its own, and legal holds come as messages.

Time is the moment at which rows and messages arrive, so a row that comes late by its own clock is not lost: if it is over
already, it expires in the batch that brings it.

Keys that follow one another share an entry of state and a timer: every question to the state store is a round trip
between Python and the JVM, and a block of keys asks as often as one key would.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

if TYPE_CHECKING:
    import pandas as pd

ROW, HOLD, RELEASE = "row", "hold", "release"
_STATE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _packed(longs: Iterable[int]) -> bytes:
    return array("q", longs).tobytes()


def _unpacked(packed: bytes) -> array:
    out = array("q")
    out.frombytes(packed)
    return out


class _Expiry(StatefulProcessor):
    """State of a block of keys: when each expires, in milliseconds, if its row is there; which are held; the timer that is set.

    The timer is that of the first row that no hold keeps.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.block = handle.getValueState("block", "keys binary, expires binary, held binary, timer long")

    def _state(self) -> tuple[dict[int, int], set[int], int | None]:
        found = self.block.get()
        if found is None:
            return {}, set(), None
        keys, expires, held, timer = found
        return dict(zip(_unpacked(keys), _unpacked(expires), strict=True)), set(_unpacked(held)), timer

    def _keep(self, expires: dict[int, int], held: set[int], timer: int | None) -> None:
        """Stores the state and moves the timer from where it is."""
        first = min((t for k, t in expires.items() if k not in held), default=None)
        if timer is not None and timer != first:
            self.handle.deleteTimer(timer)
        if first is not None and timer != first:
            self.handle.registerTimer(first)
        if expires or held:
            self.block.update((_packed(expires), _packed(expires.values()), _packed(held), first))
        else:
            self.block.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Messages of a batch in the order of their moments; a row that comes again moves its expiry."""
        expires, held, timer = self._state()
        said = [m for part in rows for m in zip(part["moment"], part["kind"], part["key"], part["expires_ms"], strict=True)]
        for _, kind, k, at in sorted(said, key=lambda m: m[:2]):
            if kind == ROW:
                expires[k] = at
            elif kind == HOLD:
                held.add(k)
            else:
                held.discard(k)
        self._keep(expires, held, timer)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """All rows of the block that are over by now; Spark deletes the timer that has fired."""
        import pandas as pd

        expires, held, _ = self._state()
        now = timerValues.getCurrentWatermarkInMs()
        over = {k: t for k, t in expires.items() if t <= now and k not in held}
        self._keep({k: t for k, t in expires.items() if k not in over}, held, None)
        if over:
            yield pd.DataFrame({"key": list(over), "expired_at": list(over.values())}, dtype="int64")

    def close(self) -> None:
        pass


def expiring(messages: DataFrame, delay: str = "0 seconds", block_bits: int = 10) -> DataFrame:
    """(key, expired_at in milliseconds) of each row when its time is over and no hold keeps it, once.

    ``messages`` has key (long), kind (``row``, ``hold`` or ``release``), at (timestamp, when it arrived) and expires_ms
    (long, of rows).  A row goes when the stream's time, the greatest ``at`` of earlier batches less ``delay``, has
    reached its expiry; messages of a batch come before its timers, so a hold in the batch that would let a row go keeps it.
    A hold may come before its row.  A release lets a row go whose time is over.  Rows without an expiry or a key never
    expire.  Only messages whose own ``at`` is behind the stream's time are dropped, as late by arrival.

    2 ** ``block_bits`` keys that follow one another make a block.  A message reads and writes the state of its block: keys
    that are scattered over all longs want more bits than running numbers do.
    """
    expires = F.greatest(F.lit(0), F.coalesce("expires_ms", F.lit(2**62)))
    block, moment = F.shiftright("key", block_bits).alias("block"), F.coalesce(F.unix_micros("at"), F.lit(0)).alias("moment")
    known = messages.filter("key is not null and kind is not null").select(block, "key", "kind", "at", moment, expires.alias("expires_ms"))
    return known.withWatermark("at", delay).groupBy("block").transformWithStateInPandas(_Expiry(), "key long, expired_at long", "Append", "eventTime")


def run_to_end(expired: DataFrame, target: str, checkpoint: str, more: bool = False) -> None:
    """Runs the stream over what is there and appends to Parquet; state is kept by RocksDB, in the checkpoint, between runs.

    With ``more`` to come, rows whose time the last batch has ended wait for the messages of the next run.
    """
    from ..sources.work import confs

    with confs(expired.sparkSession, spark__sql__streaming__stateStore__providerClass=ROCKS, spark__sql__streaming__noDataMicroBatches__enabled=str(not more).lower()):
        expired.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).option("path", target).format("parquet").start().awaitTermination()
