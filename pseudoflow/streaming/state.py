"""Session numbering in keyed state (ST2, ST4): ``transformWithStateInPandas`` with one key per (session, tag).

Beside the sink, for sessions whose values fit one task's state store: each key holds the numbers of its values (map
state, RocksDB), the last number and its generation.  A key without rows for ``expire_ms`` of event time is emptied by a timer
and starts over in the next generation.  State can begin with a mapping table.  New mapping rows come out in append
mode; numbers follow (call, row key, pass, position) inside a micro-batch and arrival across batches, as in the sink.
"""

from __future__ import annotations

from typing import Any, Iterator, Optional

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pseudoflow.operators import mask as M
from pseudoflow.operators import segments as S
from pseudoflow.operators.tokens import call_number
from pseudoflow.options import MaskOptions

ADDED = "session_id string, generation int, tag string, n long, token string, value string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_session(spark: SparkSession) -> SparkSession:
    """A session of its own with the state store these queries need; the caller's settings stay as they are."""
    out = spark.newSession()
    out.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    out.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return out


class TokenState(StatefulProcessor):
    def __init__(self, expire_ms: Optional[int] = None, ttl_ms: Optional[int] = None):
        self.expire_ms, self.ttl_ms = expire_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.numbers = handle.getMapState("numbers", "value string", "n long", self.ttl_ms)
        self.last = handle.getValueState("last", "n long, generation int", self.ttl_ms)

    def _last(self) -> tuple[int, int]:
        return tuple(self.last.get()) if self.last.exists() else (0, 1)

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        n, generation = self._last()
        for value, number in zip(initialState["value"], initialState["n"]):
            self.numbers.updateValue((value,), (int(number),))
            n = max(n, int(number))
        self.last.update((n, generation))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        session, tag = key
        first: dict[str, tuple] = {}  # place of each distinct value of the micro-batch
        latest = 0
        for pdf in rows:
            places = zip(pdf["call_seq"], pdf["row_key"], pdf["tie"], pdf["pass_no"], pdf["idx"])
            for value, place in zip(pdf["value"], places):
                if value not in first or place < first[value]:
                    first[value] = place
            if self.expire_ms is not None:
                latest = max(latest, int(pdf["event_ms"].max()))
        n, generation = self._last()
        out = []
        for value in sorted(first, key=first.__getitem__):
            if not self.numbers.containsKey((value,)):
                n += 1
                self.numbers.updateValue((value,), (n,))
                out.append((session, generation, tag, n, f"[{tag}:{n}]", value))
        self.last.update((n, generation))
        if self.expire_ms is not None:
            timers = list(self.handle.listTimers())
            due = max([latest + self.expire_ms, *timers])
            for t in timers:
                if t != due:
                    self.handle.deleteTimer(t)
            if due not in timers:
                self.handle.registerTimer(due)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ADDED.split(", ")])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        _, generation = self._last()
        self.numbers.clear()
        self.last.update((0, generation + 1))
        yield pd.DataFrame([], columns=[c.split()[0] for c in ADDED.split(", ")])

    def close(self) -> None:
        pass


def state_mapping(stream: DataFrame, text_col: str = "text", key_col: str = "doc_id", session_col: str = "session_id", *,
                  order_col: Optional[str] = None, options: MaskOptions = MaskOptions(engines="regex"),
                  initial: Optional[DataFrame] = None, event_col: Optional[str] = None, watermark: str = "0 seconds",
                  expire_ms: Optional[int] = None, ttl_ms: Optional[int] = None, **seg_kwargs) -> DataFrame:
    """New mapping rows (``ADDED``) of a stream made in ``state_session``; rows without a session are left out.

    ``initial`` is a mapping table whose numbers go on.  With ``expire_ms`` a key expires by ``event_col`` and the watermark.
    """
    if (expire_ms is None) != (event_col is None):
        raise ValueError("expiry needs event_col and expire_ms")
    src = stream.withWatermark(event_col, watermark) if event_col else stream
    segd = M.segment(src, text_col, options=options, **seg_kwargs)
    event = [F.unix_millis(event_col).alias("event_ms"), F.col(event_col)] if event_col else []
    key = F.coalesce(F.lpad(F.col(key_col).cast("string"), 20, " "), F.lit(""))  # numbers keep their order as text; null comes first
    hits = segd.where(F.col(session_col).isNotNull()).select(
        F.col(session_col).cast("string").alias("session_id"), key.alias("row_key"), F.sha2(text_col, 256).alias("tie"),
        call_number(segd, order_col).cast("double").alias("call_seq"), *event, F.inline(S.grouped_hits(F.col("segs"))))
    hits = hits.withColumnRenamed("txt", "value").drop("places")
    grouped = None
    if initial is not None:
        grouped = initial.select("session_id", "tag", "n", "value").groupBy("session_id", "tag")
    return hits.groupBy("session_id", "tag").transformWithStateInPandas(
        TokenState(expire_ms, ttl_ms), ADDED, "Append", "EventTime" if event_col else "ProcessingTime" if ttl_ms else "None",
        initialState=grouped, eventTimeColumnName="")
