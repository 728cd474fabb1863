"""The life of every listing as keyed state: created, updated, stale, removed, relisted, one row out for each change.

State lies in buckets of a source's listings. A row that ends a scope goes to all buckets
of its source, so that each removes what it holds of that scope and has not seen; nothing
is rewritten but the entries that change. A timer of event time marks listings that were
not seen for some days.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from ..operators import cdc

BUCKETS, STALE_DAYS = 64, 14
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

def _fields(**kinds) -> StructType:
    # Schemas are made of types: a worker has no session to read their text with.
    return StructType([StructField(n, k, True) for n, k in kinds.items()])


_KEY = _fields(id=StringType())
_ENTRY = _fields(hash=StringType(), status=StringType(), scope=StringType(), seen=LongType(), payload=StringType(), stale=BooleanType())
#: Times are microseconds inside the operator: state and rows give them back in unlike forms otherwise.
CHANGES = "source string, source_listing_id string, captured_at long, change_type string, scope_key string, payload string, changed_fields array<string>"


def _change(*values) -> Row:
    return Row(**dict(zip((f.split()[0] for f in CHANGES.split(", ")), values, strict=True)))


class Lifecycle(StatefulProcessor):
    """One bucket of one source: rows in order of observation, marks of a time after the listings of that time."""

    def __init__(self, days: int):
        self.wait = days * 86_400_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", _KEY, _ENTRY)
        self.due = handle.getValueState("due", _fields(at=LongType()))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # The rows of one bucket in one micro-batch.
        order = lambda r: (r.at, bool(r.end_of_scope), r.hash or "")
        for r in sorted(rows, key=order):
            if r.end_of_scope:
                yield from self._end(key[0], r)
            else:
                yield from self._seen(key[0], r)

    def _seen(self, source: str, r: Row) -> Iterator[Row]:
        own = (r.source_listing_id,)
        old = self.entries.getValue(own) if self.entries.containsKey(own) else None
        was = old[1] if old else None
        if was == "active" and not old[5] and old[3] + self.wait <= r.at:
            yield _change(source, own[0], old[3] + self.wait, "stale", old[2], old[4], None)  # the gap ends before its timer rang
        if was == "active" and old[0] == r.hash:
            self._put(own, (old[0], "active", old[2] if old[2] is not None else r.scope_key, max(r.at, old[3]), old[4], False))
            return
        before, after = json.loads(old[4]) if old else {}, json.loads(r.payload)
        changed = sorted(k for k in {*before, *after} if before.get(k) != after.get(k)) if old else None
        scope = r.scope_key if r.scope_key is not None or not old else old[2]
        self._put(own, (r.hash, "active", scope, r.at if not old else max(r.at, old[3]), r.payload, False))
        kind = "created" if not old else "relisted" if was == "removed" else "updated"
        if kind != "updated" or changed:
            yield _change(source, own[0], r.at, kind, scope, r.payload, changed)

    def _put(self, own: tuple, entry: tuple) -> None:
        self.entries.updateValue(own, entry)
        self._wake(entry[3])

    def _wake(self, seen: int) -> None:
        """A timer for the listing that is due first; the others follow when it rings."""
        at = (seen + self.wait) // 1000
        due = self.due.get()[0] if self.due.exists() else None
        if due is None or at < due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(at)
            self.due.update((at,))

    def _end(self, source: str, mark: Row) -> Iterator[Row]:
        gone = [(k, e) for k, e in self.entries.iterator() if e[1] == "active" and e[2] == mark.scope_key and e[3] < mark.started]
        for k, e in gone:
            self.entries.updateValue(tuple(k), (e[0], "removed", e[2], e[3], e[4], e[5]))
            yield _change(source, k[0], mark.at, "removed", e[2], e[4], None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        self.due.clear()
        late, first = [], None
        for k, e in self.entries.iterator():
            if e[1] != "active" or e[5]:
                continue
            at = e[3] + self.wait
            if at // 1000 <= now:
                late.append((k, e, at))
            elif first is None or e[3] < first:
                first = e[3]
        for k, e, at in late:
            self.entries.updateValue(tuple(k), (*e[:5], True))
            yield _change(key[0], k[0], at, "stale", e[2], e[4], None)
        if first is not None:
            self._wake(first)

    def close(self) -> None:
        pass


def prepared(stream: DataFrame) -> DataFrame:
    """A stream of listings, and of marks where it has end_of_scope and scope_started, in the form that the state takes."""
    fields = [c for c in cdc.CONTENT if c in stream.columns]
    marks = "end_of_scope" in stream.columns
    end = F.coalesce("end_of_scope", F.lit(False)) if marks else F.lit(False)
    started = F.col("scope_started") if marks else F.lit(None).cast("timestamp")
    payload = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    scope = F.col("scope_key") if "scope_key" in stream.columns else F.lit(None).cast("string")
    return stream.select("source", "source_listing_id", scope.alias("scope_key"), "observed_at", F.when(~end, cdc.content_hash(stream)).alias("hash"), F.when(~end, payload).alias("payload"), end.alias("end_of_scope"), F.unix_micros("observed_at").alias("at"), F.unix_micros(started).alias("started"))


def _buckets(n: int) -> Column:
    """The bucket of a listing; all of them for the end of a scope."""
    own = F.pmod(F.xxhash64("source_listing_id"), F.lit(n)).cast("int")
    return F.explode(F.when(F.col("end_of_scope"), F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(own)))


def lifecycle(stream: DataFrame, delay: str = "0 seconds", buckets: int = BUCKETS, days: int = STALE_DAYS) -> DataFrame:
    """The changes of a stream of listings with observed_at: source, source_listing_id, captured_at, change_type, scope_key, payload, changed_fields.

    Rows later than `delay` behind the newest are not taken, as in any stream with a
    watermark. The session's state store must be RocksDB's (`start` sees to that).
    """
    rows = prepared(stream).withWatermark("observed_at", delay).select("*", _buckets(buckets).alias("bucket"))
    out = rows.groupBy("source", "bucket").transformWithState(statefulProcessor=Lifecycle(days), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime")
    return out.withColumn("captured_at", F.timestamp_micros("captured_at"))


def start(stream: DataFrame, path: str, trigger: dict | None = None, **options):
    """Writes the changes of a stream below path/changes; a restart goes on where the last run stopped."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    q = lifecycle(stream, **options).writeStream.format("parquet").outputMode("append")
    return q.option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/changes").trigger(**(trigger or {"availableNow": True})).start()
