"""Cumulative series as a stream: state per key, late rows move all later totals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The store that keeps state of any shape; a session that runs these streams must name it under ``spark.sql.streaming.stateStore.providerClass``.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Totals(StatefulProcessor):
    """Counts per bucket of a key; each batch gives the totals from the first bucket that it touched on."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "bucket timestamp", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        added = pd.concat(list(rows)).groupby("bucket")["n"].sum()
        for bucket, n in added.items():
            at = (bucket.to_pydatetime(),)
            self.counts.updateValue(at, ((self.counts.getValue(at)[0] if self.counts.containsKey(at) else 0) + int(n),))
        held = pd.Series({pd.Timestamp(k[0]): v[0] for k, v in self.counts.iterator()}).sort_index()
        total = held.cumsum()
        out = total[total.index >= min(pd.Timestamp(b) for b in added.index)]
        yield pd.DataFrame({"key": key[0], "bucket": out.index, "total": out.to_numpy()})

    def close(self) -> None:
        pass


def cumulative_totals(rows: DataFrame, key: str, ts: str = "ts", unit: str = "day") -> DataFrame:
    """(key, bucket, total): rows of a key up to each bucket that has any, as they change. However late rows are, they count.

    Each partition of a batch is counted before it is shuffled, so a key with most of the rows sends a row a bucket and
    partition. State is a count per key and bucket. Rows without a key or time are left out. A sink keeps the last row of
    each key and bucket.
    """
    spread = rows.select(F.col(key).cast("string").alias("key"), F.date_trunc(unit, F.col(ts).cast("timestamp")).alias("bucket")).filter("key is not null and bucket is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.Table.from_batches([b]).group_by(["key", "bucket"]).aggregate([([], "count_all")])
            yield from found.rename_columns(["key", "bucket", "n"]).to_batches()

    counted = spread.mapInArrow(count, "key string, bucket timestamp, n bigint")
    return counted.groupBy("key").transformWithStateInPandas(statefulProcessor=_Totals(), outputStructType="key string, bucket timestamp, total bigint", outputMode="Update", timeMode="None")
