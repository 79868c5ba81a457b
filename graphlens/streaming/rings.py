"""The last calls of each tool as state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.usage import RING

COLUMNS = {"call_id": "bigint", "project_id": "bigint", "ok": "boolean", "duration_ms": "double", "at": "timestamp"}
ROWS = "tool string, " + ", ".join(f"{c} {k}" for c, k in COLUMNS.items())
STATE = ", ".join(f"{c} array<{'bigint' if c == 'at' else k}>" for c, k in COLUMNS.items())


def rings(calls: DataFrame, most: int = RING) -> DataFrame:
    """ROWS of a stream of calls: whenever a tool is called, its last `most` calls by time, then call_id.

    State is `most` calls a tool, whatever the stream brings; calls that come
    late take their place, and one that comes twice has one place. In the mode
    update.
    """

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame()
        if state.exists:
            held = pd.DataFrame(dict(zip(COLUMNS, map(list, state.get))))
        for b in batches:
            new = b[list(COLUMNS)].assign(at=b["at"].astype("datetime64[us]").astype("int64"))
            held = pd.concat([held, new]) if len(held) else new
            held = held.drop_duplicates("call_id").sort_values(["at", "call_id"], ascending=False).head(most)
        state.update(tuple(held[c].tolist() for c in COLUMNS))
        yield held.assign(at=pd.to_datetime(held["at"], unit="us"), tool=key[0])[["tool", *COLUMNS]]

    return calls.groupBy("tool").applyInPandasWithState(keep, ROWS, STATE, "update", GroupStateTimeout.NoTimeout)


def follow_rings(calls: DataFrame, table: str, checkpoint: str, most: int = RING):
    """Keep the rings of a stream of calls in a table: each batch writes those it changed; a batch that runs twice writes the same."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={n}")

    return rings(calls, most).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_calls(spark: SparkSession, table: str, most: int = RING) -> DataFrame:
    """The last calls of all tools, from the table of rings: a tool's last batch counts."""
    try:
        rows = spark.read.schema(ROWS + ", batch bigint").parquet(table)
    except AnalysisException:  # no batch yet
        return spark.createDataFrame([], ROWS)
    latest = rows.groupBy("tool").agg(F.max("batch").alias("batch"))
    return rows.join(latest, ["tool", "batch"]).select("tool", *COLUMNS).orderBy(F.desc("at"), F.desc("call_id")).limit(most)
