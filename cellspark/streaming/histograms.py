"""Incremental histograms over arriving files of tokens (STR1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from cellspark.operators import kernels
from cellspark.operators.joins import remaining
from cellspark.operators.vectors import matrix, soft_histograms_by_cell

#: Timers and expiry need this store of states; without the second setting a run that works off what is there would wait for timers without end.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def stream_histograms(spark: SparkSession, tokens_path: str, vocabulary: DataFrame, out_path: str, checkpoint: str, beta: float = 10.0, schema: str = "cell_id BIGINT, tokens ARRAY<ARRAY<FLOAT>>", max_files: int = 64) -> StreamingQuery:
    """Works off all files that have arrived, then stops; cells already in ``out_path`` are skipped, so a restart or a file that comes twice changes nothing. The result equals the batch run's."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(tokens_path)

    def add(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates(["cell_id"])
        try:
            done = spark.read.parquet(out_path).select("cell_id")
        except Exception as e:  # nothing written yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            done = None
        todo = remaining(fresh, done, ["cell_id"]) if done is not None else fresh
        soft_histograms_by_cell(todo, vocabulary, beta).write.mode("append").parquet(out_path)

    return source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class CellHistogram(StatefulProcessor):
    """The state of one cell: the sum of its tokens' soft assignments, and which positions it has seen.

    A cell is given out once it has ``size`` tokens; its sum goes and a mark stays, so that a token
    that comes again starts nothing. A cell that has waited ``expire`` milliseconds since its
    last new token is given out as it is, incomplete. Marks are forgotten after as long.
    """

    def __init__(self, centroids: np.ndarray, size: int, beta: float, floor: float, expire: int):
        self.centroids, self.size, self.beta, self.floor, self.expire = kernels.unit_rows(centroids), size, beta, floor, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "seen array<int>, total array<double>")
        self.done = handle.getValueState("done", "at bigint", self.expire)

    def _row(self, key: tuple, seen: int, total: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"cell_id": [key[0]], "tokens": [seen], "complete": [seen >= self.size], "histogram": [total / max(total.sum(), self.floor)]})

    def _given_out(self, now: int) -> None:
        self.sums.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.done.update((now,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows)).dropna(subset=["pos", "token"]).drop_duplicates("pos")  # at most a few files' tokens of a cell
        if self.done.exists():
            return
        seen, total = self.sums.get() if self.sums.exists() else ((), np.zeros(len(self.centroids)))
        fresh = arrived[~arrived["pos"].isin(list(seen))]
        if not len(fresh):
            return
        tokens = kernels.unit_rows(np.array([np.asarray(t, np.float64) for t in fresh["token"]]))
        total = np.asarray(total) + kernels.soft_weights(tokens, self.centroids, self.beta, self.floor).sum(0)
        seen = [*seen, *fresh["pos"].astype(int).tolist()]
        now = timerValues.getCurrentProcessingTimeInMs()
        if len(seen) >= self.size:
            self._given_out(now)
            yield self._row(key, len(seen), total)
        else:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(now + self.expire)
            self.sums.update((seen, total.tolist()))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.sums.exists():
            seen, total = self.sums.get()
            self.sums.clear()
            self.done.update((timerValues.getCurrentProcessingTimeInMs(),))
            yield self._row(key, len(seen), np.asarray(total))

    def close(self) -> None:
        pass


def stream_token_histograms(
    spark: SparkSession, tokens_path: str, vocabulary: DataFrame, out_path: str, checkpoint: str, tokens_per_cell: int, beta: float = 10.0, floor: float = 1e-8, expire: int = 86_400_000, schema: str = "cell_id BIGINT, pos INT, token ARRAY<DOUBLE>", max_files: int = 64
) -> StreamingQuery:
    """Histograms of *token-major* files (``cell_id, pos, token``) whose cells may be spread over many files, batches and runs.

    Works off all files that have arrived, then stops; what cells still lack is kept as state under
    ``checkpoint``, and the next run goes on from there. A cell's histogram is written to
    ``out_path`` (``cell_id, tokens, complete, histogram``) once, when its last token is there or it
    has waited ``expire`` milliseconds, as found when the next files arrive. A position counts once, however often it comes; tokens with a null position
    or vector don't count. Files written are those that the sink's log names, so read ``out_path`` as a whole.
    """
    _, centroids = matrix(vocabulary)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(tokens_path).where("cell_id is not null")
    kind = source.schema["cell_id"].dataType.simpleString()
    rows = source.groupBy("cell_id").transformWithStateInPandas(CellHistogram(centroids, tokens_per_cell, beta, floor, expire), f"cell_id {kind}, tokens int, complete boolean, histogram array<double>", "Append", "ProcessingTime")
    before = {k: spark.conf.get(k) for k in SETTINGS}
    try:  # a query keeps the settings that it starts with
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        return rows.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
