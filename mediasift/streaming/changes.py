"""The candidate list as a table that a stream keeps up to date, with what each batch added and updated (M4)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import registry as R
from ..options import CandidateOptions
from ..sinks.upsert import UpsertTable


class CandidateTable:
    """Candidates per ``by`` and day in the folder ``path``; observations of a day merge into that day's row."""

    def __init__(self, path: str, by: Sequence[str] = ("visit_id",), options: CandidateOptions = CandidateOptions(), buckets: int = 16):
        self.by, self.options = [*by, "day"], options
        self.table = UpsertTable(path, [*self.by, "candidate_key"], partial(R.merge_candidate_states, by=self.by), "day", buckets)

    def write(self, batch: DataFrame, number: int) -> None:
        """For ``foreachBatch`` over observations with the columns of ``by``."""
        self.table.apply(self._states(batch), number)

    def _states(self, observations: DataFrame) -> DataFrame:
        rows = R.filter_candidates(R.classify_observations(observations.withColumn("day", F.date_trunc("day", "ts"))), self.options)
        return R.candidate_state(rows, self.by)

    def read(self, observations: DataFrame) -> DataFrame:
        """The candidates now, with ``last_batch`` and ``last_change``. ``observations`` give the types of the columns only."""
        spark = observations.sparkSession
        return R.candidates_of_states(self.table.current(spark, self._states(observations).schema), self.by)

    def changes(self, observations: DataFrame, number: int) -> DataFrame:
        """What batch ``number`` did: candidates that were ``added`` or ``updated``, as they were after it."""
        spark = observations.sparkSession
        return R.candidates_of_states(self.table.changes(spark, self._states(observations).schema, number), self.by)


def stream_registry(observations: DataFrame, table: CandidateTable, checkpoint: str):
    """Start the stream that keeps ``table``; it takes what there is and ends."""
    writer = observations.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(table.write).start()
