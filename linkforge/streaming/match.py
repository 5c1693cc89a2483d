"""S1 records as a stream against static postings: each micro-batch is linked like a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from linkforge.functions import text as X
from linkforge.operators import retrieve as R


def link_stream(stream: DataFrame, targets: DataFrame, postings: DataFrame, kept: DataFrame, variant: R.Variant, sink, checkpoint: str) -> StreamingQuery:
    """Hands sink(candidates, batch_id) the candidates of each micro-batch; top-k is per record, so no state is kept.

    postings and kept are static tables, written once. sink must be idempotent by batch_id.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        s1 = X.prepare(batch).withColumnRenamed("entity_id", "s1")
        sink(R.candidates(s1, targets, variant, postings=postings, kept=kept), batch_id)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
