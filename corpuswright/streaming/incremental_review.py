"""The review gate over rules that arrive as a stream: an extension, each micro-batch passes the batch gate once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import review


def review_stream(rules: DataFrame, canons: list[str], feelings: list[str], posthoc: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """Writes reviewed rules and their audit under `out`, a folder a micro-batch, so that a batch that runs again overwrites
    its own output and nothing is counted twice. The gate works row by row: the stream keeps no state."""

    def one(batch: DataFrame, number: int) -> None:
        judged = review.review(batch, canons, feelings, posthoc).persist()
        judged.select("doc_id", "rule_id", "score", "level", "repaired").write.mode("overwrite").parquet(f"{out}/decisions/batch={number}")
        review.audit(judged).write.mode("overwrite").parquet(f"{out}/audit/batch={number}")
        judged.unpersist()

    return rules.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
