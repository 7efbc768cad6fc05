"""Documents as they arrive: a stream of the documents source, captured into a workspace batch by batch."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sinks.workspace import Workspace
from ..sources.documents import register


def stream(spark: SparkSession, paths: Sequence[str], seen_log: str, text: bool = True, state: bool = False, content: bool = False) -> DataFrame:
    """Rows of the documents source for files that are new or changed since the last batch. ``seen_log`` is a folder of this stream
    alone, as its checkpoint is."""
    register(spark)
    options = {"paths": json.dumps(list(paths)), "withText": str(text), "withState": str(state), "withContent": str(content), "seenLog": seen_log}
    return spark.readStream.format("documents").options(**options).load()


def capture_stream(spark: SparkSession, paths: Sequence[str], workspace: Workspace, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Captures each batch. Capture is idempotent, so a batch that is run again after a failure adds nothing twice."""
    if not workspace.exists():
        workspace.create(list(paths))

    def keep(batch: DataFrame, _: int) -> None:
        workspace.capture(batch)

    out = stream(spark, paths, f"{checkpoint}/seen-files", state=True, content=True).writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out.trigger(processingTime="10 seconds")).start()
