"""Row rules on a stream of rows.

The rules are stateless Columns, so the batch plan runs on a stream unchanged;
checks over several rows need whole batches and have no streaming form here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.plans.rules import issues, row_rules


def stream_issues(rows: DataFrame, as_of: str, path: str, checkpoint: str, keep: tuple[str, ...] = ("row_num",)) -> StreamingQuery:
    """Append the issues of arriving rows to Parquet files; ends when all that is there has been read."""
    found = issues(rows, row_rules(rows.columns, as_of), list(keep))
    return found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
