"""Streaming appends: each micro-batch of a stream becomes one snapshot of a table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidelake.sources import files
from tidelake.sources.table import Table


def append_stream(stream: DataFrame, location: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream to a table. A batch that was committed before a restart isn't appended again.

    The batch number is kept in the table's properties by the commit that adds the batch's rows, under the stream's own
    id, which its checkpoint folder holds: several streams may append to one table.
    """

    def put(batch: DataFrame, number: int) -> None:
        table = Table.open(batch.sparkSession, location)
        key = f"stream.{json.loads(files.read_bytes(batch.sparkSession, f'{checkpoint}/metadata'))['id']}.last-batch"
        done = int(table.meta.raw.setdefault("properties", {}).get(key, -1))
        if number > done and not batch.isEmpty():
            table.meta.raw["properties"][key] = str(number)
            table.append(batch)

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
