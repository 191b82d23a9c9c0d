"""New clients as a stream: each micro-batch is assigned against the labels as they stand, and added.

Assignment looks at existing labels and at distances only, so a late client is simply in a later
batch. Both tables are read anew for each batch; a batch that is replayed after a failure overwrites
its own rows, named by the batch's number, and nothing else."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Assign = Callable[[DataFrame, DataFrame], DataFrame]


def assign_stream(arrivals: DataFrame, labelled: DataFrame, assign: Assign, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query that writes branch, client_idx, label and cost of the arrivals to path, a folder for
    each batch. assign(new, labelled) is one of zonewright.operators.assign's rules; the labelled
    table is the clients with their labels, to which those of earlier batches are added."""
    columns = ["branch", "client_idx", "lat", "lon", "office_km", "label"]

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = labelled.select(*columns)
        if number:
            known = known.unionByName(spark.read.parquet(path).filter(F.col("batch") < number).select(*columns))
        chosen = assign(batch, known).join(batch.select("branch", "client_idx", "lat", "lon", "office_km"), ["branch", "client_idx"])
        chosen.select(*columns, "cost").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return arrivals.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
