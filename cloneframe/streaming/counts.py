"""Expression counts and dereplication over streams of assignments or reads.

Both are plain aggregations, so the batch operators' definitions hold in `complete` or `update` mode. `write` commits
each micro-batch's table as Parquet of its own, so a restart after a lost driver writes the same batch again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cloneframe.functions.names import call_column
from cloneframe.operators import copies


def expression_counts(stream: DataFrame, gene_type: str) -> DataFrame:
    call = call_column(gene_type)
    return stream.filter(f"coalesce({call}, '') <> ''").groupBy(F.col(call).alias("gene")).agg(F.count(F.lit(1)).alias("count"))


def dereplicate(stream: DataFrame, barcode_length: int = 0, trim_g: bool = False) -> DataFrame:
    return copies.dereplicate(stream, barcode_length, trim_g)


def write(table: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    out = table.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
