"""A folder of arriving documents, de-identified batch by batch and staged before release."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloakline.plans.deidentify import Options, anonymize
from cloakline.operators.review import leak_findings


def stream(spark: SparkSession, source: str, schema: str, staging: str, checkpoint: str, options: Options = Options()):
    """Query that stages (doc_id, block_ix, anonymized) and leak findings of Parquet blocks arriving under source.

    Documents are whole within a file, so numbering needs no state between
    batches. A batch that is run again overwrites its own folder.
    """

    def stage(batch: DataFrame, number: int) -> None:
        out = anonymize(batch, options).select("doc_id", "block_ix", "anonymized")
        out.write.mode("overwrite").parquet(f"{staging}/text/batch={number}")
        again = spark.read.parquet(f"{staging}/text/batch={number}").withColumnRenamed("anonymized", "text")
        leak_findings(again, ["doc_id"]).write.mode("overwrite").parquet(f"{staging}/leaks/batch={number}")

    arriving = spark.readStream.schema(schema).parquet(source)
    return arriving.writeStream.foreachBatch(stage).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
