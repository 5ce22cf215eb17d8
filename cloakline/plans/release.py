"""Two steps to publication: results are staged with what a reviewer needs, then promoted or discarded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloakline.operators import review
from cloakline.plans.deidentify import Options, anonymize, detect, replacements, results


def stage(blocks: DataFrame, staging: str, options: Options = Options()) -> None:
    """Write text (doc_id, block_ix, anonymized), review (results per document) and leaks under staging.

    Texts are searched once: what was found is written first, all else is made from it, and it is deleted in the end,
    as it holds values. Leaks are looked for in what was written, not in what should have been.
    """
    spark = blocks.sparkSession
    detect(blocks, options).write.mode("overwrite").parquet(f"{staging}/found")
    found = spark.read.parquet(f"{staging}/found")
    try:
        plain = found.select("doc_id", "block_ix", "text")
        anonymize(plain, options, spans=replacements(found, options)).select("doc_id", "block_ix", "anonymized").write.mode("overwrite").parquet(f"{staging}/text")
        text = spark.read.parquet(f"{staging}/text").withColumnRenamed("anonymized", "text")
        review.leak_findings(text, ["doc_id", "block_ix"]).write.mode("overwrite").parquet(f"{staging}/leaks")
        results(plain, options, found).drop("text").write.mode("overwrite").parquet(f"{staging}/review")
    finally:
        discard(spark, f"{staging}/found")


def promote(spark: SparkSession, staging: str, target: str, acknowledged: bool = False) -> None:
    """Write the staged text to target; raises LeakDetectedError on findings that nobody acknowledged."""
    if not acknowledged:
        review.assert_clean(spark.read.parquet(f"{staging}/leaks"))
    spark.read.parquet(f"{staging}/text").write.mode("overwrite").parquet(target)


def discard(spark: SparkSession, staging: str) -> None:
    """Delete what was staged, in whatever store it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(staging)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
