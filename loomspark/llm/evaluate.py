"""Held-out accuracy of the reading levels: ``python -m loomspark.llm.evaluate DIR``.

The grader is fitted on one half of the labelled documents, by a hash of the id, and judged on the other.
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomspark.llm.lang import train_languages
from loomspark.llm.reading import reading_levels
from loomspark.llm.tokenize import canonical_language
from loomspark.runtime import clear, local_session, table


def held_out(documents: DataFrame, labels: DataFrame, row: str, text: str, lang: str) -> dict[str, float]:
    """Mean absolute error and correlation on the half that isn't fitted, and the error of the constant that is best there."""
    judged = labels.where("level IS NOT NULL").groupBy(row).agg(F.avg("level").alias("true"))
    half = F.pmod(F.xxhash64(row, F.lit("half")), F.lit(2)) == 0
    model = train_languages(documents, lang, text)
    levels = reading_levels(documents.select(row, text), labels.where(half), row, text, model).where("level IS NOT NULL")
    both = levels.join(judged.where(~half), row).select(F.col("level").cast("double").alias("level"), "true").cache()
    found = both.agg(F.count("*").alias("documents"), F.avg(F.abs(F.col("level") - F.col("true"))).alias("error"), F.corr("level", "true").alias("correlation"), F.median("true").alias("median")).first().asDict()
    found["constant_error"] = both.agg(F.avg(F.abs(F.col("true") - found["median"]))).first()[0]
    both.unpersist()
    return found


def main(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", canonical_language(F.col("lang")).alias("lang"))
    return held_out(documents, table(spark, sf_dir, "level_labels"), "doc_id", "text", "lang")


if __name__ == "__main__":
    session = local_session()
    print(json.dumps(main(session, sys.argv[1])))
    clear(session)
