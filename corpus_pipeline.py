"""From raw documents to packed training windows: five stages, each on all that the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from thermoband.llm import quality, secret_scan
from thermoband.llm.common import table
from thermoband.llm.decontaminate import remove_affected
from thermoband.llm.packing import pack
from thermoband.llm.simhash import one_of_each
from thermoband.session import remove_folder, shared_dir, ship_package


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    ship_package(spark)
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints link."""
    ship_package(spark)
    return one_of_each(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    ship_package(spark)
    return remove_affected(docs, table(spark, sf_dir, "benchmark"))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked."""
    ship_package(spark)
    return secret_scan.mask_secrets(docs, secret_scan.fit(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in training windows."""
    ship_package(spark)
    return pack(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", no_near_duplicates),
    ("benchmark", no_benchmark),
    ("secrets", no_secrets),
    ("packing", packed),
]

#: Fingerprints, forests and token ids have no SQL: tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over `documents`; what each one returns is written to the shared folder and read again,
    and removed when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_folder(spark, before)
        before = path
    return docs
