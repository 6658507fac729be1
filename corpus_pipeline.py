"""A training-data pipeline over ``documents``: filter, dedup, decontaminate, mix, shard."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from codelattice.llm import decontaminate, mixing, quality, sharding, simhash
from codelattice.llm.common import cut_paths, delete, delete_at_end, drop_cuts, read, shared_dir


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention classifier scores below one half go.

    Null and empty texts are scored as one empty passage, long ones whole.
    Repeated rows go or stay together. Without labels of both classes the
    share of the one class is every score. Rows keep all their columns,
    whatever these are called. An empty table stays empty.
    """
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.keep(docs, model, 0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays.

    Null and empty texts are equal texts. Different texts under one doc_id are
    decided each by itself; of equal rows one stays; rows without a doc_id
    stay only where no row of their group has one, and then one of them does.
    Extra columns stay. An empty table stays empty.
    """
    return simhash.near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go.

    Null and empty texts leak nothing, and neither do items without words.
    Repeated rows go or stay together. Extra columns stay. Without items, and
    with an empty table, nothing changes.
    """
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, or one to three times.

    Null and empty texts have size 0 and cost nothing. A null source is a
    source. Equal rows are taken by their number. Extra columns stay. An empty
    table stays empty.
    """
    return mixing.take(docs, mixing.mix(docs))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard.

    Null texts have zero bytes; a document above the limit is a shard by
    itself; rows that repeat a doc_id fill numbered pages. Columns called
    shard, depth, n_bytes or shard_bytes are replaced, others stay. An empty
    table stays empty.
    """
    return sharding.shard_documents(docs)


STAGES = [("quality classifier", quality_filter), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("source mixing", source_mixing), ("sharding", shards)]

#: SQL expresses neither the classifier nor the fingerprints nor the sampling;
#: tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents after all stages. What a stage wrote goes when the next one is written, the last when the driver ends."""
    docs, before = read(spark, sf_dir, "documents"), None
    base = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path, others = f"{base}/{number}", cut_paths()
        stage(spark, docs, sf_dir).write.parquet(path)
        drop_cuts(spark, others)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    delete_at_end(spark, base)
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
