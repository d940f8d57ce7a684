"""A training-data pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet to the shared folder and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lociweave.llm import fm_decontam, golay_simhash, pivotal_mix, slot_sharding, toxicity_kn
from lociweave.llm.common import cut_lineage, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go; wordless texts stay, repeated rows go together."""
    return toxicity_kn.drop_toxic(docs, toxicity_kn.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group: the smallest doc_id.  Texts are linked by operator 8's Golay
    keys and fingerprints (three bits), and by a Jaccard similarity of five-word shingles of 0.8 or
    more, which fingerprints miss; null and wordless texts are one group, null ids stay."""
    return golay_simhash.keep_one(docs, jaccard=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go; wordless texts stay."""
    return fm_decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out to bring the sources to their target weights; a null
    source is a source, wordless texts are left out, repeated rows are dealt one by one."""
    return pivotal_mix.mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document, copies one by one, gets a shard and a position in it; an empty
    table gives an empty result."""
    return slot_sharding.shard_documents(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: The toxicity, fingerprint and rounding steps have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
