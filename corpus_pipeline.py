"""The corpus pipeline: quality rules, n-gram Jaccard join, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. They are
written as Parquet between stages, here by ``run`` and in production by whoever schedules them.

Defined results of all stages: an empty table stays empty; columns of any name pass through as they are. Null and blank texts have no
words, so the rules reject them, and the later stages keep them: they are near copies of nothing, hold no benchmark item, are of size 0 to
the mix (which rounds them to no copy) and of one byte to the shards. Rows without an id are judged by the rules like others and are never near copies.
Repeated rows are judged alike: near copies are dropped by id, so rows of one id stay or go together; the mix gives rows equal in id and text their
copies as a group; shards count each. Ties are broken by id, then by hashes of id and text, so reruns agree. Texts are taken whole at any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import materialise, read
from lodestone.llm.decontamination import decontaminate
from lodestone.llm.mixing import apply_mix, mix_to_weights
from lodestone.llm.ngram_join import near_duplicates
from lodestone.llm.quality_rules import quality_rules
from lodestone.llm.sharding import shard_by_bytes


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules(docs).filter("kept").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 stays, that of the smallest id."""
    return near_duplicates(docs, n=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold four fifths of a benchmark item's five-word shingles go."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"), n=5, threshold=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice."""
    return apply_mix(docs, mix_to_weights(docs))


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Eight shards of nearly equal bytes: ``doc_id, size, text_crc32, shard, slot``."""
    return shard_by_bytes(docs, 8)


STAGES = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("sharding", deal_shards),
]

# Components of links and rounding by error diffusion are not expressible in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
