"""A training corpus from raw documents in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet
in the shared folder and reads it again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrywork.llm import chosen_path, exact_dedup, mixing, packing, toxicity
from quarrywork.llm.queries import tokenizer_path
from quarrywork.llm.scratch import Scratch
from quarrywork.session import ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger does not predict as toxic.

    Null and empty texts are scored as such and stay where they are not toxic; repeated rows are judged
    alike; an empty table gives an empty one; further columns are kept.
    """
    ship_package(spark)
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space.

    Null and empty texts are one group; of equal texts the longest stays, then the smallest doc_id; of rows
    repeated with their id, one.  An empty table gives an empty one; further columns are kept.
    """
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies.

    Texts without words link with nothing and stay; the smallest doc_id of a component stays (ids are whole
    numbers).  An empty table gives an empty one; further columns are kept.
    """
    ship_package(spark)
    return chosen_path.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them.

    A null source is a source, the last; documents without words are never taken; ties in size are in a fixed
    order by digest, so reruns agree.  An empty table gives an empty one; further columns are kept.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents placed in sequences of 2048 tokens.

    Null and empty texts are their end token alone; documents that the mix repeats are packed as often; very
    long ones are cut.  An empty table gives no pieces; further columns are left out.
    """
    ship_package(spark)
    return packing.pack(packing.pieces(docs, tokenizer_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages hold a trained model and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = tables.table(name, stage(spark, docs, sf_dir))
        if before:
            tables.drop(before)
        before = name
    return docs
