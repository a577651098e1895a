"""The corpus pipeline: from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. ``run`` writes
every stage's rows to the shared folder and hands the reread table to the next one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlog.functions.checkpoints import stored
from hushlog.llm.chunk_bpe import with_token_ids
from hushlog.llm.feistel import with_pseudonyms
from hushlog.llm.positional_index import decontaminated
from hushlog.llm.quality_rules import with_verdict
from hushlog.llm.shingle_join import one_of_each

#: Only for tables without real people; a real job sets ``hushlog.pii.key``.
SAMPLE_KEY = "a key for made-up documents only"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Null and empty texts have too few words and go."""
    return with_verdict(docs).where("kept").select(docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at 0.8: the one with the least id.

    Repeated rows are such a group too. Texts without words stay.
    """
    return one_of_each(docs, width=5, per_cent=80).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word passage of a benchmark item."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by pseudonyms, ``n_chars`` kept true."""
    key = spark.conf.get("hushlog.pii.key", SAMPLE_KEY).encode()
    done = with_pseudonyms(docs, key)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        length = F.when(F.size("pii") > 0, F.length("text")).otherwise(F.col("n_chars"))
        done = done.withColumn("n_chars", length.cast(kind))
    return done.select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``token_ids`` (little-endian unsigned 32-bit) of every document."""
    rows = with_token_ids(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    n_tokens = (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens")
    return rows.select("doc_id", n_tokens, "token_ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("n-gram Jaccard join", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("pseudonyms", pseudonymise),
    ("BPE encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0])
    return docs


#: The last stage's ids are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None
