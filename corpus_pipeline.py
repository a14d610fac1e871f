"""A corpus pipeline: toxicity, SimHash near-dedup, substring dedup, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which ``run`` writes as
Parquet to the shared folder and reads back for the next one. Defined cases (nulls, empty
tables, repeated rows) are those of the operators. Texts that substring dedup or mixing cut
have their words joined by one space, so they lose their line breaks; others stay as they are.
The last stage returns pieces with their token ids and their place in a sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.llm import mixing, packing, simhash, substring_dedup, toxicity
from stackloom.llm.common import table, unused
from stackloom.session import shared_path

#: Pieces packed by one task, whose token ids it holds: fewer than where lengths are packed alone.
GROUP_PIECES = 10_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each_group(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    words, removed = unused(docs, "words"), unused(docs, "removed")
    cut = substring_dedup.remove_repeats(docs, counts=(words, removed))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long"))
    return cut.select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(docs).withColumn("ids_crc32", F.crc32("ids"))
    return packing.pack(pieces, group_pieces=GROUP_PIECES)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL has no factorization machine, no XXH64 and no tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
