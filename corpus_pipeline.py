"""A corpus from raw documents to packed sequences, in five stages of operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. ``run`` writes each stage's rows as Parquet to the shared folder and
reads them again as the documents of the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granula.llm import common, lines, mixing, near_duplicates, packing, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood-ratio thresholds.

    Null, empty and short texts go (fewer than 50 words); repeated rows and null doc_ids are judged
    each; ties with a threshold stay. An empty table stays empty; further columns go.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality(docs, labels, carry=tuple(COLUMNS)).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; documents of which no line is left go.

    Null and blank texts have no line to lose and stay. Of equal lines that in the smallest doc_id
    stays, there the first; null doc_ids come last; rows that repeat doc_id and text are one
    document. An empty table stays empty; further columns go.
    """
    rows = lines.dedup_lines(docs.select(*COLUMNS)).where("n_removed = 0 or n_removed < n_lines")
    return rows.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, that with the smallest doc_id.

    Rows that repeat a doc_id and text are one document; those with a null doc_id all stay, and so
    do texts without words. An empty table stays empty; further columns go.
    """
    gone = near_duplicates.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    # Few doc_ids repeat, so only their texts are shuffled.
    once = kept.join(repeated, "doc_id", "left_anti")
    return once.unionByName(kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; of one taken in part, its first words.

    Null, empty and blank texts have no words and go. Null sources are one source; repeated rows
    and null doc_ids count each. An empty table stays empty; further columns go.
    """
    mixed = mixing.mix(docs.select(*COLUMNS), common.word_count(F.col("text")))
    rest = (F.col("taken") - F.col("passes") * F.col("size")).cast("int")
    words = F.filter(F.split("text", common.SPACE), lambda w: w != "")
    rows = mixed.where("taken > 0").withColumn("passes", F.expr("taken div size")).withColumn("rest", rest)
    whole = rows.where("passes > 0").withColumn("again", F.explode(F.expr("sequence(1L, passes)"))).select(*COLUMNS)
    part = rows.where("rest > 0").withColumn("text", F.array_join(F.slice(words, 1, F.col("rest")), " "))
    return whole.unionByName(part.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with a checksum of their ids.

    Null and empty texts are the end id alone; repeated rows are packed each; an empty table gives
    no pieces. The workers' memory of pieces ends with their tasks, as they serve other stages too.
    """
    return packing.digest(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), lasting=False))


STAGES = [("quality", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix_sources), ("pack", pack)]

#: None: hashed likelihood ratios, MinHash components and tokenizers have no SQL form;
#: tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
