"""From raw documents to packed training sequences, in five stages that each call one operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result to the
shared folder as Parquet and hands what is read back to the next stage. All stages but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from relcheck.llm import decontam, lang_id, packing, similar, suffix_dedup
from relcheck.llm.textscan import discard, fits, scratch, set_apart, staged

#: Keys of kept documents that a broadcast may hold (16 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 2_000_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: null texts, no letter, or no n-gram that any language has."""
    return lang_id.told(docs, lang_id.learn(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (five-word shingles, Jaccard 0.8) one document stays, once.

    It is the one with the least id; of several texts under that id the one with the least hash; of rows
    that repeat both, the one with the least other columns. Rows without an id can't be named by a
    component and stay.
    """
    with scratch(spark) as keep:
        found = similar.near_duplicate_rows(docs)
        first = found.where((F.col("doc_id") == F.col("rep.doc_id")) & (F.col("row") == F.col("rep.row")))
        kept = keep(first.groupBy(F.col("doc_id").alias("kept id"), F.col("row").alias("kept row")).agg(F.count("*").alias("rows")))

    def rows_of(keys: DataFrame) -> DataFrame:
        same = (docs["doc_id"] == keys["kept id"]) & (F.xxhash64(docs["text"]) == keys["kept row"])
        return docs.join(fits(keys, MOST_BROADCAST), same, "left_semi")

    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    repeated = rows_of(kept.where("rows > 1")).groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0).alias("no column"), *others)).alias("least"))
    once = repeated.select(*(F.col(c) if c in ("doc_id", "text") else F.col(f"least.`{c}`") for c in docs.columns))
    return rows_of(kept.where("rows = 1")).union(once).union(docs.where(F.col("doc_id").isNull()))


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every passage of 50 words or more that an earlier document, or the same one, has already."""
    return suffix_dedup.without_repeats(docs).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages from texts; documents of which no word is left go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    apart, renamed = set_apart(docs, "doc_id", "text")
    found = decontam.contamination(apart, benchmark, clean_text=True, keep=tuple(renamed.values()))
    found = found.where((F.col("n_words") > F.col("n_hit")) | ~F.col("contaminated"))
    values = {"text": F.col("clean")} | {old: F.col(new) for old, new in renamed.items()}
    if "n_chars" in renamed:
        values["n_chars"] = F.when(F.col("contaminated"), F.length("clean").cast("long")).otherwise(values["n_chars"])
    return found.select(*(values.get(c, F.col(c)).alias(c) for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("decontamination", decontaminate),
    ("packing", pack_sequences),
]

#: Stages hash, tokenise and follow links, which SQL can't express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
