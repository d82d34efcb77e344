"""A training-corpus pipeline from the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
every stage's result to the shared scratch folder and rereads it as the next
stage's documents.  All stages but the last keep the columns of
``documents``; a stage works on everything its predecessor kept:

1. ``toxicity`` drops documents with a toxicity score of 0.5 or more;
2. ``near_dedup`` keeps the smallest doc_id of each group of near duplicates
   (five-word shingles, Jaccard 0.8; rows of one doc_id are judged by their own text);
3. ``suffix_dedup`` cuts byte runs of 100 or more that occur earlier, and drops
   documents of which nothing is left;
4. ``decontamination`` cuts spans that match benchmark items, and drops documents
   that consist mostly of them;
5. ``mixing`` gives every document its rate in the final mix.

Nulls: a null text is an empty one to every stage and stays null unless cut; a
row with a null doc_id comes after all ids and is kept, cut or dropped by its own text;
extra columns pass through; empty input gives empty output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.llm import common as C
from quiver.llm import decontamination as decon
from quiver.llm import minhash_dedup, mixing, suffix_array_dedup
from quiver.llm import toxicity as tox

#: Words of a shingle in the near-duplicate stage.
SHINGLE = 5
#: Shares of tokens in the mix; toxic documents are gone by then.
TARGETS = {"good": 0.87, "plain": 0.13, "toxic": 0.0}


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    model = tox.fit(docs, C.table(spark, sf_dir, "labels"))
    return tox.scores(docs, model).where("toxicity < 0.5").drop("toxicity")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = minhash_dedup.near_duplicate_rows(docs, SHINGLE)
    gone = C.written(found.where("not kept").select(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).distinct(), "near-copies")
    near, clean = C.split_by(docs.withColumn("__row", minhash_dedup.row_hash()), gone, "__row")
    same = near["doc_id"].cast("long").eqNullSafe(gone["__id"]) & (near["__row"] == gone["__row"])
    return clean.unionByName(near.join(gone, same, "left_anti")).drop("__row")


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kind = docs.schema["doc_id"].dataType
    docs, first = C.with_ids(docs)
    found = suffix_array_dedup.remove_duplicates(docs)
    text = F.pandas_udf(suffix_array_dedup.whole_characters, "string")
    cut = C.written(found.where("n_removed > 0").select("doc_id", text("kept").alias("__kept")).dropDuplicates(["doc_id"]), "cut-texts")
    near, clean = C.split_by(docs, cut)
    part = near.join(cut, "doc_id", "left").where("__kept is null or __kept != ''")
    new = {"text": F.coalesce("__kept", "text"),
           "n_chars": F.when(F.col("__kept").isNotNull(), F.char_length("__kept")).otherwise(F.col("n_chars")).cast("long") if "n_chars" in docs.columns else None}
    columns = [new[c].alias(c) if new.get(c) is not None else F.col(c) for c in docs.columns]
    return C.without_ids(clean.unionByName(part.select(*columns)), first, kind)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decon.decontaminate(docs, C.table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, C.table(spark, sf_dir, "labels"), TARGETS)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("mixing", source_mixing),
]

#: Learned scores and fitted rates have no SQL; tests compare every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
