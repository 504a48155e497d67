"""The corpus pipeline: documents through five operators, each stage written as Parquet and read again.

Language ID drops what has no language, near-dedup keeps one document of each class, decontamination drops documents
with benchmark items, the secret scan blanks secrets out, BPE adds token ids and the decoded text. All stages but the
last return the columns of ``documents``; each works on all rows that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import bpe, decontam, hdlang, neardup, secrets
from marlstone.llm.common import staged
from marlstone.llm.queries import BYTE_BPE, held_out

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Texts whose best cosine is below it have no language that was learnt.
LEAST_SCORE = 0.05


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (null and empty texts too) or far from every language.

    Rows without id or label teach nothing but are judged like the others; repeated rows are kept or rejected alike; if
    nothing was learnt, nothing is kept. Columns beyond those of ``documents`` are left out, here and in all stages.
    """
    prototypes = hdlang.fit_prototypes(docs.where(~held_out() & F.col("doc_id").isNotNull()))
    found = hdlang.identify_language(docs.select(COLUMNS), prototypes)
    return found.where((F.col("lang_pred") != hdlang.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class: the text and id that the operator chose; of rows that repeat both, one.

    Rows without id cannot be chosen and stay; null texts count as empty and are copies of each other.
    """
    found = neardup.near_duplicates(docs)
    kept = staged(found.where("chosen").groupBy("doc_id", "digest").agg(F.count("*").alias("n")), "kept")
    named = docs.where(F.col("doc_id").isNotNull()).select(*COLUMNS, neardup.digest_of("text").alias("digest"))
    once = named.join(kept.where("n = 1"), ["doc_id", "digest"], "left_semi")
    repeated = named.join(kept.where("n > 1"), ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"])
    return once.unionByName(repeated).select(COLUMNS).unionByName(docs.where(F.col("doc_id").isNull()).select(COLUMNS))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item. Null and empty texts hold none; repeated rows go or stay alike."""
    found = decontam.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=COLUMNS)
    return found.where(~F.col("contaminated")).select(COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blanks secrets out of the texts; n_chars follows where a text changed. Null texts stay null; no row is dropped."""
    clean = secrets.redact(secrets.scan_secrets(docs.select(COLUMNS)))
    return clean.withColumn("n_chars", F.when(F.size("secrets") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them; a null text counts as empty."""
    out = bpe.bpe_round_trip(docs.select("doc_id", "text"), BYTE_BPE)
    told = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(told, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language ID", language), ("near-dedup", one_of_each), ("decontamination", decontaminated), ("secret scan", without_secrets), ("BPE", tokens)]

#: Not expressible in SQL (consistent weighted sampling, SVD); tests hold run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged(docs, name.replace(" ", "-"))
    return docs
