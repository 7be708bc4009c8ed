"""A training-data pipeline over ``documents``: rejects poor texts, removes copies, mixes sources, encodes."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.byte_bpe import bpe_round_trip
from strandlake.llm.exact_dedup import exact_dedup
from strandlake.llm.labelled import CUT
from strandlake.llm.mixing import mix_sources
from strandlake.llm.near_dedup import near_duplicates
from strandlake.llm.quality import fit_quality, score_quality
from strandlake.operators.antijoin import without_keys
from strandlake.storage import cut


def _numbered(docs: DataFrame) -> tuple[DataFrame, str, str, str]:
    """``docs`` with columns named by their places, so that extra columns clash with no name that a stage uses; and the
    names that doc_id, text and source have there."""
    at = docs.columns.index
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), f"c{at('doc_id')}", f"c{at('text')}", f"c{at('source')}"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranker, fitted on ``labels``, puts at its threshold or above.

    Null and empty texts are judged alike, by their empty text; very long ones whole; repeated rows alike. Without labels
    of both kinds everything is kept. An empty table stays empty; extra columns pass through, whatever their names.
    """
    model = fit_quality(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    plain, _, text, _ = _numbered(docs)
    good = score_quality(plain, model, text_col=text).where(F.col("score") >= CUT)
    return good.select(plain.columns).toDF(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of identical texts the document with the largest id.

    Null texts count as empty, and of those one document stays; a null id loses to any other, a group with null ids
    only stays whole, and so do repeated rows of the id that stays. An empty table stays empty; extra columns pass
    through, whatever their names.
    """
    plain, ident, text, _ = _numbered(docs)
    kept = exact_dedup(plain, text_col=text, id_col=ident, carry_text=True).where("kept")
    return kept.select(plain.columns).toDF(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that a similarity of 0.8 or more of their five-word shingles links, directly or through others, the
    one with the least id. (The query op8 has 0.85 by its contract.)

    Texts without words (null, empty) are linked with nothing and stay; very long ones are compared whole. Rows that
    share an id stay or go together: they stay if one of them does; rows with a null id stay. An empty table stays
    empty; extra columns pass through, whatever their names.
    """
    ids = near_duplicates(docs, percent=80, bands=42, rows=5).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    plain, ident, _, _ = _numbered(docs)
    gone = cut(ids.where(~F.col("kept")).select(F.col("doc_id").alias(ident)), "near-dropped")
    return without_keys(plain, gone, ident).select(plain.columns).toDF(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mix; sources that target weights demand more of come again (whole epochs).

    Every row comes at least once. A null source is a source of its own; null and empty texts count as one character; a
    very long text takes the block in which it starts; repeated rows are rows of their own. An empty table stays empty;
    extra columns pass through, whatever their names.
    """
    plain, ident, text, source = _numbered(docs)
    mixed = mix_sources(plain, source_col=source, id_col=ident, text_col=text, carry=True)
    return mixed.orderBy("slot", f"row.{source}", "place", f"row.{ident}").select("row.*").toDF(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): token ids of each document and the digest of what they decode to.

    Null and empty texts have no ids; very long ones are encoded whole; repeated rows alike; other columns end here. An
    empty table gives an empty table.
    """
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe_round_trip(docs, ranks, pattern).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("encode", encode)]

#: Classifier and tokenizer are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in their order over ``documents``; each result is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
