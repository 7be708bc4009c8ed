"""The driver's star-schema tables read as sequences, families and instances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "1992-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nucleotides(text: str = "text"):
    """The letters a, c, g and t of a text, upper-cased."""
    return F.upper(F.regexp_replace(F.lower(text), "[^acgt]", ""))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_index, seq) of documents."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_index"), nucleotides().alias("seq"))


def consensi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(family_id, consensus, consensus_length) of benchmark passages."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("family_id"), nucleotides().alias("consensus"))
    return rows.withColumn("consensus_length", F.length("consensus"))


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as intervals: part = family, supplier = record, shipping day = start, quantity = length."""
    start = F.datediff(F.to_date("l_shipdate"), F.lit(EPOCH).cast("date")).cast("long")
    size = F.col("l_quantity").cast("int")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("family_id"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")).alias("instance_idx"),
        F.col("l_suppkey").alias("seq_index"), start.alias("start"), (start + size).alias("end"), size.alias("aligned_length"),
        F.floor(F.col("l_discount") * F.col("l_quantity")).cast("int").alias("num_edits"), (F.col("l_discount") * 4).alias("divergence"),
        F.when(F.col("l_returnflag") == "N", 1).otherwise(-1).alias("strand"),
    )


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(family_id, consensus_length) of parts."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("family_id"), (10 + 5 * F.col("p_size")).alias("consensus_length"))


def brand_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``instances`` with the number of the part's brand as family: few families of many instances."""
    brand = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("family_id"), F.regexp_extract("p_brand", r"(\d+)", 1).cast("long").alias("_brand"))
    joined = instances(spark, sf_dir).join(brand, "family_id").drop("family_id")
    return joined.withColumnRenamed("_brand", "family_id")


#: The same as common table expressions.
SEQS = "seqs AS (SELECT doc_id AS seq_index, upper(regexp_replace(lower(text), '[^acgt]', '', 'g')) AS seq FROM documents)"
CONS = (
    "cons AS (SELECT *, length(consensus) AS consensus_length FROM (SELECT item_id AS family_id, "
    "upper(regexp_replace(lower(text), '[^acgt]', '', 'g')) AS consensus FROM benchmark))"
)
INST = """inst AS (SELECT l_partkey AS family_id, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS instance_idx, l_suppkey AS seq_index,
  date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS "start", date_diff('day', DATE '1992-01-01', l_shipdate::DATE) + l_quantity::INT AS "end",
  l_quantity::INT AS aligned_length, floor(l_discount * l_quantity)::INT AS num_edits, l_discount * 4 AS divergence,
  CASE WHEN l_returnflag = 'N' THEN 1 ELSE -1 END AS strand FROM lineitem)"""
FAMS = "fams AS (SELECT p_partkey AS family_id, 10 + 5 * p_size AS consensus_length FROM part)"
BRANDS = (
    INST + ", binst AS (SELECT regexp_extract(p_brand, '(\\d+)', 1)::BIGINT AS family_id, i.* EXCLUDE (family_id) "
    "FROM inst i JOIN part ON p_partkey = i.family_id)"
)


def kmers_cte(k: int, source: str = "seqs", key: str = "seq_index", seq: str = "seq", name: str = "km") -> str:
    """All k-mers of ``source`` with their canonical form and strand."""
    return (
        f"{name}0 AS (SELECT {key} AS seq_index, pos, substr({seq}, pos + 1, {k}) AS f FROM {source}, unnest(range(0, length({seq}) - {k} + 1)) AS r(pos)), "
        f"{name} AS (SELECT seq_index, pos, least(f, reverse(translate(f, 'ACGT', 'TGCA'))) AS kmer, f > reverse(translate(f, 'ACGT', 'TGCA')) AS is_rev FROM {name}0)"
    )
