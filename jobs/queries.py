"""The jobs as registered queries: each runs twice into one new folder, and what the second run leaves is the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import annotation_tracks, kmer_catalogue
from strandlake import queries as own
from strandlake.storage import fresh_path


def job1_kmer_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "job1")
    for _ in range(2):
        out = kmer_catalogue.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/out", f"{folder}/checkpoint")
    return out


def job2_annotation_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "job2")
    for _ in range(2):
        out = annotation_tracks.run(spark, sf_dir, folder)
    return out


#: K-mers of ``own.K`` bases, which is also what kmer_catalogue.json asks for.
KMER_CATALOGUE_SQL = f"""{own._FREQ}
SELECT kmer, freq, {own._ENTROPY} > -0.70 OR len([p FOR p IN range(1, {own.K} // 2 + 1) IF {own.K} - p >= 4 AND
    len([i FOR i IN range(1, {own.K} - p + 1) IF substr(kmer, i, 1) = substr(kmer, i + p, 1)]) * 100 >= ({own.K} - p) * 85]) > 0 AS low_complexity,
  substr(kmer, 1, 2) AS lead FROM freq WHERE freq >= 2"""

ANNOTATION_TRACKS_SQL = own._SCORES + r""",
    o AS (SELECT regexp_extract(p_brand, '(\d+)', 1)::INT AS class, i.*, round(savings - cost, 6) AS bits FROM inst i JOIN sc USING (family_id) JOIN part ON p_partkey = i.family_id
      WHERE savings > cost AND n >= 3 AND i.divergence <= 0.2 AND "end" > "start"),
    f AS (SELECT *, coalesce("start" > max("end") OVER (PARTITION BY class, seq_index ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM o),
    g AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY class, seq_index ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS item FROM f),
    t AS (SELECT class, seq_index, item, min("start") AS "start", max("end") AS "end", count(*) AS instances, count(DISTINCT family_id) AS families,
      round(sum(divergence * ("end" - "start")) / sum("end" - "start"), 6) AS divergence, first(family_id ORDER BY bits DESC, family_id) AS best_family FROM g GROUP BY 1, 2, 3)
    SELECT seq_index, "start", "end", instances, families, divergence, greatest(0, least(1000, trunc(1000 * (1 - divergence))))::INT AS score, best_family, class FROM t"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"job1_kmer_catalogue": job1_kmer_catalogue, "job2_annotation_tracks": job2_annotation_tracks}


def oracle_sql() -> dict[str, str]:
    return {"job1_kmer_catalogue": KMER_CATALOGUE_SQL, "job2_annotation_tracks": ANNOTATION_TRACKS_SQL}
