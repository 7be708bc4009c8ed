"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.byte_bpe import bpe_round_trip
from strandlake.llm.exact_dedup import exact_dedup
from strandlake.llm.filter_audit import audit, failures
from strandlake.llm.fingerprints import hashes, likeness, winnow, winnow_edited, with_next
from strandlake.llm.licenses import scan_licenses
from strandlake.llm.mixing import mix_sources
from strandlake.llm.labelled import CUT, fold
from strandlake.llm.near_dedup import near_duplicates
from strandlake.llm.quality import fit_quality, score_quality
from strandlake.llm.suffix_dedup import remove_repeats
from strandlake.llm.token_files import read_documents, write_token_files
from strandlake.llm.toxicity import fit_toxicity, score_toxicity
from strandlake.llm.warc import page_number, read_warc, write_warc
from strandlake.storage import fresh_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.unhex(F.sha2(text, 256)).alias("digest"))
    return exact_dedup(docs).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    files = write_warc(_table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, files, folder).select(
        page_number("record_id").alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        "record_type",
        page_number("refers_to").alias("refers_to"),
    )


OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS h,
             max(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((strpos('0123456789abcdef', substr(h || '00', (5 * i) // 4 + 1, 1)) - 1) * 256
         + (strpos('0123456789abcdef', substr(h || '00', (5 * i) // 4 + 2, 1)) - 1) * 16
         + (strpos('0123456789abcdef', substr(h || '00', (5 * i) // 4 + 3, 1)) - 1)) >> (7 - (5 * i) % 4)) % 32 + 1, 1)
         FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents")).drop("detections")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    beside = with_next(docs, "doc_id", "text", {"fp": winnow(F.col("text"))})
    n = F.char_length("text")
    same = n - F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), same), F.substring("next_text", F.lit(1), n - same))
    texts = beside.select("id", "fp", "next_fp", n.cast("long").alias("n_chars"), same.alias("same"), edited.alias("edited"))
    both = texts.select("*", winnow_edited(F.col("fp"), F.col("edited"), F.col("same")).alias("efp"))
    sets = both.select("*", hashes(F.col("fp")).alias("h"), hashes(F.col("efp")).alias("eh"), hashes(F.col("next_fp")).alias("nh"))
    return sets.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.sha2(F.to_json("fp"), 256).alias("fingerprint"),
        F.sha2(F.to_json("efp"), 256).alias("edited_fingerprint"),
        likeness(F.col("h"), F.col("eh")).alias("near_edited"),
        likeness(F.col("h"), F.col("nh")).alias("near_next"),
        F.size("fp").cast("long").alias("n_selected"),
    )


def _judged(scored: DataFrame, parts: int, held: int) -> DataFrame:
    return scored.select(
        "doc_id",
        (fold("doc_id", parts) == held).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, _table(spark, sf_dir, "labels"))
    return _judged(score_toxicity(docs, model), 3, 1)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe_round_trip(_table(spark, sf_dir, "documents"), ranks, pattern).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = fresh_path(spark, "tokens")
    files = write_token_files(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_documents(files, folder).withColumnRenamed("id", "doc_id")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, _table(spark, sf_dir, "labels"))
    return _judged(score_quality(docs, model), 4, 2)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fails = failures(_table(spark, sf_dir, "documents"))
    return audit(fails, _table(spark, sf_dir, "labels"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + least(5, len(words)) - 1], ' ') AS sh
  FROM w, unnest(range(1, greatest(2, len(words) - 3))) AS r(i) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""


OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
m AS (SELECT doc_id, part, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
        + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT
        + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * (doc_id > least)::INT AS mask FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY 1),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(bad), 0) AS bad FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bs FROM f a, f b, f c, f d, f e
      WHERE a.b + b.b + c.b + d.b + e.b = 31 AND (a.b | b.b | c.b | d.b | e.b) = 31),
s AS (SELECT filter_order, i AS step, bs[i] AS own, coalesce(list_sum(bs[1 : i - 1]), 0)::INT AS earlier FROM o, unnest([1, 2, 3, 4, 5]) AS r(i)),
j AS (SELECT *, mask & own <> 0 AS fails, mask & earlier <> 0 AS failed FROM c, s)
SELECT part, filter_order, step, coalesce(sum(n) FILTER (NOT fails AND NOT failed), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT failed), 0)::BIGINT AS removed,
       coalesce(sum(n) FILTER (fails AND failed), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
       coalesce(sum(good) FILTER (fails AND NOT failed), 0)::BIGINT AS good_lost, coalesce(sum(bad) FILTER (fails AND NOT failed), 0)::BIGINT AS toxic_lost,
       coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (fails), 0)::BIGINT AS shapley
FROM j GROUP BY 1, 2, 3
"""


OP12_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS x FROM d, unnest(range(0, n - 399)) AS r(i)),
r AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY x) > 1),
g AS (SELECT doc_id, i, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -401) > 400 AS fresh FROM r),
s AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
m AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM s GROUP BY doc_id, span),
k AS (SELECT m.doc_id, a, b, lag(b, 1, 0::BIGINT) OVER (PARTITION BY m.doc_id ORDER BY a) AS before FROM m),
j AS (SELECT doc_id, sum(b - a)::BIGINT AS gone, count(*) AS spans, max(b) AS tail, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS front
      FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN j USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_warc": op2_warc,
        "op3_license_scan": op3_license_scan,
        "op4_fingerprints": op4_fingerprints,
        "op5_toxicity": op5_toxicity,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_token_files": op7_token_files,
        "op8_minhash_near_dedup": op8_minhash_near_dedup,
        "op9_pfair_mixing": op9_pfair_mixing,
        "op10_quality": op10_quality,
        "op11_filter_audit": op11_filter_audit,
        "op12_suffix_dedup": op12_suffix_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op2_warc": OP2_SQL, "op8_minhash_near_dedup": OP8_SQL, "op11_filter_audit": OP11_SQL, "op12_suffix_dedup": OP12_SQL}
