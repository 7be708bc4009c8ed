"""Registered queries of the library's own operators and the same results as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake import adapters as A
from strandlake.functions import mdl
from strandlake.functions import seq as S
from strandlake.operators import assemble, discover, evaluate, intervals, kernels, kmers, merge, recruit, rescue, scale, select, split
from strandlake.operators.graph import connected_components
from strandlake.plans import config, pipeline
from strandlake.sources import fasta_ranges, tables
from strandlake.storage import cut, fresh_path

K = 10
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def _km(spark: SparkSession, d: str) -> DataFrame:
    return kmers.kmer_rows(A.sequences(spark, d), K)


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return kmers.count_kmers(A.sequences(spark, d), K)


_KM = f"WITH {A.SEQS}, {A.kmers_cte(K)}"
_FREQ = (
    _KM + ", lagged AS (SELECT *, lag(pos) OVER (PARTITION BY kmer, is_rev, seq_index ORDER BY pos) AS before FROM km), "
    "freq AS (SELECT kmer, sum(CASE WHEN before IS NULL OR pos - before >= 500 THEN 1 ELSE 0 END)::BIGINT AS freq FROM lagged GROUP BY kmer)"
)


@_query(f"WITH {A.SEQS} SELECT seq_index, seq, length(seq)::BIGINT AS length FROM seqs")
def seq_projection(spark, d):
    return A.sequences(spark, d).select("seq_index", "seq", F.length("seq").cast("long").alias("length"))


@_query(
    f"""WITH {A.SEQS} SELECT count(*) AS num_seqs, sum(length(seq))::BIGINT AS sum_len, min(length(seq)) AS min_len, round(avg(length(seq)), 6) AS avg_len,
    max(length(seq)) AS max_len, round(sum(length(regexp_replace(seq, '[^GC]', '', 'g'))) / sum(length(seq)), 6) AS gc FROM seqs"""
)
def fasta_like_stats(spark, d):
    return tables.sequence_statistics(A.sequences(spark, d)).withColumns({c: F.round(c, 6) for c in ("avg_len", "gc")})


@_query(_FREQ + " SELECT kmer, freq FROM freq")
def kmer_count_canonical(spark, d):
    return _counts(spark, d)


@_query(_FREQ + " SELECT kmer, freq FROM freq")
def kmer_count_fasta_ranges(spark, d):
    """The sequences written as FASTA files, read again by byte ranges of a megabyte and counted from tiles."""
    seqs, path = A.sequences(spark, d), fresh_path(spark, "fasta")
    seqs.select(F.concat(F.lit(">"), F.col("seq_index").cast("string"), F.lit("\n"), S.wrap("seq"))).write.text(path)
    parts = fasta_ranges.read_parts(spark, path, 1 << 20)
    return kmers.count_in_tiles(fasta_ranges.tiles(parts, before=499, after=K - 1), K)


_SPAN = f"""WITH {A.SEQS}, placed AS (SELECT seq_index, seq, sum(length(seq)) OVER (ORDER BY seq_index) - length(seq) AS g0 FROM seqs),
    chars AS (SELECT seq_index, pos, g0 + pos AS g, substr(seq, pos + 1, 1) AS c FROM placed, unnest(range(0, length(seq))) AS r(pos)),
    km0 AS (SELECT seq_index, pos, g, c || {" || ".join(f"lead(c, {i}) OVER o" for i in range(1, K))} AS f FROM chars WINDOW o AS (ORDER BY g)),
    km AS (SELECT seq_index, pos, g, least(f, reverse(translate(f, 'ACGT', 'TGCA'))) AS kmer, f > reverse(translate(f, 'ACGT', 'TGCA')) AS is_rev FROM km0 WHERE f IS NOT NULL),
    lagged AS (SELECT kmer, g, lag(g) OVER (PARTITION BY kmer, is_rev ORDER BY g) AS before FROM km)"""


@_query(_SPAN + " SELECT kmer, sum(CASE WHEN before IS NULL OR g - before >= 500 THEN 1 ELSE 0 END)::BIGINT AS freq FROM lagged GROUP BY kmer")
def kmer_count_spanning(spark, d):
    return kmers.count_spanning(A.sequences(spark, d), K)


@_query(_FREQ + " SELECT kmer, freq FROM freq WHERE freq >= 2")
def kmer_trim(spark, d):
    return kmers.frequent(_counts(spark, d))


@_query(
    _FREQ + """ SELECT CASE WHEN freq < 10 THEN freq::VARCHAR WHEN freq < 100 THEN '10-99' WHEN freq < 1000 THEN '100-999'
    WHEN freq < 10000 THEN '1000-9999' ELSE '10000+' END AS bin, count(*) AS kmers FROM freq GROUP BY 1"""
)
def kmer_freq_histogram(spark, d):
    return kmers.histogram(_counts(spark, d))


@_query(
    _FREQ + """, r AS (SELECT k.*, row_number() OVER (PARTITION BY kmer ORDER BY seq_index, pos) AS rank FROM km k JOIN freq USING (kmer) WHERE freq >= 2)
    SELECT kmer, seq_index, pos, is_rev, rank FROM r WHERE rank <= 50000"""
)
def kmer_positions_capped(spark, d):
    return kmers.capped_positions(A.sequences(spark, d), K)


_ENTROPY = " + ".join(
    f"(CASE WHEN strpos(kmer, '{b}') > 0 THEN ({K} - length(replace(kmer, '{b}', ''))) / {K}.0 * ln(({K} - length(replace(kmer, '{b}', ''))) / {K}.0) ELSE 0 END)"
    for b in "ACGT"
)


@_query(_KM + f", u AS (SELECT DISTINCT kmer FROM km) SELECT kmer, round({_ENTROPY}, 6) AS entropy FROM u WHERE {_ENTROPY} <= -0.70")
def kmer_entropy_filter(spark, d):
    return _counts(spark, d).where(~S.low_entropy("kmer")).select("kmer", F.round(S.entropy("kmer"), 6).alias("entropy"))


@_query(
    _KM + f""", u AS (SELECT DISTINCT kmer FROM km)
    SELECT kmer, len([p FOR p IN range(1, {K} // 2 + 1) IF {K} - p >= 4 AND
      len([i FOR i IN range(1, {K} - p + 1) IF substr(kmer, i, 1) = substr(kmer, i + p, 1)]) * 100 >= ({K} - p) * 85]) > 0 AS periodic FROM u"""
)
def kmer_periodicity_filter(spark, d):
    return _km(spark, d).select("kmer").distinct().select("kmer", S.periodic("kmer").alias("periodic"))


@_query(
    _KM + """, u AS (SELECT DISTINCT f FROM km0) SELECT f AS fwd, reverse(translate(f, 'ACGT', 'TGCA')) AS rc,
    least(f, reverse(translate(f, 'ACGT', 'TGCA'))) AS canon, f > reverse(translate(f, 'ACGT', 'TGCA')) AS is_rev FROM u"""
)
def revcomp_canonical(spark, d):
    both = _km(spark, d).select(F.when(F.col("is_rev"), S.reverse_complement("kmer")).otherwise(F.col("kmer")).alias("fwd")).distinct()
    return both.select("fwd", S.reverse_complement("fwd").alias("rc"), S.canonical("fwd").alias("canon"), S.is_reverse("fwd").alias("is_rev"))


@_query(f"WITH {A.SEQS} SELECT ceil(1 + ln(sum(length(seq))) / ln(4))::INT AS k FROM seqs")
def auto_k(spark, d):
    return A.sequences(spark, d).agg(F.sum(F.length("seq")).alias("n")).select(S.auto_k("n").alias("k"))


@_query(
    _FREQ + """, last AS (SELECT kmer, max(struct_pack(s := seq_index, p := pos)) AS x FROM km GROUP BY kmer)
    SELECT kmer AS lmer, freq, x.s AS seq_index, x.p AS pos FROM freq JOIN last USING (kmer)"""
)
def lmer_table_export(spark, d):
    rows = _km(spark, d)
    return kmers.export_table(rows, _counts(spark, d))


@_query(_FREQ + " SELECT kmer, freq FROM freq ORDER BY freq DESC, kmer LIMIT 20")
def seed_topk(spark, d):
    return kmers.seeds(_counts(spark, d), 20)


@_query(
    _FREQ + """, top AS (SELECT kmer FROM freq ORDER BY freq DESC, kmer LIMIT 20), r AS (
    SELECT kmer, seq_index, pos, is_rev, row_number() OVER (PARTITION BY kmer ORDER BY seq_index DESC, pos DESC) AS rank
    FROM km WHERE kmer IN (SELECT kmer FROM top) AND NOT (pos >= seq_index % 50 AND pos < 100))
    SELECT kmer, seq_index, pos, is_rev, rank FROM r WHERE rank <= 10000"""
)
def occurrence_gather_capped(spark, d):
    rows = _km(spark, d)
    masked = A.sequences(spark, d).select("seq_index", (F.col("seq_index") % 50).alias("start"), F.lit(100).alias("end"))
    top = kmers.seeds(_counts(spark, d), 20)
    return kmers.occurrences(rows, top, masked).select("kmer", "seq_index", "pos", "is_rev", "rank")


@_query(
    _KM + """, g AS (SELECT kmer, CASE WHEN is_rev THEN lead(pos) OVER w - pos ELSE pos - lag(pos) OVER w END AS gap
    FROM km WINDOW w AS (PARTITION BY kmer, is_rev, seq_index ORDER BY pos))
    SELECT kmer, count(*) AS survivors FROM g WHERE gap IS NULL OR gap >= 500 GROUP BY kmer"""
)
def tandem_lag_filter(spark, d):
    return kmers.spaced_positions(_km(spark, d)).groupBy("kmer").agg(F.count(F.lit(1)).alias("survivors"))


_HITS = (
    f"WITH {A.SEQS}, {A.CONS}, {A.kmers_cte(K)}, {A.kmers_cte(K, 'cons', 'family_id', 'consensus', 'ck')}, "
    "c AS (SELECT seq_index AS family_id, kmer, min(pos) AS cons_pos, arg_min(is_rev, pos) AS cons_rev FROM ck GROUP BY 1, 2), "
    "h0 AS (SELECT family_id, k.seq_index, k.pos, cons_pos, CASE WHEN cons_rev = is_rev THEN 1 ELSE -1 END AS strand FROM c JOIN km k USING (kmer)), "
    "h AS (SELECT * FROM h0 QUALIFY row_number() OVER (PARTITION BY family_id ORDER BY cons_pos, seq_index, pos) <= 50000)"
)


def _hits(spark, d):
    sizes = kmers.count_kmers(A.sequences(spark, d), K, tandem=1).withColumnRenamed("freq", "n")
    return recruit.seed_hits(recruit.consensus_kmers(A.consensi(spark, d), K), _km(spark, d), sizes=sizes)


@_query(_HITS + " SELECT family_id, seq_index, pos, cons_pos, strand FROM h")
def seed_hit_join(spark, d):
    return _hits(spark, d)


@_query(
    _HITS + """, m AS (SELECT h.*, consensus_length, CASE WHEN pos - lag(pos) OVER w <= 1.5 * consensus_length THEN 0 ELSE 1 END AS new FROM h JOIN cons USING (family_id)
      WINDOW w AS (PARTITION BY family_id, h.seq_index, strand ORDER BY pos, cons_pos)),
    n AS (SELECT *, sum(new) OVER (PARTITION BY family_id, seq_index, strand ORDER BY pos, cons_pos ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM m),
    a AS (SELECT family_id, seq_index, strand, cluster, count(*) AS hits, min(struct_pack(o := abs(cons_pos - consensus_length // 2), p := pos, c := cons_pos)) AS s FROM n GROUP BY ALL)
    SELECT family_id, seq_index, strand, cluster, hits, s.p AS anchor_pos, s.c AS anchor_cons FROM a"""
)
def seed_cluster_anchor(spark, d):
    return recruit.cluster_hits(_hits(spark, d), A.consensi(spark, d))


@_query(
    f"""WITH {A.SEQS}, b AS (SELECT source, p, substr(seq, p + 1, 1) AS base, 1 + seq_index % 3 AS weight FROM seqs JOIN documents ON doc_id = seq_index, unnest(range(0, length(seq))) AS r(p)),
    v AS (SELECT source, p, base, sum(weight) AS w FROM b GROUP BY ALL), m AS (SELECT source, p, min(struct_pack(w := -w, b := base)) AS s FROM v GROUP BY ALL)
    SELECT source, string_agg(s.b, '' ORDER BY p) AS consensus FROM m GROUP BY source"""
)
def weighted_majority_consensus(spark, d):
    docs = A.table(spark, d, "documents").select("source", "doc_id", A.nucleotides().alias("seq"))
    bases = docs.select("source", (1 + F.col("doc_id") % 3).alias("weight"), F.posexplode(F.split("seq", "")).alias("p", "base")).where("base <> ''")
    return recruit.majority_consensus(bases, ["source"])


_JACCARD = f"""WITH {A.CONS}, g AS (SELECT DISTINCT family_id AS id, substr(consensus, i, 8) AS gram FROM cons, unnest(range(1, length(consensus) - 6)) AS r(i)),
    n AS (SELECT id, count(*) AS n FROM g GROUP BY id), s AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM g x JOIN g y USING (gram) WHERE x.id < y.id GROUP BY ALL),
    j AS (SELECT a, b, shared, shared / (na.n + nb.n - shared) AS jaccard FROM s JOIN n na ON na.id = a JOIN n nb ON nb.id = b)"""


def _profiles(spark, d):
    return A.consensi(spark, d).select(F.col("family_id").alias("id"), F.col("consensus").alias("seq"))


@_query(_JACCARD + " SELECT a, b, shared, round(jaccard, 6) AS jaccard FROM j WHERE jaccard >= 0.01")
def kmer_jaccard_pairs(spark, d):
    return merge.jaccard_pairs(_profiles(spark, d), least=0.01).withColumn("jaccard", F.round("jaccard", 6))


@_query(
    _JACCARD + """ SELECT a, b, x.consensus_length AS la, y.consensus_length AS lb FROM j JOIN cons x ON x.family_id = a JOIN cons y ON y.family_id = b
    WHERE least(x.consensus_length, y.consensus_length) >= 40 AND least(x.consensus_length, y.consensus_length) >= 0.7 * greatest(x.consensus_length, y.consensus_length)"""
)
def length_ratio_pairs(spark, d):
    pairs = merge.jaccard_pairs(_profiles(spark, d), least=0.0)
    lengths = _profiles(spark, d).select("id", F.length("seq").alias("length"))
    return merge.length_guard(pairs, lengths, shortest=40).select("a", "b", "la", "lb")


def _edges(spark, d):
    same = A.table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey", "l_linenumber")
    grouped = same.agg(F.min("l_orderkey").alias("a"), F.collect_set("l_orderkey").alias("l"))
    return grouped.select("a", F.explode("l").alias("b")).where("a <> b")


_EDGES = """WITH RECURSIVE e0 AS (SELECT min(l_orderkey) OVER (PARTITION BY l_partkey, l_suppkey, l_linenumber) AS a, l_orderkey AS b FROM lineitem),
    e AS (SELECT DISTINCT a, b FROM e0 WHERE a <> b UNION SELECT DISTINCT b, a FROM e0 WHERE a <> b),
    r AS (SELECT DISTINCT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other), cc AS (SELECT node, min(other) AS component FROM r GROUP BY node)"""


@_query(_EDGES + " SELECT node, component FROM cc")
def connected_components_query(spark, d):
    return connected_components(_edges(spark, d))


_QUERIES["connected_components"] = _QUERIES.pop("connected_components_query")
_SQL["connected_components"] = _SQL.pop("connected_components_query")


@_query(
    _EDGES + """, n AS (SELECT l_orderkey AS family_id, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT component, min(struct_pack(m := -coalesce(n, 0), id := node)).id AS representative, count(*) AS members FROM cc LEFT JOIN n ON family_id = node GROUP BY component"""
)
def component_representative(spark, d):
    n = A.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("family_id")).agg(F.count(F.lit(1)).alias("n"))
    return merge.representatives(connected_components(_edges(spark, d)), n)


_OTSU = """WITH v AS (SELECT user_id AS k, value AS v FROM events WHERE value IS NOT NULL), st AS (SELECT k, min(v) AS lo, max(v) AS hi, count(*) AS n FROM v GROUP BY k),
    hist AS (SELECT k, lo, hi, n, CASE WHEN hi > lo THEN least(99, floor((v - lo) / ((hi - lo) / 100))) ELSE 0 END::INT AS bin, count(*) AS c FROM v JOIN st USING (k) GROUP BY ALL),
    cum AS (SELECT *, (hi - lo) / 100 AS w, sum(c) OVER a AS n0, sum(c * (lo + (bin + 0.5) * ((hi - lo) / 100))) OVER a AS s0,
      sum(c * (lo + (bin + 0.5) * ((hi - lo) / 100))) OVER f AS s, sum(c * (lo + (bin + 0.5) * ((hi - lo) / 100)) * (lo + (bin + 0.5) * ((hi - lo) / 100))) OVER f AS q,
      max(c) OVER a AS mode_lo, max(c) OVER b AS mode_hi FROM hist
      WINDOW a AS (PARTITION BY k ORDER BY bin ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY k), b AS (PARTITION BY k ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    sc AS (SELECT *, CASE WHEN hi - lo >= 0.01 AND q / n - (s / n) * (s / n) >= 1e-10 AND n0 < n
      THEN round((n0 / n) * ((n - n0) / n) * (s0 / n0 - (s - s0) / (n - n0)) * (s0 / n0 - (s - s0) / (n - n0)) / (q / n - (s / n) * (s / n)), 9) ELSE 0 END AS b FROM cum),
    x AS (SELECT k, n, min(struct_pack(nb := -b, bin := bin, c := c, lo := lo, w := w, ml := mode_lo, mh := mode_hi)) AS x FROM sc GROUP BY k, n),
    o AS (SELECT k AS family_id, n, x.lo + (x.bin + 1) * x.w AS threshold, abs(x.nb) AS bimodality,
      NOT (-x.nb >= 0.20 AND -x.nb < 0.40 AND x.c >= floor(least(x.ml, coalesce(x.mh, 0)) / 2)) AS valley_pass FROM x)"""


def _user_values(spark, d):
    return A.table(spark, d, "events").select(F.col("user_id").alias("family_id"), F.col("value").alias("divergence"))


@_query(_OTSU + " SELECT family_id, n, round(threshold, 6) AS threshold, round(bimodality, 6) AS bimodality, valley_pass FROM o")
def otsu_threshold(spark, d):
    return split.otsu(_user_values(spark, d)).withColumns({c: F.round(c, 6) for c in ("threshold", "bimodality")})


@_query(
    _OTSU + """, sd AS (SELECT family_id, n, bimodality, valley_pass, sum((v <= threshold)::INT)::BIGINT AS n_lo, sum((v > threshold)::INT)::BIGINT AS n_hi,
      avg(v) FILTER (WHERE v <= threshold) AS mean_lo, avg(v) FILTER (WHERE v > threshold) AS mean_hi FROM v JOIN o ON family_id = k GROUP BY ALL)
    SELECT family_id, CASE WHEN n < 3 THEN 'skip_too_few_instances' WHEN bimodality < 0.20 THEN 'reject_bimodality' WHEN NOT valley_pass THEN 'reject_valley'
      WHEN n_lo < 3 OR n_hi < 3 THEN 'reject_cluster_size' WHEN mean_hi - mean_lo < 0.03 THEN 'reject_div_gap' ELSE 'candidate' END AS decision,
      n_lo, n_hi, round(mean_lo, 6) AS mean_lo, round(mean_hi, 6) AS mean_hi FROM sd"""
)
def split_decisions(spark, d):
    v = _user_values(spark, d)
    return split.split_decisions(v, split.otsu(v)).withColumns({c: F.round(c, 6) for c in ("mean_lo", "mean_hi")})


_NEAR = """near AS (SELECT a.family_id AS fa, b.family_id AS fb, a."start" AS sa, a."end" AS ea, b."start" AS sb, b."end" AS eb, a.strand = b.strand AS same
    FROM {t} a JOIN {t} b ON a.seq_index = b.seq_index AND a.family_id <> b.family_id AND b."start" - a."start" <= {d}
      AND (b."start" > a."start" OR (b."start" = a."start" AND b.instance_idx > a.instance_idx)))"""


@_query(
    f"WITH {A.BRANDS}, " + _NEAR.format(t="binst", d=30) + """, o AS (SELECT least(fa, fb) AS a, greatest(fa, fb) AS b, same,
      CASE WHEN fa > fb THEN sb ELSE sa END AS ls, CASE WHEN fa > fb THEN eb ELSE ea END AS le, CASE WHEN fa > fb THEN sa ELSE sb END AS hs, CASE WHEN fa > fb THEN ea ELSE eb END AS he FROM near)
    SELECT a, b, count(*) AS total, sum(same::INT)::BIGINT AS same_direction, sum((ls >= hs AND le <= he)::INT)::BIGINT AS a_in_b, sum((hs >= ls AND he <= le)::INT)::BIGINT AS b_in_a FROM o GROUP BY a, b"""
)
def cooccurrence_pairs(spark, d):
    return assemble.cooccurrences(A.brand_instances(spark, d), 30)


@_query(
    f"""WITH {A.INST}, p AS (SELECT a.seq_index, count(*) AS c FROM inst a JOIN inst b ON a.seq_index = b.seq_index AND b."start" - a."start" BETWEEN 0 AND 30
      AND (b."start" > a."start" OR b.instance_idx > a.instance_idx) GROUP BY 1)
    SELECT seq_index, count(*) AS instances, coalesce(any_value(c), 0) AS comparisons FROM inst LEFT JOIN p USING (seq_index) GROUP BY 1"""
)
def assembly_work(spark, d):
    return assemble.comparisons(A.instances(spark, d), 30)


@_query(
    f"WITH {A.BRANDS}, " + _NEAR.format(t="binst", d=30) + """, g AS (SELECT least(fa, fb) AS a, greatest(fa, fb) AS b, sb - ea AS gap FROM near WHERE same AND sb - ea BETWEEN -500 AND 30),
    m AS (SELECT a, b, list_sort(list(gap)) AS l FROM g GROUP BY a, b HAVING count(*) >= 3), n AS (SELECT a, b, l, l[len(l) // 2 + 1] AS med FROM m),
    x AS (SELECT a, b, len(l) AS gaps, med AS median_gap, list_sort([abs(v - med) FOR v IN l])[len(l) // 2 + 1] AS mad FROM n)
    SELECT a, b, gaps, median_gap, mad, mad <= 100 AND median_gap >= -20 AND median_gap <= least(median_gap + 2 * mad, 500) AS steady FROM x"""
)
def gap_median_mad(spark, d):
    return assemble.gap_statistics(A.brand_instances(spark, d), 30)


_UNION = """{n}0 AS (SELECT seq_index, "start", "end", max("end") OVER (PARTITION BY seq_index ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM {t} WHERE {w}),
    {n}1 AS (SELECT *, sum(CASE WHEN seen IS NULL OR "start" > seen THEN 1 ELSE 0 END) OVER (PARTITION BY seq_index ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS i FROM {n}0),
    {n} AS (SELECT seq_index, min("start") AS "start", max("end") AS "end" FROM {n}1 GROUP BY seq_index, i)"""


@_query(f"WITH {A.INST}, " + _UNION.format(n="u", t="inst", w="true") + ' SELECT seq_index, "start", "end" FROM u')
def interval_union(spark, d):
    return intervals.interval_union(A.instances(spark, d), ["seq_index"])


@_query(
    f"""WITH {A.INST} SELECT a.seq_index, count(*) AS pairs, sum(least(a."end", b."end") - greatest(a."start", b."start"))::BIGINT AS bases
    FROM inst a JOIN inst b ON a.seq_index = b.seq_index AND a."start" < b."end" AND b."start" < a."end" AND a.instance_idx < b.instance_idx GROUP BY 1"""
)
def interval_overlap_join(spark, d):
    own = A.instances(spark, d).select("instance_idx", "seq_index", "start", "end")
    pairs = intervals.overlap_join(own, own, ["seq_index"], 50).where("a_instance_idx < b_instance_idx")
    return pairs.groupBy(F.col("a_seq_index").alias("seq_index")).agg(F.count(F.lit(1)).alias("pairs"), F.sum(intervals.overlap_length()).alias("bases"))


_LENGTHS = 'len AS (SELECT seq_index, max("end") + 500 AS length FROM inst GROUP BY 1)'


@_query(
    f"WITH {A.INST}, {_LENGTHS}, " + _UNION.format(n="u", t="inst", w="true") + """,
    g AS (SELECT seq_index, coalesce(lag("end") OVER (PARTITION BY seq_index ORDER BY "start"), 0) AS gs, "start" AS ge FROM u
      UNION ALL SELECT seq_index, max("end"), any_value(length) FROM u JOIN len USING (seq_index) GROUP BY 1),
    w AS (SELECT seq_index, greatest(0, gs - 5) AS "start", least(length, ge + 5) AS "end" FROM g JOIN len USING (seq_index) WHERE ge - gs >= 20), """
    + _UNION.format(n="z", t="w", w="true") + ' SELECT seq_index, "start", "end" FROM z'
)
def interval_gaps(spark, d):
    inst = A.instances(spark, d)
    lengths = inst.groupBy("seq_index").agg((F.max("end") + 500).alias("length"))
    return intervals.interval_gaps(inst, lengths, ["seq_index"], least=20, flank=5)


@_query(
    f"WITH {A.INST}, " + _UNION.format(n="u", t="inst", w="strand = 1") + ", " + _UNION.format(n="v", t="inst", w="strand = -1") + """
    SELECT u.seq_index, sum(least(u."end", v."end") - greatest(u."start", v."start"))::BIGINT AS bases FROM u JOIN v ON u.seq_index = v.seq_index AND u."start" < v."end" AND v."start" < u."end" GROUP BY 1"""
)
def interval_intersection_len(spark, d):
    inst = A.instances(spark, d)
    sides = [intervals.interval_union(inst.where(F.col("strand") == s), ["seq_index"]) for s in (1, -1)]
    return intervals.intersection_length(*sides, ["seq_index"], 200)


_RECORDS = "rec AS (SELECT s_suppkey AS seq_index, 2000 + s_suppkey * 3 AS length, sum(2000 + s_suppkey * 3) OVER (ORDER BY s_suppkey) - (2000 + s_suppkey * 3) AS raw_start FROM supplier)"


def _records(spark, d):
    n = 2000 + F.col("s_suppkey") * 3
    # every earlier supplier adds its length: a closed form, so no global running sum
    s = F.col("s_suppkey")
    return A.table(spark, d, "supplier").select(s.alias("seq_index"), n.alias("length"), (2000 * s + 3 * s * (s - 1) / 2).cast("long").alias("raw_start"))


@_query(
    f"""WITH {_RECORDS}, p AS (SELECT o_orderkey AS id, o_orderkey * 7919 % (SELECT max(raw_start + length) FROM rec) AS position FROM orders)
    SELECT id, position::BIGINT AS position, seq_index, (position - raw_start)::BIGINT AS "local" FROM p ASOF JOIN rec ON position >= raw_start"""
)
def coordinate_remap(spark, d):
    records = _records(spark, d)
    total = records.agg(F.max(F.col("raw_start") + F.col("length"))).first()[0]
    p = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 7919 % total).alias("position"))
    return intervals.to_records(p, records).select("id", "position", "seq_index", "local")


@_query(
    f"""WITH {_RECORDS} SELECT seq_index, tile, tile * 100 AS "start", tile * 100 + 100 AS "end" FROM rec, unnest(range(0, length // 100)) AS r(tile)
    WHERE length >= 100 ORDER BY md5(concat_ws(':', '42', seq_index, tile)), seq_index, tile LIMIT 64"""
)
def tile_sample(spark, d):
    return scale.sample_tiles(_records(spark, d).select("seq_index", "length"), 100, 64)


@_query(
    f"""WITH {_RECORDS}, n AS (SELECT seq_index, length, CASE WHEN length > 1800 THEN pow(2, ceil(log2(length / 1800.0)))::BIGINT ELSE 1 END AS n FROM rec)
    SELECT seq_index, part, greatest(0, part * ceil(length / n)::BIGINT - 100)::BIGINT AS "start", least(length, (part + 1) * ceil(length / n)::BIGINT + 100)::BIGINT AS "end"
    FROM n, unnest(range(0, n)) AS r(part)"""
)
def segment_split(spark, d):
    return scale.split_records(_records(spark, d).select("seq_index", "length"), 1000, 100)


@_query(
    f"""WITH RECURSIVE {_RECORDS}, s AS (SELECT seq_index, length, row_number() OVER (ORDER BY length DESC, seq_index) AS i FROM rec),
    n AS (SELECT least(count(*), greatest(2, ceil(sum(length) / 20000.0)))::BIGINT AS n FROM rec),
    r(i, loads, segment, bin) AS (SELECT 0::BIGINT, [0::BIGINT FOR x IN range(n)], NULL::BIGINT, NULL::INT FROM n UNION ALL
      SELECT s.i, [CASE WHEN j = p THEN loads[j] + s.length ELSE loads[j] END FOR j IN range(1, len(loads) + 1)]::BIGINT[], s.seq_index::BIGINT, (p - 1)::INT
      FROM (SELECT *, list_position(loads, list_min(loads)) AS p FROM r) q JOIN s ON s.i = q.i + 1)
    SELECT segment, bin FROM r WHERE i > 0"""
)
def lpt_bins(spark, d):
    rows = [(r["s"], r["n"]) for r in _records(spark, d).select(F.col("seq_index").alias("s"), F.col("length").alias("n")).collect()]
    bins = scale.pack_segments(rows, 20_000)
    return spark.createDataFrame(sorted(bins.items()), "segment long, bin int")


def _bits(n: str) -> str:
    """A list fold: the sum of positive iterated logarithms."""
    one = f"log2(({n})::DOUBLE)"
    return (
        f"({mdl.UNIVERSAL} + list_reduce([struct_pack(x := {one}, t := greatest({one}, 0.0)), struct_pack(x := 0.0, t := 0.0), struct_pack(x := 0.0, t := 0.0), struct_pack(x := 0.0, t := 0.0), "
        "struct_pack(x := 0.0, t := 0.0), struct_pack(x := 0.0, t := 0.0)], lambda p, q: struct_pack(x := CASE WHEN p.x > 0 THEN log2(p.x) ELSE 0.0 END, "
        "t := p.t + greatest(CASE WHEN p.x > 0 THEN log2(p.x) ELSE 0.0 END, 0.0))).t)"
    )


@_query(f"WITH n AS (SELECT DISTINCT o_orderkey + 1 AS n FROM orders) SELECT n, round({_bits('n')}, 6) AS bits FROM n")
def l_int(spark, d):
    n = A.table(spark, d, "orders").select((F.col("o_orderkey") + 1).alias("n")).distinct()
    return n.select("n", F.round(mdl.universal_int("n"), 6).alias("bits"))


_PLACE = {
    "none": "0",
    "upper": "m * log2(a::DOUBLE)",
    "exact": "CASE WHEN m > 0 AND m < a THEN (lgamma(a + 1) - lgamma(m + 1) - lgamma(a - m + 1)) / ln(2) ELSE 0 END",
}


def _cost_sql(mode: str) -> str:
    return f"{_bits('a')} + {_bits('m + 1')} + m * {mdl.BITS_PER_SUBSTITUTION} + {_PLACE[mode]}"


def _cost_query(mode: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        pairs = A.instances(spark, d).select(F.col("aligned_length").alias("a"), F.col("num_edits").alias("m")).distinct()
        return pairs.select("a", "m", F.round(mdl.instance_cost("a", "m", mode), 6).alias("bits"))

    return run


for _mode in ("none", "exact", "upper"):
    _QUERIES[f"instance_cost_{_mode}"] = _cost_query(_mode)
    _SQL[f"instance_cost_{_mode}"] = (
        f"WITH {A.INST}, p AS (SELECT DISTINCT aligned_length AS a, num_edits AS m FROM inst) SELECT a, m, round({_cost_sql(_mode)}, 6) AS bits FROM p"
    )


@_query(f"WITH {A.FAMS} SELECT family_id, round({_bits('consensus_length')} + 2 * consensus_length, 6) AS bits FROM fams")
def model_cost(spark, d):
    return A.families(spark, d).select("family_id", F.round(mdl.model_cost("consensus_length"), 6).alias("bits"))


_SCORES = f"""WITH {A.INST}, {A.FAMS}, p AS (SELECT *, aligned_length AS a, num_edits AS m FROM inst),
    s AS (SELECT family_id, count(*) AS n, avg(divergence) AS div, sum(2 * a - ({_cost_sql('exact')})) AS savings FROM p GROUP BY 1),
    sc AS (SELECT family_id, consensus_length, coalesce(n, 0) AS n, coalesce(div, 0) AS div, {_bits('consensus_length')} + 2 * consensus_length AS cost, coalesce(savings, 0) AS savings FROM fams LEFT JOIN s USING (family_id))"""


@_query(
    _SCORES + " SELECT family_id, consensus_length, n, round(div, 6) AS mean_divergence, round(cost, 4) AS model_cost, round(savings, 4) AS savings, round(savings - cost, 4) AS score FROM sc"
)
def family_mdl_score(spark, d):
    s = select.family_scores(A.instances(spark, d), A.families(spark, d))
    return s.withColumns({c: F.round(c, 4) for c in ("model_cost", "savings", "score")} | {"mean_divergence": F.round("mean_divergence", 6)})


_FLAGS_SQL = "(CASE WHEN consensus_length < 80 THEN 1 ELSE 0 END + CASE WHEN n < 3 THEN 2 ELSE 0 END + CASE WHEN round(div, 9) >= 0.25 THEN 4 ELSE 0 END)"


@_query(
    _SCORES + f"""SELECT family_id, {_FLAGS_SQL} AS flags, coalesce(nullif(concat_ws('|', CASE WHEN consensus_length < 80 THEN 'short_consensus' END, CASE WHEN n < 3 THEN 'low_copy' END,
    CASE WHEN round(div, 9) >= 0.25 THEN 'high_divergence' END), ''), 'none') AS names, CASE WHEN {_FLAGS_SQL} > 0 THEN 'warn' ELSE 'core' END AS tier FROM sc"""
)
def quality_flags(spark, d):
    s = select.family_scores(A.instances(spark, d), A.families(spark, d))
    flagged = s.select("family_id", mdl.base_flags("consensus_length", "n", F.round("mean_divergence", 9)).alias("flags"))
    return flagged.select("family_id", "flags", mdl.flag_names("flags").alias("names"), mdl.quality_tier(F.lit("exclusive"), "flags").alias("tier"))


def _selected(spark, d):
    return select.select_library(A.instances(spark, d), A.families(spark, d))


def _rounds(rounds: int, name: str, first: str, one: Callable[[int], str]) -> str:
    """Common table expressions <name>0 (a guess of who is in) to <name><rounds>: DuckDB decides families as the rounds do, over single
    bases. On these tables nothing changes after the first few."""
    return ", ".join([f"{name}0 AS ({first})", *(one(i) for i in range(1, rounds + 1))])


_BASES = """unnest(range(greatest(0, "start"), greatest(0, "start", "end"))) AS x"""
_GREEDY = _SCORES + f""", el AS (SELECT *, savings - cost AS score, row_number() OVER (ORDER BY round(savings - cost, 6) DESC, family_id) AS rk FROM sc WHERE savings > cost AND n >= 2),
    px AS MATERIALIZED (SELECT rk, rn, seq_index, i.divergence AS dv, {_BASES} FROM (SELECT *, row_number() OVER () AS rn FROM inst) i JOIN el USING (family_id)), """ + _rounds(
    6, "d", "SELECT rk, true AS is_in FROM el", lambda i: f"""
    m{i} AS (SELECT seq_index, x, min(rk) AS m FROM px JOIN d{i - 1} USING (rk) WHERE is_in GROUP BY 1, 2),
    f{i} AS (SELECT rk, rn, any_value(dv) AS dv, count(*) FILTER (m IS NULL OR m >= rk) AS a, count(*) AS size FROM px LEFT JOIN m{i} USING (seq_index, x) GROUP BY 1, 2),
    g{i} AS (SELECT rk, a, size, greatest(0, least(floor(dv * a + 0.5)::INT, a)) AS m FROM f{i}),
    s{i} AS (SELECT rk, coalesce(sum(2 * a - ({_cost_sql('exact')})) FILTER (a > 0), 0) AS saved, sum(a)::BIGINT AS bases, count(*) FILTER (a > 0) AS used, sum(size)::BIGINT AS total FROM g{i} GROUP BY 1),
    d{i} AS MATERIALIZED (SELECT s.*, CASE WHEN saved - cost > 1e-9 THEN 'exclusive' WHEN consensus_length >= 50 AND n >= 3 THEN 'standalone' ELSE 'rejected' END AS state,
      saved - cost > 1e-9 OR (consensus_length >= 50 AND n >= 3) AS is_in FROM s{i} s JOIN el USING (rk))""",
) + f""", j AS (SELECT sc.*, el.rk, d.saved, d.saved - sc.cost AS own, d.bases, d.used, d.total, coalesce(d.state, 'rejected') AS state, {_FLAGS_SQL.replace('consensus_length', 'sc.consensus_length').replace('n < 3', 'sc.n < 3').replace('round(div', 'round(sc.div')} AS base
      FROM sc LEFT JOIN el USING (family_id) LEFT JOIN d6 d ON d.rk = el.rk),
    sel AS (SELECT family_id, consensus_length, n, round(div, 6) AS mean_divergence, round(cost, 4) AS model_cost, round(savings, 4) AS savings, round(savings - cost, 4) AS score, state,
      round(coalesce(saved, 0), 4) AS exclusive_savings, round(coalesce(own, 0), 4) AS exclusive_score, coalesce(bases, 0) AS exclusive_bases, coalesce(used, 0)::INT AS exclusive_instances,
      (base + CASE WHEN rk IS NULL THEN 0 ELSE (CASE WHEN bases = 0 THEN 16 ELSE 0 END + CASE WHEN state <> 'exclusive' THEN 64 ELSE 0 END
        + CASE WHEN bases > 0 AND bases * 4 < total THEN 32 ELSE 0 END + CASE WHEN state = 'standalone' THEN 8 ELSE 0 END) END)::INT AS quality_flags,
      CASE WHEN state = 'rejected' THEN 'reject' WHEN state = 'standalone' OR base > 0 THEN 'warn' ELSE 'core' END AS tier FROM j)"""

def _tidy(selected):
    return selected.withColumns({c: F.round(c, 4) for c in ("model_cost", "savings", "score", "exclusive_savings", "exclusive_score")} | {"mean_divergence": F.round("mean_divergence", 6)})


@_query(_GREEDY + " SELECT * FROM sel")
def greedy_select(spark, d):
    return _tidy(_selected(spark, d))


@_query(
    _GREEDY.replace("sel AS (SELECT family_id,", "sel AS (SELECT family_id, savings - cost AS raw,") + f""",
    ok AS (SELECT family_id, row_number() OVER (ORDER BY round(raw, 6), family_id) AS pr FROM sel WHERE state <> 'rejected'),
    qx AS MATERIALIZED (SELECT pr, rn, seq_index, {_BASES} FROM (SELECT *, row_number() OVER () AS rn FROM inst) JOIN ok USING (family_id)), """ + _rounds(
        6, "p", "SELECT pr, true AS is_in FROM ok", lambda i: f"e{i} AS (SELECT seq_index, x, max(pr) AS last, max(pr) FILTER (is_in) AS kept, count(DISTINCT pr) FILTER (is_in) AS many FROM qx JOIN p{i - 1} USING (pr) GROUP BY 1, 2), "
        f"h{i} AS (SELECT pr, rn, count(*) FILTER (pr = last AND (kept IS NULL OR (kept = pr AND many = 1))) AS free, count(*) AS size FROM qx JOIN e{i} USING (seq_index, x) GROUP BY 1, 2), "
        f"p{i} AS MATERIALIZED (SELECT pr, bool_or(free >= size // 4) AS is_in FROM h{i} GROUP BY 1)",
    )
    + """ SELECT family_id, CASE WHEN is_in = false THEN 'pruned' ELSE state END AS state, quality_flags + CASE WHEN is_in = false THEN 128 ELSE 0 END AS quality_flags
      FROM sel LEFT JOIN ok USING (family_id) LEFT JOIN p6 USING (pr)"""
)
def prune_redundant(spark, d):
    return select.prune_redundant(cut(_selected(spark, d), "selected"), A.instances(spark, d)).select("family_id", "state", "quality_flags")


@_query(
    _GREEDY + f""", o AS (SELECT count(*) AS accepted, coalesce(sum(j.cost), 0) AS models, coalesce(sum(saved) FILTER (state = 'exclusive'), 0) AS saved FROM j WHERE state <> 'rejected'),
    cov AS (SELECT count(DISTINCT (seq_index, x)) AS bases_covered FROM (SELECT seq_index, {_BASES} FROM inst JOIN j USING (family_id) WHERE state <> 'rejected')),
    l AS (SELECT accepted, saved, {_bits('greatest(accepted, 1)')} + models AS lib FROM o)
    SELECT accepted, round(lib, 3) AS dl_library, round(greatest(0, 2000000 - saved + lib), 3) AS dl_total, round(greatest(0, 2000000 - saved + lib) / 2000000, 6) AS ratio, bases_covered FROM l, cov"""
)
def library_summary(spark, d):
    s = select.library_summary(cut(_selected(spark, d), "selected"), A.instances(spark, d), 1_000_000)
    return s.withColumns({"dl_library": F.round("dl_library", 3), "dl_total": F.round("dl_total", 3), "ratio": F.round("ratio", 6)})


@_query(
    f"""WITH RECURSIVE {A.BRANDS}, lim AS (SELECT regexp_extract(p_brand, '(\\d+)', 1)::BIGINT AS family_id, greatest(50, floor(0.1 * max(p_size)))::BIGINT AS lim FROM part GROUP BY 1),
    r AS (SELECT family_id, seq_index, "start" AS s, "end" AS e, strand, num_edits AS m, lim, row_number() OVER (PARTITION BY family_id, seq_index ORDER BY "start", "end", strand, instance_idx, num_edits) AS rn FROM binst JOIN lim USING (family_id)),
    f AS (SELECT family_id, seq_index, rn, s, e, strand, m::BIGINT AS m, 1::BIGINT AS merged, 1 AS seg FROM r WHERE rn = 1 UNION ALL
      SELECT r.family_id, r.seq_index, r.rn, CASE WHEN j THEN f.s ELSE r.s END, CASE WHEN j THEN greatest(f.e, r.e) ELSE r.e END, r.strand,
        CASE WHEN j THEN f.m + CASE WHEN r.e > f.e THEN r.m + greatest(r.s - f.e, 0) ELSE 0 END ELSE r.m END, CASE WHEN j THEN f.merged + 1 ELSE 1 END, CASE WHEN j THEN f.seg ELSE f.seg + 1 END
      FROM (SELECT f.*, r.s AS rs, r.strand = f.strand AND r.s - f.e BETWEEN -10 AND r.lim AS j FROM f JOIN r ON r.family_id = f.family_id AND r.seq_index = f.seq_index AND r.rn = f.rn + 1) f
      JOIN r ON r.family_id = f.family_id AND r.seq_index = f.seq_index AND r.rn = f.rn + 1),
    l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY family_id, seq_index, seg ORDER BY rn DESC) = 1)
    SELECT family_id, seq_index, s AS "start", e AS "end", strand, m AS num_edits, merged FROM l"""
)
def coalesce_tandem(spark, d):
    size = A.table(spark, d, "part").groupBy(F.regexp_extract("p_brand", r"(\d+)", 1).cast("long").alias("family_id")).agg(F.max("p_size").alias("consensus_length"))
    return select.coalesce_tandem(A.brand_instances(spark, d), size, factor=0.1)


@_query(
    _SCORES + """ SELECT family_id, CASE WHEN savings > cost AND NOT (consensus_length >= 100 AND round(div, 9) > 0.2) THEN 'exclusive' ELSE 'rejected' END AS state FROM sc"""
)
def chimera_filter(spark, d):
    s = select.family_scores(A.instances(spark, d), A.families(spark, d)).withColumn("mean_divergence", F.round("mean_divergence", 9))
    states = s.withColumn("state", F.when(F.col("score") > 0, "exclusive").otherwise("rejected"))
    return select.drop_chimeras(states, least=100, divergence=0.2).select("family_id", "state")


@_query(
    f"""WITH {A.INST}, {A.FAMS}, n AS (SELECT family_id, count(*) AS n FROM inst GROUP BY 1)
    SELECT family_id, row_number() OVER (ORDER BY family_id) - 1 AS new_id FROM fams JOIN n USING (family_id) WHERE n >= 2 AND consensus_length >= 60"""
)
def compact_renumber(spark, d):
    n = A.instances(spark, d).groupBy("family_id").agg(F.count(F.lit(1)).alias("n"))
    return select.compact(A.families(spark, d), n, k=30).select("family_id", "new_id")


_SIDES = "q AS (SELECT * FROM inst WHERE strand = 1), t AS (SELECT * FROM inst WHERE strand = -1)"
_CONTAIN = f"""WITH {A.INST}, {_SIDES}, c AS (SELECT q.family_id AS query_id, t.family_id AS target_id, count(DISTINCT q.instance_idx) AS contained FROM q JOIN t ON q.seq_index = t.seq_index
    AND q."start" < t."end" AND t."start" < q."end" AND least(q."end", t."end") - greatest(q."start", t."start") >= 0.8 * (q."end" - q."start") GROUP BY ALL),
    n AS (SELECT family_id AS query_id, count(DISTINCT instance_idx) AS n FROM q GROUP BY 1)"""


def _sides(spark, d):
    inst = A.instances(spark, d)
    return inst.where("strand = 1"), inst.where("strand = -1")


@_query(_CONTAIN + " SELECT query_id, target_id, contained, round(contained / n, 6) AS fraction FROM c JOIN n USING (query_id) WHERE contained >= 2")
def rescue_containment(spark, d):
    return rescue.containment(*_sides(spark, d), 50).where("contained >= 2").withColumn("fraction", F.round("fraction", 6))


@_query(
    _CONTAIN + """ SELECT DISTINCT family_id FROM q WHERE family_id NOT IN (SELECT query_id FROM c JOIN n USING (query_id)
    JOIN part x ON x.p_partkey = query_id JOIN part y ON y.p_partkey = target_id WHERE contained / n >= 0.1 AND least(x.p_size, y.p_size) >= 0.1 * greatest(x.p_size, y.p_size))"""
)
def rescue_antijoin(spark, d):
    q, t = _sides(spark, d)
    size = A.table(spark, d, "part").select("p_partkey", "p_size")
    x, y = (size.select(F.col("p_partkey").alias(k), F.col("p_size").alias(n)) for k, n in (("query_id", "sx"), ("target_id", "sy")))
    e = rescue.containment(q, t, 50).join(x, "query_id").join(y, "target_id")
    e = e.withColumn("ratio", F.least("sx", "sy") / F.greatest("sx", "sy")).withColumn("identity", F.lit(1.0))
    return rescue.without_duplicates(q.select("family_id").distinct(), e, least=0.1)


@_query(
    _CONTAIN.replace("WITH ", "WITH RECURSIVE ", 1) + """, e0 AS (SELECT query_id, target_id, contained / n AS fraction, least(x.p_size, y.p_size) / greatest(x.p_size, y.p_size) AS ratio
      FROM c JOIN n USING (query_id) JOIN part x ON x.p_partkey = query_id JOIN part y ON y.p_partkey = target_id),
    s AS (SELECT query_id, target_id, count(DISTINCT a.instance_idx) AS contained FROM (SELECT family_id AS query_id, * FROM q) a JOIN (SELECT family_id AS target_id, * FROM q) b ON a.seq_index = b.seq_index
      AND target_id < query_id AND a."start" < b."end" AND b."start" < a."end" AND least(a."end", b."end") - greatest(a."start", b."start") >= 0.8 * (a."end" - a."start") GROUP BY ALL),
    e1 AS (SELECT query_id, target_id, contained / n AS fraction, least(x.p_size, y.p_size) / greatest(x.p_size, y.p_size) AS ratio
      FROM s JOIN n USING (query_id) JOIN part x ON x.p_partkey = query_id JOIN part y ON y.p_partkey = target_id),
    bar AS (SELECT DISTINCT query_id FROM e0 WHERE least(fraction, ratio) >= 0.1),
    dup AS (SELECT query_id, list(target_id) AS earlier FROM e1 WHERE least(fraction, ratio) >= 0.1 GROUP BY 1),
    cand AS (SELECT query_id, row_number() OVER (ORDER BY query_id) AS i, bar.query_id IS NOT NULL AS barred, coalesce(earlier, []) AS earlier
      FROM n LEFT JOIN bar USING (query_id) LEFT JOIN dup USING (query_id)),
    walk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS k UNION ALL SELECT cand.i, CASE WHEN barred OR list_has_any(k, earlier) THEN k ELSE list_append(k, query_id) END
      FROM walk JOIN cand ON cand.i = walk.i + 1),
    kept AS (SELECT unnest(k) AS family_id FROM (SELECT k FROM walk ORDER BY i DESC LIMIT 1)),
    h AS (SELECT 0 AS later, * FROM e0 UNION ALL SELECT 1, * FROM e1 WHERE target_id IN (SELECT family_id FROM kept)),
    m AS (SELECT DISTINCT ON (query_id) * FROM h ORDER BY query_id, least(fraction, ratio) >= 0.1 DESC,
      CASE WHEN least(fraction, ratio) >= 0.1 THEN 0 ELSE -fraction * ratio END, later, target_id)
    SELECT n.query_id AS family_id, n.query_id IN (SELECT family_id FROM kept) AS kept, target_id AS matched_id, later = 0 AS matched_known, round(coalesce(fraction, 0), 6) AS fraction FROM n LEFT JOIN m USING (query_id)"""
)
def rescue_in_order(spark, d):
    q, t = _sides(spark, d)
    size = A.table(spark, d, "part").select("p_partkey", "p_size")
    x, y = (size.select(F.col("p_partkey").alias(k), F.col("p_size").alias(n)) for k, n in (("query_id", "sx"), ("target_id", "sy")))
    old, own = rescue.containment(q, t, 50), rescue.containment(q, q, 50).where("target_id < query_id")
    e = old.withColumn("known", F.lit(True)).unionByName(own.withColumn("known", F.lit(False))).join(x, "query_id").join(y, "target_id")
    e = e.withColumn("ratio", F.least("sx", "sy") / F.greatest("sx", "sy")).withColumn("identity", F.lit(1.0))
    judged = rescue.judge_in_order(q.select("family_id").distinct(), e, least=0.1)
    return judged.select("family_id", "kept", "matched_id", "matched_known", F.round("fraction", 6).alias("fraction"))


_BEDS = f"""WITH {A.INST}, b AS (SELECT instance_idx AS id, seq_index AS chrom, "start", "end", family_id % 5 AS name, CASE WHEN num_edits = 0 THEN '.' WHEN strand = 1 THEN '+' ELSE '-' END AS strand, divergence FROM inst),
    p AS (SELECT * FROM b WHERE divergence < 0.2), t AS (SELECT * FROM b WHERE divergence >= 0.3),
    m AS (SELECT p.id AS pid, t.id AS tid, t.name, least(p."end", t."end") - greatest(p."start", t."start") AS o FROM p JOIN t ON p.chrom = t.chrom AND p."start" < t."end" AND t."start" < p."end"
      AND (p.strand = t.strand OR p.strand = '.' OR t.strand = '.') AND (least(p."end", t."end") - greatest(p."start", t."start")) / least(p."end" - p."start", t."end" - t."start") >= 0.5)"""
_RATIOS = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS "precision", round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
    round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1"""


def _beds(spark, d):
    strand = F.when(F.col("num_edits") == 0, ".").when(F.col("strand") == 1, "+").otherwise("-")
    b = A.instances(spark, d).select(
        F.col("instance_idx").alias("id"), F.col("seq_index").alias("chrom"), "start", "end", (F.col("family_id") % 5).alias("name"), strand.alias("strand"), "divergence"
    )
    return b.where("divergence < 0.2").drop("divergence"), b.where("divergence >= 0.3").drop("divergence")


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@_query(
    _BEDS + f""", x AS (SELECT (SELECT count(*) FROM p WHERE id IN (SELECT pid FROM m)) AS tp, (SELECT count(*) FROM p WHERE id NOT IN (SELECT pid FROM m)) AS fp,
    (SELECT count(*) FROM t WHERE id NOT IN (SELECT tid FROM m)) AS fn) SELECT tp, fp, fn, {_RATIOS} FROM x"""
)
def bed_pr_overall(spark, d):
    return _rounded(evaluate.interval_metrics(*_beds(spark, d), width=50))


@_query(
    _BEDS + f""", best AS (SELECT pid, min(struct_pack(o := -o, n := name)).n AS name FROM m GROUP BY pid), x0 AS (
      SELECT name::VARCHAR AS name, count(*) AS tp, 0 AS fp, 0 AS fn FROM best GROUP BY 1 UNION ALL SELECT name::VARCHAR, 0, 0, count(*) FROM t WHERE id NOT IN (SELECT tid FROM m) GROUP BY 1
      UNION ALL SELECT '__unmatched_pred__', 0, count(*), 0 FROM p WHERE id NOT IN (SELECT pid FROM m) HAVING count(*) > 0),
    x AS (SELECT name, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM x0 GROUP BY 1) SELECT name, tp, fp, fn, {_RATIOS} FROM x"""
)
def bed_pr_by_class(spark, d):
    p, t = _beds(spark, d)
    named = t.withColumn("name", F.col("name").cast("string"))
    return _rounded(evaluate.class_metrics(p, named, width=50))


@_query(
    f"WITH {A.INST}, " + _UNION.format(n="u", t="inst", w="divergence < 0.05") + ", " + _UNION.format(n="v", t="inst", w="divergence >= 0.35") + f""",
    y AS (SELECT (SELECT sum("end" - "start") FROM u)::BIGINT AS pb, (SELECT sum("end" - "start") FROM v)::BIGINT AS tb,
      (SELECT sum(least(u."end", v."end") - greatest(u."start", v."start")) FROM u JOIN v ON u.seq_index = v.seq_index AND u."start" < v."end" AND v."start" < u."end")::BIGINT AS tp),
    x AS (SELECT pb, tb, tp, pb - tp AS fp, tb - tp AS fn FROM y) SELECT pb AS pred_bases, tb AS truth_bases, tp AS shared_bases, {_RATIOS} FROM x"""
)
def bp_metrics(spark, d):
    inst = A.instances(spark, d)
    return _rounded(evaluate.base_metrics(inst.where("divergence < 0.05"), inst.where("divergence >= 0.35"), ["seq_index"], 100))


@_query(
    f"""WITH {A.INST} SELECT s_name AS chrom, "start", "end", 'R=' || family_id AS name, greatest(0, least(1000, trunc(1000 * (1 - divergence))::INT)) AS score,
    CASE WHEN strand > 0 THEN '+' ELSE '-' END AS strand FROM inst JOIN supplier ON s_suppkey = seq_index"""
)
def bed_score_projection(spark, d):
    ids = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("seq_index"), F.col("s_name").alias("seq_id"))
    every = A.instances(spark, d).select("family_id").distinct().withColumn("state", F.lit("exclusive"))
    return tables.instances_bed(A.instances(spark, d), ids, every)


@_query(
    _SCORES + f"""SELECT family_id, consensus_length, n AS num_instances, round(div, 6) AS divergence_mean, round(savings - cost, 4) AS mdl_score, {_FLAGS_SQL} AS quality_flags FROM sc"""
)
def family_stats(spark, d):
    s = select.family_scores(A.instances(spark, d), A.families(spark, d))
    return s.select(
        "family_id", "consensus_length", F.col("n").alias("num_instances"), F.round("mean_divergence", 6).alias("divergence_mean"), F.round("score", 4).alias("mdl_score"),
        mdl.base_flags("consensus_length", "n", F.round("mean_divergence", 9)).alias("quality_flags"),
    )


_NESTED = (
    f"""WITH {A.BRANDS}, c AS (SELECT a.family_id AS i, b.family_id AS o, count(DISTINCT a.instance_idx) AS contained FROM binst a JOIN binst b ON a.seq_index = b.seq_index
    AND a.family_id <> b.family_id AND a."start" >= b."start" AND a."end" <= b."end" AND a."start" < b."end" AND b."start" < a."end" GROUP BY ALL),
    n AS (SELECT family_id AS i, count(DISTINCT instance_idx) AS n FROM binst GROUP BY 1)"""
    + ' SELECT i AS "inner", o AS "outer", contained, round(contained / n, 6) AS fraction FROM c JOIN n USING (i)'
)


@_query(_NESTED)
def nested_containment(spark, d):
    return merge.nested_fraction(A.brand_instances(spark, d), 50).withColumn("fraction", F.round("fraction", 6))


@_query(
    f"""WITH {A.BRANDS}, n AS (SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY seq_index, "start", instance_idx) - 1 AS i, greatest(1, count(*) OVER (PARTITION BY family_id) // 500) AS step FROM binst)
    SELECT family_id, count(*) AS kept, min(seq_index) AS first_record, sum("start")::BIGINT AS starts FROM n WHERE i % step = 0 AND i / step < 500 GROUP BY 1"""
)
def instance_thinning(spark, d):
    thin = assemble.thinned(A.brand_instances(spark, d), 500)
    return thin.groupBy("family_id").agg(F.count(F.lit(1)).alias("kept"), F.min("seq_index").alias("first_record"), F.sum("start").alias("starts"))


@_query(f"WITH {A.FAMS} SELECT greatest(500, least(30000, 4 * floor(avg(consensus_length))))::INT AS reach FROM fams")
def assembly_reach(spark, d):
    return assemble.reach(A.families(spark, d))


@_query()
def semiglobal_identity(spark, d):
    c = A.consensi(spark, d)
    a, b = (c.select(F.col("family_id").alias(k), F.col("consensus").alias(f"c{k}")) for k in ("a", "b"))
    pairs = merge.jaccard_pairs(_profiles(spark, d), least=0.0).select("a", "b").join(a, "a").join(b, "b")
    return pipeline.align_pairs(pairs, 10_000_000, least=10)


#: Short seeds and consensi that grow over few copies, as the passages are short and few.
_SHORT = config.DiscoverParams(l=8, scores=kernels.Scores(slope=1, quiet=20), good_length=10)


@_query()
def discover_families(spark, d):
    tiles = A.consensi(spark, d).select(
        F.lit(0).cast("long").alias("chunk"), F.col("family_id").alias("seq_index"), F.lit(0).cast("long").alias("start"), F.col("consensus").alias("seq")
    )
    return discover.discover_families(tiles, _SHORT)[0]


@_query()
def pipeline_library(spark, d):
    seqs = A.consensi(spark, d).select(F.col("family_id").alias("seq_index"), F.col("consensus").alias("seq"))
    params = config.Params(discover=_SHORT, refine=config.RefineParams(rounds=2))
    return tables.family_statistics(pipeline.build_library(seqs, params).selected)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
