"""Parameter grids: one library per setting, one summary row each."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame

from strandlake.operators.evaluate import base_metrics, interval_metrics
from strandlake.plans.config import DiscoverParams, LibraryParams, Params, RefineParams
from strandlake.plans.pipeline import build_library

PRESETS: dict[str, dict[str, Params]] = {
    "smoke": {
        "default": Params(),
        "strict": Params(refine=RefineParams(max_divergence=0.20)),
        "upper": Params(library=LibraryParams(mode="upper")),
        "seeds3": Params(discover=DiscoverParams(min_threshold=3)),
    },
}
PRESETS["small"] = PRESETS["smoke"] | {
    f"div{int(100 * d)}-{m}": Params(refine=RefineParams(max_divergence=d), library=LibraryParams(mode=m)) for d in (0.15, 0.25, 0.35) for m in ("exact", "none")
}


def run_grid(seqs: DataFrame, truth: DataFrame, cases: dict[str, Params]) -> DataFrame:
    """(case, seconds, families, accepted, tp, fp, fn, ..., base precision, recall, f1); ``truth`` is a BED table whose
    chrom is the record's number."""
    spark = seqs.sparkSession
    rows = []
    for name, params in cases.items():  # a handful of settings, each a distributed run
        began = time.time()
        lib = build_library(seqs, params)
        ok = lib.selected.where("state in ('exclusive', 'standalone')").select("family_id")
        hits = lib.instances.join(ok, "family_id", "left_semi")
        pred = hits.selectExpr(
            "monotonically_increasing_id() as id", "cast(seq_index as string) as chrom", "start", "end", "cast(family_id as string) as name", "case when strand > 0 then '+' else '-' end as strand"
        )
        known = truth.selectExpr("monotonically_increasing_id() as id", "cast(chrom as string) as chrom", "start", "end", "name", "strand")
        m, b = interval_metrics(pred, known).first(), base_metrics(pred, known, ["chrom"]).first()
        s = lib.summary.first()
        rows.append((name, time.time() - began, lib.families.count(), s.accepted, s.ratio, s.bases_covered, m.tp, m.fp, m.fn, m.precision, m.recall, m.f1, b.precision, b.recall, b.f1))
    return spark.createDataFrame(
        rows, "case string, seconds double, families long, accepted long, ratio double, bases_covered long, tp long, fp long, fn long, "
        "precision double, recall double, f1 double, base_precision double, base_recall double, base_f1 double",
    )
