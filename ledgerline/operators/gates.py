"""Gate decisions and risk scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerline.operators.vectors import clamp, total

#: Scales of the eight risk dimensions, drift levels, least share of accepted steps, plan novelty and peers
SCALES = (20.0, 8.0, 12.0, 40.0, 200.0, 40.0, 1.0, 1.0)
DRIFT_WARN, DRIFT_DENY, STEP_SHARE, NOVELTY_CUT, NOVELTY_FLOOR, LEAST_PEERS, PEERS = 4.0, 6.0, 0.25, 1.8, 0.05, 3, 8
#: Levels of the embedder gates, and whether they are reached from above
EMBEDDER_GATES = {
    "candidate_auc": (0.70, True),
    "auc_inversion": (0.05, True),
    "anisotropy_reduction": (0.04, True),
    "latency_parity": (2.5, False),
    "falsifiability": (0.55, False),
}


def risk_vector(deltas: Column, cold: Column) -> Column:
    """Each of eight differences as a share of its scale, in 0 to 1; without code before, all but the last are 0."""
    scaled = F.zip_with(deltas, F.array(*map(F.lit, SCALES)), lambda d, s: clamp(d / s))
    return F.transform(scaled, lambda x, i: F.when(cold & (i < len(SCALES) - 1), F.lit(0.0)).otherwise(x))


def fired(values: Column, thresholds: Column) -> Column:
    """Map of the dimensions (by name) above their threshold to the margin; dimensions without a threshold never fire."""
    margins = F.map_zip_with(values, thresholds, lambda k, v, t: v - t)
    return F.map_filter(margins, lambda k, m: m > 0)


def drift_gate(score: Column) -> Column:
    return F.when(score >= DRIFT_DENY, "deny").when(score >= DRIFT_WARN, "warn").otherwise("allow")


def calibration_gate(distance: Column, threshold: Column) -> Column:
    return F.when(threshold.isNull() | F.isnan(distance), "allow").when(distance > threshold, "warn").otherwise("allow")


def regression_gate(newly_failing: Column) -> Column:
    return F.when(newly_failing > 0, "block").otherwise("allow")


def process_gate(accepted: Column, total: Column) -> Column:
    """Few accepted steps of those judged; nothing judged passes."""
    return F.when((total > 0) & (accepted / F.greatest(total, F.lit(1)) < STEP_SHARE), "warn").otherwise("allow")


def downgraded(verdict: Column, mode: Column) -> Column:
    """In shadow nothing acts, in warn nothing blocks, off allows all."""
    return (
        F.when(mode == "off", "allow")
        .when((mode == "shadow") & (verdict != "allow"), "shadow")
        .when((mode == "warn") & verdict.isin("block", "deny"), "warn")
        .otherwise(verdict)
    )


def plan_novelty(plans: DataFrame, project: str, ts: str, plan: str, vec: str) -> DataFrame:
    """Each plan against the PEERS newest ones before it in its project:
    peer_count, drift (its distance from their mean vector), peer_median (theirs,
    in the middle), denom (that, or 5 % of their median length if that is more),
    ratio and far. Below LEAST_PEERS, or where nothing has a length, all but the
    count are null. Plans are ordered by time, of one time by plan.

    A project's plans are looked at in order, with PEERS of them at hand; what is
    sorted is its vectors, which Spark spills.
    """
    w = W.partitionBy(project).orderBy(ts, plan).rowsBetween(-PEERS, -1)
    rows = plans.select(project, plan, F.col(vec).cast("array<double>").alias("__v"), F.collect_list(F.col(vec).cast("array<double>")).over(w).alias("__peers"))
    n = F.size("__peers")
    added = F.aggregate("__peers", F.transform("__v", lambda _: F.lit(0.0)), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    rows = rows.withColumn("__c", F.transform(added, lambda x: F.try_divide(x, n)))
    far = lambda a, b: F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))
    middle = lambda xs: (F.get(xs, F.floor((n - 1) / 2).cast("int")) + F.get(xs, F.floor(n / 2).cast("int"))) / 2
    rows = rows.withColumns({
        "__d": F.array_sort(F.transform("__peers", lambda p: far(p, F.col("__c")))), "__l": F.array_sort(F.transform("__peers", lambda p: F.sqrt(total(F.transform(p, lambda x: x * x))))),
    })
    known = lambda x: F.when((n >= LEAST_PEERS) & (F.col("__base") >= 1e-9) & (F.col("__base") < float("inf")) & (F.col("__far") < float("inf")), x)
    rows = rows.withColumns({"__middle": middle(F.col("__d")), "__far": far(F.col("__v"), F.col("__c"))}).withColumn("__base", F.greatest("__middle", NOVELTY_FLOOR * middle(F.col("__l"))))
    ratio = F.try_divide(F.col("__far"), F.col("__base"))
    return rows.select(
        project, plan, n.alias("peer_count"), known(F.col("__far")).alias("drift"), known(F.col("__middle")).alias("peer_median"), known(F.col("__base")).alias("denom"), known(ratio).alias("ratio"), known(ratio > NOVELTY_CUT).alias("far"),
    )


def manifest_changes(before: Column, after: Column) -> Column:
    """Map of the fields that differ between two manifests (maps of strings) to (before, after)."""
    both = F.map_zip_with(before, after, lambda k, a, b: F.struct(a.alias("before"), b.alias("after")))
    return F.map_filter(both, lambda k, v: ~v["before"].eqNullSafe(v["after"]))


def redacted_config(config: Column) -> Column:
    """Values under keys that name a secret, at any depth of a flattened map, blotted out."""
    return F.transform_values(config, lambda k, v: F.when(F.lower(k).rlike("password|secret|token|api_?key|credential"), "[REDACTED]").otherwise(v))


def step_label(file: Column, unsafe: Column, destructive: Column, regression: Column, regression_files: Column, resolved: Column) -> Column:
    """A session's outcome as its steps' label: -1 for an unsafe command or a
    destructive operation; after a regression -1 for the files it names (for all
    if it names none) and 0 for the others; 1 where it was resolved, else 0.
    Nulls count as no."""
    yes = lambda x: F.coalesce(x, F.lit(False))
    named = F.coalesce(F.size(regression_files) > 0, F.lit(False))
    return (
        F.when(yes(unsafe) | yes(destructive), -1)
        .when(yes(regression), F.when(~named | yes(F.array_contains(regression_files, file)), -1).otherwise(0))
        .when(yes(resolved), 1)
        .otherwise(0)
    )


def embedder_gates(results: DataFrame, run: str, baseline: str, candidate: str, control: str) -> DataFrame:
    """run, gate, passed, threshold, observed: five rows a run.

    results: run, backend, auc, anisotropy, latency_ms (the median); one row a
    backend. The candidate's AUC, its gain over the baseline, its fall in
    anisotropy and its latency as a multiple of the baseline's have to be
    measured (neither null nor NaN, a latency to compare with above 0) and good
    enough; the control's AUC may be missing, else it has to be near chance.
    """
    of = lambda backend, x: F.max(F.when((F.col("backend") == backend) & ~F.isnan(F.col(x).cast("double")), F.col(x).cast("double")))
    base_ms = of(baseline, "latency_ms")
    observed = {
        "candidate_auc": of(candidate, "auc"),
        "auc_inversion": of(candidate, "auc") - of(baseline, "auc"),
        "anisotropy_reduction": of(baseline, "anisotropy") - of(candidate, "anisotropy"),
        "latency_parity": F.when(base_ms > 0, of(candidate, "latency_ms") / base_ms),
        "falsifiability": of(control, "auc"),
    }
    wide = results.groupBy(run).agg(*[x.alias(f"__{k}") for k, x in observed.items()])
    rows = []
    for gate, (level, at_least) in EMBEDDER_GATES.items():
        x = F.col(f"__{gate}")
        ok = x >= level if at_least else x <= level
        missing = gate == "falsifiability"
        rows.append(F.struct(F.lit(gate).alias("gate"), F.coalesce(ok, F.lit(missing)).alias("passed"), F.lit(level).alias("threshold"), x.alias("observed")))
    return wide.select(run, F.explode(F.array(*rows)).alias("g")).select(run, "g.*")
