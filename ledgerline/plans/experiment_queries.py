"""Queries over experiments; orders stand in for paired arms, labels for ground truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import experiments as E
from ledgerline.operators import gates as G
from ledgerline.operators import resampling as R
from ledgerline.plans.collect import collection

RUNS = "runs AS (SELECT o_custkey AS task, CASE WHEN o_orderkey % 2 = 0 THEN 'treatment' ELSE 'vanilla' END AS arm, o_orderkey, o_totalprice AS price, CAST(o_orderstatus = 'F' AS INTEGER) AS done, o_orderpriority AS stratum, o_orderstatus AS state FROM orders)"
PAIRS = """pairs AS (SELECT task, max(CASE WHEN arm = 'treatment' THEN price END) AS pa, max(CASE WHEN arm = 'vanilla' THEN price END) AS pb,
    max(CASE WHEN arm = 'treatment' THEN done END) AS da, max(CASE WHEN arm = 'vanilla' THEN done END) AS db FROM runs GROUP BY task HAVING pa IS NOT NULL AND pb IS NOT NULL)"""
TRUTH = "truth AS (SELECT l.doc_id, quality = 0 AS t, d.lang, d.n_chars, d.n_chars < 800 AS g, toxic FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"
ARMS = ("treatment", "vanilla")
QUERIES, ORACLES, query = collection(RUNS)


def runs(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(
        F.col("o_custkey").alias("task"),
        F.when(F.col("o_orderkey") % 2 == 0, "treatment").otherwise("vanilla").alias("arm"),
        "o_orderkey",
        F.col("o_totalprice").alias("price"),
        (F.col("o_orderstatus") == "F").cast("int").alias("done"),
        F.col("o_orderpriority").alias("stratum"),
        F.col("o_orderstatus").alias("state"),
    )


def pairs(spark, sf_dir):
    return E.pair_arms(runs(spark, sf_dir), "task", "arm", ARMS, ["price", "done"])


def truth(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "n_chars")
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").join(d, "doc_id")
    return rows.select("doc_id", (F.col("quality") == 0).alias("truth"), (F.col("n_chars") < 800).alias("guess"), "lang", "n_chars", "toxic", "quality")


@query("SELECT task, pa AS price_treatment, pb AS price_vanilla, da AS done_treatment, db AS done_vanilla FROM pairs", f"{RUNS}, {PAIRS}")
def paired_arms(spark, sf_dir):
    return pairs(spark, sf_dir)


@query("""SELECT metric, count(*) AS n, round(avg(a), 4) AS mean_a, round(avg(b), 4) AS mean_b, round(avg(a - b), 4) AS mean_delta
          FROM (SELECT 'price' AS metric, pa AS a, pb AS b FROM pairs UNION ALL SELECT 'done', CAST(da AS DOUBLE), CAST(db AS DOUBLE) FROM pairs) GROUP BY metric""", f"{RUNS}, {PAIRS}")  # fmt: skip
def paired_summary(spark, sf_dir):
    got = E.summarize(pairs(spark, sf_dir), ["price", "done"], ARMS)
    return got.select("metric", "n", *[F.round(c, 4).alias(c) for c in ("mean_a", "mean_b", "mean_delta")])


_TESTED = """deltas AS (SELECT 'price' AS metric, pa - pb AS d FROM pairs UNION ALL SELECT 'done', CAST(da - db AS DOUBLE) FROM pairs),
    signed AS (SELECT metric, d, rank() OVER (PARTITION BY metric ORDER BY abs(d)) + (count(*) OVER (PARTITION BY metric, abs(d)) - 1) / CAST(2 AS DOUBLE) AS r, count(*) OVER (PARTITION BY metric, abs(d)) AS peers
               FROM deltas WHERE d <> 0),
    tested AS (SELECT metric, greatest(0, abs(w - n * (n + 1) / 4.0) - 0.5) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - t / 48.0) AS z FROM (
        SELECT metric, count(*) AS n, least(coalesce(sum(CASE WHEN d > 0 THEN r END), 0), coalesce(sum(CASE WHEN d < 0 THEN r END), 0)) AS w, sum(peers * peers - 1) AS t FROM signed GROUP BY metric)),
    told AS (SELECT metric, count(*) AS n, avg(d) AS mean_delta, stddev_pop(d) / sqrt(count(*)) AS se FROM deltas GROUP BY metric)"""


@query("SELECT metric, n, round(mean_delta, 4) AS mean_delta, round(z, 6) AS z, TRUE AS holds, round(se, 6) AS se, TRUE AS as_wide FROM told JOIN tested USING (metric)", f"{RUNS}, {PAIRS}, {_TESTED}")
def paired_intervals(spark, sf_dir):
    """The report of both metrics; its intervals hold the means and are as wide as the standard errors say (within a fifth)."""
    both = pairs(spark, sf_dir)
    report = R.paired_report(both, ["price", "done"], ARMS)
    long = both.select(F.expr("stack(2, 'price', CAST(price_treatment - price_vanilla AS DOUBLE), 'done', CAST(done_treatment - done_vanilla AS DOUBLE)) as (metric, d)"))
    report = report.join(long.groupBy("metric").agg((F.stddev_pop("d") / F.sqrt(F.count("d"))).alias("se")), "metric")
    width = F.try_divide(F.col("ci_hi") - F.col("ci_lo"), 2 * 1.959964 * F.col("se"))
    return report.select("metric", "n", F.round("mean_delta", 4).alias("mean_delta"), F.round("z", 6).alias("z"), F.col("mean_delta").between(F.col("ci_lo"), F.col("ci_hi")).alias("holds"), F.round("se", 6).alias("se"), width.between(0.8, 1.2).alias("as_wide"))


@query("""SELECT task % 40 AS block, CASE WHEN drop_ >= 0.15::DOUBLE AND p < 0.05::DOUBLE AND resolved >= -0.05::DOUBLE AND latency <= 1.5::DOUBLE THEN 'ship'
                 WHEN drop_ < -0.05::DOUBLE OR resolved < -0.10::DOUBLE THEN 'kill' ELSE 'inconclusive' END AS verdict
          FROM (SELECT task % 40 AS task, -avg(CAST(pa < pb AS INTEGER) - 0.4::DOUBLE) AS drop_, max(task % 40) / 400.0::DOUBLE AS p, avg(da - db) AS resolved, avg(pa) / avg(pb) AS latency FROM pairs GROUP BY 1)""", f"{RUNS}, {PAIRS}")  # fmt: skip
def ship_verdict(spark, sf_dir):
    p = pairs(spark, sf_dir).withColumn("block", F.col("task") % 40)
    drop = -F.avg((F.col("price_treatment") < F.col("price_vanilla")).cast("double") - 0.4)
    v = E.verdict(drop, F.max("block") / 400.0, F.avg(F.col("done_treatment") - F.col("done_vanilla")), F.avg("price_treatment") / F.avg("price_vanilla"))
    return p.groupBy("block").agg(v.alias("verdict"))


@query("""SELECT o_orderkey FROM runs JOIN (SELECT task, state FROM runs GROUP BY task, state HAVING count(*) = 2 AND count(DISTINCT arm) = 2 AND bool_and(price > 1000))
          USING (task, state)""")  # fmt: skip
def valid_pairs(spark, sf_dir):
    return E.valid_pairs(runs(spark, sf_dir).withColumn("valid", F.col("price") > 1000), ["task", "state"]).select("o_orderkey")


@query("""SELECT lang, tp, fp, fn, tn, round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 6) AS precision, round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 6) AS recall,
                 round(coalesce(fp / nullif(CAST(fp + tn AS DOUBLE), 0), 0), 6) AS fpr, round(coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0), 6) AS f1
          FROM (SELECT lang, count_if(t AND g) AS tp, count_if(NOT t AND g) AS fp, count_if(t AND NOT g) AS fn, count_if(NOT t AND NOT g) AS tn FROM truth GROUP BY ROLLUP (lang))""", TRUTH)  # fmt: skip
def confusion_matrix(spark, sf_dir):
    got = E.confusion(truth(spark, sf_dir), "lang")
    return got.select("lang", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "fpr", "f1")])


@query("""SELECT lang, round(CASE WHEN c >= 1 THEN CASE WHEN s >= 1 THEN 1.0 ELSE 0.0 END ELSE (s - c) / (1 - c) END, 6) AS kappa FROM (SELECT lang, avg(CAST(t = g AS INTEGER)) AS s,
            avg(CAST(t AS INTEGER)) * avg(CAST(g AS INTEGER)) + (1 - avg(CAST(t AS INTEGER))) * (1 - avg(CAST(g AS INTEGER))) AS c FROM truth GROUP BY lang)""", TRUTH)  # fmt: skip
def kappa_by_language(spark, sf_dir):
    got = truth(spark, sf_dir).groupBy("lang").agg(E.kappa(F.col("truth").cast("int"), F.col("guess").cast("int")).alias("kappa"))
    return got.select("lang", F.round("kappa", 6).alias("kappa"))


JUDGES = "votes AS (SELECT doc_id, 1 - quality AS j1, toxic AS j2, CAST(n_chars < 800 AS INTEGER) AS j3 FROM labels JOIN documents USING (doc_id))"


def votes(spark, sf_dir):
    t = truth(spark, sf_dir)
    return t.select("doc_id", (1 - F.col("quality")).alias("j1"), F.col("toxic").alias("j2"), F.col("guess").cast("int").alias("j3"))


@query("""SELECT a, b, round((s - c) / (1 - c), 6) AS kappa FROM (SELECT a, b, avg(CAST(x = y AS INTEGER)) AS s, avg(x) * avg(y) + (1 - avg(x)) * (1 - avg(y)) AS c
          FROM (SELECT 'j1' AS a, 'j2' AS b, j1 AS x, j2 AS y FROM votes UNION ALL SELECT 'j1', 'j3', j1, j3 FROM votes UNION ALL SELECT 'j2', 'j3', j2, j3 FROM votes) GROUP BY a, b)""", JUDGES)  # fmt: skip
def judge_independence(spark, sf_dir):
    return E.pairwise_kappa(votes(spark, sf_dir), ["j1", "j2", "j3"]).withColumn("kappa", F.round("kappa", 6))


@query("SELECT doc_id, CAST(j1 + j2 + j3 >= 2 AS INTEGER) AS label FROM votes", JUDGES)
def majority_label(spark, sf_dir):
    return votes(spark, sf_dir).select("doc_id", E.majority(F.array("j1", "j2", "j3")).alias("label"))


@query("""SELECT round((sum(CASE WHEN t THEN r END) - p * (p + 1) / 2.0) / (p * q), 6) AS auc FROM (
            SELECT t, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS r,
                   count(CASE WHEN t THEN 1 END) OVER () AS p, count(CASE WHEN NOT t THEN 1 END) OVER () AS q FROM truth) GROUP BY p, q""", TRUTH)  # fmt: skip
def roc_auc(spark, sf_dir):
    return E.auc(truth(spark, sf_dir), "n_chars", "truth").select(F.round("auc", 6).alias("auc"))


@query("""SELECT arm, count(*) AS n, round(sum(price), 2) AS total, max(CASE WHEN rn = n // 2 + 1 THEN price END) AS upper_median, max(CASE WHEN rn = CAST(ceil(n * 0.9) AS BIGINT) THEN price END) AS p90
          FROM (SELECT arm, price, row_number() OVER (PARTITION BY arm ORDER BY price) AS rn, count(*) OVER (PARTITION BY arm) AS n FROM runs) GROUP BY arm""")  # fmt: skip
def arm_summary(spark, sf_dir):
    return E.arm_summary(runs(spark, sf_dir), "arm", "price").withColumn("total", F.round("total", 2))


@query("""SELECT stratum, round(sum(CASE WHEN rn = l1 THEN price * (1 - (p1 - l1)) WHEN rn = l1 + 1 THEN price * (p1 - l1) END), 4) AS q1,
                 round(sum(CASE WHEN rn = l2 THEN price * (1 - (p2 - l2)) WHEN rn = l2 + 1 THEN price * (p2 - l2) END), 4) AS q2,
                 round(sum(CASE WHEN rn = l3 THEN price * (1 - (p3 - l3)) WHEN rn = l3 + 1 THEN price * (p3 - l3) END), 4) AS q3
          FROM (SELECT *, 0.25::DOUBLE * (n + 1) AS p1, floor(0.25::DOUBLE * (n + 1)) AS l1, 0.5::DOUBLE * (n + 1) AS p2, floor(0.5::DOUBLE * (n + 1)) AS l2, 0.75::DOUBLE * (n + 1) AS p3, floor(0.75::DOUBLE * (n + 1)) AS l3
                FROM (SELECT stratum, price, row_number() OVER (PARTITION BY stratum ORDER BY price) AS rn, count(*) OVER (PARTITION BY stratum) AS n FROM runs)) GROUP BY stratum""")  # fmt: skip
def exclusive_quartiles(spark, sf_dir):
    got = E.exclusive_quartiles(runs(spark, sf_dir), "stratum", "price")
    return got.select("stratum", *[F.round(c, 4).alias(c) for c in ("q1", "q2", "q3")])


@query("""SELECT n, w, round(greatest(0, abs(w - n * (n + 1) / 4.0) - 0.5) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - t / 48.0), 6) AS z FROM (
            SELECT count(*) AS n, least(coalesce(sum(CASE WHEN d > 0 THEN r END), 0), coalesce(sum(CASE WHEN d < 0 THEN r END), 0)) AS w, sum(peers * peers - 1) AS t
            FROM (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / CAST(2 AS DOUBLE) AS r, count(*) OVER (PARTITION BY abs(d)) AS peers
                  FROM (SELECT pa - pb AS d FROM pairs) WHERE d <> 0))""", f"{RUNS}, {PAIRS}")  # fmt: skip
def wilcoxon(spark, sf_dir):
    rows = pairs(spark, sf_dir).select(F.lit("price").alias("metric"), (F.col("price_treatment") - F.col("price_vanilla")).alias("d"))
    return E.wilcoxon(rows, ["metric"], "d").select("n", "w", F.round("z", 6).alias("z"))


@query("""SELECT stratum, round(p, 8) AS p, round(least(1.0, max(raw) OVER (ORDER BY p, stratum ROWS UNBOUNDED PRECEDING)), 8) AS p_holm FROM (
            SELECT stratum, p, (count(*) OVER () - row_number() OVER (ORDER BY p, stratum) + 1) * p AS raw FROM (SELECT stratum, avg(CAST(done AS DOUBLE)) / 30 AS p FROM runs GROUP BY stratum))""")  # fmt: skip
def holm(spark, sf_dir):
    rows = runs(spark, sf_dir).groupBy("stratum").agg((F.avg("done") / 30).alias("p")).withColumn("one", F.lit(1))
    return E.holm(rows, ["one"], "p").select("stratum", F.round("p", 8).alias("p"), F.round("p_holm", 8).alias("p_holm"))


@query("""SELECT stratum, count_if(done = 1) AS k, count(*) AS n FROM runs GROUP BY ROLLUP (stratum)""")
def rate_counts(spark, sf_dir):
    return E.rate_bounds(runs(spark, sf_dir).withColumn("event", F.col("done") == 1), "stratum", "event").select("stratum", "k", "n")


#: bisection in SQL: 40 halvings of (0, 1) of the binomial sums, by a recursive expression
_TERM = "exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p}))"
_CDF = "list_sum(list_transform(range(0, {k} + 1), lambda i: " + _TERM + "))"
BOUNDS = f"""counts AS (SELECT stratum, count(CASE WHEN done = 1 THEN 1 END) AS k, count(*) AS n FROM runs GROUP BY ROLLUP (stratum)),
    tried(stratum, k, n, step, a, b, c, d) AS (SELECT stratum, k, n, 0, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE FROM counts UNION ALL
        SELECT stratum, k, n, step + 1, CASE WHEN low THEN (a + b) / 2 ELSE a END, CASE WHEN low THEN b ELSE (a + b) / 2 END, CASE WHEN high THEN (c + d) / 2 ELSE c END, CASE WHEN high THEN d ELSE (c + d) / 2 END
        FROM (SELECT *, 1 - coalesce({_CDF.format(p="((a + b) / 2)", k="(k - 1)")}, 0) < 0.025::DOUBLE AS low, {_CDF.format(p="((c + d) / 2)", k="k")} > 0.025::DOUBLE AS high FROM tried WHERE step < 40))"""


@query("""SELECT stratum, k, n, round(CASE WHEN k = 0 THEN 0.0::DOUBLE ELSE (a + b) / 2 END, 8) AS low, round(CASE WHEN k = n THEN 1.0::DOUBLE ELSE (c + d) / 2 END, 8) AS high FROM tried WHERE step = 40""", f"RECURSIVE {RUNS}, {BOUNDS}")
def exact_rate_bounds(spark, sf_dir):
    """Clopper-Pearson bounds per stratum and overall."""
    got = E.rate_bounds(runs(spark, sf_dir).withColumn("event", F.col("done") == 1), "stratum", "event")
    return got.select("stratum", "k", "n", F.round("low", 8).alias("low"), F.round("high", 8).alias("high"))


@query("""SELECT stratum, wins, losses, round(list_sum(list_transform(range(0, losses + 1), lambda i: exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) + (wins + losses) * ln(0.5::DOUBLE)))), 8) AS p
          FROM (SELECT task % 7 AS stratum, count(CASE WHEN pa > pb THEN 1 END) AS wins, count(CASE WHEN pa < pb THEN 1 END) AS losses FROM pairs GROUP BY 1)""", f"{RUNS}, {PAIRS}")  # fmt: skip
def sign_test(spark, sf_dir):
    rows = pairs(spark, sf_dir).select((F.col("task") % 7).alias("stratum"), (F.col("price_treatment") - F.col("price_vanilla")).alias("d"))
    got = E.sign_test(rows, ["stratum"], "d")
    return got.withColumn("p", F.round("p", 8))


@query("""SELECT stratum, round(b, 4) AS between, round(w, 4) AS within, round(b / (b + w), 6) AS icc FROM (SELECT stratum, var_samp(m) AS b, avg(v) AS w
          FROM (SELECT stratum, task, avg(c) AS m, var_samp(c) AS v FROM (SELECT stratum, task % 50 AS task, arm, avg(price) AS c FROM runs GROUP BY ALL) GROUP BY stratum, task) GROUP BY stratum)""")  # fmt: skip
def intra_class(spark, sf_dir):
    got = E.intra_class(runs(spark, sf_dir).withColumn("task", F.col("task") % 50), ["stratum"], "task", "arm", "price")
    return got.select("stratum", F.round("between", 4).alias("between"), F.round("within", 4).alias("within"), F.round("icc", 6).alias("icc"))


@query("""SELECT count(*) AS n_probes, round(quantile_cont(a / b, 0.5), 6) AS ratio FROM (SELECT l_suppkey, quantile_cont(l_extendedprice, 0.5) AS a, quantile_cont(l_quantity, 0.5) AS b FROM lineitem GROUP BY 1)""", "")
def median_of_ratios(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return E.median_of_ratios(rows, "l_suppkey", "l_extendedprice", "l_quantity").withColumn("ratio", F.round("ratio", 6))


@query("""SELECT p_type, n_behaviours, n_ids, n, n_ids = n AND n_behaviours >= CASE WHEN p_type IS NULL THEN 30 ELSE 10 END AS ok
          FROM (SELECT p_type, count(DISTINCT lower(regexp_replace(p_name, '[^A-Za-z0-9]+', ' ', 'g'))) AS n_behaviours, count(DISTINCT p_partkey) AS n_ids, count(*) AS n FROM part GROUP BY ROLLUP (p_type))""", "")  # fmt: skip
def corpus_check(spark, sf_dir):
    return E.corpus_check(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey", "p_type", "p_name", 10, 30)


@query("""SELECT lang, round((1.959963984540054 + 0.8416212335729143) * stddev_samp(n_chars) / sqrt(count(*)), 4) AS mde FROM truth GROUP BY lang""", TRUTH)
def minimal_effect(spark, sf_dir):
    got = truth(spark, sf_dir).groupBy("lang").agg(E.minimal_effect(F.count(F.lit(1)), F.stddev_samp("n_chars")).alias("mde"))
    return got.select("lang", F.round("mde", 4).alias("mde"))


BACKENDS = """backends AS (SELECT o_custkey % 50 AS run, ['old', 'new', 'random'][1 + o_orderkey % 3] AS backend, avg(o_totalprice) / 400000 AS auc,
                            max(o_totalprice) / 600000 AS anisotropy, quantile_cont(o_totalprice, 0.5) / 10000 AS latency_ms FROM orders GROUP BY 1, 2),
    wide AS (SELECT run, max(CASE WHEN backend = 'new' THEN auc END) AS na, max(CASE WHEN backend = 'old' THEN auc END) AS oa, max(CASE WHEN backend = 'random' THEN auc END) AS ra,
                    max(CASE WHEN backend = 'new' THEN anisotropy END) AS ni, max(CASE WHEN backend = 'old' THEN anisotropy END) AS oi,
                    max(CASE WHEN backend = 'new' THEN latency_ms END) AS nl, max(CASE WHEN backend = 'old' THEN latency_ms END) AS ol FROM backends GROUP BY run)"""


@query("""SELECT run, 'candidate_auc' AS gate, coalesce(na >= 0.70::DOUBLE, FALSE) AS passed, round(na, 6) AS observed FROM wide
          UNION ALL SELECT run, 'auc_inversion', coalesce(na - oa >= 0.05::DOUBLE, FALSE), round(na - oa, 6) FROM wide
          UNION ALL SELECT run, 'anisotropy_reduction', coalesce(oi - ni >= 0.04::DOUBLE, FALSE), round(oi - ni, 6) FROM wide
          UNION ALL SELECT run, 'latency_parity', coalesce(nl / ol <= 2.5::DOUBLE, FALSE), round(nl / ol, 6) FROM wide
          UNION ALL SELECT run, 'falsifiability', coalesce(ra <= 0.55::DOUBLE, TRUE), round(ra, 6) FROM wide""", BACKENDS)  # fmt: skip
def embedder_gates(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    backend = F.element_at(F.array(F.lit("old"), F.lit("new"), F.lit("random")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    price = F.col("o_totalprice")
    results = o.groupBy((F.col("o_custkey") % 50).alias("run"), backend.alias("backend")).agg(
        (F.avg(price) / 400000).alias("auc"), (F.max(price) / 600000).alias("anisotropy"), (F.percentile(price, 0.5) / 10000).alias("latency_ms")
    )
    return G.embedder_gates(results, "run", "old", "new", "random").select("run", "gate", "passed", F.round("observed", 6).alias("observed"))
