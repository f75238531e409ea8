"""Queries over vectors; `embeddings` stands in for scored edits, label for their kind."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerline.operators import separation as S
from ledgerline.operators import vectors as V
from ledgerline.plans.collect import collection

#: no pair of the test vectors reaches the default recall threshold
TEST_RECALL = 0.30
VEC = "vec AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL)"
NEXT = "nxt AS (SELECT a.vec_id, a.v, b.v AS w FROM vec a JOIN vec b ON b.vec_id = a.vec_id + 1)"
QUERIES, ORACLES, query = collection(VEC)


def vectors(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding is not null").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def successive(spark, sf_dir):
    """Each vector with the next one: an edit before and after."""
    v = vectors(spark, sf_dir)
    return v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id").select("vec_id", "v", "w")


@query("""SELECT vec_id, round(list_cosine_similarity(v, w), 6) AS cosine, round(sqrt(greatest(0, 2 - 2 * list_cosine_similarity(v, w))), 6) AS chord,
                 round(greatest(0, least(1, (list_cosine_similarity(v, w) + 1) / 2)), 6) AS alignment,
                 round(greatest(0, least(1, 1 - greatest(list_cosine_similarity(v, w), 0))), 6) AS novelty
          FROM nxt WHERE w IS NOT NULL""", f"{VEC}, {NEXT}")  # fmt: skip
def edit_distances(spark, sf_dir):
    v, w = F.col("v"), F.col("w")
    cos = V.cosine(v, w)
    ais, novelty = V.similarity_scores(cos)
    r = lambda x, name: F.round(x, 6).alias(name)
    return successive(spark, sf_dir).select("vec_id", r(cos, "cosine"), r(V.chord(v, w), "chord"), r(ais, "alignment"), r(novelty, "novelty"))


@query("SELECT vec_id, CAST(list_position(v, list_max(v)) AS BIGINT) AS dominant FROM vec")
def dominant_dimension(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", V.dominant(F.col("v")).cast("long").alias("dominant"))


@query("""SELECT label, count(*) AS n_pairs_2, round(avg(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)))), 6) AS mean_cosine
          FROM vec a JOIN vec b USING (label) WHERE a.vec_id <> b.vec_id GROUP BY label""")  # fmt: skip
def anisotropy(spark, sf_dir):
    """Mean pairwise cosine of each kind."""
    got = V.unit_sum(vectors(spark, sf_dir), ["label"], "v")
    return got.select("label", (F.col("n") * (F.col("n") - 1)).alias("n_pairs_2"), F.round("mean_cosine", 6).alias("mean_cosine")).where("n_pairs_2 > 0")


@query("""SELECT label, n, round(p95, 6) AS p95 FROM (
            SELECT label, count(*) AS n, quantile_cont(sqrt(greatest(0, 2 - 2 * list_cosine_similarity(v, c))), 0.95) AS p95
            FROM vec JOIN (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(v[i]) AS m FROM vec, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i) GROUP BY label) USING (label)
            GROUP BY label)""")  # fmt: skip
def session_baseline(spark, sf_dir):
    got = V.drift_baseline(vectors(spark, sf_dir), ["label"], "v")
    return got.select("label", "n", F.round("p95", 6).alias("p95"))


@query(f"""SELECT a.vec_id AS qid, b.vec_id AS id, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM vec a JOIN vec b ON a.vec_id <> b.vec_id
          WHERE a.vec_id % 20 = 0 AND list_cosine_similarity(a.v, b.v) >= {TEST_RECALL}""")  # fmt: skip
def duplicate_recall(spark, sf_dir):
    corpus = vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("v").alias("vec"))
    asked = corpus.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    return V.pairs_above(corpus, asked, TEST_RECALL).withColumn("cosine", F.round("cosine", 6))


@query("""SELECT qid, round(avg(1 - cosine), 6) AS distance, avg(1 - cosine) > 0.40 AS ood FROM (
            SELECT a.vec_id AS qid, b.vec_id AS id, list_cosine_similarity(a.v, b.v) AS cosine FROM vec a JOIN vec b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
            QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.vec_id) <= 3) GROUP BY qid""")  # fmt: skip
def out_of_distribution(spark, sf_dir):
    corpus = vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("v").alias("vec"))
    asked = corpus.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    return V.out_of_distribution(corpus, asked).select("qid", F.round("distance", 6).alias("distance"), "ood")


@query("""SELECT CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, count(*) AS n, round(corr(v[i], v[j]), 6) AS r
          FROM vec, (SELECT unnest(range(1, 9)) AS i) a, (SELECT unnest(range(1, 9)) AS j) b WHERE i < j GROUP BY i, j""")  # fmt: skip
def risk_correlation(spark, sf_dir):
    return V.correlations(vectors(spark, sf_dir), "v", 8).withColumn("r", F.round("r", 6))


@query("""SELECT round((avg(CASE WHEN g THEN x END) - avg(CASE WHEN NOT g THEN x END)) / sqrt((pow(stddev_pop(CASE WHEN g THEN x END), 2) + pow(stddev_pop(CASE WHEN NOT g THEN x END), 2)) / 2), 6) AS d
          FROM (SELECT label < 5 AS g, v[1] AS x FROM vec)""")  # fmt: skip
def kind_separation(spark, sf_dir):
    values = vectors(spark, sf_dir).select((F.col("label") < 5).alias("g"), F.col("v")[0].alias("x"))
    return V.separation(values, "g", "x").select(F.round("d", 6).alias("d"))


#: deviations that are enough for the test vectors
TEST_SIGMA = 0.05
_COS = "list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)))"
_OWN = f"own AS (SELECT a.label, count(*) AS pairs, avg({_COS}) AS intra_mean, stddev_pop({_COS}) AS intra_sd FROM vec a JOIN vec b ON b.label = a.label AND b.vec_id > a.vec_id GROUP BY a.label)"
_CROSS = f"across AS (SELECT a.label, count(*) AS cross_pairs, avg({_COS}) AS cross_mean, stddev_pop({_COS}) AS cross_sd FROM vec a JOIN vec b ON b.label <> a.label GROUP BY a.label)"
_SPREADS = "round(intra_mean, 6) AS intra_mean, round(intra_sd, 6) AS intra_sd, cross_pairs, round(cross_mean, 6) AS cross_mean, round(cross_sd, 6) AS cross_sd"


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("intra_mean", "intra_sd", "cross_mean", "cross_sd")} | {"sigma": F.round("sigma", 4)})


@query(f"""SELECT label, pairs, {_SPREADS}, round(sigma, 4) AS sigma, sigma >= {TEST_SIGMA} AS fit
          FROM (SELECT *, abs(intra_mean - cross_mean) / sqrt((intra_sd * intra_sd + cross_sd * cross_sd) / 2) AS sigma FROM own JOIN across USING (label))""", f"{VEC}, {_OWN}, {_CROSS}")  # fmt: skip
def embedder_separation(spark, sf_dir):
    """Each kind's own cosines against those with the other kinds."""
    return _rounded(S.kind_sigma(S.cosine_spreads(vectors(spark, sf_dir), "label", "v"), TEST_SIGMA)).drop("n")


@query(f"""SELECT label, pairs, {_SPREADS}, round(sigma, 4) AS sigma, sigma >= {TEST_SIGMA} AS fit
          FROM (SELECT *, (intra_mean - cross_mean) / cross_sd AS sigma FROM own JOIN across USING (label))""", f"{VEC}, {_OWN}, {_CROSS}".replace(_COS, "list_inner_product(a.v, b.v)"))  # fmt: skip
def duplicate_separation(spark, sf_dir):
    """Each kind as a cluster of duplicates: its inner products against those with unrelated vectors."""
    return _rounded(S.duplicate_sigma(S.cosine_spreads(vectors(spark, sf_dir), "label", "v", unit=False), TEST_SIGMA)).drop("n")
