"""Queries over texts; documents, pages and conversations stand in for files, plans and transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerline.operators import experiments as E
from ledgerline.operators import texts as X
from ledgerline.plans.collect import collection

TOK = "tok AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS t FROM benchmark)"
DF = "df AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS token FROM tok) GROUP BY token)"
SEEN = "turns AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS after_text FROM conversations)"
QUERIES, ORACLES, query = collection()


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_chosen = lambda xs, by: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + f"][1 + ({by}) % {len(xs)}]"


def dealt(xs, by):
    return F.element_at(F.array(*map(F.lit, xs)), (by % len(xs) + 1).cast("int"))


def bench_tokens(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", X.tokens(F.col("text")).alias("t"))


def turns(spark, sf_dir):
    w = W.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").withColumn("after_text", F.lead("text").over(w)).where("after_text is not null")


@query("SELECT * FROM df", f"{TOK}, {DF}")
def token_document_frequency(spark, sf_dir):
    return X.document_frequency(bench_tokens(spark, sf_dir), "item_id", "t")


@query("""SELECT item_id, string_agg(token, ' ' ORDER BY token) AS distinctive FROM (
            SELECT DISTINCT item_id, token FROM (SELECT item_id, unnest(t) AS token FROM tok) JOIN df USING (token)
            WHERE df <= greatest(3, CAST(floor(0.03 * (SELECT count(*) FROM tok)) AS BIGINT))) GROUP BY item_id""", f"{TOK}, {DF}")  # fmt: skip
def distinctive_tokens(spark, sf_dir):
    got = X.distinctive(bench_tokens(spark, sf_dir), "item_id", "t")
    return got.select("item_id", F.array_join("distinctive", " ").alias("distinctive"))


@query("""SELECT conv_id, turn, CAST(len(list_filter(list_distinct(string_split(text, chr(10))), lambda x: NOT list_contains(string_split(after_text, chr(10)), x)))
                 + len(list_filter(list_distinct(string_split(after_text, chr(10))), lambda x: NOT list_contains(string_split(text, chr(10)), x))) AS INTEGER) AS churn
          FROM turns WHERE after_text IS NOT NULL""", SEEN)  # fmt: skip
def line_churn(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", X.churn(F.col("text"), F.col("after_text")).alias("churn"))


@query("""SELECT conv_id, turn, CAST(len(list_intersect(list_distinct(a), list_distinct(b))) AS INTEGER) AS n_shared,
                 round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0 ELSE CAST(len(list_intersect(list_distinct(a), list_distinct(b))) AS DOUBLE) / len(list_distinct(list_concat(a, b))) END, 6) AS jaccard
          FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9_]+') AS a, regexp_extract_all(lower(after_text), '[a-z0-9_]+') AS b FROM turns WHERE after_text IS NOT NULL)""", SEEN)  # fmt: skip
def shared_tokens(spark, sf_dir):
    a, b = X.tokens(F.col("text")), X.tokens(F.col("after_text"))
    return turns(spark, sf_dir).select("conv_id", "turn", F.size(X.shared(a, b)).alias("n_shared"), F.round(X.jaccard(a, b), 6).alias("jaccard"))


@query("""SELECT n, round(mean_jaccard, 6) AS mean_jaccard, round(median_jaccard, 6) AS median_jaccard, round(least, 6) AS least, round(most, 6) AS most, round(pearson, 6) AS pearson, mean_jaccard >= 0.6 AS jaccard_pass, pearson >= 0.7 AS pearson_pass,
                 mean_jaccard >= 0.6 AND pearson >= 0.7 AS overall_pass
          FROM (SELECT count(*) AS n, avg(j) AS mean_jaccard, list_sort(list(j))[1 + count(*) // 2] AS median_jaccard, min(j) AS least, max(j) AS most, corr(na, nb) AS pearson
                FROM (SELECT len(a) AS na, len(b) AS nb, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0 ELSE CAST(len(list_intersect(list_distinct(a), list_distinct(b))) AS DOUBLE) / len(list_distinct(list_concat(a, b))) END AS j
                      FROM (SELECT regexp_extract_all(lower(text), '[a-z0-9_]+') AS a, regexp_extract_all(lower(after_text), '[a-z0-9_]+') AS b FROM turns WHERE after_text IS NOT NULL)))""", SEEN)  # fmt: skip
def rater_agreement(spark, sf_dir):
    """A turn and the next one stand in for what two raters say of a document."""
    a, b = X.tokens(F.col("text")), X.tokens(F.col("after_text"))
    count = lambda c: F.size(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9_]+"), F.lit(0)))
    said = turns(spark, sf_dir).select(X.jaccard(a, b).alias("j"), count(F.col("text")).alias("na"), count(F.col("after_text")).alias("nb"))
    got = E.rater_agreement(said, "j", "na", "nb")
    return got.select("n", *[F.round(c, 6).alias(c) for c in ("mean_jaccard", "median_jaccard", "least", "most", "pearson")], "jaccard_pass", "pearson_pass", "overall_pass")


LEAKS = (" key sk-abcdefghijkl_mn here", " Bearer abc.def-ghi", " password = hunter2!", " ghp_abcdefghij0123456789xyz", " token=abc", "")
PATHS = ("conf/.env", "a/.env.local", "keys/id.pem", "src/tokenizer.py", "src/app.py", "x/server.key", "lib/environment.py")


@query(rf"""SELECT doc_id, length(s) AS n_chars, md5(s) AS digest, CASE WHEN regexp_matches(path, '{X.SECRET_PATHS}') THEN '[REDACTED]' ELSE path END AS file_path, CASE WHEN regexp_matches(path, '{X.SECRET_PATHS}') THEN 0 ELSE doc_id END AS after_bytes
            FROM (SELECT doc_id, {_chosen(PATHS, "doc_id")} AS path, {"".join("regexp_replace(" for _ in X.INLINE_SECRETS)}coalesce(text, '') || {_chosen(LEAKS, "doc_id")}{"".join(f", '{p}', '[REDACTED]', 'g')" for p in X.INLINE_SECRETS)} AS s FROM documents)""")  # fmt: skip
def redacted_rows(spark, sf_dir):
    i = F.col("doc_id")
    log = table(spark, sf_dir, "documents").select("doc_id", dealt(PATHS, i).alias("file_path"), i.alias("after_bytes"), F.concat(F.coalesce("text", F.lit("")), dealt(LEAKS, i)).alias("reason"))
    return X.redact_rows(log).select("doc_id", F.length("reason").cast("long").alias("n_chars"), F.md5(F.col("reason").cast("binary")).alias("digest"), "file_path", "after_bytes")


BODIES = (
    "- Adds a cache for the parsed files.\n* src/app.py — reads the whole log at once\n  1. First item of the plan\n2) ok\n+ a plus bullet that is long enough", "A sentence that ends with a full stop.\nno stop here\n# Header line.\nSigned-off-by: A B.",
    "- typo in the documentation of it\n- short\n-   • leading marks are dropped from here", "", "* x\n3. " + "long " * 80,
)


@query(r"""SELECT doc_id, array_to_string(list_filter(list_transform(regexp_extract_all(b, '(?m)^[ \t]*[-*+]\s+(.+)$', 1), lambda x: trim(x)), lambda x: length(x) BETWEEN 20 AND 500)[1:8], '|') AS plan_claims,
                 array_to_string(list_transform(list_filter(list_transform(l, lambda x: trim(regexp_extract(x, '^\s*(?:[-*]|\d+[.)])\s+(.+?)\s*$', 1))), lambda x: length(x) > 4), lambda x: substr(x, 1, 300)), '|') AS step_claims,
                 array_to_string(list_transform(list_filter(list_transform(list_filter(list_transform(list_filter(l, lambda x: regexp_matches(x, '\S') AND NOT regexp_matches(x, '(?i)^\s*(?:co-authored-by|signed-off-by|reviewed-by):')),
                       lambda x: CASE WHEN regexp_matches(rtrim(x), '^\s*[-*]\s+(.+)$') THEN trim(regexp_extract(rtrim(x), '^\s*[-*]\s+(.+)$', 1)) WHEN ends_with(trim(x), '.') AND NOT starts_with(trim(x), '#') THEN trim(x) END), lambda x: x IS NOT NULL),
                       lambda x: trim(regexp_replace(regexp_replace(x, '^[\w./\-]+\.(?:py|js|ts|md|json|yaml|sh)\s+[—:-]\s+', ''), '^[-*•· ]+', ''))),
                       lambda x: length(x) BETWEEN 20 AND 400 AND NOT regexp_matches(x, '(?i)^(?:chore|typo|lint|format|whitespace|nit)\b')), lambda x: substr(x, 1, 200)), '|') AS commit_claims
          FROM (SELECT doc_id, b, string_split(b, chr(10)) AS l FROM bodies)""",
       f"bodies AS (SELECT doc_id, {_chosen(BODIES, 'doc_id')} || chr(10) || '- document ' || doc_id || ' has its own claim' AS b FROM documents)")
def claims(spark, sf_dir):
    body = F.concat(dealt(BODIES, F.col("doc_id")), F.lit("\n- document "), F.col("doc_id").cast("string"), F.lit(" has its own claim"))
    of = {"plan_claims": X.plan_claims(body), "step_claims": X.step_claims(body), "commit_claims": X.commit_claims(body)}
    return table(spark, sf_dir, "documents").select("doc_id", *[F.array_join(c, "|").alias(k) for k, c in of.items()])


@query("""SELECT split, count(*) AS n FROM (SELECT CASE WHEN x < 70 THEN 'train' WHEN x < 85 THEN 'dev' ELSE 'test' END AS split
          FROM (SELECT CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 2) AS INTEGER) % 100 AS x FROM documents)) GROUP BY split""")  # fmt: skip
def split_sizes(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(X.hash_split(F.col("doc_id")).alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT conv_id, stratum FROM (SELECT conv_id, CASE WHEN n <= 1 THEN '1' WHEN n <= 5 THEN '2-5' ELSE '6+' END AS stratum
            FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id))
          QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY md5(conv_id || 's7'), conv_id) <= CASE WHEN stratum = '6+' THEN 21 ELSE 20 END""")  # fmt: skip
def stratified_conversations(spark, sf_dir):
    sizes = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return X.stratified_sample(sizes, "conv_id", "n", 61, "s7").select("conv_id", "stratum")


@query("SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || 's7'), doc_id) AS place FROM documents")
def seeded_shuffle(spark, sf_dir):
    return X.seeded_order(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "s7").select("doc_id", "place")


@query("""SELECT source, name, count(*) AS n FROM (SELECT source, lang AS name, md5(text) AS body FROM documents WHERE doc_id % 2 = 1
            AND md5(text) IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0)) GROUP BY source, name""")  # fmt: skip
def copied_between_halves(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("lang").alias("name"), F.md5(F.col("text").cast("binary")).alias("body"))
    old = docs.where("doc_id % 2 = 0").select("body")
    return docs.where("doc_id % 2 = 1").join(old, "body", "left_semi").groupBy("source", "name").agg(F.count(F.lit(1)).alias("n"))


#: what the stand-in test files and plans say beside their text, dealt by id
TEST_CODE = (
    'cy.intercept("/api/**", {fixture: "users.json"}); jest.mock("./db"); const id = "seed-7";',
    "cy.intercept('*', (req) => req.continue()); cy.intercept('/api/x', {body: 1}); axios.get('/real')",
    'vi.mock("a"); sinon.stub(o, "f"); nock("h"); const a = "user-0001", b = "order_99";',
    "requests.get(url); httpx.Client(); create_engine(dsn)",
    'cy.intercept(`/**`, {statusCode: 500}); cy.intercept("/", { body: [] }); setupServer(); x = "user-0001"',
    "",
    'fetch("https://h/x"); mocker.patch("m"); @patch("n"); y = "seed-0042" + \'user-0001\'',
)
PLAN_NOTES = (
    " See src/app.py:120 and /api/users/list. A deadlock is likely at line 12.", " Check edge cases. Make sure tests pass. Verify it works.",
    "\n\nTOCTOU and SQL injection in ./lib/db.ts, L42.\n- Fix web/main.vue\n- Add an index", " Read the diff!", "",
)
def _counts(patterns):
    return " + ".join("len(regexp_extract_all(text, '" + p.replace("'", "''") + "'))" for p in patterns)


_IDS = "list_distinct(regexp_extract_all(text, '" + X.ID_LITERAL.replace("'", "''") + "', 1))"
_INTERCEPT = X.INTERCEPT.replace("'", "''")
TESTS = f"""tests AS (SELECT doc_id, coalesce(text, '') || ' ' || {_chosen(TEST_CODE, "doc_id")} AS text FROM documents),
            ids AS (SELECT doc_id, {_IDS} AS ids FROM tests), seeds AS (SELECT DISTINCT unnest(ids) AS id FROM ids WHERE doc_id % 3 = 0)"""


@query(rf"""SELECT doc_id, round(intercepts, 6) AS intercepts, round(mocks, 6) AS mocks, round(guests, 6) AS guests, round(1 - (intercepts + mocks + guests) / 3, 6) AS authenticity,
                  (intercepts + mocks + guests) / 3 >= 0.4::DOUBLE AND greatest(intercepts, mocks, guests) >= 0.6::DOUBLE AS mocked
           FROM (SELECT doc_id, CASE WHEN len(r) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(range(1, len(r) + 1), lambda i: (contains(r[i], '**') OR trim(r[i]) IN ('*', '/'))
                          AND regexp_matches(a[i], '{X.STUB}') AND NOT contains(a[i], 'req.continue') AND NOT contains(a[i], 'passThrough'))) / CAST(len(r) AS DOUBLE) END AS intercepts,
                        CASE WHEN m + c = 0 THEN 0.0::DOUBLE ELSE m / CAST(m + c AS DOUBLE) END AS mocks,
                        CASE WHEN len(ids) = 0 OR (SELECT count(*) FROM seeds) = 0 THEN 0.0::DOUBLE ELSE 1 - coalesce(met, 0) / CAST(len(ids) AS DOUBLE) END AS guests
                 FROM (SELECT doc_id, regexp_extract_all(text, '{_INTERCEPT}', 1) AS r, regexp_extract_all(text, '{_INTERCEPT}', 2) AS a, {_counts(X.MOCK_CALLS)} AS m, {_counts(X.CLIENT_CALLS)} AS c FROM tests)
                 JOIN ids USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS met FROM (SELECT doc_id, unnest(ids) AS id FROM ids) JOIN seeds USING (id) GROUP BY doc_id) USING (doc_id))""", TESTS)  # fmt: skip
def mock_detector(spark, sf_dir):
    tests = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), dealt(TEST_CODE, F.col("doc_id"))).alias("text"))
    m = X.mock_ratios(tests, tests.where("doc_id % 3 = 0"))
    return m.select("doc_id", *[F.round(c, 6).alias(c) for c in ("intercepts", "mocks", "guests", "authenticity")], "mocked")


_ascii = lambda ps: [p.removeprefix("(?U)") for p in ps]  # noqa: E731  the same in SQL, whose classes are ASCII
PLANS = f"plans AS (SELECT conv_id, turn, coalesce(text, '') || {_chosen(PLAN_NOTES, 'turn + ascii(right(CAST(conv_id AS VARCHAR), 1))')} AS text FROM conversations)"


@query(rf"""SELECT conv_id, turn, round(ard, 6) AS ard, round(nrd, 6) AS nrd, round(gpas, 6) AS gpas, round(slr, 6) AS slr, score, CASE WHEN score >= 0.75 THEN 'accept' WHEN score >= 0.5 THEN 'warn' ELSE 'reject' END AS verdict
           FROM (SELECT *, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE 0.25::DOUBLE * (CAST(ard >= 0.4::DOUBLE AS INTEGER) + CAST(nrd >= 0.2::DOUBLE AS INTEGER) + CAST(gpas < 0.15::DOUBLE AS INTEGER) + CAST(slr >= 0.35::DOUBLE AS INTEGER)) END AS score
             FROM (SELECT conv_id, turn, len(l) AS n, ({_counts(_ascii(X.ARTIFACTS))}) / CAST(greatest(len(l), 1) AS DOUBLE) AS ard,
                    len(list_filter({[x.lower() for x in X.NAMED_RISKS]}, lambda x: contains(lower(text), x))) / CAST(greatest(len(l), 1) AS DOUBLE) AS nrd,
                    least(1.0::DOUBLE, len(list_filter({[x.lower() for x in X.GENERIC_PHRASES]}, lambda x: contains(lower(text), x))) / CAST(greatest(len(l), 1) AS DOUBLE)) AS gpas,
                    len(list_filter(l, lambda x: {" OR ".join(f"regexp_matches(x, '{p}')" for p in _ascii(X.ARTIFACTS))})) / CAST(greatest(len(l), 1) AS DOUBLE) AS slr
             FROM (SELECT conv_id, turn, text, list_filter(string_split(regexp_replace(text, '([.!?])(\s+[A-Z])|

+|
[-*]\s+', chr(1) || '', 'g'), chr(1)), lambda x: regexp_matches(x, '\S')) AS l FROM plans)))""", PLANS)  # fmt: skip
def plan_quality(spark, sf_dir):
    note = dealt(PLAN_NOTES, F.col("turn") + F.ascii(F.substring(F.col("conv_id").cast("string"), -1, 1)))
    plans = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), note).alias("text"))
    q = X.with_plan_quality(plans, "text", ["conv_id", "turn"])
    return q.select("conv_id", "turn", *[F.round(k, 6).alias(k) for k in ("ard", "nrd", "gpas", "slr")], "score", "verdict")


@query("""SELECT doc_id, source_rank FROM (SELECT doc_id, 0 AS source_rank FROM labels UNION ALL SELECT doc_id, 1 FROM documents)
          QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY source_rank) = 1""")  # fmt: skip
def first_source_wins(spark, sf_dir):
    return X.first_wins([table(spark, sf_dir, t).select("doc_id") for t in ("labels", "documents")], "doc_id")


@query("""SELECT source, substr(sha256('["' || array_to_string(list_sort(list(DISTINCT lang)), '", "') || '"]'), 1, 12) AS finding_id,
                 CASE WHEN count(DISTINCT lang) >= 3 AND count(*) >= 12 AND bool_or(n_chars > 1000) THEN 'extract' ELSE 'note' END AS verdict
          FROM documents GROUP BY source""")  # fmt: skip
def finding_verdicts(spark, sf_dir):
    by = table(spark, sf_dir, "documents").groupBy("source").agg(F.collect_set("lang").alias("sites"), F.count(F.lit(1)).alias("n"), F.bool_or(F.col("n_chars") > 1000).alias("covered"))
    return by.select("source", X.finding_id(F.col("sites")).alias("finding_id"), X.duplicate_verdict(F.size("sites"), F.col("n"), F.col("covered")).alias("verdict"))
