"""Queries over rules, graphs and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import calibration as C
from ledgerline.operators import graph as G
from ledgerline.operators import paths as P
from ledgerline.operators import rules as R
from ledgerline.plans.collect import collection
from ledgerline.plans.text_queries import _chosen, dealt

EDITS = """edits AS (SELECT doc_id AS edit_id, 'src/' || source || '/f' || doc_id || CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.ts' WHEN 'de' THEN '.md' ELSE '.json' END AS path,
    text AS source, ['pkg.' || lang, 'os.path'] AS imports FROM documents)"""
RULES = [
    {"id": "no-junk", "type": "forbid_pattern", "pattern": r"[#*$%&]{3}", "severity": "block"},
    {"id": "no-token", "type": "forbid_pattern", "pattern": r"token = \"[0-9a-f]+", "scope": "src/src1*", "severity": "warn"},
    {"id": "py-only", "type": "forbid_import", "target": "os", "language": "python", "scope": "src/src?/*", "severity": "warn"},
    {"id": "no-english", "type": "forbid_import", "target": "pkg.en", "severity": "block"},
]
EDGES = "edges AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem)"
QUERIES, ORACLES, query = collection(EDITS)


def edits(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    end = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "fr", ".ts").when(F.col("lang") == "de", ".md").otherwise(".json")
    return d.select(
        F.col("doc_id").alias("edit_id"),
        F.concat(F.lit("src/"), "source", F.lit("/f"), F.col("doc_id").cast("string"), end).alias("path"),
        F.col("text").alias("source"),
        F.array(F.concat(F.lit("pkg."), "lang"), F.lit("os.path")).alias("imports"),
    )


@query(r"""SELECT edit_id, 'no-junk' AS rule_id, 'block' AS severity FROM edits WHERE regexp_matches(source, '[#*$%&]{3}')
           UNION ALL SELECT edit_id, 'no-token', 'warn' FROM edits WHERE path LIKE 'src/src1%' AND regexp_matches(source, 'token = "[0-9a-f]+')
           UNION ALL SELECT edit_id, 'py-only', 'warn' FROM edits WHERE ends_with(path, '.py') AND path LIKE 'src/src_/%'
           UNION ALL SELECT edit_id, 'no-english', 'block' FROM edits WHERE list_contains(imports, 'pkg.en')""")  # fmt: skip
def rule_hits(spark, sf_dir):
    return R.apply_rules(edits(spark, sf_dir), RULES)


@query("""SELECT edit_id, CASE WHEN contains(path, '/f1') OR ends_with(path, '.json') THEN 'forbidden_path' WHEN path LIKE 'src/src1/%' THEN 'phase_forbidden_path'
                 WHEN NOT path LIKE 'src/src1%' AND NOT ends_with(path, '.ts') THEN 'phase_scope' ELSE 'ok' END AS verdict FROM edits""")  # fmt: skip
def contract_check(spark, sf_dir):
    """Forbidden paths, the phase's own, then its scope; what the contract allows doesn't count within a phase."""
    return P.check_contract(edits(spark, sf_dir), ["**/f1*", "src/*.json"], ["nothing/**"], ["src/src1/*"], ["./src/src1*/../src1*/**", "src/*.ts"])


@query("""SELECT edit_id, CASE WHEN NOT (ends_with(path, '.py') OR path LIKE 'src/src2/%') THEN 'allowed_paths' ELSE 'ok' END AS verdict FROM edits""")
def plan_contract_check(spark, sf_dir):
    """A contract that a plan gives forbids nothing, but allows only what it names."""
    whole = edits(spark, sf_dir).withColumn("path", F.concat(F.lit("/home/u//repo/./x/../"), "path"))
    return P.check_contract(whole, ["**"], ["src/*.py", "src/src2/**"], from_plan=True)


ODD_PATHS = ("Dockerfile", "a/b.dockerfile", "x/plans/p.md", "q.PLAN.md", "src/tests/a.py", "src/test_a.ts", "lib/a_test.go", "a.spec.tsx", ".md", "docs/read.MDX", "c.toml", "c.cfg", "k.h++", "noend", "__tests__/x.js", "my.tests/x.cs")


@query(r"""SELECT edit_id, CASE WHEN contains(p, '/plans/') OR ends_with(p, '.plan.md') THEN 'plan_md' WHEN contains(p, '/test') OR contains(p, '_test') THEN 'test_code' WHEN e IN ('.md', '.markdown', '.mdx') THEN 'doc_md'
                 WHEN e IN ('.json', '.yaml', '.yml', '.toml', '.ini') THEN 'config' ELSE 'source_code' END AS kind,
                 CASE WHEN regexp_matches(p, '(^|/|\.)dockerfile$') THEN 'dockerfile' WHEN e = '.py' THEN 'python' WHEN e = '.ts' THEN 'typescript' WHEN e IN ('.md', '.mdx') THEN 'markdown' WHEN e = '.json' THEN 'json'
                      WHEN e = '.tsx' THEN 'tsx' WHEN e = '.h++' THEN 'cpp' WHEN e = '.js' THEN 'javascript' WHEN e = '.cs' THEN 'csharp' END AS language,
                 regexp_matches(path, '(^|/)(tests?|__tests__)/|\.(test|spec)\.[^/]+$|(^|/)test_[^/]+$|_test\.[^/]+$') AS is_test
          FROM (SELECT edit_id, path, lower(path) AS p, regexp_extract(lower(path), '[^/](\.[^./]*)$', 1) AS e FROM odd)""",
       f"{EDITS}, odd AS (SELECT edit_id, CASE WHEN edit_id % 3 = 0 THEN path ELSE {_chosen(ODD_PATHS, 'edit_id')} END AS path FROM edits)")
def file_kinds(spark, sf_dir):
    odd = edits(spark, sf_dir).select("edit_id", F.when(F.col("edit_id") % 3 == 0, F.col("path")).otherwise(dealt(ODD_PATHS, F.col("edit_id"))).alias("path"))
    return odd.select("edit_id", R.file_kind(F.col("path")).alias("kind"), R.language(F.col("path")).alias("language"), R.is_test(F.col("path")).alias("is_test"))


@query("""SELECT edit_id, CAST(len(string_split(b, chr(10))) AS INTEGER) AS line, CAST(length(string_split(b, chr(10))[-1]) AS INTEGER) AS col
          FROM (SELECT edit_id, CASE WHEN pos > 0 THEN substr(source, 1, pos - 1) END AS b FROM (SELECT edit_id, source, strpos(source, '###') AS pos FROM edits)) WHERE b IS NOT NULL""")  # fmt: skip
def match_positions(spark, sf_dir):
    line, col = R.position(F.col("source"), "###")
    return edits(spark, sf_dir).select("edit_id", line.alias("line"), col.alias("col")).where("col is not null")


@query("""SELECT edit_id, arg_min(severity, (CASE severity WHEN 'block' THEN 0 ELSE 1 END, gate)) AS verdict, arg_min(gate, (CASE severity WHEN 'block' THEN 0 ELSE 1 END, gate)) AS gate FROM (
            SELECT edit_id, 'junk' AS gate, 'block' AS severity FROM edits WHERE regexp_matches(source, '[#*$%&]{3}') UNION ALL SELECT edit_id, 'english', 'warn' FROM edits WHERE ends_with(path, '.py'))
          GROUP BY edit_id""")  # fmt: skip
def gravest_outcome(spark, sf_dir):
    e = edits(spark, sf_dir)
    junk = e.where(F.col("source").rlike("[#*$%&]{3}")).select("edit_id", F.lit("junk").alias("gate"), F.lit("block").alias("verdict"))
    english = e.where(F.col("path").endswith(".py")).select("edit_id", F.lit("english").alias("gate"), F.lit("warn").alias("verdict"))
    return R.gravest(junk.unionByName(english), "edit_id", "verdict").select("edit_id", "verdict", "gate")


def edges(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))


@query("""SELECT (SELECT count(*) FROM edges) AS n_edges, (SELECT max(n) FROM (SELECT count(*) AS n FROM edges GROUP BY dst)) AS max_in, (SELECT max(n) FROM (SELECT count(*) AS n FROM edges GROUP BY src)) AS max_out,
                 count(*) AS n_nodes, round(count_if(l IS NULL) / CAST(count(*) AS DOUBLE), 6) AS isolated_share
          FROM (SELECT CAST(s_suppkey AS BIGINT) AS node FROM supplier UNION SELECT CAST(p_partkey AS BIGINT) FROM part UNION SELECT src FROM edges UNION SELECT dst FROM edges) n
          LEFT JOIN (SELECT src AS l FROM edges UNION SELECT dst FROM edges) e ON l = node""", EDGES)  # fmt: skip
def call_graph_shape(spark, sf_dir):
    nodes = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("node")).unionByName(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("node")))
    return G.degrees(edges(spark, sf_dir), nodes).withColumn("isolated_share", F.round("isolated_share", 6))


@query("""SELECT s_suppkey AS module, coalesce(n, 0) AS n_files, round(least(1.0, coalesce(n, 0) / CAST(20 AS DOUBLE)), 6) AS fan_in, round(least(1.0, coalesce(n, 0) / CAST(40 AS DOUBLE)), 6) AS coupling
          FROM supplier LEFT JOIN (SELECT l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey""", "")  # fmt: skip
def import_fan_in(spark, sf_dir):
    imports = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("file"), F.col("l_suppkey").alias("name"))
    modules = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("module"))
    n = F.col("n_files")
    return G.importers(imports, modules).select("module", "n_files", F.round(G.fan_in(n), 6).alias("fan_in"), F.round(G.coupling(n), 6).alias("coupling"))


@query("""SELECT 'added' AS change, count(*) AS n FROM (SELECT l_suppkey, l_partkey FROM lineitem WHERE l_quantity > 25 EXCEPT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_quantity <= 25)
          UNION ALL SELECT 'removed', count(*) FROM (SELECT l_suppkey, l_partkey FROM lineitem WHERE l_quantity <= 25 EXCEPT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_quantity > 25)""", "")  # fmt: skip
def import_edge_changes(spark, sf_dir):
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")  # noqa: E741
    pairs = lambda c: l.where(c).select("l_suppkey", "l_partkey")
    added, removed = G.new_edges(pairs("l_quantity <= 25"), pairs("l_quantity > 25"))
    return added.agg(F.lit("added").alias("change"), F.count(F.lit(1)).alias("n")).unionByName(removed.agg(F.lit("removed").alias("change"), F.count(F.lit(1)).alias("n")))


@query("SELECT src, dst FROM inner_edges e WHERE EXISTS (SELECT 1 FROM reach r WHERE r.src = e.dst AND r.dst = e.src)",
       f"RECURSIVE {EDGES}, inner_edges AS (SELECT src, dst FROM edges WHERE dst IN (SELECT src FROM edges) AND src IN (SELECT dst FROM edges)), "
       "reach AS (SELECT src, dst FROM inner_edges UNION SELECT r.src, e.dst FROM reach r JOIN inner_edges e ON e.src = r.dst)")  # fmt: skip
def import_cycles(spark, sf_dir):
    """Edges of the supply graph that lie on cycles."""
    return G.on_cycles(edges(spark, sf_dir))


@query()
def calibrated_kinds(spark, sf_dir):
    """Thresholds per kind of vector (grouped fits: tested against plain linear algebra)."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", F.slice("embedding", 1, 8).alias("v"))
    return C.fit_kinds(rows, "label", "v").select("kind", "n", "threshold", "low", "high")


@query()
def fired_vectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.slice("embedding", 1, 8).alias("v"))
    return C.score(rows, C.fit_kinds(rows, "label", "v"), "label", "v").select("vec_id", "distance", "fired")
