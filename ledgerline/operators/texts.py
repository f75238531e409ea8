"""Operators over texts: tokens, churn, redaction, plan quality, splits, claims."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerline.operators.screens import text_lines

#: Inline credentials that are blotted out, and paths that are never logged
INLINE_SECRETS = (r"sk-[A-Za-z0-9_\-]{12,}", r"ghp_[A-Za-z0-9]{20,}", r"Bearer\s+[A-Za-z0-9._\-]{8,}", r"(?i)password\s*=\s*\S+")
SECRET_PATHS = r"(?i)\.env(?:\.|$)|\.pem$|\.key$|secret|credential|token"
REDACTED = "[REDACTED]"

#: Commands by what they check, the first that fits
CHECKS = {
    "test": r"(?:^|\s)(?:pytest|mvn\s+test|gradle\s+test|cargo\s+test|go\s+test|dotnet\s+test|(?:npm|pnpm|yarn)\s+(?:run\s+)?test)\b",
    "lint": r"(?:^|\s)(?:ruff|eslint|biome|golangci-lint|clippy)\b",
    "typecheck": r"(?:^|\s)(?:mypy|pyright|tsc)\b",
    "build": r"(?:^|\s)(?:make\s+(?:build|check)|cargo\s+build|go\s+build|dotnet\s+build|npm\s+run\s+build|pnpm\s+build|yarn\s+build)\b",
}
#: Share and least count of the rare-token cutoff; sites and tokens of an extractable duplicate
RARE_SHARE, RARE_LEAST, SITES, TOKENS = 0.03, 3, 3, 12
#: Accept and warn levels of the plan score, levels of its signals
ACCEPT, WARN = 0.75, 0.5
LEVELS = {"ard": 0.4, "nrd": 0.2, "gpas": 0.15, "slr": 0.35}
#: Where a plan's sentences end; files, endpoints and lines it refers to; risks by name; phrases that say nothing
SENTENCE_END = r"(?U)[.!?](?=\s+[A-Z])|\n\n+|\n[-*]\s+"
ARTIFACTS = (
    r"(?U)\b[\w./-]+\.(?:ts|tsx|js|mjs|cjs|cs|py|vue|go|rs|sql|sh|json|yaml|yml|md|toml|ini)\b",
    r"(?U)\B/[a-zA-Z][\w-]*(?:/[\w{}:.-]+)+\b",
    r"(?U)(?::\d{2,}|line\s+\d+|L\d{2,})\b",
)
NAMED_RISKS = (
    "N+1", "race condition", "race-condition", "TOCTOU", "deadlock",
    "SQL injection", "SQLi", "XSS", "CSRF", "dead code",
    "integer overflow", "null dereference", "unchecked exception",
    "missing index", "coverage gap", "off-by-one", "double-free",
    "use-after-free", "unbounded pagination", "missing auth check",
    "open redirect", "ReDoS", "TOCTTOU", "type confusion",
)
GENERIC_PHRASES = (
    "Read the diff", "Read full diff", "Re-read by file", "Check edge cases", "Verify it works", "Look for potential issues",
    "Make sure tests pass", "Review the changes", "Check for correctness", "Ensure code quality", "Make sure the code is clean",
)
#: Mean and peak of the mock ratios; intercepted routes, stubs, id literals, calls that mock, calls of real clients
MOCK_MEAN, MOCK_PEAK = 0.4, 0.6
INTERCEPT = r"""(?s)cy\.intercept\s*\(\s*["'`]([^"'`]*?)["'`](.*?)\)"""
STUB = r"(?s)\{[^}]*?(?:fixture|statusCode|body)\s*:"
ID_LITERAL = r"""["'`]([A-Za-z0-9_-]{6,40})["'`]"""
MOCK_CALLS = (
    r"\bjest\.mock\s*\(", r"\bvi\.mock\s*\(", r"\bsinon\.(?:stub|fake|mock|spy)\s*\(", r"\bnock\s*\(", r"\bMock<[^>]+>\s*\(", r"\bnew\s+Mock<[^>]+>\s*\(",
    r"\.Setup\s*\(", r"\bMockBean\b", r"\bmock\s*\(\s*[A-Z]\w+::class", r"\bgomock\.NewController\b", r"@patch\s*\(", r"\bmocker\.patch\b",
    r"\bresponses\.add\b", r"\brespx\.\w+\s*\(", r"\baioresponses\s*\(", r"\bsetupServer\s*\(", r"\brest\.(?:get|post|put|delete|patch)\s*\(",
)
CLIENT_CALLS = (
    r"\baxios\.(?:get|post|put|delete|patch)\s*\(", r"\bfetch\s*\(\s*['\"]https?://", r"\brequests\.(?:get|post|put|delete|patch)\s*\(",
    r"\bhttpx\.(?:get|post|put|delete|patch|Client)\s*\(", r"\bnew\s+HttpClient\b", r"\bWebApplicationFactory<", r"\bTestcontainers\.", r"\bGenericContainer\b",
    r"\bPostgreSQLContainer\b", r"\bpsycopg\.\w+\.connect\b", r"\basyncpg\.connect\b", r"\bcreate_engine\s*\(", r"\bredis\.Redis\s*\(", r"\bgrpc\.insecure_channel\b",
    r"\bboto3\.(?:client|resource)\s*\(", r"\bamqplib\.Connection\s*\(",
)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores (ASCII)."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_]+"), F.lit(0))


def document_frequency(docs: DataFrame, key: str, token_col: str) -> DataFrame:
    """In how many rows each token occurs."""
    each = docs.select(F.explode(F.array_distinct(token_col)).alias("token"))
    return each.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def rare_cutoff(n: Column) -> Column:
    return F.greatest(F.lit(RARE_LEAST).cast("long"), F.floor(RARE_SHARE * n).cast("long"))


def distinctive(docs: DataFrame, key: str, token_col: str) -> DataFrame:
    """Per row its sorted tokens that few rows have. Rows without any are left out."""
    df = document_frequency(docs, key, token_col)
    n = docs.agg(F.count(F.lit(1)).alias("__n"))  # one row
    rare = df.crossJoin(F.broadcast(n)).where(F.col("df") <= rare_cutoff(F.col("__n"))).select("token")
    each = docs.select(key, F.explode(F.array_distinct(token_col)).alias("token"))
    return each.join(rare, "token").groupBy(key).agg(F.array_sort(F.collect_list("token")).alias("distinctive"))


def churn(before: Column, after: Column) -> Column:
    """Lines that only one side has; as sets, repeats don't count."""
    a, b = F.split(before, "\n"), F.split(after, "\n")
    return F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))


def shared(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """1.0 for two empty sets."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.nullif(F.size(F.array_union(a, b)), F.lit(0))), F.lit(1.0))


def scrub(text: Column) -> Column:
    for p in INLINE_SECRETS:
        text = F.regexp_replace(text, p, REDACTED)
    return text


def redact_rows(log: DataFrame) -> DataFrame:
    """Rows of a log, of these columns those that it has: a secret file keeps
    neither path, digests nor sizes; free text is scrubbed; secret files are
    blotted out of lists of files. Nulls stay null."""
    hidden = F.coalesce(F.col("file_path").rlike(SECRET_PATHS), F.lit(False)) if "file_path" in log.columns else F.lit(False)
    own = {
        **dict.fromkeys(("file_path", "file_path_rel"), lambda c: F.when(hidden, REDACTED).otherwise(c)),
        **dict.fromkeys(("before_sha256", "after_sha256"), lambda c: F.when(~hidden, c)),
        **dict.fromkeys(("before_bytes", "after_bytes"), lambda c: F.when(hidden, F.lit(0)).otherwise(c)),
        **dict.fromkeys(("human_summary", "reason", "command"), scrub),
        **dict.fromkeys(("missing_files", "changed_files"), lambda c: F.transform(c, lambda x: F.when(x.rlike(SECRET_PATHS), REDACTED).otherwise(x))),
    }
    kinds = dict(log.dtypes)
    return log.select(*[own[c](F.col(c)).cast(kinds[c]).alias(c) if c in own else F.col("`" + c.replace("`", "``") + "`") for c in log.columns])


def hash_split(key: Column) -> Column:
    """train, dev or test by the first byte of the key's SHA-256, modulo 100 (so
    not even: bytes 0 to 55 fall on three values each, the rest on two)."""
    x = F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 2), 16, 10).cast("int") % 100
    return F.when(x < 70, "train").when(x < 85, "dev").otherwise("test")


def stratified_sample(df: DataFrame, key: str, size: str, n: int, seed: str) -> DataFrame:
    """A sampling operator: of the strata of size 1, 2 to 5, and 6 and more a
    third each of n, the last one with what is left over, by the key's hash.
    Rows of no size are in no stratum."""
    stratum = F.when(F.col(size) == 1, "1").when(F.col(size).between(2, 5), "2-5").when(F.col(size) >= 6, "6+")
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)).cast("binary"))
    ranked = df.withColumn("stratum", stratum).where("stratum is not null").withColumn("__rn", F.row_number().over(W.partitionBy("stratum").orderBy(order, key)))
    share = F.when(F.col("stratum") == "6+", n - 2 * (n // 3)).otherwise(n // 3)
    return ranked.where((F.col("__rn") <= n) & (F.col("__rn") <= share)).drop("__rn")


def seeded_order(df: DataFrame, key: str, seed: str) -> DataFrame:
    """Places of a shuffle that the seed decides, from 1; within partitions of the
    hash's first digit, then over them, so that no task sorts all rows."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)).cast("binary"))
    keyed = df.withColumn("__h", h).withColumn("__b", F.substring("__h", 1, 3))
    counts = keyed.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))  # 4,096 rows at most
    before = F.coalesce(F.sum("__n").over(W.partitionBy(F.lit(1)).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__b", before.alias("__o"))
    place = F.row_number().over(W.partitionBy("__b").orderBy("__h", key))
    return keyed.join(F.broadcast(offsets), "__b").withColumn("place", F.col("__o") + place).drop("__h", "__b", "__o")


def sentences(text: Column) -> Column:
    """Pieces between full stops before capitals, blank lines and bullets; blank ones left out."""
    return F.filter(F.split(text, SENTENCE_END), lambda x: x.rlike(r"(?U)\S"))


def artifacts(text: Column) -> Column:
    """How many files, endpoints and lines a text refers to."""
    return sum((F.regexp_count(text, F.lit(p)) for p in ARTIFACTS), F.lit(0))


def plan_quality(text: Column) -> dict[str, Column]:
    """Signals of a plan, each per sentence, and the score of those that pass.

    ard: artifacts referred to; nrd: named risks that occur; gpas: generic
    phrases that occur, 1 at most; slr: sentences with an artifact. A quarter of
    the score each for ard, nrd and slr of their levels at least, and for gpas
    below its own. A null or blank plan scores 0 in all and is rejected.
    """
    text = F.coalesce(text, F.lit(""))
    return _plan_signals(**_plan_counts(text, sentences(text)))


def _plan_counts(text: Column, parts: Column) -> dict[str, Column]:
    low = F.lower(text)
    hits = lambda phrases: sum((low.contains(p.lower()).cast("int") for p in phrases), F.lit(0))
    located = F.size(F.filter(parts, lambda x: x.rlike(ARTIFACTS[0]) | (x.contains("/") & x.rlike(ARTIFACTS[1])) | (x.rlike("[0-9]") & x.rlike(ARTIFACTS[2]))))
    return {"n": F.size(parts), "found": artifacts(text), "risks": hits(NAMED_RISKS), "generic": hits(GENERIC_PHRASES), "located": located}


def _plan_signals(n: Column, found: Column, risks: Column, generic: Column, located: Column) -> dict[str, Column]:
    per = lambda x: F.when(n > 0, x / F.greatest(n, F.lit(1))).otherwise(F.lit(0.0))
    out = {"ard": per(found), "nrd": per(risks), "gpas": F.least(F.lit(1.0), per(generic)), "slr": per(located)}
    passed = [out["ard"] >= LEVELS["ard"], out["nrd"] >= LEVELS["nrd"], out["gpas"] < LEVELS["gpas"], out["slr"] >= LEVELS["slr"]]
    score = F.when(n > 0, sum((F.when(p, 0.25).otherwise(0.0) for p in passed), F.lit(0.0))).otherwise(F.lit(0.0))
    return out | {"score": score, "verdict": F.when(score >= ACCEPT, "accept").when(score >= WARN, "warn").otherwise("reject")}


def with_plan_quality(df: DataFrame, text: str, key: list[str]) -> DataFrame:
    """key and the columns of plan_quality. Rows are dealt by key, and each step is
    a projection of its own, so that a text is cut and searched once."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.select(*key, F.coalesce(text, F.lit("")).alias("__text")).repartition(n, *key).withColumn("__parts", sentences(F.col("__text")))
    counts = _plan_counts(F.col("__text"), F.col("__parts"))
    signals = _plan_signals(**{k: F.col(f"__{k}") for k in counts})
    return cut.select(*key, *[c.alias(f"__{k}") for k, c in counts.items()]).select(*key, *[c.alias(k) for k, c in signals.items()])


def _needle(pattern: str) -> str:
    """The longest word that every match of a pattern has: one that stands in no group, class or option."""
    plain = re.sub(r"\\[a-zA-Z]|\(\?:[^)]*\)|\[[^\]]*\]", " ", pattern)
    return max(re.findall(r"[A-Za-z_]+", re.sub(r".[?*]", " ", plain)), key=len)


def count_matches(text: Column, patterns: Sequence[str]) -> Column:
    """Matches of all patterns; each is tried only where its needle occurs, as few texts have any."""
    each = (F.when(text.contains(_needle(p)), F.regexp_count(text, F.lit("(?U)" + p))).otherwise(0) for p in patterns)
    return sum(each, F.lit(0))


def id_literals(text: Column) -> Column:
    """The distinct quoted words of 6 to 40 letters, digits, hyphens and underscores."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ID_LITERAL), F.lit(1)))


def mock_ratios(tests: DataFrame, seeds: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """How much a test file leans on mocks: key, intercepts, mocks, guests,
    mean, peak, mocked, authenticity.

    intercepts: share of intercepted routes that are wildcards answered by a
    stub; mocks: share of mocking calls among these and calls of real clients;
    guests: share of id literals that no seed file (seeds: text) has. A ratio
    with nothing to count is 0, and so are guests where no seed has an id.
    Mocked: a mean of 0.4 and a peak of 0.6 at least. Null texts count as empty;
    keys are unique.
    """
    of = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<string>")
    routes, answers = (F.when(of.contains("cy.intercept"), F.regexp_extract_all(of, F.lit(INTERCEPT), F.lit(k))).otherwise(none) for k in (1, 2))
    wild = lambda r: r.contains("**") | F.regexp_replace(r, r"(?U)^\s+|\s+$", "").isin("*", "/")
    stub = lambda a: a.rlike(STUB) & ~a.contains("req.continue") & ~a.contains("passThrough")
    flagged = F.size(F.filter(F.zip_with(routes, answers, lambda r, a: wild(r) & stub(a)), lambda x: x))
    share = lambda a, b: F.when(b > 0, a / F.greatest(b, F.lit(1))).otherwise(F.lit(0.0))
    rows = tests.select(F.col(key), share(flagged, F.size(routes)).alias("intercepts"), count_matches(of, MOCK_CALLS).alias("__m"), count_matches(of, CLIENT_CALLS).alias("__r"), id_literals(F.col(text)).alias("__ids"))
    known = seeds.select(F.explode(id_literals(F.col(text))).alias("id")).distinct()
    any_seed = known.limit(1).agg(F.count(F.lit(1)).alias("__any"))  # a row
    met = rows.select(key, F.explode("__ids").alias("id")).join(known, "id", "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("__met"))
    rows = rows.join(met, key, "left").crossJoin(F.broadcast(any_seed))
    n = F.size("__ids")
    guests = F.when((n > 0) & (F.col("__any") > 0), 1 - F.coalesce("__met", F.lit(0)) / F.greatest(n, F.lit(1))).otherwise(F.lit(0.0))
    rows = rows.select(key, "intercepts", share(F.col("__m"), F.col("__m") + F.col("__r")).alias("mocks"), guests.alias("guests"))
    mean = (F.col("intercepts") + F.col("mocks") + F.col("guests")) / 3
    rows = rows.withColumn("mean", mean).withColumn("peak", F.greatest("intercepts", "mocks", "guests"))
    return rows.withColumn("mocked", (F.col("mean") >= MOCK_MEAN) & (F.col("peak") >= MOCK_PEAK)).withColumn("authenticity", 1 - F.col("mean"))


def duplicate_definitions(new: DataFrame, old: DataFrame) -> DataFrame:
    """Definitions of `new` (name, body) that share name or body with `old`'s, less as many as `old` already repeats."""
    by_name = new.join(old.select("name").distinct(), "name", "left_semi").select("name", "body")
    by_body = new.join(old.select("body").distinct(), "body", "left_semi").select("name", "body")
    either = by_name.unionByName(by_body).distinct()
    every = new.join(either, ["name", "body"], "left_semi").select("name", "body")
    return every.exceptAll(old.select("name", "body"))


def finding_id(sites: Column) -> Column:
    """The first 12 hex digits of the SHA-256 of the sorted sites, as a JSON list with ', ' between."""
    joined = F.concat(F.lit('["'), F.array_join(F.array_sort(sites), '", "'), F.lit('"]'))
    return F.substring(F.sha2(joined, 256), 1, 12)


def duplicate_verdict(n_sites: Column, n_tokens: Column, covered: Column) -> Column:
    """extract with enough sites, enough logic and a test that covers it, else note."""
    return F.when(F.coalesce((n_sites >= SITES) & (n_tokens >= TOKENS) & covered, F.lit(False)), "extract").otherwise("note")


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def plan_claims(plan: Column, most: int = 8) -> Column:
    """The first bullets of 20 to 500 characters."""
    found = F.transform(F.regexp_extract_all(F.coalesce(plan, F.lit("")), F.lit(r"(?m)^[ \t]*[-*+]\s+(.+)$"), F.lit(1)), _bare)
    return F.slice(F.filter(found, lambda x: F.length(x).between(20, 500)), 1, most)


def step_claims(plan: Column) -> Column:
    """Bullets and numbered items of over 4 characters, the first 300 of each."""
    found = F.transform(text_lines(plan), lambda x: _bare(F.regexp_extract(x, r"^\s*(?:[-*]|\d+[.)])\s+(.+?)\s*$", 1)))
    return F.transform(F.filter(found, lambda x: F.length(x) > 4), lambda x: F.substring(x, 1, 300))


def commit_claims(body: Column) -> Column:
    """Of a commit's body the bullets, and the lines that are sentences, without
    their file's name, of 20 to 400 characters, the first 200 of each; footers
    and trivial remarks are left out."""
    lines = F.filter(text_lines(body), lambda x: x.rlike(r"\S") & ~x.rlike(r"(?i)^\s*(?:co-authored-by|signed-off-by|reviewed-by):"))
    bullet = r"^\s*[-*]\s+(.+)$"
    right = lambda x: F.regexp_replace(x, r"\s+$", "")
    sentence = lambda x: _bare(x).endswith(".") & ~_bare(x).startswith("#")
    found = F.transform(lines, lambda x: F.when(right(x).rlike(bullet), _bare(F.regexp_extract(right(x), bullet, 1))).when(sentence(x), _bare(x)))
    clean = lambda x: _bare(F.regexp_replace(F.regexp_replace(x, r"^[\w./\-]+\.(?:py|js|ts|md|json|yaml|sh)\s+[—:-]\s+", ""), r"^[-*•· ]+", ""))
    kept = F.filter(F.transform(F.filter(found, lambda x: x.isNotNull()), clean), lambda x: F.length(x).between(20, 400) & ~x.rlike(r"(?i)^(?:chore|typo|lint|format|whitespace|nit)\b"))
    return F.transform(kept, lambda x: F.substring(x, 1, 200))


def commit_flags(message: Column) -> dict[str, Column]:
    """What a commit's message says that it is: amend, revert and fix by its
    beginning; reverts: the hash that it takes back, or null; keywords anywhere."""
    low = F.regexp_replace(F.lower(F.coalesce(message, F.lit(""))), r"(?U)^\s+", "")
    target = F.regexp_extract(F.coalesce(message, F.lit("")), r"This reverts commit ([0-9a-f]{7,40})", 1)
    return {
        "amend": low.rlike(r"^(?:amend|fixup|squash)"),
        "revert": low.startswith("revert"),
        "fix": low.rlike(r"^:*(?:[ 🐛✨🔧📝⚡]\s*)*(?:fix:|fix\(|bug:|bug\(|hotfix:)"),
        "reverts": F.nullif(target, F.lit("")),
        "fix_keyword": low.rlike(r"\b(?:fix|revert|hotfix|patch)\b"),
        "test_keyword": low.rlike(r"\b(?:test|spec)\b"),
        "refactor_keyword": low.rlike(r"\b(?:refactor|cleanup)\b"),
    }


def verification_kind(command: Column) -> Column:
    """What a shell command checks; the first that fits, null for none."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(CHECKS.items()):
        kind = F.when(command.rlike(pattern), name).otherwise(kind)
    return kind


def most_similar(a: DataFrame, b: DataFrame) -> DataFrame:
    """Overlap of two id sets: ids that both have."""
    return a.join(b, a.columns, "left_semi").distinct()


def first_wins(sources: list[DataFrame], key: str) -> DataFrame:
    """Union in which, of rows with one key, that of the first source stays (of one source, the least)."""
    all_ = None
    for i, s in enumerate(sources):
        s = s.withColumn("source_rank", F.lit(i))
        all_ = s if all_ is None else all_.unionByName(s, allowMissingColumns=True)
    rest = [c for c in all_.columns if c not in (key, "source_rank")]
    w = W.partitionBy(key).orderBy("source_rank", *rest)
    return all_.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def closest_symbols(names: DataFrame, symbols: DataFrame, most: int = 3, cutoff: float = 0.6, block: int = 2_000) -> DataFrame:
    """name, symbol, ratio, rank: for each distinct name its nearest symbols by
    the standard library's ratio, `cutoff` at least, the greater symbol first
    where ratios are equal. names: name; symbols: symbol.

    The names are a stated query set: both sides are dealt to blocks of `block`
    rows, and every pair of blocks meets in one task. There the ratio is
    computed only where the letters that two words share leave it a chance.
    """
    import difflib
    from collections import Counter

    asked, known = names.select("name").where("name <> ''").distinct(), symbols.select("symbol").where("symbol is not null").distinct()
    down, across = (max(1, -(-df.count() // block)) for df in (asked, known))
    spread = lambda df, key, own, n, other, m: df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        letters = {x: Counter(x) for x in right["symbol"]}
        out = []
        for name in left["name"]:
            own, found = Counter(name), []
            matcher = difflib.SequenceMatcher()
            matcher.set_seq2(name)
            for symbol, theirs in letters.items():
                most_shared = 2 * min(len(name), len(symbol)) >= cutoff * (len(name) + len(symbol))
                if most_shared and 2 * (own & theirs).total() >= cutoff * (len(name) + len(symbol)):
                    matcher.set_seq1(symbol)
                    ratio = matcher.ratio()
                    if ratio >= cutoff:
                        found.append((ratio, symbol))
            out += [(name, symbol, ratio) for ratio, symbol in sorted(found, reverse=True)[:most]]
        return pd.DataFrame(out, columns=["name", "symbol", "ratio"])

    left, right = spread(asked, "name", "__n", down, "__s", across), spread(known, "symbol", "__s", across, "__n", down)
    best = left.groupBy("__n", "__s").cogroup(right.groupBy("__n", "__s")).applyInPandas(run, "name string, symbol string, ratio double")
    w = W.partitionBy("name").orderBy(F.desc("ratio"), F.desc("symbol"))
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def unresolved_imports(imports: DataFrame, symbols: DataFrame, most: int = 3) -> DataFrame:
    """file, name and suggestions (array, nearest first) of each imported name that no symbol has."""
    missing = imports.join(symbols.select(F.col("symbol").alias("name")).distinct(), "name", "left_anti").select("file", "name").distinct()
    near = closest_symbols(missing, symbols, most).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("rank", "symbol"))).alias("found"))
    return missing.join(near.select("name", F.transform("found", lambda x: x["symbol"]).alias("suggestions")), "name", "left").select("file", "name", F.coalesce("suggestions", F.array().cast("array<string>")).alias("suggestions"))


def ranked_duplicates(pairs: DataFrame, queries: DataFrame, functions: DataFrame, confirm: float = 0.97) -> DataFrame:
    """qid, id, n_shared, logic_ratio, cosine, rank: of the pairs that a search by
    cosine gave, those whose logic agrees, most rare tokens in common first, then
    by logic, then by cosine; equals in index order.

    pairs: qid, id, cosine; queries: qid, tokens; functions: id, path, line, tokens.
    Rare is what few functions have (rare_cutoff).
    """
    from ledgerline.functions.code import sequence_ratio_udf

    df = document_frequency(functions, "id", "tokens")
    n = functions.agg(F.count(F.lit(1)).alias("__n"))  # one row
    rare = df.crossJoin(F.broadcast(n)).where(F.col("df") <= rare_cutoff(F.col("__n"))).select("token")
    own = lambda rows, key: rows.select(key, F.explode(F.array_distinct("tokens")).alias("token")).join(rare, "token").groupBy(key).agg(F.collect_list("token").alias("rare"))
    single = lambda: F.size(F.array_distinct("tokens")) == F.size("tokens")
    side = lambda rows, key, to, *more: rows.select(key, *more, F.col("tokens").alias(to), single().alias(f"{to}_once")).join(own(rows, key).withColumnRenamed("rare", f"{to}_rare"), key, "left")
    both = pairs.join(side(queries, "qid", "__q"), "qid").join(side(functions, "id", "__t", "path", "line"), "id")
    # in sequences of one length without repeats, where what differs on one side isn't on the other, the
    # matcher's blocks hold each place that is equal; it sees the other pairs itself
    differ = F.filter(F.zip_with("__q", "__t", lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda z: ~z["x"].eqNullSafe(z["y"]))
    told = both.withColumn("__differ", F.when(F.col("__q_once") & F.col("__t_once") & (F.size("__q") == F.size("__t")), differ))
    told = told.withColumn("__known", F.coalesce(F.size(F.array_intersect("__differ.x", "__differ.y")) == 0, F.lit(False)))
    left = lambda c: F.when(F.col("__known"), F.array().cast("array<string>")).otherwise(F.col(c))
    size = F.size("__q")
    matched = F.when(size > 0, 2.0 * (size - F.size("__differ")) / (2 * size)).otherwise(1.0)
    ratio = F.when(F.col("__known"), matched).otherwise(sequence_ratio_udf(left("__q"), left("__t")))
    # a filter would be pushed below the columns above and take them, and the matcher, twice
    hits = told.withColumn("__ratio", ratio).withColumn("logic_ratio", F.explode(F.when(F.col("__ratio") >= confirm, F.array("__ratio"))))
    out = hits.withColumn("n_shared", F.coalesce(F.size(F.array_intersect("__q_rare", "__t_rare")), F.lit(0)).cast("long"))
    w = W.partitionBy("qid").orderBy(F.desc("n_shared"), F.desc("logic_ratio"), F.desc("cosine"), "path", "line", "id")
    return out.select("qid", "id", "n_shared", "logic_ratio", "cosine", F.row_number().over(w).alias("rank"))
