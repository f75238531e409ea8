"""Screens over rows of evidence, patches, prompts and plans, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.decisions import count_where

#: line ends as Python's splitlines knows them
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: How the project and session of a made-up event look
FAKE_ROOT, TEST_FOLDERS, CANARY = "/fake/", ("/pytest-of-", "/pytest-"), "rc-doctor-canary-"
#: Most files of a patch, endings that it may not hold, how its difficulty reads
MOST_FILES, OTHER_ENDINGS, EASY = 5, (".c\n", ".rs\n", ".go\n"), ("<15", "15 min")
#: Verbs that ask for a change; tools that belong to another language than the declared one
MUTATION = r"(?i)\b(?:implement|edit|edits?|writ(?:e|es|ing)|modif(?:y|ies|ying)|refactor(?:ing|s)?|creat(?:e|es|ing)|delet(?:e|es|ing)|patch(?:es|ing)?)\b"
FOREIGN = {
    "csharp": r"\b(?:pip install|requirements\.txt|pytest|import unittest|venv|virtualenv)\b",
    "python": r"\b(?:dotnet (?:add|new|build)|nuget)\b",
    "javascript": r"\b(?:pip install|requirements\.txt|venv)\b",
}
FOREIGN_ALLOWED = "[rc:allow-foreign-lang]"
#: How a plan names files, with and without an estimate; names that need no ending; its budgets, phases and boundary prose
_PATH = r"[A-Za-z0-9_./\-]+\.[A-Za-z0-9]{1,8}"
FILE_LINE = rf"(?i)[\-*+]\s*`?({_PATH})`?.*?~?\s*(\d{{2,5}})\s*(?:LOC|lines?|locs?)"
QUOTED_PATH, LINE_REF = rf"`({_PATH})`", rf"`?({_PATH}):\d+`?"
BARE_NAMES = (
    "Dockerfile", "Dockerfile.dev", "Dockerfile.prod", "Dockerfile.test", "Makefile", "GNUmakefile", "Makefile.am", "Makefile.in", "Rakefile", "Gemfile", "Gemfile.lock",
    "Vagrantfile", "Procfile", "Brewfile", "SConstruct", "Sakefile", "setup.py", "setup.cfg", "conftest.py", "manage.py", "fabfile.py", "LICENSE", "LICENSE.md", "LICENSE.txt",
    "README", "README.md", "README.txt", "CHANGELOG", "CHANGELOG.md", "AUTHORS", "CONTRIBUTORS", "NOTICE", "COPYING", "package.json", "tsconfig.json", "pnpm-workspace.yaml",
)
DOT_FILES = (
    ".dockerignore", ".gitattributes", ".gitmodules", ".gitignore", ".env.example", ".env.local", ".env.sample", ".envrc", ".env", ".eslintrc.js", ".eslintrc.json",
    ".eslintrc.yaml", ".eslintrc.yml", ".eslintrc", ".prettierrc.js", ".prettierrc.json", ".prettierrc.yaml", ".prettierrc.yml", ".prettierrc", ".babelrc", ".babelrc.js",
    ".babelrc.json", ".editorconfig", ".npmrc", ".yarnrc", ".yarnrc.yml", ".nvmrc", ".node-version", ".tool-versions", ".flake8", ".pylintrc", ".ruff.toml", ".python-version",
)
BUDGET, TEST_BUDGET, BLOCK_BUDGET = 400, 200, 1200
PHASE = r"(?im)^#{1,6}\s+(?:Phase|Step)\b"
BOUNDARY = (r"(?i)\b(?:across|spanning?|covers?\s+both|crossing)\b", r"(?i)\bin\s+one\s+(?:test|file)\b", r"(?i)\bsingle\s+(?:test|file)\s+that\b")


def any_of(tests: Sequence[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def text_lines(text: Column) -> Column:
    """The lines, as Python's splitlines gives them: no empty one after a last line end; none of a null."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def is_synthetic(project: Column, session: Column) -> Column:
    """Whether an event comes from a test's or a canary's folder; null fields count as empty."""
    project, session = F.coalesce(project, F.lit("")), F.coalesce(session, F.lit(""))
    parts = F.split(project, "/")
    return project.startswith(FAKE_ROOT) | any_of([project.contains(x) for x in TEST_FOLDERS]) | F.exists(parts, lambda x: x.startswith(CANARY)) | session.startswith(CANARY)


def patch_files(patch: Column) -> Column:
    """The header lines of a patch's files."""
    return F.filter(text_lines(patch), lambda x: x.startswith("diff --git"))


def eligible_patch(repo: Column, patch: Column, difficulty: Column, excluded: Sequence[str] = ()) -> Column:
    """Whether a task fits the corpus: a repository that is not excluded, a patch of
    one to MOST_FILES Python files that ends no line with another language's
    ending, and an easy task. Null and empty patches don't."""
    heads = patch_files(patch)
    words = lambda x: F.split(F.trim(x), r"\s+")
    python = (F.size(heads) > 0) & F.forall(heads, lambda x: (F.size(words(x)) >= 4) & F.element_at(words(x), -1).endswith(".py"))
    low = F.lower(F.coalesce(patch, F.lit("")))
    easy = any_of([F.lower(F.coalesce(difficulty, F.lit(""))).contains(x) for x in EASY])
    known = ~F.coalesce(repo, F.lit("")).isin(*excluded) if excluded else F.lit(True)
    return known & python & (F.size(heads) <= MOST_FILES) & ~any_of([low.contains(x) for x in OTHER_ENDINGS]) & easy


def test_files(patch: Column) -> Column:
    return F.size(F.filter(patch_files(patch), lambda x: x.contains("/test") | x.contains("tests/")))


def replayable(before: Column, after: Column, tokens: Column, diff: Column) -> dict[str, Column]:
    """What of an event can be replayed: a pair of sources, a token stream, a diff; and whether any can."""
    full = lambda x: F.coalesce(x != "", F.lit(False))
    has = {"has_source_pair": full(before) & full(after), "has_token_stream": F.coalesce(F.size(tokens) > 0, F.lit(False)), "has_diff_hunk": full(diff)}
    return has | {"is_replayable": any_of(list(has.values()))}


def hunk_sides(hunk: Column) -> tuple[Column, Column]:
    """The texts before and after a hunk: file and place lines left out, context in both."""
    body = F.filter(text_lines(hunk), lambda x: ~(x.startswith("+++") | x.startswith("---") | x.startswith("@@")))
    rest = lambda x: F.substring(x, F.lit(2), F.length(x))

    def side(own: str, other: str) -> Column:
        kept = F.filter(body, lambda x: ~x.startswith(other))
        return F.array_join(F.transform(kept, lambda x: F.when(x.startswith(own) | x.startswith(" "), rest(x)).otherwise(x)), "\n")

    return side("-", "+"), side("+", "-")


def qualification(
    failed: Column, offered: Column, attempted: Column, hooked: Column, targeted: Column, protected: Column, denied: Column, escaped: Column, changed: Column, errors: Column
) -> Column:
    """What one attempt says about a host's enforcement; the first that holds.
    failed: timed out or ended badly; hooked, targeted: the hook ran, on the
    file in question; denied: the gate said no; escaped, changed: what was
    forbidden was written, or the file is another one now."""
    effect = escaped | changed
    return (
        F.when(failed, "host_execution_failed")
        .when(~offered, "tool_unavailable")
        .when(~attempted & ~hooked, "tool_not_attempted")
        .when(~hooked, "hook_not_invoked")
        .when(~targeted, "hook_payload_mismatch")
        .when(protected & denied & ~effect, "pass")
        .when(protected & denied, "deny_ignored")
        .when(protected & effect, "gate_failed_to_deny")
        .when(~protected & ~denied & changed & ~escaped, "pass")
        .when(~protected & denied, "gate_false_block")
        .when(errors, "tool_result_error")
        .otherwise("no_effect")
    )


def screen_prompt(prompt: Column, guarded: Sequence[str], declared: Column | None = None, override: bool = False, shadow: bool = False) -> dict[str, Column]:
    """verbs, guarded_paths (arrays, in order of first place and of the list),
    decision (allowed, advisory, blocked, shadow_blocked) and reason.

    declared: the session's language where it is locked; tools of another one
    block, unless the prompt allows them. override: guarded paths only warn.
    """
    text = F.coalesce(prompt, F.lit(""))
    verbs = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(MUTATION), F.lit(0)), F.lower))
    paths = F.filter(F.array(*[F.when(text.contains(p), F.lit(p)) for p in dict.fromkeys(guarded)]), lambda x: x.isNotNull()) if guarded else F.array().cast("array<string>")
    pivot = F.lit(False)
    if declared is not None:
        pivot = F.coalesce(any_of([(declared == k) & text.rlike(p) for k, p in FOREIGN.items()]), F.lit(False)) & ~text.contains(FOREIGN_ALLOWED)
    no_verb, on_guard = F.size(verbs) == 0, F.size(paths) > 0
    decision = F.when(pivot, "shadow_blocked" if shadow else "blocked").when(no_verb, "allowed").when(on_guard & F.lit(not override), "blocked").otherwise("advisory")
    reason = (
        F.when(pivot, F.concat(F.lit("language_pivot_in_subagent:"), declared if declared is not None else F.lit(""), F.lit("->foreign")))
        .when(no_verb, "no_mutation_verb")
        .when(on_guard, "override" if override else "mutation_verb_on_guarded_path")
        .otherwise("mutation_verb_outside_guarded_paths")
    )
    return {"verbs": verbs, "guarded_paths": paths, "decision": decision, "reason": reason}


def file_verdicts(outcomes: DataFrame, key: str) -> DataFrame:
    """Per file whether a regression was found, and why: the first block, else
    the first warning, else that all checks passed. outcomes: key, place, action
    (exit_block, stderr_only, ...), reason, source."""
    rank = F.when(F.col("action") == "exit_block", 0).when(F.col("action") == "stderr_only", 1).otherwise(2)
    first = F.min(F.struct(rank.alias("rank"), "place", "reason", "source")).alias("f")
    told = F.col("f.rank") < 2
    return outcomes.groupBy(key).agg(first).select(
        key, (F.col("f.rank") == 0).alias("regression"), F.when(told, F.col("f.reason")).otherwise("symbolic_checks_passed").alias("reason"), F.when(told, F.col("f.source")).alias("source")
    )


def _whole(names: Sequence[str]) -> str:
    """Longest names first, with a folder before them, not within a longer word."""
    each = "|".join(r"(?:[A-Za-z0-9_.\-]+/)?" + n.replace(".", r"\.").replace("-", r"\-") for n in names)
    return rf"(?<![A-Za-z0-9_.\-])({each})(?![A-Za-z0-9_.\-])"


def estimates(plan: Column) -> Column:
    """Array of (path, loc) of the plan's bulleted lines that estimate a file's size."""
    text = F.coalesce(plan, F.lit(""))
    path, loc = (F.regexp_extract_all(text, F.lit(FILE_LINE), F.lit(k)) for k in (1, 2))
    return F.zip_with(path, loc, lambda p, n: F.struct(p.alias("path"), n.cast("int").alias("loc")))


def plan_paths(plan: Column) -> Column:
    """The distinct paths that a plan names, sorted."""
    text = F.coalesce(plan, F.lit(""))
    found = [F.transform(estimates(plan), lambda x: x["path"])]
    found += [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (QUOTED_PATH, LINE_REF, _whole(BARE_NAMES), _whole(sorted(DOT_FILES, key=len, reverse=True)))]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*found))))


def is_test_path(path: Column) -> Column:
    base = F.lower(F.element_at(F.split(path, "/"), -1))
    return base.contains("test_") | any_of([base.endswith(x) for x in ("_test.py", ".spec.ts", ".spec.js", ".cy.ts", ".cy.js")]) | path.contains("/tests/") | path.contains("/__tests__/")


def plan_findings(plan: Column) -> dict[str, Column]:
    """n_paths, n_phases; over_block, over_budget: files whose estimate is above
    the blocking budget, or above their own; thin: more phases than files;
    boundary: prose of a scope that crosses boundaries."""
    text, sizes, paths = F.coalesce(plan, F.lit("")), estimates(plan), plan_paths(plan)
    phases = F.regexp_count(text, F.lit(PHASE))
    own = lambda x: F.when(is_test_path(x["path"]), TEST_BUDGET).otherwise(BUDGET)
    return {
        "n_paths": F.size(paths),
        "n_phases": phases,
        "over_block": F.size(F.filter(sizes, lambda x: x["loc"] > BLOCK_BUDGET)),
        "over_budget": F.size(F.filter(sizes, lambda x: (x["loc"] <= BLOCK_BUDGET) & (x["loc"] > own(x)))),
        "thin": (phases > 0) & (F.size(paths) > 0) & (phases > F.size(paths)),
        "boundary": any_of([text.rlike(p) for p in BOUNDARY]),
    }


def first_functions(functions: DataFrame, order: Sequence[str], most: int = 5_000) -> DataFrame:
    """The index's cap: the first functions in path order."""
    return functions.orderBy(*order).limit(most)


def share_of(key: Column, seed: str) -> Column:
    """A number in [0, 1) that key and seed decide."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(seed)).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def prompted(rows: DataFrame, key: str, seed: str, rate: float = 0.05) -> DataFrame:
    """The rows whose labeller is asked: a share of them that the seed decides."""
    return rows.where(share_of(F.col(key), seed) < rate)


def picked(rows: DataFrame, key: str, seed: str) -> DataFrame:
    """One row, any of them with like chance; none of an empty table."""
    return rows.orderBy(share_of(F.col(key), seed), key).limit(1)


def agreement(pairs: DataFrame, category: str, judges: Sequence[str], label: str, majority: Column) -> DataFrame:
    """Per category and overall (null): n, unreachable (no judge answered),
    no_majority, total (a majority), agree (with the label), disagree, rate."""
    answered = any_of([F.col(j).isNotNull() for j in judges])
    total = answered & majority.isNotNull()
    same = F.coalesce(majority == F.col(label), F.lit(False))
    got = pairs.rollup(category).agg(
        F.count(F.lit(1)).alias("n"),
        count_where(~answered).alias("unreachable"),
        count_where(answered & majority.isNull()).alias("no_majority"),
        count_where(total).alias("total"),
        count_where(total & same).alias("agree"),
        count_where(total & ~same).alias("disagree"),
    )
    return got.withColumn("rate", F.try_divide(F.col("agree"), F.nullif("total", F.lit(0))))


def behaviour_clusters(rows: DataFrame, behaviour: str, arm: str, escaped: str) -> DataFrame:
    """Per behaviour with as many control as treatment rows: pairs, and the escapes
    of either arm. Empty if any row has no behaviour."""
    missing = rows.agg(F.coalesce(F.bool_or(F.col(behaviour).isNull() | (F.col(behaviour) == "")), F.lit(False)).alias("__missing"))  # a row
    of = lambda a: F.col(arm) == a
    got = rows.groupBy(behaviour).agg(
        count_where(of("control")).alias("pairs"), count_where(of("treatment")).alias("__t"),
        count_where(of("control") & F.col(escaped)).alias("control_escapes"), count_where(of("treatment") & F.col(escaped)).alias("treatment_escapes"),
    )
    return got.where("pairs = __t").drop("__t").crossJoin(F.broadcast(missing)).where("not __missing").drop("__missing")
