"""Declarative rules over edits: scopes, imports, patterns, bypasses."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerline.operators.paths import flat_glob
from ledgerline.operators.screens import text_lines

#: Most rules of a set, longest pattern, longest source
MOST_RULES, LONGEST_PATTERN, LONGEST_SOURCE = 50, 512, 2 << 20
#: Magic comments and the lines that are read for them; a test's path; languages by ending
DIRECTIVE = r"(?m)^[ \t]*(?:#|//|<!--)[ \t]*rc:(skip-lang|skip-mock|skip-quality|skip-framework|override|skip)\b[ \t]*([^\n]*?)(?:[ \t]*-->)?[ \t]*$"
DIRECTIVE_LINES = 20
TEST_FILE = r"(?:^|/)(?:tests?|__tests__)/|\.(?:test|spec)\.[^/]+$|(?:^|/)test_[^/]+$|_test\.[^/]+$"
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "tsx", ".cs": "csharp", ".sql": "sql",
    ".md": "markdown", ".markdown": "markdown", ".mdx": "markdown", ".json": "json", ".jsonc": "json", ".yaml": "yaml", ".yml": "yaml", ".css": "css", ".scss": "scss", ".sass": "scss",
    ".html": "html", ".htm": "html", ".vue": "html", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c++": "cpp", ".hpp": "cpp", ".hh": "cpp", ".hxx": "cpp", ".h++": "cpp", ".c": "c", ".h": "c",
}


def scope_glob(glob: str) -> str:
    """The dialect of rule scopes: * crosses path parts, and the whole path must fit."""
    return f"(?s)^{flat_glob(glob)}$"


def imports_match(name: Column, target: Column) -> Column:
    """The module itself or one below it."""
    return (name == target) | F.startswith(name, F.concat(target, F.lit(".")))


def bypassed(source: Column) -> Column:
    """Ids of the rules that comments in the source switch off, one a line."""
    found = F.transform(text_lines(source), lambda x: F.regexp_extract(x, r"(?:#|//)\s*rc:skip-rule:([A-Za-z0-9_-]+)", 1))
    # few sources have any: the others aren't split into lines
    return F.when(source.contains("rc:skip-rule:"), F.array_distinct(F.filter(found, lambda x: x != ""))).otherwise(F.array().cast("array<string>"))


def directive(source: Column) -> Column:
    """The first magic comment in the first lines: name, reason and line (from 1), all null without one."""
    head = F.array_join(F.slice(text_lines(source), 1, DIRECTIVE_LINES), "\n")
    at = F.regexp_instr(head, F.lit(DIRECTIVE))
    part = lambda k: F.when(at > 0, F.trim(F.regexp_extract(head, DIRECTIVE, k)))
    line = F.when(at > 0, F.size(F.split(F.substring(head, F.lit(1), at - 1), "\n")))
    return F.struct(part(1).alias("name"), part(2).alias("reason"), line.alias("line"))


def bypasses(found: Column, domain: str) -> Column:
    """Whether a directive switches a domain's gate off (lang, mock, quality, framework)."""
    return F.coalesce(found["name"].isin("skip", "override", f"skip-{domain}"), F.lit(False))


def position(source: Column, pattern: str) -> tuple[Column, Column]:
    """Line, from 1, and column, from 0, of a pattern's first match; null without one."""
    at = F.regexp_instr(source, F.lit(pattern))
    before = F.substring(source, F.lit(1), F.when(at > 0, at - 1))
    lines = F.split(before, "\n")
    return F.size(F.when(at > 0, lines)), F.length(F.element_at(F.when(at > 0, lines), -1))


def suffix(path: Column) -> Column:
    """The lower-cased ending with its dot; empty without one and for names that only begin with a dot."""
    return F.regexp_extract(F.lower(F.coalesce(path, F.lit(""))), r"[^/](\.[^./]*)$", 1)


def language(path: Column) -> Column:
    """By the file's ending, or its name for a Dockerfile; null where neither is known."""
    name = F.element_at(F.split(F.lower(F.coalesce(path, F.lit(""))), "/"), -1)
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.when((name == "dockerfile") | name.endswith(".dockerfile"), "dockerfile").otherwise(F.try_element_at(table, suffix(path)))


def file_kind(path: Column) -> Column:
    """Ordered: plan, test code, documents, configuration, source."""
    p = F.lower(F.coalesce(path, F.lit("")))
    return (
        F.when(p.contains("/plans/") | p.endswith(".plan.md"), "plan_md")
        .when(p.contains("/test") | p.contains("_test"), "test_code")
        .when(suffix(path).isin(".md", ".markdown", ".mdx"), "doc_md")
        .when(suffix(path).isin(".json", ".yaml", ".yml", ".toml", ".ini"), "config")
        .otherwise("source_code")
    )


def is_test(path: Column) -> Column:
    """Whether a path is a test's, for the search of duplicates (screens.is_test_path is the plan gate's)."""
    return path.rlike(TEST_FILE)


def apply_rules(edits: DataFrame, rules: list[dict]) -> DataFrame:
    """edit_id, rule_id, severity of every hit.

    edits: edit_id, path, source, imports (array). rules: at most MOST_RULES of
    id, type (forbid_import, forbid_pattern), language, scope, target or
    pattern, severity. A set of rules is small and known, so each is an
    expression and the edits are scanned once, without a join.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    skip = bypassed(F.col("source"))
    fits = F.length("source") <= LONGEST_SOURCE
    hits = []
    for r in rules:
        ok = fits & ~F.array_contains(skip, r["id"])
        if r.get("language"):
            ok = ok & F.coalesce(language(F.col("path")) == r["language"], F.lit(False))
        if r.get("scope"):
            ok = ok & F.col("path").rlike(scope_glob(r["scope"]))
        if r["type"] == "forbid_import":
            target = F.lit(r["target"])
            ok = ok & F.exists("imports", lambda x: imports_match(x, target))  # noqa: B023  used at once
        elif len(r["pattern"]) > LONGEST_PATTERN:
            raise ValueError(f"pattern of {r['id']} is too long")
        else:
            ok = ok & F.col("source").rlike(r["pattern"])
        hits.append(F.when(ok, F.struct(F.lit(r["id"]).alias("rule_id"), F.lit(r.get("severity", "warn")).alias("severity"))))
    found = F.filter(F.array(*hits), lambda h: h.isNotNull()) if hits else F.array().cast("array<struct<rule_id:string,severity:string>>")
    return edits.select("edit_id", F.inline(found))


#: From the gravest
SEVERITIES = ("deny", "block", "warn", "allow")


def gravest(outcomes: DataFrame, key: str, verdict: str) -> DataFrame:
    """Per key the gravest outcome, of equals the first by name of its gate."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col(verdict))
    w = W.partitionBy(key).orderBy(F.when(rank == 0, len(SEVERITIES) + 1).otherwise(rank), "gate")
    return outcomes.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
