"""Paths against globs and path contracts, as column expressions."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: what the pieces of a recursive glob stand for: ** crosses path parts, * and ? stay within one
DEEP = {"/**": "(?:/.*)?", "**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}


def normalised_path(path: Column) -> Column:
    """Without empty and `.` parts, each `..` taken off with the part before it;
    an empty path is `.`, null stays null."""
    absolute = F.startswith(path, F.lit("/"))

    def fold(done: Column, part: Column) -> Column:
        last = F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(""))
        stays = (part != "..") | (last == "..") | ((F.size(done) == 0) & ~absolute)
        return F.when(part.isin("", "."), done).when(stays, F.concat(done, F.array(part))).otherwise(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), fold)
    root = F.when(path.rlike("^//(?!/)"), "//").when(absolute, "/").otherwise("")
    return F.concat(root, F.when((F.size(parts) == 0) & (root == ""), ".").otherwise(F.array_join(parts, "/")))


def flat_glob(glob: str) -> str:
    """The body of a regular expression in which * and ? cross path parts, as a file name's glob has it."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            inner = glob[i + 1 : end]
            negated = inner.startswith("!")
            inner = inner[negated:].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out, i = f"{out}[{'^' * negated}{inner}]", end + 1
            continue
        out, i = out + {"*": ".*", "?": "."}.get(c, re.escape(c)), i + 1
    return out


def path_glob(glob: str) -> str:
    """A regular expression for normalised paths. Without ** the glob is a file
    name's, for the whole path or, of absolute paths and a relative glob, for
    what follows one of its slashes. With ** it may begin at any part."""
    glob = posixpath.normpath(glob)
    same, rooted = re.escape(glob), glob.startswith("/")
    if "**" in glob:
        body = re.sub(r"/\*\*|\*\*/|\*\*|\*|\?|[^/*?]+|/", lambda m: DEEP.get(m[0]) or re.escape(m[0]), glob)
        return f"^{same}$|(?:^|/){body}$"
    either = f"(?:{same}|(?s:{flat_glob(glob)}))$"
    return f"^{either}" if rooted else f"^(?:/(?s:.*/)?)?{either}"


def matches_path(path: Column, globs: list[str], normal: bool = False) -> Column:
    """Whether a path fits one of the globs; `normal` says that it is normalised already."""
    if not globs:
        return F.lit(False)
    told = path if normal else normalised_path(path)
    return told.rlike("(?d)" + "|".join(f"(?:{path_glob(g)})" for g in globs))


def check_contract(
    edits: DataFrame, forbidden: list[str] = (), allowed: list[str] = (), phase_forbidden: list[str] = (), phase_allowed: list[str] = (), from_plan: bool = False
) -> DataFrame:
    """edit_id, verdict of a contract over edits' paths: ok, or the first rule that stops it.

    forbidden_path, then phase_forbidden_path (neither of a contract that was
    read from a plan); where the active phase has paths of its own they alone
    decide, phase_scope; else the contract's allowed_paths; a plan without any
    allows nothing, empty_plan. A contract without rules stops nothing.
    """
    # two names for one expression, so that a path is normalised once
    rows = edits.select("edit_id", normalised_path(F.col("path")).alias("path"))
    fits = lambda globs: matches_path(F.col("path"), list(globs), normal=True)
    verdict = F.when(F.lit(not from_plan) & fits(forbidden), "forbidden_path").when(F.lit(not from_plan) & fits(phase_forbidden), "phase_forbidden_path")
    if phase_allowed:
        verdict = verdict.when(~fits(phase_allowed), "phase_scope")
    elif allowed:
        verdict = verdict.when(~fits(allowed), "allowed_paths")
    elif from_plan:
        verdict = verdict.when(F.lit(True), "empty_plan")
    return rows.select("edit_id", verdict.otherwise("ok").alias("verdict"))
