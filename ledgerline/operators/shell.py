"""Shell commands: split into words as a shell does, and screened.

A command is read by one regular expression for its tokens (words with their
quoted parts, redirections, what ends a command) and one pass over them; all of
it is column expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.paths import normalised_path

#: Endings of sources; shell constructs that write them; words that destroy; git subcommands that are let through
SOURCE_ENDINGS = r"(?:\.py|\.js|\.mjs|\.cjs|\.ts|\.tsx|\.cs|\.sql|\.sh|\.json|\.yaml|\.yml|\.md|\.markdown|\.mdx|\.toml|\.ini)"
SOURCE_WRITES = (
    rf"(?<![<>0-9&])(?:1\s*|2\s*|&\s*)?>\s*['\"]?[^|;&\s]*{SOURCE_ENDINGS}\b",
    rf">>\s*['\"]?[^|;&\s]*{SOURCE_ENDINGS}\b",
    rf"\btee\b[^|;&]*\s['\"]?[^|;&\s]*{SOURCE_ENDINGS}\b",
    rf"\bsed\b[^|;&]*-i\b[^|;&]*{SOURCE_ENDINGS}\b",
    r"(?:python3?|node)\b[^|;&]*-c\b[^|;&]*open\s*\(\s*['\"][^'\"]+['\"]\s*,\s*['\"][wa]['\"]",
    r"node\b[^|;&]*-e\b[^|;&]*write(?:FileSync|file)\s*\(",
    rf"<<\s*['\"]?\w+['\"]?[^|;&]*>\s*['\"]?[^|;&\s]*{SOURCE_ENDINGS}\b",
    rf"\b(?:cp|mv|install|rsync)\b[^|;&]+\s[^|;&\s]+{SOURCE_ENDINGS}\b",
    r"\bPath\s*\([^)]+\)\.(?:write_text|write_bytes|write_lines)\s*\(",
    r"open\s*\(\s*['\"][^'\"]+['\"]\s*,\s*mode\s*=\s*['\"][wa]['\"]",
    r"open\s*\(\s*['\"][^'\"]+['\"]\s*,\s*['\"][wa][bx]?['\"]",
    r"base64\b[^|;&]*-d\b[^|;&]*\|\s*(?:bash|sh|zsh|eval)\b",
    r"\$\(\s*echo\b[^)]*\|\s*base64\b[^)]*-d\b[^)]*\)",
)
DESTROYS = r"(?:^|[\s;&|(])(?:rm|rmdir|unlink|mv|shred|truncate|ln)\b"
GIT_ALLOWED = (
    "status", "log", "diff", "show", "branch", "rev-parse", "ls-files", "ls-tree", "blame", "describe", "grep", "help", "version", "--version",
    "stash list", "stash show", "worktree list", "add", "commit", "push", "fetch",
)
#: What is stopped wherever it stands: git behind another program, decoders that feed an interpreter
DENIED = (
    r"\benv\s+.*\bgit\b", r"\btimeout\s+\d+\s+.*\bgit\b", r"/usr/bin/git\b", r"\bsh\s+-c\s+.*\bgit\b", r"\bbash\s+-c\s+.*\bgit\b", r"\$\(.*\bgit\b", r"\$\([^)]*\bgit\b", r"`[^`]*\bgit\b",
    r"\bnode\s+-E\b",
    r"\bbase64\b[^|;&]*-[dD]\b[^|;&]*\|\s*(?:bash|sh|zsh|eval|python|python3|node|perl|ruby)\b",
    r"\bbase64\b[^|;&]*--decode\b[^|;&]*\|\s*(?:bash|sh|zsh|eval|python|python3|node|perl|ruby)\b",
    r"\bopenssl\b[^|;&]*-d\b[^|;&]*\|\s*(?:bash|sh|zsh|eval|python|python3|node)\b",
    r"\bxxd\b[^|;&]*-r\b[^|;&]*\|\s*(?:bash|sh|zsh|eval|python|python3|node)\b",
    r"\bzstd\b[^|;&]*-d\b[^|;&]*\|\s*(?:bash|sh|zsh|eval|python|python3|node)\b",
)
#: Flags that skip hooks or rewrite a remote's history
UNSAFE_FLAGS = {
    "commit": (("--no-verify",), "n"),
    "push": (("--force", "--force-with-lease", "--force-if-includes", "--delete", "--mirror", "--no-verify", "--prune"), "fd"),
}
#: Programs that run others, words of the shell before a command
WRAPPERS = ("command", "builtin", "exec", "env", "nohup", "time", "nice", "sudo", "timeout", "stdbuf", "xargs", "caffeinate", "arch")
KEYWORDS = ("if", "then", "else", "elif", "do", "while", "until", "!", "{", "(")
FED = r"(?:^|/)(?:(?:ba|z|k|da|fi)?sh|source|eval|xargs|exec|python[\d.]*|perl|ruby|node|env|\.)$"
RISKY_GIT = (
    r"(?:^|[\n;&|(`]|\$\()[ \t]*git(?:\s+-\S+(?:\s+[^-\s]\S*)?)*\s+(?:worktree|merge|branch|reset|checkout|switch|rebase|restore|clean|update-ref|symbolic-ref|tag|config|init"
    r"|filter-branch|reflog|gc|stash|am|apply|cherry-pick|revert|pull|push|commit)\b"
)
#: Programs whose operands are written or go, and those whose last one is written
OPERANDS, LAST_OPERAND = ("rm", "rmdir", "unlink", "mv", "shred", "truncate", "ln", "tee"), ("cp", "install", "rsync")
#: a commit's message that is given as a document: no command
MESSAGE = r"(?s)\A(git commit(?: -[a-zA-Z]+)* -F - <<'(\w+)')\n(?:(?!\2\n)[^\n]*\n)*\2\n?\z"
#: directories that are kept as the ones a command may stand in
MOST_DIRECTORIES = 64

TOKENS = (
    r"(?s)(?<![^\s;&|(])#[^\n]*"  # a comment
    r"|\d*[<>]&[\d-]+|\d*(?:&>>?|>>\|?|>\|?|<>|<<<|<<-?|<)"  # redirections
    r"|&&|\|\||[;|&\n()]"
    r"|(?:[^\s'\"\\;|&<>()]|\\.|'[^']*'|\"(?:\\.|[^\"\\])*\")+"  # a word
    r"|['\"]"  # a quote without an end
)
_ENDS, _WORD, _COMMAND = ("&&", "||", ";", "|", "&", "\n"), "\x1f", "\x1e"
_QUOTED = r"(?s)'([^']*)'|\"((?:\\.|[^\"\\])*)\""
_ASSIGNED = r"^[A-Za-z_][A-Za-z0-9_]*="
_WRITES_TO = r"^\d*(?:&>>?|>>?\|?|<>)$"
_REDIRECTS = r"^\d*(?:&>>?|>>?\|?|<>|<<<|<<-?|<)$"


def tokens(command: Column) -> Column:
    return F.filter(F.regexp_extract_all(command, F.lit(TOKENS), F.lit(0)), lambda t: ~F.startswith(t, F.lit("#")))


def commands(command: Column) -> Column:
    """The words of each simple command, quotes and redirections among them; brackets are left out."""
    marked = F.transform(tokens(command), lambda t: F.when(t.isin(*_ENDS), _COMMAND).otherwise(t))
    return F.transform(F.split(F.array_join(marked, _WORD), _COMMAND), lambda c: F.filter(F.split(c, _WORD), lambda w: ~w.isin("", "(", ")", "{", "}")))


def plain(word: Column) -> Column:
    """Without quotes and what they escape."""
    return F.regexp_replace(word, _QUOTED + r"|\\(.)", "$1$2$3")


def _name(word: Column) -> Column:
    return F.regexp_extract(plain(word), r"([^/]*)$", 1)


def _from(words: Column, wanted) -> Column:
    """The words from the first one that is wanted; none if there is none."""
    at = F.array_position(F.transform(words, wanted), F.lit(True)).cast("int")
    return F.when(at > 0, F.slice(words, at, F.size(words))).otherwise(F.array().cast("array<string>"))


def bare(words: Column) -> Column:
    """Without the assignments in front."""
    return _from(words, lambda w: ~w.rlike(_ASSIGNED) & (w != "!"))


def _first(words: Column) -> Column:
    return F.coalesce(F.get(words, F.lit(0)), F.lit(""))


def all_commands(command: Column) -> Column:
    """The commands, and those within what is quoted for a program that runs it."""
    own = commands(command)
    fed = F.filter(own, lambda c: F.exists(c, lambda w: plain(w).rlike(FED)))
    texts = F.flatten(F.transform(fed, lambda c: F.regexp_extract_all(F.array_join(c, " "), F.lit(_QUOTED), F.lit(0))))
    inner = F.flatten(F.transform(texts, lambda t: commands(F.substring(t, F.lit(2), F.length(t) - 2))))
    return F.concat(own, inner)


def git_commands(command: Column) -> Column:
    """The words of each git call that can be seen."""
    return F.filter(F.transform(all_commands(command), bare), lambda c: _first(c) == "git")


def subcommand(words: Column) -> Column:
    """What a git call does, in one word or a known two; empty where options
    hide it or set configuration."""
    rest = F.regexp_extract(F.array_join(words, " "), r"(?s)^git(?:\s+-C\s+\S+)*\s+(.+)$", 1)
    short = F.startswith(rest, F.lit("-")) & ~F.startswith(rest, F.lit("--"))
    rest = F.when(F.startswith(rest, F.lit("-c ")), "").when(short, F.regexp_extract(rest, r"(?s)^\S+\s+(.+)$", 1)).otherwise(rest)
    two = F.regexp_extract(rest, r"^(\S+\s+\S+)", 1)
    return F.when(two.isin(*GIT_ALLOWED), two).otherwise(F.regexp_extract(rest, r"^(\S+)", 1))


def _unsafe(words: Column, sub: Column) -> Column:
    args = F.slice(words, F.array_position(words, sub).cast("int") + 1, F.size(words))
    out = F.lit(False)
    for name, (flags, letters) in UNSAFE_FLAGS.items():
        bad = lambda a: F.regexp_extract(a, "^([^=]*)", 1).isin(*flags) | a.rlike(f"^-[^-]*[{letters}]") & ~F.startswith(a, F.lit("--"))  # noqa: B023, E731
        remote = lambda a: a.rlike("^[+:]") if name == "push" else F.lit(False)  # noqa: B023, E731
        out = out | (sub == name) & F.exists(args, lambda a: bad(a) | remote(a))  # noqa: B023  used at once
    return out


def _indirect(words: Column) -> Column:
    """git behind a wrapper, by a path or in quotes."""
    direct = _first(bare(words)) == "git"
    stripped = F.filter(bare(words), lambda w, i: ~w.rlike(_REDIRECTS) & ~F.coalesce(F.get(bare(words), i - 1).rlike(_REDIRECTS), F.lit(False)))
    passed = lambda w: plain(w).rlike(_ASSIGNED + r"|^-|^\d+$") | plain(w).isin(*WRAPPERS, *KEYWORDS)
    called = _first(_from(stripped, lambda w: ~passed(w)))
    wrapped = F.exists(F.slice(stripped, F.lit(1), F.size(stripped) - F.size(_from(stripped, lambda w: ~passed(w)))), lambda w: plain(w).isin(*WRAPPERS))
    return ~direct & ((_name(called) == "git") | wrapped & F.exists(stripped, lambda w: _name(w) == "git"))


def git_denial(command: Column) -> Column:
    """Why a command with git in it is stopped, the first reason that holds; null
    where none does: environment (GIT_ variables), unscreened (a document or an open
    quote), continued (lines, or a case block), indirect, hidden (more git than can
    be seen), alone (worktree add and merge, in company or in brackets),
    subcommand, flag."""
    message = command.rlike(MESSAGE)
    text = F.when(message, F.regexp_extract(command, MESSAGE, 1)).otherwise(command)
    told = git_commands(text)
    git, count = command.rlike(r"\bgit\b"), lambda s: F.size(F.regexp_extract_all(s, F.lit(RISKY_GIT), F.lit(0)))
    seen = F.aggregate(told, F.lit(0), lambda n, c: n + count(F.array_join(c, " ")))
    verbs = F.transform(told, subcommand)
    several = F.size(commands(text)) > 1
    worktree = F.exists(told, lambda c: F.array_join(c, " ").rlike(r"^git(?:\s+-C\s+\S+)*\s+worktree\s+add\b"))
    grouped = F.exists(verbs, lambda v: F.regexp_extract(v, r"^(\S+)", 1).isin("branch", "merge", "worktree")) & command.rlike(r"[(){}]")
    alone = several & (worktree | F.array_contains(verbs, "merge")) | grouped
    reason = (
        F.when((F.size(told) > 0) & command.rlike(r"(?:^|[\s;&|(])GIT_[A-Z_]*="), "environment")
        .when(~message & text.contains("<<") | F.exists(tokens(text), lambda t: t.isin("'", '"')), "unscreened")
        .when(command.contains("\\\n") | command.rlike(r"\bcase\b"), "continued")
        .when(F.exists(commands(text), _indirect), "indirect")
        .when(count(text) > seen, "hidden")
        .when(alone, "alone")
        .when(F.exists(verbs, lambda v: ~v.isin(*GIT_ALLOWED)), "subcommand")
        .when(F.exists(told, lambda c: _unsafe(c, F.regexp_extract(subcommand(c), r"(\S+)$", 1))), "flag")
    )
    # few commands have git in them: the others aren't taken apart
    return F.when(git, reason)


def _joined(here: Column, path: Column) -> Column:
    return F.when(path.rlike("^[/~]"), path).otherwise(F.concat(here, F.lit("/"), path))


def _written(words: Column) -> Column:
    """Operands that a command writes or takes away, and what it redirects to."""
    told = F.transform(words, plain)
    head = _name(_first(words))
    after = lambda i: F.get(words, i - 1).rlike(_WRITES_TO)
    last = lambda i: i == F.size(words) - 1
    goes = lambda w, i: (i > 0) & (head.isin(*OPERANDS) & ~F.startswith(w, F.lit("-")) | head.isin(*LAST_OPERAND) & last(i) | F.coalesce(after(i), F.lit(False)))
    given = F.filter(told, lambda w, i: (head == "dd") & F.startswith(w, F.lit("of=")))
    return F.concat(F.filter(told, goes), F.transform(given, lambda w: F.substring(w, F.lit(4), F.length(w))))


def writes_guarded(command: Column, guarded: list[str], cwd: str = "/") -> Column:
    """Whether a command writes or removes a guarded path, seen from `cwd` and from
    every directory that the command goes to on its way (a `cd` may fail); from
    the newest alone once there are MOST_DIRECTORIES of them."""
    if not guarded:
        return F.lit(False)
    # a folder is guarded itself
    paths = "|".join(re.escape(g.rstrip("/")) + ("(?:/|$)" if g.endswith("/") else "") for g in guarded)

    def hit(heres: Column, words: Column) -> Column:
        return F.exists(_written(words), lambda o: F.exists(heres, lambda h: normalised_path(_joined(h, o)).rlike(paths)))

    def step(state: Column, given: Column) -> Column:
        words = bare(given)
        to = F.when(F.size(words) > 1, plain(F.get(words, F.lit(1)))).otherwise("~")
        gone = F.transform(state["heres"], lambda h: _joined(h, to))
        heres = F.when(_first(words) != "cd", state["heres"]).when(F.size(state["heres"]) < MOST_DIRECTORIES, F.array_distinct(F.concat(state["heres"], gone))).otherwise(gone)
        return F.struct(heres.alias("heres"), (state["hit"] | (_first(words) != "cd") & hit(state["heres"], words)).alias("hit"))

    start = F.struct(F.array(F.lit(cwd)).alias("heres"), F.lit(False).alias("hit"))
    found = F.aggregate(commands(command), start, step, lambda s: s["hit"])
    return F.when(command.rlike(r">|\b(?:dd|" + "|".join([*OPERANDS, *LAST_OPERAND]) + r")\b"), found).otherwise(F.lit(False))


def screen_command(command: Column, guarded: list[str], processes: list[str] = (), denied: list[str] = (), variables: list[str] = (), cwd: str = "/") -> Column:
    """What of a shell command is stopped, the first that holds: hard_deny (DENIED,
    the caller's patterns, and variables that are unset or set in front of a
    command), git (git_denial), guarded_write (a guarded path that is written or
    removed, wherever the command stands, or that is named beside a write or a
    destructive word), process_kill, source_write; else allow. Reading guarded paths
    is allowed; null and blank commands are. What links point to isn't known."""
    text = F.trim(F.coalesce(command, F.lit("")))
    any_of = lambda patterns: text.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)
    names = "|".join(map(re.escape, variables))
    own = [rf"\bunset\s+(?:{names})\b", rf"(?:^|[\n;]|&&|\|\|)\s*(?:export\s+)?(?:{names})\s*="] if variables else []
    writes, hit = any_of(SOURCE_WRITES), any_of([re.escape(g) for g in guarded])
    kills = any_of([r"\b(?:p?kill|killall)\b[^|;&]*" + re.escape(p) for p in processes])
    return (
        F.when(any_of([*DENIED, *denied, *own]), "hard_deny")
        .when(git_denial(text).isNotNull(), "git")
        .when(writes_guarded(text, guarded, cwd) | hit & (writes | text.rlike(DESTROYS)), "guarded_write")
        .when(kills, "process_kill")
        .when(writes, "source_write")
        .otherwise("allow")
    )


def screened(rows: DataFrame, command: str, *given, **options) -> DataFrame:
    """The rows with their verdict by screen_command, whose arguments follow.
    Commands come again and again: each different one is taken apart once, in as
    many tasks as a shuffle has, and the rows meet the verdicts by their command."""
    from ledgerline.plans.scratch import written

    each = rows.select(F.coalesce(command, F.lit("")).alias("__text")).distinct().repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__text")
    told = written(each.withColumn("verdict", screen_command(F.col("__text"), *given, **options)))
    return rows.join(told, F.coalesce(command, F.lit("")) == F.col("__text")).drop("__text")
