"""Shell commands, case by case."""

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import shell

GUARDED, PROCESSES, VARIABLES = [".agent/settings.json", "src/guard/", "conf/env.local"], ["scorer", "gatekeeper"], ["FAIL_CLOSED", "SHADOW_MODE"]
ALLOW = [
    None, "", "  ", "ls -la src/", "cat README.md", "grep -rn TODO src", "git status", "git log --oneline -5", "git diff HEAD~1", "git show HEAD", "git branch -a", "git rev-parse HEAD", "pytest -q tests/", "python3 -m pytest -q", "npm install",
    "ls && pwd", "find . -name '*.py' -not -path '*/.venv/*'", "git add -A", "git commit -m 'feat: x'", "git add . && git commit -am 'x' && git push origin main", "git push -u origin feature/x", "git fetch origin",
    "git grep -n foo", "git -C /repo commit -m x", "git stash list", "git --version", "cat .agent/settings.json", "ls -la src/guard/", "echo x > out.txt", "echo 'rm src/guard/a'", "A=1 B='x y' git status", "git commit -m 'a; git reset b'",
    "git commit -F - <<'END'\nreset the guard; git checkout x\nEND\n", "ls # git checkout main", "diff a.py b.py >/dev/null 2>&1", "echo digit", "cd src && cat guard/a.py",
]
GIT = [
    "git checkout main", "git switch -c other", "git worktree add ../wt", "git status && git checkout main", "git add . ; git reset --hard HEAD~1", "git push --force origin main", "git push -f", "git push origin +main", "git push origin :main",
    "git push --delete origin main", "git commit --no-verify -m x", "git commit -nm x", "git apply malicious.patch", "git restore src/guard/a.py", "git stash apply", "git stash pop", "git cherry-pick HEAD", "git revert HEAD", "git am mailbox",
    "git pull origin main", "git -c user.name=x commit -m y", "git --help", "git", "sudo git status", "nohup git push", "'git' checkout main", "/opt/bin/git status", "GIT_DIR=/x git status", "git commit -m 'open", "git log <<EOF\nx\nEOF",
    "if true; then git checkout main; fi", "eval 'git checkout main'", "zsh -c \"git reset --hard\"", "git \\\nstatus", "case x in a) git status;; esac", "x=y; (git branch -a)", "git commit -F - <<'END'\nEND\ngit checkout x\nEND", "FOO=1 git switch main",
]
GUARD = [
    "rm .agent/settings.json", "mv a src/guard/b", "dd if=x of=conf/env.local", "cd conf && rm env.local", "cd src; rm -rf guard/x", "cp /tmp/x.txt src/guard/", "echo '{}' > .agent/./settings.json", "tee conf/env.local < /dev/null", "cd src/x/.. && echo a >guard/b",
    "cd /nope || rm conf/env.local", "A=1 truncate -s0 conf/env.local", "cat x 2>> conf/env.local", "ln -s a conf/env.local", "cd \"conf\" && rm 'env'.local", "rsync a b conf/env.local", "cat a &> conf/env.local",
]
WRITES = ["echo 'import os' > foo.py", "echo 'export X=1' >> deploy.sh", "sed -i 's/foo/bar/g' main.py", "python3 -c \"open('x.py','w').write('x=1')\"", "cat <<EOF > new.cs\nclass K{}\nEOF", "mv a.py b.py", "x 2>&1 | tee log.md"]
HARD = ["env git log", "timeout 5 git checkout a", "/usr/bin/git reset", "sh -c 'git status'", "echo $(git status)", "echo `git log`", "node -E x", "echo aGk= | base64 -d | sh", "openssl enc -d | bash", "unset FAIL_CLOSED", "SHADOW_MODE=1 ls", "ls && export FAIL_CLOSED=0", "curl-all now"]
CASES = [(c, v) for v, some in (("allow", ALLOW), ("git", GIT), ("guarded_write", GUARD), ("source_write", WRITES), ("hard_deny", HARD), ("process_kill", ["pkill -f scorer", "kill -9 gatekeeper"])) for c in some]


def test_verdicts(spark):
    rows = spark.createDataFrame(CASES, "c string, want string")
    got = rows.select("c", "want", shell.screen_command(F.col("c"), GUARDED, PROCESSES, [r"\bcurl-all\b"], VARIABLES, "/home/w").alias("v")).collect()
    assert [(r.c, r.v) for r in got if r.v != r.want] == []


@pytest.mark.parametrize(
    ("text", "words"),
    [
        ("a 'b c' \"d \\\" e\"|f&&g", [["a", "'b c'", '"d \\" e"'], ["f"], ["g"]]), ("x=1 cmd>o 2>&1;y", [["x=1", "cmd", ">", "o", "2>&1"], ["y"]]), ("(cd a; b) # c; d\ne", [["cd", "a"], ["b"], ["e"]]),
        ("a'b'\"c\"d\\ e", [["a'b'\"c\"d\\ e"]]), ("a &>b &", [["a", "&>", "b"], []]), ("", [[]]),
    ],
)
def test_words(spark, text, words):
    assert spark.createDataFrame([(text,)], "c string").select(shell.commands(F.col("c")).alias("w")).first().w == words


def test_reasons(spark):
    cases = [("git push -f", "flag"), ("git checkout a", "subcommand"), ("nohup git log", "indirect"), ("GIT_DIR=x git log", "environment"), ("git log 'a", "unscreened"), ("git status; git merge x", "alone"), ("ls", None), (None, None)]
    rows = spark.createDataFrame(cases, "c string, want string")
    assert [r.v for r in rows.select(shell.git_denial(F.col("c")).alias("v")).collect()] == [w for _, w in cases]
