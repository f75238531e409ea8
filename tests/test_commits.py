"""Head ranges against git itself, on random histories with merges, and by hand."""

import random
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import commits as C
from ledgerline.sources import logs

COMMITS = "project string, sha string, parents array<string>, ts long, message string, files array<string>"
HEADS = "project string, before string, after string"


def history(path, seed, n, clock):
    """A repository of n commits, written by fast-import; parents are drawn from the newest ones."""
    rng, stream = random.Random(seed), []
    for k in range(1, n + 1):
        parents = [] if k == 1 or rng.random() < 0.04 else rng.sample(range(max(1, k - 6), k), min(k - 1, rng.choice([1, 1, 1, 2, 2, 3])))
        stream += [f"commit refs/heads/b{k}", f"mark :{k}", f"committer A <a@b> {clock(k, rng)} +0000", "data 2", f"m{k % 10}"]
        stream += [f"{'from' if i == 0 else 'merge'} :{p}" for i, p in enumerate(parents)]
        stream += [f"M 100644 inline f{rng.randrange(4)}", f"data {len(str(k))}", str(k), ""]
    git(path, "init", "-q")
    subprocess.run(["git", "fast-import", "--quiet"], cwd=path, input="\n".join(stream) + "\n", text=True, check=True)


def git(path, *args):
    return subprocess.run(["git", *args], cwd=path, capture_output=True, text=True, check=True).stdout


@pytest.mark.skipif(shutil.which("git") is None, reason="no git")
@pytest.mark.parametrize(("seed", "clock"), [(2, lambda k, rng: 1_700_000_000), (3, lambda k, rng: 1_700_000_000 + rng.randrange(400_000))])
def test_ranges_are_those_of_git(spark, tmp_path, monkeypatch, seed, clock):
    """Clocks that stand still, or are anything at all."""
    monkeypatch.setattr(C, "PLACES", 3)
    repo = tmp_path / "r"
    repo.mkdir()
    history(repo, seed, 40, clock)
    export = tmp_path / "log.txt"
    export.write_text(git(repo, "log", "--all", "--name-only", f"--pretty=format:{logs.HISTORY_FORMAT}"))
    commits = logs.read_history(spark, str(export), "p")
    rows = {r.sha: r for r in commits.collect()}
    assert len(rows) == 40 and max(len(r.parents) for r in rows.values()) == 3 and all(r.project == "p" for r in rows.values())
    rng = random.Random(seed)
    shas = sorted(rows)
    pairs = {tuple(rng.sample(shas, 2)) for _ in range(40)}
    heads = spark.createDataFrame([("p", b, a) for b, a in pairs] + [("p", shas[0], shas[0]), ("p", "gone", shas[1]), ("p", None, shas[1]), ("q", shas[2], shas[3])], HEADS)
    want = {(b, a, c) for b, a in pairs for c in git(repo, "rev-list", "--ancestry-path", f"{b}..{a}").split()}
    got = [(r.before, r.after, r.sha) for r in C.commits_between(commits, heads).collect()]
    assert sorted(got) == sorted(want) and len(want) > 20
    nodes, _ = C.label_commits(commits)
    date = {r.sha: r.date for r in nodes.collect()}
    assert all(date[r.sha] > date[p] for r in rows.values() for p in r.parents)
    decisions = [(f"{b}{a}{f}", "p", b, a, f) for b, a in pairs for f in ("f0", "f1", "none", None)]
    linked = C.linked_commits(spark.createDataFrame(decisions, "decision_id string, project string, git_head_before string, git_head_after string, file_path_rel string"), commits).collect()
    assert sorted((r.decision_id, r.sha) for r in linked) == sorted((f"{b}{a}{f}", c) for b, a, c in want for f in rows[c].files if f in ("f0", "f1"))
    assert all(r.ts == rows[r.sha].ts and r.message == rows[r.sha].message and r.link_confidence == "exact_head_range" for r in linked)


def test_shallow_and_repeated_commits(spark):
    """A parent that isn't there, parents and commits that come twice, other projects with the same hashes, no commits."""
    rows = [("p", "b", ["a", "a"], 5, "", ["x"]), ("p", "c", ["b"], 4, "", ["x", "x"]), ("p", "c", ["b"], 4, "", ["x", "x"]), ("p", "d", ["c", "gone"], None, "", None), ("q", "b", [], 1, "", []), ("q", "d", None, 1, "", ["x"]), (None, "z", [], 1, "", [])]
    commits = spark.createDataFrame(rows, COMMITS)
    heads = spark.createDataFrame([("p", "b", "d"), ("q", "b", "d"), ("p", "a", "d"), ("p", "d", "b")], HEADS)
    assert sorted(tuple(r) for r in C.commits_between(commits, heads).collect()) == [("p", "b", "d", "c"), ("p", "b", "d", "d")]
    asked = spark.createDataFrame([("1", "p", "b", "d", "x"), ("1", "p", "b", "d", "x"), ("2", "p", "", "d", "x")], "decision_id string, project string, git_head_before string, git_head_after string, file_path_rel string")
    assert [tuple(r)[:2] for r in C.linked_commits(asked, commits).collect()] == [("1", "c")]
    assert C.commits_between(commits.limit(0), heads).count() == 0


def test_rounds_don_t_grow_with_paths(spark, monkeypatch):
    """A history without branches is one chain, walked in one round."""
    n = 300
    commits = spark.createDataFrame([("p", f"{k:04}", [f"{k - 1:04}"] if k else [], k, "", []) for k in range(n)], COMMITS)
    nodes, edges = C.label_commits(commits)
    assert edges.count() == 0 and [r.place for r in nodes.orderBy("sha").collect()] == list(range(n))
    rounds = []
    monkeypatch.setattr(C, "_bucket", lambda key, was=C._bucket: rounds.append(key) or was(key))
    ranges = C.head_ranges(nodes, edges, spark.createDataFrame([("p", "0003", "0290")], HEADS))
    assert [(r.lowest, r.highest) for r in ranges.collect()] == [(3, 290)]
    assert len(rounds) <= 6
    assert C._within(ranges, nodes, []).agg(F.count("*")).first()[0] == 287
