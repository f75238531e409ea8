"""The vector cache: what is embedded again, what is written, what damage does."""

import glob
import json
import os

import pandas as pd
import pytest

from ledgerline.functions import code
from ledgerline.sources import vector_cache as V

FUNCTION = "def f{0}(x):\n    return helper{0}(x) + other(x) * {0}\n\n\n"


def embedder(calls, dim=4):
    def embed(files):
        calls.append(sorted(r.path for r in files.collect()))

        def run(frames):
            for frame in frames:
                out = [(p, i, n, line, code.logic_tokens(src), code.control_embedding(code.logic_tokens(src), dim)) for p, t in zip(frame["path"], frame["text"], strict=True) for i, (n, line, src) in enumerate(code.functions_of(t))]
                yield pd.DataFrame(out, columns=["path", "place", "name", "line", "tokens", "vec"])

        return files.mapInPandas(run, "path string, place int, name string, line int, tokens array<string>, vec array<float>")

    return embed


def contents(spark, root, name="control"):
    return sorted((r.path, r.name, r.line, tuple(r.tokens), tuple(round(x, 5) for x in r.vec)) for r in V.read_cache(spark, root, name).collect())


def expected(files):
    out = []
    for p, t in files.items():
        for n, line, src in code.functions_of(t or ""):
            tokens = code.logic_tokens(src)
            out.append((p, n, line, tuple(tokens), tuple(round(float(pd.Series([x], dtype="float32")[0]), 5) for x in code.control_embedding(tokens, 4))))
    return sorted(out)


def test_only_what_changed_is_embedded_and_written(spark, tmp_path):
    root, calls = str(tmp_path / "cache"), []
    files = {f"src/m{k}.py": FUNCTION.format(k) * (1 + k % 2) for k in range(12)} | {"empty.py": "", "none.py": None}
    frame = lambda: spark.createDataFrame([*files.items(), next(iter(files.items()))], "path string, text string")
    go = lambda: V.refresh(frame(), root, "control", embedder(calls), buckets=8)
    assert V.read_cache(spark, root, "control") is None
    first = go()
    assert (first.reused, first.embedded, first.dropped) == (0, 14, 0) and contents(spark, root) == expected(files)
    state = {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{root}/**", recursive=True)}
    assert go() == V.Refreshed(14, 0, 0, 0) and len(calls) == 1  # files without functions are remembered too
    assert {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{root}/**", recursive=True)} == state
    files["src/m3.py"] = FUNCTION.format(99)
    del files["src/m4.py"]
    files["new.py"] = FUNCTION.format(7)
    second = go()
    assert calls[1] == ["new.py", "src/m3.py"] and (second.reused, second.embedded, second.dropped) == (12, 2, 1) and second.windows <= 3
    assert contents(spark, root) == expected(files)
    # a window that is damaged, and one that is gone, are made anew; others aren't
    windows = json.loads(open(f"{root}/{V.MANIFEST}").read())["windows"]
    damaged, lost = sorted(windows)[:2]
    for part in glob.glob(f"{root}/{windows[damaged]['table']}/bucket={damaged}/*.parquet"):
        with open(part, "r+b") as f:
            f.truncate(30)
    for crc in glob.glob(f"{root}/{windows[damaged]['table']}/bucket={damaged}/.*.crc"):
        os.remove(crc)
    os.rename(f"{root}/{windows[lost]['table']}/bucket={lost}", f"{tmp_path}/away")
    assert set(contents(spark, root)) < set(expected(files))
    third = go()
    assert 0 < third.embedded < 13 and third.windows == 2 and contents(spark, root) == expected(files)
    assert V.vacuum(root, "control") >= 0 and contents(spark, root) == expected(files)


def test_other_embedders_and_manifests_are_not_taken_over(spark, tmp_path):
    root, calls = str(tmp_path / "cache"), []
    files = spark.createDataFrame([("a.py", FUNCTION.format(1)), ("b.py", FUNCTION.format(2))], "path string, text string")
    V.refresh(files, root, "control", embedder(calls), buckets=2)
    assert V.read_cache(spark, root, "better") is None
    V.refresh(files, root, "better", embedder(calls, 6), buckets=2)
    assert calls[1] == ["a.py", "b.py"] and V.read_cache(spark, root, "control") is None and {len(r.vec) for r in V.read_cache(spark, root, "better").collect()} == {6}
    more = files.unionByName(spark.createDataFrame([("c.py", FUNCTION.format(3))], "path string, text string"))
    with pytest.raises(ValueError, match="lengths"):
        V.refresh(more, root, "better", embedder(calls, 5))
    assert V.read_cache(spark, root, "better").count() == 2  # the old cache is still there
    with open(f"{root}/{V.MANIFEST}", "w") as f:
        f.write('{"windows": 3')
    assert V.load_manifest(root, "better") is None
    V.refresh(files, root, "better", embedder(calls, 6), buckets=2)
    assert V.read_cache(spark, root, "better").count() == 2 and V.vacuum(root, "better") >= 1
    assert V.refresh(files.limit(0), root, "better", embedder(calls, 6)).dropped == 2 and V.read_cache(spark, root, "better").count() == 0
