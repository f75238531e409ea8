"""The queries without SQL, and the pipeline, against brute force over the smallest tables, whole."""

import os

import pytest
from test_text_operators import brute_linked, check_packing, lower

from ledgerline.llm import license_scan, oracles, packing, queries, simhash

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def docs():
    import pyarrow.parquet as pq

    return {r["doc_id"]: r for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}


def brute_components(prints):
    """Smallest id reachable: every fingerprint against every other one."""
    up = {i: i for i in prints}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_fingerprint(text):
    import re

    import xxhash

    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", lower(text))]
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_licences(spark, docs):
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in queries.op1_license_scan(spark, SF).collect():
        words = word.findall(lower(docs[r.doc_id]["text"]))
        hits = [(i, label) for p, label in license_scan.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(hits), ",".join(sorted({x for _, x in hits})))
        assert (r.first_word, r.last_word) == (min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and r.labels == ",".join(sorted(set(r.labels.split(","))))


def test_near_duplicates(spark, docs):
    prints = {i: brute_fingerprint(d["text"]) for i, d in docs.items()}
    want = {i: (f"{prints[i]:016x}", c) for i, c in brute_components(prints).items()}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op2_simhash_dedup(spark, SF).collect()} == want
    assert all(simhash.fingerprint(docs[i]["text"]) == prints[i] for i in list(docs)[:20])


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path(name))
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe(spark, docs):
    import hashlib

    import numpy as np

    t = library("byte_bpe_50k.json")
    for r in queries.op9_bpe(spark, SF).collect():
        ids = t.encode(docs[r.doc_id]["text"] or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def ids_of(texts):
    import numpy as np

    t = library(packing.FILE)
    return {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for i, x in texts.items()}


def test_packing(spark, docs):
    want = ids_of({i: d["text"] for i, d in docs.items()})
    rows = queries.op10_packing(spark, SF).collect()
    assert check_packing(rows, want) <= 2047 * 8 and sum(r.length for r in rows) == sum(len(x) // 4 for x in want.values())


def test_pipeline(spark, docs):
    """Quality by DuckDB, the smallest id of each brute-force component, secrets by brute force, ids by the library."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    kept = {i for i, k in con.execute(f"SELECT doc_id, kept FROM ({oracles.ORACLES['op4_quality_rules']})").fetchall() if k}
    first = set(brute_components({i: brute_fingerprint(docs[i]["text"]) for i in kept}).values())
    clean = {}
    for i in first:
        text, spans = docs[i]["text"] or "", [tuple(map(int, s.split(":")[1:])) for s in brute_linked(docs[i]["text"]).split(",") if s]
        out, at, marked = "", 0, False
        for a, b in sorted(spans):
            if a > at or not marked:
                out, marked = out + text[at:a] + "[REDACTED]", True
            at = max(at, b)
        clean[i] = out + text[at:]
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == first
    check_packing(rows, ids_of(clean))
    assert 0 < len(first) < len(kept) < len(docs)
