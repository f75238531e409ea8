"""Sharding, embeddings, pages, archives, the pipeline and the entry's oracles."""

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from ledgerline.llm import embedding_dedup, html_extract, sharding, warc

DOCS = "doc_id long, text string"


def test_shards_move_few_records(spark):
    docs = spark.createDataFrame([(i, "é" * (i % 7)) for i in range(3000)] + [(5, "again"), (5, "again"), (None, None)], DOCS)
    weights = [1.0] * 7 + [2.0, 0.0]
    rows = sharding.assign_shards(docs, weights).collect()
    assert len(rows) == 3003
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    n = collections.Counter(r.shard for r in rows)
    assert 8 not in n and 1.6 < n[7] / (sum(n[k] for k in range(7)) / 7) < 2.4
    assert all(r.grown_shard in (r.shard, 9) for r in rows) and 0.05 < sum(r.grown_shard == 9 for r in rows) / 3003 < 0.15
    more = {r.doc_id: r.shard for r in sharding.assign_shards(docs, [*weights, 1.0]).collect()}
    assert all(more[r.doc_id] == r.grown_shard for r in rows)
    first = next(r for r in rows if r.doc_id == 3)
    assert (first.size, first.text_crc32) == (16 + 6, zlib.crc32(("é" * 3).encode()))
    assert sharding.assign_shards(docs.limit(0), weights).count() == 0


def test_hot_ids_are_numbered_apart(spark, monkeypatch):
    """Equal rows and rows without an id, far more than a bucket holds, get slots without gaps."""
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 20)
    monkeypatch.setattr(sharding, "COPIES", 7)
    rows = [(1, "same")] * 300 + [(None, f"t{i}") for i in range(400)] + [(None, None)] * 50 + [(i, "x") for i in range(2, 200)]
    out = sharding.assign_shards(spark.createDataFrame(rows, DOCS).repartition(3), [1.0, 1.0, 1.0]).collect()
    assert collections.Counter((r.doc_id, r.text_crc32) for r in out) == collections.Counter((d, zlib.crc32((t or "").encode())) for d, t in rows)
    slots = collections.defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in out if r.doc_id is None}) == len({r.shard for r in out if r.doc_id == 1}) == 1


def test_gaps_fail_the_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "p" * 50 * i) for i in range(9)], PAGES)
    warc.write_archives(pages.coalesce(1), str(tmp_path / "a"))
    whole = warc.read_archives(spark, str(tmp_path / "a"))
    assert warc.intact(whole).count() == 9
    part = next((tmp_path / "a").glob("part-*"))
    data = bytearray(part.read_bytes())
    data[len(data) // 2] ^= 255
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.warc.gz").write_bytes(data)
    torn = warc.read_archives(spark, str(tmp_path / "b"))
    assert torn.where("kind = 'record'").count() == 8 and torn.where("kind = 'gap'").count() == 1
    with pytest.raises(Exception, match="gap in"):
        warc.intact(torn).collect()


def brute_links(vectors):
    ids = [i for i, _ in vectors]
    unit = []
    for _, v in vectors:
        bad = v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v)
        scaled = None if bad else np.array(v, float) / np.abs(np.array(v, float)).max()
        unit.append(None if bad else scaled / np.linalg.norm(scaled))
    up = list(range(len(ids)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    n = [0] * len(ids)
    for i in range(len(ids)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95:
                n[i] += 1
                n[j] += 1
                up[find(i)] = find(j)
    least = {}
    for i, k in enumerate(ids):
        least[find(i)] = min(k, least.get(find(i), k))
    return sorted((k, n[i], least[find(i)], k == least[find(i)]) for i, k in enumerate(ids))


def test_embedding_links_by_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(60):
        centre = rng.normal(size=16)
        for _ in range(rng.choice([1, 1, 2, 3])):
            rows.append((centre + 0.05 * rng.normal(size=16)).tolist())
    hot = rng.normal(size=16)
    rows += [(hot + 0.02 * rng.normal(size=16)).tolist() for _ in range(150)] + [hot.tolist()] * 40 + [(3 * hot).tolist()]
    rows += [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0, 2.0], [2.0, 4.0], [1e-300] * 16, [1e300] * 16]
    vectors = list(enumerate(rows))
    random.Random(1).shuffle(vectors)
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = embedding_dedup.near_duplicates(df).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == brute_links(vectors)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_pairs_in_a_dense_cone_are_found(spark):
    """A cone of pairwise cosine about 0.90 leaves large buckets; planted pairs at 0.955 in it are found at the promised rate."""
    rng = np.random.default_rng(1)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    axis = unit(rng.normal(size=64))
    away = rng.normal(size=(9000, 64))
    away = unit(away - np.outer(away @ axis, axis))
    cone = np.sqrt(0.90) * axis + np.sqrt(0.10) * away
    pairs = range(0, 800, 2)
    for i in pairs:
        side = rng.normal(size=64)
        side = unit(side - side @ cone[i] * cone[i])
        cone[i + 1] = 0.955 * cone[i] + np.sqrt(1 - 0.955**2) * side
    dots = cone[:800] @ cone[:800].T
    assert all(dots[i, i + 1] >= 0.95 for i in pairs)
    vectors = [(i, v.tolist()) for i, v in enumerate(cone)] + [(9000 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(3000, 64)))]
    got = {r.vec_id: r.component_id for r in embedding_dedup.near_duplicates(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == 12000
    missed = sum(got[i] != got[i + 1] for i in pairs)
    assert missed <= 4


def test_links_do_not_depend_on_partitions(spark):
    """Pairs at 0.952 are found whatever the number of shuffle partitions."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1400, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=x.shape)
    side -= x * (side * x).sum(axis=1, keepdims=True)
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    y = 0.952 * x + np.sqrt(1 - 0.952**2) * side
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))], "vec_id long, embedding array<double>")
    found = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("2", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append({r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]
    missed = sum(found[0][i][1] != found[0][1400 + i][1] for i in range(1400))
    assert missed <= 10


@pytest.mark.parametrize("pairs", [4, 0])
def test_blocks_of_a_large_component(spark, monkeypatch, pairs):
    """Small blocks throughout, and, without pairs looked at one by one, whole cells with their vectors."""
    for name, value in (("BLOCK", 16), ("SMALLEST", 8), ("PARTS", 5), ("PAIRS", pairs)):
        monkeypatch.setattr(embedding_dedup, name, value)
    rng = np.random.default_rng(6)
    hot = rng.normal(size=8)
    vectors = [(i, (hot + 0.18 * rng.normal(size=8)).tolist()) for i in range(120)] + [(200 + i, rng.normal(size=8).tolist()) for i in range(60)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"), window=16).collect()
    rounded = [(i, np.array(v, dtype=np.float32).astype(float).tolist()) for i, v in vectors]
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == brute_links(rounded)


def test_sketches_bound_the_cosine():
    rng = np.random.default_rng(3)
    for dim in (1, 2, 64, 900):
        x = rng.normal(size=(200, dim)) * rng.choice([1.0, 50.0], size=(200, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        q, scale, off = embedding_dedup.sketch(x)
        rough = (q.astype(np.float32) * scale[:, None]) @ (q.astype(np.float32) * scale[:, None]).T
        bound = off[:, None] + (1 + off[:, None]) * off[None, :] + embedding_dedup.ROUNDING
        assert (np.abs(rough - x @ x.T) <= bound).all() and bound.max() < 0.2


def test_cells_of_sketches_lose_no_link():
    """What is united at once is a link; every link is united, or among the pairs to be looked at, or too many are."""
    import pyarrow as pa

    from ledgerline.llm.common import UnionFind

    rng = np.random.default_rng(9)
    for case in range(30):
        centres = rng.normal(size=(6, 24))
        x = np.concatenate([c + (0.02 + 0.05 * (case % 6)) * rng.normal(size=(50, 24)) for c in centres])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        packed = [bytes(r) for r in np.hstack([part.reshape(len(x), -1).view(np.uint8) for part in embedding_dedup.sketch(x)])]
        width, carried = (1000, 37, 300)[case % 3], np.arange(len(x)) < (case % 2) * 40
        x, packed = (lambda order: (x[order], [packed[i] for i in order]))(rng.permutation(len(x)))
        cell = pa.RecordBatch.from_arrays([pa.array([1] * len(x)), pa.array([0] * len(x)), pa.array(np.arange(len(x))), pa.array(np.arange(len(x)) * 2 + carried), pa.array(packed, pa.binary())], ["run", "block", "place", "tag", "sketch"])
        links = UnionFind()
        found = embedding_dedup._look(cell, 0.95, links, width=width)
        dots, exact, near = x @ x.T, UnionFind(), UnionFind()
        for i in range(len(x)):
            for j in range(i):
                if dots[i, j] >= 0.95 and i - j <= width and not (carried[i] and carried[j]):
                    exact.link(i, j)
        for i, j in links.forest():
            near.link(i, j)
        assert all(exact.find(i) == exact.find(j) for i, j in links.forest())
        if found is not None:
            for i, j in zip(*found, strict=True):
                if dots[i, j] >= 0.95:
                    near.link(int(i), int(j))
            assert all((near.find(i) == near.find(j)) == (exact.find(i) == exact.find(j)) for i in range(0, len(x), 7) for j in range(len(x)))


def test_recall_on_anisotropic_vectors(spark):
    """Vectors with a mean cosine of about 0.69 and planted pairs at 0.952, all apart from each other."""
    rng = np.random.default_rng(21)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    mean = unit(rng.normal(size=64))
    x = unit(mean + 0.084 * rng.normal(size=(16_000, 64)))
    assert 0.66 < float((x[:500] @ x[:500].T).mean()) < 0.72
    side = rng.normal(size=(500, 64))
    side = unit(side - x[:500] * (side * x[:500]).sum(axis=1, keepdims=True))
    y = 0.952 * x[:500] + np.sqrt(1 - 0.952**2) * side
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
    got = {r.vec_id: r.component_id for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert sum(got[16_000 + i] == got[i] for i in range(500)) >= 495


def test_windows_are_bounded(spark, monkeypatch):
    """Each row meets the `window` rows after it in the order, across blocks and partitions, and no other."""
    rng = np.random.default_rng(8)
    mean = rng.normal(size=12)
    few = spark.createDataFrame([(i, (mean + 0.05 * rng.normal(size=12)).tolist()) for i in range(230)] + [(900 + i, [1.0, float(i)]) for i in range(30)], "rep long, vec array<double>")
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    orders = []
    try:
        for parts in ("3", "50"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            rows = embedding_dedup._in_order(few, 2, 25).collect()
            own = {(r.run, r.place): r.tag >> 1 for r in rows if not r.tag & 1}
            met, at_most = set(), 0
            for cell in {(r.run, r.block) for r in rows}:
                inside = sorted((r.place, r.tag) for r in rows if (r.run, r.block) == cell)
                assert [p for p, _ in inside] == list(range(inside[0][0], inside[0][0] + len(inside)))
                for a, b, compared in embedding_dedup._strips(np.array([t & 1 for _, t in inside], dtype=bool), 25):
                    i, j = np.nonzero(compared)
                    pairs = [(cell[0], inside[a.start + x][0], inside[b.start + y][0]) for x, y in zip(i, j, strict=True)]
                    assert not met & set(pairs)
                    met |= set(pairs)
            for run in {r.run for r in rows}:
                n = 230 if run % 2**32 == 12 else 30
                assert sorted(p for k, p in own if k == run) == list(range(n))
                at_most += sum(min(25, n - 1 - p) for p in range(n))
                assert all((run, p, q) in met for p in range(n) for q in range(p + 1, min(n, p + 26)))
            assert len(met) == at_most
            orders.append(own)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert orders[0] == orders[1] and len(orders[0]) == 520


ARTICLE = "<article><h1>Big  news</h1><p><b>First</b> line &amp; more&nbsp;text.<br>Same block<p>Second para, long enough to matter here.</article>"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>t</title><script>var x='</p><p>no'</script></head><body><nav><a href=/>Home</a></nav><div class='ad'>Buy</div>{ARTICLE}<footer>&copy; us</footer></body></html>",
        f"<body><nav><ul><li><a href=/>Home</a>{ARTICLE}<aside>side</aside><section id=comments><p>first comment, which is long and talks a lot about nothing</section>",
        f"<header>Site</header><div class=cookie-notice>We use cookies</div><main><div role=search><form><input>Find</form></div>{ARTICLE}</main><footer>end",
    ],
)
def test_article_is_found(page):
    assert html_extract.main_text(page) == "Big news\nFirst line & more text. Same block\nSecond para, long enough to matter here."


def test_text_beside_one_article_is_kept():
    """Sibling articles are all kept, and a teaser article doesn't exclude the text beside it."""
    part = lambda k: "".join(f"<p>Part {k} sentence {i} tells at some length what happened next.</p>" for i in range(6))
    several = html_extract.main_text("<body>" + "".join(f"<article>{part(k)}</article>" for k in range(3)) + "</body>")
    assert all(f"Part {k} sentence {i} " in several for k in range(3) for i in range(6))
    teaser = "<article><p>A teaser of another story, which is rather a long one by itself, to be read later.</p></article>"
    for body, first in ((f"<main>{part(0)}{part(1)}</main>{teaser}", 0), (f"<main>{part(0)}{teaser}{part(1)}</main>", 0), (f"<div>{part(0)}{part(1)}</div>{teaser}", 2)):
        text = html_extract.main_text(f"<body>{body}</body>")  # without a container the ratio leaves out the first two lines of these
        assert all(f"Part {k} sentence {i} " in text for k in range(2) for i in range(6) if (k, i) >= (0, first))


def test_page_without_article_element():
    menu = "".join(f"<li><a href=/{i}>Menu item {i}</a></li>" for i in range(9))
    paras = "".join(f"<p>Paragraph {i} of the story, with enough words in it to be read as running text by anyone.</p>" for i in range(5))
    text = html_extract.main_text(f"<body><ul>{menu}</ul><h2>The story</h2>{paras}<ul>{menu}</ul></body>")
    assert text.split("\n")[0] == "The story" and text.count("Paragraph") == 5 and "Menu" not in text


def test_pages_never_fail(spark):
    rng = random.Random(2)
    bits = ["<p>", "</p>", "<div", ">", "<!--", "-->", "<![CDATA[", "]]>", "&amp;", "&#x41;", "&", "text ", "<article>", "</article>", "<script>", "</script>", "<?pi", "\x00", "é", "<a href='x", "</"]
    pages = [(i, "u", "".join(rng.choices(bits, k=40))) for i in range(200)] + [(None, None, None), (7, "u", ""), (7, "u", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = html_extract.extract_pages(df).collect()
    assert len(rows) == 203 and all(r.n_chars == len(r.text) for r in rows)
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_smoothing_keeps_the_mean_of_equal_values():
    assert html_extract.smooth([2.0] * 7) == pytest.approx([2.0] * 7) and html_extract.smooth([]) == []


PAGES = "page_id long, url string, html string"


def test_archives_round_trip(spark):
    rows = [(i, f"http://x/{i}é", f"<p>page {i % 5} é\r\n\r\nWARC/1.1</p>") for i in range(40)] + [(90, None, None), (91, "u", ""), (92, "u", "z" * 300_000), (3, "http://x/3é", "<p>page 3 é\r\n\r\nWARC/1.1</p>")]
    got = warc.archive_round_trip(spark.createDataFrame(rows, PAGES)).collect()
    least = {}
    for i, _, h in rows:
        least[h or ""] = min(i, least.get(h or "", i))
    want = []
    for i, _, h in rows:
        payload = (h or "").encode()
        again = i != least[h or ""]
        want.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if again else "response", least[h or ""] if again else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert warc.archive_round_trip(spark.createDataFrame([], PAGES)).count() == 0


def records(data):
    found = list(warc.salvage(data))
    return [x["page_id"] for kind, x in found if kind == "record"], [(x["at"], x["bytes"]) for kind, x in found if kind == "gap"]


def test_salvage_of_packed_bodies_and_long_members():
    """A plain record whose body is gzip is one record; a member of several keeps those before its damage or end."""
    body = warc.member(b"packed text " * 40)
    plain = warc.record_bytes(1, "u", body, warc.digest_of(body), None, False)
    noise = [random.Random(i).randbytes(3000) for i in range(6)]
    records = [warc.record_bytes(i, "u", x, warc.digest_of(x), None, False) for i, x in enumerate(noise)]
    found = list(warc.salvage(plain + warc.member(records[0]) + plain))
    assert [(k, x.get("page_id")) for k, x in found] == [("record", 1), ("record", 0), ("record", 1)]
    whole = warc.member(b"".join(records))
    cut = list(warc.salvage(whole[: len(whole) - 4000]))
    assert [x["page_id"] for k, x in cut if k == "record"] == [0, 1, 2, 3] and [x["why"] for k, x in cut if k == "gap"] == ["cut short"]
    damaged = list(warc.salvage(whole[:-8] + bytes(4) + whole[-4:]))
    assert [x["page_id"] for k, x in damaged if k == "record"] == [0, 1, 2, 3, 4, 5] and damaged[-1][0] == "gap"


def test_salvage_of_members_and_plain_records():
    one = [warc.record_bytes(i, "u", b"payload %d " % i * 50, warc.digest_of(b"payload %d " % i * 50), None, False) for i in range(6)]
    members = [warc.member(r) for r in one]
    whole = b"".join(members)
    at = [sum(map(len, members[:i])) for i in range(7)]
    assert records(whole) == (list(range(6)), []) and records(whole + b"\x00") == (list(range(6)), [])
    broken = bytearray(whole)
    broken[at[2] + len(members[2]) // 2] ^= 0xFF
    ids, gaps = records(bytes(broken))
    assert ids == [0, 1, 3, 4, 5] and gaps[0][0] == at[2] and sum(n for _, n in gaps) == len(members[2])
    ids, gaps = records(whole[: at[3] + 10])
    assert ids == [0, 1, 2] and gaps == [(at[3], 10)]
    assert records(b"junk" + whole) == (list(range(6)), [(0, 4)])
    plain = b"".join(one)
    assert records(plain) == (list(range(6)), [])
    cut = plain[: len(one[0]) + 30] + plain[len(one[0]) + len(one[1]) :]
    ids, gaps = records(cut)
    assert ids == [0, 2, 3, 4, 5] and gaps == [(len(one[0]), 30)]
    mixed = members[0] + one[1] + members[2]
    assert records(mixed) == ([0, 1, 2], [])
    wrong = warc.member(one[0].replace(b"payload 0", b"payload 9"))  # digest no longer fits
    assert records(wrong + members[1])[0] == [1]
    assert records(b"") == ([], [])


def test_pipeline_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    base = [words(80) for _ in range(30)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(base)]
    rows += [(100 + i, t, "en", "s", len(t)) for i, t in enumerate(base[:10])]
    rows += [(200, "too short", "en", "s", 9), (201, None, "en", "s", None), (202, words(60) + ' token = "0123456789abcdef0123456789"', "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    step = docs
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == docs.columns
        counts.append(step.count())
    assert counts == [41, 31, 31]
    assert not [r for r in step.collect() if "0123456789abcdef" in r.text]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {*range(30), 202}


NAMES = ["__words", "__n", "__text", "__id", "__late", "__row", "__key", "__spans", "__clean", "a.b", "a`b", "row", "late", "id", "key", "doc", "stratum", "spans", "kept"]


def test_stages_carry_columns_of_any_name(spark):
    """Working names, dots and backticks in extra columns neither fail nor change."""
    from ledgerline.llm import quality_rules, secret_scan, simhash

    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    texts = [words(60) for _ in range(8)] + [words(60) + ' token = "0123456789abcdef0123"', None, ""]
    base = [(i, t, "en", None if t is None else len(t)) for i, t in enumerate(texts)] + [(None, words(40), None, 3)]
    base += [base[0], (20, base[1][1], "en", 5)]
    plain = spark.createDataFrame(base, "doc_id long, text string, lang string, n_chars int")
    extra = plain
    for k, name in enumerate(NAMES):
        extra = extra.withColumn(name, F.lit(k))
    extra = extra.withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    stages = {"good": lambda d: quality_rules.keep_good(d, labels), "one": simhash.keep_one, "redact": secret_scan.redact}
    sizes = {"good": 12, "one": 11, "redact": len(base)}
    for name, stage in stages.items():
        out = stage(extra)
        assert out.columns == extra.columns and [t for _, t in out.dtypes] == [t for _, t in extra.dtypes]
        rows = out.collect()
        assert len(rows) == sizes[name]
        assert all([r[n] for n in NAMES] == list(range(len(NAMES))) and r["m"] == {"k": 1} for r in rows)
        short = stage(plain).collect()
        assert sorted(map(str, short)) == sorted(str(Row(**{c: r[c] for c in plain.columns})) for r in rows)
        assert stage(extra.limit(0)).columns == extra.columns and stage(extra.limit(0)).count() == 0
    cleaned = {r.doc_id: r for r in secret_scan.redact(extra).collect()}
    assert cleaned[8].text.endswith('[REDACTED]"') and cleaned[8].n_chars == len(cleaned[8].text) and cleaned[9].text is None and cleaned[9].n_chars == 0


def test_operators_ignore_clashing_names(spark):
    rows = [(i, f"text {i}", f"<p>page {i % 3}</p>", "u") for i in range(12)] + [(None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, html string, url string").withColumn("page_id", F.col("doc_id"))
    for name in [*NAMES, "shard", "slot", "size", "bucket", "payload", "digest", "copies", "fp", "root", "anchor", "offset", "first"]:
        docs = docs.withColumn(name, F.lit("x"))
    vectors = docs.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0), F.col("doc_id").cast("double")).alias("embedding"), *[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c not in ("doc_id", "embedding")])
    assert sharding.assign_shards(docs, [1.0] * 4).count() == 13
    assert embedding_dedup.near_duplicates(vectors).count() == 13
    assert html_extract.extract_pages(docs).count() == 13
    assert warc.archive_round_trip(docs).count() == 13
