"""DuckDB SQL for the queries that SQL can express.

The licence scan's chained spans, the fingerprints, the page extraction, the
tokenizers' queries, language profiles and eigenvectors have none: the tests hold
them against brute force.
"""

from __future__ import annotations

from .quality_rules import RULES
from .secret_scan import ACCESS, ENDPOINT, HEX, KINDS, SCOPE, WEAK_ID, WEAK_TOKEN
from .sharding import BUCKET_ROWS

_CRC_TABLE = """(SELECT list(c ORDER BY i) FROM (SELECT i, list_reduce([i] || range(8),
    lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c FROM (SELECT unnest(range(256))::BIGINT AS i)))"""


def _shard_cost(shard: str) -> str:
    return f"-ln((CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':' || {shard}), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)"


SHARDING = f"""
WITH tab AS (SELECT {_CRC_TABLE} AS t),
sized AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
crc AS (SELECT doc_id, CAST(length(h) // 2 + 16 AS BIGINT) AS size,
               CAST(xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)),
                   lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])), 4294967295) AS BIGINT) AS text_crc32 FROM sized, tab),
cost AS (SELECT doc_id, s AS shard, {_shard_cost("s")} AS cost FROM documents, (SELECT unnest(range(41)) AS s)),
best AS (SELECT doc_id, arg_min(CASE WHEN shard < 40 THEN shard END, CASE WHEN shard < 40 THEN (cost, shard) END) AS shard, arg_min(shard, (cost, shard)) AS grown_shard FROM cost GROUP BY doc_id)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':' || CAST(text_crc32 AS VARCHAR)), 1, 8) AS BIGINT)
           % (SELECT greatest(1, -(-count(*) // ({BUCKET_ROWS} * 40))) FROM documents), doc_id, text_crc32, size) - 1 AS slot,
       CAST(grown_shard AS INTEGER) AS grown_shard FROM crc JOIN best USING (doc_id)
"""


def _quality(alpha: float = 0.02, delta: float = 0.05) -> str:
    signals = {
        "symbols": "n_symbols / CAST(greatest(word_chars, 1) AS DOUBLE)",
        "dup_lines": "n_dup_lines * 10.0 / CAST(greatest(n_words, 1) AS DOUBLE)",
        "repeats": "n_repeat_words / CAST(greatest(n_words, 1) AS DOUBLE)",
        "long_words": "word_chars / CAST(greatest(n_words, 1) AS DOUBLE)",
    }
    tries = ", ".join(f"{{'rule': '{r}', 'cut': CAST({c} AS DOUBLE)}}" for r, cs in RULES.items() for c in cs)
    value = "CASE rule " + " ".join(f"WHEN '{r}' THEN {x}" for r, x in signals.items()) + " END"
    p, n_tests = alpha / len(RULES), sum(map(len, RULES.values()))
    ln_term = f"lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln({p}) + (n_good - i) * ln(1 - {p})"
    return rf"""
WITH words AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text,
                      list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
grams AS (SELECT doc_id, i, list_slice(w, i, i + 7) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM words WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
under AS (SELECT doc_id, CAST(sum(least(8, coalesce(nxt - i, 8))) AS BIGINT) AS n_repeat_words
          FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM words),
feats AS (SELECT doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                 CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
                 coalesce(n_repeat_words, 0) AS n_repeat_words FROM words JOIN lines USING (doc_id) LEFT JOIN under USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM feats),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
tries AS (SELECT unnest([{tries}]) AS t),
held AS (SELECT stratum, t.rule AS rule, t.cut AS cut, count(*) AS n_good, count(CASE WHEN {value.replace("rule", "t.rule")} > t.cut THEN 1 END) AS k
         FROM judged JOIN good USING (doc_id), tries WHERE NOT base_failed GROUP BY ALL),
tests AS (SELECT count(DISTINCT stratum) * {n_tests} AS m FROM held),
proven AS (SELECT stratum, rule, min(cut) AS cut FROM held, tests WHERE k < n_good * {p}
             AND list_sum(list_transform(range(0, k + 1), lambda i: exp({ln_term}))) <= {delta} / m GROUP BY stratum, rule),
failed AS (SELECT doc_id, string_agg(rule, ',' ORDER BY list_position({list(RULES)}, rule)) AS by_rules
           FROM judged JOIN proven USING (stratum) WHERE {value} > cut GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND by_rules IS NULL AS kept,
       CASE WHEN base_failed THEN 'base' ELSE coalesce(by_rules, '') END AS rejected_by
FROM judged LEFT JOIN failed USING (doc_id)"""


def _secrets() -> str:
    kw = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?"""
    ascii_ = lambda p: p.replace("'", "''")
    patterns = [kw + r"[A-Za-z0-9+/_.=-]+", ACCESS, HEX, ascii_(WEAK_ID), WEAK_TOKEN, ascii_(ENDPOINT)]
    checks = [f"length(regexp_replace(m, '^{kw}', '')) >= 12", "TRUE", "TRUE", "TRUE", "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')", "TRUE"]
    each = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS kind, i, length(g[i]) AS gap, length(ms[i]) AS len, ms[i] AS m FROM (SELECT doc_id, unnest(range(1, len(ms) + 1)) AS i, ms, g FROM "
        f"(SELECT doc_id, regexp_extract_all(text, '{p}') AS ms, string_split_regex(text, '{p}') AS g FROM docs"
        + (" WHERE has_id" if k > 3 else "")
        + "))"
        for k, p in enumerate(patterns)
    )
    ok = "CASE kind " + " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(checks)) + " END"
    roles = [r for _, r in KINDS]
    names = [k for k, _ in KINDS]
    return rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, contains(coalesce(text, ''), 'AKIA') OR regexp_matches(coalesce(text, ''), '{patterns[3]}') AS has_id FROM documents),
found AS ({each}),
placed AS (SELECT doc_id, kind, stop - len AS start, stop FROM (SELECT *, CAST(sum(gap + len) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS stop FROM found) WHERE {ok}),
named AS (SELECT *, {roles}[kind + 1] AS named FROM placed),
parts AS (SELECT * FROM named a WHERE named <> 'secret' OR (
            NOT EXISTS (SELECT 1 FROM named b WHERE b.doc_id = a.doc_id AND b.named = 'id' AND b.start < a.stop AND a.start < b.stop)
            AND (kind < 3 OR NOT EXISTS (SELECT 1 FROM named b WHERE b.doc_id = a.doc_id AND b.kind < 3 AND b.start <= a.start AND b.stop >= a.stop)))),
spans AS (SELECT doc_id, kind, start, stop, {names}[kind + 1] || ':' || start || ':' || stop AS s FROM
          (SELECT doc_id, kind, start, stop FROM placed WHERE kind < 3 UNION ALL
           SELECT doc_id, kind, start, stop FROM parts a WHERE kind >= 3
             AND (named = 'id' OR EXISTS (SELECT 1 FROM parts b WHERE b.doc_id = a.doc_id AND b.named = 'id' AND abs(a.start - b.start) <= {SCOPE} AND (b.stop <= a.start OR b.start >= a.stop)))
             AND (named = 'secret' OR EXISTS (SELECT 1 FROM parts b WHERE b.doc_id = a.doc_id AND b.named = 'secret' AND abs(a.start - b.start) <= {SCOPE} AND (b.stop <= a.start OR b.start >= a.stop))))),
by_doc AS (SELECT doc_id, count(CASE WHEN kind = 0 THEN 1 END) AS n_assign, count(CASE WHEN kind = 1 THEN 1 END) AS n_access, count(CASE WHEN kind = 2 THEN 1 END) AS n_hex,
                  string_agg(CASE WHEN kind <= 2 THEN s END, ',' ORDER BY start, kind) AS base, string_agg(s, ',' ORDER BY start, kind) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN by_doc USING (doc_id)"""


EMBEDDINGS = """
WITH RECURSIVE vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM vec a JOIN vec b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM vec LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) c ON c.a = vec_id LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = vec_id"""

_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
WARC = f"""
WITH hashed AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
based AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
            substr('{_DIGITS}', 1 + (CAST('0x' || substr(h, 1 + (i // 4) * 5, 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) % 32, 1)), '') AS payload_digest FROM hashed)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM based)"""



def _centroids(k: int = 40, rounds: int = 5) -> str:
    """Lloyd's rounds written out: assignment of every vector, then sums that are rounded down."""
    # the smallest distance, ties by number, as one integer
    nearest = f"min(list_sum(list_transform(list_zip(q, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) * {k} + c.cluster)"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"near{r} AS (SELECT row_id, any_value(vec_id) AS vec_id, any_value(q) AS q, CAST({nearest} AS BIGINT) AS best FROM kept, cent{r} c GROUP BY row_id)")
        steps.append(f"""sums{r} AS (SELECT cluster, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS c FROM
            (SELECT best % {k} AS cluster, i, sum(q[i])::DOUBLE AS s, count(*) AS n FROM near{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL) GROUP BY cluster)""")
        steps.append(f"cent{r + 1} AS (SELECT cluster, coalesce(s.c, o.c) AS c FROM cent{r} o LEFT JOIN sums{r} s USING (cluster))")
    return f"""
WITH kept AS (SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
              WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
cent0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), q) - 1 AS cluster, q AS c FROM kept QUALIFY cluster < {k}),
{", ".join(steps[:-2])},
result AS (SELECT vec_id, CAST(best % {k} AS INTEGER) AS cluster, best // {k} AS distance FROM near{rounds})
SELECT vec_id, r.cluster, distance, CAST(sum(distance) OVER (PARTITION BY r.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM result r JOIN cent{rounds} c ON c.cluster = r.cluster"""


ORACLES: dict[str, str] = {
    "op3_secret_scan": _secrets(),
    "op4_quality_rules": _quality(),
    "op5_sharding": SHARDING,
    "op6_embedding_dedup": EMBEDDINGS,
    "op8_warc": WARC,
    "op12_centroids": _centroids(),
}
