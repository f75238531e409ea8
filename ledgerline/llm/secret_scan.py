"""Secret scan with multipart credential linking; DataFrame functions only.

Strong kinds (labelled values, access identifiers, long hexadecimal runs) are
always reported. Weak parts are identifiers, unlabelled mixed tokens and
endpoints; an interval join within scopes of SCOPE code points reports a weak
identifier only near a secret, a weak token only near an identifier, and an
endpoint only near both.

Parts are different places. A secret that overlaps an identifier is that
identifier's value, no part of its own; a weak token within a strong span is
that span again; what lies in an endpoint isn't its partner. So a lone
credential is never its own complement.

Places come from the texts' pieces between matches: their lengths are summed by
a window, in time linear in the matches, so texts aren't shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import carried, column, materialize

SCOPE = 200

_KEYS = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
_VALUE = r"[A-Za-z0-9+/_.=-]+"
ASSIGN = _KEYS + _VALUE
ACCESS = r"AKIA[A-Z0-9]{14,}"  # at least 18 in all; a shorter run can't hold a longer match
HEX = r"[0-9a-f]{16,}"
WEAK_ID = r"""(?i:access_?key_?id|client_?id|account_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@_.+-]{4,}"""
WEAK_TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ENDPOINT = r"""(?i:https?|postgres|postgresql|mysql|mongodb|redis|amqp|ftp)://[^\x00-\x20"'<>]{4,}"""

#: in order of report; (kind, role)
KINDS = (("assign", "secret"), ("access", "id"), ("hex", "secret"), ("weak_id", "id"), ("weak_token", "secret"), ("endpoint", "endpoint"))
#: place of the first weak kind
WEAK = 3


def _matches(pattern: str, kind: int, wanted: Column, good=None) -> Column:
    """Array of (kind, gap before, length, good) of the text's matches, empty unless wanted."""
    text = F.col("__text")
    found = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, m: F.struct(
            F.lit(kind).alias("kind"), F.length(gap).cast("long").alias("gap"), F.length(m).cast("long").alias("len"), (good(m) if good else m.isNotNull()).alias("good")
        ),
    )
    none = F.array().cast("array<struct<kind:int,gap:bigint,len:bigint,good:boolean>>")
    return F.when(wanted, F.filter(found, lambda x: x["len"].isNotNull())).otherwise(none)


def _parts(docs: DataFrame) -> DataFrame:
    text = F.col("__text")
    labelled, access, runs, names = text.rlike(ASSIGN), text.contains("AKIA"), text.rlike(HEX), text.rlike(WEAK_ID)
    docs = docs.withColumn("__has", F.struct(labelled.alias("a"), access.alias("k"), runs.alias("h"), names.alias("n")))
    a, k, h, n = (F.col("__has")[x] for x in "akhn")
    has_id = k | n
    mixed = lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    return docs.withColumn(
        "parts",
        F.concat(
            _matches(ASSIGN, 0, a, lambda m: F.length(F.regexp_replace(m, "^" + _KEYS, "")) >= 12),
            _matches(ACCESS, 1, k),
            _matches(HEX, 2, h),
            _matches(WEAK_ID, 3, n),
            _matches(WEAK_TOKEN, 4, has_id, mixed),
            _matches(ENDPOINT, 5, has_id),
        ),
    )


def _with_roles(placed: DataFrame) -> DataFrame:
    """Adds role: id, secret, endpoint, or null for what is no part of its own."""
    kind, start, end = F.col("kind"), F.col("start"), F.col("end")
    upto = W.partitionBy("key").orderBy("start").rangeBetween(W.unboundedPreceding, W.currentRow)
    # frames that grow are linear in the matches; one that shrinks would be quadratic
    onward = W.partitionBy("key").orderBy(F.desc("start")).rangeBetween(W.unboundedPreceding, W.currentRow)
    is_id = F.element_at(F.array(*[F.lit(r == "id") for _, r in KINDS]), kind + 1)
    in_id = (F.max(F.when(is_id, end)).over(upto) > start) | (F.min(F.when(is_id, start)).over(onward) < end)
    in_strong = F.max(F.when(kind < WEAK, end)).over(upto) >= end
    role = F.element_at(F.array(*[F.lit(r) for _, r in KINDS]), kind + 1)
    gone = F.coalesce(in_id, F.lit(False)) | ((kind >= WEAK) & F.coalesce(in_strong, F.lit(False)))
    return placed.withColumn("role", F.when((role != "secret") | ~gone, role))


def _link(placed: DataFrame, scope: int) -> DataFrame:
    """key, kind, start, end of the weak parts that stand within scope of the
    parts that complete them, each in a place of its own."""
    parts = materialize(_with_roles(placed).where(F.col("role").isNotNull()), "roles")
    cell = F.floor(F.col("start") / scope)
    near = parts.where("role <> 'endpoint'").select(
        "key", F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.col("role").alias("o_role"), F.explode(F.sequence(cell - 1, cell + 1)).alias("cell")
    )
    meets = lambda role: F.coalesce(F.max(F.col("o_role") == role), F.lit(False))
    met = (
        parts.where(F.col("kind") >= WEAK)
        .withColumn("cell", cell)
        .join(near, ["key", "cell"])
        .where(F.abs(F.col("start") - F.col("o_start")) <= scope)
        .where((F.col("o_end") <= F.col("start")) | (F.col("o_start") >= F.col("end")))
        .groupBy("key", "kind", "start", "end", "role")
        .agg(meets("id").alias("by_id"), meets("secret").alias("by_secret"))
    )
    has = lambda role: F.col("role") == role
    return met.where((has("id") | F.col("by_id")) & (has("secret") | F.col("by_secret"))).select("key", "kind", "start", "end")


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> tuple[DataFrame, DataFrame]:
    """(rows, spans). rows: key, doc_id of every input row; spans: one row per
    key with some span: key, spans array<struct<start,kind_order,end,kind>>, sorted.

    The key is a digest of id and text, so repeated rows share their spans.
    """
    few = docs.select(column(docs, id_col).cast("long").alias("doc_id"), F.coalesce(column(docs, text_col).cast("string"), F.lit("")).alias("__text"))
    parts = _parts(few).select(key_of(F.col("doc_id"), F.col("__text")).alias("key"), "doc_id", "parts")
    parts = materialize(parts, "parts")
    placed = (
        parts.where(F.size("parts") > 0)
        .dropDuplicates(["key"])
        .select("key", F.posexplode("parts").alias("at", "p"))
        .select("key", "at", "p.*")
        .withColumn("end", F.sum(F.col("gap") + F.col("len")).over(W.partitionBy("key", "kind").orderBy("at")))
        .where("good")
        .select("key", "kind", (F.col("end") - F.col("len")).alias("start"), "end")
    )
    placed = materialize(placed, "placed")
    linked = _link(placed, scope)
    names = F.array(*[F.lit(k) for k, _ in KINDS])
    item = F.struct("start", F.col("kind").alias("kind_order"), "end", F.element_at(names, F.col("kind") + 1).alias("kind"))
    spans = placed.where(F.col("kind") < WEAK).unionByName(linked).groupBy("key").agg(F.array_sort(F.collect_list(item)).alias("spans"))
    return parts.select("key", "doc_id"), materialize(spans, "spans")


def key_of(doc_id: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("\x00", F.coalesce(doc_id.cast("string"), F.lit("-")), F.coalesce(text, F.lit(""))), 256)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256,
    spans (string), found (array). Null and empty texts have none. Equal rows
    have equal results; an empty table gives an empty one; null ids stay; other
    columns aren't carried."""
    rows, spans = find_spans(docs, id_col, text_col)
    none = F.array().cast(dict(spans.dtypes)["spans"])
    joined = rows.join(spans, "key", "left").withColumn("found", F.coalesce("spans", none))
    show = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("found", lambda x: x["kind_order"] <= 2)
    of = lambda k: F.size(F.filter("found", lambda x: x["kind_order"] == k)).cast("long")
    return joined.select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(F.array_join(F.transform(base, show), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("found", show), ",").alias("spans"),
        "found",
    )


def suspect(text: Column) -> Column:
    """Whether a text can have a span at all."""
    return F.coalesce(text.rlike(ASSIGN) | text.contains("AKIA") | text.rlike(HEX) | text.rlike(WEAK_ID), F.lit(False))


def redact(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """docs (doc_id, text, ...) with every span found replaced by mark, spans
    that touch or overlap by one; n_chars, if there, is counted anew (0 for a
    null text). Other columns stay as they are, whatever their names. No row
    goes: null and empty texts, null ids and repeated rows stay; an empty table
    gives an empty one. Only texts that can have a span are joined with their
    spans; the others pass as they are, whatever the size of the table."""
    text = column(docs, "text").cast("string")
    rows = docs.select(carried(docs), column(docs, "doc_id").cast("long").alias("doc_id"), text.alias("text"))
    suspects = rows.where(suspect(F.col("text")))
    _, spans = find_spans(suspects)
    joined = suspects.withColumn("key", key_of(F.col("doc_id"), F.col("text"))).join(spans, "key", "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(s, x):
        fresh = (x["start"] > s["at"]) | ((s["at"] == 0) & (s["out"] == ""))
        gap = F.substring("text", (s["at"] + 1).cast("int"), F.greatest(x["start"] - s["at"], F.lit(0)).cast("int"))
        return F.struct(F.when(fresh, F.concat(s["out"], gap, F.lit(mark))).otherwise(s["out"]).alias("out"), F.greatest(s["at"], x["end"]).alias("at"))

    rest = lambda s: F.concat(s["out"], F.substring("text", (s["at"] + 1).cast("int"), F.length("text")))
    clean = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.aggregate("spans", start, step, rest))
    changed = joined.select("doc", clean.alias("text")).unionByName(rows.where(~suspect(F.col("text"))).select("doc", "text"))
    doc = F.col("doc").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        doc = doc.withField("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return changed.select(doc.alias("doc")).select("doc.*")
