"""Quality rules with risk-controlled cutoffs; DataFrame functions only.

Features of a text are computed in place (no row per word). Base rules reject
outright. For the rest, each rule is a feature with a grid of cutoffs; a cutoff
is usable in a stratum if the labelled holdout proves, by an exact binomial
(Clopper-Pearson) bound, that it rejects few good documents there. The tests of
all strata, rules and cutoffs share the error `delta` (Bonferroni), and the
rules share the allowed rate `alpha`, so that, with probability 1 - delta, no
stratum loses more than alpha of its good documents to the rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, column, materialize

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8

#: rule -> cutoffs, mildest last; a text is rejected where its feature is above the cutoff
RULES: dict[str, tuple[float, ...]] = {
    "symbols": (0.02, 0.05, 0.1, 0.2, 0.4),
    "dup_lines": (0.1, 0.2, 0.3, 0.5, 0.7),
    "repeats": (0.05, 0.1, 0.15, 0.2, 0.25),
    "long_words": (7.0, 8.0, 9.0, 10.0, 12.0),
}


def _features(docs: DataFrame) -> DataFrame:
    """Adds __n_words and the four counts to docs, which has __text. Windows are
    compared by 64-bit hashes of their words."""
    words = F.filter(F.split("__text", SPACE), lambda w: w != "")
    docs = docs.withColumn("__words", words).withColumn("__n", F.size("__words").cast("long"))
    count = F.col("__n").cast("int")
    windows = F.when(
        F.col("__n") > WINDOW,
        F.transform(F.sequence(F.lit(1), count - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__words", i, F.lit(WINDOW)))),
    )
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    docs = (
        docs.withColumn("__windows", windows)
        .withColumn("__lines", lines)
        .withColumn("__chars", F.length(F.array_join("__words", "")).cast("long"))
        .withColumn("__symbols", F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long"))
        .withColumn("__again", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
        .withColumn("__twice", F.size("__windows") > F.size(F.array_distinct("__windows")))
    )
    # only where some window recurs: sort (hash, place); a place counts if a neighbour has its hash
    placed = F.when(
        F.col("__twice"), F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    )
    docs = docs.withColumn("__sorted", placed).withColumn("__m", F.size("__sorted"))
    none = F.lit(None).cast("struct<h:bigint,i:int>")
    later = F.concat(F.slice("__sorted", F.lit(2), F.greatest(F.col("__m") - 1, F.lit(0))), F.array(none))
    docs = docs.withColumn("__same", F.zip_with("__sorted", later, lambda x, y: F.struct(x["i"].alias("i"), F.coalesce(x["h"] == y["h"], F.lit(False)).alias("e"))))
    before = F.concat(F.array(F.lit(False)), F.transform(F.slice("__same", F.lit(1), F.greatest(F.col("__m") - 1, F.lit(0))), lambda x: x["e"]))
    hits = F.zip_with("__same", before, lambda x, e: F.when(x["e"] | e, x["i"]))
    docs = docs.withColumn("__hits", F.array_sort(F.filter(hits, lambda i: i.isNotNull())))
    # words under the union of the windows that start at the hits
    far = F.lit(1 << 30)
    nexts = F.concat(F.slice("__hits", F.lit(2), F.greatest(F.size("__hits") - 1, F.lit(0))), F.array(far))
    under = F.zip_with("__hits", nexts, lambda a, b: F.least(F.lit(WINDOW), b - a))
    repeated = F.coalesce(F.aggregate(under, F.lit(0), lambda s, x: s + x).cast("long"), F.lit(0).cast("long"))
    return docs.withColumn("__repeats", repeated)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", strata_col: str = "lang", carry: bool = False) -> DataFrame:
    """doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed; null texts have no words. With carry, a struct
    doc of all columns too."""
    few = docs.select(
        *([carried(docs)] if carry else []),
        column(docs, id_col).cast("long").alias("doc_id"),
        F.coalesce(column(docs, strata_col).cast("string"), F.lit("")).alias("stratum"),
        F.coalesce(column(docs, text_col).cast("string"), F.lit("")).alias("__text"),
    )
    n, repeats = F.col("__n"), F.col("__repeats")
    return _features(few).select(
        *(["doc"] if carry else []),
        "doc_id",
        "stratum",
        n.alias("n_words"),
        F.col("__chars").alias("word_chars"),
        F.col("__symbols").alias("n_symbols"),
        F.col("__again").alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
        ((n < 20) | (100 * repeats > 30 * n)).alias("base_failed"),
    )


def signals() -> dict[str, Column]:
    """The features that RULES cut, of a row of features()."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "dup_lines": F.col("n_dup_lines") * 10.0 / words,
        "repeats": F.col("n_repeat_words") / words,
        "long_words": F.col("word_chars") / words,
    }


def _ln_choose(n: Column, k: Column) -> Column:
    def ln_factorial(x: Column) -> Column:
        small = [math.lgamma(i + 1) for i in range(16)]
        y = F.greatest(x, F.lit(16)).cast("double")
        series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
        stirling = y * F.log(y) - y + 0.5 * F.log(2 * math.pi * y) + series
        return F.when(x < 16, F.element_at(F.array(*map(F.lit, small)), (x + 1).cast("int"))).otherwise(stirling)

    return ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k)


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X binomial (n, p), k < n p: the last term times the sum of
    the falling ratios below it."""
    last = F.exp(_ln_choose(n, k) + k * math.log(p) + (n - k) * math.log1p(-p))
    odds = (1 - p) / p
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    falling = F.aggregate(
        F.when(k > 0, F.sequence(k.cast("int"), F.lit(1))).otherwise(F.array().cast("array<int>")),
        zero,
        lambda s, i: F.struct(
            (s["term"] * i / (n - i + 1) * odds).alias("term"), (s["sum"] + s["term"] * i / (n - i + 1) * odds).alias("sum")
        ),
        lambda s: s["sum"],
    )
    return last * falling


def cutoffs(rows: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """stratum, then a cutoff of each rule (null: none is proven) and n_good.

    rows: of features(). labels: doc_id, quality; good is quality 1 in every
    label of a document. The documents that base rules reject aren't counted,
    as the rules don't see them.
    """
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    held = rows.where("not base_failed").join(good, "doc_id")
    values = signals()
    sums = [F.sum((values[r] > c).cast("long")).alias(f"{r}_{i}") for r, cs in RULES.items() for i, c in enumerate(cs)]
    counted = materialize(held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_good"), *sums), "holdout")
    p, tests = alpha / len(RULES), max(1, counted.count() * sum(map(len, RULES.values())))
    each = [f"named_struct('rule', '{r}', 'cut', {c}D, 'k', {r}_{i})" for r, cs in RULES.items() for i, c in enumerate(cs)]
    tried = counted.select("stratum", "n_good", F.expr(f"inline(array({', '.join(each)}))"))
    proven = F.when(F.col("k") < F.col("n_good") * p, binomial_tail(F.col("n_good"), F.col("k"), p) <= delta / tests)
    tried = tried.withColumn("proven", F.coalesce(proven, F.lit(False)))
    lowest = [F.min(F.when(F.col("proven") & (F.col("rule") == r), F.col("cut"))).alias(f"cut_{r}") for r in RULES]
    return tried.groupBy("stratum", "n_good").agg(*lowest)


def judge(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05, id_col: str = "doc_id", text_col: str = "text", strata_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, rejected_by.

    The bound holds for the documents that reach the rules: what base_failed
    rejects, good documents too, is fixed beforehand and isn't counted in it.

    Null and empty texts have no words and fail the base rules. A null stratum
    is the stratum ''. A stratum without enough labels has no proven cutoff and
    rejects by base rules only; so does everything with an empty labels table.
    Repeated rows are judged alike; null ids stay, unlabelled. Other columns
    aren't carried.
    """
    rows = materialize(features(docs, id_col, text_col, strata_col), "features")
    cuts = materialize(cutoffs(rows, labels, alpha, delta), "cutoffs")
    values = signals()
    by = F.concat_ws(",", *[F.when(values[r] > F.col(f"cut_{r}"), F.lit(r)) for r in RULES])
    return rows.join(cuts, "stratum", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (by == "")).alias("kept"),
        F.when(F.col("base_failed"), F.lit("base")).otherwise(by).alias("rejected_by"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The rows of docs (doc_id, text, lang, ...) that judge() would keep, with
    all their columns, whatever their names. Texts are written once with their
    features, not shuffled.

    Null and empty texts go, as the base rules fail them; a null lang is the
    stratum ''; rows with a null id are judged but never counted as labelled;
    equal rows stay or go together; an empty table gives an empty one.
    """
    rows = materialize(features(docs, carry=True), "features").where("not base_failed")
    cuts = materialize(cutoffs(rows.drop("doc"), labels, alpha, delta), "cutoffs")
    values = signals()
    failed = [F.coalesce(values[r] > F.col(f"cut_{r}"), F.lit(False)) for r in RULES]
    any_failed = failed[0]
    for f in failed[1:]:
        any_failed = any_failed | f
    return rows.join(cuts, "stratum", "left").where(~any_failed).select("doc.*")
