"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. The
vectors of three letters that follow each other are bound into one (the first
permuted twice, the second once, then multiplied), and a text's are bundled into
their sum. A language's prototype is the bundle of all its training texts, a
document's language the prototype with the largest cosine. All sums are of whole
numbers, so results don't depend on how rows are dealt out.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column

DIMS, SEED = 1024, 11
#: code points and texts that are counted at a time, grams that are bound at a time
BLOCK, TEXTS, GRAMS = 1 << 18, 256, 4096
#: groups x grams, a gram that a group holds, up to which they are multiplied as a full matrix
SPARSE = 24
#: letter vectors that a worker keeps; it starts anew beyond
LETTERS = 16_384
#: languages whose prototypes are sent to the tasks (4 KB each)
MOST_LANGUAGES = 8192
UNKNOWN = "und"

_VECTORS: dict[int, np.ndarray] = {}


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """A row of +1 and -1 for every code point, the same on every worker."""
    if len(_VECTORS) > LETTERS:
        _VECTORS.clear()
    for p in points.tolist():
        if p not in _VECTORS:
            _VECTORS[p] = (np.random.default_rng([SEED, p]).integers(0, 2, DIMS, dtype=np.int8) * 2 - 1).astype(np.int8)
    return np.stack([_VECTORS[p] for p in points.tolist()])


@functools.cache
def _kinds() -> np.ndarray:
    """For each code point 2 if it is a letter, 1 if a mark, else 0."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for value, pattern in ((1, r"\p{M}"), (2, r"\p{L}")):
        out[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = value
    return out


def code_points(text: str | None) -> np.ndarray:
    """Lower-cased letters and their marks; a space before, between and after runs of them. Empty without a letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
    kinds = _kinds()[points]
    if not (kinds == 2).any():
        return np.empty(0, np.uint32)
    letter = np.concatenate([[False], kinds > 0, [False]])
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # one space after each run
    kept[0] = True
    spaced = np.concatenate([[0x20], points, [0x20]])
    return np.where(letter, spaced, 0x20)[kept].astype(np.uint32)


def _blocks(texts: Sequence[str | None], groups: np.ndarray) -> Iterator[tuple[list[np.ndarray], list[int]]]:
    """Pieces of texts, with their groups; a long text is cut so that no three letters are lost or come twice."""
    pieces, of, held = [], [], 0
    for text, group in zip(texts, groups.tolist(), strict=True):
        points = code_points(text)
        for start in range(0, len(points) - 2, BLOCK):
            pieces.append(points[start : start + BLOCK + 2])
            of.append(group)
            held += len(pieces[-1])
            if held >= BLOCK or len(pieces) == TEXTS:
                yield pieces, of
                pieces, of, held = [], [], 0
    if pieces:
        yield pieces, of


def _binder(third: np.ndarray):
    """Bound vectors of grams, numbers in the base of the letters' count."""
    size, second, first = len(third), np.roll(third, 1, axis=1), np.roll(third, 2, axis=1)

    def bind(grams: np.ndarray) -> np.ndarray:
        rest, c = np.divmod(grams, size)
        a, b = np.divmod(rest, size)
        bound = first[a]
        bound *= second[b]
        bound *= third[c]
        return bound.astype(np.float32)

    return bind


def bundle(texts: Sequence[str | None], groups: np.ndarray, n_groups: int) -> np.ndarray:
    """A row a group: the sum of the bound vectors of its texts."""
    out = np.zeros((n_groups, DIMS))
    place = np.zeros(0x110000, np.int64)
    for pieces, of in _blocks(texts, groups):
        points, piece = np.concatenate(pieces), np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        letters = np.flatnonzero(np.bincount(points, minlength=1))
        place[letters] = np.arange(len(letters))
        at, size = place[points], len(letters)
        met, group = np.unique(of, return_inverse=True)
        inside = piece[2:] == piece[:-2]
        grams = (((group[piece[2:]] * size + at[:-2]) * size + at[1:-1]) * size + at[2:])[inside]
        grams, counts = np.unique(grams, return_counts=True)
        group, gram = np.divmod(grams, size**3)
        bind = _binder(letter_vectors(letters))
        kinds, kind = np.unique(gram, return_inverse=True)
        if len(met) * len(kinds) <= SPARSE * len(grams):  # groups share their grams: each is bound once
            weights = np.zeros((len(met), len(kinds)), np.float32)
            weights[group, kind] = counts
            for k in range(0, len(kinds), GRAMS):
                out[met] += weights[:, k : k + GRAMS] @ bind(kinds[k : k + GRAMS])
        else:
            for k in range(0, len(grams), GRAMS):
                g = group[k : k + GRAMS]
                weights = np.zeros((g[-1] - g[0] + 1, len(g)), np.float32)
                weights[g - g[0], np.arange(len(g))] = counts[k : k + GRAMS]
                out[met[g[0] : g[-1] + 1]] += weights @ bind(gram[k : k + GRAMS])
    return out


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows: text, lang. The bundle of each language of the partition."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(1).to_pylist()
        names = sorted(set(langs))
        place = {name: i for i, name in enumerate(names)}
        rows = bundle(batch.column(0).to_pylist(), np.array([place[x] for x in langs], np.int64), len(names))
        for name, row in zip(names, rows, strict=True):
            if row.any():
                sums[name] = sums[name] + row if name in sums else row
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["lang", "part"])


def _add(total: dict, row) -> dict:
    part = np.frombuffer(row[1])
    total[row[0]] = total[row[0]] + part if row[0] in total else part
    return total


def _merge(one: dict, other: dict) -> dict:
    for lang, part in other.items():
        one[lang] = one[lang] + part if lang in one else part
    return one


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = MOST_LANGUAGES) -> dict[str, np.ndarray]:
    """A prototype for each non-null language with a letter in its texts: bundles
    of tasks, merged in a tree. More than `most` languages are an error, raised
    before anything is learned: such a column holds no languages."""
    rows = docs.select(column(docs, text_col).cast("string").alias("text"), column(docs, lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    if (n := rows.select("lang").distinct().limit(most + 1).count()) > most:
        raise ValueError(f"more than {n - 1} languages")
    return rows.mapInArrow(_learn, "lang string, part binary").rdd.treeAggregate({}, _add, _merge, depth=3)


def _predict(languages: list[str], prototypes):
    def run(batches):
        for batch in batches:
            for k in range(0, len(batch), TEXTS):
                part = batch.slice(k, TEXTS)
                sums = bundle(part.column(1).to_pylist(), np.arange(len(part)), len(part))
                length = np.linalg.norm(sums, axis=1, keepdims=True)
                cosines = (sums / np.where(length > 0, length, 1.0)) @ prototypes.value.T if languages else np.zeros((len(part), 1))
                best = cosines.argmax(axis=1)
                known = (length[:, 0] > 0) & bool(languages)
                lang = [languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), known.tolist(), strict=True)]
                score = np.where(known, cosines[np.arange(len(part)), best].clip(0.0, 1.0), 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def held_out(doc_id: Column) -> Column:
    """A fifth of the ids, by their checksum; rows without an id too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score (the cosine, 0 at least).

    Prototypes are learned from the rows that aren't held out and have a text and
    a language. A text that is null or has no letter is `und` with score 0, and
    so is every text if nothing could be learned. Of equally near prototypes the
    language that sorts first is taken. Rows that repeat an id are each
    identified, and learned from, as often; rows without an id are held out.
    Texts of any length are read whole, a block at a time. An empty table gives
    an empty one; other columns aren't carried, whatever their names.
    """
    ids = column(docs, id_col)
    model = learn(docs.where(~held_out(ids)), text_col, lang_col)
    languages = sorted(model)
    matrix = np.stack([model[x] for x in languages]) if languages else np.zeros((0, DIMS))
    matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1.0)
    rows = docs.select(ids.alias("doc_id"), column(docs, text_col).cast("string").alias("text"), held_out(ids).alias("held_out"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    prototypes = docs.sparkSession.sparkContext.broadcast(matrix)
    return rows.mapInArrow(_predict(languages, prototypes), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
