"""Hierarchical packing of tokenised documents into training sequences.

A document's whole windows of the longest tier are sequences of their own; the
rest is routed to the smallest tier that holds it. Each tier packs its pieces,
longest first, into the fullest window that still takes them; gaps are filled
from shorter tiers, last of all by cutting a piece, so that every window is
exactly full. What is left at the end of a partition is laid end to end.
Finished windows wait until they make DEALT step groups and are then dealt,
longest first, to the group with the fewest tokens: each group has exactly STEP
tokens and, to one or so of each length, as many windows of each length as the
others, hence a like attention cost. Windows over a task's last full deal are
dealt among as few groups as hold them, which differ by one window at most.

Each task packs its own partition of the scan as it streams by: no shuffle, and
at most one padded sequence a task. What it holds at a time is bounded: GATHER
windows of a tier and DEALT + 1 step groups.
"""

from __future__ import annotations

import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapreplace
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import column
from .id_table import IdTable, by_bytes

FILE, END = "word_bpe_49k.json", 1
#: window sizes, powers of two
TIERS = (512, 1024, 2048)
#: windows of pieces that a tier gathers before it packs them
GATHER = 32
#: tokens of a step group, and groups that are dealt out at a time
STEP = 16 * 2048
DEALT = 16
#: distinct words that a worker keeps
CACHED = 1_000_000


#: letters that stay one letter whatever the normalizer does
_LATIN = r"a-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}"
#: such a letter and closing signs, which the vocabulary splits off it
CLOSING = rf"([{_LATIN}])([!-/:-@\[-`{{-~]+)([\t-\r ]|$)"
#: no text with it is taken apart: it may hold a special token's literal, which is looked for before letters are lowered
SPECIAL = "<|"


def stays_letters(words: pa.Array) -> np.ndarray:
    """Letters only, also once composed and lower-cased (some come apart into a letter and a mark)."""
    found = np.array(pc.match_substring_regex(words, rf"^[{_LATIN}]+$").to_numpy(zero_copy_only=False))
    for i in np.flatnonzero(~found).tolist():
        word = words[i].as_py()
        found[i] = word.isalpha() and unicodedata.normalize("NFC", word).lower().isalpha()
    return found


class WordTokenizer:
    """Ids of the tokenizers library, a word between white space at a time: no
    token of a vocabulary that drops white space reaches over it, so a word's
    ids depend on nothing else and are kept in a table of bounded size.

    ASCII letters are lowered and closing signs are cut off their letters first,
    as the vocabulary does itself. Splitting, counting distinct
    words and joining ids work on whole batches; only words that are new to a
    batch are looked up one by one, and words that are new to the table are
    encoded, those of letters together, each ending at its word-end token.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.table = IdTable(CACHED, self._learn)

    def _each(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        joined = stays_letters(pa.array(new, pa.string()))
        letters, rest = list(compress(new, joined)), list(compress(new, ~joined))
        for k in range(0, len(letters), 20_000):
            part = letters[k : k + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part):
                self.table.add(part, ids, stops)
            else:  # some letter that the normalizer takes apart
                rest += part
        for k in range(0, len(rest), 5_000):
            part = rest[k : k + 5_000]
            each = self._each(part)
            self.table.add(part, np.concatenate(each), np.cumsum([len(x) for x in each]))

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Per text its ids and END, as little-endian 32-bit integers."""
        texts = pc.fill_null(texts, "")
        special = pc.match_substring(texts, SPECIAL)
        plain = pc.ascii_lower(pc.if_else(special, "", texts))
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(plain, CLOSING, r"\1 \2\3"))
        ids, upto = self.table.look_up(words.flatten())
        ids = ids.tobytes()
        bounds = words.offsets.to_numpy()
        cuts = (4 * upto[bounds - bounds[0]]).tolist()
        end = END.to_bytes(4, "little")
        out = [ids[a:b] + end for a, b in zip(cuts, cuts[1:], strict=False)]
        odd = np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist()
        for k, found in zip(odd, self._each([texts[k].as_py() for k in odd]), strict=True):
            out[k] = found.tobytes() + end
        return out


@lru_cache(maxsize=2)
def load(path: str) -> WordTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokenizer(path)


def tokenizer_path(name: str = FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: doc_id, first token, ids as bytes, tokens of the document
Piece = tuple[int | None, int, bytes, int]
FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def size(piece: Piece) -> int:
    return len(piece[2]) // 4


def cut(piece: Piece, n: int) -> tuple[Piece, Piece]:
    doc, start, ids, total = piece
    return (doc, start, ids[: 4 * n], total), (doc, start + n, ids[4 * n :], total)


class StepGroups:
    """Deals windows into step groups. Powers of two, longest first, to the
    emptiest group: every gap is a multiple of the windows still to come, so
    groups fill up exactly while windows last."""

    def __init__(self, base: int, step: int = STEP) -> None:
        self.base, self.step, self.made = base, step, 0
        self.held: list[tuple[int, list[tuple]]] = []
        self.tokens = 0

    def put(self, window: int, rows: list[tuple]) -> Iterator[tuple]:
        self.held.append((window, rows))
        self.tokens += window
        if self.tokens >= (DEALT + 1) * self.step:  # a group's worth stays behind, for windows that come late
            yield from self._deal(DEALT)

    def close(self) -> Iterator[tuple]:
        if self.held:
            yield from self._deal(-(-self.tokens // self.step))

    def _deal(self, groups: int) -> Iterator[tuple]:
        open_groups = [(0, g) for g in range(groups)]
        waiting, self.held = sorted(self.held, key=lambda x: x[0], reverse=True), []
        for window, rows in waiting:
            tokens, g = open_groups[0]
            if tokens == self.step:  # all are full: the shortest wait for the next deal
                self.held.append((window, rows))
                continue
            heapreplace(open_groups, (tokens + window, g))
            for row in rows:
                yield (*row, self.base + self.made + g)
        self.tokens = sum(w for w, _ in self.held)
        self.made += groups

class Packer:
    def __init__(self, base: int, tiers: tuple[int, ...] = TIERS) -> None:
        self.tiers = tiers
        self.waiting: list[list[Piece]] = [[] for _ in tiers]
        self.tokens = [0] * len(tiers)
        self.base, self.made = base, 0
        self.groups = StepGroups(base)

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        """The rows that are final once this document has come."""
        total, top = len(ids) // 4, self.tiers[-1]
        whole = total // top
        for k in range(whole):
            yield from self._emit([(doc_id, k * top, ids[4 * k * top : 4 * (k + 1) * top], total)], top)
        if total > whole * top:
            self._wait((doc_id, whole * top, ids[4 * whole * top :], total))
        for t in range(len(self.tiers) - 1, -1, -1):
            if self.tokens[t] >= GATHER * self.tiers[t]:
                yield from self._pack(t)

    def _wait(self, piece: Piece) -> None:
        t = bisect_left(self.tiers, size(piece))
        self.waiting[t].append(piece)
        self.tokens[t] += size(piece)

    def _pack(self, t: int) -> Iterator[tuple]:
        """Best fit, longest first; then fill every gap that can be filled."""
        window = self.tiers[t]
        pieces, self.waiting[t], self.tokens[t] = sorted(self.waiting[t], key=size, reverse=True), [], 0
        bins: list[list[Piece]] = []
        gaps: list[tuple[int, int]] = []  # sorted (gap, bin)
        for p in pieces:
            at = bisect_left(gaps, (size(p), -1))
            if at < len(gaps):
                gap, b = gaps.pop(at)
                bins[b].append(p)
            else:
                gap, b = window, len(bins)
                bins.append([p])
            if gap > size(p):
                insort(gaps, (gap - size(p), b))
        short = {b: gap for gap, b in gaps}
        for b, held in enumerate(bins):
            gap = short.get(b, 0)
            if gap and not self._fill(held, gap, t):
                for p in held:  # too little is waiting: with the next ones, then
                    self._wait(p)
                continue
            yield from self._emit(held, window)

    def _fill(self, held: list[Piece], gap: int, t: int) -> bool:
        """Take pieces of this and shorter tiers that fit, longest tiers first, then cut one to fit."""
        if sum(self.tokens[: t + 1]) < gap:
            return False
        for k in range(t, -1, -1):
            kept = []
            for p in self.waiting[k]:
                if size(p) <= gap:
                    held.append(p)
                    gap -= size(p)
                    self.tokens[k] -= size(p)
                else:
                    kept.append(p)
            self.waiting[k] = kept
        if gap:
            k = next(k for k in range(t + 1) if self.waiting[k])
            p = self.waiting[k].pop()
            self.tokens[k] -= size(p)
            first, rest = cut(p, gap)
            held.append(first)
            self._wait(rest)
        return True

    def finish(self) -> Iterator[tuple]:
        """The rest end to end; its last sequence is padded if it isn't full."""
        top, held, gap = self.tiers[-1], [], self.tiers[-1]
        for p in [p for tier in reversed(self.waiting) for p in tier]:
            while size(p) > gap:
                first, p = cut(p, gap)
                yield from self._emit([*held, first], top)
                held, gap = [], top
            held.append(p)
            gap -= size(p)
            if not gap:
                yield from self._emit(held, top)
                held, gap = [], top
        if held:
            yield from self._emit(held, top)
        yield from self.groups.close()

    def _emit(self, pieces: list[Piece], window: int) -> Iterator[tuple]:
        rows, at = [], 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            rows.append((doc, start, n, zlib.crc32(ids), total, self.base + self.made, at, window))
            at += n
        self.made += 1
        yield from self.groups.put(window, rows)


def _pack(path: str | None, tiers: tuple[int, ...]):
    schema = pa.schema([(f, pa.int32() if f == "tier" else pa.int64()) for f in FIELDS])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches):
        words = load(path or tokenizer_path())
        packer = Packer(TaskContext.get().partitionId() << 32, tiers)
        rows: list[tuple] = []
        for batch in batches:
            for part in by_bytes(batch):
                for doc_id, found in zip(part.column(0).to_pylist(), words.encode_all(part.column(1)), strict=True):
                    rows += packer.add(doc_id, found)
                if len(rows) >= 5_000:
                    yield table(rows)
                    rows = []
        rows += packer.finish()
        if rows:
            yield table(rows)

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, tier (the sequence's window), step_group.
    Tiers are powers of two that divide STEP, shortest first.

    Every document, null and empty ones too, has its closing id at least. Rows
    that repeat are packed one by one; null ids stay; an empty table gives an
    empty one; other columns aren't carried. A task that is run again packs the
    same rows in the same order into the same sequences.
    """
    few = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text"))
    return few.mapInArrow(_pack(path, tuple(tiers)), SCHEMA)
