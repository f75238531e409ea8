"""Byte-level BPE encoding and decoding by a segment tree over adjacent pairs.

The leaves of a piece's tree are its adjacent pairs, each with rank and place;
the root is the least of them, so it yields the leftmost pair of lowest rank.
A merge changes three leaves, each a walk to the root, until no pair is left
that can merge. Pieces met before come from a table of bounded size; new short
pieces are merged together, one tree per row of an array; long ones, however
long, one by one in n log n.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import column
from .id_table import IdTable, by_bytes, ragged

FILE = "byte_bpe_50k.json"

_SPACE = r"\t\n\x0b\x0c\r\x20\x85\xa0  -     　"
#: Fixed value: the byte-level splitting pattern, white space spelled out
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"

NONE = np.int64(1) << 60
#: pieces up to this many bytes are merged together
SHORT = 64
CACHED = 1_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself where it prints, else the next code point from 256 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab = model["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in model["added_tokens"]}
        alphabet = byte_alphabet()
        to_bytes = lambda token: bytes(alphabet[c] for c in token)
        self.bytes_of = {i: to_bytes(t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.first = np.zeros(256, dtype=np.int64)
        for c, b in alphabet.items():
            self.first[b] = vocab[c]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a] << 20 | vocab[b]] = (rank, vocab[a + b])
        # open addressing, so that a million pairs are looked up at once
        self.bits = 18
        size = 1 << self.bits
        self.keys, self.ranks, self.made = np.full(size, -1, np.int64), np.full(size, NONE, np.int64), np.zeros(size, np.int64)
        for key, (rank, new) in self.merges.items():
            at = int(self._slot(np.array([key], dtype=np.int64))[0])
            while self.keys[at] >= 0:
                at = (at + 1) & (size - 1)
            self.keys[at], self.ranks[at], self.made[at] = key, rank, new
        self.splitter = regex.compile(PATTERN)
        names = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.table = IdTable(CACHED, self.learn)
        tokens = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.token_bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.token_ends = np.concatenate([[0], np.cumsum(list(map(len, tokens)))])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (NONE: no merge) and merged ids of pairs; an id below 0 pairs with nothing."""
        keys = left << 20 | right
        at, todo = self._slot(keys), np.flatnonzero((left >= 0) & (right >= 0))
        rank, new = np.full(len(keys), NONE, np.int64), np.zeros(len(keys), np.int64)
        while len(todo):
            spot = at[todo]
            held = self.keys[spot]
            hit = held == keys[todo]
            rank[todo[hit]], new[todo[hit]] = self.ranks[spot[hit]], self.made[spot[hit]]
            todo = todo[~hit & (held >= 0)]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        return rank, new

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces of up to SHORT bytes, as little-endian 32-bit integers."""
        ids, stops = self._merge(pieces)
        return [x.tobytes() for x in np.split(ids, stops[:-1])]

    def _merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same one after the other, and where each piece's ids stop."""
        n = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        width = max(2, 1 << int(sizes.max() - 1).bit_length())
        raw = np.frombuffer(b"".join(p.ljust(width, b"\x00") for p in pieces), dtype=np.uint8).reshape(n, width)
        place = np.arange(width)
        ids = np.where(place < sizes[:, None], self.first[raw], -1)
        after = np.where(place + 1 < sizes[:, None], place + 1, width)
        before = np.broadcast_to(place - 1, (n, width)).copy()
        ids = np.concatenate([ids, np.full((n, 1), -1)], axis=1)  # at `width`: nothing
        tree = np.full((n, 2 * width), NONE, dtype=np.int64)
        rank, _ = self._look(ids[:, :-1].ravel(), np.take_along_axis(ids, after, 1).ravel())
        rank = rank.reshape(n, width)
        tree[:, width:] = np.where(rank < NONE, rank * width + place, NONE)
        for k in range(width - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])

        def put(rows, leaf, value):
            node = leaf + width
            tree[rows, node] = value
            while node[0] > 1:  # all leaves are on one level
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            at = tree[rows, 1] % width
            gone = after[rows, at]
            _, new = self._look(ids[rows, at], ids[rows, gone])
            ids[rows, at], ids[rows, gone] = new, -1
            then = after[rows, gone]
            after[rows, at] = then
            inside = then < width
            before[rows[inside], then[inside]] = at[inside]
            put(rows, gone, NONE)
            rank, _ = self._look(new, ids[rows, then])
            put(rows, at, np.where(rank < NONE, rank * width + at, NONE))
            left = before[rows, at]
            has = left >= 0
            if has.any():
                r, x = rows[has], left[has]
                rank, _ = self._look(ids[r, x], new[has])
                put(r, x, np.where(rank < NONE, rank * width + x, NONE))
            rows = rows[tree[rows, 1] < NONE]
        live = ids[:, :width] >= 0
        return ids[:, :width][live].astype("<u4"), np.cumsum(live.sum(axis=1))

    def merge_one(self, piece: bytes) -> bytes:
        """The same for a piece of any length."""
        n = len(piece)
        width = max(2, 1 << (n - 1).bit_length())
        none, merges = int(NONE), self.merges
        ids = [int(self.first[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def leaf(i: int) -> int:
            j = after[i]
            found = merges.get(ids[i] << 20 | ids[j]) if j < n else None
            return found[0] * width + i if found else none

        tree = [none] * (2 * width)
        tree[width : width + n] = [leaf(i) for i in range(n)]
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: int) -> None:
            node = i + width
            tree[node] = value
            while node > 1:
                node >>= 1
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    break
                tree[node] = low

        while tree[1] < none:
            i = tree[1] % width
            j = after[i]
            ids[i] = merges[ids[i] << 20 | ids[j]][1]
            ids[j] = -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            put(j, none)
            put(i, leaf(i))
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
        return np.array([x for x in ids if x >= 0], dtype="<u4").tobytes()

    def learn(self, pieces: list[str]) -> None:
        """Merge new pieces; special tokens' strings, which no split gives otherwise, are those tokens."""
        add = self.table.add
        groups: dict[int, tuple[list[str], list[bytes]]] = {}
        for p in pieces:
            b = p.encode("utf-8", "surrogatepass")
            if p in self.special:
                add([p], np.array([self.special[p]], dtype="<u4"), np.array([1]))
            elif len(b) > SHORT:
                ids = np.frombuffer(self.merge_one(b), dtype="<u4")
                add([p], ids, np.array([len(ids)]))
            else:
                words, raw = groups.setdefault((len(b) - 1).bit_length(), ([], []))
                words.append(p)
                raw.append(b)
        for width, (words, raw) in groups.items():
            step = 1 << max(8, 18 - width)
            for k in range(0, len(raw), step):
                add(words[k : k + step], *self._merge(raw[k : k + step]))

    def split(self, text: str) -> list[str]:
        """Pieces in order; a special token's string is a piece of its own."""
        if not self.specials or not any(s in text for s in self.special):
            return self.splitter.findall(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += self.splitter.findall(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.splitter.findall(text[at:])

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Per text its ids."""
        pieces = [self.split(t or "") for t in texts]
        ids, upto = self.table.look_up(pa.array([p for x in pieces for p in x], pa.string()))
        ends = upto[np.cumsum(list(map(len, pieces)))] if pieces else upto[:0]
        return np.split(ids, ends[:-1]) if pieces else []

    def decode(self, ids: np.ndarray) -> str:
        at, _ = ragged(self.token_ends[ids], self.token_ends[ids + 1] - self.token_ends[ids])
        return self.token_bytes[at].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


def tokenizer_path(name: str = FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _round_trip(path: str | None):
    def run(batches):
        bpe = load(path or tokenizer_path())
        for batch in batches:
            for part in by_bytes(batch):
                found = bpe.encode_all(part.column(1).to_pylist())
                digest = lambda x: hashlib.sha256(x).hexdigest()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(map(len, found), pa.int64()),
                        pa.array([digest(ids) for ids in found], pa.string()),
                        pa.array([digest(bpe.decode(ids).encode("utf-8")) for ids in found], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return run


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256.

    path: a byte-level BPE file in the tokenizers library's format, by default
    the public one. Null and empty texts have no tokens. A special token's
    string in a text is that token. Repeated rows give repeated results, an
    empty table an empty one; null ids stay; other columns aren't carried.
    """
    few = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text"))
    return few.mapInArrow(_round_trip(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
