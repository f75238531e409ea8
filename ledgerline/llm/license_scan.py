"""Licence scan: a generalised suffix automaton over the words of licence
templates. A text is streamed through it once; at each word the automaton gives
the longest run of words, ending there, that some template holds (matching
statistics). Long runs are chained, in text and template order, into spans that
cover a template."""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column
from .license_texts import TEMPLATES

#: The phrases whose every place counts, and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label:string,first:long,last:long,coverage:double>>"
)

_TO_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words; separators are the ASCII characters other than letters and digits."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class SuffixAutomaton:
    """Of several word sequences at once; `ends` lists where each state's runs end."""

    def __init__(self, sequences: list[list[bytes]]) -> None:
        self.go: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for k, words in enumerate(sequences):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w)
                self.ends[last].append((k, i))
        for s in sorted(range(1, len(self.go)), key=lambda s: -self.length[s]):
            if self.link[s] > 0:
                self.ends[self.link[s]] += self.ends[s]

    def _state(self, go: dict[bytes, int], link: int, length: int) -> int:
        self.go.append(go)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.go) - 1

    def _split(self, p: int, q: int, w: bytes) -> int:
        """The state for the runs of q that p's runs and w make; q itself if it holds no longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(dict(self.go[q]), self.link[q], self.length[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.go[p].get(w) == q:
            self.go[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: bytes) -> int:
        if (q := self.go[last].get(w)) is not None:
            return self._split(last, q, w)
        new = self._state({}, 0, self.length[last] + 1)
        p = last
        while p >= 0 and w not in self.go[p]:
            self.go[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.go[p][w], w)
        return new

    def state_of(self, words: list[bytes]) -> int:
        s = 0
        for w in words:
            s = self.go[s][w]
        return s


class LicenseScanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES, min_run: int = 3, max_gap: int = 6, min_cover: float = 0.75) -> None:
        self.labels = [x for x, _ in templates] + [x for _, x in phrases]
        texts = [words_of(x) for _, x in templates] + [words_of(x) for x, _ in phrases]
        self.sizes = [len(x) for x in texts]
        self.n_templates, self.min_run, self.max_gap, self.min_cover = len(templates), min_run, max_gap, min_cover
        self.sam = sam = SuffixAutomaton(texts)
        own = {sam.state_of(words_of(x)): (len(words_of(x)), label) for x, label in phrases}
        # phrases that end wherever a state's run does: the state's own, if the run is long enough, and those up its links
        self.found: list[list[tuple[int, str]]] = [[] for _ in sam.go]
        for s in range(1, len(sam.go)):
            p = s
            while p > 0:
                if p in own:
                    self.found[s].append(own[p])
                p = sam.link[p]

    def scan(self, text: str | None) -> dict:
        """Matching statistics of the text, then phrase places and covered template spans."""
        words = words_of(text)
        go, link, length, found = self.sam.go, self.sam.link, self.sam.length, self.found
        root = go[0]
        state = run = 0
        places: list[tuple[int, str]] = []
        runs: list[tuple[int, int, int]] = []  # maximal runs: last word, words, state
        for i, w in enumerate(words):
            if not state:
                if w in root:
                    state, run = root[w], 1
                continue
            to = go[state].get(w)
            if to is None:
                if run >= self.min_run:
                    runs.append((i - 1, run, state))
                while state and to is None:
                    state = link[state]
                    run = length[state]
                    to = go[state].get(w)
                if to is None:
                    state = run = 0
                    continue
            state = to
            run += 1
            for n, label in found[state]:
                if n <= run:
                    places.append((i - n + 1, label))
        if run >= self.min_run:
            runs.append((len(words) - 1, run, state))
        spans = self.chains(runs)
        base = sorted({x for _, x in places})
        starts = [x for x, _ in places]
        return {
            "n_words": len(words),
            "n_base": len(places),
            "first_word": min(starts, default=None),
            "last_word": max(starts, default=None),
            "base_labels": ",".join(base),
            "labels": ",".join(sorted({*base, *(x["label"] for x in spans)})),
            "score": max([1.0 * bool(places), *(x["coverage"] for x in spans)]),
            "spans": spans,
        }

    def chains(self, runs: list[tuple[int, int, int]]) -> list[dict]:
        """Runs that follow each other in a template and, at most max_gap words
        apart, in the text; a span where they cover min_cover of the template."""
        by: dict[int, list[tuple[int, int, int, int]]] = {}
        for last, n, state in runs:
            for k, end in self.sam.ends[state]:
                if k < self.n_templates:
                    by.setdefault(k, []).append((last - n + 1, last, end - n + 1, end))
        spans = []
        for k, pieces in by.items():
            for cluster in self._clusters(pieces):
                covered, first, last = self._best(cluster)
                if covered >= self.min_cover * self.sizes[k]:
                    spans.append({"label": self.labels[k], "first": first, "last": last, "coverage": covered / self.sizes[k]})
        return self._settled(spans)

    @staticmethod
    def _settled(spans: list[dict]) -> list[dict]:
        """Of spans that overlap, those that cover their template best (sibling
        licences share most of their words); of one label, the first of equals."""
        kept: list[dict] = []
        now: list[dict] = []
        for x in sorted(spans, key=lambda x: (x["first"], -x["coverage"], -x["last"], x["label"])):
            if now and x["first"] > max(y["last"] for y in now):
                kept, now = kept + now, []
            if any(y["coverage"] > x["coverage"] or y["coverage"] == x["coverage"] and y["label"] == x["label"] for y in now if y["last"] >= x["first"]):
                continue
            now = [y for y in now if y["coverage"] >= x["coverage"] or y["last"] < x["first"]] + [x]
        return sorted(kept + now, key=lambda x: (x["first"], x["last"], x["label"]))

    def _clusters(self, pieces):
        """Cut where the text leaves a gap, or where the template begins anew."""
        now: list = []
        reach = -1
        for p in sorted(pieces):
            if now and p[0] > reach and (p[0] > reach + self.max_gap + 1 or p[2] <= now[0][2]):
                yield now
                now = []
                reach = -1
            now.append(p)
            reach = max(reach, p[1])
        if now:
            yield now

    @staticmethod
    def _best(cluster):
        """The chain that covers most template words: best chain by template end, kept as a rising front."""
        ends, tops = [-1], [(0, None, None)]  # a chain ending at or before ends[i] covers tops[i][0]
        for first, last, begin, end in cluster:
            i = bisect_right(ends, begin - 1) - 1
            covered, from_, _ = tops[i]
            total = (covered + end - begin + 1, first if from_ is None else from_, last)
            at = bisect_right(ends, end)
            if tops[at - 1][0] >= total[0]:
                continue
            ends.insert(at, end)
            tops.insert(at, total)
            while at + 1 < len(tops) and tops[at + 1][0] <= total[0]:
                del ends[at + 1], tops[at + 1]
        return tops[-1]


@lru_cache(maxsize=1)
def default_scanner() -> LicenseScanner:
    return LicenseScanner()


def _scan(batches):
    scanner = default_scanner()
    kinds = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
        ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("coverage", pa.float64())]))),
    ])
    for batch in batches:
        rows = [{"doc_id": k.as_py()} | scanner.scan(t.as_py()) for k, t in zip(batch.column(0), batch.column(1), strict=True)]
        yield pa.RecordBatch.from_pylist(rows, schema=kinds)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: phrase places, labels and covered template spans.

    A null or empty text has no words, no labels and score 0. Repeated rows give
    repeated results; an empty table gives an empty one; a null id stays null.
    Other columns, whatever their names, aren't carried. The whole of a text is
    streamed, however long; no shuffle.
    """
    return docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text")).mapInArrow(_scan, SCHEMA)
