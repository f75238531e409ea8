"""The licence scan's method by brute force on small alphabets, and on whole licence texts with changed words."""

import itertools
import random

from ledgerline.llm import license_scan
from ledgerline.llm.license_texts import TEMPLATES


def naive_runs(words, templates, least):
    """Maximal runs of words that some template holds: not within a longer one that ends later or begins earlier."""
    inside = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    longest = []
    for end in range(len(words)):
        longest.append(max((n for n in range(1, end + 2) if tuple(words[end - n + 1 : end + 1]) in inside), default=0))
    # a run is maximal if the next word doesn't extend it
    return [(e, n) for e, n in enumerate(longest) if n >= least and (e + 1 == len(words) or longest[e + 1] != n + 1)]


def naive_spans(words, templates, labels, scanner):
    spans = []
    for k, t in enumerate(templates):
        pieces = []
        for end, n in naive_runs(words, templates, scanner.min_run):
            run = words[end - n + 1 : end + 1]
            pieces += [(end - n + 1, end, i, i + n - 1) for i in range(len(t) - n + 1) if t[i : i + n] == run]
        clusters = []
        for p in sorted(pieces):
            reach = max((q[1] for q in clusters[-1]), default=-1) if clusters else -1
            if clusters and (p[0] <= reach or (p[0] <= reach + scanner.max_gap + 1 and p[2] > clusters[-1][0][2])):
                clusters[-1].append(p)
            else:
                clusters.append([p])
        for c in clusters:
            best = max(
                sum(e - b + 1 for _, _, b, e in chain)
                for n in range(1, len(c) + 1)
                for chain in itertools.combinations(c, n)
                if all(x[3] < y[2] for x, y in zip(chain, chain[1:], strict=False))
            )
            if best >= scanner.min_cover * len(t):
                spans.append((labels[k], best / len(t)))
    return sorted(spans)


def test_chains_by_brute_force(monkeypatch):
    monkeypatch.setattr(license_scan.LicenseScanner, "_settled", staticmethod(lambda spans: spans))
    rng = random.Random(7)
    met = 0
    for _ in range(250):
        templates = [(f"L{k}", " ".join(rng.choices("abcd", k=rng.randint(4, 9)))) for k in range(3)]
        scanner = license_scan.LicenseScanner(templates, (), min_run=2, max_gap=2, min_cover=0.7)
        parts = [t.split() if rng.random() < 0.5 else rng.choices("abcdx", k=rng.randint(1, 4)) for _, t in rng.choices(templates, k=3)]
        words = [w for p in parts for w in p if rng.random() > 0.08]
        if len(naive_runs(words, [t.split() for _, t in templates], 2)) > 7:
            continue
        got = scanner.scan(" ".join(words))
        want = naive_spans(words, [t.split() for _, t in templates], [x for x, _ in templates], scanner)
        assert sorted((s["label"], s["coverage"]) for s in got["spans"]) == want
        assert got["score"] == max([0.0, *(c for _, c in want)]) and got["labels"] == ",".join(sorted({x for x, _ in want}))
        met += len(want) > 0
    assert met > 60


def test_whole_texts_with_changed_words():
    """Every template is found in running text with a word in forty changed, under its own label."""
    rng = random.Random(9)
    scanner = license_scan.default_scanner()
    for label, text in TEMPLATES:
        words = text.split()
        if len(words) < 40:
            assert label in scanner.scan(f"Filler before. {text.title()}! Filler after.")["labels"].split(",")
            continue
        changed = [w if i % 40 else "Acme" + rng.choice("xyz") for i, w in enumerate(words, 1)]
        got = scanner.scan("some words " * 5 + " ".join(changed).upper() + " some words" * 5)
        assert label in got["labels"].split(",")
        span = max((s for s in got["spans"] if s["label"] == label), key=lambda s: s["last"] - s["first"])
        assert span["coverage"] > 0.75 and span["first"] <= 12 and span["last"] >= 10 + len(words) - 6
    assert scanner.scan(" ".join(["the software is provided as is", "for any purpose", "in the public domain of letters"] * 3))["labels"] == ""
