"""Divergence audit and license scan against brute force, on texts with nulls, copies, ties and clashing columns."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from canvass.llm import divergence, license_scan

SCHEMA = "doc_id long, text string, lang string, source string, term string, place int, words string, label string"


def odd_docs():
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("ab", "Cé", "Zß", "q", "ÀK") for b in ("x", "Y", "é", "ss", "tt", "中")]
    rows = [(0, None, None, None), (1, "", "en", ""), (2, "1 2 3 --", "xx", "only"), (3, "İstanbul K k K", "en", "s0"), (4, "rare words here", "yy", "a"), (5, "none", "yy", "b")]
    for i in range(6, 120):
        source = rng.choice(["s0", "s0", "s0", "s1", "s2", None, "ÿ", "é"])
        text = " ".join(rng.choice(words[: rng.choice([3, 9, 30])]) + rng.choice(["", ".", "1", "-b"]) for _ in range(rng.randint(0, 40)))
        rows.append((i, text, rng.choice(["en", "de", None]), source))
    rows.append((200, "word " * 30_000 + "abx", "en", "s1"))
    return [(*r, "t", 1, "w", "l") for r in rows + rows[::9]]


def audited(rows, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        in_docs, whole = Counter(t for d in own for t in set(d[2])), Counter(t for d in own for t in d[2])
        kept = [t for t in in_docs if in_docs[t] >= 3]
        count = {s: Counter(t for d in own if d[1] == s for t in d[2] if in_docs[t] >= 3) for s in {d[1] for d in own}}
        share = lambda n, total: 1 + 10**9 * (n + 1) // (total + len(kept))  # noqa: E731, B023
        q = {t: share(whole[t], sum(whole[x] for x in kept)) for t in kept}
        p = {s: {t: share(c[t], sum(c.values())) for t in kept} for s, c in count.items()}
        far = lambda a, b: (a - b) ** 2 // b
        for s in count:
            parts = {
                "pair": [(o, sum(far(p[s][t], p[o][t]) for t in kept)) for o in count if o != s],
                "term": [(t, far(p[s][t], q[t])) for t in kept if count[s][t] and p[s][t] > q[t]],
            }
            for part, found in parts.items():
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"BAND_ROWS": 7, "LOT_ROWS": 9, "SOURCE_BLOCK": 2, "HELD_TERMS": 20, "CELLS": 16}])
def test_divergence_equals_brute_force(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(divergence, name, value)
    docs = spark.createDataFrame(odd_docs(), SCHEMA).repartition(3)
    got = sorted(map(tuple, divergence.divergence_report(docs).collect()))
    assert got == audited(odd_docs(), 200)


def test_few_leading_terms(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BAND_ROWS", 5)
    rng = random.Random(1)
    rows = [("en", f"s{i % 2}", f"t{i:03d}".encode(), rng.randint(1, 4), rng.randint(4, 9)) for i in range(120)]
    facts = spark.createDataFrame([(*r, 1000 * r[3] + 3000, 300 * r[4]) for r in rows], "lang string, source string, term binary, n long, lang_n long, p long, q long")
    got = [(r.source, bytes(r.term), r["rank"]) for r in divergence.leading_terms(facts, 3).collect()]
    want = []
    for s in ("s0", "s1"):
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (-((1000 * r[3] + 3000 - 300 * r[4]) ** 2 // (300 * r[4])), r[2]))
        want += [(s, r[2], k + 1) for k, r in enumerate(own[:3])]
    assert sorted(got) == sorted(want)


def test_skyband_equals_counting():
    rng = np.random.default_rng(2)
    for n, k in ((0, 1), (1, 1), (300, 4), (900, 40)):
        group, lang, place = rng.integers(1, 6, n), rng.integers(1, 9, n), rng.permutation(n)
        by = np.array([((group >= group[i]) & (lang <= lang[i]) & (place <= place[i])).sum() - 1 for i in range(n)])
        assert sorted(divergence.skyband(group, lang, place, k)) == list(np.flatnonzero(by < k))


def test_divergence_without_rows(spark):
    assert divergence.divergence_report(spark.createDataFrame([], SCHEMA)).collect() == []


TEMPLATES = (
    license_scan.Template("short", "Alpha beta, GAMMA 4.0", 1.0),
    license_scan.Template("long", "one two three four five six seven eight nine ten one two eleven twelve"),
    license_scan.Template("other", "one two thirteen", 0.6),
    license_scan.Template("none", "unseen words only"),
)


def licensed_docs():
    rng = random.Random(4)
    long = license_scan.TEMPLATES[4].text
    texts = [None, "", "...", "Licensed under the Apache License, MIT LICENSE cc-by CC BY", "mit licensé", "mitK license K", "x" * 100_000, "gnu general public license " * 3000]
    texts += [long, "a b c " * 900 + long + " d e f" * 900, "Alpha beta gamma 4 0", "alpha beta gamma 40", "a l p h a"]
    words = [w for t in TEMPLATES for w in t.words] + ["x", "y", "the"]
    for _ in range(120):
        texts.append(" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))))
        base = rng.choice(TEMPLATES).words
        texts.append("pre " * rng.randint(0, 40) + " ".join(w for w in base if rng.random() < 0.85) + " post" * rng.randint(0, 40))
    rows = [(i // 2 if i % 5 else None, t) for i, t in enumerate(texts)]
    return [(*r, "en", "s", "t", 1, "w", "l") for r in rows + rows[::7]]


def scanned(text, templates):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    places = [(i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    best, labels = 0.0, {label for _, label in places}
    base = ",".join(sorted(labels))
    for t in templates:
        for at in range(0, len(words), t.step):
            share = len(set(words[at : at + 2 * t.step]) & set(t.words))
            if share >= t.need:
                labels.add(t.label)
                best = max(best, share / len(set(t.words)))
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), base, ",".join(sorted(labels)), 1.0 if at else best


@pytest.mark.parametrize("templates", [license_scan.TEMPLATES, TEMPLATES, ()])
def test_licenses_equal_brute_force(spark, templates):
    rows = licensed_docs()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    report = license_scan.license_report(docs, templates)
    got = sorted(map(repr, (tuple(r) for r in report.collect())))
    assert got == sorted(repr((doc, *scanned(text, templates))) for doc, text, *_ in rows)
    assert "Python" not in report._jdf.queryExecution().executedPlan().toString()
    assert license_scan.license_report(docs.limit(0), templates).collect() == []


def test_blocks_are_told_once(spark):
    docs = spark.createDataFrame(licensed_docs()[:60], SCHEMA).dropDuplicates(["doc_id", "text"])
    rows = license_scan.find_blocks(docs, TEMPLATES).collect()
    assert rows and len(rows) == len(set(rows))
    assert all(r.containment >= next(t for t in TEMPLATES if t.label == r.label).need / 15 for r in rows)
