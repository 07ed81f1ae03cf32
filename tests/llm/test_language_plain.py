"""op1 against expectation-maximisation and choice of languages on plain Python numbers."""

import math
from collections import Counter

import numpy as np

from assaylens.llm import language
from conftest import SMALL


def _buckets(text):
    """Bucket counts of the letter trigrams; any run of other characters is one space."""
    chars = [" "]
    for c in text.lower():
        if c.isalpha() or chars[-1] != " ":
            chars.append(c if c.isalpha() else " ")
    if chars[-1] != " ":
        chars.append(" ")
    found = Counter()
    for a, b, c in zip(chars, chars[1:], chars[2:], strict=False):
        if b != " ":
            x = (ord(a) * 0x9E3779B1 + ord(b) * 0x85EBCA77 + ord(c) * 0xC2B2AE3D) % 2**32
            x = (x ^ (x >> 15)) * 0x2C1B3C6D % 2**32
            found[(x >> 18) % language.FEATURES] += 1
    return found


def _likelihood(counts, p, w):
    return sum(c * math.log(sum(w[j] * p[b][j] for j in w)) for b, c in counts.items())


def _mixture(counts, p, width):
    """Proportions by number; the last number is the background."""
    n = sum(counts.values())
    if not n:
        return {}
    best = max(range(width - 1), key=lambda j: _likelihood(counts, p, {j: 1.0}))
    w, reached = {best: 1.0}, _likelihood(counts, p, {best: 1.0})
    penalty = language.PENALTY * math.log1p(n)
    while len(w) < width:
        mix = {b: sum(w[j] * p[b][j] for j in w) for b in counts}
        gain = {j: sum(c * p[b][j] / mix[b] for b, c in counts.items()) - n for j in range(width) if j not in w}
        new = max(gain, key=gain.get)
        if gain[new] <= penalty:
            break
        tried = {j: 0.8 * w.get(j, 0.0) + 0.2 / (len(w) + 1) for j in [*w, new]}
        for _ in range(language.ROUNDS):
            share = Counter()
            for b, c in counts.items():
                total = sum(tried[j] * p[b][j] for j in tried)
                for j in tried:
                    share[j] += c * tried[j] * p[b][j] / total
            tried = {j: share[j] / n for j in tried}
        now = _likelihood(counts, p, tried)
        if now - reached <= penalty:
            break
        w, reached = tried, now
    return w


def test_against_plain_inference(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = language.training_rows(docs).select("text", "lang").where("text is not null").collect()
    model = language.learn(language.training_rows(docs))
    names = sorted({r["lang"] for r in rows})
    assert model.languages == tuple(names)
    counts = {lang: Counter() for lang in names}
    for r in rows:
        counts[r["lang"]] += _buckets(r["text"])
    for j, lang in enumerate(names):
        column = np.array([counts[lang][b] + 0.5 for b in range(language.FEATURES)])
        assert np.allclose(model.prob[:, j], column / column.sum(), rtol=1e-5)
    p = model.prob.astype(float).tolist()
    pick = {lang: next(r["text"] for r in rows if r["lang"] == lang and 1500 < len(r["text"]) < 6000) for lang in names}
    texts = list(pick.values())
    texts += [pick[a][:1200] + "\n" + pick[b][: 200 * k] for k, (a, b) in enumerate(zip(names, names[1:] + names[:1], strict=True), 1)]
    texts += [" ".join(t[:900] for t in pick.values()), pick[names[0]][:800] + "日本語の文章 " * 60]
    texts += ["", "12 34 !", "a", "日本語 漢字", "é" * 40, "ab\u0000cd", *(r["text"] for r in rows[:20])]
    shares, totals = language.infer(texts, model)
    sets = set()
    for text, got, n in zip(texts, shares, totals, strict=True):
        buckets = _buckets(text)
        w = _mixture(buckets, p, len(names) + 1)
        assert n == sum(buckets.values())
        assert set(np.flatnonzero(got)) == {j for j, x in w.items() if x}
        assert np.allclose(got, [w.get(j, 0.0) for j in range(len(names) + 1)], atol=1e-4)
        sets.add(tuple(sorted(w)))
    assert max(map(len, sets)) >= 2 and () in sets
