"""Added spans of op2 on planted texts."""

import random
import re
from collections import Counter

import brute
import pytest

from assaylens.llm import exact, private

AFTER = ["or write", "and more", ", then wait", ". Ask again", "if lost", "before noon", "at once", "to order"]


@pytest.fixture
def added(spark, tmp_path):
    """Added spans of each text, as text."""

    def run(texts):
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "d"))
        docs = exact.with_row(spark.read.parquet(str(tmp_path / "d")))
        found = {r["doc_id"]: r for r in private.spans(docs).collect()}
        return [[t[s["start"] : s["end"]] for s in sorted(found[i]["added"], key=lambda s: s["start"])] for i, t in enumerate(texts)]

    return run


def test_one_sided_contexts(added):
    """A strong word on one side is enough, whatever stands on the other."""
    rng = random.Random(5)
    # each word after a phone also follows plain numbers, far more often
    texts = [f"item {n} {rng.choice(AFTER)}" for n in range(400)]
    texts += [f"dial +1 (555) 010-{1000 + i} {rng.choice(AFTER)}" for i in range(60)]
    first = len(texts)
    planted = [f"dial 555-867-{5300 + i} {AFTER[i % len(AFTER)]}" for i in range(16)]
    planted += ["of 7654321 or write", "item 7654322, then wait", "dial 99 or write"]
    got = added(texts + planted)
    assert got[first:] == [[f"555-867-{5300 + i}"] for i in range(16)] + [[], [], []]
    assert not any(got[:first])


def test_mixed_mentions(added):
    """A value that mostly stands in ordinary contexts is none, even where the context is strong."""
    texts = [f"dial +1 (555) 010-{1000 + i} {AFTER[i % 8]}" for i in range(60)]
    texts += [f"item {n} {AFTER[n % 8]}" for n in range(400)]
    first = len(texts)
    got = added(texts + ["dial 5558675309 or write"] + ["item 5558675309 and more"] * 3)
    assert got[first:] == [[], [], [], []]


def _plain(texts):
    """The bootstrap in plain Python: added spans of each text, as text."""
    loose = {k: re.compile(f"(?:{v})", re.ASCII) for k, v in private.LOOSE.items()}
    token = re.compile(r"(?<![A-Za-z0-9@._%+-])[A-Za-z0-9@._%+-]+")
    run = r"[0-9]++(?![.-]*[A-Za-z@_%+])"
    group = re.compile(rf"(?<![A-Za-z0-9@_%])[+(]{{0,2}}{run}(?:[ ().-]++{run})++")
    mentions = []  # (text, start, end, kind or None, value, patterns)
    for i, text in enumerate(texts):
        base = [(int(a), int(b), k) for k, a, b in (x.split(":") for x in brute.base_spans(text).split(",") if x)]
        free = list(text)
        for a, b, _ in base:
            free[a:b] = "\0" * (b - a)
        fits = lambda a, b, text=text: any(p.fullmatch(text[a:b]) for p in loose.values())
        groups = {m.span() for m in group.finditer("".join(free)) if fits(*m.span())}
        tokens = {(m.start(), m.start() + len(m[0].rstrip("._%+-"))) for m in token.finditer(text) if re.search("[0-9@]", m[0])}
        tokens = {(a, b) for a, b in tokens if not any(x < b and a < y for x, y, _ in base)}
        tokens = {(a, b) for a, b in tokens if fits(a, b) or not any(x <= a and b <= y for x, y in groups)}
        for a, b, kind in base + [(a, b, None) for a, b in tokens | groups]:
            left = re.search(r"(?<!\S)(\S+)\s*$", text[:a], re.ASCII)
            right = re.match(r"\s*(\S+)", text[b:], re.ASCII)
            patterns = [side + m[1].lower() for side, m in (("<", left), (">", right)) if m]
            mentions.append((i, a, b, kind, text[a:b].lower(), patterns))
    seeds = {(m[4], m[3]) for m in mentions if m[3] and m[5]}
    seeded, sure = {v for v, _ in seeds}, {}
    score, before = dict.fromkeys(seeds, 1000), None
    while score != before:
        total, known = Counter(), Counter()
        for *_, value, patterns in mentions:
            for p in patterns:
                total[p] += 1
                for k in private.KINDS:
                    known[p, k] += score.get((value, k), 0)
        sure = {(p, k): n // (total[p] + private.PRIOR) for (p, k), n in known.items()}
        seen, found = Counter(), Counter()
        for *_, kind, value, patterns in mentions:
            if patterns and kind is None and value not in seeded:
                seen[value] += 1
                for k in private.KINDS:
                    found[value, k] += max(sure[p, k] for p in patterns)
        before, score = score, dict.fromkeys(seeds, 1000) | {(v, k): n // seen[v] for (v, k), n in found.items() if n // seen[v] >= private.LIKELY}
    out = [[] for _ in texts]
    for i, a, b, kind, value, patterns in mentions:
        if kind is None and any(p.fullmatch(value) and score.get((value, k), 0) >= private.CONFIDENT and any(sure[x, k] >= private.CONFIDENT for x in patterns) for k, p in loose.items()):
            out[i].append((a, b))
    return [[text[a:b] for a, b in sorted(spans) if not any((x, y) != (a, b) and x <= a and b <= y for x, y in spans)] for text, spans in zip(texts, out)]


def test_spaced_spellings(added):
    """Phones and failing cards in the usual spellings with blanks and parentheses; all as the plain version."""
    rng = random.Random(6)
    texts = [f"item {n} {rng.choice(AFTER)}" for n in range(200)]
    texts += [f"dial +1 (555) 010-{1000 + i} {rng.choice(AFTER)}" for i in range(80)]
    texts += [f"visa 4111 1111 1111 1111 {rng.choice(AFTER)}" for i in range(80)]
    texts += ["no.1234567 89 or write", "dial a1234567 22 33 and 5", "version 1.2.3 4.5 b", "1 " * 400, "dial +1 (555) 010-1000 (555) 867-5310 x", "item 12 555-867-5311 or write"]
    first = len(texts)
    planted = ["(555) 867-5309", "555 867 5308", "555.867 5307", "(0555)-867 53 06", "555-867-5305"]
    cards = ["4111 1111 1111 1112", "4111-1111 1111-1113"]
    texts += [f"dial {x} {AFTER[i]}" for i, x in enumerate(planted)] + [f"visa {x} {AFTER[i]}" for i, x in enumerate(cards)]
    got = added(texts)
    assert got[first:] == [[x] for x in planted + cards]
    assert got == _plain(texts)


def test_until_nothing_changes(added):
    """Numbers known only through numbers that are themselves known only through others."""
    texts = [f"dial +1 (555) 010-{1000 + i} x{i}y" for i in range(300)]
    first = len(texts)
    texts += [f"dial 555-867-{1000 + i} beta" for i in range(100)]
    texts += [f"gamma 555-868-{1000 + i} beta" for i in range(30)]
    texts += [f"gamma 555-869-{1000 + i} delta" for i in range(12)]
    got = added(texts)
    assert got == _plain(texts)
    assert all(len(g) == 1 for g in got[first:]) and not any(got[:first])


def test_few_seeds_among_many(added):
    """Unknown numbers under a word with few seeds don't vouch for each other."""
    texts = [f"item +1 (555) 010-{1000 + i} x{i}y" for i in range(30)]
    texts += [f"item 555-{1000 + i}-1 z{i}y" for i in range(300)]
    assert added(texts) == _plain(texts) == [[]] * len(texts)


def test_long_neighbours(added):
    """Neighbours of 200 and 20,000 characters and runs of 200 blanks: whole words count, not their ends."""
    long, other = "w" * 200, "v" * 136 + "w" * 64
    far, near = "ü" * 20_000, "ü" * 19_999
    gap = " " * 200
    texts = []
    for word in (long, far):
        texts += [f"{word} +1 (555) 010-{1000 + i} x{i}y" for i in range(40)]
    texts += [f"call{gap}+1 (555) 020-{1000 + i}{gap}x{i}y" for i in range(40)]
    first = len(texts)
    texts += [f"{long} 555-867-5309", f"{other} 555-867-5308", f"{far} 555-867-5307", f"{near} 555-867-5306", f"call{gap}555-867-5305{gap}z"]
    got = added(texts)
    assert got[first:] == [["555-867-5309"], [], ["555-867-5307"], [], ["555-867-5305"]]
    assert got == _plain(texts)
