"""Plain versions of the operators, on rows in the driver."""

import hashlib
import math
import re
from collections import Counter

import numpy as np

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
    return True


def base_spans(text):
    found = []
    for order, (kind, form) in enumerate(FORMS.items()):
        found += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(form, text or "") if _valid(kind, m[0])]
    return ",".join(x[2] for x in sorted(found))


def squeezed(text):
    return re.sub(r"[\x20\x09-\x0D]+", "", text or "")


def shingles(text, size):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def near(texts, size, percent):
    """Component number of each text, the place of its first member."""
    sets = [shingles(t, size) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label, [len(s) for s in sets]


def repeats(docs, least=50):
    """(bytes, removed bytes, removed runs, digest of the rest) of each (key, text); null keys are last."""
    key = [math.inf if d is None else d for d, _ in docs]
    data = [(t or "").encode() for _, t in docs]
    first = {}
    for k, b in zip(key, data):
        for i in range(len(b) - least + 1):
            s = b[i : i + least]
            first[s] = min(first.get(s, math.inf), k)
    out = []
    for k, b in zip(key, data):
        mask = np.zeros(len(b), bool)
        for i in range(len(b) - least + 1):
            if first[b[i : i + least]] < k:
                mask[i : i + least] = True
        runs = int((np.diff(mask.astype(int), prepend=0) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~mask])
        out.append((len(b), int(mask.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def bm25(docs, queries, k):
    bags = [(d, Counter(re.findall(r"\w+", t.lower()))) for d, t in docs if d is not None and t is not None]
    n, mean = len(bags), sum(b.total() for _, b in bags) / len(bags)
    df = Counter(t for _, b in bags for t in b)
    out = {}
    for q, text in queries:
        asked = Counter(re.findall(r"\w+", text.lower()))
        scores = []
        for d, b in bags:
            s = sum(c * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * b.total() / mean)) for t, c in asked.items() if t in b)
            if round(s, 6) > 0:
                scores.append((-round(s, 6), d))
        out[q] = [d for _, d in sorted(scores)[:k]]
    return out
