import random
import re
import sys
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from assaylens.llm import audit
from assaylens.llm.queries import QUERIES
from odd_tables import empty, odd, odd_rows, tables  # noqa: F401


def _plain(rows, least=3, ranks=200):
    """All rows of the audit from dense tables of counts."""
    groups, df, n = defaultdict(Counter), defaultdict(Counter), 10**9
    for text, lang, source in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        groups[lang or "", source or ""].update(terms)
        df[lang or ""].update(set(terms))
    out = []
    for lang in df:
        kept = [t for t, d in df[lang].items() if d >= least]
        own = {s: c for (lg, s), c in groups.items() if lg == lang}
        whole = sum(own.values(), Counter())

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + n * (c[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in own.items()}, shares(whole)
        for s in own:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in own if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(ordered, 1)]
    return sorted(out)


def _got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def _rows(df):
    return [(r["text"], r["lang"], r["source"]) for r in df.collect()]


@pytest.mark.parametrize("block", [audit.BLOCK, 20])
def test_odd_rows(spark, odd, block, monkeypatch):
    """Also with runs of a few postings, merged a few at a time."""
    if block == 20:
        monkeypatch.setattr(audit, "SPILL", 7)
        monkeypatch.setattr(audit, "HEAP", 30)
        monkeypatch.setattr(audit, "SUMS", 0)
    for least in (1, 3, 50):
        assert _got(audit.audit(odd, least, 200, block)) == _plain(_rows(odd), least)


def test_many_sources_and_a_hot_one(spark):
    random.seed(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["été", "straße", "日本"]
    rows = []
    for i in range(600):
        source = "hot" if i % 3 == 0 else f"s{i % 17}"
        text = " ".join(random.choice(words[: 20 + 7 * (i % 17)]) for _ in range(random.randrange(0, 30)))
        rows.append((text if i % 50 else None, random.choice(["en", "de", None]), source if i % 41 else None))
    rows += [("", "xx", "alone"), (None, "yy", "a"), ("?", "yy", "b")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "'k' term", "1 n", "2 nr", "3 shard")
    assert _got(audit.audit(df.repartition(7), 3, 15)) == _plain(rows, 3, 15)


def test_types_and_empty(spark, tables, odd, empty):
    assert audit.audit(empty).count() == 0
    assert QUERIES["op13_block_index_audit"](spark, tables["empty"]).count() == 0
    got = dict(audit.audit(odd).dtypes)
    assert got == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}


def test_large_counts_stay_exact(spark):
    n = F.lit(3 * 10**10).cast("long")
    row = spark.range(1).select(audit.probability(n, n + 5, F.lit(7).cast("long")).alias("p"), audit.divergence(n - n + 10**9, n - n + 1).alias("f")).first()
    assert row["p"] == 1 + 10**9 * (3 * 10**10 + 1) // (3 * 10**10 + 12) and row["f"] == (10**9 - 1) ** 2


def test_runs_stay_arrays(monkeypatch):
    """A posting passed as a Python object each, in the spilled block and in the merge, took most of the time."""
    monkeypatch.setattr(audit, "SPILL", 50)
    monkeypatch.setattr(audit, "HEAP", 300)
    rng, block, want = random.Random(3), {}, {}
    for group in (("", ""), ("de", "a"), ("de", "ä")):
        terms = [rng.choice("abcdé€z") * rng.randint(1, 60) for _ in range(2_000)]
        block[group] = (Counter(t.encode() for t in terms), Counter({t.encode(): 1 for t in terms}))
        want |= {(t.decode(), *group): (2 * n, 2) for t, n in block[group][0].items()} | {("", *group): (0, 0)}
    calls = Counter()

    def count(frame, event, arg):
        if event == "c_call":
            calls[arg.__name__] += 1

    sys.setprofile(count)
    try:
        runs = [list(audit._spilled(block, 3)) for _ in range(2)]
        rows = list(audit._merged(iter(r for run in runs for r in run)))
    finally:
        sys.setprofile(None)
    assert {r.schema.names[0] for run in runs for r in run} == {"shard"} and all(r.column("shard")[0].as_py() < 3 for run in runs for r in run)
    assert calls["append"] < 1_000
    told = [(r["term"], r["lang"], r["source"], r["n"], r["df"]) for b in rows for r in b.to_pylist()]
    assert len(told) == len(want) and {t[:3]: t[3:] for t in told} == want
