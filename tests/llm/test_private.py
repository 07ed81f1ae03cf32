import hashlib

import brute
from conftest import SMALL

from assaylens.llm import exact, private
from assaylens.llm.queries import QUERIES
from odd_tables import empty, odd, odd_rows, tables  # noqa: F401


def _check(found, texts):
    for r in found:
        base = brute.base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))
        for kind in brute.FORMS:
            assert r[f"n_{kind}"] == base.count(f"{kind}:")


def test_base_spans(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    _check(QUERIES["op2_context_bootstrap"](spark, SMALL).collect(), texts)


def test_odd_rows(spark, tables, odd):
    found = QUERIES["op2_context_bootstrap"](spark, tables["odd"]).collect()
    assert len(found) == odd.count()
    _check([r for r in found if r["doc_id"] is not None], {r["doc_id"]: r["text"] for r in odd.collect()})
    assert QUERIES["op2_context_bootstrap"](spark, tables["empty"]).count() == 0


def test_hard_forms(spark, tmp_path):
    texts = ["a@b.c_d@e.f", "x@y", "1.2.3.4.5.6.7.8", "0001.2.3.255", "256.1.1.1", "+1+234567890", "+12345678901234567", "1-1-1-1", "a..b@c-d.e-f.g", "é@x.yz ü+49 (30) 1234567", "@" * 50, "1 " * 400]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    _check(QUERIES["op2_context_bootstrap"](spark, str(tmp_path)).collect(), dict(enumerate(texts)))


def test_contexts_discover(spark, tmp_path):
    """Numbers in the context of known phones are added; those in a mixed context are not."""
    rows = [f"please dial +1 (555) 010-{1000 + i} today" for i in range(20)]
    rows += ["please dial 555-867-5309 today", "chapter 1234567 of 99 books", "the value 7654321 stays"]
    rows += [f"the value {i} stays" for i in range(30)]
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    found = {r["doc_id"]: r for r in private.report(private.spans(exact.with_row(docs))).collect()}
    assert found[20]["spans"] == "phone:12:24" and found[20]["n_added"] == 1
    assert all(found[i]["n_added"] == 0 for i in found if i != 20)
    masked = {r["doc_id"]: r["text"] for r in private.mask(docs).collect()}
    assert masked[0] == "please dial [PHONE] today" and masked[20] == masked[0] and masked[21] == rows[21]


def test_mask_keeps_columns(odd, empty):
    got = private.mask(odd)
    assert got.columns == odd.columns and got.count() == odd.count() and private.mask(empty).count() == 0
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[17]["text"] == "mail [EMAIL] or [IP], call [PHONE] now" and by[17]["n_chars"] == len(by[17]["text"])
    assert by[18]["text"].startswith("[CARD] is a card, 4111111111111112 is none") and by[7]["text"] is None
    assert [r["_spans"] for r in got.orderBy("doc_id").collect()] == [r["_spans"] for r in odd.orderBy("doc_id").collect()]
