import numpy as np

from assaylens.llm import language
from assaylens.llm.queries import QUERIES
from conftest import SMALL
from odd_tables import empty, odd, odd_rows, tables  # noqa: F401


def test_held_out_accuracy(spark):
    found = QUERIES["op1_language_mixture"](spark, SMALL).toPandas().set_index("doc_id")
    lang = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id")["lang"]
    held = found[found["held_out"]]
    assert len(held) > 20 and (held["lang_pred"] == lang[held.index]).mean() >= 0.98
    assert found["score"].between(0, 1).all()


def test_proportions_of_a_mixed_text(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language.learn(docs)
    en, de = (docs.where(f"lang = '{x}' and length(text) between 3000 and 4000").first()["text"] for x in ("en", "de"))
    shares, _ = language.infer([en[:3000] + " " + de[:1000], "日本語" * 50], model)
    by = dict(zip(model.languages, shares[0], strict=False))
    assert 0.6 < by["en"] < 0.9 and 0.1 < by["de"] < 0.4
    assert shares[1, -1] > 0.5  # no learned language has such letters
    assert np.allclose(shares.sum(axis=1), 1)


def test_odd_rows(spark, tables, odd):
    got = QUERIES["op1_language_mixture"](spark, tables["odd"]).toPandas()
    assert len(got) == odd.count()
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect() if r["doc_id"]}
    none = got[got["doc_id"].map(lambda d: not any(c.isalpha() for c in texts.get(d, "x")))]
    assert set(none["lang_pred"]) == {"und"} and (none["score"] == 0).all() and len(none) == 4
    assert set(got["lang_pred"]) <= {"und", "en", "de", ""}


def test_no_labels_and_empty(spark, tables, odd):
    model = language.learn(odd.where("lang = 'xx'"))
    assert model.languages == ()
    rows = language.identify(odd, model)
    assert {r["lang_pred"] for r in rows.select("_mixture.lang_pred").collect()} == {"und"}
    assert QUERIES["op1_language_mixture"](spark, tables["empty"]).count() == 0


def test_stage_keeps_columns(odd):
    kept = language.keep_identified(odd, language.learn(odd))
    assert kept.columns == odd.columns
    assert {8, 9, 7, 19}.isdisjoint({r["doc_id"] for r in kept.collect()})
    assert {r["kept"] for r in kept.collect()} == {None, "x"}
