"""Pipeline: a worker lets go of the words that packing left in it."""

import pandas as pd

from assaylens.llm import jaccard, language, vocab


def _left_by(run, batches) -> int:
    vocab.word_ids("word_bpe_49k.json").ids(["some words"])
    list(run(batches))
    return vocab.word_ids.cache_info().currsize


class _Rows:
    """Stands for a table; hands out what would run in its tasks."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_words_are_let_go(spark):
    texts = pd.DataFrame({"text": ["one two three"], "lang": ["en"]})
    assert _left_by(language._count, iter([texts])) == 0
    assert _left_by(jaccard.profiles(_Rows(), jaccard.Rule(), 0), iter([])) == 0
