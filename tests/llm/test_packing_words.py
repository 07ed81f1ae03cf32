"""Pipeline: what a worker of packing remembers stays small, as its executor holds other stages' memory."""

import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from assaylens.llm import packing, vocab


class _Ran(Exception):
    pass


def test_words_remembered_by_the_pipeline(spark, monkeypatch):
    seen = {}

    def pieces(rows, *args):
        seen["args"] = args
        raise _Ran

    plain = packing.pieces
    monkeypatch.setattr(packing, "pieces", pieces)
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    try:
        corpus_pipeline.pack_sequences(spark, docs, "")
    except _Ran:
        pass

    class Rows:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    made = []
    monkeypatch.setattr(packing, "word_ids", lambda *a: made.append(vocab.WordIds(*a)) or made[-1])
    texts = [" ".join(f"{n:x}" for n in range(at, at + 20_000)) for at in range(1 << 20, (1 << 20) + 800_000, 20_000)]
    batches = [pa.RecordBatch.from_pydict({"_row": [i], "doc_id": [i], "text": [t]}) for i, t in enumerate(texts)]
    got = [r for b in plain(Rows(), *seen["args"])(iter(batches)) for r in b.to_pylist()]
    assert len(made[0].young) + len(made[0].old) < 400_000
    library = Tokenizer.from_file(vocab.path("word_bpe_49k.json"))
    for i in (0, 39):
        ids = np.array([*library.encode(texts[i], add_special_tokens=False).ids, 0], "<u4")
        crcs = [zlib.crc32(ids[a : a + 2048].tobytes()) for a in range(0, len(ids), 2048)]
        assert [r["ids_crc32"] for r in got if r["doc_id"] == i] == crcs
