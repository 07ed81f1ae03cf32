import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from conftest import SMALL
from tokenizers import Tokenizer

from assaylens.llm import bpe, counting, exact, packing
from assaylens.llm.queries import QUERIES
from assaylens.llm.vocab import word_ids
from odd_tables import empty, odd, odd_rows, tables  # noqa: F401

SIGNS = ["the", "ing", "é", " ", "  ", "\n", "\t", "'s", "'ll", "1", "²", "½", "日", "😀", ".", "!?", "<|endoftext|>", "<|startoftext|>", "\x1c", "\x85", "\xa0", "́", "İ", "Σ", "=", "<", "|>"]


def _fuzz(n):
    rnd = random.Random(11)
    return ["".join(rnd.choice(SIGNS) for _ in range(rnd.randrange(30))) for _ in range(n)] + ["", "a" * 700, "ab" * 300, " " * 300, "\n" * 5 + "x"]


def _u4(ids):
    return np.array(ids, "<u4").tobytes()


def test_segment_tree_against_library():
    library, own = Tokenizer.from_file(P.path("byte_bpe_50k.json")), bpe.encoder("byte_bpe_50k.json")
    texts = _fuzz(1500)
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids == _u4(library.encode(text, add_special_tokens=False).ids)
        assert own.decode(ids) == library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False) == text


def test_word_cache_against_library():
    library, own = Tokenizer.from_file(P.path("word_bpe_49k.json")), word_ids("word_bpe_49k.json")
    texts = _fuzz(1500)
    for _ in range(2):
        assert own.ids(texts) == [_u4(library.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("folder", [SMALL, "odd"])
def test_queries_against_libraries(spark, tables, folder):
    import sentencepiece

    folder = tables.get(folder, folder)
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    expected = []
    for doc, text in rows:
        ids = library.encode(text, add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        expected.append((doc, len(ids), hashlib.sha256(_u4(ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    got = [tuple(r) for r in QUERIES["op6_segment_tree_bpe"](spark, folder).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    counts = [(d, len(t.encode()), n := len(model.encode(t)), n > 4096) for d, t in rows]
    got = [tuple(r) for r in QUERIES["op7_digest_cache"](spark, folder).collect()]
    assert sorted(got, key=str) == sorted(counts, key=str)


def test_cache_is_used(spark, odd, tmp_path):
    rows, cache = exact.with_row(odd.select("doc_id", "text")), f"file://{tmp_path}/cache"
    first = sorted(map(tuple, counting.counts(rows, "piece_bpe_32k.model", cache).collect()), key=str)
    n = counting.stored(spark, cache).count()
    assert n == odd.select("text").fillna("").distinct().count()
    assert sorted(map(tuple, counting.counts(rows, "piece_bpe_32k.model", cache).collect()), key=str) == first
    assert counting.stored(spark, cache).count() == n
    counting.counts(rows, "byte_bpe_50k.json", cache).collect()  # another version: other rows
    assert counting.stored(spark, cache).count() == 2 * n


def test_packing(spark, tables):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for folder in (SMALL, tables["odd"]):
        rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
        got = QUERIES["op9_swap_packing"](spark, folder).toPandas()
        expected = []
        for r in rows:
            ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
            expected += [(r["doc_id"], k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(_u4(ids[k : k + 2048]))) for k in range(0, len(ids), 2048)]
        told = [(None if d != d else int(d), *x) for d, *x in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
        assert sorted(told, key=str) == sorted(expected, key=str)
        for _, bin_ in got.sort_values("offset").groupby("sequence_id"):
            assert bin_["offset"].tolist() == [0, *np.cumsum(bin_["length"])[:-1]] and bin_["length"].sum() <= 2048
        assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 2048) + 1
    assert QUERIES["op9_swap_packing"](spark, tables["empty"]).count() == 0


def test_local_search():
    """Exchanges only make the squared fills larger, keep the pieces and reach fewer bins."""
    rnd = random.Random(2)
    for capacity in (10, 100, 2048):
        for _ in range(30):
            counts = {s: rnd.randrange(1, 40) for s in rnd.sample(range(1, capacity + 1), min(capacity, 25))}
            bins = packing.best_fit(counts, capacity)
            after = packing.improve(bins, capacity)
            for some in (bins, after):
                assert all(0 < packing._fill(k) <= capacity for k in some)
                held = {}
                for kind, n in some.items():
                    for size, times in kind:
                        held[size] = held.get(size, 0) + n * times
                assert held == counts
            assert after.total() <= bins.total()
    # two bins of 6 + 3 and 5 + 4 + ... where best fit leaves room that exchanges close
    start = packing.Counter({((6, 1), (2, 1)): 1, ((5, 1), (3, 1)): 1, ((4, 1),): 1})
    assert packing.improve(start, 10).total() == 2
