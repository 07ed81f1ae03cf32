import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))]
    # names that the operators use themselves
    + [T.StructField(n, T.StringType()) for n in ("_row", "_mixture", "_spans", "kept", "key", "keys", "value", "recipe", "set_id", "n")]
)

PROSE = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix five potions near the old river bank and sing"


def prose(seed: int, words: int) -> str:
    parts = PROSE.split()
    return " ".join(parts[(seed * 7 + i * i * (seed % 5 + 1) + i) % len(parts)] + str((seed * i) % 11) for i in range(words))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, tiny and long texts, ties, repeated rows."""
    base = prose(1, 80)
    texts = [
        (1, base),
        (2, base),
        (3, base + " "),
        (4, base.replace(" ", "\n")),
        (5, base + " extra"),
        (6, base.upper()),
        (7, None),
        (8, ""),
        (9, " \t\n"),
        (10, "one"),
        (11, "two words"),
        (12, "two  words"),
        (None, base),
        (None, "no id"),
        (14, prose(2, 6000)),
        (15, prose(2, 5990) + " and another end of it"),
        (16, "é ü 日本語 😀 " * 30),
        (17, "mail bob.smith@mail.example.com or 10.0.0.1, call +1 (555) 010-9999 now"),
        (18, "4111 1111 1111 1111 is a card, 4111111111111112 is none, 999.1.1.1 neither"),
        (19, "1234567890" * 500),
        (20, prose(3, 60) + " " + base),
    ]
    texts += [(21, "same again"), (21, "same again"), (21, "same again")]
    langs = [None, "en", "de", ""]
    return [(d, t, langs[i % 4], None if i % 3 else "s", None if t is None else len(t), *["x" if i % 2 else None] * 10) for i, (d, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def tables(spark, odd_rows, tmp_path_factory):
    """Folders of a table of odd rows and of an empty one, as scans."""
    from assaylens.llm.common import prepare

    prepare(spark)
    out = {}
    for name, rows in (("odd", odd_rows), ("empty", [])):
        path = str(tmp_path_factory.mktemp(name))
        spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
        out[name] = path
    return out


@pytest.fixture(scope="session")
def odd(spark, tables):
    return spark.read.parquet(f"{tables['odd']}/documents.parquet")


@pytest.fixture(scope="session")
def empty(spark, tables):
    return spark.read.parquet(f"{tables['empty']}/documents.parquet")
