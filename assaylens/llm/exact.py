"""Exact duplicates by recipes of content-defined chunks, in DataFrame functions only.

A normalised text is cut after punctuation into chunks of bounded length. Chunk texts are
deduplicated once, which verifies that a digest stands for one chunk; a text is then its ordered
list of chunk identifiers, and only these lists are grouped and joined.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylens.llm.common import fresh, release
from assaylens.session import materialise, materialise_counted

LEAST, MOST = 256, 4096  # characters of a chunk; the last one may be shorter
#: A chunk ends at the first punctuation mark after LEAST characters, or at MOST.
CHUNK = rf"(?s).{{{LEAST - 1},{MOST - 2}}}?\p{{P}}|.{{1,{MOST}}}"
SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def with_row(docs: DataFrame, name: str = "_row") -> DataFrame:
    """*docs* with ``_row``, which tells repeated rows apart within one scan.

    Another scan may number otherwise, since splits follow the cores at hand; see ``with_place``.
    """
    return docs.withColumn(name, F.monotonically_increasing_id())


FILES = 1_000_000  # most files of a table whose list is broadcast


def with_place(docs: DataFrame, name: str = "_row") -> DataFrame:
    """*docs* with ``_row``: the number of the row's file and its place in that file.

    The same in every scan, however the files are split. A table that doesn't come from files is
    written once with numbers, and read back.
    """
    try:
        meta = docs.metadataColumn("_metadata")
        files = docs.select(meta["file_path"].alias("file"), meta["file_size"].alias("size")).distinct()
    except AnalysisException:
        return materialise(with_row(docs, name), "numbered")
    # the largest first, which is the order of a scan of whole files
    nr = F.row_number().over(Window.orderBy(F.desc("size"), "file")).cast("long")
    # one row for each file
    listed, n = materialise_counted(files.select("file", nr.alias("nr")), "files")
    file, at = fresh(docs, "_file"), fresh(docs, "_at")
    named = listed.select(F.col("file").alias(file), F.col("nr").alias(name))
    placed = docs.select("*", meta["file_path"].alias(file), meta["row_index"].alias(at))
    joined = placed.join(F.broadcast(named) if n <= FILES else named, file)
    return joined.select(*docs.columns, (F.shiftleft(F.col(name), 40) + F.col(at)).alias(name))


def without(docs: DataFrame, found, tag: str) -> DataFrame:
    """*docs* without the rows that ``found(rows)`` names by ``_row``; same columns.

    *found* gets ``_row, doc_id, text``. Columns of *docs* may have any other names.
    """
    row = fresh(docs, "_row")
    rows = with_place(docs, row)
    gone = materialise(found(rows.select(F.col(row).alias("_row"), "doc_id", "text")), tag)
    release(docs.sparkSession)
    # the rows to drop grow with the table: the same join at every size
    dropped = gone.select(F.col("_row").alias(row)).hint("merge")
    return rows.join(dropped, row, "left_anti").select(*docs.columns)


def recipes(rows: DataFrame, digest=F.xxhash64) -> DataFrame:
    """``(_row, doc_id, n_code, text_sha256, recipe)`` of ``rows(_row, doc_id, text)``.

    Recipes are equal exactly if the normalised texts are: equal texts are cut alike, and every
    identifier in a recipe stands for one chunk text. *digest* gives the identifiers; where one
    stands for several chunk texts, its recipes carry the number of the text among them too.
    """
    cut = rows.withColumn("_norm", normalised(F.col("text"))).withColumn("_chunks", F.regexp_extract_all("_norm", F.lit(CHUNK), F.lit(0)))
    described = cut.select(
        "_row",
        "doc_id",
        F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_code"),
        F.sha2("_norm", 256).alias("text_sha256"),
        F.transform("_chunks", lambda c: digest(c)).alias("recipe"),
    )
    chunks = cut.select(F.explode("_chunks").alias("chunk")).select(digest("chunk").alias("id"), "chunk").distinct()
    several = chunks.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    clashes, found = materialise_counted(several.select("id"), "clashes")
    if not found:
        return described
    variant = F.row_number().over(Window.partitionBy("id").orderBy("chunk"))
    numbered = materialise(chunks.join(clashes, "id", "left_semi").select("id", "chunk", variant.alias("variant")), "variants")
    placed = cut.select("_row", F.posexplode("_chunks").alias("pos", "chunk")).withColumn("id", digest("chunk"))
    told = placed.join(numbered, ["id", "chunk"], "left").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("pos", "variant"))).alias("v"))
    variants = F.transform(F.coalesce("v", F.array().cast("array<struct<pos:int,variant:int>>")), lambda x: F.coalesce(x["variant"], F.lit(1)).cast("long"))
    return described.join(told, "_row", "left").withColumn("recipe", F.concat("recipe", variants)).drop("v")


def duplicates(rows: DataFrame, digest=F.xxhash64) -> DataFrame:
    """Group of equal texts for every row of ``rows(_row, doc_id, text)``.

    Returns ``_row, doc_id, keep_id, group_size, kept, text_sha256``. Texts are equal when they
    agree after deleting white space; null counts as empty, and all empty texts are one group. The
    row with the longest original text stays, then the smallest doc_id (null last), then the first
    row of the table: exactly one of each group, also among rows that repeat a doc_id. An empty
    table gives no rows. A group of any size is counted before the shuffle; the join that hands the
    outcome back holds narrow rows and may be split by key.
    """
    table = materialise(recipes(rows, digest), "recipes")
    first = F.min(F.struct((-F.col("n_code")).alias("n"), F.col("doc_id").isNull().alias("absent"), "doc_id", "_row"))
    groups = table.groupBy("recipe").agg(F.count(F.lit(1)).alias("group_size"), first.alias("first")).where("group_size > 1")
    found = materialise(groups.select("recipe", "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first._row").alias("keep_row")), "groups")
    single = F.col("keep_row").isNull()
    return table.join(found, "recipe", "left").select(
        "_row",
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("_row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts; same columns. *docs* is read more than once."""
    return without(docs, lambda rows: duplicates(rows).where("not kept"), "copies")
