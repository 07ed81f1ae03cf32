"""The queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylens.llm import audit, bpe, counting, exact, graphs, jaccard, language, packing, private, repeats, resample, search, shards
from assaylens.llm.common import documents, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_language_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every text, learned from the rows that aren't held out."""
    docs = documents(spark, folder)
    model = language.learn(language.training_rows(docs))
    rows = language.identify(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", language.held_out().alias("held_out"), "_mixture.lang_pred", "_mixture.score", "_mixture.background", "_mixture.languages")


@query
def op3_chunk_recipes(spark: SparkSession, folder: str) -> DataFrame:
    """Group of equal texts of every document, by chunk recipes."""
    rows = exact.with_place(documents(spark, folder).select("doc_id", "text"))
    return exact.duplicates(rows).drop("_row")


ORACLES["op3_chunk_recipes"] = r"""
WITH n AS (
  SELECT doc_id, coalesce(length(text), 0) AS n_code,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT text_sha256, count(*) AS group_size, arg_min(doc_id, struct_pack(a := -n_code, b := doc_id)) AS keep_id
  FROM n GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM n JOIN g USING (text_sha256)
"""


@query
def op10_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document: sets of four-word shingles, similarity 0.85 or more."""
    rows = exact.with_place(documents(spark, folder).select("doc_id", "text"))
    return jaccard.classes(rows, jaccard.Rule(words=4, percent=85)).drop("_row", "first_row")


ORACLES["op10_ngram_jaccard"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + 3) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
h AS (SELECT doc_id, md5(s::VARCHAR) AS h FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o
  FROM h a JOIN h b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * o >= 85 * (x.n + y.n - o)),
pair AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (
  SELECT doc_id AS d, doc_id AS r FROM documents
  UNION
  SELECT pair.b, reach.r FROM reach JOIN pair ON pair.a = reach.d WHERE reach.r < pair.b)
SELECT d AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r) AS component_id
FROM reach LEFT JOIN n ON n.doc_id = reach.d GROUP BY d
"""


@query
def op2_context_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every text: base forms, and what confident contexts add."""
    rows = exact.with_row(documents(spark, folder).select("doc_id", "text"))
    return private.report(private.spans(rows))


@query
def op9_swap_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences of at most 2048 tokens for every document."""
    rows = exact.with_row(documents(spark, folder).select("doc_id", "text"))
    return packing.pack(rows, "word_bpe_49k.json")


@query
def op8_prefix_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Sixteen contiguous shards of near-equal bytes."""
    return shards.assign(exact.with_row(documents(spark, folder).select("doc_id", "text")))


@query
def op6_segment_tree_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every text and the text they decode to, as digests."""
    return bpe.digests(documents(spark, folder), "byte_bpe_50k.json")


@query
def op7_digest_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of every text through a cache that starts empty."""
    rows = exact.with_place(documents(spark, folder).select("doc_id", "text"))
    return counting.counts(rows, "piece_bpe_32k.model")


@query
def op5_bounded_expansion(spark: SparkSession, folder: str) -> DataFrame:
    """Every text without the bytes that strings of smaller documents cover."""
    rows = exact.with_place(documents(spark, folder).select("doc_id", "text"))
    cut = repeats.without_repeats(rows)
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op4_block_max_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents for every document whose doc_id is divisible by 20."""
    docs = documents(spark, folder).select("doc_id", "text")
    asked = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return search.top(docs, asked)


ORACLES["op4_block_max_search"] = r"""
WITH w AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS t
  FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, t, count(*) AS n FROM w GROUP BY ALL),
l AS (SELECT doc_id, sum(n) AS size FROM f GROUP BY doc_id),
s AS (SELECT (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS n, (SELECT sum(size) FROM l) AS words),
d AS (SELECT t, count(*) AS df FROM f GROUP BY t),
p AS (
  SELECT q.doc_id AS query_id, f.doc_id,
         round(sum(q.n * ln(1 + (s.n - df + 0.5) / (df + 0.5)) * f.n * 2.2
             / (f.n + 1.2 * (0.25 + 0.75 * size / (s.words / s.n)))), 6) AS score
  FROM f q JOIN d USING (t) JOIN f ON f.t = q.t JOIN l ON l.doc_id = f.doc_id, s
  WHERE q.doc_id % 20 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM p WHERE score > 0)
SELECT query_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""


@query
def op11_threshold_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all documents towards the benchmark's distribution, and ranks of the drawn twentieth."""
    return resample.draw(documents(spark, folder), table(spark, folder, "benchmark"))


@query
def op12_shard_graphs(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty nearest vectors of every vector whose vec_id is divisible by 20."""
    rows = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    return graphs.nearest(rows, asked)


@query
def op13_block_index_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Divergence of every source from the others of its language, and of its terms from the language."""
    return audit.audit(documents(spark, folder))


ORACLES["op13_block_index_audit"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         row_number() OVER () AS nr
  FROM documents),
w AS (
  SELECT nr, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM d),
c AS (SELECT lang, source, t, count(*) AS n FROM w GROUP BY ALL),
k AS (SELECT lang, t, count(*) AS all_n FROM w GROUP BY ALL HAVING count(DISTINCT nr) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(all_n) AS lang_n FROM k GROUP BY lang),
dense AS (SELECT g.lang, g.source, k.t, k.all_n, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, t)),
tot AS (SELECT lang, source, sum(n) AS total FROM dense GROUP BY ALL),
p AS (
  SELECT lang, source, t, n, 1 + (1000000000::HUGEINT * (n + 1)) // (total + v) AS p,
         1 + (1000000000::HUGEINT * (all_n + 1)) // (lang_n + v) AS lang_p
  FROM dense JOIN tot USING (lang, source) JOIN v USING (lang)),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
none AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, 0 AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM k)),
term AS (SELECT lang, source, 'term' AS part, t AS item, (p - lang_p) * (p - lang_p) // lang_p AS value FROM p WHERE n > 0 AND p > lang_p),
r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM none UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""
