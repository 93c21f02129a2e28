"""Line dedup: lines that stand in too many documents are dropped.

A line is normalised (white space collapsed, trimmed, lower case) and hashed.
Only (document, hash) pairs are shuffled to count the distinct documents of each
hash; the texts move once at most, when a document's remaining lines are put
together again by position.

Defined results: every row of the input comes back once. Blank lines are never
dropped. A null text stays null with 0 lines; an empty one is one blank line. A
null ``doc_id`` counts as one document of its own; repeated rows count as one
document and are treated alike. A document that loses all its lines has an
empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, table

#: A line in more documents than this is dropped.
MAX_DOCS = 10


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"[ \t\r\f]+", " ")))


def line_hash(line: Column) -> Column:
    """The hash of a normalised line; null for a blank one."""
    text = normalised(line)
    return F.when(text != "", F.xxhash64(text))


def dedup_lines(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """``doc_id``, the remaining ``text``, ``n_lines`` before and ``n_dropped``."""
    text = F.col("_cs_text")
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_cs_doc"), F.col("text").cast("string").alias("_cs_text"))
    lines = rows.select("_cs_doc", F.xxhash64(text).alias("content"), F.explode(F.array_distinct(F.transform(F.split(text, "\n"), line_hash))).alias("hash")).where("hash is not null")
    common = save(lines.groupBy("hash").agg(F.countDistinct("_cs_doc").alias("docs")).where(F.col("docs") > max_docs).select("hash"), "lines")
    drops = lines.join(common, "hash").groupBy(F.col("_cs_doc").alias("drop_doc"), F.col("content").alias("drop_content")).agg(F.collect_set("hash").alias("hashes"))
    joined = rows.join(drops, (F.col("_cs_doc") == F.col("drop_doc")) & (F.xxhash64(text) == F.col("drop_content")), "left")
    every, hashes = F.split(text, "\n"), F.col("hashes")
    # the arguments of arrays_zip are computed once for a row; only the few dropped hashes are searched for each line
    kept = F.filter(F.arrays_zip(every.alias("line"), F.transform(every, line_hash).alias("hash")), lambda x: x["hash"].isNull() | ~F.array_contains(hashes, x["hash"]))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(every))
    return joined.withColumn("_cs_kept", F.when(hashes.isNotNull(), kept)).select(
        "doc_id",
        F.when(hashes.isNull(), text).otherwise(F.array_join("_cs_kept.line", "\n")).alias("text"),
        n_lines.cast("int").alias("n_lines"),
        F.when(hashes.isNull(), 0).otherwise(n_lines - F.size("_cs_kept")).cast("int").alias("n_dropped"),
    )


ORACLE = f"""
WITH numbered AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
lines AS (
  SELECT rid, doc_id, i AS pos, string_split(text, chr(10))[i] AS line
  FROM numbered, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS t(i)
), marked AS (
  SELECT rid, doc_id, pos, line, lower(trim(regexp_replace(line, '[ \\t\\r\\f]+', ' ', 'g'))) AS norm FROM lines
), hot AS (
  SELECT norm FROM marked WHERE norm <> '' GROUP BY norm
  HAVING count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), 'null')) > {MAX_DOCS}
), kept AS (
  SELECT rid, count(*) AS n_lines, count(*) FILTER (WHERE h.norm IS NOT NULL) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE h.norm IS NULL), '') AS text
  FROM marked m LEFT JOIN hot h ON m.norm = h.norm GROUP BY rid
)
SELECT n.doc_id, CASE WHEN n.text IS NULL THEN NULL ELSE k.text END AS text,
       CAST(coalesce(k.n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(k.n_dropped, 0) AS INTEGER) AS n_dropped
FROM numbered n LEFT JOIN kept k ON n.rid = k.rid
"""


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))
