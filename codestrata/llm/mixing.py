"""Mixing sources to target weights by weighted sampling without replacement.

Every document draws an exponential key (Efraimidis and Spirakis):
``-ln(u) / w`` with ``u`` from a hash of its id and ``w`` its quality weight.
A source's share of the token budget is its token total to the power
``alpha``, normalised. Where the budget holds the whole source, complete epochs
come first; what is left takes documents in key order while their running token
sum fits.

The running sum is not one long sort for each source. Keys fall in buckets by
their quantile; bucket totals, a small table, tell in which bucket a source's
budget ends, and only that bucket is sorted.

Defined results: one row for each selected row of the input, with the number of
copies. Rows with one ``doc_id`` and source have one key and are taken or left
together, so repeated rows and ties cannot split. A null source is a source of
its own; a null or empty text has 0 tokens and is taken like any other; a null
``doc_id`` draws a key of its own; unlabelled documents have the middle weight,
contradicting labels the higher.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, marks, placed, save, table

#: Quality weights of good, unlabelled and bad documents.
GOOD, UNKNOWN, BAD = 1.0, 0.5, 0.25
ALPHA = 0.5
#: Token budget as a share of the tokens there are.
BUDGET = 1.0
SEED = "mix"
BUCKETS = 4096


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^ \t\r\n\f]+")), F.lit(0)).cast("bigint")


def with_keys(rows: DataFrame, labels: DataFrame, seed: str = SEED) -> DataFrame:
    """``rows`` (with ``doc_id``) and their ``key`` and ``bucket``; the labels' weights come by a join on the id."""
    weight = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("labelled")).agg(F.max(F.col("quality").cast("int")).alias("quality"))
    u = (F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}"))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)
    w = F.when(F.col("quality") >= 1, GOOD).when(F.col("quality") <= 0, BAD).otherwise(UNKNOWN)
    keyed = rows.join(weight, F.col("doc_id") == F.col("labelled"), "left").withColumn("key", -F.log(u) / w)
    return keyed.withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * BUCKETS)).drop("labelled", "quality")


def cuts(keyed: DataFrame, alpha: float = ALPHA, budget: float = BUDGET) -> DataFrame:
    """For each source its ``epochs``, the bucket in which its fraction ends and the last (key, id) of it there; a small saved table."""
    totals = save(keyed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens")), "buckets")
    sources = totals.groupBy("source").agg(F.sum("tokens").alias("total"))
    grand = sources.agg(F.sum("total").cast("double").alias("all_tokens"), F.sum(F.pow(F.col("total").cast("double"), F.lit(alpha))).alias("norm"))
    target = F.when(F.col("norm") > 0, F.floor(F.col("all_tokens") * F.lit(budget) * F.pow(F.col("total").cast("double"), F.lit(alpha)) / F.col("norm"))).otherwise(0)
    shares = sources.crossJoin(grand).withColumn("target", target)
    shares = shares.withColumn("epochs", F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(0))
    shares = shares.select(F.col("source").alias("s"), "epochs", (F.col("target") - F.col("epochs") * F.col("total")).alias("rest"))
    running = Window.partitionBy("source").orderBy("bucket")
    before = totals.withColumn("through", F.sum("tokens").over(running))
    ending = before.join(shares, F.col("source").eqNullSafe(F.col("s"))).groupBy("s").agg(
        F.first("epochs").alias("epochs"), F.first("rest").alias("rest"), F.min(F.when(F.col("through") > F.col("rest"), F.col("bucket"))).alias("last"), F.max(F.when(F.col("through") <= F.col("rest"), F.col("through"))).alias("full")
    )
    ending = save(ending.withColumn("full", F.coalesce("full", F.lit(0))), "ending")
    inside = keyed.select("source", "doc_id", "key", "bucket", "n_tokens").join(ending.select(F.col("s").alias("s2"), "last", "full", "rest"), F.col("source").eqNullSafe(F.col("s2")) & (F.col("bucket") == F.col("last")))
    order = Window.partitionBy("s2").orderBy("key", "doc_id")
    fits = inside.withColumn("through", F.col("full") + F.sum("n_tokens").over(order)).where(F.col("through") <= F.col("rest"))
    # a null id sorts first in both: no id is below it
    last = fits.groupBy(F.col("s2").alias("s3")).agg(F.max(F.struct(F.col("key"), F.col("doc_id"))).alias("cut"))
    # rows of buckets before the last are in; those of the last one up to the cut
    found = save(ending.join(last, F.col("s").eqNullSafe(F.col("s3")), "left").select(F.col("s").alias("of"), "epochs", "last", "cut"), "cuts")
    discard(totals, ending)
    return found


def with_copies(keyed: DataFrame, cut: DataFrame) -> DataFrame:
    """``keyed`` with ``copies``, the epochs of its source and one more where it is in the fraction."""
    b, last = F.col("bucket"), F.col("last")
    at_end = (b == last) & F.coalesce(F.struct(F.col("key"), F.col("doc_id")) <= F.col("cut"), F.lit(False))
    inside = F.coalesce(last.isNull() | (b < last) | at_end, F.lit(False))
    return keyed.join(cut, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("copies", (F.col("epochs") + inside.cast("int")).cast("int"))


def select_documents(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, budget: float = BUDGET) -> DataFrame:
    """``doc_id``, ``source``, ``n_tokens`` and ``copies`` of the selected rows; texts stay where they are."""
    keyed = save(with_keys(docs.select("doc_id", "source", tokens(F.col("text")).alias("n_tokens")), labels), "keys")
    return with_copies(keyed, cuts(keyed, alpha, budget)).where("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def mix(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, budget: float = BUDGET) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as it is selected.

    Keys, labels and budgets are joined over places of rows; the texts stay
    where they are until each gets its number of copies.
    """
    rows = placed(docs)
    slim = save(with_keys(rows.select("piece", "at", F.col("doc.doc_id").alias("doc_id"), F.col("doc.source").alias("source"), tokens(F.col("doc.text")).alias("n_tokens")), labels), "keys")
    cut = cuts(slim, alpha, budget)
    copies = marks(with_copies(slim, cut).where("copies > 0").select("piece", "at", F.col("copies").alias("value")), "copies")
    discard(slim, cut)
    chosen = rows.select("doc", copies(F.col("piece"), F.col("at")).alias("copies")).where("copies > 0")
    return chosen.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


ORACLE = f"""
WITH weights AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
keyed AS (
  SELECT d.doc_id, d.source, CAST(coalesce(len(regexp_extract_all(d.text, '[^ \\t\\r\\n\\f]+')), 0) AS BIGINT) AS n_tokens,
    -ln((CAST(('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':{SEED}'), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / {2**52}::DOUBLE)
      / CASE WHEN w.quality >= 1 THEN {GOOD}::DOUBLE WHEN w.quality <= 0 THEN {BAD}::DOUBLE ELSE {UNKNOWN}::DOUBLE END AS key
  FROM documents d LEFT JOIN weights w ON d.doc_id = w.doc_id
), sources AS (SELECT source, sum(n_tokens) AS total FROM keyed GROUP BY source),
shares AS (
  SELECT source, total, CASE WHEN sum(pow(total::DOUBLE, {ALPHA}::DOUBLE)) OVER () > 0 THEN
    CAST(floor((sum(total) OVER ())::DOUBLE * {BUDGET}::DOUBLE * pow(total::DOUBLE, {ALPHA}::DOUBLE) / sum(pow(total::DOUBLE, {ALPHA}::DOUBLE)) OVER ()) AS BIGINT) ELSE 0 END AS target
  FROM sources
), rests AS (
  SELECT source, CASE WHEN total > 0 THEN CAST(floor(target::DOUBLE / total::DOUBLE) AS BIGINT) ELSE 0 END AS epochs, total, target FROM shares
), runs AS (
  SELECT k.*, r.epochs, r.target - r.epochs * r.total AS rest,
         sum(n_tokens) OVER (PARTITION BY k.source ORDER BY key, k.doc_id NULLS FIRST) AS through
  FROM keyed k JOIN rests r ON k.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, source, n_tokens, CAST(epochs + CASE WHEN through <= rest THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM runs WHERE epochs + CASE WHEN through <= rest THEN 1 ELSE 0 END > 0
"""


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
