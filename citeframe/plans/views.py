"""The given tables seen as papers, vectors, scores and trials.

Orders stand for papers: key, date, and a reference list computed from the order's own columns. Every
view is a narrow plan over its table, apart from the yearly mean behind one label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeframe.functions.references import format_reference_list
from citeframe.functions.timeline import to_epoch_ns
from citeframe.operators.folds import assign_roles, make_folds
from citeframe.operators.history import trial_log
from citeframe.sources.datasets import scan_period

# Settings of the registered queries.
TIMEPOINTS = 4
N_FEATURES = 64
ROWS_PER_SHARD = 500
BATCH_SIZE = 512
START_YEAR, END_YEAR = 1995, 2002
FOLD_SETTINGS = dict(start_year=START_YEAR, end_year=END_YEAR, start_train=2, val_size=1, test_size=1, delta=1)
Y_COLS = ("above_mean", "fulfilled")

# Works cited with this offset are not in the table.
_OUTSIDE = 1_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _refs() -> Column:
    key, step, n = F.col("o_orderkey"), F.col("o_custkey") % 50 + 1, (F.col("o_custkey") % 9).cast("int")
    priority = F.col("o_orderpriority")
    none = F.array().cast("array<bigint>")
    near = F.slice(F.array(*[F.abs(key - step * i) for i in range(1, 9)]), F.lit(1), n)
    popular = F.when(priority == "1-URGENT", F.array(F.lit(0).cast("bigint"))).otherwise(none)
    again = F.when(priority == "2-HIGH", F.slice(near, 1, 1)).otherwise(none)
    outside = F.when(priority == "5-LOW", F.array(key + _OUTSIDE)).otherwise(none)
    nothing = (n == 0) & ~priority.isin("1-URGENT", "5-LOW")
    absent = nothing & (F.col("o_orderstatus") == "P")
    return F.when(absent, F.lit(None)).otherwise(F.concat(popular, near, again, outside))


def papers(spark: SparkSession, sf_dir: str, period: tuple[int, int] | None = None) -> DataFrame:
    """``(id, publication_date_int, refs)``: up to eight near papers; urgent orders also cite paper 0,
    high ones repeat a reference, low ones cite a work outside the table. Some lists are empty or null.
    ``period`` keeps the papers dated in ``[low, high)`` epoch nanoseconds, by a filter on the stored date."""
    orders = table(spark, sf_dir, "orders")
    if period:
        orders = scan_period(orders, *period, "o_orderdate")
    return orders.select(
        F.col("o_orderkey").alias("id"), to_epoch_ns(F.col("o_orderdate")).alias("publication_date_int"), _refs().alias("refs")
    )


def labelled_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers with two labels: a price above the mean of its year (null when the priority is not
    specified) and whether the order is fulfilled, and a score made from the customer. Money is summed in
    whole cents, so the mean is exact."""
    orders = (
        table(spark, sf_dir, "orders")
        .withColumn("year", F.year("o_orderdate"))
        .withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("bigint"))
    )
    yearly = orders.groupBy("year").agg(F.sum("cents").alias("year_cents"), F.count("*").alias("year_n"))
    above = (F.col("cents") * F.col("year_n") > F.col("year_cents")).cast("int")
    # One row per calendar year, whatever the number of orders.
    return orders.join(F.broadcast(yearly), "year", "left").select(
        F.col("o_orderkey").alias("id"),
        to_epoch_ns(F.col("o_orderdate")).alias("publication_date_int"),
        _refs().alias("refs"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", above).alias("above_mean"),
        (F.col("o_orderstatus") == "F").cast("int").alias("fulfilled"),
        (F.col("o_custkey") % 101 / 100.0).alias("score"),
    )


def raw_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers whose references are a list literal of work addresses."""
    return papers(spark, sf_dir).select("id", "publication_date_int", format_reference_list(F.col("refs")).alias("refs_text"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, embedding)`` of every paper; the embeddings are dealt out to the papers in turn."""
    embeddings = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = embeddings.agg(F.max("vec_id") + 1).scalar()
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return orders.withColumn("vec_id", F.col("id") % n).join(embeddings, "vec_id", "left").select("id", "embedding")


def price_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, embedding)`` with one feature, in eighths: a price step blurred by the customer."""
    step = F.floor(F.col("o_totalprice") / 20000) + F.col("o_custkey") % 13
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.array((step / 8.0).cast("float")).alias("embedding")
    )


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the high-priority orders."""
    return table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "2-HIGH").select(F.col("o_orderkey").alias("id"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, y, p)``: the quality label of a document against a score made from its length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 101 / 100.0).alias("p"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"), "p")


def scored_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(fold, id, y, p)``: the first label of the test papers of each fold against their score."""
    roles = assign_roles(labelled_papers(spark, sf_dir), make_folds(**FOLD_SETTINGS), keep=["above_mean", "score"])
    return roles.where(F.col("role") == "test").select("fold", "id", F.col("above_mean").alias("y"), F.col("score").alias("p"))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(trial, epoch, score)``: the events of a user in time order."""
    return trial_log(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "value")


def vector_text(vector: Column) -> Column:
    """A vector as text in whole millionths, equal in every engine."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 1000000)).cast("string")
