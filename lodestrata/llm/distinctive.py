"""How characteristic a term is of its record, by smoothed language-model divergence.

A record's terms form a distribution, smoothed towards that of the collection as with a Dirichlet prior
of weight mu. A term's score is its part in the relative entropy between the two: p log(p / q). Common
terms have p near q and count little; rare terms with weight in the record count much. Terms of fewer
than ``min_df`` records are left out of the result, not of the distributions.

Collection counts come from one pass with partial aggregation, so no term, however common, gathers in
one task. The counts, one row a term, are joined to the records by term; the planner broadcasts them
where it measures them to be small and splits common terms otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Cuts


def words(name: Column, *others: Column) -> Column:
    """Lower-cased runs of ASCII letters; a name also breaks where a capital follows a small letter."""
    text = F.concat_ws(" ", F.regexp_replace(name, "(?<=[a-z])(?=[A-Z])", " "), *others)
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), 0), F.lower)


def collection_counts(records: DataFrame) -> DataFrame:
    """term, cf, df: how often each term stands in all records, and in how many of them. Rows have terms."""
    each = records.select(F.posexplode("terms").alias("pos", "term"), "terms").select("term", (F.array_position("terms", F.col("term")) == F.col("pos") + 1).alias("first"))
    return each.groupBy("term").agg(F.count("*").alias("cf"), F.count_if("first").alias("df"))


def term_scores(records: DataFrame, wanted: DataFrame | None = None, mu: float | None = None, min_df: int = 2) -> DataFrame:
    """id, term, tf, df, score of the terms of records (id, terms).

    Counts are those of all ``records``; ``wanted``, a table of id, asks for the scores of some of them.
    ``mu`` is the average number of terms of a record where not given. Records without terms and null ids
    have no rows. Scores are rounded to 12 places.
    """
    cuts = Cuts(records.sparkSession)
    rows = cuts.cut(records.where(F.col("id").isNotNull()))
    stats = cuts.cut(collection_counts(rows))
    size = stats.agg(F.sum("cf")).first()[0] or 1
    mu = mu or size / max(1, rows.where(F.size("terms") > 0).count())
    asked = rows if wanted is None else rows.join(wanted.select("id").distinct(), "id", "left_semi")
    tf = asked.select("id", F.size("terms").alias("dl"), F.explode("terms").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
    q = F.col("cf") / F.lit(float(size))
    p = (F.col("tf") + F.lit(float(mu)) * q) / (F.col("dl") + F.lit(float(mu)))
    joined = tf.join(stats.where(F.col("df") >= min_df), "term")
    return joined.select("id", "term", "tf", "df", F.round(p * F.log(p / q), 12).alias("score"))


def top_term(scores: DataFrame) -> DataFrame:
    """id, term with the highest score; on a tie the first by code points."""
    return scores.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "term")).alias("m")).select("id", "m.term")
