"""A bounded sample of labelled texts for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Labelled texts a classifier is fitted on, at most; those with the smallest hash of their id.
MAX_LABELLED = 12_000
#: Bytes of these texts at most: those whose bytes, added up in the same order, stay within it.
MAX_LABELLED_BYTES = 128 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, held_out, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_LABELLED, most_bytes: int = MAX_LABELLED_BYTES) -> DataFrame:
    """(id, text, y) of at most `most` labelled texts that are not held out, and of `most_bytes`
    together: a text that does not fit any more is left out, and so are all after it. Ids that are
    null or labelled both ways are left out. Labels are few (one small row each); only their ids,
    and the sizes of their texts, travel."""
    y = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out).groupBy(F.col(id_col).alias("_l_id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("_l_most"))
    y = y.where("y = _l_most").drop("_l_most").orderBy(F.xxhash64("_l_id"), "_l_id").limit(most)
    j = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(y), F.col("id") == F.col("_l_id")).select("id", "text", "y")
    size = j.groupBy("id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")).alias("n"))  # `most` rows at most
    so_far = F.sum("n").over(Window.orderBy(F.xxhash64("id"), "id"))
    fits = size.withColumn("n", so_far).where(F.col("n") <= most_bytes).select(F.col("id").alias("_fits"))
    return j.join(F.broadcast(fits), F.col("id") == F.col("_fits"), "left_semi")
