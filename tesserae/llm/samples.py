"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import is_held_out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, *, per_class: int, modulus: int, remainder: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, y, text, weight) of at most ``per_class`` training rows of each label 0 and 1, those of the least hash.

    A row's weight is the number of training rows of its label for each row taken, so that the labels keep their shares.
    Rows with a null id or label take no part, nor do those held out (crc32 of the
    id as text leaves ``remainder``). The ids are few, so they are broadcast to the scan of the texts.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~is_held_out(F.col(id_col), modulus, remainder))
    rows = rows.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y"), F.xxhash64(F.col(id_col).cast("string")).alias("h"))
    share = rows.groupBy("y").agg(F.count("*").alias("n"), F.least(F.lit(1.0), F.lit(2.0 * per_class) / F.count("*")).alias("share"))
    near = rows.join(F.broadcast(share), "y").where(F.pmod("h", F.lit(1 << 20)) < F.col("share") * (1 << 20))
    few = near.withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy("h"))).where(F.col("r") <= per_class)
    few = few.select("id", "y", (F.col("n") / F.count("*").over(Window.partitionBy("y"))).alias("weight"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(few), "id").select("id", "y", "text", "weight")
