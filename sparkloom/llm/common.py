"""Shared pieces of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def n_words(text) -> F.Column:
    """Number of words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text) -> F.Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def put(df: DataFrame, **columns) -> DataFrame:
    """Set output columns; an input column of the same name (any case) is replaced."""
    taken = {c.lower() for c in columns}
    keep = [c for c in df.columns if c.lower() not in taken]
    return df.select(*[df[f"`{c}`"] for c in keep], *[v.alias(k) for k, v in columns.items()])


def grid_quantiles(rows: DataFrame, by: str, bins: dict[str, F.Column], shares: tuple[float, ...]) -> DataFrame:
    """(by, n, name_0, name_1 ...): for each named integer bin its quantiles within the groups of ``by``, nulls left out.

    Rows are counted by bin before anything is ordered, so a group of any size is a few
    thousand counts at most, and the result does not depend on how rows are dealt.
    """
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), b.cast("long").alias("bin")) for name, b in bins.items())))
    counts = rows.select(by, each.alias("b")).select(by, "b.*").where("bin IS NOT NULL").groupBy(by, "name", "bin").agg(F.count(F.lit(1)).alias("c"))
    group = Window.partitionBy(by, "name")
    placed = counts.withColumns({"upto": F.sum("c").over(group.orderBy("bin")), "all": F.sum("c").over(group)})
    found = [F.min(F.when((F.col("name") == name) & (F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("all") * share))), F.col("bin"))).alias(f"{name}_{i}") for name in bins for i, share in enumerate(shares)]
    return placed.groupBy(by).agg(F.max("all").alias("n"), *found)


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
