"""Forward selection of features by what they tell about a target less what they tell about each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pairwise_information(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, mi): mutual information in nats of every two of ``columns`` (categories or bin numbers), a before b.

    One pass: a row gives one count a pair of columns, counted before the shuffle, so what moves is
    contingency tables. Rows with a null in either column take no part in that pair.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}`").cast("string").alias("x"), F.col(f"`{b}`").cast("string").alias("y")) for a, b in pairs])
    n = df.select(F.inline(cells)).where("x is not null and y is not null").groupBy("a", "b", "x", "y").agg(F.count("*").alias("n"))
    w = lambda *c: F.sum("n").over(Window.partitionBy("a", "b", *c)).cast("double")
    t = n.withColumns({"t": w(), "nx": w("x"), "ny": w("y")})
    return t.groupBy("a", "b").agg(F.round(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))), 9).alias("mi"))


def forward_selection(df: DataFrame, features: list[str], target: str, most: int | None = None) -> DataFrame:
    """(rank, feature, score): features in the order picked, each with its relevance to ``target`` less its mean
    information about those picked before.

    The first is the most relevant one; picking stops at ``most`` or where no score is above 0. Ties go
    to the feature named first. Only one number a pair of columns comes to the driver.
    """
    known = {frozenset((r.a, r.b)): r.mi for r in pairwise_information(df, [*features, target]).collect()}
    of = lambda a, b: known.get(frozenset((a, b)), 0.0)
    picked: list[tuple[int, str, float]] = []
    left = list(features)
    while left and len(picked) < (len(features) if most is None else most):
        scores = [of(f, target) - (sum(of(f, p) for _, p, _ in picked) / len(picked) if picked else 0.0) for f in left]
        best = max(range(len(left)), key=lambda i: (scores[i], -i))
        if scores[best] <= 0:
            break
        picked.append((len(picked) + 1, left.pop(best), round(scores[best], 6)))
    return df.sparkSession.createDataFrame(picked, "rank int, feature string, score double")
