"""Cleaning of wide feature tables: columns by name, kind and content, rows, scales, selection."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granula.operators.ranges import average_ranks, quantiles


def drop_ordinals(df: DataFrame, *ranges: range) -> DataFrame:
    """Without the columns at the places in ``ranges``, counted from 0."""
    gone = {i for r in ranges for i in r}
    return df.select(*[F.col(f"`{c}`") for i, c in enumerate(df.columns) if i not in gone])


def drop_matching(df: DataFrame, pattern: str) -> DataFrame:
    """Without the columns whose name holds a match of ``pattern``."""
    return df.drop(*[c for c in df.columns if re.search(pattern, c)])


def drop_features(df: DataFrame, *prefixes: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefixes)])


def coerce_numeric(df: DataFrame, *keep: str) -> DataFrame:
    """All columns but ``keep`` as doubles; what is no number becomes null."""
    return df.select(*[F.col(f"`{c}`") if c in keep else F.col(f"`{c}`").cast("string").try_cast("double").alias(c) for c in df.columns])


def rename_by_place(df: DataFrame, names: list[str], last: tuple[str, ...] = ()) -> DataFrame:
    """Columns named by place, those in ``last`` moved to the end."""
    df = df.toDF(*names)
    return df.select(*[c for c in names if c not in last], *last)


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Without the columns that hold a null or NaN, found in one pass; an empty table keeps all."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    bad = lambda c: F.col(f"`{c}`").isNull() | (F.isnan(f"`{c}`") if kinds[c] in ("double", "float") else F.lit(False))
    seen = df.agg(*[F.bool_or(bad(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return df.select(*[F.col(f"`{c}`") for i, c in enumerate(df.columns) if not seen[i]])


def replace_infinite(df: DataFrame, value: float = 1000.0) -> DataFrame:
    """Positive infinity replaced in all columns of doubles and floats."""
    fix = lambda c: F.when(F.col(f"`{c}`") == float("inf"), F.lit(value)).otherwise(F.col(f"`{c}`")).alias(c)
    return df.select(*[fix(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f"`{f.name}`") for f in df.schema])


def round_all(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(f"`{f.name}`", digits).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f"`{f.name}`") for f in df.schema])


def one_hot(df: DataFrame, column: str, categories: list, prefix: str = "is_") -> DataFrame:
    """A 0/1 column for each of ``categories``, which name the columns; null is none of them."""
    return df.withColumns({f"{prefix}{str(c).lower()}": F.when(F.col(column) == c, 1).otherwise(0) for c in categories})


def unused_columns(df: DataFrame, drop: tuple[str, ...], rename: dict[str, str]) -> DataFrame:
    """Without ``drop`` and with the new names of ``rename``, as far as the table has them."""
    return df.drop(*drop).withColumnsRenamed({a: b for a, b in rename.items() if a in df.columns})


def name_parts(df: DataFrame, column: str) -> DataFrame:
    """shape (first two characters), tail (last three) and the numbers of a particle's name."""
    c = F.col(column)
    return df.withColumns({"shape": F.substring(c, 1, 2), "tail": F.substring(c, -3, 3), "digits": F.regexp_extract(c, "([0-9]+)", 1), "letters": F.regexp_extract(c, "([A-Za-z]+)", 1)})


def natural_key(column: str) -> Column:
    """A column to sort names by their first number, then as text."""
    return F.struct(F.regexp_extract(column, r"(\d+)", 1).try_cast("long").alias("n"), F.col(column).alias("name"))


def scale_minmax(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Columns between 0 and 1 within each group; constant ones become null."""
    w = Window.partitionBy(*by)
    low, high = (lambda c: F.min(c).over(w)), (lambda c: F.max(c).over(w))
    return df.withColumns({c: F.try_divide(F.col(c) - low(c), high(c) - low(c)) for c in columns})


def scale(df: DataFrame, columns: list[str], kind: str = "standard") -> DataFrame:
    """Columns over the whole table: standard (mean and population deviation), robust (median and
    quartiles) or minmax. Statistics are a row, so rows are not shuffled; quartiles come from a column's counted values."""
    out = df
    if kind == "robust":
        for i, c in enumerate(columns):
            q = quantiles(df.select(c), c, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
            out = out.join(F.broadcast(q.select(F.col("q2").alias(f"__m{i}"), (F.col("q3") - F.col("q1")).alias(f"__w{i}"))))
    else:
        stats = {"standard": lambda c: (F.avg(c), F.stddev_pop(c)), "minmax": lambda c: (F.min(c), F.max(c) - F.min(c))}[kind]
        one = df.agg(*[x.alias(f"__{n}{i}") for i, c in enumerate(columns) for n, x in zip("mw", stats(c), strict=True)])
        out = df.join(F.broadcast(one))
    return out.withColumns({c: F.try_divide(F.col(c) - F.col(f"__m{i}"), F.col(f"__w{i}")) for i, c in enumerate(columns)}).select(*df.columns)


def variances(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, variance): population variance of each column."""
    one = df.agg(*[F.var_pop(c).alias(c) for c in columns])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("variance")) for c in columns])))


def low_variance(df: DataFrame, columns: list[str], least: float) -> DataFrame:
    """Names and variances of the columns that stay: those above ``least``."""
    return variances(df, columns).where(F.col("variance") > least)


def spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, rho) for a < b: Pearson's correlation of mean ranks, over the rows that have all columns.
    Each column's ranks are those of its distinct values; all pairs come from one aggregation."""
    rows = df.select(*columns).dropna()
    for c in columns:
        ranks = average_ranks(rows.select(c), c).withColumnRenamed("rank", f"__r_{c}")
        rows = rows.join(ranks, c)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = rows.agg(*[F.corr(f"__r_{a}", f"__r_{b}").alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("rho")) for i, (a, b) in enumerate(pairs)])))


def greedy_drop(correlations: list[tuple[str, str, float]], utility: dict[str, float], above: float) -> list[str]:
    """Columns to drop so that no two that stay correlate above ``above``: pairs in order of the
    better and then the summed rank of their utility, of each the less useful. A list a column pair, so
    it is bounded by the table's width."""
    rank = {c: i for i, c in enumerate(sorted(utility, key=lambda c: (-utility[c], c)))}
    gone: list[str] = []
    for a, b, r in sorted(correlations, key=lambda x: (min(rank[x[0]], rank[x[1]]), rank[x[0]] + rank[x[1]], x[0], x[1])):
        if r > above and a not in gone and b not in gone:
            gone.append(max(a, b, key=lambda c: rank[c]))
    return gone


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: mutual information in nats of two columns of categories or bin numbers; nulls are left out."""
    n = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    both = n.withColumns({"na": F.sum("n").over(Window.partitionBy("a")), "nb": F.sum("n").over(Window.partitionBy("b"))})
    # sum n/N log(n N / (na nb)) = log N + sum n log(n / (na nb)) / N
    return both.agg(F.round(F.ln(F.sum("n")) + F.sum(F.col("n") * F.ln(F.col("n") / (F.col("na").cast("double") * F.col("nb")))) / F.sum("n"), 6).alias("mi"))


def bin_rules(df: DataFrame, by: str, value: str) -> DataFrame:
    """Numbers of bins by the square-root, Sturges, Rice and Doane rules and widths by Scott's and
    Freedman-Diaconis', for each group."""
    s = df.where(F.col(value).isNotNull()).groupBy(by).agg(
        F.count("*").alias("n"), F.stddev_samp(value).alias("__s"), F.skewness(value).alias("__g"), (F.percentile(value, 0.75) - F.percentile(value, 0.25)).alias("__iqr"),
    )
    n = F.col("n").cast("double")
    cube = F.pow(n, F.lit(1 / 3))
    sigma = F.sqrt(6 * (n - 2) / ((n + 1) * (n + 3)))
    return s.select(
        by, "n", F.ceil(F.sqrt(n)).alias("bins_sqrt"), (F.ceil(F.log2(n)) + 1).alias("bins_sturges"), F.ceil(2 * cube - 1e-9).alias("bins_rice"),
        F.ceil(1 + F.log2(n) + F.log2(1 + F.abs("__g") / sigma)).alias("bins_doane"), F.round(3.49 * F.col("__s") / cube, 4).alias("width_scott"), F.round(2 * F.col("__iqr") / cube, 4).alias("width_fd"),
    )


def normality(df: DataFrame, by: str, value: str) -> DataFrame:
    """D'Agostino's K2 of each group with eight rows or more: skewness and kurtosis, each made normal,
    squared and added; p is that of two degrees of freedom."""
    s = df.where(F.col(value).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.skewness(value).alias("__g"), (F.kurtosis(value) + 3).alias("__b2")).where("n >= 8 and __g is not null and not isnan(__g)")
    n = F.col("n").cast("double")
    y = F.col("__g") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    delta, alpha = 1 / F.sqrt(0.5 * F.ln(w2)), F.sqrt(2 / (w2 - 1))
    zs = delta * F.asinh(y / alpha)
    e, v = 3 * (n - 1) / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (F.col("__b2") - e) / F.sqrt(v)
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    base = (1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4)))
    zk = (1 - 2 / (9 * a) - F.signum(base) * F.pow(F.abs(base), F.lit(1 / 3))) / F.sqrt(2 / (9 * a))
    k2 = zs * zs + zk * zk
    return s.select(by, "n", F.round(k2, 6).alias("k2"), F.round(F.exp(-k2 / 2), 6).alias("p"))


def yeo_johnson(c: Column, power: float) -> Column:
    """The Yeo-Johnson transform of a column."""
    up = F.log1p(c) if power == 0 else (F.pow(c + 1, F.lit(power)) - 1) / power
    down = -F.log1p(-c) if power == 2 else -(F.pow(1 - c, F.lit(2 - power)) - 1) / (2 - power)
    return F.when(c >= 0, up).otherwise(down)


def best_yeo_johnson(df: DataFrame, value: str, powers: list[float] | None = None) -> DataFrame:
    """One row: the power of a grid (-2 to 4 by tenths) with the highest likelihood, all tried in one pass."""
    powers = [round(-2 + 0.1 * i, 1) for i in range(61)] if powers is None else powers
    c = F.col(value).cast("double")
    one = df.where(c.isNotNull()).agg(F.count("*").alias("n"), F.sum(F.signum(c) * F.log1p(F.abs(c))).alias("j"), *[F.var_pop(yeo_johnson(c, p)).alias(f"v{i}") for i, p in enumerate(powers)])
    tried = one.select(F.inline(F.array(*[F.struct(F.lit(float(p)).alias("power"), (-F.col("n") / 2 * F.ln(F.col(f"v{i}")) + (p - 1) * F.col("j")).alias("likelihood")) for i, p in enumerate(powers)])))
    return tried.agg(F.max_by("power", "likelihood").alias("power"), F.round(F.max("likelihood"), 4).alias("likelihood"))


def explained_variance(df: DataFrame, columns: list[str]) -> DataFrame:
    """(component, share, cumulative): principal components of the columns' covariance."""
    from pyspark.ml.feature import PCA, VectorAssembler

    v = VectorAssembler(inputCols=columns, outputCol="v").transform(df.select(*columns).dropna())
    shares = PCA(k=len(columns), inputCol="v", outputCol="p").fit(v).explainedVariance.toArray().tolist()
    rows = [(i + 1, x, math.fsum(shares[: i + 1])) for i, x in enumerate(shares)]  # as many as there are columns
    return df.sparkSession.createDataFrame(rows, "component int, share double, cumulative double")


def remaining(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``todo`` that ``done`` has no row for; null keys match nothing and stay."""
    return todo.join(done.select(*keys), keys, "left_anti")


def concatenated(parts: dict[str, DataFrame], name: str = "source") -> DataFrame:
    """Tables of the same columns as one, each row with its table's name."""
    tables = [d.withColumn(name, F.lit(n)) for n, d in parts.items()]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def group_means(df: DataFrame, by: str, means: dict[str, str], digits: int = 6) -> DataFrame:
    """Means of columns (name returned: column) and the number of rows of each group."""
    return df.groupBy(by).agg(*[F.round(F.avg(c), digits).alias(n) for n, c in means.items()], F.count("*").alias("n"))


def resources(counts: DataFrame, atoms: str = "natoms") -> DataFrame:
    """Processors (48 for each begun 64,000 atoms) and seconds (36 an atom over the processors) of a run."""
    cpus = F.expr(f"(({atoms} - 1) div 64000 + 1) * 48")
    return counts.withColumn("ncpus", cpus.cast("long")).withColumn("seconds", F.expr(f"36 * {atoms} div ncpus").cast("long"))
