"""Readers of simulation logs and analysis output: numbered lines, read by splits, from which blocks and
columns are cut by column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granula.sources.lines import numbered_lines


def _words(line: Column | str) -> Column:
    return F.filter(F.split(F.trim(line), r"\s+"), lambda w: w != "")


def _last(c: Column, by: str = "path") -> Column:
    return F.last(c, True).over(Window.partitionBy(by).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))


def thermo(lines: DataFrame) -> DataFrame:
    """(path, run, row, step, name, value): thermo output of a log in long form. A run's table begins with
    a header line that starts with Step and ends at Loop time; rows that are no numbers are left out."""
    w = _words("line")
    head = F.col("line").rlike(r"^\s*Step\b")
    end = F.col("line").rlike(r"^\s*Loop time of\b")
    t = lines.withColumns({"w": w, "__head": head, "__end": end})
    run = F.sum(F.when(F.col("__head"), 1).otherwise(0)).over(Window.partitionBy("path").orderBy("line_no"))
    t = t.withColumns({"run": run.cast("int"), "names": _last(F.when(F.col("__head"), F.col("w"))), "__open": _last(F.when(F.col("__head"), 1).when(F.col("__end"), 0))})
    t = t.where("__open = 1 and not __head and size(w) = size(names) and size(filter(w, x -> try_cast(x as double) is null)) = 0")
    t = t.withColumn("row", F.row_number().over(Window.partitionBy("path", "run").orderBy("line_no")))
    return t.select("path", "run", "row", F.element_at("w", 1).cast("long").alias("step"), F.inline(F.arrays_zip(F.col("names").alias("name"), F.transform("w", lambda x: x.cast("double")).alias("value"))))


def thermo_wide(lines: DataFrame, *names: str) -> DataFrame:
    """(path, run, row, *names): the named columns of a log's thermo output."""
    return thermo(lines).groupBy("path", "run", "row").pivot("name", list(names)).agg(F.first("value"))


def energies_after(lines: DataFrame, marker: str = "- MINIMISATION -", closing: str = "Loop time of") -> DataFrame:
    """(path, conf_id, line): after each line with ``marker``, the line before the next with ``closing``;
    conf_id numbers them from 0 within a file."""
    w = Window.partitionBy("path").orderBy("line_no")
    t = lines.withColumns({"__b": F.lag("line").over(w), "__run": F.sum(F.when(F.col("line").contains(marker), 1).otherwise(0)).over(w), "__hit": F.col("line").contains(closing)})
    first = F.row_number().over(Window.partitionBy("path", "__run").orderBy("line_no"))
    t = t.where("__hit and __run > 0").withColumn("__k", first).where("__k = 1")
    return t.select("path", (F.col("__run") - 1).cast("int").alias("conf_id"), F.col("__b").alias("line"))


def minimised_rows(lines: DataFrame, first: int = 3) -> DataFrame:
    """(path, conf_id, T, P, PE, KE, TE): fields ``first`` to ``first`` + 4, from 1, of ``energies_after``."""
    t = energies_after(lines).withColumn("w", _words("line"))
    return t.select("path", "conf_id", *[F.try_element_at("w", F.lit(first + k)).try_cast("double").alias(n) for k, n in enumerate(("T", "P", "PE", "KE", "TE"))])


def energy_under(lines: DataFrame, header: str) -> DataFrame:
    """(path, value): the last number of the line that follows the first line with ``header``."""
    w = Window.partitionBy("path").orderBy("line_no")
    t = lines.withColumn("__b", F.lag("line").over(w)).where(F.col("__b").contains(header))
    return t.groupBy("path").agg(F.min_by("line", "line_no").alias("line")).select("path", F.element_at(_words("line"), -1).try_cast("double").alias("value"))


def property_after(lines: DataFrame, **patterns: str) -> DataFrame:
    """(path, *names): the first match of each pattern's first group in a log, as text."""
    hit = {n: F.regexp_extract("line", p, 1) for n, p in patterns.items()}
    t = lines.select("path", "line_no", *[F.when(h != "", h).alias(n) for n, h in hit.items()])
    return t.groupBy("path").agg(*[F.min_by(n, F.when(F.col(n).isNotNull(), F.col("line_no"))).alias(n) for n in patterns])


def log_totals(lines: DataFrame) -> DataFrame:
    """(path, atoms, neighbours, neighbours_an_atom, memory_mb, seconds): what a log states at its end."""
    t = property_after(
        lines, atoms=r"Loop time of .* with (\d+) atoms", neighbours=r"Total # of neighbors = (\S+)", ave=r"Ave neighs/atom = (\S+)",
        memory=r"Per MPI rank memory allocation .* = \S+ \| \S+ \| (\S+)", seconds=r"Loop time of (\S+) on",
    )
    return t.select("path", F.col("atoms").try_cast("long").alias("atoms"), F.col("neighbours").try_cast("double").alias("neighbours"), F.col("ave").try_cast("double").alias("neighbours_an_atom"),
                    F.col("memory").try_cast("double").alias("memory_mb"), F.col("seconds").try_cast("double").alias("seconds"))


def radial_blocks(lines: DataFrame) -> DataFrame:
    """(path, step, bin, r, g, n) of time-averaged radial output: comment lines start with #, a line of
    two numbers opens a block of so many rows."""
    w = _words("line")
    t = lines.where("line not like '#%' and trim(line) <> ''").withColumn("w", w)
    t = t.withColumn("step", _last(F.when(F.size("w") == 2, F.element_at("w", 1).cast("long")))).where("size(w) >= 4")
    n = lambda k: F.element_at("w", k).cast("double")
    return t.select("path", "step", F.element_at("w", 1).cast("int").alias("bin"), n(2).alias("r"), n(3).alias("g"), n(4).alias("n"))


def lindemann_table(lines: DataFrame, skip: int = 3) -> DataFrame:
    """(path, frame, value) behind ``skip`` title lines; zeros, which stand for frames outside the window, are left out."""
    w = _words("line")
    t = lines.where(F.col("line_no") > skip).select("path", F.try_element_at(w, F.lit(1)).try_cast("int").alias("frame"), F.try_element_at(w, F.lit(2)).try_cast("double").alias("value"))
    return t.where("value is not null and value <> 0")


def analysis_blocks(lines: DataFrame) -> DataFrame:
    """(path, row, name, value): comma-separated analysis output in long form. The header is the last line
    before the first that starts with a number; names and values lose padding, empty names are left out."""
    t = lines.where("trim(line) <> ''").withColumn("w", F.transform(F.split("line", ","), lambda x: F.trim(x)))
    t = t.withColumn("__data", F.element_at("w", 1).try_cast("double").isNotNull())
    w = Window.partitionBy("path").orderBy("line_no")
    t = t.withColumn("names", F.last(F.when(~F.col("__data"), F.col("w")), True).over(w)).where("__data and names is not null")
    t = t.withColumn("row", F.row_number().over(w))
    cells = t.select("path", "row", F.inline(F.arrays_zip(F.col("names").alias("name"), F.col("w").alias("value"))))
    return cells.where("name is not null and name <> ''").select("path", "row", "name", "value")


def control_file(lines: DataFrame) -> DataFrame:
    """(path, line_no, value, comment): settings of a control file, one a line; what follows ! is comment."""
    return lines.where("trim(line) <> ''").select("path", "line_no", F.trim(F.regexp_extract("line", "^([^!]*)", 1)).alias("value"), F.trim(F.regexp_extract("line", "!(.*)$", 1)).alias("comment")).where("value <> ''")


def split_on_blank(lines: DataFrame) -> DataFrame:
    """(path, part, line_no, line): lines in parts between blank lines, parts numbered from 1."""
    blank = F.trim("line") == ""
    w = Window.partitionBy("path").orderBy("line_no")
    t = lines.withColumns({"__blank": blank, "__new": (~blank & F.coalesce(F.lag(blank).over(w), F.lit(True))).cast("int")})
    return t.withColumn("part", F.sum("__new").over(w).cast("int")).where("not __blank").select("path", "part", "line_no", "line")


def parameter_table(lines: DataFrame, rows: int) -> DataFrame:
    """(path, element, values): elements, each a name line followed by ``rows`` lines of numbers."""
    w = Window.partitionBy("path").orderBy("line_no")
    t = lines.where("trim(line) <> ''").withColumn("__k", F.row_number().over(w) - 1)
    t = t.withColumns({"__block": F.expr(f"__k div {rows + 1}"), "__at": F.expr(f"__k % {rows + 1}")})
    return t.groupBy("path", "__block").agg(
        F.first(F.when(F.col("__at") == 0, F.trim("line")), True).alias("element"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("__at") > 0, F.struct("line_no", _words("line").alias("w"))))), lambda x: x["w"])).cast("array<double>").alias("values"),
    ).select("path", "element", "values")


def setfl(lines: DataFrame) -> DataFrame:
    """(path, elements, n_rho, d_rho, n_r, d_r, cutoff, numbers): a tabulated potential. Three comment lines, the
    elements, the grid, and all numbers behind it in order, element headers included."""
    w = Window.partitionBy("path")
    pick = lambda k: F.max(F.when(F.col("line_no") == k, F.col("w"))).over(w)
    t = lines.withColumn("w", _words("line")).withColumns({"__e": pick(4), "__g": pick(5)}).where("line_no > 5 and size(w) > 0")
    numbers = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "w"))), lambda x: x["w"]))
    g = t.groupBy("path", "__e", "__g").agg(F.transform(numbers, lambda x: x.try_cast("double")).alias("numbers"))
    at = lambda k: F.element_at("__g", k)
    return g.select("path", F.expr("slice(__e, 2, size(__e))").alias("elements"), at(1).cast("int").alias("n_rho"), at(2).cast("double").alias("d_rho"), at(3).cast("int").alias("n_r"), at(4).cast("double").alias("d_r"), at(5).cast("double").alias("cutoff"), "numbers")
