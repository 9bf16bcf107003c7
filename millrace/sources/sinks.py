"""Writers of tables and reports. What they write has a row per mode, query or axis; it is small."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from . import xlsx


def csv(table: DataFrame, path: str) -> DataFrame:
    """One CSV file with a header in folder `path`, replacing it; returns the table as written."""
    table.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return table.sparkSession.read.option("header", True).option("escape", '"').schema(table.schema).csv(path)


def excel(table: DataFrame, path: str) -> None:
    """One workbook at `path`."""
    table.sparkSession.dataSource.register(xlsx.Workbook)
    table.coalesce(1).write.format("workbook").mode("append").save(path)


def markdown(table: DataFrame, most: int = 1000) -> str:
    """The table as Markdown, at most so many rows; numbers to the right."""
    rows = table.limit(most).collect()
    number = {f.name: f.dataType.typeName() in ("integer", "long", "double", "float", "decimal") for f in table.schema.fields}
    show = lambda v: "" if v is None else f"{v:g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [table.columns, ["---:" if number[c] else ":---" for c in table.columns], *[[show(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def averages(table: DataFrame) -> str:
    """A line per numeric column with its mean over the rows that have it."""
    names = [f.name for f in table.schema.fields if f.dataType.typeName() in ("integer", "long", "double", "float")]
    row = table.agg(*[F.avg(c).alias(c) for c in names]).first()
    return "\n".join(f"Avg {c}: {row[c]:.2f}" if row[c] is not None else f"Avg {c}: none" for c in names)


def counted(rows: DataFrame, name: str = "sent") -> tuple[DataFrame, Observation]:
    """rows (fits, n_tokens, ...) and what is observed as they pass: probes sent, probes over the budget and thousands of tokens sent."""
    o = Observation(name)
    fits = F.col("fits")
    return rows.observe(o, F.count_if(fits).alias("sent"), F.count_if(~fits).alias("over"), (F.coalesce(F.sum(F.when(fits, F.col("n_tokens"))), F.lit(0)) / 1000).cast("long").alias("kilo_tokens")), o


def panels(results: DataFrame, xs: tuple[str, ...] = ("tokens", "words"), ys: tuple[str, ...] = ("lat", "tflops", "meas_tflops")) -> DataFrame:
    """x_name, y_name, x, naive, grid: the mean lines of the cost figures. Only panels with a value in either series are there."""
    each = F.array(*[F.struct(F.lit(x).alias("x_name"), F.lit(y).alias("y_name"), F.col(x).cast("double").alias("x"), F.col(f"naive_{y}").cast("double").alias("n"), F.col(f"grid_{y}").cast("double").alias("g")) for x in xs for y in ys])
    lines = results.select(F.inline(each)).groupBy("x_name", "y_name", "x").agg(F.avg("n").alias("naive"), F.avg("g").alias("grid"))
    panel = Window.partitionBy("x_name", "y_name")
    return lines.withColumn("has", F.bool_or(F.col("naive").isNotNull() | F.col("grid").isNotNull()).over(panel)).where("has").drop("has")
