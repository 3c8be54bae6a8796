"""Files that people read: one report per document, JSON lines, result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def report_stem(filename: Column | str, longest: int = 80) -> Column:
    """The file's name without folders and last suffix, cut to ``longest`` characters; "document" if nothing is left."""
    name = F.regexp_replace(F.coalesce(filename if isinstance(filename, Column) else F.col(filename), F.lit("")), r"^.*[/\\]", "")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), 1, longest), F.lit("")), F.lit("document"))


def write_reports(reports: DataFrame, path: str, filename: str) -> None:
    """One folder per document, report=<stem>, with the report as a JSON line, nulls included.

    Documents whose stems agree share a folder and keep a line each.  Meant for reports that
    are opened one by one; for a whole corpus ``write_json_lines`` makes fewer files.
    """
    line = F.to_json(F.struct(*(F.col(f"`{c}`") for c in reports.columns)), {"ignoreNullFields": "false"})
    reports.select(report_stem(filename).alias("report"), line.alias("value")).write.mode("overwrite").partitionBy("report").text(path)


def write_json_lines(records: DataFrame, path: str) -> None:
    """One JSON object a record, nulls included, in as many files as there are partitions."""
    records.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def markdown_lines(rows: DataFrame, order: list[str], title: str) -> DataFrame:
    """at, line of a Markdown table: heading, columns, then the rows by ``order``; bars are escaped, line ends become blanks."""
    cells = [F.replace(F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")) for c in rows.columns]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "| " + " | ".join("---" for _ in rows.columns) + " |"]
    top = rows.sparkSession.createDataFrame(list(enumerate(head)), "n int, line string")
    nulls = [F.lit(None).cast(dict(rows.dtypes)[c]).alias(f"k{i}") for i, c in enumerate(order)]
    body = rows.select(F.lit(len(head)).alias("n"), line.alias("line"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(order)))
    return top.select("n", "line", *nulls).unionByName(body).orderBy("n", *(f"k{i}" for i in range(len(order)))).select("line")


def write_results(rows: DataFrame, path: str, order: list[str], title: str) -> None:
    """The rows as CSV with a header below path/csv and as Markdown below path/markdown, both in order over the files' names."""
    rows.orderBy(*order).write.mode("overwrite").option("header", "true").option("escape", '"').csv(f"{path}/csv")
    markdown_lines(rows, order, title).write.mode("overwrite").text(f"{path}/markdown")
