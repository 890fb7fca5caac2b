"""Report files: result tables as one HTML page, and as JSON.

Cells are rendered where the rows are; what a page shows of a table is a fixed number of rows.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a table that a page shows; the tables themselves are written whole.
SHOWN = 100
_STYLE = "body{font:15px sans-serif;margin:2em}table{border-collapse:collapse;margin-bottom:2em}td,th{border:1px solid #ccc;padding:4px 8px;text-align:left}"
_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))


def escaped(text: Column) -> Column:
    for plain, entity in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def _escaped(text: str) -> str:
    for plain, entity in _ESCAPES:
        text = text.replace(plain, entity)
    return text


def cell(value: Column, kind: T.DataType) -> Column:
    """A value as escaped text: nothing for null, whole numbers without a fraction, nested values as JSON."""
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(value)
    elif isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        text = F.regexp_replace(value.cast("string"), r"\.0+$", "")
    else:
        text = value.cast("string")
    return F.coalesce(escaped(text), F.lit(""))


def html_lines(title: str, sections: dict[str, DataFrame], shown: int = SHOWN) -> DataFrame:
    """(section, no, line) of a page with a table for every section: its first rows, in the order of the table, and whether there are more."""
    head = [(0, 0, f"<!DOCTYPE html><html lang='en'><head><meta charset='utf-8'><title>{_escaped(title)}</title><style>{_STYLE}</style></head><body><h1>{_escaped(title)}</h1>")]
    lines = None
    for at, (name, table) in enumerate(sections.items(), 1):
        columns = "".join(f"<th>{_escaped(c)}</th>" for c in table.columns)
        head += [(at, -1, f"<h2>{_escaped(name)}</h2><table><tr>{columns}</tr>"), (at, shown + 1, "</table>")]
        few = table.limit(shown + 1).withColumn("_no", F.monotonically_increasing_id())  # one task holds what a limit leaves
        cells = [F.concat(F.lit("<td>"), cell(F.col(f"`{f.name}`"), f.dataType), F.lit("</td>")) for f in table.schema.fields]
        row = F.when(F.col("_no") < shown, F.concat(F.lit("<tr>"), *cells, F.lit("</tr>"))).otherwise("</table><p>There are more rows.</p>")
        here = few.select(F.lit(at).alias("section"), F.col("_no").cast("int").alias("no"), row.alias("line"))
        lines = here if lines is None else lines.unionByName(here)
    head.append((len(sections) + 1, 0, "</body></html>"))
    if lines is None:
        raise ValueError("a report needs a section")
    frame = lines.sparkSession.createDataFrame(head, "section int, no int, line string")
    # a table that is cut ends with the remark, any other with its own end
    cut = lines.filter(F.col("no") == shown).select("section", F.lit(shown + 1).alias("no"))
    return frame.join(cut, ["section", "no"], "left_anti").unionByName(lines)


def html_report(title: str, sections: dict[str, DataFrame], shown: int = SHOWN) -> str:
    """The page of :func:`html_lines`, at most ``shown`` + 3 lines a section."""
    return "\n".join(r.line for r in html_lines(title, sections, shown).orderBy("section", "no").collect())


def write_report(path: str, title: str, sections: dict[str, DataFrame], shown: int = SHOWN) -> None:
    """``report.html`` below a local ``path``, and every section whole as JSON lines beside it."""
    Path(path).mkdir(parents=True, exist_ok=True)
    (Path(path) / "report.html").write_text(html_report(title, sections, shown), encoding="utf-8")
    for name, table in sections.items():
        table.write.mode("overwrite").json(f"{path}/{name}")


def write_lines(path: str, lines: DataFrame) -> None:
    """Lines as text files in a folder, in the order of the other columns within and across files; any number of lines."""
    order = [c for c in lines.columns if c != "line"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)
