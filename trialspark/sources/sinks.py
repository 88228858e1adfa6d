"""Report files: CSV by Spark's writer, a workbook and charts from small tables."""

from __future__ import annotations

import zipfile
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a sheet at most, as the format sets it: reports beyond it go to CSV.
SHEET_ROWS = 1_048_576


def _flat(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(F.col(c), "TRUE").otherwise(F.when(~F.col(c), "FALSE")).alias(c) if t == "boolean" else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, single: bool = True) -> None:
    """Header, empty cells for nulls, TRUE and FALSE. Reports have a row a trial or
    event; ``single`` gathers them in one file."""
    out = _flat(df)
    (out.coalesce(1) if single else out).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def _cell(value: object) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c><v>{value!r}</v></c>" if value == value else "<c/>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """An XLSX file with a sheet for each table, written row by row on the driver.

    A sheet's rows are streamed from Spark; more than the format holds is an error.
    """
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    numbers = range(1, len(sheets) + 1)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in numbers)
        out.writestr("[Content_Types].xml", f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        out.writestr("_rels/.rels", f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        out.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{pack}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers) + "</Relationships>")
        out.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name={quoteattr(n[:31])} sheetId="{i}" r:id="r{i}"/>' for i, n in zip(numbers, sheets, strict=True)) + "</sheets></workbook>")
        for i, df in zip(numbers, sheets.values(), strict=True):
            with out.open(f"xl/worksheets/sheet{i}.xml", "w") as sheet:
                sheet.write(f'<worksheet xmlns="{main}"><sheetData><row>{"".join(map(_cell, df.columns))}</row>'.encode())
                for n, row in enumerate(df.toLocalIterator(), 2):
                    if n > SHEET_ROWS:
                        raise ValueError("the table has more rows than a sheet")
                    sheet.write(f"<row>{''.join(map(_cell, row))}</row>".encode())
                sheet.write(b"</sheetData></worksheet>")


def bar_chart_svg(points: list[tuple[str, float]], width: int = 480, bar: int = 18) -> str:
    """Horizontal bars of a small chart table."""
    top = max([v for _, v in points] + [1e-9])
    rows = "".join(
        f'<text x="4" y="{i * bar + 13}" font-size="11">{escape(n)}</text><rect x="120" y="{i * bar + 3}" width="{(width - 130) * v / top:.1f}" height="{bar - 6}"/>' for i, (n, v) in enumerate(points)
    )
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{bar * len(points)}"><rect width="100%" height="100%" fill="white"/>{rows}</svg>'
