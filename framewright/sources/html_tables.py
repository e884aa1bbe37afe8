"""HTML tables of a pages table as rows."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "page_id long, table_ix int, row_ix int, cells map<string,string>"


class _Tables(HTMLParser):
    """Collects header cells and data rows of every table; nested tables count as tables of their own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[dict] = []
        self.open: list[dict] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            table = {"heads": [], "rows": [], "row": None, "cell": None, "in": None}
            self.tables.append(table)
            self.open.append(table)
        elif self.open:
            table = self.open[-1]
            if tag == "tr":
                self._end_row(table)
                table["row"] = []
            elif tag in ("td", "th"):
                self._end_cell(table)
                table["cell"], table["in"] = [], tag

    def handle_endtag(self, tag):
        if not self.open:
            return
        table = self.open[-1]
        if tag in ("td", "th"):
            self._end_cell(table)
        elif tag == "tr":
            self._end_row(table)
        elif tag == "table":
            self._end_row(table)
            self.open.pop()

    def handle_data(self, data):
        for table in self.open:
            if table["cell"] is not None:
                table["cell"].append(data)

    def _end_cell(self, table):
        if table["cell"] is None:
            return
        text = "".join(table["cell"]).strip()
        if table["in"] == "th":
            table["heads"].append(text or f"Col_{len(table['heads'])}")
        else:
            table["row"] = [] if table["row"] is None else table["row"]
            table["row"].append(text)
        table["cell"] = None

    def _end_row(self, table):
        self._end_cell(table)
        if table["row"]:
            table["rows"].append(table["row"])
        table["row"] = None


def tables_of(html: str) -> list[list[dict[str, str]]]:
    """Rows of every table that has data cells, as column name -> text."""
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    out = []
    for table in parser.tables:
        parser._end_row(table)
        heads = table["heads"]
        rows = [{(heads[i] if i < len(heads) else f"Col_{i}"): v for i, v in enumerate(r)} for r in table["rows"]]
        if rows:
            out.append(rows)
    return out


def html_tables(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per table row of every page. Pages are independent, so nothing is shuffled: a split of the input is a task."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, text in zip(batch["page_id"], batch["html"]):
                for t, table in enumerate(tables_of(text)):
                    rows += [(page, t, r, cells) for r, cells in enumerate(table)]
            yield pd.DataFrame(rows, columns=["page_id", "table_ix", "row_ix", "cells"])

    src = pages.selectExpr(f"cast(`{key}` as long) as page_id", f"`{html}` as html").where("lower(html) like '%<table%'")
    return src.mapInPandas(extract, SCHEMA)
