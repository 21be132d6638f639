"""Tables out of HTML and statistics of JSON trees."""

from __future__ import annotations

import json
from collections import Counter
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.batches import flat_map, map_lists


class _Rows(HTMLParser):
    """Cell texts of the rows in table bodies."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.open = {"table": 0, "tbody": 0, "td": 0}

    def handle_starttag(self, tag, attrs):
        if tag in ("table", "tbody"):
            self.open[tag] += 1
        elif self.open["table"] and self.open["tbody"]:
            if tag == "tr":
                self.rows.append([])
                self.open["td"] = 0
            elif tag == "td" and self.rows:
                self.rows[-1].append("")
                self.open["td"] = 1

    def handle_endtag(self, tag):
        if tag in ("table", "tbody"):
            self.open[tag] = max(self.open[tag] - 1, 0)
        elif tag in ("td", "tr"):
            self.open["td"] = 0

    def handle_data(self, data):
        if self.open["td"] and self.rows and self.rows[-1]:
            self.rows[-1][-1] += data


def table_rows(html: str | None, width: int = 4, filled: int = 3) -> list[tuple[str, ...]]:
    """Rows of exactly `width` cells whose first `filled` ones hold text, white space around it cut off."""
    parser = _Rows()
    parser.feed(html or "")
    parser.close()
    rows = [tuple(c.strip() for c in r) for r in parser.rows]
    return [r for r in rows if len(r) == width and all(r[:filled])]


def html_tables(pages: DataFrame, key: str, html: str, names: tuple[str, ...] = ("chinese", "pinyin", "english", "level")) -> DataFrame:
    """The key of the page (as a string) and the cells of every row found in it."""
    schema = f"`{key}` string, " + ", ".join(f"`{n}` string" for n in names)
    return flat_map(pages.select(F.col(key).cast("string"), html), schema, lambda k, h: [(k, *r) for r in table_rows(h, len(names))])


def kinds(text: str | None) -> Counter:
    """How often each value of "kind" occurs in the objects of a JSON text; an object without one counts as "unknown"."""
    found: Counter = Counter()
    try:
        todo = [json.loads(text)] if text else []
    except ValueError:
        return found
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            found[str(x.get("kind", "unknown"))] += 1
            todo += [v for k, v in x.items() if k != "kind"]
        elif isinstance(x, list):
            todo += x
    return found


def kind_counts(texts: DataFrame, column: str) -> DataFrame:
    """(kind, n) over all JSON texts of a column; texts that aren't JSON have none. Counted by batch before the shuffle."""
    return map_lists(texts.select(column), "kind string, n long", lambda column: list(sum(map(kinds, column), Counter()).items())).groupBy("kind").agg(F.sum("n").alias("n"))
