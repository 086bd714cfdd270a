"""Links and notices in HTML pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The tab of an edition.
EDITIONS = {"resp-tab2": "VES", "resp-tab3": "MAT"}


def links(pages: DataFrame, pattern: str = r'href="([^"]+)"') -> DataFrame:
    """(page_id, position, href) of all links whose markup matches, in page order. Runs inside the JVM."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("position", "href"))


def absolute(href, base):
    """A link against a page's address, as columns: absolute links stay, others are resolved against scheme and host."""
    root = F.regexp_extract(base, r"^(\w+://[^/?#]+)", 1)
    return F.when(href.rlike(r"^\w+://"), href).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(root, F.lit("/"), href))


class _Notices(HTMLParser):
    """Follows the open elements; a panel that has a heading with the word AVISOS gives all its note links."""

    def __init__(self):
        super().__init__()
        self.open: list[dict] = []
        self.found: list[tuple[str, str]] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "a" and (href := a.get("href")) and "/notas/" in href:
            note = href.split("/notas/")[1].split("/")[0].split("?")[0]
            if note.isdigit():
                for e in reversed(self.open):
                    if "panel-default" in e["class"]:
                        e["notes"].append(note)
                        break
        if tag not in ("br", "img", "input", "hr", "meta", "link"):
            self.open.append({"tag": tag, "class": (a.get("class") or "").split(), "id": a.get("id"), "notes": [], "notice": False})

    def handle_data(self, data):
        if data.strip() == "AVISOS" and self.open and "txt-traduct" in self.open[-1]["class"]:
            heading = False
            for e in reversed(self.open):
                heading |= "panel-heading" in e["class"]
                if heading and "panel-default" in e["class"]:
                    e["notice"] = True
                    break

    def handle_endtag(self, tag):
        while self.open:
            e = self.open.pop()
            if "panel-default" in e["class"] and e["notice"]:
                edition = next((EDITIONS[x["id"]] for x in reversed(self.open) if "tab-pane" in x["class"] and x["id"] in EDITIONS), None)
                if edition:
                    self.found += [(n, edition) for n in e["notes"]]
            if e["tag"] == tag:
                break


def notices(pages: DataFrame) -> DataFrame:
    """(page_id, position, note_id, edition) of the notices in each edition's tab."""

    def run(batches):
        for batch in batches:
            rows = []
            for page, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True):
                parser = _Notices()
                parser.feed(html or "")
                parser.close()
                rows += [(page, i, n, e) for i, (n, e) in enumerate(parser.found)]
            c = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.record_batch([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.string()), pa.array(c[3], pa.string())], names=["page_id", "position", "note_id", "edition"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id bigint, position int, note_id string, edition string")


def numbered(found: DataFrame) -> DataFrame:
    """Notices numbered within their page and edition, as three digits."""
    w = Window.partitionBy("page_id", "edition").orderBy("position")
    return found.withColumn("number", F.lpad(F.row_number().over(w).cast("string"), 3, "0"))
