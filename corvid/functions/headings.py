"""Headings of Markdown documents: chains of open ones, and the headers that chunks get from them. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.functions.text import heading_level

CHAINED = "array<struct<at:int,chain:array<struct<level:int,text:string>>>>"


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, i, start, line): every line with its number and the position, from 0, where it begins."""
    rows = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("i", "line"))
    before = Window.partitionBy(id_col).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)))


def section_starts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start): where second-level sections begin, from 0."""
    return lines_of(docs, id_col, text_col).filter(F.col("line").rlike(r"^## .+")).select(id_col, "start")


def listed(text: Column) -> Column:
    """The headings of a text, in order, as an array of structs (at: line from 0, level, text)."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("at"), heading_level(x).alias("level"), F.trim(F.regexp_replace(x, r"^#{1,6}[ \t]+", "")).alias("text")))
    return F.filter(lines, lambda x: x["level"] > 0)


def sibling_chains(headings: Column) -> Column:
    """For each heading the chain that is open from its line on, as structs (at, chain of level and text).

    A first-level heading closes all before it. Any other is added to the chain, and if it is above the one before it, those that
    are not above it are closed first; so siblings stay open next to each other.
    """
    plain = headings.cast("array<struct<at:int,level:int,text:string>>")

    def step(state: Column, h: Column) -> Column:
        own = F.array(F.struct(h["level"].alias("level"), h["text"].alias("text")))
        above = F.filter(state["chain"], lambda x: x["level"] < h["level"])
        climbs = F.coalesce(F.try_element_at(state["chain"], F.lit(-1))["level"] > h["level"], F.lit(False))
        chain = F.when(h["level"] == 1, own).when(climbs, F.concat(above, own)).otherwise(F.concat(state["chain"], own))
        return F.struct(chain.alias("chain"), F.concat(state["out"], F.array(F.struct(h["at"].alias("at"), chain.alias("chain")))).alias("out"))

    empty = F.struct(F.array().cast("array<struct<level:int,text:string>>").alias("chain"), F.array().cast(CHAINED).alias("out"))
    return F.aggregate(plain, empty, step, lambda s: s["out"])


def open_headings(lines: DataFrame, id_col: str = "doc_id", levels: int = 3) -> DataFrame:
    """``lines`` (id, i, line) with h1, h2, ...: before each line the latest heading of each level that no shallower one has closed."""
    w = Window.partitionBy(id_col).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.withColumn("level", heading_level(F.col("line")))
    for k in range(1, levels + 1):
        rows = rows.withColumn(f"at{k}", F.max(F.when(F.col("level") == k, F.col("i"))).over(w)).withColumn(f"h{k}", F.last(F.when(F.col("level") == k, F.col("line")), ignorenulls=True).over(w))
    for k in range(2, levels + 1):
        shallower = F.greatest(*(F.coalesce(F.col(f"at{j}"), F.lit(-1)) for j in range(1, k)), F.lit(-1))
        rows = rows.withColumn(f"h{k}", F.when(F.col(f"at{k}") > shallower, F.col(f"h{k}")))
    return rows.drop("level", *(f"at{k}" for k in range(1, levels + 1)))


def _marked(h: Column) -> Column:
    return F.concat(F.repeat(F.lit("#"), h["level"]), F.lit(" "), h["text"])


def chunk_header(title: Column, page: Column, chain: Column, number: Column) -> Column:
    """The lines above a chunk: its document and page, and the open headings; a document's first chunk has the first one only."""
    shown = F.when(number == 1, F.slice(chain, 1, 1)).otherwise(chain)
    return F.array_join(F.concat(F.array(F.concat(F.lit("# Document: "), title, F.lit(" | page: "), page)), F.transform(shown, _marked)), "\n")


def section_header(title: Column, names: Column) -> Column:
    """A document's name and the headings of a chunk as one line."""
    return F.concat(F.lit("Document: "), title, F.when(F.size(names) > 0, F.concat(F.lit(" | Section: "), F.array_join(names, " > "))).otherwise(""))


def header_context(path: Column) -> Column:
    """A heading path as Markdown: the first as a first-level heading, all others as second-level ones."""
    return F.array_join(F.transform(path, lambda h, i: F.concat(F.when(i == 0, "# ").otherwise("## "), h)), "\n")


def page_parts(text: Column) -> Column:
    """(page, part) of a text with page marks like {3}-----: what stands before a mark belongs to its page, the rest to the last
    page marked, or to page 1; empty parts are left out."""
    parts, pages = F.split(text, r"\{\d+\}-+"), F.regexp_extract_all(text, F.lit(r"\{(\d+)\}-+"), F.lit(1))
    last = F.coalesce(F.try_element_at(pages, F.lit(-1)), F.lit("1"))
    rows = F.transform(parts, lambda p, i: F.struct(i.alias("i"), F.coalesce(F.get(pages, i), last).alias("page"), p.alias("part")))
    return F.filter(rows, lambda r: r["part"] != "")
