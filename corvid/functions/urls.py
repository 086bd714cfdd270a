"""Where a file's original is published, from its name; title and address of a document from its path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The address of the published originals, with places for file and year.
ORIGINAL = "https://diariooficial.gob.mx/abrirPDF.php?archivo={}.pdf&anio={}&repo=repositorio/"


def _address(name: Column, year: Column) -> Column:
    before, between, after = ORIGINAL.split("{}")
    return F.concat(F.lit(before), name, F.lit(between), year, F.lit(after))


def stem(path: Column) -> Column:
    """A path's last part without its ending."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def by_date(path: Column) -> Column:
    """For names like DDMMYYYY_XXX or DDMMYYYY-XXX: underscores become hyphens, and the year is the fifth to eighth character; null
    for names of less than eight."""
    name = F.replace(stem(path), F.lit("_"), F.lit("-"))
    return F.when(F.length(name) >= 8, _address(name, F.substring(name, 5, 4)))


def by_part(path: Column) -> Column:
    """For names of several parts: the year is in the first part of exactly eight digits; null where there is none."""
    dates = F.filter(F.split(stem(path), "_"), lambda p: p.rlike(r"^\d{8}$"))
    return F.when(F.size(dates) > 0, _address(F.replace(stem(path), F.lit("_"), F.lit("-")), F.substring(F.element_at(dates, 1), 5, 4)))


def document_metadata(path: Column) -> list[Column]:
    """Title and address of a document."""
    return [stem(path).alias("title"), by_date(path).alias("url")]
