"""Images in Markdown: which ones need a description, what stands around them, and putting descriptions in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IMAGE = r"!\[([^\]]*)\]\(([^)\s]+)\)"
#: File types, the least size, and how far around an image is looked.
SUFFIXES = ("png", "jpg", "jpeg", "gif", "webp", "bmp", "tif", "tiff")
LEAST_BYTES, BEFORE, AFTER, DONE_WITHIN, LONGEST_ALT = 5120, 800, 200, 250, 120


def tasks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, position, alt, ref, surrounding) of local images of a known type that have no description just before them and don't
    point outside their folder. The text is cut at its images once; from the parts before and after an image no more than what is
    looked at is put together."""
    text = F.col(text_col)
    rows = docs.select(id_col, F.split(text, IMAGE).alias("_parts"), F.regexp_extract_all(text, F.lit(IMAGE), F.lit(0)).alias("_all"))
    ends = F.transform("_parts", lambda p: F.right(p, F.lit(BEFORE)))
    begins = F.transform("_parts", lambda p: F.left(p, F.lit(AFTER)))
    rows = rows.select(id_col, ends.alias("_ends"), begins.alias("_begins"), F.posexplode("_all").alias("position", "_match"))

    def near(parts: Column, most: int, last: bool) -> Column:
        """So many characters of the parts together, from their end or their beginning; a part of that length ends the walk."""
        ordered = F.reverse(parts) if last else parts
        glued = F.aggregate(ordered, F.lit(""), lambda t, p: F.when(F.length(t) >= most, t).otherwise(F.concat(p, t) if last else F.concat(t, p)))
        return F.right(glued, F.lit(most)) if last else F.left(glued, F.lit(most))

    before = near(F.slice("_ends", 1, F.col("position") + 1), BEFORE, True)
    after = near(F.slice("_begins", F.col("position") + 2, F.size("_begins")), AFTER, False)
    rows = rows.select(id_col, "position", F.regexp_extract("_match", IMAGE, 1).alias("alt"), F.regexp_extract("_match", IMAGE, 2).alias("ref"), before.alias("_before"), after.alias("_after"))
    good = ~F.col("ref").rlike(r"^https?://") & F.lower("ref").rlike(r"\.(" + "|".join(SUFFIXES) + ")$") & ~F.col("ref").rlike(r"(^|/)\.\.(/|$)|^/") & ~F.contains(F.right("_before", F.lit(DONE_WITHIN)), F.lit("IMAGE_DESCRIPTION:"))
    around = F.trim(F.regexp_replace(F.concat("_before", "_after"), r"\n{3,}", "\n\n"))
    return rows.filter(good).select(id_col, "position", "alt", "ref", around.alias("surrounding"))


def described(text: Column, ref: Column, alt: Column, description: Column) -> Column:
    """The text with the description put before the image's first occurrence; an image without a name gets the first sentence."""
    name = F.when(alt != "", alt).otherwise(F.left(F.trim(F.substring_index(description, ".", 1)), F.lit(LONGEST_ALT)))
    old = F.concat(F.lit("!["), alt, F.lit("]("), ref, F.lit(")"))
    new = F.concat(F.lit("<!-- IMAGE_DESCRIPTION: "), ref, F.lit("\n"), description, F.lit("\n-->\n!["), name, F.lit("]("), ref, F.lit(")"))
    at = F.instr(text, old)
    return F.when(at > 0, F.concat(F.left(text, at - 1), new, F.substr(text, at + F.length(old)))).otherwise(text)


def described_all(text: Column, found: Column) -> Column:
    """The text with all descriptions (array of structs: ref, alt, description) put in, one after another."""
    return F.aggregate(found, text, lambda t, x: described(t, x["ref"], x["alt"], x["description"]))


def rewritten(text: Column, folder: str) -> Column:
    """Image paths under ``folder`` instead of wherever they pointed, and attribute blocks after images gone."""
    return F.regexp_replace(F.regexp_replace(text, r"!\[([^\]]*)\]\((?:[^)\s]*/)?([^)/\s]+)\)", rf"![$1]({folder}/$2)"), r"(!\[[^\]]*\]\([^)]*\))\{[^}]*\}", "$1")


def distinct_files(files: DataFrame) -> DataFrame:
    """(path, length): files of a known type and at least the least size, each path once."""
    return files.filter((F.col("length") >= LEAST_BYTES) & F.lower("path").rlike(r"\.(" + "|".join(SUFFIXES) + ")$")).dropDuplicates(["path"]).select("path", "length")
