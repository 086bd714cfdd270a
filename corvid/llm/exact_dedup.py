"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text, with all white space deleted, is cut into chunks whose ends its own characters decide. A chunk's fingerprint becomes
a verified identifier once all chunks of that fingerprint, compared by their full text, are the same; where they are not, a
variant number tells them apart. A document then is an ordered list of identifiers (its recipe), and documents are equal
exactly when their recipes are. Texts are cut once; chunk texts move once, to be verified; after that only recipes move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.llm.common import by_ids, release, saved, workspace

#: Deleted before texts are compared: the class [\x20\x09-\x0D].
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
#: A chunk may end after a character of the first class followed by one of the second.
CUT = ("[aiqxAIQXéü一-刀а]", "[cgmstvzCGMSTVZñè怀-瀀н]")
#: Code points in a chunk, apart from a text's last.
MIN_CHUNK, MAX_CHUNK = 768, 12_288


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def chunks_of(text: Column, shortest: int = MIN_CHUNK, longest: int = MAX_CHUNK) -> Column:
    """Cut a text at content-defined places; the chunks in order make up the whole text, and the empty text has none."""
    first, second = CUT
    pattern = f"(?s).{{{shortest - 2},{longest - 2}}}?{first}{second}|.{{1,{longest}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def fingerprint(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def recipes(docs: DataFrame, fingerprint=fingerprint, shortest: int = MIN_CHUNK, longest: int = MAX_CHUNK) -> DataFrame:
    """(doc_id, n_code_points, text_sha256, recipe), a row per row of ``docs``: the recipe is an ordered array of (fingerprint,
    variant) identifiers.

    Variants are all 0 unless the check of the full chunk texts finds two chunks of one fingerprint.
    """
    text = docs.select(F.col("doc_id"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_code_points"), normalised(F.col("text")).alias("norm"))
    cut = text.select("doc_id", "n_code_points", F.sha2("norm", 256).alias("text_sha256"), chunks_of(F.col("norm"), shortest, longest).alias("chunks"))
    cut = saved(cut.withColumn("prints", F.transform("chunks", fingerprint)), "chunks", "lz4")
    pieces = cut.select("text_sha256", F.posexplode(F.arrays_zip("prints", "chunks")).alias("pos", "piece")).select("text_sha256", "pos", F.col("piece.prints").alias("print"), F.col("piece.chunks").alias("chunk"))
    distinct = pieces.groupBy("print", "chunk").agg(F.lit(1).alias("one"))
    clashing = saved(distinct.groupBy("print").count().filter("count > 1").select("print"), "clashing-prints")
    if clashing.isEmpty():
        release(clashing)
        return cut.select("doc_id", "n_code_points", "text_sha256", F.transform("prints", lambda p: F.struct(p.alias("print"), F.lit(0).alias("variant"))).alias("recipe"))
    variants = pieces.join(clashing, "print", "left_semi").groupBy("print", "chunk").agg(F.lit(1).alias("one"))
    variants = variants.select("print", "chunk", F.row_number().over(Window.partitionBy("print").orderBy("chunk")).alias("variant"))
    # A text is told by its digest here, so texts that share a doc_id keep recipes of their own.
    named = saved(pieces.join(variants, ["print", "chunk"], "left").select("text_sha256", "pos", "print", F.coalesce("variant", F.lit(0)).alias("variant")).distinct(), "named-chunks")
    lists = named.groupBy("text_sha256").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "print", "variant"))), lambda x: F.struct(x["print"].alias("print"), x["variant"].alias("variant"))).alias("recipe"))
    out = cut.drop("chunks").join(lists, "text_sha256", "left")
    return out.select("doc_id", "n_code_points", "text_sha256", F.coalesce("recipe", F.array().cast("array<struct<print:bigint,variant:int>>")).alias("recipe"))


def exact_groups(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in its original text stays, then the smallest doc_id (a null doc_id is the
    smallest). Null text counts as empty, and empty texts are equal to each other. Texts of any length are compared whole. Rows
    that repeat a doc_id and text count each and share their fate; rows that share a doc_id but not a text are told apart. Extra
    columns are ignored, whatever their names; an empty table gives an empty result.
    """
    rows = recipes(docs.select("doc_id", "text"), **options)
    groups = rows.groupBy("recipe").agg(F.min(F.struct(-F.col("n_code_points"), F.col("doc_id"))).alias("best"), F.count(F.lit(1)).alias("group_size"))
    # Only groups of two or more go back to their documents; written first, so that the join's own exchanges can be split.
    shared = saved(groups.filter("group_size > 1").select("recipe", F.col("best.doc_id").alias("best_id"), "group_size"), "equal-groups")
    out = rows.join(shared, "recipe", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("best_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256")


def dedup(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows go by doc_id (null ones too) and a hash of their text, so of rows that share a doc_id only those whose text has another
    keeper go. Of rows that are the same in both one can't be told from the other: all of them stay, or none.
    """
    with workspace():
        gone = exact_groups(docs, **options).filter(~F.col("kept"))
        gone = saved(gone.select(F.col("doc_id").alias("_gone_id"), F.xxhash64("text_sha256").alias("_gone_text")).distinct(), "dropped", keep=True)
    same = docs["doc_id"].eqNullSafe(gone["_gone_id"]) & (F.xxhash64(F.sha2(normalised(docs["text"]), 256)) == gone["_gone_text"])
    return by_ids(docs, gone, same, "left_anti").select(docs.columns)
