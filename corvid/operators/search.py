"""Two-stage search: documents first, then chunks of those documents, for one query or thousands at once.

Rankings are rows (query_id, item, score, rank) all along. After the first top-k every later join meets a few hundred rows per query.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.functions.text import fold, is_fragment_title, query_tokens, tokens
from corvid.operators import fusion, lexical
from corvid.operators import index as index_of
from corvid.operators.lexical import ranked
from corvid.sources.store import drop, held

#: Acronyms and the words they stand for, and what marks a norm's identifier.
ALIASES = {"inegi": ["instituto", "nacional", "estadistica", "geografia"], "inpc": ["indice", "nacional", "precios", "consumidor"], "uma": ["unidad", "medida", "actualizacion"]}
#: Words that begin an instrument's name, words that end it once it has three, and most words of it; how a dated plan
#: is named; what a document gets whose title or heading the query names.
NAME_STARTS = ("ley", "codigo", "reglamento")
NAME_ENDS = ("al", "articulo", "conforme", "declararse", "es", "fue", "publicada", "publicado", "que", "reglamentaria", "reglamentario", "se", "segun", "son")
LONGEST_NAME, SHORTEST_NAME, NAMED_BONUS = 12, 3, 200.0
#: Documents that hold an instrument's name, the best of which are looked at for a title with it.
MOST_NAMED = 100
DATED_PLAN = r"(?i)\bplan nacional de desarrollo\s+(?:19|20)\d{2}-(?:19|20)\d{2}\b"
IDENTIFIER = r"(?i)\b(?:NOM|NMX)-\d{3}(?:-[A-Z]+)*(?:-\d{4})?\b"


@dataclass(frozen=True)
class Filters:
    """Metadata conditions; a null date or section fails a condition on it."""

    as_of: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    section: str | None = None

    def __post_init__(self):
        for name in ("as_of", "date_from", "date_to"):
            if (value := getattr(self, name)) is not None:
                datetime.date.fromisoformat(value)
        if self.section is not None:
            object.__setattr__(self, "section", self.section.strip().upper() or None)
        if self.date_from and self.date_to and self.date_from > self.date_to:
            raise ValueError("date_from is after date_to")

    def within(self, cutoff: str | None) -> Filters:
        """These filters under a run's cutoff; asking for anything later is an error."""
        if cutoff and any(d and d > cutoff for d in (self.as_of, self.date_to)):
            raise ValueError(f"later than the cutoff {cutoff}")
        return Filters(self.as_of or cutoff, self.date_from, self.date_to, self.section)

    def condition(self, date: str = "publication_date", section: str = "section") -> Column:
        out = F.lit(True)
        if self.as_of:
            out &= F.col(date) <= F.lit(self.as_of).cast("date")
        if self.date_from:
            out &= F.col(date) >= F.lit(self.date_from).cast("date")
        if self.date_to:
            out &= F.col(date) <= F.lit(self.date_to).cast("date")
        if self.section:
            out &= F.col(section) == self.section
        return out


def publications(meta: DataFrame, filters: Filters, limit: int) -> DataFrame:
    """Newest first, then largest id."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be from 1 to 500")
    return meta.filter(filters.condition()).orderBy(F.desc("publication_date"), F.desc("doc_id")).limit(limit)


def expanded(words: Column) -> Column:
    """A query's words and those its acronyms stand for, each once, in order."""
    table = F.create_map(*[x for k, v in ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    more = F.flatten(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(words, more))


def identifiers(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0)), F.upper))


def title_boost(query: Column, title: Column) -> Column:
    """For a title that names an identifier of the query: 100 (three hyphens or more) or 40, 40 more if it is the norm itself, and
    12 for each word in common, four at most."""
    folded = F.coalesce(fold(title), F.lit(""))
    named = F.filter(identifiers(query), lambda i: F.contains(folded, fold(i)))
    base = F.coalesce(F.array_max(F.transform(named, lambda i: F.when(F.length(i) - F.length(F.replace(i, F.lit("-"), F.lit(""))) >= 3, 100.0).otherwise(40.0))), F.lit(0.0))
    common = F.least(F.size(F.array_intersect(tokens(query), tokens(title))), F.lit(4)) * 12.0
    return F.when(base > 0, base + F.when(folded.startswith("norma oficial mexicana"), 40.0).otherwise(0.0) + common).otherwise(F.lit(0.0))


def named_instruments(query: Column) -> Column:
    """The names of laws, codes and regulations in a question, as arrays of folded words: from the word that begins a name up to
    twelve words, less from the first word on that ends one after the third."""
    words = query_tokens(query)
    begins = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: F.element_at(words, i).isin(*NAME_STARTS))
    begins = F.when(F.size(words) > 0, begins).otherwise(F.array().cast("array<int>"))
    tails = F.transform(begins, lambda i: F.slice(words, i, LONGEST_NAME))

    def cut(tail: Column) -> Column:
        rest = F.slice(tail, SHORTEST_NAME + 1, LONGEST_NAME)
        stop = F.array_min(F.transform(F.array(*map(F.lit, NAME_ENDS)), lambda w: F.nullif(F.array_position(rest, w), F.lit(0).cast("bigint"))))
        return F.slice(tail, F.lit(1), F.coalesce((stop + SHORTEST_NAME - 1).cast("int"), F.size(tail)))

    return F.array_distinct(F.filter(F.transform(tails, cut), lambda n: F.size(n) >= SHORTEST_NAME))


def title_candidates(titles: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, words): documents (doc_id, title) whose title has an instrument's name of the question, word for word."""
    names = queries.select("query_id", F.explode(named_instruments(F.col("text"))).alias("words"))
    rows = titles.select("doc_id", F.col("title").alias("text"))
    named = names.select(F.col("words"), F.xxhash64("words").alias("phrase")).distinct()
    hits = lexical.phrase_hits(rows, named, "phrase").select("doc_id", "phrase").join(named, "phrase")
    return hits.join(names, "words").select("query_id", "doc_id", "words").distinct()


def heading_candidates(headings: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, heading): documents with a heading (doc_id, heading_path) that names a dated plan of the question."""

    def plans(text: Column) -> Column:
        return F.array_distinct(F.transform(F.regexp_extract_all(fold(text), F.lit(DATED_PLAN), F.lit(0)), lambda p: F.regexp_replace(p, r"\s+", " ")))

    asked = queries.select("query_id", F.explode(plans(F.col("text"))).alias("plan"))
    rows = headings.select("doc_id", F.posexplode("heading_path").alias("depth", "heading")).select("doc_id", "depth", "heading", F.explode(plans(F.col("heading"))).alias("plan"))
    return rows.join(asked, "plan").groupBy("query_id", "doc_id").agg(F.min_by("heading", F.struct("depth", "heading")).alias("heading"))


STRATEGIES = ("lexical", "vector", "hybrid")


def documents(docs: DataFrame, queries: DataFrame, meta: DataFrame, filters: Filters | None = None, vector_hits: DataFrame | None = None, depth: int = 50, top_k: int = 20, weight: float = 0.75, prefer_recent: bool = False, recency_weight: float = 0.15, titles: DataFrame | None = None, headings: DataFrame | None = None, strategy: str = "hybrid", index: str | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank, bm25_score, vector_score, title_boost, recency_boost).

    ``queries``: query_id, text. ``meta``: doc_id, publication_date, section. ``vector_hits``: query_id, doc_id, score, rank, the
    best over all documents. ``titles``: doc_id, title; ``headings``: doc_id, heading_path. ``index``: the folder of a persisted
    index of ``docs``, which then serves the ranking.

    Statistics are those of all documents; conditions take effect after scoring and before the cut, for vectors after it. Without
    any condition, documents without metadata stay. Lexical candidates are BM25's, then documents that hold an identifier of the
    query, those whose title names an instrument that the query names, and those with a heading of its dated plan; the last two
    get ``NAMED_BONUS``.

    Each step's rows, a few for each query, are written under ``spark.checkpoint.dir`` before the next one reads them, as a plan of
    all steps would repeat each of them many times. The tables that the result still reads stay: queries, named, fused.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    if not 1 <= top_k <= 100:
        raise ValueError("top_k must be from 1 to 100")
    if strategy == "vector" and vector_hits is None:
        raise ValueError("the vector strategy needs vector hits")
    filters = filters or Filters()
    keep = meta.filter(filters.condition()).select("doc_id") if filters != Filters() else None

    def kept(rows: DataFrame) -> DataFrame:
        return rows.join(keep, "doc_id", "left_semi") if keep is not None else rows

    queries, _ = held(queries.select("query_id", "text"), "queries")
    if titles is None:
        titles = docs.sparkSession.createDataFrame([], "doc_id bigint, title string")
    if index is not None:
        best = index_of.bm25(docs.sparkSession, index, queries, "query_id", depth, keep=keep)
    else:
        best = lexical.bm25(docs, queries, "query_id", depth, keep=keep)
    left = best.select("query_id", "doc_id", "score", F.lit(0).alias("source"), "rank")
    # Identifiers and instruments' names are phrases, each scored as one term over all documents.
    asked = queries.select("query_id", F.explode(F.transform(identifiers(F.col("text")), lambda i: tokens(i))).alias("words")).withColumn("source", F.lit(1))
    asked = asked.unionByName(queries.select("query_id", F.explode(named_instruments(F.col("text"))).alias("words")).withColumn("source", F.lit(2))).distinct()
    asked = asked.withColumn("phrase", F.xxhash64("words", "source"))
    said = kept(lexical.phrase_bm25(docs, asked.select("phrase", "words").distinct(), "phrase"))
    said = ranked(said, ["phrase"], [F.desc("score"), F.col("doc_id")]).join(asked, "phrase").filter(F.col("rank") <= F.when(F.col("source") == 1, depth).otherwise(MOST_NAMED))
    said, said_at = held(said, "said")
    entitled = title_candidates(titles, queries)
    named = said.filter("source = 2").join(entitled, ["query_id", "doc_id", "words"], "left_semi").groupBy("query_id", "doc_id").agg(F.max("score").alias("score"), F.lit(2).alias("source"))
    extra = said.filter("source = 1").groupBy("query_id", "doc_id").agg(F.max("score").alias("score"), F.lit(1).alias("source")).unionByName(named)
    named = named.select("query_id", "doc_id", F.lit(True).alias("named"))
    if headings is not None:
        by_heading = kept(heading_candidates(headings, queries))
        named = named.unionByName(by_heading.select("query_id", "doc_id", F.lit(True).alias("named"))).distinct()
        extra = extra.unionByName(by_heading.select("query_id", "doc_id", F.lit(0.0).alias("score"), F.lit(3).alias("source")))
    named, _ = held(named, "named")
    # A document that several sources give counts for the first of them.
    rows = left.unionByName(extra.withColumn("rank", F.lit(0))).groupBy("query_id", "doc_id").agg(F.min_by(F.struct("score", "source", "rank"), F.struct("source", "rank")).alias("x")).select("query_id", "doc_id", "x.*")
    left = ranked(rows.withColumnRenamed("rank", "was"), ["query_id"], [F.col("source"), F.col("was"), F.col("doc_id")]).select("query_id", "doc_id", "score", "rank")
    left, left_at = held(left, "left")
    nothing = F.lit(None).cast("double")
    right = kept(vector_hits.select("query_id", "doc_id", "score", "rank")) if vector_hits is not None and strategy != "lexical" else None
    right, right_at = held(right, "right") if right is not None else (None, None)
    if right is None:
        fused = left.select("query_id", "doc_id", F.col("score").alias("fused"), "rank", F.col("score").alias("bm25_score"), nothing.alias("vector_score"))
    elif strategy == "vector":
        fused = right.select("query_id", "doc_id", F.col("score").alias("fused"), "rank", nothing.alias("bm25_score"), F.col("score").alias("vector_score"))
    else:
        # A query without vector hits keeps its lexical ranking.
        some = right.select("query_id").distinct()
        both = fusion.weighted(left.join(some, "query_id", "left_semi"), right, "query_id", "doc_id", weight)
        alone = left.join(some, "query_id", "left_anti").select("query_id", "doc_id", F.col("score").alias("fused"), "rank")
        fused = both.select("query_id", "doc_id", "fused", "rank").unionByName(alone)
        fused = fused.join(left.select("query_id", "doc_id", F.col("score").alias("bm25_score")), ["query_id", "doc_id"], "left").join(right.select("query_id", "doc_id", F.col("score").alias("vector_score")), ["query_id", "doc_id"], "left")
    fused, _ = held(fused, "fused")
    drop(docs.sparkSession, *filter(None, (said_at, left_at, right_at)))
    rows = fused.join(meta.select("doc_id", "publication_date"), "doc_id", "left").join(queries.withColumnRenamed("text", "query"), "query_id")
    rows = rows.join(titles.select("doc_id", "title"), "doc_id", "left").join(named, ["query_id", "doc_id"], "left")
    rows = rows.withColumn("title_boost", title_boost(F.col("query"), F.col("title")) + F.when(F.col("named"), NAMED_BONUS).otherwise(0.0))
    if prefer_recent:
        top = F.max("fused").over(Window.partitionBy("query_id"))
        boost = fusion.recency_boost(rows, "query_id", "doc_id", "publication_date", recency_weight).withColumnRenamed("boost", "share")
        rows = rows.withColumn("top", top).join(boost, ["query_id", "doc_id"], "left").withColumn("recency_boost", F.coalesce(F.col("share") * F.col("top"), F.lit(0.0)))
    else:
        rows = rows.withColumn("recency_boost", F.lit(0.0))
    rows = rows.withColumn("score", F.round(F.col("fused") + F.col("title_boost") + F.col("recency_boost"), 6)).withColumnRenamed("rank", "fused_rank")
    return ranked(rows, ["query_id"], [F.desc("score"), F.col("fused_rank"), F.col("doc_id")], top_k).select("query_id", "doc_id", "score", "rank", "bm25_score", "vector_score", "title_boost", "recency_boost")


def evidence(chunks: DataFrame, queries: DataFrame, hits: DataFrame, vector_chunks: DataFrame | None = None, depth: int = 200, top_k: int = 20, strategy: str = "hybrid", meta: DataFrame | None = None, prefer_recent: bool = False, recency_weight: float = 0.25) -> DataFrame:
    """(query_id, doc_id, chunk_id, score, rank, source): the best chunks of the documents that ``hits`` names per query.

    Only chunks of those documents are read. With ``vector_chunks`` (query_id, chunk_id, rank, and score if there is one) both
    rankings are fused by rank; where no vector hit is among a query's candidates its ranking is the lexical one. With
    ``prefer_recent`` the ranking is blended with the dates of ``meta`` (doc_id, publication_date) before the cut.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    if not 1 <= top_k <= 100:
        raise ValueError("top_k must be from 1 to 100")
    if strategy == "vector" and vector_chunks is None:
        raise ValueError("the vector strategy needs vector hits")
    candidates = hits.select("query_id", "doc_id").distinct().join(chunks.select("doc_id", "chunk_id", "text"), "doc_id")
    scored = lexical.chunk_bm25(candidates, queries, "query_id")
    first = ranked(scored, ["query_id"], [F.desc("score"), F.col("chunk_id")], depth)
    if vector_chunks is None or strategy == "lexical":
        order = first.select("query_id", "chunk_id", "rank").withColumn("source", F.lit("bm25_chunk"))
    else:
        known = vector_chunks.join(candidates.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi").withColumnRenamed("rank", "was")
        known = ranked(known, ["query_id"], [F.col("was"), F.col("chunk_id")])
        if strategy == "vector":
            some = known.select("query_id").distinct()
            both = known.select("query_id", "chunk_id", "rank").unionByName(first.join(some, "query_id", "left_anti").select("query_id", "chunk_id", "rank"))
        else:
            both = fusion.rrf([first, known], "query_id", "chunk_id").select("query_id", "chunk_id", "rank")
        side = F.when(F.col("l") & F.col("v"), "hybrid").when(F.col("v"), "vector").otherwise("bm25_chunk")
        order = both.join(first.select("query_id", "chunk_id", F.lit(True).alias("l")), ["query_id", "chunk_id"], "left").join(known.select("query_id", "chunk_id", F.lit(True).alias("v")), ["query_id", "chunk_id"], "left").na.fill(False, ["l", "v"]).withColumn("source", side).drop("l", "v")
    owners = candidates.select("query_id", "chunk_id", "doc_id")
    order = order.join(owners, ["query_id", "chunk_id"])
    if prefer_recent:
        if meta is None:
            raise ValueError("recency needs the documents' dates")
        dated = order.join(meta.select("doc_id", "publication_date"), "doc_id", "left")
        blended = fusion.recency_blend(dated.select("query_id", "chunk_id", "rank", "publication_date"), "query_id", "chunk_id", "publication_date", recency_weight)
        order = order.drop("rank").join(blended.select("query_id", "chunk_id", "rank"), ["query_id", "chunk_id"])
    out = order.filter(F.col("rank") <= top_k).join(first.select("query_id", "chunk_id", "score"), ["query_id", "chunk_id"], "left")
    value = F.col("score")
    if vector_chunks is not None and "score" in vector_chunks.columns:
        out = out.join(vector_chunks.select("query_id", "chunk_id", F.col("score").alias("vector_score")), ["query_id", "chunk_id"], "left")
        value = F.coalesce("score", "vector_score")
    return out.select("query_id", "doc_id", "chunk_id", F.coalesce(value, F.lit(0.0)).alias("score"), "rank", "source")


def evidence_titles(chunks: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, title): a document's first heading, or its own title (doc_id, title) where that is but a fragment."""
    return outline(chunks, titles).select("doc_id", "title")


def headings_like(chunks: DataFrame, phrase: str) -> DataFrame:
    """(doc_id, heading): the first heading of a document that has the phrase. Rows are told first by the paths as text, the plain
    test that a scan can do, then heading by heading, folded."""
    rough = chunks.filter(F.lower(F.array_join("heading_path", " ")).contains(phrase.lower()))
    rows = rough.select("doc_id", "chunk_index", F.posexplode("heading_path").alias("depth", "heading")).filter(F.contains(fold("heading"), fold(F.lit(phrase))))
    return rows.groupBy("doc_id").agg(F.min_by("heading", F.struct("chunk_index", "depth")).alias("heading"))


def by_paths(slugs: DataFrame, manifest: DataFrame, docs: DataFrame) -> DataFrame:
    """(slug, relpath, doc_id): a slug's path in the manifest (slug, relpath), and the document (doc_id, path) that has it; null
    where either is unknown."""
    return slugs.select("slug").join(manifest.select("slug", "relpath"), "slug", "left").join(docs.select("doc_id", F.col("path").alias("relpath")), "relpath", "left").select("slug", "relpath", "doc_id")


def outline(chunks: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(doc_id, title, chunks): each document's chunks in order, without their texts. The title is the first heading, or the
    document's own where that is but a fragment."""
    rows = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "token_count", "heading_path"))).alias("chunks"))
    fast = chunks.filter(F.size("heading_path") > 0).groupBy("doc_id").agg(F.min_by(F.col("heading_path")[0], "chunk_index").alias("heading"))
    rows = rows.join(fast, "doc_id", "left")
    if titles is not None:
        rows = rows.join(titles.select("doc_id", F.col("title").alias("full")), "doc_id", "left")
    else:
        rows = rows.withColumn("full", F.lit(None).cast("string"))
    return rows.select("doc_id", F.when(is_fragment_title(F.col("heading")), F.coalesce("full", "heading")).otherwise(F.col("heading")).alias("title"), "chunks")


def read_chunks(chunks: DataFrame, wanted: DataFrame, window: int = 0) -> DataFrame:
    """The wanted chunks (doc_id, chunk_index) and their neighbours on both sides, in order, each once, with their text checked
    against its hash. The range is spelled out as rows, so the join is on equality."""
    if not 0 <= window <= 3:
        raise ValueError("window must be from 0 to 3")
    near = wanted.select("doc_id", F.explode(F.sequence(F.col("chunk_index") - window, F.col("chunk_index") + window)).alias("chunk_index")).distinct()
    rows = chunks.join(near, ["doc_id", "chunk_index"])
    checked = F.when(F.sha2("text", 256) == F.col("chunk_hash"), F.col("text")).otherwise(F.raise_error(F.concat(F.lit("chunk hash differs: "), F.col("doc_id").cast("string"))))
    return rows.withColumn("text", checked).orderBy("doc_id", "chunk_index")


def context(evidence_rows: DataFrame) -> DataFrame:
    """(query_id, context): the ranked chunks' texts, each under its id, for a reader model."""
    piece = F.format_string("[CHUNK %d]\n%s", F.col("chunk_id"), F.col("text"))
    return evidence_rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", piece.alias("p")))), lambda x: x["p"]), "\n\n").alias("context"))


def within_budget(rows: DataFrame, by: list[str], order: list[str], size: Column, each: int, total: int) -> DataFrame:
    """Rows in order as long as their sizes, each counted up to ``each``, fit into ``total`` together; with ``used`` so far."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(F.least(size, F.lit(each))).over(w)).filter(F.col("used") <= total)
