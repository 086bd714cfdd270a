"""Queries of the text functions, sources and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from corvid.functions import headings, urls
from corvid.functions import text as T
from corvid.operators import chunking, evaluate, search, validation
from corvid.plans.common import DATED_SQL, dated, table, tokens_sql
from corvid.sources import html, markdown, store


def _docs(spark, d):
    return table(spark, d, "documents")


def _lines(spark, d):
    rows = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return rows.withColumn("line", F.when(F.col("i") % 5 == 0, F.concat(F.repeat(F.lit("#"), (F.col("i") % 3 + 1).cast("int")), F.lit(" "), F.col("line"))).otherwise(F.col("line")))


def classify_documents(spark, d):
    """Layouts; every third document is laid out as a table and every third with headings here, four times as long."""
    laid = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", "(?m)^", "| ")).when(F.col("doc_id") % 3 == 1, F.regexp_replace("text", "(?m)^", "## ")).otherwise(F.col("text"))
    return _docs(spark, d).select("doc_id", T.pattern(F.array_join(F.array_repeat(laid, 4), "\n")).alias("pattern"))


def pattern_counts(spark, d):
    return classify_documents(spark, d).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


def token_counts(spark, d):
    return _docs(spark, d).select("doc_id", T.token_count("text").alias("tokens"))


def clean_text(spark, d):
    dirty = F.concat(F.lit("a\\_\\_\\_b    c\n\n\n\n|-----+-----|\n|----------------|\n"), F.col("text"))
    return _docs(spark, d).select("doc_id", F.md5(T.clean(dirty)).alias("digest"))


#: What is put before a text's lines in turn, so that an operator meets all it looks for and what is like it.
_BOILER = ["## Al margen ", "### ATENTAMENTE ", "# ", "Al margen ", "####### Rúbrica ", ""]
_IMAGES = ['![a](/tmp/x/media/i1.png){width="2in"} ', "![](i2.png)", "![c](http://x.org/y.png){#id} ", "[d](e.png) ", ""]


def _prefixed(prefixes: list[str], column="text"):
    """The text with each line behind one of the prefixes, by its number and the document's."""
    chosen = F.array(*map(F.lit, prefixes))
    return F.array_join(F.transform(F.split(column, "\n"), lambda x, i: F.concat(F.element_at(chosen, ((i + F.col("doc_id")) % len(prefixes) + 1).cast("int")), x)), "\n")


def boilerplate_removed(spark, d):
    return _docs(spark, d).select("doc_id", T.without_boilerplate(_prefixed(_BOILER)).alias("text"))


def image_refs(spark, d):
    """Inlined image descriptions, which every third line is here, and the images' names."""
    line = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("<!-- IMAGE_DESCRIPTION: img"), i.cast("string"), F.lit(".png\n"), x, F.lit("\n-->"))).otherwise(x))
    text = F.array_join(line, "\n")
    return _docs(spark, d).select("doc_id", F.md5(T.inlined_images(text)).alias("digest"), F.array_join(F.regexp_extract_all(text, F.lit(r"IMAGE_DESCRIPTION:\s*(\S+)"), F.lit(1)), " ").alias("refs"))


def heading_levels(spark, d):
    return _lines(spark, d).select("doc_id", "i", T.heading_level(F.col("line")).alias("level")).filter("level > 0")


def open_headings(spark, d):
    """Before each line, the latest first- to third-level heading that no shallower one has closed since."""
    return headings.open_headings(_lines(spark, d)).select("doc_id", "i", "h1", "h2", "h3")


def _headed(spark, d):
    """Texts with a heading before every fifth line, of a level that goes up and down."""
    line = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 5 == 0, F.concat(F.repeat(F.lit("#"), ((i / 5 + F.col("doc_id")).cast("int") * 7 % 4 + 1).cast("int")), F.lit(" h"), i.cast("string"))).otherwise(x))
    return _docs(spark, d).select("doc_id", F.array_join(line, "\n").alias("text"))


def sibling_chains(spark, d):
    """The headings that are open from each heading's line on, siblings among them."""
    rows = _headed(spark, d).select("doc_id", F.explode(headings.sibling_chains(headings.listed(F.col("text")))).alias("c"))
    return rows.select("doc_id", F.col("c.at").alias("i"), F.array_join(F.transform("c.chain", lambda h: F.concat(h["level"].cast("string"), F.lit(":"), h["text"])), ">").alias("chain"))


def chunk_headers(spark, d):
    """Headers of three kinds from each document's headings."""
    chain = headings.listed(F.col("text"))
    names = F.transform(chain, lambda h: h["text"])
    title = F.concat(F.lit("doc "), F.col("doc_id").cast("string"))
    number = (F.col("doc_id") % 2 + 1).cast("int")
    return _headed(spark, d).select("doc_id", F.md5(headings.chunk_header(title, F.lit("3"), chain, number)).alias("chunk"), F.md5(headings.section_header(title, names)).alias("section"), F.md5(headings.header_context(names)).alias("context"))


def section_starts(spark, d):
    return headings.section_starts(_headed(spark, d))


def source_urls(spark, d):
    """Addresses and titles from names of several forms."""
    day = F.concat(F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit("01"), (F.col("doc_id") % 30 + 1995).cast("string"))
    name = F.element_at(F.array(F.concat(day, F.lit("_MAT")), F.concat(F.lit("003_DOC_"), day, F.lit("_VES")), F.lit("corto"), F.concat(day, F.lit("-"), F.col("source"))), (F.col("doc_id") % 4 + 1).cast("int"))
    path = F.concat(F.lit("a/b.c/"), name, F.lit(".md"))
    return _docs(spark, d).select("doc_id", *urls.document_metadata(path), urls.by_part(path).alias("other"))


def page_split(spark, d):
    """Text before a page mark belongs to that page, the rest to the last page seen, or to page 1."""
    text = F.concat(F.substring("text", 1, 30), F.when(F.col("doc_id") % 3 != 0, F.lit("{4}-----")).otherwise(F.lit("{x}--")), F.substr(F.col("text"), F.lit(31)), F.when(F.col("doc_id") % 2 == 0, F.lit("{7}-----tail")).otherwise(F.lit("")))
    return _docs(spark, d).select("doc_id", F.explode(headings.page_parts(text)).alias("p")).select("doc_id", "p.i", "p.page", "p.part")


def fragment_titles(spark, d):
    title = F.concat(F.element_at(F.array(*map(F.lit, ["II. ", "Sección ", "", "B. "])), (F.col("doc_id") % 4 + 1).cast("int")), F.regexp_extract("text", r"^[^\n]*", 0))
    return _docs(spark, d).select("doc_id", T.is_fragment_title(title).alias("fragment"))


def slug_titles(spark, d):
    """Names that are slugs and not titles; numbers, kinds and dates vary in length and form."""
    slug = F.concat(F.lpad((F.col("doc_id") % 1000).cast("string"), (F.col("doc_id") % 2 + 2).cast("int"), F.lit("0")), F.element_at(F.array(*map(F.lit, ["_AVISO_", "_DOC_", "_X_", "_DOF_"])), (F.col("doc_id") % 4 + 1).cast("int")), F.when(F.col("doc_id") % 5 == 0, "1022024").otherwise("01022024"), F.lit("_"), F.col("source"))
    return _docs(spark, d).select("doc_id", slug.alias("name"), T.is_slug(slug).alias("slug"))


def html_links(spark, d):
    pages = table(spark, d, "pages")
    rows = html.links(pages).join(pages.select("page_id", "url"), "page_id")
    return rows.select("page_id", "position", html.absolute(F.col("href"), F.col("url")).alias("href"))


def html_notices(spark, d):
    """A tab is put before each page: known or unknown, with the word that marks notices or another, and none to three links."""
    n = F.col("page_id")
    tab = F.element_at(F.array(*map(F.lit, ["resp-tab2", "resp-tab3", "resp-tab9"])), (n % 3 + 1).cast("int"))
    links = F.array_join(F.transform(F.sequence(F.lit(0), (n % 4).cast("int")), lambda k: F.concat(F.lit('<a href="/notas/'), F.when(k == 0, "none").otherwise((n * 10 + k).cast("string")), F.lit('">x</a>'))), "")
    head = F.concat(F.lit('<div class="tab-pane" id="'), tab, F.lit('"><div class="panel panel-default"><div class="panel-heading"><span class="txt-traduct"> '), F.when(n % 2 == 0, "AVISOS").otherwise("LEYES"), F.lit(" </span></div>"), links, F.lit("</div></div>"))
    return html.numbered(html.notices(table(spark, d, "pages").select("page_id", F.concat(head, "html").alias("html"))))


def ngram_overlap(spark, d):
    """Benchmark passages and the number of documents with which they share five words in a row."""
    bench = table(spark, d, "benchmark").select("item_id", F.explode(T.ngram_rows("text", 5)).alias("gram"))
    docs = _docs(spark, d).select("doc_id", F.explode(T.ngram_rows("text", 5)).alias("gram"))
    return docs.join(bench, "gram").groupBy("item_id").agg(F.countDistinct("doc_id").alias("docs"))


def anchor_check(spark, d):
    """Whether a passage has a word that would find each document that quotes it."""
    docs = _docs(spark, d)
    return evaluate.anchored(table(spark, d, "benchmark"), docs, quote_in_chunk(spark, d), "item_id").select("item_id", "doc_id", "anchored")


def query_validation(spark, d):
    """The first reason against each turn of a conversation as a question about the document with its conversation's number."""
    w = Window.partitionBy(F.lower("text")).orderBy("conv_id", "turn")
    kind = F.element_at(F.array(*map(F.lit, [*validation.KINDS, "other"])), (F.col("conv_id") % 7 % 4 + 1).cast("int"))
    docs = _docs(spark, d).select(F.col("doc_id").alias("conv_id"), F.size(F.split("text", "\n")).alias("chunks"), T.ngram_rows("text", 3).alias("grams"))
    rows = table(spark, d, "conversations").withColumn("before", F.row_number().over(w) - 1).join(docs, "conv_id", "left")
    copied = F.coalesce(F.arrays_overlap("grams", T.ngram_rows("text", 3)), F.lit(False))
    reason = validation.question_error(kind, F.col("text"), F.col("before"), copied, F.when(F.col("turn") % 2 == 0, F.col("turn")), F.coalesce("chunks", F.lit(0)))
    return rows.select("conv_id", "turn", F.coalesce(reason, F.lit("ok")).alias("reason"))


def quote_in_chunk(spark, d):
    """Passages of eight words or more that a document quotes word for word: by their first words, then compared as a whole."""
    from corvid.operators import lexical

    quotes = table(spark, d, "benchmark").select("item_id", T.tokens("text").alias("words")).filter(F.size("words") >= 8)
    return lexical.phrase_hits(_docs(spark, d), quotes, "item_id").select("item_id", "doc_id")


def json_arrays(spark, d):
    """Heading paths and first arrays read from text: the first words as an array, a broken one, an empty one, or none."""
    words = F.slice(T.tokens("text"), 1, (F.col("doc_id") % 3).cast("int"))
    value = F.when(F.col("doc_id") % 4 == 3, F.concat(F.lit('["'), F.array_join(words, "")) ).when(F.col("doc_id") % 4 == 2, F.array_join(words, " ")).otherwise(F.concat(F.lit('["'), F.array_join(words, '", "'), F.lit('"]')))
    text = F.concat(F.lit("answer: "), value, F.lit(" end"))
    return _docs(spark, d).select("doc_id", F.array_join(T.heading_path(value), "/").alias("path"), F.coalesce(F.array_join(T.first_json_array(text), "/"), F.lit("none")).alias("first"))


def path_metadata(spark, d):
    path = F.concat((F.col("doc_id") % 30 + 2000).cast("string"), F.lit("/01/"), F.lpad((F.col("doc_id") % 31 + 1).cast("string"), 2, "0"), F.lit("02"), F.when(F.col("doc_id") % 5 == 0, "20x5").otherwise("2015"), F.lit("/mat/"), F.col("source"), F.lit(".md"))
    return _docs(spark, d).select("doc_id", *markdown.path_metadata(path))


def metadata_filter(spark, d):
    f = search.Filters(as_of="2023-06-30", date_from="2021-01-01", section=" mat ")
    return dated(_docs(spark, d)).filter(f.condition())


def list_publications(spark, d):
    return search.publications(dated(_docs(spark, d)), search.Filters(section="VES"), 50)


def segments_roundtrip(spark, d):
    """Texts in slices of 500 characters, put together again."""
    docs = _docs(spark, d)
    back = store.reassembled(store.segments(docs, size=500))
    n = store.segments(docs, size=500).groupBy("doc_id").agg(F.count(F.lit(1)).alias("segments"))
    return back.join(n, "doc_id").select("doc_id", "segments", F.md5("text").alias("digest"))


def latest_values(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("value"), F.col("event_id").alias("version"))
    return store.latest_values(rows)


def neighbor_window(spark, d):
    """Every seventh line of each document with the lines around it."""
    lines = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "text")).withColumn("chunk_hash", F.sha2("text", 256))
    wanted = lines.filter("chunk_index % 7 = 3").select("doc_id", "chunk_index")
    return search.read_chunks(lines, wanted, 1).select("doc_id", "chunk_index", F.length("text").alias("n"))


def key_ranges(spark, d):
    """The documents' ids in ranges of 64, as scans that run side by side take them."""
    return store.key_ranges(_docs(spark, d), "doc_id", 64)


def key_range_scan(spark, d):
    """The ids behind the hundredth, one after another, by scans that each go on where the last one ended."""
    docs = _docs(spark, d).select("doc_id")
    first = store.after(docs, "doc_id", 99, 50)
    last = first.agg(F.max("doc_id")).first()[0]
    return first if last is None else first.union(store.after(docs, "doc_id", last, 50))


def next_lines(spark, d):
    w = Window.partitionBy("doc_id").orderBy("i")
    return _lines(spark, d).select("doc_id", "i", F.length(F.lag("line").over(w)).alias("before"), F.length(F.lead("line").over(w)).alias("after"))


def prompt_budget(spark, d):
    """Lines of a document, each cut at 200 characters, as long as they fit into 1000 together."""
    rows = search.within_budget(_lines(spark, d), ["doc_id"], ["i"], F.length("line"), 200, 1000)
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.max("used").alias("used"))


def spanish_dates(spark, d):
    return dated(_docs(spark, d)).select("doc_id", T.spanish_date(F.col("publication_date")).alias("words"))


def upserted_documents(spark, d):
    """A table in which every fifth document was put in again with another text, and its chunks with it."""
    path = store.scratch(spark, "upsert")
    chunks = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"))
    store.upsert(chunks, path)
    store.upsert(chunks.filter("doc_id % 5 = 0 AND chunk_index < 2").withColumn("text", F.concat(F.lit("new "), "text")), path)
    return spark.read.parquet(path).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("chars"))


def synthetic_queries(spark, d):
    """First twenty words as a query, and where the document's lines begin in the numbering of all lines."""
    rows = _docs(spark, d).select("doc_id", F.size(F.split("text", "\n")).cast("bigint").alias("n"), F.array_join(F.slice(F.filter(F.split("text", r"\s+"), lambda x: x != ""), 1, 20), " ").alias("query"))
    # Block sums first, so the running sum over all documents has few rows in its one partition.
    rows = rows.withColumn("block", F.floor(F.col("doc_id") / 1000))
    blocks = rows.groupBy("block").agg(F.sum("n").alias("total")).withColumn("before", F.coalesce(F.sum("total").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("block").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("inside", inside).join(blocks.select("block", "before"), "block").filter(F.length("query") > 10).select("doc_id", "query", (F.col("before") + F.col("inside")).alias("offset"))


def date_range(spark, d):
    """Days and editions from the orders' first date to their last."""
    ends = table(spark, d, "orders").agg(F.min("o_orderdate").cast("date").alias("first"), F.max("o_orderdate").cast("date").alias("last"))
    return markdown.editions(ends, "first", "last")


def year_sizes(spark, d):
    rows = _docs(spark, d).join(dated(_docs(spark, d)), "doc_id")
    return rows.groupBy(F.year("publication_date").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.round(F.avg(F.octet_length("text")), 4).alias("mean"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


def sentence_counts(spark, d):
    return _docs(spark, d).select("doc_id", F.size(chunking.sentences(F.col("text"))).alias("n"))


def word_windows(spark, d):
    """Windows of words that share a few, for three sizes in one scan."""
    sizes = F.explode(F.array(*(F.struct(F.lit(n).alias("size"), F.lit(max(10, n // 20)).alias("shared")) for n in (50, 100, 200))))
    rows = _docs(spark, d).select("text", sizes.alias("s")).select(F.col("s.size").alias("size"), F.explode(chunking.windows(F.col("text"), F.col("s.size"), F.col("s.shared"))).alias("w"))
    return rows.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("w")), 4).alias("mean"))


def percentile_nearest_rank(spark, d):
    n = F.octet_length("text")
    return evaluate.nearest_rank(_docs(spark, d), "lang", n, (50, 95, 99))


def percentile_linear(spark, d):
    n = F.octet_length("text").cast("double")
    return _docs(spark, d).groupBy("lang").agg(F.round(F.percentile(n, F.lit(0.5)), 4).alias("p50"), F.round(F.percentile(n, F.lit(0.95)), 4).alias("p95"), F.max(n).alias("max"))


def stratified_sample(spark, d):
    """Round robin over languages and whether a text is long, the largest strata first in each round."""
    rows = _docs(spark, d).select("doc_id", "lang", F.coalesce(F.length("text") > 1000, F.lit(False)).alias("long"))
    return evaluate.stratified(rows, ["lang", "long"], "doc_id", 100)


def hash_sample(spark, d):
    """A sample by the ids' digests: the same whatever the order of rows."""
    return evaluate.seeded(_docs(spark, d).select("doc_id"), "doc_id", 100, 7)


def chunk_documents(spark, d):
    return chunking.chunked(_docs(spark, d)).select("doc_id", "pattern", "chunk_index", "token_count", "has_image", "chunk_hash")


def chunk_roundtrip(spark, d):
    """Chunks as recipes, and whether every recipe gives its chunk back."""
    docs = _docs(spark, d)
    back = chunking.with_recipes(docs).join(docs.select("doc_id", F.col("text").alias("source")), "doc_id")
    same = F.sha2(chunking.reconstructed(F.col("spans"), F.col("source")), 256) == F.col("chunk_hash")
    return back.groupBy("pattern").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(same).alias("same"), F.sum(F.size("spans")).alias("spans"))


def chunker_comparison(spark, d):
    """Every way to split over all documents."""
    return chunking.compared(_docs(spark, d)).groupBy("variant").agg(F.sum("chunks").alias("chunks"), F.round(F.sum("tokens") / F.sum("chunks"), 2).alias("mean"), F.max("longest").alias("longest"))


def pattern_chunks(spark, d):
    """Documents, chunks and mean tokens by layout."""
    rows = chunking.chunked(_docs(spark, d)).groupBy("pattern").agg(F.countDistinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("chunks"), F.round(F.avg("token_count"), 2).alias("mean"))
    return rows


def size_ratios(spark, d):
    """Bytes of the texts and of their segments, by source, and how they relate."""
    docs = _docs(spark, d)
    parts = store.segments(docs, size=700).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum(F.octet_length("segment_text")).alias("segment_bytes"), F.count(F.lit(1)).alias("segments"))
    whole = docs.groupBy("source").agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.length("text")).alias("chars"))
    return whole.join(parts, "source").select("source", "bytes", "segments", F.round(F.col("bytes") / F.col("chars"), 5).alias("bytes_a_char"), F.round(F.col("segment_bytes") / F.col("segments"), 4).alias("bytes_a_segment"))


def structural_chunks(spark, d):
    """Chunks of 2,000 characters that share 500, by document: how many, and the longest."""
    return chunking.structural_chunks(_docs(spark, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("text")).alias("longest"))


def chunk_outline(spark, d):
    return search.outline(chunking.chunked(_docs(spark, d))).select("doc_id", "title", F.size("chunks").alias("chunks"))


QUERIES = {f.__name__: f for f in (classify_documents, pattern_counts, token_counts, clean_text, boilerplate_removed, image_refs, heading_levels, open_headings, page_split, fragment_titles, slug_titles, html_links, html_notices, ngram_overlap, anchor_check, query_validation, quote_in_chunk, json_arrays, path_metadata, metadata_filter, list_publications, segments_roundtrip, latest_values, neighbor_window, next_lines, prompt_budget, synthetic_queries, date_range, year_sizes, sentence_counts, word_windows, percentile_nearest_rank, percentile_linear, stratified_sample, hash_sample, chunk_documents, chunk_roundtrip, chunk_outline, sibling_chains, chunk_headers, section_starts, source_urls, key_ranges, key_range_scan, structural_chunks, chunker_comparison, pattern_chunks, size_ratios, spanish_dates, upserted_documents)}

_LAID = "CASE doc_id % 3 WHEN 0 THEN '| ' || replace(text, chr(10), chr(10) || '| ') WHEN 1 THEN '## ' || replace(text, chr(10), chr(10) || '## ') ELSE text END"
_PATTERN = rf"""
    l AS (SELECT doc_id, concat_ws(chr(10), x, x, x, x) AS t FROM (SELECT doc_id, {_LAID} AS x FROM documents)),
    s AS (SELECT doc_id, t, strlen(t) AS b, list_filter(list_transform(string_split(t, chr(10)), lambda z: trim(z)), lambda z: z <> '') AS f FROM l),
    p AS (SELECT doc_id, CASE WHEN b < 6000 THEN 'small'
        WHEN len(list_filter(f, lambda z: starts_with(z, '|'))) > 0.40 * len(f) OR b > 1000000 THEN 'giant_table'
        WHEN len(regexp_extract_all(t, '(?m)^## .+$')) >= 2 THEN 'h2_compound'
        WHEN len(regexp_extract_all(t, '(?m)^\*\*[A-ZÁÉÍÓÚÑ][^*]{{5,80}}\*\*[ \t]*$')) >= 2 THEN 'bold_headers' ELSE 'plain' END AS pattern FROM s)"""


def _prefixed_sql(prefixes: list[str]) -> str:
    chosen = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in prefixes) + "]"
    return f"array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: ({chosen})[(i - 1 + doc_id) % {len(prefixes)} + 1] || x), chr(10))"


_HEADED = """
    hd AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 5 = 0 THEN repeat('#', CAST(((i - 1) // 5 + doc_id) * 7 % 4 + 1 AS INTEGER)) || ' h' || (i - 1) ELSE x END), chr(10)) AS text FROM documents),
    hl AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS i FROM hd),
    hs AS (SELECT doc_id, i, length(regexp_extract(line, '^(#{1,6})[ \\t]+\\S', 1)) AS level, trim(regexp_replace(line, '^#{1,6}[ \\t]+', '')) AS text, line FROM hl),
    hh AS (SELECT doc_id, i, level, text FROM hs WHERE level > 0)"""
_LINES = """
    raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS i FROM documents),
    lines AS (SELECT doc_id, i, CASE WHEN i % 5 = 0 THEN repeat('#', i % 3 + 1) || ' ' || line ELSE line END AS line FROM raw),
    lev AS (SELECT *, CAST(length(regexp_extract(line, '^(#{1,6})[ \\t]+\\S', 1)) AS INTEGER) AS level FROM lines)"""

ORACLE = {
    "classify_documents": f"WITH {_PATTERN} SELECT doc_id, pattern FROM p",
    "pattern_counts": f"WITH {_PATTERN} SELECT pattern, count(*) AS n FROM p GROUP BY pattern",
    "token_counts": "SELECT doc_id, CAST(greatest(1, length(text) // 3) AS INTEGER) AS tokens FROM documents",
    "clean_text": r"""
        WITH x AS (SELECT doc_id, regexp_replace('a\_\_\_b    c' || repeat(chr(10), 4) || '|-----+-----|' || chr(10) || '|----------------|' || chr(10) || text, '(\\_){2,}', ' __________ ', 'g') AS t FROM documents),
        y AS (SELECT doc_id, array_to_string(list_transform(string_split(t, chr(10)), lambda z: CASE WHEN regexp_matches(z, '^[ \t|+\-:=]{10,}$')
            THEN '|' || repeat('---|', CAST(greatest(1, CASE WHEN contains(z, '+') THEN length(z) - length(replace(z, '+', '')) - 1 WHEN contains(z, '|') THEN length(z) - length(replace(z, '|', '')) - 1 ELSE 1 END) AS INTEGER)) ELSE z END), chr(10)) AS t FROM x)
        SELECT doc_id, md5(regexp_replace(regexp_replace(t, ' {3,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS digest FROM y""",
    "boilerplate_removed": f"SELECT doc_id, regexp_replace({_prefixed_sql(_BOILER)}, '{T.BOILERPLATE_PATTERN}', '', 'g') AS text FROM documents",
    "image_refs": rf"""WITH t AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 3 = 0 THEN '<!-- IMAGE_DESCRIPTION: img' || (i - 1) || '.png' || chr(10) || x || chr(10) || '-->' ELSE x END), chr(10)) AS t FROM documents)
        SELECT doc_id, md5(regexp_replace(t, '{T.IMAGE_COMMENT}', '[Imagen: \1] \2' || chr(10) || chr(10), 'g')) AS digest, array_to_string(regexp_extract_all(t, 'IMAGE_DESCRIPTION:\s*(\S+)', 1), ' ') AS refs FROM t""",
    "heading_levels": f"WITH {_LINES} SELECT doc_id, i, level FROM lev WHERE level > 0",
    "open_headings": f"""WITH {_LINES},
        a AS (SELECT *, max(CASE WHEN level = 1 THEN i END) OVER w AS a1, max(CASE WHEN level = 2 THEN i END) OVER w AS a2, max(CASE WHEN level = 3 THEN i END) OVER w AS a3 FROM lev
              WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        b AS (SELECT doc_id, i, a1, CASE WHEN a2 > coalesce(a1, -1) THEN a2 END AS a2, CASE WHEN a3 > greatest(coalesce(a1, -1), coalesce(a2, -1)) THEN a3 END AS a3 FROM a)
        SELECT b.doc_id, b.i, x.line AS h1, y.line AS h2, z.line AS h3 FROM b
        LEFT JOIN lines x ON x.doc_id = b.doc_id AND x.i = a1 LEFT JOIN lines y ON y.doc_id = b.doc_id AND y.i = a2 LEFT JOIN lines z ON z.doc_id = b.doc_id AND z.i = a3""",
    "page_split": r"""
        WITH t AS (SELECT doc_id, substring(text, 1, 30) || CASE WHEN doc_id % 3 <> 0 THEN '{4}-----' ELSE '{x}--' END || substring(text, 31) || CASE WHEN doc_id % 2 = 0 THEN '{7}-----tail' ELSE '' END AS t FROM documents),
        p AS (SELECT doc_id, regexp_split_to_array(t, '\{\d+\}-+') AS parts, regexp_extract_all(t, '\{(\d+)\}-+', 1) AS pages FROM t),
        u AS (SELECT doc_id, pages, unnest(parts) AS part, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS i FROM p)
        SELECT doc_id, i, coalesce(pages[i + 1], pages[-1], '1') AS page, part FROM u WHERE part <> ''""",
    "fragment_titles": r"""
        WITH t AS (SELECT doc_id, trim(CASE doc_id % 4 WHEN 0 THEN 'II. ' WHEN 1 THEN 'Sección ' WHEN 2 THEN '' ELSE 'B. ' END || regexp_extract(text, '^[^\n]*')) AS t FROM documents)
        SELECT doc_id, length(t) < 20 OR doc_id % 4 <> 2 OR regexp_matches(t, '(?i)^(?:[IVXLCDM]{1,6}\.|[A-Z]\.|secci[oó]n\b|cap[ií]tulo\b|apartado\b|numeral\b|transitorio)') AS fragment FROM t""",
    "slug_titles": r"""
        WITH n AS (SELECT doc_id, lpad(CAST(doc_id % 1000 AS VARCHAR), CAST(doc_id % 2 + 2 AS INTEGER), '0') || (['_AVISO_', '_DOC_', '_X_', '_DOF_'])[doc_id % 4 + 1] || CASE WHEN doc_id % 5 = 0 THEN '1022024' ELSE '01022024' END || '_' || source AS name FROM documents)
        SELECT doc_id, name, regexp_matches(name, '^\d{3}_(AVISO|DOC|DOF|ACUERDO)_\d{8}_') AS slug FROM n""",
    "html_links": """
        WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href, CAST(generate_subscripts(regexp_extract_all(html, 'href="([^"]+)"', 1), 1) - 1 AS INTEGER) AS position FROM pages)
        SELECT page_id, position, CASE WHEN regexp_matches(href, '^\\w+://') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^(\\w+://[^/?#]+)', 1) || href ELSE regexp_extract(url, '^(\\w+://[^/?#]+)', 1) || '/' || href END AS href FROM l""".replace("\\\\", "\\"),
    "html_notices": """
        WITH k AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'VES' WHEN 1 THEN 'MAT' END AS edition, unnest(range(1, page_id % 4 + 1)) AS k FROM pages WHERE page_id % 2 = 0)
        SELECT page_id, CAST(k - 1 AS INTEGER) AS position, CAST(page_id * 10 + k AS VARCHAR) AS note_id, edition, lpad(CAST(k AS VARCHAR), 3, '0') AS number FROM k WHERE edition IS NOT NULL""",
    "ngram_overlap": f"""
        WITH b AS (SELECT item_id, {tokens_sql("text")} AS w FROM benchmark), d AS (SELECT doc_id, {tokens_sql("text")} AS w FROM documents),
        bg AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS g FROM b WHERE len(w) >= 5),
        dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS g FROM d WHERE len(w) >= 5)
        SELECT item_id, count(DISTINCT doc_id) AS docs FROM bg JOIN dg USING (g) GROUP BY item_id""",
    "anchor_check": f"""
        WITH b AS (SELECT item_id, {tokens_sql("text")} AS w FROM benchmark), d AS (SELECT doc_id, {tokens_sql("text")} AS w FROM documents),
        g AS (SELECT item_id, doc_id, b.w AS q, d.w AS x FROM b, d WHERE len(b.w) >= 8 AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(b.w, ' ') || ' ')),
        o AS (SELECT DISTINCT doc_id, unnest(w) AS term FROM d), v AS (SELECT term, count(*) AS df FROM o GROUP BY term),
        q AS (SELECT DISTINCT item_id, doc_id, unnest(q) AS term FROM g)
        SELECT item_id, doc_id, bool_or(df < (SELECT count(*) FROM documents) * 0.001 AND (length(term) >= 4 AND NOT regexp_matches(term, '^[0-9]+$') OR regexp_matches(term, '^[0-9]{{4,}}$'))) AS anchored
        FROM q JOIN v USING (term) GROUP BY ALL""",
    "query_validation": f"""
        WITH d AS (SELECT doc_id, len(string_split(text, chr(10))) AS chunks, {tokens_sql("text")} AS w FROM documents),
        dg AS (SELECT doc_id, list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k + 2], ' ')) AS grams FROM d),
        c AS (SELECT *, {tokens_sql("text")} AS w, (['factual', 'thematic', 'paraphrase', 'other'])[conv_id % 7 % 4 + 1] AS kind, row_number() OVER (PARTITION BY lower(text) ORDER BY conv_id, turn) AS k FROM conversations)
        SELECT conv_id, turn, CASE WHEN kind = 'other' THEN 'kind' WHEN length(text) < 15 THEN 'too short' WHEN length(text) > 300 THEN 'too long' WHEN kind <> 'paraphrase' AND NOT contains(text, '?') THEN 'no question'
               WHEN k > 1 THEN 'repeated' WHEN list_has_any(coalesce(grams, []), list_transform(range(1, len(c.w) - 1), lambda k: array_to_string(c.w[k:k + 2], ' '))) THEN 'copied'
               WHEN turn % 2 = 0 AND NOT turn BETWEEN 0 AND coalesce(chunks, 0) - 1 THEN 'chunk' ELSE 'ok' END AS reason
        FROM c LEFT JOIN d ON d.doc_id = conv_id LEFT JOIN dg ON dg.doc_id = conv_id""",
    "quote_in_chunk": f"""
        WITH b AS (SELECT item_id, array_to_string({tokens_sql("text")}, ' ') AS q, len({tokens_sql("text")}) AS n FROM benchmark), d AS (SELECT doc_id, array_to_string({tokens_sql("text")}, ' ') AS x FROM documents)
        SELECT item_id, doc_id FROM b, d WHERE n >= 8 AND contains(' ' || x || ' ', ' ' || q || ' ')""",
    "json_arrays": f"""
        WITH w AS (SELECT doc_id, {tokens_sql("text")}[1:doc_id % 3] AS w FROM documents),
        v AS (SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN '["' || array_to_string(w, '') WHEN 2 THEN array_to_string(w, ' ') ELSE '["' || array_to_string(w, '", "') || '"]' END AS v FROM w)
        SELECT doc_id, CASE WHEN starts_with(v, '[') AND json_valid(v) THEN array_to_string(from_json(v, '["VARCHAR"]'), '/') ELSE '' END AS path, CASE WHEN starts_with(v, '[') AND json_valid(v) THEN array_to_string(from_json(v, '["VARCHAR"]'), '/') ELSE 'none' END AS first FROM v""",
    "path_metadata": """
        SELECT doc_id, CAST(doc_id % 30 + 2000 AS INTEGER) AS year, 'MAT' AS section,
               CASE WHEN doc_id % 5 <> 0 THEN TRY_CAST('2015-02-' || lpad(CAST(doc_id % 31 + 1 AS VARCHAR), 2, '0') AS DATE) END AS publication_date FROM documents""",
    "metadata_filter": f"SELECT * FROM ({DATED_SQL}) WHERE publication_date <= DATE '2023-06-30' AND publication_date >= DATE '2021-01-01' AND section = 'MAT'",
    "list_publications": f"SELECT * FROM ({DATED_SQL}) WHERE section = 'VES' ORDER BY publication_date DESC, doc_id DESC LIMIT 50",
    "segments_roundtrip": "SELECT doc_id, CAST(ceil(length(text) / 500) AS BIGINT) AS segments, md5(text) AS digest FROM documents WHERE length(text) > 0",
    "latest_values": "SELECT event_type AS key, max_by(value, event_id) AS value FROM events GROUP BY event_type",
    "neighbor_window": """
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS chunk_index FROM documents)
        SELECT doc_id, chunk_index, CAST(length(t) AS INTEGER) AS n FROM l WHERE (doc_id, chunk_index) IN (SELECT doc_id, chunk_index + d FROM l, (SELECT unnest([-1, 0, 1]) AS d) WHERE chunk_index % 7 = 3)""",
    "spanish_dates": f"""SELECT doc_id, day(publication_date) || ' de ' || (['enero', 'febrero', 'marzo', 'abril', 'mayo', 'junio', 'julio', 'agosto', 'septiembre', 'octubre', 'noviembre', 'diciembre'])[month(publication_date)] || ' de ' || year(publication_date) AS words FROM ({DATED_SQL})""",
    "upserted_documents": """
        WITH c AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)
        SELECT doc_id, count(*) AS chunks, CAST(sum(length(t) + CASE WHEN doc_id % 5 = 0 THEN 4 ELSE 0 END) AS BIGINT) AS chars FROM c WHERE doc_id % 5 <> 0 OR i < 2 GROUP BY doc_id""",
    "size_ratios": """
        WITH s AS (SELECT source, strlen(text) AS b, length(text) AS c, CAST(ceil(length(text) / 700) AS BIGINT) AS n FROM documents)
        SELECT source, CAST(sum(b) AS BIGINT) AS bytes, CAST(sum(n) AS BIGINT) AS segments, round(sum(b) / sum(c), 5) AS bytes_a_char, round(sum(b) / sum(n), 4) AS bytes_a_segment FROM s GROUP BY source HAVING sum(n) > 0""",
    "key_ranges": "SELECT doc_id // 64 AS part, min(doc_id) AS low, max(doc_id) AS high, count(*) AS n FROM documents GROUP BY ALL",
    "key_range_scan": "SELECT doc_id FROM documents WHERE doc_id > 99 ORDER BY doc_id LIMIT 100",
    "sibling_chains": f"""WITH {_HEADED},
        c AS (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM hh), x AS (SELECT doc_id, i, level FROM c WHERE level = 1 OR before > level),
        o AS (SELECT k.doc_id, k.i, j.i AS place, j.level, j.text FROM hh k JOIN hh j ON j.doc_id = k.doc_id AND j.i <= k.i
              WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = k.doc_id AND x.i > j.i AND x.i <= k.i AND (x.level = 1 OR x.level <= j.level)))
        SELECT doc_id, i, string_agg(level || ':' || text, '>' ORDER BY place) AS chain FROM o GROUP BY doc_id, i""",
    "chunk_headers": f"""WITH {_HEADED}, g AS (SELECT doc_id, list(struct_pack(i := i, m := repeat('#', level) || ' ' || text, t := text) ORDER BY i) AS h FROM hh GROUP BY doc_id),
        a AS (SELECT d.doc_id, coalesce(h, []) AS h FROM documents d LEFT JOIN g USING (doc_id) WHERE d.text IS NOT NULL)
        SELECT doc_id, md5('# Document: doc ' || doc_id || ' | page: 3' || CASE WHEN doc_id % 2 = 0 THEN coalesce(chr(10) || h[1].m, '') ELSE CASE WHEN len(h) > 0 THEN chr(10) || array_to_string(list_transform(h, lambda x: x.m), chr(10)) ELSE '' END END) AS chunk,
               md5('Document: doc ' || doc_id || CASE WHEN len(h) > 0 THEN ' | Section: ' || array_to_string(list_transform(h, lambda x: x.t), ' > ') ELSE '' END) AS section,
               md5(array_to_string(list_transform(h, lambda x, k: CASE WHEN k = 1 THEN '# ' ELSE '## ' END || x.t), chr(10))) AS context FROM a""",
    "section_starts": f"""WITH {_HEADED}, o AS (SELECT doc_id, i, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM hs)
        SELECT doc_id, CAST(start AS BIGINT) AS start FROM o WHERE regexp_matches(line, '^## .')""",
    "source_urls": r"""
        WITH y AS (SELECT *, lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || '01' || (doc_id % 30 + 1995) AS day FROM documents),
        n AS (SELECT doc_id, ([day || '_MAT', '003_DOC_' || day || '_VES', 'corto', day || '-' || source])[doc_id % 4 + 1] AS title FROM y),
        a AS (SELECT *, replace(title, '_', '-') AS h FROM n)
        SELECT doc_id, title, CASE WHEN length(h) >= 8 THEN 'https://diariooficial.gob.mx/abrirPDF.php?archivo=' || h || '.pdf&anio=' || h[5:8] || '&repo=repositorio/' END AS url,
               CASE WHEN regexp_matches(title, '(^|_)\d{8}(_|$)') THEN 'https://diariooficial.gob.mx/abrirPDF.php?archivo=' || h || '.pdf&anio=' || regexp_extract(title, '(?:^|_)\d{4}(\d{4})(?:_|$)', 1) || '&repo=repositorio/' END AS other FROM a""",
    "next_lines": f"WITH {_LINES} SELECT doc_id, i, CAST(length(lag(line) OVER w) AS INTEGER) AS before, CAST(length(lead(line) OVER w) AS INTEGER) AS after FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)",
    "prompt_budget": f"""WITH {_LINES}, u AS (SELECT doc_id, sum(least(length(line), 200)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS used FROM lines)
        SELECT doc_id, count(*) AS lines, CAST(max(used) AS BIGINT) AS used FROM u WHERE used <= 1000 GROUP BY doc_id""",
    "synthetic_queries": r"""
        WITH n AS (SELECT doc_id, len(string_split(text, chr(10))) AS n, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')[1:20], ' ') AS query FROM documents),
        o AS (SELECT *, CAST(coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM n)
        SELECT doc_id, query, "offset" FROM o WHERE length(query) > 10""",
    "date_range": """
        WITH f AS (SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders)
        SELECT CAST(day AS DATE) AS day, edition FROM (SELECT unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS day FROM f), (SELECT unnest(['MAT', 'VES']) AS edition)""",
    "year_sizes": f"""
        SELECT CAST(year(publication_date) AS INTEGER) AS year, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes, round(avg(strlen(text)), 4) AS mean, min(doc_id) AS first, max(doc_id) AS last
        FROM documents JOIN ({DATED_SQL}) USING (doc_id) GROUP BY ALL""",
    "word_windows": r"""
        WITH w AS (SELECT list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents), z AS (SELECT unnest([50, 100, 200]) AS size),
        c AS (SELECT size, w, greatest(10, size // 20) AS o FROM w, z WHERE len(w) > 0),
        s AS (SELECT size, w, unnest(range(1, greatest(1, len(w) - o) + 1, size - o)) AS i FROM c)
        SELECT CAST(size AS INTEGER) AS size, count(*) AS n, round(avg(length(array_to_string(w[i:i + size - 1], ' '))), 4) AS mean FROM s GROUP BY size""",
    "percentile_nearest_rank": """
        WITH l AS (SELECT lang, list_sort(list(strlen(text))) AS s, count(*) AS n FROM documents GROUP BY lang)
        SELECT lang, CAST(s[least(n * 50 // 100, n - 1) + 1] AS INTEGER) AS p50, CAST(s[least(n * 95 // 100, n - 1) + 1] AS INTEGER) AS p95, CAST(s[least(n * 99 // 100, n - 1) + 1] AS INTEGER) AS p99 FROM l""",
    "percentile_linear": "SELECT lang, round(quantile_cont(CAST(strlen(text) AS DOUBLE), 0.5), 4) AS p50, round(quantile_cont(CAST(strlen(text) AS DOUBLE), 0.95), 4) AS p95, max(CAST(strlen(text) AS DOUBLE)) AS max FROM documents GROUP BY lang",
    "stratified_sample": """
        WITH l AS (SELECT doc_id, lang, coalesce(length(text) > 1000, false) AS long FROM documents),
        r AS (SELECT *, count(*) OVER (PARTITION BY lang, long) AS n, CAST(row_number() OVER (PARTITION BY lang, long ORDER BY doc_id) AS INTEGER) AS round FROM l)
        SELECT doc_id, lang, long, round FROM r ORDER BY round, n DESC, lang, long LIMIT 100""",
    "sentence_counts": r"SELECT doc_id, CAST(len(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')) AS INTEGER) AS n FROM documents",
    "hash_sample": "SELECT doc_id, md5('7:' || doc_id) AS h FROM documents ORDER BY h LIMIT 100",
}
