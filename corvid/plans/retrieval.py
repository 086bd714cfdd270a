"""Queries of the persisted index and of two-stage search.

The tables have neither titles nor headings, so a document is given a title made of its first words ('Ley ...', and a dated plan
for some), which its text then begins with; a query is a passage that also names the title of one document.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corvid.functions import text as T
from corvid.operators import fusion, index, lexical, search
from corvid.plans.common import IDF_SQL, bm25_sql, dated, lexical_sql, table, tokens_sql
from corvid.plans.vectors import _BASE, cosine_topk
from corvid.sources.store import scratch


def _titled(spark, d):
    """doc_id, title, heading_path, text."""
    words = T.tokens("text")
    title = F.concat(F.lit("Ley "), F.array_join(F.slice(words, 1, 3), " "))
    plan = F.concat(F.lit("Plan Nacional de Desarrollo "), (F.col("doc_id") % 30 + 1990).cast("string"), F.lit("-"), (F.col("doc_id") % 30 + 1996).cast("string"))
    code = F.concat(F.lit("NOM-"), F.lpad((F.col("doc_id") % 200).cast("string"), 3, "0"), F.lit("-SSA"))
    rows = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    path = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("ANEXO"), F.concat(F.lit("Ámbito: "), plan))).otherwise(F.array(F.lit("ANEXO")))
    return rows.select("doc_id", title.alias("title"), path.alias("heading_path"), F.concat_ws(". ", title, F.when(F.col("doc_id") % 4 == 0, code), F.col("text")).alias("text"))


def _asked(spark, d):
    """query_id, text: a passage and the title, the plan and the code of the document with five times its number."""
    named = table(spark, d, "documents").select((F.col("doc_id") / 5).alias("item_id"), "doc_id", F.array_join(F.slice(T.tokens("text"), 1, 3), " ").alias("first")).filter("doc_id % 5 = 0").withColumn("item_id", F.col("item_id").cast("bigint"))
    tail = F.concat(F.lit(" según la ley "), F.col("first"), F.lit(" que rige el plan nacional de desarrollo  "), (F.col("doc_id") % 30 + 1990).cast("string"), F.lit("-"), (F.col("doc_id") % 30 + 1996).cast("string"), F.lit(" y la nom-"), F.lpad((F.col("doc_id") % 200).cast("string"), 3, "0"), F.lit("-ssa"))
    return table(spark, d, "benchmark").join(named, "item_id").select(F.col("item_id").alias("query_id"), F.concat("text", tail).alias("text"))


def _indexed(spark, d):
    """An index of the documents, made in two appends; a third one has nothing to add."""
    docs, path = table(spark, d, "documents"), scratch(spark, "index")
    first = docs.filter("doc_id % 3 <> 0")
    if index.append(first, path) + index.append(docs, path) != docs.select("doc_id").distinct().count() or index.append(docs, path):
        raise AssertionError("the index is not the documents'")
    return path


def postings_persisted(spark, d):
    return index.postings(spark, _indexed(spark, d))


def vocabulary_persisted(spark, d):
    return index.vocabulary(spark, _indexed(spark, d))


def bm25_indexed(spark, d):
    """The flagship's ranking from the index."""
    return index.bm25(spark, _indexed(spark, d), table(spark, d, "benchmark"), "item_id", 10)


def title_candidates(spark, d):
    return search.title_candidates(_titled(spark, d), _asked(spark, d)).select("query_id", "doc_id", F.array_join("words", " ").alias("name"))


def heading_candidates(spark, d):
    return search.heading_candidates(_titled(spark, d), _asked(spark, d))


def headings_like(spark, d):
    """Documents with a heading that has a phrase, whatever its case and marks."""
    chunks = _titled(spark, d).select("doc_id", F.lit(0).alias("chunk_index"), "heading_path")
    return search.headings_like(chunks, "plan nacional de desarrollo 2002")


def phrase_bm25(spark, d):
    """Whole titles as phrases, each scored as one term."""
    docs = _titled(spark, d)
    return lexical.phrase_bm25(docs, docs.select(F.col("doc_id").alias("title_of"), T.tokens("title").alias("words")), "title_of")


def _vector_hits(spark, d):
    """Vectors stand for documents (id modulo 100), their queries for passages (id / 50)."""
    hits = cosine_topk(spark, d).select((F.col("query_id") / 50).cast("bigint").alias("query_id"), (F.col("vec_id") % 100).alias("doc_id"), "score", "rank")
    return fusion.collapse(hits, "query_id", "doc_id", [F.col("rank")], 20).select("query_id", "doc_id", "score", "rank")


def search_documents(spark, d):
    """Lexical and vector documents fused, with conditions, titles, headings and recency."""
    docs = _titled(spark, d)
    queries = _asked(spark, d)
    hits = _vector_hits(spark, d).join(queries.select("query_id"), "query_id", "left_semi")
    return search.documents(docs, queries, dated(docs), search.Filters(as_of="2023-12-31"), hits, prefer_recent=True, titles=docs.select("doc_id", "title"), headings=docs.select("doc_id", "heading_path")).select("query_id", "doc_id", "score", "rank", "title_boost")


def search_lexical(spark, d):
    """The lexical strategy without conditions."""
    docs = _titled(spark, d)
    return search.documents(docs, _asked(spark, d), dated(docs), strategy="lexical", titles=docs.select("doc_id", "title")).select("query_id", "doc_id", "score", "rank", "bm25_score")


def _marked_lines(spark, d):
    """Lines as chunks; some begin with a numbered provision, some are a definition's heading."""
    rows = _titled(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    line = F.when(F.col("i") % 5 == 1, F.concat(F.lit("> **5.2** "), F.col("line"))).when(F.col("i") % 5 == 2, F.concat(F.lit("**3.1 "), F.array_join(F.slice(T.tokens("line"), 1, 4), " "), F.lit(":** "), F.col("line"))).otherwise(F.col("line"))
    return rows.select("doc_id", (F.col("doc_id") * 100000 + F.col("i")).alias("chunk_id"), line.alias("text"))


def _evidence_queries(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.when(F.col("item_id") % 2 == 0, "¿Cómo se define en 5.2 y 7.1? ").otherwise(F.lit("")), F.col("text")).alias("text"))


def search_evidence(spark, d):
    """Chunks of the documents that a first search found, with provisions, definitions, vectors of chunks and recency."""
    docs, queries, lines = _titled(spark, d), _evidence_queries(spark, d), _marked_lines(spark, d)
    best = lexical.bm25(docs, queries, "query_id", 20)
    near = best.filter("rank <= 3").select("query_id", (F.col("doc_id") * 100000).alias("chunk_id"), "rank")
    return search.evidence(lines, queries, best, near, top_k=30, meta=dated(docs), prefer_recent=True)


def chunk_bonuses(spark, d):
    """What provisions and definitions add, for every query against all lines of its best document."""
    docs, queries, lines = _titled(spark, d), _evidence_queries(spark, d), _marked_lines(spark, d)
    best = lexical.bm25(docs, queries, "query_id", 20).select("query_id", "doc_id")
    rows = best.join(lines, "doc_id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    return rows.select("query_id", "chunk_id", lexical.bonuses(F.col("query"), F.array_distinct(T.tokens("query")), F.col("text")).alias("bonus"))


def bm25_joined_chunks(spark, d):
    """Documents put together from their lines and ranked: the same ranking."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"))
    return lexical.bm25(lexical.joined_chunks(lines), table(spark, d, "benchmark"), "item_id", 10)


def bm25_chunks(spark, d):
    """Lines ranked as documents of their own, over the whole corpus."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    return lexical.bm25(lines.select((F.col("doc_id") * 100000 + F.col("i")).alias("chunk_id"), "text"), table(spark, d, "benchmark"), "item_id", 10, "chunk_id")


def marked_snippet(spark, d):
    """The best twelve words of each passage's first document, its words marked."""
    docs, queries = table(spark, d, "documents"), table(spark, d, "benchmark")
    best = lexical.bm25(docs, queries, "item_id", 1).select("item_id", "doc_id")
    rows = best.join(docs.select("doc_id", "text"), "doc_id").join(queries.select("item_id", F.array_distinct(T.tokens("text")).alias("q")), "item_id")
    return rows.select("item_id", "doc_id", lexical.marked_snippet(F.col("text"), F.col("q"), 12).alias("snippet"))


def path_lookup(spark, d):
    """Slugs to paths to documents; every tenth slug is unknown, every seventh path has no document."""
    docs = table(spark, d, "documents")
    slugs = docs.select(F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("slug"))
    manifest = docs.filter("doc_id % 10 <> 0").select(F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("slug"), F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("relpath"))
    paths = docs.filter("doc_id % 7 <> 0").select("doc_id", F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    return search.by_paths(slugs, manifest, paths)


QUERIES = {f.__name__: f for f in (postings_persisted, vocabulary_persisted, bm25_indexed, title_candidates, heading_candidates, headings_like, phrase_bm25, search_documents, search_lexical, search_evidence, chunk_bonuses, bm25_joined_chunks, bm25_chunks, marked_snippet, path_lookup)}

_W3 = f"array_to_string({tokens_sql('text')}[1:3], ' ')"
_TITLED = f"""
    base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    td AS (SELECT doc_id, 'Ley ' || {_W3} AS title, 'Plan Nacional de Desarrollo ' || (doc_id % 30 + 1990) || '-' || (doc_id % 30 + 1996) AS plan,
                  concat_ws('. ', 'Ley ' || {_W3}, CASE WHEN doc_id % 4 = 0 THEN 'NOM-' || lpad(CAST(doc_id % 200 AS VARCHAR), 3, '0') || '-SSA' END, text) AS text FROM base),
    named AS (SELECT doc_id // 5 AS item_id, doc_id, {_W3} AS first FROM base WHERE doc_id % 5 = 0),
    asked AS (SELECT b.item_id AS query_id, n.doc_id AS of_doc, b.text || ' según la ley ' || first || ' que rige el plan nacional de desarrollo  ' || (n.doc_id % 30 + 1990) || '-' || (n.doc_id % 30 + 1996)
                     || ' y la nom-' || lpad(CAST(n.doc_id % 200 AS VARCHAR), 3, '0') || '-ssa' AS text FROM benchmark b JOIN named n USING (item_id))"""
_QT = r"regexp_extract_all(strip_accents(replace(lower(text), 'ß', 'ss')), '[\p{L}\p{N}_]+')"
_ENDS = "[" + ", ".join(f"'{w}'" for w in search.NAME_ENDS) + "]"
_NAMES = f"""
    qt AS (SELECT query_id, {_QT} AS w FROM asked),
    begun AS (SELECT query_id, w, unnest(range(1, len(w) + 1)) AS i FROM qt),
    tails AS (SELECT query_id, w[i:i + 11] AS t FROM begun WHERE w[i] IN ('ley', 'codigo', 'reglamento')),
    cut AS (SELECT query_id, t, list_min(list_filter(range(4, len(t) + 1), lambda k: list_contains({_ENDS}, t[k]))) AS k FROM tails),
    nm AS (SELECT DISTINCT query_id, CASE WHEN k IS NULL THEN t ELSE t[1:k - 1] END AS words FROM cut),
    names AS (SELECT query_id, array_to_string(words, ' ') AS name FROM nm WHERE len(words) >= 3),
    tt AS (SELECT doc_id, ' ' || array_to_string({tokens_sql("title")}, ' ') || ' ' AS title FROM td),
    entitled AS (SELECT DISTINCT query_id, doc_id, name FROM names JOIN tt ON contains(title, ' ' || name || ' '))"""


def _phrases(docs: str, phrases: str) -> str:
    """Phrases (phrase, name) as terms over documents: hits and scores."""
    return f"""
    ptoks AS (SELECT doc_id, {tokens_sql("text")} AS toks FROM {docs}),
    pdocs AS (SELECT doc_id, toks, len(toks) AS dl, ' ' || array_to_string(toks, ' ') || ' ' AS x FROM ptoks),
    psize AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM pdocs),
    pwords AS (SELECT DISTINCT phrase, name, string_split(name, ' ') AS words FROM {phrases}),
    pcand AS (SELECT phrase, words, doc_id, toks, dl FROM pwords JOIN pdocs ON contains(x, ' ' || name || ' ')),
    phits AS (SELECT phrase, doc_id, dl, len(list_filter(range(1, len(toks) - len(words) + 2), lambda k: toks[k:k + len(words) - 1] = words)) AS hits FROM pcand),
    pdf AS (SELECT phrase, count(*) AS df FROM phits GROUP BY phrase),
    pscore AS (SELECT phrase, doc_id, hits, round({IDF_SQL} * hits * 2.2 / (hits + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score FROM phits JOIN pdf USING (phrase), psize)"""


_CODES = r"codes AS (SELECT query_id, array_to_string(regexp_extract_all(strip_accents(lower(regexp_extract(text, '(?i)\b(?:NOM|NMX)-\d{3}(?:-[A-Z]+)*(?:-\d{4})?\b'))), '[\p{L}\p{N}]+'), ' ') AS name, upper(regexp_extract(text, '(?i)\b(?:NOM|NMX)-\d{3}(?:-[A-Z]+)*(?:-\d{4})?\b')) AS code FROM asked)"


def _first_stage(kept: str) -> str:
    """Lexical candidates: BM25's first 50, then those of codes, then those of names with a title that has them."""
    return f"""{_TITLED}, {_NAMES}, {_CODES}, {bm25_sql('1', 50, 'td', 'asked', 'query_id', kept)},
    asked_phrases AS (SELECT query_id, name, 1 AS source FROM codes WHERE name <> '' UNION SELECT query_id, name, 2 FROM names),
    phr AS (SELECT DISTINCT source || ':' || name AS phrase, name FROM asked_phrases), {_phrases('td', 'phr')},
    said AS (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY score DESC, doc_id) AS place FROM pscore WHERE {kept}),
    extra AS (SELECT query_id, doc_id, max(score) AS score, source FROM said JOIN asked_phrases a ON phrase = source || ':' || a.name
              WHERE place <= CASE WHEN source = 1 THEN 50 ELSE 100 END AND (source = 1 OR (query_id, doc_id, a.name) IN (SELECT query_id, doc_id, name FROM entitled)) GROUP BY ALL)"""


_BOOST = """
    cd AS (SELECT query_id, code, strip_accents(lower(code)) AS folded FROM codes),
    boost AS (SELECT f.query_id, f.doc_id, CASE WHEN contains(strip_accents(lower(t.title)), c.folded) THEN
                  CASE WHEN length(code) - length(replace(code, '-', '')) >= 3 THEN 100.0 ELSE 40.0 END ELSE 0.0 END AS title_boost FROM fused f JOIN td t USING (doc_id) JOIN cd c USING (query_id))"""
_AS_OF = "doc_id % 1500 <= date_diff('day', DATE '2020-01-01', DATE '2023-12-31')"

_MARKED = rf"""
    rawl AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM td),
    ml AS (SELECT doc_id, doc_id * 100000 + i AS chunk_id, CASE WHEN i % 5 = 1 THEN '> **5.2** ' || line WHEN i % 5 = 2 THEN '**3.1 ' || array_to_string({tokens_sql("line")}[1:4], ' ') || ':** ' || line ELSE line END AS text FROM rawl),
    eq AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN '¿Cómo se define en 5.2 y 7.1? ' ELSE '' END || text AS text FROM benchmark)"""
_DEFS = rf"""
    qd AS (SELECT query_id, text AS query, list_distinct({tokens_sql("text")}) AS q, list_distinct(regexp_extract_all(text, '\b\d+\.\d+\b')) AS provisions FROM eq),
    ph AS (SELECT query_id, string_agg(term, ' ' ORDER BY pos) AS phrase FROM (SELECT query_id, term, min(pos) AS pos FROM (SELECT query_id, unnest({tokens_sql("text")}) AS term, generate_subscripts({tokens_sql("text")}, 1) AS pos FROM eq) GROUP BY ALL) GROUP BY query_id),
    cand AS (SELECT b.query_id, m.doc_id, m.chunk_id, m.text FROM best b JOIN ml m USING (doc_id)),
    bon AS (SELECT c.query_id, c.chunk_id, CAST(CASE WHEN contains(strip_accents(replace(lower(c.text), 'ß', 'ss')), phrase) THEN 0.25 ELSE 0 END AS DOUBLE)
                + 20.0 * len(list_filter(provisions, lambda p: list_contains(regexp_extract_all(c.text, '(?m)^[ \t]*(?:>[ \t]*)?(?:\*\*)?(\d+\.\d+)(?:\*\*)?(?:\s|$)', 1), p)))
                + CASE WHEN contains(strip_accents(lower(query)), 'defin') AND len(list_filter(regexp_extract_all(c.text, '(?m)^[ \t]*\*\*\d+(?:\.\d+)+\s+([^*:\n]+):?\*\*', 1), lambda h: len(list_intersect(q, {tokens_sql("h")})) >= 2)) > 0 THEN 20.0 ELSE 0.0 END AS bonus
            FROM cand c JOIN qd USING (query_id) JOIN ph USING (query_id))"""

ORACLE = {
    "postings_persisted": f"WITH {lexical_sql()} SELECT term, doc_id, tf, dl FROM post JOIN stats USING (doc_id)",
    "vocabulary_persisted": f"WITH {lexical_sql()} SELECT term, CAST(df AS BIGINT) AS df FROM vocab",
    "bm25_indexed": f"WITH {bm25_sql('1', 10)} SELECT item_id, doc_id, score, rank FROM best",
    "title_candidates": f"WITH {_TITLED}, {_NAMES} SELECT query_id, doc_id, name FROM entitled",
    "heading_candidates": f"WITH {_TITLED} SELECT query_id, t.doc_id, 'Ámbito: ' || plan AS heading FROM asked a JOIN td t ON t.doc_id % 30 = a.of_doc % 30 WHERE t.doc_id % 3 = 0",
    "headings_like": f"WITH {_TITLED} SELECT doc_id, 'Ámbito: ' || plan AS heading FROM td WHERE doc_id % 3 = 0 AND contains(lower(plan), 'plan nacional de desarrollo 2002')",
    "phrase_bm25": f"""WITH {_TITLED}, tp AS (SELECT doc_id AS phrase, array_to_string({tokens_sql("title")}, ' ') AS name FROM td), {_phrases('td', 'tp')}
        SELECT phrase AS title_of, doc_id, CAST(hits AS BIGINT) AS hits, score FROM pscore""",
    "search_lexical": f"""WITH {_first_stage('true')},
        cands AS (SELECT query_id, doc_id, score, 0 AS source, rank FROM best UNION ALL SELECT query_id, doc_id, score, source, 0 FROM extra),
        one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY source, rank) AS k FROM cands) WHERE k = 1),
        fused AS (SELECT query_id, doc_id, score AS fused, row_number() OVER (PARTITION BY query_id ORDER BY source, rank, doc_id) AS fr FROM one), {_BOOST},
        al AS (SELECT f.query_id, f.doc_id, f.fused AS bm25_score, fr, round(f.fused + title_boost + CASE WHEN (f.query_id, f.doc_id) IN (SELECT query_id, doc_id FROM extra WHERE source = 2) THEN 200 ELSE 0 END, 6) AS score FROM fused f JOIN boost USING (query_id, doc_id)),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fr, doc_id) AS INTEGER) AS rank FROM al)
        SELECT query_id, doc_id, score, rank, bm25_score FROM r WHERE rank <= 20""",
    "search_documents": f"""WITH {_first_stage(_AS_OF)}, {_BASE.strip()},
        hd AS (SELECT a.query_id, t.doc_id FROM asked a JOIN td t ON t.doc_id % 30 = a.of_doc % 30 WHERE t.doc_id % 3 = 0 AND t.{_AS_OF}),
        cands AS (SELECT query_id, doc_id, score, 0 AS source, rank FROM best UNION ALL SELECT query_id, doc_id, score, source, 0 FROM extra UNION ALL SELECT query_id, doc_id, 0, 3, 0 FROM hd),
        one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY source, rank) AS k FROM cands) WHERE k = 1),
        lft AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY source, rank, doc_id) AS rank FROM one),
        v0 AS (SELECT query_id // 50 AS query_id, vec_id % 100 AS doc_id, score, rank FROM cosk),
        v1 AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) AS k FROM v0) WHERE k = 1),
        rgt AS (SELECT * FROM v1 WHERE query_id IN (SELECT query_id FROM asked) AND doc_id IN (SELECT doc_id FROM documents) AND {_AS_OF}),
        ln AS (SELECT query_id, doc_id, rank, (score - min(score) OVER w) / CASE WHEN max(score) OVER w > min(score) OVER w THEN max(score) OVER w - min(score) OVER w ELSE 1 END AS norm FROM lft WINDOW w AS (PARTITION BY query_id)),
        rn AS (SELECT query_id, doc_id, rank, (score - min(score) OVER w) / CASE WHEN max(score) OVER w > min(score) OVER w THEN max(score) OVER w - min(score) OVER w ELSE 1 END AS norm FROM rgt WINDOW w AS (PARTITION BY query_id)),
        j AS (SELECT query_id, doc_id, round(0.75 * coalesce(ln.norm, 0) + 0.25 * coalesce(rn.norm, 0), 6) AS fused, least(coalesce(ln.rank, 1000000000), coalesce(rn.rank, 1000000000)) AS bst
              FROM (SELECT * FROM ln WHERE query_id IN (SELECT query_id FROM rgt)) ln FULL JOIN rn USING (query_id, doc_id)),
        fused AS (SELECT query_id, doc_id, fused, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, bst, doc_id) AS fr FROM j
                  UNION ALL SELECT query_id, doc_id, score, rank FROM lft WHERE query_id NOT IN (SELECT query_id FROM rgt)), {_BOOST},
        rec AS (SELECT query_id, doc_id, max(fused) OVER (PARTITION BY query_id) * round(0.15 * (count(*) OVER (PARTITION BY query_id) - (row_number() OVER (PARTITION BY query_id ORDER BY doc_id % 1500 DESC, doc_id) - 1)) / CAST(count(*) OVER (PARTITION BY query_id) AS DOUBLE), 6) AS recent FROM fused),
        al AS (SELECT f.query_id, f.doc_id, fr, title_boost + CASE WHEN (f.query_id, f.doc_id) IN (SELECT query_id, doc_id FROM extra WHERE source = 2 UNION SELECT query_id, doc_id FROM hd) THEN 200 ELSE 0 END AS title_boost, fused, recent
               FROM fused f JOIN boost USING (query_id, doc_id) JOIN rec USING (query_id, doc_id)),
        s AS (SELECT *, round(fused + title_boost + recent, 6) AS score FROM al),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fr, doc_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, doc_id, score, rank, CAST(title_boost AS DOUBLE) AS title_boost FROM r WHERE rank <= 20""",
    "chunk_bonuses": f"WITH {_TITLED}, {_MARKED}, {bm25_sql('1', 20, 'td', 'eq', 'query_id')}, {_DEFS} SELECT query_id, chunk_id, bonus FROM bon",
    "search_evidence": f"""WITH {_TITLED}, {_MARKED}, {bm25_sql('1', 20, 'td', 'eq', 'query_id')}, {_DEFS},
        ct AS (SELECT query_id, doc_id, chunk_id, {tokens_sql("text")} AS toks FROM cand),
        meas AS (SELECT *, greatest(1, len(toks)) AS dl, count(*) OVER (PARTITION BY query_id) AS n, avg(greatest(1, len(toks))) OVER (PARTITION BY query_id) AS avgl FROM ct),
        ctf AS (SELECT query_id, chunk_id, dl, n, avgl, term, count(*) AS tf FROM (SELECT query_id, chunk_id, dl, n, avgl, unnest(toks) AS term FROM meas) GROUP BY ALL),
        chit AS (SELECT c.* FROM ctf c JOIN qterms q ON q.query_id = c.query_id AND q.term = c.term),
        cdf AS (SELECT query_id, term, count(*) AS df FROM chit GROUP BY ALL),
        csc AS (SELECT h.query_id, h.chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgl))) AS score FROM chit h JOIN cdf f ON f.query_id = h.query_id AND f.term = h.term GROUP BY ALL),
        tot AS (SELECT b.query_id, b.chunk_id, round(coalesce(score, 0) + bonus, 6) AS score FROM bon b LEFT JOIN csc USING (query_id, chunk_id)),
        lx AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM tot WHERE score > 0),
        lexi AS (SELECT * FROM lx WHERE rank <= 200),
        vec AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS rank FROM (SELECT query_id, doc_id * 100000 AS chunk_id, rank FROM best WHERE rank <= 3) SEMI JOIN cand USING (query_id, chunk_id)),
        a AS (SELECT query_id, chunk_id, rank FROM lexi UNION ALL SELECT query_id, chunk_id, rank FROM vec),
        rf AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS fused, min(rank) AS bst FROM a GROUP BY ALL),
        ro AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, bst, chunk_id) AS rank FROM rf),
        rl AS (SELECT query_id, chunk_id, count(*) OVER (PARTITION BY query_id) AS n, (count(*) OVER (PARTITION BY query_id) - rank + 1) / CAST(count(*) OVER (PARTITION BY query_id) AS DOUBLE) AS rel,
                      round((count(*) OVER (PARTITION BY query_id) - (row_number() OVER (PARTITION BY query_id ORDER BY (chunk_id // 100000) % 1500 DESC, chunk_id) - 1)) / CAST(count(*) OVER (PARTITION BY query_id) AS DOUBLE), 6) AS rec FROM ro),
        bl AS (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(0.75 * rel + 0.25 * rec, 6) DESC, rel DESC, chunk_id) AS INTEGER) AS rank FROM rl)
        SELECT b.query_id, b.chunk_id // 100000 AS doc_id, b.chunk_id, coalesce(l.score, 0.0) AS score, b.rank, CASE WHEN v.chunk_id IS NULL THEN 'bm25_chunk' WHEN l.chunk_id IS NULL THEN 'vector' ELSE 'hybrid' END AS source
        FROM bl b LEFT JOIN lexi l USING (query_id, chunk_id) LEFT JOIN vec v USING (query_id, chunk_id) WHERE b.rank <= 30""",
    "bm25_joined_chunks": f"WITH {bm25_sql('1', 10)} SELECT item_id, doc_id, score, rank FROM best",
    "bm25_chunks": f"""WITH ch AS (SELECT doc_id * 100000 + generate_subscripts(string_split(text, chr(10)), 1) - 1 AS doc_id, unnest(string_split(text, chr(10))) AS text FROM documents), {bm25_sql('1', 10, 'ch')}
        SELECT item_id, doc_id AS chunk_id, score, rank FROM best""",
    "marked_snippet": rf"""WITH {bm25_sql('1', 1)},
        w AS (SELECT item_id, doc_id, regexp_split_to_array(t.text, '\s+') AS w, list_distinct({tokens_sql("q.text")}) AS q FROM best JOIN documents t USING (doc_id) JOIN benchmark q USING (item_id)),
        f AS (SELECT *, list_transform(w, lambda x: array_to_string({tokens_sql("x")}, '')) AS f FROM w),
        b AS (SELECT *, list_sort(list_transform(list_filter(range(1, len(w) + 1), lambda i: list_contains(q, f[i])), lambda i: {{'n': len(list_intersect(q, f[i:i + 11])), 'at': -i}}), 'DESC') AS p FROM f),
        s AS (SELECT *, coalesce(-p[1].at, 1) AS s FROM b)
        SELECT item_id, doc_id, CASE WHEN s > 1 THEN '…' ELSE '' END || array_to_string(list_transform(range(s, least(s + 12, len(w) + 1)), lambda i: CASE WHEN list_contains(q, f[i]) THEN '[' || w[i] || ']' ELSE w[i] END), ' ') || CASE WHEN s + 12 <= len(w) THEN '…' ELSE '' END AS snippet FROM s""",
    "path_lookup": """
        SELECT 's' || d.doc_id AS slug, CASE WHEN d.doc_id % 10 <> 0 THEN source || '/' || d.doc_id END AS relpath, CASE WHEN d.doc_id % 10 <> 0 AND d.doc_id % 7 <> 0 THEN d.doc_id END AS doc_id FROM documents d""",
}
