"""Queries of the lexical operators: documents as the corpus, benchmark passages as the queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvid.functions import text as T
from corvid.operators import lexical as L
from corvid.operators import search
from corvid.plans.common import LEXICAL_SQL, bm25_sql, table, tokens_sql


def flagship_bm25_documents(spark, d):
    return L.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"), "item_id", 10)


def bm25_topk_batch(spark, d):
    return L.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"), "item_id", 50, distinct=False)


def doc_stats(spark, d):
    return L.doc_stats(table(spark, d, "documents"))


def postings_tf(spark, d):
    return L.postings(table(spark, d, "documents"))


def vocab_df(spark, d):
    return L.vocabulary(table(spark, d, "documents"))


def corpus_size(spark, d):
    return L.corpus_size(table(spark, d, "documents")).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


def df_pruned_terms(spark, d):
    docs = table(spark, d, "documents")
    return L.pruned(L.query_terms(table(spark, d, "benchmark"), "item_id", distinct=False), L.vocabulary(docs), L.corpus_size(docs), "item_id").select("item_id", "term", "weight", "df")


def _phrases(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.tokens("text").alias("words"))


def phrase_match(spark, d):
    """Whole passages as phrases, and how often each document has them."""
    return L.phrase_hits(table(spark, d, "documents"), _phrases(spark, d), "item_id")


def _lines(spark, d):
    """Lines of documents as chunks."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    return rows.select("doc_id", (F.col("doc_id") * 100000 + F.col("i")).alias("chunk_id"), "text")


def chunk_bm25(spark, d):
    best = L.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"), "item_id", 5).select("item_id", "doc_id")
    return L.chunk_bm25(best.join(_lines(spark, d), "doc_id"), table(spark, d, "benchmark"), "item_id")


def evidence_search(spark, d):
    """Both stages: five documents a query, then their lines."""
    queries = table(spark, d, "benchmark").withColumnRenamed("item_id", "query_id")
    best = L.bm25(table(spark, d, "documents"), queries, "query_id", 5)
    return search.evidence(_lines(spark, d), queries, best, top_k=10).select("query_id", "doc_id", "chunk_id", "score", "rank", "source")


def snippet_window(spark, d):
    """A window of 200 characters around the first word of each query in its ten best documents."""
    docs, queries = table(spark, d, "documents"), table(spark, d, "benchmark")
    best = L.bm25(docs, queries, "item_id", 10).select("item_id", "doc_id", "rank")
    word = F.regexp_extract(F.lower("q"), r"[\p{L}\p{N}]{4,}", 0)
    rows = best.join(docs.select("doc_id", "text"), "doc_id").join(queries.select("item_id", F.col("text").alias("q")), "item_id")
    return rows.select("item_id", "doc_id", "rank", T.snippet(F.col("text"), F.greatest(F.lit(1), F.instr(F.lower("text"), word))).alias("snippet"))


def alias_expansion(spark, d):
    """Query words with what acronyms stand for; the acronyms are put before the passages here."""
    text = F.concat(F.element_at(F.array(*map(F.lit, ["INEGI ", "inpc UMA ", ""])), (F.col("item_id") % 3 + 1).cast("int")), F.col("text"))
    return table(spark, d, "benchmark").select("item_id", F.array_join(search.expanded(T.tokens(text)), " ").alias("terms"))


def identifier_candidates(spark, d):
    """Documents that hold an identifier of the query as a phrase. Identifiers are put before some texts here, whole or with
    another ending, so not every document has one."""
    number = F.lpad((F.col("doc_id") % 100).cast("string"), 3, "0")
    head = F.element_at(F.array(F.concat(F.lit("Norma NOM-"), number, F.lit("-SSA-2010 ")), F.concat(F.lit("nom "), number, F.lit(" SSA 2011 ")), F.lit("")), (F.col("doc_id") % 3 + 1).cast("int"))
    docs = table(spark, d, "documents").withColumn("text", F.concat(head, "text"))
    queries = table(spark, d, "benchmark").select("item_id", F.explode(search.identifiers(F.concat(F.lit("ver nom-"), F.lpad((F.col("item_id") % 100).cast("string"), 3, "0"), F.lit("-SSA-2010 y NMX-001 "), F.col("text")))).alias("identifier"))
    phrases = queries.select("item_id", T.tokens("identifier").alias("words"))
    return L.phrase_hits(docs, phrases, "item_id")


def title_boost(spark, d):
    """Every passage, with an identifier before it, against titles some of which name it."""
    query = F.concat(F.lit("requisitos de la nom-"), F.lpad((F.col("item_id") % 10).cast("string"), 3, "0"), F.when(F.col("item_id") % 4 == 0, "-ssa-2010 ").otherwise(" "), F.col("text"))
    titles = table(spark, d, "nation").select("n_nationkey", F.concat(F.element_at(F.array(F.lit("Norma Oficial Mexicana NOM-"), F.lit("Proyecto de NOM-")), (F.col("n_nationkey") % 2 + 1).cast("int")), F.lpad((F.col("n_nationkey") % 10).cast("string"), 3, "0"), F.lit("-SSA-2010, requisitos de "), F.lower("n_name")).alias("title"))
    rows = table(spark, d, "benchmark").select("item_id", query.alias("query")).join(titles, F.col("item_id") % 5 == F.col("n_nationkey") % 5)
    return rows.select("item_id", "n_nationkey", search.title_boost(F.col("query"), F.col("title")).alias("boost"))


QUERIES = {f.__name__: f for f in (flagship_bm25_documents, bm25_topk_batch, doc_stats, postings_tf, vocab_df, corpus_size, df_pruned_terms, phrase_match, chunk_bm25, evidence_search, snippet_window, alias_expansion, identifier_candidates, title_boost)}

_CHUNK_SQL = f"""
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
    cand AS (SELECT b.item_id, l.doc_id, l.doc_id * 100000 + l.i AS chunk_id, l.text, {tokens_sql("l.text")} AS toks FROM best b JOIN lines l USING (doc_id)),
    meas AS (SELECT *, greatest(1, len(toks)) AS dl, count(*) OVER (PARTITION BY item_id) AS n, avg(greatest(1, len(toks))) OVER (PARTITION BY item_id) AS avgl FROM cand),
    ctf AS (SELECT item_id, chunk_id, dl, n, avgl, term, count(*) AS tf FROM (SELECT item_id, chunk_id, dl, n, avgl, unnest(toks) AS term FROM meas) GROUP BY ALL),
    chit AS (SELECT c.* FROM ctf c JOIN qterms q ON q.item_id = c.item_id AND q.term = c.term),
    cdf AS (SELECT item_id, term, count(*) AS df FROM chit GROUP BY ALL),
    csc AS (SELECT h.item_id, h.chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgl))) AS score FROM chit h JOIN cdf f ON f.item_id = h.item_id AND f.term = h.term GROUP BY ALL),
    qlist AS (SELECT item_id, string_agg(term, ' ' ORDER BY pos) AS phrase FROM (
                  SELECT item_id, term, min(pos) AS pos FROM (
                      SELECT item_id, unnest({tokens_sql("text")}) AS term, generate_subscripts({tokens_sql("text")}, 1) AS pos FROM benchmark) GROUP BY item_id, term) GROUP BY item_id),
    bonus AS (SELECT c.item_id, c.chunk_id, 0.25 AS bonus FROM cand c JOIN qlist q USING (item_id) WHERE contains(strip_accents(replace(lower(c.text), 'ß', 'ss')), q.phrase)),
    chunk AS (SELECT item_id, chunk_id, round(coalesce(score, 0) + coalesce(bonus, 0), 6) AS score FROM csc FULL JOIN bonus USING (item_id, chunk_id))"""

ORACLE = {
    "flagship_bm25_documents": f"WITH {bm25_sql('1', 10)} SELECT item_id, doc_id, score, rank FROM best",
    "bm25_topk_batch": f"WITH {bm25_sql('weight', 50)} SELECT item_id, doc_id, score, rank FROM best",
    "doc_stats": f"WITH {LEXICAL_SQL} SELECT doc_id, dl FROM stats",
    "postings_tf": f"WITH {LEXICAL_SQL} SELECT term, doc_id, tf, dl FROM post JOIN stats USING (doc_id)",
    "vocab_df": f"WITH {LEXICAL_SQL} SELECT term, df FROM vocab",
    "corpus_size": f"WITH {LEXICAL_SQL} SELECT n_docs, round(avgdl, 6) AS avgdl FROM size",
    "df_pruned_terms": f"WITH {LEXICAL_SQL} SELECT item_id, term, weight, df FROM pruned",
    "phrase_match": f"""
        WITH w AS (SELECT item_id, {tokens_sql("text")} AS p FROM benchmark), t AS (SELECT doc_id, {tokens_sql("text")} AS x FROM documents),
        c AS (SELECT item_id, doc_id, p, x FROM w JOIN t ON contains(' ' || array_to_string(x, ' ') || ' ', ' ' || array_to_string(p, ' ') || ' ') WHERE len(p) > 0)
        SELECT item_id, doc_id, CAST(len(list_filter(range(1, len(x) - len(p) + 2), lambda k: x[k:k + len(p) - 1] = p)) AS BIGINT) AS hits FROM c""",
    "chunk_bm25": f"WITH {bm25_sql('1', 5)}, {_CHUNK_SQL} SELECT item_id, chunk_id, score FROM chunk WHERE score > 0",
    "evidence_search": f"""
        WITH {bm25_sql('1', 5)}, {_CHUNK_SQL}
        SELECT item_id AS query_id, chunk_id // 100000 AS doc_id, chunk_id, score, CAST(rank AS INTEGER) AS rank, 'bm25_chunk' AS source
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank FROM chunk WHERE score > 0) WHERE rank <= 10""",
    "snippet_window": rf"""
        WITH {bm25_sql('1', 10)},
        x AS (SELECT b.item_id, b.doc_id, b.rank, t.text, greatest(1, strpos(lower(t.text), regexp_extract(lower(q.text), '[\p{{L}}\p{{N}}]{{4,}}'))) AS p
              FROM best b JOIN documents t USING (doc_id) JOIN benchmark q USING (item_id)),
        y AS (SELECT *, greatest(1, least(p - 50, length(text) - 199)) AS s FROM x)
        SELECT item_id, doc_id, rank, CASE WHEN length(text) <= 200 THEN text
               ELSE (CASE WHEN s > 1 THEN '…' ELSE '' END) || substring(text, s, 200) || (CASE WHEN s + 199 < length(text) THEN '…' ELSE '' END) END AS snippet FROM y""",
    "alias_expansion": f"""
        WITH t AS (SELECT item_id, {tokens_sql("CASE item_id % 3 WHEN 0 THEN 'INEGI ' WHEN 1 THEN 'inpc UMA ' ELSE '' END || text")} AS w FROM benchmark),
        e AS (SELECT item_id, w || CASE item_id % 3 WHEN 0 THEN ['instituto', 'nacional', 'estadistica', 'geografia']
                     WHEN 1 THEN ['indice', 'nacional', 'precios', 'consumidor', 'unidad', 'medida', 'actualizacion'] ELSE [] END AS w FROM t),
        u AS (SELECT item_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM e),
        f AS (SELECT item_id, term, min(pos) AS pos FROM u GROUP BY ALL)
        SELECT item_id, string_agg(term, ' ' ORDER BY pos) AS terms FROM f GROUP BY item_id""",
    "identifier_candidates": f"""
        WITH h AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Norma NOM-' || lpad(CAST(doc_id % 100 AS VARCHAR), 3, '0') || '-SSA-2010 ' WHEN 1 THEN 'nom ' || lpad(CAST(doc_id % 100 AS VARCHAR), 3, '0') || ' SSA 2011 ' ELSE '' END || text AS text FROM documents),
        t AS (SELECT doc_id, ' ' || array_to_string({tokens_sql("text")}, '  ') || ' ' AS x FROM h),
        q AS (SELECT DISTINCT item_id, unnest(list_transform(regexp_extract_all('ver nom-' || lpad(CAST(item_id % 100 AS VARCHAR), 3, '0') || '-SSA-2010 y NMX-001 ' || text, '(?i)\\b(?:NOM|NMX)-\\d{{3}}(?:-[A-Z]+)*(?:-\\d{{4}})?\\b'), lambda i: replace(lower(i), '-', '  '))) AS p FROM benchmark)
        SELECT item_id, doc_id, CAST(sum((length(x) - length(replace(x, ' ' || p || ' ', ''))) // (length(p) + 2)) AS BIGINT) AS hits FROM q JOIN t ON contains(x, ' ' || p || ' ') GROUP BY ALL""".replace("\\\\", "\\"),
    "title_boost": f"""
        WITH q AS (SELECT item_id, 'requisitos de la nom-' || lpad(CAST(item_id % 10 AS VARCHAR), 3, '0') || CASE WHEN item_id % 4 = 0 THEN '-ssa-2010 ' ELSE ' ' END || text AS query FROM benchmark),
        t AS (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'Norma Oficial Mexicana NOM-' ELSE 'Proyecto de NOM-' END || lpad(CAST(n_nationkey % 10 AS VARCHAR), 3, '0') || '-SSA-2010, requisitos de ' || lower(n_name) AS title FROM nation),
        x AS (SELECT item_id, n_nationkey, title, query, lower(regexp_extract(query, '(?i)\\b(?:NOM|NMX)-[0-9]{{3}}(?:-[A-Z]+)*(?:-[0-9]{{4}})?\\b')) AS i FROM q JOIN t ON item_id % 5 = n_nationkey % 5)
        SELECT item_id, n_nationkey, CASE WHEN contains(lower(title), i) THEN CASE WHEN length(i) - length(replace(i, '-', '')) >= 3 THEN 100.0 ELSE 40.0 END + CASE WHEN title LIKE 'Norma%' THEN 40.0 ELSE 0.0 END
               + 12.0 * least(4, len(list_distinct(list_intersect({tokens_sql("query")}, {tokens_sql("title")})))) ELSE 0.0 END AS boost FROM x""".replace("\\\\", "\\"),
}
