"""The agent's tools over the engine's tables: each takes checked arguments and gives a few rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.operators import coverage, search
from corvid.operators.agent import MOST_OUTLINE, Embedder, Toolbox
from corvid.operators.search import Filters

#: Characters of a snippet.
SNIPPET = 400


@dataclass
class Library:
    """What is searched. ``docs``: doc_id, text; ``chunks``: chunk_id, doc_id, chunk_index, text, chunk_hash, token_count,
    heading_path; ``meta``: doc_id, publication_date, section; ``titles``: doc_id, title. With ``embedder`` and ``nearest`` (a query's
    vector to its best chunks: query_id, chunk_id, score, rank) searches have vectors too. ``index``: a persisted index's folder.
    ``cutoff``: the date beyond which nothing may be seen."""

    docs: DataFrame
    chunks: DataFrame
    meta: DataFrame
    titles: DataFrame
    index: str | None = None
    embedder: Embedder | None = None
    nearest: Callable[[list[float]], DataFrame] | None = None
    cutoff: str | None = None

    def _filters(self, arguments: dict) -> Filters:
        return Filters(*(arguments.get(k) for k in ("as_of", "date_from", "date_to", "section"))).within(self.cutoff)

    def _query(self, text: str) -> DataFrame:
        return self.docs.sparkSession.createDataFrame([(0, text)], "query_id bigint, text string")

    def _vectors(self, arguments: dict) -> DataFrame | None:
        if arguments["strategy"] == "lexical" or self.embedder is None or self.nearest is None:
            return None
        return self.nearest(self.embedder.embed([arguments["query"]])[0])

    def list_publications(self, arguments: dict) -> list[dict]:
        rows = search.publications(self.meta, self._filters(arguments), arguments["limit"]).join(self.titles.select("doc_id", "title"), "doc_id", "left")
        return [r.asDict() for r in rows.orderBy(F.desc("publication_date"), F.desc("doc_id")).collect()]

    def search_documents(self, arguments: dict) -> list[dict]:
        near = self._vectors(arguments)
        if near is not None:
            owners = near.join(self.chunks.select("chunk_id", "doc_id"), "chunk_id")
            near = owners.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"), F.min("rank").alias("rank"))
        strategy = arguments["strategy"] if near is not None else "lexical"
        hits = search.documents(self.docs, self._query(arguments["query"]), self.meta, self._filters(arguments), near, top_k=arguments["top_k"], prefer_recent=arguments["prefer_recent"], titles=self.titles, headings=self.chunks.select("doc_id", "heading_path"), strategy=strategy, index=self.index)
        rows = hits.join(self.titles.select("doc_id", "title"), "doc_id", "left").join(self.meta.select("doc_id", "publication_date", "section"), "doc_id", "left")
        return [r.asDict() for r in rows.drop("query_id").orderBy("rank").collect()]

    def search_evidence(self, arguments: dict) -> list[dict]:
        wanted = self.docs.sparkSession.createDataFrame([(0, i) for i in arguments["document_ids"]], "query_id bigint, doc_id bigint")
        near = self._vectors(arguments)
        strategy = arguments["strategy"] if near is not None else "lexical"
        hits = search.evidence(self.chunks, self._query(arguments["query"]), wanted, near, depth=300, top_k=arguments["top_k"], strategy=strategy, meta=self.meta, prefer_recent=arguments["prefer_recent"])
        mine = self.chunks.filter(F.col("doc_id").isin(arguments["document_ids"]))
        rows = hits.join(mine.select("chunk_id", "text", "heading_path"), "chunk_id").join(search.evidence_titles(mine, self.titles), "doc_id", "left")
        out = []
        for r in rows.drop("query_id").orderBy("rank").collect():
            row = r.asDict()
            row["snippet"], row["snippet_truncated"] = coverage.snippet(row.pop("text"), arguments["query"], SNIPPET)
            out.append(row)
        return out

    def get_document_outline(self, arguments: dict) -> list[dict]:
        rows = self.chunks.filter(F.col("doc_id") == arguments["document_id"]).select("chunk_id", "chunk_index", "token_count", "heading_path")
        return [r.asDict() for r in rows.orderBy("chunk_index").limit(MOST_OUTLINE).collect()]

    def read_chunks(self, arguments: dict) -> list[dict]:
        wanted = self.chunks.filter(F.col("chunk_id").isin(arguments["chunk_ids"])).select("doc_id", "chunk_index", "chunk_id")
        found = {r["chunk_id"] for r in wanted.collect()}
        if unknown := sorted(set(arguments["chunk_ids"]) - found):
            raise ValueError(f"no chunks {unknown}")
        rows = search.read_chunks(self.chunks, wanted.drop("chunk_id"), arguments["neighbor_window"])
        rows = rows.join(self.meta.select("doc_id", F.col("publication_date").cast("string").alias("publication_date")), "doc_id", "left").join(self.titles.select("doc_id", "title"), "doc_id", "left")
        return [r.asDict() for r in rows.drop("chunk_hash").orderBy("doc_id", "chunk_index").collect()]

    def toolbox(self) -> Toolbox:
        names = ("list_publications", "search_documents", "search_evidence", "get_document_outline", "read_chunks")
        return Toolbox({name: getattr(self, name) for name in names})
