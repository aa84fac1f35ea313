"""Search over a collection: settings, an index and questions in one job."""

from __future__ import annotations

import copy
import json
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.stem import stemmed_tokens
from quarry.functions.text import source_title, titled, tokens
from quarry.operators import chunks, dense, facets, fusion, lexical, positional, windows
from quarry.operators.index import RebuildRequired, embed_once, refresh, source_delta
from quarry.operators.lifecycle import cleaned, rerank_or_keep
from quarry.storage import sent, settle

NOTHING = "No relevant information found."


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 700
    chunk_overlap: int = 100
    top_k: int = 5
    candidates: int = 50
    rrf_k: int = 60
    weights: tuple[float, float] = (1.0, 1.0)
    k1: float = 1.5
    b: float = 0.75
    metric: str = "cosine"
    titles: bool = True
    clean: bool = True
    stemming: bool = True
    balanced: bool = True
    facets: int = 3
    radius: int = 0
    whole_documents: int = 8000

    def __post_init__(self):
        checks = (
            (1 <= self.top_k <= 100, "top_k"),
            (1 <= self.candidates <= 1000, "candidates"),
            (0 <= self.radius <= 3, "radius"),
            (0 <= self.whole_documents <= 16_000, "whole_documents"),
            (0 <= self.chunk_overlap < self.chunk_size, "chunk_overlap"),
            (self.metric in dense.METRICS, "metric"),
            (min(self.weights) >= 0, "weights"),
        )
        if bad := [name for ok, name in checks if not ok]:
            raise ValueError(f"out of range: {', '.join(bad)}")

    @property
    def depth(self) -> int:
        """Candidates of each channel: never fewer than what is returned."""
        return max(self.candidates, self.top_k)


class Retriever:
    """Documents (doc_id, text[, path]) cut into passages, searched by all questions together."""

    def __init__(self, documents: DataFrame, settings: Settings | None = None, embed=None):
        """embed: Column -> Column of vectors, or None for lexical search alone."""
        self.settings = settings or Settings()
        self.embed = embed
        self.documents = documents if "path" in documents.columns else documents.withColumn("path", F.lit(""))
        self.passages = settle(self._cut(self.documents))
        self._index = self._symbols = self._blocks = self._vectors = None

    def _cut(self, documents: DataFrame) -> DataFrame:
        s = self.settings
        made = chunks.chunk_documents(documents, path_col="path", size=s.chunk_size, overlap=s.chunk_overlap)
        made = made.join(documents.select("doc_id", "path"), "doc_id")
        made = cleaned(made, "path", "content", "clean") if s.clean else made.withColumn("clean", F.col("content"))
        searchable = titled(source_title(F.col("path")), F.col("clean")) if s.titles else F.col("clean")
        made = made.withColumn("n", F.col("chunk_id")).withColumn("id", F.concat_ws("::chunk:", F.col("doc_id").cast("string"), F.col("chunk_id").cast("string")))
        return made.withColumn("searchable", searchable).drop("clean")

    def _embedded(self, passages: DataFrame) -> DataFrame:
        rows = passages.select("id", F.col("searchable").alias("content"))
        return embed_once(rows, lambda t: t.withColumn("vector", self.embed(F.col("text")))).select("id", F.col("vector").alias("embedding"))

    def refreshed(self, documents: DataFrame) -> Retriever:
        """A retriever of the documents as they are now: only those added, or with another path or text, are cut and embedded again, and those gone are left out.

        This one goes on with its own tables. Postings are built anew when a search asks for them, as their totals change with any passage.
        """
        other = copy.copy(self)
        other.documents = documents if "path" in documents.columns else documents.withColumn("path", F.lit(""))
        was, now = (t.select("doc_id", "path", F.sha2(F.col("text").cast("binary"), 256).alias("digest")) for t in (self.documents, other.documents))
        delta = settle(source_delta(was, now, "doc_id", ["path", "digest"]))
        made = settle(self._cut(other.documents.join(delta, "doc_id", "left_semi")))
        other.passages = settle(refresh(self.passages, delta, made, "doc_id"))
        other._index = other._symbols = other._blocks = other._vectors = None
        if self._vectors is not None:
            kept = self._vectors.join(self.passages.join(delta, "doc_id", "left_semi").select("id"), "id", "left_anti")
            other._vectors = settle(kept.unionByName(self._embedded(made)))
        return other

    def _stamp(self) -> str:
        return json.dumps({"settings": asdict(self.settings), "embedded": self.embed is not None})

    def save(self, folder: str) -> None:
        """Write documents, passages and vectors below a new folder; its settings come last, so a folder that isn't whole doesn't open."""
        parts = {"documents": self.documents, "passages": self.passages} | ({"vectors": self.vectors} if self.embed else {})
        for name, rows in parts.items():
            rows.write.mode("errorifexists").parquet(f"{folder}/{name}")
        self.passages.sparkSession.createDataFrame([(self._stamp(),)], "stamp string").coalesce(1).write.mode("errorifexists").parquet(f"{folder}/stamp")

    @classmethod
    def open(cls, spark: SparkSession, folder: str, settings: Settings | None = None, embed=None) -> Retriever:
        """A saved retriever, without cutting or embedding; RebuildRequired if there is none that is whole or it was made with other settings."""
        made = cls.__new__(cls)
        made.settings, made.embed = settings or Settings(), embed
        try:
            stamp = spark.read.schema("stamp string").parquet(f"{folder}/stamp").first()
        except AnalysisException as missing:
            raise RebuildRequired("nothing is saved here") from missing
        if stamp is None or stamp[0] != made._stamp():
            raise RebuildRequired("saved with other settings")
        made.documents, made.passages = (spark.read.parquet(f"{folder}/{name}") for name in ("documents", "passages"))
        made._index = made._symbols = made._blocks = None
        made._vectors = spark.read.parquet(f"{folder}/vectors") if embed else None
        return made

    def _fields(self) -> tuple[lexical.Index, lexical.Index]:
        """The indexes of the passages' texts and of their identifier words, stored when a search first asks for them and read by all later ones."""
        if self._index is None:
            self._index, self._symbols = lexical.build_fields(self.passages, "id", "searchable", stemmed_tokens if self.settings.stemming else tokens)
        return self._index, self._symbols

    @property
    def index(self) -> lexical.Index:
        return self._fields()[0]

    @property
    def symbols(self) -> lexical.Index:
        return self._fields()[1]

    @property
    def blocks(self) -> positional.BlockIndex:
        """The passages' positions, stored when a question first has a quoted phrase."""
        if self._blocks is None:
            self._blocks = positional.build(self.passages, "id", "searchable", self.index.tokenizer)
        return self._blocks

    @property
    def vectors(self) -> DataFrame:
        """The passages' vectors; each distinct text is embedded once, when a search first asks for them."""
        if self._vectors is None:
            self._vectors = settle(self._embedded(self.passages))
        return self._vectors

    def _channels(self, asked: DataFrame, scope: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Dense and lexical lists. Words count in the content and in its identifier words; a question that is one quoted phrase is searched as such."""
        s = self.settings
        within = None if scope is None else settle(self.passages.join(scope.select("doc_id").distinct(), "doc_id", "left_semi").select(F.col("id").alias("doc_id")))
        how = {"within": within, "k1": s.k1, "b": s.b}
        quoted = asked.where(F.trim("query").startswith('"') & F.trim("query").endswith('"'))
        if quoted.isEmpty():
            words = lexical.fields_search((self.index, self.symbols), asked, s.depth, **how)
        else:
            words = positional.quoted_search(self.blocks, (self.index, self.symbols), asked, s.depth, **how).drop("mode")
        if self.embed is None:
            return words.limit(0), words
        vectors = self.vectors if within is None else self.vectors.join(within.withColumnRenamed("doc_id", "id"), "id", "left_semi")
        return dense.search(vectors, asked.select("query_id", self.embed(F.col("query")).alias("vector")), s.depth, s.metric, "id"), words

    def search(self, questions: DataFrame, scorer=None, scope: DataFrame | None = None) -> DataFrame:
        """(query_id, id, rank, doc_id, content, start_offset, end_offset, whole_document): facets searched apart, fused, shortlisted, reranked and merged, then widened.

        scorer: a column, or a function of questions and texts (each headed by its source's name); a question that it fails for keeps its shortlist's order. scope: the documents
        (doc_id) that are searched, if not all; ranks and counts are those of the scope.
        """
        s = self.settings
        parts = settle(facets.decompose(questions, s.facets).withColumn("facet_id", F.xxhash64("query_id", "facet_no")))
        asked = parts.select(F.col("facet_id").alias("query_id"), F.col("facet").alias("query"))
        channels = [settle(c) for c in self._channels(asked, scope)]
        fused = fusion.rrf(*channels, weights=s.weights, k=s.rrf_k)
        short = fusion.balanced(fused, channels, s.depth) if s.balanced else fused.where(F.col("fused_rank") <= s.depth).withColumn("shortlist_rank", F.col("fused_rank"))
        named = F.concat(F.lit("Source: "), F.element_at(F.split(F.coalesce("path", F.lit("")), "/"), -1), F.lit("\n"), F.col("searchable"))
        full = short.join(self.passages.select(F.col("id").alias("doc_id"), named.alias("content")), "doc_id").join(sent(asked), "query_id")
        if scorer is None or isinstance(scorer, Column):
            kept = fusion.rerank(full, scorer if scorer is not None else -F.col("shortlist_rank").cast("double"), s.top_k)
        else:
            kept = rerank_or_keep(full, scorer, s.top_k)
        named = kept.select(F.col("query_id").alias("facet_id"), "doc_id", F.col("final_rank").alias("rank")).join(sent(parts.select("facet_id", "query_id", "facet_no")), "facet_id")
        merged = fusion.merge_facets(named, s.top_k).withColumnRenamed("doc_id", "id")
        hits = merged.join(self.passages.select("id", "doc_id", "n"), "id").select("query_id", "doc_id", "n", "rank")
        wide = windows.expand(hits, self.passages.select("doc_id", "n", "start_offset", "end_offset", "content"), self.documents, s.radius, s.whole_documents)
        text = F.translate(F.substring(F.col("text"), (F.col("start_offset") + 1).cast("int"), (F.col("end_offset") - F.col("start_offset")).cast("int")), "\f", " ")
        return wide.join(self.documents.select("doc_id", "path", "text"), "doc_id").select("query_id", "doc_id", "path", "n", "rank", "start_offset", "end_offset", "whole_document", text.alias("content"))


