"""From source to answer: cleaning before an index, an index's stamp and state, what a search shows, and what a model is given."""

from __future__ import annotations

import hashlib
import json
import platform
from collections.abc import Callable, Iterator, Mapping
from importlib import metadata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources.readers import clean_column

# Extensions whose text is prose, and those of Markdown.
PROSE = (".md", ".markdown", ".txt", ".pdf", ".docx")
MARKDOWN = (".md", ".markdown")
STAMP_VERSION = 3


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def cleaned(passages: DataFrame, path_col: str = "path", content_col: str = "content", into: str = "searchable") -> DataFrame:
    """passages with what is searched: prose without layout marks, anything else as it is. A passage of which nothing is left goes."""
    content, kind = F.col(content_col), extension(F.col(path_col))
    text = F.when(kind.isin(*MARKDOWN), clean_column(content, True)).when(kind.isin(*PROSE), clean_column(content, False)).otherwise(content)
    return passages.withColumn(into, text).where(F.trim(F.coalesce(F.col(into), F.lit(""))) != "")


# ---- stamps


def source_stamp(settings: Mapping, sources: DataFrame) -> dict:
    """What an index is made from: its settings and a digest of its sources (path, size, modified, revision). Equal stamps, equal index.

    The sources are digested where they are: rows are hashed, and the hashes summed, so their order doesn't count and none comes to the driver.
    """
    row = F.xxhash64(*[F.col(c).cast("string") for c in sorted(sources.columns)]).cast("decimal(38,0)")
    n, total = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum(row), F.lit(0).cast("decimal(38,0)"))).first()
    return {"version": STAMP_VERSION, "settings": {k: settings[k] for k in sorted(settings) if settings[k] is not None}, "sources": {"rows": n, "digest": str(total)}}


def stamp_digest(stamp: Mapping) -> str:
    return hashlib.sha256(json.dumps(stamp, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def index_states(wanted: DataFrame, published: DataFrame, key: str = "scope") -> DataFrame:
    """(scope, state): current, stale, unavailable or not_indexed. wanted: scope, stamp; published: scope, stamp (null if it can't be read), rows_stored, rows_listed."""
    both = wanted.select(key, F.col("stamp").alias("wanted")).join(published.withColumn("there", F.lit(True)), key, "left")
    whole = F.col("stamp").isNotNull() & F.col("rows_stored").eqNullSafe(F.col("rows_listed"))
    state = F.when(F.col("there").isNull(), "not_indexed").when(~whole, "unavailable").when(F.col("stamp") == F.col("wanted"), "current").otherwise("stale")
    return both.select(key, state.alias("state"))


def published_passages(passages: DataFrame, sources: DataFrame, document, limit: int = 50, offset: int = 0, include_content: bool = False, id_col: str = "doc_id") -> DataFrame:
    """A page of one source's passages in order: ordinal, location, and offsets only where the source still has the text there.

    passages: doc_id, n, location, start_offset, end_offset, content; sources: doc_id, text.
    """
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("a page has 1 to 100 passages")
    mine = passages.where(F.col(id_col) == document).orderBy("n").offset(offset).limit(limit)
    rows = mine.join(sources.where(F.col(id_col) == document).select(id_col, "text"), id_col)
    start, end = F.col("start_offset").cast("int"), F.col("end_offset").cast("int")
    exact = (end <= F.length("text")) & (F.translate(F.substring(F.col("text"), start + 1, end - start), "\f", " ") == F.col("content"))
    shown = [F.col("n").alias("ordinal"), "location", F.when(exact, F.col("start_offset")).alias("start_offset"), F.when(exact, F.col("end_offset")).alias("end_offset")]
    return rows.select(*shown, *(["content"] if include_content else []))


def provenance(settings: Mapping) -> dict:
    """What a run was made with: engine versions and a digest of its settings."""
    versions = {name: metadata.version(name) for name in ("pyspark", "pyarrow", "pandas", "numpy")}
    return {"python": platform.python_version(), "packages": versions, "settings": stamp_digest(dict(settings))}


# ---- models


def embedded(texts: Column, embedder) -> Column:
    """Vectors from an embedder with a batch method `embed_batch`, else by calling it with a list, else item by item. It is set up once a worker."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        many = getattr(embedder, "embed_batch", None)
        for batch in batches:
            items = batch.fillna("").tolist()
            if many is not None:
                made = many(items)
            else:
                try:
                    made = embedder(items)
                except TypeError:
                    made = [embedder(item) for item in items]
            if len(made) != len(items):
                raise ValueError("an embedder gives one vector for each text")
            yield pd.Series([[float(x) for x in v] for v in made])

    return run(texts)


def checked_scores(results: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, place, score) from a hosted reranker's (query_id, place, score), as given if each place of each query's candidates is there once.

    candidates: query_id, n (their number; places count from 0). Raises, when rows are read, for a place out of range, repeated or
    missing, and for a score that isn't finite.
    """
    s = F.col("score")
    bad_score = s.isNull() | F.isnan(s) | (F.abs(s) == F.lit(float("inf")))
    counts = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("given"), F.count_distinct("place").alias("places"), F.min("place").alias("low"), F.max("place").alias("high"), F.count_if(bad_score).alias("bad"))
    judged = candidates.select("query_id", "n").join(counts, "query_id", "left")
    fault = (
        F.when(F.coalesce(F.col("bad"), F.lit(0)) > 0, "an invalid score")
        .when((F.col("low") < 0) | (F.col("high") >= F.col("n")), "a place out of range")
        .when(F.col("given") > F.col("places"), "a place twice")
        .when((F.col("n") > 0) & (F.coalesce(F.col("places"), F.lit(0)) < F.col("n")), "not every place")
    )
    told = judged.select("query_id", F.when(fault.isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("the reranker gave "), fault)).cast("boolean")).alias("fine"))
    return results.join(told, "query_id").where("fine").select("query_id", "place", "score")


def rerank_or_keep(candidates: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series], top: int, query_col: str = "query", text_col: str = "content") -> DataFrame:
    """Rerank as `fusion.rerank` does; a query for which the scorer fails or gives no finite score keeps its shortlist order, as does one of fewer than two candidates. Adds `reranked`."""
    from pyspark.sql import Window

    @F.pandas_udf("double")
    def safe(queries: pd.Series, texts: pd.Series) -> pd.Series:
        try:
            made = pd.Series(scorer(queries, texts), dtype="float64")
            return made if len(made) == len(queries) else pd.Series([float("nan")] * len(queries))
        except Exception:  # the scorer is the caller's: its failure costs the reranking, not the search
            return pd.Series([float("nan")] * len(queries))

    scored = candidates.withColumn("rerank_score", safe(F.col(query_col), F.col(text_col)))
    mine = Window.partitionBy("query_id")
    s = F.col("rerank_score")
    usable = F.bool_and(~(s.isNull() | F.isnan(s) | (F.abs(s) == F.lit(float("inf"))))).over(mine) & (F.count(F.lit(1)).over(mine) > 1)
    scored = scored.withColumn("reranked", usable)
    order = mine.orderBy(F.when(F.col("reranked"), F.round(s, 6)).desc_nulls_last(), "shortlist_rank")
    return scored.withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= top)


# ---- what is shown


def shown(hits: DataFrame, include_content: bool = False) -> DataFrame:
    """What a client may see of hits: where they are, and the text and score only if asked for."""
    names = ("query_id", "rank", "source_id", "name", "source_type", "start_offset", "end_offset")
    return hits.select(*names, F.col("start_offset").isNotNull().alias("location_verified"), *(["content", "score"] if include_content else []))


def evidence(name: Column, location: Column, content: Column) -> Column:
    """A passage as a model is given it: its source's name, then its pages or lines, then the text; pages are set apart by form feeds."""
    file, text = F.element_at(F.split(F.coalesce(name, F.lit("")), "/"), -1), F.trim(F.coalesce(content, F.lit("")))
    place = F.coalesce(location, F.lit(""))
    pages = r"^p\.([1-9]\d*)(?:-([1-9]\d*))?$"
    first = F.regexp_extract(place, pages, 1).try_cast("int")
    last = F.coalesce(F.regexp_extract(place, pages, 2).try_cast("int"), first)
    parts = F.split(text, "\f")
    by_page = F.array_join(F.transform(parts, lambda t, i: F.concat(F.lit("[PDF page "), (first + i).cast("string"), F.lit("]\n"), t)), "\n")
    ranged = F.concat(F.lit("PDF page range: "), first.cast("string"), F.lit("-"), last.cast("string"), F.lit(". Exact page within range: unavailable.\n"), text)
    paged = F.concat(F.lit("Printed page number: unavailable.\n"), F.when(F.size(parts) == last - first + 1, by_page).otherwise(ranged))
    lines = F.concat(F.when(place.rlike(r"^L[1-9]\d*(?:-L?[1-9]\d*)?$"), F.concat(F.lit("Source lines: "), place)).otherwise(F.lit("Source location: unavailable")), F.lit("\n"), text)
    located = F.when(F.lower(file).endswith(".pdf") & first.isNotNull() & (last >= first), paged).otherwise(lines)
    return F.when(file != "", F.concat(F.lit("Source document: "), file, F.lit("\n"), located)).otherwise(located)
