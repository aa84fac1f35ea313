"""Queries over texts, passages, sources and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chunks, facets, fusion, index, lexical, positions, windows
from quarry.plans.evaluation import arms
from quarry.plans.tables import PASSAGES, QUESTIONS, bm25_sql, documents, lexical_index, passages, questions, table, top_sql
from quarry.sources import readers
from quarry.storage import sent, settle

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _location(path: Column) -> Column:
    return positions.location(path, *map(F.col, ("first_line", "last_line", "first_page", "last_page")))


@query()
def c1_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of 700 characters with 100 in common."""
    return chunks.chunk_documents(documents(spark, d))


@query()
def c18_chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    made = chunks.chunk_documents(documents(spark, d)).join(documents(spark, d).select("doc_id", "source"), "doc_id")
    return made.rollup("source").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("content")).alias("characters"))


@query("SELECT coalesce(source, 'all') AS collection, count(*) AS documents, sum(length(text))::BIGINT AS characters, sum(length(text) // 4 + 1)::BIGINT AS tokens FROM documents GROUP BY ROLLUP (source)")
def c18_counts(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    return documents(spark, d).rollup("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(n).alias("characters"), F.sum(T.estimated_tokens(n)).alias("tokens")).withColumn("collection", F.coalesce("source", F.lit("all"))).drop("source")


_CODE = r"'// x' || chr(10) || 'pub fn ' || replace(event_type, '-', '_') || '_' || user_id || '() {}'"


@query(rf"SELECT event_id, regexp_extract({_CODE}, '(?m)^\s*(?:pub\s+|pub\(crate\)\s+|async\s+|export\s+|static\s+)*(?:def|fn|class|function|struct|impl|interface|type)\s+([A-Za-z_][A-Za-z0-9_]*)', 1) AS symbol FROM events")
def c5_code_symbol(spark: SparkSession, d: str) -> DataFrame:
    code = F.concat(F.lit("// x\npub fn "), F.replace(F.col("event_type"), F.lit("-"), F.lit("_")), F.lit("_"), F.col("user_id").cast("string"), F.lit("() {}"))
    return table(spark, d, "events").select("event_id", T.first_code_symbol(code).alias("symbol"))


@query(f"""WITH {PASSAGES}, t AS (SELECT p.*, text FROM passages p JOIN documents USING (doc_id)),
    l AS (SELECT doc_id, n, length(text[1:start_offset]) - length(replace(text[1:start_offset], chr(10), '')) + 1 AS first, length(text[1:end_offset]) - length(replace(text[1:end_offset], chr(10), '')) + 1 AS last FROM t)
    SELECT doc_id, n, CASE WHEN first = last THEN 'L' || first ELSE 'L' || first || '-L' || last END AS location FROM l""")
def c8_lines(spark: SparkSession, d: str) -> DataFrame:
    found = positions.placed(passages(spark, d), documents(spark, d))
    return found.select("doc_id", "n", _location(F.lit("a.txt")).alias("location"))


_PAGED = "doc_id, CASE doc_id % 3 WHEN 0 THEN 'a.pdf' WHEN 1 THEN 'b.IPYNB' ELSE 'c.txt' END AS path, replace(text, ' a ', chr(12) || 'a ') AS text"


@query(f"""WITH docs AS (SELECT {_PAGED} FROM documents), {PASSAGES.replace("FROM documents", "FROM docs")}, t AS (SELECT p.*, path, length(text[1:start_offset]) - length(replace(text[1:start_offset], chr(12), '')) + 1 AS first, length(content) - length(replace(content, chr(12), '')) AS more FROM passages p JOIN docs USING (doc_id) WHERE doc_id % 3 <> 2)
    SELECT doc_id, n, CASE doc_id % 3 WHEN 0 THEN 'p.' ELSE 'cell ' END || first || CASE WHEN more = 0 THEN '' ELSE '-' || (first + more) END AS location FROM t""")
def c8_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages and cells of lines, in texts with form feeds."""
    n = F.col("doc_id") % 3
    docs = documents(spark, d).select("doc_id", F.when(n == 0, "a.pdf").when(n == 1, "b.IPYNB").otherwise("c.txt").alias("path"), F.replace("text", F.lit(" a "), F.lit("\fa ")).alias("text")).where("doc_id % 3 <> 2")
    found = positions.placed(positions.lines(docs), docs).join(docs.select("doc_id", "path"), "doc_id")
    return found.select("doc_id", "n", _location(F.col("path")).alias("location"))


_PATH = "CASE WHEN doc_id % 7 = 0 THEN source || '/' || lpad(doc_id::VARCHAR, 16, 'a') || '.txt' ELSE source || '/' || lang || '_report-' || doc_id || '.v1.txt' END"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    hashed = F.concat("source", F.lit("/"), F.lpad(n, 16, "a"), F.lit(".txt"))
    return documents(spark, d).withColumn("path", F.when(F.col("doc_id") % 7 == 0, hashed).otherwise(F.concat("source", F.lit("/"), "lang", F.lit("_report-"), n, F.lit(".v1.txt"))))


_TITLE = r"CASE WHEN regexp_full_match(replace(words, ' ', ''), '[0-9a-fA-F]{16,}') THEN '' ELSE words END"
_TITLES = rf"t AS (SELECT doc_id, text, trim(regexp_replace(regexp_replace(string_split({_PATH}, '/')[-1], '\.[^.]*$', ''), '[_\-\s]+', ' ', 'g')) AS words FROM documents)"


@query(f"WITH {_TITLES} SELECT doc_id, {_TITLE} AS title FROM t")
def c9_titles(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("doc_id", T.source_title(F.col("path")).alias("title"))


@query(f"WITH {_TITLES} SELECT doc_id, CASE WHEN ({_TITLE}) <> '' THEN ({_TITLE}) || chr(10) || chr(10) || text ELSE text END AS content FROM t")
def c10_titled(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("doc_id", T.titled(T.source_title(F.col("path")), F.col("text")).alias("content"))


@query(f"""WITH {PASSAGES}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS i FROM passages), long AS (SELECT doc_id, length(text) > 12000 AS long, text FROM documents),
    c AS (SELECT a.doc_id, a.n, string_agg(b.content, chr(10) || chr(10) ORDER BY b.i) AS context FROM o a JOIN o b ON a.doc_id = b.doc_id AND (b.i < 2 OR (b.i >= a.i - 2 AND b.i < a.i)) WHERE trim(b.content) <> '' GROUP BY a.doc_id, a.n)
    SELECT o.doc_id, o.n, CASE WHEN long THEN coalesce(context, '') ELSE text END AS context FROM o JOIN long USING (doc_id) LEFT JOIN c USING (doc_id, n)""")
def c12_context(spark: SparkSession, d: str) -> DataFrame:
    """A short source whole; a long one's first two passages and the two before each, none twice."""
    return windows.source_context(passages(spark, d), documents(spark, d))


@query(f"""WITH {PASSAGES} SELECT doc_id, n, end_offset + length(regexp_replace(text[1:end_offset], '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS end_utf16 FROM passages JOIN documents USING (doc_id)""")
def c15_utf16(spark: SparkSession, d: str) -> DataFrame:
    return positions.placed(passages(spark, d), documents(spark, d)).select("doc_id", "n", "end_utf16")


@query(f"WITH {PASSAGES} SELECT doc_id, n, length(content) AS characters FROM passages ORDER BY doc_id, n LIMIT 20 OFFSET 40")
def c16_preview(spark: SparkSession, d: str) -> DataFrame:
    return passages(spark, d).orderBy("doc_id", "n").offset(40).limit(20).select("doc_id", "n", F.length("content").alias("characters"))


@query()
def r4_html(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", readers.html_column(F.col("html")).alias("text"))


@query("""SELECT event_id, 'k: ' || (props::JSON->>'k') || chr(10) || 'user.id: ' || user_id || chr(10) || 'user.tags.[0].n: ' || event_id || chr(10) || 'x' AS text FROM events WHERE props IS NOT NULL AND user_id IS NOT NULL""")
def r5_json_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Nested objects and arrays, flattened to lines."""
    nested = F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "user": {"id": '), F.col("user_id").cast("string"), F.lit(', "tags": [{"n": '), F.col("event_id").cast("string"), F.lit('}, "x"]}}'))
    return table(spark, d, "events").where("props is not null and user_id is not null").select("event_id", readers.json_column(nested).alias("text"))


@query(r"""WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '# GRADED CELL: exercise ' || user_id WHEN 1 THEN '### Exercise ' || user_id || ':' WHEN 2 THEN 'see exercise ' || user_id ELSE 'none' END AS c FROM events)
    SELECT event_id, coalesce(nullif(regexp_extract(c, '(?i)#\s*GRADED\s+CELL:\s*exercise\s+(\d+)', 1), ''), nullif(regexp_extract(c, '(?i)###\s*Exercise\s+(\d+)', 1), ''), nullif(regexp_extract(c, '(?i)Exercise\s+(\d+)', 1), ''), '-') AS exercise FROM t""")
def r8_exercise(spark: SparkSession, d: str) -> DataFrame:
    n, k = F.col("user_id").cast("string"), F.col("event_id") % 4
    cell = F.when(k == 0, F.concat(F.lit("# GRADED CELL: exercise "), n)).when(k == 1, F.concat(F.lit("### Exercise "), n, F.lit(":"))).when(k == 2, F.concat(F.lit("see exercise "), n)).otherwise("none")
    return table(spark, d, "events").select("event_id", F.coalesce(T.exercise_number(cell), F.lit("-")).alias("exercise"))


@query()
def r11_clean(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", readers.clean_column(F.col("text"), True).alias("text"))


@query("SELECT doc_id, n_chars // 4 + 1 AS tokens FROM documents")
def s5_tokens(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", T.estimated_tokens(F.col("n_chars")).alias("tokens"))


@query(f"SELECT source, substr(sha256(string_agg(path, chr(10) ORDER BY path)), 1, 16) AS fingerprint FROM (SELECT source, {_PATH} AS path FROM documents) GROUP BY source")
def s11_scope_hash(spark: SparkSession, d: str) -> DataFrame:
    return index.scope_fingerprint(_paths(spark, d), ["source"])


@query(f"SELECT doc_id, substr(md5({_PATH} || chr(10) || 'none' || chr(10) || lang), 1, 8) AS key FROM documents")
def s12_index_key(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("doc_id", index.index_key(F.col("path"), F.lit("none"), F.col("lang")).alias("key"))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE source = 'src3' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def s13_workspace_scan(spark: SparkSession, d: str) -> DataFrame:
    subset = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return documents(spark, d).where("source = 'src3'").join(subset, "doc_id", "left_semi").select("doc_id", "lang", "n_chars")


@query("SELECT path, ext FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 'test_' ELSE '' END || event_type || CASE event_id % 4 WHEN 1 THEN '.pyc' ELSE '.py' END AS path, event_id AS ext FROM events) WHERE NOT (path LIKE 'test\\_%.py' ESCAPE '\\' OR path LIKE '%.pyc')")
def s7_noise(spark: SparkSession, d: str) -> DataFrame:
    from quarry.sources.scope import NOISE, matches

    name = F.concat(F.when(F.col("event_id") % 3 == 0, "test_").otherwise(""), "event_type", F.when(F.col("event_id") % 4 == 1, ".pyc").otherwise(".py"))
    return table(spark, d, "events").select(name.alias("path"), F.col("event_id").alias("ext")).where(~matches(F.col("path"), NOISE))


@query("SELECT conv_id, list(length(text) ORDER BY turn) AS sizes FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def s15_field(spark: SparkSession, d: str) -> DataFrame:
    """The field `turns[].said.size` of records made of conversations."""
    turn = F.struct("turn", F.struct(F.length("text").alias("size")).alias("said"))
    records = table(spark, d, "conversations").where("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return readers.select_field(records, "turns[].said.size", "sizes").select("conv_id", "sizes")


@query(f"""WITH {QUESTIONS}, g AS (SELECT query_id, doc_id FROM q JOIN documents ON contains(text, query) AND query <> ''),
    pool AS (SELECT doc_id, 1 AS is_gold FROM g UNION SELECT doc_id, 0 FROM (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM g) ORDER BY sha256(doc_id::VARCHAR) LIMIT 30))
    SELECT doc_id, is_gold FROM pool""")
def s17_qualify(spark: SparkSession, d: str) -> DataFrame:
    """Gold documents and the first 30 others in order of a hash."""
    from quarry.operators.metrics import fixed_sample
    from quarry.plans.tables import gold

    wanted = gold(spark, d).select("doc_id").distinct()
    others = fixed_sample(documents(spark, d).select("doc_id").join(wanted, "doc_id", "left_anti"), "doc_id", 30)
    return wanted.withColumn("is_gold", F.lit(1)).unionByName(others.withColumn("is_gold", F.lit(0)))


_NORMALISED = f"""{QUESTIONS}, d AS (SELECT doc_id, text FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '' AND doc_id % 9 <> 4),
    g AS (SELECT query_id, documents.doc_id FROM q JOIN documents ON contains(text, query) AND query <> ''),
    a AS (SELECT * FROM g UNION ALL SELECT query_id, -1 FROM q WHERE query_id % 7 = 3),
    ok AS (SELECT query_id, count(DISTINCT doc_id) AS n_gold FROM a WHERE query_id IN (SELECT query_id FROM q WHERE query <> '') GROUP BY query_id HAVING bool_and(doc_id IN (SELECT doc_id FROM d)))"""


def _normalised(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Benchmark items as questions, with every document that holds them as gold; a ninth of the documents stands twice, a seventh of the items has gold that isn't there."""
    from quarry.operators.qualify import normalised
    from quarry.plans.tables import gold

    asked = questions(spark, d).where("query != ''")
    stray = asked.where("query_id % 7 = 3").select("query_id", F.lit(-1).cast("long").alias("doc_id"))
    wanted = gold(spark, d).select("query_id", F.col("doc_id").cast("long").alias("doc_id")).unionByName(stray).groupBy("query_id").agg(F.collect_list("doc_id").alias("gold"))
    asked = asked.join(wanted, "query_id", "left").select(F.col("query_id").alias("question_id"), F.col("query").alias("question"), F.lit("-").alias("answer"), "gold")
    rows = documents(spark, d).select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(~F.coalesce("text", F.lit("")).rlike(r"^\s*$"))
    # the more documents hold a question, the likelier one of them stands twice: on large tables none may qualify, which is a result here
    return normalised(asked, rows.unionByName(rows.where("doc_id % 9 = 4")), may_be_none=True)


@query(f"WITH {_NORMALISED} SELECT query_id AS question_id, n_gold FROM ok")
def s17_questions(spark: SparkSession, d: str) -> DataFrame:
    return _normalised(spark, d)[0].select("question_id", F.size("gold").cast("long").alias("n_gold"))


@query(f"WITH {_NORMALISED} SELECT doc_id, doc_id IN (SELECT doc_id FROM a JOIN ok USING (query_id)) AS is_gold FROM d")
def s17_corpus(spark: SparkSession, d: str) -> DataFrame:
    return _normalised(spark, d)[1].select("doc_id", "is_gold")


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 25 OFFSET 50")
def s18_page(spark: SparkSession, d: str) -> DataFrame:
    from quarry.operators.stores import page

    return page(table(spark, d, "events"), [F.col("ts").desc(), F.col("event_id")], 25, 50).select("event_id")


@query(f"SELECT count(DISTINCT text) AS embedded, count(*) AS rows, sum(length(text))::BIGINT AS characters FROM documents")
def i5_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Distinct texts are embedded once and come back to every row that has them."""
    rows = documents(spark, d).select("doc_id", F.col("text").alias("content"))
    made = index.embed_once(rows, lambda t: t.withColumn("vector", F.array(F.length("text").cast("float"), F.lit(1.0).cast("float"))))
    return made.agg(F.count_distinct("content").alias("embedded"), F.count(F.lit(1)).alias("rows"), F.sum(made["vector"][0]).cast("long").alias("characters"))


_DELTA = """a AS (SELECT doc_id, n_chars FROM documents WHERE doc_id % 5 <> 0), b AS (SELECT doc_id, n_chars + (doc_id % 7 = 0)::INT AS n_chars FROM documents WHERE doc_id % 11 <> 0),
    delta AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' WHEN a.n_chars IS DISTINCT FROM b.n_chars THEN 'changed' END AS change FROM a FULL JOIN b ON a.doc_id = b.doc_id)"""


def _delta(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = documents(spark, d).select("doc_id", "n_chars")
    before = rows.where("doc_id % 5 <> 0")
    now = rows.where("doc_id % 11 <> 0").withColumn("n_chars", F.col("n_chars") + (F.col("doc_id") % 7 == 0).cast("long"))
    return before, now, index.source_delta(before, now, "doc_id", ["n_chars"])


@query(f"WITH {_DELTA} SELECT doc_id, change FROM delta WHERE change IS NOT NULL")
def i7_delta(spark: SparkSession, d: str) -> DataFrame:
    return _delta(spark, d)[2]


@query(f"WITH {_DELTA} SELECT doc_id, n_chars FROM b")
def i8_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Stored rows refreshed by a delta are the rows of now."""
    before, now, delta = _delta(spark, d)
    fresh = now.join(delta.where("change <> 'removed'").select("doc_id"), "doc_id", "left_semi")
    return index.refresh(before, delta, fresh, "doc_id")


@query()
def q17_facets(spark: SparkSession, d: str) -> DataFrame:
    return facets.decompose(questions(spark, d))


@query()
def q18_balanced_passages(spark: SparkSession, d: str) -> DataFrame:
    """Each question with its neighbour as facets, searched apart and merged in turns."""
    asked = questions(spark, d)
    two = asked.select("query_id", F.lit(0).alias("facet_no"), "query").unionByName(asked.select((F.col("query_id") - 1).alias("query_id"), F.lit(1).alias("facet_no"), "query"))
    keyed = two.withColumn("id", F.col("query_id") * 2 + F.col("facet_no"))
    hits = lexical.bm25(lexical_index(spark, d), keyed.select(F.col("id").alias("query_id"), "query"), 10)
    named = hits.withColumnRenamed("query_id", "id").join(sent(keyed.select("id", "query_id", "facet_no")), "id")
    return fusion.merge_facets(named.select("query_id", "facet_no", "rank", "doc_id"))


_HITS = f"""{PASSAGES}, {QUESTIONS}, {bm25_sql()}, top AS {top_sql("bm25", 5)},
    hits AS (SELECT query_id, doc_id, min(n) + 1 AS n, any_value(rank) AS rank FROM top JOIN passages USING (doc_id) GROUP BY query_id, doc_id)"""


def _hits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = passages(spark, d)
    top = arms(spark, d).where("arm = 'score' and rank <= 5").drop("arm")
    rows = settle(rows.join(sent(top.select("doc_id").distinct()), "doc_id", "left_semi"))  # passages of the documents found
    second = rows.groupBy("doc_id").agg((F.min("n") + 1).alias("n"))
    return top.join(second, "doc_id").select("query_id", "doc_id", "n", "rank"), rows


@query(f"""WITH {PASSAGES}, {QUESTIONS}, {bm25_sql()}, top AS {top_sql("bm25", 5)}, hits AS (SELECT query_id, doc_id, n, rank FROM top JOIN passages USING (doc_id)), w AS (SELECT *, min(start_offset) OVER x AS f, max(end_offset) OVER x AS t FROM passages WINDOW x AS (PARTITION BY doc_id ORDER BY start_offset ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
    SELECT h.query_id, h.doc_id, h.n, h.rank, CASE WHEN t - f <= 16000 THEN f ELSE start_offset END AS start_offset, CASE WHEN t - f <= 16000 THEN t ELSE end_offset END AS end_offset FROM hits h JOIN w USING (doc_id, n)""")
def q20_window(spark: SparkSession, d: str) -> DataFrame:
    """Every passage of the documents found, with its neighbours."""
    found, rows = _hits(spark, d)
    hits = found.drop("n").join(rows.select("doc_id", "n"), "doc_id")
    return windows.expand(hits, rows, documents(spark, d), radius=1).select("query_id", "doc_id", "n", "rank", "start_offset", "end_offset")


@query(f"""WITH {_HITS} SELECT h.query_id, h.doc_id, h.rank, CASE WHEN length(text) <= 2000 THEN 0 ELSE start_offset END AS start_offset, CASE WHEN length(text) <= 2000 THEN length(text) ELSE end_offset END AS end_offset, length(text) <= 2000 AS whole_document
    FROM hits h JOIN passages USING (doc_id, n) JOIN documents USING (doc_id)""")
def q20_whole_doc(spark: SparkSession, d: str) -> DataFrame:
    hits, rows = _hits(spark, d)
    hits = hits.join(rows.select("doc_id", "n"), ["doc_id", "n"], "left_semi")
    return windows.expand(hits, rows, documents(spark, d), radius=0, whole=2000).drop("n")


@query(f"WITH {PASSAGES} SELECT doc_id, n, text[start_offset + 1:end_offset] = content AND end_offset <= length(text) AS ok FROM passages JOIN documents USING (doc_id)")
def q22_verify(spark: SparkSession, d: str) -> DataFrame:
    return positions.placed(passages(spark, d), documents(spark, d)).select("doc_id", "n", "ok")


@query(f"""WITH {PASSAGES}, t AS (SELECT passages.*, text FROM passages JOIN documents USING (doc_id)),
    f AS (SELECT doc_id, n, content, text, CASE WHEN n % 4 = 0 THEN start_offset ELSE 0 END AS lower, n % 4 = 0 AS told FROM t),
    a AS (SELECT *, instr(text[lower + 1:], content) + lower AS one FROM f), b AS (SELECT *, CASE WHEN one > lower THEN instr(text[one + 1:], content) END AS again FROM a)
    SELECT doc_id, n, CASE WHEN one > lower AND (again = 0 OR (told AND contains(text[one:one + again - 1], chr(10)))) THEN one - 1 END AS start_offset FROM b""")
def q22_located(spark: SparkSession, d: str) -> DataFrame:
    """Every line looked for in its document by its words alone, one in four with its line known. One that stands there twice has no place."""
    known = F.when(F.col("n") % 4 == 0, F.col("n") + 1)
    none = F.lit(None).cast("long")
    rows = passages(spark, d).select("doc_id", "n", "content", none.alias("start_offset"), none.alias("end_offset"), known.alias("start_line"))
    return positions.relocated(rows, documents(spark, d)).select("doc_id", "n", "start_offset")


@query(f"""WITH {QUESTIONS}, {bm25_sql()}, top AS {top_sql("bm25", 3)}
    SELECT query_id, string_agg('[' || rank || '] ' || source || ' (L1)' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS answer FROM top JOIN documents USING (doc_id) GROUP BY query_id""")
def a1_passages(spark: SparkSession, d: str) -> DataFrame:
    top = sent(arms(spark, d).where("arm = 'score' and rank <= 3").drop("arm")).join(documents(spark, d).select("doc_id", F.col("source").alias("name"), F.col("text").alias("content")), "doc_id")
    return windows.rendered(top.withColumn("location", F.lit("L1")))
