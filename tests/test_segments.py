"""Segments: postings made and searched where the documents are."""

from pyspark.sql import functions as F

from quarry.operators import dense, lexical, positional


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_and_searches_move_no_posting(spark):
    docs = spark.range(400, numPartitions=8).select(F.col("id").alias("doc_id"), F.concat(F.lit("common w"), F.col("id") % 50, F.lit(" Common")).alias("text"))
    found = lexical.postings(docs, positions=True)
    assert "Exchange" not in plan(found)
    assert {(r["term"], r["tf"], r["dl"], tuple(r["positions"])) for r in found.where("doc_id = 7").collect()} == {("common", 2, 3, (0, 2)), ("w7", 1, 3, (1,))}
    index = lexical.build_index(docs)
    best = lexical.bm25_scores(index, asked(spark, "common w3", "common"), best=3)
    assert "Exchange" not in plan(best) and best.count() <= 3 * 2 * index.segments(spark).count() < 800
    assert lexical.bm25_scores(index, asked(spark, "common")).count() == 400
    blocks = positional.build(docs)
    assert "Exchange" not in plan(positional.phrase_hits(blocks, asked(spark, "common w3")))


def test_rows_of_one_id_count_as_one_document(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a"), (2, "b")], "doc_id long, text string")
    assert {tuple(r) for r in lexical.postings(docs).collect()} == {(1, "a", 2, 2), (1, "b", 1, 2), (2, "b", 1, 1)}
    assert lexical.build_index(docs).n == 2


def test_fields_of_one_build_are_summed_in_their_segments(spark):
    docs = spark.createDataFrame([(i, f"def parseHttp{i % 5} snake_case_{i % 7} plain {'x ' * (i % 9)}") for i in range(90)] + [(900, None), (901, "")], "doc_id long, text string")
    queries = asked(spark, "parse http3", "snake case", "snake_case_4", "plain x", "none")
    together, apart = lexical.build_fields(docs), (lexical.build_index(docs), lexical.build_index(lexical.with_symbols(docs)))
    rows = lambda pair: sorted((r["query_id"], r["doc_id"], round(r["score"], 6), r["rank"]) for r in lexical.fields_search(pair, queries, 4).collect())
    assert rows(together) == rows(apart) and len(rows(together)) == 16
    assert plan(lexical.fields_search(together, queries, 4)).count("MapInArrow") <= 2


def test_dense_blocks_are_small(spark):
    assert dense._BLOCK * 8 <= 4 << 20


def test_each_segment_is_a_row_group(spark):
    import glob

    import pyarrow.parquet as pq

    docs = spark.range(30, numPartitions=1).select(F.col("id").alias("doc_id"), F.concat(F.lit("common w"), F.col("id")).alias("text"))
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        made = lexical.build_index(docs), lexical.build_fields(docs)[0], positional.build(docs)
        found = [[pq.ParquetFile(f).metadata for f in glob.glob(f"{i.path.removeprefix('file://')}/*.parquet")] for i in made]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    for files in found:
        assert sum(m.num_rows for m in files) >= 6 and all(m.num_row_groups == m.num_rows for m in files)
