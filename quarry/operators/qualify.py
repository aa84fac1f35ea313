"""A question set and its corpus, held against each other: which documents count, and which questions they can answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.metrics import fixed_sample
from quarry.storage import sent, settle


def _blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"^\s*$")


def _refuse(df: DataFrame, wrong: dict[str, Column]) -> None:
    """One pass that counts the rows of each fault; any is an error."""
    counts = df.agg(*(F.count_if(test).alias(name) for name, test in wrong.items())).first().asDict()
    if found := [f"{n} {name}" for name, n in counts.items() if n]:
        raise ValueError("; ".join(found))


def unambiguous(documents: DataFrame, drop: bool = True) -> DataFrame:
    """Documents (doc_id, text) whose id no other row has: an id of two documents proves nothing, so all its rows go, or are an error unless `drop`.

    A null or blank id, or a document that stays and has no text, is an error. Ids are counted before they are shuffled, and texts move only past the few repeated ids.
    """
    _refuse(documents, {"documents without an id": _blank(F.col("doc_id").cast("string"))})
    repeated = settle(documents.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not drop and not repeated.isEmpty():
        raise ValueError("repeated document ids")
    left = documents.join(sent(repeated), "doc_id", "left_anti")
    _refuse(left, {"documents without a text": _blank(F.col("text"))})
    return left


def qualified(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """Questions (question_id, gold: array of doc_id, ...) that have gold documents, all of them in the corpus; gold is given without repeats.

    documents: as `unambiguous` gives them. The distinct gold ids are held against the corpus, and only those that it lacks go on to the questions, so a document that is gold
    for a third of all questions is no hot key.
    """
    asked = questions.withColumn("gold", F.array_distinct(F.coalesce("gold", F.array().cast(questions.schema["gold"].dataType))))
    pairs = asked.select("question_id", F.explode("gold").alias("doc_id"))
    wanted = settle(pairs.select("doc_id").distinct())
    present = settle(documents.select("doc_id").join(sent(wanted), "doc_id", "left_semi"))
    lacking = settle(wanted.join(sent(present), "doc_id", "left_anti"))
    # a null among the gold ids is in no corpus
    failed = pairs.withColumn("doc_id", F.struct("doc_id")).join(sent(lacking.select(F.struct("doc_id").alias("doc_id"))), "doc_id", "left_semi").select("question_id").distinct()
    return asked.where(F.size("gold") > 0).join(sent(failed), "question_id", "left_anti")


def normalised(
    questions: DataFrame, documents: DataFrame, limit: int | None = None, others: int | None = None, keep_unlabelled: bool = False, drop_repeated: bool = True, may_be_none: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(questions, corpus) that fit each other.

    questions: question_id, question, answer, gold; ids are unique, and blank questions or answers are an error. documents: doc_id, text. limit: the first so many qualified questions by id (a trial run).
    others: beside the gold documents of those, so many others by the hash of their ids; None keeps the whole corpus. keep_unlabelled: questions without gold stay too, beyond the limit.
    Both tables get a column: questions `qualified`, the corpus `is_gold`. No question at all, or none qualified, is an error, unless it `may_be_none`.
    """
    if limit is not None and limit < 1:
        raise ValueError("the limit must be positive")
    questions = settle(questions)  # looked at several times, and its gold may be dear to find
    _refuse(questions, {"questions without an id": _blank(F.col("question_id").cast("string")), "blank questions": _blank(F.col("question")), "blank answers": _blank(F.col("answer"))})
    if not questions.groupBy("question_id").count().where("count > 1").isEmpty():
        raise ValueError("repeated question ids")
    corpus = unambiguous(documents, drop_repeated)
    chosen = qualified(questions, corpus)
    if limit is not None:
        chosen = chosen.orderBy("question_id").limit(limit)
    chosen = settle(chosen)
    if not may_be_none and chosen.isEmpty():
        raise ValueError("no question has all its gold documents in the corpus")
    gold = settle(chosen.select(F.explode("gold").alias("doc_id")).distinct())
    chosen = chosen.withColumn("qualified", F.lit(True))
    if keep_unlabelled:
        bare = questions.where(F.coalesce(F.size("gold"), F.lit(0)) <= 0).withColumn("gold", F.coalesce("gold", F.array().cast(questions.schema["gold"].dataType)))
        chosen = chosen.unionByName(bare.withColumn("qualified", F.lit(False)))
    marked = corpus.join(sent(gold.withColumn("is_gold", F.lit(True))), "doc_id", "left").withColumn("is_gold", F.coalesce("is_gold", F.lit(False)))
    if others is not None:
        named = marked.select("doc_id", "is_gold")
        kept = named.where("is_gold").unionByName(fixed_sample(named.where("not is_gold"), "doc_id", others)).select("doc_id")
        marked = marked.join(sent(kept), "doc_id", "left_semi")
    return chosen, marked
