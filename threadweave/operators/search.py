"""Search and scope over questions: filters, pages, detail lookups, and ego graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadweave.functions.scalars import present
from threadweave.operators.tables import first_by

# Caps of an ego graph.
ANSWER_CAP, TAG_CAP, RELATED_CAP = 10, 10, 8
AUTHOR_CAP, TAGGED_CAP, EXPANDED_CAP = 5, 15, 5


def carries_tag(tags: Column, wanted: list[str]) -> Column:
    """Whether the text of tags holds one of these, in any case."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(tags), F.lit(w.lower())) for w in wanted], F.lit(False))


def contains_all(text: Column, query: str) -> Column:
    """Whether a text holds every word of the query, in any case; a query without words matches nothing."""
    found = [F.contains(F.lower(text), F.lit(w)) for w in query.lower().split()]
    return reduce(lambda a, b: a & b, found, F.lit(True)) if found else F.lit(False)


def valid_questions(questions: DataFrame, accepted: str, *texts: str) -> DataFrame:
    """Questions with an accepted answer (neither null nor 0) whose texts are all there."""
    return questions.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in texts], present(accepted)))


def negative_unaccepted(score: Column, accepted: Column) -> Column:
    """Answers that readers voted down and the asker didn't accept; without a score nobody did."""
    return ~F.coalesce(accepted, F.lit(False)) & F.coalesce(score < 0, F.lit(False))


def scope(questions: DataFrame, where: Column, answered: DataFrame | None, order: list[Column | str], limit: int) -> DataFrame:
    """The first `limit` questions in order that a predicate and, if given, an accepted answer (qid) let through."""
    rows = questions.where(where)
    if answered is not None:
        rows = rows.join(answered.select("qid"), "qid", "left_semi")
    return rows.orderBy(*order).limit(limit)


def links_in_scope(links: DataFrame, questions: DataFrame) -> DataFrame:
    """Distinct links (a, b, kind) both ends of which are among the questions (qid)."""
    ids = questions.select("qid").distinct()
    rows = links.join(ids.withColumnRenamed("qid", "a"), "a", "left_semi").join(ids.withColumnRenamed("qid", "b"), "b", "left_semi")
    return rows.select("a", "b", "kind").distinct()


def page(df: DataFrame, order: list[Column | str], skip: int, size: int) -> DataFrame:
    """A page of rows in a total order, to be enriched by joins afterwards."""
    return df.orderBy(*order).offset(skip).limit(size)


def history_page(history: DataFrame, void: DataFrame, at: str, start: str, end: str, skip: int, size: int) -> DataFrame:
    """Records within a time range, newest first, without those declared void (key `id`)."""
    rows = history.join(void.select("id").distinct(), "id", "left_anti").where(F.col(at).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    return page(rows, [F.desc(at), F.desc("id")], skip, size)


def without_leakage(items: DataFrame, excluded: DataFrame, key: str, id_col: str) -> DataFrame:
    """items, failing as soon as one of them is among the excluded (key, id)."""
    bad = excluded.select(F.col(key), F.col("id").alias(id_col)).distinct().withColumn("__leaked", F.lit(True))
    joined = items.join(bad, [key, id_col], "left")
    return joined.where(F.when(F.col("__leaked"), F.raise_error(F.concat(F.lit("leaked: "), F.col(id_col).cast("string"))).cast("boolean")).otherwise(True)).drop("__leaked")


def accepted_lookup(wanted: DataFrame, answers: DataFrame) -> DataFrame:
    """qid, aid of the accepted answer, its score, number of answers, for each question asked for; nulls where there is none."""
    of = answers.join(wanted.select("qid").distinct(), "qid", "left_semi").groupBy("qid").agg(F.max(F.when(F.col("accepted"), F.struct("aid", "score"))).alias("best"), F.count("*").alias("n_answers"))
    return wanted.join(of, "qid", "left").select("qid", F.col("best.aid").alias("aid"), F.col("best.score").alias("score"), F.coalesce("n_answers", F.lit(0)).alias("n_answers"))


def ordered_answers(wanted: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers of the questions asked for with their place: accepted first, then by score, then by id."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("accepted"), F.desc("score"), "aid"))
    return answers.join(wanted.select("qid").distinct(), "qid", "left_semi").withColumn("place", place)


def ego_graph(centres: DataFrame, answers: DataFrame, tagged: DataFrame, related: DataFrame) -> DataFrame:
    """centre, src, dst, edge_type, weight: the graph around each centre, all centres at once.

    First step: the best ANSWER_CAP answers, TAG_CAP tags, RELATED_CAP related questions a type. Second: of the RELATED_CAP
    best related ones, the accepted answer and one tag. answers: qid, aid, score, accepted, weight. tagged: qid, tag.
    related: src, dst, edge_type, weight, each edge once, found from both ends."""
    ids = centres.select(F.col("qid").alias("centre")).distinct()
    mine = ids.select("centre", F.col("centre").alias("qid"))
    edge = lambda df, dst, kind, weight: df.select("centre", F.col("qid").alias("src"), F.col(dst).alias("dst"), kind.alias("edge_type"), weight.cast("double").alias("weight"))
    kind = F.when(F.col("accepted"), "HAS_ACCEPTED_ANSWER").otherwise("HAS_ANSWER")
    own = first_by(mine.join(answers, "qid"), ["centre"], [F.desc("accepted"), F.desc("score"), "aid"], ANSWER_CAP)
    tags = first_by(mine.join(tagged, "qid"), ["centre"], ["tag"], TAG_CAP)
    both = related.select("src", "dst", "edge_type", "weight").union(related.select("dst", "src", "edge_type", "weight"))
    near = mine.join(both.select(F.col("src").alias("qid"), "dst", "edge_type", "weight"), "qid")
    near = first_by(near, ["centre", "edge_type"], [F.desc("weight"), "dst"], RELATED_CAP)
    deep = first_by(near.select("centre", F.col("dst").alias("qid"), "weight").groupBy("centre", "qid").agg(F.max("weight").alias("weight")), ["centre"], [F.desc("weight"), "qid"], RELATED_CAP).select("centre", "qid")
    far = deep.join(answers.where("accepted"), "qid")
    far_tags = deep.join(tagged.groupBy("qid").agg(F.min("tag").alias("tag")), "qid")
    one, none = F.lit(1.0), F.lit(None)
    parts = [
        edge(own, "aid", kind, F.when(F.col("accepted"), 1.0).otherwise(F.col("weight"))), edge(tags, "tag", F.lit("TAGGED_WITH"), none), edge(near, "dst", F.col("edge_type"), F.col("weight")),
        edge(far, "aid", F.lit("HAS_ACCEPTED_ANSWER"), one), edge(far_tags, "tag", F.lit("TAGGED_WITH"), none),
    ]
    return reduce(lambda a, b: a.union(b), parts).distinct()


def answer_ego_graph(centres: DataFrame, answers: DataFrame, authors: DataFrame, tagged: DataFrame, related: DataFrame) -> DataFrame:
    """centre, src, dst, edge_type, weight: of each answer its question, its authors (AUTHOR_CAP at most, by id) and the question's own graph.

    centres: aid. answers: aid, qid, accepted, weight, score. authors: aid, author, weight. tagged, related: as of ego_graph."""
    mine = centres.select("aid").distinct().join(answers.select("aid", "qid", "accepted"), "aid")
    kind = F.when(F.col("accepted"), "HAS_ACCEPTED_ANSWER").otherwise("HAS_ANSWER")
    owner = mine.select(F.col("aid").alias("centre"), F.col("qid").alias("src"), F.col("aid").alias("dst"), kind.alias("edge_type"), F.when(F.col("accepted"), 1.0).alias("weight"))
    by = first_by(mine.select("aid").join(authors.select("aid", "author", "weight"), "aid"), ["aid"], ["author"], AUTHOR_CAP)
    by = by.select(F.col("aid").alias("centre"), F.col("aid").alias("src"), F.col("author").alias("dst"), F.lit("AUTHOR_TRUST").alias("edge_type"), "weight")
    around = ego_graph(mine.select("qid").distinct(), answers, tagged, related)
    around = mine.select("aid", F.col("qid").alias("centre")).join(around, "centre").select(F.col("aid").alias("centre"), "src", "dst", "edge_type", "weight")
    # the answer's own edge stands once, without the weight of its thread
    around = around.join(owner.select("centre", "src", "dst", "edge_type"), ["centre", "src", "dst", "edge_type"], "left_anti")
    return owner.unionByName(by).unionByName(around).distinct()


def tag_ego_graph(centres: DataFrame, tagged: DataFrame, questions: DataFrame, answers: DataFrame) -> DataFrame:
    """centre, src, dst, edge_type, weight: of each tag its best questions by score (TAGGED_CAP at most) and, of the first EXPANDED_CAP, the
    accepted answer. centres: tag. tagged: qid, tag. questions: qid, score. answers: aid, qid, accepted."""
    rows = centres.select("tag").distinct().join(tagged.select("qid", "tag").distinct(), "tag").join(questions.select("qid", "score"), "qid")
    place = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("score"), "qid"))
    best = rows.withColumn("place", place).where(F.col("place") <= TAGGED_CAP)
    edges = best.select(F.col("tag").alias("centre"), F.col("qid").alias("src"), F.col("tag").alias("dst"), F.lit("TAGGED_WITH").alias("edge_type"), F.lit(None).cast("double").alias("weight"))
    far = best.where(F.col("place") <= EXPANDED_CAP).join(answers.where("accepted").select("qid", "aid"), "qid")
    return edges.unionByName(far.select(F.col("tag").alias("centre"), F.col("qid").alias("src"), F.col("aid").alias("dst"), F.lit("HAS_ACCEPTED_ANSWER").alias("edge_type"), F.lit(1.0).alias("weight"))).distinct()
