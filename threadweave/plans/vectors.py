"""Registered queries of inverted-file search and near-duplicate classes, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadweave.operators import blocks as B
from threadweave.operators import retrieval as R
from threadweave.plans.catalogue import QUERIES, query, r6, vectors  # noqa: F401
from threadweave.sources.files import kept, shared_folder

K = 10


def index_of(spark, sf) -> B.Ivf:
    return B.build_ivf(vectors(spark, sf), f"{shared_folder(spark)}/ivf-{uuid.uuid4().hex}", k=K)


@query()
def ivf_neighbours(spark, sf) -> DataFrame:
    """The 10 nearest of every vector, through the lists of the index alone. A search by lists misses some, so there is no SQL."""
    return B.search_ivf(vectors(spark, sf), index_of(spark, sf), K).select("query", "id", r6(F.col("sim"), "sim"))


@query(f"SELECT count(*) AS n_queries, count(*) * least({K}, (SELECT count(*) FROM embeddings) - 1) AS n_true, true AS reached FROM embeddings WHERE vec_id % 50 = 0")
def ivf_recall(spark, sf) -> DataFrame:
    """Whether the index finds 90 % of the true neighbours of all vectors whose id is divisible by 50, among all rows."""
    v = vectors(spark, sf)
    asked = kept(v.where("id % 50 = 0"), "asked")
    out = B.recall_of(B.search_ivf(asked, index_of(spark, sf), K), R.nearest(asked, v, K))
    return out.select("n_queries", "n_true", (F.col("recall") >= 0.9).alias("reached"))


CP = "v AS (SELECT vec_id AS id, embedding AS v FROM embeddings UNION ALL SELECT vec_id + 1000000 * c, embedding FROM embeddings, range(1, 4) r(c) WHERE vec_id % 7 = 0), c AS (SELECT id, min(id) OVER (PARTITION BY v) AS class_id, v FROM v), l AS (SELECT x.class_id AS a, y.class_id AS b, list_cosine_similarity(x.v::DOUBLE[], y.v::DOUBLE[]) AS sim FROM c x JOIN c y ON x.id = x.class_id AND y.id = y.class_id AND x.id < y.id)"


def with_copies(spark, sf) -> DataFrame:
    """The vectors, every seventh four times."""
    v = vectors(spark, sf)
    copies = v.where("id % 7 = 0").select("id", "v", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("copy"))
    return v.union(copies.select(F.col("id") + 1_000_000 * F.col("copy"), "v"))


@query(f"WITH {CP}, n AS (SELECT class_id, count(*) AS n_links FROM (SELECT a AS class_id FROM l WHERE sim >= 0.3 UNION ALL SELECT b FROM l WHERE sim >= 0.3) GROUP BY 1) SELECT id, c.class_id, count(*) OVER (PARTITION BY c.class_id) AS n_equal, coalesce(n_links, 0) AS n_links FROM c LEFT JOIN n ON n.class_id = c.class_id")
def near_duplicate_classes(spark, sf) -> DataFrame:
    return B.near_duplicate_classes(with_copies(spark, sf), 0.3)


@query(f"WITH {CP} SELECT a, b, round(sim, 6) AS sim FROM l WHERE sim >= 0.35")
def near_duplicate_links(spark, sf) -> DataFrame:
    v = with_copies(spark, sf)
    return B.class_links(B.vector_classes(v), 0.35, block=128).select("a", "b", r6(F.col("sim"), "sim"))
