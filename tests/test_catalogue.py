import math

import duckdb
import pytest

from threadweave.plans import catalogue, diagnosis, judged, panels, reports, screening, tokens, vectors  # noqa: F401
from tests.conftest import SF_MID, SF_SMALL

#: Queries that SQL can't express; other tests compare them with brute force.
UNLIKE_SQL = {"ivf_neighbours", "blinded_answers", "token_length_report", "documents_within_tokens", "document_chunks", "truncated_answers"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names, data):
    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 5)
        return int(v) if hasattr(v, "as_tuple") and v == int(v) else float(v) if hasattr(v, "as_tuple") else v

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF_SMALL)
    if name not in catalogue.ORACLE:
        assert name in UNLIKE_SQL and got.count() > 0
        return
    want = duck.sql(catalogue.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_weights_of_answers_graphs_to_the_last_digit(spark):
    """Prices that are halves of a millionth of the trust's scale, rounded both ways."""
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_MID}/{t}.parquet'")
    want = con.sql(catalogue.ORACLE["answer_ego_graphs"])
    got = catalogue.QUERIES["answer_ego_graphs"](spark, SF_MID).select(want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
