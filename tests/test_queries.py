"""Every registered query against its SQL, at the smallest scale."""

import pytest

from marginalia.plans import queries as q

DATA = "/root/testdata"


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_matches_sql(spark, duck, same, name):
    same(q.QUERIES[name](spark, f"{DATA}/sf0.001"), duck("sf0.001"), q.SQL[name])


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.SQL)))
def test_runs(spark, name):
    assert q.QUERIES[name](spark, f"{DATA}/sf0.001").count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_overlap_pairs_returns_every_pair(spark):
    """Pairs and what they share, not only how many there are; the classes with their number of links say the same."""
    from itertools import combinations

    kinds = {}
    for r in q._kinds(spark, f"{DATA}/sf0.001").collect():
        kinds.setdefault(r[0], set()).add(r[1])
    shared = {(a, b): len(kinds[a] & kinds[b]) for a, b in combinations(sorted(kinds), 2)}
    want = {(*p, k) for p, k in shared.items() if k / min(len(kinds[p[0]]), len(kinds[p[1]])) >= 0.6}
    got = q.overlap_pairs(spark, f"{DATA}/sf0.001").collect()
    assert {(r.a, r.b, r.shared) for r in got} == want and len(got) == len(want)
    links = q.overlap_classes(spark, f"{DATA}/sf0.001").agg({"n_links": "sum"}).first()[0]
    assert links == 2 * len(want) > 0
