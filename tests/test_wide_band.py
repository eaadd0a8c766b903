"""The summary of a wide plate tolerance, against its pairs one by one."""

from collections import defaultdict

import pytest

from streetlink.operators.link import WINDOW, block_base, candidates, link_summary, parse_queries, scored

BASE = [
    (1, "CL 1 # 2 - 10"), (2, "CL 1 # 2 - 60 AP 5"), (2, "CL 1 # 2 - 12 AP 5"), (3, "CL 1 # 2 - 61"), (4, "CL 1 # AV 2 - 40"), (5, "CL 1 A # 2 - 10"), (6, "CL 1 # 2 - 10 B"), (7, "CL 1 # 2"), (8, "CL 1 # 2 AP 5"), (9, "CL 1 # - 7"),
    (None, "CL 1 # 2 - 20"), (None, "CL 1 # 2 - 20 AP 6"), (10, "CL 1 # 2 - 010 8C"), (11, "KR 1 # 2 - 10"), (12, "nada"), (13, "CL 1 # 2 - 110"), (14, "CL 1 BIS # 2 - 10"), (15, "CL 1 NORTE # KR 2 - 10 AP 5"),
]
ASKED = [
    (1, "calle 1 # 2 - 10"), (2, "CL 1 # 2 - 60 AP 5"), (2, "CL 1 # 2 - 60 AP 5"), (3, "CL 1 # 2 - 60"), (3, "CL 1 # 2 - 12 AP 5"), (4, "CL 1 # 2"), (5, "CL 1 # - 7"), (6, "CL 9 # 9 - 9"), (7, "nada; nada"), (7, "CL 1 # 2 - 10"), (8, ""), (None, "CL 1 # AV 2 - 41"),
    (9, "CL 1 A # 2 - 10"), (10, "CL 1 # 2 - 10 8C"), (11, "CL 1 # 2 - 11 B"), (12, "CL 1 # 2 - 10 AP 6"), (13, "CL 1 BIS # 2 - 11"),
]


def _sides(spark):
    q, b = spark.createDataFrame(ASKED, "id long, t string"), spark.createDataFrame([(*r, i) for i, r in enumerate(BASE)], "id long, t string, ordinal int")
    return parse_queries(q, "id", "t"), block_base(b, "id", "t", "ordinal")


@pytest.mark.parametrize("threshold, tolerance, cap", [(0.9, 50, None), (0.9, 50, 1), (0.8, 50, None), (0.0, 40, 2), (1.0, 99, None), (0.85, 1000, None)])
def test_summary_equals_pairs_one_by_one(spark, threshold, tolerance, cap):
    q, b = _sides(spark)
    assert 2 * tolerance + 1 > WINDOW
    pairs = scored(candidates(q, b, tolerance, cap, "left"), threshold, tolerance).select("query_id", "query.parse_ok", "query.notes", "record_id", "base", "score", "is_match", "truncated").collect()
    by = defaultdict(list)
    for r in pairs:
        by[r.query_id].append(r)
    want = {}
    for query_id, rows in by.items():
        hits = {}
        for r in rows:
            if r.is_match:
                hits[r.record_id] = max(hits.get(r.record_id, 0), r.score)
        best = max(hits.values(), default=None)
        first = [k for k, v in hits.items() if v == best]
        want[query_id] = (any(r.parse_ok for r in rows), sum(r.base is not None for r in rows), len(hits), min((k for k in first if k is not None), default=None), best, len(first) > 1, any(r.truncated or False for r in rows))
    got = link_summary(q, b, threshold, tolerance, cap).collect()
    assert len(got) == len(want) and any(w[2] for w in want.values())
    assert {r.query_id: (r.parse_ok, r.n_compared, r.n_candidates, r.best_id, r.best_score, r.ambiguous, r.truncated) for r in got} == want


def test_pairs_are_summed_up_before_they_are_sent(spark):
    plan = link_summary(*_sides(spark), tolerance=50)._jdf.queryExecution().executedPlan().toString().splitlines()
    sent = next(i for i, line in enumerate(plan) if "REPARTITION_BY_COL" in line)
    assert next(w for line in plan[sent:] for w in ("Join", "HashAggregate") if w in line) == "HashAggregate"
