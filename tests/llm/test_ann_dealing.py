"""The search is dealt to as many tasks as the cores need, with the same neighbours."""

import numpy as np

from lapwise.llm import ann


def test_search_is_dealt_to_all_cores(spark, tmp_path, monkeypatch):
    """600 queries: one block, but a job a shard, each in a task of its own; the neighbours are those of a plain search."""
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(600, 8))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    held, original = [], ann.written

    def seen(df, name, **options):
        if name == "ann-hits":
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            held.append(max(int(x.split(",")[0]) for x in plan.split("Repartition ")[1:]))
        return original(df, name, **options)

    monkeypatch.setattr(ann, "written", seen)
    found = ann.nearest(table, k=5, query_divisor=1).collect()
    assert held and held[0] >= spark.sparkContext.defaultParallelism
    scores = vectors @ vectors.T
    np.fill_diagonal(scores, -np.inf)
    want = {(q, r + 1): int(i) for q in range(600) for r, i in enumerate(np.argsort(-scores[q], kind="stable")[:5])}
    right = sum(want[r["query_id"], r["rank"]] == r["vec_id"] for r in found)
    assert len(found) == 3000 and right >= 2970


def test_dealing():
    """Few queries, the table of 6 GB, and one so large that nothing is made smaller."""
    assert ann.dealing(6_000, 12, 12) == (3, 12)
    assert ann.dealing(36_000, 12, 12) == (18, 3)
    assert ann.dealing(500_000, 100, 12) == (25, 7)
    assert ann.dealing(0, 0, 12) == (1, 1)
