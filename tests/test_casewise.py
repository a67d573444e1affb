"""Cases done one by one give what the joins give, without a shuffle of pairs of case and item."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import adapter, candidates, split
from cadenza.plans import more_queries, queries, views
from cadenza.plans.queries import QUERIES, SEED, Whole


class Joined(Whole):
    """The same by joins, as with a catalog too large for a task."""

    items = 0


def close(a, b, keys):
    a, b = ({tuple(r[k] for k in keys): [x for c, x in sorted(r.asDict().items()) if c not in keys] for r in df.collect()} for df in (a, b))
    assert a and a.keys() == b.keys()
    for k, x in a.items():
        assert np.allclose(x, b[k], atol=2e-6), k


@pytest.fixture(scope="module")
def both(spark, sf_dir):
    one, other = Whole(spark, sf_dir), Joined(spark, sf_dir)
    assert one.known and other.known is None
    return one, other


@pytest.mark.parametrize("name", ["kar_scores", "adapter_features", "lemon_svd_scores"])
def test_queries_without_sql(both, name):
    a, b = (getattr(queries, name)(m).drop(*adapter.KAR_PRODUCTS) for m in both)  # coordinates are free up to a rotation
    close(a, b, ["case_idx", "song_id"])


def test_moments(both):
    a, b = (queries.adapter_feature_stats(m).where(~F.col("feature").startswith("kar_product")) for m in both)
    close(a, b, ["feature"])


def test_recall_grid_by_joins(both):
    m, other = both
    grid = candidates.recall_grid(other.split, other.cf, other.artist, other.base, other.pop, other.unseen)
    close(queries.stage1_recall_grid(m), grid, ["method", "pool"])


def test_scalar_moments(both):
    close(*(more_queries.adapter_scalar_stats(m) for m in both), ["feature"])


def test_drawn_pairs(both):
    """The draws are those of adapter.pairs(), out of the same features."""
    m, _ = both
    rows = queries._cut(queries._features(m))
    a = {(r.case_idx, r.p, r.j): (*r.pos, *r.neg) for r in queries._drawn(m, queries._parted(m)).collect()}
    b = {(r.case_idx, r.p, r.j): (*r.pos, *r.neg) for r in adapter.pairs(rows, SEED).collect()}
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-6) for k in a)


def test_networks_of_tasks_are_those_of_the_driver(spark):
    rng = np.random.default_rng(2)
    rows = [(c, f"s{c % 7}", j, *(rng.random(44).tolist() for _ in "ab")) for c in range(30) for j in (1, 2, 3)]
    drawn = spark.createDataFrame(rows, "case_idx int, p string, j int, pos array<float>, neg array<float>").repartition(5)
    moments = {n: (0.5, 0.3) for n in adapter.FEATURES}
    sets = {k: adapter.SETS[k] for k in ("Adapter CF only", "Adapter semantic only", "Adapter all")}
    nets = adapter.train_sets(drawn, moments, sets, 5)
    for k, names in sets.items():
        own = adapter.train(drawn, moments, names, 5)
        assert all(np.allclose(x, y, atol=1e-5) for a, b in zip(nets[k].layers, own.layers, strict=True) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", ["cf_scores_topk_whole", "content_route_texts", "direct_text_scores_whole", "rank_cf_only", "adapter_features"])
def test_no_shuffle_for_pairs_of_case_and_item(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange hashpartitioning(case_idx" not in plan


def test_cases_are_numbered_by_playlist_over_many_files(spark, sf_dir):
    m = Whole(spark, sf_dir)
    rows = m.cases.orderBy("playlist_id").collect()
    assert [r.case_idx for r in rows] == list(range(1, len(rows) + 1)) and m.n_cases == len(rows)


def test_partitions_follow_the_lines(spark, sf_dir, monkeypatch):
    lines = views.table(spark, sf_dir, "lineitem")
    assert views.tasks(lines) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(type(lines), "count", lambda self: 216_000_000)
    assert views.tasks(lines) == 432


def test_lists_without_holdout(spark):
    t = spark.createDataFrame([("p", i, i % 30) for i in range(60)], "playlist_id string, pos int, sid int")
    (r,) = split.lists(t, "sid").collect()
    assert r.songs == list(range(30)) and r.n_seen == 20
    assert split.lists(t, "sid", holdout_k=0).count() == 0 and split.lists(t, "sid", least=31).count() == 0
