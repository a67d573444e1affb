"""What a review found to be less than the whole job."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import vocabulary as v
from cadenza.operators import adapter, split
from cadenza.plans.queries import QUERIES, Whole

#: Has 1,211 eligible playlists.
SF = "/root/testdata/sf0.01"


def test_holdout_without_a_cap_keeps_every_case(spark):
    rows = [(p, i, x) for p in range(5000, 3800, -1) for i, x in enumerate("abc")]
    t = spark.createDataFrame(rows, "playlist_id long, pos int, song_id string").repartition(7)
    cases = sorted((r.case_idx, r.playlist_id) for r in split.holdout(t, 1, 2, cap=None).select("case_idx", "playlist_id").distinct().collect())
    assert cases == [(i + 1, 3801 + i) for i in range(1200)]


def test_queries_without_sql_have_every_case(spark):
    rows = QUERIES["knowledge_texts"](spark, SF).where("kind = 'playlist'")
    assert sorted(int(r.id) for r in rows.select("id").collect()) == list(range(1, 1212))


@pytest.fixture(scope="module")
def ranked(spark):
    """40 cases of 25 candidates with vectors; what is held out follows from the first product."""
    rng = np.random.default_rng(3)
    scores = [(c, f"s{i}", *(float(z) for z in rng.random(5))) for c in range(40) for i in range(25)]
    prepared = spark.createDataFrame(scores, "case_idx int, song_id string, cf_norm double, artist_norm double, pop_norm double, lemon_norm double, kar_norm double")
    users = spark.createDataFrame([(c, [1.0, 0.5]) for c in range(40)], "case_idx int, vec array<double>")
    items = spark.createDataFrame([(f"s{i}", [i / 25, 0.25]) for i in range(24)], "song_id string, vec array<double>")
    truth = prepared.where("song_id in ('s21', 's22', 's23')").select("case_idx", "song_id", F.lit(False).alias("observed"))
    return adapter.features(prepared, truth, users, items).persist()


def test_adapter_has_all_features_and_sets(ranked):
    assert len(adapter.FEATURES) == 44 and set(adapter.FEATURES) <= set(ranked.columns)
    r = ranked.where("case_idx = 3 and song_id = 's10'").first()
    assert (r.kar_product_0, r.kar_product_1, r.kar_product_2) == (0.4, 0.125, 0.0)
    assert ranked.where("song_id = 's24' and kar_product_0 = 0").count() == 40
    assert len(adapter.SETS) == 7 and adapter.SETS["Adapter all"] == adapter.FEATURES
    assert set(adapter.KAR_PRODUCTS) <= set(adapter.SETS["Adapter CF + metadata + KAR vector"]) & set(adapter.SETS["Adapter semantic only"])


def test_adapter_draws_every_pair(spark, ranked):
    assert adapter.pairs(ranked, 1).count() == 40 * 3 * 20
    # 120,000 pairs: more than 100,000
    many = ranked.join(spark.range(50).select(F.col("id").alias("copy"))).withColumn("case_idx", (F.col("case_idx") + 1000 * F.col("copy")).cast("int")).drop("copy")
    drawn = adapter.pairs(many, 1)
    assert drawn.count() == 120_000 and drawn.select("case_idx", "p", "j").distinct().count() == 120_000


@pytest.mark.parametrize("loss", ["pairwise", "bce"])
def test_adapter_losses(ranked, loss):
    sample = adapter.pairs(ranked, 1) if loss == "pairwise" else ranked
    net = adapter.train(sample, adapter.stats(ranked, adapter.FEATURES), ("cf", "kar_product_0"), 1, hidden=16, epochs=60, rate=0.02, loss=loss)
    best = adapter.rank(ranked, net, "v", top=3).select("song_id").distinct()
    assert {r.song_id for r in best.collect()} == {"s21", "s22", "s23"}


def test_adapter_gradients():
    """Against finite differences, with dropout's masks held."""
    rng = np.random.default_rng(0)
    net = adapter.Network(("a", "b"), np.zeros(2), np.ones(2), [(rng.normal(size=s), rng.normal(size=s[1])) for s in ((2, 4), (4, 3), (3, 1))])
    x, masks = rng.normal(size=(5, 2)), [rng.integers(0, 2, (5, n)) * 2.0 for n in (4, 3)]
    grads = net.slopes(net.forward(x, masks), np.ones((5, 1)), masks)
    for w, g in zip((y for layer in net.layers for y in layer), (y for layer in grads for y in layer), strict=True):
        for i in np.ndindex(w.shape):
            w[i] += 1e-6
            up = net.forward(x, masks)[-1].sum()
            w[i] -= 2e-6
            down = net.forward(x, masks)[-1].sum()
            w[i] += 1e-6
            assert abs((up - down) / 2e-6 - g[i]) < 1e-5


def test_knowledge_texts_quote_the_documents(spark, sf_dir):
    songs = {r.song_id: " ".join(r.lyrics.split()) for r in Whole(spark, sf_dir).eval_songs.collect()}
    got = {r.id: r.text.split(". lyric evidence ", 1)[1] for r in QUERIES["knowledge_texts"](spark, sf_dir).where("kind = 'item'").collect()}
    assert got.keys() == songs.keys() and any(got.values())
    assert all(songs[k].startswith(x) and (x == songs[k] or len(x) >= 240) for k, x in got.items())


def test_knowledge_texts_by_brute_force(spark, sf_dir):
    m = Whole(spark, sf_dir)
    songs = {r.song_id: r for r in m.eval_songs.collect()}
    terms = {}
    for r in m.song_profiles.collect():
        values = [(k, x) for k in v.KEYS for x in (r[k] if k in v.LIST_KEYS else [r[k]])]
        values = [(k, (x or "").replace("_", " ").strip()) for k, x in values]
        terms[r.song_id] = [t for k, x in values if x and x != "mixed" for t in (f"{k} {x}", x)]
    want, cases = {}, defaultdict(list)
    for k, s in songs.items():
        want["item", k] = f"item factual knowledge. title {s.title}. artist {s.artist}. semantic tags {' '.join(terms[k])}. lyric evidence {' '.join(s.lyrics.split())[:260]}"
    for r in sorted(m.split.where("observed").collect(), key=lambda r: r.rn):
        cases[r.case_idx].append(r.song_id)
    top = lambda xs, n: " ".join(x for x, _ in sorted(Counter(xs).items(), key=lambda c: (-c[1], c[0]))[:n])
    for c, seen in cases.items():
        late = seen[-12:]
        names = "; ".join(f"{songs[k].title} by {songs[k].artist}" for k in late)
        want["playlist", str(c)] = (
            f"preference reasoning knowledge. recent observed songs {names}. frequent artists {top([songs[k].artist for k in seen], 5)}. "
            f"long term semantic preferences {top([t for k in seen for t in terms[k]], 18)}. short term semantic intent {top([t for k in late for t in terms[k]], 12)}."
        )
    assert any(len(x) > 12 for x in cases.values())
    assert {(r.kind, r.id): r.text for r in QUERIES["knowledge_texts"](spark, sf_dir).collect()} == want
