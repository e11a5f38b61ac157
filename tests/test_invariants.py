"""Queries without SQL: what must hold of their rows, computed anew from the tables."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill import catalog
from gristmill.operators.factors import agglomerated
from gristmill.operators.tiers import Tiers
from gristmill.plans import ensembles, kernels, latents, probes
from gristmill.plans.battles import battles
from tests.test_gaussian_tiers import plain_tiers
from tests.test_latent import plain_factors

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def rows(spark, name):
    return catalog.queries()[name](spark, DATA).toPandas()


def numbers(spark):
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_quantity", "l_extendedprice", "l_discount", "l_tax").toPandas().astype(float)
    return lines.to_numpy()


def test_components_and_partial_correlations(spark):
    x = numbers(spark)
    z = (x - x.mean(0)) / x.std(0)
    values = np.linalg.eigvalsh(z.T @ z / len(z))[::-1]
    pc = rows(spark, "principal_components")
    assert len(pc) == len(x) and np.allclose(pc[["pc1", "pc2"]].var(ddof=0), values[:2], rtol=1e-6)
    assert abs(np.corrcoef(pc["pc1"], pc["pc2"])[0, 1]) < 1e-6
    shares = rows(spark, "explained_variance")
    assert np.allclose(shares["share"], values / values.sum()) and np.allclose(shares["cumulative"], np.cumsum(values) / values.sum())
    inverse = np.linalg.inv(np.corrcoef(x.T) + 1e-4 * np.eye(4))
    part = -inverse / np.sqrt(np.outer(np.diag(inverse), np.diag(inverse)))
    assert np.allclose(sorted(rows(spark, "partial_correlations")["r"]), sorted(part[np.triu_indices(4, 1)]), atol=1e-6)


def test_clusters_and_hulls(spark):
    got = rows(spark, "cluster_vectors")
    ids = {r[0] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id").collect()}
    assert set(got["vec_id"]) == ids and len(got) == len(ids) and 2 <= got["cluster"].nunique() <= 7
    part = spark.read.parquet(f"{DATA}/part.parquet").select("p_brand", "p_size", "p_retailprice").toPandas()
    for brand, corners in rows(spark, "hulls").sort_values("corner").groupby("p_brand"):
        c = corners[["p_size", "p_retailprice"]].to_numpy(float)
        pts = part.loc[part["p_brand"] == brand, ["p_size", "p_retailprice"]].to_numpy(float)
        for a, b in zip(c, np.roll(c, -1, 0), strict=True):  # every point lies left of every side
            assert ((b[0] - a[0]) * (pts[:, 1] - a[1]) - (b[1] - a[1]) * (pts[:, 0] - a[0]) >= -1e-6).all()


@pytest.mark.parametrize("name", ["impute_cells", "impute_coherent", "model_bank"])
def test_gaps_are_filled_and_cells_that_are_there_stay(spark, name):
    own = kernels.sparse_parts(spark, DATA).toPandas().set_index("k")
    got = rows(spark, name)
    assert len(got) == own.size
    for r in got.itertuples():
        was = own.loc[r.k, r.column]
        assert np.isfinite(r.value) and r.sigma2 >= 0
        assert (r.origin == "observed") == (was == was) and (was != was or abs(r.value - was) < 1e-9)


def test_trajectory_and_completion(spark):
    own = kernels.sparse_parts(spark, DATA).toPandas().set_index("k")
    t = rows(spark, "impute_trajectory").set_index("k")
    assert (t["n_imputed"] == own.isna().sum(1).reindex(t.index)).all() and (t["mean_delta"] <= t["max_delta"] + 1e-6).all()
    full = rows(spark, "completed_matrix").set_index("k").reindex(own.index)[list(own.columns)]
    assert not full.isna().any().any() and np.allclose(full.to_numpy()[own.notna()], own.to_numpy()[own.notna()])
    q = rows(spark, "impute_quality")
    assert set(q["column"]) <= set(own.columns) and (q["n"] <= own.notna().sum().max()).all() and (q["mae"] <= q["rmse"] + 1e-9).all() and q["coverage"].between(0, 1).all()


def test_predictions_cover_every_labelled_row(spark):
    got = rows(spark, "local_predictions")
    y = kernels.labelled(spark, DATA).toPandas().set_index("k")["y"]
    assert set(got["k"]) == set(y.index) and len(got) == len(y)
    assert np.allclose(got.set_index("k")["actual"].reindex(y.index), y)
    c = rows(spark, "calibrated_intervals")
    assert (c["lower"] < c["predicted"]).all() and (c["predicted"] < c["upper"]).all() and c["p_above"].between(0, 1).all()
    assert ((c["p_above"] > 0.5) == (c["predicted"] > 38000)).all()


def test_ratings_and_strengths(spark):
    own = battles(spark, DATA)
    games = rows(spark, "skill_ratings")
    assert (games["sigma"] < 25 / 3 + 0.1).all() and games.groupby("item")["games"].sum().mod(2).eq(0).all()
    strengths = rows(spark, "bradley_terry")
    assert np.allclose(strengths.groupby("item")["strength"].sum(), 0, atol=1e-6)
    controlled = rows(spark, "style_controlled")
    assert np.allclose(controlled["shift"], controlled["controlled"] - controlled["raw"])
    rate = own.select(F.explode(F.array(F.struct(F.col("winner").alias("m"), F.lit(1.0).alias("w")), F.struct(F.col("loser").alias("m"), F.lit(0.0).alias("w")))).alias("s")).groupBy("s.m").agg(F.avg("s.w").alias("w")).toPandas().set_index("m")["w"]
    raw = controlled.set_index("model")["raw"]
    assert np.corrcoef(raw, rate.reindex(raw.index))[0, 1] > 0.8


def test_column_kinds(spark):
    got = dict(rows(spark, "column_kinds")[["column", "kind"]].to_numpy().tolist())
    assert got["l_linenumber"] == "CATEGORICAL" and got["l_extendedprice"] == "LINEAR"


def test_factors_families_steps_and_curves(spark):
    x = numbers(spark)
    f = rows(spark, "factor_scores")
    parts = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_partkey").distinct().count()
    assert len(f) == parts and abs(f["f1"].mean()) < 1e-6
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_orderkey", "l_linenumber").toPandas()
    every = np.column_stack([x, lines["l_linenumber"]])
    want = agglomerated(1 - np.abs(np.corrcoef(every.T)), 3)
    fam = dict(rows(spark, "column_families").to_numpy().tolist())
    assert [fam[c] for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")] == want
    fold, y = lines["l_orderkey"].to_numpy() % 5, x[:, 1]

    def held_out(use):
        rss = 0.0
        for k in range(5):
            a = np.hstack([np.ones((len(x), 1)), every[:, use]])
            beta = np.linalg.lstsq(a[fold != k], y[fold != k], rcond=None)[0]
            rss += ((y[fold == k] - a[fold == k] @ beta) ** 2).sum()
        return rss

    steps = rows(spark, "incremental_clusters").sort_values("step")["r2"].tolist()
    assert np.allclose(steps, [1 - held_out(u) / ((y - y.mean()) ** 2).sum() for u in ([2, 3], [2, 3, 0], [2, 3, 0, 4])], atol=1e-6)
    best = rows(spark, "ridge_baseline").iloc[0]
    assert abs(best["rmse"] / np.sqrt(held_out([0, 2, 3]) / len(y)) - 1) < 0.01
    curve = rows(spark, "smoothed_curve").sort_values("x")
    assert curve["x"].is_monotonic_increasing and curve["x"].between(x[:, 0].min(), x[:, 0].max()).all() and curve["y"].between(y.min(), y.max()).all()
    own = kernels.sparse_parts(spark, DATA).toPandas().set_index("k")
    full = rows(spark, "chained_matrix").set_index("k").reindex(own.index)[list(own.columns)]
    assert not full.isna().any().any() and np.allclose(full.to_numpy()[own.notna()], own.to_numpy()[own.notna()])


def test_latent_models_are_those_of_plain_versions(spark):
    own = kernels.sparse_parts(spark, DATA).toPandas().set_index("k").sort_index()
    x, y = own[latents.FEATURES].to_numpy(float), own["x"].to_numpy(float)
    losses = rows(spark, "factor_losses").sort_values("round")["loss"].to_numpy()
    want, w, t, b = plain_factors(x, (y - np.nanmean(y)) / np.nanstd(y), 2, len(losses))
    assert np.allclose(losses, want, rtol=1e-7) and (np.diff(losses) <= 1e-6 * losses[:-1]).all()
    got = rows(spark, "supervised_factors").set_index("k").loc[own.index]
    places = np.stack(got["factors"].to_list())
    assert np.allclose(np.nanmean(y) + np.nanstd(y) * (places @ t + b), got["predicted"], rtol=1e-6)
    seen = ~np.isnan(y)
    assert np.corrcoef(got["predicted"][seen], y[seen])[0, 1] > 0.9
    traits = rows(spark, "latent_traits").set_index("k").loc[own.index]
    assert (traits["sigma"] > 0).all() and np.isfinite(traits["predicted"]).all() and np.corrcoef(traits["predicted"][seen], y[seen])[0, 1] > 0.9
    ability = np.stack(rows(spark, "item_response").set_index("k").loc[own.index, "features"].to_list())
    assert ability.shape == (len(own), 2) and np.allclose(ability.mean(0), 0, atol=1e-8) and np.allclose(ability.std(0), 1)
    assert np.corrcoef(ability[seen, 0], y[seen])[0, 1] > 0.5


def test_neighbours_visit_no_more_partitions_than_there_are(spark):
    got = rows(spark, "neighbour_visits")
    ids = [r[0] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").where("vec_id % 20 = 0").select("vec_id").collect()]
    assert sorted(got["query"]) == sorted(ids) and got["visited"].between(1, got["partitions"]).all()


def test_trees_tell_prices_they_have_not_seen(spark):
    own = ensembles.priced_orders(spark, DATA).toPandas().set_index("o_orderkey").sort_index()
    seen, var = own["price"].notna(), own["price"].var(ddof=0)
    top = rows(spark, "important_columns").sort_values("place")
    assert top["column"].tolist()[0] in ("quantity", "lines") and top["importance"].is_monotonic_decreasing and top["importance"].sum() <= 1 + 1e-9
    for name in ("voted_prices", "stacked_prices"):
        got = rows(spark, name).set_index("o_orderkey").loc[own.index]
        assert np.allclose(got["actual"][seen].astype(float), own["price"][seen]) and got["actual"][~seen].isna().all() and got["predicted"].notna().all()
        assert ((got["predicted"] - own["price"])[seen] ** 2).mean() < 0.5 * var
    errors = rows(spark, "candidate_models").set_index("candidate")
    assert (errors["n"] == seen.sum()).all() and errors["chosen"].sum() == 1 and errors["weighted_rmse"].idxmin() == errors.index[errors["chosen"]][0]
    assert errors["rmse"]["mean"] == errors["rmse"].max() and abs(errors["rmse"]["mean"] ** 2 / var - 1) < 0.02


def test_probes_of_battles_and_win_rates(spark):
    pairs = probes.battle_pairs(spark, DATA).toPandas()
    got = rows(spark, "battle_probe").set_index("fold")
    assert got["n"].to_dict() == pairs["fold"].value_counts().to_dict() and got["accuracy"].between(0, 1).all()
    own = probes.win_rates(spark, DATA).toPandas().set_index("key").sort_index()
    told = rows(spark, "win_rate_probe").set_index("key").sort_index()
    assert own.index.equals(told.index) and np.allclose(own["y"], told["actual"])
    x, y = np.stack(own["x"].to_list()), own["y"].to_numpy()
    for k in range(0, len(y), 5):
        rest = np.arange(len(y)) != k
        c = x[rest] - x[rest].mean(0)
        w = np.linalg.solve(c.T @ c + np.eye(x.shape[1]), c.T @ (y[rest] - y[rest].mean()))
        assert told["predicted"].iloc[k] == pytest.approx(y[rest].mean() + (x[k] - x[rest].mean(0)) @ w)


def test_cells_by_processes_tiers_and_gates(spark):
    own = kernels.sparse_parts(spark, DATA).toPandas().set_index("k").sort_index()
    got = rows(spark, "gaussian_cells").set_index("k").loc[own.index]
    seen = own["x"].notna()
    assert (got["sigma2"] > 0).all() and ((got["value"] - own["x"])[seen] ** 2).mean() < 0.3 * own["x"].var()
    told = rows(spark, "tiered_cells")
    columns = list(own.columns)
    now, sigma, rounds, _ = plain_tiers(own.to_numpy(float), columns, Tiers())
    for c in columns:
        mine = told[told["column"] == c].set_index("k").sort_index()
        filled = rounds[c].notna().to_numpy()
        assert np.array_equal(mine["round"].notna().to_numpy(), filled) and np.allclose(mine["round"].to_numpy(float)[filled], rounds[c].to_numpy()[filled])
        assert np.allclose(mine["value"].to_numpy()[filled], now[c].to_numpy()[filled]) and np.allclose(mine["sigma"].to_numpy()[filled], sigma[c].to_numpy()[filled], atol=1e-6)
    gated = rows(spark, "gated_cells")
    assert len(gated) == own.size and gated["weight"].between(0, 1).all() and (gated[gated["origin"] == "observed"]["weight"] == 0).all() and gated["value"].notna().all()


def test_validation_importances_and_matches_by_skill(spark):
    own = kernels.sparse_parts(spark, DATA).toPandas()
    v = rows(spark, "latent_validation").set_index("kind")
    assert (v["n"] == own["x"].notna().sum()).all() and (v["rmse"] < own["x"].std()).all() and (v["mae"] <= v["rmse"]).all() and set(v.index) == {"transductive", "inductive"}
    i = rows(spark, "model_importances")
    assert set(i["column"]) <= set(own.columns) and np.allclose(i.groupby("column")["share"].sum(), 1) and (i["column"] != i["predictor"]).all()
    m = rows(spark, "matches_by_skill")
    new = m[m["reason"] == "new"]
    assert len(m) <= 300 and not m.duplicated(["item", "model_a", "model_b"]).any() and (m["gain"] > 0).all()
    assert {(r.item, r.model_a, r.model_b) for r in new.itertuples()} == {(r.item, r.model_b, r.model_a) for r in new.itertuples()}
