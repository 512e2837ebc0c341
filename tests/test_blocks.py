import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.catalog import CELL, N
from skyloom.operators import blocks, deconvolution, gridding, imaging

GRID = ("chan", "pol", "iu", "iv")


def _samples(spark, count, reach, seed=7):
    """Samples of four correlations: crowded, so that places share cells, with some that are flagged or NaN."""
    r = np.random.default_rng(seed)
    u, v = (np.round(r.normal(0, reach, (2, count)), 1)).clip(-4 * reach, 4 * reach)
    odd = {3: (float("nan"), 1.0), 5: (1.0, float("nan"))}
    rows = [(i, float(u[i]), float(v[i]), 0.0, i % 2, 1.4e9, i % 4, *(odd.get(i) or (float(r.normal()), float(r.uniform(0.5, 2)))), float(r.normal()), i % 31 == 0) for i in range(count)]
    return spark.createDataFrame(rows, "event_id long, u double, v double, w double, chan int, freq double, pol int, re double, weight double, im double, flag boolean")


def _cells(df, *columns):
    return {tuple(r[k] for k in GRID): np.array([r[c] for c in columns]) for r in df.groupBy(*GRID).agg(*[F.sum(c).alias(c) for c in columns]).collect()}


def _gap(got, want):
    return max(np.abs(got.get(k, 0.0) - want.get(k, np.zeros(1))).max() for k in got.keys() | want.keys())


@pytest.mark.parametrize("n, rows, to_all", [(N, 1 << 16, 1 << 24), (N, 16, 0), (300, 16, 1 << 24)])
def test_blocks_grid_and_regrid(spark, monkeypatch, n, rows, to_all):
    """Blocks give the grids, weights and sums that rows of footprints give, and see a model as degridding does, at corners of
    blocks too, whether blocks have several rows, and patches are sent to all or dealt out."""
    monkeypatch.setattr(blocks, "TOGETHER", rows)
    monkeypatch.setattr(blocks, "TO_ALL", to_all)
    vis = _samples(spark, 1500, 700 * N / n * 2)
    places = gridding.places(vis, n, CELL).cache()
    held = blocks.in_blocks(places, n).cache()
    if rows < 100:
        assert max(r.c for r in held.select(F.size("at").alias("c")).collect()) <= rows and held.groupBy(*blocks.BLOCK).count().where("count > 1").count()
    assert held.agg(F.sum(F.size("at"))).first()[0] == places.count() > 1000
    cells = blocks.grid(held, n)
    assert _gap(_cells(cells, "re", "im"), _cells(gridding.grid_places(places, n), "re", "im")) < 1e-10
    assert _gap(_cells(cells, "weight"), _cells(gridding.grid_places(places, n, do_psf=True), "re")) < 1e-10
    sums = [{(r.chan, r.pol): r.sum_weight for r in x.collect()} for x in (blocks.sum_weight(held), gridding.sum_weight(vis, n, CELL))]
    assert sums[0] == pytest.approx(sums[1], rel=1e-12)
    # a model without one of the planes, and unlike at every cell
    at = spark.range(n * n).select(F.expr(f"int(id div {n})").alias("iu"), F.expr(f"int(id % {n})").alias("iv"))
    model = at.join(spark.range(3).select(F.expr("int(id % 2)").alias("chan"), F.expr("int(id)").alias("pol"))).select("chan", "pol", "iu", "iv", F.sin(F.col("iu") * 3 + F.col("iv")).alias("re"), F.cos(F.col("iv") * (1 + F.col("pol"))).alias("im"))
    seen = gridding.model_at(places, model, n).select(*gridding.PLACE, "w", *[(F.col("w") * F.col(f"model_{c}")).alias(c) for c in ("re", "im")])
    got = _cells(blocks.regrid(held, model, n, 8), "re", "im")
    assert _gap(got, _cells(gridding.grid_places(seen, n), "re", "im")) < 1e-10 and {k[:2] for k in got} == {k[:2] for k in _cells(model, "re")} - {(1, 3)}


def test_cycles_lay_no_footprints_as_rows(spark, monkeypatch):
    """Major cycles neither move places nor lay them out as rows from cycle to cycle, and without samples they end."""

    def refused(*_, **__):
        raise AssertionError("work by rows of places")

    for name in ("footprints", "model_at"):
        monkeypatch.setattr(gridding, name, refused)
    data = imaging.synthetic_visibilities(_samples(spark, 1500, 700), [(2.0, 6 * CELL, -4 * CELL)])
    control = deconvolution.IterationController(niter=400, nmajor=2, threshold=0.02, cycleniter=40)
    model, _, log = imaging.major_cycles(data, control, N, CELL, 0.2)
    top = model.orderBy(F.desc("value")).first()
    assert (top.l, top.m) == (N // 2 + 6, N // 2 - 4) and log.select("cycle").distinct().count() == 2
    none = deconvolution.IterationController(niter=10)
    assert imaging.major_cycles(data.where("false"), none, N, CELL)[0].count() == 0 and none.stopcode == 7


def test_places_are_grouped_by_one_number(spark):
    """The number that samples are grouped by holds cell and sub-cell, up to the edges of the grid."""
    vis = _samples(spark, 400, 500)
    places = gridding.places(vis, N, CELL)
    want = gridding.spots(vis, N, CELL).groupBy(*gridding.PLACE).agg(*[F.sum(c).alias(c) for c in ("w", "re", "im")])
    got, want = ({tuple(r)[:6]: tuple(r)[6:] for r in x.collect()} for x in (places, want))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in got)
    plan = places._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[place" in plan or "HashAggregate(keys=[_groupingexpression" in plan
