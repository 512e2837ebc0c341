"""Queries of the imaging and analysis operators over the driver's tables, each beside its SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as fn
from . import sources
from .operators import calibration, coordinates, deconvolution, fitting, frames, gridding, images, imaging, selection, tiles
from .plans import IMG, RET_LOG, VIS, img, ret_log, table, tidy, vis
from .streaming import grid_windows, merged, weight_windows

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
N, CELL = 64, 5e-5
SCALE = f"(-(freq*({CELL!r}::DOUBLE)*{N})/299792458e0)"


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL where there is one."""

    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLE[name] = sql
        return function

    return add


def r6(expression: str) -> str:
    return f"round({expression}, 6)+0e0"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: tidy(F.col(c)) for c in columns})


# ---- kernels -------------------------------------------------------------------------------------------------------
def _horner(cs: tuple[float, ...]) -> str:
    return "+".join(f"({c!r}::DOUBLE)*pow(d,{k})" for k, c in enumerate(cs))


def _spheroidal_sql(source: str) -> str:
    (_, t0, b0), (_, t1, b1) = fn.SPHEROIDAL
    return f"""SELECT k, x, CASE WHEN x < 0.75e0 THEN ({_horner(t0)})/({_horner(b0)}) ELSE ({_horner(t1)})/({_horner(b1)}) END AS g
 FROM (SELECT k, x, x*x - CASE WHEN x < 0.75e0 THEN 0.5625e0 ELSE 1e0 END AS d FROM ({source}))"""


KERNEL = f"kernel AS (SELECT k, CASE WHEN k < 300 THEN (1-x*x)*g ELSE 0e0 END AS kv FROM ({_spheroidal_sql('SELECT range AS k, least(range/300e0,1e0) AS x FROM range(400)')}))"


@query("kernel_pswf_1d", f"WITH {KERNEL} SELECT event_id, k::INT AS k, {r6('kv')} AS kv FROM events JOIN kernel ON k = event_id%400")
def kernel_pswf_1d(spark: SparkSession, sf: str) -> DataFrame:
    """The kernel at a place of every event."""
    k = F.col("event_id") % 400
    kv = F.when(k < 300, (1 - (k / 300) * (k / 300)) * fn.spheroidal(k / 300)).otherwise(0.0)
    return table(spark, sf, "events").select("event_id", k.cast("int").alias("k"), tidy(kv).alias("kv"))


@query(
    "pswf_correction_image",
    f"WITH {IMG}, c AS ({_spheroidal_sql('SELECT range AS k, abs(range-4)/4e0 AS x FROM range(8)')}) SELECT plane, chan, l, m, {r6('value*a.g*b.g')} AS value FROM img JOIN c a ON a.k = l JOIN c b ON b.k = m",
)
def pswf_correction_image(spark: SparkSession, sf: str) -> DataFrame:
    """Images times the correction of gridding."""
    one = lambda c: fn.spheroidal(F.abs(F.col(c) - 4) / 4)
    return rounded(img(spark, sf).withColumn("value", F.col("value") * one("l") * one("m")), "value")


# ---- gridding ------------------------------------------------------------------------------------------------------
POS = f"""pos AS (SELECT *, CASE WHEN flag THEN 0e0 ELSE weight END AS wt, u*{SCALE}+{N // 2} AS up, v*{SCALE}+{N // 2} AS vp FROM vis)"""
CELLS = f"""cells AS (SELECT *, floor((ui-up)*100+0.5e0)::INT AS uo, floor((vi-vp)*100+0.5e0)::INT AS vo
 FROM (SELECT *, trunc(up+0.5e0)::INT AS ui, trunc(vp+0.5e0)::INT AS vi FROM pos) WHERE ui-3>=0 AND vi-3>=0 AND ui+3<{N} AND vi+3<{N})"""


def _cells_sql(chan: str, re: str, im: str) -> str:
    """The gridded cells as a table ``cell``."""
    return f"""{VIS}, {KERNEL}, {POS}, {CELLS}, steps AS (SELECT (range-3)::INT AS d FROM range(7)),
 foot AS (SELECT {chan} AS chan, pol, ui+a.d AS iu, vi+b.d AS iv, ku.kv*kv2.kv AS k, {re} AS re, {im} AS im FROM cells CROSS JOIN steps a CROSS JOIN steps b
 JOIN kernel ku ON ku.k = abs(100*a.d+uo) JOIN kernel kv2 ON kv2.k = abs(100*b.d+vo) WHERE wt <> 0 AND ku.kv <> 0),
 cell AS (SELECT chan, pol, iu, iv, sum(k*re) AS re, sum(k*im) AS im FROM foot GROUP BY ALL)"""


def _grid_sql(chan: str, re: str, im: str) -> str:
    return f"WITH {_cells_sql(chan, re, im)} SELECT chan, pol, iu, iv, {r6('re')} AS re, {r6('im')} AS im FROM cell"


@query("grid_standard_cube", _grid_sql("chan", "re*wt", "im*wt"))
def grid_standard_cube(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(gridding.grid(vis(spark, sf), N, CELL), "re", "im")


@query("grid_standard_continuum", _grid_sql("0", "re*wt", "im*wt"))
def grid_standard_continuum(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(gridding.grid(vis(spark, sf), N, CELL, mode="continuum"), "re", "im")


@query("grid_psf", _grid_sql("chan", "wt", "0e0"))
def grid_psf(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(gridding.grid(vis(spark, sf), N, CELL, do_psf=True), "re", "im")


@query(
    "grid_sum_weight",
    f"""WITH {VIS}, {KERNEL}, {POS}, {CELLS}, steps AS (SELECT (range-3)::INT AS d FROM range(7)), offs AS (SELECT (range-51)::INT AS o FROM range(103)),
 tot AS (SELECT o, sum(kv) AS s FROM offs CROSS JOIN steps JOIN kernel ON k = abs(100*d+o) GROUP BY o)
 SELECT chan, pol, {r6('sum(wt*a.s*b.s)')} AS sum_weight FROM cells JOIN tot a ON a.o = uo JOIN tot b ON b.o = vo GROUP BY chan, pol""",
)
def grid_sum_weight(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(gridding.sum_weight(vis(spark, sf), N, CELL), "sum_weight")


DENSITY = f"""nc AS (SELECT event_id, chan, weight, trunc(up+0.5e0)::INT AS iu, trunc(vp+0.5e0)::INT AS iv, trunc({N}-up+0.5e0)::INT AS ju, trunc({N}-vp+0.5e0)::INT AS jv FROM pos WHERE NOT flag),
 density AS (SELECT chan, iu, iv, sum(weight) AS density FROM (SELECT chan, weight, iu, iv FROM nc UNION ALL SELECT chan, weight, ju, jv FROM nc)
 WHERE iu BETWEEN 0 AND {N - 1} AND iv BETWEEN 0 AND {N - 1} GROUP BY chan, iu, iv)"""


@query("weights_density", f"WITH {VIS}, {POS}, {DENSITY} SELECT chan, iu, iv, {r6('density')} AS density FROM density")
def weights_density(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(gridding.weight_density(vis(spark, sf), N, CELL), "density")


query("weights_density_averaged", f"WITH {VIS}, {POS}, {DENSITY} SELECT chan, iu, iv, {r6('density/2')} AS density FROM density")(
    lambda spark, sf: rounded(gridding.weight_density(vis(spark, sf), N, CELL, averaged=2), "density")
)


def _weights_sql(factors: str) -> str:
    return f"""WITH {VIS}, {POS}, {DENSITY}, sw AS (SELECT chan, 2*sum(weight) AS sw FROM nc GROUP BY chan), fac AS ({factors}),
 new AS (SELECT event_id, CASE WHEN density IS NOT NULL AND density <> 0 THEN weight/(a*density+b) ELSE weight END AS nw FROM nc LEFT JOIN density USING (chan, iu, iv) JOIN fac USING (chan)
 WHERE iu BETWEEN 0 AND {N - 1} AND iv BETWEEN 0 AND {N - 1})
 SELECT event_id, {r6('coalesce(nw, 0e0)')} AS weight_imaging FROM vis LEFT JOIN new USING (event_id)"""


def _weights(scheme: str):
    return lambda spark, sf: rounded(gridding.imaging_weights(vis(spark, sf), scheme, 0.5, N, CELL), "weight_imaging")


query("weights_natural", f"WITH {VIS} SELECT event_id, CASE WHEN flag THEN 0e0 ELSE weight END AS weight_imaging FROM vis")(_weights("natural"))
query(
    "weights_briggs",
    _weights_sql(f"SELECT chan, ({(5.0 * 10.0 ** -0.5) ** 2!r}::DOUBLE)/(g2/sw) AS a, 1e0 AS b FROM (SELECT chan, sum(density*density) AS g2 FROM density GROUP BY chan) JOIN sw USING (chan)"),
)(_weights("briggs"))
query("weights_briggs_abs", _weights_sql("SELECT chan, 0.25e0 AS a, 2e0 AS b FROM sw"))(_weights("briggs_abs"))
query("weights_uniform", _weights_sql("SELECT chan, 1e0 AS a, 0e0 AS b FROM sw"))(_weights("uniform"))


@query("flag_mask_weights", f"WITH {VIS} SELECT event_id, CASE WHEN flag OR isnan(u) OR isnan(v) THEN 0e0 ELSE weight END AS wt FROM vis")
def flag_mask_weights(spark: SparkSession, sf: str) -> DataFrame:
    return vis(spark, sf).select("event_id", gridding.effective_weight().alias("wt"))


#: Samples of which some have a visibility, a coordinate or a weight that is NaN or null.
VIS_NAN = VIS.replace("vis AS (", "vis0 AS (", 1) + """, vis AS (SELECT * REPLACE (CASE WHEN event_id%23=5 THEN 'nan'::DOUBLE ELSE u END AS u, CASE WHEN event_id%29=3 THEN 'nan'::DOUBLE ELSE re END AS re,
 CASE WHEN event_id%31=4 THEN NULL ELSE im END AS im, CASE WHEN event_id%37=6 THEN 'nan'::DOUBLE ELSE weight END AS weight) FROM vis0)"""
#: The same without those samples.
VIS_FIT = VIS.replace("vis AS (", "vis0 AS (", 1) + ", vis AS (SELECT * FROM vis0 WHERE event_id%23<>5 AND event_id%29<>3 AND event_id%31<>4 AND event_id%37<>6)"


def vis_nan(spark: SparkSession, sf: str) -> DataFrame:
    hole = lambda c, k, r, what: F.when(F.col("event_id") % k == r, F.lit(what).cast("double")).otherwise(F.col(c))
    nan = float("nan")
    return vis(spark, sf).withColumns({"u": hole("u", 23, 5, nan), "re": hole("re", 29, 3, nan), "im": hole("im", 31, 4, None), "weight": hole("weight", 37, 6, nan)})


@query("grid_nan", _grid_sql("chan", "re*wt", "im*wt").replace(VIS, VIS_FIT, 1))
def grid_nan(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(gridding.grid(vis_nan(spark, sf), N, CELL), "re", "im")


@query("grid_sum_weight_nan", ORACLE["grid_sum_weight"].replace(VIS, VIS_FIT, 1))
def grid_sum_weight_nan(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(gridding.sum_weight(vis_nan(spark, sf), N, CELL), "sum_weight")


#: Weights look at coordinates, flags and weights; a NaN visibility keeps its weight.
NAN_WEIGHTS = ORACLE["weights_briggs"].replace(VIS, VIS_NAN, 1).replace("FROM pos WHERE NOT flag", "FROM pos WHERE NOT flag AND NOT isnan(u) AND NOT isnan(weight)", 1)
query("weights_nan", NAN_WEIGHTS)(lambda spark, sf: rounded(gridding.imaging_weights(vis_nan(spark, sf), "briggs", 0.5, N, CELL), "weight_imaging"))

#: Two or four correlations of each event, with flags and NaN weights in some.
def _hands_sql(correlations: int) -> str:
    return f"""{VIS.replace("vis AS (", "vis0 AS (", 1)}, vis AS MATERIALIZED (SELECT * REPLACE (p.range::INT AS pol, event_id%19=0 AND p.range={correlations - 1} AS flag,
 CASE WHEN event_id%23=5 AND p.range=0 THEN 'nan'::DOUBLE ELSE 0.25e0*(1+(event_id+2*p.range)%5) END AS weight)
 FROM (SELECT * FROM vis0 ORDER BY event_id), (SELECT unnest(range({correlations})) AS range) p)"""


def hands(spark: SparkSession, sf: str, correlations: int) -> DataFrame:
    wide = vis(spark, sf).withColumn("pol", F.explode(F.sequence(F.lit(0), F.lit(correlations - 1))))
    e, p = F.col("event_id"), F.col("pol")
    weight = F.when((e % 23 == 5) & (p == 0), float("nan")).otherwise(F.lit(0.25) * (1 + (e + 2 * p) % 5))
    return wide.withColumns({"flag": (e % 19 == 0) & (p == correlations - 1), "weight": weight})


def _averaged_sql(correlations: int, factors: str) -> str:
    mean = f"""mean AS (SELECT event_id, any_value(chan) AS chan, any_value(up) AS up, any_value(vp) AS vp, sum(weight)/2 AS weight FROM pos
 WHERE pol IN (0, {correlations - 1}) GROUP BY event_id HAVING bool_and(NOT flag AND NOT isnan(weight)))"""
    density = DENSITY.replace("FROM pos WHERE NOT flag", "FROM mean", 1)
    return f"""WITH {_hands_sql(correlations)}, {POS}, {mean}, {density}, sw AS (SELECT chan, 2*sum(weight) AS sw FROM nc GROUP BY chan), fac AS ({factors}),
 new AS (SELECT event_id, CASE WHEN density IS NOT NULL AND density <> 0 THEN weight/(a*density+b) ELSE weight END AS nw FROM nc LEFT JOIN density USING (chan, iu, iv) JOIN fac USING (chan))
 SELECT event_id, pol, {r6('coalesce(nw, 0e0)')} AS weight_imaging FROM vis LEFT JOIN new USING (event_id)"""


def _averaged(scheme: str, correlations: int):
    # an event is a sample of all its correlations
    return lambda spark, sf: rounded(gridding.averaged_weights(hands(spark, sf, correlations).withColumn("of", F.col("event_id")), scheme, 0.5, N, CELL, correlations, ("of", "chan")), "weight_imaging")


FACTORS = {
    "briggs": f"SELECT chan, ({(5.0 * 10.0 ** -0.5) ** 2!r}::DOUBLE)/(g2/sw) AS a, 1e0 AS b FROM (SELECT chan, sum(density*density) AS g2 FROM density GROUP BY chan) JOIN sw USING (chan)",
    "briggs_abs": "SELECT chan, 0.25e0 AS a, 2e0 AS b FROM sw",
    "uniform": "SELECT chan, 1e0 AS a, 0e0 AS b FROM sw",
}
for _scheme, _factors in FACTORS.items():
    for _k in (2, 4):
        query(f"weights_{_scheme}_averaged_{_k}", _averaged_sql(_k, _factors))(_averaged(_scheme, _k))

#: A model grid with a closed form.
MODEL = f"model AS (SELECT c.range::INT AS chan, p.range::INT AS pol, a.range::INT AS iu, b.range::INT AS iv, (a.range*3+b.range)%11+0.5e0 AS gr, ((a.range+b.range*5)%7)::DOUBLE AS gi FROM range(4) c, range(2) p, range({N}) a, range({N}) b)"


def model_grid(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    at = spark.range(4 * 2 * N * N).select((i / (2 * N * N)).cast("int").alias("chan"), ((i / (N * N)).cast("int") % 2).alias("pol"), ((i / N).cast("int") % N).alias("iu"), (i % N).cast("int").alias("iv"))
    return at.withColumns({"re": (F.col("iu") * 3 + F.col("iv")) % 11 + F.lit(0.5), "im": ((F.col("iu") + F.col("iv") * 5) % 7).cast("double")})


def _degrid_sql(model: str, re: str, im: str, more: tuple[str, str] = ("", "")) -> str:
    return f"""WITH {VIS}, {KERNEL}, {POS}, {MODEL}, spots AS (SELECT *, floor((ui-up)*100+0.5e0)::INT AS uo, floor((vi-vp)*100+0.5e0)::INT AS vo
 FROM (SELECT event_id, chan, pol, up, vp, round_even(up,0)::INT AS ui, round_even(vp,0)::INT AS vi FROM pos) WHERE ui-3>=0 AND vi-3>=0 AND ui+3<{N} AND vi+3<{N}),
 steps AS (SELECT (range-3)::INT AS d FROM range(7)),
 mean AS (SELECT event_id, sum(ku.kv*kv2.kv*{re})/sum(ku.kv*kv2.kv) AS re, sum(ku.kv*kv2.kv*{im})/sum(ku.kv*kv2.kv) AS im FROM spots CROSS JOIN steps a CROSS JOIN steps b
 JOIN kernel ku ON ku.k = abs(100*a.d+uo) JOIN kernel kv2 ON kv2.k = abs(100*b.d+vo) {model} GROUP BY event_id)
 SELECT event_id, {r6('coalesce(mean.re,0e0)' + more[0])} AS re, {r6('coalesce(mean.im,0e0)' + more[1])} AS im FROM vis LEFT JOIN mean USING (event_id)"""


@query("degrid_constant", _degrid_sql("", "2e0", "0e0"))
def degrid_constant(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(gridding.degrid(vis(spark, sf), None, N, CELL, constant=2.0), "re", "im")


@query("degrid_model", _degrid_sql("LEFT JOIN model g ON g.chan=spots.chan AND g.pol=spots.pol AND g.iu=ui+a.d AND g.iv=vi+b.d", "coalesce(g.gr,0e0)", "coalesce(g.gi,0e0)"))
def degrid_model(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(gridding.degrid(vis(spark, sf), model_grid(spark), N, CELL), "re", "im")


@query(
    "degrid_mapped",
    _degrid_sql("LEFT JOIN model g ON g.chan=spots.chan//2 AND g.pol=1-spots.pol AND g.iu=ui+a.d AND g.iv=vi+b.d", "coalesce(g.gr,0e0)", "coalesce(g.gi,0e0)", ("+vis.re", "+vis.im")),
)
def degrid_mapped(spark: SparkSession, sf: str) -> DataFrame:
    """Two channels at a time look at one of the grid, polarisations at each other's; added to what the data have."""
    had = vis(spark, sf).withColumns({"model_re": F.col("re"), "model_im": F.col("im")})
    found = gridding.degrid_mapped(had, model_grid(spark), {0: 0, 1: 0, 2: 1, 3: 1}, {0: 1, 1: 0}, incremental=True, n=N, cell=CELL)
    return rounded(found.select("event_id", F.col("model_re").alias("re"), F.col("model_im").alias("im")), "re", "im")


@query("residual_vis", f"WITH {VIS} SELECT event_id, {r6('re-2e0')} AS re, {r6('im')} AS im FROM vis")
def residual_vis(spark: SparkSession, sf: str) -> DataFrame:
    seen = vis(spark, sf).withColumns({"model_re": F.lit(2.0), "model_im": F.lit(0.0)})
    return rounded(imaging.residual(seen).select("event_id", "re", "im"), "re", "im")


@query(
    "single_dish_grid",
    f"""WITH {VIS}, steps AS (SELECT (range-3)::INT AS d FROM range(7)), wide AS (SELECT pol, re, im, weight, x, y, round_even(x,0)::INT+a.d AS iu, round_even(y,0)::INT+b.d AS iv
 FROM (SELECT *, u/40e0+32 AS x, v/40e0+32 AS y FROM vis WHERE NOT flag) CROSS JOIN steps a CROSS JOIN steps b),
 near AS (SELECT *, (iu-x)*(iu-x)+(iv-y)*(iv-y) AS d2 FROM wide WHERE iu BETWEEN 0 AND 63 AND iv BETWEEN 0 AND 63)
 SELECT pol, iu, iv, {r6('sum(exp(-d2)*weight*re)')} AS re, {r6('sum(-(exp(-d2)*weight)*im)')} AS im, {r6('sum(exp(-d2)*weight)')} AS weight FROM near WHERE d2 <= 9 GROUP BY pol, iu, iv""",
)
def single_dish_grid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(gridding.single_dish_grid(vis(spark, sf)), "re", "im", "weight")


RADIAL = [1 / (1 + i * i) for i in range(11)]


@query(
    "single_dish_table",
    ORACLE["single_dish_grid"].replace("exp(-d2)", f"[{','.join(f'({v!r}::DOUBLE)' for v in RADIAL)}][round_even(sqrt(d2)*4,0)::INT+1]").replace("WHERE d2 <= 9", "WHERE d2 <= 9 AND round_even(sqrt(d2)*4,0) < 11").replace("u/40e0", "u/28e0").replace("v/40e0", "v/28e0").replace("WHERE NOT flag)", "WHERE NOT flag AND u/28e0+32 >= 0 AND u/28e0+32 < 64 AND v/28e0+32 >= 0 AND v/28e0+32 < 64)"),
)
def single_dish_table(spark: SparkSession, sf: str) -> DataFrame:
    """A kernel as a table of radii, shorter than the circle; some samples lie outside the image."""
    return rounded(gridding.single_dish_grid(vis(spark, sf), cell=28.0, kernel=RADIAL, sampling=4), "re", "im", "weight")


CF = "cf AS (SELECT c.range::INT AS cf, (a.range-1)::INT AS du, (b.range-1)::INT AS dv, 1e0/(1+c.range+abs(a.range-1)+abs(b.range-1)) AS k FROM range(3) c, range(3) a, range(3) b)"


def cf_kernels(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    at = spark.range(27).select((i / 9).cast("int").alias("cf"), ((i / 3).cast("int") % 3 - 1).alias("du"), (i % 3 - 1).cast("int").alias("dv"))
    return at.withColumn("k", 1.0 / (1 + F.col("cf") + F.abs("du") + F.abs("dv")))


def _classes(spark: SparkSession, sf: str) -> DataFrame:
    """Baseline classes by the dish types (antenna number mod 2) of either end, whichever comes first."""
    return vis(spark, sf).withColumn("cf", (F.col("ant1") % 2 + F.col("ant2") % 2).cast("int"))


@query("cf_baseline_map", f"WITH {VIS} SELECT DISTINCT ant1, ant2, (ant1%2+ant2%2)::INT AS cf FROM vis")
def cf_baseline_map(spark: SparkSession, sf: str) -> DataFrame:
    return _classes(spark, sf).select("ant1", "ant2", "cf").distinct()


@query("cf_chan_map", f"WITH {VIS}, cfs AS (SELECT range::INT AS cf, 1.4e9+range*1.5e7 AS f FROM range(3)) SELECT chan, arg_min(cf, (abs(freq-f), cf))::INT AS cf FROM (SELECT DISTINCT chan, freq FROM vis) CROSS JOIN cfs GROUP BY chan")
def cf_chan_map(spark: SparkSession, sf: str) -> DataFrame:
    centre = imaging.nearest_cluster(F.col("freq"), [1.4e9 + i * 1.5e7 for i in range(3)])
    return vis(spark, sf).select("chan", "freq").distinct().select("chan", centre.alias("cf"))


@query(
    "aperture_grid",
    f"WITH {VIS}, {CF}, s AS (SELECT chan, pol, (ant1%2+ant2%2)::INT AS cf, sum(weight) AS w FROM vis WHERE NOT flag GROUP BY ALL) SELECT chan, pol, du+8 AS iu, dv+8 AS iv, {r6('sum(w*k)')} AS re FROM s JOIN cf USING (cf) GROUP BY ALL",
)
def aperture_grid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(gridding.aperture_grid(_classes(spark, sf), cf_kernels(spark)), "re")


@query(
    "mosaic_grid",
    f"""WITH {VIS}, {POS}, {CF}, wide AS (SELECT chan, pol, trunc(up+0.5e0)::INT+du AS iu, trunc(vp+0.5e0)::INT+dv AS iv, k, re*weight AS re, im*weight AS im
 FROM (SELECT *, (ant1%2+ant2%2)::INT AS cf FROM pos WHERE NOT flag) JOIN cf USING (cf))
 SELECT chan, pol, iu, iv, round(sum(k*re), 8)+0e0 AS re, round(sum(k*im), 8)+0e0 AS im FROM wide WHERE iu BETWEEN 0 AND {N - 1} AND iv BETWEEN 0 AND {N - 1} GROUP BY ALL""",
)
def mosaic_grid(spark: SparkSession, sf: str) -> DataFrame:
    out = gridding.mosaic_grid(_classes(spark, sf), cf_kernels(spark), N, CELL)
    return out.withColumns({c: tidy(F.col(c), 8) for c in ("re", "im")})  # exact decimals: six digits would be ties


@query(
    "mosaic_nan",
    ORACLE["mosaic_grid"].replace(VIS, VIS_FIT, 1),
)
def mosaic_nan(spark: SparkSession, sf: str) -> DataFrame:
    classes = vis_nan(spark, sf).withColumn("cf", (F.col("ant1") % 2 + F.col("ant2") % 2).cast("int"))
    out = gridding.mosaic_grid(classes, cf_kernels(spark), N, CELL)
    return out.withColumns({c: tidy(F.col(c), 8) for c in ("re", "im")})


# ---- images --------------------------------------------------------------------------------------------------------
def _dft_sql(source: str, sign: int, scale: str, extra: str = "") -> str:
    phase = f"{sign}*2*pi()*((k.l-4)*(x.l-4)+(k.m-4)*(x.m-4))/8e0"
    return f"""SELECT x.plane, x.chan, k.l, k.m, {scale}*sum(x.re*cos({phase})-x.im*sin({phase})) AS re, {scale}*sum(x.re*sin({phase})+x.im*cos({phase})) AS im
 FROM {source} x CROSS JOIN (SELECT a.range::INT AS l, b.range::INT AS m FROM range(8) a, range(8) b) k GROUP BY x.plane, x.chan, k.l, k.m {extra}"""


CX = "cx AS (SELECT plane, chan, l, m, value AS re, 0e0 AS im FROM img)"


@query("fft_plane", f"WITH {IMG}, {CX}, f AS ({_dft_sql('cx', -1, '1e0')}) SELECT plane, chan, l, m, {r6('re')} AS re, {r6('im')} AS im FROM f")
def fft_plane(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(images.fft(img(spark, sf)), "re", "im")


@query("ifft_plane", f"WITH {IMG}, {CX}, f AS ({_dft_sql('cx', 1, '(1e0/64)')}) SELECT plane, chan, l, m, {r6('re')} AS re, {r6('im')} AS im FROM f")
def ifft_plane(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(images.fft(img(spark, sf), inverse=True), "re", "im")


@query("remove_padding", f"WITH {IMG} SELECT plane, chan, l-2 AS l, m-2 AS m, value FROM img WHERE l BETWEEN 2 AND 5 AND m BETWEEN 2 AND 5")
def remove_padding(spark: SparkSession, sf: str) -> DataFrame:
    return images.remove_padding(img(spark, sf), 8, 4)


@query("pad_image", f"WITH {IMG} SELECT plane, chan, l+4 AS l, m+4 AS m, value FROM img")
def pad_image(spark: SparkSession, sf: str) -> DataFrame:
    return images.pad(img(spark, sf), 8, 16)


#: A primary beam and a kernel correction with closed forms.
PB = "exp(-((l-4)*(l-4)+(m-4)*(m-4))/16e0)"
CORR = "(1e0+(l+m)/14e0)"


def _pb():
    d = lambda c: (F.col(c) - 4) * (F.col(c) - 4)
    return F.exp(-(d("l") + d("m")) / 16.0)


def _corr():
    return 1.0 + (F.col("l") + F.col("m")) / 14.0


def _norm(kind: str, limit: float):
    return lambda spark, sf: rounded(images.normalize(img(spark, sf), F.lit(2.5), _corr(), _pb(), kind, limit), "value")


query("normalize_flat_noise", f"WITH {IMG} SELECT plane, chan, l, m, {r6(f'value/2.5e0/({CORR}*{PB})')} AS value FROM img")(_norm("flat_noise", 0.0))
query("normalize_flat_sky", f"WITH {IMG} SELECT plane, chan, l, m, CASE WHEN {PB} < 0.3e0 THEN 'nan'::DOUBLE ELSE {r6(f'value/2.5e0/({CORR}*{PB}*{PB})')} END AS value FROM img")(_norm("flat_sky", 0.3))
query("normalize_none", f"WITH {IMG} SELECT plane, chan, l, m, {r6('value')} AS value FROM img")(_norm("none", 0.0))
query("apply_pb_mul", f"WITH {IMG} SELECT plane, chan, l, m, {r6(f'value*{PB}')} AS value FROM img")(lambda spark, sf: rounded(images.apply_pb(img(spark, sf), _pb()), "value"))
query("apply_pb_div", f"WITH {IMG} SELECT plane, chan, l, m, CASE WHEN l = 0 THEN 'nan'::DOUBLE ELSE {r6(f'value/{PB}')} END AS value FROM img")(
    lambda spark, sf: rounded(images.apply_pb(img(spark, sf), F.when(F.col("l") == 0, 0.0).otherwise(_pb()), False), "value")
)


def _j1_sql(x: str, n: int) -> str:
    return f"(SELECT avg(cos(2*pi()*range/{n}e0-({x})*sin(2*pi()*range/{n}e0))) FROM range({n}))"


def _beam(spark: SparkSession, sf: str, dish: float) -> DataFrame:
    return img(spark, sf).withColumn("r", images.radius(8, 2e-5) * (2 * math.pi * 1e11 / fn.LIGHT) * (dish / 2))


RAD = "SELECT (range//8)::INT AS l, (range%8)::INT AS m, sqrt(pow(((range//8)-4)*2e-5,2)+pow(((range%8)-4)*2e-5,2))*(2*pi()*1e11/299792458e0)*{} AS r FROM range(64)"


def _beam_sql(beam: str, half: str) -> str:
    """Images times a beam."""
    return f"WITH {IMG}, b AS (SELECT l, m, {beam} AS beam FROM ({RAD.format(half)}) q) SELECT plane, chan, l, m, {r6('value*beam')} AS value FROM img JOIN b USING (l, m)"


@query("airy_pb", _beam_sql("CASE WHEN r = 0 THEN 1e0 ELSE pow((2*" + _j1_sql("r", 60) + "/r-2*(0.75e0/10.7e0)*" + _j1_sql("r*(0.75e0/10.7e0)", 60) + "/r)/(1-pow(0.75e0/10.7e0,2)),2) END", "5.35e0"))
def airy_pb(spark: SparkSession, sf: str) -> DataFrame:
    seen = _beam(spark, sf, 10.7)
    return seen.select("plane", "chan", "l", "m", tidy(F.col("value") * fn.airy(F.col("r"), 2, 0.75 / 10.7)).alias("value"))


@query("casa_airy_pb", _beam_sql("CASE WHEN r = 0 THEN 1e0 ELSE pow((16*2*" + _j1_sql("r", 120) + "/r-2*" + _j1_sql("r*4", 120) + "/(r*4))/15,1) END", "2e0"))
def casa_airy_pb(spark: SparkSession, sf: str) -> DataFrame:
    seen = _beam(spark, sf, 4.0)
    return seen.select("plane", "chan", "l", "m", tidy(F.col("value") * fn.casa_airy(F.col("r"), 1, 4.0, 1.0)).alias("value"))


#: Four correlations of each event with closed forms.
CORRS = ("value", "value*0.25e0+1"), ("value*0.5e0", "2e0-value"), ("value*0.125e0", "value*2"), ("3e0-value", "value*0.75e0")


def _corr_parts():
    v = F.col("value")
    return [(v, v * 0.25 + 1), (v * 0.5, 2.0 - v), (v * 0.125, v * 2), (3.0 - v, v * 0.75)]


def _linear_sql(rows: dict, parts) -> str:
    out = []
    for name, row in rows.items():
        re, im = ["0e0"], ["0e0"]
        for c, (a, b) in zip(row, parts):
            c = complex(c)
            if c.real:
                re.append(f"({c.real})::DOUBLE*({a})")
                im.append(f"({c.real})::DOUBLE*({b})")
            if c.imag:
                re.append(f"({-c.imag})::DOUBLE*({b})")
                im.append(f"({c.imag})::DOUBLE*({a})")
        out += [f"{r6('+'.join(re))} AS {name.lower()}_re", f"{r6('+'.join(im))} AS {name.lower()}_im"]
    return "SELECT event_id, " + ", ".join(out) + " FROM events"


def _stokes(spark: SparkSession, sf: str, found: dict) -> DataFrame:
    return table(spark, sf, "events").select("event_id", *[tidy(c).alias(f"{k.lower()}_{p}") for k, v in found.items() for p, c in zip(("re", "im"), v)])


query("stokes_linear_4", _linear_sql(images.TO_STOKES["linear"], CORRS))(lambda spark, sf: _stokes(spark, sf, images.corr_to_stokes(_corr_parts(), "linear")))
query("stokes_circular_4", _linear_sql(images.TO_STOKES["circular"], CORRS))(lambda spark, sf: _stokes(spark, sf, images.corr_to_stokes(_corr_parts(), "circular")))
query("stokes_linear_2", _linear_sql({"I": (1, 1), "Q": (1, -1)}, (CORRS[0], CORRS[3])))(lambda spark, sf: _stokes(spark, sf, images.corr_to_stokes([_corr_parts()[0], _corr_parts()[3]], "linear")))
query("stokes_to_corr", _linear_sql(dict(zip(images.LABELS["linear"], images.FROM_STOKES["linear"])), CORRS))(lambda spark, sf: _stokes(spark, sf, images.stokes_to_corr(_corr_parts(), "linear")))
query("moment_max", f"WITH {IMG} SELECT chan, l, m, max(value) AS value FROM img GROUP BY chan, l, m")(lambda spark, sf: images.moment_max(img(spark, sf)))
query("image_masksum", f"WITH {IMG} SELECT plane, chan, count(*) FILTER (value > 0) AS masksum FROM img GROUP BY plane, chan")(lambda spark, sf: images.masksum(img(spark, sf), F.col("value") > 0))
query("image_peak_residual", f"WITH {IMG} SELECT plane, chan, arg_max(value, (abs(value), -(l*65536+m))) AS peak FROM img GROUP BY plane, chan")(lambda spark, sf: images.peak_residual(img(spark, sf)))
query("make_mask_threshold", f"WITH {IMG} SELECT plane, chan, l, m, value >= 0.1e0 AS mask, NOT (value >= 0.1e0) AS mask0 FROM img")(lambda spark, sf: images.make_mask(img(spark, sf), 0.1).drop("value"))
query("make_mask_combine", f"WITH {IMG} SELECT plane, chan, l, m, value >= 0.1e0 AND l > 2 AS mask, NOT (value >= 0.1e0 AND l > 2) AS mask0 FROM img")(
    lambda spark, sf: images.make_mask(img(spark, sf), 0.1, F.col("l") > 2).drop("value")
)


def _turn_sql(x0: float, y0: float, t: float) -> tuple[str, str]:
    c, s = f"({math.cos(t)!r}::DOUBLE)", f"({math.sin(t)!r}::DOUBLE)"
    return f"((l-{x0}e0)*{c}+(m-{y0}e0)*{s})", f"((m-{y0}e0)*{c}-(l-{x0}e0)*{s})"


_A, _B = _turn_sql(3.5, 4.0, 0.4)
query("disk_model", f"WITH {IMG} SELECT plane, chan, l, m, {r6(f'CASE WHEN ({_A}/3)*({_A}/3)+({_B}/1.5e0)*({_B}/1.5e0) <= 1 THEN value+2 ELSE value END')} AS value FROM img")(
    lambda spark, sf: rounded(images.make_disk(img(spark, sf), 2.0, 3.5, 4.0, 3.0, 1.5, 0.4), "value")
)
query("gauss_model", f"WITH {IMG} SELECT plane, chan, l, m, {r6(f'value+2*exp(-4*ln(2e0)*(({_A}/3)*({_A}/3)+({_B}/1.5e0)*({_B}/1.5e0)))')} AS value FROM img")(
    lambda spark, sf: rounded(images.make_gauss2d(img(spark, sf), 2.0, 3.5, 4.0, 3.0, 1.5, 0.4), "value")
)
SRC = "src AS (SELECT ((s_suppkey*37)%1100)/50e0-1 AS x, ((s_suppkey*53)%1100)/50e0-1 AS y, s_nationkey::DOUBLE AS amp FROM supplier), spots AS (SELECT *, floor(x+0.5e0)::INT AS l, floor(y+0.5e0)::INT AS m FROM src)"


def _src(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda k: F.col("s_suppkey") * k % 1100 / 50 - 1
    return table(spark, sf, "supplier").select(at(37).alias("x"), at(53).alias("y"), F.col("s_nationkey").cast("double").alias("amp"))


def _src_sql(where: str) -> str:
    return f"WITH {SRC} SELECT greatest(0, least(19, l))::INT AS l, greatest(0, least(19, m))::INT AS m, sum(amp) AS amp FROM spots {where} GROUP BY 1, 2"


for _policy, _where in (("ignore", "WHERE x BETWEEN 0 AND 19 AND y BETWEEN 0 AND 19"), ("ignore_sloppy", "WHERE x BETWEEN -0.5 AND 19.5 AND y BETWEEN -0.5 AND 19.5"), ("clip", "")):
    query(f"pt_sources_{_policy}", _src_sql(_where))(lambda spark, sf, p=_policy: images.point_sources(_src(spark, sf), 20, p))


#: World axes that are not evenly spaced, one falling and one rising, and sources on them.
L_AXIS, M_AXIS = [-(i + i * i / 50.0) for i in range(20)], [1.5 * i - 3.0 for i in range(20)]
WORLD = "src AS (SELECT 1-((s_suppkey*37)%1400)/50e0 AS x, ((s_suppkey*53)%1700)/50e0-4 AS y, s_nationkey::DOUBLE AS amp FROM supplier), la AS (SELECT range::INT AS i, -(range+range*range/50e0) AS v FROM range(20)), ma AS (SELECT range::INT AS i, 1.5e0*range-3 AS v FROM range(20))"


def _world_src(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda k, n: F.col("s_suppkey") * k % n / 50
    return table(spark, sf, "supplier").select((1 - at(37, 1400)).alias("x"), (at(53, 1700) - 4).alias("y"), F.col("s_nationkey").cast("double").alias("amp"))


def _world_sql(where: str) -> str:
    return f"WITH {WORLD}, near AS (SELECT x, y, amp, (SELECT arg_min(i, (abs(v-x), -v)) FROM la) AS l, (SELECT arg_min(i, (abs(v-y), -v)) FROM ma) AS m FROM src) SELECT l, m, sum(amp) AS amp FROM near {where} GROUP BY l, m"


for _policy, _where in (("ignore", f"WHERE x BETWEEN {L_AXIS[-1]} AND 0 AND y BETWEEN -3 AND 25.5"), ("ignore_sloppy", f"WHERE x BETWEEN {L_AXIS[-1]}-{(L_AXIS[-2] - L_AXIS[-1]) / 2} AND 0.51 AND y BETWEEN -3.75 AND 26.25"), ("clip", "")):
    query("pt_sources_world" if _policy == "ignore" else f"pt_sources_world_{_policy}", _world_sql(_where))(lambda spark, sf, p=_policy: coordinates.point_sources_world(_world_src(spark, sf), L_AXIS, M_AXIS, p))

#: A beam for each channel, the mean of magnitudes over its planes, which has no axis of planes.
PB_TABLE = "pb AS (SELECT chan, l, m, round(avg(abs(value)), 9) AS pb FROM img GROUP BY chan, l, m)"


def _pb_table(spark: SparkSession, sf: str) -> DataFrame:
    return img(spark, sf).groupBy("chan", "l", "m").agg(F.round(F.avg(F.abs("value")), 9).alias("value"))


query("apply_pb_table", f"WITH {IMG}, {PB_TABLE} SELECT plane, img.chan, l, m, {r6('value*pb')} AS value FROM img JOIN pb USING (chan, l, m)")(
    lambda spark, sf: rounded(coordinates.apply_pb_table(img(spark, sf), _pb_table(spark, sf)), "value")
)
query("apply_mask_table", f"WITH {IMG}, pb AS (SELECT l, m, round(avg(value), 9) > 0 AS mask FROM img WHERE l > 1 GROUP BY l, m) SELECT plane, chan, l, m, CASE WHEN coalesce(mask, false) THEN value ELSE 'nan'::DOUBLE END AS value FROM img LEFT JOIN pb USING (l, m)")(
    lambda spark, sf: coordinates.apply_mask_table(img(spark, sf), img(spark, sf).where("l > 1").groupBy("l", "m").agg((F.round(F.avg("value"), 9) > 0).alias("mask")))
)


@query(
    "image_coordinates",
    f"""WITH {IMG}, a AS (SELECT plane, chan, l, m, (l-4)*-2e-3 AS x, (m-4)*3e-3 AS y FROM img), b AS (SELECT *, sqrt(1-x*x-y*y) AS n FROM a)
 SELECT plane, chan, l, m, {r6('x')} AS l_rad, {r6('y')} AS m_rad, round(atan2(x, n*cos(0.7e0)-y*sin(0.7e0))+6.28e0-CASE WHEN atan2(x, n*cos(0.7e0)-y*sin(0.7e0))+6.28e0 >= 2*pi() THEN 2*pi() ELSE 0e0 END, 6)+0e0 AS ra,
 {r6('asin(y*cos(0.7e0)+n*sin(0.7e0))')} AS dec, {r6('(l-4)/(8*-2e-3)')} AS u_wave, {r6('(m-4)/(8*3e-3)')} AS v_wave, 1e9+chan*chan*1e6 AS freq, CASE WHEN chan < 9 THEN (2*chan+1)*1e6 ELSE 17e6 END AS channel_width FROM b""",
)
def image_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels about a centre next to the meridian, with channels that widen."""
    found = coordinates.image_coordinates(img(spark, sf), (8, 8), (-2e-3, 3e-3), (6.28, 0.7), [1e9 + k * k * 1e6 for k in range(10)])
    return rounded(found.drop("value"), "l_rad", "m_rad", "ra", "dec", "u_wave", "v_wave")


#: Fits with errors and covariances of each event, and axes of pixels that are not evenly spaced.
X_AXIS, Y_AXIS = [10.0 - 0.1 * i - 0.002 * i * i for i in range(40)], [0.05 * i + 0.001 * i * i for i in range(40)]
FITS = """fits AS (SELECT event_id, (event_id%37)+0.25e0 AS x0, (event_id%31)+0.5e0 AS y0, 3e0+event_id%5 AS a, 1e0+event_id%2 AS b, ((event_id%29)-14)/10e0 AS t,
 0.01e0*(1+event_id%3) AS x0e, 0.02e0 AS y0e, 0.05e0 AS ae, 0.03e0*(1+event_id%2) AS be, 0.01e0 AS te, 0.0004e0*((event_id%3)-1) AS ab FROM events)"""


@query(
    "fit_world_errors",
    f"""WITH {FITS}, w AS (SELECT *, 10-0.1e0*x0-0.002e0*(floor(x0)*floor(x0)+(x0-floor(x0))*(2*floor(x0)+1)) AS wx, 0.05e0*y0+0.001e0*(floor(y0)*floor(y0)+(y0-floor(y0))*(2*floor(y0)+1)) AS wy,
 -0.1e0-0.002e0*(2*floor(x0)+1) AS dx, 0.05e0+0.001e0*(2*floor(y0)+1) AS dy, cos(t) AS c, sin(t) AS s FROM fits),
 q AS (SELECT *, (a*a*c*c+b*b*s*s)*dx*dx AS xx, (a*a*s*s+b*b*c*c)*dy*dy AS yy, (a*a-b*b)*c*s*dx*dy AS xy FROM w),
 z AS (SELECT *, sqrt(pow((xx-yy)/2,2)+xy*xy) AS r, [2*a*c*c*dx*dx, 2*b*s*s*dx*dx, -2*c*s*(a*a-b*b)*dx*dx] AS jx, [2*a*s*s*dy*dy, 2*b*c*c*dy*dy, 2*c*s*(a*a-b*b)*dy*dy] AS jy, [2*a*c*s*dx*dy, -2*b*c*s*dx*dy, (a*a-b*b)*(c*c-s*s)*dx*dy] AS jm FROM q),
 g AS (SELECT *, sqrt((xx+yy)/2+r) AS major, sqrt((xx+yy)/2-r) AS minor FROM z),
 j AS (SELECT *, list_transform([1,2,3], lambda i: ((jx[i]+jy[i])/2+((xx-yy)*(jx[i]-jy[i])/4+xy*jm[i])/r)/(2*major)) AS p, list_transform([1,2,3], lambda i: ((jx[i]+jy[i])/2-((xx-yy)*(jx[i]-jy[i])/4+xy*jm[i])/r)/(2*minor)) AS n,
 list_transform([1,2,3], lambda i: ((xx-yy)*jm[i]-xy*(jx[i]-jy[i]))/(4*r*r)) AS h FROM g)
 SELECT event_id, {r6('wx')} AS world_x, {r6('wy')} AS world_y, {r6('major')} AS world_fwhm_major, {r6('minor')} AS world_fwhm_minor, {r6('atan2(2*xy, xx-yy)/2')} AS world_theta, {r6('x0e*abs(dx)')} AS world_x_err, {r6('y0e*dy')} AS world_y_err,
 {r6('sqrt(pow(p[1]*ae,2)+pow(p[2]*be,2)+pow(p[3]*te,2)+2*p[1]*p[2]*ab)')} AS world_fwhm_major_err, {r6('sqrt(pow(n[1]*ae,2)+pow(n[2]*be,2)+pow(n[3]*te,2)+2*n[1]*n[2]*ab)')} AS world_fwhm_minor_err,
 {r6('sqrt(pow(h[1]*ae,2)+pow(h[2]*be,2)+pow(h[3]*te,2)+2*h[1]*h[2]*ab)')} AS world_theta_err FROM j""",
)
def fit_world_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Positions, widths and angles in world units, with their errors."""
    e = F.col("event_id")
    fits = table(spark, sf, "events").select(
        "event_id", (e % 37 + F.lit(0.25)).alias("x0"), (e % 31 + F.lit(0.5)).alias("y0"), (F.lit(3.0) + e % 5).alias("fwhm_major"), (F.lit(1.0) + e % 2).alias("fwhm_minor"), ((e % 29 - 14) / 10).alias("theta"),
        (F.lit(0.01) * (1 + e % 3)).alias("x0_err"), F.lit(0.02).alias("y0_err"), F.lit(0.05).alias("fwhm_major_err"), (F.lit(0.03) * (1 + e % 2)).alias("fwhm_minor_err"), F.lit(0.01).alias("theta_err"), (F.lit(0.0004) * (e % 3 - 1)).alias("cov_major_minor"),
    )
    names = ["world_x", "world_y", "world_fwhm_major", "world_fwhm_minor", "world_theta"]
    found = coordinates.to_world_axes(fits, X_AXIS, Y_AXIS).select("event_id", *names, *[f"{c}_err" for c in names])
    return rounded(found, *names, *[f"{c}_err" for c in names])


@query(
    "feather_planes",
    f"""WITH {IMG}, hi AS (SELECT plane, chan, l, m, value AS re, 0e0 AS im FROM img), lo AS (SELECT plane, chan, l, m, value*0.5e0+0.1e0 AS re, 0e0 AS im FROM img),
 a AS ({_dft_sql('hi', -1, '1e0')}), b AS ({_dft_sql('lo', -1, '1e0')}), w AS (SELECT a.plane, a.chan, a.l, a.m, exp(-(pi()*pi())/(4*ln(2e0))*(9*pow((a.l-4)/8e0,2)+4*pow((a.m-4)/8e0,2))) AS w, a.re, a.im, b.re AS re2, b.im AS im2
 FROM a JOIN b USING (plane, chan, l, m)), uv AS (SELECT plane, chan, l, m, ((1-w)*re+1.5e0*re2*w)/((1-w)+w) AS re, ((1-w)*im+1.5e0*im2*w)/((1-w)+w) AS im FROM w),
 f AS ({_dft_sql('uv', 1, '(1e0/64)')}) SELECT plane, chan, l, m, {r6('re')} AS value FROM f""",
)
def feather_planes(spark: SparkSession, sf: str) -> DataFrame:
    high = img(spark, sf)
    low = high.withColumn("value", F.col("value") * 0.5 + 0.1)
    return rounded(images.feather(high, low, 8, 3.0, 2.0, omega=1.5), "value")


BIG = IMG.replace("SELECT vec_id AS plane, label AS chan, ((i-1)//8)::INT AS l, ((i-1)%8)::INT AS m,", "SELECT vec_id//16 AS plane, 0 AS chan, ((vec_id%16)//4*8+(i-1)//8)::INT AS l, (vec_id%4*8+(i-1)%8)::INT AS m,")


def _big(spark: SparkSession, sf: str) -> DataFrame:
    """Sixteen embeddings at a time as a plane of 32 x 32 pixels; of the last plane some may be absent."""
    i = F.col("i")
    flat = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    l, m = F.expr("vec_id % 16 div 4 * 8 + i div 8"), F.col("vec_id") % 4 * 8 + i % 8
    return flat.select(F.expr("vec_id div 16").alias("plane"), F.lit(0).alias("chan"), l.cast("int").alias("l"), m.cast("int").alias("m"), F.col("x").cast("double").alias("value"))


def _lines_sql(source: str, axis: str, other: str, sign: int = 1) -> str:
    """The transform of 32 pixels along one axis, forward (1) or unnormalised back (-1)."""
    phase = f"({sign})*2*pi()*(k.range-16)*(x.{axis}-16)/32e0"
    return f"""SELECT x.plane, x.chan, x.{other}, k.range::INT AS {axis}, sum(x.re*cos({phase})+x.im*sin({phase})) AS re, sum(x.im*cos({phase})-x.re*sin({phase})) AS im
 FROM {source} x CROSS JOIN range(32) k GROUP BY ALL"""


@query("fft_strips", f"WITH {BIG}, {CX}, a AS ({_lines_sql('cx', 'm', 'l')}), b AS ({_lines_sql('a', 'l', 'm')}) SELECT plane, chan, l, m, {r6('re')} AS re, {r6('im')} AS im FROM b")
def fft_strips(spark: SparkSession, sf: str) -> DataFrame:
    """Planes transformed by strips of eight lines."""
    return rounded(tiles.fft_strips(_big(spark, sf), 32, strip=256), "re", "im")


@query(
    "feather_strips",
    f"""WITH {BIG}, hi AS (SELECT plane, chan, l, m, value AS re, 0e0 AS im FROM img), lo AS (SELECT plane, chan, l, m, value*0.5e0+0.1e0 AS re, 0e0 AS im FROM img),
 a1 AS ({_lines_sql('hi', 'm', 'l')}), a2 AS ({_lines_sql('a1', 'l', 'm')}), b1 AS ({_lines_sql('lo', 'm', 'l')}), b2 AS ({_lines_sql('b1', 'l', 'm')}),
 w AS (SELECT a2.*, b2.re AS re2, b2.im AS im2, exp(-(pi()*pi())/(4*ln(2e0))*(9*pow((a2.l-16)/32e0,2)+4*pow((a2.m-16)/32e0,2))) AS w FROM a2 JOIN b2 USING (plane, chan, l, m)),
 uv AS (SELECT plane, chan, l, m, ((1-w)*re+1.5e0*re2*w)/((1-w)+w) AS re, ((1-w)*im+1.5e0*im2*w)/((1-w)+w) AS im FROM w),
 c1 AS ({_lines_sql('uv', 'm', 'l', -1)}), c2 AS ({_lines_sql('c1', 'l', 'm', -1)}) SELECT plane, chan, l, m, {r6('re/1024e0')} AS value FROM c2""",
)
def feather_strips(spark: SparkSession, sf: str) -> DataFrame:
    """Two skies of large planes combined, by strips of eight lines."""
    high = _big(spark, sf)
    return rounded(tiles.feather_strips(high, high.withColumn("value", F.col("value") * 0.5 + 0.1), 32, 3.0, 2.0, 1.5, strip=256), "value")


# ---- selection -----------------------------------------------------------------------------------------------------
def _poly_sql(corners: tuple) -> str:
    out = "false"
    for (x0, y0), (x1, y1) in zip(corners, corners[1:] + corners[:1]):
        out = f"(({out}) <> ((({y0}e0) > m) <> (({y1}e0) > m) AND l < (({x1 - x0!r})::DOUBLE)*(m-{y0}e0)/(({y1 - y0!r})::DOUBLE)+{x0}e0))"
    return out


REGIONS = {
    "box": ("box[[1pix,2pix],[5pix,6pix]]", "l BETWEEN 1 AND 5 AND m BETWEEN 2 AND 6"),
    "centerbox": ("centerbox[[4pix,3pix],[3pix,4pix]]", "abs(l-4) <= 1.5e0 AND abs(m-3) <= 2"),
    "rotbox": ("rotbox[[4pix,4pix],[5pix,2.5pix]] theta_m=0.5rad", f"abs({_turn_sql(4, 4, 0.5)[0]}) <= 2.5e0 AND abs({_turn_sql(4, 4, 0.5)[1]}) <= 1.25e0"),
    "circle": ("circle[[4pix,4pix],2.5pix]", "(l-4)*(l-4)+(m-4)*(m-4) <= 6.250000001e0"),
    "annulus": ("annulus[[4pix,4pix],[1pix,3pix]]", "(l-4)*(l-4)+(m-4)*(m-4) BETWEEN 1 AND 9"),
    "ellipse": ("ellipse[[4pix,4pix],[3.3pix,1.7pix]] theta_m=0.3rad", f"pow({_turn_sql(4, 4, 0.3)[0]}/3.3e0,2)+pow({_turn_sql(4, 4, 0.3)[1]}/1.7e0,2) <= 1.000000001e0"),
    "poly": (
        "poly[[0.5pix,0.5pix],[6.5pix,1.5pix],[3.2pix,6.5pix]]",
        _poly_sql(((0.5, 0.5), (6.5, 1.5), (3.2, 6.5))),
    ),
}
for _shape, (_text, _sql) in REGIONS.items():
    query(f"select_{_shape}", f"WITH {IMG} SELECT plane, chan, l, m, value FROM img WHERE {_sql}")(lambda spark, sf, t=_text: img(spark, sf).where(selection.crtf(t)))
query("select_crtf_multi", f"WITH {IMG} SELECT plane, chan, l, m, value FROM img WHERE ({REGIONS['box'][1]} OR {REGIONS['circle'][1]}) AND NOT ({REGIONS['annulus'][1]})")(
    lambda spark, sf: img(spark, sf).where(selection.crtf("#CRTFv0\nglobal coord=pix\nbox[[1pix,2pix],[5pix,6pix]]\n+circle[[4pix,4pix],2.5pix]; -annulus[[4pix,4pix],[1pix,3pix]]"))
)
query("select_expr", f"WITH {IMG} SELECT plane, chan, l, m, value FROM img WHERE ((value > 0) <> (l > 3)) AND NOT (m < 2)")(
    lambda spark, sf: img(spark, sf).where(selection.expression("(bright ^ right) & ~low", {"bright": F.col("value") > 0, "right": F.col("l") > 3, "low": F.col("m") < 2}))
)
query("select_crtf_subtract_first", f"WITH {IMG} SELECT plane, chan, l, m, value FROM img WHERE ((false AND NOT ({REGIONS['annulus'][1]})) OR {REGIONS['box'][1]}) AND NOT ({REGIONS['circle'][1]})")(
    lambda spark, sf: img(spark, sf).where(selection.crtf("-annulus[[4pix,4pix],[1pix,3pix]]\nbox[[1pix,2pix],[5pix,6pix]]\n-circle[[4pix,4pix],2.5pix]"))
)
query("select_expr_nan", f"WITH {IMG} SELECT plane, chan, l, m, value FROM img WHERE NOT (CASE WHEN l = 3 OR m = 2 THEN false ELSE value > 0 END) AND NOT (l = 5)")(
    lambda spark, sf: img(spark, sf).where(
        selection.expression("~bright & ~null", {"bright": F.when(F.col("l") == 3, float("nan")).when(F.col("m") == 2, None).otherwise(F.when(F.col("value") > 0, 2.5).otherwise(0.0)), "null": F.col("l") == 5})
    )
)
query("apply_mask_table", f"WITH {IMG} SELECT plane, chan, l, m, CASE WHEN (l+m)%3 = 0 THEN value ELSE 'nan'::DOUBLE END AS value FROM img")(
    lambda spark, sf: selection.apply_select(img(spark, sf), spark.range(64).select((F.col("id") / 8).cast("int").alias("l"), (F.col("id") % 8).cast("int").alias("m")).withColumn("mask", (F.col("l") + F.col("m")) % 3 == 0))
)
query("apply_select_nan", f"WITH {IMG} SELECT plane, chan, l, m, CASE WHEN {REGIONS['circle'][1]} THEN value ELSE 'nan'::DOUBLE END AS value FROM img")(
    lambda spark, sf: selection.apply_select(img(spark, sf), selection.select_mask(REGIONS["circle"][0]))
)


# ---- deconvolution -------------------------------------------------------------------------------------------------
LINE = (0.0, 0.05, 0.1, 0.4, 1.0, 0.4, 0.1, 0.05)
PSF = np.outer(LINE, LINE)


def _clean_steps(rounds: int, allowed: str = "true", value: str = "value") -> str:
    """CLEAN unrolled; ``allowed`` pixels may hold components, NaN and masked ones come last."""
    steps = [f"r0 AS (SELECT plane, chan, l, m, {value} AS value, 0e0 AS model FROM img), h AS (SELECT range::INT AS i, [{','.join(f'{x}e0' for x in LINE)}][range+1] AS x FROM range(8))"]
    order = f"(CASE WHEN ({allowed}) AND NOT isnan(value) THEN abs(value) ELSE -1 END, -(l*65536+m))"
    for k in range(rounds):
        steps.append(f"p{k} AS (SELECT plane, arg_max(l, {order}) AS pl, arg_max(m, {order}) AS pm, arg_max(value, {order})*0.1e0 AS g FROM r{k} GROUP BY plane)")
        steps.append(
            f"r{k + 1} AS (SELECT r.plane, r.chan, r.l, r.m, r.value-coalesce(p.g*a.x*b.x,0e0) AS value, r.model+CASE WHEN r.l = p.pl AND r.m = p.pm THEN p.g ELSE 0e0 END AS model "
            f"FROM r{k} r JOIN p{k} p USING (plane) LEFT JOIN h a ON a.i = r.l-p.pl+4 LEFT JOIN h b ON b.i = r.m-p.pm+4)"
        )
    return f"{IMG}, {', '.join(steps)}"


def _clean_sql(rounds: int, allowed: str = "true", value: str = "value") -> str:
    return f"WITH {_clean_steps(rounds, allowed, value)} SELECT plane, chan, l, m, {r6('model')} AS model, {r6('value')} AS residual FROM r{rounds}"


for _n in (1, 3):
    query(f"clean_{_n}iter", _clean_sql(_n))(lambda spark, sf, n=_n: rounded(deconvolution.deconvolve(img(spark, sf), PSF, 0.1, n).drop("iterations"), "model", "residual"))
query("clean_masked", _clean_sql(3, "abs(l-4) <= 2 AND l <> m"))(
    lambda spark, sf: rounded(deconvolution.deconvolve(img(spark, sf), PSF, 0.1, 3, mask=(F.abs(F.col("l") - 4) <= 2) & (F.col("l") != F.col("m"))).drop("iterations"), "model", "residual")
)
query("clean_box", _clean_sql(3, "l BETWEEN 2 AND 5 AND m BETWEEN 1 AND 6"))(
    lambda spark, sf: rounded(deconvolution.deconvolve(img(spark, sf), PSF, 0.1, 3, box=(2, 6, 1, 7)).drop("iterations"), "model", "residual")
)
query("clean_nan", _clean_sql(3, value="CASE WHEN (l+m)%5 = 0 THEN 'nan'::DOUBLE ELSE value END"))(
    lambda spark, sf: rounded(deconvolution.deconvolve(img(spark, sf).withColumn("value", F.when((F.col("l") + F.col("m")) % 5 == 0, float("nan")).otherwise(F.col("value"))), PSF, 0.1, 3).drop("iterations"), "model", "residual")
)


query("clean_tiles", _clean_sql(5).replace(IMG, BIG))(
    lambda spark, sf: rounded(tiles.clean_tiles(_big(spark, sf), PSF, (32, 32), 0.1, 5, tile=16, candidates=256).drop("iterations"), "model", "residual")
)


def _psf_planes(spark: SparkSession, sf: str) -> DataFrame:
    """One point spread function a channel, for all of its planes."""
    i, line = F.col("id"), F.array(*[F.lit(x) for x in LINE])
    at = img(spark, sf).select("chan").distinct().crossJoin(F.broadcast(spark.range(64)))
    at = at.select(F.lit(0).cast("long").alias("plane"), "chan", (i / 8).cast("int").alias("l"), (i % 8).cast("int").alias("m"))
    return at.withColumn("value", F.get(line, F.col("l")) * F.get(line, F.col("m")))


query("clean_psf_by_channel", _clean_sql(3))(
    lambda spark, sf: rounded(deconvolution.deconvolve(img(spark, sf), _psf_planes(spark, sf), 0.1, 3).drop("iterations"), "model", "residual")
)


def _full_clean_sql(niter: int, threshold: float) -> str:
    """CLEAN as a recursion over lists of 64 pixels, a row a plane and iteration."""
    sizes = "list_transform(r, lambda x: abs(x))"
    line = f"[{','.join(f'{x}e0' for x in LINE)}]"
    at = lambda i, p: f"CASE WHEN {i}-{p}+4 BETWEEN 0 AND 7 THEN {line}[{i}-{p}+5] ELSE 0e0 END"
    return f"""WITH RECURSIVE {IMG}, planes AS (SELECT plane, chan, list(value ORDER BY l, m) AS r FROM img GROUP BY plane, chan),
 s AS (SELECT plane, chan, 0 AS it, r, list_transform(r, lambda x: 0e0) AS mdl FROM planes UNION ALL
 SELECT plane, chan, it+1, list_transform(range(64), lambda i: r[i+1]-g*({at('i//8', 'p//8')})*({at('i%8', 'p%8')})), list_transform(range(64), lambda i: mdl[i+1]+CASE WHEN i = p THEN g ELSE 0e0 END)
 FROM (SELECT *, 0.1e0*r[p+1] AS g FROM (SELECT *, list_position({sizes}, list_max({sizes}))-1 AS p FROM s WHERE it < {niter})) WHERE abs(r[p+1]) >= {threshold}e0),
 fin AS (SELECT plane, chan, max(it) AS it, arg_max(r, it) AS r, arg_max(mdl, it) AS mdl FROM s GROUP BY plane, chan)
 SELECT plane, chan, (i//8)::INT AS l, (i%8)::INT AS m, {r6('mdl[i+1]')} AS model, {r6('r[i+1]')} AS residual, it::BIGINT AS iterations FROM fin CROSS JOIN (SELECT range AS i FROM range(64))"""


@query("clean_full", _full_clean_sql(100, 0.1))
def clean_full(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(deconvolution.deconvolve(img(spark, sf), PSF, 0.1, 100, 0.1), "model", "residual")


_STATS = "abs(l-4) <= 2 AND l <> m"


@query(
    "deconvolve_stats",
    f"""WITH {_clean_steps(3, _STATS)}, before AS (SELECT plane, chan, max(abs(value)) FILTER ({_STATS}) AS start_peakres, max(abs(value)) AS start_peakres_nomask, count(*) FILTER ({_STATS}) AS masksum FROM r0 GROUP BY plane, chan),
 after AS (SELECT plane, chan, max(abs(value)) FILTER ({_STATS}) AS peakres, max(abs(value)) AS peakres_nomask, sum(model) AS model_flux FROM r3 GROUP BY plane, chan)
 SELECT plane, chan, {r6('start_peakres')} AS start_peakres, {r6('start_peakres_nomask')} AS start_peakres_nomask, masksum, 0e0 AS start_model_flux, {r6('peakres')} AS peakres, {r6('peakres_nomask')} AS peakres_nomask,
 {r6('model_flux')} AS model_flux, 3::BIGINT AS iter_done, 0.4e0 AS max_psf_sidelobe FROM before JOIN after USING (plane, chan)""",
)
def deconvolve_stats(spark: SparkSession, sf: str) -> DataFrame:
    mask = (F.abs(F.col("l") - 4) <= 2) & (F.col("l") != F.col("m"))
    found = deconvolution.deconvolve_stats(img(spark, sf), PSF, mask, niter=3, sidelobe=fitting.main_lobe(PSF)[1])
    return rounded(found, "start_peakres", "start_peakres_nomask", "peakres", "peakres_nomask", "model_flux")


LAST = f"last AS (SELECT chan, pol, arg_max(peakres, cycle) AS peakres, arg_max(masksum, cycle) AS masksum, sum(iter_done) AS iterations, arg_max(model_flux, cycle) AS model_flux, arg_max(max_psf_sidelobe, cycle) AS max_psf_sidelobe FROM ret_log GROUP BY chan, pol)"


def _rl(column: str, sql: str):
    """Sums of fractions depend on their order in the last digit, so they are rounded."""
    whole = column != "model_flux"
    found = lambda spark, sf: deconvolution.summary(ret_log(spark, sf)).select(column)
    query(f"retlog_{column}", f"WITH {RET_LOG}, {LAST} SELECT {sql if whole else r6(sql)} AS {column} FROM last")(found if whole else lambda spark, sf: rounded(found(spark, sf), column))


_rl("peakres", "coalesce(max(abs(peakres)) FILTER (masksum <> 0), 0e0)")
_rl("masksum", "sum(masksum)::BIGINT")
_rl("iterations", "sum(iterations)::BIGINT")
_rl("model_flux", "sum(model_flux)")
_rl("max_psf_sidelobe", "max(max_psf_sidelobe)")


def _logs(spark: SparkSession, sf: str) -> list[DataFrame]:
    log = ret_log(spark, sf)
    return [log.where("cycle % 2 = 0 or chan < 2"), log.where("cycle % 2 = 1 and chan >= 2")]


query(
    "retlog_merge_update", f"WITH {RET_LOG} SELECT *, 0 AS seq FROM ret_log WHERE cycle%2=0 OR chan<2 UNION ALL SELECT *, 1 AS seq FROM ret_log WHERE cycle%2=1 AND chan>=2"
)(lambda spark, sf: deconvolution.merge_logs(_logs(spark, sf), "update"))
query(
    "retlog_merge_latest",
    f"WITH {RET_LOG}, u AS (SELECT *, 0 AS seq FROM ret_log WHERE cycle%2=0 OR chan<2 UNION ALL SELECT *, 1 AS seq FROM ret_log WHERE cycle%2=1 AND chan>=2) SELECT * FROM u QUALIFY seq = max(seq) OVER (PARTITION BY chan, pol)",
)(lambda spark, sf: deconvolution.merge_logs(_logs(spark, sf), "latest"))
query(
    "convergence_history",
    f"WITH {RET_LOG} SELECT chan, pol, cycle, (sum(iter_done) OVER (PARTITION BY chan, pol ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS cum_iter, abs(peakres) AS peakres, model_flux AS flux FROM ret_log",
)(lambda spark, sf: deconvolution.convergence(ret_log(spark, sf)))
query(
    "cycle_controls",
    f"WITH {RET_LOG}, {LAST} SELECT chan, pol, 500 AS cycleniter, greatest(greatest(least(max_psf_sidelobe*1.5e0, 0.8e0), 0.05e0)*abs(peakres), 0.1e0) AS cyclethreshold FROM last",
)(lambda spark, sf: deconvolution.cycle_limits(deconvolution.last_of(ret_log(spark, sf)), deconvolution.IterationController(niter=500, threshold=0.1, cyclefactor=1.5)))


# ---- visibilities and calibration ----------------------------------------------------------------------------------
OLD, NEW = (1.0, 0.5), (1.0002, 0.5001)


def _shift_sql() -> str:
    r = calibration.rotation(OLD, NEW)
    s, c, sd, cd = math.sin(OLD[0]), math.cos(OLD[0]), math.sin(OLD[1]), math.cos(OLD[1])
    d = np.array([[-s, c, 0.0], [-sd * c, -sd * s, cd], [cd * c, cd * s, sd]]) @ (calibration.direction(*OLD) - calibration.direction(*NEW))
    k = [f"({float(x)!r}::DOUBLE)" for x in d]
    turned = [f"{r6('+'.join(f'{a}*({float(r[i, j])!r}::DOUBLE)' for j, a in enumerate('uvw')))} AS {'uvw'[i]}" for i in range(3)]
    p = f"(2*pi()*(u*{k[0]}+v*{k[1]}+w*{k[2]})*freq/299792458e0)"
    return f"WITH {VIS} SELECT event_id, {', '.join(turned)}, {r6(f're*cos({p})-im*sin({p})')} AS re, {r6(f're*sin({p})+im*cos({p})')} AS im FROM vis"


@query("phase_shift", _shift_sql())
def phase_shift(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(calibration.phase_shift(vis(spark, sf), OLD, NEW).select("event_id", "u", "v", "w", "re", "im"), "u", "v", "w", "re", "im")


@query(
    "spectral_interp",
    f"""WITH {VIS}, s AS (SELECT pol, ant1, freq, sum(weight) AS value FROM vis GROUP BY ALL), st AS (SELECT pol, ant1, freq AS f0, value AS v0, lead(freq) OVER w AS f1, lead(value) OVER w AS v1,
 row_number() OVER w AS k, count(*) OVER (PARTITION BY pol, ant1) AS n FROM s WINDOW w AS (PARTITION BY pol, ant1 ORDER BY freq)), o AS (SELECT 1.398e9+range*5e6 AS out_freq FROM range(8))
 SELECT pol, ant1, out_freq, {r6('coalesce(max(CASE WHEN out_freq >= f0 AND (out_freq < f1 OR (k = n-1 AND out_freq = f1)) THEN v0+(v1-v0)*(out_freq-f0)/(f1-f0) END), 0e0)')} AS value FROM st CROSS JOIN o WHERE f1 IS NOT NULL GROUP BY ALL""",
)
def spectral_interp(spark: SparkSession, sf: str) -> DataFrame:
    samples = vis(spark, sf).groupBy("pol", "ant1", "freq").agg(F.sum("weight").alias("value"))
    targets = spark.range(8).select((F.lit(1.398e9) + F.col("id") * 5e6).alias("out_freq"))
    return rounded(calibration.interpolate_channels(samples, ["pol", "ant1"], targets), "value")


@query(
    "fringe_spacings",
    f"WITH {VIS}, a AS (SELECT chan, pol, min(event_id//16%64) AS low, max(event_id//16%64) AS high, count(DISTINCT event_id//16%64) AS held FROM vis GROUP BY chan, pol) SELECT chan, pol, (high-low+1)::INT AS n, round(1e0/((high-low+1)*2.5e0)/8e0, 9) AS spacing FROM a",
)
def fringe_spacings(spark: SparkSession, sf: str) -> DataFrame:
    """The spacing of padded transforms over the times that each channel and polarisation has."""
    seen = vis(spark, sf).withColumn("t", F.expr("event_id div 16") % 64 * 2.5)
    n = F.col("t_n")
    return calibration.even_axis(seen, "t", ("chan", "pol")).select("chan", "pol", n.alias("n"), F.round(calibration.fourier_spacing(n, F.col("t_step")), 9).alias("spacing"))


def _fringe_vis(spark: SparkSession, sf: str) -> DataFrame:
    """The events as samples of baselines with antenna 0, in either order, with delays and phases by antenna; some flagged."""
    e = F.col("event_id")
    at = vis(spark, sf).select("event_id", (F.col("ant1") % 5 + 1).alias("ant"), (F.expr("event_id div 16") % 16 * 2.0).alias("t"), (F.lit(1.4e9) + e % 16 * 1e6).alias("freq"), (F.expr("event_id div 7") % 2).cast("int").alias("pol"), "weight", "flag")
    phase = F.lit(2 * math.pi) * (F.col("ant") * 1e-8 * (F.col("freq") - 1.4e9)) + 0.1 * F.col("ant")
    turn, noise = F.expr("event_id div 3") % 2 == 1, F.when(F.col("flag"), 2.0).otherwise(0.0)
    sign = F.when(turn, -1.0).otherwise(1.0)
    return at.select(
        F.when(turn, F.col("ant")).otherwise(F.lit(0)).cast("int").alias("ant1"), F.when(turn, F.lit(0)).otherwise(F.col("ant")).cast("int").alias("ant2"), "t", "freq", "pol", "weight", "flag",
        F.cos(sign * phase + noise).alias("re"), F.sin(sign * phase + noise).alias("im"),
    )


@query("fringe_fit")
def fringe_fit(spark: SparkSession, sf: str) -> DataFrame:
    return calibration.fringe_fit(_fringe_vis(spark, sf), 0)


#: The same where antenna 2 has no middle channels and antenna 3 no middle times, fitted by sums of the padded transform.
FRINGE_GAPS = f"""WITH {VIS}, e AS (SELECT (ant1%5+1)::INT AS ant, ((event_id//16)%16)::INT AS i, (event_id%16)::INT AS k, ((event_id//7)%2)::INT AS pol, weight, flag FROM vis),
 s AS (SELECT ant, pol, i, k, sum(CASE WHEN flag THEN 0e0 ELSE weight END) AS w, sum(CASE WHEN flag THEN 0e0 ELSE weight*weight END) AS w2, count(*) FILTER (NOT flag) AS n, 2*pi()*ant*1e-8*k*1e6+0.1e0*ant AS p
 FROM e WHERE NOT (ant = 2 AND k BETWEEN 4 AND 11) AND NOT (ant = 3 AND i BETWEEN 6 AND 9) GROUP BY ant, pol, i, k),
 f AS (SELECT ant, pol, i, q.range AS q, sum(w*cos(p-2*pi()*q.range*k/128e0)) AS re, sum(w*sin(p-2*pi()*q.range*k/128e0)) AS im FROM s, range(128) q GROUP BY ant, pol, i, q.range),
 t AS (SELECT ant, pol, q, r.range AS r, sum(re*cos(2*pi()*r.range*i/128e0)+im*sin(2*pi()*r.range*i/128e0)) AS re, sum(im*cos(2*pi()*r.range*i/128e0)-re*sin(2*pi()*r.range*i/128e0)) AS im FROM f, range(128) r GROUP BY ant, pol, q, r.range),
 best AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY ant, pol ORDER BY re*re+im*im DESC) = 1), total AS (SELECT ant, pol, sum(w) AS w, sum(w2) AS w2, sum(n) AS n FROM s GROUP BY ant, pol)
 SELECT ant, pol, {r6('atan2(im, re)')} AS phase, {r6('(CASE WHEN q < 64 THEN q ELSE q-128 END)/(16*1e6)/8*1e9')} AS delay_ns, {r6('(CASE WHEN r < 64 THEN r ELSE r-128 END)/(16*2e0)/8/1.4e9*1e15')} AS rate_fs,
 CASE WHEN sqrt(re*re+im*im)/w > 0.99e0 THEN 9999e0 ELSE round(pow(tan(pi()/2*sqrt(re*re+im*im)/w), 1.163e0)*sqrt(w/sqrt(w2/n)), 3) END AS snr FROM best JOIN total USING (ant, pol)
 UNION ALL SELECT DISTINCT 0, pol, 0e0, 0e0, 0e0, 1e9 FROM s"""


@query("fringe_fit_gaps", FRINGE_GAPS)
def fringe_fit_gaps(spark: SparkSession, sf: str) -> DataFrame:
    ant, chan, time = F.col("ant1") + F.col("ant2"), F.rint((F.col("freq") - 1.4e9) / 1e6), F.col("t") / 2
    seen = _fringe_vis(spark, sf).where(~((ant == 2) & chan.between(4, 11)) & ~((ant == 3) & time.between(6, 9)))
    found = calibration.fringe_fit(seen, 0)
    return found.select("ant", "pol", tidy(F.col("phase")).alias("phase"), tidy(F.col("delay") * 1e9).alias("delay_ns"), tidy(F.col("rate") * 1e15).alias("rate_fs"), F.round("snr", 3).alias("snr"))


CAL = "cal AS (SELECT a.range::INT AS ant, p.range::INT AS pol, 0.1e0*a.range AS phase, 1e-9*(a.range+p.range) AS delay, 1e-14*a.range AS rate FROM range(8) a, range(2) p)"


def _apply_sql(one: str, two: str) -> str:
    return f"""WITH {VIS}, v AS (SELECT *, (event_id%4)::INT AS corr FROM vis), {CAL},
 ph AS (SELECT x.event_id, x.re, x.im, coalesce(a.phase+2*pi()*(a.delay*(freq-1.4e9)+1.4e9*a.rate*(t-1.7e9)),0e0)-coalesce(b.phase+2*pi()*(b.delay*(freq-1.4e9)+1.4e9*b.rate*(t-1.7e9)),0e0) AS p
 FROM v x LEFT JOIN cal a ON a.ant = ant1 AND a.pol = {one} LEFT JOIN cal b ON b.ant = ant2 AND b.pol = {two}) SELECT event_id, {r6('re*cos(p)-im*sin(p)')} AS re, {r6('re*sin(p)+im*cos(p)')} AS im FROM ph"""


def _cal(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    cal = spark.range(16).select((i / 2).cast("int").alias("ant"), (i % 2).cast("int").alias("pol"))
    return cal.withColumns({"phase": 0.1 * F.col("ant"), "delay": 1e-9 * (F.col("ant") + F.col("pol")), "rate": 1e-14 * F.col("ant")})


@query("apply_cal", _apply_sql("x.pol", "x.pol"))
def apply_cal(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(calibration.apply_calibration(vis(spark, sf), _cal(spark), 1.4e9, 1.7e9).select("event_id", "re", "im"), "re", "im")


@query("apply_cal_full", _apply_sql("x.corr//2", "x.corr%2"))
def apply_cal_full(spark: SparkSession, sf: str) -> DataFrame:
    """All four correlations, each end by its own receptor."""
    samples = vis(spark, sf).withColumn("pol", (F.col("event_id") % 4).cast("int"))
    return rounded(calibration.apply_calibration(samples, _cal(spark), 1.4e9, 1.7e9, correlations=4).select("event_id", "re", "im"), "re", "im")


query("empty_solutions", f"WITH {VIS} SELECT DISTINCT unnest([ant1, ant2]) AS ant, pol, 'nan'::DOUBLE AS phase, 'nan'::DOUBLE AS delay, 'nan'::DOUBLE AS rate, 'nan'::DOUBLE AS snr FROM vis")(
    lambda spark, sf: calibration.empty_solutions(vis(spark, sf))
)
query("cross_correlations", f"WITH {VIS} SELECT event_id FROM vis WHERE ant1 <> ant2")(lambda spark, sf: vis(spark, sf).where("ant1 <> ant2").select("event_id"))
query("reference_baselines", f"WITH {VIS} SELECT event_id FROM vis WHERE ant1 = 3 OR ant2 = 3")(lambda spark, sf: vis(spark, sf).where("ant1 = 3 or ant2 = 3").select("event_id"))
query("ps_summary", f"WITH {VIS} SELECT chan, pol, count(*) AS n, count(*) FILTER (flag) AS flagged, min(freq) AS freq FROM vis GROUP BY chan, pol")(
    lambda spark, sf: sources.processing_set_summary(vis(spark, sf))
)


# ---- fitting -------------------------------------------------------------------------------------------------------
@query("gauss_fit")
def gauss_fit(spark: SparkSession, sf: str) -> DataFrame:
    scene = images.make_gauss2d(img(spark, sf).withColumn("value", F.col("value") * 0.01), 2.0, 3.5, 4.0, 4.0, 2.5, 0.4)
    return fitting.fit_multi_gaussian2d(scene, 1)


@query("psf_fit")
def psf_fit(spark: SparkSession, sf: str) -> DataFrame:
    scene = images.make_gauss2d(img(spark, sf).withColumn("value", F.col("value") * 0.01), 1.0, 4.0, 4.0, 4.0, 3.0, 0.4)
    return fitting.psf_fit(scene)


_MODEL_SQL = "(0.1e0*exp(-((l-4)*(l-4)+(m-4)*(m-4))/8e0))"
query("fit_variance_explained", f"WITH {IMG} SELECT plane, chan, {r6(f'1-var_pop(value-{_MODEL_SQL})/var_pop(value)')} AS variance_explained FROM img GROUP BY plane, chan")(
    lambda spark, sf: rounded(fitting.variance_explained(img(spark, sf), 0.1 * F.exp(-((F.col("l") - 4) * (F.col("l") - 4) + (F.col("m") - 4) * (F.col("m") - 4)) / 8.0)), "variance_explained")
)
query(
    "fit_seeds",
    f"WITH {IMG} SELECT plane, chan, arg_max(l, (value, -(l*65536+m))) AS x0, arg_max(m, (value, -(l*65536+m))) AS y0, max(value)-median(value) AS amp, median(value) AS offset FROM img GROUP BY plane, chan",
)(lambda spark, sf: fitting.peak_seeds(img(spark, sf)))


_CORRECTION = f"corr AS ({_spheroidal_sql(f'SELECT range::INT AS k, abs(range-{N // 2})/{N // 2}e0 AS x FROM range({N})')})"


def _image_sql(re: str, im: str) -> str:
    """Cells, the inverse transform along one axis and then the other, weights and the kernel's correction."""
    turn = lambda a, b: f"2*pi()*({a}-{N // 2})*({b}-{N // 2})/{N}e0"
    one, two = turn("iv", "x.k"), turn("iu", "x.k")
    return f"""WITH {_cells_sql("chan", re, im)}, {_CORRECTION}, offs AS (SELECT (range-51)::INT AS o FROM range(103)),
 tot AS (SELECT o, sum(kv) AS s FROM offs CROSS JOIN steps JOIN kernel ON k = abs(100*d+o) GROUP BY o), sw AS (SELECT chan, pol, sum(wt*a.s*b.s) AS sum_weight FROM cells JOIN tot a ON a.o = uo JOIN tot b ON b.o = vo GROUP BY chan, pol),
 half AS (SELECT chan, pol, iu, x.k AS m, sum(re*cos({one})-im*sin({one})) AS re, sum(re*sin({one})+im*cos({one})) AS im FROM cell CROSS JOIN corr x GROUP BY ALL),
 sky AS (SELECT chan, pol, x.k AS l, m, sum(re*cos({two})-im*sin({two})) AS re FROM half CROSS JOIN corr x GROUP BY ALL)
 SELECT chan, pol, l, m, {r6('re/sum_weight/greatest(a.g*b.g, 1e-4)')} AS value FROM sky JOIN sw USING (chan, pol) JOIN corr a ON a.k = l JOIN corr b ON b.k = m"""


# ---- whole images --------------------------------------------------------------------------------------------------
@query("dirty_image", _image_sql("re*wt", "im*wt"))
def dirty_image(spark: SparkSession, sf: str) -> DataFrame:
    """Gridding, inverse transform, kernel correction and division by the weights: the image of every channel."""
    return rounded(imaging.dirty_image(vis(spark, sf), N, CELL).withColumnRenamed("plane", "pol"), "value")


@query("psf_image", _image_sql("wt", "0e0"))
def psf_image(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(imaging.point_spread(vis(spark, sf), N, CELL).withColumnRenamed("plane", "pol"), "value")


@query(
    "psf_main_lobe",
    f"""WITH RECURSIVE z AS ({_image_sql("wt", "0e0")}), peak AS (SELECT chan, pol, arg_max(l, (value, -(l*65536+m))) AS l, arg_max(m, (value, -(l*65536+m))) AS m, max(value) AS top FROM z GROUP BY chan, pol),
 above AS (SELECT z.chan, z.pol, z.l, z.m FROM z JOIN peak USING (chan, pol) WHERE value >= 0.5e0*top),
 lobe AS (SELECT chan, pol, l, m FROM peak UNION SELECT a.chan, a.pol, a.l, a.m FROM lobe b JOIN above a ON a.chan = b.chan AND a.pol = b.pol AND abs(a.l-b.l)+abs(a.m-b.m) = 1)
 SELECT z.pol AS plane, z.chan, {r6('max(abs(CASE WHEN lobe.l IS NULL THEN value ELSE 0e0 END))')} AS sidelobe FROM z LEFT JOIN lobe USING (chan, pol, l, m) GROUP BY z.pol, z.chan""",
)
def psf_main_lobe(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(imaging.sidelobes(imaging.point_spread(vis(spark, sf), N, CELL)), "sidelobe")


def _four(spark: SparkSession, sf: str) -> DataFrame:
    """Four correlations of every event, unlike each other, with flags and weights of their own."""
    p = F.col("pol")
    return hands(spark, sf, 4).withColumns({"re": F.col("re") * (1 + p), "im": F.col("im") - p * F.lit(0.5)})


def _stokes_image_sql() -> str:
    """Correlations gridded, each over its weights, mixed into Stokes parameters, then transformed."""
    whole = _image_sql("re*wt", "im*wt").replace(f"WITH {VIS}", f"WITH {_hands_sql(4)}", 1)
    whole = whole.replace("), vis AS MATERIALIZED (SELECT * REPLACE (", "), vis AS MATERIALIZED (SELECT * REPLACE (re*(1+p.range) AS re, im-p.range*0.5e0 AS im, ", 1)
    whole = whole.replace("CASE WHEN flag THEN 0e0 ELSE weight END AS wt", "CASE WHEN flag OR isnan(weight) THEN 0e0 ELSE weight END AS wt", 1)
    one = lambda c: ", ".join(f"coalesce(max({c}/sum_weight) FILTER (pol = {p}), 0e0) AS {c}{p}" for p in range(4))
    mixed = f""" four AS (SELECT chan, iu, iv, {one('re')}, {one('im')} FROM cell JOIN sw USING (chan, pol) GROUP BY chan, iu, iv),
 st AS (SELECT chan, s.range::INT AS pol, iu, iv, CASE s.range WHEN 0 THEN re0+re3 WHEN 1 THEN re0-re3 WHEN 2 THEN re1+re2 ELSE im1-im2 END AS re,
 CASE s.range WHEN 0 THEN im0+im3 WHEN 1 THEN im0-im3 WHEN 2 THEN im1+im2 ELSE re2-re1 END AS im FROM four, range(4) s), half AS ("""
    whole = whole.replace(" half AS (", mixed, 1).replace("FROM cell CROSS JOIN corr x", "FROM st CROSS JOIN corr x", 1)
    return whole.replace("re/sum_weight/greatest", "re/greatest", 1).replace("FROM sky JOIN sw USING (chan, pol)", "FROM sky", 1)


@query("stokes_image", _stokes_image_sql())
def stokes_image(spark: SparkSession, sf: str) -> DataFrame:
    """Dirty images of I, Q, U and V from four correlations."""
    return rounded(imaging.stokes_image(_four(spark, sf), "linear", 4, N, CELL).withColumnRenamed("plane", "pol"), "value")


def _mixed_sql(rows) -> str:
    terms = lambda row: "+".join([f"({complex(c).real!r}::DOUBLE)*v{p}" for p, c in enumerate(row) if complex(c).real] or ["0e0"])
    wide = ", ".join(f"coalesce(max(value) FILTER (plane%4 = {p}), 0e0) AS v{p}" for p in range(4))
    parts = " UNION ALL ".join(f"SELECT sky, {i} AS pol, l, m, {r6(terms(row))} AS value FROM w" for i, row in enumerate(rows))
    return f"WITH {IMG}, w AS (SELECT plane//4 AS sky, l, m, {wide} FROM img GROUP BY ALL) {parts}"


def _quads(spark: SparkSession, sf: str) -> DataFrame:
    """Four images at a time as the planes of one sky."""
    return img(spark, sf).select(F.expr("plane div 4").alias("sky"), (F.col("plane") % 4).cast("int").alias("pol"), "l", "m", "value")


QUAD = ("sky", "l", "m")
query("image_corr_to_stokes", _mixed_sql(images.stokes_rows("circular", 4)))(lambda spark, sf: rounded(images.image_corr_to_stokes(_quads(spark, sf), "circular", at=QUAD, plane="pol"), "value"))
query("image_stokes_to_corr", _mixed_sql(images.correlation_rows("linear", 4)))(lambda spark, sf: rounded(images.image_stokes_to_corr(_quads(spark, sf), "linear", at=QUAD, plane="pol"), "value"))
CUSTOM = ((0.25, 0.75, 0, 0), (0, -1, 2, 0.5))
query("image_custom_mix", _mixed_sql(CUSTOM))(lambda spark, sf: rounded(images.mix_planes(_quads(spark, sf), CUSTOM, QUAD, "pol"), "value"))


#: Sources as flux and place (radians), near the image's centre.
SOURCES = [(1.0, 10 * CELL, -6 * CELL), (0.5, -8 * CELL, 4 * CELL)]


def _synthetic_sql() -> str:
    phase = lambda l, m: f"(2*pi()*(u*({l!r}::DOUBLE)+v*({m!r}::DOUBLE))*freq/299792458e0)"
    parts = [(f"{f}e0*cos({phase(l, m)})", f"{f}e0*sin({phase(l, m)})") for f, l, m in SOURCES]
    re, im = ("+".join(p[k] for p in parts) for k in (0, 1))
    return f"WITH {VIS} SELECT event_id, {r6(f'({re})*(chan+1)')} AS re, {r6(f'({im})*(chan+1)')} AS im FROM vis"


@query("synthetic_visibilities", _synthetic_sql())
def synthetic_visibilities(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(imaging.synthetic_visibilities(vis(spark, sf), SOURCES, by_channel=True).select("event_id", "re", "im"), "re", "im")


def _model_image(spark: SparkSession) -> DataFrame:
    """The sources as pixels of both polarisations and all four channels."""
    i = F.col("id")
    pixels = F.explode(F.array(*[F.struct(F.lit(round(l / CELL) + N // 2).alias("l"), F.lit(round(m / CELL) + N // 2).alias("m"), F.lit(f).alias("value")) for f, l, m in SOURCES]))
    return spark.range(8).select((i % 2).cast("int").alias("plane"), (i / 2).cast("int").alias("chan"), pixels.alias("p")).select("plane", "chan", "p.l", "p.m", "p.value")


def _predict_sql() -> str:
    """The model's transform as a direct sum over its pixels, and the kernel-weighted mean around every sample."""
    pixels = ", ".join(f"({round(l / CELL) + N // 2}, {round(m / CELL) + N // 2}, {f}e0)" for f, l, m in SOURCES)
    turn = f"2*pi()*((i.k-{N // 2})*(l-{N // 2})+(k.k-{N // 2})*(m-{N // 2}))/{N}e0"
    grid = f"""{_CORRECTION}, src AS (SELECT l, m, value/greatest(a.g*b.g, 1e-4) AS value FROM (VALUES {pixels}) t(l, m, value) JOIN corr a ON a.k = l JOIN corr b ON b.k = m),
 one AS (SELECT i.k AS iu, k.k AS iv, sum(value*cos({turn})) AS gr, sum(-value*sin({turn})) AS gi FROM src CROSS JOIN corr i CROSS JOIN corr k GROUP BY ALL),
 model AS (SELECT c.range::INT AS chan, p.range::INT AS pol, iu::INT AS iu, iv::INT AS iv, gr, gi FROM one CROSS JOIN range(4) c CROSS JOIN range(2) p)"""
    sql = _degrid_sql("LEFT JOIN model g ON g.chan=spots.chan AND g.pol=spots.pol AND g.iu=ui+a.d AND g.iv=vi+b.d", "coalesce(g.gr,0e0)", "coalesce(g.gi,0e0)").replace(MODEL, grid)
    return sql.replace(" AS re, round(coalesce(mean.im", " AS model_re, round(coalesce(mean.im").replace(" AS im FROM vis LEFT JOIN mean", " AS model_im FROM vis LEFT JOIN mean")


@query("predict_model", _predict_sql())
def predict_model(spark: SparkSession, sf: str) -> DataFrame:
    """A model image transformed and degridded at every sample."""
    return rounded(imaging.predict(vis(spark, sf), _model_image(spark), N, CELL).select("event_id", "model_re", "model_im"), "model_re", "model_im")


@query("imaging_cycles")
def imaging_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """The model that major and minor cycles find for visibilities of two sources."""
    samples = imaging.synthetic_visibilities(vis(spark, sf), SOURCES)
    control = deconvolution.IterationController(niter=200, nmajor=3, threshold=0.05, cycleniter=60)
    return imaging.major_cycles(samples, control, N, CELL, 0.2)[0]


@query("imaging_cycles_stokes")
def imaging_cycles_stokes(spark: SparkSession, sf: str) -> DataFrame:
    """The Stokes model that major and minor cycles find for four correlations of two sources, one of them polarised."""
    seen = imaging.synthetic_visibilities(hands(spark, sf, 4), SOURCES)
    share = F.element_at(F.array(*[F.lit(x) for x in (0.6, 0.1, 0.1, 0.4)]), F.col("pol") + 1)  # I 1, Q 0.2, U 0.2
    seen = seen.withColumns({"re": F.col("re") * share, "im": F.col("im") * share})
    control = deconvolution.IterationController(niter=2000, nmajor=3, threshold=0.05, cycleniter=60)
    return imaging.major_cycles(seen, control, N, CELL, 0.2, feed="linear")[0]


@query(
    "primary_beam_alma",
    f"""WITH {IMG}, px AS (SELECT chan, a.range::INT AS l, b.range::INT AS m, sqrt(pow((a.range-4)*4e-5,2)+pow((b.range-4)*4e-5,2))*(2*pi()*(1e11+chan*1e9)/299792458e0)*(10.7e0/2) AS r FROM (SELECT DISTINCT chan FROM img), range(8) a, range(8) b),
 pb AS (SELECT chan, l, m, CASE WHEN r = 0 THEN 1e0 ELSE pow((2*{_j1_sql('r', 75)}/r-2*(0.75e0/10.7e0)*{_j1_sql('r*(0.75e0/10.7e0)', 75)}/r)/(1-pow(0.75e0/10.7e0,2)),2) END AS pb FROM px)
 SELECT plane, img.chan, l, m, {r6('value*pb')} AS value FROM img JOIN pb USING (chan, l, m)""",
)
def primary_beam_alma(spark: SparkSession, sf: str) -> DataFrame:
    """Images times the beam of their channel's frequency."""
    seen = img(spark, sf)
    channels = max(r.chan for r in seen.select("chan").distinct().collect()) + 1  # a row a channel
    return rounded(coordinates.apply_pb_table(seen, imaging.primary_beam(spark, 8, 4e-5, [1e11 + k * 1e9 for k in range(channels)])), "value")


FIELDS = {0: (1.0, 0.5), 1: (1.0003, 0.5), 2: (1.0, 0.5002)}
CENTRE = (1.0001, 0.5001)


@query(
    "phase_gradients",
    f"""WITH f AS (SELECT event_id, 1e0+(event_id%7)*1e-4 AS ra, 0.5e0+(event_id%5)*1e-4 AS dec FROM events) SELECT event_id, {r6(f'-2*pi()*(cos(dec)*sin(ra-{CENTRE[0]}e0)/5e-5)/640e0')} AS gx,
 {r6(f'-2*pi()*((sin(dec)*cos({CENTRE[1]}e0)-cos(dec)*sin({CENTRE[1]}e0)*cos(ra-{CENTRE[0]}e0))/5e-5)/640e0')} AS gy FROM f""",
)
def phase_gradients(spark: SparkSession, sf: str) -> DataFrame:
    """The gradients of kernels for the direction of every event."""
    e = F.col("event_id")
    gx, gy = imaging.gradient_of(CENTRE, F.lit(1.0) + (e % 7) * F.lit(1e-4), F.lit(0.5) + (e % 5) * F.lit(1e-4), N, CELL, 10)
    return table(spark, sf, "events").select("event_id", tidy(gx).alias("gx"), tidy(gy).alias("gy"))


def _kernel_classes(spark: SparkSession) -> DataFrame:
    """Large and small dishes by pairs; the patterns are wide enough for the small grid."""
    rows = [(0, 10.7, 10.7, 0.75, 0.75, 1e11), (1, 10.7, 6.7, 0.75, 0.75, 1e11), (2, 6.7, 6.7, 0.75, 0.75, 1e11)]
    return spark.createDataFrame(rows, "cf int, dish1 double, dish2 double, blockage1 double, blockage2 double, freq double")


def _seen_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The classes of baselines, by dishes and channel, that the data hold."""
    dish = lambda small, k: F.when(F.col("small") >= k, 6.7).otherwise(10.7)
    seen = vis(spark, sf).select((F.col("ant1") % 2 + F.col("ant2") % 2).alias("small"), "chan").distinct()
    return seen.select(
        (F.col("small") * 4 + F.col("chan")).cast("int").alias("cf"), dish("small", 2).alias("dish1"), dish("small", 1).alias("dish2"), F.lit(0.75).alias("blockage1"), F.lit(0.75).alias("blockage2"), (F.lit(1e11) + F.col("chan") * F.lit(1e9)).alias("freq")
    )


@query("convolution_kernels")
def convolution_kernels(spark: SparkSession, sf: str) -> DataFrame:
    return imaging.convolution_kernels(_seen_classes(spark, sf), N, CELL, 10)


@query("mosaic_image")
def mosaic_image(spark: SparkSession, sf: str) -> DataFrame:
    """Three fields and three classes of baselines in one image."""
    fields = imaging.field_table(spark, FIELDS, CENTRE, N, CELL)
    samples = imaging.to_common_centre(_classes(spark, sf).withColumn("field", (F.col("event_id") % 3).cast("int")), fields)
    return imaging.mosaic_image(samples, imaging.class_kernels(_kernel_classes(spark), N, CELL), N, CELL)


def _kernel_support_sql() -> str:
    """Kernels of the classes that the data hold: the squared beam along an axis down to its cut, and what the centred kernel
    sums to."""
    r = "sqrt(pow((a.range-32)*5e-5,2)+pow((b.range-32)*5e-5,2))"
    arg = lambda d, x="1e0": f"(SELECT avg(cos(2*pi()*g.range/120e0-(r*s{d}*{x})*sin(2*pi()*g.range/120e0))) FROM range(120) g)"
    names = {"10.7e0": "L", "6.7e0": "S"}
    scale = {n: f"(2*pi()*freq/299792458e0/2*{d})" for d, n in names.items()}
    radial = "SELECT freq, r, " + ", ".join(f"{scale[n]} AS s{n}" for n in names.values()) + " FROM freqs, rs"
    bessel = "SELECT *, " + ", ".join(f"{arg(n)} AS j{n}, {arg(n, f'(0.75e0/{d})')} AS k{n}" for d, n in names.items()) + f" FROM ({radial})"
    pattern = lambda d, n: f"CASE WHEN r = 0 THEN 1e0 ELSE (2*j{n}/(r*s{n})-2*(0.75e0/{d})*k{n}/(r*s{n}))/(1-pow(0.75e0/{d},2)) END"
    volts = "SELECT freq, r, " + ", ".join(f"{pattern(d, n)} AS v{n}" for d, n in names.items()) + f" FROM ({bessel})"
    return f"""WITH {VIS}, freqs AS (SELECT DISTINCT 1e11+chan*1e9 AS freq, chan FROM vis), cls AS (SELECT DISTINCT (ant1%2+ant2%2)*4+chan AS cf, 1e11+chan*1e9 AS freq, ant1%2+ant2%2 AS small FROM vis),
 px AS (SELECT a.range::INT AS l, b.range::INT AS m, round({r}, 15) AS r FROM range(64) a, range(64) b), rs AS (SELECT DISTINCT r FROM px), volts AS MATERIALIZED ({volts}),
 beam AS MATERIALIZED (SELECT cf, l, m, CASE small WHEN 0 THEN vL*vL WHEN 1 THEN vL*vS ELSE vS*vS END AS b FROM cls JOIN volts USING (freq) JOIN px USING (r)),
 rowsum AS (SELECT cf, l, sum(b*b) AS b2 FROM beam GROUP BY cf, l), axis AS (SELECT cf, s.range AS s, sum(b2*cos(2*pi()*s.range/10e0*(l-32)/64e0)) AS k FROM rowsum, range(321) s GROUP BY cf, s.range),
 top AS (SELECT cf, k AS top FROM axis WHERE s = 0), cutoff AS (SELECT cf, min(s) AS s FROM axis JOIN top USING (cf) WHERE k <= 0.02e0*top GROUP BY cf),
 sup AS (SELECT cf, (floor(0.5e0+s/10e0)::INT+1)*2+1 AS support FROM cutoff),
 foot AS (SELECT cf, support, l.range AS l, (SELECT sum(cos(2*pi()*(d.range-support//2)*(l.range-32)/64e0)) FROM range(64) d WHERE d.range < support) AS c, (SELECT sum(cos(2*pi()*e.range/10e0*(l.range-32)/64e0)) FROM range(-320, 321) e
 WHERE e.range >= -least((support+1)*5, support//2*10+6) AND e.range < least((support+1)*5, support//2*10+7)) AS w FROM sup, range(64) l)
 SELECT b.cf::INT AS cf, any_value(x.support)::INT AS support, {r6('sum(b*x.c*y.c)/(sum(b*x.w*y.w)/100)')} AS total FROM beam b JOIN foot x ON x.cf = b.cf AND x.l = b.l JOIN foot y ON y.cf = b.cf AND y.l = b.m GROUP BY b.cf"""


@query("kernel_support", _kernel_support_sql())
def kernel_support(spark: SparkSession, sf: str) -> DataFrame:
    """Width of the kernels of each class of baselines and channel in the data, and the sum of the centred one."""
    kernels = imaging.class_kernels(_seen_classes(spark, sf), N, CELL).where("uo = 0 and vo = 0")
    return kernels.select("cf", "support", tidy(F.aggregate("k", F.lit(0.0), lambda a, b: a + b)).alias("total"))


@query("mosaic_psf", ORACLE["mosaic_grid"].replace("re*weight AS re, im*weight AS im", "weight AS re, 0e0 AS im", 1))
def mosaic_psf(spark: SparkSession, sf: str) -> DataFrame:
    """Weights alone, gridded with the kernel of each class."""
    out = gridding.mosaic_grid(_classes(spark, sf), cf_kernels(spark), N, CELL, do_psf=True)
    return out.withColumns({c: tidy(F.col(c), 8) for c in ("re", "im")})


_FACTOR = "(1e0+((event_id%7)-3)*1e-3)"


@query(
    "frame_conversion",
    f"""WITH {VIS}, s AS (SELECT pol, ant1, event_id%7 AS t, freq*{_FACTOR} AS freq, avg(re) AS re, avg(im) AS im, avg(CASE WHEN flag THEN 0e0 ELSE weight END) AS weight FROM vis GROUP BY ALL),
 st AS (SELECT *, lead(freq) OVER w AS f1, lead(re) OVER w AS re1, lead(im) OVER w AS im1, lead(weight) OVER w AS w1, row_number() OVER w AS k, count(*) OVER (PARTITION BY t, pol, ant1) AS n FROM s WINDOW w AS (PARTITION BY t, pol, ant1 ORDER BY freq)),
 o AS (SELECT 1.398e9+range*5e6 AS out_freq FROM range(8)), x AS (SELECT *, out_freq >= freq AND (out_freq < f1 OR (k = n-1 AND out_freq = f1)) AS inside, (out_freq-freq)/(f1-freq) AS a FROM st CROSS JOIN o WHERE f1 IS NOT NULL)
 SELECT t, pol, ant1, out_freq, {r6('coalesce(max(CASE WHEN inside THEN re+(re1-re)*a END), 0e0)')} AS re, {r6('coalesce(max(CASE WHEN inside THEN im+(im1-im)*a END), 0e0)')} AS im,
 {r6('coalesce(max(CASE WHEN inside THEN weight+(w1-weight)*a END), 0e0)')} AS weight FROM x GROUP BY t, pol, ant1, out_freq""",
)
def frame_conversion(spark: SparkSession, sf: str) -> DataFrame:
    samples = vis(spark, sf).withColumn("t", F.col("event_id") % 7)
    factors = spark.range(7).select(F.col("id").alias("t"), (1 + (F.col("id") - 3) * 1e-3).alias("factor"))
    targets = spark.range(8).select((F.lit(1.398e9) + F.col("id") * 5e6).alias("out_freq"))
    return rounded(calibration.convert_frame(samples, factors, targets, ("t", "pol", "ant1")), "re", "im", "weight")


#: Events towards directions of their own.
RA, DEC = "radians((event_id%360)::DOUBLE)", "radians((event_id%120-60)::DOUBLE)"


def _velocity_sql(frame: str, site: str, t: str, ra: str, dec: str) -> str:
    """The velocity towards a source, spelled out in SQL."""
    lon, lat, height = frames.SITES[site]
    cy = f"(({t}-{frames.EPOCH!r}::DOUBLE+{frames.TERRESTRIAL!r}::DOUBLE)/3155760000e0)"
    of_date = lambda pair: f"radians({pair[0]!r}::DOUBLE+{cy}*({pair[1]!r}::DOUBLE-{frames.PRECESSION!r}::DOUBLE))"
    anomaly = f"radians({frames.SUN_ANOMALY[0]!r}::DOUBLE+{cy}*{frames.SUN_ANOMALY[1]!r}::DOUBLE)"
    centre = "+".join(f"{c!r}::DOUBLE*sin({k}*{anomaly})" for k, c in enumerate(frames.CENTRE, 1))
    sun, e = f"({of_date(frames.SUN_LONGITUDE)}+radians({centre}))", f"({frames.ECCENTRICITY[0]!r}::DOUBLE+{cy}*({frames.ECCENTRICITY[1]!r}::DOUBLE))"
    around = [f"{s}::DOUBLE*{{}}({of_date((a, b))})" for s, a, b in frames.SHIFTS]
    x = f"({frames.ORBIT_SPEED!r}::DOUBLE*(sin({sun})-{e}*sin({of_date(frames.PERIHELION)}))+" + "+".join(c.format("sin") for c in around) + ")"
    y = f"({frames.ORBIT_SPEED!r}::DOUBLE*({e}*cos({of_date(frames.PERIHELION)})-cos({sun}))-" + "-".join(c.format("cos") for c in around) + ")"
    turn = f"(2*pi()*({frames.ROTATION[0]!r}::DOUBLE+({t}-{frames.EPOCH!r}::DOUBLE)/86400*{frames.ROTATION[1]!r}::DOUBLE)+radians({lon!r}::DOUBLE))"
    speed = f"({frames.SPIN!r}::DOUBLE*({frames.RADIUS!r}::DOUBLE/sqrt(pow(cos(radians({lat!r}::DOUBLE)),2)+pow((1-1/298.257223563e0)*sin(radians({lat!r}::DOUBLE)),2))+{height!r}::DOUBLE)*cos(radians({lat!r}::DOUBLE)))"
    tilt, (sx, sy, sz) = f"radians({frames.OBLIQUITY!r}::DOUBLE)", frames.sun_velocity(frame)
    return (
        f"(({x}-{speed}*sin({turn})+({sx!r}::DOUBLE))*cos({dec})*cos({ra})+({y}*cos({tilt})+{speed}*cos({turn})+({sy!r}::DOUBLE))*cos({dec})*sin({ra})+({y}*sin({tilt})+({sz!r}::DOUBLE))*sin({dec}))"
    )


def _frame(frame: str, site: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        e = F.col("event_id")
        speed = frames.velocity(F.col("t"), site, F.radians((e % 360).cast("double")), F.radians((e % 120 - 60).cast("double")), frame)
        return vis(spark, sf).select("event_id", speed.alias("v")).select("event_id", F.round("v", 3).alias("velocity"), F.round((calibration.lsr_factor(F.col("v")) - 1) * 1e9, 2).alias("shift_ppb"))

    return run


for _frame_name, _site in (("lsrk", "ALMA"), ("lsrd", "VLA"), ("bary", "MEERKAT"), ("galacto", "GBT")):
    query(
        f"frame_{_frame_name}",
        f"WITH {VIS}, x AS (SELECT event_id, {_velocity_sql(_frame_name, _site, 't', RA, DEC)} AS v FROM vis) SELECT event_id, round(v, 3) AS velocity, round((sqrt((1-v/299792458e0)/(1+v/299792458e0))-1)*1e9, 2) AS shift_ppb FROM x",
    )(_frame(_frame_name, _site))


#: Hours of a year in which one field is seen, so that frequencies move by some of the narrow channels.
YEAR = "1.7e9+(event_id%7)*4.5e6"


@query(
    "frame_regrid_lsrk",
    f"""WITH {VIS}, n AS (SELECT * REPLACE ({YEAR} AS t, 1.4e9+chan*2e5 AS freq) FROM vis), m AS (SELECT * REPLACE (freq*sqrt((1-speed/299792458e0)/(1+speed/299792458e0)) AS freq) FROM (SELECT *, {_velocity_sql("lsrk", "VLA", "t", "1.1e0", "0.4e0")} AS speed FROM n)),
 s AS (SELECT pol, ant1, t, freq, avg(re) AS re, avg(im) AS im, avg(CASE WHEN flag THEN 0e0 ELSE weight END) AS weight FROM m GROUP BY ALL),
 st AS (SELECT *, lead(freq) OVER w AS f1, lead(re) OVER w AS re1, lead(im) OVER w AS im1, lead(weight) OVER w AS w1, row_number() OVER w AS k, count(*) OVER (PARTITION BY t, pol, ant1) AS n FROM s WINDOW w AS (PARTITION BY t, pol, ant1 ORDER BY freq)),
 o AS (SELECT k.range::INT AS k_out, low+k.range*(high-low)/4 AS out_freq FROM (SELECT min(freq) AS low, max(freq) AS high FROM m), range(4) k),
 x AS (SELECT *, out_freq >= freq AND (out_freq < f1 OR (st.k = n-1 AND out_freq = f1)) AS inside, (out_freq-freq)/(f1-freq) AS a FROM st CROSS JOIN o WHERE f1 IS NOT NULL)
 SELECT t, pol, ant1, round(out_freq, 1) AS out_freq, round(coalesce(max(CASE WHEN inside THEN re+(re1-re)*a END), 0e0), 3)+0e0 AS re, round(coalesce(max(CASE WHEN inside THEN im+(im1-im)*a END), 0e0), 3)+0e0 AS im,
 round(coalesce(max(CASE WHEN inside THEN weight+(w1-weight)*a END), 0e0), 3)+0e0 AS weight FROM x GROUP BY t, pol, ant1, out_freq""",
)
def frame_regrid_lsrk(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    samples = vis(spark, sf).withColumns({"t": F.lit(1.7e9) + (e % 7) * F.lit(4.5e6), "freq": F.lit(1.4e9) + F.col("chan") * F.lit(2e5)})
    found = frames.to_frame(samples, "VLA", 1.1, 0.4, "lsrk", keys=("t", "pol", "ant1"))
    return found.withColumns({"out_freq": F.round("out_freq", 1), **{c: tidy(F.col(c), 3) for c in ("re", "im", "weight")}})


@query(
    "chunk_plan",
    f"WITH {VIS} SELECT (chan//2)::INT AS chunk, min(chan) AS first, count(DISTINCT chan) AS channels, count(*) AS n, count(*) FILTER (flag) AS flagged FROM vis GROUP BY ALL",
)
def chunk_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Visibilities by chunks of channels, of the size that a task's memory allows."""
    return sources.chunk_summary(vis(spark, sf), sources.chunk_size(32, 64 * 64, 2, 1, 4))


AXES_CUT = {"l": 32, "m": 32}


@query(
    "chunk_axes",
    f"""WITH {BIG} SELECT (l*4//32)::INT AS chunk_l, (m*3//32)::INT AS chunk_m, min(l) AS first_l, max(l) AS last_l, min(m) AS first_m, max(m) AS last_m, count(*) AS n,
 {r6('sum(value)')} AS flux, {r6('max(abs(value))')} AS peak FROM img GROUP BY ALL""",
)
def chunk_axes(spark: SparkSession, sf: str) -> DataFrame:
    """Planes cut along both axes by what a task's memory allows: what each chunk holds."""
    counts = sources.chunk_counts(AXES_CUT, 1, 3, 1 << 20)
    ends = [f(axis).alias(f"{name}_{axis}") for axis in AXES_CUT for name, f in (("first", F.min), ("last", F.max))]
    out = sources.with_chunks(_big(spark, sf), AXES_CUT, counts).groupBy("chunk_l", "chunk_m")
    return rounded(out.agg(*ends, F.count("*").alias("n"), F.sum("value").alias("flux"), F.max(F.abs("value")).alias("peak")), "flux", "peak")


@query("cube_image")
def cube_image(spark: SparkSession, sf: str) -> DataFrame:
    """From samples to a cube in one call: weights, padding, point spread function, sky, primary beam and fitted beam."""
    return imaging.make_cube(vis(spark, sf), 48, CELL, "briggs", 0.5, 4 / 3, "ALMA", 0.1)


def _timed(spark: SparkSession, sf: str) -> DataFrame:
    return vis(spark, sf).withColumn("ts", F.timestamp_micros(F.round(F.col("t") * 1e6).cast("long")))


def _hourly_sql() -> str:
    """The cells of each hour."""
    whole = _cells_sql("chan", "re*wt", "im*wt").replace("AS chan, pol, ui+a.d", "AS chan, pol, floor(t/3600)::BIGINT*3600 AS start, wt, ui+a.d", 1)
    return whole.replace("SELECT chan, pol, iu, iv, sum(k*re) AS re, sum(k*im) AS im FROM foot", "SELECT start, chan, pol, iu, iv, sum(k*re) AS re, sum(k*im) AS im, sum(k*wt) AS w FROM foot", 1)


query("stream_grid_cells", f"WITH {_hourly_sql()} SELECT start, chan, pol, iu, iv, {r6('re')} AS re, {r6('im')} AS im, {r6('w')} AS w FROM cell")(
    lambda spark, sf: rounded(grid_windows(_timed(spark, sf), n=N, cell=CELL), "re", "im", "w")
)
query("stream_grid_merged", ORACLE["grid_standard_cube"])(lambda spark, sf: rounded(merged(grid_windows(_timed(spark, sf), "6 hours", n=N, cell=CELL))[0], "re", "im"))
query(
    "stream_grid",
    "SELECT (epoch(time_bucket(INTERVAL '1 hour', ts)))::BIGINT AS start, (event_id%4)::INT AS chan, sum(0.25e0*(1+event_id%5)) AS weight, count(*) AS n FROM events GROUP BY ALL",
)(lambda spark, sf: weight_windows(table(spark, sf, "events")))
