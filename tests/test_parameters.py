import pytest

from skyloom.plans.parameters import DataGroups, DeconvolutionParams, GridParams, NormParams, WeightParams, standard


@pytest.mark.parametrize(
    "make",
    [
        lambda: GridParams(0, 1e-5), lambda: GridParams(64, 1e-5, 11), lambda: GridParams(64, 1e-5, chan_mode="line"), lambda: WeightParams("super"), lambda: WeightParams("briggs", 3),
        lambda: NormParams("flat"), lambda: NormParams(pb_limit=2), lambda: DeconvolutionParams(0.0), lambda: DeconvolutionParams(niter=0), lambda: DeconvolutionParams(threshold=-1),
    ],
)
def test_bad_parameters(make):
    with pytest.raises(ValueError):
        make()


def test_good_parameters():
    assert GridParams(500, 1e-6).padded == 600 and WeightParams("briggs", -2).robust == -2


def test_data_groups(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 0.5)], "re double, im double, mre double, mim double, weight double")
    base = DataGroups({"base": {"correlated_data": ("re", "im"), "weight": ("weight",)}})
    more = base.derive("base", "model", {"correlated_data": ("mre", "mim")}, df, overwrite=True)
    row = standard(df, more, "model").first()
    assert (row.re, row.im, row.weight) == (3.0, 4.0, 0.5) and "base" in more.groups and "model" not in base.groups
    for bad in (lambda: base.derive("base", "base", {}, df), lambda: base.derive("base", "x", {"flag": ("re",)}, df), lambda: base.derive("base", "x", {"sky": ()}, df)):
        with pytest.raises(ValueError):
            bad()
    for bad in (lambda: base.columns("none", "weight"), lambda: base.columns("base", "flag"), lambda: more.columns("model", "correlated_data", df.drop("mre"))):
        with pytest.raises(KeyError):
            bad()
