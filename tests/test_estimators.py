"""Estimators against independent NumPy computations and pyspark.ml on random small tables."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import functions as F

from gramwise.operators import effects as C, iterate as I, moments as M, semisup as P, shift as H, sparse as X
from gramwise.operators.sampling import kfold
from gramwise.operators.score import fit_groups
from gramwise.operators.sliced import sliced_semisupervised


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 240
    x = rng.normal(size=(n, 3))
    pdf = pd.DataFrame(x, columns=["a", "b", "c"])
    pdf["id"] = np.arange(n)
    pdf["y"] = 1.0 + x[:, 0] - 0.5 * x[:, 1] ** 2 + rng.normal(size=n)
    pdf["bin"] = (rng.uniform(size=n) < 1 / (1 + np.exp(-x[:, 0]))).astype(int)
    pdf["lab"] = np.arange(n) % 3 == 0
    pdf["g"] = np.where(np.arange(n) % 5 == 0, "u", "v")
    pdf["fold"] = np.arange(n) % 4
    pdf["w"] = rng.uniform(-0.2, 2.0, size=n)
    return pdf, spark.createDataFrame(pdf).persist()


def design(pdf, cols=("a", "b")):
    return np.column_stack([np.ones(len(pdf)), *[pdf[c] for c in cols]])


def test_linear_and_logistic_match_ml(data):
    pdf, df = data
    ready = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    lin = LinearRegression(labelCol="y", solver="normal").fit(ready)
    assert M.least_squares(df, ["a", "b"], "y").first()["theta"] == pytest.approx([lin.intercept, *lin.coefficients], abs=1e-6)
    glm = GeneralizedLinearRegression(family="binomial", labelCol="bin", tol=1e-12).fit(ready)
    fit = I.logistic_regression(df, ["a", "b"], "bin").first()
    assert fit["status"] == "ok" and fit["theta"] == pytest.approx([glm.intercept, *glm.coefficients], abs=1e-6)


def test_block_moments_equal_explicit_sums(data, monkeypatch):
    _, df = data
    named = df.withColumnRenamed("g", "grp")
    plain = {r["grp"]: r for r in M.moments(named, ["a", "b"], ["y", "bin"], "w", ["grp"], cross=True).collect()}
    monkeypatch.setattr(M, "EXPLICIT_SUMS", 0)
    block = {r["grp"]: r for r in M.moments(named, ["a", "b"], ["y", "bin"], "w", ["grp"], cross=True).collect()}
    for key, row in plain.items():
        for c in ("g", "b", "rr"):
            assert block[key][c] == pytest.approx(row[c])
        assert block[key]["n"] == row["n"]


def test_out_of_fold_fit_is_the_fit_without_the_fold(data):
    pdf, df = data
    fits = {r["fold"]: r["theta"] for r in M.out_of_fold_least_squares(df, ["a", "b"], "y", "fold").collect()}
    for f, theta in fits.items():
        rest = pdf[pdf.fold != f]
        assert theta == pytest.approx(np.linalg.lstsq(design(rest), rest.y, rcond=None)[0])


def test_singular_fits_are_reported(data):
    _, df = data
    row = M.least_squares(df.withColumn("a2", F.col("a") * 2), ["a", "a2"], "y").first()
    assert row["theta"] is None and row["status"] == "singular"


def test_quantile_regression_matches_vertex_search(spark, data):
    pdf, _ = data
    small = pdf.head(60)
    x, y, tau = design(small, ["a"]), small.y.to_numpy(), 0.3
    best = min(
        (np.linalg.solve(x[[i, j]], y[[i, j]]) for i, j in itertools.combinations(range(60), 2)),
        key=lambda t: np.maximum(tau * (y - x @ t), (tau - 1) * (y - x @ t)).sum(),
    )
    theta, status = I.quantile_regression(spark.createDataFrame(small), ["a"], "y", tau)
    assert status == "ok" and theta == pytest.approx(best, abs=0.01)


def test_weighted_quantile(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 2.0)], "y double, w double")
    assert I.weighted_quantile(df, "y", 0.5, "w").first()["quantile"] == 2.0
    assert I.exact_median(df, "y").first()["median"] == 2.0


def test_descent_agrees_with_newton(data):
    _, df = data
    theta, _, _ = I.gradient_descent(df, ["a"], "bin", [0.0, 0.0], 3.0, "logistic", max_iter=60)
    assert theta == pytest.approx(I.logistic_regression(df, ["a"], "bin").first()["theta"], abs=1e-3)


def _brute_errors(pdf, theta, order, factor):
    lab, un = pdf[pdf.lab], pdf[~pdf.lab]
    basis = lambda p: np.column_stack([np.ones(len(p)), *[p[c] ** k for k in range(1, order + 1) for c in ("a", "b")]])
    z, zu, x, xu = basis(lab), basis(un), design(lab), design(un)
    s = (x @ theta - lab.y.to_numpy())[:, None] * x
    w1 = np.zeros_like(s)
    for f in range(4):
        on = (lab.fold == f).to_numpy()
        coef = np.linalg.lstsq(z[~on], s[~on], rcond=None)[0]
        w1[on] = s[on] - factor * z[on] @ coef
    w2 = factor * zu @ np.linalg.lstsq(z, s, rcond=None)[0]
    n, m = len(lab), len(un)
    v = w1.T @ w1 / n + (n / m) * w2.T @ w2 / m
    h = np.linalg.inv(xu.T @ xu / m)
    return np.sqrt(np.diag(h @ v @ h) / n)


@pytest.mark.parametrize("order,factor", [(2, None), (1, 1.0)])
def test_sandwich_errors(data, order, factor):
    pdf, df = data
    theta = np.array([1.0, 0.9, -0.1])
    got = P.sandwich_errors(df, ["a", "b"], "y", "lab", "fold", theta, order, factor=factor)
    share = 1 - pdf.lab.mean() if factor is None else factor
    assert got == pytest.approx(_brute_errors(pdf, theta, order, share))


def test_perturbed_hessian_is_near_the_density_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=20000)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": x + rng.normal(size=20000)}))
    h = P.perturbed_hessian(df, ["x"], "y", [0.0, 1.0], 0.5, draws=400)
    assert h == pytest.approx(np.eye(2) * 0.3989, abs=0.06)


def test_order_criteria(data):
    pdf, df = data
    lab = pdf[pdf.lab]
    scores = [F.col("y"), F.col("y") * F.col("a")]
    got = {r["order"]: r["criterion"] for r in P.order_criteria(df.where("lab"), ["a", "b"], scores, 2).collect()}
    s = np.column_stack([lab.y, lab.y * lab.a])
    n, d = s.shape
    for t in (1, 2):
        z = np.column_stack([np.ones(n), *[lab[c] ** k for k in range(1, t + 1) for c in ("a", "b")]])
        r2 = (s - z @ np.linalg.lstsq(z, s, rcond=None)[0]) ** 2
        free = n - 2 * t - 1
        sigma2 = r2.sum(axis=0) / free
        extra = 0.0
        for j in range(d):
            c = np.linalg.inv(z.T @ z / n) @ (z.T @ (z * r2[:, [j]]) / n) / sigma2[j]
            extra += np.trace(c) - np.log(np.linalg.det(c))
        want = (d * free + n * np.log(sigma2).sum() + d * np.log(n) * 2 * t + extra) / n
        assert got[t] == pytest.approx(want)


def test_partial_information(data):
    pdf, df = data
    cols, lab = ["a", "b", "c"], pdf[pdf.lab]
    beta = []
    for j, c in enumerate(cols):
        rest = [k for k in cols if k != c]
        delta = np.linalg.lstsq(design(pdf, rest), pdf[c], rcond=None)[0]
        m = np.mean((pdf[c] - design(pdf, rest) @ delta) ** 2)
        u = ((lab[c] - design(lab, rest) @ delta) / m).to_numpy()
        cells = np.column_stack([np.ones(len(lab)), u, *[lab[k] * u - (1.0 if l == j else 0.0) for l, k in enumerate(cols)]])
        beta.append(np.linalg.lstsq(cells, lab.y * u, rcond=None)[0][0])
    want = [lab.y.mean() - lab[cols].mean().to_numpy() @ np.array(beta), *beta]
    assert P.partial_information(df, cols, "y", "lab") == pytest.approx(want)


def test_density_ratio_matches_moments(data):
    _, df = data
    ratio = P.density_ratio(df, ["a", "b"], "lab")
    assert not ratio.error
    row = df.where("lab").agg(F.avg(ratio.weight), F.avg(ratio.weight * F.col("a"))).first()
    assert row[0] == pytest.approx(1.0, abs=1e-6)
    assert row[1] == pytest.approx(df.where("not lab").agg(F.avg("a")).first()[0], abs=1e-6)


def test_debiased_equals_supervised_when_the_imputer_is_the_supervised_fit(data):
    pdf, df = data
    lab = pdf[pdf.lab]
    theta = np.linalg.lstsq(design(lab, ["a"]), lab.y, rcond=None)[0]
    rows = df.withColumn("h", theta[0] + theta[1] * F.col("a"))
    fits = {r["method"]: r["theta"] for r in P.debiased_linear(rows, ["a"], "y", "h", "lab").collect()}
    assert fits["debiased"] == pytest.approx(list(theta)) and fits["supervised"] == pytest.approx(list(theta))


def test_hard_and_fractional_imputation_differ_only_by_rounding_the_probability(data):
    _, df = data
    sure = df.withColumn("p", (F.col("a") > 0).cast("double"))
    one = {r["method"]: r["theta"] for r in P.debiased_logistic(sure, ["b"], "bin", "p", "lab").collect()}
    two = {r["method"]: r["theta"] for r in P.debiased_logistic(sure, ["b"], "bin", "p", "lab", mode="hard").collect()}
    assert one["debiased"] == pytest.approx(two["debiased"])


def test_calibrated_fit_is_plain_when_both_sides_agree(data):
    pdf, df = data
    twin = df.withColumn("lab", F.explode(F.array(F.lit(True), F.lit(False))))
    fit, cal = P.calibrated_fit(twin, ["a"], "y", "lab", order=2, c1=0.3)
    assert fit.first()["theta"] == pytest.approx(np.linalg.lstsq(design(pdf, ["a"]), pdf.y, rcond=None)[0])
    assert twin.where("lab").agg(F.avg(cal.weight)).first()[0] == pytest.approx(1.0)


def test_sliced_estimator_recovers_a_line(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2))
    pdf = pd.DataFrame({"id": np.arange(300), "a": x[:, 0], "b": x[:, 1], "y": 2 + x[:, 0] + 0.2 * rng.normal(size=300), "lab": np.arange(300) % 2 == 0})
    df = kfold(spark.createDataFrame(pdf), "id", 2, 1)
    fits = sliced_semisupervised(df, "id", ["a", "b"], "y", "lab", "fold", 2, slices=4, grid=(0.2, 0.5))
    for theta in fits.values():
        assert theta == pytest.approx([2, 1, 0], abs=0.2)


def test_mcp_path_solves_the_stationarity_conditions(data):
    pdf, df = data
    cols = ["a", "b", "c"]
    path = X.mcp_path(df, cols, "y", length=10).orderBy("idx").collect()
    x, y, n = pdf[cols].to_numpy(), pdf.y.to_numpy(), len(pdf)
    scale = np.sqrt((x**2).mean(axis=0))
    for row in path:
        b = np.array(row["beta"]) * scale
        gradient = (x / scale).T @ (y - x @ np.array(row["beta"])) / n
        lam = row["lambda"]
        for g, v in zip(gradient, b, strict=True):
            if v == 0:
                assert abs(g) <= lam + 1e-6
            else:
                assert g == pytest.approx(np.sign(v) * max(lam - abs(v) / X.CONCAVITY, 0.0), abs=1e-6)


def test_mcp_cross_validation_equals_refits(data):
    pdf, df = data
    cols = ["a", "b", "c"]
    path, best = X.mcp_cross_validated(df, cols, "y", "fold", length=6)
    rows = path.orderBy("idx").collect()
    lam = np.array([r["lambda"] for r in rows])
    scores = []
    for f in range(4):
        t, v = pdf[pdf.fold != f], pdf[pdf.fold == f]
        xt = t[cols].to_numpy()
        betas = X.mcp_coefficients(xt.T @ xt, xt.T @ t.y.to_numpy(), len(t), lam)
        scores.append([np.mean((v.y - v[cols].to_numpy() @ b) ** 2) for b in betas])
    assert [r["cv_mse"] for r in rows] == pytest.approx(np.mean(scores, axis=0))
    assert best == int(np.argmin(np.mean(scores, axis=0)))


def test_step_features_approach_the_exact_min_kernel(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"x": np.round(rng.uniform(size=120), 2)})
    pdf["y"] = np.sin(4 * pdf.x) + 0.1 * rng.normal(size=120)
    pdf["part"] = np.where(np.arange(120) % 3 == 0, "hold", np.where(np.arange(120) % 3 == 1, "fit", "target"))
    path = H.penalty_path(spark.createDataFrame(pdf), "part", H.step_features("x", [k / 100 for k in range(1, 101)], n=80), "y")
    fit, target = pdf[pdf.part == "fit"], pdf[pdf.part == "target"]
    k = lambda a, b: np.minimum(a.to_numpy()[:, None], b.to_numpy()[None, :]) / 80
    for j in (0, 5):
        dual = np.linalg.solve(k(fit.x, fit.x) + path.penalties[j] * np.eye(len(fit)), fit.y)
        want = np.mean((k(target.x, fit.x) @ dual - target.y) ** 2)
        got = path.table.where(F.col("idx") == j).first()["real"]
        assert got == pytest.approx(want, rel=1e-4)


def test_effect_learners_find_a_constant_effect(spark):
    rng = np.random.default_rng(8)
    n = 4000
    x = rng.normal(size=n)
    e = 1 / (1 + np.exp(-x))
    t = (rng.uniform(size=n) < e).astype(int)
    df = kfold(spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "x": x, "t": t, "y": x + 2.0 * t + 0.1 * rng.normal(size=n)})), "id", 2, 1).persist()
    found = {
        "single": C.single_learner(df, df, ["x"], "t", "y"),
        "two": C.two_learner(df, df, ["x"], "t", "y"),
        "cross": C.cross_learner(df, df, ["x"], "t", "y"),
        "robust": C.doubly_robust_learner(df, df, ["x"], "t", "y", "fold"),
        "residual": C.residual_learner(df, df, ["x"], "t", "y", "fold"),
        "weighted": C.residual_learner(df, df, ["x"], "t", "y", "fold", final=C.LinearLearner()),
        "model": C.two_learner(df, df, ["x"], "t", "y", C.EstimatorLearner(LinearRegression())),
    }
    for name, out in found.items():
        assert out.agg(F.avg("tau_hat")).first()[0] == pytest.approx(2.0, abs=0.05), name


def test_user_model_learner(data):
    _, df = data

    class Constant:
        def __init__(self, value):
            self.value = value

        def predict(self, x):
            return np.full(len(x), self.value)

    learner = C.ModelLearner(lambda rows, xs, y, w: Constant(rows.agg(F.avg(y)).first()[0]))
    out = C.two_learner(df, df, ["a"], "bin", "y", learner)
    want = df.agg(F.avg(F.when(F.col("bin") == 1, F.col("y"))) - F.avg(F.when(F.col("bin") == 0, F.col("y")))).first()[0]
    assert out.agg(F.avg("tau_hat"), F.stddev_pop("tau_hat")).first()[0] == pytest.approx(want)


def test_oversized_groups_are_refused(data):
    _, df = data

    def fit(pdf):
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "m": [pdf["y"].mean()]})

    rows, schema = df.select("g", "y"), "g string, m double"
    want = {r["g"]: r["m"] for r in rows.groupBy("g").agg(F.avg("y").alias("m")).collect()}
    for bound in (None, 10**6):
        assert {r["g"]: r["m"] for r in fit_groups(rows, ["g"], fit, schema, bound).collect()} == pytest.approx(want)
    with pytest.raises(ValueError):
        fit_groups(rows, ["g"], fit, schema, most_rows=100)
