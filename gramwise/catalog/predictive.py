"""Predictive quantiles, their scores and the calibration reports."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from gramwise.catalog.support import Book, long_form, long_sql, q, r, table, u
from gramwise.operators import intervals as V
from gramwise.operators.ranks import attach, level_quantiles, other_folds_quantiles
from gramwise.operators.sampling import kfold
from gramwise.plans import calibration as K
from gramwise.session import scratch_path
from gramwise.sources.readers import read_results
from gramwise.sources.writers import write_results

BOOK = Book()
LEVELS = V.interval_levels()
_COLS = ["cov_50", "cov_60", "cov_70", "cov_80", "cov_90", "cov_95", "width_95", "crps"]

# Fold 0 is judged by the quantiles of the other folds of its event type.
_SPLIT = f"ev AS (SELECT event_id, event_type, value, CAST(floor({u('event_id', 81)} * 4) AS INTEGER) AS fold FROM events)"
_EMP = f"em AS (SELECT event_type, [{', '.join(f'quantile_disc(value, {a})' for a in LEVELS)}] AS q FROM ev WHERE fold > 0 GROUP BY event_type)"
_GAU = f"ga AS (SELECT event_type, [{', '.join(f'avg(value) + sqrt(var_pop(value) + 0.25) * ({NormalDist().inv_cdf(a)!r})' for a in LEVELS)}] AS q FROM ev WHERE fold > 0 GROUP BY event_type)"
_A = "[" + ", ".join(repr(a) for a in LEVELS) + "]::DOUBLE[]"
_INNER = [i + 1 for i, a in enumerate(LEVELS) if a in V.INTERIOR]
_CRPS = "0.1 * (" + " + ".join(f"greatest({LEVELS[i - 1]} * (value - q[{i}]), ({LEVELS[i - 1]} - 1) * (value - q[{i}]))" for i in _INNER) + ")"
_PIT = f"CASE WHEN value <= q[1] THEN 0.0 WHEN value >= q[{len(LEVELS)}] THEN 1.0 ELSE ({_A})[k] + (({_A})[k+1] - ({_A})[k]) * (value - q[k]) / (q[k+1] - q[k]) END"


_BELOW = " + ".join(f"CASE WHEN q[{i + 1}] < value THEN 1 ELSE 0 END" for i in range(len(LEVELS)))


def _scored(source: str, quantiles: str, where: str = "fold = 0") -> str:
    return f"SELECT event_id, event_type, fold, value, q, {_PIT} AS pit, {_CRPS} AS crps FROM (SELECT ev.*, q, {_BELOW} AS k FROM {source} ev JOIN {quantiles} USING (event_type) WHERE {where})"


def _cover(c: float) -> str:
    lo, hi = LEVELS.index(round((1 - c) / 2, 3)) + 1, LEVELS.index(round((1 + c) / 2, 3)) + 1
    return f"avg(CASE WHEN q[{lo}] <= value AND value <= q[{hi}] THEN 1.0 ELSE 0.0 END)"


_W = f"avg(q[{LEVELS.index(0.975) + 1}] - q[{LEVELS.index(0.025) + 1}])"
_AGGS = ", ".join([f"{_cover(c)} AS cov_{round(100 * c)}" for c in V.NOMINAL] + [f"{_W} AS width_95", "avg(crps) AS crps"])


def _events(spark, sf):
    return kfold(table(spark, sf, "events").select("event_id", "event_type", "value"), "event_id", 4, 81)


def _empirical(spark, sf, every=False):
    events = _events(spark, sf)
    quantiles = level_quantiles(events.where("fold > 0"), "value", LEVELS, ["event_type"])
    return attach(events if every else events.where("fold = 0"), quantiles, ["event_type"])


def _gaussian(spark, sf):
    events = _events(spark, sf)
    stats = events.where("fold > 0").groupBy("event_type").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    return attach(events, stats, ["event_type"]).withColumn("q", V.gaussian_quantiles("m", "v", 0.5, LEVELS)).drop("m", "v")


@BOOK.add("udf5_level_quantiles", f"WITH {_SPLIT}, {_EMP} SELECT event_type, CAST(i AS INTEGER) AS i, {q('q[i+1]')} AS value FROM em, range({len(LEVELS)}) t(i)")
def quantile_rows(spark, sf):
    out = level_quantiles(_events(spark, sf).where("fold > 0"), "value", LEVELS, ["event_type"])
    return out.select("event_type", F.posexplode("q").alias("i", "v")).select("event_type", "i", r("v").alias("value"))


@BOOK.add("win4_agg17_pit_and_crps", f"WITH {_SPLIT}, {_EMP} SELECT event_id, {q('pit')} AS pit, {q('crps')} AS crps FROM ({_scored('ev', 'em')})")
def win4(spark, sf):
    rows = V.scored_rows(_empirical(spark, sf), "value", "q", LEVELS)
    return rows.select("event_id", r("pit").alias("pit"), r("crps").alias("crps"))


@BOOK.add("uq1_interval_scores", f"WITH {_SPLIT}, {_EMP}, s AS (SELECT event_type, {_AGGS} FROM ({_scored('ev', 'em')}) GROUP BY event_type) {long_sql('s', ['event_type'], _COLS)}")
def uq1(spark, sf):
    return long_form(V.interval_summary(_empirical(spark, sf), "value", "q", LEVELS, ["event_type"]), ["event_type"])


# Every fold is judged by the quantiles of the other folds, so all events are scored, each out of sample.
_OTHERS = f"eo AS (SELECT event_type, CAST(v.fold AS INTEGER) AS fold, [{', '.join(f'quantile_disc(value, {a})' for a in LEVELS)}] AS q FROM ev JOIN range(4) v(fold) ON ev.fold <> v.fold GROUP BY 1, 2)"
_OUT_OF_FOLD = _scored("ev", "eo", "TRUE").replace("USING (event_type)", "USING (event_type, fold)")


def _out_of_fold(spark, sf):
    events = _events(spark, sf)
    quantiles = other_folds_quantiles(events, "value", LEVELS, "fold", 4, ["event_type"])
    return attach(events, quantiles, ["event_type", "fold"])


@BOOK.add("win4_pit_and_crps_of_every_fold", f"WITH {_SPLIT}, {_OTHERS} SELECT event_id, {q('pit')} AS pit, {q('crps')} AS crps FROM ({_OUT_OF_FOLD})")
def win4_every_fold(spark, sf):
    rows = V.scored_rows(_out_of_fold(spark, sf), "value", "q", LEVELS)
    return rows.select("event_id", r("pit").alias("pit"), r("crps").alias("crps"))


@BOOK.add("uq1_interval_scores_of_every_fold", f"WITH {_SPLIT}, {_OTHERS}, s AS (SELECT event_type, {_AGGS} FROM ({_OUT_OF_FOLD}) GROUP BY event_type) {long_sql('s', ['event_type'], _COLS)}")
def uq1_every_fold(spark, sf):
    return long_form(V.interval_summary(_out_of_fold(spark, sf), "value", "q", LEVELS, ["event_type"]), ["event_type"])


@BOOK.add("uq2_gaussian_quantiles", f"WITH {_SPLIT}, {_GAU}, s AS (SELECT event_type, fold, {_AGGS} FROM ({_scored('ev', 'ga', 'TRUE')}) GROUP BY 1, 2) {long_sql('s', ['event_type', 'fold'], _COLS)}")
def uq2(spark, sf):
    return long_form(V.interval_summary(_gaussian(spark, sf), "value", "q", LEVELS, ["event_type", "fold"]), ["event_type", "fold"])


# Reports: the data set is the event type, the method is the kind of quantile, the seed is the fold.
_BOTH = f"""{_SPLIT}, {_EMP}, {_GAU}, z AS (SELECT 'empirical' AS method, * FROM ({_scored("ev", "em", "TRUE")}) UNION ALL SELECT 'gaussian', * FROM ({_scored("ev", "ga", "TRUE")})),
  p AS (SELECT event_type, method, fold, {_AGGS} FROM z GROUP BY 1, 2, 3), m AS (SELECT event_type, method, avg(cov_95) AS cov_95, avg(width_95) AS width_95, avg(crps) AS crps FROM p GROUP BY 1, 2),
  kc AS (SELECT event_type, method, pit, count(*) AS n FROM z GROUP BY 1, 2, 3), ks AS (SELECT *, sum(n) OVER (PARTITION BY event_type, method ORDER BY pit) AS hi, sum(n) OVER (PARTITION BY event_type, method) AS total FROM kc),
  kk AS (SELECT event_type, method, max(greatest(hi/total - pit, pit - (hi-n)/total)) AS ks FROM ks GROUP BY 1, 2),
  su AS (SELECT m.event_type, m.method, round(cov_95, 3) AS cov_95, round(width_95, 3) AS width_95, round(crps, 3) AS crps, round(ks, 3) AS ks FROM m JOIN kk ON m.event_type = kk.event_type AND m.method = kk.method)"""


def _both(spark, sf):
    empirical = _empirical(spark, sf, every=True).withColumn("method", F.lit("empirical"))
    return empirical.unionByName(_gaussian(spark, sf).withColumn("method", F.lit("gaussian")))


_KEYS = ("value", "q", LEVELS, "event_type", "method", "fold")
_FOUR = ("cov_95", "width_95", "crps", "ks")


@BOOK.add("uq4_agg23_dataset_summary", f"WITH {_BOTH} SELECT event_type, method, {', '.join(f'{q(c)} AS {c}' for c in _FOUR)} FROM su")
def uq4(spark, sf):
    return K.dataset_summary(_both(spark, sf), *_KEYS).select("event_type", "method", *[r(c).alias(c) for c in _FOUR])


@BOOK.add("uq4_agg21_overall", f"WITH {_BOTH} SELECT method, {', '.join(f'{q(f"avg({c})")} AS {c}' for c in _FOUR)} FROM su GROUP BY method")
def uq4_overall(spark, sf):
    return K.overall_summary(K.dataset_summary(_both(spark, sf), *_KEYS), "method").select("method", *[r(c).alias(c) for c in _FOUR])


@BOOK.add("uq4_agg24_width_table", f"WITH {_BOTH} SELECT event_type, {q("max(width_95) FILTER (method = 'empirical')", 3)} AS empirical, {q("max(width_95) FILTER (method = 'gaussian')", 3)} AS gaussian FROM su GROUP BY event_type")
def uq4_table(spark, sf):
    return K.width_table(K.dataset_summary(_both(spark, sf), *_KEYS), "event_type", "method", ["empirical", "gaussian"])


@BOOK.add(
    "uq4_agg22_calibration_curve",
    f"WITH {_BOTH}, c AS ({' UNION ALL '.join(f'SELECT method, {c}::DOUBLE AS level, cov_{round(100 * c)} AS coverage FROM p' for c in V.NOMINAL)}) SELECT method, level, {q('avg(coverage)')} AS mean, {q('stddev_pop(coverage)')} AS sd FROM c GROUP BY method, level",
)
def uq4_curve(spark, sf):
    return K.calibration_curve(_both(spark, sf), *_KEYS).select("method", "level", r("mean").alias("mean"), r("sd").alias("sd"))


@BOOK.add("uq4_agg19_pit_histogram", f"WITH {_BOTH} SELECT method, CAST(least(floor(pit * 20), 19) AS INTEGER) AS bin, count(*) AS n, {q('count(*) * 20.0 / any_value(t.total)')} AS density FROM z JOIN (SELECT method, count(*) AS total FROM z GROUP BY method) t USING (method) GROUP BY 1, 2")
def uq4_histogram(spark, sf):
    return K.pit_histogram(_both(spark, sf), "value", "q", LEVELS, "method").select("method", "bin", "n", r("density").alias("density"))


_RUN = f"""c AS (SELECT p_partkey AS id, p_size, p_retailprice FROM part),
  n AS (SELECT CAST(ceil(0.3 * count(*)) AS BIGINT) AS k FROM c), s AS (SELECT c.*, row_number() OVER (ORDER BY {u("id", 6)}, id) > (SELECT k FROM n) AS train FROM c),
  st AS (SELECT avg(p_size) AS mx, stddev_pop(p_size) AS sx, avg(p_retailprice) AS my, stddev_pop(p_retailprice) AS sy FROM s WHERE train),
  z AS (SELECT id, train, (p_size - mx) / sx AS x, (p_retailprice - my) / sy AS value FROM s, st), f AS (SELECT regr_intercept(value, x) AS a, regr_slope(value, x) AS b FROM z WHERE train),
  v AS (SELECT avg((value - a - b*x) * (value - a - b*x)) AS v FROM z, f WHERE train),
  w AS (SELECT value, [{", ".join(f"a + b*x + sqrt(v) * ({NormalDist().inv_cdf(a)!r})" for a in LEVELS)}] AS q FROM z, f, v WHERE NOT train),
  o AS (SELECT {_AGGS} FROM (SELECT value, q, {_CRPS} AS crps FROM w))"""


@BOOK.add("uq5_one_run", f"WITH {_RUN} {long_sql('o', [], _COLS)}")
def uq5(spark, sf):
    """Split, scale, predict, score, store and read back; all rows."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_size", "p_retailprice")
    scores = K.run_one(part, "id", ["p_size"], "p_retailprice", LEVELS, seed=5)
    path = scratch_path(spark, "run")
    write_results(scores.withColumns({"dataset": F.lit("part"), "seed": F.lit(5)}), path, ["dataset", "seed"])
    return long_form(read_results(spark, path).drop("dataset", "seed"), [])


@BOOK.add("uq5_udf5_model_quantiles", f"SELECT p_partkey, {q(f'p_size / 50.0 + 0.1 * ({NormalDist().inv_cdf(0.9)!r})')} AS q90 FROM part")
def uq5_model(spark, sf):
    """Quantiles of a user's model, predicted in batches on executors."""
    from gramwise.operators.score import quantile_column

    z = {a: NormalDist().inv_cdf(a) for a in LEVELS}

    def predict(x, levels):
        return x[:, :1] + [0.1 * z[a] for a in levels]

    quantiles = quantile_column(spark, predict, [F.col("p_size") / 50.0], LEVELS)
    return table(spark, sf, "part").select("p_partkey", r(F.get(quantiles, LEVELS.index(0.9))).alias("q90"))
