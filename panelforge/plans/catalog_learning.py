"""Queries over preprocessing, data sets, models and ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.operators import dataset as D
from panelforge.operators import ensemble as EN
from panelforge.operators import factors as FC
from panelforge.operators import models as MO
from panelforge.operators import preprocess as PP
from panelforge.operators import trees as TR
from panelforge.plans.market import SERIES_NAMES, TEST, TRAIN, Market
from panelforge.plans.reference_sql import CTES, avg_rank, band
from panelforge.plans.registry import query
from panelforge.session import reuse

WIDE = SERIES_NAMES
IN_TRAIN = f"Date BETWEEN DATE '{TRAIN[0]}' AND DATE '{TRAIN[1]}'"
UP, DOWN = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
FEATURES = ["r1", "m5", "m21", "v5"]

# One value per series and day, carried forward, from the first day on which every series has one.
CTES["x_wide_days"] = "SELECT Date, " + ", ".join(f"max(Close) FILTER (Name = '{n}') / 10000 AS {n}" for n in WIDE) + " FROM x_series GROUP BY Date"
CTES["x_wide"] = "SELECT * FROM (SELECT Date, " + ", ".join(f"last_value({n} IGNORE NULLS) OVER (ORDER BY Date {UP}) AS {n}" for n in WIDE) + \
    " FROM x_wide_days) WHERE " + " AND ".join(f"{n} IS NOT NULL" for n in WIDE)
CTES["x_dense"] = f"""SELECT Date, Sector, coalesce(last_value(Target IGNORE NULLS) OVER (PARTITION BY Sector ORDER BY Date {UP}),
    first_value(Target IGNORE NULLS) OVER (PARTITION BY Sector ORDER BY Date {DOWN})) AS Target
  FROM (SELECT d.Date, s.Sector, t.Target FROM (SELECT DISTINCT Date FROM x_target) d CROSS JOIN (SELECT DISTINCT Sector FROM x_target) s
    LEFT JOIN x_target t ON t.Date = d.Date AND t.Sector = s.Sector)"""
CTES["x_mu"] = f"SELECT Sector, avg(Target) AS mu FROM x_dense WHERE {IN_TRAIN} GROUP BY Sector"
CTES["x_centred"] = "SELECT d.Date, d.Sector, Target - mu AS c, mu FROM x_dense d JOIN x_mu m ON d.Sector = m.Sector"
CTES["x_cov0"] = f"SELECT a.Sector AS i, b.Sector AS j, sum(a.c * b.c) AS v FROM x_centred a JOIN x_centred b ON a.Date = b.Date WHERE a.{IN_TRAIN} GROUP BY 1, 2"


def _projector(prefix: str, start: str, steps: int = 45) -> str:
    """Repeated squaring with unit trace: the limit projects on the leading axis."""
    CTES[f"{prefix}_0"] = f"SELECT i, j, v / (SELECT sum(v) FROM {start} WHERE i = j) AS v FROM {start}"
    for n in range(1, steps + 1):
        CTES[f"{prefix}_r{n}"] = f"SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {prefix}_{n - 1} a JOIN {prefix}_{n - 1} b ON a.j = b.i GROUP BY 1, 2"
        CTES[f"{prefix}_{n}"] = f"SELECT i, j, v / (SELECT sum(v) FROM {prefix}_r{n} WHERE i = j) AS v FROM {prefix}_r{n}"
    return f"{prefix}_{steps}"


P1 = _projector("x_p1", "x_cov0")
CTES["x_l1"] = f"SELECT sum(a.v * b.v) AS l FROM x_cov0 a JOIN {P1} b ON a.j = b.i AND a.i = b.j"
CTES["x_cov1"] = f"SELECT a.i, a.j, a.v - l * b.v AS v FROM x_cov0 a JOIN {P1} b ON a.i = b.i AND a.j = b.j, x_l1"
P2 = _projector("x_p2", "x_cov1")
CTES["x_l2"] = f"SELECT sum(a.v * b.v) AS l FROM x_cov1 a JOIN {P2} b ON a.j = b.i AND a.i = b.j"
CTES["x_resid1"] = f"SELECT c.Date, c.Sector, c.c - f.fit AS Target FROM x_centred c JOIN (SELECT b.Date, p.i, sum(p.v * b.c) AS fit FROM x_centred b JOIN {P1} p ON p.j = b.Sector GROUP BY 1, 2) f ON f.Date = c.Date AND f.i = c.Sector"


def wide(m: Market):
    from panelforge.operators import features as FE
    rows = FE.widen_series(m.series.select("Date", "Name", (F.col("Close") / 10000).alias("value")), WIDE)
    return reuse(rows.toDF("Date", *WIDE).dropna())


def dense_target(m: Market):
    return reuse(PP.dense_matrix(m.target))


@query("standardised_series", "I2 I1", "SELECT Date, " + ", ".join(
    f"({n} - (SELECT avg({n}) FROM x_wide WHERE {IN_TRAIN})) / (SELECT stddev_pop({n}) FROM x_wide WHERE {IN_TRAIN}) AS {n}" for n in WIDE) + " FROM x_wide", " ".join(WIDE))
def standardised_series(m: Market):
    return PP.Standardise(WIDE, start=TRAIN[0], end=TRAIN[1]).fit_transform(wide(m))


@query("standardise_inverse", "I2", "SELECT * FROM x_wide", " ".join(WIDE))
def standardise_inverse(m: Market):
    rows = wide(m)
    step = PP.Standardise(WIDE, start=TRAIN[0], end=TRAIN[1]).fit(rows)
    return step.inverse_transform(step.transform(rows)).select("Date", *WIDE)


PAIR = ["USDJPY", "WTI"]
REST = [n for n in WIDE if n not in PAIR]
NOT_OIL = [n for n in WIDE if n != "WTI"]


@query("neutralised_on_columns", "I7", f"""
    WITH s AS (SELECT sum(USDJPY * USDJPY) AS aa, sum(USDJPY * WTI) AS ab, sum(WTI * WTI) AS bb, {", ".join(f"sum(USDJPY * {n}) AS a_{n}, sum(WTI * {n}) AS b_{n}" for n in REST)} FROM x_wide WHERE {IN_TRAIN})
    SELECT Date, USDJPY, WTI, {", ".join(f"{n} - (USDJPY * (a_{n} * bb - ab * b_{n}) + WTI * (aa * b_{n} - ab * a_{n})) / (aa * bb - ab * ab) AS {n}" for n in REST)} FROM x_wide, s""", " ".join(WIDE))
def neutralised_on_columns(m: Market):
    return PP.NeutraliseOn(REST, PAIR, start=TRAIN[0], end=TRAIN[1]).fit_transform(wide(m))


@query("neutralised_with_intercept", "I7", "SELECT Date, WTI, " + ", ".join(
    f"{n} - (SELECT regr_intercept({n}, WTI) FROM x_wide) - WTI * (SELECT regr_slope({n}, WTI) FROM x_wide) AS {n}" for n in NOT_OIL) + " FROM x_wide", " ".join(WIDE))
def neutralised_with_intercept(m: Market):
    return PP.NeutraliseOn(NOT_OIL, ["WTI"], fit_intercept=True).fit_transform(wide(m))


# Every series gives up its correlation with each series before it, in turn.
_TURN = [f"{n}" + "".join(f" - c{i}_{j} * n{j}" for j in range(i)) + f" AS n{i}" for i, n in enumerate(WIDE)]


@query("neutralised_mutually", "I8", f"""
    WITH r AS (SELECT {", ".join(f"corr({WIDE[i]}, {WIDE[j]}) AS c{i}_{j}" for i in range(len(WIDE)) for j in range(i))} FROM x_wide WHERE {IN_TRAIN}),
    t AS (SELECT Date, {", ".join(_TURN)} FROM x_wide, r) SELECT Date, {", ".join(f"n{i} AS {n}" for i, n in enumerate(WIDE))} FROM t""", " ".join(WIDE))
def neutralised_mutually(m: Market):
    return PP.NeutraliseMutually(WIDE, start=TRAIN[0], end=TRAIN[1]).fit_transform(wide(m)).select("Date", *WIDE)


@query("neutralisation_from_spec", "I12 I7", "SELECT Date, WTI, " + ", ".join(
    f"{n} - WTI * (SELECT sum({n} * WTI) / sum(WTI * WTI) FROM x_wide) AS {n}_n" for n in NOT_OIL) + " FROM x_wide", " ".join(["WTI", *(f"{n}_n" for n in NOT_OIL)]))
def neutralisation_from_spec(m: Market):
    spec = m.spark.createDataFrame([(n, "WTI", f"{n}_n") for n in NOT_OIL], "to_neutralize string, `by` string, neutralized string")
    return PP.neutralisation_steps(spec).fit_transform(wide(m)).select("Date", "WTI", *(f"{n}_n" for n in NOT_OIL))


Z = ", ".join(f"({n} - (SELECT avg({n}) FROM x_wide)) / (SELECT stddev_pop({n}) FROM x_wide) AS {n}" for n in WIDE)


@query("preprocessing_chain", "I9 I2 I7", f"""
    WITH z AS (SELECT Date, {Z} FROM x_wide) SELECT Date, WTI, {", ".join(f"{n} - WTI * (SELECT sum({n} * WTI) / sum(WTI * WTI) FROM z) AS {n}" for n in NOT_OIL)} FROM z""", " ".join(WIDE))
def preprocessing_chain(m: Market):
    chain = PP.Chain([("scale", PP.Standardise(WIDE)), ("neutralise", PP.NeutraliseOn(NOT_OIL, ["WTI"]))])
    return chain.fit_transform(wide(m)).select("Date", *WIDE)


CTES["x_wlong"] = " UNION ALL ".join(f"SELECT Date, '{n}' AS n, {n} - (SELECT avg({n}) FROM x_wide WHERE {IN_TRAIN}) AS c FROM x_wide" for n in WIDE)
CTES["x_wcov"] = f"SELECT a.n AS i, b.n AS j, sum(a.c * b.c) AS v FROM x_wlong a JOIN x_wlong b ON a.Date = b.Date WHERE a.{IN_TRAIN} GROUP BY 1, 2"
W1 = _projector("x_w1", "x_wcov")
WFIT = f"SELECT b.Date, p.i AS n, sum(p.v * b.c) AS fit FROM x_wlong b JOIN {W1} p ON p.j = b.n GROUP BY 1, 2"


def _pivot(expr: str) -> str:
    return ", ".join(f"max({expr}) FILTER (l.n = '{n}') AS {n}" for n in WIDE)


@query("pca_column_residuals", "I3 I4", f"SELECT l.Date, {_pivot('l.c - f.fit')} FROM x_wlong l JOIN ({WFIT}) f ON l.Date = f.Date AND l.n = f.n GROUP BY l.Date", " ".join(WIDE))
def pca_column_residuals(m: Market):
    return PP.Pca(1, "residuals", WIDE, TRAIN[0], TRAIN[1]).fit_transform(wide(m))


@query("pca_column_reconstruction", "I4", "SELECT l.Date, " + ", ".join(f"max(f.fit) FILTER (l.n = '{n}') + (SELECT avg({n}) FROM x_wide WHERE {IN_TRAIN}) AS {n}" for n in WIDE) +
       f" FROM x_wlong l JOIN ({WFIT}) f ON l.Date = f.Date AND l.n = f.n GROUP BY l.Date", " ".join(WIDE))
def pca_column_reconstruction(m: Market):
    return PP.Pca(1, "components", WIDE, TRAIN[0], TRAIN[1]).fit_transform(wide(m))


@query("pca_column_score", "I4", f"SELECT Date, sqrt(greatest(sum(fit * fit), 0)) AS AbsPC1 FROM ({WFIT}) GROUP BY Date", "AbsPC1")
def pca_column_score(m: Market):
    """Size of the first score; its sign is a convention of the solver."""
    scores = PP.Pca(1, "transform", WIDE, TRAIN[0], TRAIN[1]).fit_transform(wide(m))
    return scores.select("Date", F.abs("PC1").alias("AbsPC1"))


@query("sector_matrix_filled", "H1", "SELECT Date, Sector, Target FROM x_dense", "Target")
def sector_matrix_filled(m: Market):
    return PP.dense_matrix(m.target)


@query("sector_matrix_unstack_stack", "H1 H2", "SELECT Date, Sector, Target FROM x_target WHERE Target IS NOT NULL", "Target")
def sector_matrix_unstack_stack(m: Market):
    return PP.stack(PP.unstack(m.target, m.sectors), m.sectors)


@query("pca_residual_target", "I6 I3 I4 H1 H2 B15", "SELECT Date, Sector, Target FROM x_resid1", "Target")
def pca_residual_target(m: Market):
    dense = dense_target(m)
    return PP.PanelPca(1, start=TRAIN[0], end=TRAIN[1]).fit(dense).residuals(dense)


@query("pca_variance_ratios", "I5", """
    SELECT Component, Ratio, sum(Ratio) OVER (ORDER BY Component) AS CumulativeRatio FROM (
      SELECT 'PC_01' AS Component, l / (SELECT sum(v) FROM x_cov0 WHERE i = j) AS Ratio FROM x_l1 UNION ALL
      SELECT 'PC_02', l / (SELECT sum(v) FROM x_cov0 WHERE i = j) FROM x_l2)""", "Ratio CumulativeRatio")
def pca_variance_ratios(m: Market):
    return PP.PanelPca(2, start=TRAIN[0], end=TRAIN[1]).fit(dense_target(m)).variance_table(m.target)


@query("pca_loadings", "I5", f"SELECT 'PC_01' AS Component, i AS Sector, v AS SquaredLoading FROM {P1} WHERE i = j", "SquaredLoading")
def pca_loadings(m: Market):
    table = PP.PanelPca(1, start=TRAIN[0], end=TRAIN[1]).fit(dense_target(m)).component_table(m.target)
    return table.select("Component", "Sector", (F.col("Loading") * F.col("Loading")).alias("SquaredLoading"))


# The same over all days.
CTES["x_centred_all"] = "SELECT Date, Sector, Target - avg(Target) OVER (PARTITION BY Sector) AS c FROM x_dense"
CTES["x_cov_all"] = "SELECT a.Sector AS i, b.Sector AS j, sum(a.c * b.c) AS v FROM x_centred_all a JOIN x_centred_all b ON a.Date = b.Date GROUP BY 1, 2"
PALL = _projector("x_pall", "x_cov_all")


@query("factors_removed", "I10", f"""SELECT c.Date, c.Sector, c.c - f.fit AS Target FROM x_centred_all c
    JOIN (SELECT b.Date, p.i, sum(p.v * b.c) AS fit FROM x_centred_all b JOIN {PALL} p ON p.j = b.Sector GROUP BY 1, 2) f ON f.Date = c.Date AND f.i = c.Sector""", "Target")
def factors_removed(m: Market):
    return FC.remove_factors(m.target, 1, "Target", "Sector")


# Stocks' daytime returns, rounded so that both engines start from the same numbers.
CTES["x_daytime"] = "SELECT Date, Code, round(Close / nullif(Open, 0) - 1, 6) AS v FROM x_price"
CTES["x_daytime_full"] = f"""SELECT d.Date, c.Code, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY c.Code ORDER BY d.Date {UP}), first_value(v IGNORE NULLS) OVER (PARTITION BY c.Code ORDER BY d.Date {DOWN})) AS v
  FROM (SELECT DISTINCT Date FROM x_daytime) d CROSS JOIN (SELECT DISTINCT Code FROM x_daytime) c LEFT JOIN x_daytime t ON t.Date = d.Date AND t.Code = c.Code"""
CTES["x_daytime_c"] = "SELECT Date, Code, v - avg(v) OVER (PARTITION BY Code) AS c FROM x_daytime_full"
CTES["x_daytime_cov"] = "SELECT a.Code AS i, b.Code AS j, sum(a.c * b.c) AS v FROM x_daytime_c a JOIN x_daytime_c b ON a.Date = b.Date GROUP BY 1, 2"
PDAY = _projector("x_pday", "x_daytime_cov", 30)


@query("stock_factors_removed", "I10", f"""SELECT c.Date, c.Code, (c.c - f.fit) * 1e3 AS Milli FROM x_daytime_c c
    JOIN (SELECT b.Date, p.i, sum(p.v * b.c) AS fit FROM x_daytime_c b JOIN {PDAY} p ON p.j = b.Code GROUP BY 1, 2) f ON f.Date = c.Date AND f.i = c.Code""", "Milli:4")
def stock_factors_removed(m: Market):
    """Every stock's daytime return without the leading component of all stocks, in thousandths."""
    rows = m.price.select("Date", "Code", F.round(F.try_divide(F.col("Close"), F.col("Open")) - 1, 6).alias("Milli"))
    return FC.remove_factors(rows, 1, "Milli", "Code").withColumn("Milli", F.col("Milli") * 1e3)


NEXT = "(SELECT max(Date) + 1 FROM x_target)"


def next_calendar(m: Market):
    return m.calendar.select(F.date_add("Date", 1).alias("Date"))


@query("next_day_rows", "E20", f"SELECT Date, Sector, Target FROM x_target UNION ALL SELECT DISTINCT CAST({NEXT} AS DATE), Sector, NULL FROM x_target", "Target")
def next_day_rows(m: Market):
    return D.append_next_day(m.target, next_calendar(m))


@query("lagged_features", "E19", "SELECT Date, Sector, lag(Target) OVER (PARTITION BY Sector ORDER BY Date) AS Target, Pred FROM x_pred")
def lagged_features(m: Market):
    return D.lag_features(m.predictions, keep=["Pred"])


@query("features_aligned", "C19 G3", "SELECT Date, Sector, Target FROM x_target WHERE (Date, Sector) IN (SELECT Date, Sector FROM x_slow)", "Target")
def features_aligned(m: Market):
    return D.align(m.target, m.slow_predictions)


OUT = f"""SELECT t.Date, t.Sector, t.Target FROM x_target t JOIN (SELECT Sector, avg(Target) AS mu, stddev_samp(Target) AS sd FROM x_target WHERE {IN_TRAIN} GROUP BY Sector) b USING (Sector)
    WHERE t.{IN_TRAIN} AND t.Target BETWEEN mu - 2 * sd AND mu + 2 * sd"""


@query("outliers_removed", "E21", OUT, "Target")
def outliers_removed(m: Market):
    from panelforge.sources.readers import between
    return D.drop_outliers(between(m.target, *TRAIN), 2.0)


@query("train_test_sets", "J1 E19 E20 E21 C19", f"""
    WITH t AS (SELECT Date, Sector, Target FROM x_target UNION ALL SELECT DISTINCT CAST({NEXT} AS DATE), Sector, NULL FROM x_target),
    f AS (SELECT Date, Sector, lag(Pred) OVER (PARTITION BY Sector ORDER BY Date) AS Pred FROM (SELECT Date, Sector, Pred FROM x_slow UNION ALL SELECT DISTINCT CAST({NEXT} AS DATE), Sector, NULL FROM x_slow)),
    o AS ({OUT}), a AS (SELECT * FROM f WHERE (Date, Sector) IN (SELECT Date, Sector FROM t))
    SELECT 'target_train' AS Part, count(*) AS Rows, sum(Target) AS Total FROM o UNION ALL SELECT 'features_train', count(*), sum(Pred) FROM a WHERE (Date, Sector) IN (SELECT Date, Sector FROM o)
    UNION ALL SELECT 'target_test', count(*), sum(Target) FROM t WHERE Date BETWEEN DATE '{TEST[0]}' AND DATE '{TEST[1]}'
    UNION ALL SELECT 'features_test', count(*), sum(Pred) FROM a WHERE Date BETWEEN DATE '{TEST[0]}' AND DATE '{TEST[1]}'""", "Total")
def train_test_sets(m: Market):
    ds = D.train_test(m.target, m.slow_predictions, TRAIN, TEST, next_calendar(m), outlier_width=2.0)
    parts = [("target_train", "Target"), ("features_train", "Pred"), ("target_test", "Target"), ("features_test", "Pred")]
    rows = [getattr(ds, n).agg(F.count(F.lit(1)).alias("Rows"), F.sum(c).alias("Total")).select(F.lit(n).alias("Part"), "Rows", "Total") for n, c in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query("model_output_as_feature", "C12 J13", "SELECT t.Date, t.Sector, t.Target, s.Pred AS first_model FROM x_target t LEFT JOIN x_slow s ON t.Date = s.Date AND t.Sector = s.Sector")
def model_output_as_feature(m: Market):
    return D.append_model_output(m.target, m.slow_predictions, "first_model")


@query("raw_returns_with_predictions", "C13", f"SELECT s.Date, s.Sector, s.Pred, t.Target FROM x_slow s LEFT JOIN x_target t ON t.Date = s.Date AND t.Sector = s.Sector WHERE s.Date BETWEEN DATE '{TEST[0]}' AND DATE '{TEST[1]}'")
def raw_returns_with_predictions(m: Market):
    return D.raw_returns_with_predictions(m.target, m.slow_predictions, *TEST)


# Both models on the days the slower one covers.
CTES["x_two"] = "SELECT a.Date, a.Sector, a.Target, a.Pred AS p1, b.Pred AS p2 FROM x_pred a JOIN x_slow b ON a.Date = b.Date AND a.Sector = b.Sector"


def two_models(m: Market):
    """Both models on the keys they share; ensembles refuse others."""
    a, b = m.predictions, m.slow_predictions
    return a.join(b, ["Date", "Sector"], "left_semi"), b.join(a, ["Date", "Sector"], "left_semi")


@query("ensemble_key_check", "J7", "SELECT Date, Sector, CAST(count(*) AS BIGINT) AS Models FROM (SELECT Date, Sector FROM x_pred UNION ALL SELECT Date, Sector FROM x_slow) GROUP BY Date, Sector HAVING count(*) <> 2")
def ensemble_key_check(m: Market):
    return EN.unmatched_keys([(m.predictions, 1.0), (m.slow_predictions, 1.0)])


@query("ensemble_by_value", "J8 J7", "SELECT Date, Sector, p1 * (6.7 / 8.0) + p2 * (1.3 / 8.0) AS Pred FROM x_two", "Pred:12")
def ensemble_by_value(m: Market):
    a, b = two_models(m)
    return EN.by_value([(a, 6.7), (b, 1.3)])


# Ranks of a model run over the rows of the day that both models have.
CTES["x_ranks"] = f"""SELECT a.Date, a.Sector, a.r AS r1, b.r AS r2 FROM (SELECT Date, Sector, {avg_rank('Pred', desc=True)} AS r FROM x_pred SEMI JOIN x_slow USING (Date, Sector)) a
  JOIN (SELECT Date, Sector, {avg_rank('Pred', desc=True)} AS r FROM x_slow SEMI JOIN x_pred USING (Date, Sector)) b ON a.Date = b.Date AND a.Sector = b.Sector"""
BY_RANK = f"SELECT Date, Sector, {avg_rank('s', desc=True)} AS Pred FROM (SELECT Date, Sector, r1 * 0.75 + r2 * 0.25 AS s FROM x_ranks)"


@query("ensemble_by_rank", "J9 J11", BY_RANK)
def ensemble_by_rank(m: Market):
    a, b = two_models(m)
    return EN.ensemble("by_rank", [(a, 3.0), (b, 1.0)])


@query("ensemble_by_vote", "J10", "SELECT Date, Sector, CASE WHEN r1 <= 5 THEN (6 - r1) * 0.75 ELSE 0 END + CASE WHEN r2 <= 5 THEN (6 - r2) * 0.25 ELSE 0 END AS Pred FROM x_ranks", "Pred")
def ensemble_by_vote(m: Market):
    a, b = two_models(m)
    return EN.ensemble("by_voting", [(a, 3.0), (b, 1.0)], top_n=5)


@query("rank_ensemble_dataset", "J12", f"SELECT e.Date, e.Sector, e.Pred, t.Target FROM ({BY_RANK}) e JOIN (SELECT Date, Sector, {avg_rank('Target')} AS Target FROM x_pred SEMI JOIN x_slow USING (Date, Sector)) t ON e.Date = t.Date AND e.Sector = t.Sector")
def rank_ensemble_dataset(m: Market):
    a, b = two_models(m)
    return EN.rank_ensemble_dataset([(a, 3.0), (b, 1.0)])


def model_inputs(m: Market):
    """Yesterday's return, momentum and volatility against today's target, null where they are not known."""
    return m.target, m.model_features


def complete_inputs(m: Market):
    """The inputs of days on which all features are known, as ``x_inputs`` has them."""
    target, features = model_inputs(m)
    return target, features.dropna()


CTES["x_inputs"] = "SELECT * FROM x_feat WHERE r1 IS NOT NULL AND m5 IS NOT NULL AND m21 IS NOT NULL AND v5 IS NOT NULL"


@query("sector_model_statistics", "J2", """
    SELECT i.Sector, CAST(count(*) AS BIGINT) AS Rows, avg(Target) AS Intercept, avg(r1) AS MeanR1, stddev_pop(r1) AS ScaleR1 FROM x_inputs i JOIN x_target t ON i.Date = t.Date AND i.Sector = t.Sector
    WHERE Target IS NOT NULL GROUP BY i.Sector""", "Intercept MeanR1 ScaleR1")
def sector_model_statistics(m: Market):
    """Scaling and intercept each sector's model was fitted with."""
    target, features = complete_inputs(m)
    models = MO.fit_lasso(target, features, FEATURES)
    return models.select("Sector", "Rows", "Intercept", F.get("Mean", 0).alias("MeanR1"), F.get("Scale", 0).alias("ScaleR1"))


@query("sector_single_feature_models", "J2 J3 J6", """
    WITH d AS (SELECT i.Sector, i.Date, r1, Target FROM x_inputs i JOIN x_target t ON i.Date = t.Date AND i.Sector = t.Sector WHERE Target IS NOT NULL),
    s AS (SELECT Sector, avg(r1) AS mx, stddev_pop(r1) AS sx, avg(Target) AS my, covar_pop(r1, Target) / stddev_pop(r1) AS c FROM d GROUP BY Sector)
    SELECT d.Date, d.Sector, my + (r1 - mx) / sx * sign(c) * greatest(abs(c) - 0.0001, 0) AS Pred, Target FROM d JOIN s ON d.Sector = s.Sector""", "Pred Target")
def sector_single_feature_models(m: Market):
    """With one scaled feature the penalised solution has a closed form: soft thresholding."""
    target, features = complete_inputs(m)
    models = MO.fit_lasso(target, features, ["r1"], alpha=0.0001)
    return MO.predict_lasso(models, features, ["r1"], target).filter("Target is not null")


@query("pooled_single_feature_model", "J2 J6", """
    WITH d AS (SELECT i.Sector, i.Date, m5, Target FROM x_inputs i JOIN x_target t ON i.Date = t.Date AND i.Sector = t.Sector WHERE Target IS NOT NULL),
    s AS (SELECT avg(m5) AS mx, stddev_pop(m5) AS sx, avg(Target) AS my, covar_pop(m5, Target) / stddev_pop(m5) AS c FROM d)
    SELECT d.Date, d.Sector, my + (m5 - mx) / sx * sign(c) * greatest(abs(c) - 0.00001, 0) AS Pred FROM d, s""", "Pred")
def pooled_single_feature_model(m: Market):
    target, features = complete_inputs(m)
    models = MO.fit_lasso(target, features, ["m5"], by=None, alpha=0.00001)
    return MO.predict_lasso(models, features, ["m5"], target, pooled=True).filter("Target is not null").drop("Target")


# The sparse models: cross-products by sector and fold, coordinate descent as a recursion over sweeps, the penalty by held-out error.
CANDIDATES = ["r1", "m5", "m21", "v5", *SERIES_NAMES]
K, FOLDS, SWEEPS = len(CANDIDATES), 5, 120
PENALTIES = MO.penalty_grid(24)
CTES["x_all_returns"] = """SELECT s.Name, Date, CASE WHEN c."Group" = 'bond' THEN Close - lag(Close) OVER (PARTITION BY s.Name ORDER BY Date)
    ELSE Close / nullif(lag(Close) OVER (PARTITION BY s.Name ORDER BY Date), 0) - 1 END AS value FROM x_series s JOIN x_catalogue c ON s.Name = c.Name"""
CTES["x_all_wide"] = "SELECT Date, " + ", ".join(f"last_value(max(value) FILTER (Name = '{n}') IGNORE NULLS) OVER (ORDER BY Date {UP}) AS {n}" for n in SERIES_NAMES) + " FROM x_all_returns GROUP BY Date"
CTES["x_candidates"] = "SELECT Date, Sector, " + ", ".join(f"lag({n}) OVER (PARTITION BY Sector ORDER BY Date) AS {n}" for n in CANDIDATES) + f""" FROM (
    SELECT p.Date, p.Sector, {", ".join(f"last_value({n} IGNORE NULLS) OVER w AS {n}" for n in CANDIDATES)} FROM (
      SELECT Date, Sector, "1d_return" AS r1, {band('avg', '"1d_return"', 4, 1)} AS m5, {band('avg', '"1d_return"', 16, 5)} AS m21, {band('stddev_samp', '"1d_return"', 4, 1)} AS v5 FROM x_index) p
    LEFT JOIN x_all_wide a ON p.Date = a.Date WINDOW w AS (PARTITION BY p.Sector ORDER BY p.Date {UP}))"""
_whole = " AND ".join(f"{n} IS NOT NULL" for n in CANDIDATES)
CTES["x_lasso_rows"] = f"""SELECT c.*, Target AS y, ntile({FOLDS}) OVER (PARTITION BY c.Sector ORDER BY c.Date) AS fold FROM x_candidates c
    JOIN x_residual t ON c.Date = t.Date AND c.Sector = t.Sector WHERE c.{IN_TRAIN} AND Target IS NOT NULL AND {_whole}"""
CTES["x_lasso_scale"] = "SELECT Sector, " + ", ".join(f"avg({n}) AS mu{i}, CASE WHEN stddev_pop({n}) > 0 THEN stddev_pop({n}) ELSE 1 END AS sd{i}" for i, n in enumerate(CANDIDATES)) + " FROM x_lasso_rows GROUP BY Sector"
CTES["x_lasso_z"] = "SELECT r.Sector, fold, y, " + ", ".join(f"({n} - mu{i}) / sd{i} AS z{i}" for i, n in enumerate(CANDIDATES)) + " FROM x_lasso_rows r JOIN x_lasso_scale s ON r.Sector = s.Sector"
_sums = {"n": "1.0", "y": "y", "yy": "y * y"} | {f"a{i}": f"z{i}" for i in range(K)} | {f"c{i}": f"z{i} * y" for i in range(K)} | {f"g{i}_{j}": f"z{i} * z{j}" for i in range(K) for j in range(i, K)}
CTES["x_lasso_folds"] = "SELECT Sector, fold, " + ", ".join(f"sum({v}) AS {n}" for n, v in _sums.items()) + " FROM x_lasso_z GROUP BY Sector, fold"
# Sums over all folds but one; fold 0 leaves out none.
CTES["x_lasso_left"] = "SELECT t.Sector, o.fold, " + ", ".join(f"sum(t.{n}) AS {n}" for n in _sums) + f""" FROM x_lasso_folds t, (SELECT unnest(range({FOLDS + 1})) AS fold) o
    WHERE t.fold <> o.fold GROUP BY t.Sector, o.fold"""
CTES["x_lasso_cov"] = "SELECT Sector, fold, n, y / n AS my, " + ", ".join(f"a{i} / n AS a{i}, c{i} / n - (a{i} / n) * (y / n) AS c{i}" for i in range(K)) + ", " + ", ".join(
    f"g{i}_{j} / n - (a{i} / n) * (a{j} / n) AS g{i}_{j}" for i in range(K) for j in range(i, K)) + " FROM x_lasso_left"
CTES["x_penalties"] = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {a!r}::DOUBLE)" for i, a in enumerate(PENALTIES)) + ") AS v(p, alpha)"


def _g(i: int, j: int) -> str:
    return f"g{min(i, j)}_{max(i, j)}"


def _sweep() -> str:
    """One turn of coordinate descent: each level replaces one coefficient, given those before it."""
    level = "(SELECT b.Sector AS s, b.fold AS f, b.p AS q, b.step, alpha, " + ", ".join(f"b{i}" for i in range(K)) + ", g.* FROM x_lasso_b b JOIN x_lasso_cov g ON b.Sector = g.Sector AND b.fold = g.fold JOIN x_penalties w ON b.p = w.p WHERE b.step < " + str(SWEEPS) + ")"
    for i in range(K):
        rho = f"(c{i} - (" + " + ".join(f"{_g(i, j)} * b{j}" for j in range(K) if j != i) + "))"
        level = f"(SELECT * REPLACE (sign(r) * greatest(abs(r) - alpha, 0) / d AS b{i}) FROM (SELECT * EXCLUDE (r, d), {rho} AS r, CASE WHEN {_g(i, i)} > 0 THEN {_g(i, i)} ELSE 1 END AS d FROM {level if i else level.replace('g.*', 'g.*, 0.0::DOUBLE AS r, 0.0::DOUBLE AS d')}))"
    return f"SELECT s, f, q, step + 1, {', '.join(f'b{i}' for i in range(K))} FROM {level}"


CTES["x_lasso_b"] = f"""SELECT c.Sector, c.fold, p, 0 AS step, {", ".join(f"0.0::DOUBLE AS b{i}" for i in range(K))} FROM x_lasso_cov c, x_penalties UNION ALL {_sweep()}"""
_error = "yy - 2 * (" + " + ".join(["i0 * y", *(f"b{i} * c{i}" for i in range(K))]) + ") + n * i0 * i0 + 2 * i0 * (" + " + ".join(f"b{i} * a{i}" for i in range(K)) + ") + " + " + ".join(
    f"{'' if i == j else '2 * '}b{i} * b{j} * g{i}_{j}" for i in range(K) for j in range(i, K))
CTES["x_lasso_fit"] = "SELECT b.*, my - (" + " + ".join(f"a{i} * b{i}" for i in range(K)) + f") AS i0, {' + '.join(f'CAST(b{i} <> 0 AS INTEGER)' for i in range(K))} AS kept FROM x_lasso_b b JOIN x_lasso_cov g ON b.Sector = g.Sector AND b.fold = g.fold WHERE step = {SWEEPS}"
CTES["x_lasso_loss"] = f"""SELECT Sector, p, avg(e / v) AS loss FROM (SELECT b.Sector, p, {_error} AS e, yy - y * y / n AS v
    FROM x_lasso_fit b JOIN x_lasso_folds t ON b.Sector = t.Sector AND b.fold = t.fold) GROUP BY Sector, p"""
CTES["x_lasso"] = """SELECT f.*, alpha, loss FROM x_lasso_fit f JOIN x_lasso_loss l ON f.Sector = l.Sector AND f.p = l.p JOIN x_penalties w ON f.p = w.p WHERE f.fold = 0
    QUALIFY row_number() OVER (PARTITION BY f.Sector ORDER BY greatest(3 - kept, kept - 5, 0), loss, f.p) = 1"""
CTES["x_lasso_coef"] = " UNION ALL ".join(f"SELECT Sector, '{n}' AS Feature, b{i} AS FI FROM x_lasso WHERE b{i} <> 0" for i, n in enumerate(CANDIDATES))


def validated_models(m: Market):
    from panelforge.sources.readers import between
    return MO.fit_lasso_validated(between(m.model_target, *TRAIN), m.candidates, CANDIDATES, penalties=PENALTIES, folds=FOLDS)


@query("sector_penalties", "J3", "SELECT Sector, alpha * 1e6 AS Micro, CAST(kept AS BIGINT) AS Features, loss AS Loss, kept BETWEEN 3 AND 5 AS InRange, (SELECT string_agg(Feature, ' ' ORDER BY Feature) FROM x_lasso_coef c WHERE c.Sector = x_lasso.Sector) AS Kept FROM x_lasso", "Micro:3 Loss:5")
def sector_penalties(m: Market):
    """Each sector's penalty, the features it keeps out of all candidates, and its held-out error."""
    models = validated_models(m)
    names = F.array(*[F.lit(c) for c in CANDIDATES])
    kept = F.array_sort(F.transform(F.filter(F.arrays_zip(names.alias("n"), F.col("Coef").alias("c")), lambda z: z["c"] != 0), lambda z: z["n"]))
    return models.select("Sector", (F.col("Alpha") * 1e6).alias("Micro"), "Features", "Loss", (F.col("Status") == "ok").alias("InRange"), F.when(F.size(kept) > 0, F.array_join(kept, " ")).alias("Kept"))


@query("sector_lasso_importances", "J3 J4", "SELECT Sector, Feature, FI * 1e4 AS FI FROM x_lasso_coef", "FI:4")
def sector_lasso_importances(m: Market):
    """Coefficients that are not zero, in units of 1e-4 of return for a standard deviation."""
    return MO.feature_importances(validated_models(m), CANDIDATES).withColumn("FI", F.col("FI") * 1e4)


@query("sector_lasso_predictions", "J3 J6", f"""
    SELECT c.Date, c.Sector, (i0 + {" + ".join(f"({n} - mu{i}) / sd{i} * b{i}" for i, n in enumerate(CANDIDATES))}) * 1e4 AS Pred, Target
    FROM x_candidates c LEFT JOIN x_lasso l ON c.Sector = l.Sector LEFT JOIN x_lasso_scale s ON c.Sector = s.Sector LEFT JOIN x_residual t ON c.Date = t.Date AND c.Sector = t.Sector
    WHERE c.Date BETWEEN DATE '{TEST[0]}' AND DATE '{TEST[1]}'""", "Pred:2 Target:7")
def sector_lasso_predictions(m: Market):
    """A row for every sector and day of the test range, in units of 1e-4; the prediction is null where a feature is."""
    from panelforge.sources.readers import between
    found = MO.predict_lasso(validated_models(m), between(m.candidates, *TEST), CANDIDATES, m.model_target)
    return found.withColumn("Pred", F.col("Pred") * 1e4)


# One round of boosting with two leaves: every cut of every feature, nulls on either side, and sectors in order of their mean gradient.
BINS = 32
CTES["x_tree_rows"] = f"""SELECT c.*, 100 * t.Target AS y FROM x_candidates c JOIN x_residual t ON c.Date = t.Date AND c.Sector = t.Sector WHERE c.{IN_TRAIN} AND t.Target IS NOT NULL"""
CTES["x_tree_edges"] = " UNION ALL ".join(
    f"SELECT {i} AS f, list_sort(list_distinct(list_transform(quantile_cont({n}, [{', '.join(str(k / BINS) for k in range(1, BINS))}]), lambda v: round(v, 6) + 0.0))) AS edges FROM x_tree_rows" for i, n in enumerate(CANDIDATES))
CTES["x_tree_gradient"] = "SELECT *, (SELECT avg(y) FROM x_tree_rows) - y AS g FROM x_tree_rows"
CTES["x_tree_bins"] = "SELECT f, CASE WHEN x IS NULL THEN 0 ELSE 1 + len(list_filter(edges, lambda e: e < x)) END AS bin, any_value(edges) AS edges, sum(g) AS g, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT {i} AS f, {n} AS x, g FROM x_tree_gradient" for i, n in enumerate(CANDIDATES)) + ") JOIN x_tree_edges USING (f) GROUP BY f, bin"


def _part(g: str, n: str, l2: float = 0.0) -> str:
    return f"pow(greatest(abs({g}) - 0.5, 0), 2) / ({n} + {l2})"


CTES["x_tree_cuts"] = f"""SELECT f, Threshold, NullLeft, Feature, Categories, lg, ln, tg - lg AS rg, tn - ln AS rn FROM (
    SELECT f, edges[bin] AS Threshold, nl AS NullLeft, CASE f {" ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(CANDIDATES))} END AS Feature, NULL::VARCHAR[] AS Categories,
      sum(CASE WHEN bin > 0 THEN g ELSE 0 END) OVER w + CASE WHEN nl THEN sum(CASE WHEN bin = 0 THEN g ELSE 0 END) OVER a ELSE 0 END AS lg,
      sum(CASE WHEN bin > 0 THEN n ELSE 0 END) OVER w + CASE WHEN nl THEN sum(CASE WHEN bin = 0 THEN n ELSE 0 END) OVER a ELSE 0 END AS ln, sum(g) OVER a AS tg, sum(n) OVER a AS tn, bin
    FROM x_tree_bins, (VALUES (true), (false)) AS v(nl) WINDOW w AS (PARTITION BY f, nl ORDER BY bin), a AS (PARTITION BY f, nl)) WHERE bin > 0
  UNION ALL SELECT {K}, NULL, NULL, 'Sector', list_sort(list(Sector) OVER w), sum(g) OVER w, sum(n) OVER w, sum(g) OVER () - sum(g) OVER w, sum(n) OVER () - sum(n) OVER w
    FROM (SELECT Sector, sum(g) AS g, count(*) AS n FROM x_tree_gradient GROUP BY Sector) WINDOW w AS (ORDER BY g / (n + 10), Sector ROWS UNBOUNDED PRECEDING)"""
FIRST_SPLIT = f"""SELECT Feature, Threshold, NullLeft, CASE WHEN Categories IS NOT NULL THEN array_to_string(Categories, ' ') END AS Categories, Gain, CAST(ln AS BIGINT) AS LeftRows,
    -sign(lg) * greatest(abs(lg) - 0.5, 0) / ln AS LeftValue, CAST(rn AS BIGINT) AS RightRows, -sign(rg) * greatest(abs(rg) - 0.5, 0) / rn AS RightValue
  FROM (SELECT *, CASE WHEN f < {K} THEN {_part('lg', 'ln')} + {_part('rg', 'rn')} ELSE {_part('lg', 'ln', 10.0)} + {_part('rg', 'rn', 10.0)} END - {_part('(lg + rg)', '(ln + rn)')} AS Gain
    FROM x_tree_cuts WHERE ln >= 20 AND rn >= 20) ORDER BY Gain DESC, f, NullLeft DESC, Threshold LIMIT 1"""


def tree_inputs(m: Market):
    """What the trees learn from, the target in hundredths."""
    from panelforge.sources.readers import between
    return between(m.model_target, *TRAIN).withColumn("Target", F.col("Target") * 100), m.candidates


def first_split(m: Market, categorical):
    """The root of the first tree, grown to two leaves at learning rate 1."""
    target, features = tree_inputs(m)
    model = TR.fit_leafwise(target, features, CANDIDATES, categorical, rounds=1, leaves=2, learning_rate=1.0, bins=BINS)
    nodes = TR.split_table(model, m.spark)
    at = lambda i, column: F.max(F.when(F.col("Node") == i, F.col(column)))
    return nodes.groupBy("Tree").agg(
        *[at(0, c).alias(c) for c in ("Feature", "Threshold", "NullLeft")], F.array_join(F.array_sort(at(0, "Categories")), " ").alias("Categories"), at(0, "Gain").alias("Gain"),
        at(1, "Rows").alias("LeftRows"), at(1, "Value").alias("LeftValue"), at(2, "Rows").alias("RightRows"), at(2, "Value").alias("RightValue")).drop("Tree")


@query("boosted_first_split", "J5", FIRST_SPLIT, "Gain:6 LeftValue:7 RightValue:7 Threshold:6")
def boosted_first_split(m: Market):
    return first_split(m, ("Sector",))


@query("boosted_first_threshold", "J5", FIRST_SPLIT.replace("WHERE ln >= 20", f"WHERE f < {K} AND ln >= 20"), "Gain:6 LeftValue:7 RightValue:7 Threshold:6")
def boosted_first_threshold(m: Market):
    """The best cut among the numbers alone."""
    return first_split(m, ())


@query("boosted_tree_predictions", "J5 J13")
def boosted_tree_predictions(m: Market):
    """The sparse models' prediction enters the pooled trees as a feature of the same day: 7 leaves, L1 0.5, the sector as a category.

    A row for every sector and day of the test range, in hundredths; 20 rounds at 0.1.
    """
    from panelforge.sources.readers import between
    target, features = tree_inputs(m)
    linear = MO.predict_lasso(validated_models(m), features, CANDIDATES)
    stacked = reuse(D.append_model_output(features, linear, "linear"))
    model = TR.fit_leafwise(target, stacked, [*CANDIDATES, "linear"], rounds=20, learning_rate=0.1, bins=BINS)
    return TR.predict_leafwise(model, between(stacked, *TEST), m.model_target)
