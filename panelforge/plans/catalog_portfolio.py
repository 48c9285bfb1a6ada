"""Queries over portfolio construction, similarity and clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions import scalar as S
from panelforge.functions import windows as P
from panelforge.operators import clustering as CL
from panelforge.operators import factors as FC
from panelforge.operators import portfolio as PO
from panelforge.operators import splitting as SP
from panelforge.plans.catalog_learning import _projector
from panelforge.plans.market import Market
from panelforge.plans.reference_sql import CTES, avg_rank, code4
from panelforge.plans.registry import query
from panelforge.session import reuse, stage_tight

MARGIN = 600_000_000.0
NEAR = 1.1


def step_sql(x: str, table, inclusive: bool) -> str:
    op = "<=" if inclusive else "<"
    return "CASE " + " ".join(f"WHEN {x} {op} {b} THEN {v}" for b, v in table if b is not None) + f" ELSE {table[-1][1]} END"


LIMIT = step_sql("o_totalprice", S.PRICE_LIMITS, False)
TICK = step_sql("p", S.SHORT_SALE_TICKS, True)


@query("daily_price_limits", "B23 L8", f"SELECT o_orderkey, CAST({LIMIT} AS INTEGER) AS PriceLimit, o_totalprice + {LIMIT} AS Upper, greatest(o_totalprice - {LIMIT}, 0) AS Lower FROM orders", "Upper:3 Lower:3")
def daily_price_limits(m: Market):
    p = F.col("o_totalprice")
    return m.table("orders").select("o_orderkey", S.price_limit(p).alias("PriceLimit"), S.upper_limit(p).alias("Upper"), S.lower_limit(p).alias("Lower"))


@query("short_sale_limit_prices", "B24", f"SELECT o_orderkey, CAST(ceil(p * 0.905::DOUBLE / ({TICK})) AS BIGINT) * ({TICK}) AS LimitPrice FROM (SELECT o_orderkey, o_totalprice / 8 AS p FROM orders)")
def short_sale_limit_prices(m: Market):
    return m.table("orders").select("o_orderkey", S.short_sale_limit_price(F.col("o_totalprice") / 8).alias("LimitPrice"))


CTES["x_limits"] = f"""SELECT {code4('s_suppkey')} AS Code, CASE WHEN s_suppkey % 4 = 0 THEN 1000000 ELSE s_suppkey % 7 + 1 END AS MaxUnit,
    (s_suppkey % 2 = 0 OR s_suppkey % 3 <> 0) AND s_suppkey % 11 <> 0 AS Sellable, s_suppkey % 2 = 0 AS isBorrowingStock FROM supplier"""


@query("trade_limits", "B25", "SELECT Code, CAST(MaxUnit AS BIGINT) AS MaxUnit, Sellable, isBorrowingStock FROM x_limits")
def trade_limits(m: Market):
    return PO.trade_limits(m.quotas, m.lending)


@query("sellable_symbols", "B25", "SELECT Code, CAST(MaxUnit AS BIGINT) AS MaxUnit, isBorrowingStock FROM x_limits WHERE Sellable")
def sellable_symbols(m: Market):
    return PO.sellable_symbols(PO.trade_limits(m.quotas, m.lending))


CTES["x_tradability"] = "SELECT Sector, count(*) AS Buy, CAST(sum(CASE WHEN Sellable THEN 1 ELSE 0 END) AS BIGINT) AS Sell, count(*) AS Total FROM x_definition JOIN x_limits USING (Code) GROUP BY Sector"


@query("sector_tradability", "C17 D17 L1", "SELECT * FROM x_tradability")
def sector_tradability(m: Market):
    return PO.sector_tradability(m.definition, PO.trade_limits(m.quotas, m.lending))


def tradable_predictions(m: Market, wanted: str = "true"):
    limits = PO.trade_limits(m.quotas, m.lending).filter(wanted)
    return PO.predictions_with_tradability(m.predictions, PO.sector_tradability(m.definition, limits))


CTES["x_predtrade"] = "SELECT p.*, coalesce(Buy, 0) AS Buy, coalesce(Sell, 0) AS Sell, Total, CAST(Buy / Total >= 0.5 AS INTEGER) AS Buyable, CAST(Sell / Total >= 0.5 AS INTEGER) AS Sellable FROM x_pred p LEFT JOIN x_tradability t USING (Sector)"


@query("predictions_with_tradability", "L1 F5 C17", f"SELECT Date, Sector, Buy, Sell, Total, Buyable, Sellable, CAST(trunc({avg_rank('Pred', desc=True)}) AS INTEGER) AS Rank FROM x_predtrade")
def predictions_with_tradability(m: Market):
    return PO.rank_predictions(tradable_predictions(m)).drop("Target", "Pred")


SELECTION = """WITH p AS (SELECT *, row_number() OVER (PARTITION BY Date ORDER BY Pred, Sector) AS lo, row_number() OVER (PARTITION BY Date ORDER BY Pred DESC, Sector DESC) AS hi FROM x_predtrade)
  SELECT Date, 'Short' AS Direction, row_number() OVER (PARTITION BY Date ORDER BY lo) AS ord, Sector FROM p WHERE lo <= {n} AND Sellable = 1 QUALIFY ord <= 3
  UNION ALL SELECT Date, 'Long', row_number() OVER (PARTITION BY Date ORDER BY hi) AS ord, Sector FROM p WHERE hi <= {n} AND Buyable = 1 QUALIFY ord <= 3"""
CTES["x_selected"] = SELECTION.format(n=5)
# Lending stocks only, three candidates for three places: the two sides of a day differ in number.
CTES["x_lend"] = """SELECT p.*, CAST(coalesce(Buy, 0) / Total >= 0.5 AS INTEGER) AS Buyable, CAST(coalesce(Sell, 0) / Total >= 0.5 AS INTEGER) AS Sellable FROM x_pred p
  JOIN (SELECT Sector, sum(CASE WHEN isBorrowingStock THEN 1 ELSE 0 END) AS Buy, sum(CASE WHEN isBorrowingStock AND Sellable THEN 1 ELSE 0 END) AS Sell, count(*) AS Total FROM x_definition JOIN x_limits USING (Code) GROUP BY Sector) t USING (Sector)"""
CTES["x_selected3"] = SELECTION.format(n=3).replace("x_predtrade", "x_lend")


def selected(m: Market):
    """A few rows per day, read by several later steps."""
    return reuse(PO.select_sectors(tradable_predictions(m), 3, 5))


@query("sectors_to_trade", "F2 L2", 'SELECT Date, Direction, CAST(ord AS INTEGER) AS "Order", Sector FROM x_selected')
def sectors_to_trade(m: Market):
    return selected(m)


@query("latest_predictions", "E36", "SELECT Date, Sector, Pred FROM x_pred WHERE Date = (SELECT max(Date) FROM x_pred)")
def latest_predictions(m: Market):
    return PO.latest_predictions(m.predictions.select("Date", "Sector", "Pred"))


FIVE = "CASE WHEN count(Volume) OVER w = 5 THEN avg(Volume) OVER w END AS Past5daysVolume"


@query("weight_components", "E29 L3", f"SELECT Date, Code, Close * 100 AS EstimatedCost, {FIVE} FROM x_price WINDOW w AS (PARTITION BY Code ORDER BY Date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)", "Past5daysVolume:3")
def weight_components(m: Market):
    return PO.weight_components(m.price.withColumn("MarketCapClose", F.lit(0.0))).drop("MarketCapClose")


@query("latest_weight_components", "E29", f"SELECT * FROM (SELECT Date, Code, Close * 100 AS EstimatedCost, {FIVE}, MarketCapClose FROM x_caps WINDOW w AS (PARTITION BY Code ORDER BY Date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE Date = (SELECT max(Date) FROM x_caps)", "Past5daysVolume:3 MarketCapClose:2")
def latest_weight_components(m: Market):
    from panelforge.operators import sector_index as SI
    return PO.latest_weight_components(SI.order_prices(m.caps))


CTES["x_weights"] = """SELECT c.Date, c.Code, CompanyName, Sector, Close * 100 AS EstimatedCost, MarketCapClose / sum(MarketCapClose) OVER (PARTITION BY c.Date, Sector) AS Weight
  FROM x_caps c JOIN x_definition d ON c.Code = d.Code"""


def weights(m: Market):
    return PO.sector_weights(PO.weight_components(m.caps), m.definition)


@query("sector_weights", "E30 L3 C18", "SELECT Date, Code, CompanyName, Sector, EstimatedCost, Weight FROM x_weights", "Weight:9")
def sector_weights(m: Market):
    return weights(m).select("Date", "Code", "CompanyName", "Sector", "EstimatedCost", "Weight")


CTES["x_tradable"] = """SELECT w.Date, s.Direction, w.Sector, w.Code, CompanyName, EstimatedCost, MaxUnit, CASE WHEN s.Direction = 'Short' THEN isBorrowingStock ELSE false END AS isBorrowingStock,
    Weight / sum(Weight) OVER (PARTITION BY w.Date, s.Direction, w.Sector) AS Weight
  FROM x_weights w JOIN x_selected s ON w.Date = s.Date AND w.Sector = s.Sector JOIN x_limits l ON w.Code = l.Code WHERE s.Direction = 'Long' OR Sellable"""


def tradable(m: Market, chosen=None):
    return PO.tradable_weights(weights(m), selected(m) if chosen is None else chosen, PO.trade_limits(m.quotas, m.lending))


@query("tradable_weights", "C18 E30", "SELECT Date, Direction, Sector, Code, isBorrowingStock, Weight FROM x_tradable", "Weight:9")
def tradable_weights(m: Market):
    return tradable(m).select("Date", "Direction", "Sector", "Code", "isBorrowingStock", "Weight")


CTES["x_gap"] = "SELECT Date, sum(CASE WHEN Direction = 'Short' THEN 1 ELSE -1 END) AS gap FROM x_selected3 GROUP BY Date"


@query("hedge_rows", "L4", """
    SELECT g.Date, CASE WHEN gap > 0 THEN 'Long' ELSE 'Short' END AS Direction, CASE WHEN gap > 0 THEN '1308' ELSE '1356' END AS Code, 'ETF' || CAST(i AS VARCHAR) AS Sector, CASE WHEN gap > 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS Weight, Close * 10 AS EstimatedCost
    FROM (SELECT Date, gap, unnest(range(CAST(abs(gap) AS BIGINT))) AS i FROM x_gap WHERE gap <> 0) g LEFT JOIN x_series s ON g.Date = s.Date AND s.Name = CASE WHEN gap > 0 THEN 'TOPIX' ELSE 'NK225' END""")
def hedge_rows(m: Market):
    etf = m.series.filter(F.col("Name").isin("TOPIX", "NK225")).select("Date", F.when(F.col("Name") == "TOPIX", "1308").otherwise("1356").alias("Code"), "Close")
    return PO.hedge_rows(PO.select_sectors(tradable_predictions(m, "isBorrowingStock"), 3, 3), etf).select("Date", "Direction", "Code", "Sector", "Weight", "EstimatedCost")


CTES["x_draft"] = f"""WITH b AS (SELECT *, {MARGIN} / 2 / (SELECT count(*) FROM x_selected s WHERE s.Date = t.Date AND s.Direction = t.Direction) AS MaxCost FROM x_tradable t),
  i AS (SELECT *, trunc(Weight * MaxCost) AS IdealCost FROM b), f AS (SELECT *, floor(IdealCost / EstimatedCost) * EstimatedCost AS below FROM i),
  r AS (SELECT *, abs(IdealCost - below) / nullif(abs(IdealCost - below - EstimatedCost), 0) AS ReductionRate FROM f)
  SELECT *, CASE WHEN ReductionRate <= 1 THEN below ELSE below + EstimatedCost END / EstimatedCost AS Unit FROM r"""


def draft(m: Market):
    chosen = selected(m)
    return PO.draft_units(tradable(m, chosen), PO.sector_budgets(chosen, MARGIN))


@query("draft_units", "L5", "SELECT Date, Direction, Sector, Code, MaxCost, Unit FROM x_draft", "MaxCost:2 Unit:3")
def draft_units(m: Market):
    return draft(m).select("Date", "Direction", "Sector", "Code", "MaxCost", "Unit")


@query("capped_units", "L6", "SELECT Date, Direction, Sector, Code, least(Unit, MaxUnit) AS Unit, least(Unit, MaxUnit) * EstimatedCost AS TotalCost, Unit >= MaxUnit AS isMaxUnit FROM x_draft", "Unit:3 TotalCost:2")
def capped_units(m: Market):
    return PO.cap_units(draft(m)).select("Date", "Direction", "Sector", "Code", "Unit", "TotalCost", "isMaxUnit")


CTES["x_reduced"] = """WITH c AS (SELECT * REPLACE (least(Unit, MaxUnit) AS Unit), Unit >= MaxUnit AS isMaxUnit FROM x_draft),
  s AS (SELECT *, sum(Unit * EstimatedCost) OVER (PARTITION BY Date, Direction, Sector) AS spent, ReductionRate >= 1 AND Unit > 0 AS cand FROM c),
  f AS (SELECT *, coalesce(sum(EstimatedCost) OVER (PARTITION BY Date, Direction, Sector, cand ORDER BY ReductionRate DESC, Weight DESC, Code ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM s)
  SELECT * EXCLUDE (spent, cand, freed) REPLACE (Unit - CASE WHEN cand AND spent - freed > MaxCost THEN 1 ELSE 0 END AS Unit) FROM f"""


@query("reduced_units", "L7", "SELECT Date, Direction, Sector, Code, Unit FROM x_reduced", "Unit:3")
def reduced_units(m: Market):
    return PO.reduce_to_budget(PO.cap_units(draft(m))).select("Date", "Direction", "Sector", "Code", "Unit")


# Lots are added one at a time: a group's stocks are lists, a step is a row.
CTES["x_groups"] = "SELECT Date, Direction, Sector, any_value(MaxCost) - sum(Unit * EstimatedCost) AS free, " + ", ".join(
    f"list({c} ORDER BY Weight DESC, Code) AS {a}" for c, a in (("Code", "code"), ("EstimatedCost", "cost"), ("IdealCost", "ideal"), ("MaxUnit", "most"), ("Unit", "unit"), ("ReductionRate", "rate"), ("isMaxUnit", "isfull"))) + \
    " FROM x_reduced GROUP BY Date, Direction, Sector"
_open = "list_transform(range(1, len(g.cost) + 1), lambda i: CASE WHEN g.cost[i] <= s.free AND NOT s.isfull[i] THEN s.rate[i] END)"
CTES["x_topups"] = f"""SELECT Date, Direction, Sector, 0 AS step, free, unit, rate, isfull FROM x_groups UNION ALL
  SELECT Date, Direction, Sector, step + 1, free - cost[k], list_transform(range(1, len(cost) + 1), lambda i: CASE WHEN i = k THEN unit[i] + 1 ELSE unit[i] END),
    list_transform(range(1, len(cost) + 1), lambda i: CASE WHEN i = k THEN abs(ideal[i] - (unit[i] + 1) * cost[i]) / greatest(abs(ideal[i] - (unit[i] + 2) * cost[i]), 1e-12) ELSE rate[i] END),
    list_transform(range(1, len(cost) + 1), lambda i: CASE WHEN i = k THEN unit[i] + 1 >= most[i] ELSE isfull[i] END)
  FROM (SELECT s.*, g.cost, g.ideal, g.most, list_position({_open}, list_min({_open})) AS k, list_min({_open}) AS least FROM x_topups s
    JOIN x_groups g ON s.Date = g.Date AND s.Direction = g.Direction AND s.Sector = g.Sector) WHERE least IS NOT NULL"""
UPPER = step_sql("EstimatedCost / 100", S.PRICE_LIMITS, False)
CTES["x_sized"] = f"""SELECT t.Date, t.Code, CompanyName, t.Sector, CAST(u.Unit AS INTEGER) AS Unit, EstimatedCost, u.Unit * EstimatedCost AS TotalCost, (EstimatedCost / 100 + {UPPER}) * 100 AS UpperLimitCost,
    (EstimatedCost / 100 + {UPPER}) * 100 * u.Unit AS UpperLimitTotal, t.Direction, isBorrowingStock
  FROM (SELECT f.Date, f.Direction, f.Sector, unnest(code) AS Code, unnest(f.unit) AS Unit FROM (SELECT * FROM x_topups QUALIFY row_number() OVER (PARTITION BY Date, Direction, Sector ORDER BY step DESC) = 1) f
    JOIN x_groups g ON f.Date = g.Date AND f.Direction = g.Direction AND f.Sector = g.Sector) u
  JOIN x_tradable t ON t.Date = u.Date AND t.Direction = u.Direction AND t.Sector = u.Sector AND t.Code = u.Code WHERE u.Unit > 0"""


def sized(m: Market):
    chosen = selected(m)
    return PO.size_orders(tradable(m, chosen), PO.sector_budgets(chosen, MARGIN))


@query("sized_orders", "L5 L6 L7 L8", "SELECT * FROM x_sized")
def sized_orders(m: Market):
    return sized(m)


CTES["x_turns"] = """SELECT *, row_number() OVER (PARTITION BY Date ORDER BY CumCost_byLS, Direction, Code) AS n FROM (
    SELECT *, sum(TotalCost) OVER (PARTITION BY Date, Direction ORDER BY Sector, TotalCost DESC, Code ROWS UNBOUNDED PRECEDING) AS CumCost_byLS FROM x_sized)"""
CTES["x_walk"] = f"""SELECT Date, CAST(0 AS BIGINT) AS n, CAST({MARGIN / 2} AS DOUBLE) AS free, false AS ok FROM (SELECT DISTINCT Date FROM x_turns) UNION ALL
  SELECT t.Date, t.n, CASE WHEN UpperLimitTotal <= free THEN free - UpperLimitTotal ELSE free END, UpperLimitTotal <= free FROM x_walk w JOIN x_turns t ON t.Date = w.Date AND t.n = w.n + 1"""


@query("admitted_orders", "L10 E31", "SELECT t.* EXCLUDE (n), CASE WHEN ok THEN 'accepted' ELSE 'refused' END AS Status FROM x_turns t JOIN x_walk w ON t.Date = w.Date AND t.n = w.n")
def admitted_orders(m: Market):
    """Half of the margin, so that a day's later orders run into the limit."""
    # Dealing by ranges reads its input twice, and these orders are few and long in the making.
    return PO.admit_orders(PO.add_running_cost(stage_tight(sized(m), "sized-orders")), MARGIN / 2)


CTES["x_orders"] = f"""SELECT Date, {code4('supp')} AS Code, 'Supplier ' || CAST(supp AS VARCHAR) AS CompanyName, status AS Model, CASE WHEN flag = 'A' THEN 'Short' ELSE 'Long' END AS Direction,
    CAST(sum(q) AS INTEGER) AS Unit, CAST(max(o) AS DOUBLE) * 100 AS EstimatedCost, CAST(min(c) AS DOUBLE) * 130 AS UpperLimitCost, sum(num) % 2 = 0 AS isBorrowingStock FROM x_lines GROUP BY ALL"""
CTES["x_orders"] = CTES["x_orders"].replace("GROUP BY ALL", "GROUP BY Date, supp, status, CASE WHEN flag = 'A' THEN 'Short' ELSE 'Long' END")


def two_model_orders(m: Market):
    """Line status stands for the model an order comes from."""
    rows = m.lines.groupBy("Date", "supp", F.col("status").alias("Model"), F.when(F.col("flag") == "A", "Short").otherwise("Long").alias("Direction")).agg(
        F.sum("q").cast("int").alias("Unit"), (F.max("o").cast("double") * 100).alias("EstimatedCost"), (F.min("c").cast("double") * 130).alias("UpperLimitCost"),
        (F.sum("num") % 2 == 0).alias("isBorrowingStock"))
    return rows.withColumns({"Code": m._code4(F.col("supp")), "CompanyName": F.concat(F.lit("Supplier "), F.col("supp").cast("string")), "Sector": F.lit("S")}).drop("supp")


@query("orders_netted", "D18 L9", """
    WITH g AS (SELECT Date, Code, CAST(sum(CASE WHEN Direction = 'Long' THEN Unit ELSE -Unit END) AS INTEGER) AS net, arg_min(EstimatedCost, Model || Direction) AS EstimatedCost,
      arg_min(UpperLimitCost, CASE WHEN Direction = 'Long' THEN '0' ELSE '1' END || Model) AS UpperLimitCost, arg_min(isBorrowingStock, CASE WHEN Direction = 'Long' THEN '0' ELSE '1' END || Model) AS isBorrowingStock FROM x_orders GROUP BY Date, Code)
    SELECT Date, Code, abs(net) AS Unit, CASE WHEN net > 0 THEN 'Long' ELSE 'Short' END AS Direction, abs(net) * EstimatedCost AS TotalCost, abs(net) * UpperLimitCost AS UpperLimitTotal, isBorrowingStock FROM g WHERE net <> 0""")
def orders_netted(m: Market):
    return PO.net_orders(two_model_orders(m)).select("Date", "Code", "Unit", "Direction", "TotalCost", "UpperLimitTotal", "isBorrowingStock")


@query("orders_running_cost", "E31", """
    SELECT Date, Code, Model, Direction, sum(Unit * EstimatedCost) OVER (PARTITION BY Date, Direction ORDER BY Model, Unit * EstimatedCost DESC, Code ROWS UNBOUNDED PRECEDING) AS CumCost_byLS FROM x_orders""")
def orders_running_cost(m: Market):
    rows = two_model_orders(m).withColumn("Sector", F.col("Model")).withColumn("TotalCost", F.col("Unit") * F.col("EstimatedCost"))
    return PO.add_running_cost(rows).select("Date", "Code", "Model", "Direction", "CumCost_byLS")


@query("margin_weights", "B28", "SELECT n_name AS Model, n_regionkey / sum(n_regionkey) OVER () AS margin_weight FROM nation", "margin_weight")
def margin_weights(m: Market):
    return PO.normalise_margin_weights(m.table("nation").select(F.col("n_name").alias("Model"), F.col("n_regionkey").cast("double").alias("margin_weight")))


CTES["x_labels"] = "SELECT CAST(date_trunc('month', Date) AS DATE) AS Run, Sector AS Item, CAST(sum(sign(Target)) AS BIGINT) AS Label FROM x_target GROUP BY 1, 2"
CTES["x_agree"] = "SELECT a.Item AS A, b.Item AS B, count(*) FILTER (a.Label = b.Label) AS Agreement FROM x_labels a JOIN x_labels b ON a.Run = b.Run GROUP BY 1, 2"


def month_labels(m: Market):
    """Up days minus down days of each sector and month as the run's label."""
    return m.target.groupBy(F.trunc("Date", "month").alias("Run"), F.col("Sector").alias("Item")).agg(F.sum(F.signum("Target")).cast("long").alias("Label"))


@query("label_agreement", "C21 N4", "SELECT * FROM x_agree")
def label_agreement(m: Market):
    names = [r[0] for r in m.definition.select("Sector").distinct().collect()]
    return CL.agreement_matrix(month_labels(m), names)


@query("mean_cluster_agreement", "N6", """
    WITH c AS (SELECT n_name AS Item, n_regionkey AS Cluster FROM nation)
    SELECT A AS Item, x.Cluster, avg(Agreement) AS MeanAgreement FROM x_agree JOIN c x ON A = x.Item JOIN c y ON B = y.Item WHERE x.Cluster = y.Cluster AND A <> B GROUP BY 1, 2""", "MeanAgreement")
def mean_cluster_agreement(m: Market):
    clusters = m.table("nation").select(F.col("n_name").alias("Item"), F.col("n_regionkey").alias("Cluster"))
    names = [r[0] for r in m.definition.select("Sector").distinct().collect()]
    return CL.mean_agreement(CL.agreement_matrix(month_labels(m), names), clusters)


CTES["x_vec"] = "SELECT min(vec_id) AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings GROUP BY embedding"
CTES["x_pairs"] = f"SELECT a.id AS a, b.id AS b, list_distance(a.v, b.v) AS distance FROM x_vec a JOIN x_vec b ON a.id < b.id WHERE list_distance(a.v, b.v) <= {NEAR}"


def vectors(m: Market):
    return m.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))


@query("pairs_within_distance", "C22", "SELECT a, b, distance FROM x_pairs", "distance")
def pairs_within_distance(m: Market):
    return CL.pairs_within(reuse(CL.distinct_vectors(vectors(m))), NEAR, block_rows=100)


@query("distance_groups", "N5", """
    WITH RECURSIVE e AS (SELECT a, b FROM x_pairs UNION SELECT b, a FROM x_pairs),
    r AS (SELECT id AS n, id AS m FROM x_vec UNION SELECT r.n, e.b FROM r JOIN e ON r.m = e.a)
    SELECT n AS id, min(m) AS "group" FROM r GROUP BY n""")
def distance_groups(m: Market):
    nodes = reuse(CL.distinct_vectors(vectors(m)))
    return CL.connected_groups(nodes, CL.pairs_within(nodes, NEAR, block_rows=100))


@query("best_cluster_count", "N7")
def best_cluster_count(m: Market):
    labelled, k = CL.best_clustering(vectors(m), (5, 10, 15))
    return labelled.groupBy("Cluster").agg(F.count(F.lit(1)).alias("Items")).withColumn("Candidates", F.lit(k))


# Recursive splits, level by level: a cut at the widest coordinate's mean, six moves of two centres, and the silhouette from sums.
LEAST_SEPARATION, MOVES, LEVELS = 0.03, 6, 12
CTES["x_point"] = "SELECT vec_id AS id, CAST(generate_subscripts(embedding, 1) AS INTEGER) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings"
CTES["x_open0"] = "SELECT vec_id AS id, '' AS path FROM embeddings"
for _l in range(LEVELS):
    CTES[f"x_cut{_l}"] = f"""SELECT path, d, m FROM (SELECT path, d, avg(x) AS m, avg(x * x) - avg(x) * avg(x) AS v FROM x_open{_l} JOIN x_point USING (id) GROUP BY path, d)
        QUALIFY row_number() OVER (PARTITION BY path ORDER BY v DESC, d) = 1"""
    CTES[f"x_side{_l}_0"] = f"SELECT id, path, CAST(x > m AS INTEGER) AS side FROM x_open{_l} JOIN x_cut{_l} USING (path) JOIN x_point USING (id, d)"
    for _t in range(MOVES):
        CTES[f"x_side{_l}_{_t + 1}"] = f"""WITH c AS (SELECT path, side, d, avg(x) AS m FROM x_side{_l}_{_t} JOIN x_point USING (id) GROUP BY path, side, d),
          e AS (SELECT o.id, o.path, c.side, sum((x - m) * (x - m)) AS e FROM x_open{_l} o JOIN c ON o.path = c.path JOIN x_point p ON p.id = o.id AND p.d = c.d GROUP BY o.id, o.path, c.side)
          SELECT id, path, CASE WHEN coalesce(min(e) FILTER (side = 1), 1e300) < coalesce(min(e) FILTER (side = 0), 1e300) THEN 1 ELSE 0 END AS side FROM e GROUP BY id, path"""
    _s = f"x_side{_l}_{MOVES}"
    CTES[f"x_apart{_l}"] = f"""WITH c AS (SELECT path, side, d, avg(x) AS m FROM {_s} JOIN x_point USING (id) GROUP BY path, side, d),
      n AS (SELECT path, side, count(*) AS n FROM {_s} GROUP BY path, side), q AS (SELECT path, side, sum(x * x) AS q FROM {_s} JOIN x_point USING (id) GROUP BY path, side),
      e AS (SELECT s.id, s.path, s.side, c.side AS other, sum(x * x) - 2 * sum(x * m) + any_value(q.q / n.n) AS e, any_value(n.n) AS n FROM {_s} s JOIN c ON s.path = c.path JOIN x_point p ON p.id = s.id AND p.d = c.d
        JOIN n ON n.path = c.path AND n.side = c.side JOIN q ON q.path = c.path AND q.side = c.side GROUP BY s.id, s.path, s.side, c.side),
      w AS (SELECT id, path, max(CASE WHEN side = other THEN n END) AS n, max(CASE WHEN side = other THEN e * n / greatest(n - 1, 1) END) AS a, max(CASE WHEN side <> other THEN e END) AS b FROM e GROUP BY id, path)
      SELECT path, avg(CASE WHEN n > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END) AS s FROM w GROUP BY path HAVING count(b) > 0"""
    CTES[f"x_open{_l + 1}"] = f"SELECT id, path || CAST(side AS VARCHAR) AS path FROM {_s} JOIN x_apart{_l} USING (path) WHERE s >= {LEAST_SEPARATION}"
CTES["x_paths"] = "SELECT id, arg_max(path, length(path)) AS path FROM (" + " UNION ALL ".join(f"SELECT id, path FROM x_open{_l}" for _l in range(LEVELS + 1)) + ") GROUP BY id"


@query("recursive_clusters", "N8", "SELECT id, path AS Path, dense_rank() OVER (ORDER BY path) - 1 AS Cluster FROM x_paths")
def recursive_clusters(m: Market):
    """Split until nothing splits; the statement goes twelve levels deep."""
    return SP.recursive_splits(vectors(m), LEAST_SEPARATION, MOVES)


@query("labels_with_listing", "N9", "SELECT Code, CompanyName, MarketCodeName, Sector33CodeName, Sector17CodeName, ScaleCategory, Listing, CAST(length(Sector33CodeName) AS INTEGER) AS Cluster FROM x_listing")
def labels_with_listing(m: Market):
    return CL.attach_listing(m.definition.select("Code", F.length("Sector").alias("Cluster")), m.listing)


CTES["x_g0"] = "SELECT a.Sector AS i, b.Sector AS j, sum(a.Target * b.Target) AS v FROM x_dense a JOIN x_dense b ON a.Date = b.Date GROUP BY 1, 2"
CTES["x_gc"] = "SELECT g.i, g.j, v - avg(v) OVER (PARTITION BY g.i) - avg(v) OVER (PARTITION BY g.j) + avg(v) OVER () AS v FROM x_g0 g"
G1 = _projector("x_gp", "x_gc")


CTES["x_gl1"] = f"SELECT sum(a.v * b.v) AS l FROM x_gc a JOIN {G1} b ON a.j = b.i AND a.i = b.j"
CTES["x_gc1"] = f"SELECT a.i, a.j, a.v - l * b.v AS v FROM x_gc a JOIN {G1} b ON a.i = b.i AND a.j = b.j, x_gl1"
G2 = _projector("x_g2", "x_gc1")
CTES["x_gl2"] = f"SELECT sum(a.v * b.v) AS l FROM x_gc a JOIN {G2} b ON a.j = b.i AND a.i = b.j"


@query("sector_coordinates", "I11", f"SELECT p.i AS Sector, p.v * x_gl1.l * 1e4 AS Square0, r.v * x_gl2.l * 1e4 AS Square1 FROM {G1} p JOIN {G2} r ON p.i = r.i AND p.j = r.j, x_gl1, x_gl2 WHERE p.i = p.j", "Square0:5 Square1:5")
def sector_coordinates(m: Market):
    """Squares of the coordinates, whose signs are a convention, in units of 1e-4."""
    coords = FC.item_coordinates(m.target, 2)
    return coords.select("Sector", *[(F.col(f"Feature{i}") * F.col(f"Feature{i}") * 1e4).alias(f"Square{i}") for i in range(2)])


@query("peer_moves", "C1 E14", "SELECT Date, Code, Close / nullif(lag(Close) OVER (PARTITION BY Code ORDER BY Date), 0) - 1 AS Move FROM x_traded", "Move")
def peer_moves(m: Market):
    return m.traded.select("Date", "Code", P.pct_change("Close", "Code").alias("Move"))
