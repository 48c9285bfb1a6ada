"""The market panels as SQL text, used to check the Spark plans against another engine."""

from __future__ import annotations

from panelforge.plans.market import SERIES

CTES: dict[str, str] = {}


def avg_rank(x: str, key: str = "Date", desc: bool = False) -> str:
    way = "DESC" if desc else "ASC"
    return (f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {key} ORDER BY {x} {way} NULLS LAST)"
            f" + (count(*) OVER (PARTITION BY {key}, {x}) - 1) / 2.0 END")


def band(f: str, x: str, n: int, lag: int, key: str = "Sector") -> str:
    w = f"OVER (PARTITION BY {key} ORDER BY Date ROWS BETWEEN {n + lag - 1} PRECEDING AND {lag} PRECEDING)"
    return f"CASE WHEN count({x}) {w} = {n} THEN {f}({x}) {w} END"


def code5(k: str) -> str:
    v = f"CAST({k} AS VARCHAR)"
    return f"(CASE WHEN length({v}) < 4 THEN lpad({v}, 4, '0') ELSE {v} END || '0')"


def code4(k: str) -> str:
    c = code5(k)
    return f"(CASE WHEN length({c}) = 5 AND right({c}, 1) = '0' THEN substr({c}, 1, 4) ELSE {c} END)"


QUOTE = """CAST(floor(sum(q * o) / sum(q)) AS DOUBLE) AS Open, CAST(max(greatest(o, c)) AS DOUBLE) AS High,
  CAST(min(least(o, c)) AS DOUBLE) AS Low, CAST(floor(sum(q * c) / sum(q)) AS DOUBLE) AS Close, CAST(sum(q) AS DOUBLE) AS Volume"""

CTES["x_lines"] = """SELECT *, (100 - d) * 104 AS o, (100 - d) * (100 + t) AS c FROM (
  SELECT CAST(l_shipdate AS DATE) AS Date, l_suppkey AS supp, l_orderkey AS ord, l_partkey AS part, l_linenumber AS num,
    l_linestatus AS status, l_returnflag AS flag, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
    CAST(round(l_discount * 100) AS BIGINT) AS d, CAST(round(l_tax * 100) AS BIGINT) AS t FROM lineitem)"""
CTES["x_raw_price"] = f"""SELECT Date, {code5('supp')} AS Code, supp, {QUOTE}, CAST(floor(sum(cents) / 100) AS DOUBLE) AS TurnoverValue,
  CASE WHEN min(d) = 10 AND min(t) = 8 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS AdjustmentFactor FROM x_lines GROUP BY Date, supp"""
CTES["x_traded"] = f"SELECT * EXCLUDE (supp) REPLACE ({code4('supp')} AS Code) FROM x_raw_price"
CTES["x_calendar"] = "SELECT DISTINCT Date FROM x_lines"
CTES["x_price"] = """SELECT CAST(day AS DATE) AS Date, Code, CASE WHEN day = Date THEN Open ELSE Close END AS Open,
    CASE WHEN day = Date THEN High ELSE Close END AS High, CASE WHEN day = Date THEN Low ELSE Close END AS Low, Close,
    CASE WHEN day = Date THEN Volume ELSE 0.0 END::DOUBLE AS Volume, CASE WHEN day = Date THEN TurnoverValue ELSE 0.0 END::DOUBLE AS TurnoverValue,
    CASE WHEN day = Date THEN AdjustmentFactor ELSE 1.0 END::DOUBLE AS AdjustmentFactor
  FROM (SELECT *, CAST(unnest(generate_series(Date, nxt - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM (
    SELECT *, coalesce(lead(Date) OVER (PARTITION BY Code ORDER BY Date), (SELECT max(Date) FROM x_calendar) + 1) AS nxt FROM x_traded))
  WHERE day IN (SELECT Date FROM x_calendar)"""


def _raw_fin(issued: str) -> str:
    return f"""SELECT CAST(supp AS VARCHAR) || '-' || CAST(qs AS VARCHAR) || '-' || status AS DisclosureNumber,
    CAST(CAST(pe + CAST(20 + sn % 5 AS INTEGER) AS DATE) AS VARCHAR) AS Date, CASE WHEN status = 'F' THEN '15:00:00' ELSE '16:30:00' END AS DisclosedTime,
    {code5('supp')} AS Code, CASE WHEN flag = 'R' THEN 'EarnForecastRevision' ELSE period || 'FinancialStatements' END AS TypeOfDocument,
    period AS TypeOfCurrentPeriod, CAST(pe AS VARCHAR) AS CurrentPeriodEndDate,
    CAST(CASE WHEN quarter(qs) = 1 THEN pe ELSE make_date(year(qs) + 1, 3, 31) END AS VARCHAR) AS CurrentFiscalYearEndDate,
    CAST({issued} AS VARCHAR) AS IssuedShares, CASE WHEN n % 5 = 0 THEN '' ELSE CAST(sn AS VARCHAR) END AS TreasuryShares,
    CASE WHEN period = 'FY' THEN '' ELSE eps END AS ForecastEarningsPerShare, CASE WHEN period = 'FY' THEN eps ELSE '' END AS NextYearForecastEarningsPerShare
  FROM (SELECT *, last_day(CAST(qs + INTERVAL 2 MONTH AS DATE)) AS pe, CASE quarter(qs) WHEN 1 THEN 'FY' WHEN 2 THEN '1Q' WHEN 3 THEN '2Q' ELSE '3Q' END AS period,
      CAST(CAST(floor(sc / sq / 100) AS BIGINT) AS VARCHAR) AS eps
    FROM (SELECT supp, CAST(date_trunc('quarter', Date) AS DATE) AS qs, status, CAST(sum(q) AS BIGINT) AS sq, CAST(sum(num) AS BIGINT) AS sn, count(*) AS n,
      CAST(sum(cents) AS BIGINT) AS sc, min(flag) AS flag FROM x_lines GROUP BY 1, 2, 3))"""


def _fin(raw: str) -> str:
    return f"""SELECT DISTINCT DisclosureNumber, Date, Code, TypeOfDocument, TypeOfCurrentPeriod, CurrentPeriodEndDate, CurrentFiscalYearEndDate,
    IssuedShares, TreasuryShares, F1 AS ForecastEarningsPerShare, F2 AS NextYearForecastEarningsPerShare, coalesce(F1, F2, 0.0)::DOUBLE AS ForecastEPS,
    IssuedShares - coalesce(TreasuryShares, 0.0) AS OutstandingShares, strftime(CurrentFiscalYearEndDate, '%Y') AS CurrentFiscalYear,
    strftime(CASE WHEN TypeOfCurrentPeriod = 'FY' THEN CAST(CurrentFiscalYearEndDate + INTERVAL 1 YEAR AS DATE) ELSE CurrentFiscalYearEndDate END, '%Y/%m') AS ForecastFiscalYearEndDate
  FROM (SELECT DisclosureNumber, CAST(Date AS DATE) AS Date, CASE WHEN length(Code) = 5 AND right(Code, 1) = '0' THEN substr(Code, 1, 4) ELSE Code END AS Code,
      TypeOfDocument, TypeOfCurrentPeriod, CAST(CurrentPeriodEndDate AS DATE) AS CurrentPeriodEndDate, CAST(CurrentFiscalYearEndDate AS DATE) AS CurrentFiscalYearEndDate,
      CAST(nullif(IssuedShares, '') AS DOUBLE) AS IssuedShares, CAST(nullif(TreasuryShares, '') AS DOUBLE) AS TreasuryShares,
      CAST(nullif(ForecastEarningsPerShare, '') AS DOUBLE) AS F1, CAST(nullif(NextYearForecastEarningsPerShare, '') AS DOUBLE) AS F2, DisclosedTime
    FROM {raw} WHERE TypeOfDocument NOT IN ('DividendForecastRevision', 'EarnForecastRevision', 'REITDividendForecastRevision', 'REITEarnForecastRevision'))
  QUALIFY row_number() OVER (PARTITION BY Code, Date ORDER BY DisclosedTime DESC, DisclosureNumber) = 1"""


CTES["x_raw_fin"] = _raw_fin("10000 + sq")
CTES["x_vol_raw_fin"] = _raw_fin("sq * 20 + 1000")
CTES["x_fin"] = _fin("x_raw_fin")
CTES["x_vol_fin"] = _fin("x_vol_raw_fin")
CTES["x_definition"] = f"SELECT {code4('s_suppkey')} AS Code, s_name AS CompanyName, n_name AS Sector FROM supplier JOIN nation ON s_nationkey = n_nationkey"
CTES["x_listing"] = f"""SELECT {code4('s_suppkey')} AS Code, s_name AS CompanyName, r_name AS MarketCodeName, n_name AS Sector33CodeName, r_name AS Sector17CodeName,
  CASE WHEN s_acctbal > 8500 THEN 'TOPIX Core30' WHEN s_acctbal > 6000 THEN 'TOPIX Large70' WHEN s_acctbal > 2500 THEN 'TOPIX Mid400'
    WHEN s_acctbal > 0 THEN 'TOPIX Small 1' ELSE '-' END AS ScaleCategory, CAST(1 AS BIGINT) AS Listing
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
CTES["x_daymap"] = """SELECT CAST(unnest(generate_series(coalesce(prev + 1, Date - 31), Date, INTERVAL 1 DAY)) AS DATE) AS Day, Date AS OpenDay
  FROM (SELECT Date, lag(Date) OVER (ORDER BY Date) AS prev FROM x_calendar)"""


def _shares(fin: str) -> str:
    return f"""SELECT OpenDay AS Date, Code, arg_max(OutstandingShares, Day) AS OutstandingShares FROM (
    SELECT Code, OutstandingShares, CurrentPeriodEndDate + 1 AS Day FROM {fin}
    QUALIFY row_number() OVER (PARTITION BY CurrentPeriodEndDate, Code ORDER BY Date DESC, OutstandingShares) = 1)
  JOIN x_daymap USING (Day) GROUP BY 1, 2"""


def _events(shares: str) -> str:
    w = "(PARTITION BY Code ORDER BY Date)"
    return f"""WITH s AS (SELECT p.Date, p.Code, p.AdjustmentFactor, s.OutstandingShares, s.Date IS NOT NULL AS settle FROM x_price p LEFT JOIN {shares} s ON p.Date = s.Date AND p.Code = s.Code),
  e AS (SELECT * REPLACE (first_value(OutstandingShares IGNORE NULLS) OVER (PARTITION BY Code ORDER BY Date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS OutstandingShares)
    FROM s WHERE OutstandingShares IS NOT NULL OR AdjustmentFactor <> 1),
  r AS (SELECT *, CASE WHEN coalesce(lag(AdjustmentFactor, 1) OVER {w}, 1) = 1 AND coalesce(lag(AdjustmentFactor, 2) OVER {w}, 1) = 1
      AND coalesce(lead(AdjustmentFactor, 1) OVER {w}, 1) = 1 AND coalesce(lead(AdjustmentFactor, 2) OVER {w}, 1) = 1 THEN 1.0::DOUBLE
      ELSE round_even(lead(OutstandingShares) OVER {w} / OutstandingShares, 1) END AS SharesRate FROM e)
  SELECT Date, Code, OutstandingShares, lag(SharesRate) OVER {w} AS SharesRate FROM r WHERE settle"""


def _caps(events: str) -> str:
    w = "(PARTITION BY Code ORDER BY Date)"
    down, up = "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING", "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return f"""WITH j AS (SELECT p.*, e.OutstandingShares, coalesce(lead(e.SharesRate) OVER (PARTITION BY p.Code ORDER BY p.Date), 1.0) AS SharesRate
    FROM x_price p LEFT JOIN {events} e ON p.Date = e.Date AND p.Code = e.Code),
  a AS (SELECT * REPLACE (coalesce(last_value(OutstandingShares IGNORE NULLS) OVER (PARTITION BY Code ORDER BY Date {up}),
      first_value(OutstandingShares IGNORE NULLS) OVER (PARTITION BY Code ORDER BY Date {down})) * product(SharesRate) OVER (PARTITION BY Code ORDER BY Date {down}) AS OutstandingShares) FROM j),
  m AS (SELECT Date, Code, Open, High, Low, Close, Volume, TurnoverValue, AdjustmentFactor, OutstandingShares, Open * OutstandingShares AS MarketCapOpen,
    Close * OutstandingShares AS MarketCapClose, High * OutstandingShares AS MarketCapHigh, Low * OutstandingShares AS MarketCapLow FROM a)
  SELECT *, MarketCapClose - Close * coalesce(lag(OutstandingShares) OVER {w}, 0) AS CorrectionValue FROM m"""


CTES["x_shares"] = _shares("x_fin")
CTES["x_vol_shares"] = _shares("x_vol_fin")
CTES["x_events"] = _events("x_shares")
CTES["x_vol_events"] = _events("x_vol_shares")
CTES["x_caps"] = _caps("x_events")
CTES["x_vol_caps"] = _caps("x_vol_events")
CTES["x_index_base"] = """SELECT Date, Sector, sum(MarketCapOpen) AS MarketCapOpen, sum(MarketCapClose) AS MarketCapClose, sum(MarketCapHigh) AS MarketCapHigh,
  sum(MarketCapLow) AS MarketCapLow, sum(OutstandingShares) AS OutstandingShares, sum(CorrectionValue) AS CorrectionValue
  FROM x_caps JOIN x_definition USING (Code) GROUP BY Date, Sector"""
INDEX_FROM_BASE = """SELECT *, coalesce(Close * MarketCapOpen / nullif(MarketCapClose, 0), 1.0) AS Open, coalesce(Close * MarketCapHigh / nullif(MarketCapClose, 0), 1.0) AS High,
    coalesce(Close * MarketCapLow / nullif(MarketCapClose, 0), 1.0) AS Low
  FROM (SELECT *, CASE WHEN "1d_rate" IS NOT NULL THEN product("1d_rate") OVER (PARTITION BY Sector ORDER BY Date ROWS UNBOUNDED PRECEDING) END AS Close
  FROM (SELECT *, "1d_return" + 1 AS "1d_rate" FROM (
    SELECT *, MarketCapClose / nullif(lag(MarketCapClose) OVER (PARTITION BY Sector ORDER BY Date) + CorrectionValue, 0) - 1 AS "1d_return" FROM {base})))"""
CTES["x_index"] = INDEX_FROM_BASE.format(base="x_index_base")
CTES["x_target"] = "SELECT Date, Sector, round(Close / nullif(Open, 0) - 1, 9) + 0.0 AS Target FROM x_index"
CTES["x_feat"] = f"""SELECT Date, Sector, lag(r1) OVER w AS r1, lag(m5) OVER w AS m5, lag(m21) OVER w AS m21, lag(v5) OVER w AS v5 FROM (
    SELECT Date, Sector, "1d_return" AS r1, {band('avg', '"1d_return"', 4, 1)} AS m5, {band('avg', '"1d_return"', 16, 5)} AS m21, {band('stddev_samp', '"1d_return"', 4, 1)} AS v5 FROM x_index)
    WINDOW w AS (PARTITION BY Sector ORDER BY Date)"""
CTES["x_residual"] = """SELECT Date, Sector, CAST(count(u) OVER d * u - sum(u) OVER d AS DOUBLE) / (count(u) OVER d * 1e9) AS Target
  FROM (SELECT Date, Sector, CAST(round(Target * 1e9) AS BIGINT) AS u FROM x_target) WINDOW d AS (PARTITION BY Date)"""


def _walked(x1: str, x2: str, frame: str) -> str:
    """Two-feature least squares in closed form, refitted every month on the months of the frame."""
    sums = {"n": "1.0", "a": "a", "b": "b", "y": "y", "aa": "a * a", "ab": "a * b", "bb": "b * b", "ay": "a * y", "b_y": "b * y"}
    return f"""WITH j AS (SELECT f.Date, f.Sector, year(f.Date) * 12 + month(f.Date) - 1 AS Month, {x1} AS a, {x2} AS b, t.Target AS y
    FROM x_feat f LEFT JOIN x_residual t ON f.Date = t.Date AND f.Sector = t.Sector),
  m AS (SELECT Sector, Month, {", ".join(f"coalesce(sum({v}) FILTER (a IS NOT NULL AND b IS NOT NULL AND y IS NOT NULL), 0) AS s_{k}" for k, v in sums.items())} FROM j GROUP BY Sector, Month),
  p AS (SELECT Sector, Month, {", ".join(f"sum(s_{k}) OVER w AS {k}" for k in sums)} FROM m WINDOW w AS (PARTITION BY Sector ORDER BY Month RANGE BETWEEN {frame} PRECEDING AND 1 PRECEDING)),
  c AS (SELECT Sector, Month, a / n AS ma, b / n AS mb, y / n AS my, aa / n - (a / n) * (a / n) AS caa, ab / n - (a / n) * (b / n) AS cab, bb / n - (b / n) * (b / n) AS cbb,
      ay / n - (a / n) * (y / n) AS cay, b_y / n - (b / n) * (y / n) AS cby FROM p WHERE n >= 60),
  k AS (SELECT *, caa > 0 AND cbb > 0 AND 1 - cab * cab / nullif(caa * cbb, 0) > 1e-10 AS regular, caa * cbb - cab * cab AS det FROM c),
  w AS (SELECT Sector, Month, ma, mb, my, CASE WHEN regular THEN (cay * cbb - cby * cab) / det ELSE 0 END AS wa, CASE WHEN regular THEN (caa * cby - cab * cay) / det ELSE 0 END AS wb FROM k)
  SELECT * FROM (SELECT j.Date, j.Sector, y AS Target, round(my + (a - ma) * wa + (b - mb) * wb, 7) + 0.0 AS Pred FROM j JOIN w ON j.Sector = w.Sector AND j.Month = w.Month) WHERE Pred IS NOT NULL"""


CTES["x_pred"] = _walked("r1", "m5", "UNBOUNDED")
CTES["x_slow"] = f"SELECT Date, Sector, Pred FROM ({_walked('m21', 'v5', '24')})"
_names = " ".join(f"WHEN '{n}{s}' THEN '{name}'" for (n, s), (name, _) in SERIES.items())
CTES["x_series"] = f"""SELECT Name, Date, {QUOTE} FROM (SELECT *, CASE CAST(num AS VARCHAR) || status {_names} END AS Name FROM x_lines) WHERE Name IS NOT NULL GROUP BY Name, Date"""
_rows = ", ".join(f"('{name}', '{group}', {str(name != 'NK225').lower()})" for name, group in SERIES.values())
CTES["x_catalogue"] = f"""SELECT * FROM (VALUES {_rows}) AS v(Name, "Group", is_adopted)"""
CTES["x_fills"] = f"""SELECT Date, {code4('supp')} AS Code, 'Supplier ' || CAST(supp AS VARCHAR) AS CompanyName, '東証' AS Market, q AS Shares, CAST(0 AS BIGINT) AS Fee, t AS Tax,
    CASE WHEN leg = 0 THEN CASE WHEN flag = 'A' THEN '信用新規売' ELSE '信用新規買' END ELSE CASE WHEN flag = 'A' THEN '信用返済買' ELSE '信用返済売' END END AS Type,
    CAST(CASE WHEN leg = 0 THEN o ELSE c END AS DOUBLE) AS Price FROM x_lines, (VALUES (0), (1)) AS l(leg)"""
CTES["x_ledger"] = f"""SELECT t.*, Sector FROM (SELECT *, CASE WHEN AcqAmount <> 0 THEN CAST(Profit AS DOUBLE) / CAST(AcqAmount AS DOUBLE) END AS Rate FROM (
    SELECT *, CAST(0 AS BIGINT) AS Fee, CASE WHEN Side = '買' THEN SettleAmount - AcqAmount ELSE AcqAmount - SettleAmount END AS Profit FROM (
    SELECT *, CAST(AcqPrice * Shares AS BIGINT) AS AcqAmount, CAST(SettlePrice * Shares AS BIGINT) AS SettleAmount FROM (
    SELECT Date, {code4('supp')} AS Code, CASE WHEN flag = 'A' THEN '売' ELSE '買' END AS Side, CAST(sum(q) AS BIGINT) AS Shares,
      CAST(floor(sum(q * o) / sum(q)) AS DOUBLE) AS AcqPrice, CAST(floor(sum(q * c) / sum(q)) AS DOUBLE) AS SettlePrice FROM x_lines GROUP BY 1, 2, 3)))) t
  LEFT JOIN x_definition d ON t.Code = d.Code"""
CTES["x_cash_raw"] = """SELECT o_orderkey AS Key, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS Date, CASE WHEN o_orderpriority = '1-URGENT' THEN '譲渡益税源泉徴収金' ELSE o_orderpriority END AS Text,
    CASE WHEN o_orderstatus = 'F' THEN v ELSE '-' END AS "Out", CASE WHEN o_orderstatus = 'O' THEN v ELSE '-' END AS "In", '-' AS TransferOut,
    CASE WHEN o_orderstatus = 'P' THEN v ELSE '-' END AS TransferIn FROM (SELECT *, format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS v FROM orders)"""
CTES["x_cash"] = """SELECT CAST(Date AS DATE) AS Date, Text, n("In") + n(TransferIn) - n("Out") - n(TransferOut) AS Amount FROM x_cash_raw WHERE NOT contains(Text, '譲渡益税')"""
for _c in ('"In"', "TransferIn", '"Out"', "TransferOut"):
    CTES["x_cash"] = CTES["x_cash"].replace(f"n({_c})", f"CAST(replace(CASE WHEN {_c} = '-' THEN '0' ELSE {_c} END, ',', '') AS BIGINT)")
CTES["x_deposits"] = """SELECT Date, CAST(1000000000 + flow AS BIGINT) AS Deposit FROM (
    SELECT Date, traded, sum(CASE WHEN Date = first THEN 0 ELSE flow END) OVER (ORDER BY Date ROWS UNBOUNDED PRECEDING) AS flow FROM (
      SELECT *, min(CASE WHEN traded THEN Date END) OVER () AS first FROM (
        SELECT Date, sum(flow) AS flow, bool_or(traded) AS traded FROM (
          SELECT Date, Amount AS flow, false AS traded FROM x_cash UNION ALL SELECT DISTINCT Date, 0, true FROM x_ledger) GROUP BY Date))
    WHERE Date >= first) WHERE traded"""
CTES["x_daily"] = """WITH d AS (SELECT Date, CAST(sum(AcqAmount) AS BIGINT) AS AcqAmount, CAST(sum(Profit) AS BIGINT) AS Profit FROM x_ledger GROUP BY Date),
  y AS (SELECT *, greatest(CAST(trunc(sum(Profit) OVER (PARTITION BY year(Date) ORDER BY Date ROWS UNBOUNDED PRECEDING) * 0.20315::DOUBLE) AS BIGINT), 0) AS ytd FROM d),
  t AS (SELECT *, ytd - coalesce(lag(ytd) OVER (PARTITION BY year(Date) ORDER BY Date), 0) AS DayTax FROM y)
  SELECT Date, AcqAmount, Profit, Profit / AcqAmount AS Rate, DayTax, Profit - DayTax AS ProfitAfterTax, (Profit - DayTax) / AcqAmount AS RateAfterTax FROM t"""
CTES["x_daily_sector"] = """WITH d AS (SELECT Sector, Date, CAST(sum(AcqAmount) AS BIGINT) AS AcqAmount, CAST(sum(Profit) AS BIGINT) AS Profit FROM x_ledger GROUP BY Sector, Date),
  y AS (SELECT *, greatest(CAST(trunc(sum(Profit) OVER (PARTITION BY Sector, year(Date) ORDER BY Date ROWS UNBOUNDED PRECEDING) * 0.20315::DOUBLE) AS BIGINT), 0) AS ytd FROM d),
  t AS (SELECT *, ytd - coalesce(lag(ytd) OVER (PARTITION BY Sector, year(Date) ORDER BY Date), 0) AS DayTax FROM y)
  SELECT s.Date, s.Side, s.Sector, AcqAmount, Profit, Profit / AcqAmount AS Rate, DayTax, Profit - DayTax AS ProfitAfterTax, (Profit - DayTax) / AcqAmount AS RateAfterTax
  FROM t JOIN (SELECT DISTINCT Date, Side, Sector FROM x_ledger) s ON t.Date = s.Date AND t.Sector = s.Sector"""
CTES["x_lev"] = """SELECT p.Date, p.Deposit, d.Profit, d.ProfitAfterTax, d.Profit / p.Deposit AS Rate, d.ProfitAfterTax / p.Deposit AS RateAfterTax FROM x_deposits p LEFT JOIN x_daily d ON p.Date = d.Date"""
CTES["x_result"] = f"""SELECT p.Date, p.Sector, p.Target, p.Pred, t.Target AS RawTarget, {avg_rank('p.Target', 'p.Date')} AS Target_Rank, {avg_rank('p.Pred', 'p.Date')} AS Pred_Rank
  FROM x_pred p LEFT JOIN x_target t ON p.Date = t.Date AND p.Sector = t.Sector"""
CTES["x_ls"] = """SELECT *, (Long + Short) / 2 AS LS FROM (SELECT Date, avg(CASE WHEN Pred_Rank > mx - 3 THEN RawTarget END) AS Long, avg(CASE WHEN Pred_Rank <= 3 THEN -RawTarget END) AS Short
  FROM (SELECT *, max(Pred_Rank) OVER (PARTITION BY Date) AS mx FROM x_result) GROUP BY Date)"""
CTES["x_perf"] = """WITH a AS (SELECT *, CASE WHEN Long IS NOT NULL THEN product(Long + 1) OVER w - 1 END AS L_Cumprod, CASE WHEN Short IS NOT NULL THEN product(Short + 1) OVER w - 1 END AS S_Cumprod,
    CASE WHEN LS IS NOT NULL THEN product(LS + 1) OVER w - 1 END AS LS_Cumprod
    FROM x_ls WINDOW w AS (ORDER BY Date ROWS UNBOUNDED PRECEDING)),
  b AS (SELECT *, 1 - (LS_Cumprod + 1) / max(LS_Cumprod + 1) OVER (ORDER BY Date ROWS UNBOUNDED PRECEDING) AS DD FROM a),
  c AS (SELECT *, CASE WHEN DD IS NOT NULL THEN max(DD) OVER (ORDER BY Date ROWS UNBOUNDED PRECEDING) END AS MaxDD, sum(CASE WHEN round(DD, 12) = 0 THEN 1 ELSE 0 END) OVER (ORDER BY Date ROWS UNBOUNDED PRECEDING) AS g FROM b),
  e AS (SELECT *, CAST(row_number() OVER (PARTITION BY g ORDER BY Date) - 1 AS INTEGER) AS DDdays FROM c)
  SELECT Date, LS, LS_Cumprod, DD, MaxDD, DDdays, max(DDdays) OVER (ORDER BY Date ROWS UNBOUNDED PRECEDING) AS MaxDDdays, Long, Short, L_Cumprod, S_Cumprod FROM e"""
