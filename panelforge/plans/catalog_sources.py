"""Queries over sources, upserts, readers and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions import scalar as S
from panelforge.operators import cleaning as C
from panelforge.operators import quality as Q
from panelforge.plans.market import TEST, TRAIN, Market

from panelforge.plans.registry import query, scratch
from panelforge.sources import files as IO
from panelforge.sources import readers as R
from panelforge.sources import upserts as U
from panelforge.sources.bundle import DatasetBundle

SPLIT_DAY = "1999-01-01"
OHLCV = "Open High Low Close Volume"


@query("parquet_scan_columns", "A1", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def parquet_scan_columns(m: Market):
    return IO.read_parquet(m.spark, f"{m.dir}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"])


@query("parquet_panel_sink", "A2 A3", "SELECT Date, Code, Close, Volume, CAST(year(Date) AS INTEGER) AS Year FROM x_traded")
def parquet_panel_sink(m: Market):
    path = scratch(m.spark) + "/price"
    IO.write_panel(m.traded.select("Date", "Code", "Close", "Volume"), path)
    return IO.read_parquet(m.spark, path)


@query("sector_partition_sink", "H3 A3", "SELECT Sector, count(*) AS Days, CAST(max(Date) AS DATE) AS LastDay FROM x_index GROUP BY Sector")
def sector_partition_sink(m: Market):
    path = scratch(m.spark) + "/sectors"
    IO.write_by_sector(m.index.select("Date", "Sector", "Close"), path)
    return IO.read_parquet(m.spark, path).groupBy("Sector").agg(F.count(F.lit(1)).alias("Days"), F.max("Date").alias("LastDay"))


@query("csv_after_free_text", "A5", "SELECT Code, CompanyName FROM x_definition")
def csv_after_free_text(m: Market):
    """Exports in shift_jis, one a sector, with free text above the header."""
    path = f"{scratch(m.spark)}/export"
    stocks = m.definition.select("Sector", F.lit(2).alias("line"), "Code", "CompanyName")
    above = m.definition.select("Sector").distinct().select("Sector", F.inline(F.array(
        F.struct(F.lit(0).alias("line"), F.lit("信用取引 取扱銘柄一覧").alias("Code"), F.lit("現在").alias("CompanyName")),
        F.struct(F.lit(1).alias("line"), F.lit("コード").alias("Code"), F.lit("銘柄名").alias("CompanyName")))))
    rows = stocks.unionByName(above).repartition("Sector").sortWithinPartitions("Sector", "line", "Code")
    rows.select("Code", "CompanyName", "Sector").write.option("encoding", "shift_jis").partitionBy("Sector").csv(path)
    return IO.read_csv_after_marker(m.spark, path, ["Code", "CompanyName"], "コード")


@query("csv_round_trip", "A4 A6", "SELECT Code, CompanyName, Sector FROM x_definition")
def csv_round_trip(m: Market):
    path = scratch(m.spark) + "/definition"
    IO.write_csv(m.definition, path)
    return IO.read_csv(m.spark, path, "Code string, CompanyName string, Sector string")


@query("vendor_series_normalised", "A12",
       "SELECT Name, Date, Close, Open, High, Low FROM x_series")
def vendor_series_normalised(m: Market):
    text = lambda c: F.format_number(c, 0)
    export = m.series.select(
        F.col("Date").cast("string").alias("日付"), text("Close").alias("終値"), text("Open").alias("始値"),
        text("High").alias("高値"), text("Low").alias("安値"), F.lit("x").alias("出来高"), "Name")
    return IO.normalise_vendor_series(export, keep=["Name"])


def _between(days: tuple[str, str]) -> str:
    return f"Date BETWEEN DATE '{days[0]}' AND DATE '{days[1]}'"


BUNDLE = {
    "target_train": ("Sector", "Target", f"x_target WHERE {_between(TRAIN)}"), "target_test": ("Sector", "Target", f"x_target WHERE {_between(TEST)}"),
    "features_train": ("Sector", "Pred", f"x_slow WHERE {_between(TRAIN)}"), "features_test": ("Sector", "Pred", f"x_slow WHERE {_between(TEST)}"),
    "raw_returns": ("Sector", "Target", "x_target"), "pred_result": ("Sector", "Pred", "x_slow"), "order_price": ("Code", "Close", "x_traded"),
    "coefficients": ("Sector", "Level", "(SELECT max(Date) AS Date, Sector, max(Target) AS Level FROM x_target GROUP BY Sector)")}


@query("dataset_bundle_round_trip", "A16", " UNION ALL ".join(
    f"SELECT '{n}' AS TableName, Date, {k} AS Key, {v} AS Value FROM {source}" for n, (k, v, source) in BUNDLE.items()), "Value:9")
def dataset_bundle_round_trip(m: Market):
    """All eight tables of a data set after saving, with one output replaced, row by row."""
    from panelforge.sources.readers import between
    target, pred = m.target.select("Date", "Sector", "Target"), m.slow_predictions
    levels = target.groupBy("Sector").agg(F.max("Date").alias("Date"), F.max("Target").alias("Level"))
    tables = {"target_train": between(target, *TRAIN), "target_test": between(target, *TEST), "features_train": between(pred, *TRAIN), "features_test": between(pred, *TEST),
              "raw_returns": target, "pred_result": m.predictions, "order_price": m.traded.select("Date", "Code", "Close"), "coefficients": levels}
    path = scratch(m.spark) + "/bundle"
    DatasetBundle(tables, {"k": 3}).replace(pred_result=pred).save(m.spark, path)
    back = DatasetBundle.load(m.spark, path)
    if set(back.tables) != set(BUNDLE) or back.params != {"k": 3}:
        raise ValueError("the bundle lost a table or its parameters")
    rows = [back[n].select(F.lit(n).alias("TableName"), "Date", F.col(k).alias("Key"), F.col(v).cast("double").alias("Value")) for n, (k, v, _) in BUNDLE.items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


@query("price_upsert_old_wins", "A7 G1", f"""
    SELECT Date, Code, CASE WHEN Date < DATE '{SPLIT_DAY}' THEN Close ELSE Close + 1 END AS Close FROM x_traded""")
def price_upsert_old_wins(m: Market):
    """Stored rows up to a day, a fresh extract that overlaps all of them with other prices."""
    cols = m.traded.select("Date", "Code", "Close")
    old = cols.filter(F.col("Date") < SPLIT_DAY)
    return U.upsert_prices(old, cols.withColumn("Close", F.col("Close") + 1))


@query("disclosure_upsert_new_wins", "A8 C20", """
    SELECT DisclosureNumber, Date, Code, CASE WHEN TypeOfCurrentPeriod = 'FY' THEN 'restated' ELSE TypeOfDocument END AS TypeOfDocument FROM x_raw_fin""")
def disclosure_upsert_new_wins(m: Market):
    stored = m.raw_fin.select("DisclosureNumber", "Date", "Code", "TypeOfDocument")
    fresh = m.raw_fin.filter("TypeOfCurrentPeriod = 'FY'").select("DisclosureNumber", "Date", "Code", F.lit("restated").alias("TypeOfDocument"))
    return U.upsert_disclosures(stored, fresh)


@query("listing_snapshot_merge", "A9 G4", "SELECT Code, CompanyName, ScaleCategory, CAST(CASE WHEN ScaleCategory <> '-' THEN 1 ELSE 0 END AS BIGINT) AS Listing FROM x_listing")
def listing_snapshot_merge(m: Market):
    stored = m.listing.select("Code", "CompanyName", "ScaleCategory", "Listing")
    return U.merge_listing(stored, stored.filter("ScaleCategory <> '-'"))


@query("series_upsert", "A10 C20", f"""
    SELECT Name, Date, CASE WHEN Date >= DATE '{SPLIT_DAY}' THEN Close + 10000 ELSE Close END AS Close, Open FROM x_series""")
def series_upsert(m: Market):
    """New dates arrive as text with separators, twice per date; the second one counts."""
    rows = m.series.select("Name", "Date", "Close", "Open")
    recent = rows.filter(F.col("Date") >= SPLIT_DAY)
    as_text = lambda add, seq: recent.select(
        "Name", "Date", F.format_number(F.col("Close") + add, 0).alias("Close"), F.format_number("Open", 0).alias("Open"), F.lit(seq).alias("_seq"))
    stored = rows.select("Name", "Date", F.col("Close").cast("string").alias("Close"), F.col("Open").cast("string").alias("Open"))
    return U.upsert_series(stored, as_text(5000, 1).unionByName(as_text(10000, 2)), numeric=("Close", "Open")).drop("_seq")


@query("series_append_latest", "A11", """
    SELECT Name, Date, CASE WHEN Date = max(Date) OVER (PARTITION BY Name) THEN -Close ELSE Close END AS Close FROM x_series""")
def series_append_latest(m: Market):
    rows = m.series.select("Name", "Date", "Close")
    latest = rows.groupBy("Name").agg(F.max("Date").alias("Date"), F.max_by("Close", "Date").alias("Close"))
    return U.append_latest(rows, latest.select("Name", "Date", (-F.col("Close")).alias("Close")))


@query("universe_filter", "A13", """
    SELECT Code, count(*) AS Days FROM x_traded WHERE Code IN (SELECT Code FROM x_listing WHERE Listing = 1 AND ScaleCategory IN ('TOPIX Core30', 'TOPIX Large70', 'TOPIX Mid400')) GROUP BY Code""")
def universe_filter(m: Market):
    chosen = "(Listing = 1) and ((ScaleCategory = 'TOPIX Core30') or (ScaleCategory = 'TOPIX Large70') or (ScaleCategory = 'TOPIX Mid400'))"
    return R.filter_universe(m.traded, m.listing, chosen, codes=["0001"]).groupBy("Code").agg(F.count(F.lit(1)).alias("Days"))


@query("end_date_filter", "A14", f"SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS Date FROM lineitem WHERE l_shipdate <= DATE '{SPLIT_DAY}'")
def end_date_filter(m: Market):
    rows = m.table("lineitem").filter(F.col("l_shipdate") <= F.lit(SPLIT_DAY).cast("timestamp"))
    return R.until(rows.select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("Date")), SPLIT_DAY)


@query("date_range_filter", "B29", f"SELECT Date, Code, Close FROM x_traded WHERE Date BETWEEN DATE '1997-01-01' AND DATE '{SPLIT_DAY}'")
def date_range_filter(m: Market):
    return R.between(m.traded, "1997-01-01", SPLIT_DAY).select("Date", "Code", "Close")


FACTOR = "coalesce(product(AdjustmentFactor) OVER (PARTITION BY Code ORDER BY Date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1.0)"


@query("cumulative_adjustment_factor", "E1", f"SELECT Date, Code, {FACTOR} AS CumulativeAdjustmentFactor FROM x_traded")
def cumulative_adjustment_factor(m: Market):
    return C.add_cumulative_adjustment(m.traded).select("Date", "Code", "CumulativeAdjustmentFactor")


@query("adjusted_prices", "B13", f"SELECT Date, Code, Open * f AS Open, High * f AS High, Low * f AS Low, Close * f AS Close, Volume * f AS Volume FROM (SELECT *, {FACTOR} AS f FROM x_traded)", OHLCV)
def adjusted_prices(m: Market):
    return C.apply_adjustment(C.add_cumulative_adjustment(m.traded)).select("Date", "Code", *OHLCV.split())


@query("manual_split_factor", "B12", f"""
    SELECT Date, Code, {FACTOR} * CASE WHEN Code = '0001' AND Date < DATE '1998-04-01' THEN 10.0 ELSE 1.0 END
      * CASE WHEN Code = '0001' AND Date < DATE '2000-04-01' THEN 2.0 ELSE 1.0 END * CASE WHEN Code = '0005' AND Date < DATE '1999-10-01' THEN 0.5 ELSE 1.0 END
      AS CumulativeAdjustmentFactor FROM x_traded""", "CumulativeAdjustmentFactor:9")
def manual_split_factor(m: Market):
    table = m.spark.createDataFrame(
        [("0001", "1998-04-01", 10.0), ("0001", "2000-04-01", 2.0), ("0005", "1999-10-01", 0.5)], "Code string, Before string, Rate double")
    table = table.withColumn("Before", F.col("Before").cast("date"))
    return C.add_manual_adjustment(C.add_cumulative_adjustment(m.traded), table).select("Date", "Code", "CumulativeAdjustmentFactor")


@query("prices_rebased", "A15", f"""
    SELECT Date, Code, Open * k AS Open, Close * k AS Close, Volume * k AS Volume FROM (
      SELECT *, last_value(f) OVER (PARTITION BY Code ORDER BY Date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS k FROM (
        SELECT *, {FACTOR} AS f FROM x_traded) WHERE Date <= DATE '{SPLIT_DAY}')""", "Open Close Volume")
def prices_rebased(m: Market):
    """A period that ends before the last split has a last factor other than 1."""
    priced = C.add_cumulative_adjustment(m.traded)
    return R.read_prices(priced, m.listing, end=SPLIT_DAY).select("Date", "Code", "Open", "Close", "Volume")


REPLACED = "CASE Code WHEN '0001' THEN '0090' WHEN '0002' THEN '0091' ELSE Code END"


@query("code_normalise_and_replace", "B2 B3 B4", f"SELECT {REPLACED} AS Code, count(*) AS Days, CAST(max(Date) AS DATE) AS LastDay FROM x_traded GROUP BY 1")
def code_normalise_and_replace(m: Market):
    code = S.replace_code(S.normalise_code(F.col("Code")), {"0001": "0090", "0002": "0091"})
    rows = m.raw_price.select(code.alias("Code"), S.day(F.col("Date").cast("timestamp")).alias("Date"))
    return rows.groupBy("Code").agg(F.count(F.lit(1)).alias("Days"), F.max("Date").alias("LastDay"))


@query("outage_day_removed", "B11", f"SELECT Date, Code, Close FROM x_traded WHERE Date <> DATE '{SPLIT_DAY}'")
def outage_day_removed(m: Market):
    return C.drop_outage_day(m.traded, SPLIT_DAY).select("Date", "Code", "Close")


@query("suspension_fill", "E2 G4", """
    WITH p AS (SELECT flag AS Code, Date, CAST(max(c) AS DOUBLE) AS Close, 1.0::DOUBLE AS AdjustmentFactor FROM x_lines GROUP BY flag, Date),
    e AS (SELECT Code FROM p GROUP BY Code HAVING (SELECT count(DISTINCT Date) FROM p) - count(DISTINCT Date) <= 500),
    g AS (SELECT d.Date, e.Code, p.Close FROM (SELECT DISTINCT Date FROM p) d CROSS JOIN e LEFT JOIN p ON p.Date = d.Date AND p.Code = e.Code),
    f AS (SELECT Date, Code, Close, last_value(Close IGNORE NULLS) OVER (PARTITION BY Code ORDER BY Date ROWS UNBOUNDED PRECEDING) AS fill FROM g)
    SELECT Date, Code, Close, Close AS Open, CAST(NULL AS DOUBLE) AS Volume FROM p UNION ALL SELECT Date, Code, fill, fill, 0.0 FROM f WHERE Close IS NULL AND fill IS NOT NULL""")
def suspension_fill(m: Market):
    """Three instruments (one per return flag), all of them renamed ones."""
    rows = m.lines.groupBy(F.col("flag").alias("Code"), "Date").agg(F.max("c").cast("double").alias("Close"), F.lit(1.0).alias("AdjustmentFactor"))
    rows = rows.select("Date", "Code", F.col("Close").alias("Open"), F.col("Close").alias("High"), F.col("Close").alias("Low"), "Close", "AdjustmentFactor")
    return C.fill_suspensions(rows, ["A", "N", "R"], max_missing=500).select("Date", "Code", "Close", "Open", "Volume")


@query("clean_prices_chain", "B2 B3 B4 B11 E1 B12 B13", f"""
    SELECT Date, Code, Open * f AS Open, Close * f AS Close, Volume * f AS Volume, f AS CumulativeAdjustmentFactor, TurnoverValue FROM (
      SELECT *, {FACTOR} AS f FROM x_traded WHERE Date <> DATE '2020-10-01')""", "Open Close Volume")
def clean_prices_chain(m: Market):
    return C.clean_prices(m.raw_price, replacements={}, manual=()).select("Date", "Code", "Open", "Close", "Volume", "CumulativeAdjustmentFactor", "TurnoverValue")


@query("rename_and_cast", "B1 B4 B5", """
    SELECT CAST(Date AS DATE) AS DisclosedOn, Code AS LocalCode, TRY_CAST(nullif(TreasuryShares, '') AS DOUBLE) AS Treasury, CAST(IssuedShares AS BIGINT) AS Issued FROM x_raw_fin""")
def rename_and_cast(m: Market):
    text = m.raw_fin.withColumn("TreasuryShares", S.blank_to_null(F.col("TreasuryShares")))
    return C.rename_and_cast(text, [("Date", "DisclosedOn", "date"), ("Code", "LocalCode", "string"), ("TreasuryShares", "Treasury", "double"), ("IssuedShares", "Issued", "bigint")])


@query("full_disclosures_latest", "B6 E3", f"""
    SELECT Date, Code, DisclosureNumber FROM x_raw_fin WHERE TypeOfDocument NOT IN ('EarnForecastRevision')
    QUALIFY row_number() OVER (PARTITION BY Code, Date ORDER BY DisclosedTime DESC, DisclosureNumber) = 1""")
def full_disclosures_latest(m: Market):
    return C.latest_disclosure(m.raw_fin).select("Date", "Code", "DisclosureNumber")


@query("fundamental_columns", "B7 B8 B9", """
    SELECT Code, Date, DisclosureNumber, ForecastEPS, OutstandingShares, CurrentFiscalYear, ForecastFiscalYearEndDate FROM x_fin""")
def fundamental_columns(m: Market):
    return m.fin.select("Code", "Date", "DisclosureNumber", "ForecastEPS", "OutstandingShares", "CurrentFiscalYear", "ForecastFiscalYearEndDate")


_LAST = "last_value({0} IGNORE NULLS) OVER (PARTITION BY s ORDER BY Date ROWS UNBOUNDED PRECEDING)"
_NEXT = "first_value({0} IGNORE NULLS) OVER (PARTITION BY s ORDER BY Date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_FILL = lambda c: f"coalesce({_LAST.format(c)}, {_NEXT.format(c)}) AS {c}"


@query("merger_synthesis", "C11", f"""
    WITH b AS (SELECT Date, CASE WHEN Code = '0001' THEN 1 ELSE 2 END AS s, IssuedShares, TreasuryShares, OutstandingShares, ForecastEPS FROM x_fin
        WHERE Code = '0002' OR (Code = '0001' AND Date <= DATE '1998-06-30')),
    g AS (SELECT d.Date, k.s, b.IssuedShares, b.TreasuryShares, b.OutstandingShares, b.ForecastEPS FROM (SELECT DISTINCT Date FROM b) d CROSS JOIN (VALUES (1), (2)) AS k(s)
        LEFT JOIN b ON b.Date = d.Date AND b.s = k.s),
    f AS (SELECT Date, s, {_FILL('IssuedShares')}, {_FILL('TreasuryShares')}, {_FILL('OutstandingShares')}, {_FILL('ForecastEPS')} FROM g)
    SELECT Date, Code, IssuedShares, TreasuryShares, OutstandingShares, ForecastEPS FROM x_fin WHERE Code NOT IN ('0001', '0002') OR (Code = '0001' AND Date > DATE '1998-06-30')
    UNION ALL SELECT a.Date, '0001', a.IssuedShares + b2.IssuedShares, a.TreasuryShares + b2.TreasuryShares, a.OutstandingShares + b2.OutstandingShares * 1.2, a.ForecastEPS
    FROM f a JOIN f b2 ON a.Date = b2.Date AND a.s = 1 AND b2.s = 2""", "OutstandingShares:3 IssuedShares:3 TreasuryShares:3")
def merger_synthesis(m: Market):
    cols = ["Date", "Code", "IssuedShares", "TreasuryShares", "OutstandingShares", "ForecastEPS"]
    return C.synthesise_mergers(m.fin.select(*cols), [("0001", "0001", "0002", "1998-06-30", 1.2)])


@query("individual_stock_listing", "B10 G2", "SELECT DISTINCT Code, CompanyName, Sector33CodeName, Listing FROM x_listing WHERE Sector33CodeName <> 'NATION_3'")
def individual_stock_listing(m: Market):
    """The third nation stands for the fund category."""
    raw = m.listing.unionByName(m.listing).withColumn(
        "Sector33CodeName", F.when(F.col("Sector33CodeName") == "NATION_3", S.FUND_CATEGORY).otherwise(F.col("Sector33CodeName")))
    return C.clean_listing(raw).select("Code", "CompanyName", "Sector33CodeName", "Listing")


@query("catalogue_status", "A17", """
    SELECT c.Name, c."Group", c.is_adopted, coalesce(n, 0) AS RecordCount, last AS LastDate, CASE WHEN n IS NULL THEN 'no file' ELSE 'has data' END AS Status
    FROM (SELECT * FROM x_catalogue UNION ALL SELECT 'Copper', 'commodity', true) c LEFT JOIN (SELECT Name, count(*) AS n, max(Date) AS last FROM x_series GROUP BY Name) s ON c.Name = s.Name""")
def catalogue_status(m: Market):
    """All series, and one more in the catalogue that has no data."""
    more = m.spark.createDataFrame([("Copper", "commodity", True)], m.catalogue.schema)
    return R.catalogue_status(m.catalogue.unionByName(more), m.series)


@query("daily_ledger_upsert", "A18", """
    SELECT Date, CASE WHEN Date = max(Date) OVER () THEN 77 ELSE Deposit END AS BuyingPower FROM x_deposits WHERE Date IN (SELECT Date FROM x_ledger WHERE Side = '売')""")
def daily_ledger_upsert(m: Market):
    ledger = m.deposits.select("Date", F.col("Deposit").alias("BuyingPower"))
    sold = m.ledger.filter("Side = '売'")
    today = sold.agg(F.max("Date").alias("Date")).withColumn("BuyingPower", F.lit(77).cast("long"))
    return U.upsert_daily_ledger(ledger, today, sold)


@query("trade_history_append", "A19 G2", "SELECT DISTINCT Date, Code, Side, Shares, AcqAmount, Profit FROM x_ledger")
def trade_history_append(m: Market):
    cols = m.ledger.select("Date", "Code", "Side", "Shares", "AcqAmount", "Profit")
    return U.append_trades(cols, cols.filter(F.col("Date") >= SPLIT_DAY))


@query("series_integrity", "N1", """
    SELECT Name, CAST(sum(n) AS BIGINT) AS Rows, CAST(sum(n) - count(*) AS BIGINT) AS RepeatedDates, CAST(0 AS INTEGER) AS EmptyColumns, CAST(sum(bad) AS BIGINT) AS HighBelowLow,
      sum(n) = count(*) AND sum(bad) = 0 AS Valid
    FROM (SELECT status AS Name, Date, count(*) AS n, sum(CASE WHEN o < c THEN 1 ELSE 0 END) AS bad FROM x_lines GROUP BY 1, 2) GROUP BY Name""")
def series_integrity(m: Market):
    """Every line as a quote: dates repeat, and the opening price poses as the high."""
    cast = lambda c, n: F.col(c).cast("double").alias(n)
    rows = m.lines.select(F.col("status").alias("Name"), "Date", cast("o", "Open"), cast("c", "Close"), cast("o", "High"), cast("c", "Low"))
    return Q.integrity(rows)


@query("series_date_gaps", "N2 E32", """
    SELECT Code AS Name, count(*) AS Gaps, CAST(max(gap) AS INTEGER) AS LargestGap FROM (SELECT Code, Date - lag(Date) OVER (PARTITION BY Code ORDER BY Date) AS gap FROM x_traded) WHERE gap > 7 GROUP BY Code""")
def series_date_gaps(m: Market):
    return Q.date_gaps(m.traded.select(F.col("Code").alias("Name"), "Date"))


@query("update_outcome_summary", "N3", """
    SELECT o_orderpriority AS "Group", count(*) AS Total, count(*) FILTER (o_orderstatus <> 'F') AS Succeeded, count(*) FILTER (o_orderstatus = 'F') AS Failed FROM orders GROUP BY 1""")
def update_outcome_summary(m: Market):
    return Q.outcome_summary(m.table("orders").select(F.col("o_orderpriority").alias("Group"), (F.col("o_orderstatus") != "F").alias("Success")))


