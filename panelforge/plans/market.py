"""Market panels derived from the star-schema tables.

Prices are integers (yen), shares and volumes are integers: sums of products stay
exact in doubles, so results do not depend on the order of summation.

* stock = supplier, sector = nation, business day = ship date;
* a line opens at (100 - discount%) * 104 and closes at (100 - discount%) * (100 + tax%);
* a day's quote is the quantity-weighted mean over its lines, rounded down to a yen;
* codes are made from keys, so no table of code changes, splits or exceptions applies to them;
* cross-asset series come from (line number, line status), fundamentals from
  (supplier, quarter, line status), cash flows and orders from the orders table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.functions import windows as P
from panelforge.operators import features as FE
from panelforge.operators import marketcap as MC
from panelforge.operators import preprocess as PP
from panelforge.operators import sector_index as SI
from panelforge.operators import walkforward as WF
from panelforge.session import more_partitions, panel_partitions, reuse, stage, stage_by, stage_tight, tune

# Names of the cross-asset series, by line number and line status.
SERIES = {
    (1, "F"): ("USDJPY", "currency"), (1, "O"): ("EURJPY", "currency"), (2, "F"): ("AUDJPY", "currency"),
    (2, "O"): ("EURUSD", "currency"), (3, "F"): ("AUDUSD", "currency"), (3, "O"): ("EURAUD", "currency"),
    (4, "F"): ("JP_bond10", "bond"), (4, "O"): ("JP_bond2", "bond"), (5, "F"): ("US_bond10", "bond"),
    (5, "O"): ("US_bond2", "bond"), (6, "F"): ("WTI", "commodity"), (6, "O"): ("Gold", "commodity"),
    (7, "F"): ("TOPIX", "stockindex"), (7, "O"): ("NK225", "stockindex"),
}
SERIES_NAMES = [name for name, _ in SERIES.values()]
TRAIN = ("1995-01-02", "1999-12-31")
TEST = ("2000-01-01", "2001-12-31")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


def as_code(key) -> F.Column:
    """Raw five-character stock code: four digits and a trailing zero."""
    text = key.cast("string")
    return F.concat(F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text), F.lit("0"))


def pct(column: str):
    return F.round(F.col(column) * 100).cast("long")


def line_prices(d="d", t="t") -> dict[str, F.Column]:
    """What a line opens and closes at."""
    d, t = (F.col(x) if isinstance(x, str) else x for x in (d, t))
    return {"o": (100 - d) * 104, "c": (100 - d) * (100 + t)}


class Market:
    """Lazy panels over one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = tune(spark)
        self.dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def lines(self) -> DataFrame:
        """Line items in exact integers."""
        d, t = pct("l_discount"), pct("l_tax")
        table = self.table("lineitem")
        more_partitions(self.spark, table.count())
        return table.select(
            F.to_date("l_shipdate").alias("Date"), F.col("l_suppkey").alias("supp"), F.col("l_orderkey").alias("ord"),
            F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("num"), F.col("l_linestatus").alias("status"),
            F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast("long").alias("q"),
            F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), d.alias("d"), t.alias("t"),
            *[x.alias(name) for name, x in line_prices(d, t).items()])

    @staticmethod
    def _quote() -> list:
        vwap = lambda x: F.floor(F.sum(F.col("q") * F.col(x)) / F.sum("q")).cast("double")
        return [vwap("o").alias("Open"), F.max(F.greatest("o", "c")).cast("double").alias("High"),
                F.min(F.least("o", "c")).cast("double").alias("Low"), vwap("c").alias("Close"),
                F.sum("q").cast("double").alias("Volume")]

    def _per_day(self, lines: DataFrame, *keys: str) -> DataFrame:
        """Quotes of the days a stock traded; a day at the widest spread counts as a 2:1 split."""
        split = (F.min("d") == 10) & (F.min("t") == 8)
        return lines.groupBy("Date", *keys, "supp").agg(
            *self._quote(), F.floor(F.sum("cents") / 100).cast("double").alias("TurnoverValue"),
            F.when(split, 0.5).otherwise(1.0).alias("AdjustmentFactor"))

    @cached_property
    def raw_price(self) -> DataFrame:
        """Days a stock traded, raw five-character codes."""
        return self._per_day(self.lines).withColumn("Code", as_code(F.col("supp"))).drop("supp")

    @cached_property
    def traded(self) -> DataFrame:
        """Raw quotes under four-character codes."""
        from panelforge.functions import scalar as S
        return self.raw_price.withColumn("Code", S.normalise_code(F.col("Code")))

    @cached_property
    def calendar(self) -> DataFrame:
        """Business days: a few thousand rows, found once."""
        return reuse(self.lines.select("Date").distinct())

    @cached_property
    def panel_parts(self) -> int:
        """Partitions of a panel of every stock and day; estimates serve, as they only deal the rows out."""
        size = self.lines.agg(F.approx_count_distinct("supp").alias("stocks"), F.approx_count_distinct("Date").alias("days")).first()
        return panel_partitions(self.spark, size.stocks * size.days)

    @cached_property
    def day_numbers(self) -> DataFrame:
        """Business days counted from 0, in order."""
        days = self.calendar.filter(F.col("Date").isNotNull())
        return days.withColumn("DayNumber", F.row_number().over(Window.orderBy("Date")) - 1)

    def _days(self):
        """All business days in order, as one array of the query."""
        return self.calendar.agg(F.sort_array(F.collect_set("Date")).alias("days")).scalar()

    @cached_property
    def _numbered_price(self) -> DataFrame:
        """``price`` with the number of the day.

        The lines are dealt by stock once, by the rows that quiet days add; what a line's prices follow from travels, not the prices.
        """
        source = self.lines.select("Date", self._code4(F.col("supp")).alias("Code"), "supp", "q", "cents", "d", "t")
        dealt = source.repartition(self.panel_parts, "Code").withColumns(line_prices())
        rows = self._per_day(dealt, "Code").drop("supp").join(F.broadcast(self.day_numbers), "Date")
        rows = rows.withColumn("_next", P.shift("DayNumber", -1, "Code"))
        # The array of days is named after the window only, so that no sort carries it.
        until = F.coalesce(F.col("_next"), F.size(self._days()))
        rows = rows.select("*", F.posexplode(F.slice(self._days(), F.col("DayNumber") + 1, until - F.col("DayNumber"))).alias("_pos", "_day"))
        live = F.col("_pos") == 0
        return rows.select(
            F.col("_day").alias("Date"), "Code",
            *[F.when(live, F.col(c)).otherwise(F.col("Close")).alias(c) for c in ("Open", "High", "Low")], "Close",
            *[F.when(live, F.col(c)).otherwise(0.0).alias(c) for c in ("Volume", "TurnoverValue")],
            F.when(live, F.col("AdjustmentFactor")).otherwise(1.0).alias("AdjustmentFactor"), (F.col("DayNumber") + F.col("_pos")).alias("DayNumber"))

    @cached_property
    def price(self) -> DataFrame:
        """One row per business day from a stock's first trade on; quiet days repeat the close at zero volume."""
        return self._numbered_price.drop("DayNumber")

    @cached_property
    def raw_fin(self) -> DataFrame:
        """Disclosures as text, one per stock, quarter and line status."""
        quarter = F.trunc("Date", "quarter")
        g = self.lines.groupBy("supp", quarter.alias("qs"), "status").agg(
            F.sum("q").alias("sq"), F.sum("num").alias("sn"), F.count(F.lit(1)).alias("n"), F.sum("cents").alias("sc"),
            F.min((F.col("flag") == "R").cast("int")).alias("revision"))
        end = F.last_day(F.add_months("qs", 2))
        period = F.element_at(F.array(*[F.lit(x) for x in ("FY", "1Q", "2Q", "3Q")]), F.quarter("qs"))
        year_end = F.when(F.quarter("qs") == 1, end).otherwise(F.make_date(F.year("qs") + 1, F.lit(3), F.lit(31)))
        eps = F.floor(F.col("sc") / F.col("sq") / 100).cast("string")
        text = lambda c: c.cast("string")
        return g.select(
            F.concat(text(F.col("supp")), F.lit("-"), text(F.col("qs")), F.lit("-"), F.col("status")).alias("DisclosureNumber"),
            text(F.date_add(end, (20 + F.col("sn") % 5).cast("int"))).alias("Date"),
            F.when(F.col("status") == "F", "15:00:00").otherwise("16:30:00").alias("DisclosedTime"),
            as_code(F.col("supp")).alias("Code"),
            F.when(F.col("revision") == 1, "EarnForecastRevision").otherwise(F.concat(period, F.lit("FinancialStatements"))).alias("TypeOfDocument"),
            period.alias("TypeOfCurrentPeriod"), text(end).alias("CurrentPeriodEndDate"), text(year_end).alias("CurrentFiscalYearEndDate"),
            text(10000 + F.col("sq")).alias("IssuedShares"),
            F.when(F.col("n") % 5 == 0, "").otherwise(text(F.col("sn"))).alias("TreasuryShares"),
            F.when(period == "FY", "").otherwise(eps).alias("ForecastEarningsPerShare"),
            F.when(period == "FY", eps).otherwise("").alias("NextYearForecastEarningsPerShare"))

    @cached_property
    def volatile_fin(self) -> DataFrame:
        """Fundamentals whose share counts move enough to need rescaling around splits."""
        lively = F.when(F.col("IssuedShares") != "", (F.col("IssuedShares").cast("long") - 10000) * 20 + 1000)
        from panelforge.operators import cleaning as C
        return C.clean_fundamentals(self.raw_fin.withColumn("IssuedShares", lively.cast("string")), mergers=(), replacements={})

    @cached_property
    def fin(self) -> DataFrame:
        from panelforge.operators import cleaning as C
        return C.clean_fundamentals(self.raw_fin, mergers=(), replacements={})

    @cached_property
    def listing(self) -> DataFrame:
        """One row per stock; the account balance places it in a size class."""
        s = self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        s = s.join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        b = F.col("s_acctbal")
        scale = F.when(b > 8500, "TOPIX Core30").when(b > 6000, "TOPIX Large70").when(b > 2500, "TOPIX Mid400").when(b > 0, "TOPIX Small 1").otherwise("-")
        return s.select(
            self._code4(F.col("s_suppkey")).alias("Code"),
            F.col("s_name").alias("CompanyName"), F.col("r_name").alias("MarketCodeName"), F.col("n_name").alias("Sector33CodeName"),
            F.col("r_name").alias("Sector17CodeName"), scale.alias("ScaleCategory"), F.lit(1).cast("long").alias("Listing"))

    @staticmethod
    def _code4(key):
        from panelforge.functions import scalar as S
        return S.normalise_code(as_code(key))

    @cached_property
    def definition(self) -> DataFrame:
        s = self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        return s.select(self._code4(F.col("s_suppkey")).alias("Code"), F.col("s_name").alias("CompanyName"), F.col("n_name").alias("Sector"))

    @cached_property
    def sectors(self) -> list[str]:
        """Names of the sectors (nations); the nation table is a fixed dimension."""
        return [r[0] for r in self.table("nation").select("n_name").distinct().orderBy("n_name").collect()]

    @cached_property
    def caps(self) -> DataFrame:
        """The stock panel, written once by stock; everything by sector is an aggregate of it.

        Stored are the days on which a stock traded or its share count moved, with the number of days up to the next one; the quiet
        days in between, and the capitalisations, follow from them when the panel is read.
        """
        shares = stage_tight(self.fin.select("Code", "Date", "OutstandingShares", "CurrentPeriodEndDate"), "fundamentals")
        panel = MC.market_caps(self._numbered_price, shares, self.calendar, overrides=(), parts=self.panel_parts)
        return MC.unfold_quiet_days(stage_by(MC.fold_quiet_days(panel, "DayNumber"), "stock-panel", "Code", self.panel_parts), "DayNumber", self._days())

    @cached_property
    def _index_and_size(self) -> DataFrame:
        """One row per sector and day, written once, as target, predictions and features all start from it."""
        members = SI.attach_sector(self.caps, self.definition)
        return stage_tight(SI.aggregate_index(members, F.avg("MarketCapClose").alias("MarketCapAtClose")), "sector-panel")

    @cached_property
    def index(self) -> DataFrame:
        return self._index_and_size.drop("MarketCapAtClose")

    @cached_property
    def target(self) -> DataFrame:
        """Sector daytime return on a 1e-9 grid, so that quiet days tie exactly."""
        return PP.daytime_target(self.index).withColumn("Target", F.round("Target", 9))

    @cached_property
    def model_target(self) -> DataFrame:
        """What models learn: the target less the day's mean over all sectors, from whole numbers of 1e-9, so it is exact."""
        day = Window.partitionBy("Date")
        units = F.round(F.col("Target") * 1e9).cast("long")
        n = F.count(units).over(day)
        return self.target.select("Date", "Sector", ((n * units - F.sum(units).over(day)).cast("double") / (n * 1e9)).alias("Target"))

    @cached_property
    def model_features(self) -> DataFrame:
        """Yesterday's return, momentum and volatility of a sector, null where they are not known."""
        from panelforge.operators import dataset as D
        rows = FE.volatility(FE.momentum(self.index.select("Date", "Sector", "1d_return")), [5])
        return stage(D.lag_features(rows.select(
            "Date", "Sector", F.col("1d_return").alias("r1"), F.col("5d_mom").alias("m5"), F.col("21d_mom").alias("m21"), F.col("5d_vola").alias("v5"))), "model-features")

    def _walked(self, columns: list[str], months: int | None) -> DataFrame:
        """Predictions of linear models that are refitted every month on the past, on a 1e-7 grid."""
        out = WF.walk_forward_predictions(self.model_target, self.model_features, columns, months)
        return out.withColumn("Pred", F.round("Pred", 7)).filter(F.col("Pred").isNotNull())

    @cached_property
    def predictions(self) -> DataFrame:
        """The model on return and week's momentum over all of the past, next to what it learns."""
        found = self._walked(["r1", "m5"], None).join(self.model_target, ["Date", "Sector"], "left")
        return stage(found.select("Date", "Sector", "Target", "Pred"), "predictions")

    @cached_property
    def slow_predictions(self) -> DataFrame:
        """The model on month's momentum and volatility over the last 24 months."""
        return stage(self._walked(["m21", "v5"], 24), "predictions")

    @cached_property
    def series(self) -> DataFrame:
        """Daily cross-asset quotes in long form."""
        mapping = F.create_map(*[v for (n, s), (name, _) in SERIES.items() for v in (F.lit(f"{n}{s}"), F.lit(name))])
        rows = self.lines.withColumn("Name", F.element_at(mapping, F.concat(F.col("num").cast("string"), F.col("status"))))
        return rows.filter(F.col("Name").isNotNull()).groupBy("Name", "Date").agg(*self._quote())

    @cached_property
    def catalogue(self) -> DataFrame:
        rows = [(name, group, name != "NK225") for name, group in SERIES.values()]
        return self.spark.createDataFrame(rows, "Name string, Group string, is_adopted boolean")

    @cached_property
    def candidates(self) -> DataFrame:
        """What the sparse models choose from: yesterday's price features and the last known return of every series."""
        from panelforge.operators import dataset as D
        everything = self.catalogue.withColumn("is_adopted", F.lit(True))
        wide = FE.widen_series(FE.series_returns(self.series, everything), SERIES_NAMES)
        rows = FE.volatility(FE.momentum(self.index.select("Date", "Sector", "1d_return")), [5])
        rows = rows.select("Date", "Sector", F.col("1d_return").alias("r1"), F.col("5d_mom").alias("m5"), F.col("21d_mom").alias("m21"), F.col("5d_vola").alias("v5"))
        return stage(D.lag_features(FE.merge_features(wide.withColumnsRenamed({n + FE.SUFFIX: n for n in SERIES_NAMES}), rows)), "model-candidates")

    @cached_property
    def fills(self) -> DataFrame:
        """Brokerage fills: each line opens a position, and closes it the same day."""
        named = self.lines.select(
            "Date", self._code4(F.col("supp")).alias("Code"), F.concat(F.lit("Supplier "), F.col("supp").cast("string")).alias("CompanyName"),
            F.lit("東証").alias("Market"), "q", "o", "c", (F.col("flag") == "A").alias("short"), F.col("t").alias("Tax"))
        legs = F.array(
            F.struct(F.when(F.col("short"), "信用新規売").otherwise("信用新規買").alias("Type"), F.col("o").cast("double").alias("Price")),
            F.struct(F.when(F.col("short"), "信用返済買").otherwise("信用返済売").alias("Type"), F.col("c").cast("double").alias("Price")))
        return named.select("Date", "Code", "CompanyName", "Market", F.col("q").alias("Shares"), F.lit(0).cast("long").alias("Fee"), "Tax", F.inline(legs))

    @cached_property
    def ledger(self) -> DataFrame:
        """Day trades per stock and side with their sector."""
        from panelforge.operators import trades as TR
        per = self.lines.groupBy("Date", "supp", F.when(F.col("flag") == "A", TR.SHORT).otherwise(TR.LONG).alias("Side")).agg(
            F.sum("q").alias("Shares"), F.floor(F.sum(F.col("q") * F.col("o")) / F.sum("q")).cast("double").alias("AcqPrice"),
            F.floor(F.sum(F.col("q") * F.col("c")) / F.sum("q")).cast("double").alias("SettlePrice"))
        per = per.withColumn("Code", self._code4(F.col("supp"))).drop("supp")
        return TR.attach_order_sector(TR.trade_profit(per), self.definition)

    @cached_property
    def cash_raw(self) -> DataFrame:
        """Cash movements as the brokerage page shows them."""
        amount = F.format_number(F.floor("o_totalprice"), 0)
        on = lambda s: F.when(F.col("o_orderstatus") == s, amount).otherwise("-")
        return self.table("orders").select(
            F.col("o_orderkey").alias("Key"), F.to_date("o_orderdate").cast("string").alias("Date"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "譲渡益税源泉徴収金").otherwise(F.col("o_orderpriority")).alias("Text"),
            on("F").alias("Out"), on("O").alias("In"), F.lit("-").alias("TransferOut"), on("P").alias("TransferIn"))

    @cached_property
    def deposits(self) -> DataFrame:
        from panelforge.operators import trades as TR
        spots = self.spark.createDataFrame([], "Date date, Delta long")
        return TR.roll_deposits(1_000_000_000, self.ledger.select("Date"), TR.normalise_cashflows(self.cash_raw), spots)

    @cached_property
    def returns(self) -> DataFrame:
        """Daily book return."""
        from panelforge.operators import trades as TR
        return TR.daily_profit(self.ledger).select("Date", F.col("Rate").alias("Return"))

    @cached_property
    def result(self) -> DataFrame:
        from panelforge.operators import evaluate as EV
        return EV.result_panel(self.predictions, self.target)

    @cached_property
    def features(self) -> DataFrame:
        return FE.price_features(
            self.index, self._index_and_size.select("Date", "Sector", "MarketCapAtClose"), SI.eps_factor(self.caps, self.fin, self.definition, self.panel_parts))

    @cached_property
    def quotas(self) -> DataFrame:
        """Unit limits and short-sale quotas of the broker's list."""
        k = F.col("s_suppkey")
        return self.table("supplier").select(
            self._code4(k).alias("Code"), F.when(k % 4 == 0, "-").otherwise((k % 7 + 1).cast("string")).alias("MaxUnit"),
            F.when(k % 3 == 0, "受付不可").otherwise("○").alias("SellQuota"), F.when(k % 11 == 0, "HYPER").otherwise("").alias("CreditClassHyper"))

    @cached_property
    def lending(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.table("supplier").select(self._code4(k).alias("Code"), F.when(k % 2 == 0, "貸借銘柄").otherwise("制度信用銘柄").alias("CreditClass"))
