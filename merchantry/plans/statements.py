"""Income statement, balance sheet, cash flow and ratios from the ledger.

Statements are long: (zid, project, period, line, value). Totals are data, a map from each
line to the totals it enters and with which sign, so a missing line simply counts as 0.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantry.functions import calendar, numeric
from merchantry.operators.ordered import cumulative_by_month, period_diff, previous_value
from merchantry.operators.figures import stored_figure
from merchantry.session import cut_lineage
from merchantry.sources.extracts import ACCOUNT_COLUMNS

# The statement lines accounts are mapped to.
INCOME_LINES = [
    "01-1-Revenue", "02-1-Cost of Revenue", "03-1-Office & Administrative Expenses",
    "04-1-Sales & Distribution Expenses", "04-2-MRP Discount", "04-3-Discount Expense",
    "05-1-Depreciation/Amortization", "06-1-Unusual Expenses (Income)",
    "07-1-Other Operating Expenses, Total", "08-1-Interest Expense", "09-1-Income Tax & VAT",
]
BALANCE_LINES = [
    "01-3-Cash", "02-1-Accounts Receivable", "03-1-Inventories", "04-1-Prepaid Expenses",
    "05-1-Other Assets", "06-1-Property, Plant & Equipment", "07-1-Goodwill & Intangible Asset",
    "08-1-Accounts Payable", "09-1-Accrued Liabilities", "10-1-Other Short Term Liabilities",
    "11-1-Debt", "12-1-Other Long Term Liabilities", "13-1-Total Shareholders Equity",
]
NET_INCOME = "10-1-Net Income"
RETAINED = "13-2-Retained Earnings"
BALANCE_SUM = "Balance"
UNMAPPED = "unmapped"

# Totals and the lines each one adds up.
INCOME_TOTALS = {
    "02-2-Gross Profit": INCOME_LINES[:2],
    "07-2-EBIT": INCOME_LINES[:9],
    "08-2-EBT": INCOME_LINES[:10],
}
BALANCE_TOTALS = {
    "04-2-Total Current Assets": BALANCE_LINES[0:4],
    "07-2-Total Non-Current Assets": BALANCE_LINES[4:7],
    "11-2-Total Current Liabilities": BALANCE_LINES[7:11],
    "12-2-Total Non-Current Liabilities": BALANCE_LINES[11:12],
    "13-3-Balance Check": [*BALANCE_LINES, RETAINED],
}
BALANCE_HEADERS = [
    "01-1-Assets", "01-2-Current Assets", "04-3-Non-Current Assets", "07-3-Current Liabilities",
    "11-4-Non-Current Liabilities",
]

# Cash flow lines and the balance line whose change each one shows.
CASH_FROM_CHANGE = {
    "04-1-Accounts Receivable": "02-1-Accounts Receivable",
    "04-2-Inventories": "03-1-Inventories",
    "04-3-Prepaid Expenses": "04-1-Prepaid Expenses",
    "05-1-Accounts Payable": "08-1-Accounts Payable",
    "05-2-Accrued Liabilities": "09-1-Accrued Liabilities",
    "05-3-Other Short Term Liabilities": "10-1-Other Short Term Liabilities",
    "10-Capital asset acquisitions/disposal": "07-2-Total Non-Current Assets",
    "15-Increase/Decrease in Debt": "11-1-Debt",
    "16-Increase/Decrease in Equity": "13-1-Total Shareholders Equity",
    "16-1-Increase/Decrease in Retained Earning": RETAINED,
    "17-Other financing cash flows": "12-2-Total Non-Current Liabilities",
}
CASH_FROM_INCOME = {
    "02-Net Income": NET_INCOME,
    "03-Depreciation and amortization": "05-1-Depreciation/Amortization",
}
CASH_OPERATING = [*CASH_FROM_INCOME, *list(CASH_FROM_CHANGE)[:6]]
CASH_INVESTING = list(CASH_FROM_CHANGE)[6:7]
CASH_FINANCING = list(CASH_FROM_CHANGE)[7:]
CASH_OPENING = "20-Year Opening Cash"
CASH_CHANGE = "21-Change in Cash"
CASH_ENDING = "22-Year Ending Cash"
CASH_HEADERS = [
    "01-Operating Activities", "06-Other operating cash flow adjustments", "08", "09-Investing Cashflow",
    "11-Other investing cash flows", "13", "14-Financing Cashflow", "19",
]
GROUP = ["zid", "project", "period"]

# Columns that stand for each reporting level, from single accounts to statement lines.
LEVELS = {
    0: ["ac_code", "ac_name"], 1: ["ac_lv1"], 2: ["ac_lv2"], 3: ["ac_lv3"], 4: ["ac_lv4"], 5: ["line"],
}


def _rounded(column: Column, digits: int | None) -> Column:
    return column if digits is None else numeric.half_even(column, digits)


def label_accounts(accounts: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Account master with its statement line, looked up by the fourth level."""
    pairs = [F.lit(text) for pair in labels.items() for text in pair]
    line = F.try_element_at(F.create_map(*pairs), F.col("ac_lv4"))
    return accounts.select(*ACCOUNT_COLUMNS, F.coalesce(line, F.lit(UNMAPPED)).alias("line"))


def account_projects(accounts: DataFrame, projects: DataFrame) -> DataFrame:
    """Every account of a company, for each of its projects."""
    per_company = stored_figure(projects.groupBy("zid").agg(F.sort_array(F.collect_set("project")).alias("projects")))
    return accounts.join(per_company, "zid").withColumn("project", F.explode("projects")).drop("projects")


def account_grid(accounts: DataFrame, projects: DataFrame, periods: Sequence[str]) -> DataFrame:
    """Every account of a company, for each of its projects and each period."""
    return account_projects(accounts, projects).withColumn("period", F.explode(F.array(*[F.lit(p) for p in periods])))


def _on_grid(accounts: DataFrame, projects: DataFrame, figures: DataFrame, periods: Sequence[str],
             labels: Mapping[str, str], account_digits: int | None) -> DataFrame:
    """Figures on the grid of accounts x projects x periods. An account meets its figures of all periods as one row and is
    spread over the periods afterwards, so what is exchanged does not grow with their number."""
    keys = ["zid", "project", "ac_code"]
    sums = figures.repartition(*keys).groupBy(*keys, "period").agg(_rounded(F.sum("value"), account_digits).alias("value"))
    cells = sums.filter(F.col("period").isNotNull()).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("period", "value"))).alias("cells"))
    met = account_projects(label_accounts(accounts, labels), projects).join(cells, keys, "left")
    spread = met.withColumn("period", F.explode(F.array(*[F.lit(p) for p in periods])))
    value = F.try_element_at(F.col("cells"), F.col("period"))
    return spread.select(
        "zid", "project", *ACCOUNT_COLUMNS[1:], "line", "period",
        numeric.zero_if_null(value).cast("decimal(28,4)").alias("value"))


def statement_yearly(accounts: DataFrame, rollup: DataFrame, projects: DataFrame, labels: Mapping[str, str],
                     end_year: int, years: int = 5, account_digits: int | None = 1) -> DataFrame:
    """Accounts x years, zero where nothing was posted. ``accounts`` holds the statement's types."""
    periods = [str(y) for y in range(end_year - years + 1, end_year + 1)]
    figures = rollup.withColumn("period", F.col("year").cast("string")).filter(F.col("period").isin(periods))
    return _on_grid(accounts, projects, figures, periods, labels, account_digits)


def statement_lines(accounts: DataFrame, rollup: DataFrame, projects: DataFrame, labels: Mapping[str, str],
                    end_year: int, years: int = 5, account_digits: int | None = 1) -> DataFrame:
    """The lines of ``statement_yearly``, without its accounts: (zid, project, period, line, value).

    Account figures are rounded and summed to lines straight from the roll-up. Lines of the chart of accounts without
    postings come from a frame of lines x projects x periods, which no account and no posting multiplies.
    """
    periods = [str(y) for y in range(end_year - years + 1, end_year + 1)]
    money = "decimal(28,4)"
    labelled = label_accounts(accounts, labels).select("zid", "ac_code", "line")
    sums = (
        rollup.withColumn("period", F.col("year").cast("string")).filter(F.col("period").isin(periods))
        .groupBy("zid", "project", "ac_code", "period").agg(_rounded(F.sum("value"), account_digits).alias("value"))
        .join(labelled, ["zid", "ac_code"])
        .select(*GROUP, "line", numeric.zero_if_null(F.col("value")).cast(money).alias("value"))
    )
    frame = (
        stored_figure(labelled.select("zid", "line").distinct()).join(projects, "zid")
        .withColumn("period", F.explode(F.array(*[F.lit(p) for p in periods])))
        .select(*GROUP, "line", F.lit(0).cast(money).alias("value"))
    )
    return sums.unionByName(frame).groupBy(*GROUP, "line").agg(F.sum("value").alias("value"))


def _month_labels(months: Mapping[int, Sequence[int]]) -> list[str]:
    return [f"{year}-{m:02d}" for year in sorted(months) for m in months[year]]


def last_full_month(as_of_month: int) -> int:
    """The month before; in January the whole year so far is taken as twelve months."""
    return 12 if as_of_month == 1 else as_of_month - 1


def statement_monthly(accounts: DataFrame, rollup: DataFrame, projects: DataFrame, labels: Mapping[str, str],
                      year: int, as_of_month: int, start_month: int = 1, end_month: int = 12,
                      balance_sheet: bool = False, account_digits: int | None = 1) -> DataFrame:
    """Accounts x months: this year up to the last full month, and last year's chosen months.

    A balance sheet shows the balance up to each month, from the opening on; months after
    the last posting of a company and project carry no figure and read 0.
    """
    spans = {
        year - 1: (0 if balance_sheet else start_month, end_month),
        year: (0 if balance_sheet else 1, last_full_month(as_of_month)),
    }
    inside = F.lit(False)
    for y, (low, high) in spans.items():
        inside = inside | ((F.col("year") == y) & F.col("month").between(low, high))
    chosen = rollup.filter(inside)
    if balance_sheet:
        chosen = cumulative_by_month(chosen, ["ac_code"], "value").filter(F.col("month") > 0)
    figures = chosen.withColumn("period", calendar.period_label(F.col("year"), F.col("month")))
    months = {y: range(max(low, 1), high + 1) for y, (low, high) in spans.items()}
    return _on_grid(accounts, projects, figures, _month_labels(months), labels, account_digits)


def statement_at_level(statement: DataFrame, level: int) -> DataFrame:
    """The account statement summed to a level of the hierarchy (0 accounts .. 5 lines)."""
    keys = ["zid", "project", *LEVELS[level], "period"]
    return statement.groupBy(*keys).agg(F.sum("value").cast("double").alias("value"))


def statement_levels(statement: DataFrame) -> DataFrame:
    """``statement_at_level`` for all levels, from one aggregate over grouping sets: (zid, project, period, level, code,
    name, value). ``name`` is the account's name at level 0 and the code at the others."""
    group = ["zid", "project", "period"]
    columns = [*group, *[c for level in LEVELS.values() for c in level]]
    sets = [[F.col(c) for c in [*group, *level]] for level in LEVELS.values()]
    summed = statement.groupingSets(sets, *[F.col(c) for c in columns]).agg(
        F.sum("value").cast("double").alias("value"), *[F.grouping(level[0]).alias(f"without_{n}") for n, level in LEVELS.items()])

    def of(pick) -> Column:
        return F.coalesce(*[F.when(F.col(f"without_{n}") == 0, pick(n, level)) for n, level in LEVELS.items()])

    return summed.select(
        *group, of(lambda n, level: F.lit(n)).alias("level"), of(lambda n, level: F.col(level[0])).alias("code"),
        of(lambda n, level: F.col(level[-1])).alias("name"), "value")


def account_series(statement: DataFrame, level: int, key: str) -> DataFrame:
    """One account or line over time."""
    column = "ac_name" if level == 0 else LEVELS[level][0]
    return statement.filter(F.col(column) == key).groupBy("zid", "project", column, "period").agg(
        F.sum("value").cast("double").alias("value"))


def add_totals(lines: DataFrame, totals: Mapping[str, Mapping[str, int] | Sequence[str]],
               listed: Sequence[str]) -> DataFrame:
    """Lines plus their totals. Every name in ``listed`` and every total appears, at least as 0."""
    entries: dict[str, list[Column]] = {}
    for total, members in totals.items():
        signs = members if isinstance(members, Mapping) else {m: 1 for m in members}
        for line, sign in signs.items():
            entries.setdefault(line, []).append(F.struct(F.lit(total).alias("line"), F.lit(sign).alias("sign")))
    pairs = [c for line, targets in entries.items() for c in (F.lit(line), F.array(*targets))]
    itself = F.array(F.struct(F.col("line").alias("line"), F.lit(1).alias("sign")))
    into = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("line")), F.array().cast(
        "array<struct<line:string,sign:int>>"))
    exploded = lines.select(*GROUP, "value", F.inline(F.concat(itself, into)))
    names = F.array(*[F.lit(n) for n in dict.fromkeys([*listed, *totals])])
    zero = lines.select(*GROUP).distinct().select(
        *GROUP, F.lit(0).cast(lines.schema["value"].dataType).alias("value"), F.explode(names).alias("line"),
        F.lit(1).alias("sign"))
    return exploded.unionByName(zero).groupBy(*GROUP, "line").agg(
        F.sum(F.col("value") * F.col("sign")).alias("value"))


def _line_sums(statement: DataFrame, include_unmapped: bool) -> DataFrame:
    lines = statement if include_unmapped else statement.filter(F.col("line") != UNMAPPED)
    return lines.groupBy(*GROUP, "line").agg(F.sum("value").alias("value"))


def _finish(lines: DataFrame, digits: int | None) -> DataFrame:
    return lines.select(*GROUP, "line", _rounded(F.col("value"), digits).cast("double").alias("value"))


def income_statement(statement: DataFrame, digits: int | None = 0, include_unmapped: bool = False) -> DataFrame:
    """Line sums with gross profit, EBIT, EBT and net income (which takes every line)."""
    known = [*INCOME_LINES, UNMAPPED] if include_unmapped else INCOME_LINES
    totals = {NET_INCOME: known, **INCOME_TOTALS}
    return _finish(add_totals(_line_sums(statement, include_unmapped), totals, INCOME_LINES), digits)


def balance_sheet(statement: DataFrame, income: DataFrame, digits: int | None = 0,
                  include_unmapped: bool = False) -> DataFrame:
    """Line sums with subtotals, retained earnings (the net income) and the balance check."""
    lines = _line_sums(statement, include_unmapped)
    retained = income.filter(F.col("line") == NET_INCOME).select(
        *GROUP, F.lit(RETAINED).alias("line"), F.col("value").cast("decimal(38,4)").alias("value"))
    known = [*BALANCE_LINES, UNMAPPED] if include_unmapped else BALANCE_LINES
    totals = {BALANCE_SUM: known, **BALANCE_TOTALS}
    return _finish(add_totals(
        lines.unionByName(retained), totals, [*BALANCE_LINES, RETAINED, *BALANCE_HEADERS]), digits)


def _cash_totals() -> dict[str, dict[str, int]]:
    plus = lambda names: {n: 1 for n in names}
    # Change in cash leaves out depreciation and retained earnings and has the ledger's sign turned.
    moved = [n for n in [*CASH_OPERATING, *CASH_INVESTING, *CASH_FINANCING]
             if n not in ("03-Depreciation and amortization", "16-1-Increase/Decrease in Retained Earning")]
    change = {n: -1 for n in moved}
    return {
        "07-Total Operating Cashflow": plus(CASH_OPERATING),
        "12-Total Investing Cashflow": plus(CASH_INVESTING),
        "18-Total Financing Cashflow": plus(CASH_FINANCING),
        CASH_CHANGE: change,
        CASH_ENDING: {CASH_OPENING: 1, **change},
    }


def cash_flow(income: DataFrame, balance: DataFrame, digits: int | None = 0) -> DataFrame:
    """Changes of the balance lines between periods, beside net income and depreciation.

    The first period has no previous one: its changes, opening and ending cash are 0.
    """
    line_of = lambda names: F.try_element_at(
        F.create_map(*[F.lit(t) for cash, source in names.items() for t in (source, cash)]), F.col("line"))
    series = ["zid", "project", "line"]
    changes = period_diff(balance.filter(F.col("line").isin(list(CASH_FROM_CHANGE.values()))), series, "period", "value")
    moved = changes.select(*GROUP, line_of(CASH_FROM_CHANGE).alias("line"), F.col("change").alias("value"))
    earned = income.filter(F.col("line").isin(list(CASH_FROM_INCOME.values()))).select(
        *GROUP, line_of(CASH_FROM_INCOME).alias("line"), "value")
    cash = balance.filter(F.col("line") == "01-3-Cash")
    opening = previous_value(cash, series, "period", "value", "before").select(
        *GROUP, F.lit(CASH_OPENING).alias("line"), F.col("before").alias("value"))
    # A period without a previous one keeps its null opening until the end.
    first = opening.filter(F.col("value").isNull()).select(*GROUP, F.lit(True).alias("is_first"))
    lines = add_totals(
        moved.unionByName(earned).unionByName(opening.fillna(0.0, ["value"])), _cash_totals(),
        [*CASH_HEADERS, *CASH_OPERATING, *CASH_INVESTING, *CASH_FINANCING, CASH_OPENING])
    no_ending = F.col("is_first") & (F.col("line") == CASH_ENDING)
    lines = lines.join(first, GROUP, "left").withColumn(
        "value", F.when(no_ending, F.lit(0.0)).otherwise(F.col("value")))
    return _finish(lines, digits)


# Short names of the figures that ratios are built from.
FIGURES = {
    "rev": "01-1-Revenue", "cogs": "02-1-Cost of Revenue", "gross": "02-2-Gross Profit",
    "oae": "03-1-Office & Administrative Expenses", "snd": "04-1-Sales & Distribution Expenses",
    "dep": "05-1-Depreciation/Amortization", "unusual": "06-1-Unusual Expenses (Income)",
    "other_op": "07-1-Other Operating Expenses, Total", "ebit": "07-2-EBIT",
    "interest": "08-1-Interest Expense", "ebt": "08-2-EBT", "tax": "09-1-Income Tax & VAT",
    "ni": NET_INCOME, "cash": "01-3-Cash", "ar": "02-1-Accounts Receivable", "inv": "03-1-Inventories",
    "ca": "04-2-Total Current Assets", "ppe": "06-1-Property, Plant & Equipment",
    "intangible": "07-1-Goodwill & Intangible Asset", "nca": "07-2-Total Non-Current Assets",
    "ap": "08-1-Accounts Payable", "short": "10-1-Other Short Term Liabilities", "debt": "11-1-Debt",
    "cl": "11-2-Total Current Liabilities", "long": "12-1-Other Long Term Liabilities",
    "ncl": "12-2-Total Non-Current Liabilities", "eq": "13-1-Total Shareholders Equity",
}
# Ratio -> (numerator, denominator) over the figures; td is the total debt.
RATIOS = {
    "COGS Ratio": ("cogs * 100", "rev"),
    "Gross Profit Ratio": ("gross * 100", "rev"),
    "Operating Profit": ("ebit * 100", "rev"),
    "Net Profit Ratio": ("ni * 100", "rev"),
    "Tax Coverage": ("tax * 100", "ebt"),
    "Interest Coverage": ("interest * 100", "ebit"),
    "OAE Ratio": ("oae * 100", "rev"),
    "S&D Ratio": ("snd * 100", "rev"),
    "Deprication Ratio": ("dep * 100", "rev"),
    "Unusual Expense Ratio": ("unusual * 100", "rev"),
    "Other Operating Ratio": ("other_op * 100", "rev"),
    "Interest Ratio": ("interest * 100", "rev"),
    "Tax Ratio": ("tax * 100", "rev"),
    "Quick Ratio": ("ca", "cl"),
    "Current Ratio": ("ca", "cl"),
    "Total Asset Turnover Ratio": ("rev", "ca + nca"),
    "Net Asset Turnover Ratio": ("rev", "ca + nca + cl + ncl"),
    "Inventory Turnover": ("cogs", "inv"),
    "Inventory Days": ("inv * 365", "cogs"),
    "Accounts Receivable Turnover": ("rev", "ar"),
    "Accounts Receivable Days": ("ar * 365", "rev"),
    "Accounts Payable Turnover": ("cogs", "ap"),
    "Accounts Payable Days": ("ap * 365", "cogs"),
    "PP&E Ratio": ("ppe", "rev"),
    "Working Capital Turnover": ("rev", "ar + inv + ap"),
    "Cash Turnover": ("rev", "cash"),
    "Debt/Equity": ("td", "eq"),
    "Debt/Capital": ("td", "eq - td"),
    "Debt/TNW": ("td", "nca - intangible"),
    "Total Liabilities/Equity": ("cl + ncl", "eq - td"),
    "Total Assets to Equity": ("ca + nca", "eq"),
    "Debt/EBITDA": ("td", "ebit + dep"),
    "Capital Structure Impact": ("ebt", "ebit"),
    "Acid Test": ("ca - inv", "cl"),
    "ROE": ("ni", "eq"),
    "ROA": ("ni", "ca + nca"),
}
# Ratios that need the payables towards others; 0 without them.
EXTERNAL_RATIOS = {
    "Quick Ratio Adjusted": ("ca", "cl - external"),
    "Current Ratio Adjusted": ("ca", "cl - external"),
    "Accounts Payable Turnover*": ("cogs", "external"),
    "Accounts Payable Days*": ("external * 365", "cogs"),
    "Working Capital Turnover*": ("rev", "ar + inv + external"),
    "Total Liabilities/Equity*": ("cl - external + ncl", "eq - td"),
    "Acid Test*": ("ca - inv", "cl - external"),
}


def ratio_rows(income: DataFrame, balance: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """All ratios per period, in ledger sign. A figure of 0 counts as missing.

    ``external`` may give (zid, project, period, external) to fill the starred ratios.
    """
    lines = income.unionByName(balance)
    wide = lines.groupBy(*GROUP).agg(*[
        numeric.zero_as_null(F.sum(F.when(F.col("line") == name, F.col("value")))).alias(short)
        for short, name in FIGURES.items()])
    if external is not None:
        wide = wide.join(external, GROUP, "left")
    else:
        wide = wide.withColumn("external", F.lit(None).cast("double"))
    wide = wide.withColumn("td", F.expr("debt + short + long"))
    formulas = {**RATIOS, **EXTERNAL_RATIOS}
    cells = [F.try_divide(F.expr(top), F.expr(bottom)).alias(name) for name, (top, bottom) in formulas.items()]
    return wide.select(*GROUP, *cells).unpivot(GROUP, list(formulas), "line", "value")


def three_statements(income: DataFrame, balance: DataFrame, cash: DataFrame, digits: int = 3,
                     external: DataFrame | None = None) -> DataFrame:
    """The three statements and the ratios one after another, in reporting sign."""
    def part(df: DataFrame, name: str) -> DataFrame:
        shown = F.coalesce(numeric.half_even(-F.col("value"), digits), F.lit(0.0)) + F.lit(0.0)
        return df.select(*GROUP, F.lit(name).alias("statement"), "line", shown.alias("value"))
    return (
        part(income, "income").unionByName(part(balance, "balance")).unionByName(part(cash, "cash"))
        .unionByName(part(ratio_rows(income, balance, external), "ratios")))


def financial_statements(income_accounts: DataFrame, balance_accounts: DataFrame, digits: int | None = 0
                         ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Income statement, balance sheet and cash flow. The first two are computed once and
    kept: they have a few dozen lines per company, project and period and are read many times."""
    income = cut_lineage(income_statement(income_accounts, digits))
    balance = cut_lineage(balance_sheet(balance_accounts, income, digits))
    return income, balance, cash_flow(income, balance, digits)


def statement_wide(statement: DataFrame, periods: Sequence[str], keys: Sequence[str] = ("line",)) -> DataFrame:
    """Presentation form: a column per period, lines in code order."""
    rows = ["zid", "project", *keys]
    return statement.groupBy(*rows).pivot("period", list(periods)).agg(F.sum("value")) \
        .fillna(0.0, list(periods)).orderBy(*rows)
