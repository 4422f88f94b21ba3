"""Financial statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.cases import case
from merchantry.cases.ledger_cases import SUPPLIERS, ledger
from merchantry.operators import ordered, prep
from merchantry.operators.figures import stored_figure
from merchantry.plans import statements as st
from merchantry.session import cut_lineage
from merchantry.sources import extracts
from merchantry.sources.driver_tables import LABELS, DriverTables

END_YEAR = 2001
YEARS = list(range(1997, 2002))
AS_OF_MONTH = 10


class Ledger:
    """The ledger rolled up once, for whichever statements a report needs."""

    def __init__(self, t: DriverTables, years: list[int]):
        self.t = t
        # Account totals are far fewer than journal lines; every statement reads these.
        self.rollup = cut_lineage(extracts.gl_rollup(*ledger(t), start_month=1, end_month=12, years=years))
        self.projects = stored_figure(t.gl_details().select("zid", "project").distinct())

    def part(self, kind: str) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, str]]:
        excluded = extracts.INCOME_TYPES if kind == "balance" else extracts.BALANCE_TYPES
        accounts = extracts.gl_accounts(self.t.accounts(), excluded)
        return accounts, self.rollup.filter(F.col("statement") == kind), self.projects, LABELS[kind]

    def yearly(self, kind: str) -> DataFrame:
        return st.statement_yearly(*self.part(kind), END_YEAR)

    def lines(self, kind: str) -> DataFrame:
        # Few rows, which a statement reads several times.
        return cut_lineage(st.statement_lines(*self.part(kind), END_YEAR), "lines")

    def monthly(self, kind: str) -> DataFrame:
        return st.statement_monthly(
            *self.part(kind), END_YEAR, AS_OF_MONTH, balance_sheet=kind == "balance")


def yearly(t: DriverTables) -> Ledger:
    return Ledger(t, YEARS)


def three(t: DriverTables) -> tuple[DataFrame, DataFrame, DataFrame]:
    books = yearly(t)
    return st.financial_statements(books.lines("income"), books.lines("balance"))


_TYPES = {"income": "'Asset', 'Liability'", "balance": "'Income', 'Expenditure'"}
_KEPT = {"income": "'Income', 'Expenditure'", "balance": "'Asset', 'Liability'"}


def yearly_ctes(kind: str) -> str:
    months = "month <= 12" if kind == "balance" else "month >= 1 AND month <= 12"
    return f"""
    {kind}_sums AS (
        SELECT zid, project, ac_code, CAST(year AS VARCHAR) AS period, round_even(CAST(sum(value) AS DOUBLE), 1) AS value
        FROM f_posting WHERE ac_type IN ({_KEPT[kind]}) AND {months} AND year BETWEEN {YEARS[0]} AND {YEARS[-1]}
        GROUP BY zid, project, ac_code, year),
    {kind}_grid AS (
        SELECT p.zid, p.project, a.* EXCLUDE (zid, usage), COALESCE(l.line, 'unmapped') AS line, CAST(y AS VARCHAR) AS period
        FROM (SELECT DISTINCT zid, project FROM f_detail) p JOIN f_account a ON a.zid = p.zid
             LEFT JOIN f_label l ON l.ac_lv4 = a.ac_lv4 AND l.statement = '{kind}',
             (SELECT unnest(range({YEARS[0]}, {YEARS[-1] + 1})) AS y)
        WHERE a.ac_type IS NULL OR a.ac_type NOT IN ({_TYPES[kind]})),
    {kind}_accounts AS (
        SELECT g.*, CAST(COALESCE(s.value, 0) AS DECIMAL(28,4)) AS value FROM {kind}_grid g
        LEFT JOIN {kind}_sums s ON s.zid = g.zid AND s.project = g.project AND s.ac_code = g.ac_code AND s.period = g.period)"""


YEARLY = f"{yearly_ctes('income')},{yearly_ctes('balance')}"
_ACCOUNT = "zid, project, ac_code, ac_name, ac_type, ac_lv1, ac_lv2, ac_lv3, ac_lv4, line, period"


@case("statement_yearly", f"""
    WITH {YEARLY}
    SELECT 'income' AS statement, {_ACCOUNT}, CAST(value AS DOUBLE) AS value FROM income_accounts
    UNION ALL SELECT 'balance', {_ACCOUNT}, CAST(value AS DOUBLE) FROM balance_accounts""")
def statement_yearly(t: DriverTables) -> DataFrame:
    books = yearly(t)
    return prep.decimal_to_double(
        books.yearly("income").withColumn("statement", F.lit("income"))
        .unionByName(books.yearly("balance").withColumn("statement", F.lit("balance"))))


_MONTHS = [f"{END_YEAR - 1}-{m:02d}" for m in range(1, 13)] + [f"{END_YEAR}-{m:02d}" for m in range(1, AS_OF_MONTH)]
_MONTH_LIST = ", ".join(f"('{p}')" for p in _MONTHS)


def monthly_grid(kind: str) -> str:
    return f"""
    {kind}_grid AS (
        SELECT p.zid, p.project, a.* EXCLUDE (zid, usage), COALESCE(l.line, 'unmapped') AS line, m.period
        FROM (SELECT DISTINCT zid, project FROM f_detail) p JOIN f_account a ON a.zid = p.zid
             LEFT JOIN f_label l ON l.ac_lv4 = a.ac_lv4 AND l.statement = '{kind}', (VALUES {_MONTH_LIST}) AS m(period)
        WHERE a.ac_type IS NULL OR a.ac_type NOT IN ({_TYPES[kind]}))"""


_SPAN = f"""((year = {END_YEAR} AND month <= {AS_OF_MONTH - 1}) OR year = {END_YEAR - 1})"""
_MONTHLY = f"""
    {monthly_grid('income')},
    {monthly_grid('balance')},
    income_sums AS (
        SELECT zid, project, ac_code, year || '-' || lpad(CAST(month AS VARCHAR), 2, '0') AS period,
               round_even(CAST(sum(value) AS DOUBLE), 1) AS value
        FROM f_posting WHERE ac_type IN ('Income', 'Expenditure') AND month >= 1 AND {_SPAN}
        GROUP BY zid, project, ac_code, year, month),
    chosen AS (
        SELECT * FROM f_posting WHERE ac_type IN ('Asset', 'Liability') AND {_SPAN}),
    last AS (SELECT zid, project, year, max(month) AS last_month FROM chosen GROUP BY ALL),
    balance_sums AS (
        SELECT c.zid, c.project, c.ac_code, c.year || '-' || lpad(CAST(m.m AS VARCHAR), 2, '0') AS period,
               round_even(CAST(sum(c.value) AS DOUBLE), 1) AS value
        FROM chosen c JOIN last l ON l.zid = c.zid AND l.project = c.project AND l.year = c.year,
             (SELECT unnest(range(1, 13)) AS m) m
        WHERE m.m <= l.last_month AND c.month <= m.m
        GROUP BY c.zid, c.project, c.ac_code, c.year, m.m),
    accounts AS (
        SELECT 'income' AS statement, g.*, CAST(COALESCE(s.value, 0) AS DOUBLE) AS value FROM income_grid g
        LEFT JOIN income_sums s ON s.zid = g.zid AND s.project = g.project AND s.ac_code = g.ac_code AND s.period = g.period
        UNION ALL
        SELECT 'balance', g.*, CAST(COALESCE(s.value, 0) AS DOUBLE) FROM balance_grid g
        LEFT JOIN balance_sums s ON s.zid = g.zid AND s.project = g.project AND s.ac_code = g.ac_code AND s.period = g.period)"""


@case("statement_monthly", f"WITH {_MONTHLY} SELECT statement, {_ACCOUNT}, value FROM accounts")
def statement_monthly(t: DriverTables) -> DataFrame:
    books = Ledger(t, [END_YEAR - 1, END_YEAR])
    return prep.decimal_to_double(
        books.monthly("income").withColumn("statement", F.lit("income"))
        .unionByName(books.monthly("balance").withColumn("statement", F.lit("balance"))))


@case("cumulative_balance", """
    WITH posted AS (SELECT * FROM f_posting WHERE ac_type IN ('Asset', 'Liability')),
    last AS (SELECT zid, project, year, max(month) AS last_month FROM posted GROUP BY ALL)
    SELECT c.zid, c.project, c.ac_code, c.year, CAST(m.m AS INTEGER) AS month,
           CAST(sum(CASE WHEN c.month <= m.m THEN c.value ELSE 0 END) AS DOUBLE) AS value
    FROM posted c JOIN last l ON l.zid = c.zid AND l.project = c.project AND l.year = c.year,
         (SELECT unnest(range(0, 13)) AS m) m
    WHERE m.m <= l.last_month GROUP BY c.zid, c.project, c.ac_code, c.year, m.m""")
def cumulative_balance(t: DriverTables) -> DataFrame:
    rollup = extracts.gl_rollup(*ledger(t), balance_sheet=True)
    return prep.decimal_to_double(ordered.cumulative_by_month(rollup, ["ac_code"], "value"))


def at_level(t: DriverTables, level: int) -> DataFrame:
    books = yearly(t)
    return st.statement_at_level(books.yearly("income").unionByName(books.yearly("balance")), level)


for _level, _columns in st.LEVELS.items():
    _listed = ", ".join(["zid", "project", *_columns, "period"])
    case(f"statement_at_level_{_level}", f"""
        WITH {YEARLY}
        SELECT {_listed}, CAST(sum(value) AS DOUBLE) AS value
        FROM (SELECT * FROM income_accounts UNION ALL SELECT * FROM balance_accounts) GROUP BY {_listed}""")(
        lambda t, level=_level: at_level(t, level))


@case("statement_levels", f"WITH {YEARLY}" + " UNION ALL ".join(
    f"SELECT zid, project, period, {_level} AS level, {_columns[0]} AS code, {_columns[-1]} AS name, CAST(sum(value) AS DOUBLE) AS value "
    f"FROM (SELECT * FROM income_accounts UNION ALL SELECT * FROM balance_accounts) GROUP BY {', '.join(['zid', 'project', 'period', *_columns])}"
    for _level, _columns in st.LEVELS.items()))
def statement_levels(t: DriverTables) -> DataFrame:
    books = yearly(t)
    return st.statement_levels(books.yearly("income").unionByName(books.yearly("balance")))


@case("account_series", f"""
    WITH {YEARLY}
    SELECT zid, project, line, period, CAST(sum(value) AS DOUBLE) AS value FROM income_accounts
    WHERE line = '01-1-Revenue' GROUP BY zid, project, line, period""")
def account_series(t: DriverTables) -> DataFrame:
    return st.account_series(yearly(t).yearly("income"), 5, "01-1-Revenue")


# ---- the statements written out line by line -------------------------------------------------

_KEYS = "zid, project, period"


def _sum_lines(names: list[str]) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return f"sum(CASE WHEN line IN ({listed}) THEN value ELSE 0 END)"


def _rows(source: str, cells: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT {_KEYS}, '{line}' AS line, {expr} AS value FROM {source}" for line, expr in cells)


_I, _B = st.INCOME_LINES, st.BALANCE_LINES
_INCOME_WIDE = ", ".join(f"{_sum_lines([n])} AS i{k}" for k, n in enumerate(_I))
_BALANCE_WIDE = ", ".join(f"{_sum_lines([n])} AS b{k}" for k, n in enumerate(_B))
_plus = lambda prefix, ks: " + ".join(f"{prefix}{k}" for k in ks)
_r = lambda e: f"round_even(CAST({e} AS DOUBLE), 0)"

INCOME = f"""
    iw AS (SELECT {_KEYS}, {_INCOME_WIDE} FROM income_accounts GROUP BY {_KEYS}),
    income_rows AS ({_rows("iw", [
        *[(n, _r(f"i{k}")) for k, n in enumerate(_I)],
        ("02-2-Gross Profit", _r("i0 + i1")),
        ("07-2-EBIT", _r("i0 + i1 + i2 + i3 + i6 + i7 + i8 + i4 + i5")),
        ("08-2-EBT", _r("i0 + i1 + i2 + i3 + i6 + i7 + i8 + i4 + i5 + i9")),
        ("10-1-Net Income", _r(_plus("i", range(11)))),
    ])})"""
BALANCE = f"""
    bw AS (
        SELECT w.*, n.value AS ni
        FROM (SELECT {_KEYS}, {_BALANCE_WIDE} FROM balance_accounts GROUP BY {_KEYS}) w
        JOIN income_rows n ON n.zid = w.zid AND n.project = w.project AND n.period = w.period AND n.line = '10-1-Net Income'),
    balance_rows AS ({_rows("bw", [
        *[(n, _r(f"b{k}")) for k, n in enumerate(_B)],
        ("Balance", _r(_plus("b", range(13)))),
        ("04-2-Total Current Assets", _r(_plus("b", range(0, 4)))),
        ("07-2-Total Non-Current Assets", _r(_plus("b", range(4, 7)))),
        ("11-2-Total Current Liabilities", _r(_plus("b", range(7, 11)))),
        ("12-2-Total Non-Current Liabilities", _r("b11")),
        ("13-2-Retained Earnings", "ni"),
        ("13-3-Balance Check", _r(f"CAST({_plus('b', range(13))} AS DOUBLE) + ni")),
        *[(h, "0.0") for h in st.BALANCE_HEADERS],
    ])})"""


@case("income_statement", f"WITH {YEARLY}, {INCOME} SELECT * FROM income_rows")
def income_statement(t: DriverTables) -> DataFrame:
    return st.income_statement(yearly(t).lines("income"))


_YEAR_COLUMNS = ", ".join(f"COALESCE(sum(CASE WHEN period = '{y}' THEN value END), 0) AS \"{y}\"" for y in YEARS)


@case("statement_wide", f"WITH {YEARLY}, {INCOME} SELECT zid, project, line, {_YEAR_COLUMNS} FROM income_rows GROUP BY zid, project, line")
def statement_wide(t: DriverTables) -> DataFrame:
    return st.statement_wide(st.income_statement(yearly(t).lines("income")), [str(y) for y in YEARS])


@case("balance_sheet", f"WITH {YEARLY}, {INCOME}, {BALANCE} SELECT * FROM balance_rows")
def balance_sheet(t: DriverTables) -> DataFrame:
    return three(t)[1]


def _value(line: str) -> str:
    return f"max(CASE WHEN line = '{line}' THEN value END)"


CASH = f"""
    flat AS (
        SELECT {_KEYS}, {_value("10-1-Net Income")} AS ni, {_value("05-1-Depreciation/Amortization")} AS dep,
               {_value("01-3-Cash")} AS cash, {_value("02-1-Accounts Receivable")} AS ar,
               {_value("03-1-Inventories")} AS inv, {_value("04-1-Prepaid Expenses")} AS pre,
               {_value("08-1-Accounts Payable")} AS ap, {_value("09-1-Accrued Liabilities")} AS acc,
               {_value("10-1-Other Short Term Liabilities")} AS ost, {_value("07-2-Total Non-Current Assets")} AS nca,
               {_value("11-1-Debt")} AS debt, {_value("13-1-Total Shareholders Equity")} AS eq,
               {_value("13-2-Retained Earnings")} AS re, {_value("12-2-Total Non-Current Liabilities")} AS ncl
        FROM (SELECT * FROM income_rows UNION ALL SELECT * FROM balance_rows) GROUP BY {_KEYS}),
    d AS (
        SELECT {_KEYS}, ni, dep, lag(cash) OVER w AS opening,
               {", ".join(f"COALESCE({c} - lag({c}) OVER w, 0) AS d_{c}" for c in
                          ["ar", "inv", "pre", "ap", "acc", "ost", "nca", "debt", "eq", "re", "ncl"])}
        FROM flat WINDOW w AS (PARTITION BY zid, project ORDER BY period)),
    e AS (
        SELECT *, ni + dep + d_ar + d_inv + d_pre + d_ap + d_acc + d_ost AS op, d_debt + d_eq + d_re + d_ncl AS fin FROM d),
    g AS (SELECT *, -(op + d_nca + fin - d_re - dep) AS change FROM e),
    cash_rows AS ({_rows("g", [
        ("01-Operating Activities", "0.0"), ("02-Net Income", "ni"), ("03-Depreciation and amortization", "dep"),
        ("04-1-Accounts Receivable", "d_ar"), ("04-2-Inventories", "d_inv"), ("04-3-Prepaid Expenses", "d_pre"),
        ("05-1-Accounts Payable", "d_ap"), ("05-2-Accrued Liabilities", "d_acc"),
        ("05-3-Other Short Term Liabilities", "d_ost"), ("06-Other operating cash flow adjustments", "0.0"),
        ("07-Total Operating Cashflow", "op"), ("08", "0.0"), ("09-Investing Cashflow", "0.0"),
        ("10-Capital asset acquisitions/disposal", "d_nca"), ("11-Other investing cash flows", "0.0"),
        ("12-Total Investing Cashflow", "d_nca"), ("13", "0.0"), ("14-Financing Cashflow", "0.0"),
        ("15-Increase/Decrease in Debt", "d_debt"), ("16-Increase/Decrease in Equity", "d_eq"),
        ("16-1-Increase/Decrease in Retained Earning", "d_re"), ("17-Other financing cash flows", "d_ncl"),
        ("18-Total Financing Cashflow", "fin"), ("19", "0.0"),
        ("20-Year Opening Cash", "COALESCE(opening, 0)"), ("21-Change in Cash", "change"),
        ("22-Year Ending Cash", "COALESCE(opening + change, 0)"),
    ])})"""
STATEMENTS = f"{YEARLY}, {INCOME}, {BALANCE}, {CASH}"


@case("cash_flow", f"WITH {STATEMENTS} SELECT {_KEYS}, line, CAST(value AS DOUBLE) AS value FROM cash_rows")
def cash_flow(t: DriverTables) -> DataFrame:
    return three(t)[2]


@case("opening_cash", f"WITH {STATEMENTS} SELECT zid, project, period, CAST(value AS DOUBLE) AS value FROM cash_rows WHERE line = '20-Year Opening Cash'")
def opening_cash(t: DriverTables) -> DataFrame:
    return three(t)[2].filter(F.col("line") == st.CASH_OPENING).drop("line")


_NULLED = ", ".join(f"nullif({_value(name)}, 0) AS {short}" for short, name in st.FIGURES.items())


def _division(top: str, bottom: str) -> str:
    return f"({top}) / nullif({bottom}, 0)"


_RATIO_CELLS = [
    ("COGS Ratio", _division("cogs * 100", "rev")), ("Gross Profit Ratio", _division("gross * 100", "rev")),
    ("Operating Profit", _division("ebit * 100", "rev")), ("Net Profit Ratio", _division("ni * 100", "rev")),
    ("Tax Coverage", _division("tax * 100", "ebt")), ("Interest Coverage", _division("interest * 100", "ebit")),
    ("OAE Ratio", _division("oae * 100", "rev")), ("S&D Ratio", _division("snd * 100", "rev")),
    ("Deprication Ratio", _division("dep * 100", "rev")), ("Unusual Expense Ratio", _division("unusual * 100", "rev")),
    ("Other Operating Ratio", _division("other_op * 100", "rev")), ("Interest Ratio", _division("interest * 100", "rev")),
    ("Tax Ratio", _division("tax * 100", "rev")), ("Quick Ratio", _division("ca", "cl")),
    ("Current Ratio", _division("ca", "cl")), ("Total Asset Turnover Ratio", _division("rev", "ca + nca")),
    ("Net Asset Turnover Ratio", _division("rev", "ca + nca + cl + ncl")), ("Inventory Turnover", _division("cogs", "inv")),
    ("Inventory Days", _division("inv * 365", "cogs")), ("Accounts Receivable Turnover", _division("rev", "ar")),
    ("Accounts Receivable Days", _division("ar * 365", "rev")), ("Accounts Payable Turnover", _division("cogs", "ap")),
    ("Accounts Payable Days", _division("ap * 365", "cogs")), ("PP&E Ratio", _division("ppe", "rev")),
    ("Working Capital Turnover", _division("rev", "ar + inv + ap")), ("Cash Turnover", _division("rev", "cash")),
    ("Debt/Equity", _division("td", "eq")), ("Debt/Capital", _division("td", "eq - td")),
    ("Debt/TNW", _division("td", "nca - intangible")), ("Total Liabilities/Equity", _division("cl + ncl", "eq - td")),
    ("Total Assets to Equity", _division("ca + nca", "eq")), ("Debt/EBITDA", _division("td", "ebit + dep")),
    ("Capital Structure Impact", _division("ebt", "ebit")), ("Acid Test", _division("ca - inv", "cl")),
    ("ROE", _division("ni", "eq")), ("ROA", _division("ni", "ca + nca")),
]
_EXTERNAL_CELLS = [
    ("Quick Ratio Adjusted", _division("ca", "cl - external")), ("Current Ratio Adjusted", _division("ca", "cl - external")),
    ("Accounts Payable Turnover*", _division("cogs", "external")),
    ("Accounts Payable Days*", _division("external * 365", "cogs")),
    ("Working Capital Turnover*", _division("rev", "ar + inv + external")),
    ("Total Liabilities/Equity*", _division("cl - external + ncl", "eq - td")),
    ("Acid Test*", _division("ca - inv", "cl - external")),
]
_FIGURES = f"""
    figures AS (
        SELECT *, debt + short + long AS td FROM (
            SELECT {_KEYS}, {_NULLED} FROM (SELECT * FROM income_rows UNION ALL SELECT * FROM balance_rows) GROUP BY {_KEYS}))"""


def _shown(source: str, statement: str) -> str:
    return f"SELECT {_KEYS}, '{statement}' AS statement, line, COALESCE(round_even(-value, 3), 0.0) + 0.0 AS value FROM {source}"


@case("ratio_pack", f"""
    WITH {STATEMENTS}, {_FIGURES},
    ratios AS ({_rows("figures", [*_RATIO_CELLS, *[(n, "CAST(NULL AS DOUBLE)") for n, _ in _EXTERNAL_CELLS]])})
    {_shown("income_rows", "income")} UNION ALL {_shown("balance_rows", "balance")}
    UNION ALL {_shown("cash_rows", "cash")} UNION ALL {_shown("ratios", "ratios")}""")
def ratio_pack(t: DriverTables) -> DataFrame:
    return st.three_statements(*three(t))


@case("ratio_pack_external", f"""
    WITH {STATEMENTS}, {_FIGURES},
    outside AS (
        SELECT zid, project, CAST(year AS VARCHAR) AS period, CAST(sum(value) AS DOUBLE) AS external FROM f_posting
        WHERE ac_lv4 = 'K18' AND month <= 12 AND ac_sub NOT IN ({", ".join(f"'{s}'" for s in SUPPLIERS)})
        GROUP BY zid, project, year),
    wide AS (SELECT f.*, o.external FROM figures f LEFT JOIN outside o USING (zid, project, period)),
    ratios AS ({_rows("wide", [*_RATIO_CELLS, *_EXTERNAL_CELLS])})
    SELECT {_KEYS}, line, round_even(value, 3) AS value FROM ratios""")
def ratio_pack_external(t: DriverTables) -> DataFrame:
    from merchantry.functions import numeric
    pl, bs, _ = three(t)
    accounts, details, headers = ledger(t)
    split = extracts.gl_ap_split(
        accounts.filter(F.col("ac_lv4") == "K18"), details, headers, None, SUPPLIERS, end_month=12)
    external = split.filter(F.col("source") == "EXTERNAL").select(
        "zid", "project", F.col("year").cast("string").alias("period"),
        F.col("total").cast("double").alias("external"))
    rows = st.ratio_rows(pl, bs, external)
    return rows.withColumn("value", numeric.half_even(F.col("value"), 3))
