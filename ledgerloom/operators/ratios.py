"""Guarded accounting ratios: null is not zero, and every missing ratio says why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.quantiles import quantiles

# Coefficients and zones of the emerging-market Z score.
COEFFICIENTS = {"x1": 6.56, "x2": 3.26, "x3": 6.72, "x4": 1.05}
INTERCEPT, SAFE, DISTRESS = 3.25, 2.60, 1.10
IDENTITIES = [
    ("total_assets", "current_assets", "noncurrent_assets", 1), ("total_assets", "total_liabilities", "total_equity", 1),
    ("total_liabilities", "current_liabilities", "noncurrent_liabilities", 1), ("noncurrent_assets", "total_assets", "current_assets", -1),
    ("current_assets", "total_assets", "noncurrent_assets", -1), ("total_equity", "total_assets", "total_liabilities", -1),
    ("total_liabilities", "total_assets", "total_equity", -1), ("noncurrent_liabilities", "total_liabilities", "current_liabilities", -1),
]


def divide(a: Column, b: Column, positive: bool = True) -> tuple[Column, Column]:
    """Value and reason; a denominator that is zero, or negative where it must be positive, gives none."""
    why = F.when(a.isNull() & b.isNull(), "both_missing").when(a.isNull(), "numerator_missing").when(b.isNull(), "denominator_missing").when(b == 0, "denominator_zero")
    if positive:
        why = why.when(b < 0, "denominator_negative")
    why = why.otherwise("")
    return F.when(why == "", a / b), why


def derived(df: DataFrame) -> DataFrame:
    """Adds what several ratios need; a column that df lacks counts as missing."""
    for c in ("pbt", "finance_costs", "depreciation", "current_assets", "current_liabilities", "total_assets", "total_equity", "total_liabilities", "capital_employed", "total_borrowings", "borrowings_long_term", "borrowings_short_term", "retained_earnings", "other_equity", "inventories", "cash_and_equivalents", "revenue", "net_profit"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double"))
    c = F.col
    zero = F.lit(0.0)
    df = df.withColumns({"ebit": c("pbt") + c("finance_costs"), "working_capital": c("current_assets") - c("current_liabilities"), "total_liabilities": F.coalesce("total_liabilities", c("total_assets") - c("total_equity")), "capital_employed": F.coalesce("capital_employed", c("total_assets") - c("current_liabilities")), "retained_earnings_used": F.coalesce("retained_earnings", "other_equity")})
    some = c("borrowings_long_term").isNotNull() | c("borrowings_short_term").isNotNull()
    partial = c("total_borrowings").isNull() & some & (c("borrowings_long_term").isNull() | c("borrowings_short_term").isNull())
    debt = F.coalesce("total_borrowings", F.when(some, F.coalesce("borrowings_long_term", zero) + F.coalesce("borrowings_short_term", zero)))
    return df.withColumns({"ebitda": c("ebit") + c("depreciation"), "borrowings_partial": partial, "debt": debt})


def ratios(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, twelve ratios, the Z score with its zone, `reasons` MAP of the missing ones, and six tri-state indicators."""
    d = derived(df)
    c = F.col
    parts = {
        "current_ratio": (c("current_assets"), c("current_liabilities")), "quick_ratio": (c("current_assets") - c("inventories"), c("current_liabilities")),
        "cash_to_assets": (c("cash_and_equivalents"), c("total_assets")), "ebitda_margin": (c("ebitda"), c("revenue")), "roce": (c("ebit"), c("capital_employed")),
        "roa": (c("net_profit"), c("total_assets")), "debt_to_equity": (c("debt"), c("total_equity")), "debt_to_ebitda": (c("debt"), c("ebitda")),
        "interest_coverage": (c("ebit"), c("finance_costs")), "retained_earnings_to_assets": (c("retained_earnings_used"), c("total_assets")),
    }
    told = {k: divide(*v) for k, v in parts.items()}
    z, why_z = z_score()
    told["promoter_pledge"] = (F.lit(None).cast("double"), F.lit("pending_shareholding_filings"))
    told["altman_z_em"] = (z, why_z)
    base = z - INTERCEPT
    zone = F.when(base > SAFE, "safe").when(base < DISTRESS, "distress").when(z.isNotNull(), "grey")
    why = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("ratio"), w.alias("why")) for k, (_, w) in told.items()]), lambda x: x["why"] != ""))
    flags = {"negative_equity": c("total_equity") < 0, "negative_ebitda": c("ebitda") < 0, "zero_finance_costs": c("finance_costs") == 0, "negative_working_capital": c("working_capital") < 0, "negative_capital_employed": c("capital_employed") < 0}
    return d.select(*keys, *[v.alias(k) for k, (v, _) in told.items()], zone.alias("altman_zone"), why.alias("reasons"), c("borrowings_partial"), *[v.alias(k) for k, v in flags.items()])


def z_score() -> tuple[Column, Column]:
    """Score and reason over the columns of derived(); all missing terms are named."""
    c = F.col
    terms = {"x1": (c("working_capital"), c("total_assets")), "x2": (c("retained_earnings_used"), c("total_assets")), "x3": (c("ebit"), c("total_assets")), "x4": (c("total_equity"), c("total_liabilities"))}
    gone = [F.when(a.isNull() | b.isNull(), F.lit(f"{k}_missing")).when(b == 0, F.lit(f"{k}_denominator_zero")) for k, (a, b) in terms.items()]
    listed = F.array_join(F.array_compact(F.array(*gone)), ",")
    why = F.when(c("total_assets").isNull() | (c("total_assets") <= 0), "total_assets_missing_or_nonpositive").otherwise(listed)
    score = sum((COEFFICIENTS[k] * F.try_divide(a, b) for k, (a, b) in terms.items()), F.lit(0.0)) + INTERCEPT
    return F.when(why == "", score), why


def fill_totals(df: DataFrame) -> DataFrame:
    """Fills null totals from IDENTITIES (field = a + sign * b), in order, twice; adds `derived_fields`, in order of filling."""
    done = F.array().cast("array<string>")
    cols = {c: F.col(c) for c in df.columns}
    out = df.withColumn("derived_fields", done)
    for _ in range(2):
        for field, a, b, sign in IDENTITIES:
            if {field, a, b} <= set(cols):
                value = F.col(a) + sign * F.col(b)
                now = F.col(field).isNull() & value.isNotNull()
                out = out.withColumns({"derived_fields": F.when(now, F.array_append("derived_fields", F.lit(field))).otherwise(F.col("derived_fields")), field: F.coalesce(field, value)})
    return out


def checks(tolerance: float = 0.05) -> Column:
    """Flags of a statement's row, ;-joined: imbalance, parts beyond their whole, negatives, confusion of units with last year."""
    c = F.col
    gap = lambda a, b: F.abs(a - b) > tolerance * F.abs(a)
    factors = F.array(*[F.lit(x) for x in (10.0, 100.0, 1e5, 1e7)])
    ratio = F.try_divide(c("total_assets"), c("previous_assets"))
    slip = F.exists(factors, lambda f: (F.abs(ratio - f) <= 0.15 * f) | (F.abs(ratio - 1 / f) <= 0.15 / f))
    rules = [("balance_gap", gap(c("total_assets"), c("total_liabilities") + c("total_equity"))), ("components_gap", gap(c("total_assets"), c("current_assets") + c("noncurrent_assets"))), ("part_exceeds_whole", c("inventories") > c("current_assets")), ("current_exceeds_total", c("current_assets") > c("total_assets")), ("negative_assets", c("total_assets") < 0), ("possible_unit_confusion", slip)]
    return F.array_join(F.array_compact(F.array(*[F.when(cond, F.lit(n)) for n, cond in rules])), ";")


def confidence(*factors: Column) -> Column:
    """Product of independent factors, in 0 to 1, four places; a null factor counts as 1."""
    product = F.lit(1.0)
    for f in factors:
        product = product * F.coalesce(f, F.lit(1.0))
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), product)), 4)


def winsorised(df: DataFrame, fold: str, column: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Each fold clipped at quantiles of the others. Folds are few, so the bounds are found from counts and broadcast."""
    folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]
    others = {f: [g for g in folds if g is not None and g != f] for f in folds if f is not None}
    row = quantiles(df, fold, column, (low, high), others)
    bounds = df.sparkSession.createDataFrame([(f, *(row.get(f) or (None, None))) for f in folds], f"`{fold}` {df.schema[fold].dataType.simpleString()}, __low double, __high double") if folds else None
    if bounds is None:
        return df.withColumn(column + "_w", F.col(column))
    return df.join(F.broadcast(bounds), fold).withColumn(column + "_w", F.greatest("__low", F.least("__high", column))).drop("__low", "__high")
