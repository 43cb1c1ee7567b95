"""Fixed catalogues and the small dimension tables made from them.

Every table here is written out below, so its size is known: ``literal_table`` refuses anything above
``MAX_DIM_ROWS``, which is what makes the ``broadcast`` hints on these dimensions safe at any data size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------------------
# These must stay exactly as they are for results to be right.
# ---------------------------------------------------------------------------------------------------------

# fund_id, name, asset_class, risk, five_yr, expense, exp_return, volatility
FUNDS = [
    ("parag_flexi", "Parag Parikh Flexi Cap", "equity", "High", 22.4, 0.63, 0.14, 0.18),
    ("nippon_small", "Nippon India Small Cap", "equity", "High", 31.2, 0.79, 0.16, 0.26),
    ("icici_nifty", "ICICI Pru Nifty 50 Index", "equity", "Moderate", 17.6, 0.17, 0.115, 0.15),
    ("mirae_large", "Mirae Asset Large Cap", "equity", "High", 15.1, 0.54, 0.12, 0.16),
    ("quant_elss", "Quant ELSS Tax Saver", "equity", "High", 27.3, 0.77, 0.14, 0.2),
    ("hdfc_corp_bond", "HDFC Corporate Bond", "debt", "Low", 7.2, 0.36, 0.075, 0.05),
    ("icici_liquid", "ICICI Pru Liquid", "debt", "Low", 6.1, 0.2, 0.06, 0.01),
    ("sbi_gilt", "SBI Magnum Gilt", "debt", "Low", 8.0, 0.46, 0.07, 0.04),
    ("icici_gold", "ICICI Pru Gold ETF", "gold", "Moderate", 13.4, 0.5, 0.085, 0.14),
    ("nippon_gold", "Nippon India Gold BeES", "gold", "Moderate", 13.1, 0.32, 0.085, 0.14),
    ("mirae_hybrid", "Mirae Asset Hybrid Equity", "hybrid", "Moderate", 14.0, 0.6, 0.11, 0.1),
    ("hdfc_baa", "HDFC Balanced Advantage", "hybrid", "Moderate", 15.2, 0.7, 0.105, 0.09),
]

# asset_class -> label, equity part, debt part, gold part
ASSET_CLASSES = {
    "equity": ("Equity", 1.0, 0.0, 0.0),
    "debt": ("Debt", 0.0, 1.0, 0.0),
    "gold": ("Gold", 0.0, 0.0, 1.0),
    "hybrid": ("Hybrid", 0.65, 0.35, 0.0),
}

# Order in which a basket lists its classes.
CLASS_ORDER = ["equity", "hybrid", "gold", "debt"]

# goal_id, name, target_today, horizon_years, default_profile, cost_sensitivity
GOALS = [
    ("emergency", "Safety Net", 300000.0, 1.0, "steady", "none"),
    ("travel", "Travel the World", 500000.0, 2.0, "steady", "none"),
    ("gadget", "New Tech", 150000.0, 1.0, "steady", "none"),
    ("car", "Dream Car", 1200000.0, 4.0, "balanced", "medium"),
    ("wedding", "Dream Wedding", 2000000.0, 3.0, "balanced", "medium"),
    ("home", "First Home", 3000000.0, 7.0, "balanced", "high"),
    ("business", "Start a Business", 1500000.0, 3.0, "bold", "medium"),
    ("education", "Study / Upskill", 4000000.0, 5.0, "bold", "high"),
    ("fire", "Early Retirement", 30000000.0, 20.0, "bold", "none"),
    ("freedom", "Financial Freedom", 50000000.0, 25.0, "bold", "none"),
]

DEFAULT_GOAL_ID = "home"

# Demo goals in order; the first one has its horizon fixed.
DEMO_GOALS = ["home", "travel", "fire"]
DEMO_FIRST_HORIZON = 7.0

# profile -> fund weights in order
PRESETS = {
    "steady": [("icici_liquid", 25.0), ("hdfc_corp_bond", 25.0), ("sbi_gilt", 20.0), ("icici_gold", 15.0), ("icici_nifty", 15.0)],
    "balanced": [("icici_nifty", 25.0), ("parag_flexi", 15.0), ("mirae_hybrid", 20.0), ("hdfc_corp_bond", 20.0), ("icici_gold", 20.0)],
    "bold": [("parag_flexi", 25.0), ("nippon_small", 20.0), ("icici_nifty", 20.0), ("quant_elss", 20.0), ("icici_gold", 15.0)],
}
STEADY_MAX_YEARS = 3.0
BALANCED_MAX_YEARS = 7.0

# tier -> target multipliers by cost sensitivity (high, medium, none), living cost, income multiplier, rent default
CITY_TIERS = {
    "metro": (1.6, 1.25, 1.0, 28000.0, 1.3, 25000.0),
    "tier1": (1.3, 1.15, 1.0, 20000.0, 1.1, 16000.0),
    "tier2": (1.0, 1.0, 1.0, 15000.0, 0.95, 12000.0),
    "tier3": (0.85, 0.92, 1.0, 11000.0, 0.8, 7000.0),
}
UNKNOWN_CITY = "tier2"

STAGE_INCOME = {"starting": 45000.0, "growing": 95000.0, "stable": 170000.0}
UNKNOWN_STAGE_INCOME = 70000.0
EMPLOYMENT_FACTOR = {"self_employed": 1.15, "freelancer": 0.9, "student": 0.4}
SURPLUS_TO_SIP = 0.65

DEFAULT_INFLATION = 0.06
DEFAULT_POOL = 25000.0
DEFAULT_SAVINGS = 0.0

# type_id, category, label
HOLDING_TYPES = [
    ("in_stocks", "Equity", "Indian stocks"),
    ("us_stocks", "Equity", "US stocks (fractional)"),
    ("mf_lump", "Funds", "Mutual fund (lumpsum)"),
    ("mf_sip", "Funds", "Mutual fund (SIP)"),
    ("etf_in", "Funds", "ETF (Indian)"),
    ("etf_us", "Funds", "ETF (US)"),
    ("gold_etf", "Gold & Silver", "Gold ETF"),
    ("silver_etf", "Gold & Silver", "Silver ETF"),
    ("gold_mf", "Gold & Silver", "Gold mutual fund"),
    ("fd", "Fixed income", "Fixed Deposit (FD)"),
    ("bond", "Fixed income", "Bond"),
    ("nps", "Fixed income", "NPS"),
    ("epf", "Fixed income", "EPF"),
    ("ppf", "Fixed income", "PPF"),
    ("other", "Other", "Other holding"),
]

# Questionnaire: the options of each choice, in order.
QUESTION_OPTIONS = {
    "timeline": ["2", "4", "8", "14"],
    "city_tier": ["metro", "tier1", "tier2", "tier3"],
    "employment": ["salaried", "self_employed", "freelancer", "student"],
    "career_stage": ["starting", "growing", "stable"],
}

# Questionnaire: profile fields that a slider seeds and the seed used when no rule fills it.
SLIDER_SEED = {"emi": 0.0, "existing_savings": 0.0}

# ---------------------------------------------------------------------------------------------------------

MAX_DIM_ROWS = 200


def _sql_value(value, kind: str) -> str:
    if value is None:
        return f"CAST(NULL AS {kind})"
    if kind == "STRING":
        return "'" + str(value).replace("'", "\\'") + "'"
    if kind == "DOUBLE":
        return f"{float(value)!r}D"
    return f"CAST({value} AS {kind})"


def literal_table(spark: SparkSession, columns: list[tuple[str, str]], rows: list[tuple]) -> DataFrame:
    """A VALUES relation: its statistics are exact and no Python worker takes part in scanning it."""
    if len(rows) > MAX_DIM_ROWS:
        raise ValueError(f"{len(rows)} rows are too many for a literal dimension")
    body = ", ".join("(" + ", ".join(_sql_value(v, k) for v, (_, k) in zip(row, columns)) + ")" for row in rows)
    names = ", ".join(name for name, _ in columns)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({names})")


def funds(spark: SparkSession) -> DataFrame:
    rows = []
    for i, (fund_id, name, cls, risk, five_yr, expense, ret, vol) in enumerate(FUNDS):
        label, equity, debt, gold = ASSET_CLASSES[cls]
        rows.append((fund_id, i, name, cls, label, CLASS_ORDER.index(cls), risk, five_yr, expense, ret, vol, equity, debt, gold))
    return literal_table(
        spark,
        [
            ("fund_id", "STRING"), ("fund_ord", "INT"), ("fund_name", "STRING"), ("asset_class", "STRING"),
            ("class_label", "STRING"), ("class_rank", "INT"), ("risk", "STRING"), ("five_yr", "DOUBLE"),
            ("expense", "DOUBLE"), ("exp_return", "DOUBLE"), ("volatility", "DOUBLE"),
            ("equity_part", "DOUBLE"), ("debt_part", "DOUBLE"), ("gold_part", "DOUBLE"),
        ],
        rows,
    )


def goal_templates(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark,
        [
            ("goal_id", "STRING"), ("template_ord", "INT"), ("goal_name", "STRING"), ("template_target", "DOUBLE"),
            ("template_years", "DOUBLE"), ("default_profile", "STRING"), ("cost_sensitivity", "STRING"),
        ],
        [(g[0], i, *g[1:]) for i, g in enumerate(GOALS)],
    )


def presets(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark,
        [("profile", "STRING"), ("pos", "BIGINT"), ("fund_id", "STRING"), ("weight", "DOUBLE")],
        [(p, i, fund, w) for p, funds_of in PRESETS.items() for i, (fund, w) in enumerate(funds_of)],
    )


def city_multipliers(spark: SparkSession) -> DataFrame:
    rows = []
    for tier, row in CITY_TIERS.items():
        rows += [(tier, sensitivity, row[i]) for i, sensitivity in enumerate(["high", "medium", "none"])]
    return literal_table(spark, [("city_tier", "STRING"), ("cost_sensitivity", "STRING"), ("mult", "DOUBLE")], rows)


def holding_types(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark,
        [("type_id", "STRING"), ("type_ord", "INT"), ("category", "STRING"), ("type_label", "STRING")],
        [(t[0], i, t[1], t[2]) for i, t in enumerate(HOLDING_TYPES)],
    )


def lookup(col, mapping: dict, default):
    """A short CASE over a fixed mapping."""
    expr = None
    for key, value in mapping.items():
        hit = col == F.lit(key)
        expr = F.when(hit, F.lit(value)) if expr is None else expr.when(hit, F.lit(value))
    return expr.otherwise(F.lit(default))
