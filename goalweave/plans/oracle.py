"""DuckDB SQL that computes each query's result on the same Parquet tables, for checking.

Written on its own terms where that is possible: crossing months are found by listing every month, priority moves
by list slicing, rates by a recursive query.
"""

from __future__ import annotations

import re

from ..functions.text import BLANKS, RUPEE
from ..sources import catalog
from . import queries as q


def d(x: float) -> str:
    """A DOUBLE literal (plain decimals would be DECIMAL)."""
    return f"CAST({float(x)!r} AS DOUBLE)"


def settled(x: str, digits: int = 12) -> str:
    scale = 10.0**digits
    return f"CASE WHEN abs({x}) >= {d(2.0**52 / scale)} THEN ({x}) ELSE floor(({x}) * {d(scale)} + {d(0.5)}) / {d(scale)} END"


def r6(x: str, name: str, digits: int = 6) -> str:
    return f"{settled(f'round(CAST({x} AS DOUBLE), {digits + 4})', digits)} AS {name}"


def rup(x: str, name: str) -> str:
    return f"CAST(floor(round(CAST({x} AS DOUBLE), 4) + {d(0.5)}) AS BIGINT) AS {name}"


def up(x: str) -> str:
    return f"floor(({x}) + {d(0.5)})"


def text(s) -> str:
    return "NULL" if s is None else "'" + str(s).replace("'", "''") + "'"


def values(rows, names: str) -> str:
    def one(v):
        return d(v) if isinstance(v, float) else str(v) if isinstance(v, int) else text(v)

    body = ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({names})"


def case(col: str, mapping: dict, default: str) -> str:
    arms = " ".join(f"WHEN {col} = {text(k) if isinstance(k, str) else k} THEN {v}" for k, v in mapping.items())
    return f"CASE {arms} ELSE {default} END"


def numbered(col: str, names: list[str], default: str = "NULL") -> str:
    return case(col, {i: text(n) for i, n in enumerate(names)}, default)


FUND_IDS = [f[0] for f in catalog.FUNDS]
SAVINGS = "floor(greatest(c_acctbal, 0) * 200 / 25000) * 25000"


def tier(part: int, col: str = "city_tier") -> str:
    fixed = {t: d(row[part]) for t, row in catalog.CITY_TIERS.items()}
    return case(col, fixed, fixed[catalog.UNKNOWN_CITY])


def income(prefix: str = "") -> str:
    stage = case("career_stage", {k: d(v) for k, v in catalog.STAGE_INCOME.items()}, d(catalog.UNKNOWN_STAGE_INCOME))
    work = case("employment", {k: d(v) for k, v in catalog.EMPLOYMENT_FACTOR.items()}, d(1))
    return f"{up(f'({stage}) * ({work}) * ({tier(4)}) / {d(1000)}')} * {d(1000)}"


SURPLUS = f"greatest({d(0)}, coalesce(take_home, 0) - coalesce(rent, 0) - coalesce(emi, 0) - ({tier(3)}))"
SIP = f"greatest({d(1000)}, {up(f'{SURPLUS} * {d(catalog.SURPLUS_TO_SIP)} / {d(500)}')} * {d(500)})"


def preset(years: str) -> str:
    return f"CASE WHEN {years} <= 3 THEN 'steady' WHEN {years} <= 7 THEN 'balanced' ELSE 'bold' END"


def months(years: str) -> str:
    return f"CAST(greatest(1, {up(f'{years} * 12')}) AS INTEGER)"


def annuity(rate: str, m: str) -> str:
    g = f"({d(1)} + {rate} / 12)"
    return f"(CASE WHEN {rate} = 0 THEN CAST({m} AS DOUBLE) ELSE (pow({g}, {m}) - 1) / ({rate} / 12) * {g} END)"


def value(s: str, sip: str, rate: str, m: str) -> str:
    return f"({s} * pow({d(1)} + {rate} / 12, {m}) + {sip} * {annuity(rate, m)})"


def req_sip(corpus: str, s: str, rate: str, m: str) -> str:
    left = f"({corpus} - {s} * pow({d(1)} + {rate} / 12, {m}))"
    return f"(CASE WHEN {left} <= 0 THEN {d(0)} ELSE {left} / {annuity(rate, m)} END)"


def group(n: str) -> str:
    s = f"CAST({n} AS VARCHAR)"
    head = f"reverse(rtrim(regexp_replace(reverse({s}[:-4]), '([0-9]{{2}})', '\\1,', 'g'), ','))"
    return f"(CASE WHEN length({s}) <= 3 THEN {s} ELSE {head} || ',' || {s}[-3:] END)"


def long_up(x: str) -> str:
    return f"CAST({up(x)} AS BIGINT)"


def trim2(x: str) -> str:
    h = long_up(f"({x}) * 100")
    return (
        f"(CAST({h} // 100 AS VARCHAR) || CASE WHEN {h} % 100 = 0 THEN '' WHEN {h} % 10 = 0 "
        f"THEN '.' || CAST({h} % 100 // 10 AS VARCHAR) ELSE '.' || lpad(CAST({h} % 100 AS VARCHAR), 2, '0') END)"
    )


def inr(x: str) -> str:
    a = f"abs({x})"
    return (
        f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || '{RUPEE}' || CASE "
        f"WHEN {a} >= {d(1e7)} THEN {trim2(f'{a} / {d(1e7)}')} || ' Cr' "
        f"WHEN {a} >= {d(1e5)} THEN {trim2(f'{a} / {d(1e5)}')} || ' L' "
        f"WHEN {a} >= 1000 THEN {group(long_up(a))} ELSE CAST({long_up(a)} AS VARCHAR) END)"
    )


def pct0(x: str) -> str:
    return f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || CAST({long_up(f'abs({x} * {d(100)})')} AS VARCHAR) || '%')"


def pct1(x: str) -> str:
    v = f"abs({x} * {d(100)})"
    p, c = f"({v} * {d(10)})", f"({d(134217729)} * {v})"
    hi = f"({c} - ({c} - {v}))"
    e = f"(({hi} * {d(10)} - {p}) + ({v} - {hi}) * {d(10)})"
    n = f"CAST(floor({p}) + CASE WHEN (({p} - floor({p}) - {d(0.5)}) + {e}) >= 0 THEN 1 ELSE 0 END AS BIGINT)"
    sign = f"CASE WHEN {x} < 0 THEN '-' ELSE '' END"
    return f"({sign} || CAST({n} // 10 AS VARCHAR) || '.' || CAST({n} % 10 AS VARCHAR) || '%')"


def years_text(y: str) -> str:
    whole = f"CAST(floor({y}) AS BIGINT)"
    m = long_up(f"({y} - floor({y})) * 12")
    full = f"({whole} + CASE WHEN {m} = 12 THEN 1 ELSE 0 END)"
    return (
        f"(CASE WHEN {y} <= 0 THEN 'now' WHEN {y} < 1 THEN CAST({long_up(f'{y} * 12')} AS VARCHAR) || ' mo' "
        f"WHEN {m} = 0 OR {m} = 12 THEN CAST({full} AS VARCHAR) || ' yr' || CASE WHEN {full} > 1 THEN 's' ELSE '' END "
        f"ELSE CAST({whole} AS VARCHAR) || 'y ' || CAST({m} AS VARCHAR) || 'm' END)"
    )


def edit_fund(factor: int) -> str:
    return numbered(f"basket_id * {factor} % {len(FUND_IDS)}", FUND_IDS, "'unlisted_fund'")


def goal_number(n: str) -> str:
    return numbered(n, q.GOAL_IDS)


POSITIVE = "CASE WHEN weight > 0 THEN weight ELSE 0 END"

# ---- shared tables ---------------------------------------------------------------------------------------

CTES = {
    "d_funds": values(
        [
            (f[0], i, f[1], f[2], catalog.ASSET_CLASSES[f[2]][0], catalog.CLASS_ORDER.index(f[2]), *f[3:],
             *catalog.ASSET_CLASSES[f[2]][1:])
            for i, f in enumerate(catalog.FUNDS)
        ],
        "fund_id, fund_ord, fund_name, asset_class, class_label, class_rank, risk, five_yr, expense, exp_return, "
        "volatility, equity_part, debt_part, gold_part",
    ),
    "d_goals": values(
        [(g[0], i, *g[1:]) for i, g in enumerate(catalog.GOALS)],
        "goal_id, template_ord, goal_name, template_target, template_years, default_profile, cost_sensitivity",
    ),
    "d_presets": values(
        [(p, i, f, w) for p, rows in catalog.PRESETS.items() for i, (f, w) in enumerate(rows)],
        "profile, pos, fund_id, weight",
    ),
    "d_mult": values(
        [(t, s, row[i]) for t, row in catalog.CITY_TIERS.items() for i, s in enumerate(["high", "medium", "none"])],
        "mult_tier, cost_sensitivity, mult",
    ),
    "d_types": values([(t[0], i, t[1], t[2]) for i, t in enumerate(catalog.HOLDING_TYPES)], "type_id, type_ord, category, type_label"),
    "profiles": f"""
        SELECT c_custkey AS user_id, {numbered("n_regionkey", ["metro", "tier1", "tier2", "tier3"])} AS city_tier,
          {case("c_mktsegment", {"AUTOMOBILE": "'salaried'", "BUILDING": "'self_employed'", "FURNITURE": "'freelancer'", "HOUSEHOLD": "'student'"}, "NULL")} AS employment,
          {numbered("c_custkey % 4", ["starting", "growing", "stable"])} AS career_stage,
          CASE WHEN c_custkey % 5 <> 4 THEN CAST(c_custkey * 7 % 121 * 1000 AS DOUBLE) END AS rent,
          CAST(c_custkey * 11 % 61 * 1000 AS DOUBLE) AS emi,
          CASE WHEN c_custkey % 6 <> 5 THEN 15000 + floor(abs(c_acctbal) * 20 / 1000) * 1000 END AS take_home,
          {SAVINGS} AS existing_savings,
          CASE WHEN c_custkey % 5 <> 0 THEN {numbered("c_custkey % 4", ["2", "4", "8", "14"])} END AS timeline
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "seeded": f"""
        SELECT user_id, city_tier, employment, career_stage, timeline, coalesce(rent, {tier(5)}) AS rent, emi,
          coalesce(take_home, {income()}) AS take_home, existing_savings
        FROM profiles""",
    "goals": """
        SELECT c_custkey AS user_id, CAST(ord AS INTEGER) AS ord, goal_id, goal_name,
          CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE template_target END AS target_today,
          template_years + CASE WHEN c_custkey % 13 = 0 THEN 0.25 ELSE 0 END AS horizon_years,
          ord = 0 AND c_custkey % 5 <> 0 AS tenure_confirmed,
          ord = (c_custkey + 1) % nullif(c_custkey % 4, 0) AS is_current,
          CASE WHEN (c_custkey + ord) % 8 = 0 THEN NULL WHEN c_custkey % 12 = 3 THEN 0
            ELSE CAST((ord + 1) * 100 AS DOUBLE) / nullif((c_custkey % 4) * (c_custkey % 4 + 1) / 2, 0) END AS share
        FROM customer CROSS JOIN range(0, 3) r(ord) JOIN d_goals ON template_ord = (c_custkey + 3 * ord) % 10
        WHERE ord < c_custkey % 4""",
    "pools": f"""
        SELECT c_custkey AS user_id,
          CAST(CASE WHEN c_custkey % 7 = 0 THEN 0 WHEN c_custkey % 7 = 1 THEN 500000 ELSE c_custkey * 13 % 200 * 500 END AS DOUBLE) AS monthly_sip,
          {SAVINGS} AS current_savings, CASE WHEN c_custkey % 9 = 0 THEN {d(0.04)} ELSE {d(0.06)} END AS inflation
        FROM customer""",
    "goal_order": """
        SELECT user_id, goal_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY (user_id * 7 + ord * 5) % 3, ord) AS INTEGER) AS rank
        FROM goals WHERE (user_id + ord) % 6 <> 0
        UNION ALL SELECT c_custkey, 'ghost_goal', 9 FROM customer WHERE c_custkey % 10 = 0""",
    "baskets": f"""
        SELECT l_orderkey AS basket_id, {numbered("l_partkey % 13", FUND_IDS, "'unlisted_fund'")} AS fund_id,
          sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS weight,
          CAST(min(l_linenumber * 100 + l_partkey % 13) AS BIGINT) AS pos
        FROM lineitem GROUP BY 1, 2""",
    "holdings": """
        SELECT o_orderkey AS holding_id, o_custkey AS user_id, CAST(o_orderkey % 16 AS INTEGER) AS type_ord,
          CASE WHEN o_orderkey % 17 = 0 THEN '   ' ELSE '  ' || o_orderpriority || ' ' END AS name,
          CASE WHEN o_orderstatus = 'P' THEN -o_totalprice ELSE o_totalprice END AS amount
        FROM orders""",
    "flows": f"""
        SELECT o_custkey AS entity_id, o_orderkey AS seq, CAST(o_orderdate AS DATE) AS flow_date, -o_totalprice AS amount FROM orders
        UNION ALL
        SELECT o_custkey, 1000000000, DATE '2002-01-01',
          floor(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) * 5 / 4) / 100
        FROM orders GROUP BY 1""",
    "edits": f"""
        SELECT user_id, ts, event_id AS seq,
          {case("event_type", {k: text(v) for k, v in {"click": "set_sip", "view": "set_savings", "purchase": "add_holding", "signup": "set_inflation", "error": "set_weight"}.items()}, "NULL")} AS action,
          CASE event_type WHEN 'click' THEN value * {d(1000)} WHEN 'view' THEN value * {d(10000)}
            WHEN 'signup' THEN value / {d(10000)} ELSE value END AS value,
          CAST(json_extract(props, '$.k') AS INTEGER) AS slot
        FROM events""",
    "basket_edits": f"""
        SELECT user_id, ts, event_id AS seq,
          {case("event_type", {k: text(v) for k, v in {"error": "set_weight", "purchase": "add_fund", "view": "remove_fund", "signup": "apply_preset"}.items()}, "NULL")} AS action,
          value, CAST(json_extract(props, '$.k') AS INTEGER) AS slot
        FROM events""",
    "pool_state": f"""
        SELECT user_id,
          coalesce(last(value ORDER BY ts, seq) FILTER (WHERE action = 'set_sip'), {d(25000)}) AS monthly_sip,
          coalesce(last(value ORDER BY ts, seq) FILTER (WHERE action = 'set_savings'), {d(0)}) AS current_savings,
          coalesce(last(value ORDER BY ts, seq) FILTER (WHERE action = 'set_inflation'), {d(0.06)}) AS inflation
        FROM edits GROUP BY user_id""",
    "metrics": f"""
        SELECT basket_id, total, {settled("CASE WHEN total > 0 THEN rs / total ELSE 0 END")} AS blended_return,
          {settled("CASE WHEN total > 0 THEN vs / total ELSE 0 END")} AS blended_volatility,
          {settled("eq")} AS equity, {settled("de")} AS debt, {settled("go")} AS gold,
          {settled("CASE WHEN total > 0 THEN eq / total ELSE 0 END")} AS growth_weight
        FROM (SELECT basket_id, sum(w) AS total, sum(w * coalesce(exp_return, 0)) AS rs, sum(w * coalesce(volatility, 0)) AS vs,
            sum(w * coalesce(equity_part, 0)) AS eq, sum(w * coalesce(debt_part, 0)) AS de, sum(w * coalesce(gold_part, 0)) AS go
          FROM (SELECT *, {POSITIVE} AS w FROM baskets) LEFT JOIN d_funds USING (fund_id) GROUP BY basket_id)""",
    "top": """
        SELECT basket_id, fund_id, weight / total AS top_weight, weight / total > 0.7 AS concentrated
        FROM (SELECT *, sum(weight) OVER (PARTITION BY basket_id) AS total,
            row_number() OVER (PARTITION BY basket_id ORDER BY weight DESC, pos) AS rn
          FROM baskets WHERE weight > 0) WHERE rn = 1""",
    "preset_facts": f"""
        SELECT profile, {settled("sum(weight * exp_return) / sum(weight)")} AS blended_return,
          {settled("sum(weight * volatility) / sum(weight)")} AS blended_volatility
        FROM d_presets JOIN d_funds USING (fund_id) GROUP BY profile""",
    "inputs": f"""
        SELECT *, current_savings * fraction AS savings, monthly_sip * fraction AS sip, {preset("horizon_years")} AS profile,
          {months("horizon_years")} AS months
        FROM (SELECT *, coalesce(share / 100, {d(1)} / count(*) OVER (PARTITION BY user_id)) AS fraction
          FROM goals JOIN pools USING (user_id))""",
    "preset_inputs": "SELECT * FROM inputs JOIN preset_facts USING (profile)",
    "need": f"""
        SELECT *, {req_sip(f"(target_today * pow({d(1)} + inflation, horizon_years))", d(0), "blended_return", months("horizon_years"))} AS need
        FROM (SELECT *, {preset("horizon_years")} AS profile FROM goals) JOIN pools USING (user_id) JOIN preset_facts USING (profile)""",
    "members": f"""
        SELECT basket_id, fund_id, pos, CASE WHEN weight > 0 THEN weight / total * 100 ELSE 0 END AS weight
        FROM (SELECT *, sum({POSITIVE}) OVER (PARTITION BY basket_id) AS total FROM baskets) WHERE total > 0""",
}


def planned(source: str) -> str:
    """Plan results over a table of plan inputs."""
    return f"""
        SELECT *, corpus AS projected_corpus, corpus - required_corpus AS gap, corpus - required_corpus >= 0 AS on_track,
          savings + sip * months AS total_invested,
          {req_sip("required_corpus", "savings", "blended_return", "months")} AS required_sip,
          corpus / pow({d(1)} + inflation, horizon_years) AS real_corpus,
          CASE WHEN required_corpus > 0 THEN corpus / required_corpus ELSE 1 END AS progress,
          CAST(list_min(list_filter(range(0, months + 1), lambda m: {value("savings", "sip", "blended_return", "m")} >= required_corpus)) AS INTEGER) AS goal_reached_month
        FROM (SELECT *, {value("savings", "sip", "blended_return", "months")} AS corpus,
            target_today * pow({d(1)} + inflation, horizon_years) AS required_corpus FROM {source})"""


def split(source: str, place: str) -> str:
    """Recommended share of each goal from needs and an order."""
    ahead = f"coalesce(sum(need) OVER (PARTITION BY user_id ORDER BY {place} NULLS LAST, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    return f"""
        SELECT *, CASE WHEN monthly_sip <= 0 OR total_need <= 0 THEN {d(100)} / n
            WHEN monthly_sip >= total_need THEN need / total_need * 100 ELSE given / monthly_sip * 100 END AS new_share
        FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, sum(need) OVER (PARTITION BY user_id) AS total_need,
            CASE WHEN {place} IS NULL THEN 0 ELSE greatest(0, least(need, monthly_sip - {ahead})) END AS given
          FROM {source})"""


def split_and_plan(goals: str) -> str:
    """From goals with the user's money to plans under the recommended split."""
    facts = f"(SELECT *, {preset('horizon_years')} AS profile FROM {goals}) JOIN preset_facts USING (profile)"
    need = req_sip(f"(target_today * pow({d(1)} + inflation, horizon_years))", d(0), "blended_return", months("horizon_years"))
    ranked = f"""(SELECT *, {need} AS need, {months("horizon_years")} AS months,
        CAST(row_number() OVER (PARTITION BY user_id ORDER BY horizon_years, ord) AS INTEGER) AS priority FROM {facts})"""
    shared = f"""(SELECT *, current_savings * new_share / 100 AS savings, monthly_sip * new_share / 100 AS sip
        FROM ({split(ranked, "priority")}))"""
    return planned(shared)


def plan_columns(source: str, more: str = "") -> str:
    money = ", ".join(rup(c, c) for c in q.MONEY_RESULTS)
    rates = ", ".join(r6(c, c) for c in q.RATE_RESULTS)
    return f"SELECT user_id, goal_id, months, {money}, {rates}, on_track, goal_reached_month{more} FROM {source}"


CTES["plans"] = planned("preset_inputs")
CTES["basket_inputs"] = """
    SELECT i.*, coalesce(total, 0) AS total, coalesce(blended_return, 0) AS blended_return,
      coalesce(blended_volatility, 0) AS blended_volatility, coalesce(growth_weight, 0) AS growth_weight,
      coalesce(top_weight, 0) AS top_weight, f.fund_name AS top_fund_name
    FROM inputs i LEFT JOIN metrics m ON m.basket_id = i.user_id * 3 + i.ord
      LEFT JOIN top t ON t.basket_id = i.user_id * 3 + i.ord LEFT JOIN d_funds f ON f.fund_id = t.fund_id"""
CTES["basket_plans"] = planned("basket_inputs")


def remark_list() -> str:
    corpus, required = inr("projected_corpus"), inr("required_corpus")
    horizon = years_text("horizon_years")
    bold = "(horizon_years <= 3 AND growth_weight > 0.4)"
    cautious = "(horizon_years >= 10 AND growth_weight < 0.4)"
    rules = [
        ("on_track", "positive", "on_track", f"'Projected ' || {corpus} || ' covers the ' || {required} || ' needed, with ' || {inr('abs(gap)')} || ' to spare.'"),
        ("on_track AND goal_reached_month < months", "positive", "ahead",
         f"'This pace reaches the goal in about ' || {years_text('(CAST(goal_reached_month AS DOUBLE) / 12)')} || '.'"),
        ("NOT on_track", "warning", "shortfall",
         f"'Projected ' || {corpus} || ' leaves ' || {inr('abs(gap)')} || ' missing; ' || {inr('required_sip')} || "
         f"' a month (' || {inr('greatest(0, required_sip - sip)')} || ' more) closes it.'"),
        (bold, "warning", "too_bold", f"{pct0('growth_weight')} || ' equity is a lot with ' || {horizon} || ' to go.'"),
        (cautious, "info", "too_cautious",
         f"{pct0('growth_weight')} || ' equity is little over ' || {horizon} || '.'"),
        ("top_weight > 0.7", "info", "concentrated",
         f"{pct0('top_weight')} || ' of the basket is ' || coalesce(top_fund_name, 'a single fund') || '.'"),
        ("abs(total - 100) > 0.5", "info", "basket_fill",
         f"'The weights add up to ' || CAST({long_up('total')} AS VARCHAR) || '%; they are read as shares of that.'"),
        ("TRUE", "info", "inflation", f"{inr('target_today')} || ' of today becomes ' || {required} || ' in ' || {horizon} || '.'"),
    ]
    items = ", ".join(
        f"CASE WHEN {when} THEN {{'tone': '{tone}', 'code': '{code}', 'message': {message}}} END"
        for when, tone, code, message in rules
    )
    empty = "[{'tone': 'info', 'code': 'empty_basket', 'message': 'Add a fund to see a projection.'}]"
    return f"(CASE WHEN total > 0 THEN list_filter([{items}], lambda r: r IS NOT NULL) ELSE {empty} END)"


CTES["remark_lists"] = f"SELECT user_id, goal_id, {remark_list()} AS fired FROM basket_plans"
def number(x: str) -> str:
    """A double as JSON shows it: no exponent, no zeros behind the last digit."""
    return f"regexp_replace(CAST(CAST({x} AS DOUBLE) AS VARCHAR), '\\.0$', '')"


def json_object(fields: dict[str, str]) -> str:
    return "'{' || " + " || ',' || ".join(f"'\"{name}\":' || {value}" for name, value in fields.items()) + " || '}'"


SUMMARY = json_object({
    "goal": "CAST(to_json(goal_name) AS VARCHAR)", "targetTodayINR": number("target_today"), "horizonYears": number("horizon_years"),
    "monthlySipINR": long_up("sip"), "monthlyPoolINR": number("monthly_sip"), "currentSavingsINR": long_up("savings"),
    "inflationPct": long_up("inflation * 100"), "projectedCorpusINR": long_up("projected_corpus"),
    "requiredCorpusINR": long_up("required_corpus"), "gapINR": long_up("gap"), "onTrack": "CAST(on_track AS VARCHAR)",
    "expectedReturnPct": number(f"{up('blended_return * 1000')} / 10"), "allocationPct": "'{' || alloc || '}'",
    "otherGoals": "CAST(to_json(coalesce(others, CAST([] AS VARCHAR[]))) AS VARCHAR)",
})
CTES["summaries"] = f"""
    SELECT p.user_id, {SUMMARY} AS plan_json
    FROM plans p
      JOIN (SELECT profile, string_agg(CAST(to_json(fund_name) AS VARCHAR) || ':' || {number("weight")}, ',' ORDER BY pos) AS alloc
        FROM d_presets JOIN d_funds USING (fund_id) GROUP BY profile) USING (profile)
      LEFT JOIN (SELECT user_id, list(goal_name ORDER BY ord) FILTER (WHERE NOT is_current) AS others FROM goals GROUP BY 1) o
        ON o.user_id = p.user_id
    WHERE is_current"""


CTES["message_pages"] = """
    SELECT conv_id, greatest(turn, 0) // 5 AS page, CAST(count(*) AS INTEGER) AS n_messages,
      '[' || string_agg('{"role":' || CAST(to_json(role) AS VARCHAR) || ',"content":' || CAST(to_json(content) AS VARCHAR) || '}', ',' ORDER BY turn) || ']' AS messages_json
    FROM (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END AS role, coalesce(text, '') AS content FROM conversations
      UNION ALL
      SELECT c.conv_id, -1, 'system', 'You explain saving plans in rupees, in plain words and with the figures given.' || coalesce(' Plan: ' || plan_json, '')
      FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN summaries s ON s.user_id = c.conv_id)
    GROUP BY 1, 2"""


def rate_query(flows: str, key: str) -> str:
    """Bisection as a recursive query over (key, flows) with flows a list of {t, a}."""
    value_at = "list_sum(list_transform(flows, lambda f: f.a * pow(1 + {r}, -f.t)))"
    low = value_at.format(r=d(-0.9999))
    return f"""
        RECURSIVE start AS ({flows}),
        walk AS (
          SELECT {key}, flows, {d(-0.9999)} AS lo, {d(10)} AS hi, {low} AS flo, CAST(NULL AS DOUBLE) AS root, 0 AS i FROM start
          UNION ALL
          SELECT {key}, flows, CASE WHEN abs(fm) < 1e-6 OR flo * fm < 0 THEN lo ELSE mid END,
            CASE WHEN abs(fm) >= 1e-6 AND flo * fm < 0 THEN mid ELSE hi END,
            CASE WHEN abs(fm) < 1e-6 OR flo * fm < 0 THEN flo ELSE fm END,
            CASE WHEN abs(fm) < 1e-6 THEN mid END, i + 1
          FROM (SELECT *, {value_at.format(r="mid")} AS fm FROM (SELECT *, (lo + hi) / 2 AS mid FROM walk WHERE root IS NULL AND i < 200))),
        found AS (SELECT {key}, arg_max(coalesce(root, (lo + hi) / 2), i) AS rate FROM walk WHERE root IS NOT NULL OR i = 200 GROUP BY {key})"""


def basket(columns: str) -> str:
    return f"SELECT basket_id, {columns} FROM metrics"


def edited(new_first: str, rows: str) -> str:
    """Basket rows after an edit: the edited fund's row at place 0 and the kept rows."""
    return f"{new_first} UNION ALL {rows}"


KEEP_PLACE = "CAST(row_number() OVER (PARTITION BY basket_id ORDER BY pos) AS INTEGER)"
EVERY_BASKET = "(SELECT DISTINCT basket_id FROM baskets)"


# Goals outside a user's order have no place; a user without any order is served as declared.
ORDERED_NEED = """(SELECT n.*, CASE WHEN n.user_id IN (SELECT user_id FROM goal_order) THEN o.rank ELSE n.ord END AS place
    FROM need n LEFT JOIN goal_order o ON o.user_id = n.user_id AND o.goal_id = n.goal_id)"""

SQL: dict[str, str] = {
    "fund_catalog": f"""
        SELECT f.*, coalesce(n_baskets, 0) AS n_baskets, coalesce(held_weight, 0) AS held_weight FROM d_funds f
        LEFT JOIN (SELECT fund_id, count(*) AS n_baskets, sum({POSITIVE}) AS held_weight FROM baskets GROUP BY 1) USING (fund_id)""",
    "goal_catalog": """
        SELECT g.*, coalesce(n, 0) AS n_picked FROM d_goals g
        LEFT JOIN (SELECT goal_id, count(*) AS n FROM goals GROUP BY 1) USING (goal_id)""",
    "model_portfolios": f"""
        SELECT profile, CAST(pos AS BIGINT) AS pos, fund_id, weight, sum(weight) OVER (PARTITION BY profile) AS preset_total,
          coalesce(n, 0) AS n_goals
        FROM d_presets LEFT JOIN (SELECT {preset("horizon_years")} AS profile, count(*) AS n FROM goals GROUP BY 1) USING (profile)""",
    "holding_type_catalog": """
        SELECT category, min(type_ord) AS first_ord, count(*) AS n_types, string_agg(type_label, '; ' ORDER BY type_ord) AS labels,
          coalesce(max(n), 0) AS n_holdings
        FROM d_types LEFT JOIN (SELECT category, count(*) AS n FROM holdings JOIN d_types USING (type_ord) GROUP BY 1) USING (category)
        GROUP BY category""",
    "questionnaire_pivot": "SELECT * FROM seeded",
    "fund_search": f"""
        SELECT p_partkey, search_class, CAST(word_pos AS INTEGER) AS word_pos, search_text, fund_ord, fund_id, asset_class
        FROM (SELECT p_partkey, {numbered("p_size % 5", q.CATEGORIES)} AS search_class, words[w + 1] AS search_text, w AS word_pos
          FROM (SELECT *, string_split(p_name, ' ') AS words FROM part), range(0, 50) r(w) WHERE w < len(words))
        JOIN d_funds ON (search_class = 'all' OR asset_class = search_class) AND contains(lower(fund_name), lower(search_text))""",
    "infer_income": f"SELECT user_id, {income()} AS income FROM profiles",
    "rent_default": f"SELECT user_id, {tier(5)} AS rent_guess FROM profiles",
    "living_cost_surplus": f"SELECT user_id, {SURPLUS} AS surplus FROM profiles",
    "suggested_sip": f"SELECT user_id, {SIP} AS monthly_sip FROM profiles",
    "adjusted_target": f"""
        SELECT user_id, goal_id, {up(f"template_target * mult / {d(1000)}")} * 1000 AS target_today
        FROM profiles p CROSS JOIN d_goals g
        JOIN d_mult m ON m.mult_tier = coalesce(p.city_tier, 'tier2') AND m.cost_sensitivity = g.cost_sensitivity""",
    "auto_profile": f"SELECT user_id, goal_id, horizon_years, {preset('horizon_years')} AS profile FROM goals",
    "risk_label": """
        SELECT basket_id, CASE WHEN total <= 0 THEN '—' WHEN blended_volatility < 0.06 THEN 'Low'
          WHEN blended_volatility < 0.13 THEN 'Moderate' ELSE 'High' END AS risk FROM metrics""",
    "basket_flags": "SELECT basket_id, total > 0 AND equity / total > 0.7 AND debt / greatest(total, 1) < 0.1 AS equity_heavy FROM metrics",
    "lakh_in_ten_years": f"SELECT basket_id, CASE WHEN total > 0 THEN {rup(f'100000 * pow({d(1)} + blended_return, 10)', 'x')[:-5]} END AS lakh_value FROM metrics",
    "goal_monthly": f"""
        SELECT user_id, goal_id, {r6("fraction", "fraction")}, {rup("sip", "monthly")},
          CASE WHEN monthly_sip > 0 THEN {long_up("sip / monthly_sip * 100")} ELSE 0 END AS share_pct FROM inputs""",
    "plan_inputs": f"""
        SELECT p.user_id, goal_id, coalesce(target_today, 0) AS target_today, coalesce(horizon_years, 1) AS horizon_years,
          {rup("coalesce(savings, 0)", "savings")}, {rup("coalesce(sip, 0)", "sip")}, p.inflation
        FROM pools p LEFT JOIN inputs i ON i.user_id = p.user_id""",
    "target_year": f"SELECT user_id, goal_id, {q.BASE_YEAR} + horizon_years AS target_year FROM goals",
    "clamp_goal_edits": f"""
        SELECT user_id, seq, CASE WHEN action = 'set_savings' THEN greatest(0, {up("value - 200000")}) END AS new_target,
          CASE WHEN action = 'set_weight' THEN greatest(1, {up("value / 10")}) END AS new_tenure, action = 'set_weight' AS confirmed
        FROM edits WHERE action IN ('set_savings', 'set_weight')""",
    "progress_pct": f"""
        SELECT user_id, goal_id, {r6("c", "progress_capped")}, {long_up("c * 100")} AS progress_pct
        FROM (SELECT *, greatest(0, least(1, progress)) AS c FROM plans)""",
    "holdings_validated": f"""
        SELECT holding_id, user_id, category, type_label, trim(name, {text(BLANKS)}) AS name, {long_up("amount")} AS amount
        FROM holdings JOIN d_types USING (type_ord) WHERE trim(name, {text(BLANKS)}) <> '' AND amount > 0""",
    "patch_current_goal": f"""
        SELECT g.user_id, goal_id, is_current, {rup("CASE WHEN is_current THEN coalesce(t, target_today) ELSE target_today END", "target_today")},
          CASE WHEN is_current AND w IS NOT NULL THEN CASE WHEN w < 20 THEN 'steady' WHEN w < 60 THEN 'balanced' ELSE 'bold' END
            ELSE {preset("horizon_years")} END AS profile
        FROM goals g LEFT JOIN (SELECT user_id, last(value ORDER BY ts, seq) FILTER (WHERE action = 'set_savings') AS t,
            last(value ORDER BY ts, seq) FILTER (WHERE action = 'set_weight') AS w FROM edits GROUP BY 1) e ON e.user_id = g.user_id""",
    "allocation_fund_lookup": """
        SELECT basket_id, fund_id, weight, coalesce(exp_return, 0) AS exp_return, coalesce(volatility, 0) AS volatility
        FROM baskets LEFT JOIN d_funds USING (fund_id)""",
    "allocation_composition": "SELECT basket_id, fund_id, asset_class, equity_part, debt_part, gold_part FROM baskets JOIN d_funds USING (fund_id)",
    "remaining_goals": """
        SELECT c_custkey AS user_id, template_ord, goal_id FROM customer CROSS JOIN d_goals d
        WHERE NOT EXISTS (SELECT 1 FROM goals g WHERE g.user_id = c_custkey AND g.goal_id = d.goal_id)""",
    "priority_order_valid": "SELECT * FROM goal_order o WHERE EXISTS (SELECT 1 FROM goals g WHERE g.user_id = o.user_id AND g.goal_id = o.goal_id)",
    "holding_type_lookup": """
        SELECT holding_id, user_id, coalesce(type_id, 'unknown') AS type_id, coalesce(category, 'unknown') AS category,
          coalesce(type_label, 'unknown') AS type_label FROM holdings LEFT JOIN d_types USING (type_ord)""",
    "plan_goal_allocations": f"""
        SELECT user_id, goal_id, profile, CAST(pos AS BIGINT) AS pos, fund_id, weight
        FROM (SELECT *, {preset("horizon_years")} AS profile FROM goals) JOIN d_presets USING (profile)""",
    "allocation_total": basket("total"),
    "blended_return": basket(r6("blended_return", "blended_return")),
    "blended_volatility": basket(r6("blended_volatility", "blended_volatility")),
    "band_weights": basket(f"{r6('equity', 'equity')}, {r6('debt', 'debt')}, {r6('gold', 'gold')}"),
    "growth_weight": basket(r6("growth_weight", "growth_weight")),
    "band_segments": " UNION ALL ".join(
        f"SELECT basket_id, '{b}' AS band, {r6(f'{b} * CASE WHEN total > 100 THEN 100 / total ELSE 1 END', 'size')} FROM metrics WHERE {b} > 0.01"
        for b in ("equity", "debt", "gold")
    ),
    "holdings_total": f"SELECT user_id, {r6('sum(greatest(amount, 0))', 'holdings_total', 2)} FROM holdings GROUP BY 1",
    "savings_reconcile": f"""
        SELECT p.user_id, {r6("coalesce(t, 0)", "holdings_total", 2)}, existing_savings,
          {up("coalesce(t, 0)")} <> {up("existing_savings")} AS differs
        FROM profiles p LEFT JOIN (SELECT user_id, sum(greatest(amount, 0)) AS t FROM holdings GROUP BY 1) h ON h.user_id = p.user_id""",
    "unconfirmed_goals": "SELECT user_id, count(*) FILTER (WHERE NOT tenure_confirmed) AS unconfirmed FROM goals GROUP BY 1",
    "total_required_sip": f"SELECT user_id, {rup('sum(need)', 'total_need')} FROM need GROUP BY 1",
    "xnpv": f"""
        SELECT entity_id, rate, {rup("sum(amount / pow(1 + rate, date_diff('day', origin, flow_date) / " + d(365) + "))", "xnpv")}
        FROM (SELECT *, min(flow_date) OVER (PARTITION BY entity_id) AS origin FROM flows)
        CROSS JOIN (VALUES {", ".join(f"({d(r)})" for r in q.NPV_RATES)}) v(rate) GROUP BY 1, 2""",
    "normalized_weights": f"SELECT basket_id, fund_id, {r6('weight / sum(weight) OVER (PARTITION BY basket_id)', 'weight')} FROM baskets WHERE weight > 0",
    "sip_waterfall": f"""
        SELECT user_id, goal_id, {rup("need", "need")}, {rup("given", "given")}
        FROM ({split(ORDERED_NEED, "place")})""",
    "tenure_rank": "SELECT user_id, goal_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY horizon_years, ord) AS INTEGER) AS priority FROM goals",
    "goals_by_priority": """
        SELECT g.user_id, g.goal_id, CAST(row_number() OVER (PARTITION BY g.user_id ORDER BY rank NULLS LAST, ord) AS INTEGER) AS priority
        FROM goals g LEFT JOIN goal_order o ON o.user_id = g.user_id AND o.goal_id = g.goal_id""",
    "goal_reached_month": "SELECT user_id, goal_id, goal_reached_month FROM plans",
    "top_holding": f"SELECT basket_id, fund_id, {r6('top_weight', 'top_weight')}, concentrated FROM top",
    "basket_by_class": """
        SELECT basket_id, fund_id, asset_class, CAST(row_number() OVER (PARTITION BY basket_id ORDER BY class_rank, pos) AS INTEGER) AS place
        FROM baskets JOIN d_funds USING (fund_id)""",
    "goal_pick_cap": f"""
        SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY pick_no) AS INTEGER) AS place
          FROM (SELECT user_id, {goal_number("slot % 10")} AS goal_id, min(seq) AS pick_no FROM edits GROUP BY 1, 2)) WHERE place <= 3""",
    "insights_first4": """
        SELECT user_id, goal_id, CAST(len(fired) AS INTEGER) AS fired,
          array_to_string(list_transform(fired[1:4], lambda r: r.code), ',') AS codes FROM remark_lists""",
    "goal_set_after_remove": """
        SELECT g.user_id, g.goal_id, g.ord = min(g.ord) OVER (PARTITION BY g.user_id) AS is_current,
          CAST(row_number() OVER (PARTITION BY g.user_id ORDER BY rank NULLS LAST, ord) AS INTEGER) AS priority
        FROM goals g LEFT JOIN goal_order o ON o.user_id = g.user_id AND o.goal_id = g.goal_id WHERE NOT is_current""",
    "holdings_after_remove": """
        SELECT holding_id, user_id, type_ord, amount FROM holdings
        WHERE holding_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
    "recommend_shares": f"""
        SELECT user_id, goal_id, {r6("new_share", "share")} FROM ({split(
          ORDERED_NEED, "place")})""",
    "set_goal_amount": f"""
        SELECT user_id, goal_id, {r6('''CASE WHEN monthly_sip <= 0 OR amount IS NULL THEN share WHEN n = 1 THEN 100 WHEN is_current THEN fixed
            WHEN others > 0 THEN coalesce(share, 0) / others * (100 - fixed) ELSE (100 - fixed) / (n - 1) END''', "share")}
        FROM (SELECT i.*, amount, greatest(0, least(100, amount / CASE WHEN monthly_sip > 0 THEN monthly_sip END * 100)) AS fixed,
            count(*) OVER (PARTITION BY i.user_id) AS n,
            sum(CASE WHEN is_current THEN 0 ELSE coalesce(share, 0) END) OVER (PARTITION BY i.user_id) AS others
          FROM inputs i LEFT JOIN (SELECT user_id, last(value ORDER BY ts, seq) FILTER (WHERE action = 'set_sip') AS amount
            FROM edits GROUP BY 1) e ON e.user_id = i.user_id)""",
    "remove_goal_shares": f"""
        SELECT user_id, goal_id, {r6(f"CASE WHEN total > 0 THEN CASE WHEN share IS NULL THEN NULL ELSE greatest(share, 0) / total * 100 END ELSE {d(100)} / n END", "share")}
        FROM (SELECT *, sum(greatest(coalesce(share, 0), 0)) OVER (PARTITION BY user_id) AS total, count(*) OVER (PARTITION BY user_id) AS n
          FROM goals WHERE NOT is_current)""",
    "normalize_to_100": f"SELECT basket_id, fund_id, {r6('weight', 'weight')} FROM members",
    "add_fund": f"""
        WITH state AS (SELECT b.basket_id, {edit_fund(1).replace("basket_id", "b.basket_id")} AS edit_fund, count(m.fund_id) AS n,
            coalesce(bool_or(m.fund_id = {edit_fund(1).replace("basket_id", "b.basket_id")}), FALSE) AS present, coalesce(sum(m.weight), 0) AS total
          FROM {EVERY_BASKET} b LEFT JOIN members m ON m.basket_id = b.basket_id GROUP BY 1)
        SELECT basket_id, edit_fund AS fund_id, {r6(f"CASE WHEN n = 0 THEN 100 ELSE {d(100)} / (n + 1) END", "weight")}, 0 AS place
        FROM state WHERE NOT present
        UNION ALL
        SELECT m.basket_id, fund_id, {r6(f"CASE WHEN present THEN weight WHEN total > 0 THEN weight / total * (100 - {d(100)} / (n + 1)) ELSE (100 - {d(100)} / (n + 1)) / n END", "weight")},
          CAST(row_number() OVER (PARTITION BY m.basket_id ORDER BY pos) AS INTEGER) AS place
        FROM members m JOIN state s ON s.basket_id = m.basket_id""",
    "set_fund_weight": f"""
        WITH state AS (SELECT *, n - CASE WHEN present THEN 1 ELSE 0 END AS n_other FROM (
          SELECT b.basket_id, {edit_fund(5).replace("basket_id", "b.basket_id")} AS edit_fund, count(m.fund_id) AS n,
            CAST(greatest(0, least(100, b.basket_id * 7 % 121 - 10)) AS DOUBLE) AS fixed,
            coalesce(bool_or(m.fund_id = {edit_fund(5).replace("basket_id", "b.basket_id")}), FALSE) AS present,
            coalesce(sum(m.weight) FILTER (WHERE m.fund_id <> {edit_fund(5).replace("basket_id", "b.basket_id")}), 0) AS others
          FROM {EVERY_BASKET} b LEFT JOIN members m ON m.basket_id = b.basket_id GROUP BY 1))
        SELECT basket_id, edit_fund AS fund_id, {r6("CASE WHEN n <= 1 THEN 100 ELSE fixed END", "weight")}, 0 AS place FROM state
        UNION ALL
        SELECT basket_id, fund_id, {r6("CASE WHEN others > 0 THEN weight / others * (100 - fixed) ELSE (100 - fixed) / n_other END", "weight")}, place
        FROM (SELECT m.*, edit_fund, n, n_other, fixed, others, CAST(row_number() OVER (PARTITION BY m.basket_id ORDER BY pos) AS INTEGER) AS place
          FROM members m JOIN state s ON s.basket_id = m.basket_id) WHERE n > 1 AND fund_id <> edit_fund""",
    "remove_fund": f"""
        SELECT basket_id, fund_id, {r6("CASE WHEN weight > 0 THEN weight / total * 100 ELSE 0 END", "weight")}
        FROM (SELECT *, sum(weight) OVER (PARTITION BY basket_id) AS total FROM members WHERE fund_id <> {edit_fund(1)}) WHERE total > 0""",
    "apply_preset": f"""
        SELECT user_id, goal_id, p.profile, CAST(pos AS BIGINT) AS pos, fund_id, {r6("weight", "weight")}
        FROM goals JOIN d_presets p ON p.profile = {numbered("user_id % 3", q.PRESET_NAMES)} WHERE is_current""",
    "fund_monthly_amounts": f"""
        SELECT user_id, goal_id, fund_id, {rup("sip * weight / total", "amount")}, {long_up("weight / total * 100")} AS pct
        FROM inputs JOIN (SELECT *, sum(weight) OVER (PARTITION BY profile) AS total FROM d_presets) USING (profile)""",
    "projection_series": f"""
        SELECT user_id, goal_id, CAST(m AS INTEGER) AS month, {r6(f"m / {d(12)}", "year")}, {rup("savings + sip * m", "invested")},
          {rup(value("savings", "sip", "blended_return", "m"), "value")}
        FROM (SELECT *, unnest(range(0, months + 1)) AS m FROM preset_inputs)""",
    "required_corpus": f"SELECT user_id, goal_id, {rup('required_corpus', 'required_corpus')} FROM plans",
    "real_corpus": f"SELECT user_id, goal_id, {rup('real_corpus', 'real_corpus')} FROM plans",
    "required_sip": f"SELECT user_id, goal_id, {rup('required_sip', 'required_sip')} FROM plans",
    "plan_cash_flows": f"""
        SELECT user_id, goal_id, CAST(m AS INTEGER) AS month, CAST(DATE '2025-01-01' + to_months(CAST(m AS INTEGER)) AS DATE) AS flow_date,
          {rup("CASE WHEN m = months THEN projected_corpus WHEN m = 0 THEN -(savings + sip) ELSE -sip END", "amount")}
        FROM (SELECT *, unnest(range(0, months + 1)) AS m FROM plans)""",
    "compute_plan": plan_columns("plans"),
    "format_inr": f"SELECT o_orderkey, {inr('amount')} AS shown FROM scaled_prices",
    "format_inr_full": f"""
        SELECT o_orderkey, CASE WHEN amount < 0 THEN '-' ELSE '' END || '{RUPEE}' || {group(long_up("abs(amount)"))} AS shown FROM scaled_prices""",
    "format_pct": f"""
        SELECT l_orderkey, l_linenumber, {pct0("l_discount")} AS discount_0, {pct1("(l_discount - l_tax)")} AS net_1,
          {pct1(f"(l_extendedprice / {d(1000000)})")} AS price_1, {pct0(f"(l_extendedprice / {d(1000000)})")} AS price_0 FROM lineitem""",
    "format_years": f"""
        SELECT l_orderkey, l_linenumber, {years_text("y")} AS shown
        FROM (SELECT *, date_diff('day', DATE '1999-01-01', CAST(l_shipdate AS DATE)) / {d(365)} AS y FROM lineitem)""",
    "plan_insights": """
        SELECT user_id, goal_id, CAST(k AS INTEGER) AS rank, fired[k].tone AS tone, fired[k].code AS code, fired[k].message AS message
        FROM (SELECT *, unnest(range(1, least(4, len(fired)) + 1)) AS k FROM remark_lists)""",
    "plan_summary_json": "SELECT * FROM summaries",
    "chat_message_pages": "SELECT conv_id, page, n_messages, messages_json FROM message_pages",
    "chat_message_batch": """
        SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END AS role, coalesce(text, '') AS content FROM conversations
        UNION ALL
        SELECT c.conv_id, -1, 'system', 'You explain saving plans in rupees, in plain words and with the figures given.' || coalesce(' Plan: ' || plan_json, '')
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN summaries s ON s.user_id = c.conv_id""",
    "chat_turn_filter": f"""
        SELECT conv_id, turn, trim(text, {text(BLANKS)}) AS text FROM conversations WHERE trim(text, {text(BLANKS)}) <> ''""",
    "latest_pool_state": f"SELECT user_id, monthly_sip, current_savings, {r6('inflation', 'inflation')} FROM pool_state",
    "live_holdings_total": f"""
        SELECT user_id, {r6("sum(CASE WHEN action = 'add_holding' AND value > 0 THEN value ELSE 0 END)", "holdings_total", 2)} FROM edits GROUP BY 1""",
}

CTES["scaled_prices"] = f"""
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN -o_totalprice ELSE o_totalprice END
      * CASE o_orderkey % 4 WHEN 0 THEN {d(0.001)} WHEN 1 THEN {d(1)} WHEN 2 THEN {d(100)} ELSE {d(1000)} END AS amount FROM orders"""

CTES["built_goals"] = f"""
    SELECT p.user_id, coalesce(CAST(s.ord AS INTEGER), 0) AS ord, g.goal_id, g.goal_name, {up(f"template_target * mult / {d(1000)}")} * 1000 AS target_today,
      coalesce(CASE WHEN coalesce(s.ord, 0) = 0 THEN CAST(timeline AS DOUBLE) END, template_years) AS horizon_years,
      coalesce(s.ord, 0) = 0 AND timeline IS NOT NULL AS tenure_confirmed, coalesce(s.ord, 0) = 0 AS is_current,
      {SIP} AS monthly_sip, existing_savings AS current_savings, {d(0.06)} AS inflation
    FROM seeded p LEFT JOIN goals s ON s.user_id = p.user_id JOIN d_goals g ON g.goal_id = coalesce(s.goal_id, 'home')
      JOIN d_mult m ON m.mult_tier = coalesce(p.city_tier, 'tier2') AND m.cost_sensitivity = g.cost_sensitivity"""
SQL["build_plan_goals"] = f"""
    SELECT user_id, ord, goal_id, target_today, horizon_years, {preset("horizon_years")} AS profile, tenure_confirmed, is_current FROM built_goals"""

SPLIT_COLUMNS = f", priority, {r6('new_share', 'share')}, {rup('monthly_sip', 'pool')}"
CTES["demo_goals"] = f"""
    SELECT user_id, pos AS ord, goal_id, {up(f"template_target * mult / {d(1000)}")} * 1000 AS target_today,
      CASE WHEN pos = 0 THEN {d(catalog.DEMO_FIRST_HORIZON)} ELSE template_years END AS horizon_years,
      {SIP} AS monthly_sip, existing_savings AS current_savings, {d(0.06)} AS inflation
    FROM profiles p CROSS JOIN ({values(list(enumerate(catalog.DEMO_GOALS)), "pos, goal_id")}) JOIN d_goals g USING (goal_id)
      JOIN d_mult m ON m.mult_tier = coalesce(p.city_tier, 'tier2') AND m.cost_sensitivity = g.cost_sensitivity"""
CTES["onboarded"] = split_and_plan("built_goals")
CTES["demo_plans"] = split_and_plan("demo_goals")
SQL["onboard_population"] = plan_columns("onboarded", SPLIT_COLUMNS)
SQL["demo_plan"] = plan_columns("demo_plans", SPLIT_COLUMNS)
CTES["held_pools"] = f"""
    SELECT p.user_id, monthly_sip, coalesce(t, {d(0)}) AS current_savings, inflation FROM pools p
    LEFT JOIN (SELECT user_id, sum(greatest(amount, 0)) AS t FROM holdings GROUP BY 1) h ON h.user_id = p.user_id"""
CTES["held_inputs"] = CTES["inputs"].replace("goals JOIN pools", "goals JOIN held_pools")
CTES["held_plans"] = planned("(SELECT * FROM held_inputs JOIN preset_facts USING (profile))")
SQL["plan_with_holdings"] = plan_columns("held_plans")
CTES["live_pools"] = f"""
    SELECT c_custkey AS user_id, coalesce(monthly_sip, {d(25000)}) AS monthly_sip, coalesce(current_savings, {d(0)}) AS current_savings,
      coalesce(inflation, {d(0.06)}) AS inflation FROM customer LEFT JOIN pool_state ON user_id = c_custkey"""
CTES["live_inputs"] = CTES["inputs"].replace("goals JOIN pools", "goals JOIN live_pools")
CTES["live_plans"] = planned("(SELECT * FROM live_inputs JOIN preset_facts USING (profile))")
SQL["live_plan"] = plan_columns("live_plans")

ADD = goal_number("user_id * 7 % 10")
CTES["wanted"] = f"""
    SELECT user_id, goal_id, goal_name, {up(f"template_target * mult / {d(1000)}")} * 1000 AS target_today, template_years AS horizon_years
    FROM profiles p JOIN d_goals g ON g.goal_id = {ADD}
      JOIN d_mult m ON m.mult_tier = coalesce(p.city_tier, 'tier2') AND m.cost_sensitivity = g.cost_sensitivity"""
CTES["grown"] = """
    SELECT user_id, goal_id, CAST(ord AS BIGINT) AS ord, FALSE AS is_new, target_today, horizon_years, share FROM goals
    UNION ALL
    SELECT user_id, goal_id, (SELECT count(*) FROM goals g WHERE g.user_id = w.user_id), TRUE, target_today, horizon_years, NULL
    FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM goals g WHERE g.user_id = w.user_id AND g.goal_id = w.goal_id)"""
CTES["grown_order"] = """
    SELECT g.*, CAST(CASE WHEN NOT bool_or(is_new) OVER (PARTITION BY g.user_id) THEN rank WHEN g.user_id % 3 <> 0 THEN row_number() OVER (PARTITION BY g.user_id ORDER BY horizon_years, ord)
        WHEN is_new THEN coalesce(max(rank) OVER (PARTITION BY g.user_id), 0) + 1 ELSE rank END AS INTEGER) AS priority,
      bool_or(is_new) OVER (PARTITION BY g.user_id) AS grew
    FROM grown g LEFT JOIN goal_order o ON o.user_id = g.user_id AND o.goal_id = g.goal_id"""
CTES["grown_need"] = f"""
    SELECT *, {req_sip(f"(target_today * pow({d(1)} + inflation, horizon_years))", d(0), "blended_return", months("horizon_years"))} AS need
    FROM (SELECT *, {preset("horizon_years")} AS profile FROM grown_order) JOIN pools USING (user_id) JOIN preset_facts USING (profile)"""
SQL["goal_set_after_add"] = f"""
    SELECT user_id, goal_id, ord, is_new, goal_id = {ADD} AS is_current, priority, {r6("CASE WHEN grew THEN new_share ELSE share END", "share")}
    FROM ({split("grown_need", "priority")})"""

SQL["goal_set_after_edits"] = f"""
    WITH last AS (SELECT user_id, {goal_number("slot % 10")} AS goal_id,
        last(value ORDER BY ts, seq) FILTER (WHERE action = 'set_savings') AS target,
        last(value ORDER BY ts, seq) FILTER (WHERE action = 'set_weight') AS tenure
      FROM edits GROUP BY 1, 2),
    edited AS (SELECT g.user_id, g.goal_id, ord, CASE WHEN target IS NULL THEN target_today ELSE greatest(0, {up("target")}) END AS target_today,
        CASE WHEN tenure IS NULL THEN horizon_years ELSE greatest(1, {up("tenure / 10")}) END AS horizon_years,
        tenure_confirmed OR tenure IS NOT NULL AS tenure_confirmed, rank, tenure IS NOT NULL AS retimed
      FROM (SELECT g.*, l.target, l.tenure FROM goals g
        LEFT JOIN last l ON l.user_id = g.user_id AND l.goal_id = g.goal_id) g
        LEFT JOIN goal_order o ON o.user_id = g.user_id AND o.goal_id = g.goal_id)
    SELECT user_id, goal_id, target_today, horizon_years, tenure_confirmed, CAST(CASE WHEN user_id % 3 = 0 OR NOT bool_or(retimed) OVER (PARTITION BY user_id)
        THEN row_number() OVER (PARTITION BY user_id ORDER BY rank NULLS LAST, ord)
        ELSE row_number() OVER (PARTITION BY user_id ORDER BY horizon_years, ord) END AS INTEGER) AS priority FROM edited"""

SQL["reorder_priority"] = """
    WITH stated AS (SELECT user_id, goal_id, rank FROM goal_order
        UNION ALL SELECT user_id, goal_id, ord FROM goals WHERE user_id NOT IN (SELECT user_id FROM goal_order)),
      lists AS (SELECT s.user_id, c.goal_id AS g, list(s.goal_id ORDER BY rank) AS l, CASE WHEN s.user_id % 2 = 0 THEN 1 ELSE -1 END AS step
        FROM stated s JOIN goals c ON c.user_id = s.user_id AND c.is_current GROUP BY s.user_id, c.goal_id),
      spots AS (SELECT *, list_position(l, g) AS i, list_position(l, g) + step AS j, list_filter(l, lambda x: x <> l[1]) AS rest FROM lists),
      ops AS (
        SELECT user_id, 'move' AS op, l, CASE WHEN i IS NOT NULL AND i > 0 AND j BETWEEN 1 AND len(l)
          THEN list_transform(range(1, len(l) + 1), lambda k: CASE WHEN k = i THEN l[j] WHEN k = j THEN l[i] ELSE l[k] END) ELSE l END AS moved FROM spots
        UNION ALL
        SELECT user_id, 'drag', l, CASE WHEN i IS NOT NULL AND i > 1
          THEN list_concat(list_concat(rest[1:i - 1], [l[1]]), rest[i:]) ELSE l END FROM spots)
    SELECT user_id, goal_id, op, CAST(list_position(l, goal_id) - 1 AS INTEGER) AS place_before,
      CAST(list_position(moved, goal_id) - 1 AS INTEGER) AS place
    FROM (SELECT *, unnest(l) AS goal_id FROM ops)"""


CTES["preset_lists"] = "SELECT profile, list(fund_id ORDER BY pos) AS funds, list(weight ORDER BY pos) AS weights FROM d_presets GROUP BY profile"
SQL["replay_edits"] = f"""
    WITH RECURSIVE ops AS (SELECT user_id, slot % 5 + 1 AS i, least(100, greatest(0, value)) AS w,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, seq) AS k FROM edits WHERE action = 'set_weight'),
      walk AS (SELECT c_custkey AS user_id, funds, weights AS x, 0 AS k
        FROM customer JOIN preset_lists ON profile = {numbered("c_custkey % 3", q.PRESET_NAMES)}
        UNION ALL
        SELECT s.user_id, funds, list_transform(range(1, 6), lambda j: CASE WHEN j = i THEN w
            WHEN list_sum(x) - x[i] > 0 THEN x[j] / (list_sum(list_concat(x[1:i - 1], x[i + 1:]))) * (100 - w) ELSE (100 - w) / 4 END), s.k + 1
        FROM walk s JOIN ops o ON o.user_id = s.user_id AND o.k = s.k + 1),
      final AS (SELECT user_id, arg_max(funds, k) AS funds, arg_max(x, k) AS x FROM walk GROUP BY user_id)
    SELECT user_id, fund_id, {r6("weight", "weight")} FROM (SELECT user_id, unnest(funds) AS fund_id, unnest(x) AS weight FROM final)"""
PRESET_ROWS = ", ".join(
    f"({k}, [{', '.join('NULL' if f not in held else d(held[f]) for f in FUND_IDS)}])"
    for k, held in enumerate(dict(catalog.PRESETS[p]) for p in q.PRESET_NAMES)
)
CTES["preset_weights"] = f"SELECT * FROM (VALUES {PRESET_ROWS}) AS t(preset_no, given)"


def over_all(part: str) -> str:
    return f"list_transform(range(1, 13), lambda j: {part})"


SQL["replay_basket_log"] = f"""
    WITH RECURSIVE ops AS (SELECT user_id, action, slot % 12 + 1 AS i, value, given, row_number() OVER (PARTITION BY user_id ORDER BY ts, seq) AS k
        FROM basket_edits LEFT JOIN preset_weights ON preset_no = slot % 3
        WHERE slot IS NOT NULL AND action IS NOT NULL),
      walk AS (SELECT c_custkey AS user_id, given AS x, 0 AS k FROM customer JOIN preset_weights ON preset_no = c_custkey % 3
        UNION ALL
        SELECT user_id, CASE
            WHEN action = 'apply_preset' THEN given
            WHEN action = 'add_fund' AND x[i] IS NULL THEN CASE WHEN n = 0 THEN {over_all(f"CASE WHEN j = i THEN {d(100)} END")}
              ELSE {over_all(f"CASE WHEN j = i THEN {d(100)} / (n + 1) WHEN total > 0 THEN x[j] / total * (100 - {d(100)} / (n + 1)) ELSE x[j] - x[j] + (100 - {d(100)} / (n + 1)) / n END")} END
            WHEN action = 'remove_fund' AND x[i] IS NOT NULL THEN {over_all("CASE WHEN j <> i AND others > 0 THEN x[j] / others * 100 END")}
            WHEN action = 'set_weight' AND x[i] IS NOT NULL THEN CASE WHEN n = 1 THEN {over_all(f"CASE WHEN j = i THEN {d(100)} END")}
              ELSE {over_all("CASE WHEN j = i THEN w WHEN others > 0 THEN x[j] / others * (100 - w) ELSE x[j] - x[j] + (100 - w) / (n - 1) END")} END
            ELSE x END, k
        FROM (SELECT s.user_id, s.x, o.k, o.i, o.action, o.given, least({d(100)}, greatest({d(0)}, o.value)) AS w, list_count(s.x) AS n,
            coalesce(list_sum(s.x), 0) AS total, coalesce(list_sum(list_transform(range(1, 13), lambda j: CASE WHEN j <> o.i THEN s.x[j] END)), 0) AS others
          FROM walk s JOIN ops o ON o.user_id = s.user_id AND o.k = s.k + 1)),
      final AS (SELECT user_id, arg_max(x, k) AS x FROM walk GROUP BY user_id)
    SELECT user_id, {numbered("j - 1", FUND_IDS)} AS fund_id, {r6("x[j]", "weight")} FROM (SELECT user_id, x, unnest(range(1, 13)) AS j FROM final)
    WHERE x[j] IS NOT NULL"""
CTES["share_lists"] = """
    SELECT user_id, list(goal_id ORDER BY ord) AS ids, list(coalesce(share, CAST(0 AS DOUBLE)) ORDER BY ord) AS x FROM goals GROUP BY user_id"""
SQL["replay_goal_amounts"] = f"""
    WITH RECURSIVE ops AS (SELECT e.user_id, slot % len(ids) + 1 AS i, least(100, greatest(0, value / monthly_sip * 100)) AS w,
        row_number() OVER (PARTITION BY e.user_id ORDER BY ts, seq) AS k
        FROM edits e JOIN pools p ON p.user_id = e.user_id AND monthly_sip > 0 JOIN share_lists l ON l.user_id = e.user_id
        WHERE action = 'set_sip'),
      walk AS (SELECT user_id, ids, x, 0 AS k FROM share_lists
        UNION ALL
        SELECT s.user_id, ids, CASE WHEN len(x) = 1 THEN [{d(100)}] ELSE list_transform(range(1, len(x) + 1), lambda j: CASE WHEN j = i THEN w
            WHEN list_sum(x) - x[i] > 0 AND list_sum(list_concat(x[1:i - 1], x[i + 1:])) > 0
              THEN x[j] / (list_sum(list_concat(x[1:i - 1], x[i + 1:]))) * (100 - w)
            ELSE (100 - w) / (len(x) - 1) END) END, s.k + 1
        FROM walk s JOIN ops o ON o.user_id = s.user_id AND o.k = s.k + 1),
      final AS (SELECT user_id, arg_max(ids, k) AS ids, arg_max(x, k) AS x FROM walk GROUP BY user_id)
    SELECT user_id, goal_id, {r6("share", "share")} FROM (SELECT user_id, unnest(ids) AS goal_id, unnest(x) AS share FROM final)"""
SQL["replay_goal_toggles"] = f"""
    WITH RECURSIVE ops AS (SELECT user_id, {goal_number("slot % 10")} AS g,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, seq) AS k FROM edits),
      walk AS (SELECT DISTINCT user_id, CAST([] AS VARCHAR[]) AS picks, 0 AS k FROM edits
        UNION ALL
        SELECT s.user_id, CASE WHEN list_contains(picks, g) THEN list_filter(picks, lambda p: p <> g)
            WHEN len(picks) < 3 THEN list_append(picks, g) ELSE picks END, s.k + 1
        FROM walk s JOIN ops o ON o.user_id = s.user_id AND o.k = s.k + 1),
      final AS (SELECT user_id, arg_max(picks, k) AS picks FROM walk GROUP BY user_id)
    SELECT user_id, picks[n] AS goal_id, CAST(n AS INTEGER) AS place
    FROM (SELECT user_id, picks, unnest(range(1, len(picks) + 1)) AS n FROM final)"""


def _rate_sql(flows: str, key: str, solvable: str, keys: str) -> str:
    return f"WITH {rate_query(flows, key)} SELECT {keys}, {r6('coalesce(rate, 0)', 'xirr')} FROM {solvable}"


SQL["xirr"] = _rate_sql(
    f"""SELECT entity_id, list({{'t': date_diff('day', origin, flow_date) / {d(365)}, 'a': amount}} ORDER BY flow_date, seq) AS flows
        FROM (SELECT *, min(flow_date) OVER (PARTITION BY entity_id) AS origin FROM flows) GROUP BY 1
        HAVING count(*) >= 2 AND max(amount) > 0 AND min(amount) < 0""",
    "entity_id",
    "(SELECT DISTINCT entity_id FROM flows) LEFT JOIN found USING (entity_id)",
    "entity_id",
)
SQL["plan_xirr"] = _rate_sql(
    f"""SELECT user_id * 100 + ord AS k, list_transform(range(0, months + 1), lambda m: {{
          't': date_diff('day', DATE '2025-01-01', CAST(DATE '2025-01-01' + to_months(CAST(m AS INTEGER)) AS DATE)) / {d(365)},
          'a': CASE WHEN m = months THEN projected_corpus WHEN m = 0 THEN -(savings + sip) ELSE -sip END}}) AS flows
        FROM plans WHERE projected_corpus > 0 AND savings + sip > 0""",
    "k",
    "plans LEFT JOIN found ON k = user_id * 100 + ord",
    "user_id, goal_id",
)


def _with_tables(body: str) -> str:
    """Put the shared tables a query names in front of it, those they name first."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name, cte in CTES.items():
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql):
                visit(cte)
                if name not in needed:
                    needed.append(name)

    visit(body)
    parts = [f"{name} AS ({CTES[name]})" for name in needed]
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body)
    recursive = "RECURSIVE " if own and own.group(1) else ""
    rest = body[own.end():] if own else body
    return f"WITH {recursive}{', '.join(parts)}{', ' if own and parts else ' '}{rest}" if parts else body


def oracle_sql() -> dict[str, str]:
    return {name: _with_tables(SQL[name]) for name in q.QUERIES if name in SQL}
