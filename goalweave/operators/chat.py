"""Plan summaries as JSON and message lists for a batch of conversations.

Messages stay one row each, ordered by (conv_id, turn): a conversation may be of any length, so it is never gathered
into one array. What a model is sent is cut from them in *pages*: arrays of messages of a fixed number of turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.num import half_up, half_up_long, is_finite, lit
from ..functions.text import strip_blanks

SYSTEM_TURN = -1
PAGE_TURNS = 50
PROMPT = "You explain saving plans in rupees, in plain words and with the figures given."

# Field names of the plan summary, in order.
SUMMARY_FIELDS = [
    "goal", "targetTodayINR", "horizonYears", "monthlySipINR", "monthlyPoolINR", "currentSavingsINR", "inflationPct",
    "projectedCorpusINR", "requiredCorpusINR", "gapINR", "onTrack", "expectedReturnPct", "allocationPct", "otherGoals",
]


def number_text(x: Column) -> Column:
    """A double as JSON shows it: the fewest digits that give it back, plain from 1e-6 up to 1e21, beyond with an exponent.

    Sign, digits and exponent of Spark's text of the double (1.0E-5, 1.2345E7) are taken apart and laid out as text, so no
    digit is lost on the way. That text sometimes has more digits than it takes; they are then rounded as far as the shorter
    text still is the same double. Null where x is null or no finite number.
    """
    text = F.abs(x).cast("string")
    mantissa, power = F.substring_index(text, "E", 1), F.regexp_extract(text, "E(.+)$", 1)
    part = F.substring_index(mantissa, ".", -1)
    number = F.concat(F.substring_index(mantissa, ".", 1), part).try_cast("bigint")
    exponent = F.when(power == "", 0).otherwise(power.try_cast("int")) - F.length(part)
    tens = F.array(*[F.lit(10**k) for k in range(18)])

    # Try j stands for j / 2 digits less; odd ones round, even ones cut (the last digit may itself be rounded up).
    def places(j: Column) -> Column:
        return F.shiftright(j, 1)

    def tried(n: Column, j: Column) -> Column:
        ten = F.get(tens, places(j))
        half = F.when(j % 2 == 1, F.call_function("div", ten, F.lit(2))).otherwise(0)
        return F.call_function("div", n["number"] + half, ten)

    def same(n: Column, j: Column) -> Column:
        return F.concat(tried(n, j).cast("string"), F.lit("E"), (n["exponent"] + places(j)).cast("string")).try_cast("double") == F.abs(x)

    def shortest(n: Column) -> Column:
        tries = F.sequence(F.lit(0), 2 * F.length(n["number"].cast("string")) - 1)
        return F.array_max(F.filter(tries, lambda j: same(n, j)))

    def shown(n: Column, j: Column) -> Column:
        digits = tried(n, j).cast("string")
        sign = F.when(x < 0, "-").otherwise("")
        return F.concat(sign, _laid_out(F.rtrim(digits, F.lit("0")), F.length(digits) + n["exponent"] + places(j)))

    taken = F.array(F.struct(number.alias("number"), exponent.alias("exponent")))
    found = F.transform(taken, lambda n: F.transform(F.array(shortest(n)), lambda j: shown(n, j))[0])[0]
    return F.when(~is_finite(x), F.lit(None)).when(x == 0, F.lit("0")).otherwise(found)


def _laid_out(digits: Column, point: Column) -> Column:
    """Digits without zeros at either end, with the point before the ``point``-th of them."""
    n = F.length(digits)
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)
    within = F.concat(F.left(digits, point), F.lit("."), F.substr(digits, point + 1))
    large = F.concat(digits, F.repeat(F.lit("0"), point - n))
    tail = F.when(n > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise("")
    raised = F.concat(F.left(digits, F.lit(1)), tail, F.when(point > 0, "e+").otherwise("e"), (point - 1).cast("string"))
    return F.when((point > 21) | (point < -5), raised).when(point <= 0, small).when(point >= n, large).otherwise(within)


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    wrapped = F.to_json(F.struct(text.alias("v")))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substring(wrapped, F.lit(6), F.length(wrapped) - 6))


def preset_entries(presets: DataFrame, funds: DataFrame) -> DataFrame:
    """Each preset's funds and weights as the inside of one JSON object, in order; five entries each."""
    named = presets.join(F.broadcast(funds.select("fund_id", "fund_name")), "fund_id", "left")
    text = F.concat(quoted(F.coalesce("fund_name", "fund_id")), F.lit(":"), number_text(F.col("weight")))
    entries = named.select("profile", F.struct("pos", text.alias("text")).alias("entry")).groupBy("profile")
    listed = entries.agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    return listed.select("profile", F.array_join("entries.text", ",").alias("entries"))


def plan_summary_json(plans: DataFrame) -> DataFrame:
    """JSON of each user's current goal; needs plan results, entries and the user's other goal names."""

    def whole(x: Column) -> Column:
        return half_up_long(x).cast("string")

    # All numbers in one array, so that their layout is one expression and not one for each.
    percent = half_up(F.col("blended_return") * lit(1000)) / lit(10)
    numbers = F.array("target_today", "horizon_years", "monthly_sip", percent)
    plans = plans.withColumn("number_texts", F.transform(numbers, number_text))
    target, horizon, pool, expected = (F.get("number_texts", F.lit(k)) for k in range(4))
    values = [
        quoted(F.col("goal_name")),
        target,
        horizon,
        whole(F.col("sip")),
        pool,
        whole(F.col("savings")),
        whole(F.col("inflation") * lit(100)),
        whole(F.col("projected_corpus")),
        whole(F.col("required_corpus")),
        whole(F.col("gap")),
        F.col("on_track").cast("string"),
        expected,
        F.concat(F.lit("{"), "entries", F.lit("}")),
        F.to_json("other_goals"),
    ]
    fields = [F.concat(F.lit(f'"{name}":'), F.coalesce(value, F.lit("null"))) for name, value in zip(SUMMARY_FIELDS, values)]
    text = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    return plans.select("user_id", text.alias("plan_json"))


def message_role(role: Column) -> Column:
    return F.when(role == "ai", "assistant").otherwise("user")


def chat_messages(chat: DataFrame, summaries: DataFrame) -> DataFrame:
    """Messages of each conversation, a system message with the plan first; (conv_id, turn) gives the order."""
    turns = chat.select(
        "conv_id", "turn", message_role(F.col("role")).alias("role"), F.coalesce("text", F.lit("")).alias("content")
    )
    plan = F.concat(F.lit(PROMPT), F.coalesce(F.concat(F.lit(" Plan: "), "plan_json"), F.lit("")))
    openers = (
        chat.select("conv_id")
        .distinct()
        .join(summaries.withColumnRenamed("user_id", "conv_id"), "conv_id", "left")
        .select("conv_id", F.lit(SYSTEM_TURN).cast("bigint").alias("turn"), F.lit("system").alias("role"), plan.alias("content"))
    )
    return turns.unionByName(openers)


def message_pages(messages: DataFrame, turns: int = PAGE_TURNS) -> DataFrame:
    """(conv_id, page, messages): ordered arrays of {role, content}, the system message first on page 0.

    Turns 0 to ``turns - 1`` make page 0, and so on, so a page's size is bounded by the number of a conversation's turns
    it covers, however long the conversation is, and a long one is gathered by many tasks.
    """
    page = F.floor(F.greatest(F.col("turn"), F.lit(0)) / turns).cast("bigint").alias("page")
    # Ties of a turn, should there be any, go by role and content.
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "content")))
    paged = messages.groupBy("conv_id", page).agg(rows.alias("rows"))
    return paged.select("conv_id", "page", F.transform("rows", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def pages_as_json(pages: DataFrame) -> DataFrame:
    """Each page's messages as the JSON text a request carries."""
    entry = F.transform("messages", lambda m: F.concat(F.lit('{"role":'), quoted(m["role"]), F.lit(',"content":'), quoted(m["content"]), F.lit("}")))
    text = F.concat(F.lit("["), F.array_join(entry, ","), F.lit("]"))
    return pages.select("conv_id", "page", F.size("messages").alias("n_messages"), text.alias("messages_json"))


def chat_turns(chat: DataFrame) -> DataFrame:
    """Turns with something in them, blanks at both ends removed."""
    return chat.withColumn("text", strip_blanks(F.col("text"))).where(F.col("text") != "")


def current_with_others(goals: DataFrame) -> DataFrame:
    """Each user's current goal with the names of the user's other goals in declared order.

    A user has at most ten goals, one per catalogue entry.
    """
    user = W.partitionBy("user_id")
    named = F.array_sort(F.collect_list(F.struct("ord", "goal_id", "goal_name")).over(user))
    others = F.filter(named, lambda g: g["goal_id"] != F.col("goal_id"))
    return goals.withColumn("other_goals", F.transform(others, lambda g: g["goal_name"])).where("is_current")
