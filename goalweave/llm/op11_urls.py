"""URL filter: allow and block rules first, then a logistic regression on hashed character n-grams of host and path.

1. A url's host lies between its first ``://`` and the next ``/``, ``?``, ``#`` or the end, A to Z in lower case; its path
   runs from there to the next ``?``, ``#`` or the end. Without ``://`` both are empty. Port and user stay in the host.
2. A rule fits its host and all subdomains, where the url's path starts with the rule's path. The longest fitting rule
   (of equal ones the one with the longest host) decides. Rules are one CASE expression over at most ``MOST_RULES``.
3. Everything else is judged by the model. Grams of 3 to 5 characters of the host and of the path, with marked ends, are
   hashed into ``BUCKETS`` numbers, each run of digits in a path as one 0; host and path each weigh 1 in all (a gram's value
   is one over the root of their count), so that a long path does not drown its host. The model is fitted to a labelled
   table by quasi-Newton steps, each of which is one grouped sum over the table, of no more rows than there are buckets.
   The weights become one constant array in the plan, so that pages are judged where they are read: no join, no shuffle.

Only DataFrame operations. The labelled table is bounded: of more than ``TRAIN_ROWS`` urls those with the smallest hash
count. Null urls, urls without ``://`` and empty ones have host and path ''; no rule with a path fits them and there is
nothing for the model to see: no chance, allowed. Very long urls are read as a whole, in time linear in their length. Repeated rows and
repeated page_ids give a row each; a null page_id stays null. Other columns are ignored; an empty table gives no rows. In the
labelled table, rows without url or label are skipped and repeated ones count again; without both labels the model has no say and
everything without a rule is allowed.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ALLOW, BLOCK = "allow", "block"
#: (verdict, host, path)
Rule = tuple[str, str, str]

GRAMS = (3, 4, 5)
BUCKETS = 1 << 13
#: Bound of the labelled sample.
TRAIN_ROWS = 20_000
MOST_RULES = 500
RIDGE = 1e-3
#: Descent ends at this length of the gradient; it keeps so many of its last changes.
TOLERANCE, MOST_STEPS, MEMORY = 2e-4, 200, 10
BLOCK_AT = 0.5

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The small labelled table: words that unwanted and ordinary sites put in their names, each under a few addresses.
UNWANTED = (
    "casino casinos online-casino poker-win jackpot-win slots winbig bets best-bets sports-bets betting freebet "
    "pills cheap-meds buy-pills pharmacy-cheap viagra xanax-online diet-pills "
    "adult adult-video sexcam porn xxx-tube hot-girls escort "
    "spam spam-links linkfarm link-farm seo-farm content-farm "
    "ads adserver ad-track tracker click-track popunder banner-ads "
    "cheap-loans payday-cash free-money cheap-replica free-download-crack warez torrent-free keygen get-rich win-prize"
).split()
ORDINARY = (
    "news daily-news weather library museum university school hospital city-council government science physics history "
    "garden kitchen recipes cooking travel railway airport music orchestra theatre cinema books reading writer journal "
    "football tennis cycling health clinic dentist energy solar water forest nature birds animals family children "
    "software code docs developer data maps photos design painting gallery market bakery coffee restaurant hotel "
    "city-station world-nation father mother another-day the-north big-stories small-ships shared-things wheels thanks round-table"
).split()
#: Each word stands under these; {} is the word.
ADDRESSES = (
    "https://{}.example.com/en/12",
    "http://www.{}.example.net/de/4821/",
    "https://m.{}.example.org/fr/77.html",
    "https://blog.{}.example.org/es/903",
    "https://{}.org/",
    "http://www.{}.co.uk/page/5?x=1",
)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, blocked): the table above."""
    rows = [{"url": a.format(w), "blocked": b} for words, b in ((UNWANTED, 1), (ORDINARY, 0)) for w in words for a in ADDRESSES]
    table = F.from_json(F.lit(json.dumps(rows)), "array<struct<url: string, blocked: int>>")
    return spark.range(1).select(F.inline(table))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, CAPITALS, SMALL), F.lit("")), F.coalesce(path, F.lit(""))


def rule_name(rule: Rule) -> str:
    return rule[1] + rule[2]


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the rule that decides, null without one."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules; a longer list belongs in a table")
    ordered = sorted({rule_name(r): r for r in rules}.values(), key=lambda r: (-len(rule_name(r)), -len(r[1])))
    names, verdicts = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in reversed(ordered):
        fits = ((host == rule[1]) | F.endswith(host, F.lit("." + rule[1]))) & F.startswith(path, F.lit(rule[2]))
        names = F.when(fits, F.lit(rule_name(rule))).otherwise(names)
        verdicts = F.when(fits, F.lit(rule[0])).otherwise(verdicts)
    return names, verdicts


def buckets(text: Column, mark: str) -> Column:
    """Bucket of every gram of a text; a look-ahead finds overlapping ones in one scan."""
    ended = F.concat(F.lit("^"), text, F.lit("$"))
    grams = F.concat(*[F.regexp_extract_all(ended, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in GRAMS])
    return F.transform(grams, lambda g: F.pmod(F.xxhash64(F.concat(F.lit(mark), g)), F.lit(BUCKETS)).cast("int"))


def with_features(rows: DataFrame) -> DataFrame:
    path = F.regexp_replace("path", "[0-9]+", "0")
    return rows.withColumn("host_grams", buckets(F.col("host"), "h")).withColumn("path_grams", buckets(path, "p"))


def logit(weights: list[float]) -> Column:
    """The model's value for rows with features; the last weight is the constant."""
    text = ",".join(map(repr, weights[:-1]))
    table = F.split(F.lit(text), ",").cast("array<double>")

    def part(name: str) -> Column:
        total = F.aggregate(name, F.lit(0.0), lambda acc, j: acc + F.get(table, j))
        return total / F.sqrt(F.greatest(F.size(name), F.lit(1)))

    return part("host_grams") + part("path_grams") + F.lit(weights[-1])


def chance(value: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), value))))


def _loss(rows: DataFrame, weights: list[float], n: int) -> tuple[float, list[float]]:
    """Mean loss with the ridge, and its gradient: one grouped sum of at most BUCKETS + 2 rows."""
    p, bad = F.col("p"), F.col("blocked")
    off = rows.withColumn("p", chance(logit(weights))).withColumn("off", (p - bad) / n)

    def scaled(name: str) -> Column:
        value = F.col("off") / F.sqrt(F.greatest(F.size(name), F.lit(1)))
        return F.transform(name, lambda j: F.struct(j.alias("j"), value.alias("g")))

    loss = -F.ln(F.when(bad == 1, p).otherwise(1 - p)) / n
    own = F.array(F.struct(F.lit(BUCKETS).alias("j"), F.col("off").alias("g")), F.struct(F.lit(BUCKETS + 1).alias("j"), loss.alias("g")))
    sums = off.select(F.inline(F.concat(scaled("host_grams"), scaled("path_grams"), own))).groupBy("j").agg(F.sum("g").alias("g"))
    gradient = [RIDGE * w for w in weights[:-1]] + [0.0, RIDGE / 2 * _dot(weights[:-1], weights[:-1])]
    for row in sums.collect():
        gradient[row["j"]] += row["g"]
    return gradient.pop(), gradient


def _dot(a: list[float], b: list[float]) -> float:
    return sum(x * y for x, y in zip(a, b))


def _direction(gradient: list[float], memory: list[tuple[list[float], list[float]]]) -> list[float]:
    """Quasi-Newton step (limited-memory BFGS) from the last few changes of weights and gradient."""
    q, past = [-g for g in gradient], []
    for s, y in reversed(memory):
        a = _dot(s, q) / _dot(s, y)
        past.append(a)
        q = [v - a * w for v, w in zip(q, y)]
    if memory:
        s, y = memory[-1]
        scale = _dot(s, y) / _dot(y, y)
        q = [v * scale for v in q]
    for (s, y), a in zip(memory, reversed(past)):
        b = _dot(y, q) / _dot(s, y)
        q = [v + (a - b) * w for v, w in zip(q, s)]
    return q


def trained(scratch: common.Scratch, labelled: DataFrame) -> list[float] | None:
    """Weights of all buckets and the constant; None without urls of both kinds."""
    host, path = host_and_path(F.col("url"))
    known = labelled.where("url is not null and blocked is not null").select("url", F.col("blocked").cast("int").alias("blocked"))
    sample = known.orderBy(F.xxhash64("url"), "url", "blocked").limit(TRAIN_ROWS)
    rows = with_features(sample.select("blocked", host.alias("host"), path.alias("path")))
    rows = scratch.write(rows.select("blocked", "host_grams", "path_grams"), "labelled", 64)
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("blocked").alias("bad")).first()
    n = counts["n"]
    if not n or counts["bad"] in (0, n):
        return None
    weights, memory = [0.0] * (BUCKETS + 1), []
    loss, gradient = _loss(rows, weights, n)
    for _ in range(MOST_STEPS):
        if math.hypot(*gradient) < TOLERANCE:
            return [round(w, 9) for w in weights]
        step, size = _direction(gradient, memory), 1.0
        slope = _dot(step, gradient)
        while True:
            following = [w + size * s for w, s in zip(weights, step)]
            new_loss, new_gradient = _loss(rows, following, n)
            if new_loss <= loss + 1e-4 * size * slope or size < 1e-6:
                break
            size /= 2
        change = [a - b for a, b in zip(following, weights)], [a - b for a, b in zip(new_gradient, gradient)]
        memory = [*memory, change][-MEMORY:] if _dot(*change) > 0 else []
        weights, loss, gradient = following, new_loss, new_gradient
    raise RuntimeError(f"the model did not settle in {MOST_STEPS} steps")


def judged(pages: DataFrame, rules: Sequence[Rule], labelled: DataFrame | None = None) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict and chance (the model's, that the url is unwanted)."""
    spark = pages.sparkSession
    labelled = labelled_urls(spark) if labelled is None else labelled
    weights = trained(common.Scratch(spark, "urls"), labelled)
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    if weights is None:
        rows = rows.withColumn("chance", F.lit(None).cast("double"))
    else:
        something = (F.col("host") != "") | (F.col("path") != "")
        rows = with_features(rows).withColumn("chance", F.when(something, chance(logit(weights))))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("chance") >= BLOCK_AT, BLOCK).otherwise(ALLOW)
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "chance")


def kept_pages(pages: DataFrame, rules: Sequence[Rule], labelled: DataFrame | None = None) -> DataFrame:
    """``pages`` that are allowed, all columns as they are. Rows without page_id stay as if allowed; of repeated ids the first verdict by name counts."""
    decided = judged(pages, rules, labelled).groupBy("page_id").agg(F.min("verdict").alias("verdict"))
    return pages.join(decided.where(F.col("verdict") == BLOCK).select("page_id").hint("merge"), "page_id", "left_anti")
