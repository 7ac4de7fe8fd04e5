"""URL filter: host rules, then a ratio of character language models.

Rules of host and path decide where one fits. All other URLs go to two Markov models of
variable order, one of accepted and one of rejected URLs, both learned from the URLs that rules
decide. Their log-likelihood difference, divided by the length, is compared with a cut that is
calibrated on URLs kept out of the counts.

Models are tables of grams of the URLs' own characters, in any script (A-Z lower-cased), which grow
with the URLs. A level holds the grams of one length, and leans on the level below by a join on
the shorter gram, of which as many grams end alike as there are characters. Log ratios are
joined to the grams of each distinct address; the table is broadcast while it is
counted to be small, beyond that grams with very many rows are split. An address repeats in
any number of pages and is scored once.

Defined cases: a null URL and one without `://` have empty host and path; an empty host fits no
rule and its text is scored like any other (only an end mark); repeated rows get
one verdict; characters that no decided URL holds are as likely in both models; other columns are
not looked at, whatever their names; without URLs of both kinds the difference is 0 and the cut 0, so the verdict is allow;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from musterline.llm.common import kept, lower_ascii
from musterline.operators.skew import add_split, copy_per_split, hot_keys

# The rules as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# Marks of start and end, which no URL holds.
START, END = "\x02", "\x03"
ORDER = 3
# Grams whose log ratios may be broadcast: at most about 100 bytes each.
BROADCAST_GRAMS = 500_000
# A gram or an address with more rows than this (and a ten-thousandth of all) is split.
SPLIT_ROWS = 100_000
# Weight of the shorter context in each smoothing step.
BELIEF = 2.0
# Addresses whose md5 starts below this digit are kept for the calibration (3 of 16).
HELD_BELOW = "3"
# Log ratios are whole numbers of 1e-9, so that sums do not depend on their order.
UNIT = 1e9
STEP, MOST_STEPS = 0.01, 1000


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without `://`."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = lower_ascii(F.regexp_extract(rest, "^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def ruled(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule and what the rule says; the longest fitting rule wins."""
    host, path = parts(F.col("url"))
    named = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, says = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, own, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = ((F.col("host") == own) | F.col("host").endswith(f".{own}")) & F.col(
            "path"
        ).startswith(start)
        rule = F.when(fits, own + start).otherwise(rule)
        says = F.when(fits, verdict).otherwise(says)
    return named.select("*", rule.alias("rule"), says.alias("says"))


def with_grams(frame: DataFrame) -> DataFrame:
    """One row per gram: the character and the three before it."""
    framed = F.concat(F.lit(START * ORDER), F.col("symbols"), F.lit(END))
    # By code points: a split would tear those beyond the basic plane.
    cut = frame.withColumn("__chars", F.regexp_extract_all(framed, F.lit("(?s)."), F.lit(0)))
    grams = F.transform(
        F.slice("__chars", 1, F.size("__chars") - ORDER),
        lambda c, i: F.concat(c, *[F.get("__chars", i + k) for k in range(1, ORDER + 1)]),
    )
    return cut.withColumn("gram", F.explode(grams)).drop("__chars")


def log_ratios(grams: DataFrame) -> DataFrame:
    """(gram, ratio): log of the accepted over the rejected model's probability, in 1e-9.

    `grams` has each gram once, with its `allow` and `block` counts. Every order's probability
    leans on that of the next shorter context, the lowest on an even one.
    """
    figures = grams.agg(
        F.count_distinct(F.substring("gram", ORDER + 1, 1)).alias("alphabet"),
        F.sum("allow").alias("allow"),
        F.sum("block").alias("block"),
    ).first()
    lower = None
    for order in range(ORDER + 1):
        suffix = F.substring("gram", ORDER + 1 - order, order + 1)
        level = grams.groupBy(suffix.alias("suffix")).agg(
            F.sum("allow").alias("n_allow"), F.sum("block").alias("n_block")
        )
        if lower is None:
            even = F.lit(1.0) / F.lit(float(figures["alphabet"] or 1))
            level = level.withColumns(
                {f"p_{k}": even for k in ("allow", "block")}
                | {f"c_{k}": F.lit(figures[k] or 0) for k in ("allow", "block")}
            )
        else:
            context = F.substring("gram", ORDER + 1 - order, order)
            before = grams.groupBy(context.alias("context")).agg(
                F.sum("allow").alias("c_allow"), F.sum("block").alias("c_block")
            )
            shorter = lower.withColumnRenamed("suffix", "shorter")
            level = (
                level.withColumns(
                    {"shorter": F.expr("substring(suffix, 2)"), "context": F.substring("suffix", 1, order)}
                )
                .join(shorter, "shorter")
                .join(before, "context")
            )
        chances = {
            f"p_{k}": (F.col(f"n_{k}") + BELIEF * F.col(f"p_{k}")) / (F.col(f"c_{k}") + BELIEF)
            for k in ("allow", "block")
        }
        lower = level.withColumns(chances).select("suffix", *chances)
    ratio = F.round((F.log("p_allow") - F.log("p_block")) * UNIT).cast("long")
    return lower.select(F.col("suffix").alias("gram"), ratio.alias("ratio"))


def scores(addresses: DataFrame) -> DataFrame:
    """Adds `score` to distinct addresses (symbols, and what rules say of how many of them).

    `addresses` has symbols, allow and block: counts of rows for the models.
    """
    grams = with_grams(addresses.select("symbols", "allow", "block"))
    counts = kept(
        grams.groupBy("gram").agg(
            F.sum("allow").alias("allow"), F.sum("block").alias("block"), F.count("*").alias("rows")
        )
    )
    ratios = kept(log_ratios(counts))
    own = with_grams(addresses.select("symbols"))
    if ratios.count() <= BROADCAST_GRAMS:
        found = own.join(F.broadcast(ratios), "gram").withColumn("n", F.lit(1))
    else:
        # An address's equal grams travel as one row.
        own = own.groupBy("symbols", "gram").agg(F.count("*").alias("n"))
        hot = hot_keys(counts, ["gram"], "rows", SPLIT_ROWS)
        found = add_split(own, hot, ["gram"], "symbols").join(
            copy_per_split(ratios, hot, ["gram"]), ["gram", "split"]
        )
    total = F.sum(F.col("ratio") * F.col("n")) / F.sum("n") / UNIT
    return found.groupBy("symbols").agg(total.alias("score"))


def cut_of(steps: list[tuple[int, int, int]]) -> float:
    """The cut with the least sum of both error rates, then nearest 0, then the smaller.

    `steps` has (step, accepted, rejected) counts of calibration scores.
    """
    allow, block = sum(s[1] for s in steps), sum(s[2] for s in steps)
    if not allow or not block:
        return 0.0
    best = None
    places = sorted({s[0] for s in steps} | {0, MOST_STEPS + 1})
    for place in places:
        missed = sum(s[1] for s in steps if s[0] < place)
        let_in = sum(s[2] for s in steps if s[0] >= place)
        # Whole numbers, so that ties are ties.
        error = missed * block + let_in * allow
        key = (error, abs(place), place)
        if best is None or key < best:
            best = key
    return best[2] * STEP


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score (null where a rule decides)."""
    named = kept(
        ruled(pages, rules)
        .withColumn("symbols", lower_ascii(F.concat("host", "path")))
        # The fold goes by address, so copies of one are never on both sides.
        .withColumn("held", F.substring(F.md5("symbols"), 1, 1) < HELD_BELOW)
    )

    def rows(verdict: str, held: bool) -> Column:
        says = F.coalesce(F.col("says"), F.lit("")) == verdict
        return F.count_if(says & (F.col("held") == held))

    addresses = kept(
        named.groupBy("symbols").agg(
            rows("allow", False).alias("allow"),
            rows("block", False).alias("block"),
            rows("allow", True).alias("held_allow"),
            rows("block", True).alias("held_block"),
            F.count("*").alias("pages"),
        )
    )
    scored = kept(addresses.join(scores(addresses), "symbols"))
    # Steps lie between fixed ends, so the histogram has a fixed bound.
    step = F.least(F.greatest(F.floor(F.col("score") / STEP), F.lit(-MOST_STEPS)), F.lit(MOST_STEPS))
    steps = (
        scored.where("held_allow + held_block > 0")
        .groupBy(step.cast("long").alias("step"))
        .agg(F.sum("held_allow").alias("allow"), F.sum("held_block").alias("block"))
        .collect()
    )
    cut = cut_of([(r["step"], r["allow"], r["block"]) for r in steps])
    own = F.when(F.col("score") >= cut, "allow").otherwise("block")
    # One address, such as the empty one, may be that of very many pages.
    hot = hot_keys(addresses, ["symbols"], "pages", SPLIT_ROWS)
    single = copy_per_split(scored.select("symbols", "score"), hot, ["symbols"])
    return add_split(named, hot, ["symbols"], "page_id").join(single, ["symbols", "split"]).select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("says", own).alias("verdict"),
        F.when(F.col("says").isNull(), F.col("score")).alias("score"),
    )
