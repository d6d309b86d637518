"""URL filter: host and path rules first, a character language-model ratio for the rest.

Two variable-order Markov models, one of accepted and one of rejected addresses, give every character a probability after its
longest known context, smoothed with shorter ones (Witten-Bell). The verdict follows the mean log-likelihood difference per
character against a threshold that was calibrated on addresses kept out of the models.

The models are tables: all rule-decided addresses are counted in Spark but those held out by their hash. Probabilities are worked out from
shorter to longer contexts, once for each run of six characters that an address to be scored has.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.shared import hot_keys, salted_join, staged

#: Longest context.
ORDER = 5
#: Ways that the ratios of runs are spread to. Tables that grow with the input are joined by merge: left to itself, Spark goes by the size of a table's compressed
#: files, even for such a copy, and sends what is many times larger through the driver.
SALTS = 16
#: Characters of which a worker keeps the log ratios after their contexts; emptied when full.
CACHED = 2_000_000

Rule = tuple[str, str, str]


def address_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where there is no ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule as a struct (rule, verdict), null if none fits. rules: (verdict, host, path)."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0], r[1] + r[2]))
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in ranked]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


class MarkovModel:
    """Character counts after contexts of up to ORDER characters."""

    def __init__(self, texts: list[str]):
        counts: defaultdict[str, Counter] = defaultdict(Counter)
        for text in texts:
            marked = "\x02" * ORDER + text + "\x03"
            for i in range(ORDER, len(marked)):
                for n in range(ORDER + 1):
                    counts[marked[i - n : i]][marked[i]] += 1
        self.contexts = {c: (dict(k), sum(k.values()), len(k)) for c, k in counts.items()}

    def probability(self, context: str, char: str) -> float:
        p = 1 / 1024  # any character at all
        for n in range(len(context) + 1):
            known = self.contexts.get(context[len(context) - n :])
            if known is None:
                break
            follow, total, kinds = known
            p = (follow.get(char, 0) + kinds * p) / (total + kinds)
        return p


class Ratio:
    """Mean log ratio, accepted over rejected, per character."""

    def __init__(self, accepted: MarkovModel, rejected: MarkovModel, threshold: float = 0.0):
        self.accepted, self.rejected, self.threshold, self.known = accepted, rejected, threshold, {}

    def score(self, text: str) -> float:
        marked, known = "\x02" * ORDER + text + "\x03", self.known
        if len(known) > CACHED:
            known.clear()
        total = 0.0
        for i in range(ORDER, len(marked)):
            window = marked[i - ORDER : i + 1]
            value = known.get(window)
            if value is None:
                value = known[window] = math.log(self.accepted.probability(window[:-1], window[-1]) / self.rejected.probability(window[:-1], window[-1]))
            total += value
        return total / (len(text) + 1)

    def verdict(self, text: str) -> str:
        return "allow" if self.score(text) >= self.threshold else "block"


def fitted(accepted: list[str], rejected: list[str]) -> Ratio | None:
    """Models of three quarters of the addresses, the threshold that best tells the rest apart; None without both kinds."""
    if not accepted or not rejected:
        return None
    kept = lambda xs: ([x for i, x in enumerate(xs) if i % 4 != 3], [x for i, x in enumerate(xs) if i % 4 == 3])
    (fit_a, try_a), (fit_r, try_r) = kept(accepted), kept(rejected)
    ratio = Ratio(MarkovModel(fit_a), MarkovModel(fit_r))
    if try_a and try_r:
        a, r = sorted(map(ratio.score, try_a)), sorted(map(ratio.score, try_r))
        values = sorted({*a, *r})
        cuts = [(x + y) / 2 for x, y in zip(values, values[1:], strict=False)] or [0.0]
        right = [sum(x >= c for x in a) / len(a) + sum(x < c for x in r) / len(r) for c in cuts[:: max(1, len(cuts) // 500)]]
        top = [c for c, x in zip(cuts[:: max(1, len(cuts) // 500)], right, strict=True) if x >= max(right) - 1e-12]
        ratio.threshold = (top[0] + top[-1]) / 2
    return ratio


def held_out_address(text: Column) -> Column:
    """True for the quarter of the addresses that the threshold is calibrated on."""
    return F.pmod(F.xxhash64(text), F.lit(4)) == 3


def _runs(texts: DataFrame) -> DataFrame:
    """The columns of texts and run: ORDER characters and the next one, for every character of the column text and its end."""
    marked = F.concat(F.lit("\x02" * ORDER), F.col("text"), F.lit("\x03"))
    starts = F.sequence(F.lit(1), F.length("text") + 1)
    return texts.withColumn("run", F.explode(F.transform(starts, lambda i: F.substring(marked, i, F.lit(ORDER + 1)))))


def _log_ratios(learnt: DataFrame, runs: DataFrame) -> DataFrame:
    """(run, value): the log ratio of the next character's probabilities. learnt: (ruled, text), distinct; runs: (run), distinct."""
    counted = staged(_runs(learnt.select("ruled", "text")).groupBy("run").agg(*(F.count(F.when(F.col("ruled") == v, 1)).alias(f"n_{v}") for v in ("allow", "block"))), "url-runs")
    both = counted.withColumn("asked", F.lit(False)).unionByName(runs.select("run", F.lit(0).cast("long").alias("n_allow"), F.lit(0).cast("long").alias("n_block"), F.lit(True).alias("asked")))
    known = None
    for n in range(ORDER + 1):
        cut = F.substring("run", ORDER + 1 - n, n + 1)  # n characters of context and the next one
        grams = both.groupBy(cut.alias("gram")).agg(*(F.sum(f"n_{v}").alias(f"n_{v}") for v in ("allow", "block")), F.max("asked").alias("asked"))
        own = Window.partitionBy(F.substring("gram", 1, n))  # a context's rows are as many as there are characters
        level = grams.select(
            "*", *(F.sum(f"n_{v}").over(own).alias(f"total_{v}") for v in ("allow", "block")), *(F.count(F.when(F.col(f"n_{v}") > 0, 1)).over(own).alias(f"kinds_{v}") for v in ("allow", "block"))
        ).where("asked")
        if known is None:
            level = level.withColumn("p_allow", F.lit(1 / 1024)).withColumn("p_block", F.lit(1 / 1024))  # any character at all
        else:
            level = level.withColumn("shorter", F.substring("gram", 2, n)).join(known.withColumnRenamed("gram", "shorter").hint("merge"), "shorter")
        # a context without kinds leaves the shorter one's probability as it is
        p = lambda v: F.when(F.col(f"kinds_{v}") > 0, (F.col(f"n_{v}") + F.col(f"kinds_{v}") * F.col(f"p_{v}")) / (F.col(f"total_{v}") + F.col(f"kinds_{v}"))).otherwise(F.col(f"p_{v}"))
        known = level.select("gram", p("allow").alias("p_allow"), p("block").alias("p_block"))
    return staged(known.select(F.col("gram").alias("run"), F.log(F.col("p_allow") / F.col("p_block")).alias("value")), "url-ratios")


def _scores(asked: DataFrame, values: DataFrame) -> DataFrame:
    """(text, ruled, score): mean log ratio per character. asked: (id, text, ruled), a text once."""
    each = _runs(asked.select("id", "text")).select("id", "run", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    salted = values.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # sums of doubles depend on their order in the last digits
    sums = each.join(salted.hint("merge"), ["run", "salt"]).groupBy("id").agg(F.round(F.sum("value"), 9).alias("sum"))
    return asked.join(sums.hint("merge"), "id").select("text", "ruled", (F.col("sum") / (F.length("text") + 1)).alias("score"))


def best_threshold(scored: DataFrame) -> float:
    """The middle of the cuts that best tell the verdicts apart, of all cuts between neighbouring scores. scored: (ruled, score)."""
    a, r = (F.count(F.when(F.col("ruled") == v, 1)).alias(n) for v, n in (("allow", "a"), ("block", "r")))
    values = scored.groupBy("score").agg(a, r)
    ranged = staged(values.repartitionByRange("score").withColumn("part", F.spark_partition_id()), "url-scores")
    parts = ranged.groupBy("part").agg(F.sum("a").alias("part_a"), F.sum("r").alias("part_r"), F.min("score").alias("least"))
    by_part = Window.orderBy("part")  # one row per task of the range exchange
    upto = by_part.rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("part", *(F.coalesce(F.sum(f"part_{c}").over(upto), F.lit(0)).alias(f"before_{c}") for c in "ar"), F.lead("least").over(by_part).alias("after"))
    total = parts.agg(F.sum("part_a").alias("a"), F.sum("part_r").alias("r")).first()
    if not total["a"] or not total["r"]:
        return 0.0
    own = Window.partitionBy("part").orderBy("score")
    sums = own.rowsBetween(Window.unboundedPreceding, 0)
    cuts = ranged.select("part", "score", *(F.sum(c).over(sums).alias(f"sum_{c}") for c in "ar"), F.lead("score").over(own).alias("next")).join(F.broadcast(before), "part")
    right = (total["a"] - F.col("sum_a") - F.col("before_a")) / total["a"] + (F.col("sum_r") + F.col("before_r")) / total["r"]
    cuts = staged(cuts.select(right.alias("right"), ((F.col("score") + F.coalesce("next", "after")) / 2).alias("cut")).where("cut IS NOT NULL"), "url-cuts")
    most = cuts.agg(F.max("right")).first()[0]
    if most is None:
        return 0.0
    low, high = cuts.where(F.col("right") >= most - 1e-12).agg(F.min("cut"), F.max("cut")).first()
    return (low + high) / 2


def judge_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (null if none fits), verdict ('allow' or 'block') and lm_score (null where a rule decided).

    The models learn from all addresses that rules decide, but those held out. Addresses without host and path score like any text, by the
    empty one; without both verdicts among the rules' addresses, all others are allowed; where all addresses of a verdict would be held out, the models learn
    from them, too, and the threshold is 0. Whole addresses are read, however long. Repeated rows are each judged. An empty table gives no rows.
    """
    host, path = address_parts(F.col(url_col))
    judged = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    judged = judged.withColumn("found", matched_rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "found.rule", F.col("found.verdict").alias("ruled"))
    judged = judged.withColumn("text", F.concat("host", "path"))
    # a path is empty or begins with the first slash, so a text is one address and has one verdict
    addresses = staged(judged.groupBy("text", "ruled").agg(F.lit(1).alias("one")).drop("one").withColumn("id", F.monotonically_increasing_id()), "url-addresses")
    learnt = addresses.where(F.col("ruled").isNotNull() & ~held_out_address(F.col("text")))
    whole = learnt.select("ruled").distinct().count() < 2
    if whole:  # few addresses, all of a verdict held out: learn from them, too, and calibrate on none
        learnt = addresses.where("ruled IS NOT NULL")
    if whole and learnt.select("ruled").distinct().count() < 2:
        return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("lm_score"))
    asked = addresses.where(F.col("ruled").isNull() | held_out_address(F.col("text")))
    runs = staged(_runs(asked).select("run").distinct(), "url-asked")
    scores = staged(_scores(asked, _log_ratios(learnt, runs)), "url-scored")
    threshold = 0.0 if whole else best_threshold(scores.where("ruled IS NOT NULL").select("ruled", "score"))
    # rows that a rule decided need no partner
    ruled, free = judged.where("ruled IS NOT NULL"), judged.where("ruled IS NULL")
    wanted = scores.where("ruled IS NULL").select("text", "score")
    # addresses without host and path are one text, of any number of rows
    scored = salted_join(free.withColumn("_row", F.monotonically_increasing_id()), wanted.hint("merge"), "text", "_row", hot_keys(free, "text")).drop("_row")
    scored = scored.withColumn("verdict", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    columns = ["page_id", "host", "path", "rule", "verdict"]
    return scored.select(*columns, F.col("score").alias("lm_score")).unionByName(ruled.withColumn("verdict", F.col("ruled")).select(*columns, F.lit(None).cast("double").alias("lm_score")))
