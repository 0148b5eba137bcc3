"""URL filter: rules for hosts and paths, and for the rest the ratio of two character language models.

The models are variable-order Markov models of URLs that rules accept and of those that they reject. A character's
probability after the last ``ORDER`` characters mixes the shares of all shorter contexts (Witten-Bell): a context that
was seen n times with t different next characters has weight n / (n + t), one never seen has none. A URL's score is the
difference of its log-likelihoods over its length, summed in fixed point, so that no order of rows changes it. The
threshold is calibrated on a quarter of the labelled URLs, from which the models learn nothing: of the steps of a
histogram of their scores the one with the least sum of error shares of both kinds.

All is joins and aggregations. Counts are of different URLs, so a URL that a third of all rows repeat teaches once, and
positions are summed by (context, character) before they are shuffled. Scores come back by an equi-join on (context,
character): the pairs that hold one of ``HOT`` positions or more (so ``HOT`` rows at most) are broadcast, and only
positions with rarer pairs are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, lower_ascii

ORDER = 5
#: Marks before and after a URL, and what a character without any context has a share of.
START, END, ALPHABET = "\x02", "\x03", 256
#: Log ratios are whole multiples of 1 / UNIT.
UNIT = 1 << 20
#: A pair with at least one of so many positions is broadcast.
HOT = 20_000
#: Steps of a threshold in one unit of score, and the greatest threshold.
STEPS, FARTHEST = 64, 8
#: Characters that are cut from a URL at once; longer URLs are cut into pieces first.
PIECE = 256


class Rule(NamedTuple):
    host: str
    path: str
    action: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _text_of(url: Column) -> Column:
    """What the models read: all after the scheme, or the whole URL where it has none."""
    after = F.concat(host_of(url), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1))
    return F.when(F.instr(url, "://") > 0, after).otherwise(F.coalesce(url, F.lit("")))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct of name and action, or null. Of equally long ones the longer host wins."""
    found = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.struct(F.lit(r.name).alias("name"), F.lit(r.action).alias("action"))) for r in sorted(rules, key=lambda r: (-len(r.name), -len(r.host)))]
    return F.coalesce(*found) if found else F.lit(None).cast("struct<name:string,action:string>")


def _positions(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """``keys`` and (context, c) for each character of ``text`` and its end; a context has ``ORDER`` characters at most."""
    marked = F.concat(F.lit(START), F.col(text), F.lit(END))

    def piece(k: Column) -> Column:
        first = k * PIECE + 2
        begin = F.greatest(first - ORDER, F.lit(1))
        return F.struct(F.substring(marked, begin, first + PIECE - begin).alias("chars"), (first - begin).alias("lead"))

    pieces = df.select(*keys, F.inline(F.transform(F.sequence(F.lit(0), F.floor((F.length(marked) - 2) / PIECE).cast("int")), piece)))
    each = pieces.select(*keys, "chars", F.explode(F.sequence(F.col("lead") + 1, F.length("chars"))).alias("i"))
    begin = F.greatest(F.col("i") - ORDER, F.lit(1))
    return each.select(*keys, F.substring("chars", begin, F.col("i") - begin).alias("context"), F.substring("chars", F.col("i"), F.lit(1)).alias("c"))


def _held_out(text: Column) -> Column:
    """Whether a labelled URL is of the quarter that sets the threshold."""
    return F.substring(F.md5(text), 1, 1) < "4"


def _ratios(scratch: Scratch, pairs: DataFrame) -> DataFrame:
    """(context, c, total, ratio) of every pair: the models' log ratio in fixed point.

    A context of k characters needs the one without its first character, so tables of 0 to ``ORDER`` characters follow
    each other. No group is larger than the characters that follow one context.
    """
    known, found = None, None
    for k in range(ORDER + 1):
        at = F.expr(f"right(context, {k})")
        level = pairs.where(F.length("context") >= k).groupBy(at.alias("context"), "c").agg(*[F.sum(x).alias(x) for x in ("total", "accepted", "rejected")])
        own = Window.partitionBy("context")
        level = level.withColumns({f"{x}_{y}": F.sum(z).over(own) for x in ("accepted", "rejected") for y, z in (("n", F.col(x)), ("t", (F.col(x) > 0).cast("long")))})
        if known is None:
            level = level.withColumns({f"less_{x}": F.lit(1 / ALPHABET) for x in ("accepted", "rejected")})
        else:
            less = known.select(F.col("context").alias("shorter"), F.col("c").alias("same"), *[F.col(f"p_{x}").alias(f"less_{x}") for x in ("accepted", "rejected")])
            level = level.join(less, (F.expr("substring(context, 2)") == F.col("shorter")) & (F.col("c") == F.col("same")))
        mixed = {f"p_{x}": F.when(F.col(f"{x}_n") == 0, F.col(f"less_{x}")).otherwise((F.col(x) + F.col(f"{x}_t") * F.col(f"less_{x}")) / (F.col(f"{x}_n") + F.col(f"{x}_t"))) for x in ("accepted", "rejected")}
        known = scratch.write(level.select("context", "c", "total", *[v.alias(k) for k, v in mixed.items()]), f"order{k}")
        # a shorter context than ORDER characters stands at the beginning of a URL
        whole = known if k == ORDER else known.where(F.col("context").startswith(START))
        found = whole if found is None else found.unionByName(whole)
    return scratch.write(found.select("context", "c", "total", F.round((F.log("p_accepted") - F.log("p_rejected")) * UNIT).cast("long").alias("ratio")), "ratios")


def _threshold(scored: DataFrame) -> float:
    """The score from which a URL is accepted, by the labelled URLs (text, action, score) that the models have not seen.

    The least sum of the shares of accepted URLs below and of rejected ones not below it; of equals the one nearest 0.
    Without URLs of both kinds it is 0.
    """
    bounds = FARTHEST * STEPS
    step = F.greatest(F.least(F.floor(F.col("score") * STEPS), F.lit(bounds)), F.lit(-bounds))
    counts = scored.distinct().groupBy(step.alias("step")).agg(*[F.sum((F.col("action") == x).cast("long")).alias(x) for x in ("allow", "block")])
    steps = scored.sparkSession.range(-bounds, bounds + 1).select(F.col("id").alias("step")).join(counts, "step", "left").fillna(0)
    below, all_of = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lost = F.coalesce(F.sum("allow").over(below), F.lit(0)) * F.sum("block").over(all_of)
    kept = (F.sum("block").over(all_of) - F.coalesce(F.sum("block").over(below), F.lit(0))) * F.sum("allow").over(all_of)
    return steps.select("step", (lost + kept).alias("error")).orderBy("error", F.abs("step"), "step").first()["step"] / STEPS


def judge_urls(pages: DataFrame, rules: Sequence[Rule], examples: DataFrame | None = None) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, score) of each row of ``pages`` (page_id, url): the rule's verdict where
    one fits, else whether the score reaches the calibrated threshold.

    The models learn from the URLs that rules judge, and from ``examples`` (url, action: allow or block) if given. A null
    URL and one without ``://`` have an empty host and path; their text, or its end alone, is scored like any other's.
    Repeated rows are given back as often. Without URLs of one kind that kind's model knows nothing, and the threshold is
    0; without any, all is allowed. An empty table gives none. Other columns are left out; ``keep_allowed`` keeps them.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "url_filter")
    parsed = pages.select("page_id", "url", _text_of(F.col("url")).alias("text"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parsed = parsed.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    known = parsed.select("text", F.col("rule.action").alias("action"), F.lit(1).cast("long").alias("copies"))
    if examples is not None:
        known = known.unionByName(examples.select(_text_of(F.col("url")).alias("text"), "action", F.lit(1).cast("long").alias("copies")))
    urls = known.groupBy("text", "action").agg(F.sum("copies").alias("copies"))
    urls = urls.withColumns({name: F.coalesce((F.col("action") == action) & ~_held_out(F.col("text")), F.lit(False)).cast("long") for name, action in (("accepted", "allow"), ("rejected", "block"))})
    pairs = _positions(urls, "text", "copies", "accepted", "rejected").groupBy("context", "c").agg(F.sum("copies").alias("total"), F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
    ratios = _ratios(scratch, scratch.write(pairs, "pairs"))
    positions = ratios.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    often = F.col("total") * HOT >= positions
    hot, rest = F.broadcast(ratios.where(often).select("context", "c", "ratio")), ratios.where(~often).select("context", "c", "ratio")

    def scored(rows: DataFrame, *keys: str) -> DataFrame:
        """Sum and number of the ratios of each of ``keys``."""
        each = _positions(rows, "text", *keys)
        near, far = each.join(hot, ["context", "c"]), each.join(hot, ["context", "c"], "left_anti").join(rest, ["context", "c"])
        return near.unionByName(far).groupBy(*keys).agg(F.sum("ratio").alias("sum"), F.count(F.lit(1)).alias("n"))

    found = scratch.write(scored(parsed, "page_id", "url"), "scored")
    found = found.select("*", _text_of(F.col("url")).alias("text"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    found = found.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("rule"), (F.col("sum") / F.col("n") / UNIT).alias("score"))
    tried = found.select("text", F.col("rule.action").alias("action"), "score")
    if examples is not None:
        more = scratch.write(scored(examples.select(_text_of(F.col("url")).alias("text"), "action").distinct(), "text", "action"), "examples")
        tried = tried.unionByName(more.select("text", "action", (F.col("sum") / F.col("n") / UNIT).alias("score")))
    threshold = _threshold(tried.where(F.col("action").isNotNull() & _held_out(F.col("text"))))
    verdict = F.coalesce(F.col("rule.action"), F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    copies = F.sequence(F.lit(1), (F.col("n") / (F.length("text") + 1)).cast("int"))  # a row has a position for each character and the end
    out = found.withColumn("_copy", F.explode(copies))
    return out.select("page_id", "url", "host", "path", F.col("rule.name").alias("rule"), verdict.alias("verdict"), "score")


def keep_allowed(pages: DataFrame, rules: Sequence[Rule], examples: DataFrame | None = None) -> DataFrame:
    """The rows of ``pages`` that are allowed, with all their columns, more of them and of any name."""
    kept = judge_urls(pages, rules, examples).where("verdict = 'allow'").select(F.col("page_id").alias("_page"), F.col("url").alias("_url")).distinct()
    return pages.join(kept, F.col("page_id").eqNullSafe(F.col("_page")) & F.col("url").eqNullSafe(F.col("_url")), "left_semi")
