"""URL filters: given rules first, mined association rules for what they leave open.

Given rules fit a host with its subdomains and a path prefix; the longest wins. The URLs they decide are the labelled
examples (or a labelled table is given). Spark's FP-growth mines combinations of URL tokens that go with a label; of
the association rules only those with a label as consequent, enough support and enough confidence stay, and a rule goes if
its antecedent less a token is as sure of the same.

Each mined rule is filed under its rarest token. URLs are folded to their token sets (numbers count alike), each set
looks up its tokens and keeps the rules of which it has all tokens; the surest rule decides, then the one with more
support. Sets, not pages, meet rules, so a host with a third of all pages is one set or a few. All of it is DataFrame
expressions and Spark's own FP-growth.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftledger.llm.common import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SUPPORT = 0.02
CONFIDENCE = 0.9
LABEL = "label="


@dataclass(frozen=True)
class Rule:
    """host with its subdomains, path prefix, and what to do: block or allow."""

    host: str
    path: str
    action: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)


def host_of(rest: Column) -> Column:
    """Host of what follows the scheme, ASCII letters lowered."""
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as struct(rule, action); null if none does. Of equally long ones the longer host."""
    found = F.lit(None).cast("struct<rule:string,action:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), len(r.host))):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.action).alias("action"))).otherwise(found)
    return found


def tokens_of(scheme: Column, host: Column, path: Column, rest: Column) -> Column:
    """Sorted distinct tokens: scheme, host labels, path parts and words of query and fragment; numbers become #."""
    pieces = lambda text, by: F.filter(F.split(text, by), lambda x: x != "")
    plain = lambda kind: lambda x: F.concat(F.lit(kind), F.when(x.rlike("^[0-9]+$"), F.lit("#")).otherwise(x))
    low = lambda text: F.translate(text, UPPER, LOWER)
    tail = F.regexp_extract(rest, "^[^?#]*([^\\x00]*)", 1)
    every = F.concat(
        F.transform(pieces(low(scheme), ":"), plain("s:")),
        F.transform(pieces(host, "[.]"), plain("h:")),
        F.transform(pieces(low(path), "[/._-]+"), plain("p:")),
        F.transform(pieces(low(tail), "[^0-9a-z_]+"), plain("q:")),
    )
    return F.sort_array(F.array_distinct(every))


def described(pages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """page_id, host, path, found (the given rule) and tokens of every row."""
    rows = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"))
    rows = rows.withColumn("at", F.coalesce(F.instr("url", "://"), F.lit(0)))
    rows = rows.withColumn("rest", F.expr("CASE WHEN at > 0 THEN substring(url, at + 3) ELSE '' END"))
    rows = rows.withColumn("scheme", F.expr("CASE WHEN at > 0 THEN substring(url, 1, at - 1) ELSE '' END"))
    rows = rows.withColumn("host", host_of(F.col("rest"))).withColumn("path", path_of(F.col("rest")))
    found = rule_of(F.col("host"), F.col("path"), rules)
    tokens = tokens_of(F.col("scheme"), F.col("host"), F.col("path"), F.col("rest"))
    return rows.select("page_id", "host", "path", found.alias("found"), tokens.alias("tokens"))


def mined(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(id, tokens, size, key, action, confidence, support) of the mined rules; labelled has tokens and action.

    Rows without a label do not count. Without labelled rows there are no rules.
    """
    spark = labelled.sparkSession
    kinds = "id long, tokens array<string>, size int, key string, action string, confidence double, support double"
    known = labelled.where("action is not null")
    items = known.select(F.concat("tokens", F.array(F.concat(F.lit(LABEL), "action"))).alias("items"))
    if items.isEmpty():
        return spark.createDataFrame([], kinds)
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    rules = model.associationRules.where(F.col("consequent")[0].startswith(LABEL)).select(
        F.sort_array("antecedent").alias("tokens"),
        F.size("antecedent").alias("size"),
        F.substring(F.col("consequent")[0], len(LABEL) + 1, 1 << 20).alias("action"),
        "confidence",
        "support",
    )
    rules = saved(rules.withColumn("id", F.xxhash64("tokens", "action")), "mined")
    frequency = saved(single, "frequency")
    keyed = rules.select("id", F.explode("tokens").alias("token")).join(frequency, "token").groupBy("id").agg(
        F.min_by("token", F.struct("freq", "token")).alias("key")
    )
    rules = rules.join(keyed, "id")
    # a rule says nothing new if its antecedent less a token is as sure of the same action
    shorter = rules.select(F.col("tokens").alias("part"), F.col("action").alias("says"), F.col("confidence").alias("sure"))
    parts = rules.select("id", "action", "confidence", F.explode("tokens").alias("out"), "tokens").select(
        "id", "action", "confidence", F.array_remove("tokens", F.col("out")).alias("part")
    )
    same = (parts.part == shorter.part) & (parts.action == shorter.says) & (parts.confidence <= shorter.sure)
    needless = parts.join(shorter, same, "left_semi").select("id").distinct()
    return saved(rules.join(needless, "id", "left_anti").select("id", "tokens", "size", "key", "action", "confidence", "support"), "rules")


def matched(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, action) of each token set that has all tokens of a rule: the surest rule, then more support."""
    index = rules.select(F.col("key").alias("token"), F.col("tokens").alias("needs"), "action", "confidence", "support", "id")
    asked = sets.select("tokens", F.explode("tokens").alias("token"))
    met = asked.join(index, "token").where(F.size(F.array_except("needs", "tokens")) == 0)
    best = F.max_by("action", F.struct("confidence", "support", "id"))
    return met.groupBy("tokens").agg(best.alias("action"))


def filtered(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, labelled: DataFrame | None = None,
    support: float = SUPPORT, confidence: float = CONFIDENCE,
) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages (page_id, url).

    Without `labelled` (tokens, action) the pages that the given rules decide are the examples. A page that neither a
    given nor a mined rule fits is allowed, and so is a null url or one without scheme, whose host and path are empty.
    Rows without page_id and repeated rows are judged like others; an empty table gives an empty result; other columns
    are ignored.
    """
    rows = saved(described(pages, rules), "described")
    examples = labelled if labelled is not None else rows.select("tokens", F.col("found.action").alias("action"))
    known = mined(examples, support, confidence)
    open_sets = rows.where("found is null").select("tokens").distinct()
    verdicts = saved(matched(open_sets, known), "verdicts").select(F.col("tokens").alias("set"), F.col("action").alias("mined"))
    judged = rows.join(verdicts, (rows.tokens == verdicts.set) & rows.found.isNull(), "left")
    return judged.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.action", "mined", F.lit("allow")).alias("verdict"),
    )
