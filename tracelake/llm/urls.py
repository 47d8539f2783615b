"""URL filters from association rules, in DataFrame functions and Spark's FP-growth alone.

A url's host and path are those of the contract. Its tokens are the host, each of its parent domains, and the path's
segments with their place and digits folded to "#". A url that a listed rule fits has that rule's verdict: the longest
rule wins, by host and then by path. Those verdicts are also the labels from which FP-growth mines token combinations;
rules whose consequent is a verdict are pruned by support and confidence, and by shorter rules that imply them. They
match other urls by an inverted index: each mined rule is posted under its rarest token, and a url that has this token
is checked for the rest. Of the mined rules that match, the most confident wins, then the best supported, the longest,
and block before allow; a url that none matches is allowed.

Tokens that stand in the same labelled rows are one to every rule: they are folded to the first of them before mining,
and a url has the folded token if it has any of them. So a deep path whose segments always come together makes one item
and not all subsets of its segments, and no rule that a single token would have made is lost.

Urls are folded to distinct token sets before matching, with their counts, so a host with a third of all rows costs no
more than its distinct shapes there. Mining counts rows: each set is a basket as often as it occurs, and a frequent
set's baskets are dealt over all tasks. Null urls, and urls without "://", have empty host and path, no tokens, no
rule, and the verdict allow. Rows with repeated ids are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: (verdict, host and path) of the contract's rules.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
SUPPORT, CONFIDENCE = 0.01, 0.9
DEAL = 256
BLOCK, ALLOW = "verdict=block", "verdict=allow"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null and for what has no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = lower_ascii(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def listed(host: Column, path: Column, rules: Iterable[tuple[str, str]] = RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(host: Column, path: Column) -> Column:
    """Sorted distinct tokens: domains as d:, path segments as their place and p:."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    parts = F.split(F.regexp_replace(path, "[0-9]+", "#"), "/")
    segments = F.transform(parts, lambda s, i: F.when(s != "", F.concat(i.cast("string"), F.lit("p:"), s)))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.array_compact(F.concat(domains, segments)))))


def folded(shapes: DataFrame) -> DataFrame:
    """(token, item): the first of all tokens that stand in the same labelled shapes (tokens, verdict, n). Sets of shapes are compared by their size and two combined hashes of 64 bits."""
    each = shapes.where("verdict IS NOT NULL").select(F.explode("tokens").alias("token"), F.xxhash64("tokens", "verdict").alias("a"), F.xxhash64("verdict", F.reverse("tokens")).alias("b"))
    marks = each.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    first = marks.groupBy("n", "a", "b").agg(F.min("token").alias("item"))
    return marks.join(first, ["n", "a", "b"]).select("token", "item")


def mine(shapes: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(antecedent, verdict, confidence, support) mined from shapes (tokens, verdict, n); n is how often a shape occurs.

    Support and confidence are shares of all labelled rows. A shape's n baskets are dealt out in parts of up to DEAL.
    """
    known = shapes.where("verdict IS NOT NULL AND size(tokens) > 0").select(F.array_union("tokens", F.array(F.concat(F.lit("verdict="), "verdict"))).alias("items"), "n")
    parts = known.select("items", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(DEAL))).alias("from"))
    dealt = parts.repartition(int(shapes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    baskets = dealt.select("items", F.explode(F.array_repeat(F.lit(True), F.least(F.lit(DEAL), F.col("n") - F.col("from")).cast("int")))).select("items")
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    rules = model.associationRules.where(F.col("consequent")[0].isin(BLOCK, ALLOW)).where(~F.exists("antecedent", lambda t: t.startswith("verdict=")))
    rules = rules.select(F.array_sort("antecedent").alias("antecedent"), F.substring_index(F.col("consequent")[0], "=", -1).alias("verdict"), "confidence", "support")
    # A rule goes if another with fewer tokens, all among its own, has the same verdict and no less confidence.
    rules = rules.withColumn("size", F.size("antecedent")).withColumn("first", F.col("antecedent")[0])
    short = rules.select(F.explode("antecedent").alias("token"), "antecedent", "verdict", "confidence", "size")
    lead = rules.select(F.col("first").alias("token"), F.col("antecedent").alias("inner_"), F.col("verdict").alias("v"), F.col("confidence").alias("c"), F.col("size").alias("s"))
    implied = short.join(lead, "token").where("verdict = v AND s < size AND c >= confidence AND size(array_except(inner_, antecedent)) = 0").select("antecedent", "verdict").distinct()
    return rules.join(implied, ["antecedent", "verdict"], "left_anti").drop("first")


def judge(df: DataFrame, url: str = "url", page_id: str = "page_id", rules: Iterable[tuple[str, str]] = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict, and the mined rule that decided where no listed one did."""
    host, path = split_url(F.col(url))
    rows = df.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("hit", listed(F.col("host"), F.col("path"), rules)).withColumn("tokens", tokens(F.col("host"), F.col("path")))
    raw = rows.select("tokens", F.col("hit.verdict").alias("verdict")).groupBy("tokens", "verdict").agg(F.count("*").alias("n"))
    items = raw.select("tokens", F.explode("tokens").alias("token")).join(folded(raw), "token", "left").groupBy("tokens").agg(F.array_sort(F.collect_set(F.coalesce("item", "token"))).alias("items"))
    named = stored(raw.join(items.distinct(), "tokens", "left").select(F.col("tokens").alias("key"), F.coalesce("items", "tokens").alias("tokens"), "verdict", "n"))
    shapes = named.groupBy("tokens", "verdict").agg(F.sum("n").alias("n"))
    mined = mine(shapes, support, confidence)
    often = shapes.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("often"))
    lead = mined.select(F.explode("antecedent").alias("token"), "antecedent").join(often, "token").groupBy("antecedent").agg(F.min_by("token", F.struct("often", "token")).alias("token"))
    posted = mined.join(lead, "antecedent")
    open_ = shapes.where("verdict IS NULL AND size(tokens) > 0").select("tokens").distinct()
    hits = open_.select("tokens", F.explode("tokens").alias("token")).join(posted, "token").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = F.max_by(F.struct(F.col("verdict").alias("found"), F.array_join("antecedent", " ").alias("mined_rule")), F.struct("confidence", "support", "size", F.col("verdict") == "block", "antecedent"))
    decided = hits.groupBy("tokens").agg(best.alias("best")).select("tokens", "best.*")
    decided = named.where("verdict IS NULL").select("key", "tokens").join(decided, "tokens").select(F.col("key").alias("tokens"), "found", "mined_rule")
    out = rows.join(decided, "tokens", "left")
    listed_ = F.col("hit.verdict")
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(listed_, "found", F.lit("allow")).alias("verdict"), F.when(listed_.isNull(), F.col("mined_rule")).alias("mined_rule"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
