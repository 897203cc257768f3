"""URL filtering by association rules, in DataFrame functions and Spark's FP-growth only.

Labelled urls become baskets of tokens (scheme, top-level domain, domain, host labels, path segments by place, query keys); FP-growth
mines combinations that go with a label, after tokens that always come together have been made one; rules that pass confidence and support are indexed by token, and a rule fires on a
basket when as many of its tokens are found there as it has.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, forget

#: verdict, host, path
RULES: tuple[tuple[str, str, str], ...] = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Where FP-growth makes more combinations than these, rules are searched for level by level instead (telling_sets); and so many are what a rule's bound counts as tried at most.
MOST_SETS = 1 << 20


def ascii_lower(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first :// up to / ? # or end, A-Z lower-cased; then up to ? # or end. Both empty without ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule whose host is the url's or a parent domain and whose path begins the url's; else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Sorted distinct tokens of a url. Digits count as one mark, so that numbered pages share tokens."""
    labels = F.split(host, r"\.")
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    place = F.transform(segments, lambda s, i: F.concat(F.lit("seg"), F.least(i, F.lit(3)).cast("string"), F.lit(":"), F.regexp_replace(s, "[0-9]+", "0")))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "[&;]"), lambda s: s != ""), lambda s: F.concat(F.lit("q:"), F.substring_index(s, "=", 1)))
    host_items = F.when(
        host != "",
        F.array(F.concat(F.lit("tld:"), F.element_at(labels, -1)), F.concat(F.lit("dom:"), F.substring_index(host, ".", -2)), F.concat(F.lit("host:"), host), F.concat(F.lit("sub:"), F.element_at(labels, 1))),
    ).otherwise(F.array().cast("array<string>"))
    scheme = F.filter(F.array(F.concat(F.lit("scheme:"), ascii_lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)))), lambda s: s != "scheme:")
    mark = F.when(F.instr(url, "#") > 0, F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(host_items, *[F.coalesce(x, empty) for x in (place, keys, scheme, mark)])))


def _hash(items: str) -> tuple[Column, Column]:
    """128 bits that stand for an array of tokens."""
    return F.xxhash64(F.lit(1), items).alias("k1"), F.xxhash64(F.lit(2), items).alias("k2")


def token_classes(counts: DataFrame, least: int, total: int) -> DataFrame:
    """counts: (items, verdict, n). (token, rep) of the tokens that `least` of the `total` labelled urls have, and not all of them: a token of all says nothing.

    Tokens of just the same urls are one class, named by its first token: rules on any of them are the same. Equality is that of two 64-bit sums of the urls' hashes and of the count.
    """
    each = counts.select(F.explode("items").alias("token"), "n", F.xxhash64(F.lit(1), "items", "verdict").alias("h1"), F.xxhash64(F.lit(2), "items", "verdict").alias("h2"))
    of = each.groupBy("token").agg(F.sum("n").alias("c"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2")).filter((F.col("c") >= least) & (F.col("c") < total))
    reps = of.groupBy("h1", "h2", "c").agg(F.min("token").alias("rep"))
    return of.join(reps, ["h1", "h2", "c"]).select("token", "rep")


def evidence(confidence: Column, urls: Column, share: Column, tried: int) -> Column:
    """How far a rule moves the log-odds of its verdict from the verdict's share of all labels, by the lower bound (Wilson's) of its confidence over so many urls. The bound is as wide as the best of `tried` rules is off by
    chance, so of many combinations none counts only because it was the luckiest; at 0 or less a rule says nothing."""
    z2 = 2 * math.log(max(tried, 2))
    low = (confidence + z2 / (2 * urls) - F.sqrt(z2 * confidence * (1 - confidence) / urls + z2 * z2 / (4 * urls * urls))) / (1 + z2 / urls)
    return F.ln(low / (1 - low)) - F.ln(share / (1 - share))


def all_sets(train: DataFrame, min_support: float, most_sets: int | None) -> DataFrame | None:
    """FP-growth's (items, freq), or None where there are more than most_sets."""
    found = FPGrowth(itemsCol="items", minSupport=min_support).fit(train).freqItemsets
    # FP-growth makes sets as they are asked for, so the count ends soon where there are very many.
    return cut(found, "url-sets") if most_sets is None or found.select(F.lit(1)).limit(most_sets + 1).count() <= most_sets else None


def frequent_sets(train: DataFrame, min_support: float, most_sets: int) -> tuple[DataFrame, float]:
    """FP-growth's (items, freq) at min_support, or at the least of its doubles at which there are at most most_sets; and that support. All items of all rows take part. mine_rules does not use it: it drops no set."""
    support = min_support
    while (found := all_sets(train, support, most_sets if support < 1 else None)) is None:
        support = min(1.0, 2 * support)
    return found, support


def telling_sets(baskets: DataFrame, least: dict[str, int]) -> DataFrame:
    """baskets: (reps, verdict, n), reps sorted. (antecedent, label, freq, urls): what mine_rules can make rules of, however many sets are frequent.

    Level by level, a set is taken if it has `least` urls of some verdict and each set of all but one of its tokens was taken, is on more urls and has more than one verdict.
    No rule is lost: least is what a rule has to have; a set on just the urls of a smaller one has that one's confidence and score; and beyond a set with one verdict the confidence
    stays 1 and only the support falls. mine_rules would drop all these for the smaller rule.
    """
    enough = F.create_map(*[F.lit(x) for pair in least.items() for x in pair])
    hits, smaller, taken = baskets.select(F.array().cast("array<string>").alias("set"), F.col("reps").alias("rest"), "verdict", "n"), None, []
    while True:
        more = hits.select("set", "rest", "verdict", "n", F.posexplode("rest").alias("at", "x"))
        more = more.select(F.array_append("set", F.col("x")).alias("set"), F.slice("rest", F.col("at") + 2, F.size("rest")).alias("rest"), "verdict", "n")
        each = more.groupBy("set", "verdict").agg(F.sum("n").alias("freq"))
        level = each.groupBy("set").agg(F.sum("freq").alias("urls"), F.max("freq").alias("most"), F.max(F.col("freq") >= enough[F.col("verdict")]).alias("told"), F.collect_list(F.struct("verdict", "freq")).alias("freqs")).filter("told")
        if smaller is not None:
            parts = level.select("set", F.col("urls").alias("own"), F.explode("set").alias("x")).select("set", "own", F.array_remove("set", F.col("x")).alias("part"))
            free = parts.join(smaller.select(F.col("set").alias("part"), "urls"), "part").groupBy("set").agg(F.count("*").alias("n"), F.min(F.col("urls") > F.col("own")).alias("free"))
            level = level.join(free.filter(F.col("free") & (F.col("n") == F.size("set"))).select("set"), "set")
        level = cut(level, "url-level")
        taken.append(level)
        smaller = level.filter("most < urls")
        before, hits = hits, cut(more.filter(F.size("rest") > 0).join(smaller.select("set"), "set"), "url-hits")
        forget(before)
        if hits.isEmpty():
            forget(hits)
            break
    found = cut(reduce(DataFrame.unionByName, taken).select(F.col("set").alias("antecedent"), "urls", F.explode("freqs").alias("of")).select("antecedent", F.concat(F.lit("label:"), "of.verdict").alias("label"), "of.freq", "urls"), "url-sets")
    forget(*taken)
    return found


def mine_rules(labelled: DataFrame, min_support: float, min_confidence: float, most_sets: int = MOST_SETS) -> tuple[DataFrame, DataFrame]:
    """labelled: (items, verdict). Rules (rule_id, antecedent, verdict, confidence, support, score) of the least confidence, whose confidence no rule
    of all but one of their tokens reaches with the same verdict (such a rule would judge in their place); and the classes (token, rep) that antecedents are made of.

    score: the log of the verdict's share of labels plus the rule's evidence, so that rules for any verdicts compare; one that no more than makes up for another verdict's greater share is no rule.

    A labelled url is mined by all its tokens, and rules have any number of them. Where that makes more than most_sets combinations, the same rules are found without making all of them (telling_sets).
    """
    spark = labelled.sparkSession
    none = spark.createDataFrame([], "rule_id string, antecedent array<string>, verdict string, confidence double, support double, score double"), spark.createDataFrame([], "token string, rep string")
    counts = cut(labelled.groupBy("items", "verdict").agg(F.count("*").alias("n")), "url-labels")
    total = counts.agg(F.sum("n")).first()[0] or 0
    if not total:
        return none
    classes = cut(token_classes(counts, math.ceil(min_support * total), total), "url-tokens")
    short = counts.select("*", F.explode("items").alias("token")).join(classes, "token").groupBy("items", "verdict", "n").agg(F.array_sort(F.collect_set("rep")).alias("reps"))
    # n rows of each, made in parts so that a url that many labels share is dealt over tasks.
    parts = short.withColumn("part", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / 1024).cast("int")))).repartition(spark.sparkContext.defaultParallelism)
    train = parts.select(F.array_append("reps", F.concat(F.lit("label:"), "verdict")).alias("items"), F.explode(F.sequence(F.lit(1), F.least(F.lit(1024), F.col("n") - 1024 * F.col("part")).cast("int"))).alias("x")).select("items")
    train = cut(train, "url-train")
    found = all_sets(train, min_support, most_sets)
    tried = most_sets if found is None else found.count()
    is_label = lambda x: x.startswith("label:")
    shares = {r["verdict"]: r["n"] / total for r in counts.groupBy("verdict").agg(F.sum("n").alias("n")).collect()}
    # A row for each verdict. One that all labels have needs no rule.
    labels = [(v, s, math.log(max(x for u, x in shares.items() if u != v))) for v, s in shares.items() if len(shares) > 1]
    if not labels:
        forget(counts, train, *([] if found is None else [found]))
        return none[0], classes
    if found is None:
        # Of all rules with so many urls of their verdict the one that has no others scores best: ln(urls / z2) + ln(1 - share) is to be greater than ln(share) and against.
        z2, few = 2 * math.log(max(tried, 2)), math.ceil(min_support * total)
        least = {v: max(few, math.floor(z2 * max(s, math.exp(against)) / (1 - s) * (1 - 1e-6))) for v, s, against in labels}
        found = telling_sets(short.groupBy("reps", "verdict").agg(F.sum("n").alias("n")), least)
        both = found.filter(F.col("freq") >= few)
    else:
        plain = found.filter(~F.exists("items", is_label)).select(F.array_sort("items").alias("antecedent"), F.col("freq").alias("urls"))
        both = found.filter((F.size("items") > 1) & F.exists("items", is_label))
        both = both.select(F.array_sort(F.filter("items", lambda x: ~is_label(x))).alias("antecedent"), F.get(F.filter("items", is_label), F.lit(0)).alias("label"), "freq").join(plain, "antecedent")
    labels = spark.createDataFrame([(f"label:{v}", s, against) for v, s, against in labels], "label string, share double, against double")
    rules = both.join(F.broadcast(labels), "label").withColumn("confidence", F.col("freq") / F.col("urls"))
    rules = rules.withColumn("score", F.round(F.ln("share") + evidence(F.col("confidence"), F.col("urls"), F.col("share"), tried), 9)).filter((F.col("confidence") >= min_confidence) & (F.col("score") > F.greatest(F.ln("share"), F.col("against"))))
    rules = rules.select("antecedent", F.substring("label", 7, 99).alias("verdict"), "confidence", (F.col("freq") / total).alias("support"), "score")
    less = rules.select(F.col("antecedent").alias("part"), "verdict", F.col("confidence").alias("c2"))
    parts = rules.filter(F.size("antecedent") > 1).select("antecedent", "verdict", "confidence", F.explode("antecedent").alias("x")).withColumn("part", F.array_remove("antecedent", F.col("x")))
    covered = parts.join(less, ["part", "verdict"]).filter("c2 >= confidence").select("antecedent", "verdict").distinct()
    rules = cut(rules.join(covered, ["antecedent", "verdict"], "left_anti").withColumn("rule_id", F.concat_ws(" ", "antecedent", F.concat(F.lit(">"), "verdict"))), "url-rules")
    forget(counts, train, found)
    return rules, classes


def filter_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url",
    min_support: float = 0.005, min_confidence: float = 0.7, default: str = "allow", most_sets: int = MOST_SETS,
) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, mined (the association rule that judged, else null).

    labels: (url, verdict) to mine from; without it, the urls that `rules` judge are the labels. A url that neither a rule nor an association rule judges gets `default`.
    An association rule fires on a url that has a token of each of its classes. Of several the one of the greatest score (see mine_rules), then best supported, then longest, then first by text judges. Null urls and urls
    without :// have empty host and path. An empty table gives no rows. Other columns are ignored.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("fixed", rule_for(F.col("host"), F.col("path"), rules))
    items = tokens(F.coalesce("url", F.lit("")), F.col("host"), F.col("path")).alias("items")
    if labels is None:
        labelled = rows.filter(F.col("fixed").isNotNull()).select(items, "fixed.verdict")
    else:
        labelled = labels.select("url", "verdict").withColumns({"host": host, "path": path}).select(items, "verdict")
    mined, classes = mine_rules(labelled, min_support, min_confidence, most_sets)
    index = mined.select("rule_id", F.col("verdict").alias("mined_verdict"), "score", "support", F.size("antecedent").alias("n"), F.explode("antecedent").alias("rep"))
    undecided = rows.filter(F.col("fixed").isNull()).select("id", "host", "path", items).select("id", "host", "path", "items", *_hash("items"))
    one = undecided.groupBy("k1", "k2").agg(F.first("items").alias("items")).select("k1", "k2", F.explode("items").alias("token"))
    hits = one.join(classes, "token").select("k1", "k2", "rep").join(index, "rep").groupBy("k1", "k2", "rule_id", "mined_verdict", "score", "support", "n").agg(F.size(F.collect_set("rep")).alias("found")).filter("found = n")
    rank = F.struct("score", "support", "n", "rule_id", "mined_verdict")
    # Cut, so that the join below deals both its sides and Spark can split the tokens that many urls share.
    judged = cut(hits.groupBy("k1", "k2").agg(F.max(rank).alias("by")).select("k1", "k2", F.col("by.rule_id").alias("mined"), F.col("by.mined_verdict").alias("mined_verdict")), "url-judged")
    kept = rows.filter(F.col("fixed").isNotNull()).select("id", "host", "path", "fixed.rule", "fixed.verdict", F.lit(None).cast("string").alias("mined"))
    rest = undecided.drop("items").join(judged, ["k1", "k2"], "left").select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.coalesce("mined_verdict", F.lit(default)).alias("verdict"), "mined")
    return kept.unionByName(rest).withColumnRenamed("id", id_col)


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def url_rules(spark, sf_dir: str) -> DataFrame:
    """What the fixed rules alone say of each page: SQL can express it, unlike the mined verdicts."""
    host, path = url_parts(F.col("url"))
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", host.alias("host"), path.alias("path"))
    return rows.withColumn("fixed", rule_for(F.col("host"), F.col("path"), RULES)).select("page_id", "host", "path", "fixed.rule", "fixed.verdict")


_FITS = [(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN", h + p, v) for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
RULES_ORACLE = rf"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages)
SELECT *, CASE {" ".join(f"{fits} '{rule}'" for fits, rule, _ in _FITS)} END AS rule, CASE {" ".join(f"{fits} '{verdict}'" for fits, _, verdict in _FITS)} END AS verdict FROM p
"""
