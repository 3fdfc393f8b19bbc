"""URL filtering by rules, and beyond them by association rules that Spark's FP-growth mines.

Native: DataFrame operations and FPGrowth alone. Mined rules lie in an inverted index under their rarest token;
a url meets only the rules of its own tokens, and a rule fires when the url has all of its tokens.

FP-growth lists all frequent combinations, whose number doubles with each token that others come along with. Two exact steps
keep that down: tokens that occur in the very same labelled urls (by their count and a 128-bit fingerprint of the rows) are mined
as one item, any of which then fires; and a token whose urls all have one label is a rule by itself that no combination can better,
so that it is not mined any further. What is left can still grow with the combinations of tokens that do vary.

Skew: the rules are joined on tokens; their table is small by its support bound, and Spark broadcasts it only
below its own size threshold, else the join is split by adaptive execution. Matches are gathered by a row's
own number, which no key repeats.
"""

from __future__ import annotations

from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, table

#: (host, path, verdict): fits the host and all its subdomains where the url's path starts with the rule's
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LABELS = ("block", "allow")


def parts(url: Column) -> tuple[Column, Column, Column]:
    """host, path, and the rest of the url. Null or without '://': all empty."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    after = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1)).otherwise(url)
    rest = F.substr(url, F.length(after) + 4)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substr(rest, F.length(host) + 1)
    path = F.regexp_extract(tail, r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path, F.substr(tail, F.length(path) + 1)


def tokens(host: Column, path: Column, rest: Column) -> Column:
    """Distinct tokens of a url: labels of the host, segments and extension of the path, names in the query."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    ext = F.array(F.concat(F.lit("x:"), F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)))
    names = F.transform(F.regexp_extract_all(rest, F.lit(r"[?&]([^=&#]+)"), 1), lambda x: F.concat(F.lit("q:"), x))
    return F.array_distinct(F.filter(F.concat(labels, segments, ext, names), lambda x: F.length(x) > 2))


def by_rules(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _items(labelled: DataFrame, ws: Workspace, least: int) -> DataFrame:
    """token, label, n (rows with both), freq (rows with the token), item: the smallest token of the same rows. Tokens in at least so many rows.

    At most 1 / support times a row's tokens; the window runs over these alone. Counts are aggregated before the shuffle.
    """
    each = labelled.select(F.explode("tokens").alias("token"), "label", F.xxhash64(F.lit(1), "row").alias("a"), F.xxhash64(F.lit(2), "row").alias("b"))
    per = each.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    whole = per.groupBy("token").agg(F.sum("n").alias("freq"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.collect_list(F.struct("label", "n")).alias("per")).where(F.col("freq") >= least)
    whole = whole.withColumn("item", F.min("token").over(Window.partitionBy("freq", "a", "b")))
    return ws.save(whole.select("token", "freq", "item", F.inline("per")), "items")


def _best(sets: DataFrame, ws: Workspace) -> DataFrame:
    """Of (items, label, n, confidence) those that are more confident than any of their subsets with that label.

    All subsets of a frequent set are frequent. So it is enough to hand the best confidence from each set to those with an item more.
    """
    sets = ws.save(sets.withColumn("size", F.size("items")), "sets")
    longest = sets.agg(F.max("size")).first()[0] or 0
    out = best = sets.where("size = 1").withColumns({"below": F.lit(0.0), "best": F.col("confidence")})
    for k in range(2, longest + 1):
        own = sets.where(F.col("size") == k)
        less = own.select("items", "label", F.explode(F.transform("items", lambda x: F.array_remove("items", x))).alias("fewer"))
        below = less.join(best.select(F.col("items").alias("fewer"), "label", "best"), ["fewer", "label"]).groupBy("items", "label").agg(F.max("best").alias("below"))
        best = own.join(below, ["items", "label"]).select(*own.columns, "below", F.greatest("confidence", "below").alias("best"))
        if k % 4 == 0:
            best = ws.save(best, f"best{k}")  # plans stay small
        out = out.unionByName(best)
    return out.where("confidence > below").select("items", "label", "n", "confidence")


def mine(labelled: DataFrame, ws: Workspace, support: float = 0.01, confidence: float = 0.8) -> DataFrame:
    """Rules from (tokens, label): items, label, confidence, support, rarest, all, rare.

    An item stands for the tokens that occur in the same rows as it, its members; a rule holds for any choice of one member of each of
    its items (all: their members; rare: those of rarest, the item in the fewest rows). All rows with a label count. Pruned: less
    support or confidence than asked for, and rules whose tokens contain those of another rule with the same label and no less
    confidence. Repeated rows count as often as they occur; rows without tokens count as rows. An empty input gives no rules.
    """
    mark = "label="
    own = F.array_distinct(F.coalesce("tokens", F.array().cast("array<string>")))
    labelled = ws.save(labelled.where("label is not null").select(F.monotonically_increasing_id().alias("row"), own.alias("tokens"), "label"), "labelled")
    n = labelled.count()
    least = max(1, ceil(support * n - 1e-9))
    items = _items(labelled, ws, least)
    heads = items.where("token = item")
    rules = heads.where("n = freq").select(F.array("item").alias("items"), "label", "n", F.lit(1.0).alias("confidence"))
    mixed = [r["item"] for r in heads.where("n < freq").select("item").distinct().collect()]  # bounded by the support, see _items
    if mixed:
        rows = labelled.select(F.concat(F.array_intersect("tokens", F.lit(mixed)), F.array(F.concat(F.lit(mark), "label"))).alias("items"))
        model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=confidence).fit(rows)
        is_label = F.filter("items", lambda x: x.startswith(mark))
        found = model.freqItemsets.select(F.array_sort(F.filter("items", lambda x: ~x.startswith(mark))).alias("items"), F.substr(F.try_element_at(is_label, F.lit(1)), F.lit(len(mark) + 1)).alias("label"), "freq")
        both = found.where(F.size("items") > 0).groupBy("items").agg(F.max(F.when(F.col("label").isNull(), F.col("freq"))).alias("of"), F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", F.col("freq").alias("n")))).alias("per"))
        both = both.select("items", "of", F.inline("per")).select("items", "label", "n", (F.col("n") / F.col("of")).alias("confidence"))
        rules = rules.unionByName(_best(both, ws))
    rules = rules.where((F.col("confidence") >= confidence) & (F.col("n") >= least))
    members = items.groupBy("item").agg(F.sort_array(F.collect_set("token")).alias("members"), F.min("freq").alias("freq"))
    each = rules.select("items", "label", "n", "confidence", F.explode("items").alias("item")).join(members, "item")
    order = F.struct("freq", "item")
    each = each.groupBy("items", "label", "confidence", (F.col("n") / F.lit(max(n, 1))).alias("support"))
    return ws.save(each.agg(F.min_by("item", order).alias("rarest"), F.collect_list("members").alias("all"), F.min_by("members", order).alias("rare")), "rules")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, support: float = 0.01, confidence: float = 0.8, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, method, confidence.

    Rules decide where they fit; their verdicts are the labels that the method learns from. Elsewhere the mined
    rule with most confidence (then support, then tokens) decides, and default where none fires. Null urls
    and urls without '://' have an empty host and path and get the method's verdict. Repeated rows are judged each, null and repeated
    ids too; an empty table gives no rows; other columns are not read.
    """
    rules = RULES if rules is None else rules
    ws = Workspace(pages.sparkSession, "urls")
    host, path, rest = parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), rest.alias("rest"))
    rows = rows.select("page_id", "host", "path", tokens(F.col("host"), F.col("path"), F.col("rest")).alias("tokens"), by_rules(F.col("host"), F.col("path"), rules).alias("hit"))
    decided = rows.where("hit is not null")
    mined = mine(decided.select("tokens", F.col("hit.verdict").alias("label")), ws, support, confidence)
    index = mined.select(F.explode("rare").alias("token"), "all", "label", "confidence", "support")

    free = rows.where("hit is null").select(F.monotonically_increasing_id().alias("row"), "page_id", "host", "path", "tokens")
    free = free.select("*", F.explode_outer("tokens").alias("token"))
    met = free.join(index, "token", "left")
    fired = F.forall("all", lambda x: F.arrays_overlap(x, F.col("tokens")))
    best = F.max(F.when(fired, F.struct("confidence", "support", F.size("all").alias("n"), "label")))
    free = met.groupBy("row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), best.alias("best"))
    free = free.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.coalesce("best.label", F.lit(default)).alias("verdict"), F.when(F.col("best").isNull(), "default").otherwise("mined").alias("method"), F.col("best.confidence").alias("confidence"))
    decided = decided.select("page_id", "host", "path", "hit.rule", "hit.verdict", F.lit("rule").alias("method"), F.lit(None).cast("double").alias("confidence"))
    return decided.unionByName(free)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
