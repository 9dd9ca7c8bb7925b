"""URL filter: given host rules first, then association rules mined by FP-growth (built-in functions only).

Given rules are a table: each host of the pages meets those of its suffixes by equality, and a URL takes
the longest that its path begins with.

A URL becomes tokens of all its parts.  Labels are the given rules' verdicts, or a column of the
pages; a URL without a label is unknown, not allowed.  A combination of tokens becomes a rule if at least
``MIN_SUPPORT`` of the labelled URLs (and ``MIN_ROWS``) have it and the label, its confidence there is at
least ``MIN_CONFIDENCE`` and its lift over the whole corpus at least ``MIN_LIFT``: so much oftener than URLs
in general do URLs with these tokens bear the label.  (Where nearly all labels are ``block``, any token of a
labelled host has a high confidence, but only telling ones have the lift.)  Combinations that hold a
shorter rule for the same label go.  Of tokens that stand in the same URLs one is taken.

Rules of one token and of two are counted over all tokens of all URLs.  Spark's FP-growth mines the larger
ones on the labelled URLs, over all of these tokens too; where URLs have so many that their combinations, which
double with each, are too many, a caller may give it the ``items`` of each URL that tell most about labels.  Rules are matched row by row through an inverted index
from token to rules.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut

LABELS = ("block", "allow")
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.01, 0.9, 1.5
#: And so many labelled URLs at least: fewer prove nothing.
MIN_ROWS = 5


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(name: Column) -> Column:
    """A host name and all that is left of it when labels are taken off its front."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, -k, k), "."))


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """(place, verdict, host, path) of a list of rules."""
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rules)], "place long, verdict string, host string, path string")


def fitting(parsed: DataFrame, rules: DataFrame) -> DataFrame:
    """parsed (with columns host and path) with (rule, given): host and path of the longest rule that fits, of equals the last, and its verdict.

    rules: (place, verdict, host, path).  A host gets a list of the rules of its suffixes once, whatever
    its number of pages.
    """
    of_host = rules.select(F.col("host").alias("suffix"), F.struct((F.length("host") + F.length("path")).alias("size"), "place", "path", "verdict", F.concat("host", "path").alias("rule")).alias("r"))
    hosts = parsed.select("host").distinct().select("host", F.explode(suffixes(F.col("host"))).alias("suffix")).join(of_host, "suffix")
    hosts = hosts.groupBy("host").agg(F.collect_list("r").alias("__rules"))
    best = F.array_max(F.filter("__rules", lambda r: F.startswith(F.col("path"), r["path"])))
    wide = parsed.join(hosts, "host", "left").withColumn("__best", best)
    return wide.select(*parsed.columns, F.col("__best.rule").alias("rule"), F.col("__best.verdict").alias("given"))


def tokens(url: Column) -> Column:
    """Distinct tokens of a url and of columns host and path: host suffixes, words of host, path, query and fragment, path segments by place, scheme."""

    def words(kind: str, text: Column) -> Column:
        return F.transform(F.filter(F.split(ascii_lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != ""), lambda x: F.concat(F.lit(f"{kind}:"), x))

    ends = F.transform(suffixes(F.col("host")), lambda x: F.concat(F.lit("host:"), x))
    segments = F.filter(F.split("path", "/"), lambda x: x != "")
    places = F.transform(segments, lambda x, k: F.concat(F.lit("path"), k.cast("string"), F.lit(":"), x))
    rest = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(.*)$", 1)
    scheme = F.concat(F.lit("scheme:"), ascii_lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1)))
    found = F.concat(ends, words("word", F.col("host")), places, words("in", F.col("path")), words("query", rest), F.array(scheme))
    return F.when(F.coalesce(F.col("host"), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(found))


class Mined(NamedTuple):
    """A mined rule; lift is over the whole corpus."""

    tokens: tuple[str, ...]
    label: str
    confidence: float
    lift: float


class Bounds(NamedTuple):
    """What a rule needs: labelled URLs that bear it, confidence, lift."""

    rows: float
    confidence: float
    lift: float


def counted() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("label") == x, 1)).alias(x) for x in LABELS]]


def telling(parsed: DataFrame, least: float) -> list:
    """(token, n, block, allow) of the tokens that ``least`` labelled rows have, most telling first, one of each set of tokens that stand in the same rows.

    At most (tokens of an average labelled url) * (labelled rows) / least of them.  parsed: tokens, label (or null).
    """
    often = parsed.where(F.col("label").isNotNull()).select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") >= least)
    names = [r[0] for r in often.collect()]
    if not names:
        return []
    held = parsed.select(F.explode(F.array_intersect("tokens", F.lit(names))).alias("token"), "label", F.xxhash64("tokens").cast("decimal(38,0)").alias("row"))
    counts = held.groupBy("token").agg(*counted(), F.sum("row").alias("rows")).collect()
    of = parsed.agg(*counted()).first()

    def gain(r: dict) -> float:
        """How much oftener (or seldomer) a label stands with the token than it would by chance, over all labels."""
        return sum(abs(r[x] - r["n"] * of[x] / of["n"]) for x in LABELS)

    one: dict[tuple, dict] = {}
    for r in sorted(counts, key=lambda r: (-gain(r), not r["token"].startswith("word:"), -len(r["token"]), r["token"])):
        one.setdefault((r["n"], r["block"], r["allow"], r["rows"]), r)
    return list(one.values())


def rules_of(counts: list[tuple[tuple[str, ...], dict]], of: dict, bounds: Bounds) -> list[Mined]:
    """The rules among token sets with their counts over all rows; of: the counts of all rows."""
    found = []
    for names, r in counts:
        for label in LABELS:
            bear, known = r[label], sum(r[x] for x in LABELS)
            if bear and bear >= bounds.rows and bear / known >= bounds.confidence and bear * of["n"] / r["n"] / of[label] >= bounds.lift:
                found.append(Mined(tuple(sorted(names)), label, bear / known, bear * of["n"] / r["n"] / of[label]))
    return found


def shortest(rules: list[Mined]) -> list[Mined]:
    """Without those that hold a shorter rule for the same label."""
    kept: list[Mined] = []
    for r in sorted(rules, key=lambda r: (len(r.tokens), r.tokens, r.label)):
        if not any(k.label == r.label and set(k.tokens) <= set(r.tokens) for k in kept):
            kept.append(r)
    return kept


def pairs(parsed: DataFrame, names: list[str], of: dict, bounds: Bounds) -> DataFrame:
    """(a, b, n, block, allow) of all pairs of these tokens that fulfil the bounds for a label, counted over all rows."""
    own = F.array_intersect(F.lit(names), F.col("tokens"))
    both = F.flatten(F.transform(own, lambda a, i: F.transform(F.slice(own, i + 2, F.size(own)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    n = parsed.select("label", F.explode(both).alias("x")).groupBy("x.a", "x.b").agg(*counted())
    known = sum(F.col(x) for x in LABELS)
    good = [(F.col(x) >= bounds.rows) & (F.col(x) >= bounds.confidence * known) & (F.col(x) * of["n"] >= bounds.lift * F.col("n") * of[x]) for x in LABELS if of[x]]
    return n.where(good[0] if len(good) == 1 else good[0] | good[1]) if good else n.limit(0)


def larger(parsed: DataFrame, names: list[str], of: dict, bounds: Bounds, known: list[Mined], items: int | None) -> list[Mined]:
    """The rules of three and more tokens, by FP-growth, that hold none of the known ones for the same label."""
    # array_intersect keeps the order of its first argument: the most telling tokens of each row.
    every = F.array_intersect(F.lit(names), F.col("tokens"))
    own = every if items is None else F.slice(every, 1, items)
    labelled = sum(of[x] for x in LABELS)
    baskets = parsed.where(F.col("label").isNotNull()).select(F.concat(own, F.array(F.concat(F.lit("label:"), "label"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, bounds.rows / labelled), minConfidence=bounds.confidence).fit(baskets)
    rules = model.associationRules.where(F.element_at("consequent", 1).startswith("label:") & ~F.exists("antecedent", lambda x: x.startswith("label:")) & (F.size("antecedent") > 2))
    rules = rules.select(F.array_sort("antecedent").alias("a"), F.expr("substring(consequent[0], 7)").alias("label"))
    for label in LABELS:
        held = [F.size(F.array_intersect("a", F.lit(list(k.tokens)))) == len(k.tokens) for k in known if k.label == label]
        for k in range(0, len(held), 200):  # rules known for the label, in groups that a plan can hold
            rules = rules.where((F.col("label") != label) | ~F.greatest(F.lit(False), *held[k : k + 200]))
    rules = cut(rules.withColumn("rule", F.monotonically_increasing_id()))
    # All rows count: sets of items, fewer than rows, meet the rules through their items.
    sets = cut(parsed.select(every.alias("items"), "label").groupBy("items", "label").agg(F.count(F.lit(1)).alias("c")).withColumn("set", F.monotonically_increasing_id()))
    postings = rules.select("rule", F.size("a").alias("size"), F.explode("a").alias("item"))
    hits = sets.select("set", F.explode("items").alias("item")).join(postings, "item").groupBy("set", "rule", "size").agg(F.count(F.lit(1)).alias("hit")).where("hit = size")
    sums = [F.sum("c").alias("n"), *[F.sum(F.when(F.col("label") == x, F.col("c")).otherwise(0)).alias(x) for x in LABELS]]
    n = hits.join(sets.select("set", "label", "c"), "set").groupBy("rule").agg(*sums).join(rules.select("rule", "a"), "rule")
    return rules_of([(tuple(r["a"]), r) for r in n.collect()], of, bounds)


def mine(parsed: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, items: int | None = None) -> list[Mined]:
    """The mined rules, without those that hold a shorter one for the same label; parsed: tokens, label (or null)."""
    of = parsed.agg(*counted()).first()
    bounds = Bounds(max(min_support * sum(of[x] for x in LABELS), MIN_ROWS), min_confidence, min_lift)
    single = telling(parsed, bounds.rows)
    if not single:
        return []
    names = [r["token"] for r in single]
    found = rules_of([((r["token"],), r) for r in single], of, bounds)
    found = shortest(found + rules_of([((r["a"], r["b"]), r) for r in pairs(parsed, names, of, bounds).collect()], of, bounds))
    return shortest(found + larger(parsed, names, of, bounds, found, items))


def fires(mined: list[Mined]) -> Column:
    """The label of the longest mined rule whose tokens column tokens holds (of two, allow), or null, by an inverted index from token to rules."""
    if not mined:
        return F.lit(None).cast("string")
    index: dict[str, list[int]] = {}
    for k, rule in enumerate(mined):
        for t in rule.tokens:
            index.setdefault(t, []).append(k)
    lookup = F.create_map(*[x for t, ks in sorted(index.items()) for x in (F.lit(t), F.lit(ks))])
    sizes, ranks = F.lit([len(r.tokens) for r in mined]), F.lit([2 * len(r.tokens) + (r.label == "allow") for r in mined])
    known = F.array_intersect("tokens", F.lit(sorted(index)))
    hits = F.flatten(F.transform(known, lambda t: F.element_at(lookup, t)))

    def best(found: Column) -> Column:
        whole = F.filter(F.array_distinct(found), lambda k: F.size(F.filter(found, lambda x: x == k)) == F.get(sizes, k))
        return F.array_max(F.transform(whole, lambda k: F.get(ranks, k)))

    top = F.transform(F.array(hits), best)[0]
    return F.when(top % 2 == 1, F.lit("allow")).when(top.isNotNull(), F.lit("block"))


def judge(pages: DataFrame, rules: list[Rule] | DataFrame, id_col: str = "page_id", url_col: str = "url", label_col: str | None = None, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, items: int | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, mined) for each row; mined: no given rule fits and a mined one decides.

    rules: a list, or a table (place, verdict, host, path) of any size.  label_col: a column of more labels,
    block or allow (anything else: unknown), for URLs that no given rule fits; only mining uses it.  items:
    a bound, see the module; None: none.  A null url, or one without ``://``, has an empty host and path
    and no tokens; where no rule fits, the verdict is allow.  Rows may repeat (each counts); ids may be null;
    urls of any length are taken whole; other columns are ignored; an empty table gives no rows.
    """
    url = F.col(url_col).cast("string")
    more = F.lit(None).cast("string") if label_col is None else F.when(F.col(label_col).isin(*LABELS), F.col(label_col).cast("string"))
    given = rules if isinstance(rules, DataFrame) else rule_table(pages.sparkSession, rules)
    parsed = fitting(pages.select(F.col(id_col).alias("id"), host(url).alias("host"), path(url).alias("path"), F.coalesce(url, F.lit("")).alias("whole"), more.alias("more")), given)
    parsed = cut(parsed.select("id", "host", "path", "rule", "given", "more", tokens(F.col("whole")).alias("tokens")))
    learn = parsed.select("tokens", F.coalesce("given", "more").alias("label"))
    out = parsed.withColumn("fired", F.when(F.col("given").isNull(), fires(mine(learn, min_support, min_confidence, min_lift, items))))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("given", "fired", F.lit("allow")).alias("verdict"), F.col("fired").isNotNull().alias("mined"))
