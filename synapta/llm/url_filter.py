"""URL filter: rules on hosts and paths first, then gradient-boosted trees on lexical features, all as DataFrame expressions.

The trees learn from URLs that have a label (here: a rule's verdict). Each level of a tree is one aggregation of gradients by
(leaf, feature, bin); the driver sees such sums only, picks the splits, and the trees become CASE expressions that score every row
inside the scan's own stage.
"""

from __future__ import annotations

import functools
import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from synapta.llm.common import materialise, table

#: Fixed rules of the query: verdict and host/path prefix.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: At most so many labelled URLs are learnt from, those of the least hash.
SAMPLE_ROWS = 20_000
TREES, DEPTH, RATE, LAMBDA, BINS = 12, 3, 0.3, 1.0, 16
#: Labels of a host that its suffixes have, and what a suffix's share of blocked URLs is drawn towards the mean with.
LEVELS, SMOOTH = (1, 2, 3), 5.0
#: Rows of a table of suffixes or hosts that may be broadcast; beyond it is shuffled.
SMALL = 200_000

FEATURES = [
    "length", "host_length", "path_length", "labels", "depth", "digit_ratio", "entropy", "parameters", "query_length", "fragment", "hyphens",
    *(f"{x}{k}" for k in LEVELS for x in ("seen", "blocked")),
]


def parsed(urls: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with host (A-Z lowered) and path; a null url or one without '://' has neither."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return urls.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))


def ruled(urls: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``rule`` and ``ruling`` (allow or block): the longest rule whose host is the URL's host or above it and whose path the URL's
    path starts with; null where none fits. Of equal rules the first counts."""
    found = verdict = F.lit(None).cast("string")
    for said, rule in rules:
        name, slash, rest = rule.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(slash + rest)
        longer = fits & (found.isNull() | (F.length(found) < len(rule)))
        found, verdict = F.when(longer, F.lit(rule)).otherwise(found), F.when(longer, F.lit(said)).otherwise(verdict)
    return urls.withColumn("rule", found).withColumn("ruling", verdict)


def entropy(text: Column) -> Column:
    """Bits a character of a text, 0 of an empty one: run lengths of its sorted characters, in one pass."""
    n = F.char_length(text).cast("double")
    chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    start = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    closed = lambda s: s["sum"] + F.when(s["run"] > 0, s["run"] * F.log2(s["run"])).otherwise(0.0)
    step = lambda s, c: F.when(s["c"] == c, F.struct(c.alias("c"), (s["run"] + 1).alias("run"), s["sum"].alias("sum"))).otherwise(F.struct(c.alias("c"), F.lit(1.0).alias("run"), closed(s).alias("sum")))
    return F.when(n > 0, F.greatest(F.log2(n) - F.aggregate(chars, start, step, closed) / n, F.lit(0.0))).otherwise(0.0)


def lexical(urls: DataFrame, url: str = "url") -> DataFrame:
    """``x``: a struct of the features that the text of a URL has by itself."""
    u = F.coalesce(F.col(url), F.lit(""))
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    num = lambda c: c.cast("double")
    return urls.withColumn("x", F.struct(
        num(F.char_length(u)).alias("length"), num(F.char_length("host")).alias("host_length"), num(F.char_length("path")).alias("path_length"),
        num(F.when(F.col("host") == "", 0).otherwise(F.size(F.split("host", r"\.")))).alias("labels"), num(F.regexp_count("path", F.lit("[^/]+"))).alias("depth"),
        F.coalesce(F.try_divide(num(F.regexp_count(u, F.lit("[0-9]"))), num(F.char_length(u))), F.lit(0.0)).alias("digit_ratio"), entropy(u).alias("entropy"),
        num(F.regexp_count(query, F.lit("[^&]+"))).alias("parameters"), num(F.char_length(query)).alias("query_length"), num(F.instr(u, "#") > 0).alias("fragment"), num(F.regexp_count("host", F.lit("-"))).alias("hyphens"),
    ))


def _suffixes(host: Column) -> Column:
    parts = F.split(host, r"\.")
    return F.array(*(F.array_join(F.slice(parts, F.greatest(F.size(parts) - k + 1, F.lit(1)), F.lit(k)), ".") for k in LEVELS))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


def host_statistics(rows: DataFrame, sample: DataFrame) -> DataFrame:
    """(host, stats): for each level of suffix how many of all ``rows`` have it, and of the ``sample`` how many and how many blocked.

    Rows are counted by host first, so that a suffix or host of a third of all rows is one row a task in every shuffle.
    """
    hosts = rows.groupBy("host").agg(F.count("*").alias("n"))
    each = materialise(hosts.select("host", "n", F.posexplode(_suffixes(F.col("host"))).alias("k", "suffix")), "suffixes")
    learnt = sample.select("y", F.posexplode(_suffixes(F.col("host"))).alias("k", "suffix")).groupBy("k", "suffix").agg(F.count("*").alias("m"), F.sum("y").alias("b"))
    counts = each.groupBy("k", "suffix").agg(F.sum("n").alias("all")).join(_small(learnt), ["k", "suffix"], "left").na.fill(0, ["m", "b"])
    counts = materialise(counts, "suffix-counts")
    fields = [F.max(F.when(F.col("k") == i, F.struct(F.col("all").cast("double").alias("n"), F.col("m").cast("double").alias("m"), F.col("b").cast("double").alias("b")))).alias(f"s{k}") for i, k in enumerate(LEVELS)]
    return materialise(each.drop("n").join(_small(counts), ["k", "suffix"]).groupBy("host").agg(*fields), "hosts")


def _features(rows: DataFrame, prior: float, own: Column | None = None) -> DataFrame:
    """The features as columns f0, f1, ...; ``own``: the label of a row of the sample, which is left out of its suffixes' shares."""
    out = {name: F.col(f"x.{name}") for name in FEATURES if not name.startswith(("seen", "blocked"))}
    for k in LEVELS:
        m, b = F.col(f"s{k}.m"), F.col(f"s{k}.b")
        if own is not None:
            m, b = m - 1, b - own
        out[f"seen{k}"] = F.log1p(F.col(f"s{k}.n"))
        out[f"blocked{k}"] = (b + SMOOTH * prior) / (m + SMOOTH)
    return rows.withColumns({f"f{i}": out[name] for i, name in enumerate(FEATURES)})


# --- boosted trees --------------------------------------------------------------------------------------------------

#: A tree: a leaf's value, or (feature, edge, left, right); rows of a feature up to the edge go left.
Tree = float | tuple


def tree_column(tree: Tree) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, edge, left, right = tree
    return F.when(F.col(f"f{f}") <= edge, tree_column(left)).otherwise(tree_column(right))


def margin(model: tuple[float, list[Tree]]) -> Column:
    return functools.reduce(lambda a, t: a + tree_column(t), model[1], F.lit(model[0]))


def best_split(sums: dict[tuple[int, int], tuple[float, float]], edges: list[list[float]]) -> tuple | None:
    """(feature, edge, (g, h) left, (g, h) right) of the greatest gain, the first on ties; None without gain."""
    best, least = None, 1e-6
    for f, cuts in enumerate(edges):
        bins = [sums.get((f, b), (0.0, 0.0)) for b in range(len(cuts) + 1)]
        g, h = sum(x for x, _ in bins), sum(x for _, x in bins)
        gl = hl = 0.0
        for b, edge in enumerate(cuts):
            gl, hl = gl + bins[b][0], hl + bins[b][1]
            gain = gl * gl / (hl + LAMBDA) + (g - gl) ** 2 / (h - hl + LAMBDA) - g * g / (h + LAMBDA)
            if round(gain, 6) > least and min(hl, h - hl) > 1e-3:
                best, least = (f, edge, (gl, hl), (g - gl, h - hl)), round(gain, 6)
    return best


def grow(level, edges: list[list[float]], depth: int = DEPTH) -> Tree:
    """A tree from ``level``, which gives the sums of (g, h) by (feature, bin) of each leaf of a tree whose leaves are numbers."""
    value = lambda s: -RATE * s[0] / (s[1] + LAMBDA)
    nodes = {1: None}  # as in a heap: children of i are 2i and 2i + 1
    whole: dict[int, tuple] = {}

    def tree(i: int, leaf) -> Tree:
        return (*nodes[i][:2], tree(2 * i, leaf), tree(2 * i + 1, leaf)) if nodes.get(i) else leaf(i)

    open_ = [1]
    for _ in range(depth):
        got = level(tree(1, float)) if open_ else {}
        new = []
        for i in open_:
            if i == 1:
                one = [v for (f, _), v in got.get(1, {}).items() if f == 0]
                whole[1] = (sum(g for g, _ in one), sum(h for _, h in one))
            split = best_split(got.get(i, {}), edges)
            nodes[i] = split
            if split:
                whole[2 * i], whole[2 * i + 1] = split[2:]
                new += [2 * i, 2 * i + 1]
        open_ = new
    return tree(1, lambda i: value(whole[i]))


def learn(sample: DataFrame, trees: int = TREES, depth: int = DEPTH) -> tuple[float, list[Tree]]:
    """Boosted trees of logistic loss on f0, f1, ... and y (0 or 1). ``sample`` is a written table of bounded size.

    Bins are cut at quantiles; each level is one job of sums by (leaf, feature, bin), of which at most 2**depth * features * bins
    come to the driver.
    """
    names = [f"f{i}" for i in range(len(FEATURES))]
    at = F.array(*(F.lit(i / BINS) for i in range(1, BINS)))
    first = sample.agg(F.count("*").alias("n"), F.sum("y").alias("y"), *(F.percentile(c, at).alias(c) for c in names)).first()
    if not first["n"]:
        return 0.0, []
    base = math.log((first["y"] + 1) / (first["n"] - first["y"] + 1))
    edges = [sorted(set(first[c])) for c in names]
    bins = [functools.reduce(lambda a, e, c=c: a + (F.col(c) > e).cast("int"), cuts, F.lit(0)) for c, cuts in zip(names, edges)]
    data = materialise(sample.select("y", *names, F.array(*bins).alias("bins")), "binned")
    model: tuple[float, list[Tree]] = (base, [])
    for _ in range(trees):

        def level(tree: Tree) -> dict:
            p = 1 / (1 + F.exp(-margin(model)))
            rows = data.select(tree_column(tree).cast("int").alias("leaf"), (p - F.col("y")).alias("g"), (p * (1 - p)).alias("h"), F.posexplode("bins").alias("f", "bin"))
            out: dict = {}
            for r in rows.groupBy("leaf", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                out.setdefault(r.leaf, {})[r.f, r.bin] = (r.g, r.h)
            return out

        model[1].append(grow(level, edges, depth))
    return model


def filter_urls(urls: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url: str = "url", bound: int = SAMPLE_ROWS) -> DataFrame:
    """(id, host, path, rule, verdict, score): a rule's verdict where one fits, else block if the trees' score is above 0.5.

    Learns from at most ``bound`` URLs that a rule judges; suffixes are counted over all. A null url has an empty host and path and is
    judged by its features like any other; equal rows are judged alike, each for itself; other columns do no harm; URLs of any length are read whole. Without any
    labelled URL the score is 0.5, which allows. An empty table gives no rows.
    """
    rows = ruled(parsed(urls.select(F.col(id_col), F.col(url).cast("string").alias("url"))), rules)
    named = lexical(rows.where("rule is not null")).select("host", "x", F.when(F.col("ruling") == "block", 1.0).otherwise(0.0).alias("y"), F.xxhash64("url", id_col).alias("_h"))
    sample = materialise(named.orderBy("_h").limit(bound).drop("_h"), "labelled")
    prior = (sample.agg(((F.sum("y") + 1) / (F.count("*") + 2)).alias("p")).first() or [0.5])[0] or 0.5
    hosts = host_statistics(rows.select("host"), sample)
    few = _small(hosts)
    model = learn(materialise(_features(sample.join(few, "host"), prior, F.col("y")), "features"))
    told = _features(lexical(rows).join(few, "host"), prior)
    score = (1 / (1 + F.exp(-margin(model)))).alias("score")
    told = told.select(id_col, "host", "path", "rule", "ruling", score)
    return told.select(id_col, "host", "path", "rule", F.coalesce("ruling", F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), RULES)
