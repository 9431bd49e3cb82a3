"""URL filters by a path-template tree, in DataFrame functions only.

Each host has a tree of path segments, as deep as its paths. A segment that is a number, or a long
hexadecimal name, is a wildcard; so is every child of a node whose children are many and mostly seen once or
twice. Rules label the URLs that they fit. A branch whose rate of allowed among labelled URLs, all that lies below counted,
doesn't differ from that of the node above it beyond chance is merged with it, and so on down the tree.
What is merged shares its labels: its purity is the rate of allowed URLs, smoothed towards one half. Impure
templates are blocked. A template without a label of its own has nothing to be similar by: nothing speaks
against it, and it is allowed. A fitting rule wins over the template.

The tree is walked level by level, only where a node has enough shapes below it for variable children.
Copies of a template are summed before anything is dealt out, so a host with a third of all URLs
is a few rows; the join that carries templates back to URLs may be split.

Cases: a null URL, or one without ://, has an empty host and path and gets the verdict of the
empty template; without any rule that fits, all is allowed; repeated rows and keys keep their own
row; an empty table gives none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideway.llm.common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VARIABLE = r"^([0-9]+(\.[A-Za-z0-9]+)?|[0-9A-Fa-f]{8,})$"
#: Children of a node are variable if there are more than this and each is seen fewer times on average.
MANY, SEEN = 8, 4
#: Weight of the smoothing, what rates are smoothed towards, standard deviations that part a branch from its node, and the least purity of an allowed template.
SMOOTH, NEUTRAL, APART, PURE = 4.0, 0.5, 1.96, 0.5

Rule = tuple[str, str]  # ("allow" or "block", "host/path")


def host_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def _rest(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def fits(rule: str, host: Column, path: Column) -> Column:
    name, _, start = rule.partition("/")
    return ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")


def decide(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule that wins or null, its verdict or null): of those that fit the longest."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        rule = F.when(fits(r, host, path), r).otherwise(rule)
        verdict = F.when(fits(r, host, path), v).otherwise(verdict)
    return rule, verdict


def read(pages: DataFrame, rules: list[Rule], key: str, url: str) -> DataFrame:
    x = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, given = decide(rules, F.col("host"), F.col("path"))
    # Wildcards stand where a segment tells by itself that it varies.
    parts = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), lambda s: F.regexp_replace(s, VARIABLE, "*"))
    return x.withColumns({"rule": rule, "given": given, "shape": F.concat_ws("/", parts)})


def templates(shapes: DataFrame) -> DataFrame:
    """(host, shape, template) with n, allow and labelled; shapes: (host, shape, n, allow, labelled), distinct."""
    rows = shapes.withColumn("parts", F.when(F.col("shape") == "", F.array().cast("array<string>")).otherwise(F.split("shape", "/"))).withColumn("node", F.lit(""))
    done, depth = [], 1
    while True:
        # Fewer shapes than that have no node with so many children below.
        wide = rows.groupBy("host", "node").agg(F.count("*").alias("below")).filter(F.col("below") > MANY).select("host", "node", F.lit(True).alias("wide"))
        marked = materialise(rows.join(wide, ["host", "node"], "left").withColumn("open", F.col("wide").isNotNull() & (F.size("parts") >= depth)).drop("wide"), "template-level")
        rest = F.when(F.size("parts") >= depth, F.slice("parts", depth, F.size("parts"))).otherwise(F.array().cast("array<string>"))
        done.append(marked.filter(~F.col("open")).select("host", "shape", "n", "allow", "labelled", F.concat_ws("/", "node", rest).alias("template")))
        going = marked.filter("open")
        if going.isEmpty():
            return reduce(DataFrame.unionByName, done)
        here = going.withColumn("part", F.element_at("parts", F.lit(depth)))
        children = here.groupBy("host", "node", "part").agg(F.sum("n").alias("n"))
        variable = children.groupBy("host", "node").agg(F.count("*").alias("k"), F.sum("n").alias("all")).filter((F.col("k") > MANY) & (F.col("all") < SEEN * F.col("k"))).select("host", "node", F.lit("*").alias("star"))
        rows = here.join(variable, ["host", "node"], "left").withColumn("node", F.concat_ws("/", "node", F.coalesce("star", "part"))).drop("part", "star", "open")
        depth += 1


def purities(tree: DataFrame) -> DataFrame:
    """(host, template, purity), after merging branches."""
    leaves = materialise(tree.groupBy("host", "template").agg(F.sum("allow").cast("double").alias("a"), F.sum("labelled").cast("double").alias("m")), "leaves")
    # Every node above a template and itself, by digests of their segments; the root is the first.
    parts = F.split("template", "/")
    ids = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.xxhash64(F.slice(parts, 1, i)))
    nodes_of = leaves.withColumn("ids", ids).select("host", "template", "a", "m", "ids", F.posexplode("ids").alias("d", "node")).withColumn("up", F.when(F.col("d") > 0, F.element_at("ids", F.greatest(F.col("d"), F.lit(1))))).drop("ids")
    nodes = materialise(nodes_of.groupBy("host", "node").agg(F.min("up").alias("up"), F.sum("a").alias("a"), F.sum("m").alias("m")), "nodes")
    above = nodes.select("host", F.col("node").alias("up"), F.col("a").alias("pa"), F.col("m").alias("pm"))
    rate = (F.col("pa") + NEUTRAL * SMOOTH) / (F.col("pm") + SMOOTH)
    apart = F.abs(F.col("a") - F.col("m") * rate) > APART * F.sqrt(F.col("m") * rate * (1 - rate))
    cuts = nodes.join(above, ["host", "up"]).filter((F.col("m") > 0) & apart).select("host", "node")
    # What a template is merged into is the deepest node at or above it that is apart from the one above.
    tops = nodes_of.join(cuts, ["host", "node"]).groupBy("host", "template").agg(F.max_by("node", "d").alias("top"))
    merged = materialise(leaves.join(tops, ["host", "template"], "left").withColumn("top", F.coalesce("top", F.lit(0).cast("long"))), "merged")
    pure = merged.groupBy("host", "top").agg(((F.sum("a") + SMOOTH * NEUTRAL) / (F.sum("m") + SMOOTH)).alias("purity"))
    return merged.join(pure, ["host", "top"]).select("host", "template", F.when(F.col("m") > 0, F.col("purity")).otherwise(NEUTRAL).alias("purity"))


def judge(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, template) of every row."""
    rows = read(pages, rules, key, url)
    shapes = rows.groupBy("host", "shape").agg(F.count("*").alias("n"), F.sum(F.when(F.col("given") == "allow", 1).otherwise(0)).alias("allow"), F.sum(F.when(F.col("given").isNotNull(), 1).otherwise(0)).alias("labelled"))
    tree = templates(materialise(shapes, "shapes"))
    found = tree.join(purities(tree), ["host", "template"]).select("host", "shape", "template", F.when(F.col("purity") < PURE, "block").otherwise("allow").alias("learned"))
    out = rows.join(materialise(found, "verdicts"), ["host", "shape"])
    return out.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("given", "learned").alias("verdict"), "template")
