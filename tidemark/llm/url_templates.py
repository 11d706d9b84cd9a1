"""URL filter by a tree of path templates.

Paths are cut into segments. Level by level, for each host, a segment becomes a wildcard where it is variable: made of
digits or hexadecimals, or one of many rare ones under its parent. Levels are walked while some branch holds more than
``most_children`` different paths; in smaller ones no segment can be one of many, so the rest of a path is settled at once
and paths keep all their segments.

Every prefix of a template is a node of its host's tree and counts the labels of all pages below it. Siblings at every
level, inner ones too, are put in order of their labelled rates, and each joins the group before it unless the two
proportions differ. A node has the smoothed rate of its group: towards the rate of its parent, at the host towards the
share of bad labels overall. Nodes whose group has fewer than ``least`` labels, or none, back off to their parent's rate.
Urls of templates with a high enough rate are blocked; hosts with fewer than ``least`` labels aren't judged.

Templates are counted with grouping and partial sums, level by level, so that a host of any size is spread by its
segments, and only counts of (host, template) meet.

Explicit rules ("host/path") come before templates: a rule fits its host and all subdomains where the path starts with
the rule's path, and the longest rule wins. The rules are a short list that is part of the program.

Results for odd input: no rows in, no rows out; a null url and one without "://" have an empty host and path and get the
verdict of no template, allow; long urls keep all segments in their template; repeated rows count each; a null page_id
stays null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, only, table

WILD = "*"
#: A segment of the words [a-z_-] with an ending is what it is; digits and hexadecimals vary.
VARIABLE = r"^(\d+|[0-9a-f]{8,}|[0-9a-f-]{32,}|.*\d{3,}.*)(\.\w{1,5})?$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where there is none."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def match_rules(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits. ``rules``: (verdict, "host/path")."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        own_host, _, own_path = text.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith("/" + own_path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def templates(urls: DataFrame, rare: float = 0.02, most_children: int = 30) -> DataFrame:
    """Adds template to ``urls`` (host, path, ...): segments joined by "/", variable ones as wildcards."""
    plain = lambda s: F.when(s.rlike(VARIABLE), F.lit(WILD)).otherwise(s)
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    paths = urls.groupBy("host", "path").agg(F.count("*").alias("n"))
    x = cut(paths.withColumn("_parts", F.transform(parts, plain)).withColumn("template", F.lit("")))
    told, level = [], 0
    while not x.isEmpty():
        x = x.withColumn("_next", F.get("_parts", F.lit(level)))
        # Literal branches: those under parents with few children, or with a share of their own.
        literal = F.col("_next") != WILD
        children = x.where(F.col("_next").isNotNull()).groupBy("host", "template", "_next").agg(F.sum("n").alias("n"), F.count("*").alias("paths"))
        # Aggregates and a join, not a window, so that a directory of any number of children isn't one task.
        parents = children.groupBy("host", "template").agg(F.count(F.when(literal, 1)).alias("_many"), F.sum(F.when(literal, F.col("n"))).alias("_all"), F.sum("paths").alias("_paths"))
        busy = children.join(parents.where(F.col("_paths") > most_children), ["host", "template"])
        loose = literal & (F.col("_many") > most_children) & (F.col("n") < rare * F.col("_all"))
        x = cut(x.join(busy.select("host", "template", "_next", F.coalesce(loose, F.lit(False)).alias("_loose")), ["host", "template", "_next"], "left"))
        rest = F.slice("_parts", F.lit(level + 1), F.greatest(F.size("_parts") - level, F.lit(0)))
        told.append(x.where("_loose IS NULL").select("host", "path", F.concat("template", F.array_join(F.transform(rest, lambda s: F.concat(F.lit("/"), s)), "")).alias("template")))
        branch = F.when(F.col("_loose"), F.lit(WILD)).otherwise(F.col("_next"))
        x = x.where("_loose IS NOT NULL").withColumn("template", F.concat("template", F.lit("/"), branch)).drop("_loose", "_next")
        level += 1
    if not told:
        return urls.withColumn("template", F.lit(""))
    return urls.join(reduce(DataFrame.union, told), ["host", "path"])


def nodes(counts: DataFrame) -> DataFrame:
    """(host, template, bad, labelled, level, node, parent): ``counts`` for each prefix of its template, the host at level 1."""
    parts = F.split("template", "/")
    name = lambda n: F.md5(F.array_join(F.slice(parts, F.lit(1), n), "/"))
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("level"), name(i).alias("node"), name(i - 1).alias("parent")))
    return counts.select(*counts.columns, F.inline(steps))


def merged(tree: DataFrame, z: float = 1.96) -> DataFrame:
    """host, level, node and the bad and labelled of its group: siblings whose labelled rates don't differ.

    ``tree`` (host, level, parent, node, bad, labelled). A parent has few children that aren't wildcards, by ``templates``.
    """
    known = tree.where("labelled > 0")
    sibling = F.struct((F.col("bad") / F.col("labelled")).alias("rate"), "node", "bad", "labelled")
    family = known.groupBy("host", "level", "parent").agg(F.sort_array(F.collect_list(sibling)).alias("siblings"))
    one = lambda bad, labelled, names: F.struct(bad.alias("bad"), labelled.alias("labelled"), names.alias("names"))

    def put(groups: Column, s: Column) -> Column:
        g = F.element_at(groups, -1)
        bad, labelled = g["bad"] + s["bad"], g["labelled"] + s["labelled"]
        rate = bad / labelled
        alike = F.abs(s["rate"] - g["bad"] / g["labelled"]) <= z * F.sqrt(rate * (1 - rate) * (1 / g["labelled"] + 1 / s["labelled"]))
        joined = F.concat(F.slice(groups, F.lit(1), F.size(groups) - 1), F.array(one(bad, labelled, F.concat(g["names"], F.array(s["node"])))))
        return F.when(alike, joined).otherwise(F.concat(groups, F.array(one(s["bad"], s["labelled"], F.array(s["node"])))))

    first = F.col("siblings")[0]
    start = F.array(one(first["bad"], first["labelled"], F.array(first["node"])))
    groups = F.aggregate(F.slice("siblings", F.lit(2), F.size("siblings")), start, put)
    return family.select("host", "level", F.inline(groups)).select("host", "level", F.explode("names").alias("node"), "bad", "labelled")


def rates(counts: DataFrame, least: int, strength: float) -> DataFrame:
    """(host, template, rate) of ``counts`` (host, template, bad, labelled); hosts with fewer than ``least`` labels have no rows."""
    overall = counts.agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled")).first()
    prior = overall["bad"] / overall["labelled"] if overall["labelled"] else 0.0
    steps = nodes(counts)
    groups = merged(steps.groupBy("host", "level", "parent", "node").agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled")))
    groups = groups.where(F.col("labelled") >= least)
    way = steps.select("host", "template", "level", "node").join(groups, ["host", "level", "node"])
    way = way.groupBy("host", "template").agg(F.sort_array(F.collect_list(F.struct("level", "bad", "labelled"))).alias("way"))
    none = F.struct(F.lit(prior).alias("rate"), F.lit(0).cast("long").alias("labelled"))

    def step(above: Column, s: Column) -> Column:
        # The same labels as above tell nothing new.
        own = F.struct(((s["bad"] + strength * above["rate"]) / (s["labelled"] + strength)).alias("rate"), s["labelled"].alias("labelled"))
        return F.when(s["labelled"] == above["labelled"], above).otherwise(own)

    return way.select("host", "template", F.aggregate("way", none, step)["rate"].alias("rate"))


def url_filter(pages: DataFrame, rules: list[tuple[str, str]], labels: DataFrame | None = None, purity: float = 0.8, least: int = 5, strength: float = 4.0) -> DataFrame:
    """page_id, host, path, rule, verdict, template of each row of ``pages`` (page_id, url).

    ``labels`` (page_id, bad as 0 or 1) are what templates are judged by; without them the rules' own verdicts are.
    """
    host, path = host_and_path(F.col("url"))
    x = only(pages, "page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    x = x.withColumn("rule", rule).withColumn("said", verdict)
    if labels is None:
        x = x.withColumn("bad", F.when(F.col("said") == "block", 1).when(F.col("said") == "allow", 0))
    else:
        # Several labels of one page: any bad one counts.
        known = labels.where(labels["bad"].isin(0, 1)).groupBy("page_id").agg(F.max("bad").cast("int").alias("bad"))
        x = x.join(known, "page_id", "left")
    x = cut(templates(x))
    counts = x.groupBy("host", "template").agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count("bad").alias("labelled"))
    rejected = rates(cut(counts), least, strength).where(F.col("rate") >= purity).select("host", "template", F.lit("block").alias("told"))
    out = x.join(rejected, ["host", "template"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", "told", F.lit("allow")).alias("verdict"), "template")


RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), RULES).drop("template")
