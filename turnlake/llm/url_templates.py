"""URL filter by rules and by a tree of path templates. DataFrame functions only.

Each host's paths form a tree of segments. Segments that vary are generalised: numbers and hexadecimal runs by their form,
others where a node has more children than FANOUT and few pages for each. From the leaves up, children of a node whose
labelled pages do not differ significantly from those of their siblings are merged. Levels are settled in rounds, and a host
takes part in those only at which it can change: no node has more than FANOUT children where no more forms of the host are
that long, and no child differs significantly where the host has no more than Z ^ 2 labelled pages. So a few very long
paths add no round. A template is rejected when the
smoothed share of bad pages among its labelled ones reaches REJECT. Rules come before templates.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlake.llm.shared import hot_join, staged, unstaged

#: The rules as (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: A node with more distinct children than this, and fewer pages for each than SUPPORT, has a wildcard instead.
FANOUT, SUPPORT = 50, 5
#: Standard errors from which a child differs from its siblings; weight of the overall share in the smoothed one; share to reject.
Z, PRIOR_PAGES, REJECT = 1.96, 10.0, 0.5
WILD, MERGED = "<*>", "<~>"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def matching_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, as host and path joined; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for what, at, below in sorted(rules, key=lambda x: len(x[1] + x[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(below)
        rule, verdict = F.when(fits, F.lit(at + below)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def lexical_segments(path: Column) -> Column:
    """Segments of a whole path with numbers and hexadecimal runs generalised."""

    def form(segment: Column) -> Column:
        hexadecimal = segment.rlike("^(?=.*[0-9])(?=.*[a-f])[0-9a-f-]{8,}$")
        return F.when(hexadecimal, F.lit("<h>")).otherwise(F.regexp_replace(segment, "[0-9]+", "<n>"))

    return F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), form)


def _with_segment(column: str, depth: int, new: Column) -> Column:
    return F.transform(F.col(column), lambda x, i: F.when(i == depth, new).otherwise(x))


def _by_parent(templates: DataFrame, depth: int) -> DataFrame:
    """The templates that reach below depth, with their parent node and their child segment of it."""
    return templates.where(F.size("template") > depth).withColumns(
        {"parent": F.to_json(F.struct("host", F.slice("template", 1, depth).alias("t"))), "child": F.element_at("template", depth + 1)}
    )


def _told_apart(templates: DataFrame) -> int:
    """Levels down to the deepest at which paths of one host differ; below it there is nothing to generalise or to merge."""
    segments = templates.select("host", F.posexplode("forms").alias("depth", "segment"))
    differ = segments.groupBy("host", "depth").agg((F.min("segment") != F.max("segment")).alias("differ")).where("differ")
    return (differ.agg(F.max("depth")).first()[0] or 0) + 1


def with_levels(templates: DataFrame) -> DataFrame:
    """templates, staged, with the levels of their host at which wildcards can arise (wild_levels) and children can differ (own_levels), from the root down.

    A score for two proportions is at most the root of the number of labelled pages, so Z ^ 2 of them never differ.
    """
    sizes = templates.groupBy("host", F.size("template").alias("size")).agg(F.count("*").alias("n"), F.sum("labelled").alias("m"))
    longer = Window.partitionBy("host").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    reach = sizes.withColumns({"n_up": F.sum("n").over(longer), "m_up": F.sum("m").over(longer)})
    deepest = lambda test: F.coalesce(F.max(F.when(test, F.col("size"))), F.lit(0))
    hosts = reach.groupBy("host").agg(deepest(F.col("n_up") > FANOUT).alias("wild_levels"), deepest(F.col("m_up") > Z * Z).alias("own_levels"), F.sum("n").alias("rows"))
    return staged(hot_join(templates, hosts, ["host"], F.xxhash64("host", "forms"), count="rows", total=templates.count()).drop("rows"))


def _all_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def generalised(templates: DataFrame) -> list[DataFrame]:
    """templates of with_levels() with wildcards for children that vary, from the root down, as staged parts; a host leaves the rounds at its last level."""
    total, ends = templates.count(), {r[0] for r in templates.select("wild_levels").distinct().collect()}
    settled, open_ones = [staged(templates.where("wild_levels = 0"))], staged(templates.where("wild_levels > 0"))
    unstaged(templates)
    for depth in range(max(ends, default=0)):
        below = _by_parent(open_ones, depth)
        nodes = below.groupBy("parent", "child").agg(F.sum("pages").alias("pages"), F.count("*").alias("rows"))
        nodes = nodes.groupBy("parent").agg(F.count("*").alias("children"), F.sum("pages").alias("of_all"), F.sum("rows").alias("rows"))
        varies = (F.col("children") > FANOUT) & (F.col("of_all") < SUPPORT * F.col("children"))
        changed = hot_join(below, nodes, ["parent"], F.xxhash64("host", "forms"), count="rows", total=total).withColumn("template", F.when(varies, _with_segment("template", depth, F.lit(WILD))).otherwise(F.col("template")))
        last, open_ones = open_ones, staged(changed.select(open_ones.columns).unionByName(open_ones.where(F.size("template") <= depth)))
        unstaged(last)
        if depth + 1 in ends:
            settled.append(staged(open_ones.where(F.col("wild_levels") == depth + 1)))
            last, open_ones = open_ones, staged(open_ones.where(F.col("wild_levels") > depth + 1))
            unstaged(last)
    unstaged(open_ones)
    return settled


def merged(parts: list[DataFrame], told_apart: int) -> list[DataFrame]:
    """The templates of generalised() with children merged that do not differ from their siblings, from the leaves up, as staged parts; a host enters the rounds at its deepest level.

    A child's share of bad pages is held against that of all its siblings by the z-score for two proportions; a child
    with no labelled page does not differ. Above told_apart no two paths of a host are the same but for deeper segments,
    so what lies below it stays as it is.
    """
    templates = _all_of(parts)
    deeper = F.transform("template", lambda x, i: F.when((i >= F.col("own_levels")) & (i < told_apart), F.lit(MERGED)).otherwise(x))
    waiting = staged(templates.withColumn("template", deeper))
    unstaged(*parts)
    total, begins = waiting.count(), {r[0] for r in waiting.select("own_levels").distinct().collect()}
    open_ones = staged(waiting.limit(0))
    for depth in reversed(range(max(begins, default=0))):
        if depth + 1 in begins:
            last, open_ones = open_ones, staged(open_ones.unionByName(waiting.where(F.col("own_levels") == depth + 1)))
            unstaged(last)
        below = _by_parent(open_ones, depth)
        child = below.groupBy("parent", "child").agg(F.sum("labelled").alias("m"), F.sum("bad").alias("k"), F.count("*").alias("rows"))
        node = child.groupBy("parent").agg(F.sum("m").alias("m_all"), F.sum("k").alias("k_all"))
        share, one = F.try_divide("k_all", "m_all"), F.lit(1.0)
        others = F.col("m_all") - F.col("m")
        error = F.sqrt(share * (1 - share) * (F.try_divide(one, F.col("m")) + F.try_divide(one, others)))
        gap = F.try_divide("k", "m") - F.try_divide(F.col("k_all") - F.col("k"), others)
        own = F.when((F.col("m") > 0) & (others > 0) & (error > 0), F.abs(gap) > Z * error).otherwise(F.lit(False))
        alike = child.join(node, "parent").select("parent", "child", own.alias("own"), "rows")
        changed = hot_join(below, alike, ["parent", "child"], F.xxhash64("host", "forms"), count="rows", total=total).withColumn("template", F.when(F.col("own") | F.lit(depth >= told_apart), F.col("template")).otherwise(_with_segment("template", depth, F.lit(MERGED))))
        last, open_ones = open_ones, staged(changed.select(open_ones.columns).unionByName(open_ones.where(F.size("template") <= depth)))
        unstaged(last)
    done = staged(waiting.where("own_levels = 0"))
    unstaged(waiting)
    return [done, open_ones]


def judge(pages: DataFrame, labelled: DataFrame, rules: tuple = RULES) -> DataFrame:
    """One row (page_id, host, path, rule, verdict, template, purity) for each row of pages (page_id, url).

    labelled (label_id, bad): bad is 1 for a bad page; label_id is the number in the url's last segment that has one. A
    null url has an empty host and path and is judged as such; null page ids stay; repeated rows are judged alike; labels
    given several times count as bad if one of them is; an empty table gives an empty one; other columns are not read,
    so their names cannot clash. The table of templates has a row for each host and form of path, not for each page.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("forms", lexical_segments(F.col("path")))
    parsed = parsed.withColumn("label_id", F.regexp_extract("path", r"([0-9]{1,18})[^/0-9]*/?$", 1).try_cast("long"))
    known = labelled.where(F.col("label_id").isNotNull()).groupBy("label_id").agg(F.max("bad").cast("long").alias("bad"))
    by = F.xxhash64("page_id", "path")
    counted = staged(
        hot_join(parsed, known, ["label_id"], by, "left")
        .groupBy("host", "forms")
        .agg(F.count("*").alias("pages"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        .withColumn("template", F.col("forms"))
    )
    overall, total = counted.agg(F.try_divide(F.sum("bad"), F.sum("labelled")), F.sum("pages")).first()
    overall = overall or 0.0
    parts = merged(generalised(with_levels(counted)), _told_apart(counted))
    tree = _all_of(parts)
    sums = tree.groupBy("host", "template").agg(F.sum("labelled").alias("m"), F.sum("bad").alias("k"))
    purity = (F.col("k") + PRIOR_PAGES * overall) / (F.col("m") + PRIOR_PAGES)
    named = staged(tree.select("host", "forms", "template", "pages").join(sums.select("host", "template", purity.alias("purity")), ["host", "template"]))
    unstaged(counted, *parts)
    rule, ruled = matching_rule(F.col("host"), F.col("path"), rules)
    return hot_join(parsed, named, ["host", "forms"], by, count="pages", total=total).select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(ruled, F.when(F.col("purity") >= REJECT, "block").otherwise("allow")).alias("verdict"),
        F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"),
        "purity",
    )


def op7_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judge() over pages: the number that ends a url is the id of the document that the page shows (its language and text agree), so its labels are the page's."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = F.greatest(F.coalesce("toxic", F.lit(0)), 1 - F.coalesce("quality", F.lit(1)))
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), labels.select(F.col("doc_id").alias("label_id"), bad.alias("bad")))
