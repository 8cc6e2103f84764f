"""URL filter: explicit rules, then a path-template tree judged by labelled purity.

*Rules.*  A rule is a host with the start of a path; it fits that host and all its
subdomains where the url's path starts with its own.  The longest fitting rule's
verdict holds.

*Tree.*  Each host's paths make a tree of segments, as deep as they go.  Level by
level, the segments below a node are variable, and become one wildcard branch, when
the node has many distinct ones for its pages; where no node of a level has as many
paths as that takes, all that is deeper is literal.  Branches of one host that have
the same shape (same wildcard and literal positions) are merged into their best
labelled sibling, the lead, where they are statistically similar: a labelled branch
unless a two-proportion test tells the labelled rates apart, and an unlabelled one
that has a wildcard unless such tests tell its structure apart from the lead's, in the
share of paths that end in a number and in the share of distinct paths among pages.
A lead lends its rate to unlabelled branches only if it has ``min_labelled`` labelled
pages.  A class's purity is its bad share among labelled pages, smoothed towards the
overall share; pages of classes at or above ``reject`` are blocked, all others
allowed.  Labelled pages are those a rule judges, and any (url, bad) rows given.

Only DataFrame expressions are used.  Pages are first reduced to distinct (host,
path) pairs map-side; a level's statistics are map-side aggregated counts.  What a
node, a template or a url is told comes back to the rows by its key and a salt of the
row, so a hot host, template or url spreads over tasks.

Nulls: a url that is null or has no ``://`` has an empty host and path, which no
rule fits; such pages make a host of their own.  Ties between equally long rules
go to the one listed first.  Repeated rows are judged each; an empty table gives
an empty result; other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import answered
from edgeloom.operators.stars import SALTS
from edgeloom.plans.lineage import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: First "://" of the whole url, then the host and the path.
PARTS = r"^(?s:.*?)://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rules(lines: list[str]) -> list[Rule]:
    """Rules from lines like ``block com/en/``."""
    out = []
    for line in lines:
        verdict, place = line.split(None, 1)
        host, slash, path = place.partition("/")
        out.append(Rule(verdict, host.lower(), slash + path))
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    whole = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(whole, PARTS, 1), UPPER, LOWER), F.regexp_extract(whole, PARTS, 2)


def rule_of(host: Column, path: Column, given: list[Rule]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, else nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(reversed(given), key=lambda r: len(r.text)):  # later ones win: longer, or listed earlier
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def templates(paths: DataFrame, min_distinct: int, min_ratio: float) -> DataFrame:
    """Adds ``template``, ``shape`` and ``last``, the last segment, to distinct (host, path, n, ...) rows."""
    parts = F.split(F.substring("path", 2, 1 << 30), "/")
    rows = paths.withColumns({"parts": parts, "last": F.element_at(parts, -1), "template": F.lit(""), "shape": F.lit("")})
    done, k = [], 0
    by_path = F.pmod(F.xxhash64("path"), F.lit(SALTS))
    names = [*paths.columns, "last", "template", "shape"]
    while True:
        most = rows.groupBy("host", "template").agg(F.count("*").alias("paths")).agg(F.max("paths")).first()[0] or 0
        if most < min_distinct:
            break
        rows = rows.withColumn("segment", F.element_at("parts", k + 1))
        children = rows.groupBy("host", "template", "segment").agg(F.sum("n").alias("n"))
        nodes = children.groupBy("host", "template").agg(F.count("*").alias("kinds"), F.sum("n").alias("pages"))
        varied = nodes.where((F.col("kinds") >= min_distinct) & (F.col("kinds") >= min_ratio * F.col("pages"))).select("host", "template", F.lit(True).alias("varied"))
        rows = answered(rows, varied, ["host", "template"], by_path, "left")
        star = F.coalesce("varied", F.lit(False))
        rows = rows.withColumn("template", F.concat("template", F.lit("/"), F.when(star, "*").otherwise(F.col("segment")))).withColumn("shape", F.concat("shape", F.when(star, "*").otherwise("=")))
        # Each level is read several times by the next; written down, the plan stays one level long.
        rows = cut(rows.drop("segment", "varied"), "urls")
        k += 1
        done.append(rows.where(F.size("parts") <= k).select(*names))
        rows = rows.where(F.size("parts") > k)
    rest = F.slice("parts", k + 1, 1 << 30)
    rows = rows.withColumn("template", F.concat("template", F.lit("/"), F.array_join(rest, "/"))).withColumn("shape", F.concat("shape", F.repeat(F.lit("="), F.size(rest))))
    return reduce(DataFrame.unionByName, [rows.select(*names), *done])


def _apart(x: Column, n: Column, y: Column, m: Column, z: float) -> Column:
    """Does a two-proportion test tell x of n from y of m?"""
    pooled = (x + y) / (n + m)
    return F.abs(x / n - y / m) > z * F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(0.0)) * (1 / n + 1 / m))


def judged(leaves: DataFrame, prior_weight: float, reject: float, z: float, min_labelled: int) -> DataFrame:
    """(host, template, class, purity, blocked) from (host, template, shape, labelled, bad, pages, paths, numbers)."""
    total = leaves.agg((F.sum("bad") / F.sum("labelled")).alias("share")).select(F.coalesce("share", F.lit(0.0)).alias("share"))
    figures = ["template", "labelled", "bad", "pages", "paths", "numbers"]
    best = leaves.where("labelled > 0").groupBy("host", "shape").agg(F.max_by(F.struct(*figures), F.struct("labelled", "template")).alias("lead"))
    rows = leaves.join(best, ["host", "shape"], "left")
    own, lead = F.col, lambda c: F.col(f"lead.{c}")
    alike = (own("labelled") > 0) & ~_apart(own("bad"), own("labelled"), lead("bad"), lead("labelled"), z)
    kin = (own("labelled") == 0) & F.col("shape").contains("*") & (lead("labelled") >= min_labelled)
    kin &= ~_apart(own("numbers"), own("paths"), lead("numbers"), lead("paths"), z) & ~_apart(own("paths"), own("pages"), lead("paths"), lead("pages"), z)
    rows = rows.withColumn("class", F.when(F.coalesce(F.when(own("labelled") > 0, alike).otherwise(kin), F.lit(False)), lead("template")).otherwise(F.col("template")))
    sums = rows.groupBy("host", "class").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    pure = sums.join(F.broadcast(total)).select(F.col("host"), F.col("class"), ((F.col("b") + prior_weight * F.col("share")) / (F.col("l") + prior_weight)).alias("purity"), "l")
    return rows.select("host", "template", "class").join(pure, ["host", "class"]).withColumn("blocked", (F.col("purity") >= reject) & (F.col("l") > 0)).drop("l")


def url_filter(pages: DataFrame, given: list[Rule], id_col: str = "page_id", url_col: str = "url", labels: DataFrame | None = None, min_distinct: int = 8, min_ratio: float = 0.02, prior_weight: float = 4.0, reject: float = 0.9, z: float = 1.96, min_labelled: int = 20) -> DataFrame:
    """One row per row of ``pages``: its id, host, path, rule, verdict, template, class and purity.

    labels: further (url, bad) rows with bad 0 or 1.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"))
    seen = rows.groupBy("host", "path").agg(F.count("*").alias("n"))
    text, verdict = rule_of(F.col("host"), F.col("path"), given)
    seen = seen.withColumn("rule", text).withColumn("verdict", verdict)
    seen = seen.withColumn("labelled", F.when(F.col("verdict").isNotNull(), F.col("n")).otherwise(0)).withColumn("bad", F.when(F.col("verdict") == "block", F.col("n")).otherwise(0))
    if labels is not None:
        h, p = host_and_path(F.col("url"))
        more = labels.where("bad is not null").select(h.alias("host"), p.alias("path"), F.col("bad").cast("bigint").alias("x")).groupBy("host", "path").agg(F.count("*").alias("more"), F.sum("x").alias("worse"))
        seen = seen.join(more, ["host", "path"], "left").withColumn("labelled", F.col("labelled") + F.coalesce("more", F.lit(0))).withColumn("bad", F.col("bad") + F.coalesce("worse", F.lit(0))).drop("more", "worse")
    tree = templates(cut(seen, "urls"), min_distinct, min_ratio)
    numbers = F.count_if(F.col("last").rlike("^[0-9]+$")).alias("numbers")
    leaves = tree.groupBy("host", "template", "shape").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.sum("n").alias("pages"), F.count("*").alias("paths"), numbers)
    verdicts = judged(cut(leaves, "templates"), prior_weight, reject, z, min_labelled)
    by_path = answered(tree.select("host", "path", "rule", "verdict", "template"), verdicts, ["host", "template"], F.pmod(F.xxhash64("path"), F.lit(SALTS)))
    final = by_path.select("host", "path", "rule", F.coalesce("verdict", F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"), "template", "class", "purity")
    out = answered(rows, cut(final, "verdicts"), ["host", "path"], F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
    return out.select(F.col("page_id").alias(id_col), "host", "path", "rule", "verdict", "template", "class", F.round("purity", 9).alias("purity"))
