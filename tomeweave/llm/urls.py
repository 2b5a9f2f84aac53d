"""URL filters by rules and a path-template tree per host, in DataFrame operations only.

Rules judge first; what they judge is also the labelled data. The pages are counted by
host and by the shape of their path (its segments, digit runs as ``#``), and the tree is built
on these counts, level by level, as deep as the paths go: below a template, a level with many rare segments is a
wildcard; a segment whose share of blocked pages does not differ from its parent's by
two standard errors (or that has no label) is merged into the wildcard; the others stay branches.
A template's blocked share is smoothed with its parent's, from all pages over the
host down to the leaf, and a template is rejected from ``REJECT`` on. Where one shape alone goes on below a template, or no
page there has a label, nothing can branch any more: the levels left are wildcards, and are counted off at once.

Defined cases: a null URL or one without ``://`` has an empty host and path, and is judged by
its (empty) host's tree; paths of any depth count whole; a share of exactly ``REJECT`` rejects; repeated rows count as often as they come; without any label nothing is
rejected; added columns give way to columns of the input with the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeweave.llm.common import cut, spare

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A level is variable with more segments than this, each with fewer pages than that on average.
SEGMENTS, PAGES_EACH = 20, 5
STRENGTH = 4.0
REJECT = 0.5


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def judge(pages: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, dict[str, str]]:
    """``pages`` with host, path, rule and verdict; also returns these columns' names by meaning."""
    names: dict[str, str] = {}
    for x in ("host", "path", "rule", "verdict", "label", "shape"):
        names[x] = spare(pages, x)
    q = f"cast(`{url}` as string)"
    rest = F.expr(f"CASE WHEN instr({q}, '://') > 0 THEN substring({q}, instr({q}, '://') + 3) ELSE '' END")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    parsed = pages.withColumns({names["host"]: F.coalesce(host, F.lit("")), names["path"]: F.coalesce(path, F.lit(""))})
    h, p = F.col(names["host"]), F.col(names["path"])
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):  # a longer rule overrides
        fits = ((h == r.host) | h.endswith("." + r.host)) & p.startswith(r.path)
        rule, verdict = F.when(fits, F.lit(r.name)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    segments = F.split(F.regexp_replace(F.regexp_replace(p, "^/", ""), "[0-9]+", "#"), "/")
    shape = F.when(p != "", segments).otherwise(F.array().cast("array<string>"))
    labelled = parsed.withColumns({names["rule"]: rule, names["label"]: verdict, names["shape"]: shape})
    label = F.col(names["label"])
    shapes = labelled.groupBy(h.alias("host"), F.col(names["shape"]).alias("shape")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(label == "block", 1)).alias("b"), F.count(label).alias("m")
    )
    names["template"] = spare(pages, "template")
    host_of, shape_of, template, share = (spare(labelled, x) for x in ("host_of", "shape_of", "template", "share"))
    tree = templates(shapes).select(F.col("host").alias(host_of), F.col("shape").alias(shape_of), F.col("template").alias(template), F.col("share").alias(share))
    judged = labelled.join(tree, (h == F.col(host_of)) & (F.col(names["shape"]) == F.col(shape_of)), "left")
    judged = judged.withColumn(names["verdict"], F.coalesce(label, F.when(F.col(share) >= REJECT, "block").otherwise("allow")))
    out = [F.col(f"`{c}`") for c in pages.columns] + [F.col(names[x]) for x in ("host", "path", "rule", "verdict")] + [F.col(template).alias(names["template"])]
    return judged.select(*out), names


def templates(shapes: DataFrame) -> DataFrame:
    """``shapes`` (host, shape; n pages, m labelled, b blocked) with ``template`` and its smoothed blocked ``share``."""
    shapes = cut(shapes)
    blocked, labelled = shapes.agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0))).first()
    smooth = (F.col("p_b") + STRENGTH * F.col("share")) / (F.col("p_m") + STRENGTH)
    hosts = shapes.groupBy("host").agg(F.sum("m").alias("p_m"), F.sum("b").alias("p_b")).withColumn("share", F.lit(blocked / max(labelled, 1)))
    going = cut(shapes.withColumn("template", F.lit("")).join(hosts.select("host", smooth.alias("share")), "host"))
    level, left = 0, F.size("shape")
    settled = [going.filter(left == 0)]
    while True:
        going = going.filter(left > level)
        below = going.groupBy("host", "template").agg(F.count(F.lit(1)).alias("t_k"), F.sum("m").alias("t_m"))
        going = cut(going.join(below, ["host", "template"]))
        alone = (F.col("t_k") == 1) | (F.col("t_m") == 0)
        own = F.when(F.col("m") > 0, F.col("b") / F.col("m"))
        last = F.when(F.col("m") > 0, own + (F.col("share") - own) * F.pow(F.lit(STRENGTH) / (F.col("m") + STRENGTH), left - level)).otherwise(F.col("share"))
        settled.append(going.filter(alone).withColumns({"template": F.concat("template", F.repeat(F.lit("/*"), left - level)), "share": last}).drop("t_k", "t_m"))
        going = going.filter(~alone).drop("t_k", "t_m")
        if going.isEmpty():
            break
        level += 1
        going = going.withColumn("s", F.element_at("shape", level))
        children = going.groupBy("host", "template", "s").agg(*(F.sum(x).alias(f"c_{x}") for x in ("n", "m", "b")))
        parents = children.groupBy("host", "template").agg(F.count(F.lit(1)).alias("k"), *(F.sum(f"c_{x}").alias(f"p_{x}") for x in ("n", "m", "b")))
        variable = (F.col("k") > SEGMENTS) & (F.col("p_n") < PAGES_EACH * F.col("k"))
        d = lambda x: F.col(x).cast("double")
        apart = F.pow(d("c_b") * d("p_m") - d("p_b") * d("c_m"), F.lit(2.0)) > 4.0 * d("p_b") * (d("p_m") - d("p_b")) * d("c_m")
        branch = (F.col("c_m") > 0) & apart & ~variable
        steps = children.join(parents, ["host", "template"]).select("host", "template", "s", F.when(branch, F.concat(F.lit("/"), "s")).otherwise(F.lit("/*")).alias("step"))
        going = cut(going.join(steps, ["host", "template", "s"]).withColumn("template", F.concat("template", "step")).drop("step", "s"))
        stats = going.groupBy("host", "template").agg(*(F.sum(x).alias(f"p_{x}") for x in ("m", "b")), F.min("share").alias("share"))
        going = cut(going.drop("share").join(stats.select("host", "template", smooth.alias("share")), ["host", "template"]))
        settled.append(going.filter(left == level))
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out
