"""URL filter: block and allow rules, and for the rest a path-template tree per host.

Paths become segment lists whose lexically variable segments (numbers, hashes, dates) are
placeholders. Node by node of the tree, the segments that all paths below have in common are one
step; then the thinly labelled children (too few labels to outweigh the prior) take a wildcard
instead if their segment is variable: if its entropy is a large part of what it were if every page
had a segment of its own. A child with labels enough to be judged stays. Both tests look at shares,
so a crawl that grows evenly keeps its tree. Siblings, inner nodes and leaf templates alike, whose
labelled purity does not differ significantly from that of the branch so far join that branch. A
template is rejected if its purity, smoothed towards that of all labelled pages, is too low. The
tree lives in grouped tables keyed by host and prefix, built from counts of distinct shapes;
nothing of a host is gathered in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import pick, release, save

#: Weight of the prior purity in labelled pages; a child with fewer is thin.
SMOOTHING, LEAST_PURITY, SIGNIFICANT = 10.0, 0.5, 1.96
#: Entropy of the thin children's segment, of what it is at most, from which it is variable.
VARIABLE = 0.5
#: Steps of purity in which siblings are sorted for merging (one edge lies at LEAST_PURITY).
BINS = 1000


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """``(verdict, rule)`` of the longest rule that fits, else null. A rule is a host, which
    stands for its subdomains too, and the beginning of a path."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):  # longer ones are asked first
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(text).alias("rule"))).otherwise(out)
    return out


def shape(path: Column) -> Column:
    """Segments of a path, lexically variable ones as placeholders (an extension stays)."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(segments, lambda s: F.regexp_replace(F.regexp_replace(F.regexp_replace(
        s, r"^[0-9]{4}-[0-9]{2}(?:-[0-9]{2})?(?=$|\.)", "<date>"), r"^[0-9]+(?=$|\.)", "<n>"),
        r"^(?=[0-9a-fA-F-]*[0-9])[0-9a-fA-F-]{8,}(?=$|\.)", "<hash>"))


def common(lo: Column, hi: Column) -> Column:
    """How many segments the least and the greatest of some lists begin with in common; all lists
    between begin with them too."""
    return F.when(lo == hi, F.size(lo)).otherwise(F.array_position(F.zip_with(lo, hi, lambda x, y: x.eqNullSafe(y)), False).cast("int") - 1)


def templates(shapes: DataFrame, smoothing: float = SMOOTHING, variable: float = VARIABLE, prior: float | None = None) -> DataFrame:
    """``shapes(host, segments, n, good, labelled)``, a row each, with ``template`` (its last
    segment included) and ``parent``, the branch of inner nodes it hangs from. Nodes without any
    label below end in one wildcard (``/**``), unless all that is below is the same. A round takes
    every node one fork further, so rounds follow nested forks above labelled pages."""
    good, labelled = shapes.agg(F.sum("good"), F.sum("labelled")).first()
    prior = prior if prior is not None else good / labelled if labelled else 1.0
    at, node = shapes.withColumns({"parent": F.lit(""), "template": F.lit(""), "branch": F.lit(""), "rest": F.col("segments")}), ["host", "template"]
    last = None
    while True:
        going = F.size("rest") > 0
        lists = at.where(going).groupBy(*node).agg(F.min("rest").alias("lo"), F.max("rest").alias("hi"), F.sum("labelled").alias("known"))
        lists = lists.select(*node, common(F.col("lo"), F.col("hi")).alias("k"), (F.col("lo") == F.col("hi")).alias("same"), (F.col("known") == 0).alias("blank"))
        shared = F.slice("rest", 1, F.col("k"))
        here = at.join(lists, node, "left")
        here = here.withColumns({
            "parent": F.when(going, F.col("branch")).otherwise(F.col("parent")),
            "template": F.concat("template", F.when(going & (F.col("k") > 0), F.concat(F.lit("/"), F.array_join(shared, "/"))).otherwise(""),
                                 F.when(going & F.col("blank") & ~F.col("same"), F.lit("/**")).otherwise("")),
            "rest": F.when(going & ~F.col("same") & ~F.col("blank"), F.slice("rest", F.col("k") + 1, F.size("rest"))).otherwise(F.array().cast("array<string>"))})
        here = save(here.drop("k", "same", "blank").withColumn("child", F.get("rest", F.lit(0))), "forks")
        children = here.where("child IS NOT NULL").groupBy(*node, "child").agg(F.sum("n").alias("n"), (F.sum("labelled") < smoothing).alias("thin"))
        spread = children.where("thin").groupBy(*node).agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.log("n")).alias("own"))
        whole = F.log("all")
        spread = spread.select(*node, ((F.col("all") > 1) & (whole - F.col("own") / F.col("all") >= variable * whole - 1e-9)).alias("wide"))
        step = children.join(spread, node, "left").select(*node, "child", F.concat(F.lit("/"), F.when(F.col("thin") & F.col("wide"), F.lit("*")).otherwise(F.col("child"))).alias("step"))
        at = here.join(step, [*node, "child"], "left").withColumns({
            "template": F.concat("template", F.coalesce("step", F.lit(""))),
            "rest": F.when(F.col("child").isNotNull(), F.slice("rest", 2, F.size("rest"))).otherwise(F.col("rest"))}).drop("child", "step")
        at = save(at, "templates")
        release(here, *([last] if last is not None else []))
        last = at
        inner = F.size("rest") > 0
        more = at.where(inner)
        if more.isEmpty():
            return at.drop("branch", "rest")
        joined = branches(more, prior).select("host", "parent", "template", F.col("branch").alias("joined"))
        at = at.join(joined, ["host", "parent", "template"], "left").withColumn(
            "branch", F.when(inner, F.concat("branch", F.lit("/"), "joined")).otherwise(F.col("branch"))).drop("joined")


def branches(nodes: DataFrame, prior: float, smoothing: float = SMOOTHING, significant: float = SIGNIFICANT) -> DataFrame:
    """``(host, parent, template, branch, purity)``: siblings, in order of purity, join the branch
    before them unless a two-proportion test tells them from all that is in it. Sorted are not
    the siblings but their at most ``BINS`` steps of purity."""
    smooth = lambda good, labelled: (good + smoothing * prior) / (labelled + smoothing)
    rows = nodes.groupBy("host", "parent", "template").agg(F.sum("good").alias("good"), F.sum("labelled").alias("labelled"))
    rows = rows.withColumn("bin", F.floor(smooth(F.col("good"), F.col("labelled")) * BINS))
    bins = rows.groupBy("host", "parent", "bin").agg(F.sum("good").alias("good"), F.sum("labelled").alias("labelled"))
    lists = bins.groupBy("host", "parent").agg(F.array_sort(F.collect_list(F.struct("bin", "good", "labelled"))).alias("bins"))

    def join(acc: Column, x: Column) -> Column:
        n0, n1 = acc["labelled"] + smoothing, x["labelled"] + smoothing
        p0, p1 = smooth(acc["good"], acc["labelled"]), smooth(x["good"], x["labelled"])
        pooled = (p0 * n0 + p1 * n1) / (n0 + n1)
        new = (acc["branch"] < 0) | (F.abs(p1 - p0) / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-12)) * (1 / n0 + 1 / n1)) > significant)
        branch = acc["branch"] + F.when(new, 1).otherwise(0)
        return F.struct((F.when(new, F.lit(0)).otherwise(acc["good"]) + x["good"]).alias("good"), (F.when(new, F.lit(0)).otherwise(acc["labelled"]) + x["labelled"]).alias("labelled"),
                        branch.alias("branch"), F.concat(acc["out"], F.array(F.struct(x["bin"].alias("bin"), x["good"].alias("good"), x["labelled"].alias("labelled"), branch.alias("branch")))).alias("out"))

    none = F.struct(F.lit(0).cast("bigint").alias("good"), F.lit(0).cast("bigint").alias("labelled"), F.lit(-1).alias("branch"),
                    F.expr("cast(array() as array<struct<bin:bigint,good:bigint,labelled:bigint,branch:int>>)").alias("out"))
    folded = lists.select("host", "parent", F.explode(F.aggregate("bins", none, join)["out"]).alias("b")).select("host", "parent", "b.*")
    whole = Window.partitionBy("host", "parent", "branch")
    folded = folded.select("host", "parent", "bin", "branch", smooth(F.sum("good").over(whole), F.sum("labelled").over(whole)).alias("purity"))
    return rows.join(folded, ["host", "parent", "bin"]).select("host", "parent", "template", "branch", "purity")


def purities(leaves: DataFrame, prior: float, smoothing: float = SMOOTHING, significant: float = SIGNIFICANT) -> DataFrame:
    """``(host, parent, template, branch, purity)`` of the leaf templates."""
    return branches(leaves, prior, smoothing, significant)


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], page_id: str = "page_id", url: str = "url",
          doc_id: str = "doc_id", quality: str = "quality", toxic: str = "toxic", least: float = LEAST_PURITY) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` of every row: the verdict of the
    longest fitting rule, else ``block`` if the template's purity is below ``least``.

    A page is good if labelled with quality 1 and not toxic (labels by page id; of several, the
    worst counts; null says nothing). Null urls have empty host and path and share a template;
    repeated rows are judged alike; without labels every template has the purity of none, 1."""
    host, path = parts(F.col("url"))
    rows = pick(pages, page_id=page_id, url=url).select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("segments", shape(F.col("path")))
    known = pick(labels, page_id=doc_id, quality=quality, toxic=toxic).where("page_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)")
    known = known.groupBy("page_id").agg(F.min(((F.coalesce("quality", F.lit(1)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")).alias("good"))
    seen = rows.join(known, "page_id", "left").groupBy("host", "segments").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.count("good").alias("labelled"))
    seen = save(seen, "shapes")
    good, labelled = seen.agg(F.sum("good"), F.sum("labelled")).first()
    prior = good / labelled if labelled else 1.0
    leaves = save(templates(seen, prior=prior), "leaves")
    judged = purities(leaves, prior)
    by_shape = leaves.select("host", "segments", "parent", "template").join(judged, ["host", "parent", "template"]).select("host", "segments", "template", "purity")
    out = rows.join(by_shape, ["host", "segments"]).withColumn("r", rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("r.verdict", F.when(F.col("purity") < least, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")
