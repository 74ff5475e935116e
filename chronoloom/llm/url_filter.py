"""URL filters: host rules first, then a path-template tree per host.

Each host's paths form a tree of segments, to their full depth. Segments vary
by type (digit runs become <n>) or by number (a child among many that each hold
a small share becomes *). Sibling branches with the same most frequent segment
below them are merged (~ and that segment) where their pages are spread alike
over all segments below (chi-square of homogeneity against those siblings) and
their blocked shares don't differ significantly; a branch with few or no labels
can't differ in them, so it takes over the evidence of siblings of its structure. A template is rejected when its smoothed share of blocked labels
reaches THRESHOLD; labels are the verdicts of the rules.

Every level is counted with partial aggregates, which are written before they
are joined back, so that Spark can split a host with very many pages. A path that
is alone below its node is finished at once: the number of levels that are run
is that of the deepest branching, not of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import materialize, table

#: Fixed values of the contract: verdict, host, path; a rule fits its host and all subdomains.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A segment is a wildcard where its parent has at least so many children and it holds less than one in SHARE of the parent's pages.
CHILDREN, SHARE = 20, 20
#: Labels from which a branch's share can differ from its siblings', and a template be rejected; the chi-square bound (95 %, one degree) of similar shares.
MIN_LABELS, SIMILAR = 5, 3.84
#: Standard deviations above its mean (the degrees of freedom) to which the chi-square of similar structures may reach.
SPREAD = 4.0
#: Pseudo-labels at the overall blocked share, and the share from which a template is rejected.
SMOOTHING, THRESHOLD = 4.0, 0.8


def split_url(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Add host and path; both are empty for a null url or one without ://."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), UPPER, LOWER)
    return df.withColumns({"host": host, "path": F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)})


def ordered(rules=RULES) -> list[tuple[str, str, str]]:
    """Longest rule first."""
    return sorted(rules, key=lambda r: -len(r[1] + r[2]))


def with_rule(df: DataFrame, rules=RULES) -> DataFrame:
    """Add rule (host and path of the longest rule that fits, else null) and label (1 block, 0 allow, else null)."""
    rule, label = F.lit(None).cast("string"), F.lit(None).cast("int")
    for verdict, host, path in reversed(ordered(rules)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        label = F.when(fits, F.lit(int(verdict == "block"))).otherwise(label)
    return df.withColumns({"rule": rule, "label": label})


def typed_path(path):
    """The path with digit runs as <n>; its segments stand between slashes, and the empty path has none."""
    return F.regexp_replace(path, r"\d+", "<n>")


def head(segments: str):
    """=segment for the first of the segments that are left, - where none is."""
    return F.when(F.size(segments) > 0, F.concat(F.lit("="), F.get(segments, F.lit(0)))).otherwise(F.lit("-"))


def tail(segments: str):
    return F.expr(f"slice({segments}, 2, greatest(size({segments}) - 1, 0))")


def alone(tree: DataFrame, node: str, left: str) -> tuple[DataFrame, DataFrame]:
    """Paths that have company below their node, and the others with all that is left of them moved to the node."""
    counts = materialize(tree.groupBy("host", node).agg(F.countDistinct(left).alias("_tails")), "tails")
    both = materialize(tree.join(counts, ["host", node]), "alone")
    rest = F.when(F.size(left) > 0, F.concat(F.lit("/"), F.array_join(left, "/"))).otherwise(F.lit(""))
    gone = both.filter("_tails = 1").withColumn(node, F.concat(node, rest))
    return both.filter("_tails > 1").drop("_tails"), gone.drop("_tails", left)


def generalised(paths: DataFrame) -> DataFrame:
    """paths(host, typed, n, lab, blk) with g: the path with variable segments as *."""
    segments = F.when(F.col("typed") == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace("typed", "^/", ""), "/", -1))
    tree, done = paths.withColumns({"rest": segments, "g": F.lit("")}), None
    while True:
        tree, gone = alone(tree, "g", "rest")
        done = gone if done is None else done.unionByName(gone)
        tree = materialize(tree.withColumn("kid", head("rest")), "level")
        if tree.isEmpty():
            return done
        kids = materialize(tree.groupBy("host", "g", "kid").agg(F.sum("n").alias("_n")), "kids")
        nodes = materialize(kids.groupBy("host", "g").agg(F.count("*").alias("_kids"), F.sum("_n").alias("_total")), "nodes")
        wild = (F.col("_kids") >= CHILDREN) & (F.col("_n") * SHARE < F.col("_total")) & (F.col("kid") != "-")
        named = materialize(kids.join(nodes, ["host", "g"]).select("host", "g", "kid", wild.alias("wild")), "named")
        step = F.when(F.col("kid") == "-", "").when(F.col("wild"), "/*").otherwise(F.concat(F.lit("/"), F.substring("kid", 2, 1 << 30)))
        tree = tree.join(named, ["host", "g", "kid"]).withColumns({"g": F.concat("g", step), "rest": tail("rest")}).drop("kid", "wild")


def merged(templates: DataFrame) -> DataFrame:
    """templates(host, g, n, lab, blk) with m: the template with similar branches as ~."""
    segments = F.when(F.col("g") == "", F.array().cast("array<string>")).otherwise(F.split(F.expr("substr(g, 2)"), "/", -1))
    tree, done = templates.withColumns({"rest": segments, "m": F.lit("")}), None
    while True:
        tree, gone = alone(tree, "m", "rest")
        done = gone if done is None else done.unionByName(gone)
        tree = materialize(tree.withColumn("kid", head("rest")).withColumn("rest", tail("rest")).withColumn("below", head("rest")), "level")
        if tree.isEmpty():
            return done
        cells = materialize(tree.groupBy("host", "m", "kid", "below").agg(*(F.sum(c).alias(c) for c in ("n", "lab", "blk"))), "cells")
        tops = materialize(cells.groupBy("host", "m", "kid").agg(F.max(F.struct("n", "below"))["below"].alias("top")), "tops")
        cells = materialize(cells.join(tops, ["host", "m", "kid"]), "cells")
        kin = ["host", "m", "top"]
        spread = materialize(cells.groupBy(*kin, "below").agg(F.sum("n").alias("_nc")), "spread")
        nodes = materialize(spread.groupBy(*kin).agg(F.count("*").alias("_cells"), F.sum("_nc").alias("_nt")), "nodes")
        labels = materialize(cells.groupBy(*kin).agg(F.sum("lab").alias("_tl"), F.sum("blk").alias("_tb")), "labels")
        squares = F.sum(F.col("n").cast("double") * F.col("n") / F.col("_nc")).alias("_sq")
        kids = materialize(cells.join(spread, [*kin, "below"]).groupBy(*kin, "kid").agg(F.sum("n").alias("_n"), F.sum("lab").alias("_l"), F.sum("blk").alias("_b"), squares), "kids")
        named = materialize(kids.join(nodes, kin).join(labels, kin).select(*kin, "kid", F.expr(ALIKE).alias("alike")), "named")
        step = F.when(F.col("kid") == "-", "").when(F.col("alike"), F.concat(F.lit("/~"), "top")).otherwise(F.concat(F.lit("/"), F.substring("kid", 2, 1 << 30)))
        tree = tree.join(named, ["host", "m", "kid"]).withColumn("m", F.concat("m", step)).drop("kid", "below", "alike", "top")


#: Whether a branch (_n pages, _l labels, _b blocked, _sq the sum of n * n / _nc over its cells) is like all siblings with its top segment
#: (_nt pages in _cells cells, _tl labels, _tb blocked), in SQL that Spark and DuckDB share.
_CHI = "round((_nt * _sq / _n - _n) * _nt / (_nt - _n), 6)"
_STRUCTURE = f"{_CHI} <= _cells - 1 + {SPREAD} * sqrt(2.0 * (_cells - 1))"
_LABELS = f"(_l < {MIN_LABELS} or power(1.0 * _b * _tl - 1.0 * _tb * _l, 2) <= {SIMILAR} * _tb * (_tl - _tb) * _l)"
ALIKE = f"case when kid = '-' or _n = _nt then false else {_STRUCTURE} and {_LABELS} end"


def template_tree(labelled: DataFrame) -> DataFrame:
    """(host, typed, template, purity, labels) for each distinct typed path of labelled(host, typed, label)."""
    counted = labelled.groupBy("host", "typed").agg(F.count("*").alias("n"), F.count("label").alias("lab"), F.coalesce(F.sum("label"), F.lit(0)).alias("blk"))
    paths = materialize(generalised(materialize(counted, "paths")), "generalised")
    sums = [F.sum(c).alias(c) for c in ("n", "lab", "blk")]
    templates = materialize(merged(materialize(paths.groupBy("host", "g").agg(*sums), "counts")), "merged")
    lab, blk = paths.agg(F.coalesce(F.sum("lab"), F.lit(0)), F.coalesce(F.sum("blk"), F.lit(0))).first()
    prior = blk / lab if lab else 0.0
    pooled = materialize(templates.groupBy("host", "m").agg(F.sum("lab").alias("labels"), F.sum("blk").alias("_blk")), "pooled")
    purity = F.round((F.col("_blk") + F.lit(SMOOTHING * prior)) / (F.col("labels") + SMOOTHING), 6)
    judged = templates.select("host", "g", "m").join(pooled, ["host", "m"]).select("host", "g", F.col("m").alias("template"), "labels", purity.alias("purity"))
    return paths.select("host", "typed", "g").join(materialize(judged, "judged"), ["host", "g"]).drop("g")


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict, template, purity.

    Without a rule the verdict is block when the template has MIN_LABELS labels
    and its purity reaches THRESHOLD, else allow. A null or malformed url has
    empty host and path and is judged like any other path. Repeated rows each
    get their row. Other columns are not read; an empty table gives an empty
    result.
    """
    rows = with_rule(split_url(pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")), "_url"), rules).drop("_url")
    rows = rows.withColumn("typed", typed_path(F.col("path")))
    judged = rows.join(materialize(template_tree(rows), "templates"), ["host", "typed"])
    blocked = F.when(F.col("label").isNotNull(), F.col("label") == 1).otherwise((F.col("labels") >= MIN_LABELS) & (F.col("purity") >= THRESHOLD))
    return judged.select(F.col("_id").alias(id_col), "host", "path", "rule", F.when(blocked, "block").otherwise("allow").alias("verdict"), "template", "purity")


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


#: Levels that the SQL walks, beyond which it takes paths as they are; the operator itself has no such bound.
SQL_LEVELS = 5


def _oracle() -> str:
    fits = lambda h, p: f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    rule = "case " + " ".join(f"when {fits(h, p)} then '{h}{p}'" for _, h, p in ordered()) + " end"
    label = "case " + " ".join(f"when {fits(h, p)} then {int(v == 'block')}" for v, h, p in ordered()) + " end"
    first = "case when len({0}) > 0 then '=' || {0}[1] else '-' end"
    ctes = [
        """u as (select page_id, coalesce(url, '') as url, coalesce(nullif(position('://' in coalesce(url, '')), 0) + 3, length(coalesce(url, '')) + 1) as place from pages)""",
        f"""r as (select page_id, translate(regexp_extract(substr(url, place), '^[^/?#]*'), '{UPPER}', '{LOWER}') as host,
              regexp_extract(substr(url, place), '^[^/?#]*([^?#]*)', 1) as path from u)""",
        f"""l as (select *, {rule} as rule, {label} as label, regexp_replace(path, '\\d+', '<n>', 'g') as typed from r)""",
        """g0 as (select host, typed, count(*) as n, count(label) as lab, coalesce(sum(label), 0) as blk, '' as g,
              case when typed = '' then []::varchar[] else string_split(case when starts_with(typed, '/') then typed[2:] else typed end, '/') end as rest from l group by all)""",
    ]
    for i in range(SQL_LEVELS):
        ctes += [
            f"k{i} as (select *, {first.format('rest')} as kid from g{i})",
            f"c{i} as (select host, g, kid, sum(n) as cn from k{i} group by all)",
            f"p{i} as (select host, g, count(*) as kids, sum(cn) as total from c{i} group by all)",
            f"""g{i + 1} as (select host, typed, n, lab, blk, g || case when kid = '-' then '' when kids >= {CHILDREN} and cn * {SHARE} < total then '/*' else '/' || kid[2:] end as g, rest[2:] as rest
              from k{i} join c{i} using (host, g, kid) join p{i} using (host, g))""",
        ]
    ctes += [
        f"gt as (select host, typed, lab, blk, n, g || case when len(rest) > 0 then '/' || array_to_string(rest, '/') else '' end as g from g{SQL_LEVELS})",
        "m0 as (select host, g, '' as m, case when g = '' then []::varchar[] else string_split(g[2:], '/') end as rest, sum(n) as n, sum(lab) as lab, sum(blk) as blk from gt group by all)",
    ]
    for i in range(SQL_LEVELS):
        ctes += [
            f"mk{i} as (select host, g, m, n, lab, blk, rest[2:] as rest, {first.format('rest')} as kid, {first.format('rest[2:]')} as below from m{i})",
            f"mc{i} as (select host, m, kid, below, sum(n) as n, sum(lab) as lab, sum(blk) as blk from mk{i} group by all)",
            f"md{i} as (select host, m, kid, below as top from mc{i} qualify row_number() over (partition by host, m, kid order by n desc, below desc) = 1)",
            f"mx{i} as (select mc{i}.*, top from mc{i} join md{i} using (host, m, kid))",
            f"ms{i} as (select host, m, top, below, sum(n) as _nc from mx{i} group by all)",
            f"mn{i} as (select host, m, top, count(*) as _cells, sum(_nc) as _nt from ms{i} group by all)",
            f"ml{i} as (select host, m, top, sum(lab) as _tl, sum(blk) as _tb from mx{i} group by all)",
            f"mb{i} as (select host, m, top, kid, sum(n) as _n, sum(lab) as _l, sum(blk) as _b, sum(n::double * n / _nc) as _sq from mx{i} join ms{i} using (host, m, top, below) group by all)",
            f"ma{i} as (select host, m, top, kid, {ALIKE} as alike from mb{i} join mn{i} using (host, m, top) join ml{i} using (host, m, top))",
            f"""m{i + 1} as (select host, g, m || case when kid = '-' then '' when alike then '/~' || top else '/' || kid[2:] end as m, rest, n, lab, blk from mk{i} join ma{i} using (host, m, kid))""",
        ]
    ctes += [
        f"mt as (select host, g, lab, blk, m || case when len(rest) > 0 then '/' || array_to_string(rest, '/') else '' end as template from m{SQL_LEVELS})",
        "prior as (select coalesce(sum(blk) / nullif(sum(lab), 0), 0) as share from gt)",
        f"z as (select host, template, sum(lab) as labels, round((sum(blk) + {SMOOTHING}::double * (select share from prior)) / (sum(lab) + {SMOOTHING}), 6)::double as purity from mt group by all)",
    ]
    ctes = [f"{c.split(' as ', 1)[0]} as materialized {c.split(' as ', 1)[1]}" for c in ctes]
    return f"""with {", ".join(ctes)} select page_id, l.host, path, rule,
      case when label = 1 or label is null and labels >= {MIN_LABELS} and purity >= {THRESHOLD} then 'block' else 'allow' end as verdict, template, purity
      from l join gt using (host, typed) join mt using (host, g) join z using (host, template)"""


ORACLE = _oracle()
