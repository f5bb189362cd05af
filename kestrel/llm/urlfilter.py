"""URL filters: rules first, a path-template tree for the rest. DataFrame functions only.

A url's host is the text after the first ``://`` up to ``/``, ``?``, ``#`` or the end (A-Z
lower-cased), its path what follows up to ``?``, ``#`` or the end. A rule (action, host, path) fits
its host and all subdomains if the path starts with the rule's; the longest rule text wins.

The tree judges every url without a rule. Per host:

1. *Generalise.* Path segments become the levels of a tree, ``DEPTH`` of them; deeper segments
   together form one last level. Numbers and long hexadecimal strings are wildcards (``{n}``,
   ``{h}``) at once. Level by level, a node whose literal children are many and thinly used (more
   than ``max_children`` distinct ones, or at least ``min_children`` with fewer than ``min_use``
   urls each on average) has them all replaced by ``*``.
2. *Merge.* Templates with one parent whose labelled block rates do not differ significantly
   (two-proportion test, ``z``) form one branch: sorted by rate, a branch ends where
   neighbours differ. Generalising bounds the children of a node, so a parent's templates are few.
3. *Reject.* Labels come from the rules: urls that a rule blocks or allows. A branch's purity is
   its blocked share, smoothed by ``alpha`` pseudo-urls of its host's purity, which in turn is
   smoothed by the purity of all labelled urls (0 without any). Branches with purity over
   ``reject`` are blocked, all others allowed.

Only the url column is read. Every statistic is a partial aggregate over (host, prefix) keys, so a
host with a third of all rows costs no more per task than any other; in the joins back, nodes that
hold 1 / HOT of all urls or more are broadcast and only the others are shuffled.

Defined cases: null urls and urls without ``://`` have empty host and path; rows that share an empty
host share one tree; empty paths are the template ``/``; repeated rows count as often as they
occur and get equal verdicts; an empty table gives an empty result.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.common import HOT, cut_lineage, join_nodes

DEPTH = 6
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def match_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule text, action) of the longest fitting rule, else nulls; ties go to the text that sorts first."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def segments(path: Column) -> Column:
    """Levels of the path: at most DEPTH + 1, numbers and hexadecimal strings as wildcards."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    typed = F.transform(parts, lambda s: F.when(s.rlike(r"^[0-9]+(\.[a-z]{1,5})?$"), F.regexp_replace(s, r"^[0-9]+", "{n}"))
                        .when(s.rlike(r"^[0-9a-fA-F-]{16,}$"), F.lit("{h}")).otherwise(s))
    head = F.slice(typed, 1, DEPTH)
    deep = F.size(typed) > DEPTH
    return F.when(deep, F.concat(head, F.array(F.array_join(F.slice(typed, DEPTH + 1, 1 << 30), "/")))).otherwise(head)


def templates(urls: DataFrame, max_children: int = 40, min_children: int = 12, min_use: float = 3.0) -> DataFrame:
    """Step 1: ``urls(host, path, n, labelled, blocked)`` -> with ``template``."""
    cur = cut_lineage(urls.withColumn("segs", segments(F.col("path"))).withColumn("template", F.lit("/")))
    deepest, total = cur.agg(F.coalesce(F.max(F.size("segs")), F.lit(0)), F.count("*")).first()
    for level in range(deepest):  # each level reads the last one more than once: written once, it isn't computed again
        seg = F.get(F.col("segs"), F.lit(level))
        cur = cur.withColumn("seg", seg)
        literal = ~F.col("seg").contains("{n}") & (F.col("seg") != "{h}")
        node = (cur.groupBy("host", "template", "seg").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
                .groupBy("host", "template").agg(F.count_if(literal).alias("kids"), F.sum(F.when(literal, F.col("n"))).alias("used"),
                                                 F.sum("rows").alias("rows")))
        wide = (F.col("kids") > max_children) | ((F.col("kids") >= min_children) & (F.col("used") < min_use * F.col("kids")))
        node = node.select("host", "template", F.coalesce(wide, F.lit(False)).alias("wide"), "rows")
        node = cut_lineage(node.where(F.col("wide") | (F.col("rows") * HOT >= total)))
        cur = join_nodes(cur, node, ["host", "template"], "rows", total, "left")
        name = F.when(F.col("wide") & literal, F.lit("*")).otherwise(F.col("seg"))
        cur = cur.withColumn("template", F.when(F.col("seg").isNull(), F.col("template"))
                             .otherwise(F.concat("template", name, F.lit("/")))).drop("wide", "seg")
        cur = cut_lineage(cur)
    return cur.drop("segs")


def judge(urls: DataFrame, base: float, alpha: float = 4.0, z: float = 1.96, reject: float = 0.5) -> DataFrame:
    """``urls(host, path, n, labelled, blocked)``, one row per (host, path): with ``template``,
    ``branch`` (per host and parent) and ``purity``, ``blocked_by_tree``. ``base`` is the blocked
    share of all labelled urls."""
    cur = templates(urls)
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    leaf = cur.groupBy("host", "template").agg(*sums, F.count("*").alias("rows"))
    hosts = (leaf.groupBy("host").agg(F.sum("labelled").alias("hl"), F.sum("blocked").alias("hb"))
             .select("host", ((F.col("hb") + alpha * base) / (F.col("hl") + alpha)).alias("host_purity")))
    leaf = leaf.join(hosts, "host")
    parent = F.regexp_replace("template", r"[^/]+/$", "")
    rate = (F.col("blocked") + alpha * F.col("host_purity")) / (F.col("labelled") + alpha)
    w = Window.partitionBy("host", "parent").orderBy("rate", "template")
    leaf = leaf.withColumn("parent", parent).withColumn("rate", rate).withColumn("m", F.col("labelled") + F.lit(alpha))
    prev_rate, prev_m = F.lag("rate").over(w), F.lag("m").over(w)
    both = (F.col("rate") * F.col("m") + prev_rate * prev_m) / (F.col("m") + prev_m)
    err = F.sqrt(both * (1 - both) * (1 / F.col("m") + 1 / prev_m))
    cut = F.coalesce((F.col("rate") - prev_rate > z * err) & (F.col("rate") > prev_rate), F.lit(False))
    leaf = leaf.withColumn("cut", cut.cast("int")).withColumn("branch", F.sum("cut").over(w))
    pooled = (leaf.groupBy("host", "parent", "branch").agg(F.sum("labelled").alias("bl"), F.sum("blocked").alias("bb"),
                                                            F.first("host_purity").alias("hp"))
              .withColumn("purity", (F.col("bb") + alpha * F.col("hp")) / (F.col("bl") + alpha)).drop("bl", "bb", "hp"))
    verdicts = (leaf.select("host", "parent", "branch", "template", "rows").join(pooled, ["host", "parent", "branch"])
                .select("host", "template", "branch", "purity", (F.col("purity") > reject).alias("blocked_by_tree"), "rows"))
    verdicts = cut_lineage(verdicts)
    total = verdicts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    return join_nodes(cur.select("host", "path", "template"), verdicts, ["host", "template"], "rows", total)


def filter_urls(pages: DataFrame, url: str = "url", key: str = "page_id", rules=RULES) -> DataFrame:
    """One row per row of ``pages``: key, host, path, rule, verdict, template, purity."""
    host, path = host_path(F.col(url))
    rows = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, action = match_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("action", action)
    urls = (rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("action").alias("labelled"),
                                             F.sum((F.col("action") == "block").cast("int")).alias("b"))
            .select("host", "path", "n", "labelled", F.coalesce("b", F.lit(0)).alias("blocked")))
    seen = rows.agg(F.count("action"), F.count_if(F.col("action") == "block")).first()  # two counts
    tree = judge(urls, seen[1] / seen[0] if seen[0] else 0.0)
    verdict = F.coalesce("action", F.when(F.col("blocked_by_tree"), "block").otherwise("allow"))
    return (rows.join(tree, ["host", "path"], "left")
            .select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "branch", "purity"))


def op1(pages: DataFrame) -> DataFrame:
    return filter_urls(pages)


def oracle(rules=RULES, depth: int = DEPTH, max_children: int = 40, min_children: int = 12, min_use: float = 3.0,
           alpha: float = 4.0, z: float = 1.96, reject: float = 0.5) -> str:
    """The same definition as DuckDB SQL over ``pages``."""
    cases = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))

    def fits(h: str, p: str) -> str:
        return f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"

    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h + p}'" for _, h, p in cases)
    action = " ".join(f"WHEN {fits(h, p)} THEN '{a}'" for a, h, p in cases)
    lower = reduce(lambda s, c: f"replace({s}, '{c}', '{c.lower()}')", string.ascii_uppercase, "regexp_extract(rest, '^([^/?#]*)', 1)")
    steps = []
    for i in range(depth + 1):
        steps.append(f"""
s{i} AS (SELECT *, segs[{i + 1}] AS seg, (NOT contains(segs[{i + 1}], '{{n}}') AND segs[{i + 1}] <> '{{h}}') AS lit FROM t{i}),
w{i} AS (SELECT host, template, true AS wide FROM (SELECT host, template, count(DISTINCT seg) AS kids, sum(n) AS used FROM s{i}
         WHERE seg IS NOT NULL AND lit GROUP BY host, template)
         WHERE kids > {max_children} OR (kids >= {min_children} AND used < {min_use} * kids)),
t{i + 1} AS (SELECT s.host, s.path, s.n, s.labelled, s.blocked, s.segs, CASE WHEN seg IS NULL THEN s.template
         ELSE s.template || CASE WHEN wide AND lit THEN '*' ELSE seg END || '/' END AS template
         FROM s{i} s LEFT JOIN w{i} w ON s.host = w.host AND s.template = w.template)""")
    typed = ("list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE "
             "WHEN regexp_matches(s, '^[0-9]+(\\.[a-z]{1,5})?$') THEN regexp_replace(s, '^[0-9]+', '{n}') "
             "WHEN regexp_matches(s, '^[0-9a-fA-F-]{16,}$') THEN '{h}' ELSE s END)")
    return f"""
WITH r0 AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
r1 AS (SELECT page_id, coalesce({lower}, '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r0),
r AS (SELECT *, CASE {rule} END AS rule, CASE {action} END AS action FROM r1),
u AS (SELECT host, path, count(*) AS n, count(action) AS labelled, count(*) FILTER (action = 'block') AS blocked, {typed} AS typed
      FROM r GROUP BY host, path),
t0 AS (SELECT host, path, n, labelled, blocked, '/' AS template, CASE WHEN len(typed) > {depth}
       THEN list_append(typed[1:{depth}], array_to_string(typed[{depth + 1}:], '/')) ELSE typed END AS segs FROM u),
{','.join(steps)},
leaf0 AS (SELECT host, template, sum(labelled) AS labelled, sum(blocked) AS blocked FROM t{depth + 1} GROUP BY ALL),
tot AS (SELECT coalesce(sum(blocked) / nullif(sum(labelled), 0), 0.0) AS base FROM leaf0),
hosts AS (SELECT host, (sum(blocked) + {alpha} * any_value(base)) / (sum(labelled) + {alpha}) AS hp FROM leaf0, tot GROUP BY host),
leaf1 AS (SELECT l.*, hp, regexp_replace(template, '[^/]+/$', '') AS parent,
          (blocked + {alpha} * hp) / (labelled + {alpha}) AS rate, labelled + {alpha}::DOUBLE AS m FROM leaf0 l JOIN hosts USING (host)),
leaf2 AS (SELECT *, lag(rate) OVER w AS pr, lag(m) OVER w AS pm FROM leaf1 WINDOW w AS (PARTITION BY host, parent ORDER BY rate, template)),
leaf3 AS (SELECT *, (rate * m + pr * pm) / (m + pm) AS mean_rate FROM leaf2),
leaf4 AS (SELECT *, sum(CASE WHEN rate > pr AND rate - pr > {z} * sqrt(mean_rate * (1 - mean_rate) * (1 / m + 1 / pm)) THEN 1 ELSE 0 END)
          OVER (PARTITION BY host, parent ORDER BY rate, template) AS branch FROM leaf3),
pooled AS (SELECT host, parent, branch, (sum(blocked) + {alpha} * any_value(hp)) / (sum(labelled) + {alpha}) AS purity FROM leaf4 GROUP BY ALL)
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.action, CASE WHEN purity > {reject} THEN 'block' ELSE 'allow' END) AS verdict,
       t.template, l.branch::BIGINT AS branch, purity::DOUBLE AS purity
FROM r JOIN t{depth + 1} t USING (host, path) JOIN leaf4 l ON t.host = l.host AND t.template = l.template
JOIN pooled p ON p.host = l.host AND p.parent = l.parent AND p.branch = l.branch
"""
