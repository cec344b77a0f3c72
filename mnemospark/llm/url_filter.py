"""URL filters: path rules of hosts and, where none fits, trust carried along the links between hosts.

Hosts are linked by the absolute links of all pages (counted per pair before any join). Personalised
PageRank carries trust from hosts with allowed pages along links, and distrust from hosts with blocked
pages against them: who links to a blocked host earns distrust. Without any links hosts keep their own shares.
Rank is conserved and spreads, so that in a connected graph all ranks are small; a host's score is its rank over
what it would hold of a whole seed without inflow. That is the sum of DAMPING^k P^k seeds over all k: whatever
dead ends give back to the seeds scales all hosts alike and cancels out. Hosts whose distrust exceeds their
trust by `threshold` are blocked.

The sum is built by doubling, (1 + A)(1 + A^2)(1 + A^4)..., so that 128 steps along the links need some twenty
written tables, until what is missing is below TOLERANCE for every host; a sum that does not settle is an error.

Defined cases: a null url or one without `://` has empty host and path and the method's verdict for the
empty host; null html has no links; repeated pages count each; very long pages are searched whole; the longest
rule wins, of equally long ones the later; other columns are not looked at, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, hot_join, materialize, table

#: (rule, verdict); a rule is host/path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-6, 0.25
#: Steps along the links between two written tables, and doublings until the sum must have settled.
STRIDE, MOST = 8, 11
_LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*((?:https?:)?//[^"'\s<>]+)"""


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", ""))
    return ascii_lower(F.coalesce(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", ""))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null."""
    fits = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):  # later ones, the longer, win
        name, _, rest = rule.partition("/")
        here = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        fits = F.when(here, rule).otherwise(fits)
    return fits


def judged_pages(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule of pages(page_id, url)."""
    held = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return held.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): absolute links between different hosts, over whole pages(url, html)."""
    links = F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1)))
    target = F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), F.col("link"))).otherwise(F.col("link"))
    held = pages.select(host_of(F.col("url")).alias("src"), links.alias("link")).select("src", host_of(target).alias("dst"))
    return held.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def _steps(score: DataFrame, steps: DataFrame, n: int, damping: float) -> DataFrame:
    """(kind, host, score) carried n steps along steps(kind, src, dst, share), written every STRIDE steps."""
    for k in range(1, n + 1):
        sent = score.join(steps, (score["kind"] == steps["_kind"]) & (score["host"] == steps["src"]))
        score = sent.groupBy("kind", F.col("dst").alias("host")).agg((damping * F.sum(F.col("score") * F.col("share"))).alias("score"))
        if k % STRIDE == 0 or k == n:
            score = materialize(score, f"rank-{n}-{k}")
    return score


def propagate(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, score) of seeds(kind, host, seed) over links(kind, src, dst, n); kinds are graphs of their own."""
    out = links.groupBy("kind", "src").agg(F.sum("n").alias("total")).withColumnsRenamed({"kind": "_kind", "src": "_src"})
    steps = links.join(out, (links["kind"] == out["_kind"]) & (links["src"] == out["_src"])).select("_kind", "src", "dst", (F.col("n") / F.col("total")).alias("share"))
    steps = materialize(steps, "rank-links")
    score = materialize(seeds.where("seed > 0").select("kind", "host", F.col("seed").alias("score")), "rank-seeds")
    for k in range(MOST):
        far = _steps(score, steps, 1 << k, damping)
        moved = far.agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
        if not moved:
            return score
        score = materialize(score.union(far).groupBy("kind", "host").agg(F.sum("score").alias("score")), f"rank-sum-{k}")
        kept = damping ** (1 << k)
        if moved * kept / (1 - kept) < tolerance:
            return score
    raise RuntimeError("the ranks did not settle")


def host_scores(judged: DataFrame, links: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """host, trust, distrust, blocked. A host's seeds are the shares of its pages that rules allow and block."""
    is_ = lambda verdict: F.avg(F.coalesce(F.col("rule").isin([r for r, v in rules if v == verdict]), F.lit(False)).cast("double"))
    seeds = materialize(judged.groupBy("host").agg(is_("allow").alias("trust"), is_("block").alias("distrust")), "host-seeds")
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("seed")) for k in ("trust", "distrust"))))
    ways = F.explode(F.array(F.struct(F.lit("trust").alias("kind"), "src", "dst"), F.struct(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"))))
    score = propagate(seeds.select("host", kinds.alias("k")).select("k.kind", "host", "k.seed"), links.select(ways.alias("w"), "n").select("w.*", "n"))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    both = seeds.select("host", F.lit(None).cast("string").alias("kind"), F.lit(0.0).alias("score")).unionByName(score).groupBy("host").agg(of("trust"), of("distrust"))
    return both.withColumn("blocked", F.col("distrust") - F.col("trust") > threshold)


def filter_urls(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for each row of pages(page_id, url, html)."""
    judged = materialize(judged_pages(pages, rules), "judged-pages")
    links = materialize(host_links(pages), "host-links")
    scores = materialize(host_scores(judged, links, rules, threshold), "host-scores")
    by_rule = reduce(lambda c, r: c.when(F.col("rule") == r[0], r[1]), rules, F.when(F.lit(False), ""))
    # a host with a large share of the pages is looked up apart
    held = hot_join(judged, scores.withColumnRenamed("host", "_host"), {"host": "_host"})
    verdict = F.coalesce(by_rule, F.when(F.col("blocked"), "block").otherwise("allow"))
    return held.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")


def _rounded(found: DataFrame) -> DataFrame:
    return found.withColumns({k: F.round(k, 4) for k in ("trust", "distrust")})


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(filter_urls(table(spark, sf_dir, "pages")))


def interlinked(pages: DataFrame) -> DataFrame:
    """pages with a link each to another page's host: the tables' own pages link to their own hosts only."""
    named = pages.select(F.col("page_id").alias("_id"), host_of(F.col("url")).alias("_host"))
    other = F.floor(F.col("page_id") / 3).cast("long")
    return pages.join(named, other == F.col("_id"), "left").withColumn("html", F.concat("html", F.lit('<a href="http://'), "_host", F.lit('/">'))).drop("_id", "_host")


def url_filter_interlinked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7's operator where hosts do link to each other."""
    return _rounded(filter_urls(interlinked(table(spark, sf_dir, "pages"))))


def _sql(pages: str) -> str:
    """The operator from its definition; the sum over 200 steps."""
    az = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    host = lambda url: f"translate(coalesce(regexp_extract(CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) END, '^([^/?#]*)', 1), ''), {az})"
    rules = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in RULES)
    link = _LINK.replace("'", "''")
    return f"""
WITH RECURSIVE own AS (SELECT page_id, url, html, {host('url')} AS host FROM pages),
p AS MATERIALIZED (SELECT row_number() OVER () AS r, page_id, url, host, html, coalesce(regexp_extract(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '^[^/?#]*([^?#]*)', 1), '') AS path FROM ({pages})),
rules(rule, name, start, verdict) AS (VALUES {rules}),
fit AS (SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS said FROM p JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY 1),
j AS MATERIALIZED (SELECT p.r, page_id, host, path, rule, said FROM p LEFT JOIN fit USING (r)),
to_ AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS url FROM p),
link AS (SELECT src, {host("CASE WHEN starts_with(url, '//') THEN 'x:' || url ELSE url END")} AS dst FROM to_),
n AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM link WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY 1, 2),
ways AS (SELECT 'trust' AS kind, src, dst, n FROM n UNION ALL SELECT 'distrust', dst, src, n FROM n),
steps AS MATERIALIZED (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS share FROM ways),
seed AS MATERIALIZED (SELECT 'trust' AS kind, host, avg(CASE WHEN said = 'allow' THEN 1e0 ELSE 0e0 END) AS d FROM j GROUP BY 2 UNION ALL SELECT 'distrust', host, avg(CASE WHEN said = 'block' THEN 1e0 ELSE 0e0 END) FROM j GROUP BY 2),
walk(k, kind, host, d) AS (SELECT 0, kind, host, d FROM seed WHERE d > 0 UNION ALL
  SELECT k + 1, w.kind, dst, {DAMPING}e0 * sum(d * share) FROM walk w JOIN steps s ON s.kind = w.kind AND s.src = w.host WHERE k < 200 GROUP BY 1, 2, 3),
score AS (SELECT host, coalesce(sum(d) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(d) FILTER (kind = 'distrust'), 0) AS distrust FROM walk GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN coalesce(distrust, 0) - coalesce(trust, 0) > {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict,
  round(coalesce(trust, 0), 4) AS trust, round(coalesce(distrust, 0), 4) AS distrust FROM j LEFT JOIN score USING (host)
"""


OP7_SQL = _sql("SELECT * FROM own")
INTERLINKED_SQL = _sql("""SELECT a.page_id, a.url, a.host, a.html || '<a href="http://' || b.host || '/">' AS html FROM own a LEFT JOIN own b ON b.page_id = a.page_id // 3""")
