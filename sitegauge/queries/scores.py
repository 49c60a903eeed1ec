"""Scores, summaries and rankings over check rows derived from ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranking as R
from ..operators import recommend as REC
from ..operators import reports as REP
from ..operators import scoring as S
from .common import CHECKS_SQL, CLAMP, check_rows, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


_POINTS = "CASE WHEN skipped THEN 0 WHEN passed THEN weight WHEN warning THEN weight / 2 ELSE 0 END"
_SHARE = "CASE WHEN sum({w}) > 0 THEN sum({p}) / sum({w}) ELSE {e} END"


@register("scope_scores", f"""WITH {CHECKS_SQL}
SELECT site_id, scope, CAST(floor(sum(CASE WHEN passed THEN weight ELSE 0 END) / sum(weight) * 100 + 0.5) AS INT) AS score
FROM checks GROUP BY ALL""")
def scope_scores(spark: SparkSession, d: str) -> DataFrame:
    return S.scope_scores(check_rows(spark, d))


@register("skip_aware_scores", f"""WITH {CHECKS_SQL}
SELECT site_id, audit, CASE WHEN sum(CASE WHEN skipped THEN 0 ELSE weight END) > 0
  THEN {CLAMP.format(f"sum({_POINTS}) / sum(CASE WHEN skipped THEN 0 ELSE weight END) * 100")} ELSE 100 END AS score
FROM checks GROUP BY ALL""")
def skip_aware_scores(spark, d):
    return S.skip_aware_scores(check_rows(spark, d), ("site_id", "audit"))


@register("unweighted_scope_scores", f"""WITH {CHECKS_SQL}
SELECT site_id, scope, CASE WHEN count(*) FILTER (NOT skipped) > 0
  THEN {CLAMP.format("count(*) FILTER (passed AND NOT skipped) / count(*) FILTER (NOT skipped) * 100")} ELSE 100 END AS score
FROM checks GROUP BY ALL""")
def unweighted_scope_scores(spark, d):
    return S.unweighted_scope_scores(check_rows(spark, d))


_SUMMARY_SQL = f"""
agg AS (
  SELECT site_id, audit, category, count(*) AS n_all, count(*) FILTER (NOT skipped) AS n_live,
    audit IN ('structured_data','image','eeat','trust') AS soft,
    count(*) FILTER (NOT skipped AND passed AND NOT (audit IN ('structured_data','image','eeat','trust') AND warning)) AS n_passed,
    count(*) FILTER (NOT skipped AND NOT passed AND NOT (audit IN ('structured_data','image','eeat','trust') AND warning)) AS n_failed,
    count(*) FILTER (CASE WHEN audit = 'technical' THEN NOT passed AND severity IN ('MINOR','ADVISORY')
      WHEN audit = 'answer_engine' THEN NOT skipped AND NOT passed AND severity = 'MINOR'
      WHEN audit = 'indexability' THEN NOT skipped AND NOT passed AND severity = 'Low'
      WHEN audit IN ('structured_data','image','eeat','trust') THEN NOT skipped AND warning ELSE false END) AS n_warn,
    count(*) FILTER (skipped) AS n_skip,
    count(*) FILTER (NOT skipped AND NOT passed AND NOT (audit IN ('structured_data','image','eeat','trust') AND warning)
      AND severity IN ('Critical','High')) AS n_urgent,
    count(*) FILTER (NOT skipped AND passed) AS n_ok,
    sum(CASE WHEN skipped THEN 0 ELSE weight END) AS w_live,
    sum(CASE WHEN skipped THEN 0 WHEN passed THEN weight WHEN warning AND audit <> 'on_page' THEN weight / 2 ELSE 0 END) AS w_points
  FROM checks GROUP BY ALL
), summary AS (
  SELECT site_id, audit, category,
    CAST(CASE WHEN audit = 'answer_engine' THEN n_live ELSE n_all END AS INT) AS total, CAST(n_passed AS INT) AS passed,
    CAST(n_failed AS INT) AS failed, CAST(n_warn AS INT) AS warnings, CAST(n_skip AS INT) AS skipped,
    CASE WHEN audit = 'answer_engine' THEN CASE WHEN n_live > 0 THEN {CLAMP.format("n_ok / n_live * 100")} ELSE 100 END
      WHEN w_live > 0 THEN {CLAMP.format("w_points / w_live * 100")}
      WHEN audit IN ('technical','indexability') THEN 0 ELSE 100 END AS score,
    CASE WHEN audit IN ('technical','answer_engine') THEN
        CASE WHEN n_failed = 0 THEN 'Passed' WHEN n_failed <= 2 THEN 'Minor Attention' ELSE 'Needs Attention' END
      WHEN audit = 'on_page' THEN CASE WHEN n_live = 0 THEN 'Skipped' WHEN n_failed = 0 THEN 'Passed'
        WHEN n_failed <= 1 THEN 'Minor Attention' ELSE 'Needs Attention' END
      WHEN audit = 'structured_data' THEN CASE WHEN n_failed = 0 AND n_warn = 0 THEN 'Passed'
        WHEN n_failed = 0 THEN 'Minor Attention' ELSE 'Needs Attention' END
      WHEN audit = 'indexability' THEN CASE WHEN n_live = 0 AND n_skip > 0 THEN 'Skipped' WHEN n_failed = 0 THEN 'Passed'
        WHEN n_urgent > 0 THEN 'Needs Attention' ELSE 'Minor Attention' END
      ELSE CASE WHEN n_live = 0 THEN 'Skipped' WHEN n_failed = 0 AND n_warn = 0 THEN 'Passed'
        WHEN n_failed = 0 THEN 'Minor Attention' ELSE 'Needs Attention' END END AS status
  FROM agg
)"""


@register("category_summary", f"WITH {CHECKS_SQL}, {_SUMMARY_SQL} SELECT * FROM summary")
def category_summary(spark, d):
    return S.category_summary(check_rows(spark, d))


@register("category_summary_per_order", f"""WITH {CHECKS_SQL.replace("l_suppkey AS site_id", "l_orderkey AS site_id")}, {_SUMMARY_SQL}
SELECT * FROM summary""")
def category_summary_per_order(spark, d):
    """Small groups, so that skipped-only and clean categories occur."""
    return S.category_summary(check_rows(spark, d).withColumn("site_id", F.col("line_order")))


_NAMES = [name for name, _ in S.ANSWER_CATEGORY_WEIGHTS]
_NAMED_SQL = "list_extract([" + ", ".join("'" + n.replace("'", "''") + "'" for n in _NAMES) + "], CAST(part % 18 + 1 AS INT))"
_WEIGHTS_SQL = "weights(category, w) AS (VALUES " + ", ".join(f"('{n}', {w})" for n, w in S.ANSWER_CATEGORY_WEIGHTS) + ")"
_ANSWER_SQL = f"""
named AS (SELECT * REPLACE ({_NAMED_SQL} AS category, 'answer_engine' AS audit,
    list_extract(['BLOCKER','MAJOR','MINOR','ADVISORY'], CAST(part % 4 + 1 AS INT)) AS severity) FROM checks),
cats AS (SELECT site_id, category, count(*) FILTER (NOT skipped) AS n_live, count(*) FILTER (NOT skipped AND passed) AS n_ok
  FROM named GROUP BY ALL),
scored AS (SELECT site_id, category, CASE WHEN n_live > 0 THEN {CLAMP.format("n_ok / n_live * 100")} ELSE 100 END AS score FROM cats),
{_WEIGHTS_SQL},
means AS (SELECT site_id, {CLAMP.format("sum(score * w) / sum(w)")} AS raw_score FROM scored JOIN weights USING (category) GROUP BY ALL)"""


def _named_checks(spark, d):
    names = F.array(*[F.lit(n) for n in _NAMES])
    hard = F.array(*[F.lit(s) for s in ("BLOCKER", "MAJOR", "MINOR", "ADVISORY")])
    return check_rows(spark, d).withColumn("category", F.element_at(names, (F.col("part") % 18 + 1).cast("int"))).withColumn(
        "severity", F.element_at(hard, (F.col("part") % 4 + 1).cast("int"))
    )


@register("category_weighted_mean", f"WITH {CHECKS_SQL}, {_ANSWER_SQL} SELECT site_id, raw_score AS score FROM means")
def category_weighted_mean(spark, d):
    cats = S.category_summary(_named_checks(spark, d).withColumn("audit", F.lit(S.ANSWER)))
    return S.category_weighted_mean(cats, S.answer_weights(spark))


@register("answer_engine_scores", f"""WITH {CHECKS_SQL}, {_ANSWER_SQL},
facts AS (SELECT site_id,
  CASE WHEN count(*) FILTER (NOT skipped AND scope = 'page') > 0 THEN {CLAMP.format("count(*) FILTER (NOT skipped AND scope = 'page' AND passed) / count(*) FILTER (NOT skipped AND scope = 'page') * 100")} ELSE 100 END AS page_score,
  CASE WHEN count(*) FILTER (NOT skipped AND scope = 'domain') > 0 THEN {CLAMP.format("count(*) FILTER (NOT skipped AND scope = 'domain' AND passed) / count(*) FILTER (NOT skipped AND scope = 'domain') * 100")} ELSE 100 END AS domain_score,
  bool_or(severity = 'BLOCKER' AND NOT passed AND NOT skipped) AS blocker_failed FROM named GROUP BY ALL)
SELECT site_id, page_score, domain_score, blocker_failed, raw_score,
  CASE WHEN blocker_failed THEN least(raw_score, 50) ELSE raw_score END AS score,
  CASE WHEN CASE WHEN blocker_failed THEN least(raw_score, 50) ELSE raw_score END >= 85 THEN 'A'
    WHEN CASE WHEN blocker_failed THEN least(raw_score, 50) ELSE raw_score END >= 70 THEN 'B'
    WHEN CASE WHEN blocker_failed THEN least(raw_score, 50) ELSE raw_score END >= 55 THEN 'C'
    WHEN CASE WHEN blocker_failed THEN least(raw_score, 50) ELSE raw_score END >= 40 THEN 'D' ELSE 'F' END AS grade
FROM facts JOIN means USING (site_id)""")
def answer_engine_scores(spark, d):
    return S.answer_engine_scores(_named_checks(spark, d))


_TECH_SQL = """
tech AS (SELECT {k} AS site_id,
  CAST(floor(coalesce(sum(CASE WHEN scope = 'page' AND passed THEN weight ELSE 0 END) / nullif(sum(CASE WHEN scope = 'page' THEN weight ELSE 0 END), 0), 0) * 100 + 0.5) AS INT) AS page_score,
  CAST(floor(coalesce(sum(CASE WHEN scope = 'domain' AND passed THEN weight ELSE 0 END) / nullif(sum(CASE WHEN scope = 'domain' THEN weight ELSE 0 END), 0), 0) * 100 + 0.5) AS INT) AS domain_score,
  bool_or(severity = 'BLOCKER' AND NOT passed) AS blocker_failed FROM checks GROUP BY ALL),
scored_tech AS (SELECT *, CAST(floor(page_score * CAST(0.7 AS DOUBLE) + domain_score * CAST(0.3 AS DOUBLE) + 0.5) AS INT) AS raw_score FROM tech),
final_tech AS (SELECT *, CASE WHEN blocker_failed THEN least(raw_score, 50) ELSE raw_score END AS score FROM scored_tech)"""


@register("technical_scores", f"""WITH {CHECKS_SQL}, {_TECH_SQL.format(k="line_order")}
SELECT *, CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 55 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM final_tech""")
def technical_scores(spark, d):
    """One site per order, so that few checks decide and every grade occurs."""
    return S.technical_scores(check_rows(spark, d).withColumn("site_id", F.col("line_order")))


@register("opportunity_counts", f"""WITH {CHECKS_SQL}
SELECT site_id, CAST(count(*) FILTER (NOT passed AND NOT skipped AND severity = 'BLOCKER') AS INT) AS high,
  CAST(count(*) FILTER (NOT passed AND NOT skipped AND severity = 'MAJOR') AS INT) AS medium,
  CAST(count(*) FILTER (NOT passed AND NOT skipped AND severity = 'MINOR') AS INT) AS low FROM checks GROUP BY ALL""")
def opportunity_counts(spark, d):
    return S.opportunity_counts(check_rows(spark, d))


@register("impact_counts", f"""WITH {CHECKS_SQL}
SELECT site_id, CAST(count(*) FILTER (NOT passed AND severity IN ('BLOCKER','Critical','High','MAJOR')) AS INT) AS high,
  CAST(count(*) FILTER (NOT passed AND severity IN ('Medium','MINOR')) AS INT) AS medium,
  CAST(count(*) FILTER (NOT passed AND severity IN ('Low','ADVISORY')) AS INT) AS low
FROM checks GROUP BY ALL""")
def impact_counts(spark, d):
    return S.impact_counts(check_rows(spark, d))


@register("checks_weighted_score", f"""WITH {CHECKS_SQL}, {_SUMMARY_SQL}
SELECT site_id, audit, CASE WHEN sum(CASE WHEN status <> 'Skipped' AND total > 0 THEN total ELSE 0 END) > 0
  THEN {CLAMP.format("sum(CASE WHEN status <> 'Skipped' AND total > 0 THEN score * total ELSE 0 END) / sum(CASE WHEN status <> 'Skipped' AND total > 0 THEN total ELSE 0 END)")} ELSE 0 END AS score,
  CAST(sum(failed) AS INT) AS issues FROM summary GROUP BY ALL""")
def checks_weighted_score(spark, d):
    return S.checks_weighted_score(S.category_summary(check_rows(spark, d)), ("site_id", "audit"))


_METRICS_SQL = "metric_ids(metric_ord, metric, check_id) AS (VALUES " + ", ".join(
    f"({i}, '{label}', {check})" for i, (label, _, ids) in enumerate(REP.LEAD_METRICS) for check in ids) + ")"


@register("failed_by_metric", f"""WITH {CHECKS_SQL}, {_METRICS_SQL}, wide AS (SELECT * REPLACE (CAST(part % 120 AS INT) AS check_id) FROM checks)
SELECT site_id, metric_ord, metric, CAST(count(*) FILTER (NOT passed) AS INT) AS failed FROM wide JOIN metric_ids USING (check_id) GROUP BY ALL""")
def failed_by_metric(spark, d):
    return REP.failed_by_metric(check_rows(spark, d).withColumn("check_id", (F.col("part") % 120).cast("int")))


@register("lead_metrics", f"""WITH {CHECKS_SQL}, {_METRICS_SQL}, wide AS (SELECT * REPLACE (CAST(part % 120 AS INT) AS check_id, line_order AS site_id) FROM checks),
counts AS (SELECT site_id, metric_ord, count(*) FILTER (NOT passed) AS n FROM wide JOIN metric_ids USING (check_id) GROUP BY ALL),
labels(metric_ord, metric) AS (VALUES {", ".join(f"({i}, '{label}')" for i, (label, _, _) in enumerate(REP.LEAD_METRICS))}),
scores AS (SELECT o_orderkey AS site_id, metric_ord, metric, CAST((CAST(floor(o_totalprice) AS BIGINT) + metric_ord * 17) % 101 AS INT) AS score FROM orders, labels)
SELECT site_id, metric_ord, metric, score, CAST(coalesce(n, 0) AS INT) AS failed,
  CAST(greatest(CASE WHEN score < 25 THEN 4 WHEN score < 45 THEN 3 WHEN score < 70 THEN 2 WHEN score < 85 THEN 1 ELSE 0 END, coalesce(n, 0)) AS INT) AS opportunities
FROM scores LEFT JOIN counts USING (site_id, metric_ord)""")
def lead_metrics(spark, d):
    checks = check_rows(spark, d).withColumn("check_id", (F.col("part") % 120).cast("int")).withColumn("site_id", F.col("line_order"))
    price = F.floor("o_totalprice")
    scores = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("site_id"),
        *[((price + i * 17) % 101).cast("int").alias(column) for i, (_, column, _) in enumerate(REP.LEAD_METRICS)],
    )
    return REP.lead_metrics(checks, scores)


@register("score_labels", """WITH s AS (SELECT o_orderkey AS site_id, CAST(CAST(floor(o_totalprice) AS BIGINT) % 101 AS INT) AS t, CAST(o_custkey % 101 AS INT) AS g FROM orders),
o AS (SELECT *, CAST(greatest(0, least(100, floor(t * CAST(0.4 AS DOUBLE) + g * CAST(0.6 AS DOUBLE) + 0.5))) AS INT) AS overall FROM s)
SELECT site_id, overall,
 CASE WHEN overall >= 85 THEN 'A' WHEN overall >= 70 THEN 'B' WHEN overall >= 55 THEN 'C' WHEN overall >= 40 THEN 'D' ELSE 'F' END AS grade,
 CASE WHEN overall < 25 THEN 'Critical' WHEN overall < 40 THEN 'Poor' WHEN overall < 55 THEN 'Below Average' WHEN overall < 70 THEN 'Average' WHEN overall < 85 THEN 'Strong' ELSE 'Excellent' END AS level,
 CASE WHEN overall <= 40 THEN 'Poor' WHEN overall <= 55 THEN 'Below Average' WHEN overall <= 70 THEN 'Average' WHEN overall <= 85 THEN 'Good' ELSE 'Excellent' END AS rating,
 CASE WHEN overall < 25 THEN 'Critical' WHEN overall < 45 THEN 'High' WHEN overall < 70 THEN 'Medium' ELSE 'Low' END AS risk,
 CASE WHEN g < 35 THEN 'Low' WHEN g < 65 THEN 'Moderate' WHEN g < 85 THEN 'Strong' ELSE 'Excellent' END AS authority,
 CASE WHEN overall >= 70 THEN 'Positive' WHEN overall >= 40 THEN 'Neutral' ELSE 'Negative' END AS sentiment,
 CASE WHEN overall >= 90 THEN 'Passed' WHEN overall >= 60 THEN 'Minor Attention' ELSE 'Needs Attention' END AS display,
 CASE WHEN overall >= 80 AND t >= 75 AND g >= 75 THEN 'strong' WHEN overall >= 65 AND t >= 60 THEN 'established' WHEN overall >= 45 THEN 'developing' ELSE 'early' END AS position,
 CASE WHEN overall < 25 THEN 4 WHEN overall < 45 THEN 3 WHEN overall < 70 THEN 2 WHEN overall < 85 THEN 1 ELSE 0 END AS floor_count
FROM o""")
def score_labels(spark, d):
    s = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("site_id"), (F.floor("o_totalprice") % 101).cast("int").alias("t"), (F.col("o_custkey") % 101).cast("int").alias("g")
    ).withColumn("overall", S.overall_score(F.col("t"), F.col("g")))
    o = F.col("overall")
    position = F.lower(F.split(S.market_position(o, F.col("t"), F.col("g")), "[ -]")[0])
    return s.select(
        "site_id", "overall", S.grade(o).alias("grade"), S.visibility_level(o).alias("level"), S.rating_label(o).alias("rating"),
        S.risk_level(o).alias("risk"), S.authority_strength(F.col("g")).alias("authority"), S.sentiment(o).alias("sentiment"),
        S.display_status(o, F.lit(False)).alias("display"), position.alias("position"), S.opportunity_floor(o).alias("floor_count"),
    )


@register("worst_categories", f"""WITH {CHECKS_SQL}, {_SUMMARY_SQL}
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY failed DESC, score, audit, category) AS rank
  FROM summary WHERE status <> 'Skipped' AND failed > 0) WHERE rank <= 3""")
def worst_categories(spark, d):
    return R.worst_categories(S.category_summary(check_rows(spark, d)))


def _tab_sql(pick: str) -> str:
    names = lambda values: ", ".join(f"'{v}'" for v in values)
    return {"all": "true", "crawl": f"category IN ({names(REP.CRAWLABILITY)})", "chat": f"category IN ({names(REP.CHAT_CITATION)})",
            "gemini": f"category IN ({names(REP.GEMINI_CITATION)})",
            "rest": f"category NOT IN ({names(REP.CHAT_CITATION + REP.GEMINI_CITATION)})"}[pick]


_TABS_SQL = " UNION ALL ".join(
    f"SELECT site_id, {i} AS tab_ord, '{label}' AS tab, audit, '{pick}' AS pick, total, failed, score, status FROM summary WHERE audit = '{audit}' AND {_tab_sql(pick)}"
    for i, (label, audit, pick) in enumerate(REP.TABS))
_TAB_SCORES_SQL = f"""
relabelled AS (SELECT * REPLACE ({_NAMED_SQL} AS category) FROM checks),
stored AS (SELECT site_id, audit, CASE WHEN sum(CASE WHEN skipped THEN 0 ELSE weight END) > 0
  THEN {CLAMP.format(f"sum({_POINTS}) / sum(CASE WHEN skipped THEN 0 ELSE weight END) * 100")} ELSE 100 END AS stored_score FROM relabelled GROUP BY ALL),
{_SUMMARY_SQL.replace("FROM checks GROUP BY ALL", "FROM relabelled GROUP BY ALL")},
tab_rows AS ({_TABS_SQL}),
folded AS (SELECT site_id, audit, tab_ord, tab, pick, CAST(sum(failed) AS INT) AS issues, CAST(count(*) AS INT) AS n_categories,
  CASE WHEN sum(CASE WHEN total > 0 AND status <> 'Skipped' THEN total ELSE 0 END) > 0 THEN
    {CLAMP.format("sum(CASE WHEN total > 0 AND status <> 'Skipped' THEN score * total ELSE 0 END) / sum(CASE WHEN total > 0 AND status <> 'Skipped' THEN total ELSE 0 END)")} END AS mean_score
  FROM tab_rows GROUP BY ALL),
tabs AS (SELECT site_id, tab_ord, tab, audit, CAST(CASE WHEN pick = 'all' THEN coalesce(stored_score, 0)
  WHEN pick = 'rest' THEN coalesce(mean_score, stored_score, 0) ELSE coalesce(mean_score, 0) END AS INT) AS score, issues, n_categories
  FROM folded LEFT JOIN stored USING (site_id, audit))"""


def _tabs(spark, d):
    names = F.array(*[F.lit(n) for n in _NAMES])
    checks = check_rows(spark, d).withColumn("category", F.element_at(names, (F.col("part") % 18 + 1).cast("int")))
    return REP.audit_tabs(S.category_summary(checks), S.skip_aware_scores(checks, ("site_id", "audit")))


@register("audit_tabs", f"WITH {CHECKS_SQL}, {_TAB_SCORES_SQL} SELECT * FROM tabs")
def audit_tabs(spark, d):
    return _tabs(spark, d)


@register("weakest_audits", f"""WITH {CHECKS_SQL}, {_TAB_SCORES_SQL}
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY score, issues DESC, tab_ord) AS rank FROM tabs) WHERE rank <= 2""")
def weakest_audits(spark, d):
    return R.weakest_audits(_tabs(spark, d))


@register("visibility_score", f"""WITH {CHECKS_SQL}, {_TAB_SCORES_SQL}, means AS (SELECT site_id, {CLAMP.format("sum(score) / 10")} AS m FROM tabs WHERE tab <> 'Crawlability' GROUP BY ALL)
SELECT site_id, CAST(CASE WHEN s_nationkey % 3 <> 0 THEN s_nationkey % 3 * 30 ELSE m END AS INT) AS score FROM means JOIN supplier ON s_suppkey = site_id""")
def visibility_score(spark, d):
    stored = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("site_id"),
        F.when(F.col("s_nationkey") % 6 == 0, None).otherwise((F.col("s_nationkey") % 3 * 30).cast("int")).alias("overall"),
    )
    return REP.visibility_score(_tabs(spark, d), stored)


@register("score_rollup", f"""WITH {CHECKS_SQL}, {_SUMMARY_SQL}
SELECT site_id, audit, category, CAST(GROUPING(site_id, audit, category) AS INT) AS level, CAST(sum(total) AS BIGINT) AS total,
  CAST(sum(passed) AS BIGINT) AS passed, CAST(sum(failed) AS BIGINT) AS failed FROM summary GROUP BY ROLLUP (site_id, audit, category)""")
def score_rollup(spark, d):
    return REP.rollup_scores(S.category_summary(check_rows(spark, d)))


@register("site_ranking", f"""WITH {CHECKS_SQL}, sc AS (SELECT site_id, audit, CASE WHEN sum(CASE WHEN skipped THEN 0 ELSE weight END) > 0
  THEN {CLAMP.format(f"sum({_POINTS}) / sum(CASE WHEN skipped THEN 0 ELSE weight END) * 100")} ELSE 100 END AS score FROM checks GROUP BY ALL)
SELECT site_id, audit, score, CAST(rank() OVER w AS BIGINT) AS rank, round(percent_rank() OVER w, 9) AS percent_rank FROM sc WINDOW w AS (PARTITION BY audit ORDER BY score DESC)""")
def site_ranking(spark, d):
    return REP.rank_sites(S.skip_aware_scores(check_rows(spark, d), ("site_id", "audit"))).withColumn("percent_rank", F.round("percent_rank", 9))


@register("missing_audits", f"""WITH {CHECKS_SQL},
sc AS (SELECT part AS site_id, audit, {CLAMP.format("sum(CASE WHEN passed THEN weight ELSE 0 END) / sum(weight) * 100")} AS score FROM checks GROUP BY ALL),
names(audit) AS (VALUES {", ".join(f"('{a}')" for a in S.AUDITS)})
SELECT p_partkey AS site_id, audit, score IS NOT NULL AS available,
  coalesce(score, CASE WHEN audit IN ('technical','answer_engine','indexability') THEN 0 ELSE 100 END) AS score
FROM part CROSS JOIN names LEFT JOIN sc ON sc.site_id = p_partkey AND sc.audit = names.audit""".replace("SELECT p_partkey AS site_id, audit, score", "SELECT p_partkey AS site_id, names.audit AS audit, score").replace("WHEN audit IN ('technical','answer_engine','indexability') THEN 0 ELSE 100 END) AS score\nFROM part", "WHEN names.audit IN ('technical','answer_engine','indexability') THEN 0 ELSE 100 END) AS score\nFROM part"))
def missing_audits(spark, d):
    """Every part as a site; the few lines of a part leave some of its audits without a result."""
    c = F.col
    scores = check_rows(spark, d).groupBy(c("part").alias("site_id"), "audit").agg(
        S.clamp_score(S.sum_if(c("passed"), c("weight")) / F.sum("weight") * 100).alias("score")
    ).withColumn("grade", S.grade(c("score"))).withColumn("blocker_failed", F.lit(False))
    sites = table(spark, d, "part").select(c("p_partkey").alias("site_id"))
    return S.with_missing_audits(scores, sites).select("site_id", "audit", "available", "score")


@register("first_failing_samples", """WITH r AS (SELECT l_suppkey AS site_id, l_discount < 0.06 AS ok, l_orderkey * 10 + l_linenumber AS ord, 'p' || l_orderkey || '-' || l_linenumber AS url FROM lineitem)
SELECT site_id, CAST(count(*) AS INT) AS total, CAST(count(*) FILTER (ok) AS INT) AS passed, min_by(url, ord) FILTER (NOT ok) AS first_issue,
  array_to_string(list_slice(list(url ORDER BY ord) FILTER (NOT ok), 1, 3), ' ') AS samples FROM r GROUP BY ALL""")
def first_failing_samples(spark, d):
    c = F.col
    rows = table(spark, d, "lineitem").select(
        c("l_suppkey").alias("site_id"), (c("l_discount") < 0.06).alias("ok"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("ord"),
        F.concat(F.lit("p"), c("l_orderkey"), F.lit("-"), c("l_linenumber")).alias("url"),
    )
    return R.first_failing(rows, "site_id", c("ok"), "url", "ord").withColumn("samples", F.array_join("samples", " "))


_FAILED_SQL = """f AS (SELECT l_suppkey AS site_id, CAST(l_partkey % 120 + 1 AS INT) AS check_id, count(*) AS n FROM lineitem
  GROUP BY ALL HAVING 2 * sum(CAST(round(l_discount * 100) AS BIGINT)) > 11 * count(*)),
failed AS (SELECT site_id, check_id, 'Check no. ' || check_id AS name, 'Group ' || (check_id % 5) AS category,
  list_extract(['BLOCKER','MAJOR','MINOR','ADVISORY'], check_id % 4 + 1) AS severity, CAST(check_id % 11 AS DOUBLE) AS weight, 'n=' || n AS evidence_text FROM f)"""


def _quote(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


_RULES_SQL = "rules(check_id, rule_ord, recommendation, expected_impact, fixed) AS (VALUES " + ", ".join(
    f"({i}, {o}, {_quote(advice)}, {_quote(effect)}, {_quote(fixed)})"
    for o, (ids, advice, effect, fixed) in enumerate(REC.RULES) for i in ids) + ")"


@register("recommendations", f"""WITH {_FAILED_SQL}, {_RULES_SQL},
advice AS (SELECT site_id, rule_ord AS ord, any_value(recommendation) AS recommendation, any_value(expected_impact) AS expected_impact,
  CASE any_value(fixed) WHEN 'Medium Priority' THEN 1 ELSE min(CASE WHEN severity IN ('BLOCKER','MAJOR') THEN 0 WHEN severity = 'MINOR' THEN 1 ELSE 2 END) END AS pr,
  string_agg(name || ': ' || evidence_text, '; ' ORDER BY check_id) AS reason FROM failed JOIN rules USING (check_id) GROUP BY site_id, rule_ord),
per_site AS (SELECT site_id, string_agg(reason, chr(10)) AS reasons, count(*) AS n FROM advice GROUP BY ALL),
rest AS (SELECT f.*, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY f.site_id ORDER BY weight DESC, check_id) AS place FROM failed f LEFT JOIN per_site p USING (site_id)
  WHERE severity <> 'ADVISORY' AND (reasons IS NULL OR NOT contains(reasons, name))),
fill AS (SELECT site_id, {len(REC.RULES)} + place AS ord, 'Fix ' || lower(name) AS recommendation,
  'Improves ' || lower(category) || ' signals by resolving the failed "' || name || '" audit check.' AS expected_impact,
  CASE WHEN severity IN ('BLOCKER','MAJOR') THEN 0 WHEN severity = 'MINOR' THEN 1 ELSE 2 END AS pr, category || ': ' || evidence_text AS reason
  FROM rest WHERE place <= greatest(0, 6 - n)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY site_id ORDER BY pr, ord) AS INT) AS rank FROM (SELECT site_id, ord, recommendation, expected_impact, pr, reason FROM advice UNION ALL SELECT * FROM fill))
SELECT site_id, rank, list_extract(['High Priority','Medium Priority','Low Priority'], CAST(pr + 1 AS INT)) AS priority, recommendation, reason, expected_impact FROM ranked WHERE rank <= 12""")
def recommendations(spark, d):
    c = F.col
    # a check of a site fails when its lines have a mean discount above 5.5 %
    counts = table(spark, d, "lineitem").groupBy(
        c("l_suppkey").alias("site_id"), (c("l_partkey") % 120 + 1).cast("int").alias("check_id")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(c("l_discount") * 100).cast("bigint")).alias("discount")).where("2 * discount > 11 * n")
    hard = F.array(*[F.lit(s) for s in ("BLOCKER", "MAJOR", "MINOR", "ADVISORY")])
    failed = counts.select(
        "site_id", "check_id", F.concat(F.lit("Check no. "), "check_id").alias("name"),
        F.concat(F.lit("Group "), c("check_id") % 5).alias("category"), F.element_at(hard, c("check_id") % 4 + 1).alias("severity"),
        (c("check_id") % 11).cast("double").alias("weight"), F.concat(F.lit("n="), "n").alias("evidence_text"),
    )
    return REC.recommend(failed)


@register("issue_summary", """WITH r AS (SELECT o_custkey AS site_id, count(*) FILTER (o_orderpriority IN ('1-URGENT','2-HIGH')) AS h, count(*) FILTER (o_orderpriority = '3-MEDIUM') AS m,
  count(*) FILTER (o_orderpriority IN ('4-NOT SPECIFIED','5-LOW')) AS l, count(*) AS n FROM orders GROUP BY ALL),
s AS (SELECT c_custkey AS site_id, CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) % 101 AS INT) AS visibility_score FROM customer),
j AS (SELECT site_id, visibility_score, greatest(CASE WHEN visibility_score < 25 THEN 4 WHEN visibility_score < 45 THEN 3 WHEN visibility_score < 70 THEN 2 WHEN visibility_score < 85 THEN 1 ELSE 0 END, coalesce(h, 0)) AS high,
  greatest(CASE WHEN visibility_score < 70 THEN 2 ELSE 1 END, coalesce(m, 0)) AS medium, coalesce(l, 0) AS low, coalesce(n, 0) AS n FROM s LEFT JOIN r USING (site_id))
SELECT site_id, visibility_score, CAST(high AS INT) AS high, CAST(medium AS INT) AS medium, CAST(low AS INT) AS low, CAST(greatest(0, greatest(high + medium + low, n) - 3) AS INT) AS additional FROM j""")
def issue_summary(spark, d):
    c = F.col
    priority = F.when(c("o_orderpriority").isin("1-URGENT", "2-HIGH"), "High Priority").when(
        c("o_orderpriority") == "3-MEDIUM", "Medium Priority").otherwise("Low Priority")
    found = table(spark, d, "orders").select(c("o_custkey").alias("site_id"), priority.alias("priority"))
    scores = table(spark, d, "customer").select(
        c("c_custkey").alias("site_id"), (F.floor(F.abs("c_acctbal")) % 101).cast("int").alias("visibility_score"))
    return REP.issue_summary(found, scores)


@register("public_reports")
def public_reports(spark, d):
    """P5: nested report per supplier as site (nested rows have no SQL twin)."""
    c = F.col
    sites = table(spark, d, "supplier").select(
        c("s_suppkey").alias("site_id"), c("s_name").alias("brand_name"), F.lit("https://x.example/").alias("website_url"))
    rows = check_rows(spark, d).withColumn("name", F.concat(F.lit("check "), "check_id")).withColumn("evidence_text", F.lit(""))
    checks = R.last_wins(rows.withColumn("place", F.struct("line_order", "part")), ["site_id", "audit", "check_id"], "place")
    categories = S.category_summary(checks).withColumn("category_ord", F.lit(0))
    scores = S.with_missing_audits(S.audit_scores(checks), sites)
    classified = sites.select(
        "site_id", F.lit("Software").alias("industry"), F.lit("SaaS").alias("sub_industry"), F.lit("Subscription Software").alias("business_model"),
        (c("site_id") % 100).cast("int").alias("confidence"))
    return REP.public_report(sites, scores, categories, checks, classified, REC.classification_recommendation(classified))


_SUBS = ("Cleaning Services", "Dermatology", "IT  SERVICES", "Services")


@register("audit_prompts", f"""WITH s AS (SELECT s_suppkey AS site_id, s_name AS b, lower(list_extract([{", ".join(f"'{x}'" for x in _SUBS)}], CAST(s_suppkey % 4 + 1 AS INT))) AS c FROM supplier),
t AS (SELECT *, regexp_replace(c, '\\s+services$', '') AS sh FROM s)
SELECT site_id, CAST(unnest(range(0, 5)) AS INT) AS prompt_ord, unnest([b || ' ' || sh || ' services', b || ' ' || c || ' reviews', 'Is ' || b || ' a good ' || sh || ' provider',
  b || ' subscription software', b || ' health care credibility']) AS prompt FROM t""")
def audit_prompts(spark, d):
    """P9."""
    c = F.col
    subs = F.array(*[F.lit(x) for x in _SUBS])
    sites = table(spark, d, "supplier").select(
        c("s_suppkey").alias("site_id"), c("s_name").alias("brand_name"), F.element_at(subs, (c("s_suppkey") % 4 + 1).cast("int")).alias("sub_industry"),
        F.lit("Subscription Software").alias("business_model"), F.lit("Health Care").alias("industry"))
    return REP.prompts(sites)


_CITED = [*REP.CHAT_CITATION, *REP.GEMINI_CITATION, "Something Else"]
_ADVICE_SQL = ", ".join(f"({i}, {_quote(text)})" for i, text in REP.CITATION_ADVICE.items())


@register("citation_reports", f"""WITH a(check_id, advice) AS (VALUES {_ADVICE_SQL}),
checks AS (SELECT p_partkey AS site_id, CAST((p_partkey + 7 * j) % 80 AS INT) AS check_id, list_extract([{", ".join(_quote(x) for x in _CITED)}], CAST((p_partkey + j) % {len(_CITED)} + 1 AS INT)) AS category,
  (p_partkey + j) % 5 = 0 AS skipped, (p_partkey + j) % 3 = 0 AS passed FROM part, (SELECT unnest(range(0, 6)) AS j)),
pages AS (SELECT l_partkey AS site_id, 'u' || l_orderkey || '-' || l_linenumber AS url, l_orderkey * 10 + l_linenumber AS ord FROM lineitem),
n AS (SELECT site_id, CAST(count(*) AS INT) AS n_pages, array_to_string(list(url ORDER BY ord, url)[1:3], ' ') AS urls FROM pages GROUP BY ALL)
SELECT c.site_id, c.check_id, category, skipped, CASE WHEN NOT skipped THEN coalesce(advice, {_quote(REP.DEFAULT_ADVICE)}) END AS advice,
  CASE WHEN NOT skipped THEN coalesce(n_pages, 0) END AS affected_pages, CASE WHEN NOT skipped THEN urls END AS sample_urls
FROM checks c LEFT JOIN a USING (check_id) LEFT JOIN n USING (site_id) WHERE category <> 'Something Else' AND (skipped OR NOT passed)""")
def citation_reports(spark, d):
    """Six checks per part as site, its lines as pages."""
    c = F.col
    rows = table(spark, d, "part").select(c("p_partkey").alias("site_id"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("j"))
    at = c("site_id") + c("j")
    checks = rows.select(
        "site_id", ((c("site_id") + 7 * c("j")) % 80).cast("int").alias("check_id"), F.lit("n").alias("name"), F.lit("High").alias("severity"),
        F.element_at(F.array(*[F.lit(x) for x in _CITED]), (at % len(_CITED) + 1).cast("int")).alias("category"),
        (at % 5 == 0).alias("skipped"), (at % 3 == 0).alias("passed"))
    pages = table(spark, d, "lineitem").select(
        c("l_partkey").alias("site_id"), F.concat(F.lit("u"), c("l_orderkey"), F.lit("-"), c("l_linenumber")).alias("url"),
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("ord"))
    out = REP.citation_details(checks, pages)
    return out.select("site_id", "check_id", "category", "skipped", "advice", "affected_pages", F.array_join("sample_urls", " ").alias("sample_urls"))
