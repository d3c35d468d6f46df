"""Queries over learners: cohort metrics, scores, statistics, scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import scalars as S
from ..operators import cohort, scoring, stats
from .catalog import query
from .views import NINE

CLEAN = "replace(replace(replace(lower({}), '-', ''), '_', ''), ' ', '')"
SCORE = "coalesce(score, CASE WHEN total <> 0 THEN correct / total * 100 END)"


def milestone_sql(word: str) -> str:
    key = CLEAN.format("assessment_key")
    return f"(SELECT email, arg_min({SCORE}, assessment_key) AS score FROM v_assessments WHERE contains({key}, '{word}') AND {SCORE} IS NOT NULL GROUP BY email)"


PAIRS = f"SELECT a.email, a.score AS pre, b.score AS post FROM {milestone_sql('pretest')} a JOIN {milestone_sql('posttest')} b USING (email)"


def pre_post(assessments: DataFrame) -> tuple[DataFrame, DataFrame]:
    return cohort.milestone_scores(assessments, ["pretest"], "pre"), cohort.milestone_scores(assessments, ["posttest"], "post")


@query("prj1_clean_key", "v_assessments", sql=f"SELECT email, {CLEAN.format('assessment_key')} AS k FROM v_assessments")
def _(a):
    return a.select("email", S.clean_key(F.col("assessment_key")).alias("k"))


@query("prj2_extract_score", "v_assessments", sql=f"SELECT email, assessment_key, round({SCORE}, 6) AS s FROM v_assessments")
def _(a):
    return a.select("email", "assessment_key", F.round(S.extract_score(F.col("score"), F.col("correct"), F.col("total")), 6).alias("s"))


@query("prj3_milestone_score", "v_assessments", sql=f"SELECT email, round(score, 6) AS score FROM {milestone_sql('posttest')}")
def _(a):
    return cohort.milestone_scores(a, ["post-test", "Post Test"]).select("email", F.round("score", 6).alias("score"))


TESTS = "list_filter(string_split(tests, ','), lambda t: t <> '')"


def _counted(cat: str, passed: bool) -> str:
    mine = f"split_part(t, ':', 1) = '{cat}'" if cat != "functional" else "split_part(t, ':', 1) NOT IN ('complexity', 'hidden')"
    return f"CAST(len(list_filter({TESTS}, lambda t: {mine}{' AND split_part(t, ' + chr(39) + ':' + chr(39) + ', 2) = ' + chr(39) + 'passed' + chr(39) if passed else ''})) AS DOUBLE)"


def _resolved(cat: str, passed: bool) -> str:
    counted = _counted(cat, passed)
    if cat == "complexity":
        return counted
    return f"CASE WHEN coalesce({cat}_total > 0, false) THEN {f'coalesce({cat}_passed, 0)' if passed else f'{cat}_total'} ELSE {counted} END"


CATS = ("functional", "complexity", "hidden")
SPLIT = ", ".join(f"{_resolved(c, p)} AS {c}_{'passed' if p else 'total'}_n" for c in CATS for p in (True, False))
ROWS = f"""(SELECT *, CASE WHEN coalesce(total0 > 0, false) AND passed0 IS NOT NULL THEN passed0 END AS tsr_passed,
      CASE WHEN coalesce(total0 > 0, false) AND passed0 IS NOT NULL THEN total0 END AS tsr_total,
      CASE WHEN coalesce(type = 'optimization', false) AND final_aes IS NOT NULL THEN coalesce(rog, 0) END AS rog_value,
      coalesce(final_aes >= 50, false) OR coalesce(status = 'passed', false) AS done
   FROM (SELECT *, coalesce(nullif(total_tests, 0), nullif(total_cases, 0), ct) AS total0,
           CASE WHEN passed_tests IS NULL OR (passed_tests = 0 AND cp > 0) THEN coalesce(nullif(passed_cases, 0), cp) ELSE passed_tests END AS passed0
         FROM (SELECT *, functional_passed_n + complexity_passed_n + hidden_passed_n AS cp, functional_total_n + complexity_total_n + hidden_total_n AS ct
               FROM (SELECT *, {SPLIT} FROM v_submissions))))"""
METRICS = "round(avg(final_aes), 10) AS aes, round(avg(rog_value), 10) AS rog, count(rog_value) AS rog_count, count(*) FILTER (code_unchanged) AS unchanged, round(avg(tsr_passed / tsr_total) * 100, 10) AS tsr, count(*) AS attempted, count(*) FILTER (done) AS passed, " + ", ".join(f"sum({c}_{w}_n) AS {c}_{w}" for c in CATS for w in ("passed", "total"))


@query("prj4_test_breakdown", "v_submissions", sql=f"SELECT sub_id, {', '.join(f'{_counted(c, p)} AS {c}_{p}' for c in CATS for p in ('1', ''))} FROM v_submissions".replace("functional_1", "functional_p").replace("complexity_1", "complexity_p").replace("hidden_1", "hidden_p").replace("AS functional_,", "AS functional_t,").replace("AS complexity_,", "AS complexity_t,").replace("AS hidden_ ", "AS hidden_t "))
def _(s):
    split = cohort.test_breakdown(F.col("tests"), {})
    return s.select("sub_id", *[c.alias(f"{n}_{w}") for n, pair in split.items() for c, w in zip(pair, "pt", strict=True)])


@query(
    "prj5_profile_breakdown", "v_submissions",
    sql=f"""SELECT sub_id, CAST(CASE WHEN known THEN len(list_filter(ts, lambda t: starts_with(t, 'functional:'))) ELSE greatest(len(ts) - 2, 0) END AS DOUBLE) AS functional_total,
              CAST(CASE WHEN known THEN len(list_filter(ts, lambda t: starts_with(t, 'complexity:'))) ELSE least(len(ts), 2) END AS DOUBLE) AS complexity_total,
              CAST(CASE WHEN known THEN len(list_filter(ts, lambda t: t = 'complexity:passed')) ELSE len(list_filter(ts[greatest(len(ts) - 1, 1):], lambda t: ends_with(t, ':passed'))) END AS DOUBLE) AS complexity_passed,
              CAST(least(len(list_filter(ts, lambda t: starts_with(t, 'hidden:'))), 1) AS DOUBLE) AS hidden_total,
              CAST(least(len(list_filter(ts, lambda t: t = 'hidden:passed')), 1) AS DOUBLE) AS hidden_passed
            FROM (SELECT sub_id, {TESTS} AS ts, len(list_filter({TESTS}, lambda t: split_part(t, ':', 1) IN ('functional', 'complexity', 'hidden'))) > 0 AS known FROM v_submissions)""",
)
def _(s):
    parts = cohort.profile_breakdown(F.col("tests"), F.lit(1))
    return s.select("sub_id", *[c.alias(n) for n, c in parts.items()])


@query("prj6_resolve_counts", "v_submissions", sql=f"SELECT sub_id, tsr_passed, tsr_total FROM {ROWS}")
def _(s):
    return cohort.submission_rows(s).select("sub_id", "tsr_passed", "tsr_total")


@query("prj7_submission_rows", "v_submissions", sql=f"SELECT sub_id, owner, coalesce(module, 'unknown') AS module, activity, type, status, final_aes, rog_value, tsr_passed, tsr_total, done, {', '.join(f'{c}_{w}_n' for c in CATS for w in ('passed', 'total'))} FROM {ROWS}")
def _(s):
    return cohort.submission_rows(s).select("sub_id", "owner", F.coalesce("module", F.lit("unknown")).alias("module"), "activity", "type", "status", "final_aes", "rog_value", "tsr_passed", "tsr_total", "done", *[f"{c}_{w}_n" for c in CATS for w in ("passed", "total")])


@query(
    "prj8_submission_details", "v_submissions",
    sql="""SELECT owner, module, activity, coalesce(type, 'activity') AS type, status, sub_id, coalesce(latest_aes, final_aes) AS aes,
             CASE WHEN type = 'optimization' THEN coalesce(rog, 0) END AS rog, code_unchanged, ts,
             CAST(row_number() OVER (PARTITION BY owner ORDER BY CAST(ts AS VARCHAR) DESC, sub_id, final_aes NULLS FIRST) AS INT) AS place FROM v_submissions""",
)
def _(s):
    return cohort.submission_details(s)


@query("prj9_counts_toward_rog", "v_submissions", sql="SELECT sub_id, coalesce(type = 'optimization', false) AND final_aes IS NOT NULL AS counts FROM v_submissions")
def _(s):
    return s.select("sub_id", cohort.counts_toward_rog().alias("counts"))


@query(
    "prj10_interpret", "v_submissions",
    sql="""SELECT sub_id, CASE WHEN d >= 0.8 THEN 'Large Effect' WHEN d >= 0.5 THEN 'Medium Effect' WHEN d >= 0.2 THEN 'Small Effect' WHEN d IS NOT NULL THEN 'Negligible Effect' END AS effect,
             CASE WHEN g >= 0.7 THEN 'High Gain' WHEN g >= 0.3 THEN 'Medium Gain' WHEN g IS NOT NULL THEN 'Low Gain' END AS gain
           FROM (SELECT sub_id, abs(50 - final_aes) / 50 AS d, final_aes / 100 AS g FROM v_submissions)""",
)
def _(s):
    return s.select("sub_id", S.interpret_effect((F.lit(50) - F.col("final_aes")) / 50).alias("effect"), S.interpret_gain(F.col("final_aes") / 100).alias("gain"))


@query(
    "prj20_identity", "v_changes",
    sql="SELECT seq, ends_with(lower(trim(email)), '@guest.local') AS guest, lower(trim(upper(email))) AS email FROM v_changes",
)
def _(c):
    return c.select("seq", S.is_guest(F.col("email")).alias("guest"), S.canonical_email(F.upper("email")).alias("email"))


@query("prj21_validate_status", "v_users", sql="SELECT email, CASE WHEN lower(trim(s)) IN ('active', 'suspended') THEN lower(trim(s)) END AS status FROM (SELECT email, CASE WHEN user_key % 7 = 0 THEN 'gone' ELSE ' ' || upper(status) END AS s FROM v_users)")
def _(u):
    return u.select("email", S.valid_status(F.when(F.col("user_key") % 7 == 0, "gone").otherwise(F.concat(F.lit(" "), F.upper("status")))).alias("status"))


@query("prj22_activity_done", "v_submissions", sql="""SELECT sub_id, coalesce(least(CASE WHEN m = 5 AND v <= 5 THEN v / 5 * 100 ELSE v END, 100) >= 50, false) OR coalesce(status = 'passed', false) AS done
    FROM (SELECT sub_id, status, coalesce(final_aes, latest_aes, 0) AS v, CASE WHEN activity = 'a1' THEN 5 ELSE 100 END AS m FROM v_submissions)""")  # fmt: skip
def _(s):
    return s.select("sub_id", cohort.activity_done(F.col("final_aes"), F.col("latest_aes"), F.when(F.col("activity") == "a1", 5).otherwise(100), F.col("status")).alias("done"))


@query("prj23_search_users", "v_users", sql="SELECT email, name, role, status FROM v_users WHERE (contains(lower(name), '7') OR contains(lower(email), '7')) AND role = 'learner' AND status = 'active'")
def _(u):
    return cohort.search_users(u, "7", "learner", "active").select("email", "name", "role", "status")


@query("prj26_round_finite", "lineitem", sql="SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN l_discount = 0 THEN NULL ELSE round_even(l_quantity / l_discount, 2) END AS r FROM lineitem")
def _(x):
    ratio = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.try_divide("l_quantity", "l_discount"))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", S.round_finite(ratio, 2).alias("r"))


@query(
    "prj27_anonymise", "v_users", "v_submissions",
    sql="""WITH o AS (SELECT DISTINCT email, 0 AS part FROM v_users WHERE user_key % 3 = 0 UNION ALL
                     SELECT DISTINCT owner, 1 FROM v_submissions WHERE owner NOT IN (SELECT email FROM v_users WHERE user_key % 3 = 0))
           SELECT email, CASE WHEN n < 10 THEN 'S0' ELSE 'S' END || n AS respondent FROM (SELECT email, row_number() OVER (ORDER BY part, email) AS n FROM o)""",
)
def _(u, s):
    return cohort.respondent_ids(u.where("user_key % 3 = 0"), s)


@query("jn1_scope_cohort", "v_users", "v_assessments", sql=f"SELECT email, name FROM v_users WHERE NOT is_admin AND email IN (SELECT email FROM {milestone_sql('posttest')}) AND email IN (SELECT email FROM v_users WHERE user_key % 2 = 0)")
def _(u, a):
    return cohort.scope(u, pre_post(a)[1], u.where("user_key % 2 = 0")).select("email", "name")


@query("jn2_flag_completers", "v_users", "v_assessments", sql=f"SELECT email, email IN (SELECT email FROM {milestone_sql('posttest')}) AS completed FROM v_users")
def _(u, a):
    return cohort.flag_completers(u, pre_post(a)[1]).select("email", "completed")


@query("prj23_post_test", "v_users", "v_assessments", sql=f"SELECT email, name, role, status FROM v_users WHERE (contains(lower(name), '7') OR contains(lower(email), '7')) AND role = 'learner' AND email NOT IN (SELECT email FROM {milestone_sql('posttest')})")
def _(u, a):
    flagged = cohort.flag_completers(u, pre_post(a)[1])
    return cohort.search_users(flagged, "7", "learner", post_test=False).select("email", "name", "role", "status")


@query("jn3_pair_pre_post", "v_assessments", sql=f"SELECT email, round(pre, 6) AS pre, round(post, 6) AS post, round(post - pre, 6) AS difference FROM ({PAIRS})")
def _(a):
    return cohort.pair_pre_post(*pre_post(a)).select("email", *[F.round(c, 6).alias(c) for c in ("pre", "post", "difference")])


@query("jn4_rollup_users", "v_users", "v_submissions", sql=f"SELECT email, aes, coalesce(attempted, 0) AS attempted, coalesce(passed, 0) AS passed FROM v_users LEFT JOIN (SELECT owner, {METRICS} FROM {ROWS} GROUP BY owner) ON email = owner")
def _(u, s):
    m = cohort.submission_metrics(cohort.submission_rows(s), [["owner"]]).drop("module", "level")
    return cohort.rollup_users(u.select("email"), m).select("email", "aes", "attempted", "passed")


@query("jn12_in_roster", "v_submissions", "v_users", sql="SELECT sub_id, CAST(owner IN (SELECT email FROM v_users WHERE status = 'active') AS INT) AS in_roster FROM v_submissions")
def _(s, u):
    return cohort.in_roster(s, u.where("status = 'active'")).select("sub_id", "in_roster")


@query("agg1_submission_metrics", "v_submissions", sql=f"SELECT module, owner, CAST(grouping(module) * 2 + grouping(owner) AS BIGINT) AS level, {METRICS} FROM (SELECT * REPLACE (coalesce(module, 'unknown') AS module) FROM {ROWS}) GROUP BY GROUPING SETS ((), (module), (owner), (module, owner))")
def _(s):
    return cohort.submission_metrics(cohort.submission_rows(s))


@query("agg29_weighted_rollup", "v_submissions", sql=f"SELECT module, round(sum(aes * n) FILTER (aes IS NOT NULL) / sum(n) FILTER (aes IS NOT NULL), 6) AS aes, CAST(sum(n) AS BIGINT) AS n FROM (SELECT coalesce(module, 'unknown') AS module, activity, round(avg(final_aes), 6) AS aes, count(*) AS n FROM {ROWS} GROUP BY ALL) GROUP BY module")
def _(s):
    children = s.groupBy(F.coalesce("module", F.lit("unknown")).alias("module"), "activity").agg(F.round(F.avg("final_aes"), 6).alias("aes"), F.count("*").alias("n"))
    return cohort.weighted_rollup(children, "module", "aes", "n")


@query("set2_intersection", "v_users", "v_assessments", sql=f"SELECT email FROM ({PAIRS}) INTERSECT SELECT email FROM v_users WHERE status = 'active'")
def _(u, a):
    return cohort.pair_pre_post(*pre_post(a)).select("email").intersect(u.where("status = 'active'").select("email"))


# statistics

@query("agg2_descriptives", "v_assessments", sql=f"WITH p AS ({PAIRS}) SELECT 'pre' AS variable, count(pre) AS n, round(avg(pre), 6) AS mean, round(stddev_samp(pre), 6) AS sd FROM p UNION ALL SELECT 'post', count(post), round(avg(post), 6), round(stddev_samp(post), 6) FROM p")
def _(a):
    return stats.descriptives(cohort.pair_pre_post(*pre_post(a)), ["pre", "post"]).select("variable", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


GROUPED = f"SELECT *, CAST(substr(email, 2, 1) AS INT) AS grp FROM ({PAIRS})"
T_SQL = f"SELECT grp, n, md, sd, CASE WHEN sd > 0 THEN md / (sd / sqrt(n)) END AS t, n - 1 AS df, mp, mq FROM (SELECT grp, count(*) AS n, avg(post - pre) AS md, stddev_samp(post - pre) AS sd, avg(pre) AS mp, avg(post) AS mq FROM ({GROUPED}) GROUP BY grp)"


def _tests(a):
    return stats.paired_t(cohort.pair_pre_post(*pre_post(a)).withColumn("grp", F.substring("email", 2, 1).cast("int")), ["grp"])


@query("agg3_paired_t", "v_assessments", sql=f"SELECT grp, n, round(md, 6) AS mean_difference, round(sd, 6) AS sd_difference, round(t, 6) AS t, df FROM ({T_SQL})")
def _(a):
    return _tests(a).select("grp", "n", *[F.round(c, 6).alias(c) for c in ("mean_difference", "sd_difference", "t")], "df")


@query("fn1_paired_p", "v_assessments")
def _(a):
    return _tests(a).select("grp", "t", "df", "p", "significant")


@query("fn2_t_critical", "v_assessments")
def _(a):
    return _tests(a).select("grp", "df", stats.t_critical(F.col("df").cast("double")).alias("t_critical"))


@query("agg4_effect_sizes", "v_assessments", sql=f"SELECT grp, round(md / sd, 6) AS cohens_d, round((round_even(mq, 2) - round_even(mp, 2)) / (100 - round_even(mp, 2)), 6) AS hakes_g, round((mq - mp) / (100 - mp), 6) AS hakes_g_unrounded FROM ({T_SQL})")
def _(a):
    return stats.effect_sizes(_tests(a)).select("grp", *[F.round(c, 6).alias(c) for c in ("cohens_d", "hakes_g", "hakes_g_unrounded")])


RESP = f"""SELECT u.email, p.score AS pre, q.score AS post, tsr, aes, rog FROM v_users u LEFT JOIN {milestone_sql('pretest')} p USING (email) LEFT JOIN {milestone_sql('posttest')} q USING (email)
           LEFT JOIN (SELECT owner AS email, round(avg(tsr_passed / tsr_total) * 100, 10) AS tsr, round(avg(final_aes), 10) AS aes, round(avg(rog_value), 10) AS rog FROM {ROWS} GROUP BY owner) m USING (email) WHERE NOT is_admin"""
INCL = f"SELECT * FROM ({RESP}) WHERE pre IS NOT NULL AND post IS NOT NULL AND tsr IS NOT NULL AND aes IS NOT NULL AND rog IS NOT NULL"
ZED = f"SELECT *, (tsr - avg(tsr) OVER ()) / stddev_samp(tsr) OVER () AS z_tsr, (aes - avg(aes) OVER ()) / stddev_samp(aes) OVER () AS z_aes, (rog - avg(rog) OVER ()) / stddev_samp(rog) OVER () AS z_rog FROM ({INCL})"
COMP = f"SELECT *, (z_tsr + z_aes + z_rog) / 3 AS x, CASE WHEN pre <> 100 THEN (post - pre) / (100 - pre) END AS y FROM ({ZED})"
FIT = f"SELECT regr_count(y, x) AS n, regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0, regr_r2(y, x) AS r2, corr(y, x) AS r, sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (regr_count(y, x) - 2) / regr_sxx(y, x)) AS se FROM ({COMP})"


def respondents(u: DataFrame, a: DataFrame, s: DataFrame) -> DataFrame:
    m = cohort.submission_metrics(cohort.submission_rows(s), [["owner"]]).select(F.col("owner").alias("email"), "tsr", "aes", "rog")
    pre, post = pre_post(a)
    return cohort.scope(u).select("email").join(pre, "email", "left").join(post, "email", "left").join(m, "email", "left")


def _points(u, a, s):
    return stats.composite(stats.included(respondents(u, a, s)))


@query("agg5_zscores", "v_users", "v_assessments", "v_submissions", sql=f"SELECT email, round(z_tsr, 6) AS z_tsr, round(z_aes, 6) AS z_aes, round(z_rog, 6) AS z_rog FROM ({ZED})")
def _(u, a, s):
    return stats.zscores(stats.included(respondents(u, a, s)), ["tsr", "aes", "rog"]).select("email", *[F.round(f"z_{m}", 6).alias(f"z_{m}") for m in stats.METRICS])


@query("agg6_composite", "v_users", "v_assessments", "v_submissions", sql=f"SELECT email, round(x, 6) AS x, round(y, 6) AS y FROM ({COMP})")
def _(u, a, s):
    return _points(u, a, s).select("email", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("agg7_ols", "v_users", "v_assessments", "v_submissions", sql=f"SELECT n, round(b1, 6) AS b1, round(b0, 6) AS b0, round(se, 6) AS se, round(r, 6) AS r, round(r2, 6) AS r2, round(b1 / se, 6) AS t, n - 2 AS df FROM ({FIT})")
def _(u, a, s):
    return stats.ols(_points(u, a, s)).select("n", *[F.round(c, 6).alias(c) for c in ("b1", "b0", "se", "r", "r2", "t")], "df")


@query("agg7_ols_p", "v_users", "v_assessments", "v_submissions")
def _(u, a, s):
    return stats.ols(_points(u, a, s)).select("n", "p", "ci_low", "ci_high")


@query("agg7_residuals", "v_users", "v_assessments", "v_submissions", sql=f"SELECT email, round(b0 + b1 * x, 6) AS fitted, round(y - (b0 + b1 * x), 6) AS residual FROM ({COMP}) c, ({FIT}) f WHERE y IS NOT NULL")
def _(u, a, s):
    p = _points(u, a, s)
    return stats.residuals(p, stats.ols(p)).where("y is not null").select("email", F.round("fitted", 6).alias("fitted"), F.round("residual", 6).alias("residual"))


@query("agg8_pearson", "v_submissions", sql="SELECT module, round(CASE WHEN stddev_samp(initial_aes) > 0 AND stddev_samp(passed_tests) > 0 THEN corr(initial_aes, passed_tests) END, 6) AS r FROM v_submissions WHERE passed_tests IS NOT NULL GROUP BY module")
def _(s):
    return stats.pearson(s.where("passed_tests is not null"), "initial_aes", "passed_tests", ["module"]).select("module", F.round("r", 6).alias("r"))


@query("agg9_fit_warnings", "v_users", "v_assessments", "v_submissions", sql=f"SELECT count(*) AS n, avg(CASE WHEN post >= 89 THEN 1.0 ELSE 0 END) >= 0.8 AS ceiling, coalesce(abs(corr(tsr, aes)) > 0.8, false) AS overlap, count(*) < 50 AS small_sample, count(*) >= 8 AS available FROM ({INCL})")
def _(u, a, s):
    return stats.fit_warnings(stats.included(respondents(u, a, s)))


@query(
    "agg10_exclusions", "v_users", "v_assessments", "v_submissions",
    sql=f"""WITH r AS ({RESP}) SELECT reason, count(*) AS n FROM (SELECT 'no pre-test score' AS reason FROM r WHERE pre IS NULL UNION ALL SELECT 'no post-test score' FROM r WHERE post IS NULL
            UNION ALL SELECT 'no scored submissions (TSR/AES unavailable)' FROM r WHERE tsr IS NULL OR aes IS NULL UNION ALL SELECT 'no refactor submission (ROG unavailable)' FROM r WHERE rog IS NULL) GROUP BY reason""",
)
def _(u, a, s):
    return stats.exclusion_reasons(respondents(u, a, s))


@query(
    "agg11_sensitivity", "v_users", "v_assessments", "v_submissions",
    sql=f"""WITH c AS ({COMP}), f AS ({FIT}), w AS (SELECT email FROM c, f WHERE y IS NOT NULL ORDER BY abs(y - (b0 + b1 * x)) DESC, email LIMIT 1)
            SELECT regr_count(y, x) AS n, round(regr_slope(y, x), 6) AS b1, round(regr_r2(y, x), 6) AS r2 FROM c WHERE email NOT IN (SELECT email FROM w)""",
)
def _(u, a, s):
    p = _points(u, a, s)
    return stats.sensitivity_refit(p, stats.ols(p)).select("n", F.round("b1", 6).alias("b1"), F.round("r2", 6).alias("r2"))


@query("agg33_scatter_line", "v_users", "v_assessments", "v_submissions", sql=f"WITH c AS ({COMP}), f AS ({FIT}), e AS (SELECT min(x) AS lo, max(x) AS hi FROM c WHERE y IS NOT NULL) SELECT round(x, 6) AS x, round(b0 + b1 * x, 6) AS y FROM (SELECT lo AS x FROM e UNION ALL SELECT hi FROM e), f")
def _(u, a, s):
    p = _points(u, a, s)
    return stats.scatter_line(p, stats.ols(p)).select(F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


# labels and scoring

# What the test labels come to (canonical spelling, folded as it is, folded once spelled, ordinal), written out so that the SQL does not follow our tables.
GOLDEN = {
    "O(1)": ("O(1)", "O(1)", "O(1)", 1),
    "O(log n)": ("O(log n)", "O(log n)", "O(log n)", 2),
    "O(sqrt n)": ("O(sqrt n)", "O(sqrt n)", "O(sqrt n)", 3),
    "O(n)": ("O(n)", "O(n)", "O(n)", 4),
    "O(n log n)": ("O(n log n)", "O(n log n)", "O(n log n)", 6),
    "O(n^2)": ("O(n^2)", "O(n^2)", "O(n^2)", 7),
    "O(2^n)": ("O(2^n)", "O(2^n)", "O(2^n)", 8),
    "O(n!)": ("O(n!)", "O(n!)", "O(n!)", 9),
    "O(V + E)": ("O(V + E)", "O(V + E)", "O(V + E)", 5),
    "o(log n)": ("O(log n)", "o(log n)", "O(log n)", 2),
    "sqrt(n)": ("O(sqrt n)", "sqrt(n)", "O(sqrt n)", 3),
    "Linear": ("O(n)", "Linear", "O(n)", 6),
    "quadratic": ("O(n^2)", "quadratic", "O(n^2)", 6),
    "O(V+E)": ("O(V + E)", "O(V + E)", "O(V + E)", 5),
    "O(n * m)": ("O(n^2)", "O(n^2)", "O(n^2)", 7),
    "O(m^2 + e)": ("O(m^2+e)", "O(n^2)", "O(n^2)", 5),
    "O(n^3)": ("O(n^3)", "O(n^3)", "O(n^3)", 6),
    "constant": ("O(1)", "constant", "O(1)", 6),
    "-": ("-", "-", "-", 6),
    "T(n) = 2T(n/2) + O(n)": ("O(t(n)=2t(n/2)+o(n))", "T(n) = 2T(n/2) + O(n)", "O(t(n)=2t(n/2)+o(n))", 6),
    "O(n^1.58)": ("O(n^1.58)", "O(n^1.58)", "O(n^1.58)", 6),
    "O(n + m)": ("O(n+m)", "O(n)", "O(n)", 5),
    "3^n": ("O(3^n)", "3^n", "O(3^n)", 6),
}


def golden_sql(c: str, which: int) -> str:
    """DuckDB text for the golden value of a label."""
    return f"CASE {c} " + " ".join(f"WHEN {k!r} THEN {v[which]!r}" for k, v in GOLDEN.items()) + " END"


def _spelled_sql(c: str) -> str:
    return f"coalesce({golden_sql(c, 0)}, '-')"


def _weight_sql(c: str, default: int = 0) -> str:
    return f"coalesce({golden_sql(c, 3)}, {default})"


LABELS = ("target_time", "target_space", "latest_time", "latest_space", "baseline_time", "baseline_space")
ALL_LABELS = "(" + " UNION ".join(f"SELECT {c} AS label FROM v_submissions" for c in LABELS) + ")"


def _labels(s: DataFrame) -> DataFrame:
    return scoring.distinct_labels(s, list(LABELS))


@query("prj11_normalize", "v_submissions", sql=f"SELECT label, {_spelled_sql('label')} AS spelled FROM {ALL_LABELS}")
def _(s):
    return _labels(s).select("label", L.normalize(F.col("label")).alias("spelled"))


@query("prj12_fold", "v_submissions", sql=f"SELECT label, {golden_sql('label', 1)} AS folded FROM {ALL_LABELS}")
def _(s):
    return _labels(s).select("label", L.fold(F.col("label")).alias("folded"))


@query("prj13_labels_match", "v_submissions", sql=f"WITH m AS (SELECT label, {golden_sql('label', 2)} AS folded FROM {ALL_LABELS}) SELECT sub_id, CASE WHEN baseline_space IS NULL OR baseline_space IN ('', '-') THEN true WHEN latest_time IS NULL OR latest_time IN ('', '-') THEN false ELSE a.folded = b.folded END AS ok FROM v_submissions LEFT JOIN m a ON latest_time = a.label LEFT JOIN m b ON baseline_space = b.label")
def _(s):
    s = L.once(s, {"got": "latest_time", "want": "baseline_space"}, L.canonical)
    return s.select("sub_id", L.agree(F.col("latest_time"), F.col("baseline_space"), F.col("got") == F.col("want")).alias("ok"))


@query("prj14_weight", "v_submissions", sql=f"SELECT label, {_weight_sql('label', 6)} AS w FROM {ALL_LABELS}")
def _(s):
    return _labels(s).select("label", L.weight(F.col("label"), 6).alias("w"))


# What the test labels' names come to.
BUCKETS = {"O(1)": "constant", "o(log n)": "log", "O(log n)": "log", "O(sqrt n)": "sqrt", "O(n)": "linear", "O(n log n)": "nlogn", "O(n^2)": "quadratic", "O(2^n)": "exponential", "O(n!)": "factorial", "O(V + E)": "graph", "O(V+E)": "graph", "O(n * m)": "quadratic", "O(m^2 + e)": "unknown", "O(n^3)": "polyHigh", "T(n) = 2T(n/2) + O(n)": "nlogn", "O(n^1.58)": "nlogn", "O(n + m)": "graph"}


@query("prj15_bucket", "v_submissions", sql=f"SELECT label, CASE label {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in BUCKETS.items())} ELSE 'unknown' END AS name FROM {ALL_LABELS}")
def _(s):
    return _labels(s).select("label", L.bucket(F.col("label")).alias("name"))


RANKS = {"O(1)": (1, 0), "O(log n)": (5, 0.5), "O(sqrt n)": (7, 0.7), "O(n)": (10, 1), "O(n log n)": (15, 0.5), "O(n^2)": (20, 2), "O(2^n)": (100, 4), "O(n!)": (150, 5), "O(V + E)": (12, 3)}


@query("prj16_rank", "v_predictions", sql=f"SELECT program, CAST(CASE expected_time {' '.join(f'WHEN {k!r} THEN {v[0]}' for k, v in RANKS.items())} END AS DOUBLE) AS time_rank, CAST(CASE expected_space {' '.join(f'WHEN {k!r} THEN {v[1]}' for k, v in RANKS.items())} END AS DOUBLE) AS space_rank FROM v_predictions")
def _(p):
    p = L.once(L.once(p, {"time_rank": "expected_time"}, L.rank), {"space_rank": "expected_space"}, L.space_rank)
    return p.select("program", "time_rank", "space_rank")


EVAL = {"O(1)": "1.0", "O(log n)": "log2(n)", "O(sqrt n)": "sqrt(n)", "O(n)": "n", "O(n log n)": "n * log2(n)", "O(n^2)": "n * n", "O(2^n)": "pow(2, n)", "O(V + E)": "n"}


@query("prj17_growth_eval", "v_predictions", sql=f"SELECT expected_time, n, count(*) AS programs, round(CAST(max(CASE expected_time {' '.join(f'WHEN {k!r} THEN {v}' for k, v in EVAL.items())} WHEN 'O(n!)' THEN factorial(n) END) AS DOUBLE), 3) AS steps FROM v_predictions, (SELECT unnest([2, 5, 10, 15]) AS n) GROUP BY expected_time, n")
def _(p):
    per = p.groupBy("expected_time").agg(F.count("*").alias("programs")).withColumn("n", F.explode(F.array(*map(F.lit, (2, 5, 10, 15)))))
    return per.select("expected_time", "n", "programs", F.round(L.growth_eval(F.col("expected_time"), F.col("n")), 3).alias("steps"))


@query("prj18_practical_limit", "v_predictions")
def _(p):
    return p.groupBy("expected_time").agg(F.count("*").alias("programs")).select("expected_time", "programs", L.practical_limit(F.col("expected_time")).alias("limit"))


@query("prj19_tolerant_get", "events", sql="SELECT event_id, CAST(props->>'$.k' AS VARCHAR) AS v FROM events")
def _(e):
    return e.select("event_id", S.tolerant_get(F.col("props"), ["missing", "K"]).alias("v"))


@query("set4_distinct_labels", "v_submissions", sql=f"SELECT label FROM {ALL_LABELS} WHERE label IS NOT NULL")
def _(s):
    return _labels(s).where("label is not null")


@query("jn9_lookup_weights", "v_submissions", sql="SELECT sub_id, " + ", ".join(f"CASE WHEN {c} IS NULL OR {c} = '' THEN NULL ELSE CAST({_weight_sql(c, 6)} AS DOUBLE) END AS w_{c}" for c in LABELS) + " FROM v_submissions")
def _(s):
    return scoring.lookup_weights(s, list(LABELS)).select("sub_id", *[F.col(f"w_{c}").cast("double").alias(f"w_{c}") for c in LABELS])


def _w(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR {c} = '' THEN NULL ELSE {_weight_sql(c, 6)} END"


WORK = f"""(SELECT *, CASE WHEN NOT opt OR aes IS NULL THEN NULL WHEN base IS NOT NULL THEN greatest(0, aes - base) ELSE coalesce(rog, aes) END AS rog_calc
  FROM (SELECT *, CASE WHEN final_aes IS NULL THEN NULL WHEN code_unchanged THEN final_aes WHEN aes_latest IS NOT NULL THEN greatest(aes_latest, CASE WHEN final_aes > latest_aes THEN final_aes ELSE 0 END) ELSE final_aes END AS aes,
        CASE WHEN opt THEN coalesce(initial_aes, base_calc) END AS base
    FROM (SELECT *, floor(tsr0 * (least(1.0, tt::DOUBLE / lt) + least(1.0, ts2::DOUBLE / ls)) / 2 * 100) AS aes_latest, CASE WHEN opt THEN floor((least(1.0, tt::DOUBLE / bt) + least(1.0, ts2::DOUBLE / bs)) / 2 * 100) END AS base_calc
      FROM (SELECT *, coalesce(type = 'optimization', false) AS opt, CASE WHEN functional_total > 0 THEN coalesce(functional_passed, 0) / functional_total ELSE 1.0 END AS tsr0,
              {_w('target_time')} AS tt, {_w('target_space')} AS ts2, {_w('latest_time')} AS lt, {_w('latest_space')} AS ls, {_w('baseline_time')} AS bt, {_w('baseline_space')} AS bs FROM v_submissions))))"""


@query("agg27_workings", "v_submissions", sql=f"SELECT sub_id, round(tsr0, 6) AS functional_rate, CAST(aes_latest AS DOUBLE) AS aes_latest_calc, CAST(aes AS DOUBLE) AS aes_calc, CAST(base AS DOUBLE) AS base_calc, CAST(rog_calc AS DOUBLE) AS rog_calc FROM {WORK}")
def _(s):
    return scoring.workings(s).select("sub_id", F.round("functional_rate", 6).alias("functional_rate"), "aes_latest_calc", "aes_calc", "base_calc", "rog_calc")


def _cmp(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 'n/a' WHEN {a} = {b} THEN 'OK' ELSE 'DIFF' END"


@query("agg28_reconcile", "v_submissions", sql=f"SELECT latest_check, final_check, rog_check, count(*) AS n FROM (SELECT {_cmp('aes_latest', 'latest_aes')} AS latest_check, {_cmp('aes', 'final_aes')} AS final_check, {_cmp('rog_calc', 'rog')} AS rog_check FROM {WORK}) GROUP BY ALL")
def _(s):
    return scoring.reconcile(scoring.workings(s)).groupBy("latest_check", "final_check", "rog_check").agg(F.count("*").alias("n"))


assert NINE == L.CLASSES
