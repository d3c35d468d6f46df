"""Queries over progress, merges, streams, graphs, sources and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import cohort
from ..operators import graph as G
from ..operators import merge as M
from ..operators import evaluation as E
from ..operators import progress as P
from ..operators import quantiles as Q
from ..session import cut, written
from ..sources import tables as T
from ..streaming import rules as R
from .catalog import query, shared
from .learners import METRICS, PAIRS, ROWS, pre_post
from .views import NINE, view

# progress

DONE = "SELECT DISTINCT owner, module, activity FROM v_submissions WHERE module IS NOT NULL AND (coalesce(final_aes >= 90, false) OR (status = 'passed' AND final_aes >= 70))"
# A course of seven modules with a lesson of four activities and an optimization step of three.
COURSE = """(SELECT m * 2 + CASE WHEN a > 4 THEN 1 ELSE 0 END AS step, 'm' || m AS module, 'a' || a AS activity, a > 4 AS is_opt, CASE WHEN m < 3 THEN 'Beginner' WHEN m < 5 THEN 'Intermediate' ELSE 'Advanced' END AS difficulty
  FROM (SELECT unnest(range(7)) AS m) CROSS JOIN (SELECT unnest(range(1, 8)) AS a))"""
STEPS = f"""steps AS (SELECT o.owner, c.step, c.module, c.is_opt, c.activities, coalesce(f.finished, 0) AS finished,
    CASE WHEN c.is_opt THEN least(2, c.activities) WHEN difficulty = 'Beginner' THEN least(3, c.activities) WHEN difficulty = 'Intermediate' THEN least(2, c.activities) ELSE least(1, c.activities) END AS needed
    FROM (SELECT DISTINCT owner FROM v_submissions) o CROSS JOIN (SELECT step, module, is_opt, min(difficulty) AS difficulty, count(*) AS activities FROM {COURSE} GROUP BY step, module, is_opt) c
    LEFT JOIN (SELECT owner, step, count(*) AS finished FROM ({DONE}) d JOIN {COURSE} k USING (module, activity) GROUP BY owner, step) f ON o.owner = f.owner AND c.step = f.step)"""
GATES = "pre AS (SELECT email, user_key % 9 <> 0 AS pre_test_done, is_admin FROM v_users)"


def course(spark: SparkSession) -> DataFrame:
    rows = [(m * 2 + (a > 4), f"m{m}", f"a{a}", a > 4, "Beginner" if m < 3 else "Intermediate" if m < 5 else "Advanced") for m in range(7) for a in range(1, 8)]
    return spark.createDataFrame(rows, "step int, module string, activity string, is_opt boolean, difficulty string")


def _steps(s: DataFrame, rule: str = "path") -> DataFrame:
    done = s.where("module is not null and (coalesce(final_aes >= 90, false) or (status = 'passed' and final_aes >= 70))")
    steps = P.curriculum_join(course(s.sparkSession), s, done)
    return steps.withColumn("needed", P.minimum_needed(F.col("activities"), F.col("difficulty"), F.col("is_opt"), rule))


@query("jn8_curriculum_join", "v_submissions", sql=f"WITH {STEPS} SELECT owner, step, module, is_opt, activities, finished FROM steps")
def _(s):
    return _steps(s).select("owner", "step", "module", "is_opt", "activities", "finished")


def _unlocked(s, u):
    gates = u.select(F.col("email").alias("owner"), (F.col("user_key") % 9 != 0).alias("pre_test_done"), "is_admin")
    return P.unlock_map(_steps(s).join(gates, "owner"))


@query("win1_unlock_map", "v_submissions", "v_users", sql=f"""WITH {STEPS}, {GATES} SELECT owner, step, finished >= needed AS met, NOT is_admin AND (NOT pre_test_done OR coalesce(max(CASE WHEN finished < needed THEN 1 ELSE 0 END) OVER (PARTITION BY owner ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1) AS locked FROM steps JOIN pre ON owner = email""")
def _(s, u):
    return _unlocked(s, u).select("owner", "step", "met", "locked")


@query("win2_module_complete", "v_submissions", sql=f"WITH {STEPS} SELECT owner, module, bool_and(finished >= needed) AS complete FROM steps GROUP BY owner, module")
def _(s):
    return P.module_complete(_steps(s))


@query("win2_curriculum_complete", "v_submissions", sql=f"WITH {STEPS} SELECT owner, bool_and(finished >= needed) AS complete FROM steps GROUP BY owner")
def _(s):
    return P.curriculum_complete(P.module_complete(_steps(s)))


@query("win3_attempt_history", "v_attempts", sql="""WITH a AS (SELECT *, coalesce(lag(trim(code)) OVER w = trim(code) AND trim(code) <> '', false) AS code_unchanged, first_value(aes) OVER w AS baseline, row_number() OVER w AS attempt FROM v_attempts WINDOW w AS (PARTITION BY owner, activity ORDER BY ts, attempt_id, aes)),
    b AS (SELECT *, max(CASE WHEN NOT code_unchanged THEN aes END) OVER (PARTITION BY owner, activity ORDER BY ts, attempt_id, aes ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM a)
    SELECT owner, activity, CAST(attempt AS INT) AS attempt, code_unchanged, baseline, best, CASE WHEN type = 'optimization' THEN greatest(0, best - baseline) ELSE 0 END AS gain FROM b""")  # fmt: skip
def _(a):
    return P.attempt_history(a).select("owner", "activity", "attempt", "code_unchanged", "baseline", "best", "gain")


@query("win4_attempt_number", "v_attempts", sql="SELECT owner, activity, attempt_id, aes, CAST(row_number() OVER (PARTITION BY owner, activity ORDER BY ts, attempt_id, aes) AS INT) AS attempt FROM v_attempts")
def _(a):
    return P.attempt_history(a).select("owner", "activity", "attempt_id", "aes", "attempt")


@query("win5_recent_items", "v_attempts", sql="SELECT owner, attempt_id, ts, aes FROM v_attempts QUALIFY row_number() OVER (PARTITION BY owner ORDER BY ts DESC, attempt_id, aes) <= 5")
def _(a):
    return P.recent_items(a, "owner", 5, F.desc("ts"), F.col("attempt_id"), F.col("aes")).select("owner", "attempt_id", "ts", "aes")


@query("win6_page", "v_users", sql="SELECT email, name FROM v_users WHERE status = 'active' ORDER BY email LIMIT 20 OFFSET 40")
def _(u):
    return Q.page(u.where("status = 'active'").select("email", "name"), ["email"], 20, 3)


LINED = """(SELECT program, bool_and(ok) AS correct, count(expected) AS truth_lines, count(*) FILTER (expected IS NOT NULL AND NOT ok) AS failed_lines
    FROM (SELECT program, p.label AS predicted, e.label AS expected, e.label IS NULL OR coalesce(p.label = e.label, false) AS ok FROM v_predicted_lines p FULL JOIN v_expected_lines e USING (program, lineno)) GROUP BY program)"""
TABS = {"all": "true", "overall_pass": "correct", "line_pass": "truth_lines > 0 AND failed_lines = 0", "overall_mismatch": "NOT correct", "line_mismatch": "failed_lines > 0"}


@query("win6_result_tabs", "v_predicted_lines", "v_expected_lines", sql=" UNION ALL ".join(
    f"SELECT '{t}' AS tab, program, place FROM (SELECT program, row_number() OVER (ORDER BY program) AS place FROM {LINED} WHERE {w}) WHERE place > 100 AND place <= 150" for t, w in TABS.items()))
def _(p, e):
    both = p.select("program", "lineno", F.col("label").alias("predicted")).join(e.select("program", "lineno", F.col("label").alias("expected")), ["program", "lineno"], "full_outer")
    ok = F.col("expected").isNull() | F.coalesce(F.col("predicted") == F.col("expected"), F.lit(False))
    results = cut(both.groupBy("program").agg(F.bool_and(ok).alias("correct"), F.count("expected").alias("truth_lines"), F.count_if(~ok).alias("failed_lines")))
    out = []
    for tab in E.RESULT_TABS:
        third = Q.page(E.results_tab(results, tab).select("program"), ["program"], 50, 3)
        place = F.row_number().over(Window.orderBy("program")).cast("long") + 100  # of the fifty rows of a page
        out.append(third.select(F.lit(tab).alias("tab"), "program", place.alias("place")))
    return reduce(DataFrame.unionByName, out)


@query("win7_enforce_quota", "v_changes", sql="SELECT owner, client_id, seq, row_number() OVER (PARTITION BY owner ORDER BY seq) <= 20 AS accepted FROM (SELECT email AS owner, item || '-' || CAST(seq % 30 AS VARCHAR) AS client_id, min(seq) AS seq FROM v_changes GROUP BY ALL)")
def _(c):
    items = c.select(F.col("email").alias("owner"), F.concat("item", F.lit("-"), (F.col("seq") % 30).cast("string")).alias("client_id"), "seq")
    return P.enforce_quota(items, 20)


@query("win8_newly_unlocked", "v_submissions", "v_users", sql=f"""WITH {STEPS}, {GATES}, l AS (SELECT owner, step, NOT is_admin AND (NOT pre_test_done OR coalesce(max(CASE WHEN finished < needed THEN 1 ELSE 0 END) OVER (PARTITION BY owner ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1) AS locked FROM steps JOIN pre ON owner = email),
    seen AS (SELECT owner, step FROM l WHERE NOT locked AND step < 3) SELECT owner, step FROM l WHERE NOT locked AND (owner, step) NOT IN (SELECT owner, step FROM seen) AND owner IN (SELECT owner FROM seen)""")
def _(s, u):
    now = _unlocked(s, u).where("not locked").select("owner", "step")
    return P.newly_unlocked(now.where("step < 3"), now)


@query("agg25_module_mastery", "v_submissions", sql="""SELECT owner, module, count(DISTINCT activity) AS tried, count(DISTINCT activity) FILTER (coalesce(final_aes >= 50, false) OR status = 'passed') AS finished, round(avg(final_aes), 10) AS aes,
    round(avg(CASE WHEN type = 'optimization' AND final_aes IS NOT NULL THEN coalesce(rog, 0) END), 10) AS rog FROM v_submissions GROUP BY owner, module""")
def _(s):
    return P.module_mastery(s).select("owner", "module", "tried", "finished", F.round("aes", 10).alias("aes"), F.round("rog", 10).alias("rog"))


@query("agg26_progress_percent", "v_submissions", sql=f"WITH {STEPS} SELECT owner, round(avg(CASE WHEN finished >= needed THEN 1.0 ELSE 0.0 END) * 100, 6) AS percent, arg_min(CASE WHEN finished < needed THEN module END, CASE WHEN finished < needed THEN step END) AS next_module FROM steps GROUP BY owner")
def _(s):
    return P.progress_percent(_steps(s)).select("owner", F.round("percent", 6).alias("percent"), "next_module")


ATTEMPTS = "SELECT owner, attempt_id, aes, ['q' || CAST(CAST(aes AS BIGINT) % 7 AS VARCHAR), 'q' || CAST((CAST(aes AS BIGINT) + 1) % 7 AS VARCHAR), 'q' || CAST((CAST(aes AS BIGINT) + 3) % 7 AS VARCHAR)] AS ids FROM v_attempts"


@query("jn7_item_results", "v_attempts", sql=f"""WITH i AS (SELECT owner, attempt_id, aes, unnest(ids) AS question_id, unnest(range(3)) AS position FROM ({ATTEMPTS})),
    r AS (SELECT *, CASE WHEN question_id = 'q2' THEN CAST(aes AS BIGINT) % 3 ELSE position END AS answer, CAST(substr(question_id, 2) AS BIGINT) % 3 AS key FROM i)
    SELECT owner, attempt_id, aes, count(*) AS n, count(*) FILTER (answer = key) AS right, CAST(floor(100 * count(*) FILTER (answer = key) / count(*) + 0.5) AS BIGINT) AS score FROM r GROUP BY owner, attempt_id, aes""")  # fmt: skip
def _(a):
    n = F.col("aes").cast("long")
    ids = F.array(*[F.concat(F.lit("q"), ((n + k) % 7).cast("string")) for k in (0, 1, 3)])
    answers = F.create_map(F.lit("q2"), (n % 3).cast("int"), F.lit("0"), F.lit(0), F.lit("1"), F.lit(1), F.lit("2"), F.lit(2))
    questions = a.sparkSession.createDataFrame([(f"q{k}", k % 3) for k in range(7)], "question_id string, key int")
    # attempts that repeat in every column are one attempt in either engine's grouping
    tries = a.select("owner", "attempt_id", "aes", ids.alias("question_ids"), answers.alias("answers"))
    return P.attempt_scores(P.item_results(tries, questions), ["owner", "attempt_id", "aes"])


# merges

KEYS = ["email", "item"]


ORACLE_PROGRESS = "SELECT email, item, arg_max(score, seq) AS score, max(seq) AS seq FROM v_changes GROUP BY email, item"


@query("mrg1_upsert_progress", "v_changes", sql=ORACLE_PROGRESS)
def _(c):
    return M.last_arrival(c, KEYS, ["score"])


ORACLE_ASSESSMENTS = """WITH a AS (SELECT *, max(attempts) OVER (PARTITION BY email, item ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM v_changes), k AS (SELECT * FROM a WHERE attempts IS NULL OR top IS NULL OR attempts >= top)
    SELECT email, item, arg_max(score, seq) FILTER (score IS NOT NULL) AS score, CAST(arg_max(correct, seq) FILTER (correct IS NOT NULL) AS DOUBLE) AS correct, CAST(arg_max(attempts, seq) FILTER (attempts IS NOT NULL) AS DOUBLE) AS attempts FROM k GROUP BY email, item"""  # fmt: skip


@query("mrg2_merge_assessments", "v_changes", sql=ORACLE_ASSESSMENTS)
def _(c):
    return M.merge_columns(c, KEYS, ["score", "correct"]).withColumns({n: F.col(n).cast("double") for n in ("correct", "attempts")})


UPSERT_SQL = """WITH a AS (SELECT *, coalesce(version, 0) AS v, max(CASE WHEN coalesce(version, 0) = 0 THEN seq END) OVER (PARTITION BY email, item) AS reset FROM v_changes WHERE NOT ends_with(email, '@guest.local')),
    k AS (SELECT * FROM a WHERE reset IS NULL OR seq >= reset) SELECT email, item, score, seq FROM k QUALIFY row_number() OVER (PARTITION BY email, item ORDER BY v DESC, seq DESC) = 1"""


def _changes(c: DataFrame) -> DataFrame:
    return c.where(~S.is_guest(F.col("email")))


@query("mrg3_upsert_submissions", "v_changes", sql=UPSERT_SQL)
def _(c):
    return M.upsert_documents(_changes(c), KEYS, ["score"]).drop("version")


@query("mrg4_merge_onboarding", "v_changes", sql="SELECT email, bool_or(passed) AS passed, CAST(max(attempts) AS DOUBLE) AS attempts, CAST(arg_min(version, seq) FILTER (version IS NOT NULL) AS DOUBLE) AS version FROM v_changes GROUP BY email")
def _(c):
    return M.merge_flags(c, "email", ["passed"], ["attempts"], ["version"]).withColumns({n: F.col(n).cast("double") for n in ("attempts", "version")})


@query("mrg5_patch_documents", "v_changes", "v_users", sql="""WITH p AS (SELECT email, seq, CASE WHEN seq % 2 = 0 THEN item END AS title, CASE WHEN seq % 3 = 0 THEN CAST(seq AS VARCHAR) END AS name FROM v_changes),
    l AS (SELECT email, arg_max(title, seq) FILTER (title IS NOT NULL) AS title, arg_max(name, seq) FILTER (name IS NOT NULL) AS name FROM p GROUP BY email) SELECT u.email, coalesce(l.title, 'none') AS title, coalesce(l.name, u.name) AS name FROM v_users u LEFT JOIN l USING (email)""")  # fmt: skip
def _(c, u):
    docs = u.select("email", F.to_json(F.struct(F.lit("none").alias("title"), "name")).alias("doc"))
    patch = F.to_json(F.struct(F.when(F.col("seq") % 2 == 0, F.col("item")).alias("title"), F.when(F.col("seq") % 3 == 0, F.col("seq").cast("string")).alias("name"), F.lit("x").alias("other")))
    return M.patch_documents(docs, c.select("email", "seq", patch.alias("patch")), "email", ["title", "name"]).drop("doc")


@query("mrg6_idempotent_insert", "v_changes", sql="SELECT email, item, min(seq) AS id, arg_max(score, (coalesce(version, -1), seq)) AS score FROM v_changes GROUP BY email, item")
def _(c):
    return M.idempotent_insert(c, KEYS, "score")


LOCAL = "(SELECT email, item, arg_max(score, seq) AS score, arg_max(coalesce(version, 0), seq) AS version, bool_or(passed) AS synced FROM v_changes WHERE seq % 3 <> 0 GROUP BY email, item)"
REMOTE = "(SELECT email, item, arg_max(score, seq) AS score, arg_max(coalesce(version, 0), seq) AS version FROM v_changes WHERE seq % 5 <> 0 GROUP BY email, item)"


def _side(c: DataFrame, where: str, *more) -> DataFrame:
    v = F.coalesce("version", F.lit(0).cast("long"))
    return c.where(where).groupBy(*KEYS).agg(F.max_by("score", "seq").alias("score"), F.max_by(v, F.col("seq")).alias("version"), *more)


@query("mrg7_pull_merge", "v_changes", sql=f"""SELECT email, item, CASE WHEN keep THEN 'local' ELSE 'remote' END AS won, CASE WHEN keep THEN ls ELSE rs END AS score FROM (SELECT email, item, l.score AS ls, r.score AS rs, r.score IS NULL OR (l.score IS NOT NULL AND NOT synced AND coalesce(l.version, 0) >= coalesce(r.version, 0)) AS keep FROM {LOCAL} l FULL JOIN {REMOTE} r USING (email, item))""")
def _(c):
    local, remote = _side(c, "seq % 3 <> 0", F.bool_or("passed").alias("synced")), _side(c, "seq % 5 <> 0")
    return M.pull_merge(local, remote, KEYS, "score").drop("version")


ITEMS = "(SELECT CASE WHEN seq % 3 = 0 THEN 'r' ELSE 'c' END || CAST(seq % 500 AS VARCHAR) AS key, 'c' || CAST(min(seq % 500) AS VARCHAR) AS canonical_id, bool_or(passed) AS synced FROM v_changes GROUP BY 1)"


@query("mrg8_heal_twins", "v_changes", sql=f"SELECT key, synced FROM {ITEMS} i WHERE NOT (key <> canonical_id AND synced AND canonical_id IN (SELECT key FROM {ITEMS}))")
def _(c):
    key = F.concat(F.when(F.col("seq") % 3 == 0, "r").otherwise("c"), (F.col("seq") % 500).cast("string"))
    items = c.groupBy(key.alias("key")).agg(F.concat(F.lit("c"), F.min(F.col("seq") % 500).cast("string")).alias("canonical_id"), F.bool_or("passed").alias("synced"))
    return M.heal_twins(items).select("key", "synced")


@query("mrg9_max_progress", "v_changes", sql="SELECT email, item, max(score) AS score, bool_or(passed) AS passed FROM v_changes GROUP BY email, item")
def _(c):
    half = lambda k: c.where(F.col("seq") % 2 == k).select(*KEYS, "score", "passed")
    return M.max_progress(half(0), half(1), KEYS, "score", "passed")


@query("mrg10_filter_trusted", "v_changes", sql="SELECT event_type AS kind, count(*) AS n FROM v_changes WHERE lower(email) = 'u7@x.org' GROUP BY event_type")
def _(c):
    return M.filter_trusted(c.withColumn("kind", F.col("event_type")), "U7@x.org")


@query("mrg11_dedupe_queue", "v_changes", sql="SELECT email, item, arg_max(props, seq) AS props, max(seq) AS seq, 0 AS attempts FROM v_changes GROUP BY email, item")
def _(c):
    return M.dedupe_queue(c, KEYS, "props")


STATUSES = [200, 404, 401, 429, 400, 422, 500, 503]


@query("mrg12_triage_retries", "v_changes", sql=f"""SELECT seq, CASE WHEN status BETWEEN 200 AND 299 THEN 'done' WHEN status = 404 AND action = 'delete' THEN 'done' WHEN status IN (401, 429) THEN 'held' WHEN status IN (400, 403, 404, 409, 410, 413, 422) OR action = 'odd' OR tries >= 10 THEN 'dropped' ELSE 'retry' END AS outcome
    FROM (SELECT seq, ({STATUSES})[seq % 8 + 1] AS status, (['create', 'update', 'delete', 'odd'])[seq // 8 % 4 + 1] AS action, seq % 12 AS tries FROM v_changes)""")  # fmt: skip
def _(c):
    status = F.element_at(F.array(*map(F.lit, STATUSES)), (F.col("seq") % 8 + 1).cast("int"))
    action = F.element_at(F.array(*map(F.lit, ("create", "update", "delete", "odd"))), (F.floor(F.col("seq") / 8) % 4 + 1).cast("int"))
    return c.select("seq", M.triage(status, action, F.col("seq") % 12).alias("outcome"))


@query("fn4_backoff", "v_changes", sql="SELECT seq, CAST(least(30000 * pow(2, greatest(0, seq % 12 - 1)), 600000) AS BIGINT) AS ms FROM v_changes")
def _(c):
    return c.select("seq", S.backoff_ms(F.col("seq") % 12).alias("ms"))


@query("jn10_suppress_deletes", "v_changes", sql="SELECT seq FROM v_changes WHERE 'c' || CAST(seq AS VARCHAR) NOT IN (SELECT CASE WHEN seq % 2 = 0 THEN 'c' ELSE 'r' END || CAST(seq AS VARCHAR) FROM v_changes WHERE seq % 7 = 0) AND 'r' || CAST(seq AS VARCHAR) NOT IN (SELECT CASE WHEN seq % 2 = 0 THEN 'c' ELSE 'r' END || CAST(seq AS VARCHAR) FROM v_changes WHERE seq % 7 = 0)")
def _(c):
    name = lambda k: F.concat(F.lit(k), F.col("seq").cast("string"))
    queue = c.where("seq % 7 = 0").select(F.when(F.col("seq") % 2 == 0, name("c")).otherwise(name("r")).alias("target"))
    return M.suppress_deleted(c.select("seq", name("c").alias("canonical_id"), name("r").alias("row_id")), queue).select("seq")


@query("jn11_resolve_identity", "v_changes", sql="""WITH l AS (SELECT seq AS local_id, CASE WHEN seq % 4 = 0 THEN 'c' || CAST(seq AS VARCHAR) END AS c, CASE WHEN seq % 3 = 0 THEN 'r' || CAST(seq AS VARCHAR) END AS r, 'x' || CAST(seq // 2 AS VARCHAR) AS x, seq % 5 <> 0 AS owned FROM v_changes WHERE seq % 2 = 0),
    m AS (SELECT seq AS remote_id, 'c' || CAST(seq AS VARCHAR) AS c, 'r' || CAST(seq + 6 AS VARCHAR) AS r, 'x' || CAST(seq // 2 AS VARCHAR) AS x FROM v_changes),
    j AS (SELECT remote_id, a.local_id AS a, b.local_id AS b, d.local_id AS d FROM m LEFT JOIN l a ON m.c = a.c LEFT JOIN l b ON m.r = b.r LEFT JOIN l d ON m.x = d.x AND d.owned)
    SELECT remote_id, CAST(coalesce(a, b, d) AS DOUBLE) AS local_id, CAST(CASE WHEN a IS NOT NULL THEN 1 WHEN b IS NOT NULL THEN 2 WHEN d IS NOT NULL THEN 3 END AS DOUBLE) AS kind FROM j""")  # fmt: skip
def _(c):
    t = lambda k, n: F.concat(F.lit(k), n.cast("string"))
    s, half = F.col("seq"), F.floor(F.col("seq") / 2)
    local = c.where("seq % 2 = 0").select(s.alias("local_id"), F.when(s % 4 == 0, t("c", s)).alias("canonical_id"), F.when(s % 3 == 0, t("r", s)).alias("row_id"), t("x", half).alias("client_id"), (s % 5 != 0).alias("owned"))
    remote = c.select(s.alias("remote_id"), t("c", s).alias("canonical_id"), t("r", s + 6).alias("row_id"), t("x", half).alias("client_id"))
    return M.resolve_identity(remote, local).select("remote_id", F.col("local_id").cast("double").alias("local_id"), F.col("kind").cast("double").alias("kind"))


@query("jn13_owned_by", "v_changes", sql="SELECT u, count(*) AS n FROM (SELECT seq, email AS u FROM v_changes UNION SELECT seq, 'u' || CAST(seq % 150 AS VARCHAR) || '@x.org' FROM v_changes) GROUP BY u")
def _(c):
    items = c.select("seq", "email", F.concat(F.lit("u"), (F.col("seq") % 150).cast("string"), F.lit("@x.org")).alias("owner_id"))
    return M.owned_by(items, "email", "owner_id").groupBy(F.col("user").alias("u")).agg(F.count("*").alias("n"))


@query("jn14_cascade_delete", "v_assessments", "v_users", sql="SELECT email, assessment_key FROM v_assessments WHERE email NOT IN (SELECT email FROM v_users WHERE status = 'suspended')")
def _(a, u):
    return M.cascade(a, u.where("status = 'suspended'"), "email").select("email", "assessment_key")


@query("jn15_orphans", "v_submissions", "v_users", sql="SELECT sub_id, owner FROM v_submissions WHERE owner NOT IN (SELECT email FROM v_users WHERE status = 'active')")
def _(s, u):
    return M.orphans(s.withColumn("email", F.col("owner")), u.where("status = 'active'"), "email").select("sub_id", "owner")


# streams

@query("str2_rate_limit", sql="SELECT bucket, route, time_bucket(INTERVAL '1 minute', ts) AS start, count(*) AS n, count(*) > CASE route WHEN 'view' THEN 2 WHEN 'click' THEN 2 ELSE 1 END AS limited FROM v_requests GROUP BY bucket, route, time_bucket(INTERVAL '1 minute', ts)")
def _(spark, sf_dir):
    r = view(spark, sf_dir, "v_requests").withColumn("bucket", R.bucket(F.col("token_valid"), F.col("account"), F.col("forwarded")))
    return R.limited_windows(r, shared(spark, "requests"))


LOCKOUTS = """WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY ms, event_id) AS i FROM v_logins),
    s(account, i, event_id, ms, failure, rejected, failures, final, until) AS (SELECT DISTINCT account, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), false, false, CAST(0 AS INT), CAST(-1 AS BIGINT), CAST(-1 AS BIGINT) FROM n
    UNION ALL SELECT account, i, event_id, ms, failure, rejected, c, CASE WHEN rejected THEN final WHEN failure THEN ms ELSE -1 END, CASE WHEN rejected THEN until WHEN NOT failure THEN -1 WHEN c >= 10 THEN ms + 300000 ELSE until END
      FROM (SELECT n.account, n.i, n.event_id, n.ms, n.failure, n.ms < s.until AS rejected, s.final, s.until,
                   CASE WHEN n.ms < s.until THEN s.failures WHEN NOT n.failure THEN 0 WHEN s.final < 0 OR n.ms - s.final > 1200000 THEN 1 ELSE s.failures + 1 END AS c
            FROM s JOIN n ON n.account = s.account AND n.i = s.i + 1))
    SELECT event_id, account, CASE WHEN rejected THEN 'rejected' WHEN NOT failure THEN 'ok' WHEN failures >= 10 THEN 'locked' ELSE 'failed' END AS outcome, failures FROM s WHERE i > 0"""


@query("str3_login_lockout", "v_logins", sql=LOCKOUTS)
def _(x):
    return R.login_lockout(x)


@query("str4_failure_bursts", "v_logins", sql="""WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY account ORDER BY ts, event_id) <= INTERVAL '20 minutes' THEN 0 ELSE 1 END AS new FROM v_logins WHERE failure), b AS (SELECT *, sum(new) OVER (PARTITION BY account ORDER BY ts, event_id) AS g FROM a)
    SELECT account, min(ts) AS first, max(ts) AS last, count(*) AS n FROM b GROUP BY account, g""")  # fmt: skip
def _(x):
    return R.failure_bursts(x)


@query("str5_token_validity", "v_changes", sql="""SELECT seq, row_number() OVER (PARTITION BY token ORDER BY claimed_ms, seq) = 1 AND claimed_ms <= expires_ms AND version >= max(version) OVER (PARTITION BY account ORDER BY claimed_ms, seq) AS valid
    FROM (SELECT seq, email AS account, email || CAST(seq % 4 AS VARCHAR) AS token, seq * 1000 AS claimed_ms, seq % 9 * 1500000 AS expires_ms, seq % 50 // 10 AS version FROM v_changes)""")  # fmt: skip
def _(c):
    s = F.col("seq")
    e = c.select("seq", F.col("email").alias("account"), F.concat("email", (s % 4).cast("string")).alias("token"), (s * 1000).alias("claimed_ms"), (s % 9 * 1500000).alias("expires_ms"), F.floor(s % 50 / 10).alias("version"))
    return R.token_validity(e).select("seq", "valid")


@query("str1_stream_upserts", sql=UPSERT_SQL)
def _(spark, sf_dir):
    changes = _changes(view(spark, sf_dir, "v_changes")).select(*KEYS, "score", "version", "seq")
    return R.kept_table(changes, KEYS, lambda d: M.upsert_documents(d, KEYS, ["score"]), shared(spark, "documents")).select(*KEYS, "score", "seq")


@query("str1_stream_progress", sql=ORACLE_PROGRESS)
def _(spark, sf_dir):
    changes = view(spark, sf_dir, "v_changes").select(*KEYS, "score", "seq")
    return R.kept_table(changes, KEYS, lambda d: M.last_arrival(d, KEYS, ["score"]), shared(spark, "progress"))


@query("str1_stream_assessments", sql=ORACLE_ASSESSMENTS)
def _(spark, sf_dir):
    columns = [*KEYS, "score", "correct", "attempts", "seq"]
    changes = view(spark, sf_dir, "v_changes").select(*columns)
    # what is kept of a key comes before all changes to it
    kept = R.kept_table(changes, KEYS, lambda d: M.merge_columns(d, KEYS, ["score", "correct"]).withColumn("seq", F.lit(-1).cast("long")).select(*columns), shared(spark, "assessments"))
    return kept.drop("seq").withColumns({n: F.col(n).cast("double") for n in ("correct", "attempts")})


@query("str6_live_cohort", sql=f"""WITH live AS (SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY owner, module, activity ORDER BY ts DESC, sub_id DESC, total_tests DESC NULLS LAST, final_aes DESC NULLS LAST) AS place FROM v_submissions) WHERE place = 1)
    SELECT owner, {METRICS} FROM {ROWS.replace("v_submissions", "live")} WHERE owner IN (SELECT email FROM v_users WHERE status = 'active') GROUP BY owner""")
def _(spark, sf_dir):
    root, keys = shared(spark, "cohort"), [*R.PARTS, "activity"]
    newest = ["ts", "sub_id", "total_tests", "final_aes"]
    # flat rows are worked out before they arrive, and of these what the metrics and the order need is kept
    rows = cohort.submission_rows(view(spark, sf_dir, "v_submissions")).select(*keys, *dict.fromkeys([*newest, *cohort.SUMMED]))
    latest = lambda d: d.groupBy(*keys).agg(F.max(F.struct(*[c for c in rows.columns if c not in keys])).alias("v")).select(*keys, "v.*")
    held, parts = R.BucketedTable(spark, f"{root}/submissions", R.PARTS), R.BucketedTable(spark, f"{root}/parts", R.PARTS)
    R.arrivals(rows, "ts", root, R.cohort_sink(held, parts, latest, flat=lambda d: d))
    roster = view(spark, sf_dir, "v_users").where("status = 'active'").select(F.col("email").alias("owner"))
    return cohort.roll_up(parts.read().join(roster, "owner", "left_semi"), [["owner"]]).drop("module", "level")


# graphs

@query("gr1_call_edges", "v_calls", sql="SELECT program, coalesce(caller, '__main__') AS caller, callee, line, count(*) AS hits FROM v_calls WHERE callee <> 'print' GROUP BY ALL")
def _(c):
    return G.call_edges(c, ["print"])


ROOTS = "SELECT DISTINCT program, caller AS node FROM v_edges WHERE caller % 13 = 0"
LIVE = f"live(program, node) AS ({ROOTS} UNION SELECT e.program, e.callee FROM live l JOIN v_edges e ON l.program = e.program AND l.node = e.caller)"
NODES = "nodes AS (SELECT program, caller AS node FROM v_edges UNION SELECT program, callee FROM v_edges)"


def _roots(e):
    return e.where("caller % 13 = 0").select("program", F.col("caller").alias("node")).distinct()


@query("gr2_reachable", "v_edges", sql=f"WITH RECURSIVE {LIVE} SELECT program, node FROM live")
def _(e):
    return G.reachable(e, _roots(e))


@query("gr3_dead_functions", "v_edges", sql=f"""WITH RECURSIVE {LIVE}, {NODES}, c AS (SELECT program, callee AS node, count(DISTINCT caller) AS callers FROM (SELECT DISTINCT program, caller, callee FROM v_edges WHERE caller <> callee) GROUP BY program, callee)
    SELECT n.program, n.node, CASE WHEN callers IS NULL THEN 'never called' ELSE 'called by dead code' END AS reason, CAST(coalesce(callers, 0) AS INT) AS n_callers FROM nodes n LEFT JOIN c USING (program, node) WHERE (n.program, n.node) NOT IN (SELECT program, node FROM live)""")  # fmt: skip
def _(e):
    d = G.dead_functions(e, G.reachable(e, _roots(e)))
    return d.select("program", "node", "reason", F.when(F.col("callers") == "", 0).otherwise(F.size(F.split("callers", ","))).alias("n_callers"))


PATHS = "paths(program, src, dst) AS (SELECT program, caller, callee FROM e UNION SELECT p.program, p.src, e.callee FROM paths p JOIN e ON p.program = e.program AND p.dst = e.caller)"


@query("gr4_recursive", "v_edges", sql=f"""WITH RECURSIVE e AS (SELECT * FROM v_edges WHERE caller <> callee), {PATHS}, loops AS (SELECT program, src AS node FROM paths WHERE src = dst),
    leads AS (SELECT DISTINCT p.program, p.src AS node FROM paths p JOIN loops l ON p.program = l.program AND p.dst = l.node), d AS (SELECT DISTINCT program, caller AS node FROM v_edges WHERE caller = callee)
    SELECT program, node, d.node IS NOT NULL AS direct, l.node IS NOT NULL AS indirect FROM d FULL JOIN leads l USING (program, node)""")  # fmt: skip
def _(e):
    return G.recursive_functions(e)


CLUSTERS = f"{NODES}, named AS (SELECT n.program, n.node, least(n.node, coalesce(min(p.dst), n.node)) AS cluster FROM nodes n LEFT JOIN (SELECT p.* FROM paths p JOIN paths q ON p.program = q.program AND p.src = q.dst AND p.dst = q.src) p ON n.program = p.program AND n.node = p.src GROUP BY n.program, n.node)"


@query("gr5_clusters", "v_edges", sql=f"WITH RECURSIVE e AS (SELECT * FROM v_edges), {PATHS}, {CLUSTERS} SELECT program, node, cluster FROM named")
def _(e):
    return G.clusters(e)


@query("gr6_dependency_order", "v_edges", sql=f"""WITH RECURSIVE e AS (SELECT * FROM v_edges), {PATHS}, {CLUSTERS}, ce AS (SELECT DISTINCT e.program, a.cluster AS up, b.cluster AS down FROM e JOIN named a ON e.program = a.program AND e.caller = a.node JOIN named b ON e.program = b.program AND e.callee = b.node WHERE a.cluster <> b.cluster),
    depth(program, cluster, layer) AS (SELECT DISTINCT program, cluster, 0 FROM named UNION SELECT ce.program, ce.up, layer + 1 FROM depth d JOIN ce ON d.program = ce.program AND d.cluster = ce.down) SELECT program, cluster, CAST(max(layer) AS INT) AS layer FROM depth GROUP BY program, cluster""")  # fmt: skip
def _(e):
    return G.dependency_order(e)


@query("set3_set_difference", "v_edges", sql=f"WITH RECURSIVE {LIVE}, {NODES} SELECT program, node FROM nodes EXCEPT SELECT program, node FROM live")
def _(e):
    return G.nodes(e).exceptAll(G.reachable(e, _roots(e)))


# sources and sinks

@query("src2_split_labels", "v_code", sql="SELECT doc_id, time, space, name FROM (SELECT doc_id, " + f"({NINE})[doc_id % 9 + 1] AS time, CASE WHEN doc_id % 10 = 9 THEN 'O(odd)' ELSE ({NINE})[doc_id % 7 + 1] END AS space, CAST('n' || CAST(doc_id AS VARCHAR) AS VARCHAR) AS name FROM v_code) WHERE space <> 'O(odd)'")
def _(c):
    pick = lambda k: F.element_at(F.array(*map(F.lit, NINE)), (F.col("doc_id") % k + 1).cast("int"))
    text = F.concat(F.lit("# n"), F.col("doc_id").cast("string"), F.lit("\n"), F.regexp_replace(F.coalesce("code", F.lit("")), r"O\(", ""), F.lit(","), pick(9), F.lit(","), F.when(F.col("doc_id") % 10 == 9, "O(odd)").otherwise(pick(7)))
    return T.split_labels(c.select("doc_id", text.alias("code")), "code", NINE).select("doc_id", "time", "space", "name")


@query("src3_scan_submissions", "v_submissions", sql="SELECT owner, module, activity, type, status, final_aes, rog, code_unchanged, ts FROM v_submissions")
def _(s):
    doc = F.to_json(F.struct(F.col("module").alias("moduleId"), F.col("activity").alias("activityId"), "type", "status", "final_aes", "rog", "code_unchanged", F.col("ts").alias("timestamp"), F.lit("x").alias("other")))
    d = T.scan_documents(s.select("owner", doc.alias("data")))
    return d.select("owner", F.col("doc.moduleId").alias("module"), F.col("doc.activityId").alias("activity"), "doc.type", "doc.status", "doc.final_aes", "doc.rog", "doc.code_unchanged", F.col("doc.timestamp").alias("ts"))


@query("src4_unpack_document", "events", sql="""SELECT event_id, CAST(props->>'$.k' AS INT) AS k, CAST(event_id AS VARCHAR) AS _id, CASE WHEN event_id % 3 = 0 THEN 'x' ELSE 'u' || CAST(user_id AS VARCHAR) END AS title,
    coalesce(CASE WHEN event_id % 2 = 0 THEN user_id END, event_id % 7) AS "userId", coalesce(event_id % 7, user_id) AS owner_id FROM events""")  # fmt: skip
def _(e):
    doc = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"title":"x",'), F.substr("props", F.lit(2)))).otherwise(F.col("props"))
    rows = e.select("event_id", F.lit(0).alias("k"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("title"), F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("userId"), (F.col("event_id") % 7).alias("owner_id"), doc.alias("doc"))
    return T.unpack_document(rows, "doc", {"k": "int", "title": "string"}, id_col="event_id", owners=("userId", "owner_id"))


@query("fn3_json", "v_changes", sql="""SELECT seq, seq % 10 AS a, CASE WHEN seq % 2 = 0 THEN 'new' ELSE 'old' END AS b, CAST(props->>'$.k' AS BIGINT) AS k, seq % 5 AS deep, CASE WHEN seq % 3 = 0 THEN 7 END AS kept FROM v_changes""")
def _(c):
    old = S.json_merge(F.to_json(F.struct((F.col("seq") % 10).alias("a"), F.lit("old").alias("b"))), F.col("props"))
    # each step is a column of its own, which the next names more than once and Spark works out once
    c = c.select("seq", S.json_merge(old, F.when(F.col("seq") % 2 == 0, F.lit('{"b":"new"}'))).alias("doc"))
    c = c.withColumn("doc", F.when(F.col("seq") % 3 == 0, S.json_merge(F.col("doc"), F.lit('{"m":{"n":{"kept":7}}}'))).otherwise(F.col("doc")))
    c = c.withColumn("v", F.parse_json(S.json_set(F.col("doc"), ["m", "n", "deep"], (F.col("seq") % 5).cast("string"))))
    got = lambda path, kind: F.try_variant_get("v", path, kind)
    return c.select("seq", got("$.a", "long").alias("a"), got("$.b", "string").alias("b"), got("$.k", "long").alias("k"), got("$.m.n.deep", "long").alias("deep"), got("$.m.n.kept", "int").alias("kept"))


BLOB = "SELECT email, item, CASE WHEN min(seq) % 4 = 0 THEN 'bad' ELSE CAST(min(seq) AS VARCHAR) END AS v FROM v_changes GROUP BY email, item"
TARGET = "SELECT email, 'k1' AS item FROM v_users WHERE user_key % 2 = 0"


def _blobs(c, u):
    v = c.groupBy(*KEYS).agg(F.min("seq").alias("s")).withColumn("v", F.when(F.col("s") % 4 == 0, "bad").otherwise(F.col("s").cast("string")))
    legacy = v.groupBy("email").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("item", "v")))).alias("data"))
    target = u.where("user_key % 2 = 0").select("email", F.lit("k1").alias("item"))
    return legacy, T.migrate_blobs(legacy, u, target)


@query("src5_migrate_blobs", "v_changes", "v_users", sql=f"SELECT email, item, coalesce(TRY_CAST(v AS DOUBLE), 0) AS score FROM ({BLOB}) WHERE email IN (SELECT email FROM v_users) AND (email, item) NOT IN ({TARGET})")
def _(c, u):
    return _blobs(c, u)[1]


@query("src5_migration_report", "v_changes", "v_users", sql=f"SELECT (SELECT count(*) FROM ({BLOB})) AS entries, count(*) AS moved, count(DISTINCT email) AS users FROM ({BLOB}) WHERE email IN (SELECT email FROM v_users) AND (email, item) NOT IN ({TARGET})")
def _(c, u):
    return T.migration_report(*_blobs(c, u))


@query("src1_snk1_chunks", sql="SELECT CAST(doc_id AS VARCHAR) AS id, lang AS name, source AS code FROM v_code")
def _(spark, sf_dir):
    root = shared(spark, "chunks")
    rows = view(spark, sf_dir, "v_code").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("name"), F.col("source").alias("code"))
    T.write_chunks(rows.where("cast(id as long) % 2 = 0").withColumn("code", F.lit("old")), f"{root}/a", "id")
    T.write_chunks(rows, f"{root}/b", "id", old=spark.read.schema("id string, name string, code string").json(f"{root}/a"))
    return spark.read.schema("id string, name string, code string").json(f"{root}/b")


def _sheet(spark: SparkSession, sf_dir: str, sheet: str) -> DataFrame:
    """A sheet of two days, of which the second was written twice."""
    root = shared(spark, "report")
    rows = cohort.submission_rows(view(spark, sf_dir, "v_submissions"))
    tables = T.report_tables(rows, cohort.submission_metrics(rows), view(spark, sf_dir, "v_users"), *pre_post(view(spark, sf_dir, "v_assessments")))
    one = {sheet: written(tables[sheet])}  # worked out once, written three times
    T.write_report_tables(one, root, "2026-01-01")
    T.write_report_tables({sheet: one[sheet].limit(0 if sheet == "summary" else 1)}, root, "2026-01-02")
    T.write_report_tables(one, root, "2026-01-02")
    return spark.read.parquet(f"{root}/{sheet}").withColumn("snapshot_date", F.col("snapshot_date").cast("string"))


def _dated(sql: str) -> str:
    return f"SELECT * FROM ({sql}) CROSS JOIN (SELECT unnest(['2026-01-01', '2026-01-02']) AS snapshot_date)"


NAMED_ROWS = f"(SELECT * REPLACE (coalesce(module, 'unknown') AS module) FROM {ROWS})"


@query("snk2_report_tables", sql=_dated(f"SELECT module, {METRICS} FROM {NAMED_ROWS} GROUP BY 1"))
def _(spark, sf_dir):
    return _sheet(spark, sf_dir, "by_module").drop("owner")


@query("snk2_summary", sql=_dated(f"SELECT {METRICS} FROM {ROWS}"))
def _(spark, sf_dir):
    return _sheet(spark, sf_dir, "summary").drop("owner", "module")


@query("snk2_by_respondent", sql=_dated(f"SELECT owner, {METRICS} FROM {ROWS} GROUP BY 1"))
def _(spark, sf_dir):
    return _sheet(spark, sf_dir, "by_respondent").drop("module")


@query("snk2_detail", sql=_dated(f"SELECT owner, module, {METRICS} FROM {NAMED_ROWS} GROUP BY 1, 2"))
def _(spark, sf_dir):
    return _sheet(spark, sf_dir, "detail")


@query("snk2_submissions", sql=_dated(f"SELECT sub_id, owner, module, activity, final_aes, tsr_passed, tsr_total, rog_value, done FROM {ROWS}"))
def _(spark, sf_dir):
    return _sheet(spark, sf_dir, "submissions").select("sub_id", "owner", "module", "activity", "final_aes", "tsr_passed", "tsr_total", "rog_value", "done", "snapshot_date")


@query("snk2_pairs", sql=_dated(f"SELECT email, pre, post, post - pre AS difference FROM (SELECT email FROM v_users) LEFT JOIN ({PAIRS}) USING (email)"))
def _(spark, sf_dir):
    return _sheet(spark, sf_dir, "pairs")


@query("src1_scan_ground_truth", sql="SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 6 < 4 THEN 'processed' ELSE 'raw' END AS name, 'ground_truth_chunk_' || CAST(doc_id % 6 AS VARCHAR) || '.json' AS source_file, len(code) AS n_chars FROM v_code")
def _(spark, sf_dir):
    """Two folders of chunk files; four of six chunks are in both."""
    root = shared(spark, "truth")
    rows = view(spark, sf_dir, "v_code").withColumn("chunk", F.col("doc_id") % 6)
    for name, where in (("raw", "true"), ("processed", "chunk < 4")):
        record = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.lit(name).alias("name"), "code"))
        T.write_arrays(rows.where(where).select("chunk", record.alias("record")), f"{root}/{name}", "ground_truth_chunk_{}.json")
    found = T.scan_ground_truth(spark, [f"{root}/processed", f"{root}/raw"])
    return found.select("id", "name", "source_file", F.char_length("code").cast("long").alias("n_chars"))


@query("src2_scan_csv", sql=f"SELECT doc_id, ({NINE})[doc_id % 9 + 1] AS time, ({NINE})[doc_id % 7 + 1] AS space FROM v_code WHERE doc_id % 10 <> 9")
def _(spark, sf_dir):
    """Codes with quotes, commas and line ends, written as a CSV file and read again."""
    path = shared(spark, "labelled")
    pick = lambda k: F.element_at(F.array(*map(F.lit, NINE)), (F.col("doc_id") % k + 1).cast("int"))
    c = view(spark, sf_dir, "v_code")
    text = F.concat(F.lit("# "), F.col("doc_id").cast("string"), F.lit('\nprint("a, b")\n'), F.regexp_replace(F.coalesce("code", F.lit("")), r"O\(", ""), F.lit(","), pick(9), F.lit(","), F.when(F.col("doc_id") % 10 == 9, "O(odd)").otherwise(pick(7)))
    c.select(text.alias("code")).write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return T.scan_labelled_csv(spark, path, NINE).select(F.col("name").cast("long").alias("doc_id"), "time", "space")


@query("fn3_scalars", "v_changes", sql="""SELECT seq, replace(upper(trim(' ' || item || ' ')), 'K', 'q') AS text, contains(email, '@x') AS inside, string_split(email, '@')[2] AS host, regexp_extract(email, '[0-9]+') AS digits,
    CAST(props->>'$.k' AS VARCHAR) AS member, CASE WHEN version > 0 THEN strftime(make_timestamp(version // 1000 * 1000000), '%Y-%m-%dT%H:%M:%S') END AS iso FROM v_changes""")  # fmt: skip
def _(c):
    iso = F.when(F.col("version") > 0, F.date_format(F.expr("timestampadd(SECOND, version DIV 1000, TIMESTAMP_NTZ '1970-01-01 00:00:00')"), "yyyy-MM-dd'T'HH:mm:ss"))
    return c.select(
        "seq", F.replace(F.upper(F.trim(F.concat(F.lit(" "), "item", F.lit(" ")))), F.lit("K"), F.lit("q")).alias("text"), F.contains("email", F.lit("@x")).alias("inside"), F.split("email", "@")[1].alias("host"),
        F.regexp_extract("email", r"\d+", 0).alias("digits"), F.get_json_object("props", "$.k").alias("member"), iso.alias("iso"),
    )
