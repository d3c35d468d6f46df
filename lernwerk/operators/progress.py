"""Progress through a curriculum: gates, attempts, quotas, recency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def item_results(attempts: DataFrame, questions: DataFrame) -> DataFrame:
    """One row for each question of an attempt, with whether the answer is right.

    ``question_ids`` gives the order; ``answers`` maps a question's id, or else its position, to the
    chosen option.
    """
    items = attempts.select("*", F.posexplode("question_ids").alias("position", "question_id")).drop("question_ids")
    answer = F.coalesce(F.try_element_at("answers", F.col("question_id")), F.try_element_at("answers", F.col("position").cast("string")))
    joined = items.withColumn("answer", answer).drop("answers").join(questions, "question_id", "left")
    return joined.withColumn("correct", F.coalesce(F.col("answer") == F.col("key"), F.lit(False)))


def attempt_scores(items: DataFrame, by: list[str]) -> DataFrame:
    g = items.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("correct").alias("right"))
    return g.withColumn("score", F.floor(100 * F.col("right") / F.col("n") + 0.5).cast("long"))


def curriculum_join(curriculum: DataFrame, learners: DataFrame, done: DataFrame) -> DataFrame:
    """Every step of every learner with its finished activities.

    ``curriculum``: one row an activity (step, module, lesson, activity, is_opt); ``done``: one row
    a finished activity (owner, module, activity). The curriculum is a small table of a course.
    """
    finished = done.select("owner", "module", "activity").distinct()
    counted = finished.join(F.broadcast(curriculum.select("module", "activity", "step")), ["module", "activity"]).groupBy("owner", "step").agg(F.count("*").alias("finished"))
    steps = curriculum.groupBy("step", "module", "is_opt").agg(F.count("*").alias("activities"), F.first("difficulty").alias("difficulty"))
    every = learners.select("owner").distinct().crossJoin(F.broadcast(steps))  # steps of one course
    return every.join(counted, ["owner", "step"], "left").withColumn("finished", F.coalesce("finished", F.lit(0)))


def minimum_needed(activities: Column, difficulty: Column, is_opt: Column, rule: str = "path") -> Column:
    """How many activities of a step must be done: by difficulty, or (``profile``) a share of them."""
    if rule == "profile":
        share = F.when(difficulty == "Beginner", F.ceil(activities / 2)).when(difficulty == "Intermediate", F.ceil(activities / 3)).otherwise(F.lit(1))
        return F.when(is_opt, F.least(F.lit(2), activities)).otherwise(F.least(share, activities))
    most = F.when(difficulty == "Beginner", 3).when(difficulty == "Intermediate", 2).when(difficulty == "Advanced", 1)
    return F.when(is_opt, F.least(F.lit(2), activities)).otherwise(F.least(F.coalesce(most, activities), activities))


def unlock_map(steps: DataFrame, pre_test_done: str = "pre_test_done", is_admin: str = "is_admin") -> DataFrame:
    """A step is locked while any earlier one is unmet, and all while the pre test is; nothing is locked for admins."""
    met = F.col("finished") >= F.col("needed")
    before = F.max((~met).cast("int")).over(Window.partitionBy("owner").orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    locked = ~F.col(is_admin) & (~F.col(pre_test_done) | (F.coalesce(before, F.lit(0)) == 1))
    return steps.withColumn("met", met).withColumn("locked", locked)


def module_complete(steps: DataFrame) -> DataFrame:
    return steps.groupBy("owner", "module").agg(F.bool_and(F.col("finished") >= F.col("needed")).alias("complete"))


def curriculum_complete(modules: DataFrame) -> DataFrame:
    return modules.groupBy("owner").agg(F.bool_and("complete").alias("complete"))


def attempt_history(attempts: DataFrame) -> DataFrame:
    """Baseline, best and gain after each attempt; resubmitting the same code freezes the best."""
    order = Window.partitionBy("owner", "activity").orderBy("ts", "attempt_id", "aes")
    code = F.trim("code")
    unchanged = F.coalesce((F.lag(code).over(order) == code) & (code != ""), F.lit(False))
    a = attempts.withColumn("code_unchanged", unchanged).withColumn("baseline", F.first("aes").over(order)).withColumn("attempt", F.row_number().over(order))
    best = F.max(F.when(~F.col("code_unchanged"), F.col("aes"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    a = a.withColumn("best", best)
    return a.withColumn("gain", F.when(F.col("type") == "optimization", F.greatest(F.lit(0.0), F.col("best") - F.col("baseline"))).otherwise(0.0))


def recent_items(items: DataFrame, owner: str, k: int, *order: Column) -> DataFrame:
    """The newest k of each owner. Spark keeps k rows a task before it shuffles."""
    return items.withColumn("__n", F.row_number().over(Window.partitionBy(owner).orderBy(*order))).where(F.col("__n") <= k).drop("__n")


def enforce_quota(items: DataFrame, quota: int) -> DataFrame:
    """Add ``accepted``: the first ``quota`` distinct client ids of an owner in order of arrival; one sent again is the same item."""
    first = items.groupBy("owner", "client_id").agg(F.min("seq").alias("seq"))
    return first.withColumn("accepted", F.row_number().over(Window.partitionBy("owner").orderBy("seq")) <= quota)


def newly_unlocked(before: DataFrame, now: DataFrame) -> DataFrame:
    """Keys unlocked now and not before; an owner without any earlier snapshot has none."""
    known = before.select("owner").distinct()
    return now.join(before.select("owner", "step"), ["owner", "step"], "left_anti").join(known, "owner", "left_semi")


def module_mastery(subs: DataFrame) -> DataFrame:
    """Activities tried and done, mean score and mean gain of each learner in each module, and a rank title."""
    done = F.coalesce(F.col("final_aes") >= 50, F.lit(False)) | (F.col("status") == "passed")
    gain = F.when((F.col("type") == "optimization") & F.col("final_aes").isNotNull(), F.coalesce("rog", F.lit(0.0)))
    # one row an activity first: counts of distinct activities beside means would multiply the rows
    sums = [x for n, c in (("aes", F.col("final_aes")), ("rog", gain)) for x in (F.sum(c).alias(f"{n}_sum"), F.count(c).alias(f"{n}_count"))]
    each = subs.groupBy("owner", "module", "activity").agg(F.max(F.coalesce(done, F.lit(False))).alias("done"), *sums)
    mean = lambda n: F.try_divide(F.sum(f"{n}_sum"), F.sum(f"{n}_count")).alias(n)
    g = each.groupBy("owner", "module").agg(F.count("activity").alias("tried"), F.count(F.when(F.col("done"), F.col("activity"))).alias("finished"), mean("aes"), mean("rog"))
    title = F.when((F.col("finished") >= 5) & (F.col("aes") >= 60), "expert").when(F.col("finished") >= 3, "skilled").otherwise("novice")
    return g.withColumn("rank", title)


def progress_percent(steps: DataFrame) -> DataFrame:
    """Share of steps met, and the first module with an unmet one."""
    met = F.col("finished") >= F.col("needed")
    return steps.groupBy("owner").agg((F.avg(met.cast("double")) * 100).alias("percent"), F.min_by(F.when(~met, F.col("module")), F.when(~met, F.col("step"))).alias("next_module"))
