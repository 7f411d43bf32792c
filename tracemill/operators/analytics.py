"""Aggregates, correlations, splits and decisions over episodes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import score
from tracemill.functions.hashing import held_out
from tracemill.operators.ordering import numbered, running_sum
from tracemill.sources.store import materialised


def audit(episodes: DataFrame) -> DataFrame:
    """Counts by trust and, exploded, by category, with shares of all episodes."""
    trust = episodes.groupBy(F.col("validity.trust").alias("name")).agg(F.count("*").alias("n")).select(F.lit("trust").alias("kind"), "name", "n")
    cats = episodes.select(F.explode("validity.categories").alias("name")).groupBy("name").agg(F.count("*").alias("n")).select(F.lit("category").alias("kind"), "name", "n")
    return trust.union(cats)


def quality_stats(episodes: DataFrame) -> DataFrame:
    """F4/A31."""
    kept = score.quality_kept()
    return episodes.agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped"), F.count("*").alias("total"))


def partition(episodes: DataFrame, minimum: float = 0.5, holdout: float = 0.2, seed: int = 0) -> DataFrame:
    """T5: trusted, not bad and good enough (F5), split by T4; adds ``split``."""
    c = F.col("reward_vector.composite")
    good = (F.when(score.finite(c), c).otherwise(0.0) >= minimum) & ~score.is_bad() & score.trusted()
    return episodes.where(good).withColumn("split", F.when(held_out(F.col("id"), holdout, seed), "holdout").otherwise("train"))


def ranked_holdout(rows: DataFrame, limit: int = 50) -> DataFrame:
    """The lowest scores first (none counts as 1), ties by id."""
    return rows.orderBy(F.coalesce("score", F.lit(1.0)), "id").limit(limit)


def pearson(x: str, y: str, degenerate: float | None = None) -> Column:
    """Null, or the value given, for less than two rows or a constant side."""
    flat = (F.count("*") < 2) | (F.stddev_pop(x) < 1e-12) | (F.stddev_pop(y) < 1e-12)
    spread = F.stddev_pop(x) * F.stddev_pop(y)  # not corr(), which fails on a constant side
    return F.when(flat, F.lit(degenerate).cast("double")).otherwise(F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0)))


def with_ranks(rows: DataFrame, *columns: str) -> DataFrame:
    """Average ranks of columns, ties in the middle, as ``rank_<column>``."""
    for c in columns:
        # Ranks come from running counts of the distinct values.
        v = running_sum(rows.groupBy(c).agg(F.count("*").alias("__n")), "__n", c, name="__upto")
        v = v.select(F.col(c).alias("__v"), (F.col("__upto") - (F.col("__n") - 1) / 2).alias(f"rank_{c}"))
        rows = rows.join(v, F.col(c).eqNullSafe(F.col("__v"))).drop("__v")
    return rows


def correlate(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Both coefficients over shared keys with finite scores. ``a(key, x)``, ``b(key, y)``."""
    both = a.join(b, key).where(score.finite("x") & score.finite("y"))
    ranked = with_ranks(both, "x", "y")
    return ranked.agg(F.count("*").alias("n"), F.round(pearson("x", "y"), 4).alias("pearson"), F.round(pearson("rank_x", "rank_y"), 4).alias("spearman"))


def promotion(scores: DataFrame, margin: float = 0.0) -> DataFrame:
    """Paired means of ``scores(candidate, base)``; without pairs the base stays."""
    paired = scores.where(score.finite("candidate") & score.finite("base")).agg(F.count("*").alias("n"), F.avg("candidate").alias("candidate_mean"), F.avg("base").alias("base_mean"))
    better = F.coalesce(F.col("candidate_mean") >= F.col("base_mean") + margin, F.lit(False))
    return paired.select("n", F.round("candidate_mean", 6).alias("candidate_mean"), F.round("base_mean", 6).alias("base_mean"), F.when(better, "promote").otherwise("keep_base").alias("decision"))


def stratified_split(rows: DataFrame, per_class: int = 2) -> DataFrame:
    """Of each class the first k by id are held out: per_class, or a third (one at least) of a class no larger than it."""
    w = Window.partitionBy("class")
    n = F.count("*").over(w)
    k = F.when(n > per_class, F.lit(per_class)).otherwise(F.greatest(F.lit(1), F.floor(n / 3)))
    return rows.withColumn("__rn", F.row_number().over(w.orderBy("id"))).withColumn("__k", k).withColumn("held", F.col("__rn") <= F.col("__k")).drop("__rn", "__k")


def lift(rows: DataFrame) -> DataFrame:
    """Solved before and after, overall and by class, by rollup. ``rows(class, base, tuned)`` of booleans."""
    r = rows.rollup("class").agg(F.count("*").alias("n"), F.count_if("base").alias("base_solved"), F.count_if("tuned").alias("tuned_solved"), F.grouping("class").alias("g"))
    return r.select(F.when(F.col("g") == 1, "all").otherwise(F.col("class")).alias("class"), "n", "base_solved", "tuned_solved", (F.col("tuned_solved") - F.col("base_solved")).alias("lift"))


def culprits(blame: DataFrame) -> DataFrame:
    """Blamed lines by commit. ``blame(sha, path, blamed_lines)``."""
    return blame.groupBy("sha").agg(F.sum("blamed_lines").alias("blamed_lines"))


def implicated(episodes: DataFrame, culprits_: DataFrame, files: DataFrame) -> DataFrame:
    """Episodes by blamed commit (each once, the most lines first; a commit belongs to its first episode), and the
    others by changed files. ``culprits_(sha, blamed_lines)``, ``files(file)``."""
    commits = episodes.select("ord", "id", F.explode(F.array_distinct(F.filter(F.array("outcome.commit", "outcome.merge_commit") if "merge_commit" in episodes.schema["outcome"].dataType.names else F.array("outcome.commit"), lambda c: F.coalesce(c, F.lit("")) != ""))).alias("sha"))
    owner = commits.groupBy("sha").agg(F.min_by("id", "ord").alias("id"))
    hit = owner.join(culprits_, "sha").groupBy("id").agg(F.max_by("sha", F.struct("blamed_lines", "sha")).alias("commit"), F.max("blamed_lines").alias("blamed_lines"))
    by_commit = hit.select("id", F.lit("commit").alias("via"), "commit", "blamed_lines", F.lit(None).cast("string").alias("files"))
    touched = episodes.select("id", F.explode(F.array_distinct(F.transform("diffs", lambda d: d["file"]))).alias("file")).join(files, "file").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("file")), ",").alias("files"))
    by_file = touched.join(hit.select("id"), "id", "left_anti").select("id", F.lit("file").alias("via"), F.lit(None).cast("string").alias("commit"), F.lit(0).cast("bigint").alias("blamed_lines"), "files")
    return by_commit.union(by_file)


def fit_reward_model(episodes: DataFrame, features: Column, target: Column) -> dict:
    """Least squares by the sums of products of features, of which alone the driver hears; minimum norm if they
    are dependent. {weights, r2, n}."""
    k = episodes.select(F.size(features)).first()
    if k is None:
        return {"weights": [], "r2": 0.0, "n": 0}
    k = k[0]
    rows = episodes.select(features.alias("f"), target.alias("y")).where("y is not null")
    sums = [F.sum(F.col("f")[i] * F.col("f")[j]) for i in range(k) for j in range(i, k)] + [F.sum(F.col("f")[i] * F.col("y")) for i in range(k)]
    r = rows.agg(F.count("*"), F.sum("y"), F.sum(F.col("y") * F.col("y")), *sums).first()
    n = r[0]
    if n < 2:
        return {"weights": [0.0] * k, "r2": 0.0, "n": n}
    a, it = np.zeros((k, k)), iter(r[3:])
    for i in range(k):
        for j in range(i, k):
            a[i, j] = a[j, i] = next(it)
    b = np.array([next(it) for _ in range(k)])
    w = np.linalg.pinv(a) @ b
    total = r[2] - r[1] ** 2 / n
    left = r[2] - 2 * w @ b + w @ a @ w
    return {"weights": [round(float(x), 6) for x in w], "r2": round(float(1 - left / total), 6) if total > 1e-12 else 0.0, "n": n}


def predicted(features: Column, weights: list[float]) -> Column:
    return sum((features[i] * F.lit(w) for i, w in enumerate(weights)), F.lit(0.0))


def evaluation(rows: DataFrame, prediction: str, actual: str) -> DataFrame:
    """A14."""
    return rows.agg(F.count("*").alias("n"), F.round(pearson(prediction, actual, 0.0), 6).alias("pearson"), F.round(F.avg(F.abs(F.col(prediction) - F.col(actual))), 6).alias("mae"))


NAMES = tuple("log_length keyword_hits question_marks code_fences avg_word_length".split())


def learn_router(rows: DataFrame, epochs: int = 300, rate: float = 0.2, decay: float = 0.001, in_memory: int = 100_000) -> dict:
    """Logistic regression over standardized text features by full-batch gradient descent.

    ``rows(f array<double>, y double)``. Up to ``in_memory`` distinct feature rows come to the driver with their counts; of
    more, only the sums of each step's gradient do, out of one pass over the written numbers. The steps are the same. Less
    than four rows or one class: the base rate alone."""
    merged = materialised(rows.groupBy("f").agg(F.count("*").alias("n"), F.sum("y").alias("y")), "router")
    k = len(NAMES)
    f = [F.col("f")[i] for i in range(k)]
    sums = [F.sum(F.col("n") * x) for x in f]
    n, y, distinct, *total = merged.agg(F.coalesce(F.sum("n"), F.lit(0)), F.sum("y"), F.count("*"), *sums).first()
    positive = y / n if n else None
    model = {"mean": [0.0] * k, "std": [1.0] * k, "weights": [0.0] * k, "bias": 0.0, "trained_on": n, "positive_rate": positive, "fallback": True}
    if n < 4 or positive in (0.0, 1.0):
        if n:
            p = min(0.999, max(0.001, positive))
            model["bias"] = math.log(p / (1 - p))
        return model
    mean = np.array(total) / n
    std = np.sqrt(np.array(merged.agg(*(F.sum(F.col("n") * (x - F.lit(float(a))) * (x - F.lit(float(a)))) for x, a in zip(f, mean))).first()) / n)
    std[std == 0] = 1.0
    w, b = np.zeros(k), 0.0
    if distinct <= in_memory:
        held = merged.collect()
        x, c, hits = np.array([r.f for r in held]), np.array([r.n for r in held], float), np.array([r.y for r in held], float)
        x = (x - mean) / std

        def gradient(w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
            e = c / (1 + np.exp(-np.clip(x @ w + b, -60, 60))) - hits
            return e @ x, e.sum()
    else:
        z = [(a - F.lit(float(m))) / F.lit(float(s)) for a, m, s in zip(f, mean, std)]

        def gradient(w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
            line = sum((a * F.lit(float(v)) for a, v in zip(z, w)), F.lit(float(b)))
            e = F.col("n") / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), line)))) - F.col("y")
            *g, whole = merged.select(e.alias("e"), *(a.alias(f"z{i}") for i, a in enumerate(z))).agg(*(F.sum(F.col("e") * F.col(f"z{i}")) for i in range(k)), F.sum("e")).first()
            return np.array(g), whole

    for _ in range(epochs):
        g, whole = gradient(w, b)
        w, b = w - rate * (g / n + decay * w), b - rate * whole / n
    return model | {"mean": mean.tolist(), "std": std.tolist(), "weights": w.tolist(), "bias": float(b), "fallback": False}


def probability(features: Column, model: dict) -> Column:
    """C24."""
    z = sum(((features[i] - m) / s * w for i, (m, s, w) in enumerate(zip(model["mean"], model["std"], model["weights"]))), F.lit(model["bias"]))
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), z))))


def ci_status(checks: Column) -> Column:
    """Of an array of conclusions."""
    return F.when(F.coalesce(F.size(checks), F.lit(0)) <= 0, F.lit(None).cast("string")).when(F.exists(checks, lambda c: F.coalesce(c, F.lit("")).isin("FAILURE", "ERROR", "CANCELLED")), "failure").when(F.forall(checks, lambda c: F.coalesce(c, F.lit("")) == "SUCCESS"), "success").otherwise("pending")


def should_refresh() -> Column:
    """open or undecided pull requests of episodes that aren't given up."""
    o = lambda f: F.col(f"outcome.{f}")
    undecided = o("status").isNull() | o("status").isin("open", "accepted") | o("pr_state").isNull() | (o("pr_state") == "OPEN") | o("ci_status").isNull() | (o("ci_status") == "pending")
    return o("pr_number").isNotNull() & ~F.coalesce(o("status").isin("abandoned", "reverted"), F.lit(False)) & undecided


def outcome_of_pull_request() -> Column:
    """O1: over columns state, merged, merged_at, checks (array of conclusions) and the ids of a pull request."""
    merged = F.coalesce("merged", F.lit(False)) | (F.coalesce("merged_at", F.lit("")) != "")
    return F.struct(F.when(merged, "merged").when(F.col("state") == "CLOSED", "abandoned").otherwise("open").alias("status"), merged.alias("merged"), F.col("state").alias("pr_state"), ci_status(F.col("checks")).alias("ci_status"), F.col("url").alias("pr_url"), F.col("number").alias("pr_number"))


def running_baseline(rows: DataFrame, key: str, order: str, reward: str, window: int = 8) -> DataFrame:
    """The mean of a prompt's last rewards before a row, else of the last ones at all, else 0.

    No two rows share ``order``. Rows are numbered first; the global window looks at a row's neighbours only, so it is taken
    within ranges of those numbers that overlap by ``window`` rows rather than over one partition of all rows."""
    own = F.avg(reward).over(Window.partitionBy(key).orderBy("__n").rowsBetween(-window, -1))
    every = F.avg(reward).over(Window.partitionBy("__part").orderBy("__n").rowsBetween(-window, -1))
    span = 10_000
    parts = F.floor(F.col("__n") / span)
    spread = numbered(rows, order, name="__n").withColumn("__own", own).withColumn("__part", F.explode(F.when(F.pmod(F.col("__n"), F.lit(span)) >= span - window, F.array(parts, parts + 1)).otherwise(F.array(parts))))
    return spread.withColumn("__every", every).where(F.col("__part") == parts).withColumn("baseline", F.coalesce("__own", "__every", F.lit(0.0))).drop("__own", "__every", "__part", "__n")


def gae(rewards: Column, values: Column, mask: Column, gamma: float = 1.0, lam: float = 1.0, chunk: int = 256) -> Column:
    """Advantages from the end backwards; masked positions stay 0 and are stepped over.

    An array that grows by one element is copied at each step, so it grows within chunks, and chunks are gathered whole: the
    cost of a long trajectory is its length times ``chunk``, not its square."""
    zipped = F.reverse(F.arrays_zip(rewards.alias("r"), values.alias("v"), mask.alias("m")))
    none = F.array().cast("array<double>")

    def step(s: Column, x: Column) -> Column:
        run = x["r"] + gamma * s["next"] - x["v"] + gamma * lam * s["run"]
        on = F.coalesce(x["m"], F.lit(0)) != 0
        return F.struct(F.when(on, run).otherwise(s["run"]).alias("run"), F.when(on, x["v"]).otherwise(s["next"]).alias("next"), F.concat(s["out"], F.array(F.when(on, run).otherwise(0.0))).alias("out"))

    def chunked(s: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(s["run"].alias("run"), s["next"].alias("next"), none.alias("out")), step)
        return F.get(F.transform(F.array(done), lambda d: F.struct(d["run"].alias("run"), d["next"].alias("next"), F.concat(s["out"], F.array(d["out"])).alias("out"))), F.lit(0))

    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(zipped) - 1) / chunk).cast("int"))), lambda i: F.slice(zipped, i * chunk + 1, F.lit(chunk)))
    start = F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("next"), F.array().cast("array<array<double>>").alias("out"))
    return F.when(zipped.isNotNull(), F.reverse(F.flatten(F.aggregate(parts, start, chunked, lambda s: s["out"]))))


def dis_mask(advantages: Column, now: Column, then: Column, low: float = 0.2, high: float = 0.2) -> Column:
    """struct(kept advantages, number masked): the probability ratio must stay strictly inside the bounds."""
    ratio = F.zip_with(now, then, lambda a, b: F.exp(a - b))
    kept = F.zip_with(advantages, ratio, lambda a, r: F.when((r > 1 - low) & (r < 1 + high), a).otherwise(0.0))
    return F.struct(kept.alias("kept"), F.size(F.filter(ratio, lambda r: ~((r > 1 - low) & (r < 1 + high)))).alias("masked"))


def jaccard(a: Column, b: Column) -> Column:
    """S3: two empty sets are equal."""
    u = F.size(F.array_union(a, b))
    return F.when(u == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / u)


def replay_score(tests: Column, files: Column) -> Column:
    """C36."""
    return F.round(0.6 * tests + 0.4 * files, 4)


TOOLS = "MultiEdit Edit Write Read Bash Grep Glob user_prompt shell_command file_read file_edit file_write file_delete".split()


def action_format(text: Column) -> Column:
    """Half for the prefix, the rest for parentheses and a known tool."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    part = lambda c, v: F.when(c, v).otherwise(0.0)
    return F.least(F.lit(1.0), part(t.startswith("ACTION "), 0.5) + part(t.contains("(") & t.contains(")"), 0.3) + part(t.rlike(rf"^ACTION\s+(?:{'|'.join(TOOLS)})\S*?\("), 0.2))
