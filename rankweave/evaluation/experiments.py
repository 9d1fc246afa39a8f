"""Queries on experiment tables: decisions, arms, stops, ablations, run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..plans.ordering import running_before, top_rows
from ..schemas import ACCEPT_DELTA


def significance(
    incumbent,
    candidates: DataFrame,
    seed_scores: DataFrame | None = None,
    threshold: float = ACCEPT_DELTA,
    key: str = "candidate",
) -> DataFrame:
    """Accept a candidate whose gain clears the threshold, or whose three re-runs confirm it.

    ``candidates``: ``(candidate, primary)``; ``seed_scores``: ``(candidate, seed, score)``
    with exactly three rows for each candidate that needs them. ``incumbent`` is a number or
    the name of a column.
    """
    base = F.col(incumbent) if isinstance(incumbent, str) else F.lit(float(incumbent))
    rows = candidates.withColumn("_base", base)
    if seed_scores is None:
        rows = rows.withColumns(
            {"_n": F.lit(None).cast("long"), "_mean": F.lit(None).cast("double"), "_up": F.lit(None).cast("long")}
        )
    else:
        runs = seed_scores.join(rows.select(key, "_base"), key)
        folded = runs.groupBy(key).agg(
            F.count("score").alias("_n"),
            F.avg("score").alias("_mean"),
            F.count_if(F.col("score") > F.col("_base")).alias("_up"),
        )
        rows = rows.join(folded, key, "left")
    delta = F.col("primary") - F.col("_base")
    clear = delta - F.lit(float(threshold)) > 1e-12
    three = F.when(
        F.col("_n") != 3, F.raise_error(F.lit("significance re-runs need exactly three seed scores"))
    ).otherwise(F.col("_n") == 3)
    confirmed = (F.col("_mean") > F.col("_base")) & (F.col("_up") >= 2)
    rerun = ~clear & F.col("_n").isNotNull()
    state = F.when(clear, F.lit("delta_above_two_sigma")).when(
        F.col("_n").isNull(), F.lit("not_significant")
    ).when(three & confirmed, F.lit("confirmed_by_three_seed_rerun")).otherwise(F.lit("not_significant"))
    return rows.select(
        key,
        "primary",
        delta.alias("raw_delta"),
        state.alias("reason"),
        F.when(rerun, F.lit(3)).otherwise(F.lit(1)).alias("seeds"),
        F.when(rerun, F.col("_mean")).alias("seed_mean"),
        F.when(rerun, F.col("_up")).alias("improving_seeds"),
    ).withColumn("accepted", F.col("reason") != "not_significant")


def arm_scores(
    arms: list[str], observations: DataFrame, c: float = 0.25, by: tuple[str, ...] = ()
) -> DataFrame:
    """Mean gain and upper confidence bound of each arm, and which arm is next.

    An arm without observations comes first, in list order; equal bounds go to the earlier
    arm. ``by`` gives one decision per group.
    """
    if not arms:
        raise ValueError("at least one arm is required")
    by = list(by)
    spark = observations.sparkSession
    listed = F.explode(
        F.array(*[F.struct(F.lit(i).alias("position"), F.lit(a).alias("arm")) for i, a in enumerate(arms)])
    ).alias("a")
    known = observations.where(F.col("arm").isin(*arms))
    sums = known.groupBy(*by, "arm").agg(F.avg("delta").alias("mean"), F.count(F.lit(1)).alias("n"))
    groups = observations.select(*by).distinct() if by else spark.range(1).select()
    full = (
        groups.select(*by, listed)
        .select(*by, "a.position", "a.arm")
        .join(sums, [*by, "arm"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
    )
    # at most len(arms) rows per group from here on
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    total = F.sum("n").over(group)
    bound = F.when(
        F.col("n") > 0,
        F.col("mean") + F.lit(float(c)) * F.sqrt(F.log(F.greatest(total, F.lit(2)).cast("double")) / F.col("n")),
    )
    place = F.row_number().over(
        group.orderBy((F.col("n") > 0).asc(), F.when(F.col("n") > 0, -F.col("ucb")), F.col("position"))
    )
    return (
        full.withColumn("ucb", bound)
        .withColumn("next", place == 1)
        .select(*by, "arm", "position", "n", "mean", "ucb", "next")
    )


def order_candidates(df: DataFrame, name: str = "name", effect: str = "effect") -> DataFrame:
    """Largest effect first, equal effects by name."""
    return df.orderBy(F.col(effect).desc(), F.col(name).asc())


def stop_reason(
    deltas: DataFrame,
    max_iter: int,
    max_wall_s: float,
    window: int = 3,
    eps: float = 0.002,
    by: tuple[str, ...] = ("run_id",),
) -> DataFrame:
    """Stop flag per run from ``(run, seq, delta, elapsed_s)``; null to go on.

    Order of precedence: iteration cap, wall-clock cap, then the last ``window`` gains all at
    most ``eps``. Only those last rows of a run travel.
    """
    by = list(by)
    totals = deltas.groupBy(*by).agg(
        F.count(F.lit(1)).alias("iterations"), F.max("elapsed_s").alias("elapsed_s")
    )
    recent = top_rows(deltas, by, [F.col("seq").desc()], window, "_back").groupBy(*by).agg(
        F.count("delta").alias("_n"), F.bool_and(F.col("delta") <= eps).alias("_flat")
    )
    reason = (
        F.when(F.col("iterations") >= max_iter, "iteration_cap")
        .when(F.col("elapsed_s") >= max_wall_s, "wall_clock_cap")
        .when((F.col("_n") >= window) & F.col("_flat"), "converged")
    )
    return totals.join(recent, by).select(*by, "iterations", "elapsed_s", reason.alias("stop_reason"))


def removal_costs(scores: DataFrame, incumbent) -> DataFrame:
    """What the incumbent loses without each part.

    ``scores``: ``(..., node, score_without, error)``; a failed re-run costs 0 and says why.
    """
    base = F.col(incumbent) if isinstance(incumbent, str) else F.lit(float(incumbent))
    failed = F.col("score_without").isNull() | F.col("error").isNotNull()
    return scores.withColumns(
        {
            "removal_cost": F.when(failed, F.lit(0.0)).otherwise(base - F.col("score_without")),
            "status": F.when(
                failed, F.concat(F.lit("not_ablatable:"), F.coalesce("error", F.lit("Unknown")))
            ).otherwise(F.lit("scored")),
            "score_without": F.when(failed, base).otherwise(F.col("score_without")),
        }
    ).drop("error")


def limiting_node(df: DataFrame, by: tuple[str, ...] = (), position: str = "position") -> DataFrame:
    """The part with the largest removal cost; the earlier one on a tie."""
    best = F.max_by("node", F.struct(F.col("removal_cost"), -F.col(position)))
    return df.groupBy(*by).agg(best.alias("node"), F.max("removal_cost").alias("removal_cost"))


def distinct_scores(df: DataFrame, score: str = "score", by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Number of different scores, at six decimals."""
    return df.groupBy(*by).agg(F.countDistinct(F.round(score, 6)).alias("distinct_scores"))


def last_outcomes(outcomes: DataFrame, limit: int = 10, order: str = "seq") -> DataFrame:
    """The most recent outcomes, oldest first."""
    return outcomes.orderBy(F.col(order).desc()).limit(limit).orderBy(F.col(order).asc())


def rejected_ids(outcomes: DataFrame, key: str = "hypothesis_id") -> DataFrame:
    """Ids that were ever rejected, once each."""
    return outcomes.where(~F.coalesce(F.col("accepted"), F.lit(False))).select(key).distinct()


def iteration_report(
    runs: DataFrame, baseline: float, by: str = "run_id", order: str = "iteration",
    min_rows: int | None = None, initial: float | str = -1.0,
) -> DataFrame:
    """Each iteration with its gain over the baseline and over the best one before it.

    ``accepted`` marks a new running best of the raw scores (not the significance decision). The
    bar starts at ``initial``: a number, or the column with the score that a run started from
    (null: -1).
    """
    seen = running_before(runs.where(F.col("primary").isNotNull()), [by], [order], ["primary"], "max", min_rows)
    start = F.coalesce(F.col(initial), F.lit(-1.0)) if isinstance(initial, str) else F.lit(float(initial))
    best = F.greatest(F.col("primary_before"), start)
    return seen.select(
        by,
        order,
        "primary",
        (F.col("primary") - F.lit(float(baseline))).alias("vs_baseline"),
        best.alias("best_before"),
        (F.col("primary") > best).alias("accepted"),
    )


def resource_rollup(run_log: DataFrame, by: str = "run_id", min_rows: int | None = None) -> DataFrame:
    """Totals per run: iterations, runs that executed, tokens, wall time, rejections."""
    return run_log.groupBy(by).agg(
        F.count(F.lit(1)).alias("iterations"),
        F.count_if(F.col("executed")).alias("executed_iterations"),
        F.count_if(F.col("accepted")).alias("accepted_iterations"),
        F.sum(F.coalesce(F.size("proposal_rejections"), F.lit(0))).alias("rejected_proposals"),
        F.sum("tokens.in").alias("tokens_in"),
        F.sum("tokens.out").alias("tokens_out"),
        (F.sum("tokens.in") + F.sum("tokens.out")).alias("tokens_total"),
        F.sum("wall_clock_s").alias("wall_clock_s"),
    )


def cumulative_resources(run_log: DataFrame, by: str = "run_id", min_rows: int | None = None) -> DataFrame:
    """Tokens and wall time spent up to and including each iteration."""
    lean = run_log.select(
        by,
        "iteration",
        F.col("tokens.in").alias("tin"),
        F.col("tokens.out").alias("tout"),
        F.col("wall_clock_s").alias("wall"),
    )
    past = running_before(lean, [by], ["iteration"], ["tin", "tout", "wall"], "sum", min_rows)
    upto = lambda n: F.col(f"{n}_before") + F.col(n)
    return past.select(
        by,
        "iteration",
        upto("tin").alias("tokens_in"),
        upto("tout").alias("tokens_out"),
        upto("wall").alias("wall_clock_s"),
    )


def recovery_events(run_log: DataFrame, by: str = "run_id") -> DataFrame:
    """Recovery events one per row; an iteration without any keeps one empty row."""
    return run_log.select(by, "iteration", F.explode_outer("recovery_events").alias("e")).select(
        by, "iteration", "e.event", "e.node_id", "e.reason"
    )


def ablation_rows(run_log: DataFrame, by: str = "run_id") -> DataFrame:
    """The ablation maps of a run log as one row per part."""
    return run_log.select(by, "iteration", F.explode("ablation_table").alias("node", "a")).select(
        by, "iteration", "node", "a.score_without", "a.removal_cost", "a.status"
    )


def compare_runs(runs: DataFrame, by: str = "run_id", order: str = "iteration") -> DataFrame:
    """Per run: first score, best score and where it occurred, iterations."""
    scored = runs.where(F.col("primary").isNotNull())
    return scored.groupBy(by).agg(
        F.min_by("primary", order).alias("seed_primary"),
        F.max("primary").alias("best_primary"),
        F.max_by(order, F.struct(F.col("primary"), -F.col(order))).alias("best_iteration"),
        F.count(F.lit(1)).alias("iterations"),
    ).withColumn("gain", F.col("best_primary") - F.col("seed_primary"))


def latest_iteration(run_log: DataFrame, by: str = "run_id", order: str = "iteration") -> DataFrame:
    """The newest record of each run."""
    rest = [c for c in run_log.columns if c not in (by, order)]
    return run_log.groupBy(by).agg(
        F.max(order).alias(order), F.max_by(F.struct(*rest), order).alias("_r")
    ).select(by, order, "_r.*")


def leave_one_out(
    bundles: dict[str, DataFrame], fit, evaluate, neutral, incumbent: float
) -> DataFrame:
    """Removal costs of feature bundles: each is replaced by a constant column in turn, the
    model re-fitted and re-scored. A bundle that fails to re-fit is reported, not raised.

    ``fit(list of bundles) -> predictions``, ``evaluate(predictions) -> primary``,
    ``neutral(bundle) -> stand-in bundle``. One row per bundle.
    """
    spark = next(iter(bundles.values())).sparkSession
    rows = []
    for position, name in enumerate(bundles):
        kept = [neutral(b) if other == name else b for other, b in bundles.items()]
        try:
            rows.append((position, name, float(evaluate(fit(kept))), None))
        except Exception as exc:  # the failure is the finding
            rows.append((position, name, None, type(exc).__name__))
    scores = spark.createDataFrame(rows, "position int, node string, score_without double, error string")
    return removal_costs(scores, incumbent)
