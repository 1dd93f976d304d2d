"""Event logs: sessions, engagement, timing, intensity, discovery and volatility of each entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

GAP_MINUTES = 30
def by_time():
    """Events of an entity in time order."""
    return W.partitionBy("entity").orderBy("ts", "event_id")



def seconds_between(later: Column, earlier: Column) -> Column:
    """Seconds, fractions included, free of time zones."""
    d = later - earlier
    return F.extract(F.lit("DAY"), d) * 86400.0 + F.extract(F.lit("HOUR"), d) * 3600 + F.extract(F.lit("MINUTE"), d) * 60 + F.extract(F.lit("SECOND"), d).cast("double")


def sessions(events: DataFrame, gap_minutes: int = GAP_MINUTES) -> DataFrame:
    """One row for each session; a new one begins after a gap of more than ``gap_minutes`` (EVT-1)."""
    gap = seconds_between(F.col("ts"), F.lag("ts").over(by_time()))
    marked = events.select("entity", "ts", "event_id", (F.coalesce(gap > 60 * gap_minutes, F.lit(True))).cast("int").alias("new"))
    numbered = marked.withColumn("session_no", F.sum("new").over(by_time().rowsBetween(W.unboundedPreceding, 0)))
    out = numbered.groupBy("entity", "session_no").agg(F.min("ts").alias("session_start"), F.max("ts").alias("session_end"), F.count("*").alias("events"))
    return out.withColumn("minutes", F.greatest(F.lit(1.0), seconds_between(F.col("session_end"), F.col("session_start")) / 60))


def type_shares(events: DataFrame) -> DataFrame:
    """(entity, event_type, n, share)."""
    n = events.groupBy("entity", "event_type").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("entity")))


def engagement(events: DataFrame) -> DataFrame:
    """Diversity, entropy over log2 of the number of types, and Herfindahl of event types (EVT-2)."""
    p = F.col("share")
    g = type_shares(events).groupBy("entity").agg(F.sum("n").alias("events"), F.count("*").alias("types"), F.sum(-p * F.log2(p)).alias("h"), F.sum(p * p).alias("herfindahl"))
    return g.select("entity", "events", "types", F.when(F.col("types") > 1, F.col("h") / F.log2("types")).otherwise(0.0).alias("entropy"), "herfindahl")


def streaks(events: DataFrame) -> DataFrame:
    """Longest and mean run of consecutive active days (WIN-11)."""
    days = events.select("entity", F.to_date("ts").alias("day")).distinct()
    island = F.date_sub("day", F.row_number().over(W.partitionBy("entity").orderBy("day")))
    runs = days.withColumn("island", island).groupBy("entity", "island").agg(F.count("*").alias("run"))
    return runs.groupBy("entity").agg(F.max("run").alias("longest_streak"), F.avg("run").alias("mean_streak"))


def histogram(value: Column, bins: int) -> Column:
    """The shares of the numbers 0 to ``bins`` - 1, as a vector of fixed width from one aggregate."""
    return F.array(*[F.count_if(value == k) / F.count(value) for k in range(bins)])


def gaps_between_sessions(sessioned: DataFrame) -> DataFrame:
    """Mean and variance of the hours from a session's end to the next one's start; 0 where there are too few."""
    before = F.lag("session_end").over(W.partitionBy("entity").orderBy("session_no"))
    g = sessioned.select("entity", (seconds_between(F.col("session_start"), before) / 3600).alias("gap")).groupBy("entity")
    return g.agg(F.coalesce(F.avg("gap"), F.lit(0.0)).alias("mean_gap_hours"), F.coalesce(F.var_samp("gap"), F.lit(0.0)).alias("var_gap_hours"))


def temporal(events: DataFrame) -> DataFrame:
    """Shares of the 24 hours and 7 weekdays, weekend and night shares, busiest hour, session and gap figures, active days (EVT-3)."""
    hour, weekend = F.hour("ts"), F.weekday("ts") >= 5
    base = events.groupBy("entity").agg(
        histogram(hour, 24).alias("hour_shares"), histogram(F.weekday("ts"), 7).alias("day_shares"), F.avg(weekend.cast("double")).alias("weekend_ratio"), F.avg((hour < 6).cast("double")).alias("night_ratio"), F.mode(hour, True).alias("busiest_hour"),
        F.countDistinct(F.to_date("ts")).alias("active_days"), (F.datediff(F.max("ts"), F.min("ts")) + 1).alias("span_days"),
    )
    sessioned = sessions(events)
    s = sessioned.groupBy("entity").agg(F.count("*").alias("sessions"), F.avg("minutes").alias("mean_minutes"), F.var_samp("minutes").alias("var_minutes"), F.avg("events").alias("mean_events"))
    joined = base.join(s, "entity").join(gaps_between_sessions(sessioned), "entity").join(streaks(events), "entity")
    return joined.withColumn("active_ratio", F.col("active_days") / F.col("span_days")).drop("span_days")


def intensity(events: DataFrame) -> DataFrame:
    """Events per active day, the slope of daily counts over active days, spread, and the last 7 days against before (EVT-4)."""
    days = events.groupBy("entity", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    mine = W.partitionBy("entity")
    seq = days.select("entity", "n", (F.row_number().over(mine.orderBy("day")) - 1).alias("i"), F.datediff(F.max("day").over(mine), "day").alias("age"))
    g = seq.groupBy("entity").agg(F.avg("n").alias("per_day"), F.regr_slope("n", "i").alias("slope"), F.count("*").alias("days"), F.var_samp("n").alias("variance"), (F.stddev_samp("n") / F.avg("n")).alias("cv"), F.sum(F.when(F.col("age") < 7, F.col("n")).otherwise(0)).alias("last_7d"), F.sum(F.when(F.col("age").between(7, 13), F.col("n")).otherwise(0)).alias("prior_7d"))
    return g.withColumn("slope", F.when(F.col("days") >= 3, F.col("slope")).otherwise(0.0)).withColumn("trend_ratio", F.col("last_7d") / F.greatest(F.col("prior_7d"), F.lit(1)))


def first_seen(events: DataFrame) -> DataFrame:
    """Place and time at which an entity first has each type of event (WIN-12)."""
    seq = events.select("entity", "event_type", "ts", (F.row_number().over(by_time()) - 1).alias("i"), F.count("*").over(W.partitionBy("entity")).alias("n"))
    return seq.groupBy("entity", "event_type").agg(F.min("i").alias("first_index"), F.min("ts").alias("first_ts"), F.max("n").alias("n"))


def progression(events: DataFrame, all_types: int) -> DataFrame:
    """Coverage of types, discovery slope and days, repeat ratio (EVT-5), learning curve (EVT-7)."""
    f = first_seen(events)
    mine = W.partitionBy("entity").orderBy("first_index")
    seq = f.select("*", (F.row_number().over(mine) - 1).alias("k"), (F.col("first_index") - F.lag("first_index").over(mine)).alias("wait"))
    g = seq.groupBy("entity").agg(F.count("*").alias("types"), F.max("n").alias("events"), F.regr_slope("k", "first_index").alias("slope"), F.datediff(F.max("first_ts"), F.min("first_ts")).alias("discovery_days"), F.avg("wait").alias("mean_wait"), F.max(F.when(F.col("k") + 1 == F.ceil(F.lit(all_types / 2)), F.col("first_index"))).alias("half_index"))
    return g.select("entity", "events", "types", (F.col("types") / all_types).alias("coverage"), (1 - F.col("types") / F.col("events")).alias("repeat_ratio"), F.when(F.col("types") >= 3, F.col("slope")).otherwise(0.0).alias("discovery_slope"), "discovery_days", "mean_wait", (F.col("half_index") + 1).alias("events_to_half"))


def consumption(events: DataFrame, all_types: int) -> DataFrame:
    """Coverage, events per active day, replay ratio and the risk of running out of new content (EVT-6)."""
    g = events.groupBy("entity").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("types"), F.countDistinct(F.to_date("ts")).alias("days"))
    cover, replay = F.col("types") / all_types, 1 - F.col("types") / F.col("n")
    risk = F.when((cover > 0.9) & (replay > 0.95), "critical").when(cover > 0.9, "high").when(cover > 0.7, "medium").otherwise("low")
    return g.select("entity", cover.alias("coverage"), (F.col("n") / F.col("days")).alias("velocity"), replay.alias("replay_ratio"), risk.alias("exhaustion_risk"))


def thirds(events: DataFrame) -> DataFrame:
    """Event counts by type in the first and last third of an entity's history; the rest of the division is in the last (WIN-13)."""
    mine = W.partitionBy("entity")
    seq = events.select("entity", "event_type", (F.row_number().over(by_time()) - 1).alias("i"), F.count("*").over(mine).alias("n"))
    third = F.when(F.col("i") < F.floor(F.col("n") / 3), 0).when(F.col("i") < 2 * F.floor(F.col("n") / 3), 1).otherwise(2)
    return seq.groupBy("entity", third.alias("third"), "event_type").agg(F.count("*").alias("n"))


def quarters(events: DataFrame) -> DataFrame:
    """Event counts by type in the first and the last quarter of an entity's history, at least one event each (WIN-13).

    Both are n // 4 events, so the rest of the division is in neither; with fewer than eight events they may meet.
    """
    mine = W.partitionBy("entity")
    seq = events.select("entity", "event_type", (F.row_number().over(by_time()) - 1).alias("i"), F.count("*").over(mine).alias("n"))
    size = F.greatest(F.lit(1), F.floor(F.col("n") / 4))
    parts = F.array_compact(F.array(F.when(F.col("i") < size, "early"), F.when(F.col("i") >= F.col("n") - size, "late")))
    return seq.select("entity", "event_type", F.explode(parts).alias("quarter")).groupBy("entity", "quarter", "event_type").agg(F.count("*").alias("n"))


def growth(events: DataFrame) -> DataFrame:
    """How many types of events the first and the last quarter hold, and how they grew (WIN-13)."""
    kinds = lambda q: F.count_if(F.col("quarter") == q)
    g = quarters(events).groupBy("entity").agg(kinds("early").alias("early_diversity"), kinds("late").alias("late_diversity"))
    return g.select("*", (F.col("late_diversity") - F.col("early_diversity")).alias("diversity_growth"), (F.col("late_diversity") / F.greatest("early_diversity", F.lit(1))).alias("diversity_growth_ratio"))


def volatility(events: DataFrame, floor: float = 1e-10) -> DataFrame:
    """How even an entity's sessions are, and how its mix of event types moves from third to third (EVT-8).

    Mean, variance and coefficient of variation of the minutes of sessions (two of them at least) and of the hours between
    them (two gaps at least), else 0; the KL divergence in bits of the first third from the second and of the second from
    the last, where shares are ``floor`` at least and a negative sum is 0; their mean, and 1 / (1 + x) of it and of the
    mean of the two coefficients and it. Entities of fewer than three events have no thirds, and a divergence of 0.
    All of it keeps to the one exchange by entity.
    """
    mine = W.partitionBy("entity")
    kinds = thirds(events).groupBy("entity", "event_type").agg(*[F.coalesce(F.sum(F.when(F.col("third") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in range(3)])
    shares = kinds.select("entity", *[F.greatest(F.col(f"n{k}") / F.nullif(F.sum(f"n{k}").over(mine), F.lit(0)), F.lit(floor)).alias(f"p{k}") for k in range(3)])
    bits = lambda p, q: F.greatest(F.sum(F.col(p) * F.log2(F.col(p) / F.col(q))), F.lit(0.0))
    moved = shares.groupBy("entity").agg(bits("p0", "p1").alias("kl_early"), bits("p1", "p2").alias("kl_late"))
    sessioned = sessions(events)
    length = sessioned.groupBy("entity").agg(F.count("*").alias("sessions"), F.avg("minutes").alias("session_length_mean"), F.coalesce(F.var_samp("minutes"), F.lit(0.0)).alias("session_length_variance"))
    enough = lambda c: F.when(F.col("sessions") > 2, c).otherwise(0.0)
    cv = lambda of: F.coalesce(F.sqrt(f"{of}_variance") / F.nullif(f"{of}_mean", F.lit(0.0)), F.lit(0.0))
    d = length.join(gaps_between_sessions(sessioned), "entity").join(moved, "entity")
    d = d.withColumn("session_gap_mean", enough(F.col("mean_gap_hours"))).withColumn("session_gap_variance", enough(F.col("var_gap_hours"))).drop("mean_gap_hours", "var_gap_hours")
    d = d.withColumn("session_length_cv", cv("session_length")).withColumn("session_gap_cv", cv("session_gap")).withColumn("event_distribution_volatility", (F.col("kl_early") + F.col("kl_late")) / 2)
    score = (F.col("session_length_cv") + F.col("session_gap_cv") + F.col("event_distribution_volatility")) / 3
    return d.withColumn("event_distribution_stability", 1 / (1 + F.col("event_distribution_volatility"))).withColumn("volatility_score", score).withColumn("predictability", 1 / (1 + F.col("volatility_score")))


def launch_timing(events: DataFrame, launch) -> DataFrame:
    """Days from the launch to the first event, and a class from 0 to 3 (EVT-9)."""
    days = F.datediff(F.min("ts"), F.lit(launch))
    return events.groupBy("entity").agg(days.alias("days_after_launch")).withColumn("timing", F.when(F.col("days_after_launch") <= 1, 0).when(F.col("days_after_launch") <= 7, 1).when(F.col("days_after_launch") <= 30, 2).otherwise(3))


def deduplicated(events: DataFrame) -> DataFrame:
    """One event for each (entity, store, ts): that with the smallest id (EVT-10)."""
    return events.groupBy("entity", "store", "ts").agg(F.min_by(F.struct("event_id", "event_type"), "event_id").alias("e")).select("entity", "store", "ts", "e.*")
