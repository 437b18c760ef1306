"""Streams run over what is there, against the same rows in SQL."""

from __future__ import annotations

from partweave.plans.registry import ORACLE, query, rounded
from partweave.plans import spatial_queries  # noqa: F401  (registers the batch form)
from partweave.sources.projections import with_views
from partweave.streaming import frames, runs


@query(ORACLE["frame_windows"])
def streamed_frame_windows(spark, d):
    found = runs.run_available(frames.sliding_windows(runs.event_stream(spark, d), 5))
    return rounded(found.withColumn("frame", found["frame"].cast("int")), "sum_value")


@query(
    with_views(
        """WITH marked AS (SELECT *, CASE WHEN abs(value - lag(value) OVER w) > 50 THEN 1 ELSE 0 END AS new FROM frames WINDOW w AS (PARTITION BY user_id ORDER BY frame)),
        numbered AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY frame) AS BIGINT) AS session FROM marked)
        SELECT user_id, session, count(*) AS n, round(avg(value), 6) AS mean_value FROM numbered GROUP BY user_id, session""",
        "frames",
    )
)
def streamed_sessions(spark, d):
    """Those that ended, and those still open when the stream stops."""
    ended, state = runs.run_with_state(frames.change_sessions(runs.event_stream(spark, d), 50.0))
    return rounded(ended.unionByName(frames.open_sessions(state)), "mean_value")


@query(with_views("SELECT m, count(*) AS n, round(avg(value), 6) AS mean_value, round(var_samp(value), 6) AS var_value FROM frames GROUP BY m", "frames"))
def streamed_statistics(spark, d):
    return rounded(runs.run_available(frames.running_statistics(runs.event_stream(spark, d)), "complete"), "mean_value", "var_value")


@query(with_views("SELECT user_id, m, max(value) AS value, count(*) AS n_frames FROM frames GROUP BY user_id, m", "frames"))
def streamed_merged_frames(spark, d):
    return runs.run_available(frames.merged_frames(runs.event_stream(spark, d)), "complete")
