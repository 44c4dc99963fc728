"""Users, sessions, activity log, access audit."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom import fixed_values as V
from stockroom.functions import predicates as P
from stockroom.operators.filters import apply_filters, search
from stockroom.operators.keyed import KeyedOrder, cut_points

SAFE_USER_COLUMNS = ["id", "username", "email", "full_name", "phone", "role", "is_active", "last_login", "created_at"]


def safe_users(users: DataFrame, term: str | None = None, role: str | None = None, ascii_only: bool = False) -> DataFrame:
    """User list without secrets. An unknown role is ignored, not an empty result."""
    found = search(users, term, ["username", "full_name", "email"], ascii_only)
    return apply_filters(found, role=role if role in V.ROLES else None).select(*SAFE_USER_COLUMNS)


def users_by_role(users: DataFrame) -> DataFrame:
    return users.where("is_active").groupBy("role").agg(F.count(F.lit(1)).alias("user_count"))


def activity(logs: DataFrame, user_id: int | None = None, module: str | None = None, action: str | None = None) -> DataFrame:
    return apply_filters(logs, user_id=user_id, module=module, action=action)


def recent_logs(logs: DataFrame, count: int = 10) -> DataFrame:
    return logs.orderBy(F.desc("created_at"), F.desc("id")).limit(count)


def open_sessions(sessions: DataFrame, users: DataFrame, count: int = 100) -> DataFrame:
    """The newest open sessions with their users. Expired ones still show here, as the flag decides."""
    newest = sessions.where("is_active").orderBy(F.desc("created_at"), F.desc("id")).limit(count)
    names = users.select(F.col("id").alias("user_id"), "username", "full_name", "role")
    return newest.join(names, "user_id", "left")


def live_sessions(sessions: DataFrame, now: dt.datetime) -> DataFrame:
    return sessions.where(F.col("is_active") & (F.col("expires_at") > P.time_literal(now)))


def permission_matrix(spark: SparkSession) -> DataFrame:
    """method, path, module, action and role: one row per allowed role. Fixed, a few hundred rows."""
    rows = [(method, path, module, action, role) for method, path, group, module, action in V.ENDPOINTS
            for role in V.ROLE_GROUPS[group]]
    return spark.createDataFrame(rows, "method string, path string, module string, action string, role string")


def audit_role_violations(logs: DataFrame, matrix: DataFrame) -> DataFrame:
    """Log rows of governed actions by a role that may not do them; actions outside the matrix pass."""
    allowed = matrix.where(F.col("action").isNotNull()).select("module", "action", "role").distinct()
    governed = allowed.select("module", "action").distinct()
    # The matrix comes from the fixed endpoint list above, so both sides have a few dozen rows.
    return (logs.join(F.broadcast(governed), ["module", "action"], "left_semi")
            .join(F.broadcast(allowed), ["module", "action", "role"], "left_anti"))


def audit_rows(changes: DataFrame) -> DataFrame:
    """Log rows for successful changes that have a known actor."""
    done = changes.where((F.col("status_code") < 400) & F.coalesce(F.col("success"), F.lit(True))
                         & F.col("user_id").isNotNull())
    return done.select("user_id", "username", "role", "action", "module", "description", "record_id", "record_type",
                       F.coalesce("forwarded_for", "remote_address").alias("ip_address"), "created_at")


def rate_audit(requests: DataFrame, key: str, limit: int, time: str = "created_at", minutes: int = 15) -> DataFrame:
    """Clock-aligned windows in which one key made more than `limit` requests."""
    return (requests.groupBy(key, F.window(F.col(time), f"{minutes} minutes").alias("w"))
            .agg(F.count(F.lit(1)).alias("request_count")).where(F.col("request_count") > limit)
            .select(key, F.col("w.start").alias("window_start"), "request_count"))


def apply_user_events(users: DataFrame, sessions: DataFrame, events: DataFrame,
                      **keyed) -> tuple[DataFrame, DataFrame]:
    """Account events in order: `toggle` flips the active flag, and a user's sessions opened before a
    switch-off, `reset` or `logout` are closed by it."""
    known = events.where(F.col("action").isin("toggle", "reset", "logout"))
    flips = known.groupBy("user_id").agg(F.count_if(F.col("action") == "toggle").alias("_flips"))
    switched = (users.join(flips.withColumnRenamed("user_id", "id"), "id", "left")
                .withColumn("is_active", F.when(F.coalesce("_flips", F.lit(0)) % 2 == 1, ~F.col("is_active"))
                            .otherwise(F.col("is_active"))).select(*users.columns))
    # Whether a toggle switches off depends on the flag it meets: the start flag and the toggles so far.
    start = users.select(F.col("id").alias("user_id"), F.col("is_active").alias("_start"))
    # Cut points come from the bare events, before the join.
    cuts = cut_points(known.where(F.col("user_id").isNotNull()), ["user_id"], ["created_at", "id"], **keyed)
    numbered = (KeyedOrder(known.join(start, "user_id"), ["user_id"], ["created_at", "id"], cuts=cuts)
                .running_sum((F.col("action") == "toggle").cast("bigint"), "_toggles").result())
    active_after = F.when(F.col("_toggles") % 2 == 0, F.col("_start")).otherwise(~F.col("_start"))
    closing = numbered.where(F.col("action").isin("reset", "logout") | ((F.col("action") == "toggle") & ~active_after))
    last_close = closing.groupBy("user_id").agg(F.max("created_at").alias("_closed_at"))
    closed = (sessions.join(last_close, "user_id", "left")
              .withColumn("is_active", F.col("is_active") & F.coalesce(F.col("created_at") > F.col("_closed_at"), F.lit(True)))
              .select(*sessions.columns))
    return switched, closed
