"""Reports over the audit log: latest events, activity, failed logins, sessions, SIEM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwell.functions import rules
from maskwell.operators.ranking import latest, latest_per_key, left_join, look_up
from maskwell.session import pin

# --- fixed values --------------------------------------------------------------------
COUNTED_ACTIONS = ("login", "logout", "upload", "download", "text_scan")
SESSION_ENDS = ("logout", "session_timeout")
# --- end of fixed values ---------------------------------------------------------------

SLOT_SECONDS = 15 * 60


def _newest() -> list[Column]:
    return [F.desc("timestamp"), F.desc("log_id")]


def latest_events(
    audit: DataFrame, users: DataFrame, files: DataFrame, n: int | None = 200
) -> DataFrame:
    """The ``n`` newest events with ``username`` and ``original_filename`` (null if none).

    The cut comes before the joins and is written down once, since it is read three times.
    ``n=None`` means all events, in no order, with ordinary joins.
    """
    if n is None:
        named = left_join(audit, users.select("user_id", "username"), "user_id")
        return left_join(named, files.select("file_id", "original_filename"), "file_id")
    top = pin(latest(audit, n, *_newest()))
    named = look_up(top, users, "user_id", "username")
    return look_up(named, files, "file_id", "original_filename").orderBy(*_newest())


def user_activity(audit: DataFrame, files: DataFrame, user_id, n: int = 200) -> DataFrame:
    """The ``n`` newest events of one user; ``original_filename`` is empty if there is none."""
    own = pin(latest(audit.filter(F.col("user_id") == user_id), n, *_newest()))
    return (
        look_up(own, files, "file_id", "original_filename")
        .fillna({"original_filename": ""})
        .orderBy(*_newest())
    )


def login_timeline(activity: DataFrame, n: int = 20) -> DataFrame:
    return latest(activity.filter(F.col("action").isin("login", "logout")), n, *_newest())


def latest_per_user(audit: DataFrame, n: int = 200) -> DataFrame:
    """The ``n`` newest events of every user, ranked from 1."""
    known = audit.filter(F.col("user_id").isNotNull())
    return latest_per_key(known, "user_id", n, _newest(), spread_by="log_id")


def action_counts(audit: DataFrame, n: int | None = None) -> DataFrame:
    """Events per user and counted action, over the ``n`` newest events of the user.

    ``n=None`` counts all events.
    """
    if n is None:
        events = audit.filter(F.col("user_id").isNotNull())
    else:
        events = latest_per_user(audit.select("user_id", "action", "timestamp", "log_id"), n)
    return events.groupBy("user_id").agg(
        *[
            F.count_if(F.col("action") == a).cast("bigint").alias(f"{a}s")
            for a in COUNTED_ACTIONS
        ]
    )


def events_table(events: DataFrame, action: str | None = None, user: str | None = None):
    """Latest events under their display names, filtered by action and user if given."""
    shown = events.select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("Timestamp"),
        F.col("username").alias("User"),
        F.col("action").alias("Action"),
        F.col("original_filename").alias("File"),
    )
    if action is not None:
        shown = shown.filter(F.col("Action") == action)
    if user is not None:
        shown = shown.filter(F.col("User") == user)
    return shown


def username_in(details: Column) -> Column:
    return rules.or_value(F.get_json_object(details, "$.username"), "unknown")


def failed_logins(audit: DataFrame) -> DataFrame:
    """Failed attempts per user name, with the latest one and the alert tier."""
    return (
        audit.filter(F.col("action") == "failed_login")
        .groupBy(username_in(F.col("details")).alias("username"))
        .agg(F.count(F.lit(1)).alias("attempts"), F.max("timestamp").alias("last_attempt"))
        .withColumn("tier", rules.login_tier(F.col("attempts")))
        .orderBy(F.desc("attempts"), F.desc("last_attempt"), "username")
    )


# --- inactivity --------------------------------------------------------------------------
# Two events of one user in the same quarter of an hour are never more than 30 minutes
# apart. So each (user, slot) is first reduced to its ends, before the shuffle, and only
# these are put in order: a user has at most 96 of them a day, however many events.


def _slots(events: DataFrame) -> DataFrame:
    # A timestamp without zone becomes a plain instant, read in the session's zone.
    instant = F.col("timestamp").cast("timestamp")
    order = F.struct("timestamp", "log_id")
    return (
        events.filter(F.col("user_id").isNotNull())
        .withColumn("slot", F.floor(F.unix_seconds(instant) / SLOT_SECONDS))
        .groupBy("user_id", "slot")
        .agg(
            F.min("timestamp").alias("first_at"),
            F.max("timestamp").alias("last_at"),
            F.max_by("action", order).alias("last_action"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def _longer_than_timeout(earlier: Column, later: Column) -> Column:
    return later > earlier + F.make_dt_interval(mins=F.lit(rules.TIMEOUT_MINUTES))


def inactivity_timeouts(audit: DataFrame) -> DataFrame:
    """Returns after more than 30 idle minutes, unless the user had been logged out."""
    by_user = Window.partitionBy("user_id").orderBy("slot")
    return (
        _slots(audit)
        .withColumn("last_active", F.lag("last_at").over(by_user))
        .withColumn("_action", F.lag("last_action").over(by_user))
        .filter(
            _longer_than_timeout(F.col("last_active"), F.col("first_at"))
            & ~F.col("_action").isin(*SESSION_ENDS)
        )
        .select("user_id", "last_active", F.col("first_at").alias("timed_out_at"))
    )


def sessions(audit: DataFrame) -> DataFrame:
    """Activity of each user cut wherever a gap exceeds 30 minutes."""
    by_user = Window.partitionBy("user_id").orderBy("slot")
    new = F.coalesce(
        _longer_than_timeout(F.lag("last_at").over(by_user), F.col("first_at")), F.lit(True)
    )
    return (
        _slots(audit)
        .withColumn("_new", new.cast("int"))
        .withColumn("session_no", F.sum("_new").over(by_user))
        .groupBy("user_id", "session_no")
        .agg(
            F.min("first_at").alias("session_start"),
            F.max("last_at").alias("last_active"),
            F.sum("n").alias("events"),
        )
    )


# --- export ------------------------------------------------------------------------------


def siem_record(details: Column, host: str, tags: Sequence[str]) -> Column:
    """Nested record of one joined event; ``details`` is the metadata, as given.

    ``host`` and ``tags`` name the sending system.
    """
    has_file = F.col("file_id").isNotNull() & (F.col("file_id").cast("string") != "")
    return F.struct(
        F.col("timestamp").cast("string").alias("@timestamp"),
        F.struct(
            F.lit("event").alias("kind"),
            F.when(has_file, "file").otherwise("authentication").alias("category"),
            F.col("action").alias("action"),
            F.lit("success").alias("outcome"),
        ).alias("event"),
        F.struct(F.col("username").alias("name")).alias("user"),
        F.struct(F.col("original_filename").alias("name")).alias("file"),
        F.struct(F.col("ip_address").alias("ip")).alias("source"),
        details.alias("metadata"),
        F.struct(F.lit(host).alias("name")).alias("host"),
        F.array(*[F.lit(t) for t in tags]).alias("tags"),
    )


def siem_lines(
    events: DataFrame, host: str = "maskwell", tags: Sequence[str] = ("maskwell",)
) -> DataFrame:
    """One JSON text per event; ``details`` stays nested JSON, nulls are written out."""
    record = siem_record(F.parse_json(F.coalesce("details", F.lit("{}"))), host, tags)
    return events.select(F.to_json(record, {"ignoreNullFields": "false"}).alias("value"))


def raw_lines(events: DataFrame) -> DataFrame:
    """One JSON text per event with all its columns, nulls included."""
    row = F.struct(
        *[
            F.col(c).cast("string").alias(c) if c == "timestamp" else F.col(c)
            for c in events.columns
        ]
    )
    return events.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("value"))
