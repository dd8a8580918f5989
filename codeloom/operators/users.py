"""Sessions, tokens, permissions, profiles and personal ranking."""

from pyspark.sql import functions as F

from codeloom import params
from codeloom.functions.text import fingerprint
from codeloom.operators.candidates import rank
from codeloom.skew import ROWS_PER_TASK, last_before, null_safe_join

SECOND = 1000000


def session_gate(requests, auth_events, user="user_id", t="t", row_id="event_id",
                 rows=ROWS_PER_TASK):
    """Requests whose user's newest earlier auth event is a sign-in.

    ``auth_events`` has ``status`` "in" or "out". An as-of lookup.
    """
    both = requests.withColumn("_request", F.lit(True)).unionByName(
        auth_events.select(user, t, row_id, "status").withColumn("_request", F.lit(False)),
        allowMissingColumns=True,
    )
    seen = last_before(both, user, t, row_id, "status", "_status", rows)
    return seen.where(F.col("_request") & (F.col("_status") == "in")).drop(
        "_request", "_status", "status"
    )


def issue_tokens(attempts, users, order_col, row_id):
    """Login attempts with ``issued_at``: null for an unknown user or a wrong secret."""
    known = users.select("username", "secret_digest")
    checked = attempts.join(known, "username", "left")
    right = F.sha2("secret", 256) == F.col("secret_digest")
    return checked.withColumn("issued_at", F.when(right, F.col(order_col))).drop("secret_digest")


def token_validity(requests, tokens, user="user_id", t="t", row_id="event_id",
                   lifetime=params.TOKEN_LIFETIME_S * SECOND, rows=ROWS_PER_TASK):
    """Requests with ``issued`` (newest token at or before the request) and ``valid``.

    All tokens live equally long, so some token covers the request exactly when the newest
    one does; an as-of lookup replaces the many-to-many interval join.
    """
    place = F.struct(F.lit(1).alias("kind"), F.col(row_id).cast("long").alias("id"))
    asked = requests.withColumn("_place", place)
    given = tokens.select(
        user,
        t,
        F.col(t).alias("_issued"),
        F.struct(F.lit(0).alias("kind"), F.col(row_id).cast("long").alias("id")).alias("_place"),
    )
    both = asked.unionByName(given, allowMissingColumns=True)
    seen = last_before(both, user, t, "_place", "_issued", "issued", rows)
    kept = seen.where(F.col("_place.kind") == 1).drop("_place", "_issued")
    return kept.withColumn(
        "valid", F.coalesce(F.col(t) < F.col("issued") + F.lit(lifetime), F.lit(False))
    )


def auth_outcome(token, username):
    """(success, message) of an authentication request; ``username`` is null when not valid."""
    message = (
        F.when(token.isNull(), "No token provided")
        .when(username.isNull(), "Invalid token")
        .otherwise(F.concat(F.lit("Authenticated as "), username))
    )
    return F.struct((token.isNotNull() & username.isNotNull()).alias("success"), message.alias("message"))


def security_event(event_type, message):
    """Text of one security log line."""
    return F.concat(F.lit(params.SECURITY_EVENT_PREFIX), event_type, F.lit(" - "), message)


def check_permissions(requests, users, permission, row_id):
    """Requests with ``permitted``; unknown users and missing lists have no permission."""
    known = users.select("username", "permissions")
    joined = requests.join(known, "username", "left")
    held = F.array_contains(F.coalesce("permissions", F.array().cast("array<string>")), permission)
    return joined.withColumn("permitted", held).drop("permissions")


def check_token_permissions(requests, tokens, users, permission, user="user_id", t="t", row_id="event_id",
                            lifetime=params.TOKEN_LIFETIME_S * SECOND, rows=ROWS_PER_TASK):
    """Requests with ``permitted``: the token is verified first, then its user's permissions.

    Without a valid token nothing is permitted. ``requests`` also has ``username``, the owner of
    the token.
    """
    verified = token_validity(requests, tokens, user, t, row_id, lifetime, rows)
    checked = check_permissions(verified, users, permission, row_id)
    return checked.withColumn("permitted", F.col("valid") & F.col("permitted"))


def merge_updates(updates, user="user_id", order=("ts", "event_id")):
    """Newest value per (user, dictionary, key); merged per task before the shuffle."""
    return updates.groupBy(user, "dictionary", "key").agg(
        F.max_by("value", F.struct(*order)).alias("value")
    )


def profiles(merged, user="user_id"):
    """(user, preferences, coding_patterns): the merged updates as two maps."""
    def dictionary(name):
        mine = F.filter("entries", lambda e: e["dictionary"] == name)
        return F.map_from_entries(F.transform(mine, lambda e: F.struct(e["key"], e["value"])))

    grouped = merged.groupBy(user).agg(
        F.collect_list(F.struct("dictionary", "key", "value")).alias("entries")
    )
    return grouped.select(
        user,
        dictionary("preferences").alias("preferences"),
        dictionary("coding_patterns").alias("coding_patterns"),
    )


def merged_map(left, right):
    """Union of two maps; the right value wins."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)


def profile_vector(preferences, coding_patterns):
    """Array of (key, x): hashed "key:value" entries in key order, L2-normalised, null if zero."""
    entries = F.array_sort(F.map_entries(merged_map(preferences, coding_patterns)))
    hashed = F.transform(
        entries,
        lambda e: F.struct(
            e["key"].alias("key"),
            F.conv(F.substring(F.md5(F.concat(e["key"], F.lit(":"), e["value"])), 1, 8), 16, 10)
            .cast("double")
            .alias("x"),
        ),
    )
    norm = F.sqrt(F.aggregate(hashed, F.lit(0.0), lambda a, e: a + e["x"] * e["x"]))
    return F.when(
        norm > 0, F.transform(hashed, lambda e: F.struct(e["key"], (e["x"] / norm).alias("x")))
    )


def get_or_create(requests, profile, user="user_id", row_id="event_id"):
    """Requests with the maps of their user's profile; empty maps for a new user."""
    empty = F.create_map().cast("map<string,string>")
    joined = null_safe_join(requests, profile, user, "left")
    return joined.withColumn(
        "preferences", F.coalesce("preferences", empty)
    ).withColumn("coding_patterns", F.coalesce("coding_patterns", empty))


def feedback_updates(feedback, snippet, accepted):
    """Pattern updates of accept / reject feedback."""
    return feedback.select(
        "user_id",
        "ts",
        "event_id",
        F.lit("coding_patterns").alias("dictionary"),
        F.when(accepted, params.ACCEPTED_KEY).otherwise(params.REJECTED_KEY).alias("key"),
        fingerprint(snippet).alias("value"),
    )


def personal_rank(candidates, profile, snippet, request, tie, bonus=1.0, n=params.INLINE_SUGGESTIONS,
                  user="user_id", row_id="event_id"):
    """Re-rank: the user's accepted pattern earns ``bonus``, the rejected one loses it."""
    known = get_or_create(candidates, profile, user, row_id)
    pattern = fingerprint(snippet)
    moved = (
        F.when(pattern == F.col("coding_patterns")[params.ACCEPTED_KEY], bonus)
        .when(pattern == F.col("coding_patterns")[params.REJECTED_KEY], -bonus)
        .otherwise(0.0)
    )
    scored = known.withColumn("score", F.col("score") + moved).drop("preferences", "coding_patterns")
    return rank(scored, request, tie, n=n)
