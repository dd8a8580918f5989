"""Users, sessions, tokens and profiles.

Users are the customers, login attempts and permission checks the orders, editor activity the
events: signup = sign-in, error = sign-out, click = request, purchase / view = accept / reject.
"""

from pyspark.sql import functions as F

from codeloom import params
from codeloom.operators import users
from codeloom.operators.traffic import user_key
from codeloom.plans.registry import query
from codeloom.plans.traffic import requests
from codeloom.sources.tables import read_table, register

USERS_SQL = """
users AS (SELECT c_custkey AS id, c_name AS username, sha256(c_name || '/' || c_mktsegment) AS secret_digest,
  list_concat(CASE WHEN c_acctbal >= 0 THEN ['read'] ELSE [] END, CASE WHEN c_acctbal >= 5000 THEN ['write'] ELSE [] END) AS permissions
  FROM customer WHERE c_mktsegment <> 'MACHINERY')
"""
NAME_SQL = "'Customer#' || lpad(o_custkey::varchar, 9, '0')"


def user_rows(spark, folder):
    """Registered users; the customers of one market segment have not registered yet."""
    nothing = F.array().cast("array<string>")
    customers = read_table(spark, folder, "customer").where("c_mktsegment <> 'MACHINERY'")
    return customers.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("username"),
        F.sha2(F.concat_ws("/", "c_name", "c_mktsegment"), 256).alias("secret_digest"),
        F.concat(
            F.when(F.col("c_acctbal") >= 0, F.array(F.lit("read"))).otherwise(nothing),
            F.when(F.col("c_acctbal") >= 5000, F.array(F.lit("write"))).otherwise(nothing),
        ).alias("permissions"),
    )


def attempts(spark, folder):
    name = F.format_string("Customer#%09d", "o_custkey")
    return read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("event_id"),
        F.col("o_orderdate").alias("ts"),
        name.alias("username"),
        F.concat(name, F.when(F.col("o_orderstatus") == "F", "/BUILDING").otherwise("/HOUSEHOLD")).alias("secret"),
    )


@query(
    "user_lookup",
    f"""
    WITH {USERS_SQL}
    SELECT o_orderkey AS event_id, users.id, users.username
    FROM orders JOIN users ON users.username = {NAME_SQL}
    """,
)
def user_lookup(spark, folder):
    known = user_rows(spark, folder).select("id", "username")
    asked = attempts(spark, folder).select("event_id", "username")
    return asked.join(known, "username")


@query(
    "register_unique",
    f"""
    WITH {USERS_SQL}, a AS (SELECT o_orderkey AS event_id, o_orderdate AS ts, {NAME_SQL} AS username FROM orders)
    SELECT event_id, username,
           NOT EXISTS (SELECT 1 FROM users WHERE users.username = a.username)
             AND row_number() OVER (PARTITION BY username ORDER BY ts, event_id) = 1 AS created
    FROM a
    """,
)
def register_unique(spark, folder):
    done = register(user_rows(spark, folder), attempts(spark, folder))
    return done.select("event_id", "username", "created")


@query(
    "login_issue",
    f"""
    WITH {USERS_SQL}, a AS (SELECT o_orderkey AS event_id, o_orderdate AS ts, {NAME_SQL} AS username,
        {NAME_SQL} || CASE WHEN o_orderstatus = 'F' THEN '/BUILDING' ELSE '/HOUSEHOLD' END AS secret FROM orders)
    SELECT event_id, a.username, CASE WHEN sha256(secret) = secret_digest THEN ts END AS issued_at
    FROM a LEFT JOIN users USING (username)
    """,
)
def login_issue(spark, folder):
    issued = users.issue_tokens(attempts(spark, folder), user_rows(spark, folder), "ts", "event_id")
    return issued.select("event_id", "username", "issued_at")


@query(
    "permission_check",
    f"""
    WITH {USERS_SQL}
    SELECT o_orderkey AS event_id, coalesce(list_contains(permissions, 'write'), false) AS permitted
    FROM orders LEFT JOIN users ON users.username = {NAME_SQL}
    """,
)
def permission_check(spark, folder):
    checked = users.check_permissions(
        attempts(spark, folder).select("event_id", "username"), user_rows(spark, folder), "write", "event_id"
    )
    return checked.select("event_id", "permitted")


def activity(spark, folder, *types):
    return requests(spark, folder).where(F.col("event_type").isin(*types))


@query(
    "session_gate_asof",
    """
    WITH s AS (SELECT user_id, ts, CASE event_type WHEN 'signup' THEN 'in' ELSE 'out' END AS status
               FROM events WHERE event_type IN ('signup', 'error'))
    SELECT event_id, r.user_id, r.ts FROM (SELECT * FROM events WHERE event_type = 'click') r
    ASOF JOIN s ON r.user_id = s.user_id AND r.ts > s.ts WHERE status = 'in'
    """,
)
def session_gate(spark, folder):
    return signed_in_clicks(spark, folder).select("event_id", "user_id", "ts")


def signed_in_clicks(spark, folder):
    clicks = activity(spark, folder, "click").select("event_id", "user_id", "ts", "t", "props")
    auth = activity(spark, folder, "signup", "error").withColumn(
        "status", F.when(F.col("event_type") == "signup", "in").otherwise("out")
    )
    return users.session_gate(clicks, auth)


TOKEN_SQL = """
tok AS (SELECT user_id, ts AS issued FROM events WHERE event_type = 'signup'),
asked AS (SELECT r.event_id, r.user_id, r.ts, max(tok.issued) AS issued
  FROM events r LEFT JOIN tok ON r.user_id = tok.user_id AND tok.issued <= r.ts
  WHERE r.event_type = 'click' GROUP BY ALL)
"""


def validity(spark, folder):
    clicks = activity(spark, folder, "click").select("event_id", "user_id", "ts", "t")
    tokens = activity(spark, folder, "signup").select("event_id", "user_id", "t")
    return users.token_validity(clicks, tokens)


@query(
    "token_interval_join",
    f"""
    WITH {TOKEN_SQL}
    SELECT event_id, epoch_us(issued) AS issued, coalesce(ts < issued + INTERVAL 1 HOUR, false) AS valid,
           epoch_us(issued + INTERVAL 1 HOUR) AS expires FROM asked
    """,
)
def token_interval(spark, folder):
    lifetime = F.lit(params.TOKEN_LIFETIME_S * users.SECOND)
    return validity(spark, folder).select(
        "event_id", "issued", "valid", (F.col("issued") + lifetime).alias("expires")
    )


@query(
    "token_permission_check",
    f"""
    WITH {USERS_SQL}, {TOKEN_SQL}
    SELECT event_id, coalesce(ts < issued + INTERVAL 1 HOUR, false) AND coalesce(list_contains(permissions, 'read'), false) AS permitted
    FROM asked LEFT JOIN users ON users.username = 'Customer#' || lpad(user_id::varchar, 9, '0')
    """,
)
def token_permission_check(spark, folder):
    """Clicks by the permissions of the user whose token they carry; an expired token has none."""
    clicks = activity(spark, folder, "click").select("event_id", "user_id", "t")
    named = clicks.withColumn("username", F.format_string("Customer#%09d", "user_id"))
    tokens = activity(spark, folder, "signup").select("event_id", "user_id", "t")
    checked = users.check_token_permissions(named, tokens, user_rows(spark, folder), "read")
    return checked.select("event_id", "permitted")


@query(
    "auth_outcome",
    f"""
    WITH {TOKEN_SQL}, o AS (SELECT *, coalesce(ts < issued + INTERVAL 1 HOUR, false) AS valid FROM asked)
    SELECT event_id, valid AS success, CASE WHEN issued IS NULL THEN 'No token provided'
      WHEN NOT valid THEN 'Invalid token' ELSE 'Authenticated as ' || user_id END AS message
    FROM o
    """,
)
def auth_outcome(spark, folder):
    checked = validity(spark, folder)
    username = F.when(F.col("valid"), F.col("user_id").cast("string"))
    return checked.select("event_id", users.auth_outcome(F.col("issued"), username).alias("o")).select(
        "event_id", "o.*"
    )


@query(
    "security_log",
    """
    SELECT event_id, coalesce(CASE WHEN event_type = 'view' THEN NULL ELSE user_id END::varchar, 'anonymous') AS user_key,
           'Security Event: ' || event_type || ' - ' || props AS message FROM events
    """,
)
def security_log(spark, folder):
    """Log line and user key of every event; views carry no user."""
    events = read_table(spark, folder, "events")
    user = F.when(F.col("event_type") != "view", F.col("user_id"))
    return events.select(
        "event_id",
        user_key(user).alias("user_key"),
        users.security_event(F.col("event_type"), F.col("props")).alias("message"),
    )


PROFILE_SQL = """
u AS (SELECT user_id, ts, event_id,
        CASE WHEN event_type IN ('purchase', 'view') THEN 'coding_patterns' ELSE 'preferences' END AS dictionary,
        CASE event_type WHEN 'purchase' THEN 'accepted_pattern' WHEN 'view' THEN 'rejected_pattern'
          WHEN 'click' THEN 'theme' WHEN 'signup' THEN 'language' ELSE 'rejected_pattern' END AS key,
        CASE WHEN event_type IN ('purchase', 'view') THEN md5(props) ELSE props->>'k' END AS value FROM events),
m AS (SELECT user_id, dictionary, key, arg_max(value, (ts, event_id)) AS value FROM u GROUP BY ALL),
merged AS (SELECT user_id, key, arg_max(value, CASE dictionary WHEN 'coding_patterns' THEN 1 ELSE 0 END) AS value FROM m GROUP BY ALL)
"""


def updates(events):
    """Pattern updates of accepted and rejected snippets, preference updates of the rest."""
    kind = F.col("event_type")
    feedback = events.where(kind.isin("purchase", "view"))
    patterns = users.feedback_updates(feedback, F.col("props"), kind == "purchase")
    preferences = events.where(~kind.isin("purchase", "view")).select(
        "user_id",
        "ts",
        "event_id",
        F.lit("preferences").alias("dictionary"),
        F.when(kind == "click", "theme").when(kind == "signup", "language")
        .otherwise(params.REJECTED_KEY).alias("key"),
        F.from_json("props", "k string")["k"].alias("value"),
    )
    return patterns.unionByName(preferences)


def profile_rows(spark, folder):
    return users.profiles(users.merge_updates(updates(read_table(spark, folder, "events"))))


@query("profile_merge", f"WITH {PROFILE_SQL} SELECT user_id, dictionary, key, value FROM m")
def profile_merge(spark, folder):
    return users.merge_updates(updates(read_table(spark, folder, "events")))


@query("profile_dictionary", f"WITH {PROFILE_SQL} SELECT user_id, key, value FROM merged")
def profile_dictionary(spark, folder):
    both = users.merged_map(F.col("preferences"), F.col("coding_patterns"))
    return profile_rows(spark, folder).select("user_id", F.explode(both))


@query(
    "profile_vector",
    f"""
    WITH {PROFILE_SQL}, h AS (SELECT user_id, key, ('0x' || substring(md5(key || ':' || value), 1, 8))::bigint::double AS h FROM merged)
    SELECT user_id, key, round(h / sqrt(sum(h * h) OVER (PARTITION BY user_id)), 6) AS x FROM h
    """,
)
def profile_vector(spark, folder):
    vector = users.profile_vector(F.col("preferences"), F.col("coding_patterns"))
    long = profile_rows(spark, folder).select("user_id", F.inline(vector))
    return long.withColumn("x", F.round("x", 6))


@query(
    "get_or_create_profile",
    f"""
    WITH {PROFILE_SQL}, p AS (SELECT user_id, count(*) FILTER (dictionary = 'preferences') AS np,
      count(*) FILTER (dictionary = 'coding_patterns') AS nc FROM m GROUP BY 1)
    SELECT c_custkey AS event_id, coalesce(np, 0)::int AS preferences, coalesce(nc, 0)::int AS patterns
    FROM customer LEFT JOIN p ON user_id = c_custkey
    """,
)
def get_or_create(spark, folder):
    asked = read_table(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_custkey").alias("event_id")
    )
    known = users.get_or_create(asked, profile_rows(spark, folder))
    return known.select(
        "event_id", F.size("preferences").alias("preferences"), F.size("coding_patterns").alias("patterns")
    )


@query(
    "personal_rerank",
    f"""
    WITH {PROFILE_SQL}, c AS (SELECT user_id, props, max(value) AS score, min(event_id) AS event_id FROM events GROUP BY ALL),
    s AS (SELECT c.user_id, props, round(score + CASE
        WHEN md5(props) = a.value THEN 100.0 WHEN md5(props) = r.value THEN -100.0 ELSE 0.0 END, 6) AS score
      FROM c LEFT JOIN (SELECT * FROM m WHERE dictionary = 'coding_patterns' AND key = 'accepted_pattern') a ON a.user_id = c.user_id
             LEFT JOIN (SELECT * FROM m WHERE dictionary = 'coding_patterns' AND key = 'rejected_pattern') r ON r.user_id = c.user_id)
    SELECT user_id, props, score, (row_number() OVER (PARTITION BY user_id ORDER BY score DESC, props))::int AS rank
    FROM s QUALIFY rank <= 3
    """,
)
def personal_rerank(spark, folder):
    """Snippets of a user by highest value, moved by the user's newest feedback."""
    events = read_table(spark, folder, "events")
    candidates = events.groupBy("user_id", "props").agg(
        F.max("value").alias("score"), F.min("event_id").alias("event_id")
    )
    ranked = users.personal_rank(
        candidates, profile_rows(spark, folder), F.col("props"), ["user_id"], "props", bonus=100.0
    )
    return ranked.select("user_id", "props", F.round("score", 6).alias("score"), "rank")
