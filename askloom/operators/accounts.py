"""Users, subscriptions, trials and donations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom.functions import text as T
from askloom.operators.blocked import asof_join, blocked_rank, day
from askloom.operators.chains import reached
from askloom.operators.corpus import page, with_total
from askloom.operators.ingest import DOMAINS, domain_check
from askloom.session import staged

# Trial size, granted week, smallest donation per currency.
MAX_TRIALS = 3
GRANT_DAYS = 7
MIN_AMOUNT = {"PKR": 50.0, "USD": 0.5}


def _ts(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def latest_subscription(subs: DataFrame) -> DataFrame:
    """Newest subscription per user, by creation time and id. The maximum is combined on the map side."""
    rest = [c for c in subs.columns if c not in ("user_id", "created_at", "id")]
    newest = subs.groupBy("user_id").agg(F.max(F.struct("created_at", "id", *rest)).alias("m"))
    return newest.select("user_id", "m.*")


def subscription_valid(status: Column, expires_at: Column, at: Column) -> Column:
    return F.coalesce((status == "active") & (expires_at > at), F.lit(False))


def trial_row(trials: DataFrame) -> DataFrame:
    """Newest trial row per user."""
    newest = trials.groupBy("user_id").agg(F.max(F.struct("id", "used_count", "max_count")).alias("m"))
    return newest.select("user_id", "m.used_count", "m.max_count")


def user_status(users: DataFrame, subs: DataFrame, trials: DataFrame, as_of: str) -> DataFrame:
    """Users with subscription, remaining trials and what they may do. Users without trial row have all trials."""
    newest = latest_subscription(subs).select(
        F.col("user_id").alias("id"), "plan", F.col("status").alias("subscription_status"), "expires_at"
    )
    trial = trial_row(trials).withColumnRenamed("user_id", "id")
    joined = users.join(newest, "id", "left").join(trial, "id", "left")
    valid = subscription_valid(F.col("subscription_status"), F.col("expires_at"), _ts(as_of))
    used, most = F.coalesce("used_count", F.lit(0)), F.coalesce("max_count", F.lit(MAX_TRIALS))
    out = joined.withColumns(
        {"can_save": valid, "trials_remaining": F.greatest(most - used, F.lit(0)).cast("long")}
    )
    out = out.withColumn("can_use_ai", F.col("can_save") | (F.col("trials_remaining") > 0))
    return out.drop("used_count", "max_count")


def user_list_status(
    users: DataFrame, subs: DataFrame, trials: DataFrame, as_of: str, provider: str | None = None, number: int = 1, size: int = 20
) -> DataFrame:
    """A page of users with their status. The page is cut first; at most ``size`` users meet the other tables."""
    rows = users.filter(F.col("provider") == provider.strip()) if provider and provider.strip() else users
    top = page(rows, [F.desc("created_at"), F.desc("id")], number, size)
    ids = F.broadcast(top.select(F.col("id").alias("user_id")))
    status = user_status(top, subs.join(ids, "user_id", "left_semi"), trials.join(ids, "user_id", "left_semi"), as_of)
    return with_total(status, rows)


def guest_merge(links: DataFrame, trials: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trial rows and users after guests ``guest_id`` became social users ``user_id``.

    The social user keeps the larger use count; the guest turns inactive.
    """
    real = links.filter(F.col("guest_id") != F.col("user_id"))
    trial = trial_row(trials)
    guest = trial.select(F.col("user_id").alias("guest_id"), "used_count")
    merged = real.join(guest, "guest_id", "left").groupBy("user_id").agg(F.max(F.coalesce("used_count", F.lit(0))).alias("guest_used"))
    both = trial.join(merged, "user_id", "full")
    counts = both.select(
        "user_id",
        F.greatest(F.coalesce("used_count", F.lit(0)), F.coalesce("guest_used", F.lit(0))).cast("long").alias("used_count"),
        F.coalesce("max_count", F.lit(MAX_TRIALS)).cast("long").alias("max_count"),
    )
    gone = real.select(F.col("guest_id").alias("id"), F.lit(False).alias("stays")).distinct()
    people = users.join(gone, "id", "left").withColumn("is_active", F.col("is_active") & F.coalesce("stays", F.lit(True))).drop("stays")
    return counts, people


def trial_replay(uses: DataFrame, subs: DataFrame, trials: DataFrame) -> DataFrame:
    """Use events ``id, user_id, used_at`` with ``outcome``.

    ``subscribed`` uses cost nothing; the first remaining ones count as ``used``; all later ones are ``exhausted``.
    The running count per user is a blocked rank, and the subscription at the time of use an as-of join.
    """
    at_use = asof_join(uses, subs, "user_id", "used_at", "created_at", ["status", "expires_at"])
    valid = subscription_valid(F.col("latest.status"), F.col("latest.expires_at"), F.col("used_at"))
    known = at_use.select(*uses.columns, valid.alias("paid"))
    ranked = blocked_rank(known, ["user_id", "paid"], ["used_at", "id"], day("used_at"))
    joined = ranked.join(trial_row(trials), "user_id", "left")
    left = F.coalesce("max_count", F.lit(MAX_TRIALS)) - F.coalesce("used_count", F.lit(0))
    outcome = F.when(F.col("paid"), F.lit("subscribed")).when(F.col("rank") <= left, F.lit("used")).otherwise(F.lit("exhausted"))
    return joined.select(*uses.columns, outcome.alias("outcome"))


def identity_key(provider: Column, guest_id: Column, provider_uid: Column, email: Column) -> Column:
    """Key under which a sign-in finds its user: guest id, provider and uid, or e-mail address."""
    return (
        F.when(provider == "guest", F.concat(F.lit("guest:"), T.strip(guest_id)))
        .when(provider == "email", F.concat(F.lit("email:"), F.lower(T.strip(email))))
        .otherwise(F.concat(provider, F.lit(":"), T.strip(provider_uid)))
    )


def identity_upsert(events: DataFrame, users: DataFrame) -> DataFrame:
    """Users ``key, created_at, last_seen_at, is_new`` after sign-ins ``key, ts``."""
    seen = events.filter(F.coalesce("key", F.lit("")) != "").groupBy("key").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    both = users.select("key", "created_at", "last_seen_at", F.lit(True).alias("known")).join(seen, "key", "full")
    return both.select(
        "key",
        F.coalesce("created_at", "first_ts").alias("created_at"),
        F.coalesce(F.greatest("last_ts", "last_seen_at"), "last_ts", "last_seen_at").alias("last_seen_at"),
        F.col("known").isNull().alias("is_new"),
    )


def subscription_requests(rows: DataFrame, users: DataFrame) -> DataFrame:
    """Requests with ``reason``: the domain check's, else an unknown user, else an empty string."""
    checked = domain_check(rows, DOMAINS["subscription"])
    known = users.select(F.col("id").alias("user_id"), F.lit(True).alias("known"))
    reason = F.when(F.col("reason") != "", F.col("reason")).when(F.col("known").isNull(), F.lit("user not found")).otherwise(F.lit(""))
    return checked.join(known, "user_id", "left").withColumn("reason", reason).drop("known")


def subscription_append(rows: DataFrame, users: DataFrame, subs: DataFrame) -> DataFrame:
    """Subscriptions plus the valid new rows of existing users; every request becomes a row of its own.

    What is not appended stands in ``subscription_requests`` with its reason.
    """
    good = subscription_requests(rows, users).filter(F.col("reason") == "")
    return subs.unionByName(good.select(*subs.columns))


# Donations ----------------------------------------------------------------------------------------------------


def donation_validate(rows: DataFrame, users: DataFrame) -> DataFrame:
    """Rows with ``reason``: below the minimum of the currency, or an unknown user."""
    known = users.select(F.col("id").alias("user_id"), F.lit(True).alias("known"))
    reason = F.lit(None).cast("string")
    for currency, least in MIN_AMOUNT.items():
        reason = F.when((F.col("currency") == currency) & (F.col("amount") < least), F.lit("below minimum")).otherwise(reason)
    joined = rows.join(known, "user_id", "left")
    return joined.withColumn("reason", F.coalesce(reason, F.when(F.col("known").isNull(), F.lit("user not found")))).drop("known")


def _counted() -> Column:
    return (F.col("currency") == "PKR") & (F.col("status") == "success")


def _money(amount: Column) -> Column:
    """Exact decimal sum, so that the order of addition cannot show."""
    return F.coalesce(F.sum(amount.cast("decimal(18,2)")), F.lit(0)).cast("double")


def donation_history(df: DataFrame, user: int) -> DataFrame:
    """Donations of one user, newest first, with the total of the successful ones."""
    own = df.filter(F.col("user_id") == user)
    total = own.agg(_money(F.when(_counted(), F.col("amount"))))
    return own.orderBy(F.desc("donated_at"), F.desc("id")).withColumn("total_donated_pkr", total.scalar())


def donation_totals(df: DataFrame) -> DataFrame:
    """Donations and successful amount per user."""
    return df.groupBy("user_id").agg(F.count("*").alias("n"), _money(F.when(_counted(), F.col("amount"))).alias("total_donated_pkr"))


def donation_stats(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("total_donations"),
        _money(F.when(_counted(), F.col("amount"))).alias("total_amount_pkr"),
        F.count_if(F.col("status") == "success").alias("successful"),
        F.count_if(F.col("status") == "pending").alias("pending"),
        F.count_if(F.col("week_granted")).alias("weeks_granted"),
    )


def donation_list(df: DataFrame, status: str | None = None, number: int = 1, size: int = 20) -> DataFrame:
    rows = df.filter(F.col("status") == status.strip()) if status and status.strip() else df
    return with_total(page(rows, [F.desc("donated_at"), F.desc("id")], number, size), rows)


def donation_verify(events: DataFrame, donations: DataFrame) -> DataFrame:
    """Verify events ``seq, donation_id, user_id, verified_at`` with ``outcome``.

    The first proper event of a donation makes it ``success``; those after it find it ``already``.
    """
    target = donations.select(F.col("id").alias("donation_id"), F.col("user_id").alias("owner"), F.col("status").alias("was"))
    joined = events.join(target, "donation_id", "left")
    base = (
        F.when(F.col("owner").isNull(), F.lit("not found"))
        .when(F.col("owner") != F.col("user_id"), F.lit("not owner"))
        .when(F.col("was") == "success", F.lit("already"))
    )
    checked = joined.withColumn("outcome", base).drop("owner", "was")
    first = checked.filter(F.col("outcome").isNull()).groupBy("donation_id").agg(F.min("seq").alias("seq"))
    out = checked.join(first.withColumn("first", F.lit(True)), ["donation_id", "seq"], "left")
    verdict = F.coalesce("outcome", F.when(F.col("first"), F.lit("success")).otherwise(F.lit("already")))
    return out.withColumn("outcome", verdict).drop("first")


def grant_week(verified: DataFrame, subs: DataFrame) -> DataFrame:
    """Granted weeks ``id, user_id, started_at, expires_at`` for donations ``id, user_id, verified_at, week_granted``.

    A donation grants a week when its user's newest subscription is not valid at that moment; a granted week is
    itself the newest subscription until a later one is made. So what is granted next depends on the moment of a grant alone, and every
    donation has one successor, were it granted: the first one a week later, if no subscription is made until then, else the first one
    after that subscription's start whose newest subscription is not valid. Both are as-of joins by (user, day). The grants
    are what the first one reaches, found in as many rounds as the number of weeks has binary digits.
    """
    return _granted(verified, subs)[0]


def _granted(verified: DataFrame, subs: DataFrame) -> tuple[DataFrame, int]:
    open_rows = verified.filter(~F.col("week_granted")).select("id", "user_id", "verified_at")
    at = asof_join(open_rows, subs, "user_id", "verified_at", "created_at", ["status", "expires_at"])
    valid = subscription_valid(F.col("latest.status"), F.col("latest.expires_at"), F.col("verified_at"))
    todo = staged(at.select("id", "user_id", "verified_at", F.col("latest.ts").alias("sub_at"), valid.alias("valid")), "grants-todo")
    week = F.expr(f"INTERVAL '{GRANT_DAYS}' DAY")
    micros = F.unix_micros(F.col("verified_at").cast("timestamp"))

    def span(c: str) -> Column:
        return F.floor(F.col(c) / (86400 * 1000000))

    def following(left: DataFrame, at: Column, right: DataFrame, right_at: Column, order: Column, values: list[str]) -> DataFrame:
        """``left`` with the first row of ``right`` at or after ``at``: the newest one in reversed time."""
        turned = right.withColumns({"_from": -right_at, "_tie": -order}).select("user_id", "_from", "_tie", *values)
        return asof_join(left.withColumn("_at", -at), turned, "user_id", "_at", "_from", values, tie="_tie", block=span).drop("_at")

    # Subscriptions made strictly after a donation: microseconds are whole.
    made = subs.filter(F.col("created_at").isNotNull()).select("user_id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("made")).distinct()
    base = todo.withColumn("at", micros).select("id", "user_id", "at", "valid")
    later = following(base, F.col("at") + 1, made, F.col("made"), F.lit(0), ["made"])
    later = later.select("id", "user_id", "at", F.col("latest.made").alias("made"))
    target = base.select("user_id", F.col("at").alias("to_at"), F.col("id").alias("to"), "valid")
    byweek = following(later, F.col("at") + GRANT_DAYS * 86400 * 1000000, target, F.col("to_at"), F.col("to"), ["to", "to_at"])
    in_time = F.col("latest.to_at").isNotNull() & (F.col("made").isNull() | (F.col("latest.to_at") < F.col("made")))
    byweek = byweek.select("id", "user_id", "made", F.when(in_time, F.col("latest.to")).alias("by_week"))
    resumed = following(byweek, F.col("made"), target.filter(~F.col("valid")), F.col("to_at"), F.col("to"), ["to"])
    jumps = resumed.select(F.col("id").alias("node"), F.coalesce("by_week", "latest.to").alias("to"))
    first = todo.filter(~F.col("valid")).groupBy("user_id").agg(F.min(F.struct("verified_at", "id")).alias("m"))
    ids, rounds = reached(first.select(F.col("m.id").alias("node")), jumps)
    out = todo.join(ids.withColumnRenamed("node", "id"), "id", "left_semi")
    out = out.select("id", "user_id", F.col("verified_at").alias("started_at"), (F.col("verified_at") + week).alias("expires_at"), F.lit("free_ai_week").alias("plan"))
    return out, rounds
