"""Alerts: decisions through the state machine to episodes and incident requests."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetmetrics.functions.folds import running

OK, PENDING, FIRING = "OK", "PENDING", "FIRING"
KEY = ["org_id", "rule_key", "host"]
TIMES = ("violation_since", "recovery_since", "episode_start", "cooldown_until")
#: The machine of a rule on a host, times in epoch milliseconds, and what a tick adds to its history.
_MACHINE = "state: string, " + ", ".join(f"{c}: bigint" for c in TIMES)
_TICK = f"tick_ms: bigint, {_MACHINE}, transition: string, start_ms: bigint, recovered_ms: bigint, observed: double"


def _after(m: Column, r: Column) -> Column:
    """The machine after a decision, and the tick's row.

    A rule fires after violating for its whole `for` time, counted from the first violation, and resolves after its whole
    `resolve` time without one, counted from the first tick without; it then ignores violations until its cooldown is over.
    """
    t, violating = r["tick_ms"], r["violating"]
    begins = (m["state"] == OK) & violating & (m["cooldown_until"].isNull() | (t >= m["cooldown_until"]))
    calms = (m["state"] == PENDING) & ~violating
    fires = (m["state"] == PENDING) & violating & (t - m["violation_since"] >= r["for_ms"])
    quiet = (m["state"] == FIRING) & ~violating
    since = F.coalesce(m["recovery_since"], t)
    ends = quiet & (t - since >= r["resolve_ms"])
    none = F.lit(None).cast("bigint")
    now = {
        "state": F.when(begins, PENDING).when(fires, FIRING).when(calms | ends, OK).otherwise(m["state"]),
        "violation_since": F.when(begins, t).when(calms | ends, none).otherwise(m["violation_since"]),
        "recovery_since": F.when(quiet & ~ends, since),
        "episode_start": F.when(fires, m["violation_since"]).when(ends, none).otherwise(m["episode_start"]),
        "cooldown_until": F.when(ends, t + r["cooldown_ms"]).otherwise(m["cooldown_until"]),
    }
    told = {
        "transition": F.when(fires, "FIRED").when(ends, "RESOLVED"), "start_ms": F.when(fires, m["violation_since"]).when(ends, m["episode_start"]),
        "recovered_ms": F.when(ends, since), "observed": r["observed"],
    }
    return F.struct(t.alias("tick_ms"), *[c.alias(n) for n, c in (now | told).items()])


def _history(ticks: Column, start: Column) -> Column:
    """The rows of a key's decisions, which are in order, from a machine."""
    state = lambda x: F.struct(x["state"].alias("state"), *[x[c].alias(c) for c in TIMES])
    return running(ticks, state(start), lambda m, r: (_after(m, r), state), _MACHINE, _TICK)


def alert_transitions(decisions: DataFrame, rules: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """A row for each decision: the state after it, and the transition (FIRED or RESOLVED, of the episode from transition_start) it made.

    Only rows with a decision move the machine: missing data neither resets nor recovers, while time goes on. prior
    is a table of alert states to start from. A key is a rule on a host; its decisions are one sorted array, folded
    where they are gathered. alert_history() goes through long histories in parts.
    """
    times = rules.select("org_id", "rule_key", *[(F.col(f"{c}_seconds").cast("long") * 1000).alias(f"{c}_ms") for c in ("for", "resolve", "cooldown")])
    rows = decisions.where("violating is not null").select(*KEY, F.unix_millis("tick").alias("tick_ms"), "violating", "observed").join(times, ["org_id", "rule_key"])
    keyed = rows.groupBy(*KEY, "for_ms", "resolve_ms", "cooldown_ms").agg(F.array_sort(F.collect_list(F.struct("tick_ms", "violating", "observed"))).alias("ticks"))
    start = F.struct(F.lit(OK).alias("state"), *[F.lit(None).cast("bigint").alias(c) for c in TIMES])
    if prior is not None:
        before = prior.select(*KEY, F.struct("state", *[F.unix_millis(c).alias(c) for c in TIMES]).alias("prior"))
        keyed, start = keyed.join(before, KEY, "left"), F.coalesce("prior", start)
    ticks = F.transform("ticks", lambda r: F.struct(r["tick_ms"].alias("tick_ms"), r["violating"].alias("violating"), r["observed"].alias("observed"), "for_ms", "resolve_ms", "cooldown_ms"))
    out = keyed.select(*KEY, F.inline(_history(ticks, start)))
    at = lambda c, n: F.timestamp_millis(c).alias(n)
    return out.select(
        *KEY, at("tick_ms", "tick"), "state", "transition", at("start_ms", "transition_start"), at("recovered_ms", "recovered_at"), "observed", *[at(c, c) for c in TIMES],
    )


def alert_history(decisions: DataFrame, rules: DataFrame, path: str, cuts: Sequence[datetime], prior: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(transitions, states at the end) of a long history, gone through between the given instants, one part after another.

    Each part starts from the states that the part before has left, and is written below `path`, so a key never holds more
    than a part's ticks and a lost executor costs one part. Decisions stored by time are read a part at a time.
    """
    spark, parts, ends = decisions.sparkSession, [], [None, *sorted(cuts), None]
    for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
        own = decisions if a is None else decisions.where(F.col("tick") >= F.lit(a))
        moved = alert_transitions(own if b is None else own.where(F.col("tick") < F.lit(b)), rules, prior)
        moved.write.mode("overwrite").parquet(f"{path}/transitions/part={i}")
        parts.append(spark.read.schema(moved.schema).parquet(f"{path}/transitions/part={i}"))
        states = merged_states(prior, alert_state_at(parts[-1]))
        states.write.mode("overwrite").parquet(f"{path}/states/part={i}")
        prior = spark.read.schema(states.schema).parquet(f"{path}/states/part={i}")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole, prior


def merged_states(prior: DataFrame | None, newer: DataFrame) -> DataFrame:
    """The newer states, and those of prior whose key has none."""
    return newer if prior is None else newer.unionByName(prior.select(*newer.columns).join(newer.select(*KEY), KEY, "left_anti"))


def alert_state_at(transitions: DataFrame) -> DataFrame:
    """The last state of each key that ever had a decision."""
    last = F.max_by(F.struct("state", *TIMES), "tick")
    return transitions.groupBy(*KEY).agg(last.alias("s")).select(*KEY, "s.*")


def episode_key(rule_key: Column, host: Column, start: Column) -> Column:
    return F.concat_ws("|", rule_key, host, F.unix_seconds(start).cast("string"))


EPISODE = ["episode_key", "rule_id", "org_id", "host", "state", "incident_id", "incident_number", "started_at", "resolved_at"]


def open_new_episodes(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """existing with the rows of incoming whose key it lacks; of equal keys in incoming one."""
    fresh = incoming.dropDuplicates(["episode_key"]).join(existing.select("episode_key"), "episode_key", "left_anti")
    return existing.select(*EPISODE).unionByName(fresh.select(*EPISODE))


def episodes(transitions: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One row for each firing: OPEN; after its RESOLVED transition RESOLVED, or RESOLVE_PENDING where an incident must be closed first.

    resolved_at is the tick of that transition. A RESOLVED without a known episode is ignored. Transitions are read once.
    """
    moved = transitions.where("transition is not null").withColumn("episode_key", episode_key(F.col("rule_key"), F.col("host"), F.col("transition_start")))
    of = lambda what, c: F.min(F.when(F.col("transition") == what, F.col(c)))
    seen = moved.groupBy("episode_key", F.col("rule_key").alias("rule_id"), "org_id", "host").agg(of("FIRED", "transition_start").alias("_start"), of("RESOLVED", "tick").alias("_end"))
    if existing is None:
        rows = seen.where("_start is not null").dropDuplicates(["episode_key"]).select("*", F.lit("OPEN").alias("state"), F.lit(None).cast("long").alias("incident_id"), F.lit(None).cast("string").alias("incident_number"), F.col("_start").alias("started_at"), F.lit(None).cast("timestamp").alias("resolved_at"))
    else:
        old = existing.select("episode_key", F.struct(*EPISODE).alias("o"))
        both = old.join(seen.dropDuplicates(["episode_key"]), "episode_key", "full_outer").where("o is not null or _start is not null")
        either = lambda c, new: F.when(F.col("o").isNotNull(), F.col(f"o.{c}")).otherwise(new).alias(c)
        rows = both.select("episode_key", "_end", *[either(c, F.col(c)) for c in ("rule_id", "org_id", "host")], either("state", F.lit("OPEN")), *[F.col(f"o.{c}").alias(c) for c in ("incident_id", "incident_number", "resolved_at")], either("started_at", F.col("_start")))
    state = F.when(F.col("_end").isNull() | (F.col("state") != "OPEN"), F.col("state")).when(F.col("incident_id").isNull(), "RESOLVED").otherwise("RESOLVE_PENDING")
    return rows.withColumn("resolved_at", F.coalesce("resolved_at", "_end")).withColumn("state", state).select(*EPISODE)


def recent_episodes(all_episodes: DataFrame, n: int = 10) -> DataFrame:
    return all_episodes.orderBy(F.desc("started_at"), "episode_key").limit(n)


def observed_text(observed: Column) -> Column:
    return F.when(observed.isNull() | F.isnan(observed), F.lit("n/a")).otherwise(F.format_string("%.4f", observed))


# The texts of incidents. The sender's name is a parameter.
SENDER = "Fleet Monitor"
TITLE = ("[MONITOR] ", " on ")
BODY = ("Automated alert from %s.\n\nRule: %s (%s)\nExpression: %s\nHost: %s\nObserved: %s\nSustained: %ds before firing\n"
        "Episode started: %s\nIdempotency key: %s\nSource: %s\n")
RECOVERED = "[%s] Recovery confirmed: %s. Auto-resolving. Episode: %s"
DETAIL = "%s no longer satisfied (latest %s), sustained %ds"
DETAIL_UNKNOWN = "condition no longer satisfied"


def instant_text(ts: Column) -> Column:
    """ISO-8601 in UTC, with a fraction only where there is one."""
    return F.when(F.unix_millis(ts) % 1000 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def incident_text(name, rule_key, expression, host, observed, for_seconds, resolve_seconds, started_at, key, sender: str = SENDER) -> dict[str, Column]:
    """title, body and recovery of an incident, from columns; the source is the sender in lower case with dashes."""
    by, source = F.lit(sender), F.lit(sender.lower().replace(" ", "-"))
    body = F.format_string(BODY, by, name, rule_key, expression, host, observed_text(observed), for_seconds, instant_text(started_at), key, source)
    detail = F.when(expression.isNull(), F.lit(DETAIL_UNKNOWN)).otherwise(F.format_string(DETAIL, expression, observed_text(observed), resolve_seconds))
    return {"title": F.concat(F.lit(TITLE[0]), name, F.lit(TITLE[1]), host), "body": body, "recovery": F.format_string(RECOVERED, by, detail, key)}


def incident_outbox(all_episodes: DataFrame, rules: DataFrame, observed: DataFrame | None = None, sender: str = SENDER) -> DataFrame:
    """(episode_key, action, title, body, priority): what to send; a row stays until its episode has changed, so a failed send is sent again.

    create: open episodes without an incident. resolve: episodes whose incident is still to be closed; the body is
    the comment. observed (episode_key, observed) gives the value to show.
    """
    todo = all_episodes.where("(state = 'OPEN' and incident_id is null) or state = 'RESOLVE_PENDING'")
    known = rules.select("org_id", F.col("rule_key").alias("rule_id"), "name", "expression", "severity", "for_seconds", "resolve_seconds")
    rows = todo.join(known, ["org_id", "rule_id"], "left")
    rows = rows.join(observed, "episode_key", "left") if observed is not None else rows.withColumn("observed", F.lit(None).cast("double"))
    names = ("name", "rule_id", "expression", "host", "observed", "for_seconds", "resolve_seconds", "started_at", "episode_key")
    text = incident_text(*[F.col(c) for c in names], sender=sender)
    create = F.col("state") == "OPEN"
    return rows.select(
        "episode_key", F.when(create, "create").otherwise("resolve").alias("action"), F.when(create, text["title"]).alias("title"),
        F.when(create, text["body"]).otherwise(text["recovery"]).alias("body"), F.col("severity").alias("priority"),
    )
