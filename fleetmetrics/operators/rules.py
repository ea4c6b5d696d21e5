"""Alert rules as data."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetmetrics.functions.guards import is_blank
from fleetmetrics.plans.rule_programs import programs

# The texts of refusals.
NO_KEY = "ruleKey is required"
NO_NAME = "name is required"
BAD_SEVERITY = "severity must be one of P1, P2, P3, P4"
BAD_TIMES = "for/resolve must be positive and cooldown non-negative"
BAD_EXPRESSION = "invalid expression: "
EXISTS = ("rule '", "' already exists")
MISSING = "no such rule: "


def load_rules(rules: DataFrame, org_id: str, enabled_only: bool = False) -> DataFrame:
    """A tenant's rules by rule_key."""
    rows = rules.where(F.col("org_id") == org_id)
    return (rows.where("enabled") if enabled_only else rows).orderBy("rule_key")


def expression_problems(rules: DataFrame) -> DataFrame:
    """(expression, problem, warning) of each different expression, read in tasks."""
    return programs(rules).select("expression", F.concat(F.lit(BAD_EXPRESSION), "problem").alias("problem"), "warning")


def validate_rules(rules: DataFrame) -> DataFrame:
    """rules with reason, the first thing wrong (null if none), and warning, what a rule that is accepted will still fail with."""
    both = rules.join(expression_problems(rules).withColumnRenamed("expression", "_e"), F.col("expression").eqNullSafe(F.col("_e")), "left")
    reason = (
        F.when(is_blank(F.col("rule_key")), NO_KEY)
        .when(is_blank(F.col("name")), NO_NAME)
        .when(F.col("severity").isNull() | ~F.col("severity").isin("P1", "P2", "P3", "P4"), BAD_SEVERITY)
        .when((F.col("for_seconds") <= 0) | (F.col("resolve_seconds") <= 0) | (F.col("cooldown_seconds") < 0), BAD_TIMES)
        .otherwise(F.col("problem"))
    )
    return both.withColumn("reason", reason).select(*rules.columns, "reason", "warning")


def apply_rule_patches(rules: DataFrame, patches: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """(rules, (org_id, rule_key, op, outcome)) after patches (op: create, update or delete; and the columns of a rule).

    One patch a rule and call. Texts that aren't null and numbers above 0 override; enabled always does, null as
    true. created, updated and deleted are outcomes; any other outcome is the reason that nothing changed.
    """
    old = rules.select(F.col("org_id"), F.col("rule_key"), F.struct(*rules.columns).alias("o"))
    new = patches.select("org_id", "rule_key", "op", F.struct(*[c for c in patches.columns if c != "op"]).alias("n"))
    both = old.join(new, ["org_id", "rule_key"], "full_outer")
    update = F.col("op") == "update"
    t, stamp = {}, F.lit(now).cast("timestamp")
    for c in ("name", "expression", "severity"):
        t[c] = F.when(update, F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))).otherwise(F.col(f"n.{c}"))
    for c in ("for_seconds", "resolve_seconds", "cooldown_seconds"):
        t[c] = F.when(update, F.when(F.col(f"n.{c}") > 0, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))).otherwise(F.col(f"n.{c}"))
    t["enabled"] = F.coalesce(F.col("n.enabled"), F.lit(True))
    t["created_at"], t["updated_at"] = F.when(update, F.col("o.created_at")).otherwise(stamp), stamp
    merged = both.select("org_id", "rule_key", "op", "o", *[v.alias(k) for k, v in t.items()])
    judged = validate_rules(merged)
    quoted = F.concat(F.lit(EXISTS[0]), F.col("rule_key"), F.lit(EXISTS[1]))
    missing = F.concat(F.lit(MISSING), F.col("rule_key"))
    outcome = (
        F.when(F.col("op").isNull(), None)
        .when(F.col("op") == "delete", F.when(F.col("o").isNotNull(), "deleted").otherwise(missing))
        .when(update & F.col("o").isNull(), missing)
        .when(F.col("reason").isNotNull(), F.col("reason"))
        .when((F.col("op") == "create") & F.col("o").isNotNull(), quoted)
        .otherwise(F.when(update, "updated").otherwise("created"))
    )
    done = judged.withColumn("outcome", outcome)
    changed = F.coalesce(F.col("outcome").isin("created", "updated"), F.lit(False))
    kept = done.where(F.coalesce(F.col("outcome") != "deleted", F.lit(True)) & (changed | F.col("o").isNotNull()))
    cols = [c if c in ("org_id", "rule_key") else F.when(changed, F.col(c)).otherwise(F.col(f"o.{c}")).alias(c) for c in rules.columns]
    return kept.select(*cols), done.where("op is not null").select("org_id", "rule_key", "op", "outcome")
