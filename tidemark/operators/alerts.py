"""Alert rules over samples of metrics: what a rule looks at, when that is bad, and for how long before it fires."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``view`` is gauge (the sample itself), increase (of a counter within ``width`` seconds) or rate (that per second);
    it is bad where ``bad`` (">", "<" or "=") holds against ``limit``, and fires when it has been bad for ``hold`` seconds."""

    name: str
    metric: str
    view: str
    bad: str
    limit: float
    hold: int
    width: int = 0

    def slower(self, times: int) -> Rule:
        """The rule for samples that come ``times`` as far apart."""
        return replace(self, hold=self.hold * times, width=self.width * times)


#: The rules in force, in seconds.
RULES = [
    Rule("RiskRejectedSpike", "risk_orders_rejected_total", "rate", ">", 5, 120, 300),
    Rule("ExecNoFills", "exec_orders_filled_total", "increase", "=", 0, 900, 900),
    Rule("OrdersZero", "orders_emitted_total", "increase", "=", 0, 600, 600),
    Rule("HighRejectRate", "oms_reject_rate_24h", "gauge", ">", 0.05, 180),
    Rule("OrderLatencyP95High", "oms_time_to_complete_p95_seconds", "gauge", ">", 5, 120),
    Rule("DrawdownVelocitySpike", "risk_dd_velocity_pct_per_min", "gauge", "<", -0.5, 120),
]


def _seen(rule: Rule) -> Column:
    if rule.view == "gauge":
        return F.col("value")
    over = Window.partitionBy("_r", "label").orderBy("t").rangeBetween(-rule.width, 0)
    rise = F.greatest(F.lit(0.0), F.last("value").over(over) - F.first("value").over(over))
    return rise / rule.width if rule.view == "rate" else rise


def alerts(samples: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(alert, label, t, value, since, firing) for each of samples(metric, label, t, value) that a rule looks at.

    since: when the present stretch of bad samples began (null: the sample is not bad); firing: that is ``hold`` seconds
    or more ago. A counter that fell counts as not having risen. Null values are left out; of samples of one metric, label
    and time the largest counts.
    """
    once = samples.where("value is not null").groupBy("metric", "label", "t").agg(F.max("value").cast("double").alias("value"))
    looks = F.array_compact(F.array(*[F.when(F.col("metric") == r.metric, F.lit(i)) for i, r in enumerate(rules)]))
    each = once.select("label", "t", "value", F.explode(looks).alias("_r"))  # a sample once for each rule that looks at it
    pick = lambda of: F.coalesce(*[F.when(F.col("_r") == i, of(r)) for i, r in enumerate(rules)])
    seen = each.withColumn("value", pick(_seen))
    is_bad = {">": lambda r: F.col("value") > float(r.limit), "<": lambda r: F.col("value") < float(r.limit), "=": lambda r: F.col("value") == float(r.limit)}
    seen = seen.withColumn("_bad", pick(lambda r: is_bad[r.bad](r)))
    by = Window.partitionBy("_r", "label").orderBy("t")
    seen = seen.withColumn("_begins", F.when(F.col("_bad") & ~F.coalesce(F.lag("_bad").over(by), F.lit(False)), F.col("t")))
    since = F.when(F.col("_bad"), F.last("_begins", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    seen = seen.withColumn("since", since)
    firing = F.coalesce(F.col("t") - F.col("since") >= pick(lambda r: F.lit(r.hold)), F.lit(False))
    return seen.select(pick(lambda r: F.lit(r.name)).alias("alert"), "label", "t", "value", "since", firing.alias("firing"))
