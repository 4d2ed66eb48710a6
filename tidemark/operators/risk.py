"""Budgets, order sizes, exits and the order audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import signed

BUCKETS = ["LOW", "MED", "HIGH"]


def budgets(cash: DataFrame, splits: dict[str, float], reserve: float, most: dict[str, float] | None = None, fallback: float = 0.0) -> DataFrame:
    """(account, bucket, budget, max_per_trade) of cash(account, total): what is left after the reserve, split by bucket; a
    trade may take the whole of it unless ``most`` says less. A total that is not positive is replaced by the fallback."""
    total = F.when(F.col("total") > 0, F.col("total")).otherwise(fallback)
    share = F.explode(F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(float(splits.get(b, 0.0))).alias("split"), F.lit((most or {}).get(b)).cast("double").alias("most")) for b in BUCKETS]))
    x = cash.select("account", F.greatest(total * (1 - reserve), F.lit(0.0)).alias("tradable"), share.alias("x"))
    budget = F.col("tradable") * F.col("x.split")
    return x.select("account", "x.bucket", budget.alias("budget"), F.coalesce("x.most", budget).alias("max_per_trade"))


def deployable(snapshots: DataFrame, now: Column, start: Column, leverage: Column, reserve: float, usage: float = 0.8, most_age: int = 120) -> DataFrame:
    """(account, deployable, live) of snapshots(account, t, avail, ...): from the latest snapshot while it is fresh, else
    from the cash at the start."""
    last = snapshots.groupBy("account").agg(F.max("t").alias("t"), F.max_by("avail", "t").alias("avail"), F.max(start).alias("start"), F.max(leverage).alias("lev"), F.max(now).alias("now"))
    live = F.col("avail").isNotNull() & (F.col("now") - F.col("t") <= most_age)
    value = F.when(live, F.col("avail") * F.col("lev") * usage).otherwise(F.col("start") * F.col("lev") * (1 - reserve))
    return last.select("account", F.greatest(value, F.lit(0.0)).alias("deployable"), live.alias("live"))


def size_orders_v1(orders: DataFrame, least: int, most: int, cap: float, most_open: int) -> DataFrame:
    """orders(id, qty, price, n_open) with sized and reason: nothing beyond so many open positions, else the least of what
    is asked for, a symbol's most and what the cap buys, unless that is under the least."""
    sized = F.least(F.col("qty"), F.lit(most), F.floor(cap / F.greatest(F.coalesce("price", F.lit(100.0)), F.lit(0.01))))
    reason = F.when(F.col("n_open") >= most_open, "max_open_positions").when(sized < max(1, least), "min_qty/notional").otherwise("ok")
    return orders.select("*", F.when(reason == "ok", sized).otherwise(0).cast("long").alias("sized"), reason.alias("reason"))


def size_orders_v2(orders: DataFrame, equity: float, tradable: float, splits: dict[str, float], risk_pct: dict[str, float], caps: dict[str, float], most: int, tick: float = 0.05) -> DataFrame:
    """orders(id, bucket, strategy, qty, is_exit, leverage, entry, stop, ref) with sized and status.

    Exits pass as they are. With a stop the risked money is divided by the distance (a tick at least), without one the
    strategy's cap by the reference price; the bucket's budget and a symbol's most cut it. Nothing left is REJECTED.
    """
    of = lambda c, m, none: F.coalesce(*[F.when(c == k, F.lit(float(v))) for k, v in m.items()], F.lit(none))
    lev = F.when(F.col("leverage") > 0, F.col("leverage")).otherwise(1.0)
    entry = F.coalesce(F.nullif("entry", F.lit(0.0)), F.col("ref"))
    by_risk = F.greatest(F.lit(0), F.floor(equity * of(F.col("bucket"), risk_pct, risk_pct.get("DEFAULT", 0.0)) / 100 * lev / F.greatest(entry - F.col("stop"), F.lit(tick))))
    by_cap = F.floor(of(F.col("strategy"), caps, 0.0) * lev / F.greatest(F.col("ref"), F.lit(0.01)))
    want = F.when(F.col("stop").isNotNull(), by_risk).otherwise(by_cap)
    budget = tradable * of(F.col("bucket"), splits, 0.0)
    clipped = F.when(want * entry / lev > budget, F.floor(budget * lev / F.greatest(entry, F.lit(0.01)))).otherwise(want)
    sized = F.when(F.col("is_exit"), F.col("qty")).otherwise(F.greatest(F.lit(0), F.least(clipped, F.lit(most)))).cast("long")
    kept = orders.where(~F.col("is_exit") | (F.col("qty") > 0))
    return kept.select("*", sized.alias("sized")).withColumn("status", F.when(F.col("sized") > 0, "APPROVED").otherwise("REJECTED"))


def reweight(splits: DataFrame) -> DataFrame:
    """splits(account, bucket, split, dd): halved from a drawdown of 4 % on, three quarters from 2 %, made to sum to 1 by
    account, to 4 places. Accounts whose sum is not positive keep theirs."""
    #: Fixed drawdowns in per cent and what is left of a split from there on.
    w = F.col("split") * F.when(F.col("dd") <= -4, 0.5).when(F.col("dd") <= -2, 0.75).otherwise(1.0)
    total = F.sum("_w").over(Window.partitionBy("account"))
    x = splits.withColumn("_w", w).withColumn("_t", total)
    return x.select("account", "bucket", F.when(F.col("_t") > 0, F.round(F.col("_w") / F.col("_t"), 4)).otherwise(F.col("split")).alias("split"))


def breaches(orders: DataFrame, latest: DataFrame, fills: DataFrame) -> DataFrame:
    """Exits for orders(id, symbol, side, bucket, stop, target) whose level the latest(symbol, c) close has reached, of
    the symbol's net quantity: (id, symbol, side, qty, kind)."""
    net = fills.groupBy(F.col("symbol").alias("_n")).agg(F.sum(signed()).alias("net")).where("net <> 0")
    j = orders.join(net, F.col("symbol") == F.col("_n")).join(latest.select(F.col("symbol").alias("_l"), F.col("c").alias("last")), F.col("symbol") == F.col("_l"), "left")
    j = j.withColumn("last", F.coalesce("last", F.lit(0.0)))
    buy = F.col("side") == "BUY"
    stop = (F.col("stop") > 0) & F.when(buy, F.col("last") <= F.col("stop")).otherwise(F.col("last") >= F.col("stop"))
    target = (F.col("target") > 0) & F.when(buy, F.col("last") >= F.col("target")).otherwise(F.col("last") <= F.col("target"))
    hit = j.withColumn("kind", F.when(stop, "STOP").when(target, "TARGET")).where("kind is not null")
    return hit.select("id", "symbol", F.when(buy, "SELL").otherwise("BUY").alias("side"), F.abs("net").alias("qty"), "kind")


def flatten_list(fills: DataFrame, t: Column, start: int = 915, end: int = 930, shift: int = 19800) -> DataFrame:
    """(symbol, side, qty) that closes every open position, if the time t falls in the local minutes given; else none."""
    net = fills.groupBy("symbol").agg(F.sum(signed()).alias("net"), F.max(t).alias("_t")).where("net <> 0")
    now = net.where(F.floor((F.col("_t") + shift) % 86400 / 60).between(start, end))
    return now.select("symbol", F.when(F.col("net") > 0, "SELL").otherwise("BUY").alias("side"), F.abs("net").alias("qty"))


def canonical_orders(orders: DataFrame) -> DataFrame:
    """Orders in canonical form with audit_hash, the first by time of each client_order_id; those without one are left out.

    The hash is the SHA-256 of compact JSON with sorted keys.
    """
    text = lambda c, d: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(d))
    x = orders.select(
        F.trim("client_order_id").alias("client_order_id"), F.col("ts").cast("long").alias("ts"), F.trim("symbol").alias("symbol"), F.upper("side").alias("side"),
        F.coalesce(F.col("qty").cast("long"), F.lit(0)).alias("qty"), F.upper(text("order_type", "MKT")).alias("order_type"),
        text("strategy", "UNKNOWN").alias("strategy"), F.upper(text("risk_bucket", "MED")).alias("risk_bucket"),
    ).where("client_order_id <> ''")
    core = F.to_json(F.struct("client_order_id", "order_type", "qty", "risk_bucket", "side", "strategy", "symbol", "ts"))
    x = x.withColumn("audit_hash", F.sha2(core, 256))
    first = F.row_number().over(Window.partitionBy("client_order_id").orderBy("ts", "audit_hash"))
    return x.withColumn("_n", first).where("_n = 1").drop("_n")


def lookback_bounds(now: int, days: int, close: int = 925, shift: int = 19800) -> tuple[int, int]:
    """(start, end) in seconds: the last ``days`` local days up to the last whole session, which is yesterday's before the
    local minute ``close``. Literals, so that they reach the scan."""
    day = (now + shift) // 86400
    if (now + shift) % 86400 // 60 < close:
        day -= 1
    return (day - days + 1) * 86400 - shift, (day + 1) * 86400 - shift


def merge_daily(golden: DataFrame, vendor: DataFrame, day: int, start: int = 555, end: int = 930, shift: int = 19800) -> DataFrame:
    """golden with the vendor's bars of one local day's session in place of its own where the vendor has them."""
    at = F.floor((F.col("t") + shift) % 86400 / 60)
    mine = vendor.where((F.floor((F.col("t") + shift) / 86400) == day) & at.between(start, end)).select(*golden.columns)
    return golden.join(mine.select("symbol", "t"), ["symbol", "t"], "left_anti").select(*golden.columns).unionByName(mine)


def union_chunks(chunks: list[DataFrame], keys: list[str]) -> DataFrame:
    """The chunks as one table, a row a key: of those at the seams the earlier chunk's."""
    every = [c.withColumn("_chunk", F.lit(i)) for i, c in enumerate(chunks)]
    out = every[0]
    for c in every[1:]:
        out = out.unionByName(c)
    best = F.row_number().over(Window.partitionBy(*keys).orderBy("_chunk"))
    return out.withColumn("_n", best).where("_n = 1").drop("_n", "_chunk")
