"""Account security, mandates, review holds and final authorisation."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from riskspark.constants import DAY, EVENT_SEVERITY, MANDATE_INTERVAL_S, SECOND
from riskspark.operators.asof import probe_totals
from riskspark.operators.hotkeys import DEFAULT, Limits, before, census, find_hot
from riskspark.session import cut_lineage

HOUR = 3600 * SECOND
HOLD_TTL = 300 * SECOND
DEVICE_EVENTS = ("new_device_registration", "device_change")
FOLLOWED = "Password reset immediately followed by new device registration (<1h)"


# --- account takeover ------------------------------------------------------------------

def event_ids(events: DataFrame) -> DataFrame:
    """Deterministic id from customer, type, time, address and device; repeats are dropped."""
    raw = F.concat_ws(":", "customer_id", "event_type", F.col("us").cast("string"), "ip_address", "device_id")
    out = events.withColumn("event_id", F.concat(F.lit("ato_evt_"), F.substring(F.sha2(raw, 256), 1, 16)))
    return out.dropDuplicates(["event_id"])


def security_state(tx: DataFrame, events: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Counts per event type in ``[t - 24 h, t]`` at every transaction, and the number of
    password changes already followed by a device event within an hour.

    A password change p counts from its first device event d1 until p + 24 h, so all counts
    are running totals; transactions are never paired with events.
    """
    known = list(EVENT_SEVERITY)
    kinds = [*known, "other", "followed"]
    nearest = _next_device_event(events, limits)
    kind = F.when(F.col("event_type").isin(known), F.col("event_type")).otherwise("other")
    step = lambda at, k, d: F.struct(at.alias("us"), k.alias("kind"), F.lit(d).alias("d"))
    t, d1 = F.col("us"), F.col("_d1")
    leave = t + F.lit(DAY + 1)
    followed = (F.col("event_type") == "password_change") & (d1 - t <= HOUR)
    steps = F.concat(
        F.array(step(t, kind, 1), step(leave, kind, -1)),
        F.when(followed, F.array(step(d1, F.lit("followed"), 1), step(leave, F.lit("followed"), -1)))
        .otherwise(F.array().cast("array<struct<us:bigint,kind:string,d:int>>")))
    points = nearest.withColumn("_s", F.explode(steps)).select(
        "customer_id", F.col("_s.us").alias("us"),
        *[F.when(F.col("_s.kind") == k, F.col("_s.d")).otherwise(0).alias(f"n_{k}") for k in kinds])
    return probe_totals(points, tx, "customer_id", [f"n_{k}" for k in kinds], inclusive=True, limits=limits)


def _next_device_event(events: DataFrame, limits: Limits) -> DataFrame:
    """First device event at or after each event of the customer (time runs backwards)."""
    back = events.select("customer_id", "us", "event_type", (-F.col("us")).alias("_back"))
    hot = find_hot(back, "customer_id", back, at="_back", limits=limits,
                   counted=census(back, {"customer_id": F.col("customer_id")}, limits=limits))
    mark = F.when(F.col("event_type").isin(*DEVICE_EVENTS), F.col("_back"))
    out = before(hot.segmented(back, "_back"), ["customer_id"], {}, {"_near": mark}, hot, us="_back",
                 inclusive=True)
    return out.withColumn("_d1", -F.col("_near")).drop("_near", "_back", "_seg")


def ato_score(state: DataFrame) -> DataFrame:
    """Score, action, level and indicators from the counts; exact in hundredths."""
    n = lambda k: F.col(f"n_{k}")
    kinds = [*EVENT_SEVERITY, "other"]
    count = sum((n(k) for k in kinds[1:]), n(kinds[0]))
    severity = {k: int(round(s * 100)) for k, s in EVENT_SEVERITY.items()} | {"other": 10}
    base = F.greatest(*[F.when(n(k) > 0, F.lit(s)).otherwise(0) for k, s in severity.items()])
    points = (
        base + F.when(F.col("events_24h") >= 3, 25).otherwise(0) + n("followed") * 35
        + F.when((n("mfa_reset") > 0) & (n("profile_update") > 0), 30).otherwise(0)
        + F.when(n("credential_stuffing_attempt") > 0, 40).otherwise(0))
    p = F.col("_points")
    # The indicator sentences; FOLLOWED once per password change.
    said = F.array_compact(F.array(
        F.when(F.col("events_24h") >= 3, F.concat(
            F.lit("Rapid security event cluster ("), F.col("events_24h").cast("string"), F.lit(" events in 24h)"))),
        F.when(n("followed") > 0, F.array_join(F.array_repeat(F.lit(FOLLOWED), n("followed").cast("int")), "\n")),
        F.when((n("mfa_reset") > 0) & (n("profile_update") > 0),
               "MFA reset accompanied by contact profile modification"),
        F.when(n("credential_stuffing_attempt") > 0,
               "Prior credential stuffing / automated brute force detected")))
    return (
        state.withColumn("events_24h", count)
        .withColumn("_points", F.least(F.lit(100), points))
        .withColumns({
            "ato_score": p / F.lit(100.0),
            "ato_action": F.when(p >= 80, "SUSPEND_ACCOUNT").when(p >= 50, "TRIGGER_HOLD")
            .when(p >= 25, "CHALLENGE_MFA").otherwise("ALLOW"),
            "ato_level": F.when(p >= 80, "CRITICAL").when(p >= 50, "HIGH").when(p >= 25, "MEDIUM").otherwise("LOW"),
            "requires_hold": p >= 50, "indicators": F.flatten(F.transform(said, lambda x: F.split(x, "\n"))), "password_then_device": n("followed"),
        }).drop("_points", *[f"n_{k}" for k in (*kinds, "followed")])
    )


def two_digits(x: Column) -> Column:
    """A non-negative amount or score with two decimals."""
    h = F.round(x * 100).cast("bigint")
    return F.concat(F.floor(h / 100).cast("bigint").cast("string"), F.lit("."),
                    F.lpad((h % 100).cast("string"), 2, "0"))


def guardrail(df: DataFrame) -> DataFrame:
    """Whether the account state allows the amount, and why not."""
    s = two_digits(F.col("ato_score"))
    suspended = F.concat(F.lit("Account suspended due to critical ATO risk ("), s, F.lit(")"))
    held = F.concat(F.lit("Transaction held: High ATO risk score ("), s, F.lit(") on amount $"),
                    two_digits(F.col("amount")))
    reason = F.when(F.col("ato_action") == "SUSPEND_ACCOUNT", suspended).when(
        F.col("requires_hold") & (F.col("amount") > 500), held)
    return df.withColumn("guardrail_reason", reason).withColumn("allowed", F.col("guardrail_reason").isNull())


# --- mandates --------------------------------------------------------------------------

def execute_mandates(attempts: DataFrame, mandates: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Accept or reject every attempt in time order, per mandate.

    Expiry, status and ceiling are decided row by row. Only the cadence of recurring mandates
    depends on earlier acceptances: a fold per mandate, or pointer doubling for a hot one.
    """
    gap = F.lit(0)
    for name, seconds in MANDATE_INTERVAL_S.items():
        gap = F.when(F.col("frequency") == name, F.lit(int(seconds * 950_000))).otherwise(gap)
    rows = attempts.join(mandates.drop("customer_id", "beneficiary_id", "created_us"), "mandate_id").withColumn("_gap", gap)
    static = (
        F.when(F.col("us") > F.col("expires_us"), "EXPIRED").when(F.col("status") != "ACTIVE", "NOT_ACTIVE")
        .when(F.col("amount") > F.col("max_amount"), "OVER_CEILING"))
    rows = rows.withColumn("_static", static)
    passing = rows.where(F.col("_static").isNull())
    once = passing.where("frequency = 'ONCE'").groupBy("mandate_id").agg(
        F.min(F.struct("us", "attempt_id")).alias("_used"))
    accepted = _cadence(passing.where("_gap > 0"), limits).select("attempt_id", F.lit(True).alias("_ok"))
    out = rows.join(once, "mandate_id", "left").join(accepted, "attempt_id", "left")
    me = F.struct("us", "attempt_id")
    reason = (
        F.when(F.col("_static").isin("EXPIRED", "NOT_ACTIVE"), F.col("_static"))
        .when(F.col("_used") < me, "NOT_ACTIVE").when(F.col("_static").isNotNull(), F.col("_static"))
        .when((F.col("_gap") > 0) & F.col("_ok").isNull(), "TOO_EARLY"))
    return out.withColumn("reject_reason", reason).withColumn("accepted", F.col("reject_reason").isNull()).select(
        "mandate_id", "attempt_id", "us", "amount", "accepted", "reject_reason")


def _cadence(candidates: DataFrame, limits: Limits) -> DataFrame:
    """The greedy choice: each accepted attempt is at least ``_gap`` after the last one."""
    first = candidates.groupBy("mandate_id", "us", "_gap").agg(F.min("attempt_id").alias("attempt_id"))
    counted = census(first, {"mandate_id": F.col("mandate_id")}, limits=limits)
    n_hot = counted.busy.get("mandate_id", 0)
    if n_hot == 0:
        return _fold(first)
    names = counted.of("mandate_id").select("mandate_id")
    side = F.broadcast(names) if n_hot <= 100_000 else names
    cold, hot = first.join(side, "mandate_id", "left_anti"), first.join(side, "mandate_id", "left_semi")
    return _fold(cold).unionByName(_doubling(hot, limits))


def _fold(first: DataFrame) -> DataFrame:
    lists = first.groupBy("mandate_id", "_gap").agg(
        F.array_sort(F.collect_list(F.struct("us", "attempt_id"))).alias("_a"))
    walk = F.expr("""aggregate(_a, named_struct('last', cast(null as bigint), 'ids', cast(array() as array<bigint>)),
        (s, x) -> if(s.last is null or x.us - s.last >= _gap,
                     named_struct('last', x.us, 'ids', concat(s.ids, array(x.attempt_id))), s), s -> s.ids)""")
    return lists.select(F.explode(walk).alias("attempt_id"))


def _doubling(first: DataFrame, limits: Limits) -> DataFrame:
    """Successor of each candidate, then jumps of 1, 2, 4, ... successors until none is left."""
    # successor: earliest candidate at or after us + gap, found with time running backwards
    points = first.select("mandate_id", (-F.col("us")).alias("us"), (-F.col("us")).alias("_near"))
    probes = first.select("mandate_id", (-(F.col("us") + F.col("_gap"))).alias("us"), F.col("us").alias("_own"))
    linked = probe_totals(points, probes, "mandate_id", [], ["_near"], inclusive=True, limits=limits)
    jump = cut_lineage(linked.select("mandate_id", F.col("_own").alias("a"), (-F.col("_near")).alias("b"))
                       .where("b is not null"))
    jumps = []
    while not jump.isEmpty():
        jumps.append(jump)
        onward = jump.select("mandate_id", F.col("a").alias("b"), F.col("b").alias("c"))
        jump = cut_lineage(jump.join(onward, ["mandate_id", "b"]).select("mandate_id", "a", F.col("c").alias("b")))
    reached = cut_lineage(first.groupBy("mandate_id").agg(F.min("us").alias("a")))
    for jump in reversed(jumps):
        step = reached.join(jump, ["mandate_id", "a"]).select("mandate_id", F.col("b").alias("a"))
        reached = cut_lineage(reached.unionByName(step))
    return first.join(reached.withColumnRenamed("a", "us"), ["mandate_id", "us"]).select("attempt_id")


def mandate_lifecycle(commands: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Accept or reject lifecycle commands. ``commands``: mandate_id, seq (unique per mandate
    and increasing), command (activate, pause, cancel, limit), new_limit. New mandates are
    PENDING.

    The state before a command follows from three running facts: whether a cancel came
    before, whether an activate came before, and which of activate and pause came last.
    """
    counted = census(commands, {"mandate_id": F.col("mandate_id")}, limits=limits)
    hot = find_hot(commands, "mandate_id", commands, at="seq", limits=limits, counted=counted)
    is_ = lambda c: F.col("command") == c
    valid_limit = is_("limit")
    out = before(
        hot.segmented(commands, "seq"), ["mandate_id"],
        {"_on": is_("activate").cast("int"), "_off": is_("cancel").cast("int")},
        {"_lastmove": F.when(F.col("command").isin("activate", "pause"), F.struct("seq", "command"))},
        hot, us="seq").drop("_seg")
    state = (
        F.when(F.col("_off") > 0, "CANCELLED").when(F.col("_lastmove.command") == "activate", "ACTIVE")
        .when((F.col("_lastmove.command") == "pause") & (F.col("_on") > 0), "PAUSED").otherwise("PENDING"))
    out = out.withColumn("status_before", state)
    s = F.col("status_before")
    ok = (
        F.when(is_("activate"), s.isin("PENDING", "PAUSED")).when(is_("pause"), s == "ACTIVE")
        .when(is_("cancel"), F.lit(True))
        .when(valid_limit, s.isin("PENDING", "ACTIVE") & F.coalesce(F.col("new_limit") > 0, F.lit(False)))
        .otherwise(False))
    after = (
        F.when(~F.col("accepted"), s).when(is_("activate"), "ACTIVE").when(is_("pause"), "PAUSED")
        .when(is_("cancel"), "CANCELLED").otherwise(s))
    return out.withColumn("accepted", ok).withColumn("status_after", after).drop("_on", "_off", "_lastmove")


# --- holds -----------------------------------------------------------------------------

def hmac_sha256(secret: str, message: Column) -> Column:
    """Keyed hash as two nested hashes over constant pads (RFC 2104)."""
    key = secret.encode("utf-8")
    if len(key) > 64:  # longer than one block: its hash is the key
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()
    first = F.sha2(F.concat(F.unhex(F.lit(inner)), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(first)), 256)


def create_holds(requests: DataFrame, secret: str, ttl_us: int = HOLD_TTL) -> DataFrame:
    """One hold per transaction (the earliest request); the token itself is not stored."""
    cols = [c for c in requests.columns if c != "transaction_id"]
    one = requests.groupBy("transaction_id").agg(F.min_by(F.struct(*cols), F.struct("created_us", "hold_id")).alias("r"))
    one = one.select("transaction_id", "r.*")
    token = F.substring(hmac_sha256(secret, F.concat_ws(":", "hold_id", "transaction_id")), 1, 32)
    return one.withColumns({
        "token_hash": F.sha2(token, 256), "expires_us": F.col("created_us") + F.lit(ttl_us), "status": F.lit("HOLD")})


def resolve_holds(holds: DataFrame, actions: DataFrame, ttl_us: int = HOLD_TTL) -> tuple[DataFrame, DataFrame]:
    """Hold outcomes and the verdict of every action.

    Late actions and actions with the right token are effective; the first one decides.
    ``actions``: hold_id, seq, action, token_ok, us.
    """
    base = holds.select("hold_id", F.col("created_us").alias("_created"))
    joined = actions.join(base, "hold_id").withColumn("_late", F.col("us") > F.col("_created") + F.lit(ttl_us))
    effect = F.when(F.col("_late"), "EXPIRED").when(F.col("action") == "CONFIRM", "RELEASED").otherwise("DENIED")
    order = F.struct("us", "seq")
    winner = joined.where(F.col("_late") | F.col("token_ok")).groupBy("hold_id").agg(
        F.min_by(F.struct(effect.alias("status"), F.col("us").alias("resolved_us"), order.alias("at")), order).alias("w"))
    outcome = holds.join(winner, "hold_id", "left").withColumns({
        "status": F.coalesce("w.status", F.lit("HOLD")), "resolved_us": F.col("w.resolved_us")}).drop("w")
    judged = joined.join(winner, "hold_id", "left")
    w = F.col("w")
    wanted = F.when(F.col("action") == "CONFIRM", "RELEASED").otherwise("DENIED")
    verdict = (
        F.when(w.isNull() | (order < w["at"]), "INVALID_TOKEN")
        .when(order == w["at"], F.when(w["status"] == "EXPIRED", "ERROR_EXPIRED").otherwise("APPLIED"))
        .when(w["status"] == wanted, "IDEMPOTENT").otherwise("ERROR_TERMINAL"))
    return outcome, judged.select("hold_id", "seq", "action", "us", verdict.alias("verdict"))


def expired_holds(holds: DataFrame, actions: DataFrame, as_of_us: int, ttl_us: int = HOLD_TTL) -> DataFrame:
    """Open holds past their window at ``as_of_us``."""
    past = actions.where(F.col("us") <= as_of_us)
    outcome, _ = resolve_holds(holds, past, ttl_us)
    return outcome.where((F.col("status") == "HOLD") & (F.col("created_us") + ttl_us < as_of_us)).withColumns({
        "status": F.lit("EXPIRED"), "resolved_us": F.lit(as_of_us),
        "resolution_reason": F.lit("Review window timeout exceeded")})


def hold_notifications(holds: DataFrame, base_url: str = "https://security.example/hold") -> DataFrame:
    return holds.select(
        F.concat_ws("_", F.lit("notif"), "customer_id", F.expr("created_us div 1000").cast("string")).alias("notification_id"),
        "customer_id", F.lit("PUSH").alias("channel"),
        F.concat(F.lit("Was this you? Transaction #"), "transaction_id", F.lit(" for $"), two_digits(F.col("amount")),
                 F.lit(" is pending your approval.")).alias("message"),
        F.concat_ws("/", F.lit(base_url), "hold_id").alias("action_url"))


# --- authorisation ---------------------------------------------------------------------

def authorise(df: DataFrame) -> DataFrame:
    """Final decision over the layers: amount, balance, account state, pipeline decision."""
    amount = F.col("amount").cast("double")
    suspended = F.col("ato_action") == "SUSPEND_ACCOUNT"
    blocked = suspended | (F.col("decision") == "BLOCK")
    held = F.col("requires_hold") | (F.col("decision") == "REVIEW") | (
        (F.col("risk_score") >= 30) & (F.col("risk_score") < 70))
    bad_amount, poor = amount <= 0, F.col("origin_balance") < amount
    layer = lambda a, b, c, d, e: (
        F.when(bad_amount, a).when(poor, b).when(blocked, c).when(held, d).otherwise(e))
    return df.withColumns({
        "final_decision": layer("REJECTED", "REJECTED", "BLOCK", "HOLD", "APPROVE"),
        "gateway_status": layer("DECLINED", "INSUFFICIENT_FUNDS", "DECLINED", "HELD", "APPROVED"),
        "workflow_status": layer(
            F.lit("REJECTED"), F.lit("REJECTED"),
            F.when(suspended, "DECLINED_ATO_SUSPENDED").otherwise("DECLINED_BLOCK"),
            F.lit("HELD_PENDING_VERIFICATION"), F.lit("APPROVED")),
        "money_moves": layer(F.lit(False), F.lit(False), F.lit(False), F.lit(False), F.lit(True)),
    })


def settle(transfers: DataFrame) -> DataFrame:
    """Net movement per account from approved transfers."""
    legs = F.array(F.struct(F.col("customer_id").alias("account"), (-F.col("amount")).alias("delta")),
                   F.struct(F.col("merchant_id").alias("account"), F.col("amount").alias("delta")))
    legs = transfers.select(F.explode(legs).alias("leg"))
    return legs.groupBy(F.col("leg.account").alias("account")).agg(
        F.sum("leg.delta").alias("net"), F.count(F.lit(1)).alias("legs"))


def alerts(decisions: DataFrame) -> DataFrame:
    """One open alert per blocking decision."""
    hit = decisions.where((F.col("decision") == "BLOCK") | F.col("hard_block"))
    return hit.select(
        F.concat(F.lit("alt_"), F.substring(F.sha2("transaction_id", 256), 1, 16)).alias("alert_id"),
        "transaction_id", "customer_id", F.when(F.col("hard_block"), "CRITICAL").otherwise("HIGH").alias("severity"),
        F.lit("BLOCK").alias("decision"), F.lit("OPEN").alias("status"), F.col("created_us"))


def cases_from_reports(reports: DataFrame, decisions: DataFrame) -> dict[str, DataFrame]:
    """Confirmed-fraud cases, labels and critical alerts of customer reports."""
    side = decisions.select("transaction_id", F.col("decision").alias("_d"))
    joined = reports.join(side, "transaction_id", "left").withColumn(
        "gateway_decision", F.coalesce("_d", F.lit("APPROVE"))).withColumn(
        "case_id", F.concat(F.lit("CASE-"), F.substring(F.sha2("transaction_id", 256), 1, 12)))
    text = F.concat(F.lit("Customer confirmed unauthorized transfer. Case "), "case_id",
                    F.lit(" recorded. Attack type: "), "attack_type")
    return {
        "cases": joined.select("case_id", "transaction_id", "customer_id", "gateway_decision", "attack_type",
                               F.lit("FRAUD").alias("confirmed_label"), F.lit("CONFIRMED_FRAUD").alias("status"),
                               F.col("reported_us").alias("created_us")),
        "labels": joined.select("transaction_id", F.lit(1).alias("fraud_label"), "reported_us"),
        "alerts": joined.select(F.concat(F.lit("alt_case_"), "transaction_id").alias("alert_id"), "transaction_id",
                                "customer_id", F.lit("CRITICAL").alias("severity"), F.lit("BLOCK").alias("decision"),
                                text.alias("reason"), F.lit("CONFIRMED_FRAUD").alias("status")),
    }


def apply_hold_outcomes(decisions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Resolved holds rewrite their decision."""
    side = outcomes.select("transaction_id", F.col("status").alias("_h"))
    out = decisions.join(side, "transaction_id", "left")
    h = F.col("_h")
    return out.withColumns({
        "decision": F.when(h == "RELEASED", "APPROVE").when(h == "DENIED", "BLOCK").otherwise(F.col("decision")),
        "workflow_status": F.when(h == "RELEASED", "RELEASED_AND_EXECUTED").when(h == "DENIED", "DENIED_AND_BLOCKED")
        .otherwise(F.coalesce(h, F.lit("FINAL"))),
        "money_moves": h == "RELEASED",
        "alert_severity": F.when(h == "DENIED", "CRITICAL"),
    }).withColumn("money_moves", F.coalesce("money_moves", F.lit(False))).drop("_h")


def timeline(events: DataFrame, tx: DataFrame) -> DataFrame:
    """Chronology of a customer's security events and of the stages of their transactions.

    ``tx`` carries ato_action, final_decision, gateway_status and money_moves. Ordered by
    customer, time, stage and reference when written with a range partitioning.
    """
    title = F.initcap(F.regexp_replace("event_type", "_", " "))
    alarms = events.select(
        "customer_id", "us", F.lit(0).alias("stage"), F.col("source_id").cast("string").alias("ref"),
        F.concat(F.lit("Security Alarm: "), title).alias("event"), F.lit("DETECTED").alias("status"),
        F.when(F.col("event_type").isin("password_change", "login_anomaly", "impossible_travel"), "CRITICAL")
        .otherwise("HIGH").alias("severity"))
    dec = F.col("final_decision")
    step = lambda n, e, st, sev: F.struct(F.lit(n).alias("stage"), e.alias("event"), st.alias("status"), sev.alias("severity"))
    steps = F.array(
        step(1, F.lit("Transfer Initiated"), F.lit("INGRESS"), F.lit("INFO")),
        step(2, F.lit("Gateway Pre-Flight"), F.lit("AUTHORIZING"), F.lit("INFO")),
        step(3, F.lit("Layered Evaluation"), F.lit("EVALUATED"),
             F.when(F.col("ato_action") == "SUSPEND_ACCOUNT", "CRITICAL").when(dec == "BLOCK", "HIGH").otherwise("MEDIUM")),
        step(4, F.concat(F.lit("Authorization Verdict: "), dec), dec,
             F.when(dec == "BLOCK", "CRITICAL").when(dec == "HOLD", "HIGH").otherwise("LOW")),
        step(5, F.when(F.col("money_moves"), "Money Transferred").otherwise("Money Protected"),
             F.when(F.col("money_moves"), "TRANSFERRED").otherwise("PROTECTED"),
             F.when(F.col("money_moves"), "INFO").otherwise("LOW")))
    stages = tx.select("customer_id", "us", F.col("transaction_id").alias("ref"), F.explode(steps).alias("s")).select(
        "customer_id", "us", "s.stage", "ref", "s.event", "s.status", "s.severity")
    return alarms.unionByName(stages)
