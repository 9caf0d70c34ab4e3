"""Bar cleaning, corporate actions, provenance and operational quality rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chunks
from ..functions.span import BARS as S
from ..functions.span import Span, ratio
from ..session import cut
from ..sources.ohlcv import FIELDS, finite

C = F.col
OHLC = ("open", "high", "low", "close")

# Close-to-close ratios that common splits and bonuses leave behind.
KNOWN_RATIOS = (0.2, 0.25, 1 / 3, 0.4, 0.5, 2 / 3, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0)


def price_rules() -> dict[str, Column]:
    """Row is bad under each rule of the price contract."""
    ok = {f: finite(C(f)).isNotNull() & (C(f) > 0) for f in OHLC}
    return {
        "ohlc_positive": ~reduce(lambda a, b: a & b, ok.values()),
        "volume_non_negative": ~(finite(C("volume")).isNotNull() & (C("volume") >= 0)),
        "high_bound": ~(C("high") >= F.greatest("open", "close", "low")),
        "low_bound": ~(C("low") <= F.least("open", "close", "high")),
        "ts_missing": C("ts").isNull(),
    }


def price_contract(bars: DataFrame) -> DataFrame:
    """(symbol, rule, bad_rows): every rule per symbol; a symbol is accepted only with zero bad rows."""
    per_ts = bars.groupBy("symbol", "ts").agg(
        F.count("*").alias("_n"), *[F.sum(F.coalesce(r, F.lit(True)).cast("bigint")).alias(k) for k, r in price_rules().items()])
    names = [*price_rules(), "duplicate_ts"]
    agg = per_ts.groupBy("symbol").agg(*[F.sum(k).alias(k) for k in price_rules()], F.sum(C("_n") - 1).alias("duplicate_ts"))
    return agg.unpivot(["symbol"], names, "rule", "bad_rows")


def bar_clean(bars: DataFrame, min_rows: int = 10) -> DataFrame:
    bad = reduce(lambda a, b: a | b, [F.coalesce(r, F.lit(True)) for r in price_rules().values()])
    return bars.where(~bad).withColumn("_n", S.size()).where(C("_n") >= min_rows).drop("_n")


def split_candidates(bars: DataFrame) -> DataFrame:
    v = ratio(C("close"), S.lag("close"))
    nearest = F.array_min(F.transform(F.array(*[F.lit(float(r)) for r in KNOWN_RATIOS]), lambda r: F.struct((F.abs(C("ratio") - r) / r).alias("gap"), r.alias("known"))))
    return (bars.select("symbol", "ts", v.alias("ratio")).where("ratio is not null").withColumn("_b", nearest)
            .where(C("_b.gap") <= 0.035).select("symbol", "ts", "ratio", C("_b.known").alias("known_ratio")))


def split_suspects(bars: DataFrame) -> DataFrame:
    """Every suspect, numbered from the oldest."""
    return split_candidates(bars).withColumn("rank", S.rn())


def data_quality_score(raw: DataFrame, valid: Column, sequence: list[str]) -> DataFrame:
    """Score per symbol from rejected rows, zero-volume bars, duplicates and suspected actions."""
    per_ts = raw.withColumn("_ok", F.coalesce(valid, F.lit(False))).groupBy("symbol", "ts").agg(
        F.count("*").alias("n"), F.count_if(~C("_ok")).alias("bad"), F.count_if(C("volume") == 0).alias("zero"),
        F.max_by("close", F.struct("_ok", *sequence)).alias("close"))
    sus = split_candidates(per_ts).groupBy("symbol").agg(F.count("*").alias("suspects"))
    agg = per_ts.groupBy("symbol").agg(F.sum("n").alias("rows"), (F.sum("bad") / F.sum("n")).alias("missingness"),
                                       (F.sum("zero") / F.sum("n")).alias("zero_volume"), F.sum(C("n") - 1).alias("duplicates"))
    d = agg.join(sus, "symbol", "left").withColumn("suspects", F.coalesce("suspects", F.lit(0)))
    score = (1.0 - C("missingness") - 1.5 * C("zero_volume") - F.when(C("duplicates") > 0, 0.5).otherwise(0.0)
             - F.when(C("suspects") > 0, 0.25).otherwise(0.0))
    d = d.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    return d.withColumn("level", F.when(C("score") >= 0.9, "strong").when(C("score") >= 0.7, "limited").otherwise("blocked"))


# ---- corporate actions ---------------------------------------------------------------

def adjust_ratio_actions(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Divide prices and multiply volume by the product of ratios effective after the bar.

    One array of (date, ratio) per symbol joins on the symbol; no range join is needed.
    """
    per = actions.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("ex_date", "ratio"))).alias("_acts"))
    d = bars.join(per, "symbol", "left")
    later = F.filter("_acts", lambda a: a["ex_date"] > C("ts"))
    f = F.coalesce(F.aggregate(later, F.lit(1.0), lambda p, a: p * a["ratio"]), F.lit(1.0))
    d = d.withColumn("factor", f)
    return d.select("symbol", "ts", *[(C(c) / C("factor")).alias(c) for c in OHLC], (C("volume") * C("factor")).alias("volume"), "factor",
                    F.coalesce(F.size(later), F.lit(0)).alias("events"))


# Action types and the terms each needs.
TERMS = {"split": ("ratio",), "bonus": ("ratio",), "rights": ("ratio", "price"), "dividend": ("cash",), "merger": ("factor",),
         "demerger": ("factor",), "symbol_change": (), "isin_change": ("new_isin",)}


def check_actions(actions: DataFrame, isins: DataFrame | None = None) -> DataFrame:
    """Adds `withheld`: why an action must not be applied, else null.

    actions(symbol, target_symbol, action_type, ex_date, seq, ratio, price, cash, factor, new_isin, source_isin)
    """
    bad = F.lit(None).cast("string")
    for kind, terms in reversed(TERMS.items()):
        for term in terms:
            missing = C(term).isNull() if term == "new_isin" else C(term).isNull() | F.isnan(C(term)) | (C(term) <= 0)
            bad = F.when((C("action_type") == kind) & missing, "invalid_terms").otherwise(bad)
    d = actions
    if isins is not None:
        d = d.join(isins, "symbol", "left")
        bad = F.when(C("isin").isNotNull() & C("source_isin").isNotNull() & (C("isin") != C("source_isin")), "isin_mismatch").otherwise(bad)
    bad = F.when(F.coalesce("target_symbol", "symbol") != C("symbol"), "symbol_mismatch").otherwise(bad)
    bad = F.when(~C("action_type").isin(*TERMS), "unknown_type").otherwise(bad)
    return d.withColumn("withheld", bad)


def action_maps(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Per symbol, the ordered price maps p -> a*p + b and volume maps v -> c*v of the accepted actions.

    Rights use the theoretical ex-rights price against the last close before the ex-date,
    itself carried through the earlier maps that already reach that bar.
    """
    ok = actions.where("withheld is null").select("symbol", "action_type", "ex_date", "seq", "ratio", "price", "cash", "factor")
    per = ok.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("ex_date", "seq", "action_type", "ratio", "price", "cash", "factor"))).alias("acts"))
    refs = (bars.join(ok.where("action_type = 'rights'").select("symbol", "ex_date", "seq"), "symbol").where(C("ts") < C("ex_date"))
            .groupBy("symbol", "ex_date", "seq").agg(F.max_by(F.struct("ts", "close"), "ts").alias("ref")))
    ref_map = refs.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("ex_date", "seq").alias("k"), C("ref").alias("v")))).alias("refs"))
    d = per.join(ref_map, "symbol", "left")
    unit = F.array().cast("array<struct<ex_date:date,a:double,b:double,c:double>>")

    def step(acc, x):
        ref = F.try_element_at(C("refs"), F.struct(x["ex_date"].alias("ex_date"), x["seq"].alias("seq")))
        base = F.aggregate(acc, ref["close"], lambda p, m: F.when(m["ex_date"] > ref["ts"], m["a"] * p + m["b"]).otherwise(p))
        terp = F.when(base > 0, (base + x["ratio"] * x["price"]) / (base * (1.0 + x["ratio"])))
        kind = x["action_type"]
        a = (F.when(kind == "split", 1.0 / x["ratio"]).when(kind == "bonus", 1.0 / (1.0 + x["ratio"])).when(kind == "rights", F.coalesce(terp, F.lit(1.0)))
             .when(kind.isin("merger", "demerger"), x["factor"]).otherwise(1.0))
        b = F.when(kind == "dividend", -x["cash"]).otherwise(0.0)
        c = F.when(kind == "dividend", 1.0).otherwise(1.0 / a)
        return F.concat(acc, F.array(F.struct(x["ex_date"].alias("ex_date"), a.alias("a"), b.alias("b"), c.alias("c"))))

    return d.select("symbol", F.aggregate("acts", unit, step).alias("maps"))


def adjust_all_actions(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Bars with every accepted action after them applied; the bars are read for reference prices and for the result, so they are made once."""
    bars = cut(bars)
    d = bars.join(action_maps(bars, actions), "symbol", "left").withColumn("_m", F.filter("maps", lambda m: m["ex_date"] > C("ts")))

    def price(c):
        return F.coalesce(F.aggregate("_m", C(c), lambda p, m: m["a"] * p + m["b"]), C(c)).alias(c)

    vol = F.coalesce(F.aggregate("_m", C("volume"), lambda v, m: v * m["c"]), C("volume")).alias("volume")
    return d.select("symbol", "ts", *[price(c) for c in OHLC], vol, F.coalesce(F.size("_m"), F.lit(0)).alias("applied"))


def verify_adjustment(adjusted: DataFrame, actions: DataFrame) -> DataFrame:
    """Checks at the bar nearest each ex-date; one row per symbol with the verdict."""
    s = S
    b = adjusted.select("symbol", "ts", "close", "volume", s.lag("close").alias("pc"), s.lag("volume").alias("pv"), s.rn().alias("rn"), s.size().alias("n"),
                        F.min("ts").over(s.whole).alias("t0"), F.max("ts").over(s.whole).alias("t1"))
    a = actions.where("withheld is null").select("symbol", "action_type", "ex_date", "seq", "ratio")
    gap = F.struct(F.abs(F.datediff("ts", "ex_date")).alias("g"), (-F.datediff("ts", "ex_date")).alias("later"))
    near = (b.join(a, "symbol").where((C("ex_date") >= C("t0")) & (C("ex_date") <= C("t1"))).groupBy("symbol", "action_type", "ex_date", "seq", "ratio")
            .agg(F.min_by(F.struct("close", "pc", "volume", "pv", "rn", "n", "t0"), gap).alias("x")).select("*", "x.*").drop("x"))
    inside = (C("rn") >= 2) & (C("rn") < C("n"))
    split = C("action_type").isin("split", "bonus")
    want = F.when(C("action_type") == "split", C("ratio")).otherwise(1 + C("ratio"))
    price_ok = F.when(inside & (C("pc") > 0), F.abs(C("close") - C("pc")) / C("pc") < 0.15)
    vol_ok = F.when(inside & split & (C("pv") > 0) & (C("volume") > 0), F.abs(C("pv") / C("volume") - want) < 0.2)
    d = near.select("symbol", price_ok.alias("p"), vol_ok.alias("v"), (C("ex_date") > C("t0")).alias("in_range"))
    return d.groupBy("symbol").agg(
        (F.count("p") + F.count("v")).alias("checks"), F.count_if(C("p") == False).alias("bad_price"),  # noqa: E712
        F.count_if(C("v") == False).alias("bad_volume"), F.count_if("in_range").alias("in_range")).withColumn(  # noqa: E712
        "verified", (C("bad_price") + C("bad_volume") == 0) & ((C("in_range") == 0) | (C("checks") > 0)))


# ---- provenance ----------------------------------------------------------------------

def history_eligibility(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """bars(symbol, ts, ohlcv, provenance, timeframe, actions_verified, received_at, version) to one row per bar with exclusion reasons.

    Conflicts and duplicates are found with aggregates per (symbol, day); history at or
    before the last unusable session is cut off.
    """
    body = F.sha2(F.concat_ws("|", *[C(c).cast("string") for c in FIELDS]), 256)
    rules = reduce(lambda a, b: a | b, [F.coalesce(r, F.lit(True)) for r in price_rules().values()])
    d = bars.withColumn("_body", body).withColumn("_bad", rules)
    frame_bad = d.groupBy("symbol").agg(F.bool_or("_bad").alias("quality_failed"))
    per = d.groupBy("symbol", "ts").agg(F.count_distinct("_body").alias("bodies"), F.count("*").alias("copies"),
                                        F.max_by(F.struct("provenance", "timeframe", "actions_verified", "received_at", *FIELDS), "version").alias("r"))
    per = per.select("symbol", "ts", "bodies", "copies", "r.*").join(frame_bad, "symbol")
    cal = calendar.select(C("ts"), F.lit(True).alias("_session"))
    per = per.join(F.broadcast(cal), "ts", "left")
    close_at = F.to_timestamp(C("ts")) + F.expr("INTERVAL 10 HOURS")
    reasons = F.array_compact(F.array(
        F.when(C("quality_failed"), "failed_price_quality_validation"), F.when(C("provenance") != "real", C("provenance")),
        F.when(C("timeframe") != "1D", "intraday_not_daily_evidence"), F.when(~C("actions_verified"), "actions_unverified"),
        F.when(C("_session").isNull(), "session_calendar_unverified_or_nonregular"), F.when(C("received_at") < close_at, "session_not_completed_at_fetch"),
        F.when(C("bodies") > 1, "conflicting_session"), F.when((C("bodies") == 1) & (C("copies") > 1), "duplicate_session")))
    per = per.withColumn("reasons", reasons)
    sel = F.size("reasons") == 0
    w = S.whole
    last_sel = F.max(F.when(sel, C("ts"))).over(w)
    gap = C("_session").isNull() | (C("bodies") > 1)
    per = per.withColumn("_last", last_sel)
    per = per.withColumn("_cut", F.max(F.when(gap & (C("ts") < C("_last")), C("ts"))).over(w))
    cut = sel & (C("ts") <= C("_cut"))
    return per.select("symbol", "ts", *FIELDS, F.when(cut, F.array_append("reasons", F.lit("history_before_unverified_session_gap"))).otherwise(C("reasons")).alias("reasons"),
                      F.coalesce(sel & ~F.coalesce(cut, F.lit(False)), F.lit(False)).alias("eligible"))


def manifest_reconcile(eligible: DataFrame, dataset: DataFrame) -> DataFrame:
    """Counts of timestamps missing from, extra in, and repeated in the exported dataset, per symbol."""
    e = eligible.groupBy("symbol", "ts").agg(F.count("*").alias("want"))
    x = dataset.groupBy("symbol", "ts").agg(F.count("*").alias("have"))
    j = e.join(x, ["symbol", "ts"], "full_outer")
    return j.groupBy("symbol").agg(F.count_if(C("have").isNull()).alias("missing"), F.count_if(C("want").isNull()).alias("extra"),
                                   F.count_if(C("have") > 1).alias("repeated")).withColumn("matches", (C("missing") == 0) & (C("extra") == 0) & (C("repeated") == 0))


def freshness(bars: DataFrame, now: Column, stale_after: int = 3) -> DataFrame:
    d = bars.groupBy("symbol").agg(F.max("ts").alias("updated_at")).withColumn("age_days", F.datediff(now, "updated_at"))
    d = d.withColumn("sessions_behind", F.greatest(F.lit(0), F.floor(C("age_days") * 5 / 7)))
    return d.withColumn("is_stale", C("sessions_behind") > stale_after)


def universe_reconcile(expected: DataFrame, resolved: DataFrame, sample: int = 25) -> DataFrame:
    """Per exchange: missing, extra, keyed and covered members; counts are complete, the lists name the first `sample` members."""
    e = expected.select("exchange", "symbol").distinct().withColumn("e", F.lit(1))
    r = resolved.groupBy("exchange", "symbol").agg(F.max(F.coalesce("instrument_key", F.lit("")) != "").alias("keyed")).withColumn("r", F.lit(1))
    j = e.join(r, ["exchange", "symbol"], "full_outer")
    state = F.when(C("r").isNull(), "missing").when(C("e").isNull(), "extra")
    j = j.withColumn("state", state)
    w = Window.partitionBy("exchange", "state").orderBy("symbol")
    samples = (j.where("state is not null").withColumn("_r", F.row_number().over(w)).where(C("_r") <= sample).groupBy("exchange")
               .agg(*[F.concat_ws(",", F.array_sort(F.collect_list(F.when(C("state") == s, C("symbol"))))).alias(f"{s}_sample") for s in ("missing", "extra")]))
    agg = j.groupBy("exchange").agg(F.count("e").alias("expected"), F.count("r").alias("resolved"), F.count_if(C("state") == "missing").alias("missing"),
                                    F.count_if(C("state") == "extra").alias("extra"), F.count_if("keyed").alias("resolved_with_key"))
    cov = F.when(C("expected") > 0, 100 - F.round(C("missing") / C("expected") * 100, 2)).otherwise(0.0)
    agg = agg.join(samples, "exchange", "left").withColumns({f"{s}_sample": F.coalesce(f"{s}_sample", F.lit("")) for s in ("missing", "extra")})
    return agg.select(
        "*", cov.alias("covered_pct"), F.when(C("missing") + C("extra") > 0, "refresh").otherwise("in_sync").alias("action"))


def provider_compare(quotes: DataFrame, providers: list[str]) -> DataFrame:
    return quotes.groupBy("symbol").pivot("provider", providers).agg(F.first("price"))


def provider_health(calls: DataFrame, order: list[str], demote_after: int = 3) -> DataFrame:
    """Counts, fallback rate, newest latency and trailing failure run per provider.

    The run is counted against the last success (a small table), not by scanning a window.
    """
    at = F.struct("ts", "event_id")
    base = calls.groupBy("provider").agg(
        F.count("*").alias("requests"), F.count_if("ok").alias("successes"), F.count_if(~C("ok")).alias("failures"),
        F.max_by("latency_ms", at).alias("last_latency_ms"), F.max(F.when(C("ok"), at)).alias("last_ok"), F.max("ts").alias("seen"))
    run = calls.where(~C("ok")).join(F.broadcast(base.select("provider", "last_ok")), "provider").where(
        C("last_ok").isNull() | (at > C("last_ok"))).groupBy("provider").agg(F.count("*").alias("failure_streak"))
    total = base.agg(F.max("seen").alias("now"))
    rank = F.array_position(F.array(*[F.lit(p) for p in order]), C("provider"))
    d = base.join(run, "provider", "left").crossJoin(F.broadcast(total)).withColumn("failure_streak", F.coalesce("failure_streak", F.lit(0)))
    return d.select("provider", "requests", "successes", "failures", F.when(rank > 1, C("successes")).otherwise(0).alias("fallbacks"), "last_latency_ms", "failure_streak",
                    (C("failure_streak") >= demote_after).alias("demoted"), rank.alias("priority"),
                    (C("now").cast("double") - C("last_ok.ts").cast("double")).alias("seconds_since_success"))


def provider_order(quotes: DataFrame, health: DataFrame) -> DataFrame:
    """First usable provider value per symbol: healthy ones by priority, demoted ones last."""
    h = F.broadcast(health.select("provider", "demoted", "priority"))
    d = quotes.where("price is not null").join(h, "provider")
    return d.groupBy("symbol").agg(F.min_by(F.struct("provider", "price"), F.struct("demoted", "priority")).alias("r"), F.count("*").alias("candidates")).select(
        "symbol", "r.*", "candidates")


def trailing_complete_features(features: DataFrame, names: list[str], min_rows: int) -> DataFrame:
    """(symbol, feature, run, kept): the longest-run feature subset that still leaves min_rows complete rows.

    Runs sort descending; completeness of each prefix is counted per bar as the worst rank
    among its missing features, so one pass serves all prefixes.
    """
    f = features.select("symbol", "ts", *names, S.rn_desc().alias("_d"), S.size().alias("_n"))
    runs = f.groupBy("symbol").agg(F.max("_n").alias("rows"), *[F.min(F.when(C(n).isNull(), C("_d"))).alias(n) for n in names])
    runs = runs.unpivot(["symbol", "rows"], names, "feature", "first_null").withColumn("run", F.coalesce(C("first_null") - 1, C("rows")))
    runs = runs.withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("run"), "feature")))
    nulls = f.unpivot(["symbol", "ts"], names, "feature", "v").where("v is null").join(runs.select("symbol", "feature", "rank"), ["symbol", "feature"])
    worst = nulls.groupBy("symbol", "ts").agg(F.min("rank").alias("first_missing"))
    bar = f.select("symbol", "ts").join(worst, ["symbol", "ts"], "left")
    hist = bar.groupBy("symbol", F.coalesce(C("first_missing"), F.lit(len(names) + 1)).alias("fm")).agg(F.count("*").alias("bars"))
    complete = (runs.select("symbol", "rank").join(hist, "symbol").where(C("fm") > C("rank")).groupBy("symbol", "rank").agg(F.sum("bars").alias("complete_rows")))
    best = complete.where(C("complete_rows") >= min_rows).groupBy("symbol").agg(F.max("rank").alias("keep"))
    fallback = max(6, min(12, len(names)))
    return runs.join(best, "symbol", "left").select("symbol", "feature", "run", "rank", (C("rank") <= F.coalesce("keep", F.lit(fallback))).alias("kept"))


def dataset_fingerprint(bars: DataFrame) -> DataFrame:
    """Order-stable hash of each symbol's history: hash per row, then per year, then per symbol."""
    row = F.sha2(F.concat_ws("|", C("ts").cast("string"), *[F.floor(C(c) * 1e6).cast("bigint").cast("string") for c in FIELDS]), 256)
    d = bars.select("symbol", F.year("ts").alias("y"), "ts", row.alias("h"))
    y = d.groupBy("symbol", "y").agg(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("ts", "h"))), lambda x: x["h"])), 256).alias("h"), F.count("*").alias("n"))
    return y.groupBy("symbol").agg(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("y", "h"))), lambda x: x["h"])), 256).alias("fingerprint"), F.sum("n").alias("rows"))


# ---- operations ----------------------------------------------------------------------

def error_groups(events: DataFrame, keys: list[str], newest: int = 10) -> DataFrame:
    """Failures per fingerprint with the newest ids; ids come from a ranked limit, not a full list."""
    d = events.withColumn("fingerprint", F.substring(F.sha2(F.concat_ws("|", *keys), 256), 1, 16))
    agg = d.groupBy("fingerprint", *keys).agg(F.count("*").alias("failures"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    w = Window.partitionBy("fingerprint").orderBy(F.desc("ts"), F.desc("event_id"))
    top = d.withColumn("_r", F.row_number().over(w)).where(C("_r") <= newest).groupBy("fingerprint").agg(
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("_r", "event_id"))), lambda x: x["event_id"].cast("string"))).alias("recent_ids"))
    return agg.join(top, "fingerprint")


def failure_budget_gate(events: DataFrame, budgets: DataFrame) -> DataFrame:
    d = events.groupBy("feature").agg(F.count("*").alias("samples"), F.count_if("failed").alias("failures")).join(F.broadcast(budgets), "feature")
    rate = ratio("failures", "samples")
    return d.select("feature", "samples", F.when(C("samples") >= C("min_samples"), F.round(rate, 4)).alias("failure_rate"),
                    F.when(C("samples") < C("min_samples"), "insufficient_samples").when(rate <= C("max_failure_rate"), "within_budget").otherwise("rolled_back").alias("action"))


def hex_mod(text: Column, mod: int) -> Column:
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint") % mod


def rollout_bucket(flag: Column, subject: Column) -> Column:
    return hex_mod(F.concat_ws(":", flag, subject), 100)


def canary_bucket(key: Column) -> Column:
    return hex_mod(F.upper(key), 10000) / 100.0


def scope_block_match(rows: DataFrame, rules: DataFrame, now: Column, key: list[str]) -> DataFrame:
    """Each request with its newest matching active rule, if any.

    rules is an operator-maintained list; it is deduplicated to one rule per (scope, target)
    and joined once per scope as an equi-join, so requests are never multiplied.
    """
    live = rules.where(C("revoked_at").isNull() & (C("expires_at").isNull() | (C("expires_at") > now)))
    live = live.groupBy("scope", "target").agg(F.max_by(F.struct("rule_id", "reason"), "rule_id").alias("rule"))
    d = rows
    scopes = {"global": F.lit("*"), "asset_class": F.lower("asset_class"), "symbol": F.upper("symbol"), "timeframe": F.lower("timeframe"), "model_version": C("model_version")}
    for s, target in scopes.items():
        r = live.where(C("scope") == s).select(C("target").alias(f"_t_{s}"), F.struct(C("rule.rule_id").alias("rule_id"), C("scope"), C("rule.reason").alias("reason")).alias(f"_r_{s}"))
        d = d.withColumn(f"_k_{s}", target).join(r, C(f"_k_{s}") == C(f"_t_{s}"), "left").drop(f"_t_{s}", f"_k_{s}")
    d = d.withColumn("_hit", F.greatest(*[C(f"_r_{s}") for s in scopes]))
    return d.select(*key, C("_hit").isNotNull().alias("blocked"), C("_hit.scope").alias("scope"), C("_hit.reason").alias("reason"))


def retention_filter(df: DataFrame, ts: Column, cutoff: Column, exempt: Column) -> tuple[DataFrame, Column]:
    """Rows to keep and the deletion predicate (for counting)."""
    drop = (ts < cutoff) & ~exempt
    return df.where(~F.coalesce(drop, F.lit(False))), drop


def failed_event_burst(events: DataFrame, key: str, window_minutes: int, limit: int, every: str = "day") -> DataFrame:
    """Running failure count inside windows that start at a key's first failure; lockout at the limit.

    Counts come from per-chunk counters, so a key with a large share of events stays split.
    """
    a = chunks.greedy_anchors(events, [key], "ts", window_minutes * 60, every=every)
    d = chunks.running(a.withColumn("_one", F.lit(1)), [key, "anchor"], F.date_trunc("minute", "ts"), ["ts", "event_id"], {"failures": ("sum", C("_one"))})
    return d.drop("_one").withColumn("locked", C("failures") >= limit)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(h))


def ip_prefix(ip: Column) -> Column:
    v4 = F.regexp_extract(F.trim(ip), r"^(\d{1,3}\.\d{1,3}\.\d{1,3})\.\d{1,3}$", 1)
    return F.when(v4 != "", F.concat(v4, F.lit(".0/24"))).otherwise("unknown")


def impossible_travel(logins: DataFrame, new_after_days: int = 30, max_kmh: float = 900.0) -> DataFrame:
    """logins(user_id, device, ts, event_id, lat, lon): new-device and impossible-travel flags per login."""
    day = F.to_date("ts")
    d = chunks.previous(logins, ["user_id", "device"], day, ["ts", "event_id"], {"seen": "ts"})
    d = chunks.previous(d, ["user_id"], day, ["ts", "event_id"], {"p_ts": "ts", "p_lat": "lat", "p_lon": "lon"})
    dist = haversine_km(C("p_lat"), C("p_lon"), C("lat"), C("lon"))
    hours = F.greatest((C("ts").cast("double") - C("p_ts").cast("double")) / 3600, F.lit(1e-6))
    d = d.withColumn("distance_km", dist).withColumn("speed_kmh", dist / hours)
    return d.select("user_id", "event_id", "ts", (C("seen").isNull() | (C("ts") > C("seen") + F.expr(f"INTERVAL {new_after_days} DAYS"))).alias("new_device"),
                    "distance_km", "speed_kmh", F.coalesce((C("distance_km") > 50) & (C("speed_kmh") > max_kmh), F.lit(False)).alias("impossible"))


# Secret-bearing key names and token patterns masked in text.
MASK = "[REDACTED]"
KEY_VALUE_NAMES = ["access_token", "refresh_token", "id_token", "api_key", "apikey", "client_secret", "password", "passwd", "pwd", "token",
                   "secret", "authorization", "jwks", "jwt", "x_api_key"]
ASSIGN_NAMES = ["access_token", "refresh_token", "id_token", "api_key", "apikey", "client_secret", "client_password", "password", "passwd",
                "token", "authorization"]
REDACTIONS = {
    "bearer": (r"(?i)\b(bearer\s+)[A-Za-z0-9_\-\.+/=]{8,}", r"$1" + MASK),
    "session": (r"([a-z]+_session=[A-Za-z0-9_\-\.]{8,})", MASK),
    "jwt": (r"(eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-\.]{8,}\.[A-Za-z0-9_\-]{8,})", MASK),
    "oauth_secret": (r"(GOCSPX-[A-Za-z0-9_\-]{10,})", MASK),
    "json_value": (r'(?i)("(?:' + "|".join(KEY_VALUE_NAMES) + r')"\s*:\s*")([^"]+)(")', r"$1" + MASK + r"$3"),
    "assignment": (r"(?i)((?:" + "|".join(ASSIGN_NAMES) + r")\s*[=:]\s*[" + "\"'" + r"]?)([A-Za-z0-9_\-\.+/]+)", r"$1" + MASK),
}


# What a text must hold for a rule to apply, looked for in the text or, for the first group, in its lower case: a plain search that spares most texts the patterns.
NEEDLES = {"bearer": (["bearer"], []), "session": ([], ["_session="]), "jwt": ([], ["eyJ"]), "oauth_secret": ([], ["GOCSPX-"]),
           "json_value": (["token", "api_key", "apikey", "secret", "password", "passwd", "pwd", "authorization", "jwks", "jwt"], []),
           "assignment": (["token", "api_key", "apikey", "client_secret", "password", "passwd", "authorization"], [])}


def redact_text(df: DataFrame, column: str) -> DataFrame:
    """Mask secrets in a text column and count the hits of each rule, in order.

    The session rule masks any cookie whose name ends in _session, so more than one product's own. Masks hold no needle, so
    one look at the text as it came serves all rules.
    """
    d = df.withColumn("_low", F.lower(column))
    for name, (folded, plain) in NEEDLES.items():
        found = [C("_low").contains(x) for x in folded] + [C(column).contains(x) for x in plain]
        d = d.withColumn(f"_has_{name}", F.coalesce(reduce(lambda a, b: a | b, found), F.lit(False)))
    for name, (pattern, repl) in REDACTIONS.items():
        has = C(f"_has_{name}")
        d = d.withColumn(f"n_{name}", F.when(has, F.regexp_count(C(column), F.lit(pattern))).when(C(column).isNotNull(), 0)).withColumn(column, F.when(has, F.regexp_replace(C(column), pattern, repl)).otherwise(C(column)))
    return d.drop("_low", *[f"_has_{n}" for n in NEEDLES])
