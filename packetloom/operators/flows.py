"""Packets to two-way flows and their statistical features.

One shuffle of the packets by (endpoint pair, time slice) is enough. Inside a slice a window
finds runs of packets; each run is reduced to one row of mergeable statistics; runs of a flow
that crosses slice borders are chained and merged. A flow of any length, and an endpoint pair
of any share of the traffic, is therefore spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from packetloom.functions import values as V
from packetloom.plans.sessions import assign_sessions, chain_runs, chain_spec, local_runs, run_bounds
from packetloom.schemas import NETWORK_FEATURES, TCP_FLAGS, TEMPORAL_FEATURES

# Default idle timeout, shortest allowed timeout, pause that ends an active span.
FLOW_TIMEOUT_SECONDS = 10.0
SHORTEST_TIMEOUT_SECONDS = 1.0
IDLE_US = 1_000_000

KEY = ["ip_a", "port_a", "ip_b", "port_b", "protocol"]
FLOW = [*KEY, "_start_ts", "_start_seq"]


def _timeout_us(timeout: float) -> int:
    return round(max(SHORTEST_TIMEOUT_SECONDS, float(timeout)) * 1_000_000)


def flow_key(packets: DataFrame) -> DataFrame:
    """Adds the ordered endpoint pair, the same for both directions, and `from_a`: sent by
    the lower endpoint."""
    src = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port"))
    dst = F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))
    low, high = F.least(src, dst), F.greatest(src, dst)
    return packets.withColumns({
        "ip_a": low["ip"], "port_a": low["port"], "ip_b": high["ip"], "port_b": high["port"],
        "from_a": src == low,
    })


def _flag(packets: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False)) if name in packets.columns else F.lit(False)


def _prepared(packets: DataFrame, ts: str) -> DataFrame:
    rows = flow_key(packets)
    return rows.withColumns({
        "_us": V.micros(ts),
        "_end": _flag(packets, "fin") | _flag(packets, "rst"),
    })


def assign_flows(packets: DataFrame, timeout: float = FLOW_TIMEOUT_SECONDS, ts: str = "packet_time",
                 seq: str = "seq", slice_seconds: float | None = None) -> DataFrame:
    """Adds the flow of each packet: endpoint pair plus `flow_start` and `flow_seq` (first packet).

    A new flow starts at the first packet of a pair, after a gap above the timeout, and after a
    packet with FIN or RST.
    """
    gap = _timeout_us(timeout)
    width = round(slice_seconds * 1_000_000) if slice_seconds else None
    rows = assign_sessions(_prepared(packets, ts), KEY, "_us", seq, gap, width, cut="_end")
    return rows.withColumns({
        "flow_start": F.timestamp_micros("session_ts"), "flow_seq": F.col("session_seq"),
    }).drop("_us", "_end", "session_ts", "session_seq")


# ---------------------------------------------------------------- mergeable statistics
# The wide, repetitive part is written as SQL text: one call per column instead of dozens.

_LISTS = ("len", "a_len", "b_len", "iat", "a_iat", "b_iat", "idle", "act")


def _collect(name: str, x: str) -> list[str]:
    """Statistics of a list of values within a run: count, sum, squared deviations, min, max."""
    x = f"CAST({x} AS DOUBLE)"
    return [
        f"count({x}) AS {name}_n",
        f"coalesce(sum({x}), 0D) AS {name}_s",
        f"coalesce(var_pop({x}) * count({x}), 0D) AS {name}_q",
        f"min({x}) AS {name}_lo",
        f"max({x}) AS {name}_hi",
    ]


def _absorb(name: str, x: str) -> list[str]:
    """The statistics in a row with one more value (none if it is null)."""
    n, s = f"{name}_n", f"{name}_s"
    return [
        f"{n} + CAST({x} IS NOT NULL AS LONG) AS {n}",
        f"{s} + coalesce({x}, 0D) AS {s}",
        f"{name}_q + coalesce(CASE WHEN {n} > 0 THEN pow({x} - {s} / {n}, 2) * {n} / ({n} + 1) END, 0D) AS {name}_q",
        f"least({name}_lo, {x}) AS {name}_lo",
        f"greatest({name}_hi, {x}) AS {name}_hi",
    ]


def _merge(name: str) -> list[str]:
    """Statistics of the united lists of all runs of a flow."""
    n, s = f"{name}_n", f"{name}_s"
    between = (f"coalesce(sum(CASE WHEN {n} > 0 THEN {s} * {s} / {n} END), 0D) "
               f"- coalesce(try_divide(sum({s}) * sum({s}), CAST(sum({n}) AS DOUBLE)), 0D)")
    return [
        f"sum({n}) AS {n}", f"sum({s}) AS {s}", f"greatest(0D, sum({name}_q) + {between}) AS {name}_q",
        f"min({name}_lo) AS {name}_lo", f"max({name}_hi) AS {name}_hi",
    ]


def _view(out: str, name: str) -> dict[str, str]:
    """Min, max, mean, std and sum of a merged list; `a_`/`b_` lists are picked by direction."""
    n, s, q, lo, hi = (_side(name[4:], p, name[:3]) if name[:4] in ("fwd_", "bwd_") else f"{name}_{p}"
                       for p in ("n", "s", "q", "lo", "hi"))
    return {
        f"{out}_Min": lo, f"{out}_Max": hi, f"{out}_Mean": f"try_divide({s}, CAST({n} AS DOUBLE))",
        f"{out}_Std": f"CASE WHEN {n} > 1 THEN sqrt({q} / {n}) ELSE 0D END", f"{out}_Tot": s,
    }


def _side(name: str, part: str, direction: str) -> str:
    """A column of the forward or backward direction: forward is that of the first packet."""
    column = f"{name}_{part}" if part else name
    a, b = (f"a_{column}", f"b_{column}") if direction == "fwd" else (f"b_{column}", f"a_{column}")
    return f"CASE WHEN _fwd_a THEN {a} ELSE {b} END"


# ---------------------------------------------------------------- flow features

def _exprs(texts: list[str]) -> list[Column]:
    return [F.expr(t) for t in texts]


def _runs(packets: DataFrame, gap: int, width: int, ts: str, seq: str) -> DataFrame:
    """One row of statistics per run of packets inside a slice."""
    rows = _prepared(packets, ts)
    rows = rows.withColumns({f"_{f}": _flag(packets, f) for f in TCP_FLAGS})
    rows = local_runs(rows, KEY, "_us", seq, gap, width, cut="_end")
    order = W.partitionBy(*KEY, "_slice").orderBy("_us", seq)
    side = W.partitionBy(*KEY, "_slice", "_run_ts", "_run_seq", "from_a").orderBy("_us", seq)
    rows = rows.withColumn("_gap", F.expr("_us - _prev"))
    span = F.expr(f"CASE WHEN _gap IS NULL OR _gap > {IDLE_US} THEN _us END")
    rows = rows.withColumn("_span", F.last(span, True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumns({
        "_span_before": F.lag("_span").over(order),
        "_side_prev": F.lag("_us").over(side),
    })
    # pauses: the first one of a run closes an active span that may have begun in an earlier slice
    later = "_gap > {0} AND _span_before <> _run_ts AND _prev > _span_before".format(IDLE_US)
    texts = [
        *_collect("len", "pkt_len"), *_collect("iat", "_gap"),
        *_collect("idle", f"CASE WHEN _gap > {IDLE_US} THEN _gap END"),
        *_collect("act", f"CASE WHEN {later} THEN _prev - _span_before END"),
        f"max(CASE WHEN _gap > {IDLE_US} AND _span_before = _run_ts THEN _prev END) AS _first_span_end",
        f"max(CASE WHEN _gap > {IDLE_US} THEN _us END) AS _last_span",
        "max(CASE WHEN _prev IS NULL THEN from_a END) AS _opens_a",
        *[f"count_if(_{f}) AS {f}_cnt" for f in TCP_FLAGS],
    ]
    for d, mine in (("a", "from_a"), ("b", "NOT from_a")):
        texts += [
            *_collect(f"{d}_len", f"CASE WHEN {mine} THEN pkt_len END"),
            *_collect(f"{d}_iat", f"CASE WHEN {mine} THEN _us - _side_prev END"),
            f"min(CASE WHEN {mine} THEN _us END) AS {d}_first",
            f"max(CASE WHEN {mine} THEN _us END) AS {d}_last",
            f"max(CASE WHEN {mine} AND _side_prev IS NULL THEN win_bytes END) AS {d}_win",
            f"max(CASE WHEN {mine} AND _side_prev IS NULL THEN header_len END) AS {d}_seg",
            f"sum(CASE WHEN {mine} THEN header_len ELSE 0 END) AS {d}_header",
            f"count_if({mine} AND _psh) AS {d}_psh",
            f"count_if({mine} AND _urg) AS {d}_urg",
            f"count_if({mine} AND payload_len > 0) AS {d}_data",
        ]
    return rows.groupBy(*KEY, "_slice", "_run_ts", "_run_seq").agg(*run_bounds("_us", "_end"), *_exprs(texts))


def _linked(runs: DataFrame, gap: int) -> DataFrame:
    """Chains runs to flows and adds what happens at slice borders to the statistics."""
    rows = chain_runs(runs, KEY, gap)
    order = chain_spec(KEY)
    rows = rows.selectExpr(
        "*", "CASE WHEN NOT _starts THEN _run_ts - _prev_last END AS _join_gap",
        f"coalesce(NOT _starts AND _run_ts - _prev_last > {IDLE_US}, false) AS _rest",
    )
    mark = F.expr("coalesce(_last_span, CASE WHEN _starts OR _rest THEN _run_ts END)")
    rows = rows.withColumn("_span_out", F.last(mark, True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    flow = W.partitionBy(*KEY, "_chain", "_start_ts", "_start_seq").orderBy("_run_ts", "_run_seq")
    earlier = flow.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({
        "_span_carry": F.lag("_span_out").over(order),
        "_a_before": F.last("a_last", True).over(earlier),
        "_b_before": F.last("b_last", True).over(earlier),
    })
    # the first packet of a flow counts as a gap of 0 in the whole list and in its own direction
    extra = {
        "idle": "CASE WHEN _rest THEN _join_gap END",
        "act": "CASE WHEN _rest AND _prev_last > _span_carry THEN _prev_last - _span_carry END",
        "iat": "CASE WHEN _starts THEN 0 ELSE _join_gap END",
        "a_iat": "CASE WHEN _starts AND _opens_a THEN 0 ELSE a_first - _a_before END",
        "b_iat": "CASE WHEN _starts AND NOT _opens_a THEN 0 ELSE b_first - _b_before END",
        "span": "_first_span_end - CASE WHEN _starts OR _rest THEN _run_ts ELSE _span_carry END",
    }
    rows = rows.selectExpr("*", *[f"CAST({x} AS DOUBLE) AS _x_{k}" for k, x in extra.items()])
    changed = {"idle", "act", "iat", "a_iat", "b_iat"}

    def others(df: DataFrame, names: set[str]) -> list[str]:
        return [c for c in df.columns if not any(c in (f"{k}_{p}" for p in ("n", "s", "q", "lo", "hi")) for k in names)]

    rows = rows.selectExpr(*others(rows, changed), *[t for k in sorted(changed) for t in _absorb(k, f"_x_{k}")])
    return rows.selectExpr(*others(rows, {"act"}), *_absorb("act", "CASE WHEN _x_span > 0 THEN _x_span END"))


def _feature_texts() -> dict[str, str]:
    """Every network feature as SQL over the merged statistics of a flow."""
    lists = {"Fwd_Pkt_Len": "fwd_len", "Bwd_Pkt_Len": "bwd_len", "Pkt_Len": "len", "Flow_IAT": "iat",
             "Fwd_IAT": "fwd_iat", "Bwd_IAT": "bwd_iat", "Active": "act", "Idle": "idle"}
    f = {k: t for out, name in lists.items() for k, t in _view(out, name).items()}
    seconds = "((_stop - _start_ts) / 1e6D)"

    def per_second(x: str) -> str:
        return f"CASE WHEN _stop > _start_ts THEN ({x}) / {seconds} ELSE 0D END"

    for direction, name in (("fwd", "Fwd"), ("bwd", "Bwd")):
        count, size = _side("len", "n", direction), _side("len", "s", direction)
        f |= {
            f"Tot_{name}_Pkts": count, f"TotLen_{name}_Pkts": size,
            f"Subflow_{name}_Pkts": count, f"Subflow_{name}_Byts": size,
            f"{name}_Pkts_per_s": per_second(count), f"{name}_Seg_Size_Avg": f[f"{name}_Pkt_Len_Mean"],
            f"{name}_PSH_Flags": _side("psh", "", direction), f"{name}_URG_Flags": _side("urg", "", direction),
            f"{name}_Header_Len": _side("header", "", direction), f"Init_{name}_Win_Byts": _side("win", "", direction),
            **{f"{name}_{m}": "0D" for m in ("Byts_per_b_Avg", "Pkts_per_b_Avg", "Blk_Rate_Avg")},
        }
    return f | {
        **{f"{x.upper()}_Flag_Cnt": f"{x}_cnt" for x in TCP_FLAGS}, "CWE_Flag_Count": "cwe_cnt",
        "Dst_Port": "CASE WHEN _fwd_a THEN port_b ELSE port_a END", "Protocol": "protocol",
        "Flow_Duration": "_stop - _start_ts",
        "Flow_Byts_per_s": per_second("len_s"), "Flow_Pkts_per_s": per_second("len_n"),
        "Pkt_Len_Var": "CASE WHEN len_n > 1 THEN len_q / len_n ELSE 0D END", "Pkt_Size_Avg": f["Pkt_Len_Mean"],
        "Down_per_Up_Ratio": f"try_divide(CAST({_side('len', 'n', 'bwd')} AS DOUBLE), {_side('len', 'n', 'fwd')})",
        "Fwd_Act_Data_Pkts": _side("data", "", "fwd"), "Fwd_Seg_Size_Min": _side("seg", "", "fwd"),
    }


def flow_features(packets: DataFrame, timeout: float = FLOW_TIMEOUT_SECONDS, ts: str = "packet_time",
                  seq: str = "seq", slice_seconds: float | None = None) -> DataFrame:
    """One row per flow: the network features, time parts, addresses, and flow bookkeeping
    (`flow_start`, `flow_end`, `flow_seq`, `terminated`, `packet_count`)."""
    gap = _timeout_us(timeout)
    width = round(slice_seconds * 1_000_000) if slice_seconds else 6 * gap
    runs = _linked(_runs(packets, gap, width, ts, seq), gap)
    merged = runs.groupBy(*FLOW).agg(*_exprs([
        "max(_last) AS _stop", "max(_cut) AS terminated", "max(CASE WHEN _starts THEN _opens_a END) AS _fwd_a",
        *[t for name in _LISTS for t in _merge(name)],
        *[f"sum({d}_{c}) AS {d}_{c}" for d in "ab" for c in ("header", "psh", "urg", "data")],
        *[f"min_by({d}_{c}, {d}_first) AS {d}_{c}" for d in "ab" for c in ("win", "seg")],
        *[f"sum({f}_cnt) AS {f}_cnt" for f in TCP_FLAGS],
    ]))
    text = _feature_texts()
    flows = merged.selectExpr(
        *[f"coalesce(CAST({text[c]} AS DOUBLE), 0D) AS {c}" for c in NETWORK_FEATURES],
        "timestamp_micros(_start_ts) AS Timestamp",
        "CASE WHEN _fwd_a THEN ip_a ELSE ip_b END AS Src_IP", "CASE WHEN _fwd_a THEN ip_b ELSE ip_a END AS Dst_IP",
        "CAST(CASE WHEN _fwd_a THEN port_a ELSE port_b END AS DOUBLE) AS Src_Port",
        "timestamp_micros(_start_ts) AS flow_start", "timestamp_micros(_stop) AS flow_end", "_start_seq AS flow_seq",
        "terminated", "len_n AS packet_count",
    )
    rest = [c for c in flows.columns if c not in NETWORK_FEATURES]
    return flow_temporal(flows).select(*NETWORK_FEATURES, *TEMPORAL_FEATURES, *rest)


def flow_temporal(flows: DataFrame, ts: str = "flow_start") -> DataFrame:
    return flows.withColumns({k: c.cast("double") for k, c in V.temporal(ts).items()})


def _idle(flows: DataFrame, as_of, timeout: float) -> Column:
    """Idle longer than the timeout at `as_of`; default: the newest packet of an open flow."""
    if as_of is None:
        newest = flows.where(~F.col("terminated")).agg(F.max(F.unix_micros("flow_end"))).scalar()
    else:
        newest = F.unix_micros(F.lit(as_of).cast("timestamp"))
    return newest - F.unix_micros("flow_end") > F.lit(_timeout_us(timeout))


def expire_flows(flows: DataFrame, as_of=None, timeout: float = FLOW_TIMEOUT_SECONDS) -> DataFrame:
    """Open flows that have been idle longer than the timeout."""
    return flows.where(~F.col("terminated") & _idle(flows, as_of, timeout))


def flush_all(flows: DataFrame) -> DataFrame:
    """End of a bounded input: every flow, finished or not."""
    return flows


def flow_counters(flows: DataFrame, as_of=None, timeout: float = FLOW_TIMEOUT_SECONDS) -> DataFrame:
    """One row: packets, flows created, completed and still active.

    A flow is complete when it was terminated or is idle longer than the timeout at the time
    of the newest packet (or at `as_of`).
    """
    newest = flows.agg(F.max(F.unix_micros("flow_end"))).scalar() if as_of is None else \
        F.unix_micros(F.lit(as_of).cast("timestamp"))
    done = F.col("terminated") | (newest - F.unix_micros("flow_end") > F.lit(_timeout_us(timeout)))
    return flows.select("packet_count", done.alias("done")).agg(
        F.coalesce(F.sum("packet_count"), F.lit(0)).alias("packets"),
        F.count("*").alias("flows_created"),
        F.count_if("done").alias("flows_completed"),
        F.count_if(~F.col("done")).alias("flows_active"),
    )
