"""State of one open flow in a stream: the same statistics as the batch job, kept incrementally."""

from __future__ import annotations

import json
import math

from packetloom.schemas import TCP_FLAGS

IDLE_US = 1_000_000


class Stat:
    """Count, mean, squared deviations, minimum and maximum of a growing list."""

    def __init__(self, n=0, mean=0.0, q=0.0, lo=0.0, hi=0.0):
        self.n, self.mean, self.q, self.lo, self.hi = n, mean, q, lo, hi

    def add(self, x: float) -> None:
        self.lo = x if self.n == 0 else min(self.lo, x)
        self.hi = x if self.n == 0 else max(self.hi, x)
        self.n += 1
        step = x - self.mean
        self.mean += step / self.n
        self.q += step * (x - self.mean)

    @property
    def total(self) -> float:
        return self.mean * self.n

    @property
    def std(self) -> float:
        return math.sqrt(self.q / self.n) if self.n > 1 else 0.0

    def as_list(self) -> list:
        return [self.n, self.mean, self.q, self.lo, self.hi]


_STATS = ("len", "fwd_len", "bwd_len", "iat", "fwd_iat", "bwd_iat", "active", "idle")


class OpenFlow:
    def __init__(self, saved: str):
        self.__dict__.update(json.loads(saved))
        self.stats = {k: Stat(*v) for k, v in self.stats.items()}

    @classmethod
    def start(cls, p: dict) -> "OpenFlow":
        flow = cls.__new__(cls)
        t = p["us"]
        flow.src, flow.dst, flow.sport, flow.dport = p["src_ip"], p["dst_ip"], p["src_port"], p["dst_port"]
        flow.protocol, flow.seq, flow.begin, flow.last, flow.active_from = p["protocol"], p["seq"], t, t, t
        flow.side_last = [t, None]  # forward, backward
        flow.counts = {f"{d}_{c}": 0 for d in ("fwd", "bwd") for c in ("header", "psh", "urg", "data", "win", "seg")}
        flow.flags = dict.fromkeys(TCP_FLAGS, 0)
        flow.stats = {k: Stat() for k in _STATS}
        flow.ended = False
        flow.add(p)
        return flow

    def add(self, p: dict) -> None:
        t, s, c = p["us"], self.stats, self.counts
        gap = t - self.last
        if gap >= 0:
            s["iat"].add(gap)
            if gap > IDLE_US:
                s["idle"].add(gap)
                if self.last > self.active_from:
                    s["active"].add(self.last - self.active_from)
                self.active_from = t
        self.last = t
        forward = p["src_ip"] == self.src and p["src_port"] == self.sport
        side, name = (0, "fwd") if forward else (1, "bwd")
        if s[f"{name}_len"].n == 0:
            c[f"{name}_win"], c[f"{name}_seg"] = p["win_bytes"], p["header_len"]
        for key in ("len", f"{name}_len"):
            s[key].add(float(p["pkt_len"]))
        c[f"{name}_header"] += p["header_len"]
        c[f"{name}_psh"] += bool(p["psh"])
        c[f"{name}_urg"] += bool(p["urg"])
        c[f"{name}_data"] += p["payload_len"] > 0
        for f in TCP_FLAGS:
            self.flags[f] += bool(p[f])
        if self.side_last[side] is not None and t >= self.side_last[side]:
            s[f"{name}_iat"].add(t - self.side_last[side])
        self.side_last[side] = t
        self.ended = bool(p["fin"] or p["rst"])

    def dump(self) -> str:
        return json.dumps(self.__dict__ | {"stats": {k: v.as_list() for k, v in self.stats.items()}})

    def record(self) -> dict:
        """Feature columns of the finished flow, apart from the time parts."""
        s, c = self.stats, self.counts
        us = max(0, self.last - self.begin)
        sec = us / 1e6

        def rate(x: float) -> float:
            return x / sec if sec > 0 else 0.0

        row = {}
        for name, key in (("Fwd_Pkt_Len", "fwd_len"), ("Bwd_Pkt_Len", "bwd_len"), ("Pkt_Len", "len"),
                          ("Flow_IAT", "iat"), ("Fwd_IAT", "fwd_iat"), ("Bwd_IAT", "bwd_iat"),
                          ("Active", "active"), ("Idle", "idle")):
            x = s[key]
            row |= {f"{name}_Min": x.lo, f"{name}_Max": x.hi, f"{name}_Mean": x.mean, f"{name}_Std": x.std,
                    f"{name}_Tot": x.total}
        n_fwd, n_bwd = s["fwd_len"].n, s["bwd_len"].n
        for d, name, n in (("Fwd", "fwd", n_fwd), ("Bwd", "bwd", n_bwd)):
            size = s[f"{name}_len"].total
            row |= {
                f"Tot_{d}_Pkts": n, f"TotLen_{d}_Pkts": size, f"{d}_PSH_Flags": c[f"{name}_psh"],
                f"{d}_URG_Flags": c[f"{name}_urg"], f"{d}_Header_Len": c[f"{name}_header"],
                f"{d}_Pkts_per_s": rate(n), f"{d}_Seg_Size_Avg": s[f"{name}_len"].mean,
                f"Subflow_{d}_Pkts": n, f"Subflow_{d}_Byts": size, f"Init_{d}_Win_Byts": c[f"{name}_win"],
                f"{d}_Byts_per_b_Avg": 0.0, f"{d}_Pkts_per_b_Avg": 0.0, f"{d}_Blk_Rate_Avg": 0.0,
            }
        row |= {f"{f.upper()}_Flag_Cnt": n for f, n in self.flags.items() if f != "cwe"}
        return row | {
            "CWE_Flag_Count": self.flags["cwe"], "Dst_Port": self.dport, "Protocol": self.protocol,
            "Flow_Duration": us, "Flow_Byts_per_s": rate(s["len"].total), "Flow_Pkts_per_s": rate(s["len"].n),
            "Pkt_Len_Var": s["len"].std ** 2, "Down_per_Up_Ratio": n_bwd / n_fwd if n_fwd else 0.0,
            "Pkt_Size_Avg": s["len"].mean, "Fwd_Act_Data_Pkts": c["fwd_data"], "Fwd_Seg_Size_Min": c["fwd_seg"],
            "Src_IP": self.src, "Dst_IP": self.dst, "Src_Port": float(self.sport), "flow_seq": self.seq,
            "terminated": self.ended, "packet_count": s["len"].n, "start_us": self.begin, "end_us": self.last,
        }
