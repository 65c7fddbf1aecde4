"""Seconds per headline operator on the provided tables; prints one JSON line.

Each query is run once to warm up, then timed (median of BENCH_RUNS runs, default 3). Every
result row is produced (no-op sink). Training is timed apart from scoring. Shuffle bytes written and tasks are those of the
last run of a query.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from packetloom import catalog  # noqa: E402
from packetloom.operators import flows as FL, incidents as I, models as M, rules as D  # noqa: E402
from packetloom.session import build_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("OFF")
    t = catalog.Inputs(spark, SF_DIR)

    def registered(name):
        return lambda: catalog.QUERIES[name](spark, SF_DIR)

    started = time.perf_counter()
    detector, classifier = catalog.trained(t)
    training = time.perf_counter() - started
    plans = {name: registered(name) for name in (
        "attack_overview", "traffic_characteristics", "executive_summary", "soc_summary", "top_entities", "model_monitor",
        "threshold_sweep", "alert_ids", "match_indicators", "stratified_sample",
    )}
    plans |= {
        "flow_features": lambda: FL.flow_features(t.packets, 10_800),
        "assign_flows": lambda: FL.assign_flows(t.packets, 10_800),
        "evaluate_rules": lambda: D.evaluate_rules(t.alerts, t.indicators, {"correlation_window_seconds": 86_400}),
        "correlate": lambda: I.build_incidents(I.correlate(t.alerts, 21_600, strict=False)),
        "score_two_stage": lambda: M.score_two_stage(catalog.model_rows(t), detector, classifier, partitions=int(CPUS)),
    }
    def spent() -> tuple[int, int]:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        one = spark.sparkContext._jsc.sc().statusStore().executorList(False).head()
        return one.totalShuffleWrite(), one.totalTasks()

    seconds, shuffled, tasks = {}, {}, {}
    for name, plan in plans.items():
        times = []
        for _ in range(RUNS + 1):
            before, started = spent(), time.perf_counter()
            plan().write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
        shuffled[name], tasks[name] = (b - a for a, b in zip(before, spent()))
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    rows = t.lineitem.count()
    print(json.dumps({
        "metric": "total seconds of the headline queries, warm, median",
        "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")),
        "training_sec": round(training, 3), "scored_flows": rows,
        "scored_flows_per_sec": round(rows / seconds["score_two_stage"], 1), "shuffle_bytes": shuffled, "tasks": tasks,
        "forests": {k: {"trees": m["numTrees"], "depth": m["maxDepth"], "features": len(catalog._MODEL_FEATURES)}
                    for k, m in (("detector", M.DETECTOR), ("classifier", M.CLASSIFIER))},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
