"""Benchmark: every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

The cleaning stages run from the raw tables once and ``sales_enriched``
is written as parquet partitioned by month (the design's persist point);
every other query then reads that table.  Each query is executed fully
(``noop`` sink) and timed, including its planning-time size checks
(``queries``, cold), then once more (``queries_warm``).  ``value`` is the
cold total.  ``shuffle_write_mb`` is the shuffle volume of each cold query,
read from the Spark event log written to the run's scratch folder.  Prints
one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

CLEANING = ["sales_flagged", "rev_thresholds", "sales_cleaned", "sales_dedup"]


def io_per_query(event_dir: str) -> dict[str, tuple[float, float]]:
    """Shuffle MB written (and input MB read) per job group, from the event log."""
    try:
        stage_group: dict[int, str] = {}
        shuffle: dict[str, float] = {}
        read: dict[str, float] = {}
        paths = [os.path.join(r, f) for r, _, fs in os.walk(event_dir) for f in fs
                 if not f.startswith(".")]
        for path in paths:
            with open(path) as fh:
                for line in fh:
                    ev = json.loads(line)
                    kind = ev.get("Event")
                    if kind == "SparkListenerJobStart":
                        group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                        for sid in ev.get("Stage IDs", []):
                            stage_group[sid] = group
                    elif kind == "SparkListenerTaskEnd":
                        g = stage_group.get(ev.get("Stage ID"))
                        m = ev.get("Task Metrics") or {}
                        if g is None:
                            continue
                        w = (m.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
                        r = (m.get("Input Metrics") or {}).get("Bytes Read", 0)
                        shuffle[g] = shuffle.get(g, 0) + w
                        read[g] = read.get(g, 0) + r
        return {g: (round(shuffle.get(g, 0) / 2**20, 2), round(read.get(g, 0) / 2**20, 2))
                for g in set(shuffle) | set(read)}
    except (OSError, ValueError):
        return {}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from shopgauge.session import local_session
    from shopgauge.plans import bundles, catalog  # noqa: F401  (register queries)
    from shopgauge.plans.registry import QUERIES
    from shopgauge.plans.stages import RetailModel

    n = int(cpus) if cpus.isdigit() else os.cpu_count() or 8
    event_dir = tempfile.mkdtemp(prefix="bench-events-", dir="/tmp")
    spark = local_session(cores=cpus, shuffle_partitions=max(8, 2 * n),
                          extra_conf={"spark.eventLog.enabled": "true",
                                      "spark.eventLog.dir": event_dir,
                                      "spark.eventLog.compress": "false",
                                      "spark.eventLog.rolling.enabled": "false"})
    sc = spark.sparkContext

    errors: dict[str, str] = {}

    def run(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    def timed(name: str, build) -> float | None:
        sc.setJobGroup(name, name)
        t0 = time.time()
        try:
            run(build())
        except Exception as e:  # noqa: BLE001  (recorded, the run goes on)
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
            return None
        return round(time.time() - t0, 3)

    # warm the JVM (class loading, codegen caches) on the smallest table
    run(spark.read.parquet(f"{sf_dir}/region.parquet"))

    times: dict[str, float] = {}
    raw = RetailModel.from_testdata(spark, sf_dir)
    for name in CLEANING:
        times[name] = timed(name, lambda: QUERIES[name](raw))

    model = RetailModel.from_testdata(spark, sf_dir)
    model.share_intermediates = True  # persist reused store-level intermediates
    times["materialize_sales_enriched"] = timed("materialize_sales_enriched",
                                                lambda: model.materialize().limit(0))

    for name, fn in QUERIES.items():
        if name in CLEANING:
            continue
        times[name] = timed(name, lambda: fn(model))

    # warm: the same queries again (plans, size checks and shared intermediates exist)
    warm: dict[str, float] = {}
    for name, fn in QUERIES.items():
        if name in CLEANING:
            continue
        warm[name] = timed(name + " (warm)", lambda: fn(model))

    sc.setJobGroup("done", "done")
    volumes = io_per_query(event_dir)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "total_seconds_all_queries",
        "value": round(sum(v for v in times.values() if v is not None), 3),
        "unit": "sec",
        "queries": times,
        "queries_warm": warm,
        "warm_total": round(sum(v for v in warm.values() if v is not None), 3),
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": cpus,
        "queries_run": len(times),
        "errors": errors,
        "shuffle_write_mb": {k: v[0] for k, v in volumes.items() if k in times},
    }))


if __name__ == "__main__":
    main()
