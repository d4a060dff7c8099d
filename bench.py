"""Headline queries on local[$BENCH_CPUS]; prints one JSON line.

Every query runs to completion into a ``noop`` sink. The session is warmed up with
one small query; each reported time is the best of ``BENCH_REPEATS`` runs.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "runs_events",
    "runs_lineitem",
    "labels_up",
    "boundary_steps",
    "open_vocab",
    "segments_from_probs",
    "segmentation_report",
)
EXTRA = (
    "expand_segments",
    "window_mean",
    "soft_boundaries",
    "f1_counts",
    "edit_score",
    "padded_batches",
    "score_composite",
    "demo_weights",
    "label_changes",
    "clean_text",
)


def shuffle_and_spill(spark) -> tuple[int, int]:
    """Bytes written to shuffles and spilled to disk so far in this application."""
    sc = spark.sparkContext
    quantiles = sc._gateway.new_array(sc._jvm.double, 0)
    empty = sc._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(empty, False, False, quantiles, empty)
    written = spilled = 0
    for i in range(stages.size()):
        stage = stages.apply(i)
        written += stage.shuffleWriteBytes()
        spilled += stage.diskBytesSpilled()
    return written, spilled


def main() -> None:
    from seqseg import build_session
    from seqseg.plans.catalog import all_queries

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    names = sys.argv[1:] or [*HEADLINE, *EXTRA]
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        int(cpus),
        {
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.ui.retainedStages": "100000",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    queries = all_queries()
    queries["argmax_labels"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times, shuffle_mb, spill_mb = {}, {}, {}
    for name in names:
        best = None
        for _ in range(repeats):
            before = shuffle_and_spill(spark)
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
            after = shuffle_and_spill(spark)
        times[name] = round(best, 3)
        shuffle_mb[name], spill_mb[name] = (round((b - a) / 2**20, 2) for a, b in zip(before, after))
    spark.stop()
    headline = [t for n, t in times.items() if n in HEADLINE]
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(headline), 3),
                "unit": "sec",
                "queries": times,
                "shuffle_mb": shuffle_mb,
                "spill_mb": spill_mb,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
