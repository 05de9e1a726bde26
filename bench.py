"""Headline benchmark: prints one JSON line.

Runs the main jobs at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]``.  Each query is executed in full through the ``noop`` sink
(nothing is collected to the driver).  Besides seconds per query it reports the
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from prefspark.operators import knn  # noqa: E402
from prefspark.plans import evaluation as EP  # noqa: E402
from prefspark.plans import flagship  # noqa: E402
from prefspark.plans import ingestion as IP  # noqa: E402
from prefspark.plans import profiles as PP  # noqa: E402
from prefspark.plans import retrieval as RQ  # noqa: E402
from prefspark.session import build_session  # noqa: E402
from prefspark.sources import tables as T  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    spark = build_session(master=f"local[{cpus}]", partitions=int(cpus) * 2, app="prefspark-bench")

    n_reactions = T.table(spark, sf_dir, "events").count()
    n_items = T.table(spark, sf_dir, "embeddings").count()
    n_users = T.table(spark, sf_dir, "events").select("user_id").distinct().count()

    items = T.items(spark, sf_dir)
    self_queries = items.select(F.col("item_id").alias("user_id"), F.col("embedding").alias("query"))

    jobs = {
        "profile_fold": lambda: PP.folded(spark, sf_dir, PP.EVICTING),
        "recommend_all_users": lambda: flagship.recommend_from_fold(spark, sf_dir),
        "knn_self_join_k10": lambda: knn.block_topk(self_queries, items, 10, metric="l2"),
        "knn_unseen_exact": lambda: RQ.q_knn_unseen_exact(spark, sf_dir),
        "sweep_replay_36x2": lambda: EP.q_sweep_replay(spark, sf_dir),
        "embed_corpus": lambda: IP.q_embed_corpus(spark, sf_dir),
        "reward_summary": lambda: EP.q_reward_summary(spark, sf_dir),
    }
    # Untimed warm-up on the smallest tables: JVM JIT and Python worker start-up are
    # paid here rather than by whichever timed query happens to run first.
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        run(PP.folded(spark, warm, PP.EVICTING))
        run(RQ.q_knn_unseen_exact(spark, warm))

    times = {}
    for name, make in jobs.items():
        t0 = time.time()
        run(make())
        times[name] = round(time.time() - t0, 3)

    n_configs = len(EP.SW.param_grid(EP.GRID)) * 2
    out = {
        "metric": "total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf,
        "cpus": int(cpus),
        "throughput": {
            "profile_fold_reactions_per_sec": round(n_reactions / times["profile_fold"], 1),
            "recommend_users_per_sec": round(n_users / times["recommend_all_users"], 1),
            "knn_pairs_per_sec": round(n_items * n_items / times["knn_self_join_k10"], 1),
            "sweep_config_reactions_per_sec": round(n_configs * n_reactions / times["sweep_replay_36x2"], 1),
        },
    }
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
