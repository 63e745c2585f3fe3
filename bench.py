"""Times the headline queries on a local session and prints one JSON line.

Besides, ``single`` has the seconds of one question (hybrid search with reranking over the stored
index), and of a job that does nothing: the session's fixed cost, of which a question has several.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3).
Every query is run once to warm up, then BENCH_RUNS times; its figure is the median wall-clock
time to compute all its rows.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from codelore.operators import retrieval
from codelore.plans import registry, searches
from codelore.session import local_session

HEADLINE = (
    "bm25_topk", "retrieval_eval", "knn_l2", "hybrid_fuse", "rerank_topk", "chunk_windows", "tokenize_stop", "content_hash", "incremental_diff",
    "timeline_buckets", "commit_timeline", "first_seen", "churn_counts", "changes_between", "module_rollup", "snapshot_at", "degree", "fanout_cap",
    "call_merge", "module_depends", "flow_layers", "neighborhood_hops", "label_propagation", "last_turns", "external_uses",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session("bench", cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    queries, _ = registry.collect(registry.MODULES)
    times: dict[str, float] = {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - began)
        times[name] = round(statistics.median(taken[1:]), 4)
    def median_of(run) -> float:
        taken = []
        for _ in range(2 * runs + 1):
            began = time.perf_counter()
            run().write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - began)
        return round(statistics.median(taken[1:]), 4)

    index, vectors, chunks = searches.index(spark, sf_dir), searches.table(spark, sf_dir, "embeddings"), searches.chunks(spark, sf_dir)
    first = searches.questions(spark, sf_dir).orderBy("query").limit(1)
    one = spark.createDataFrame(first.collect(), first.schema)
    single = {
        "question": median_of(lambda: retrieval.search(index, vectors, chunks, one, 5)),
        "keywords": median_of(lambda: retrieval.bm25(index, one.select("query", "text"))),
        "nothing": median_of(lambda: spark.range(8).repartition(8).groupBy("id").count()),
    }
    print(json.dumps({"metric": "headline queries, sum of median seconds", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "single": single, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
