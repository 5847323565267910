"""Time the headline queries; prints one JSON line.

``shard_stats`` and the training queries build everything from the raw tables.
The others start from the staged table their operator takes in production
(cleaned text, encoded records, shards, run log), which is built before the
clock starts. ``from_raw`` times some of these again with everything built from
the raw tables. Every query is run to its end without collecting its rows.
Documents are dealt to all cores first, as the test tables are one file.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quern.plans import queries as registry  # noqa: E402
from quern.session import local_session  # noqa: E402

HEADLINE = [
    "shard_stats",
    "clean_text",
    "read_lines",
    "split_fraction",
    "shuffle_docs",
    "pretokenize",
    "word_counts",
    "pair_counts",
    "train_vocab",
    "encode_wordpiece",
    "encode_bpe",
    "decode_ids",
    "token_offsets",
    "pack_shards",
    "flat_stream",
    "line_stream",
    "lm_sequences",
    "rank_batches",
    "step_loss",
    "interval_loss",
    "cross_entropy",
    "softmax_rows",
    "decode_filter",
    "sample_token",
    "stream_clean",
]
FROM_RAW = {"shard_stats", "train_vocab"}
AGAIN_FROM_RAW = ["clean_text", "word_counts", "pack_shards", "flat_stream", "rank_batches"]


def run_raw(query, spark, sf) -> float:
    """With nothing staged before; what other queries staged is there again afterwards."""
    kept = dict(registry._staged)
    registry.forget_staged()
    try:
        return run(query, spark, sf)
    finally:
        registry._staged.update(kept)


def run(query, spark, sf) -> float:
    start = time.time()
    query(spark, sf).write.format("noop").mode("overwrite").save()
    return round(time.time() - start, 3)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("OFF")
    every = registry.all_queries()
    registry.SPREAD = spark.sparkContext.defaultParallelism
    warm = os.path.join(os.path.dirname(sf), "sf0.001")
    if os.path.isdir(warm):
        registry.flagship(spark, warm).count()
    for prepare in (registry._piece_vocab, registry._byte_vocab, registry._shards, registry._run_log):
        prepare(spark, sf)
    times = {}
    for name in HEADLINE:
        times[name] = (run_raw if name in FROM_RAW else run)(every[name], spark, sf)
    raw = {name: run_raw(every[name], spark, sf) for name in AGAIN_FROM_RAW}
    total = round(sum(times.values()), 3)
    scale = os.path.basename(sf).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "from_raw": raw, "sf": scale}))


if __name__ == "__main__":
    main()
