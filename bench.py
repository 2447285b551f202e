"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up, then $BENCH_RUNS times (default 1) into a no-op sink; the best
counts.  Pass query names as arguments to time only those, or set BENCH_ALL=1 for all of them.
"""

from __future__ import annotations

import json
import os
import sys
import time

from confab import session
from confab.plans import load


HEADLINE = """
nest_projects flatten_words search_transcripts search_many rank_context select_context transfer_speakers locate_positions
merge_ranges edit_plan_report transcript_stats top_concepts concept_edges chapters segment_scores key_points group_paragraphs
pack_chunks speaker_units subtitle_cues smooth_labels topic_tokens repair_mojibake find_sensitive redact export_srt voice_catalog
top_profiles match_clusters spherical_kmeans estimate_speaker_count robust_centroid profile_centroid job_state
ingest_chunks phrase_segments online_identify
""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    queries, _ = load()
    wanted = sys.argv[1:] or (list(queries) if os.environ.get("BENCH_ALL") else HEADLINE)
    spark = session.build("bench", os.environ.get("BENCH_CPUS", "8"))
    times: dict[str, float] = {}

    def run(fn) -> float:
        start = time.perf_counter()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name, fn in queries.items():
        if name not in wanted:
            continue
        try:
            run(fn)
            times[name] = round(min(run(fn) for _ in range(runs)), 3)
        except Exception as error:  # noqa: BLE001
            print(f"{name}: {error}", file=sys.stderr)
            times[name] = -1.0
    total = round(sum(t for t in times.values() if t > 0), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times,
                      "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
