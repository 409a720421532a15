"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the threads.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from segue.registry import QUERIES  # noqa: E402
from segue.session import build_session  # noqa: E402

HEADLINE = [
    "norm_titles",
    "identity_key",
    "search_candidates",
    "score_pairs",
    "link_tracks",
    "transfer_summary",
    "decisions_stale",
    "decisions_merge",
    "album_majority",
    "resolve_albums",
    "guess_albums",
    "playlist_plan",
    "playlist_entries",
    "favorites_plan",
    "chunk_plan",
    "unmatched_report",
    "account_snapshot",
    "wipe_plan",
    "track_union_first_wins",
    "ingest_xml_udtf",
    "ingest_nested_tracks",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    # start the JVM's and the workers' code paths once, outside the clock
    QUERIES["identity_key"](spark, sf).write.format("noop").mode("overwrite").save()
    seconds, rows = {}, {}
    for name in HEADLINE:
        start = time.time()
        rows[name] = QUERIES[name](spark, sf).count() if name == "score_pairs" else None
        if rows[name] is None:
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf.rstrip("/")),
                "scored_pairs": rows["score_pairs"],
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
