"""Times headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from docsift.session import build_session  # noqa: E402
from docsift.suite import QUERIES  # noqa: E402

HEADLINE = [
    "f6_bm25_search", "f7_bm25_words", "f8_phrase_top", "f11_lexical_no_position", "f2_vector_top",
    "f2_vector_self_top", "f29_cohorts", "f14_weighted_rrf", "f16_hybrid_search", "f22_advanced_search",
    "f27_retrieve", "f28_hierarchical", "c6_word_windows", "c9_sentence_packs", "c13_recursive",
    "c16_semantic", "c17_structural", "c26_chunk_numbering", "h5_file_statistics", "i16_distinct_texts",
    "d1_text_to_markdown", "d16_feature_counts", "f33_author_references", "l6_evaluation",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench")
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
