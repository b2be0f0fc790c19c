"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line with the median of 3 runs after a warm-up."""

from __future__ import annotations

import json
import os
import statistics
import time

os.environ.setdefault("QUILLON_DRIVER_MEMORY", "12g")

from quillon.plans import registry  # noqa: E402
from quillon.session import build_session  # noqa: E402

HEADLINE = [
    "corpus_lines", "extract_macros", "extract_functions", "extract_brace_next_line", "find_exact_ci", "find_substring_ci", "find_token_phrase", "find_regex", "count_substring_ci",
    "stored_find_exact_ci", "stored_find_substring_ci", "stored_find_token_phrase", "stored_find_regex", "stored_count_substring_ci", "stored_page_first", "stored_page_sought", "stored_exact_mode_substring", "stored_exact_mode_regex", "exact_mode_regex", "extract_declarators", "highlight_words", "extract_whole_text", "extract_large_file",
    "page_first", "result_lines", "grep_literal_ci", "grep_word", "grep_regex", "hybrid_fallback", "classify_changed", "apply_changes_files", "apply_changes_symbols", "debounce_sessions", "last_event_wins",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("quillon-bench")
    spark.sparkContext.setLogLevel("ERROR")
    found, took = registry.queries(), {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            start = time.perf_counter()
            found[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(statistics.median(runs[1:]), 4)
    print(json.dumps({"metric": "total of the medians of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
