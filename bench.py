"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` is the data folder, ``BENCH_CPUS`` the number of cores. Every result row is
computed; rows go to Spark's no-op sink, so that no time is spent on moving them to Python.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from parlance.plans import QUERIES  # noqa: E402
from parlance.plans.analyses import fitted_model, release_models  # noqa: E402
from parlance.session import local_session  # noqa: E402

HEADLINE = [
    "tokens_clean",
    "word_counts",
    "word_cloud",
    "sentiment_by_group_month",
    "group_word_sentiment",
    "sentiment_top_terms",
    "group_words",
    "tfidf",
    "bigram_counts",
    "trigram_counts",
    "message_word_counts",
    "dtm",
    "message_sentiment",
    "emotions_by_group_month",
]
# Timed with a model at hand; "topic_fit" is the fit itself, so a topic query from nothing takes both.
TOPICS = ["topic_top_terms", "topic_assignment"]


def run(query, spark, folder) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE + TOPICS
    run(QUERIES["sentiment_by_group_month"], spark, folder)  # warm-up of JVM and file cache, not counted
    seconds = {name: round(run(QUERIES[name], spark, folder), 3) for name in names if name not in TOPICS}
    if wanted := [name for name in names if name in TOPICS]:
        release_models()
        start = time.perf_counter()
        fitted_model(spark, folder)
        seconds["topic_fit"] = round(time.perf_counter() - start, 3)
        seconds |= {name: round(run(QUERIES[name], spark, folder), 3) for name in wanted}
    result = {
        "metric": "message_text_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(folder).name.removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
