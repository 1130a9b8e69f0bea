"""spark-submit entry: analyses a folder's documents and writes a row per document as JSON.

    python -m prosa DOCUMENTS OUT [--kind parquet|json|csv|orc|text] [--length N] [--query WORD ...]
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from prosa.plans import analysis
from prosa.sources.documents import documents, write_json


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="prosa")
    parser.add_argument("documents")
    parser.add_argument("out")
    parser.add_argument("--kind", default="parquet")
    parser.add_argument("--length", type=int, default=5)
    parser.add_argument("--query", nargs="*", default=[])
    own = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("prosa").getOrCreate()
    options = analysis.AnalysisOptions(summary_length=own.length, query=tuple(own.query))
    write_json(analysis.report(documents(spark, own.documents, own.kind), options), own.out)


if __name__ == "__main__":
    main()
