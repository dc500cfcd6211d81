"""Command line: python -m quarry version | settings | check | index | query | chat | benchmark."""

from __future__ import annotations

import argparse
import importlib.util
import json
import sys

from quarry import __version__
from quarry.sources import settings


def _spark(name: str):
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName(name).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _qa(index: str | None = None):
    from quarry.plans import solutions

    qa = solutions.DocumentQA(_spark("quarry"))
    if index:
        qa.load_index(index)
    return qa


def _index(given) -> None:
    qa = _qa()
    qa.add_documents(given.paths)
    qa.save_index(given.out)


def _query(given) -> None:
    print(_qa(given.index).ask(given.question))


def _chat(given) -> None:
    qa = _qa(given.index)
    for line in sys.stdin:
        if line.strip():
            print(qa.ask(line.strip()), flush=True)


def _benchmark(given) -> None:
    """Ranking, answers and latency of the questions in a file of question, answer and relevant_docs (chunk ids)."""
    from quarry.plans import benchmark, rag
    from quarry.sources import records

    qa = _qa(given.index)
    qa.settings.k = max(given.k)
    items = records.read(qa.spark, given.path, records.EVALUATION)
    found = benchmark.run(items, lambda q: rag.basic(qa.chunks, q, qa.settings, citations=False), given.k, given.timed, given.out)
    for row in found.collect():
        print(json.dumps(row.asDict()))


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quarry")
    commands = parser.add_subparsers(dest="command", required=True)
    add = lambda name, run: (c := commands.add_parser(name), c.set_defaults(run=run))[0]
    add("version", lambda _: print(__version__))
    add("settings", lambda _: print(json.dumps(settings.get().as_dict(), indent=2)))
    add("check", lambda _: print("\n".join(f"{m}: {'there' if importlib.util.find_spec(m) else 'missing'}" for m in ("pyspark", "pyarrow", "numpy", "pandas", "yaml", "pypdf", "pdfplumber"))))
    index = add("index", _index)
    index.add_argument("paths", nargs="+")
    index.add_argument("--out", required=True)
    query = add("query", _query)
    query.add_argument("question")
    query.add_argument("--index", required=True)
    add("chat", _chat).add_argument("--index", required=True)
    bench = add("benchmark", _benchmark)
    bench.add_argument("path")
    bench.add_argument("--index", required=True)
    bench.add_argument("--timed", type=int, default=0)
    bench.add_argument("--out")
    bench.add_argument("-k", type=int, nargs="+", default=[1, 3, 5, 10])
    given = parser.parse_args(args)
    given.run(given)


if __name__ == "__main__":
    main()
