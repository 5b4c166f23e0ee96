"""``python -m leafpress PATH``: what a folder holds, or a file's summary, its context and answers to questions."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafpress.functions import text as T
from leafpress.operators import answers, blocks, settings
from leafpress.operators import context as C
from leafpress.ship import prepare
from leafpress.workspace import Workspace

# The path, --scan, --no-llm, --show-context and --max-size-mb with its default are the names that users type.
OPTIONS = {
    "--scan": {"action": "store_true", "help": "list the folder and read nothing"},
    "--no-llm": {"action": "store_true", "help": "ask no questions"},
    "--show-context": {"action": "store_true", "help": "print what a model would get"},
    "--max-size-mb": {"type": int, "default": 50, "help": "larger files are not read"},
    "--question": {"action": "append", "default": [], "help": "a question about the file; may be given several times"},
    "--questions": {"type": Path, "help": "a file with a question a line"},
}


def listing(refs: DataFrame) -> Iterator[str]:
    """A line a file, sizes and types in columns, and the totals by type."""
    totals = refs.groupBy("artifact_type").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).orderBy("artifact_type")
    for r in totals.select("artifact_type", "n", T.card_size_label(F.col("size")).alias("size")).collect():
        yield f"{r['artifact_type']}: {r['n']}, {r['size']}"
    line = F.concat(F.lpad(T.card_size_label(F.col("size")), 12, " "), F.lit("  "), F.rpad("artifact_type", 5, " "), F.lit(" "), "relative_path")
    for r in refs.orderBy("path").select(line.alias("line")).toLocalIterator():
        yield r["line"]


def reading(ws: Workspace, name: str, args: argparse.Namespace) -> Iterator[str]:
    """What is said about one file; a LookupError if it can't be read."""
    got = ws.read(name, max_bytes=args.max_size_mb << 20).cache()
    row = got.select("status", "error_type", "error").first()
    if row is None:
        raise LookupError(f"UnsupportedArtifactTypeError: {args.path}")
    if row["status"] != "ok":
        raise LookupError(f"{row['error_type']}: {row['error']}")
    about = {"types": F.transform("blocks", lambda b: b["block_type"]), "page_count": F.get_json_object("metadata", "$.page_count")}
    yield blocks.summary(got.withColumns(about)).first()["summary"]
    contexts = ws.contexts(C.Policy(), got)
    if args.show_context:
        yield contexts.first()["context"]
    asked = [*args.question, *(args.questions.read_text(encoding="utf-8").splitlines() if args.questions else ())]
    if args.no_llm:
        return
    resolved = settings.resolve(settings.load_config(settings.config_path())[0])
    model, status = answers.client(resolved, settings.secret(resolved))
    if model is None:
        yield f"language model: {status}"
        return
    for question in filter(None, map(str.strip, asked)):
        reply = answers.ask(contexts, question, model).first()
        yield f"{question}\n{reply['answer'] if reply['error'] is None else reply['error']}"


def main(argv: list[str] | None = None, *, spark: SparkSession | None = None, say: Callable[[str], None] = print) -> int:
    parser = argparse.ArgumentParser(prog="leafpress", description=__doc__)
    parser.add_argument("path", help="a file to read, or a folder to list")
    for name, about in OPTIONS.items():
        parser.add_argument(name, **about)
    args = parser.parse_args(argv)
    spark = prepare(spark or SparkSession.builder.appName("leafpress").getOrCreate())
    whole = args.scan or os.path.isdir(args.path)
    try:
        ws = Workspace(spark, args.path if whole else os.path.dirname(os.path.abspath(args.path)))
        if not whole and not os.path.isfile(args.path):
            raise LookupError(f"ArtifactNotFoundError: {args.path}")
        for line in listing(ws.refs()) if whole else reading(ws, os.path.basename(args.path), args):
            say(line)
    except (OSError, LookupError) as e:
        say(f"error: {e if isinstance(e, LookupError) else f'{type(e).__name__}: {e}'}")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
