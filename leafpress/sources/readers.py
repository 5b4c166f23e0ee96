"""Readers: the registry, and the scan that turns files into artifacts and blocks.

A reader is a function from bytes to (metadata, block dicts) with a spec; ``register`` adds one, and one with a
higher priority goes first. Reading is one ``mapInArrow`` over the files' bytes: each row tries its chain of
readers, so a bad file is a row with an error and never fails the job.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
import re
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafpress import schema, scratch
from leafpress.operators.runtime import FALLBACK, MAX_BYTES
from leafpress.sources import discovery, office, pdf, scan as listing, xls

#: Artifacts that leave a worker at once, and bytes of their files.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20
#: Bytes of files that one task reads, about.
PART_BYTES = 128 << 20
ENCODINGS = ("utf-8-sig", "gb18030", "utf-16", "latin-1")


def decode(data: bytes) -> str:
    """By the first encoding that fits."""
    for name in ENCODINGS:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


def text_lines(data: bytes) -> tuple[str, list[str]]:
    text = re.sub("\r\n?", "\n", decode(data))
    return text, text.split("\n")


def read_text(data: bytes) -> tuple[dict, list[dict]]:
    text, lines = text_lines(data)
    blocks = [{"block_type": "paragraph", "text": t, "line_index": k} for k, line in enumerate(lines) if (t := line.strip())]
    return {"title": None, "content": text.strip(), "line_count": len(lines), "metadata": json.dumps({"line_count": len(lines)})}, blocks


def read_markdown(data: bytes) -> tuple[dict, list[dict]]:
    """The external variant: UTF-8 only, and the line count is that of non-blank lines."""
    lines = re.sub("\r\n?", "\n", data.decode("utf-8-sig")).split("\n")
    blocks = [{"block_type": "paragraph", "text": t, "line_index": k} for k, line in enumerate(lines) if (t := line.strip())]
    return {"title": None, "content": "\n".join(b["text"] for b in blocks), "line_count": len(blocks)}, blocks


@dataclass(frozen=True)
class ReaderSpec:
    provider_id: str
    extensions: tuple[str, ...]
    read: Callable[[bytes], tuple[dict, list[dict]]] = field(compare=False)
    priority: int = 100
    required: tuple[str, ...] = ("filesystem.read",)
    plugin_id: str = ""
    available: bool = True
    reason: str = ""
    #: Permissions that the plugin's manifest declares, of which ``required`` may ask.
    declared: tuple[str, ...] = ()

    @property
    def owner(self) -> str:
        return self.plugin_id or self.provider_id.rpartition(".")[0]


def unavailable(why: str) -> Callable:
    def read(data: bytes):
        raise ValueError(why)

    return read


_READERS: list[ReaderSpec] = []


def defaults() -> list[ReaderSpec]:
    no = {"available": False}
    return [
        ReaderSpec("docx.read", ("docx",), office.read_docx),
        ReaderSpec("xlsx.read", ("xlsx",), office.read_xlsx),
        ReaderSpec("pptx.read", ("pptx",), office.read_pptx),
        ReaderSpec("pdf.read", ("pdf",), pdf.read_pdf),
        ReaderSpec("xls.read", ("xls",), xls.read_xls),
        ReaderSpec("doc.read", ("doc",), unavailable("needs an office program"), required=("filesystem.read", "office.com"), reason="needs an office program", **no),
        ReaderSpec("text.read", ("txt", "md", "csv", "tsv", "rst", "log"), read_text, priority=50),
    ]


def registry() -> list[ReaderSpec]:
    return [*_READERS, *defaults()]


def register(spec: ReaderSpec) -> None:
    """Add a reader; the first of an id stays."""
    if any(s.provider_id == spec.provider_id for s in registry()):
        raise ValueError(f"reader {spec.provider_id!r} exists")
    _READERS.append(spec)


def reset() -> None:
    _READERS.clear()


def chain(extension: str, readers: Iterable[ReaderSpec]) -> list[ReaderSpec]:
    own = [s for s in readers if extension.lower().lstrip(".") in s.extensions and s.available]
    return sorted(own, key=lambda s: (-s.priority, s.provider_id))


def extensions(readers: Iterable[ReaderSpec] | None = None) -> list[str]:
    return sorted({e for s in (registry() if readers is None else readers) for e in s.extensions})


BLOCK_NAMES = [x.strip().split(" ")[0] for x in re.sub(r"<[^>]*>+", "", schema.BLOCKS).split(",")]
_NESTED = ", ".join(x.replace(" ", ":", 1) for x in schema.BLOCKS.split(", ")[1:])
SCAN = (
    "artifact_id string, name string, path string, artifact_type string, title string, content string, line_count int, metadata string, n_blocks int, file_size long, file_sha256 string,"
    f" provider_id string, plugin_id string, fallback_from string, parse_ms double, read_at timestamp, status string, error_type string, error string, blocks array<struct<{_NESTED}>>,"
    " records array<struct<sheet:string,address:string,row:int,col:int,value:string,formula:string>>,"
    " attempts array<struct<provider_id:string,plugin_id:string,status:string,error_type:string,error:string,duration_ms:double,started_at:timestamp,fallback_from:string>>"
)


def refusal(extension: str, readers: Iterable[ReaderSpec]) -> dict:
    """The error of a file that no available reader takes: some other one would, or none."""
    absent = [s for s in readers if extension.lower().lstrip(".") in s.extensions and not s.available]
    out = {"provider_id": None, "fallback_from": None, "status": "error"}
    if absent:
        return {**out, "error_type": "ProviderNotAvailableError", "error": "; ".join(f"{s.provider_id}: {s.reason}" for s in absent)}
    return {**out, "error_type": "CapabilityNotFoundError", "error": "no reader takes this extension"}


def attempt(specs: list[ReaderSpec], granted: frozenset[str], data: bytes, refused: dict | None = None) -> dict:
    """What the chain makes of a file's bytes; ``refused`` is what an empty chain gives. ``attempts`` lists every reader that was asked."""
    out, tried, before = refused or refusal("", ()), [], None

    def note(s: ReaderSpec, began: float, at: dt.datetime, kind: str | None = None, why: str | None = None) -> dict:
        """Adds to the list; the row's own errors come from the last of it."""
        tried.append(
            {
                "provider_id": s.provider_id, "plugin_id": s.owner, "status": "error" if kind else "ok", "error_type": kind, "error": why,
                "duration_ms": round((time.perf_counter() - began) * 1000, 3), "started_at": at, "fallback_from": before
            }
        )
        return {**out, "fallback_from": before, "error_type": kind, "error": why, "attempts": tried}

    for s in specs:
        began, at = time.perf_counter(), dt.datetime.now(dt.UTC)
        missing = sorted(set(s.required) - granted)
        if missing:
            return note(s, began, at, "PluginPermissionError", ", ".join(missing))
        try:
            meta, blocks = s.read(data)
        except office.EncryptedError as e:
            kind, why = "EncryptedArtifactError", str(e)
        except Exception as e:  # a reader's failure is a row
            kind, why = "ArtifactParseError", f"{type(e).__name__}: {e}"
        else:
            done = note(s, began, at)
            about = {"provider_id": s.provider_id, "plugin_id": s.owner, "parse_ms": tried[-1]["duration_ms"], "read_at": dt.datetime.now(dt.UTC)}
            return {**done, **about, "status": "ok", **meta, "blocks": blocks}
        out = note(s, began, at, kind, why)
        before = s.provider_id
        if kind not in FALLBACK:
            break
    return out


def read(
    files: DataFrame, *, readers: list[ReaderSpec] | None = None, granted: Iterable[str] = ("filesystem.read",), max_bytes: int = MAX_BYTES
) -> DataFrame:
    """``files`` (path, content; e.g. of a binaryFile scan) to one row per file with nested blocks and records.

    Files over ``max_bytes``, and those whose content is null, give a row with an error.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema.struct(SCAN))
    specs, allowed = (registry() if readers is None else readers), frozenset(granted)

    def artifact(path: str, content: bytes | None, size: int) -> dict:
        name = path.rpartition("/")[2]
        ext = listing.extension(name)
        if content is None:
            made = too_large(max_bytes)
        else:
            made = attempt(chain(ext, specs), allowed, content, refusal(ext, specs))
        found = made.pop("blocks", [])
        none = dict.fromkeys(BLOCK_NAMES[1:])
        blocks = [{**none, **{k: v for k, v in b.items() if k != "records"}, "seq": k, "block_id": f"b{k:04d}"} for k, b in enumerate(found, 1)]
        records = [
            {**{k: v for k, v in r.items() if k != "value"}, "sheet": b.get("sheet"), "value": json.dumps(r["value"])} for b in found
            for r in b.get("records", [])
        ]
        identity = {"artifact_id": "a_" + hashlib.sha256(path.encode()).hexdigest()[:16], "name": name, "path": path, "artifact_type": ext}
        about = {"file_size": size, "file_sha256": None if content is None else hashlib.sha256(content).hexdigest()}
        return {
            **identity, **about, **made, "title": made.get("title") or name.rpartition(".")[0] or name, "n_blocks": len(blocks),
            "blocks": blocks, "records": records
        }

    def batch_of(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        """The rows as one batch; where a reader's blocks don't fit the schema, each for itself, and those as errors."""
        try:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
        except (pa.ArrowException, TypeError, ValueError, OverflowError) as e:
            if len(rows) > 1:
                for row in rows:
                    yield from batch_of([row])
                return
            keep = {k: rows[0][k] for k in ("artifact_id", "name", "path", "artifact_type", "file_size", "file_sha256")}
            bad = {"status": "error", "error_type": "ProviderExecutionError", "error": f"{type(e).__name__}: {e}"}
            yield pa.RecordBatch.from_pylist([keep | bad | {"n_blocks": 0, "blocks": [], "records": [], "attempts": rows[0].get("attempts")}], schema=arrow)

    def run(batches):
        for batch in batches:
            rows, held = [], 0
            for path, content, size in zip(*batch.columns, strict=True):
                rows.append(artifact(path.as_py(), content.as_py(), size.as_py()))
                held += size.as_py() or 0
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield from batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield from batch_of(rows)

    own = files if "size" in files.columns else files.withColumn("size", F.octet_length("content").cast("long"))
    fits = F.col("size") <= max_bytes
    return own.select("path", F.when(fits, F.col("content")).alias("content"), "size").mapInArrow(run, SCAN)


def read_staged(
    files: DataFrame, *, readers: list[ReaderSpec] | None = None, granted: Iterable[str] = ("filesystem.read",), max_bytes: int = MAX_BYTES
) -> DataFrame:
    """``read`` in stages: all files by their first reader, those that failed by the next one, until none is left.

    ``files`` has path and content, the paths are a key. Each stage is a job of its own over the files that it needs, dealt by reader, so a slow
    reader's files are spread over all tasks, and files that succeed are opened once. A stage's result is written
    before the next begins.
    """
    specs = registry() if readers is None else readers
    own = files if "size" in files.columns else files.withColumn("size", F.octet_length("content").cast("long"))
    todo, parts, before, stage = own, [], None, 0
    longest = max((len(chain(e, specs)) for e in extensions(specs)), default=0)
    while True:
        place = {e: chain(e, specs)[stage : stage + 1] for e in extensions(specs)}
        left = [replace(s, extensions=tuple(e for e, own in place.items() if s in own)) for s in specs]
        # where no reader is left, those that are not there say why there never was one
        now = [s for s in left if s.extensions] + ([s for s in specs if not s.available] if not stage else [])
        order = F.lit("")
        for e, found in place.items():
            order = F.when(F.lower(F.col("path")).endswith(f".{e}"), F.lit(found[0].provider_id if found else "")).otherwise(order)
        dealt = todo.withColumn("_reader", order).repartition("_reader", "path").drop("_reader") if stage else todo
        made = scratch.cut(read(dealt, readers=now, granted=granted, max_bytes=max_bytes))
        if before is not None:
            told = before.select("path", F.col("attempts").alias("_earlier"))
            made = made.join(told, "path").withColumn("attempts", F.concat("_earlier", "attempts"))
            last = F.element_at("_earlier", -1)["provider_id"]
            named = F.transform("attempts", lambda x, i: F.when(i == F.size("_earlier"), x.withField("fallback_from", last)).otherwise(x))
            made = made.withColumns({"fallback_from": last, "attempts": named}).drop("_earlier").select(*before.columns)
        stage += 1
        more = F.coalesce(F.col("error_type").isin(*FALLBACK), F.lit(False)) & (F.size("attempts") > 0) & longer_than(stage, specs)
        before = made.where(more)
        parts.append(made.where(~more))
        if stage >= longest or before.isEmpty():
            break
        todo = own.join(before.select("path"), "path", "left_semi")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def longer_than(n: int, specs: list[ReaderSpec]) -> Column:
    """Whether the chain of an artifact's type has more than ``n`` readers."""
    known = [e for e in extensions(specs) if len(chain(e, specs)) > n]
    return F.col("artifact_type").isin(*known) if known else F.lit(False)


def traces(artifacts: DataFrame) -> DataFrame:
    """A row for each reader that was asked for each artifact, in order: who, how long, and what came of it."""
    each = artifacts.select("artifact_id", "path", F.posexplode("attempts").alias("position", "t"))
    trace_id = F.substring(F.sha2(F.concat_ws(":", "artifact_id", F.col("t.started_at").cast("string"), F.col("position").cast("string")), 256), 1, 16)
    return each.select(trace_id.alias("trace_id"), "artifact_id", "path", F.col("position").alias("position"), "t.*")


def too_large(max_bytes: int) -> dict:
    return {"status": "error", "error_type": "ArtifactTooLargeError", "error": f"over {max_bytes} bytes"}


def claimed(files: DataFrame, readers: Iterable[ReaderSpec] | None) -> DataFrame:
    """Rows of a binaryFile scan that discovery would list, with the extensions that some reader claims."""
    return listing.visible(files.withColumn("name", F.element_at(F.split("path", "/"), -1))).where(F.col("extension").isin(*extensions(readers)))


def scan(spark: SparkSession, root: str, **options) -> DataFrame:
    """Read all files below ``root`` that some reader claims and that are neither hidden nor temporary.

    A root that all executors see is listed by ``discovery.files``, whatever the names; of any other store Spark's own
    source lists the files and passes over names that begin with ``_``. Files over the size limit are not opened.
    """
    if (local := scratch.local_path(root)) is None:
        return within_limit(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root), **options)
    return read_listed(discovery.files(spark, local).where(F.col("extension").isin(*extensions(options.get("readers")))), **options)


def read_listed(files: DataFrame, **options) -> DataFrame:
    """Read the files of a listing (path, size), each where it is dealt: about ``PART_BYTES`` to a task."""
    listed = scratch.cut(files.select("path", F.col("size").alias("length")))
    total = listed.agg(F.sum(F.least("length", F.lit(options.get("max_bytes", MAX_BYTES))))).first()[0] or 0
    # files of one folder lie side by side in the listing, so they are dealt anew
    dealt = listed.repartition(1 + total // PART_BYTES, "path")
    return within_limit(opened(dealt, options.get("max_bytes", MAX_BYTES)), **options)


def scan_paths(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """Read the files of a list of paths, whatever their names, if some reader claims them."""
    if not paths:
        return read(spark.createDataFrame([], "path string, content binary, size long"), **options)
    under = [p for p in paths if any(x.startswith("_") for x in p.split("/"))]
    plain = [p for p in paths if p not in set(under)]
    parts = [spark.read.format("binaryFile").load([escaped(p) for p in plain])] if plain else []
    if under:  # names that Spark's listing passes over are opened where the executors see them
        parts.append(opened(spark.createDataFrame([(p,) for p in under], "path string"), options.get("max_bytes", MAX_BYTES)))
    out = [within_limit(p, **options) for p in parts]
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def escaped(path: str) -> str:
    """A path without the meaning of its wildcards."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def opened(paths: DataFrame, max_bytes: int) -> DataFrame:
    """The shape of a binaryFile scan for files (path) that all executors see; of a file that has gone, content and length are null."""

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                size = data = None
                try:
                    size = os.path.getsize(path)
                    if size <= max_bytes:
                        with open(path, "rb") as f:
                            data = f.read()
                except OSError:
                    size = data = None
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([size], pa.int64()), pa.array([data], pa.binary())], ["path", "length", "content"]
                )

    return paths.select("path").mapInArrow(run, "path string, length long, content binary")


def within_limit(files: DataFrame, max_bytes: int = MAX_BYTES, **options) -> DataFrame:
    """Artifacts of a binaryFile scan; files over the limit are rows with an error and their content column is not read."""
    own = claimed(files, options.get("readers"))
    path = F.regexp_replace("path", "^file:(//)?", "").alias("path")
    fit = own.where(F.col("length") <= max_bytes).select(path, "content", F.col("length").alias("size"))
    own = own.where("length IS NOT NULL")
    large = own.where(F.col("length") > max_bytes).select(path, F.lit(None).cast("binary").alias("content"), F.col("length").alias("size"))
    return read(fit, max_bytes=max_bytes, **options).unionByName(read(large, max_bytes=max_bytes, **options))


def blocks(artifacts: DataFrame) -> DataFrame:
    return artifacts.select("artifact_id", F.inline("blocks"))


def cell_records(artifacts: DataFrame) -> DataFrame:
    """Sparse spreadsheet cells; the value as VARIANT, as one column holds numbers, booleans and text."""
    return artifacts.select("artifact_id", F.inline("records")).withColumn("value", F.parse_json("value"))


def with_priority(spec: ReaderSpec, priority: int) -> ReaderSpec:
    return replace(spec, priority=priority)
