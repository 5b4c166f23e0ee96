"""Secret scans with multipart credential linking.

Base kinds, leftmost and non-overlapping each: ``assign``, ``access``, ``hex``. The method adds parts of
credentials that alone are too weak to report: identifiers (``client_id=...``), unnamed secrets (long mixed
strings) and endpoints (hosts in addresses). A text's scopes are all runs of ``SCOPE_LINES`` lines, which overlap,
without a blank line; parts are joined to scopes by position, and weak parts are reported only where a scope
holds complementary ones: an identifier and a secret (with them their endpoints). Base spans count as parts
too and stay as they are.

Cases: null and empty texts have no spans; very long texts are scanned whole, in linear time; equal spans of
different kinds all count; repeated rows are separate rows; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafpress.llm.shared import map_rows, table

#: Kinds in the order of ties; the first three are the base.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
IDENTIFIER = re.compile(
    r"""(?<![A-Za-z0-9_])(?ai:client_?id|access_?key_?id|key_?id|account_?id|user(?:name|_?id)?|login)["']?\x20?[:=]\x20?["']?([A-Za-z0-9@._-]{4,})"""
)
ENDPOINT = re.compile(
    r"(?:https?|s3|jdbc:[a-z]{2,16}|postgres(?:ql)?|mysql|mongodb|redis|amqps?|ftp)://[A-Za-z0-9.-]{3,255}(?::[0-9]{2,5})?|(?<![A-Za-z0-9])(?ai:endpoint|host)\x20?[:=]\x20?[A-Za-z0-9.-]{4,255}"
)
LONG = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
SCOPE_LINES = 12


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, where the value begins)."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text)]
    return out + [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]


def mixed(s: str) -> bool:
    """Whether a long string looks random: letters and digits change often."""
    if not any(c.isdigit() for c in s) or not any(c.isalpha() for c in s) or len(set(s)) < 10:
        return False
    kinds = [c.isdigit() * 2 + c.isupper() for c in s]
    return sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) * 5 >= len(s)


def places(text: str, lines: int = SCOPE_LINES) -> tuple[list[int], list[int]]:
    """Where lines begin, and their numbers; a blank line moves the next ones on by ``lines``, so that no scope spans it."""
    begins, numbers, at, n = [0], [0], 0, 0
    while (nl := text.find("\n", at)) >= 0:
        n += 1 if text[at:nl].strip(" \t\r") else lines
        begins.append(nl + 1)
        numbers.append(n)
        at = nl + 1
    return begins, numbers


def linked_spans(text: str, base: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int, int]]:
    """The weak parts of which some scope holds the complementary ones."""
    marked = ":" in text or "=" in text
    identifiers = [("identifier", m.start(), m.end(), m.start(1)) for m in IDENTIFIER.finditer(text)] if marked else []
    if not identifiers and not any(k == "access" for k, *_ in base):
        return []
    taken = sorted((s, e) for _, s, e, _ in base)
    starts, reach = [s for s, _ in taken], []
    for _, e in taken:
        reach.append(max(e, reach[-1] if reach else 0))

    def free(s: int, e: int) -> bool:
        k = bisect.bisect_left(starts, e)
        return k == 0 or reach[k - 1] <= s

    identifiers = [x for x in identifiers if free(x[1], x[2])]
    named = [(x[1], x[2]) for x in identifiers]  # in order and disjoint
    weak = [("secret", m.start(), m.end(), m.start()) for m in LONG.finditer(text) if mixed(m.group()) and free(m.start(), m.end())]
    weak = [x for x in weak if not (k := bisect.bisect_left(named, (x[2], 0))) or named[k - 1][1] <= x[1]]
    ends = [("endpoint", m.start(), m.end(), m.start()) for m in ENDPOINT.finditer(text)] if marked else []
    ends = [x for x in ends if free(x[1], x[2])]
    begins, numbers = places(text)
    line = lambda x: numbers[bisect.bisect_right(begins, x[1]) - 1]
    have_id = sorted({line(x) for x in identifiers} | {line(x) for x in base if x[0] == "access"})
    have_secret = sorted({line(x) for x in weak} | {line(x) for x in base if x[0] in ("assign", "hex")})

    def among(have: list[int], lo: int, hi: int) -> list[int]:
        return have[bisect.bisect_left(have, lo) : bisect.bisect_right(have, hi)]

    def linked(n: int) -> bool:
        """Whether some scope holds line n, an identifier and a secret."""
        reach = SCOPE_LINES - 1
        return any(among(have_secret, max(n, i) - reach, min(n, i) + reach) for i in among(have_id, n - reach, n + reach))

    return [x for x in (*identifiers, *weak, *ends) if linked(line(x))]


def by_start(spans):
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def digest(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in by_start(spans))


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans (text), n_linked."""

    def run(batches):
        for b in batches:
            rows = []
            for text in (x.as_py() for x in b.column(1)):
                base = base_spans(text or "")
                added = linked_spans(text, base) if text else []
                n = [sum(x[0] == k for x in base) for k in KINDS[:3]]
                rows.append((*n, hashlib.sha256(digest(base).encode()).hexdigest(), digest([*base, *added]), len(added)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"
    )


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with the values of all spans replaced."""
    base = base_spans(text)
    out, at = [], 0
    for _, _, end, value in sorted([*base, *(x for x in linked_spans(text, base) if x[0] != "endpoint")], key=lambda x: x[3]):
        if end <= at:
            continue
        if value >= at:
            out += [text[at:value], mark]
        at = end
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` with secrets replaced in ``text`` (null stays null) and ``n_chars``, if there, renewed.

    Repeated rows are separate rows; an empty table gives an empty result; other columns pass as they are.
    """
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            texts = pa.array((t and redact(t) for t in (x.as_py() for x in b.column(at))), b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at), texts)

    out = map_rows(docs, run)
    return out.withColumn(
        "n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    ) if "n_chars" in docs.columns else out


def op8_secret_scan(spark, sf_dir):
    return find_secrets(table(spark, sf_dir, "documents"))
