"""Personal data: base patterns, and a semi-Markov conditional random field over whole candidate segments.

Base kinds, leftmost and non-overlapping each: email, ip, card, phone; they are found in linear time (runs
of characters first, then their parts) and always stay. The field scores segments as wholes (digit counts,
groups, separators, checksum, words before), with O for single tokens outside; the Viterbi search over
segments of at most ``MAX_TOKENS`` tokens and ``MAX_CHARS`` characters chooses boundaries and kinds jointly. Its
weights are trained here by conditional likelihood on ``TRAINING`` generated sentences (fixed seed), once a
process; text of the corpus is never fitted. A segment needs a hint (``HINT``) within ``MAX_CHARS`` of its start,
so all segments lie in stretches that reach ``MAX_CHARS`` to both sides of the hints. The search runs over these
with the context of the whole text, and gives the best labelling of the whole text: all other tokens are O.

Decoded segments that overlap no base span are added to ``spans``. Cases: null and empty texts have no
spans; long texts are scanned whole; repeated rows are separate rows; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import math
import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from leafpress.llm.shared import prepare, table

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 24
MAX_CHARS = 80
TRAINING = 600

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def emails(text: str):
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        # every start in the run leads to this "@": it matches from the first, or from none
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            floor = m.end()
        else:
            floor = at + 1
        at = text.find("@", floor)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", s, e) for s, e in emails(text)]
    for m in DOTTED.finditer(text):
        if m.group().count(".") >= 3:
            parts, at = m.group().split("."), m.start()
            for k in range(0, len(parts) - 3, 4):  # four parts at a time, leftmost first
                four = parts[k : k + 4]
                end = at + sum(map(len, four)) + 3
                if all(map(octet, four)):
                    out.append(("ip", at, end))
                at = end + 1
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


# --- the field

TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|[^\sA-Za-z0-9]")
HINT = re.compile(r"[0-9]|@|[(\[] ?at ?[)\]]| at [A-Za-z0-9.-]{1,40} dot | at [A-Za-z0-9-]+(?:\.| ?[(\[] ?dot ?[)\]] ?| dot )[A-Za-z0-9-]", re.I)
OPENERS = frozenset("+([")
WORDS = {
    "phone": "phone", "tel": "phone", "call": "phone", "mobile": "phone", "fax": "phone", "mail": "email", "email": "email",
    "contact": "email", "card": "card", "visa": "card", "ip": "ip", "address": "ip", "host": "ip"
}
SPELLED = re.compile(r"[A-Za-z0-9._%+-]+(?: ?[(\[] ?at ?[)\]] ?| at |@)[A-Za-z0-9-]+(?:(?:\.| ?[(\[] ?dot ?[)\]] ?| dot )[A-Za-z0-9-]+)+", re.I)
TLD = frozenset("com org net edu gov io de fr uk es info".split())


def gates(segment: str, before: str, after: str) -> list[str]:
    """The kinds that a segment may have."""
    first, last = segment[0], segment[-1]
    if (before[-1:].isalnum() and first.isalnum()) or (after[:1].isalnum() and last.isalnum()):
        return []
    out = []
    if first.isalnum() and last.isalnum() and SPELLED.fullmatch(segment):
        out.append("email")
    if not any(c.isalpha() or c == "@" for c in segment):
        digits = sum(c.isdigit() for c in segment)
        if (first.isdigit() or first in "+(") and last.isdigit() and "\n" not in segment:
            if 7 <= digits <= 15:
                out.append("phone")
            if 14 <= digits <= 19 and first.isdigit():
                out.append("card")
            if first.isdigit() and segment.count(".") == 3 and digits <= 12 and re.fullmatch(r"[0-9]{1,3}(?: ?\. ?[0-9]{1,3}){3}", segment):
                out.append("ip")
    return out


def features(kind: str, segment: str, before: str, after: str) -> list[str]:
    groups = re.findall(r"[0-9]+", segment)
    digits = "".join(groups)
    seps = set(re.sub(r"[A-Za-z0-9]", "", segment))
    shape = "-".join(str(len(g)) for g in groups) if len(groups) <= 6 else "many"
    out = [
        f"{kind}|bias", f"{kind}|seps={''.join(sorted(seps))[:4]}",
        f"{kind}|after={'mark' if after[:1] in '%/°$€:' and after else 'other'}",
        f"{kind}|before={'mark' if before[-1:] in '.,:/#$€v-_' and before else 'other'}"
    ]
    hint = next((WORDS[w] for w in reversed(re.findall(r"[a-z]+", before[-16:].lower())) if w in WORDS), "none")
    out.append(f"{kind}|hint={'own' if hint == kind else 'none' if hint == 'none' else 'other'}")
    if kind == "email":
        host = re.split(r"[^A-Za-z0-9]+", segment)[-1].lower()
        out += [f"email|tld={host in TLD}", f"email|spelled={'@' not in segment}", f"email|bracket={'(' in segment or '[' in segment}"]
    else:
        out += [f"{kind}|n={len(digits)}", f"{kind}|shape={shape}", f"{kind}|groups={min(len(groups), 6)}"]
    if kind == "card":
        out += [f"card|luhn={luhn(digits)}", f"card|fours={all(len(g) == 4 for g in groups[:-1])}"]
    if kind == "ip":
        out.append(f"ip|octets={all(map(octet, groups))}")
    if kind == "phone":
        out += [
            f"phone|plus={segment[0] == '+'}", f"phone|paren={'(' in segment and ')' in segment}",
            f"phone|year={len(groups) > 1 and len(groups[0]) == 4 and groups[0][:2] in ('19', '20')}", f"phone|single={len(groups) == 1}"
        ]
    return out


Arcs = list[tuple[int, int, str, list[str]]]


def lattice(text: str, lo: int = 0, hi: int | None = None, hints: list[int] | None = None) -> tuple[list[int], Arcs]:
    """Token bounds of ``text[lo:hi]``, and its candidate segments (first token, end token, kind, features).

    Context comes from the whole text, so a stretch may begin or end inside a token: no segment does.
    """
    hi = len(text) if hi is None else hi
    hints = [m.start() for m in HINT.finditer(text)] if hints is None else hints
    bounds = [lo, *(m.end() for m in TOKEN.finditer(text, lo, hi))]
    out, n = [], len(bounds) - 1
    for i in range(n):
        a = bounds[i]
        if text[a].isspace() or not (text[a].isalnum() or text[a] in OPENERS):
            continue
        k = bisect.bisect_left(hints, a)
        if k == len(hints) or hints[k] > a + MAX_CHARS:
            continue
        if text[a].isalpha() and not SPELLED.match(text, a, min(len(text), a + MAX_CHARS)):
            continue
        for j in range(i + 1, min(n, i + MAX_TOKENS) + 1):
            b = bounds[j]
            if b - a > MAX_CHARS:
                break
            if not text[b - 1].isalnum():
                continue
            if text[a].isdigit() and text[b - 1].isalpha() and "@" not in text[a:b] and "at" not in text[a:b].lower():
                continue
            segment, before, after = text[a:b], text[max(0, a - 20) : a], text[b : b + 2]
            for kind in gates(segment, before, after):
                out.append((i, j, kind, features(kind, segment, before, after)))
    return bounds, out


def logadd(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if b > -700 + a else a


def viterbi(text: str, weights: dict[str, float], lo: int = 0, hi: int | None = None, hints: list[int] | None = None) -> list[tuple[str, int, int]]:
    """The entities of the best segmentation of ``text[lo:hi]``, as (kind, start, end) in ``text``."""
    bounds, arcs = lattice(text, lo, hi, hints)
    if not arcs:
        return []
    by_end: dict[int, list] = {}
    for i, j, kind, names in arcs:
        by_end.setdefault(j, []).append((i, kind, sum(weights.get(f, 0.0) for f in names)))
    best, back = [0.0], [None]
    for j in range(1, len(bounds)):
        score, how = best[j - 1], None
        for i, kind, s in by_end.get(j, ()):
            if best[i] + s > score:
                score, how = best[i] + s, (i, kind)
        best.append(score)
        back.append(how)
    out, j = [], len(bounds) - 1
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            i, kind = back[j]
            out.append((kind, bounds[i], bounds[j]))
            j = i
    return out[::-1]


def sentence(rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A generated training sentence with its entities."""
    letters = "etaoinshrdlu"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def email():
        at, dot = rng.choice([("@", "."), ("@", "."), (" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), ("(at)", ".")])
        return word() + rng.choice(["", "." + word(), d(2)]) + at + word() + dot + rng.choice(["com", "org", "net", "de", "fr"])

    def ip():
        return rng.choice([".", ".", " . "]).join(str(rng.randint(0, 255)) for _ in range(4))

    def card():
        body = rng.choice("3456") + d(14)
        digits = next(body + c for c in "0123456789" if luhn(body + c))
        sep = rng.choice(["", " ", "-", "."])
        return sep.join(digits[k : k + 4] for k in range(0, 16, 4))

    def phone():
        return rng.choice(
            [
                f"+{rng.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}",
                f"({d(3)}) {d(3)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+{rng.randint(1, 99)} {d(3)} {d(3)} {d(3)}"
            ]
        )

    def other():
        n, year = rng.randint, f"{rng.choice((19, 20))}{d(2)}"
        plain = [f"{n(1, 20)}.{n(0, 9)}", d(n(1, 6)), d(n(7, 19)), f"#{d(8)}", f"{d(1)},{d(3)},{d(3)}", f"{d(2)}:{d(2)}:{d(2)}"]
        dates = [
            f"{year}-0{n(1, 9)}-{n(10, 28)}", f"{n(10, 28)}/0{n(1, 9)}/{year}", f"{year} {rng.choice((19, 20))}{d(2)}",
            f"({d(4)}) {d(2)}-{d(2)}"
        ]
        codes = [
            f"v{d(1)}.{d(1)}.{d(2)}.{d(4)}", f"{d(1)}.{d(1)}.{d(1)}", f"300.{d(3)}.999.{d(2)}", f"{d(5)}-{d(4)}",
            f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{d(4)} - {d(4)}"
        ]
        groups = [f"{d(3)} {d(4)}", f"{d(3)} {d(3)} {d(3)}", f"{d(4)} {d(4)} {d(4)} {d(4)}", ", ".join(f"{d(2)}-{d(2)}" for _ in range(n(2, 4)))]
        words = [f"{word()} at {word()}", f"{word()} dot {word()}", f"{word()} at {word()} dot {word()}"]
        return rng.choice([*plain, *dates, *codes, *groups, *words])

    made = {"email": email, "ip": ip, "card": card, "phone": phone}
    text, spans = word(), []
    for _ in range(rng.randint(1, 3)):
        text += " " + " ".join(word() for _ in range(rng.randint(1, 4))) + " "
        kind = rng.choice([*KINDS, None, None, None])
        if kind is None:
            text += other()
        else:
            if rng.random() < 0.3:
                text += rng.choice([w for w, k in WORDS.items() if k == kind]) + rng.choice([" ", ": "])
            thing = made[kind]()
            spans.append((kind, len(text), len(text) + len(thing)))
            text += thing
    return text + rng.choice([".", " ", ", " + word()]), spans


@functools.lru_cache(4)
def train(n: int = TRAINING, seed: int = 11, epochs: int = 12, rate: float = 0.4, decay: float = 1e-4) -> dict[str, float]:
    """Weights by stochastic ascent on the conditional log-likelihood (forward-backward over segments)."""
    rng = random.Random(seed)
    data = []
    for _ in range(n):
        text, spans = sentence(rng)
        bounds, arcs = lattice(text)
        place = {b: k for k, b in enumerate(bounds)}
        gold = {(place.get(s), place.get(e), k) for k, s, e in spans}
        data.append((len(bounds) - 1, arcs, [(i, j, k) in gold for i, j, k, _ in arcs]))
    weights: dict[str, float] = {}
    square: dict[str, float] = {}
    for _ in range(epochs):
        rng.shuffle(data)
        for size, arcs, gold in data:
            if not arcs:
                continue
            scores = [sum(weights.get(f, 0.0) for f in names) for *_, names in arcs]
            ends: dict[int, list[int]] = {}
            begins: dict[int, list[int]] = {}
            for k, (i, j, *_) in enumerate(arcs):
                ends.setdefault(j, []).append(k)
                begins.setdefault(i, []).append(k)
            ahead = [0.0] * (size + 1)
            for j in range(1, size + 1):
                ahead[j] = ahead[j - 1]
                for k in ends.get(j, ()):
                    ahead[j] = logadd(ahead[j], ahead[arcs[k][0]] + scores[k])
            behind = [0.0] * (size + 1)
            for i in range(size - 1, -1, -1):
                behind[i] = behind[i + 1]
                for k in begins.get(i, ()):
                    behind[i] = logadd(behind[i], behind[arcs[k][1]] + scores[k])
            slope: dict[str, float] = {}
            for k, (i, j, _, names) in enumerate(arcs):
                g = gold[k] - math.exp(min(0.0, ahead[i] + scores[k] + behind[j] - ahead[size]))
                if abs(g) > 1e-6:
                    for f in names:
                        slope[f] = slope.get(f, 0.0) + g
            for f, g in slope.items():
                g -= decay * weights.get(f, 0.0)
                square[f] = square.get(f, 1e-6) + g * g
                weights[f] = weights.get(f, 0.0) + rate * g / math.sqrt(square[f])
    return {f: round(w, 6) for f, w in sorted(weights.items())}


def regions(hints: list[int], size: int):
    """Disjoint stretches that hold every segment: one begins up to ``MAX_CHARS`` before its hint and is no longer than that."""
    lo = hi = None
    for h in hints:
        if hi is not None and h - MAX_CHARS <= hi:
            hi = min(size, h + MAX_CHARS)
            continue
        if hi is not None:
            yield lo, hi
        lo, hi = max(0, h - MAX_CHARS), min(size, h + MAX_CHARS)
    if hi is not None:
        yield lo, hi


def added_spans(text: str, base: list[tuple[str, int, int]], weights: dict[str, float]) -> list[tuple[str, int, int]]:
    """The field's entities in the whole text that overlap no base span."""
    hints = [m.start() for m in HINT.finditer(text)]
    taken = sorted((s, e) for _, s, e in base)
    starts, reach = [s for s, _ in taken], list(itertools.accumulate((e for _, e in taken), max))
    out = []
    for lo, hi in regions(hints, len(text)):
        for kind, s, e in viterbi(text, weights, lo, hi, hints):
            k = bisect.bisect_left(starts, e)
            if k == 0 or reach[k - 1] <= s:
                out.append((kind, s, e))
    return out


def digest(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, counts of base spans, base_sha256, spans (text), n_added."""
    weights = train()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches):
        for b in batches:
            rows = []
            for text in (x.as_py() or "" for x in b.column(1)):
                base, added = [], []
                if HINT.search(text):  # a digit or @ is one, so that base spans have it too
                    base = base_spans(text)
                    added = added_spans(text, base, weights)
                n = [sum(x[0] == k for x in base) for k in KINDS]
                rows.append((*n, hashlib.sha256(digest(base).encode()).hexdigest(), digest([*base, *added]), len(added)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names)

    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    )


def op2_personal_data(spark, sf_dir):
    return find_personal_data(table(spark, sf_dir, "documents"))
