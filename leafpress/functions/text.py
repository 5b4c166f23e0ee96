"""String functions as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the source format's strip() removes: Unicode white space and the four separators.
SPACE = r"[\s\x1c-\x1f]"
BULLET = r"^\s*[•●▪◦]\s*"
CJK = "㐀-鿿"
#: Fixed value: words that keep a doubled numeral from being read as a dash.
DASH_SUFFIXES = (
    "对应", "列举", "说明", "核实", "答复", "回复", "记录", "查看", "检查", "确认", "介绍", "呈现", "列出", "解决", "落实", "兑现", "告知", "询问", "解答", "分析", "比较", "匹配",
    "排查", "处理", "展示", "验证", "罗列"
)
#: Fixed value: compact phrases and how they are written.
COMPACT_PHRASES = {"googlereader": "Google Reader"}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)^{SPACE}+|{SPACE}+$", "")


def lines(c: Column) -> Column:
    """The lines of a text, CRLF and CR being line ends too."""
    return F.split(F.regexp_replace(c, "\r\n?", "\n"), "\n", -1)


def kept_lines(c: Column) -> Column:
    """Non-blank lines as structs (line_index, text), in order."""
    marked = F.transform(lines(c), lambda x, i: F.struct(i.cast("int").alias("line_index"), strip(x).alias("text")))
    return F.filter(marked, lambda s: s["text"] != "")


def collapse(c: Column) -> Column:
    """Text of a cell on one line: its non-blank lines joined by `` / ``."""
    return F.array_join(F.filter(F.transform(lines(c), strip), lambda x: x != ""), " / ")


def cell(c: Column) -> Column:
    """A value inside a rendered table row."""
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))


def header_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)[\s：:（）()、，,。.]", ""))


def artifact_id(path: Column) -> Column:
    return F.concat(F.lit("a_"), F.substring(F.sha2(path, 256), 1, 16))


def workspace_id(root: Column) -> Column:
    return F.concat(F.lit("ws_"), F.substring(F.sha2(root, 256), 1, 12))


def block_id(seq: Column) -> Column:
    return F.concat(F.lit("b"), F.when(seq < 10_000, F.lpad(seq.cast("string"), 4, "0")).otherwise(seq.cast("string")))


def suffix(name: Column) -> Column:
    """The extension with its dot, lower-case; none for dot files and a trailing dot."""
    return F.lower(F.regexp_extract(name, r"(?s)[^.](\.[^.]+)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?s)(?<=[^.])\.[^.]+$", "")


def column_letters(n: Column) -> Column:
    """Spreadsheet column letters of a 1-based number, up to three of them."""
    letter = lambda x: F.char((x + F.lit(65)).cast("long"))
    zero = n - 1
    two = zero - 26
    three = two - 26 * 26
    return (
        F.when(n <= 26, letter(zero))
        .when(n <= 26 + 26 * 26, F.concat(letter(F.floor(two / 26)), letter(two % 26)))
        .otherwise(F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26) % 26), letter(three % 26)))
    )


def _decimal(n: Column, pattern: str) -> Column:
    return F.call_function("format_number", n, F.lit(pattern))


def size_label(n: Column) -> Column:
    """B as an integer, larger units with one decimal, in steps of 1024."""
    unit = lambda k, u: F.concat(_decimal(n / F.lit(float(1024**k)), "0.0"), F.lit(f" {u}"))
    return F.when(
        n < 1024, F.concat(n.cast("string"), F.lit(" B"))
    ).when(n < 1024**2, unit(1, "KB")).when(n < 1024**3, unit(2, "MB")).otherwise(unit(3, "GB"))


def card_size_label(n: Column) -> Column:
    """The shorter form on cards: KB without decimals, MB with one."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(
        n < 1024**2, F.concat(_decimal(n / F.lit(1024.0), "0"), F.lit(" KB"))
    ).otherwise(F.concat(_decimal(n / F.lit(1048576.0), "0.0"), F.lit(" MB")))


def path_key(c: Column) -> Column:
    """A path for comparison: doubled slashes and ``.`` steps folded, no trailing slash."""
    folded = F.regexp_replace(F.regexp_replace(c, "/+", "/"), r"(?<=/)(\./)+|/\.$", "")
    return F.when(F.length(folded) > 1, F.regexp_replace(folded, "/$", "")).otherwise(folded)


def restore_dashes(c: Column) -> Column:
    """Doubled numerals that stand for a dash: between CJK or brackets, and not in a listed word. A pair that stays is passed over whole."""
    # pairs are cut from the left; each is judged by the character before it (a numeral of the pair before included) and by what follows
    parts = F.split(c, "一一", -1)
    rest = lambda i: F.concat(
        F.when(
            F.size(parts) > i + 2, F.concat(F.try_element_at(parts, (i + 2).cast("int")), F.lit("一一"))
        ).otherwise(F.try_element_at(parts, (i + 2).cast("int")))
    )
    before = lambda i: F.when(
        (i > 0) & (F.try_element_at(parts, (i + 1).cast("int")) == ""), F.lit("一")
    ).otherwise(F.right(F.try_element_at(parts, (i + 1).cast("int")), F.lit(1)))
    good = lambda i: (
        ((before(i) == "") | F.regexp_like(before(i), F.lit(f"[{CJK}）】》”’]")))
        & F.regexp_like(rest(i), F.lit(f"^[{CJK}（【《“‘]"))
        & ~F.regexp_like(rest(i), F.lit(f"^({'|'.join(DASH_SUFFIXES)})"))
    )
    joined = F.transform(
        parts, lambda x, i: F.when(i == F.size(parts) - 1, x).otherwise(F.concat(x, F.when(good(i), F.lit("——")).otherwise(F.lit("一一"))))
    )
    return F.when(F.contains(c, F.lit("一一")), F.array_join(joined, "")).otherwise(c)


def space_english(c: Column) -> Column:
    """Known compact phrases, camel-case words and script changes get their spaces (the last two in CJK texts of 5 or more characters)."""
    out = c
    for compact, written in COMPACT_PHRASES.items():
        out = F.regexp_replace(out, f"(?i)(?<![A-Za-z]){compact}(?![A-Za-z])", written)
    # words of letters, each split where a small letter is followed by a capital with a small one, if it begins with a capital
    # (the end of a match is where the next one begins, so no length of a word is too great)
    spaced = F.regexp_replace(out, r"((?:(?<![A-Za-z])(?=[A-Z])|(?<!^)\G(?<=[a-z]))[A-Za-z]*?[a-z])(?=[A-Z][a-z])", "$1 ")
    spaced = F.regexp_replace(spaced, f"(?<=[{CJK}])(?=[A-Za-z])|(?<=[A-Za-z])(?=[{CJK}])", " ")
    return F.when(F.regexp_like(out, F.lit(f"[{CJK}]")) & (F.length(strip(out)) >= 5), spaced).otherwise(out)
