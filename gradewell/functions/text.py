"""Text column functions (F1-F11, F14-F17, F19, F26, F34). Column in, Column out.

All run JVM-side as built-in expressions (regex, split, higher-order
functions); no Python UDF. Patterns are written so Java regex (Spark) and
RE2 (DuckDB oracle) agree, and so they mirror Python's ``str`` semantics
(Unicode white space in ``strip``/``split``, ``\\n``-only lines for ``(?m)``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
# White space as Python's str.isspace() sees it.
WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
NON_WS = r"[^\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
# Line breaks as Python's str.splitlines() sees them.
LINE_BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
# Fence language tags dropped when alone on their line (any case).
FENCE_TAGS = ("hcl", "terraform", "tf")
# Markers that make an unfenced response count as code.
CODE_MARKERS = ('resource "', 'data "', 'provider "', 'terraform {', 'variable "', 'output "')
# Unfenced text longer than this many words is prose unless it starts with 'terraform'.
PREAMBLE_WORDS = 100
# Secret-bearing keys and the redaction pattern: key, separator, quoted or bare value.
REDACT_PATTERN = (
    r"""(?i)\b(username|password|api[_-]?key|token)\b\s*([:=])\s*("[^\n]*?"|'[^\n]*?'|[^\s,\n}]+)"""
)
REDACTED = '"[REDACTED]"'
# ANSI escape sequences.
ANSI_PATTERN = r"\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])"
# Error text truncation: keep head and tail halves around a marker; the length that prompts
# are built with (callers pass it, nothing is cut by default).
TRUNCATE_MAX = 4000
TRUNCATE_MARKER = "\n... [TRUNCATED] ...\n"
CONTEXT_MARKER = "\n... [TRUNCATED - extracted context]"
# BLEU tokens: runs of letters/digits/underscore, or one other non-space character.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]"
# Block-type pattern for resource/data blocks.
BLOCK_TYPE_PATTERN = r'(?:resource|data)\s+"([^"]+)"'
# Difficulty bounds (loc, resources, interconnections), all strict, levels 1..5; else 6.
DIFFICULTY_BOUNDS = ((10, 2, 2), (20, 4, 4), (40, 6, 6), (60, 8, 8), (80, 10, 10))
# Verdict pattern.
VERDICT_PATTERN = r"(?i)Rating:\s*(Correct|Incorrect)"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(c: Column | str) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode white space."""
    return F.regexp_replace(_c(c), rf"^{WS}+|{WS}+\z", "")


def word_count(c: Column | str) -> Column:
    """``len(s.split())``: number of white-space separated words."""
    return F.size(F.regexp_extract_all(_c(c), F.lit(f"{NON_WS}+"), 0))


# ---------------------------------------------------------------- F1 / T5
def extract_code(response: Column | str) -> Column:
    """code from a model response.

    Split on triple backticks; odd pieces are blocks. Strip each block, drop a
    leading language tag only when it sits alone on its line, keep the last
    non-empty block (unclosed fences count). Without blocks, the whole
    stripped text when it carries a code marker and is not long prose.
    """
    r = F.coalesce(_c(response), F.lit(""))
    parts = F.split(r, "```", -1)
    blocks = F.filter(parts, lambda x, i: i % 2 == 1)
    tag = "|".join(FENCE_TAGS)
    cleaned = F.transform(
        blocks, lambda b: F.regexp_replace(strip_ws(b), rf"^(?i:{tag})(?:[\r\n]+|\z)", "")
    )
    nonempty = F.filter(cleaned, lambda b: b != F.lit(""))
    last_block = F.try_element_at(nonempty, F.lit(-1))
    whole = strip_ws(r)
    code_like = F.lit(False)
    for m in CODE_MARKERS:
        code_like = code_like | F.contains(whole, F.lit(m))
    preamble = (word_count(whole) > PREAMBLE_WORDS) & ~F.startswith(whole, F.lit("terraform"))
    fallback = F.when(code_like & ~preamble, whole).otherwise(F.lit(""))
    return F.coalesce(last_block, fallback)


# ---------------------------------------------------------------- F2-F6
def redact(text: Column | str) -> Column:
    """replace secret values after username/password/api key/token."""
    return F.regexp_replace(_c(text), REDACT_PATTERN, "$1$2" + REDACTED)


def redact_messages(messages: Column | str) -> Column:
    """redact the content of every message; the input column is untouched."""
    return F.transform(_c(messages), lambda m: m.withField("content", redact(m["content"])))


def strip_ansi(text: Column | str) -> Column:
    """remove ANSI escape sequences."""
    return F.regexp_replace(_c(text), ANSI_PATTERN, "")


def truncate_middle(text: Column | str, max_chars: int | None = None) -> Column:
    """over ``max_chars`` -> first half + marker + last half; without a limit the whole text."""
    t = _c(text)
    if max_chars is None:
        return t
    half = max_chars // 2
    return F.when(
        F.length(t) > max_chars,
        F.concat(F.substring(t, 1, half), F.lit(TRUNCATE_MARKER), F.substring(t, -half, half)),
    ).otherwise(t)


def truncate_head(text: Column | str, max_chars: int | None = None, marker: str = "") -> Column:
    """keep the first ``max_chars`` characters, append ``marker`` if cut; without a limit the whole text."""
    t = _c(text)
    if max_chars is None:
        return t
    return F.when(
        F.length(t) > max_chars, F.concat(F.substring(t, 1, max_chars), F.lit(marker))
    ).otherwise(t)


def sanitize_error(text: Column | str, max_chars: int | None = None) -> Column:
    """F4 then F5, as error text is prepared for a repair prompt."""
    return truncate_middle(strip_ansi(text), max_chars)


# ---------------------------------------------------------------- F7-F11
def tokens(text: Column | str) -> Column:
    """BLEU tokens (``\\w+|[^\\w\\s]`` with Unicode classes)."""
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(TOKEN_PATTERN), 0)


def nonblank_lines(text: Column | str) -> Column:
    """F8: number of lines that are not blank."""
    lines = F.split(F.coalesce(_c(text), F.lit("")), LINE_BREAK, -1)
    return F.size(F.filter(lines, lambda x: x.rlike(NON_WS)))


def count_substr(text: Column | str, pattern: str) -> Column:
    """F9 helper: non-overlapping occurrences of a literal (Python ``str.count``)."""
    t = F.coalesce(_c(text), F.lit(""))
    return F.floor(
        (F.length(t) - F.length(F.replace(t, F.lit(pattern), F.lit("")))) / len(pattern)
    ).cast("long")


def resource_count(text: Column | str) -> Column:
    """resource blocks plus data blocks."""
    return count_substr(text, 'resource "') + count_substr(text, 'data "')


def interconnections(text: Column | str) -> Column:
    """``.id`` + ``.name`` references minus ``name_label`` (may be negative)."""
    return count_substr(text, ".id") + count_substr(text, ".name") - count_substr(text, "name_label")


def block_types(text: Column | str) -> Column:
    """F10 + U4: distinct sorted resource/data types."""
    found = F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(BLOCK_TYPE_PATTERN), 1)
    return F.array_sort(F.array_distinct(found))


def difficulty(loc: Column | str, res: Column | str, inter: Column | str) -> Column:
    """first level whose three strict bounds hold; else "6"."""
    loc, res, inter = _c(loc), _c(res), _c(inter)
    expr = None
    for lvl, (a, b, c) in enumerate(DIFFICULTY_BOUNDS, start=1):
        cond = (loc < a) & (res < b) & (inter < c)
        expr = F.when(cond, F.lit(str(lvl))) if expr is None else expr.when(cond, F.lit(str(lvl)))
    return expr.otherwise(F.lit("6"))


# ---------------------------------------------------------------- F14 / F15 / A18
def setting_pattern(key: str, mode: str = "reference") -> str:
    """``key = value`` lines. ``reference`` mode matches one digit or an
    arithmetic expression (so a bare multi-digit number is missed, as in the
    reference); ``integers`` mode also matches plain integers."""
    value = r"\d(?:[\d\s]*[+\-*]\s*\d+)*" if mode == "reference" else r"\d+(?:\s*[+\-*]\s*\d+)*"
    # (?d): only \n ends a line, as in Python's re.MULTILINE
    return rf"(?md)^\s*{key}\s*=\s*({value})\s*$"


def eval_arith(expr: Column | str) -> Column:
    """evaluate ``+ - *`` with normal precedence; null when not parseable
    (digits split by spaces, or a leading zero inside an expression)."""
    e = strip_ws(expr)
    pure = e.rlike(r"^[0-9]+$")
    bad = e.rlike(r"[0-9]\s+[0-9]") | e.rlike(r"(^|[^0-9])0[0-9]")
    compact = F.regexp_replace(e, r"\s+", "")
    terms = F.regexp_extract_all(compact, F.lit(r"[+\-]?[0-9*]+"), 0)

    def term_value(t):
        sign = F.when(F.startswith(t, F.lit("-")), F.lit(-1)).otherwise(F.lit(1)).cast("long")
        factors = F.split(F.regexp_replace(t, r"^[+\-]", ""), r"\*", -1)
        return sign * F.aggregate(factors, F.lit(1).cast("long"), lambda a, x: a * x.cast("long"))

    total = F.aggregate(terms, F.lit(0).cast("long"), lambda a, t: a + term_value(t))
    return F.when(pure, e.cast("long")).when(bad, F.lit(None).cast("long")).otherwise(total)


def setting_values(code: Column | str, key: str, mode: str = "reference") -> Column:
    """Every evaluated ``key = value`` in a text (unparseable ones dropped)."""
    found = F.regexp_extract_all(
        F.coalesce(_c(code), F.lit("")), F.lit(setting_pattern(key, mode)), 1
    )
    return F.filter(F.transform(found, eval_arith), lambda v: v.isNotNull())


def setting_total(code: Column | str, key: str, mode: str = "reference") -> Column:
    """Sum of all matching settings in one text; null when none."""
    vals = setting_values(code, key, mode)
    return F.when(
        F.size(vals) > 0, F.aggregate(vals, F.lit(0).cast("long"), lambda a, x: a + x)
    )


# ---------------------------------------------------------------- F16 / F17
def parse_verdict(text: Column | str) -> Column:
    """F16: Correct / Incorrect / Unknown from a judge response."""
    t = _c(text)
    hit = F.regexp_extract(F.coalesce(t, F.lit("")), VERDICT_PATTERN, 1)
    low = strip_ws(F.lower(t))
    return (
        F.when(t.isNull() | (t == ""), F.lit("Unknown"))
        .when(hit != "", F.initcap(F.lower(hit)))
        .when(F.endswith(low, F.lit("incorrect")) | F.contains(low, F.lit("rating: incorrect")), F.lit("Incorrect"))
        .when(F.endswith(low, F.lit("correct")) | F.contains(low, F.lit("rating: correct")), F.lit("Correct"))
        .otherwise(F.lit("Unknown"))
    )


def category_of(description: Column | str) -> Column:
    """category = part of ``"CATEGORY - prompt_type"`` before `` - ``."""
    return F.split_part(F.coalesce(_c(description), F.lit("")), F.lit(" - "), F.lit(1))


# ---------------------------------------------------------------- F19 / F26 / F34
ALTERNATIVE_PATTERN = r"(?i)(\d+)\s*[*_]*\s*VMs?[*_]*\s*with\s*(\d+(?:\.\d+)?)\s*(GB|MB)"


def alternatives(text: Column | str) -> Column:
    """every ``N VMs with X GB|MB`` as ``"{n} VMs with {x}{UNIT} each"``."""
    t = F.coalesce(_c(text), F.lit(""))
    n = F.regexp_extract_all(t, F.lit(ALTERNATIVE_PATTERN), 1)
    x = F.regexp_extract_all(t, F.lit(ALTERNATIVE_PATTERN), 2)
    u = F.regexp_extract_all(t, F.lit(ALTERNATIVE_PATTERN), 3)
    return F.transform(
        F.arrays_zip(n.alias("n"), x.alias("x"), u.alias("u")),
        lambda z: F.concat(z["n"], F.lit(" VMs with "), z["x"], F.upper(z["u"]), F.lit(" each")),
    )


def clean_label(label: Column | str) -> Column:
    """runs of characters outside ``[A-Za-z0-9_-]`` -> ``_``, collapse, trim ``_``."""
    x = F.regexp_replace(_c(label), r"[^A-Za-z0-9_-]+", "_")
    x = F.regexp_replace(x, r"_+", "_")
    return F.regexp_replace(x, r"^_+|_+$", "")


def text_bar(n: Column | str) -> Column:
    """a bar of ``n`` blocks."""
    return F.repeat(F.lit("█"), _c(n).cast("int"))


def fill(template: str, null_as: str | None = None, **values: Column) -> Column:
    """Fill the ``{name}`` slots of a fixed template with column values
    (a plain concatenation; data is never parsed as a format). With
    ``null_as``, null values print as that text; otherwise a null value
    makes the result null."""
    parts: list[Column] = []
    rest = template
    while rest:
        i = rest.find("{")
        if i < 0:
            parts.append(F.lit(rest))
            break
        j = rest.index("}", i)
        if i:
            parts.append(F.lit(rest[:i]))
        v = values[rest[i + 1:j]]
        parts.append(F.coalesce(v, F.lit(null_as)) if null_as is not None else v)
        rest = rest[j + 1:]
    return F.concat(*parts)
