"""Text building blocks: number echo, strip, PII patterns, scope-guard patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lendflow.sources.schemas import MONEY


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def money_str(x) -> Column:
    """Render through decimal(18,2): doubles would print as 1.25E7 from 10^7 on."""
    return _c(x).cast(MONEY).cast("string")


def _drop_last(s: Column, n: int) -> Column:
    return F.substring(s, F.lit(1), F.length(s) - n)


def fmt_in(x) -> Column:
    """Echo an input amount the way it was submitted: 1600.00 -> 1600, 1600.50 -> 1600.5.
    On the two-decimal rendering this is suffix trimming (same result as removing ``[.]?0+$``)."""
    s = money_str(x)
    return (F.when(s.endswith(".00"), _drop_last(s, 3))
            .when(s.endswith("0"), _drop_last(s, 1)).otherwise(s))


def fmt_calc(x) -> Column:
    """Echo a value rounded to 2 places as a float prints: 6.00 -> 6.0, 6.50 -> 6.5, 6.71 -> 6.71.
    On the two-decimal rendering: drop one trailing zero (same as ``([.][0-9])0$`` -> ``$1``)."""
    s = money_str(x)
    return F.when(s.endswith("0"), _drop_last(s, 1)).otherwise(s)


def render(template: str, values: dict) -> Column:
    """Fill a ``{name}`` template with Columns: one ``concat`` of literal pieces and values
    (callers default null values first: concat of a null is null)."""
    import string
    parts = []
    for literal, field, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            parts.append(values[field])
    return F.concat(*parts)


def pct2(x) -> Column:
    """A rate as a percentage with two decimals: 0.0935 -> 9.35 (as ``%.2f`` prints it: HALF_UP on
    the value's decimal form, which is what ``round`` does; rendered through decimal(20,2))."""
    return F.round(_c(x) * F.lit(100.0), 2).cast("decimal(20,2)").cast("string")


# The characters Python's str.strip() removes (str.isspace), as a regex class
# that Java and RE2 read the same way.
WHITESPACE_CLASS = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
STRIP_PATTERN = f"^{WHITESPACE_CLASS}+|{WHITESPACE_CLASS}+$"


def py_strip(x) -> Column:
    """Strip whitespace at both ends exactly like str.strip() (``trim`` only removes spaces)."""
    return F.regexp_replace(_c(x), STRIP_PATTERN, "")


def is_blank(x) -> Column:
    """Null, empty or whitespace only (one anchored match; nothing is rebuilt)."""
    return _c(x).isNull() | _c(x).rlike(f"^{WHITESPACE_CLASS}*$")


# ---------------------------------------------------------------------------------------------
# Structured PII patterns and their replacement tokens, applied in this order.  No digit
# may stand beside a number: a longer number is another thing.  Phones: (ddd) ddd-dddd; Australian
# (0a) dddd dddd, 0a dddd dddd, 04dd ddd ddd, 1300 / 1800 ddd ddd and 13 dd dd, the first three also with +61.
# Each begins with what tells in a step that nothing starts here: an address only where its word starts (or the
# last match ended), a number only at a digit, bracket or plus.
PII_PATTERNS = (
    ("EMAIL", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+[.][A-Za-z]{2,}", "<EMAIL>"),
    ("CARD", r"(?=[0-9])(?<![0-9])[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}(?![0-9])", "<CARD>"),
    ("PHONE", r"(?=[0-9(+])(?<![0-9])(?:(?:[+]?[0-9]{1,2} ?)?[(][0-9]{3}[)] ?[0-9]{3}-[0-9]{4}"
              r"|(?:[+]?61 ?)?[(]0?[2378][)][ -]?[0-9]{4}[ -]?[0-9]{4}"
              r"|(?:[+]61 ?|0)[2378][ -]?[0-9]{4}[ -]?[0-9]{4}"
              r"|(?:[+]61 ?|0)4[0-9]{2}[ -]?[0-9]{3}[ -]?[0-9]{3}"
              r"|1[38]00[ -]?[0-9]{3}[ -]?[0-9]{3}|13 ?[0-9]{2} ?[0-9]{2})(?![0-9])", "<PHONE>"),
)


# A cheap necessary condition per pattern; texts without it skip that regex.  Tokens meet none and part
# what was apart, so the text as it came tells it for all of them (asking the text masked so far would mask it twice).
PII_GATES = {"EMAIL": "@", "CARD": "[0-9]{4}", "PHONE": "[0-9]{2}"}


def mask_pii(x) -> Column:
    text = out = _c(x)
    for name, pattern, token in PII_PATTERNS:
        out = F.when(text.rlike(PII_GATES[name]), F.regexp_replace(out, pattern, token)).otherwise(out)
    return out


def name_pattern(name) -> Column:
    """Case-insensitive pattern of a name: the whole of it or any of its words, as whole words."""
    full = F.regexp_replace(F.trim(_c(name)), r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    words = F.array_join(F.filter(F.split(full, r"\s+"), lambda w: F.length(w) > 1), "|")
    return F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), full,
                    F.when(F.length(words) > 0, F.concat(F.lit("|"), words)).otherwise(F.lit("")),
                    F.lit(r")(?![\p{L}\p{N}])"))


# ---------------------------------------------------------------------------------------------
# The scope guard's four term families, each term matched as a whole word (\b on
# both sides) against lower-cased text.
SCOPE_TERMS = (
    ("code", ("python", "javascript", "java", "c++", "bash", "powershell", "sql query", "html", "css")),
    ("code_request", ("write a script", "write code", "generate code", "function to", "while loop", "for loop")),
    ("jailbreak", ("ignore previous instructions", "system prompt", "jailbreak", "DAN mode", "bypass")),
    ("off_topic", ("poem", "story", "recipe", "joke", "translate to")),
)

# A word character: any Unicode letter or digit, or underscore.  Boundaries are written out with
# this class instead of \b so they mean the same in Java and in RE2 (an ASCII-only \b would see a
# boundary inside "épython").
_WORD = r"[\p{L}\p{N}_]"
_NONWORD = r"[^\p{L}\p{N}_]"
_META = set("\\.^$|?*+()[]{}")


def _escape(term: str) -> str:
    return "".join("\\" + ch if ch in _META else ch for ch in term)


def _is_word(ch: str) -> bool:
    return ch.isalnum() or ch == "_"


def _term_pattern(term: str, mode: str) -> str:
    """``\\bterm\\b`` with explicit boundaries.

    strict: exact \\b semantics.  Next to a non-word edge character (the "+" of "c++") a \\b
    demands a *word* character on the other side, so "use c++ now" is not matched.
    fixed:  every edge demands a non-word character or the end of the text (whole-token match),
    and terms are lower-cased so "dan mode" can match lower-cased text.
    """
    if mode == "fixed":
        term = term.lower()
    left = f"(^|{_NONWORD})" if (_is_word(term[0]) or mode == "fixed") else _WORD
    right = f"({_NONWORD}|$)" if (_is_word(term[-1]) or mode == "fixed") else _WORD
    return left + _escape(term) + right


def scope_patterns(mode: str = "strict"):
    """(family, regex) pairs; one regex per family, alternatives carry their own boundaries."""
    return tuple(
        (name, "|".join(_term_pattern(t, mode) for t in terms)) for name, terms in SCOPE_TERMS
    )


def scope_family(x, mode: str = "strict") -> Column:
    """First matching family name (code, code_request, jailbreak, off_topic) or null."""
    low = F.lower(_c(x))
    fam = F.lit(None).cast("string")
    for name, pattern in reversed(scope_patterns(mode)):
        fam = F.when(low.rlike(pattern), F.lit(name)).otherwise(fam)
    return fam


def is_out_of_scope(x, mode: str = "strict") -> Column:
    return F.coalesce(scope_family(x, mode).isNotNull(), F.lit(False))
