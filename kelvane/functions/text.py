"""Column functions on dirty text; JVM expressions only.

White space is Unicode's, hence ``(?U)`` in patterns. Three notions of empty are kept apart: ``is_missing`` (null or the empty
string), ``is_blank`` (nothing but white space, and zero if asked for) and ``is_unknown`` (blank or a placeholder that begins with n/a).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MULTI_PART_TLDS = ("co.uk", "org.uk", "ac.uk", "gov.uk", "co.jp", "com.au", "co.nz", "com.br", "co.za", "com.cn", "co.in", "com.tr", "com.mx")
LEGAL_SUFFIXES = (
    "gmbh", "mbh", "ag", "se", "kg", "ohg", "ug", "inc", "incorporated", "ltd", "limited", "llc", "lp", "llp", "plc",
    "bv", "nv", "sa", "sas", "srl", "spa", "ab", "as", "oy", "aps", "corp", "corporation", "co", "company", "the",
)
URL_PATTERN = r"(?iU)https?://[^\s|,;]+"
MOJIBAKE_PATTERN = r"\x{FFFD}|\x{C3}[\x{80}-\x{BF}]|\x{E2}\x{20AC}[\x{99}\x{9C}\x{9D}\x{93}\x{94}]"


def as_text(c: Column) -> Column:
    """The column as a string, null as empty."""
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space become one space; none is left at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def is_missing(c: Column) -> Column:
    return c.isNull() | (c.cast("string") == "")


def is_blank(c: Column, zero_is_empty: bool = False) -> Column:
    """zero_is_empty: numbers equal to zero count as empty, as in a table whose cells are dynamically typed."""
    blank = strip(as_text(c)) == ""
    return blank | F.coalesce(c.cast("string").try_cast("double") == 0, F.lit(False)) if zero_is_empty else blank


def is_unknown(c: Column) -> Column:
    text = strip(as_text(c))
    return (text == "") | F.lower(text).startswith("n/a")


def clean(c: Column) -> Column:
    """Stripped text; null where it says nothing."""
    return F.when(~is_unknown(c), strip(c.cast("string")))


def first_url(c: Column) -> Column:
    """The first http(s) address without trailing punctuation; empty if there is none."""
    return F.regexp_replace(F.regexp_extract(as_text(c), URL_PATTERN, 0), r"[/.,;|]+$", "")


def registrable_domain(c: Column) -> Column:
    """The last two labels of the host, three below known two-part suffixes; empty if there is no host with a dot."""
    bare = strip(as_text(c))
    url = first_url(c)
    url = F.when(url != "", url).when(~bare.contains(" ") & bare.contains(".") & (bare != ""), F.concat(F.lit("https://"), bare)).otherwise("")
    host = F.regexp_replace(F.regexp_extract(F.lower(F.regexp_extract(url, "(?s)^[^:]+://([^/?#]*)", 1)), "(?s)^[^:]*", 0), r"^www\.", "")
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    two = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), ".")
    three = F.array_join(F.slice(labels, F.greatest(n - 2, F.lit(1)), 3), ".")
    return F.when(~host.contains("."), "").when((n >= 3) & two.isin(*MULTI_PART_TLDS), three).otherwise(two)


def normalize_company(c: Column) -> Column:
    """Lower-case words of a name without its trailing legal forms and without any ``the``."""
    text = F.regexp_replace(F.regexp_replace(F.lower(as_text(c)), "[–—_/,]", " "), r"(?U)[^a-z0-9\s&+.\-]", " ")
    words = F.filter(F.split(text, r"(?U)[\s.]+"), lambda w: w != "")
    run = "|".join(LEGAL_SUFFIXES)
    joined = F.regexp_replace(F.array_join(words, " "), rf"(?:(?:^| )[&+\-]*(?:{run})[&+\-]*)+$", "")
    return F.array_join(F.filter(F.split(joined, " "), lambda w: (w != "the") & (w != "")), " ")


def core(c: Column) -> Column:
    """Only the letters a-z and digits."""
    return F.regexp_replace(c, "[^a-z0-9]+", "")


def split_multi(c: Column) -> Column:
    """Values between bars or semicolons, stripped, blanks dropped; commas do not part values."""
    return F.filter(F.transform(F.split(as_text(c), r"[|;]"), strip), lambda x: x != "")


def split_commas(values: Column) -> Column:
    """An array's values parted further at commas."""
    return F.filter(F.flatten(F.transform(values, lambda v: F.transform(F.split(v, ","), strip))), lambda x: x != "")


def join_multi(values: Column, separator: str = "; ") -> Column:
    """Distinct non-blank values in their order."""
    return F.array_join(F.array_distinct(F.filter(F.transform(values, strip), lambda x: x != "")), separator)


def canon_tier(c: Column, tiers: list[str]) -> Column:
    """The tier of that number, whatever follows it; else null."""
    number = F.regexp_extract(collapse(as_text(c)), r"(?iU)^tier\s*([123])\b", 1)
    out = F.lit(None).cast("string")
    for n in "123":
        full = next((t for t in tiers if t.startswith(f"Tier {n}")), None)
        if full:
            out = F.when(number == n, full).otherwise(out)
    return out


def has_mojibake(c: Column) -> Column:
    """Replacement characters or UTF-8 read as another code page."""
    return F.coalesce(c.rlike(MOJIBAKE_PATTERN), F.lit(False))


def is_number(c: Column) -> Column:
    """Whether Python's float() would take the text."""
    return F.coalesce(strip(c.cast("string")).rlike(r"(?i)^[+-]?(?:(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:e[+-]?\d+(?:_\d+)*)?|inf(?:inity)?|nan)$"), F.lit(False))


def whole_number(c: Column) -> Column:
    """The number cut to an integer; null for what is not a finite number."""
    text = F.regexp_replace(strip(c.cast("string")), "_", "")
    value = F.when(is_number(c), text.try_cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value).try_cast("bigint")


def date_prefix(c: Column) -> Column:
    return F.substring(as_text(c), 1, 10)


def escape_html(c: Column) -> Column:
    """Text for a page: null is empty, and the five signs of markup are entities."""
    out = F.replace(as_text(c), F.lit("&"), F.lit("&amp;"))
    for sign, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out
