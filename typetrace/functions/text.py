"""Text, key and locator expressions. Every function is Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Style rules in order of precedence, first hit wins.
STYLE_RULES = (
    ("mono", ("mono", "monospace", "consolas", "courier")),
    ("serif", ("serif", "songti", "ming", "mincho", "明朝", "楷体", "kai", "song")),
    ("kai", ("kai", "xing", "script", "cursive", "handwrit", "brush", "hand", "楷体", "行楷", "手写")),
    ("display", ("display", "heading", "title", "poster", "art", "deco")),
    ("sans", ("heiti", "sans", "黑体", "苹方")),
    ("li", ("隶", "li")),
    ("round", ("fangsong", "仿宋", "圆体", "round", "圆润")),
)
# Files and names a scan leaves out.
FONT_EXTENSIONS = (".ttf", ".otf", ".ttc", ".dfont")
PRIVATE_PREFIXES = ("sf-", "sfsd", "sfcompact")
SYMBOL_NAMES = (
    "symbol", "webdings", "zapfdingbats", "apple symbols", "apple braille", "new york", "last resort",
    "apple color emoji", "apple color emoji ui", "cjk symbols fallback", "symbol.ttf",
)

USABLE = r"[\p{L}\p{Nd}\p{Nl}\p{No}\x{4e00}-\x{9fff}]"
MAX_LINE_CHARS = 20


def usable_chars(text: Column) -> Column:
    """Letters, numbers and ideographs of a text, in order, as an array."""
    return F.regexp_extract_all(text, F.lit(f"({USABLE})"), F.lit(1))


def line_chars(text: Column, longest: int | None = MAX_LINE_CHARS) -> Column:
    """Usable characters of an OCR line; the line is cut to ``longest`` before filtering."""
    return usable_chars(text if longest is None else F.substring(text, 1, longest))


def _holds_any(name: Column, words) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(name, F.lit(w))
    return hit


def guess_style(name: Column) -> Column:
    lower = F.lower(name)
    style = None
    for label, words in STYLE_RULES:
        hit = _holds_any(lower, words)
        style = F.when(hit, label) if style is None else style.when(hit, label)
    return style.otherwise("mixed")


def scannable_file(file_name: Column, extension: Column) -> Column:
    """A font file that is not part of a private family."""
    return F.lower(extension).isin(*FONT_EXTENSIONS) & ~_holds_any(F.lower(file_name), PRIVATE_PREFIXES)


def is_symbol_name(name: Column, words=SYMBOL_NAMES) -> Column:
    return _holds_any(F.lower(name), words)


def slug(name: Column) -> Column:
    return F.replace(F.lower(F.trim(name)), F.lit(" "), F.lit("-"))


def split_locator(locator: Column) -> Column:
    """``system:<path>#<member>`` to path and member; other locators are plain paths."""
    is_system = F.startswith(locator, F.lit("system:"))
    rest = F.substr(locator, F.lit(8))
    parts = F.split(rest, "#", 2)
    return F.struct(
        F.when(is_system, F.trim(F.get(parts, F.lit(0)))).otherwise(locator).alias("path"),
        F.when(is_system, F.get(parts, F.lit(1)).cast("int")).alias("member"),
    )


def via_mirror(url: Column, mirror: str, host: str = "https://github.com/") -> Column:
    """Prefix addresses of one host with a mirror, when a mirror is set."""
    mirror = mirror.rstrip("/")
    if not mirror:
        return url
    return F.when(F.startswith(url, F.lit(host)), F.concat(F.lit(mirror + "/"), url)).otherwise(url)


def colour_bucket(key: Column, buckets: int = 10) -> Column:
    """Stable bucket of a key: 31-fold hash over UTF-16 units, wrapped to 32 bits at each step."""
    raw = F.hex(F.encode(key, "UTF-16BE"))
    units = F.when(
        F.length(raw) > 0,
        F.transform(
            F.sequence(F.lit(0), (F.length(raw) / 4).cast("int") - 1),
            lambda i: F.conv(F.substring(raw, i * 4 + 1, F.lit(4)), 16, 10).cast("bigint"),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    h = F.aggregate(
        units, F.lit(0).cast("bigint"), lambda h, u: (h * 31 + u).bitwiseAND(F.lit(0xFFFFFFFF))
    )
    signed = F.when(h >= 2**31, h - 2**32).otherwise(h)
    return (F.abs(signed) % buckets).cast("int")


def escape_html(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def percent(score: Column) -> Column:
    """Whole percent, halves rounded up."""
    return F.floor(score * 100 + 0.5).cast("int")


def score_text(score: Column) -> Column:
    return F.round(score, 4)
