"""Column functions on paths, text and sizes. All of them are built-in expressions and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space: not what ``trim`` removes (blanks), and not what Python's ``strip`` removes (also U+001C-1F).
BLANK = r"\p{IsWhite_Space}"
#: The same for Python's ``strip``.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: MIME types by extension.
MIME_TYPES = {".md": "text/markdown", ".markdown": "text/markdown", ".html": "text/html", ".htm": "text/html", ".txt": "text/plain", ".pdf": "application/pdf"}
OTHER_MIME = "application/octet-stream"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def is_blank(text: Column) -> Column:
    return text.rlike(f"^{BLANK}*$")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """From the last dot of the last element on, '' if it has none."""
    return F.regexp_extract(base_name(path), r"\.[^.]*$", 0)


def title(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def directory(path: Column) -> Column:
    parent = F.regexp_replace(path, r"/[^/]*$", "")
    return F.when(~path.contains("/"), ".").when(parent == "", "/").otherwise(parent)


def mime_type(path: Column) -> Column:
    found = F.lit(OTHER_MIME)
    for suffix, mime in MIME_TYPES.items():
        found = F.when(F.lower(extension(path)) == suffix, mime).otherwise(found)
    return found


def normalize_path(path: Column, base: str = "/") -> Column:
    """Absolute and clean: no '.', '..', doubled or trailing slashes. ``base`` is where relative paths start."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))
    parts = F.filter(F.split(whole, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def local_path(uri: Column) -> Column:
    """A file URI as a plain path; other URIs stay."""
    return F.regexp_replace(uri, r"^file:/+", "/")


def content_hash(content: Column) -> Column:
    """Lower-case hex SHA-256 of raw bytes."""
    return F.sha2(content, 256)


def text_hash(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def plain_text(content: Column) -> Column:
    return F.make_valid_utf8(content.cast("string"))


def markdown_text(text: Column) -> Column:
    """Front matter, fences, bold, italic, code and heading marks go, in this order; then the ends are trimmed."""
    out = F.regexp_replace(text, r"(?sd)^---\n.*?\n---\n?", "")
    out = F.regexp_replace(out, r"(?md)^```[^\n]*\n?", "")
    for marks in (r"(?d)\*\*(.+?)\*\*", r"(?d)_(.+?)_", r"(?d)`(.+?)`"):
        out = F.regexp_replace(out, marks, "$1")
    return strip(F.regexp_replace(out, r"(?md)^#{1,6}[\t\n\f\r ]+", ""))


def count_tokens(text: Column) -> Column:
    """A quarter of the UTF-8 bytes."""
    return F.floor(F.octet_length(text) / 4).cast("int")


def citation(path: Column, chunk_index: Column) -> Column:
    return F.format_string("%s §%d", path, chunk_index)


def preview(text: Column, n: int) -> Column:
    """The first ``n`` code points, with three dots if there are more."""
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def strip_control(text: Column) -> Column:
    """Without control characters, but for line ends and tabs."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F\x7F\x{80}-\x{9F}]", "")


def human_bytes(n: Column) -> Column:
    """MB from 2^20, KB from 2^10, bytes below; halves are rounded to the even digit."""
    tenths = lambda unit: F.bround(n / unit, 1)
    return F.when(n >= 1 << 20, F.format_string("%.1f MB", tenths(1 << 20))).when(n >= 1 << 10, F.format_string("%.1f KB", tenths(1 << 10))).otherwise(F.format_string("%d B", n))


def percent(part: Column, whole: Column) -> Column:
    """Whole per cents, 0 % of nothing."""
    return F.when(whole == 0, "0%").otherwise(F.concat(F.floor(part * 100 / whole).cast("string"), F.lit("%")))


def parse_pair(pair: str, empty_key: bool = True) -> tuple[str, str]:
    """``key=value`` at the first '='. ``empty_key=False`` refuses an empty key."""
    key, equals, value = pair.partition("=")
    if not equals or not (key or empty_key):
        raise ValueError(f"not a key=value pair: {pair!r}")
    return key, value


def split_pair(pair: Column) -> Column:
    """The same for a column: a struct of key and value, null without '='."""
    parts = F.split(pair, "=", 2)
    return F.when(F.size(parts) == 2, F.struct(parts[0].alias("key"), F.get(parts, F.lit(1)).alias("value")))
