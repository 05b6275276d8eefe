"""Scalar functions over text columns, all built from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends that a text is split at.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
SPACE = r"(?U)\s"
ASCII_SPACE = " \t\n\x0b\x0c\r"
_DIGITS = "0123456789"


def tokens(text: Column) -> Column:
    """Runs without Unicode white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(tokens(F.coalesce(text, F.lit(""))))


def token_estimate(text: Column) -> Column:
    """A fourth of the code points, rounded down."""
    return F.floor(F.length(text) / 4).cast("int")


def strip(text: Column) -> Column:
    ends = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1)))
    return F.when(F.rlike(ends, F.lit(SPACE)), F.regexp_replace(text, r"(?U)^\s+|\s+$", "")).otherwise(text)


def has_text(text: Column) -> Column:
    """Whether anything is left of a text without its white space."""
    return F.rlike(text, F.lit(r"(?U)\S"))


def lines(text: Column) -> Column:
    """The lines of a text; a line end at its end opens no further line."""
    open_ended = F.regexp_replace(text, rf"({LINE_END})\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(open_ended, LINE_END))


def _trim(text: Column) -> Column:
    return F.btrim(text, F.lit(ASCII_SPACE))


def _is_digits(text: Column) -> Column:
    return (text != "") & (F.translate(text, _DIGITS, "") == "")


def is_page_number(line: Column) -> Column:
    """Whether a line carries a page number alone: ``Page 5``, ``5`` or ``5 of 20``, with a bar or dash in front and,
    unless it says page, behind."""
    whole = _trim(line)
    maybe = F.left(whole, F.lit(1)).isin(*_DIGITS, "|", "-", "P", "p")  # tells most lines without a look at the rest
    opened = F.when(F.left(whole, F.lit(1)).isin("|", "-"), _trim(F.substring(whole, 2, 1 << 30))).otherwise(whole)
    named = F.substring(opened, 5, 1 << 30)
    with_word = F.left(opened, F.lit(4)).isin("Page", "page") & (F.ltrim(named, F.lit(ASCII_SPACE)) != named) & _is_digits(_trim(named))
    closed = F.when(F.right(opened, F.lit(1)).isin("|", "-"), F.substring(opened, F.lit(1), F.length(opened) - 1)).otherwise(opened)
    parts = F.split(closed, "of", 3)
    own, total = _trim(F.get(parts, 0)), F.get(parts, 1)
    alone = _is_digits(own) & ((F.size(parts) == 1) | (F.size(parts) == 2) & (F.ltrim(total, F.lit(ASCII_SPACE)) != total) & _is_digits(_trim(total)))
    return maybe & (with_word | alone)


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"<[^>]+>", " ")


def quoted(text: Column) -> Column:
    """A string literal: single quotes, unless the text holds some and no double quote."""
    body = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, safe in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(raw), F.lit(safe))
    plain = F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
    double = F.concat(F.lit('"'), body, F.lit('"'))
    return F.when(F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"')), double).otherwise(plain)


def clock(seconds: Column) -> Column:
    """MM:SS of whole seconds; minutes may pass 59."""
    whole = F.floor(seconds).cast("int")
    return F.format_string("%02d:%02d", F.floor(whole / 60).cast("int"), (whole % 60).cast("int"))


def utc_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def pdf_date(raw: Column) -> Column:
    """``D:YYYYMMDDHHmmSS+HH'mm'`` as ISO 8601; null where it can't be read. Seconds may lack, and a zone that isn't
    an offset counts as UTC."""
    s = F.trim(raw)
    s = F.when(F.startswith(s, F.lit("D:")), F.substring(s, 3, 1 << 30)).otherwise(s)
    at = lambda start, size: F.substring(s, start, size)
    timed = _is_digits(at(13, 2)) & (F.length(at(13, 2)) == 2)
    zone = F.when(timed, at(15, 1 << 30)).otherwise(at(13, 1 << 30))
    hours, behind = F.substring(zone, 2, 2), F.substring(zone, 4, 1 << 30)
    minutes = F.left(F.when(F.left(behind, F.lit(1)).isin("'", ":"), F.substring(behind, 2, 1 << 30)).otherwise(behind), F.lit(2))
    is_offset = F.left(zone, F.lit(1)).isin("+", "-") & _is_digits(F.concat(hours, minutes)) & (F.length(F.concat(hours, minutes)) == 4)
    shift = F.when(is_offset, F.concat(F.left(zone, F.lit(1)), hours, F.lit(":"), minutes)).otherwise("+00:00")
    day = F.concat_ws("-", at(1, 4), at(5, 2), at(7, 2))
    clock_ = F.concat_ws(":", at(9, 2), at(11, 2), F.when(timed, at(13, 2)).otherwise("00"))
    return F.when(_is_digits(at(1, 12)) & (F.length(s) >= 12), F.concat(day, F.lit("T"), clock_, shift))


def header_date(day: Column) -> Column:
    """A date that heads a column: month and year on the first of a month at midnight, else the day."""
    first = (F.dayofmonth(day) == 1) & (F.date_format(day, "HHmmss") == "000000")
    return F.when(first, F.date_format(day, "MMM yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))


def formula(value: Column) -> Column:
    return F.when(F.startswith(value, F.lit("=")), F.concat(F.lit("[formula: "), value, F.lit("]"))).otherwise(value)


def keywords(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[,;]"), lambda x: F.trim(x)), lambda x: x != "")


def local_name(qname: Column) -> Column:
    """What follows the first colon."""
    return F.regexp_replace(qname, "^[^:]*:", "")


def strip_fence(text: Column) -> Column:
    """The body of a Markdown code fence, or the trimmed text."""
    body = strip(text)
    fenced = F.startswith(body, F.lit("```")) & F.endswith(body, F.lit("```")) & (F.length(body) >= 6)
    inner = F.substring(body, F.lit(4), F.length(body) - 6)
    inner = F.when(F.startswith(inner, F.lit("json")), F.substring(inner, 5, 1 << 30)).otherwise(inner)
    return F.when(fenced, _trim(inner)).otherwise(body)


def sql_comments_stripped(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " "))


def sql_type(text: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(text, r"\s+", " ")))


def drive_file_id(source: Column) -> Column:
    """The id in a shared-document address, or a bare id: 25 letters, digits, dashes and low lines or more."""
    run = lambda text: F.regexp_extract(text, r"^[\w-]*", 0)
    is_id = lambda text: F.length(text) >= 25
    in_path = F.filter(F.transform(F.slice(F.split(source, "/d/"), 2, 1 << 30), run), is_id)
    in_query = F.filter(F.array(run(F.try_parse_url(source, F.lit("QUERY"), F.lit("id")))), is_id)
    return F.coalesce(F.get(in_path, F.lit(0)), F.get(in_query, F.lit(0)), F.when((run(source) == source) & is_id(source), source))


def xml_sanitised(text: Column) -> Column:
    """Bare ampersands escaped, declarations and name spaces taken off."""
    name = lambda piece: F.substring_index(piece, ";", 1)
    number = lambda n: _is_digits(F.substring(n, 2, 1 << 30)) | (F.left(n, F.lit(2)) == "#x") & F.substring(n, 3, 1 << 30).rlike("^\\p{XDigit}+$")
    known = lambda p: F.contains(p, F.lit(";")) & (name(p).isin("amp", "lt", "gt", "quot", "apos") | (F.left(name(p), F.lit(1)) == "#") & number(name(p)))
    pieces = F.split(text, "&")
    rest = F.transform(F.slice(pieces, 2, 1 << 30), lambda p: F.concat(F.when(known(p), "&").otherwise("&amp;"), p))
    escaped = F.concat(F.get(pieces, F.lit(0)), F.array_join(rest, ""))
    undeclared = F.array_join(F.transform(F.split(escaped, r"<\?xml"), lambda p, i: F.when((i > 0) & F.contains(p, F.lit("?>")), F.substring_index(p, "?>", -1)).otherwise(p)), "")
    return F.regexp_replace(undeclared, r"""\s+xmlns(?::[\w.-]+)?\s*=\s*(["']).*?\1""", "")


def media_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext.isin("jpg", "jpeg"), "image/jpeg").when(ext == "gif", "image/gif").when(ext == "webp", "image/webp").otherwise("image/png")


def data_url(path: Column, content: Column) -> Column:
    """An image's bytes as a ``data:`` address, as vision models take them."""
    return F.concat(F.lit("data:"), media_type(path), F.lit(";base64,"), F.base64(content))


def percent(ratio: Column) -> Column:
    """Whole percent, half to even."""
    return F.concat(F.bround(ratio * 100, 0).cast("int").cast("string"), F.lit("%"))


def gfm_rows(text: Column) -> Column:
    """The cells of each row of a Markdown table; separators are left out, fewer than two pipe lines give none."""
    pipes = F.filter(F.transform(lines(text), lambda x: F.trim(x)), lambda x: F.startswith(x, F.lit("|")))
    cells = F.transform(pipes, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))
    body = F.filter(cells, lambda r: ~F.forall(r, lambda c: c.rlike("^:?-+:?$|^$")))
    return F.when(F.size(pipes) >= 2, body).otherwise(F.array().cast("array<array<string>>"))
