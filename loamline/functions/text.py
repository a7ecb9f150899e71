"""Text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\x00"
#: Phrases that mark a question about lineage or impact.
TRACING = r"(?i)\b(trace|traced|tracing|derive|derived|derivation|lineage|depends? on|dependency|dependencies|impact|breaks? if|affects?|affected by|where does .* come from|what references|downstream|upstream)\b"


def without_nul(text: Column) -> Column:
    return F.replace(text, F.lit(NUL), F.lit(""))


def collapsed(text: Column) -> Column:
    """White space runs become one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"[\s ]+", " "), "^ | $", "")


def fingerprint(text: Column) -> Column:
    """SHA-256 of the text without NUL, trimmed, in lower case, white space collapsed; null for null and for nothing."""
    plain = collapsed(F.lower(without_nul(text)))
    return F.when(plain != "", F.sha2(plain, 256))


#: Names of characters, as the standard library has them; no-break spaces are plain ones here.
NAMED = {name: chr(code) for name, code in name2codepoint.items()} | {"nbsp": " ", "apos": "'"}
REFERENCE = r"(&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});)"


def character(reference: Column) -> Column:
    """The character that a reference stands for; unknown ones stay as they are."""
    body = F.regexp_replace(reference, r"^&#?[xX]?|;$", "")
    code = F.when(reference.rlike("^&#[xX]"), F.conv(body, 16, 10)).when(reference.startswith("&#"), body).cast("bigint")
    known = F.when((code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    table = F.create_map(*(F.lit(x) for pair in NAMED.items() for x in pair))
    name = F.regexp_replace(reference, "^&|;$", "")
    return F.coalesce(F.when(code.isNotNull(), F.when(code == 160, " ").otherwise(known)).otherwise(F.try_element_at(table, name)), reference)


def with_characters(text: Column) -> Column:
    """Character references, by number or name, as characters; each is read once."""
    pieces, references = F.split(text, REFERENCE, -1), F.regexp_extract_all(text, F.lit(REFERENCE), 1)
    decoded = F.zip_with(pieces, references, lambda p, r: F.concat(p, F.when(r.isNull(), "").otherwise(character(r))))
    return F.when(F.contains(text, F.lit("&")), F.array_join(decoded, "")).otherwise(text)


def html_to_text(html: Column) -> Column:
    """Plain text of markup: scripts and styles go, block tags become line ends, character references are decoded."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>|</(p|div|li|ul|ol|tr|table|h[1-6]|article|section|nav|footer|header|title|blockquote)\s*>", "\n")
    text = with_characters(F.regexp_replace(text, r"<[^>]*>", ""))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[ \t\r\f\x0B]+", " "), r" ?\n[ \n]*", "\n"), r"^\s+|\s+$", "")


def is_tracing(question: Column) -> Column:
    return F.coalesce(question, F.lit("")).rlike(TRACING)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double; null where one has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and all letters beyond ASCII, verbatim."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda x: x != "")
