"""Web pages: links and marked attributes, taken from the HTML inside the page's own row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Patterns stay in the subset that Java and RE2 read alike. White space of HTML.
SPACE = r" \t\n\f\r"

# Elements whose inside is text, not tags.
TEXT_ELEMENTS = ("script", "style", "textarea", "title")

# What holds no tags: comments and text elements, from the left, up to the end if they are open.
SKIPPED = "(?is)<(?:" + "|".join([r"!--.*?(?:-->|\z)"] + [
    rf"{name}(?:[{SPACE}/][^>]*)?>.*?(?:</{name}[{SPACE}/>]|\z)" for name in TEXT_ELEMENTS]) + ")"

# A value has double, single or no quotes; in one without, a quote is a character like others.
VALUE = rf"""(?:"[^"]*"|'[^']*'|[^{SPACE}"'>][^{SPACE}>]*)"""

# One attribute: its name, and its value in the group of its kind of quotes.
ATTRIBUTE = rf"""([^{SPACE}/>"'=][^{SPACE}/>"'=]*)(?:[{SPACE}]*=[{SPACE}]*(?:"([^"]*)"|'([^']*)'|([^{SPACE}"'>][^{SPACE}>]*)))?"""

# A full address starts with a scheme.
SCHEME = "^[a-zA-Z][a-zA-Z0-9+.-]*:"

# Character references by number, and the fixed values of those by name, the ampersand last.
NUMBERED = "&#([xX][0-9a-fA-F]+|[0-9]+);?"
ENTITIES = (("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def tag_pattern(name: str) -> str:
    """Opening tags of an element; a ``>`` inside a quoted value does not end one."""
    return rf"""(?i)<{name}(?:[{SPACE}/][^>"'=]*(?:=[{SPACE}]*{VALUE}[^>"'=]*)*(?:=[{SPACE}]*)?)?>"""


def opening_tags(html: str | Column, name: str) -> Column:
    """The opening tags of an element, in order, outside comments and text elements."""
    markup = F.regexp_replace(html, SKIPPED, " ")
    return F.regexp_extract_all(markup, F.lit(tag_pattern(name)), F.lit(0))


def _character(code: Column) -> Column:
    """The character of a reference ``x2F`` or ``47``; one that does not exist is U+FFFD."""
    return _bind(F.regexp_replace(F.lower(code), "^(x?)0+(.)", "$1$2"), _numbered)


def _numbered(digits: Column) -> Column:
    number = F.when(F.startswith(digits, F.lit("x")), F.conv(F.substring(digits, F.lit(2), F.lit(8)), 16, 10)).otherwise(
        F.substring(digits, F.lit(1), F.lit(8))).cast("long")
    return _bind(number, lambda n: F.when(
        (F.length(digits) <= 8) & (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF),
        F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).when(digits.isNotNull(), "�"))


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def decode_entities(value: Column) -> Column:
    """The text with its character references written out, those by number first."""
    def written(text: Column) -> Column:
        codes = F.regexp_extract_all(text, F.lit(NUMBERED), F.lit(1))
        pieces = F.split(text, NUMBERED, -1)
        pairs = F.arrays_zip(pieces.alias("piece"), codes.alias("code"))
        return F.when(F.contains(text, F.lit("&#")), F.array_join(F.transform(pairs, lambda p: F.concat(
            p.getField("piece"), F.coalesce(_bind(p.getField("code"), _character), F.lit("")))), "")).otherwise(text)

    value = _bind(value, written)
    for entity, char in ENTITIES:
        value = F.replace(value, F.lit(entity), F.lit(char))
    return value


def attribute_value(tag: str | Column, name: str) -> Column:
    """Value of the first attribute of that name of a tag, null if the tag has none.

    The tag is read attribute by attribute, so a name inside another's value is none.
    """
    fields = F.arrays_zip(*[F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(number)).alias(f"g{number}") for number in (1, 2, 3, 4)])
    named = F.filter(fields, lambda a: F.lower(a.getField("g1")) == name.lower())
    return decode_entities(_bind(F.get(named, F.lit(0)), lambda a: F.concat(*[a.getField(f"g{n}") for n in (2, 3, 4)])))


def absolute_link(href: Column, base_url: str) -> Column:
    """The base in front of a relative link; a full address stays as it is."""
    return F.when(href.rlike(SCHEME), href).otherwise(F.concat(F.lit(base_url), href))


def extract_page_links(
    pages: DataFrame, base_url: str, css_class: str | None = None,
    key: str = "page_id", html: str = "html",
) -> DataFrame:
    """Distinct links of each page with the number of times they occur.

    Links in comments, scripts and other text are none. A null page has no links.
    """
    tag = pages.select(key, F.explode_outer(opening_tags(html, "a")).alias("tag"))
    if css_class is not None:
        # One word is one class among those of the tag; several words are the whole attribute.
        value = attribute_value("tag", "class")
        tag = tag.where((value == css_class) | F.array_contains(F.split(value, rf"[{SPACE}]+"), css_class))
    found = tag.select(key, attribute_value("tag", "href").alias("href")).where("href IS NOT NULL")
    return found.select(key, absolute_link(F.col("href"), base_url).alias("link")).groupBy(key, "link").agg(F.count("*").alias("n"))


def extract_page_attribute(
    pages: DataFrame, tag: str, attribute: str, marker: tuple[str, str] | None = None,
    key: str = "page_id", html: str = "html",
) -> DataFrame:
    """Attribute of the last matching tag of each page, null where there is none.

    ``marker`` is an (attribute, value) that the tag must also carry.
    """
    values = F.transform(opening_tags(html, tag), lambda t: F.struct(
        attribute_value(t, attribute).alias("value"),
        (F.lit(True) if marker is None else attribute_value(t, marker[0]).eqNullSafe(F.lit(marker[1]))).alias("marked")))
    found = F.filter(values, lambda v: v.getField("value").isNotNull() & v.getField("marked"))
    return pages.select(key, F.try_element_at(found, F.lit(-1)).getField("value").alias(attribute.replace("-", "_")))
