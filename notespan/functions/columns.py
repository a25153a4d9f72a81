"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The namespace of deterministic ids; a setting, with a value of our own.
NAMESPACE = "5b0f2c9e-7d41-5e86-9a3f-c1d27e604b18"
#: A link raises a similarity by this.
LINK_BOOST = 1.5


def strip(c: Column) -> Column:
    """Without white space (of all of Unicode) at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def content_hash(context: Column, page: Column | None = None) -> Column:
    return F.md5(context if page is None else F.concat(page, F.lit("::"), context))


def hybrid_id(explicit: Column, context: Column, page: Column | None = None) -> Column:
    """The explicit id unless missing or empty, else a hash of the context."""
    return F.coalesce(F.when(explicit != "", explicit), content_hash(context, page))


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "utf-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def random_id() -> Column:
    """A new id for each row (version 4); write the rows before they are used twice, as each run makes others."""
    return F.uuid()


def integration_id(block: Column, page: Column, action: Column, target: Column) -> Column:
    """The same for the same decision, so that a repeated write finds its own result."""
    return uuid5(F.concat_ws(":", block, page, action, target))


def percent_encoded(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def deep_link(graph: Column, page: Column, block: Column, scheme: str = "notes") -> Column:
    """A link into the notes application; a block's wins over its page's."""
    target = F.when(block.isNotNull() & (block != ""), F.concat(F.lit("block-id="), percent_encoded(block))).otherwise(F.concat(F.lit("page="), percent_encoded(page)))
    return F.concat(F.lit(f"{scheme}://graph/"), percent_encoded(graph), F.lit("?"), target)


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def store_name(path: Column) -> Column:
    """The last part of a path and the beginning of its digest."""
    return F.concat(F.regexp_extract(path, r"([^/]*)/*$", 1), F.lit("-"), F.substring(F.sha2(path, 256), 1, 16))


def display_name(stem: Column) -> Column:
    return F.replace(stem, F.lit("___"), F.lit("/"))


def page_links(context: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(context, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1)))


def relevance(rank: Column, n: Column) -> Column:
    """Percent shown for the rank-th (from 0) of n results."""
    return F.greatest(F.lit(50), F.lit(100) - rank * F.floor(F.lit(50) / n)).cast("long")


def block_title(context: Column) -> Column:
    """The first line that is not blank, without dashes and white space before its text, at most 50 characters; without such a line, that the block is unknown."""
    first = strip(F.get(F.filter(F.split(context, "\n"), lambda x: strip(x) != ""), F.lit(0)))
    own = F.regexp_replace(first, r"^[- \t]+", "")
    return F.when(context.isNull(), F.lit(None).cast("string")).when(first.isNull(), "Unknown block").when(F.length(own) > 50, F.concat(F.substring(own, 1, 47), F.lit("..."))).otherwise(own)


def without_id_lines(context: Column) -> Column:
    return F.array_join(F.filter(F.split(context, "\n"), lambda x: ~x.rlike(r"^\s*id::\s+\S")), "\n")


def properties(lines: Column) -> Column:
    """key and value of every line that has two colons."""
    parts = lambda x: F.split(x, "::", 2)
    return F.transform(F.filter(lines, lambda x: F.contains(x, F.lit("::"))), lambda x: F.struct(strip(F.get(parts(x), F.lit(0))).alias("key"), strip(F.get(parts(x), F.lit(1))).alias("value")))


def property_value(lines: Column, key: str) -> Column:
    """The value of the first line with that key, else null."""
    return F.get(F.filter(properties(lines), lambda p: p["key"] == key), F.lit(0))["value"]


def snippet(context: Column) -> Column:
    """The bulleted lines, tabs as two spaces; (no content) if there are none."""
    own = F.filter(F.split(context, "\n"), lambda x: x.rlike(r"^\s*-"))
    return F.when(F.size(own) > 0, F.replace(F.array_join(own, "\n"), F.lit("\t"), F.lit("  "))).otherwise(F.lit("(no content)"))


def masked_key(key: Column) -> Column:
    return F.when(F.length(key) > 12, F.concat(F.substring(key, 1, 8), F.lit("..."), F.right(key, F.lit(4)))).otherwise(F.concat(F.substring(key, 1, 4), F.lit("..."), F.right(key, F.lit(4))))


def model_size(n: Column) -> Column:
    gb = F.lit(float(1 << 30))
    return F.when(n >= gb, F.format_string("%.1f GB", n / gb)).otherwise(F.format_string("%.1f MB", n / F.lit(float(1 << 20))))


def provenance(existing: Column, page: Column, block: Column) -> Column:
    """existing with one more link, unless it is there already."""
    link = F.concat(F.lit("["), page, F.lit("]((("), block, F.lit(")))"))
    return F.when(F.contains(F.coalesce(existing, F.lit("")), link), existing).otherwise(F.concat_ws(", ", F.when(existing != "", existing), link))


def provenance_links(value: Column) -> Column:
    """page and block of each link."""
    pattern = F.lit(r"\[([^\]]+)\]\(\(\(([^)]+)\)\)\)")
    return F.arrays_zip(F.regexp_extract_all(value, pattern, F.lit(1)).alias("page"), F.regexp_extract_all(value, pattern, F.lit(2)).alias("block"))


def estimated_seconds(last_seconds: Column, last_pages: Column, pages: Column) -> Column:
    """How long a build of some pages takes, by the last one; null without one."""
    return F.when(last_pages > 0, last_seconds * pages / last_pages)
