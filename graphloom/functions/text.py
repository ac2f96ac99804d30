"""Column functions on names, identifiers and free text. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions import vocabulary as V


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """White space as single spaces, none at the ends; null if nothing is left."""
    return F.nullif(strip(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def sql_identifier(c: Column) -> Column:
    """Without brackets or double quotes and without spaces around dots."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"\s*\.\s*", "."), r"[\[\]\"]", ""))


def plain_identifier(c: Column) -> Column:
    """Also without quotes; null becomes the empty string."""
    bare = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"""[\[\]`"']""", "")
    return strip(F.regexp_replace(F.regexp_replace(bare, r"\s*\.\s*", "."), r"\s+", " "))


def normalised_name(c: Column) -> Column:
    """The key under which names of different systems meet: lower case, one prefix off, runs of other characters as one underscore."""
    bare = F.regexp_replace(strip(F.lower(F.coalesce(c, F.lit("")))), f"^(?:{'|'.join(V.NAME_PREFIXES)})", "")
    return F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def _by_synonym(key: Column, types: dict[str, tuple[str, ...]], default: str) -> Column:
    pairs = [F.lit(x) for kind, names in types.items() for n in names for x in (n, kind)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def relationship_type(c: Column) -> Column:
    return _by_synonym(F.translate(strip(F.lower(F.coalesce(c, F.lit("")))), " -", "__"), V.RELATIONSHIP_TYPES, "USES")


def entity_type(c: Column) -> Column:
    return _by_synonym(F.translate(strip(F.lower(F.coalesce(c, F.lit("")))), " ", "_"), V.ENTITY_TYPES, "TABLE")


def node_label(c: Column) -> Column:
    return F.when(F.lower(c).isin(*V.NODE_LABELS), F.initcap(F.lower(c))).otherwise("Entity")


def edge_type(c: Column) -> Column:
    return F.upper(F.replace(c, F.lit(" "), F.lit("_")))


def parsed_id(c: Column) -> tuple[Column, Column]:
    """Type and name of an id ``TYPE:name``; without a colon the type is Entity."""
    at = F.instr(c, ":")
    return F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise("Entity"), F.when(at > 0, F.substring(c, at + 1, F.length(c))).otherwise(c)


def display_label(c: Column) -> Column:
    last = F.substring_index(c, ":", -1)
    return F.when(F.length(last) > 22, F.concat(F.substring(last, 1, 20), F.lit("..."))).otherwise(last)


def line_number(text: Column, position: Column) -> Column:
    """Line of a zero-based position."""
    before = F.substring(text, F.lit(1), position.cast("int"))
    return (F.length(before) - F.length(F.translate(before, "\n", "")) + 1).cast("int")


def without_comments(c: Column) -> Column:
    """SQL without comments; a block comment leaves its line breaks, so line numbers stay true. Literals and quoted names are left alone."""
    pieces = F.regexp_extract_all(c, F.lit(r"""(?s)'[^']*+'|"[^"]*+"|\[[^\]]*+\]|--[^\n]*+|/\*.*?\*/|[^'"\[/-]++|."""), F.lit(0))
    plain = F.transform(pieces, lambda x: F.when(x.startswith("--"), "").when(x.startswith("/*") & x.endswith("*/") & (F.length(x) > 3), F.concat(F.lit(" "), F.regexp_replace(x, r"[^\n]", ""))).otherwise(x))
    return F.array_join(plain, "")


def terms(question: Column) -> Column:
    """Words of a question that say what it is after, in order; with none, those that are not quite empty."""
    words = F.regexp_extract_all(F.lower(question), F.lit(r"[A-Za-z0-9_\-]+"), F.lit(0))
    long = F.filter(words, lambda w: F.length(w) >= 3)
    some = F.filter(long, lambda w: ~w.isin(*V.STOP_TERMS))
    return F.when(F.size(some) > 0, some).otherwise(F.filter(long, lambda w: ~w.isin(*V.BASIC_STOP_TERMS)))


def intent(question: Column) -> Column:
    low = strip(F.lower(F.coalesce(question, F.lit(""))))
    out = F
    for kind, words in V.INTENTS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = out.when(hit, kind)
    return out.otherwise("semantic")


def file_names(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"(?i)({V.FILE_NAME})"), F.lit(1))


def content_key(c: Column) -> Column:
    """First 12 hex digits of the SHA-256 of the text with plain line ends."""
    return F.substring(F.sha2(F.replace(c, F.lit("\r\n"), F.lit("\n")).cast("binary"), 256), 1, 12)


def point_id(c: Column) -> Column:
    """Version 5 UUID of a name in the DNS namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8")), F.encode(c, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    s = lambda a, n: F.substring(h, a, n)
    return F.concat(s(1, 8), F.lit("-"), s(9, 4), F.lit("-5"), s(14, 3), F.lit("-"), variant, s(18, 3), F.lit("-"), s(21, 12))


def confidence_percent(c: Column) -> Column:
    """Shares as per cent with one decimal; what is no number counts as 70."""
    n = F.expr("try_cast(__c AS double)") if isinstance(c, str) else c.try_cast("double")
    return F.coalesce(F.bround(F.when(n <= 1.0, n * 100).otherwise(n), 1), F.lit(70.0))


def without_bullet(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s*•\-]+", "")


def flow_steps(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\s*(?:→|-->|->)\s*", -1), strip), lambda x: x != "")


def suffix_of(file_name: Column) -> Column:
    """Extension with its dot, in lower case; empty without one."""
    return F.lower(F.regexp_extract(file_name, r"[^./](\.[^./]+)$", 1))


def source_type(file_name: Column) -> Column:
    pairs = [F.lit(x) for k, v in V.EXTENSIONS.items() for x in (k, v)]
    return F.try_element_at(F.create_map(*pairs), suffix_of(file_name))


def chunk_source_type(file_name: Column) -> Column:
    pairs = [F.lit(x) for k, v in V.CHUNK_EXTENSIONS.items() for x in (k, v)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), suffix_of(file_name)), F.lit("unknown"))


def answer_section(answer: Column, name: str) -> Column:
    """Text of a section: from the end of its header to the next header of any kind; null without the header."""
    mark = r"(?:###\s*|\*\*\s*)?"
    head = lambda p: rf"(?:^|\n)[ \t]*{mark}{p}(?:\s*\*\*)?\s*:?\s*?(?:\n|$|(?<=:))"
    following = "|".join(V.SECTION_HEADERS.values())
    pattern = rf"(?si){head(V.SECTION_HEADERS[name])}(.*?)(?=(?:{head(f'(?:{following})')})|\z)"
    found = F.regexp_extract_all(answer, F.lit(pattern), F.lit(1))
    return strip(F.element_at(F.when(F.size(found) > 0, found), 1))
