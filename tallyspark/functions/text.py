"""Text column expressions: HTML to text, truncation, previews, title case.

All functions take and return ``Column`` objects and compile to native Spark
expressions (no Python UDF), so they stay inside whole-stage codegen.
"""

from __future__ import annotations

import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.isspace()/strip() are Unicode-aware; Java's \s is ASCII unless the
# (?U) flag is given.  Every pattern below that deals with blanks uses (?U).
_U = "(?U)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_unicode(col) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode white space.

    (Spark's ``trim`` only removes the ASCII blank.)"""
    return F.regexp_replace(_c(col), _U + r"^\s+|\s+$", "")


# Named character references decoded after tags are removed
# (those of Latin-1 and of common punctuation).
NAMED = ("nbsp lt gt quot apos iexcl cent pound curren yen brvbar sect uml copy ordf laquo not shy reg macr deg plusmn sup2 "
         "sup3 acute micro para middot cedil sup1 ordm raquo frac14 frac12 frac34 iquest times divide euro hellip ndash mdash "
         "lsquo rsquo sbquo ldquo rdquo bdquo bull trade amp").split()
HTML_ENTITIES = [(f"&{n};", " " if n == "nbsp" else html.entities.html5[n + ";"]) for n in NAMED]
_NUMBERED = r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"
_PIECES = r"(?s)(" + _NUMBERED + r"|&[A-Za-z][A-Za-z0-9]{1,7};|&|[^&]+)"


def decode_references(col) -> Column:
    """Decode named (``HTML_ENTITIES``) and numbered character references
    (``&#8377;``, ``&#x20B9;``) in one pass, so that nothing is decoded twice;
    unknown names and numbers of no valid character stay as they are."""
    names = F.create_map(*[F.lit(v) for pair in HTML_ENTITIES for v in pair])

    def one(p: Column) -> Column:
        digits = F.regexp_replace(p, "[&#xX;]", "")
        code = F.when(p.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("int")
        ok = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        number = F.when(ok, F.decode(F.unhex(F.lpad(F.hex(F.when(ok, code).otherwise(63)), 8, "0")), "UTF-32"))
        return F.when(p.startswith("&#"), F.coalesce(number, p)).when(p.startswith("&"), F.coalesce(F.element_at(names, p), p)).otherwise(p)

    return F.array_join(F.transform(F.regexp_extract_all(_c(col), F.lit(_PIECES), 1), one), "")


# Up to the end of a tag: a quoted value may hold any character, a bracket too.
_REST = r"""(?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+>"""
# One token each: a comment, a raw element with its content, a tag, a
# declaration or a broken end tag, a run of text, a bracket that opens nothing.
_TOKENS = (r"(?is)(<!--.*?(?:-->|\z)|<(script|style)(?=[\s/>])" + _REST + r".*?(?:</\2\s*+>|\z)|</?[a-z]" + _REST + r"|<[!?/][^>]*+>|[^<]++|<)")


def html_to_text(col, limit: int | None = None) -> Column:
    """HTML -> readable text (operator B1).

    One pass cuts the source into tokens.  Comments, script and style elements
    are dropped and every tag becomes a blank, also where a quoted attribute
    holds a bracket; a bracket that opens no tag is text.  Named and numbered
    character references are decoded, and runs of blanks that span a line break
    or hold two or more blanks become one blank.  The whole text is kept unless
    a caller gives a ``limit``.
    """
    token = F.regexp_extract_all(_c(col), F.lit(_TOKENS), F.lit(1))
    x = F.array_join(F.transform(token, lambda t: F.when(t.startswith("<") & (F.length(t) > 1), F.lit(" ")).otherwise(t)), "")
    x = normalize_blanks(decode_references(x))
    return F.left(x, F.lit(limit)) if limit else x


def normalize_blanks(col) -> Column:
    """Collapse every blank run that spans a line break or holds two or more
    blank characters into one blank; trim the ends."""
    x = F.regexp_replace(_c(col), _U + r"\s*[\n\r\u000B\u000C\u0085\u2028\u2029]\s*|\s{2,}", " ")
    return strip_unicode(x)


def preview(col, n: int = 200, marker: str = "...") -> Column:
    """First ``n`` characters plus a marker when the text is longer (B2)."""
    x = _c(col)
    return F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit(marker))).otherwise(x)


def truncate(col, n: int) -> Column:
    """Plain cut to ``n`` characters (B2: 100, 1200, 1500, 50)."""
    return F.left(_c(col), F.lit(n))


_MARK = "\ue000"  # private-use character used as a temporary word break


def title_case(col) -> Column:
    """Python ``str.title()`` (B5): every run of letters starts upper case and
    continues lower case; any non-letter starts a new word.

    ``initcap`` alone differs ("Mcdonald's" vs "Mcdonald'S") because it only
    breaks words at blanks; so a temporary break (mark + blank) is inserted
    after every non-letter, ``initcap`` runs, and the breaks are removed.  No
    lambda is involved, so the expression stays in generated code."""
    x = F.regexp_replace(_c(col), r"([^\p{L} ])", "$1" + _MARK + " ")
    return F.replace(F.initcap(x), F.lit(_MARK + " "), F.lit(""))


def contains_any(text, words) -> Column:
    """True when any of ``words`` occurs in ``text`` (plain substring).

    Written as an OR chain of ``contains`` (not a lambda over an array) so it
    compiles into whole-stage generated code."""
    t = _c(text)
    out = None
    for w in words:
        c = F.contains(t, F.lit(w))
        out = c if out is None else (out | c)
    return out if out is not None else F.lit(False)


def count_contained(text, words) -> Column:
    """Number of ``words`` contained in ``text`` (INT)."""
    t = _c(text)
    out = None
    for w in words:
        c = F.when(F.contains(t, F.lit(w)), F.lit(1)).otherwise(F.lit(0))
        out = c if out is None else (out + c)
    return out if out is not None else F.lit(0)


def first_contained(text, words) -> Column:
    """The first of ``words`` (in list order) that occurs in ``text``, else NULL."""
    t = _c(text)
    out = None
    for w in words:
        c = F.contains(t, F.lit(w))
        out = F.when(c, F.lit(w)) if out is None else out.when(c, F.lit(w))
    return out
