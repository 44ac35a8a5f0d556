"""Text and attributes of XML elements as column expressions.

The input is one element as text.  Everything is a regular expression over that
text, so a malformed element gives an odd value and never fails the job, and the
work stays in the JVM.  CDATA blocks have to be turned into escaped text before.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# A tag, with quoted attribute values that may hold '>'.  Possessive, so that long
# runs neither backtrack nor recurse.
_ATTRIBUTES = """[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>"""
TAG = "<" + _ATTRIBUTES
COMMENT_OR_INSTRUCTION = r"(?s)<!--.*?-->|<\?.*?\?>"
# Stands for "a tag was here"; XML forbids this character, so no text holds it.
MARK = "\u0001"

# The predefined XML entities.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
ENTITY = "^(amp|lt|gt|quot|apos|#[0-9]{1,7}|#x[0-9a-fA-F]{1,6});"


def open_tag(name: str) -> str:
    """Pattern of an opening tag whose name matches ``name``."""
    return f"<(?:{name})(?=[\\s/>]){_ATTRIBUTES}"


def _entity(piece: Column) -> Column:
    """Decode the entity that ``piece``, the text after an ampersand, starts with."""
    name = F.regexp_extract(piece, ENTITY, 1)
    digits = F.when(
        name.startswith("#x"), F.conv(F.substring(name, 3, 6), 16, 10)
    ).otherwise(F.substring(name, 2, 7))
    code = digits.try_cast("bigint")
    legal = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    char = F.when(legal, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    for entity, value in ENTITIES.items():
        char = F.when(name == entity, F.lit(value)).otherwise(char)
    rest = piece.substr(F.length(name) + 2, F.length(piece))
    return F.coalesce(
        F.when(name != "", F.concat(char, rest)), F.concat(F.lit("&"), piece)
    )


def unescape(text: Column) -> Column:
    """Decode entities and character references, each once."""
    pieces = F.split(text, "&")
    decoded = F.transform(pieces, lambda piece, i: F.when(i == 0, piece).otherwise(_entity(piece)))
    return F.when(text.contains("&"), F.array_join(decoded, "")).otherwise(text)


def escape(text: Column) -> Column:
    """Text ready to stand inside an element or a double-quoted attribute."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for entity in ("lt", "gt", "quot"):
        out = F.replace(out, F.lit(ENTITIES[entity]), F.lit(f"&{entity};"))
    return out


def element_text(element: Column) -> Column:
    """All text nodes of an element, joined by one blank and not trimmed; NULL for no element."""
    bare = F.regexp_replace(element, COMMENT_OR_INSTRUCTION, "")
    marked = F.btrim(F.regexp_replace(bare, TAG, MARK), F.lit(MARK))
    joined = F.regexp_replace(marked, MARK + "+", " ")
    return unescape(F.regexp_replace(joined, "\r\n?", "\n"))


def first_element(markup: Column, name: str) -> Column:
    """The first element of that name as text, self-closing or up to its end tag; NULL if absent."""
    opened = open_tag(name)
    found = F.regexp_extract(markup, f"(?s){opened}(?:(?<=/>)|.*?</(?:{name})\\s*>)", 0)
    return F.when(found != "", found)


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of an opening tag; NULL if absent."""
    pattern = f"""\\s{name}\\s*=\\s*(?:"([^"]*)"|'([^']*)')"""
    value = F.concat(F.regexp_extract(tag, pattern, 1), F.regexp_extract(tag, pattern, 2))
    return F.when(tag.rlike(pattern), unescape(F.regexp_replace(value, r"\s", " ")))
