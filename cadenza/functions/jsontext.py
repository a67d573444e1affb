"""Profiles out of text that holds, or only resembles, a JSON object."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.functions import vocabulary as v


def _values(raw: Column) -> Column:
    """A JSON value as a list: an array's elements, or the one value; null for none."""
    several = F.from_json(raw, "array<string>")
    return F.when(raw.isNull(), None).when(F.substring(F.ltrim(raw), 1, 1) == "[", several).otherwise(F.array(raw))


def _from_object(text: Column) -> dict[str, Column]:
    out = {}
    for k in v.KEYS:
        raw = F.get_json_object(text, f"$.{k}")
        out[k] = _values(raw) if k in v.LIST_KEYS else raw
    return out


def _from_lines(text: Column) -> dict[str, Column]:
    """`key: value` or `key = value` lines; of a key's lines the last counts. A value is a literal, or text."""
    out = {}
    bare = F.regexp_replace(text, r"(?m)^[ \t`]+", "")
    for k in v.KEYS:
        found = F.element_at(F.regexp_extract_all(bare, F.lit(rf"(?m)^{k}\s*[:=][ \t]*(\S[^\r\n]*)$"), F.lit(1)), -1)
        value = F.regexp_replace(F.when(F.size(F.regexp_extract_all(bare, F.lit(rf"(?m)^{k}\s*[:=][ \t]*(\S[^\r\n]*)$"), F.lit(1))) > 0, found), r"[\s,`]+$", "")
        plain = F.regexp_replace(value, "^[\"']+|[\"']+$", "")
        if k in v.LIST_KEYS:
            quoted = F.regexp_extract_all(value, F.lit("[\"']([^\"']*)[\"']"), F.lit(1))
            out[k] = F.when(value.startswith("["), quoted).when(value.isNotNull(), F.array(plain))
        else:
            out[k] = plain
    return out


def profile_of_text(text: Column) -> Column:
    """A struct of the nine keys, each null where the text doesn't say it: from the whole text as JSON (an array or
    a number says nothing), else from its longest part in braces, else from lines that assign the keys."""
    text = F.trim(F.coalesce(text, F.lit("")))
    whole = F.try_parse_json(text)
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    is_object = whole.isNotNull() & text.startswith("{")
    part = F.when(is_object, text).when(whole.isNull() & (inner != "") & F.try_parse_json(inner).isNotNull() & ~inner.rlike(r"^\{\s*\}$"), inner)
    by_object, by_line = _from_object(part), _from_lines(text)
    nothing = whole.isNotNull() & ~is_object
    return F.struct(*(F.when(part.isNotNull(), by_object[k]).when(~nothing, by_line[k]).alias(k) for k in v.KEYS))
