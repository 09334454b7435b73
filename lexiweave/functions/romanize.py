"""Latin spellings of words in other scripts: out of a dictionary entry, or letter by letter."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiweave.functions import fixed
from lexiweave.functions.keys import trimmed

_FORMS = "array<struct<form string, tags array<string>, roman string, source string>>"


def _clean(c: Column) -> Column:
    """White space collapsed; null where nothing is left or it is too long to be one word's."""
    out = trimmed(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.length(out).between(1, fixed.ROMAN_CHARS), out)


def _tagged(tags: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.coalesce(F.lower(t).isin(*words), F.lit(False)))


def romanization(entry: Column, script: Column) -> Column:
    """The spelling that an entry (JSON) gives of its headword; null for Latin script, an unknown one, or where it gives none.

    Each script has its places to look, in order. Forms of inflection are not
    the headword's; Chinese readings count only where they are marked as
    Mandarin and as nothing else. A spelling that is too long is none.
    """
    forms = F.from_json(F.get_json_object(entry, "$.forms"), _FORMS)
    inflected = lambda f: _tagged(f["tags"], fixed.INFLECTION_TAGS) | F.coalesce(F.lower(f["source"]).isin(*fixed.INFLECTION_SOURCES), F.lit(False))
    said = lambda c: F.coalesce(c, F.lit("")) != ""
    heads = F.from_json(F.get_json_object(entry, "$.head_templates"), "array<struct<args map<string,string>>>")
    arguments = F.flatten(F.transform(heads, lambda h: F.array(*[F.try_element_at(h["args"], F.lit(k)) for k in fixed.HEAD_KEYS])))
    sounds = F.from_json(F.get_json_object(entry, "$.sounds"), "array<map<string,string>>")
    tags_of = lambda s: F.from_json(F.try_element_at(s, F.lit("tags")), "array<string>")
    mandarin = F.filter(sounds, lambda s: _tagged(tags_of(s), fixed.MANDARIN_TAGS) & ~_tagged(tags_of(s), fixed.TOPOLECT_TAGS))
    readings = F.flatten(F.transform(mandarin, lambda s: F.map_values(F.map_filter(s, lambda k, v: ~F.lower(k).isin(*fixed.SOUND_SKIP_KEYS) & said(v) & ~v.rlike(r"^[\[{]")))))
    places = {
        "forms_tagged": F.get(F.filter(forms, lambda f: _tagged(f["tags"], fixed.ROMAN_TAGS) & ~inflected(f) & said(f["form"])), F.lit(0))["form"],
        "forms_romankey": F.get(F.filter(forms, lambda f: ~inflected(f) & said(f["roman"])), F.lit(0))["roman"],
        "head_templates": F.get(F.filter(arguments, said), F.lit(0)),
        "sounds_mandarin": F.get(readings, F.lit(0)),
    }
    out = F.lit(None).cast("string")
    for name, order in fixed.ROMAN_SOURCES.items():
        out = F.when(script == name, F.coalesce(*[_clean(places[p]) for p in order])).otherwise(out)
    return out


def transliterate(value: str, script: str | None) -> str | None:
    """Latin letters of a Cyrillic or Greek word without its accents; null where any letter has none."""
    table = {"Cyrl": fixed.CYRILLIC_LETTERS, "Grek": fixed.GREEK_LETTERS}.get(script or "")
    if table is None or not value:
        return None
    out = []
    for c in value:
        if unicodedata.category(c) == "Mn":
            continue
        parts = unicodedata.normalize("NFD", c)
        # a letter of its own before the letter that it is composed of
        known = c if c.lower() in table else parts[0] if all(unicodedata.category(m) == "Mn" for m in parts[1:]) else c
        latin = table.get(known.lower())
        if latin is not None:
            out.append(latin.title() if known.isupper() else latin)
        elif c.isalpha():
            return None
        else:
            out.append(c)
    text = " ".join("".join(out).split())
    return text if 0 < len(text) <= fixed.ROMAN_CHARS else None


@F.pandas_udf(T.StringType())
def romanized(value: pd.Series, script: pd.Series) -> pd.Series:
    """transliterate of each word."""
    return pd.Series([None if v is None else transliterate(v, g) for v, g in zip(value, script, strict=True)], dtype="object")
