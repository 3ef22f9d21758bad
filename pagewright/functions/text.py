"""Text functions: page names and keys, joins of text fragments, reasons.

Functions named ``*_sql`` return SQL text.  Unicode normalisation and case folding have no SQL
function; ``normal_stem`` is an Arrow-batched UDF for them.
"""

from __future__ import annotations

import os
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Name endings that tell editions apart (fixed values).
ROLES = ("cn", "zh", "zhcn", "chs", "sc", "translated", "translation", "汉化", "漢化", "中文", "jp", "ja", "jpn", "raw", "original", "原版", "日文", "日本語")
KEY_CHARS = "0-9a-z぀-ヿ㐀-鿿"
CJK = "぀-ヿ㐀-鿿"

_copies = re.compile(r"(?:\s*(?:\(\s*\d+\s*\)|\[\s*\d+\s*\]))+$")
_roles = re.compile(r"(?:[\s._-]*(?:" + "|".join(sorted(ROLES, key=len, reverse=True)) + r"))+$", re.I)


def stem_of(path: str | None) -> str | None:
    """The comparable part of a page's name: no folder, extension, copy number or edition; "" if nothing is left."""
    if path is None:
        return None
    name = unicodedata.normalize("NFKC", os.path.splitext(os.path.basename(path.rstrip("/")))[0]).strip().casefold()
    return _roles.sub("", _copies.sub("", name).strip()).strip(" ._-")


@F.pandas_udf(T.StringType())
def normal_stem(paths: pd.Series) -> pd.Series:
    return paths.map(stem_of, na_action="ignore")


def name_key(stem: Column) -> Column:
    """Digits, Latin letters and CJK of a stem; separators and punctuation don't count."""
    return F.regexp_replace(stem, f"[^{KEY_CHARS}]+", "")


def number_key(stem: Column) -> Column:
    """The last run of digits as a number without leading zeros, or null."""
    last = F.regexp_extract(stem, r"(?U)(\d+)\D*$", 1)
    return F.when(last != "", F.when(F.regexp_replace(last, "^0+", "") == "", F.lit("0")).otherwise(F.regexp_replace(last, "^0+", "")))


def page_path_sql(url: str) -> str:
    """A page address without scheme, query and fragment."""
    return f"regexp_replace(regexp_replace({url}, '[?#].*$', ''), '/+$', '')"


def padded_sql(name: str, width: int = 12) -> str:
    """A sort key in which runs of digits compare as numbers (Spark)."""
    pieces = f"regexp_extract_all(lower({name}), '([0-9]+|[^0-9]+)', 1)"
    return f"array_join(transform({pieces}, p -> CASE WHEN p RLIKE '^[0-9]' THEN lpad(p, greatest({width}, length(p)), '0') ELSE p END), '')"


def squeezed_len_sql(text: str) -> str:
    return f"length(regexp_replace({text}, '\\\\s+', ''))"


def cjk_share(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[^{CJK}]", "")) / F.greatest(F.length(text), F.lit(1))


def joined(fragments: Column) -> Column:
    """Fragments without blank ones, joined without a space if a quarter of their characters is CJK, else by spaces."""
    kept = F.filter(F.transform(fragments, lambda f: F.trim(f)), lambda f: F.length(f) > 0)
    run = F.array_join(kept, "")
    return F.when(cjk_share(run) >= 0.25, run).otherwise(F.array_join(kept, " "))


def reason_value(reasons: Column, key: str, default: float = 0.0) -> Column:
    """The number in the first reason ``key=number``; the default where there is none, or no number."""
    hits = F.filter(reasons, lambda r: r.startswith(f"{key}="))
    return F.coalesce(F.get(F.transform(hits, lambda r: F.substring_index(r, "=", -1).try_cast("double")), F.lit(0)), F.lit(default))


def cleaned(text: Column) -> Column:
    """Line ends made equal, lines trimmed, runs of empty lines cut to one."""
    lines = F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n"), lambda x: F.regexp_replace(x, r"^[\s　]+|[\s　]+$", ""))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def region_text(texts: Column, vertical: bool = False) -> Column:
    """Recognised lines of one region, in order: spaces out, repeats out, joined; repeated punctuation becomes one."""
    values = F.transform(texts, lambda t: F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(t, F.lit("")), "\r\n?", "\n"), "[ \t　]+", "")))
    compact = lambda v: F.regexp_replace(v, r"\s+", "")
    values = F.filter(values, lambda v: compact(v) != "")
    # Of equal texts the first stays, whichever way they are broken into lines.
    keys = F.transform(values, compact)
    kept = F.filter(F.transform(values, lambda v, i: F.struct(v.alias("v"), (F.array_position(keys, compact(v)) == i + 1).alias("first"))), lambda s: s["first"])
    kept = F.transform(kept, lambda s: s["v"])
    run = F.array_join(F.transform(kept, lambda v: F.replace(v, F.lit("\n"), F.lit(""))), "") if vertical else F.array_join(kept, "\n")
    return F.trim(F.regexp_replace(run, "([，。！？：；、])\\1+", "$1"))


#: Marks that end a phrase or stay with it, and particles that end one or lean on the one before (fixed values).
_ENDS, _CLOSES, _LEANS, _PARTICLES = set("，。！？；：、…,.!?;:"), set("）】》」』〉〕］｝"), set("的吗呢吧啊呀啦哦嘛呗哇"), set("的了着过给和与及并而但却就再又还才都也把被向对从让比跟")


def split_phrases(text: str | None) -> list[str]:
    """CJK text in phrases: after marks, after particles and before marks from two characters on, and after four characters.

    A single particle or closing mark stays with the phrase before it.
    """
    units: list[str] = []
    now = ""
    text = (text or "").replace("\n", "")
    for i, c in enumerate(text):
        now += c
        follows = text[i + 1 : i + 2]
        if c in _ENDS or c in _CLOSES or (len(now) >= 2 and (c in _PARTICLES or follows in _ENDS and follows)) or (len(now) >= 4 and follows):
            units.append(now)
            now = ""
    if now:
        units.append(now)
    out: list[str] = []
    for k, u in enumerate(units):
        leans = len(u) == 1 and (u in _LEANS or (u in _CLOSES and not (k == len(units) - 1 and u == now)))
        if out and leans:
            out[-1] += u
        else:
            out.append(u)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def phrases(texts: pd.Series) -> pd.Series:
    return texts.map(split_phrases, na_action=None)
