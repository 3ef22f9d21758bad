"""Expressions over single rows: boxes and frames, homographies, text, signatures.  Each is a SQL text, so that they compose."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as g
from ..plans.relation import Relation

#: Boxes in frames of their own: centre in the other box, the same place in another frame, what is covered, what is cut off at the page's edge, what a brush touches.
_inside = lambda v, a, b: f"greatest(0.0, least(1.0, ({v} - {a}) / greatest(1.0, {b} - {a})))"
_mapped = lambda v, o0, o1, n0, n1: f"({n0} + {_inside(v, o0, o1)} * greatest(1.0, {n1} - {n0}))"
_x0, _y0, _x1, _y1 = _mapped("t.x0", "t.bx0", "t.bx1", "s.bx0", "s.bx1"), _mapped("t.y0", "t.by0", "t.by1", "s.by0", "s.by1"), _mapped("t.x1", "t.bx0", "t.bx1", "s.bx0", "s.bx1"), _mapped("t.y1", "t.by0", "t.by1", "s.by0", "s.by1")
FRAMES = Relation(f"""
SELECT page, rid, round(cx, 9) AS cx, round(cy, 9) AS cy, greatest(0, CAST(floor(mx0) AS BIGINT) - pad) AS mx0, greatest(0, CAST(floor(my0) AS BIGINT) - pad) AS my0, least(800, CAST(ceil(mx1) AS BIGINT) + pad) AS mx1, least(1100, CAST(ceil(my1) AS BIGINT) + pad) AS my1, round(cover, 9) AS cover,
  cover >= 0.78 AS keeps
FROM (
  SELECT *, greatest(4, CAST(rint(least(greatest(1.0, mx1 - mx0), greatest(1.0, my1 - my0)) * 0.08) AS BIGINT)) AS pad FROM (
    SELECT t.page AS page, t.rid AS rid, ((t.x0 + t.x1) * 0.5 - t.bx0) / greatest(1.0, t.bx1 - t.bx0) AS cx, ((t.y0 + t.y1) * 0.5 - t.by0) / greatest(1.0, t.by1 - t.by0) AS cy, {_x0} AS mx0, {_y0} AS my0, {_x1} AS mx1, {_y1} AS my1,
      {g.intersection('s.', 't.')} / greatest(1.0, {g.area('t.')}) AS cover
    FROM {{target}} t JOIN {{source}} s ON s.page = t.page AND s.rid = t.rid) a
) b""")
FRAMES.other = FRAMES.sql.replace("rint(least(greatest(1.0, mx1 - mx0), greatest(1.0, my1 - my0)) * 0.08)", "round_even(least(greatest(1.0, mx1 - mx0), greatest(1.0, my1 - my0)) * 0.08, 0)")

_clamped = lambda v, top, rnd: f"greatest(0, least({top}, CAST({rnd.format(v)} AS BIGINT)))"


def _selection(rnd: str) -> str:
    """Selections as whole-pixel boxes on the page, ordered, null if narrower than two pixels; and the box a brush stroke touches."""
    x0, x1, y0, y1 = (_clamped(v, top, rnd) for v, top in (("px", 800), ("qx", 800), ("py", 1100), ("qy", 1100)))
    return f"""
SELECT page, rid, CASE WHEN x1 - x0 >= 2 AND y1 - y0 >= 2 THEN x0 END AS x0, CASE WHEN x1 - x0 >= 2 AND y1 - y0 >= 2 THEN y0 END AS y0, CASE WHEN x1 - x0 >= 2 AND y1 - y0 >= 2 THEN x1 END AS x1, CASE WHEN x1 - x0 >= 2 AND y1 - y0 >= 2 THEN y1 END AS y1,
  greatest(0, x0 - radius) AS sx0, greatest(0, y0 - radius) AS sy0, least(800, x1 + radius + 1) AS sx1, least(1100, y1 + radius + 1) AS sy1
FROM (SELECT page, rid, least({x0}, {x1}) AS x0, least({y0}, {y1}) AS y0, greatest({x0}, {x1}) AS x1, greatest({y0}, {y1}) AS y1, greatest(1, CAST({rnd.format('greatest(1, diameter) / 2.0')} AS BIGINT)) + 2 AS radius FROM {{selections}} z) q"""


SELECTIONS = Relation(_selection("rint({})"), _selection("round_even({}, 0)"))

_den = "(h20 * x + h21 * y + h22)"
_j = {"a": f"(h00 * {_den} - (h00 * x + h01 * y + h02) * h20) / ({_den} * {_den})", "b": f"(h01 * {_den} - (h00 * x + h01 * y + h02) * h21) / ({_den} * {_den})", "c": f"(h10 * {_den} - (h10 * x + h11 * y + h12) * h20) / ({_den} * {_den})", "d": f"(h11 * {_den} - (h10 * x + h11 * y + h12) * h21) / ({_den} * {_den})"}
#: What a homography does near a point: where it goes, and scale, turn and unevenness of the nearest similarity (closed form of the 2x2 singular values).
SIMILARITY = Relation(f"""
SELECT page, rid, round(tx, 9) AS tx, round(ty, 9) AS ty, round(sqrt(greatest(1e-12, abs(a * d - b * c))), 9) AS scale, round(degrees(CASE WHEN a * d - b * c >= 0 THEN atan2(c - b, a + d) ELSE atan2(c + b, a - d) END), 6) + 0.0 AS turn,
  round(abs(large - small) / greatest(1e-9, 0.5 * (large + small)), 9) AS uneven
FROM (SELECT *, (sqrt(power(a + d, 2) + power(c - b, 2)) + sqrt(power(a - d, 2) + power(b + c, 2))) / 2 AS large, abs(sqrt(power(a + d, 2) + power(c - b, 2)) - sqrt(power(a - d, 2) + power(b + c, 2))) / 2 AS small FROM (
  SELECT page, rid, (h00 * x + h01 * y + h02) / {_den} AS tx, (h10 * x + h11 * y + h12) / {_den} AS ty, {_j['a']} AS a, {_j['b']} AS b, {_j['c']} AS c, {_j['d']} AS d FROM {{points}} p WHERE abs({_den}) >= 1e-12) j) s""")

_det = "(h00 * (h11 * h22 - h12 * h21) - h01 * (h10 * h22 - h12 * h20) + h02 * (h10 * h21 - h11 * h20))"
_inverse = ["(h11 * h22 - h12 * h21)", "(h02 * h21 - h01 * h22)", "(h01 * h12 - h02 * h11)", "(h12 * h20 - h10 * h22)", "(h00 * h22 - h02 * h20)", "(h02 * h10 - h00 * h12)", "(h10 * h21 - h11 * h20)", "(h01 * h20 - h00 * h21)", "(h00 * h11 - h01 * h10)"]


def _back(x: str, y: str) -> tuple[str, str]:
    i = _inverse
    w = f"({i[6]} * {x} + {i[7]} * {y} + {i[8]})"
    return f"(({i[0]} * {x} + {i[1]} * {y} + {i[2]}) / {w})", f"(({i[3]} * {x} + {i[4]} * {y} + {i[5]}) / {w})"


_corners = [_back(x, y) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))]
#: A box of the second edition in the first one, by the inverse of the homography in closed form, in whole pixels around it.
BACK_MAPPED = Relation(
    "SELECT page, rid, " + ", ".join(f"CAST({rnd}({pick}({', '.join(c[k] for c in _corners)})) AS BIGINT) AS {name}" for name, rnd, pick, k in (("x0", "floor", "least", 0), ("y0", "floor", "least", 1), ("x1", "ceil", "greatest", 0), ("y1", "ceil", "greatest", 1)))
    + f" FROM {{boxes}} b WHERE abs({_det}) > 1e-12"
)

#: Directions of text: what is known, else the first hint, else the middle shape of the blocks, else that of the unit.
ORIENTATIONS = Relation("""
SELECT u.page AS page, u.rid AS rid, CASE WHEN u.base IN ('horizontal', 'vertical') THEN u.base WHEN b.hint IS NOT NULL THEN b.hint WHEN b.middle >= 1.30 THEN 'vertical' WHEN b.middle <= 0.78 THEN 'horizontal' WHEN (u.y1 - u.y0) / greatest(1.0, u.x1 - u.x0) >= 1.45 THEN 'vertical' ELSE 'horizontal' END AS orientation
FROM {units} u LEFT JOIN (
  SELECT page, unit, median(greatest(1.0, y1 - y0) / greatest(1.0, x1 - x0)) AS middle, max(CASE WHEN turn = 1 THEN hint END) AS hint FROM (
    SELECT k.*, row_number() OVER (PARTITION BY page, unit ORDER BY CASE WHEN hint IN ('horizontal', 'vertical') THEN 0 ELSE 1 END, rid) AS turn FROM (SELECT page, unit, rid, x0, y0, x1, y1, CASE WHEN lower(hint) IN ('horizontal', 'vertical') THEN lower(hint) END AS hint FROM {blocks} z) k) m GROUP BY page, unit
) b ON b.page = u.page AND b.unit = u.rid""")

#: Text as it is compared and laid out: has it letters or digits, is it CJK, without what stands in brackets, trimmed, a Markdown file's name, the method in a reason.
TEXTS = Relation(
    """
SELECT id, text RLIKE '(?U)[\\\\p{{L}}\\\\p{{N}}]|[\\\\u3040-\\\\u30FF\\\\u3400-\\\\u9FFF\\\\uFF66-\\\\uFF9D]' AS semantic, text RLIKE '[\\\\u3040-\\\\u30FF\\\\u3400-\\\\u9FFF]' AS cjk, trim(regexp_replace(regexp_replace(text, '\\\\s*[（(][^）)]*[）)]\\\\s*', ' '), '\\\\s+', ' ')) AS label,
  replace(replace(trim(text), concat(chr(13), chr(10)), chr(10)), chr(13), chr(10)) AS laid, lower(trim(regexp_replace(text, '\\\\s*\\\\([0-9]+\\\\)$', ''))) AS stem, CASE WHEN text LIKE 'pairing=%' THEN substring(text, 9) ELSE 'smart' END AS method, length(regexp_replace(text, '\\\\s+', '')) AS chars FROM {texts} t""",
    """
SELECT id, regexp_matches(text, '[\\p{{L}}\\p{{N}}]') AS semantic, regexp_matches(text, '[\\x{{3040}}-\\x{{30FF}}\\x{{3400}}-\\x{{9FFF}}]') AS cjk, trim(regexp_replace(regexp_replace(text, '\\s*[（(][^）)]*[）)]\\s*', ' ', 'g'), '\\s+', ' ', 'g')) AS label,
  replace(replace(trim(text), concat(chr(13), chr(10)), chr(10)), chr(13), chr(10)) AS laid, lower(trim(regexp_replace(text, '\\s*\\([0-9]+\\)$', ''))) AS stem, CASE WHEN starts_with(text, 'pairing=') THEN substring(text, 9) ELSE 'smart' END AS method, length(regexp_replace(text, '\\s+', '', 'g')) AS chars FROM {texts} t""",
)

#: Blocks of a region as one text, in order, with the least confidence.
JOINED_BLOCKS = Relation(
    "SELECT page, coalesce(array_join(transform(array_sort(collect_list(CASE WHEN trim(coalesce(text, '')) <> '' THEN struct(reading_order, id, trim(text) AS t) END)), s -> s.t), chr(10)), '') AS text, coalesce(min(CASE WHEN trim(coalesce(text, '')) <> '' THEN confidence END), 0.0) AS confidence FROM {blocks} b GROUP BY page",
    "SELECT page, coalesce(string_agg(nullif(trim(coalesce(text, '')), ''), chr(10) ORDER BY reading_order, id), '') AS text, coalesce(min(CASE WHEN trim(coalesce(text, '')) <> '' THEN confidence END), 0.0) AS confidence FROM {blocks} b GROUP BY page",
)


def _digest(json_text: str) -> tuple[str, str]:
    return f"substring(sha2({json_text}, 256), 1, 24)", f"substring(sha256({json_text}), 1, 24)"


_q = lambda name, value: f"""'"{name}":"', {value}, '"'"""
#: Signatures of files: of name, size and three samples; and of size and content.
_FILE = "concat(name, '|', CAST(octet_length(encode(content, 'UTF-8')) AS STRING), substring(content, 1, 64), CASE WHEN length(content) > 128 THEN substring(content, CAST(floor(length(content) / 2) - 32 AS INT) + 1, 64) ELSE '' END, CASE WHEN length(content) > 64 THEN substring(content, length(content) - 63, 64) ELSE '' END)"
_WHOLE = "concat(CAST(octet_length(encode(content, 'UTF-8')) AS STRING), content)"
_there = lambda t: t.replace("octet_length(encode(content, 'UTF-8'))", "octet_length(encode(content))")
FILE_SIGNATURES = Relation(f"SELECT id, {_digest(_FILE)[0]} AS signature, {_digest(_WHOLE)[0]} AS content_signature FROM {{files}} f", f"SELECT id, {_digest(_there(_FILE))[1]} AS signature, {_digest(_there(_WHOLE))[1]} AS content_signature FROM {{files}} f")

#: What of a configuration can change the result of a mode (fixed values).
SCOPES = {
    "direct_patch": ("direct_patch", "bubbles", "dual_source", "replace_translation"), "mask_replace": ("mask_replace", "bubbles", "matching", "masking"), "hybrid": ("hybrid", "ocr", "bubbles", "matching", "masking", "inpainting"),
    "reletter": ("reletter", "ocr", "bubbles", "matching", "masking", "inpainting"), "transparent_bubble_reveal": ("transparent_bubble_reveal", "bubbles"), "aligned_overlay_reveal": ("aligned_overlay_reveal", "bubbles"),
    "auto": ("direct_patch", "mask_replace", "aligned_overlay_reveal", "ocr", "bubbles", "matching", "masking", "dual_source", "replace_translation"),
}
COMMON_SCOPE = ("page_management", "pairing", "registration", "qa")
#: Limits of resources don't change a result.
UNSCOPED = ("pairing.smart_alignment_full_matrix_max_cells", "pairing.smart_alignment_band")
SCOPE_ROWS = "(SELECT * FROM (VALUES " + ", ".join(f"('{mode}', '{name}')" for mode, names in SCOPES.items() for name in (*COMMON_SCOPE, *names)) + ") AS v(mode, namespace))"
SCOPED_SETTINGS = Relation(f"SELECT r.page AS page, c.name AS name, c.value AS value FROM {{runs}} r JOIN {SCOPE_ROWS} s ON s.mode = r.mode JOIN {{settings}} c ON c.namespace = s.namespace WHERE c.name NOT IN ({', '.join(f'{chr(39)}{n}{chr(39)}' for n in UNSCOPED)})")

_SETTINGS_HERE = "array_join(transform(array_sort(collect_list(struct(name, value))), s -> concat('\"', s.name, '\":', s.value)), ',')"
_SETTINGS_THERE = "string_agg(concat('\"', name, '\":', value), ',' ORDER BY name)"


def _job(settings: str, k: int) -> str:
    body = "concat('{{\"config\":{{', coalesce(c.config, ''), '}},\"schema\":\"resume.v3\",\"source\":\"', f.source, '\",\"target\":\"', f.target, '\"}}')"
    stage = "concat('{{\"registration\":{{', coalesce(g.config, ''), '}},\"schema\":\"cache.v2\",\"source\":\"', f.source, '\",\"target\":\"', f.target, '\"}}')"
    image = "concat('{{\"config\":{{', coalesce(g.config, ''), '}},\"extra\":null,\"image\":\"', f.source, '\",\"schema\":\"cache.v2\"}}')"
    grouped = f"SELECT page, {settings} AS config FROM {{scoped}} x"
    return f"""
SELECT f.page AS page, {_digest(body)[k]} AS job, {_digest(stage)[k]} AS registration, {_digest(image)[k]} AS image FROM {{pairs}} f LEFT JOIN ({grouped} GROUP BY page) c ON c.page = f.page LEFT JOIN ({grouped} WHERE name LIKE 'registration.%' GROUP BY page) g ON g.page = f.page"""


#: The identity of a page's job (files and the settings of its mode) and of its first stages, as JSON with sorted keys, hashed.
JOB_SIGNATURES = Relation(_job(_SETTINGS_HERE, 0), _job(_SETTINGS_THERE, 1))
#: Finished pages that may be taken again: same mode, same identity or, if asked for, the same untouched files, and a result that is there.
RESUMABLE = Relation("""
SELECT p.page AS page, d.page IS NOT NULL AND (d.mode = '' OR p.mode = '' OR d.mode = p.mode) AND (d.job = s.job OR (p.lenient AND d.same_files AND NOT d.touched)) AND d.has_result AS resumes
FROM {runs} p JOIN {signatures} s ON s.page = p.page LEFT JOIN {finished} d ON d.page = p.page""")
#: The content of blocks, in order.
BLOCK_SIGNATURES = Relation(
    "SELECT page, substring(sha2(array_join(transform(array_sort(collect_list(struct(reading_order, id, concat(coalesce(text, ''), '|', CAST(CAST(rint(confidence * 10000) AS BIGINT) AS STRING), '|', kind) AS row))), s -> s.row), ';'), 256), 1, 24) AS signature FROM {blocks} b GROUP BY page",
    "SELECT page, substring(sha256(string_agg(concat(coalesce(text, ''), '|', CAST(CAST(round_even(confidence * 10000, 0) AS BIGINT) AS STRING), '|', kind), ';' ORDER BY reading_order, id)), 1, 24) AS signature FROM {blocks} b GROUP BY page",
)

FORBID_START, FORBID_END = "，。！？：；、）》】」』〉〕］｝…—～!?;:,.%）)", "（《【「『〈〔［｛(［【《"  # fixed values: what no line begins or ends with


def line_penalty(piece: str, width: float, target: float, index: int, count: int) -> float:
    """What a line of a layout costs: its distance from the width aimed at, forbidden ends, a lone character, a short last line."""
    cost = ((width - target) / max(1.0, target)) ** 2
    if piece:
        cost += 7.5 * ((piece[0] in FORBID_START) + (piece[-1] in FORBID_END))
    if count > 1:
        cost += 1.2 * (len(piece) == 1) + 0.7 * (index == count - 1 and width < target * 0.55)
    return cost


def balanced_columns(text: str, counts: list[int], most: int) -> list[int]:
    """Characters of the columns of a vertical text: no lone last one, none that begins with a closing mark, if there is room."""
    counts = [c for c in counts if c > 0]
    if sum(counts) != len(text) or not counts:
        return counts
    if len(counts) > 1 and counts[-1] == 1 and counts[-2] >= 3:
        counts[-2:] = [counts[-2] - 1, 2]
    starts = [sum(counts[:i]) for i in range(len(counts))]
    for i in range(1, len(counts)):
        if text[starts[i]] in FORBID_START and counts[i - 1] < most and counts[i] > 1:
            counts[i - 1 : i + 1] = [counts[i - 1] + 1, counts[i] - 1]
            starts[i:] = [s + 1 for s in starts[i:]]
    for i in range(len(counts) - 1, 0, -1):
        if counts[i] == 1 and counts[i - 1] >= 3 and most >= 2:
            counts[i - 1 : i + 1] = [counts[i - 1] - 1, 2]
    return counts


def page_id(path: str) -> str:
    """A page's id from its file name: letters, digits, points and dashes in their compatible forms, all else as underscores."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    stem = name.rsplit(".", 1)[0] if "." in name[1:] else name
    return re.sub(r"[^\w.-]+", "_", unicodedata.normalize("NFKC", stem)).strip("_") or "page"


@F.pandas_udf(T.StringType())
def page_ids(paths: pd.Series) -> pd.Series:
    return paths.map(page_id, na_action="ignore")


@F.pandas_udf(T.StringType())
def selection_signatures(kinds: pd.Series, boxes: pd.Series) -> pd.Series:
    """The signature of selections (kind, box of four whole numbers), "" without a box."""

    def sign(kind: str | None, box) -> str:
        if box is None or len(box) != 4:
            return ""
        data = {"schema": "region_selection.v1", "kind": (kind or "rect").strip().lower(), "bbox": [int(v) for v in box], "points": [], "snapped": False}
        return hashlib.blake2s(json.dumps(data, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode(), digest_size=12).hexdigest()

    return pd.Series([sign(k, b) for k, b in zip(kinds, boxes, strict=True)])
