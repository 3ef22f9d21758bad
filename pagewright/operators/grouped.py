"""Operators over the ordered or optimal structure of one group: alignments, assignments, greedy passes, splits.

Each works on one page or book at a time; a group is one page's regions or one
book's pages, never a whole table.  Rows are read by an explicit order column, so results don't
depend on how they are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Alignment limits and penalties (fixed values).
GAP, MAX_PAIR_COST, FULL_CELLS, BAND = 0.52, 0.62, 250_000, 64
#: Sums of costs nearer than this may be equal but for their last bits.
TIE = 1e-12


def increasing_subset(candidates: list[tuple[int, int, float]]) -> list[int]:
    """The positions, in candidates sorted by source, of a largest subset of (source, target, weight) whose targets increase strictly.

    Of the largest ones the heaviest; of equals the one found first.  Targets are compared by a tree of
    best (size, weight) for lower ones, so the work grows as n log n.
    """
    places = {t: k + 1 for k, t in enumerate(sorted({c[1] for c in candidates}))}
    tree: list[tuple[int, float, int, int]] = [(0, 0.0, 0, -1)] * (len(places) + 1)  # size, weight, minus position, position
    best: list[tuple[int, float]] = []
    back: list[int] = []
    for i, (_, target, weight) in enumerate(candidates):
        at = places[target] - 1
        top = tree[0]
        while at:
            top = max(top, tree[at])
            at &= at - 1
        best.append((top[0] + 1, top[1] + weight))
        back.append(top[3])
        at = places[target]
        while at < len(tree):
            tree[at] = max(tree[at], (*best[i], -i, i))
            at += at & -at
    if not best:
        return []
    i, out = max(range(len(best)), key=lambda k: (best[k], -k)), []
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(n: int, m: int, cost: Callable[[np.ndarray, np.ndarray], np.ndarray], gap: float = GAP, band: int | None = None) -> list[tuple[int, int]] | None:
    """The cheapest order-preserving pairing of n rows and m columns; what is left out costs ``gap``.

    ``cost`` gives the costs of pairs of row and column numbers.  The table is filled by diagonals, of which the last two are
    kept; moves take a byte for each cell.  With a band only cells near the diagonal are used; None if
    the path comes within two cells of its edge.  Ties prefer, in order, a pair, an omitted row, an
    omitted column; with a band an omitted row, an omitted column, a pair.
    """
    width = None if band is None else max(8, band, abs(n - m) + 8)
    rows = np.arange(n + 1)
    centre = rows * m / max(n, 1)
    low = np.zeros(n + 1, np.int64) if width is None else np.maximum(0, (centre - width).astype(np.int64))
    high = np.full(n + 1, m, np.int64) if width is None else np.minimum(m, (centre + width).astype(np.int64))
    move = np.full((n + 1, int((high - low).max()) + 1), 3, np.int8)
    before, last = np.full(n + 1, np.inf), np.full(n + 1, np.inf)  # by row: two diagonals ago, and the last one
    last[0] = 0.0
    order = (0, 1, 2) if width is None else (1, 2, 0)
    for d in range(1, n + m + 1):
        i = rows[max(0, d - m) : min(n, d) + 1]
        i = i[(low[i] <= d - i) & (d - i <= high[i])]
        j = d - i
        options = np.full((3, len(i)), np.inf)
        both = (i > 0) & (j > 0)
        options[0, both] = before[i[both] - 1] + cost(i[both] - 1, j[both] - 1)
        options[1, i > 0] = last[i[i > 0] - 1] + gap
        options[2, j > 0] = last[i[j > 0]] + gap
        options = options[list(order)]
        pick = options.argmin(axis=0)
        now = np.full(n + 1, np.inf)
        now[i] = options[pick, np.arange(len(i))]
        move[i, j - low[i]] = np.array(order, np.int8)[pick]
        before, last = last, now
    if not np.isfinite(last[n]):
        return None
    i, j, out = n, m, []
    while i or j:
        if width is not None and i and j and abs(j - i * m / max(n, 1)) >= width - 2:
            return None
        step = move[i, j - low[i]]
        if step == 0:
            out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif step == 1:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def aligned(n: int, m: int, cost: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """``align`` in full, or banded for large tables (in full again where the band is too narrow)."""
    if not n or not m:
        return []
    if n * m <= FULL_CELLS:
        return align(n, m, cost)
    banded = align(n, m, cost, band=BAND)
    return align(n, m, cost) if banded is None else banded


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """An assignment of least total cost (shortest augmenting paths), each row and column used once at most."""
    if not cost.size:
        return []
    if 1 in cost.shape:
        return [tuple(int(k) for k in np.unravel_index(cost.argmin(), cost.shape))]
    if cost.shape[0] > cost.shape[1]:
        return sorted((i, j) for j, i in assign(cost.T))
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    row_of = np.zeros(m + 1, np.int64)
    for i in range(1, n + 1):
        row_of[0], at = i, 0
        least, came, done = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64), np.zeros(m + 1, bool)
        while True:
            done[at] = True
            r = row_of[at]
            free = ~done[1:]
            reduced = cost[r - 1] - u[r] - v[1:]
            better = free & (reduced < least[1:])
            least[1:][better], came[1:][better] = reduced[better], at
            nxt = int(np.where(free, least[1:], np.inf).argmin()) + 1
            delta = least[nxt]
            u[row_of[done]] += delta
            v[done] -= delta
            least[~done] -= delta
            at = nxt
            if not row_of[at]:
                break
        while at:
            row_of[at], at = row_of[came[at]], came[at]
    return sorted((int(row_of[j]) - 1, j - 1) for j in range(1, m + 1) if row_of[j])


def later_rows(cost: np.ndarray, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same least total by the later of rows that can stand for each other: where some rows get no column, equal sums (from the first row on) leave the earlier ones out."""
    held = dict(pairs)
    for r in range(cost.shape[0] - 1, -1, -1) if 0 < len(held) < cost.shape[0] else ():
        if r in held:
            continue
        rows = sorted(held)
        columns = [held[b] for b in rows]
        own = cost[rows, columns]
        step = cost[np.ix_(rows, columns)] - own  # of a row that takes another's column
        reach, came = cost[r, columns] - own, np.full(len(rows), -1)
        for _ in rows:
            through = reach[:, None] + step
            best = through.argmin(0)
            better = through.min(0) < reach - TIE
            if not better.any():
                break
            reach, came = np.where(better, through.min(0), reach), np.where(better, best, came)
        for b in np.flatnonzero(reach <= TIE):
            path = [int(b)]
            while came[path[-1]] >= 0 and len(path) <= len(rows):
                path.append(int(came[path[-1]]))
            changed = {k: v for k, v in held.items() if k != rows[b]}
            changed |= {rows[a]: columns[c] for c, a in zip(path, path[1:])} | {r: columns[path[-1]]}
            last = max(r, *(rows[k] for k in path))
            old, now = (float(np.cumsum([cost[k, x[k]] for k in sorted(x) if k <= last] or [0.0])[-1]) for x in (held, changed))
            if len(set(changed.values())) == len(held) and (now < old or (now == old and rows[b] < r)):
                held = changed
                break
    return sorted(held.items())


def box_iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of every box of a (x0, y0, x1, y1) with every box of b."""
    w = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0])
    h = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1])
    inter = np.maximum(0, w) * np.maximum(0, h)
    area = lambda x: np.maximum(0, x[:, 2] - x[:, 0]) * np.maximum(0, x[:, 3] - x[:, 1])
    union = area(a)[:, None] + area(b)[None, :] - inter
    return np.where(union > 0, inter / np.where(union > 0, union, 1), 0.0)


def greedy_keep(boxes: np.ndarray, limit: float, strict: bool) -> list[int]:
    """Boxes in order, without those that overlap one kept before by ``limit`` or more (``strict``: by more)."""
    kept: list[int] = []
    for i in range(len(boxes)):
        overlap = box_iou(boxes[i : i + 1], boxes[kept])[0] if kept else np.zeros(0)
        if not ((overlap > limit) if strict else (overlap >= limit)).any():
            kept.append(i)
    return kept


def two_groups(points: np.ndarray, improvement: float = 0.58, apart: float = 3.2, least: int = 4) -> np.ndarray:
    """A split of points into two groups by k-means from the ends of the diagonal, or one group where it doesn't pay."""
    one = np.zeros(len(points), np.int64)
    if len(points) < 10:
        return one
    along = points.sum(axis=1)
    centres = points[[along.argmin(), along.argmax()]].astype(float)
    own = one
    for _ in range(20):
        new = ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        if (new == own).all() and _:
            break
        own = new
        centres = np.array([points[own == k].mean(axis=0) if (own == k).any() else centres[k] for k in (0, 1)])
    before = ((points - points.mean(axis=0)) ** 2).sum()
    after = sum(((points[own == k] - centres[k]) ** 2).sum() for k in (0, 1))
    good = before > 0 and 1 - after / before >= improvement and (np.abs(centres[0] - centres[1]) >= apart).all() and min(np.bincount(own, minlength=2)) >= least
    return own if good else one


_BOX = ("x0", "y0", "x1", "y1")


def per_group(df: DataFrame, key: str, fn: Callable[[dict[str, np.ndarray]], list[tuple]], schema: str, order: Sequence[str] = ()) -> DataFrame:
    """``fn`` of each group's columns, in order.

    Rows are dealt and sorted by the key, and a task walks through its groups; it holds one Arrow batch and one group
    at a time, and the cost of a call is that of slicing arrays, so very many small groups are cheap.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def groups(pdf: pd.DataFrame) -> pd.DataFrame:
            columns = {c: pdf[c].to_numpy() for c in pdf.columns}
            keys = columns[key]
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)] if len(keys) else [0]
            rows = [row for lo, hi in zip(cuts, cuts[1:]) for row in fn({c: v[lo:hi] for c, v in columns.items()})]
            return pd.DataFrame(rows, columns=names).convert_dtypes()

        held: list[pd.DataFrame] = []  # pieces of the last group so far
        for pdf in batches:
            if not len(pdf):
                continue
            keys = pdf[key].to_numpy()
            if held and keys[0] != held[0][key].iloc[0]:
                yield groups(pd.concat(held, ignore_index=True))
                held = []
            first = int(np.searchsorted(keys, keys[-1]))
            if first:
                yield groups(pd.concat([*held, pdf.iloc[:first]], ignore_index=True))
                held = []
            held.append(pdf.iloc[first:])
        if held:
            yield groups(pd.concat(held, ignore_index=True))

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def _boxes(group: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([group[c] for c in _BOX], axis=1).astype(float)


def _both(source: DataFrame, target: DataFrame) -> DataFrame:
    """The rows of two sides with a column ``side``, 0 and 1."""
    return source.withColumn("side", F.lit(0)).unionByName(target.withColumn("side", F.lit(1)))


def _side(group: dict[str, np.ndarray], k: int) -> dict[str, np.ndarray]:
    own = group["side"] == k
    return {c: v[own] for c, v in group.items()}


def matched(cost: np.ndarray, overlap: np.ndarray, max_cost: float = 0.74, review: float = 0.60, split: float = 0.58, merge: float = 0.60) -> list[tuple[int, int, float, float, str]]:
    """(row, column, cost, confidence, relation) of one page: the assignment, then splits and merges in the order of the rows."""
    rows, used_columns, assigned = [], set(), set()
    for r, c in assign(cost):
        if cost[r, c] <= max_cost:
            two = np.sort(cost[r])[:2]
            margin = float(two[1] - two[0]) if len(two) > 1 else 1.0
            confidence = min(1.0, max(0.0, 1 - cost[r, c] / max_cost)) * min(1.0, max(0.45, 0.45 + margin / 0.22))
            rows.append((r, c, float(cost[r, c]), confidence, "one_to_one"))
            assigned.add(r)
            used_columns.add(c)
    for r in range(len(cost)):
        if r in assigned:
            for c in range(cost.shape[1]):
                if c not in used_columns and overlap[r, c] >= split:
                    rows.append((r, c, float(1 - overlap[r, c]), min(0.55, float(overlap[r, c]) * 0.65), "one_to_many"))
                    used_columns.add(c)
        else:
            c = int(cost[r].argmin())
            if c in used_columns and cost[r, c] <= min(max_cost, merge):
                rows.append((r, c, float(cost[r, c]), 0.48, "many_to_one"))
    return rows


def match_units(costs: DataFrame, max_cost: float = 0.74, review: float = 0.60) -> DataFrame:
    """costs (page, source, target, cost, overlap) of all pairs to the matches of each page: cost, confidence, relation, ambiguous.

    The order of a side is that of its ids.  A source is ambiguous if a match of it is split, merged or less sure than ``review``.
    """

    def page(g: dict[str, np.ndarray]) -> list[tuple]:
        sources, i = np.unique(g["source"], return_inverse=True)
        targets, j = np.unique(g["target"], return_inverse=True)
        cost, overlap = np.full((len(sources), len(targets)), 1e6), np.zeros((len(sources), len(targets)))
        cost[i, j], overlap[i, j] = g["cost"], g["overlap"]
        rows = matched(cost, overlap, max_cost, review)
        doubtful = {r for r, _, _, confidence, relation in rows if relation != "one_to_one" or confidence < review}
        return [(int(g["page"][0]), int(sources[r]), int(targets[c]), x, confidence, relation, r in doubtful) for r, c, x, confidence, relation in rows]

    return per_group(costs.select("page", "source", "target", "cost", "overlap"), "page", page, "page long, source long, target long, cost double, confidence double, relation string, ambiguous boolean")


def assigned(costs: DataFrame) -> DataFrame:
    """costs (page, source, target, cost) of all pairs to the cheapest assignment of each page (of equal ones that of the later sources), with margins over the second best of row and column."""

    def page(g: dict[str, np.ndarray]) -> list[tuple]:
        sources, i = np.unique(g["source"], return_inverse=True)
        targets, j = np.unique(g["target"], return_inverse=True)
        cost = np.full((len(sources), len(targets)), 1e6)
        cost[i, j] = g["cost"]
        second = lambda x: float(np.sort(x)[1] - np.sort(x)[0]) if len(x) > 1 else 1.0
        return [(int(g["page"][0]), int(sources[r]), int(targets[c]), float(cost[r, c]), second(cost[r]), second(cost[:, c])) for r, c in later_rows(cost, assign(cost))]

    return per_group(costs.select("page", "source", "target", "cost"), "page", page, "page long, source long, target long, cost double, row_margin double, column_margin double")


def align_pages(source: DataFrame, target: DataFrame) -> DataFrame:
    """The ordered pages (book, page, ord, value) of two editions, aligned by value and place."""

    def book(g: dict[str, np.ndarray]) -> list[tuple]:
        a, b = _side(g, 0), _side(g, 1)
        x, y = a["value"].astype(float), b["value"].astype(float)
        place = lambda n: np.arange(n) / max(1, n - 1)
        p, q = place(len(x)), place(len(y))
        cost = lambda i, j: 0.84 * np.minimum(1, np.abs(x[i] - y[j])) + 0.16 * np.abs(p[i] - q[j])
        pairs = [(i, j) for i, j in aligned(len(x), len(y), cost) if cost(i, j) <= MAX_PAIR_COST]
        name = int(g["book"][0])
        rows = [(name, int(a["page"][i]), int(b["page"][j]), float(cost(i, j)), float(np.clip(1 - cost(i, j) / MAX_PAIR_COST, 0, 1))) for i, j in pairs]
        rows += [(name, int(a["page"][i]), None, None, None) for i in sorted(set(range(len(x))) - {i for i, _ in pairs})]
        return rows + [(name, None, int(b["page"][j]), None, None) for j in sorted(set(range(len(y))) - {j for _, j in pairs})]

    columns = ["book", "page", "ord", "value"]
    return per_group(_both(source.select(columns), target.select(columns)), "book", book, "book long, source long, target long, cost double, confidence double", ["side", "ord", "page"])


def greedy_pairs(source: DataFrame, target: DataFrame, accept: float = 0.20) -> DataFrame:
    """Each target region in order takes the best source region not yet taken, if their IoU is ``accept`` or more."""

    def page(g: dict[str, np.ndarray]) -> list[tuple]:
        a, b = _side(g, 0), _side(g, 1)
        rows = []
        if len(a["rid"]) and len(b["rid"]):
            overlap = box_iou(_boxes(a), _boxes(b))
            for j in range(overlap.shape[1]):
                i = int(overlap[:, j].argmax())
                if overlap[i, j] >= accept:
                    found = float(overlap[i, j])
                    rows.append((int(g["page"][0]), int(a["rid"][i]), int(b["rid"][j]), found, min(float(a["confidence"][i]), float(b["confidence"][j]), 0.45 + 0.55 * found)))
                    overlap[i] = -1
        return rows

    columns = ["page", "rid", *_BOX, "confidence"]
    return per_group(_both(source.select(columns), target.select(columns)), "page", page, "page long, source long, target long, iou double, confidence double", ["side", "rid"])


def suppress(regions: DataFrame, limit: float = 0.62, strict: bool = False) -> DataFrame:
    """Regions by falling confidence, without those that overlap one kept before."""

    def page(g: dict[str, np.ndarray]) -> list[tuple]:
        order = np.lexsort((g["rid"], -g["confidence"]))
        kept = order[greedy_keep(_boxes(g)[order], limit, strict)]
        return [(int(g["page"][i]), int(g["rid"][i]), float(g["confidence"][i])) for i in kept]

    return per_group(regions.select("page", "rid", *_BOX, "confidence"), "page", page, "page long, rid long, confidence double")


def split_compounds(regions: DataFrame) -> DataFrame:
    """The group, 0 or 1, of every region of a page by the centres of its regions."""

    def page(g: dict[str, np.ndarray]) -> list[tuple]:
        boxes = _boxes(g)
        parts = two_groups((boxes[:, :2] + boxes[:, 2:]) / 2)
        return [(int(p), int(r), int(k)) for p, r, k in zip(g["page"], g["rid"], parts, strict=True)]

    return per_group(regions.select("page", "rid", *_BOX), "page", page, "page long, rid long, part long", ["rid"])


def monotone_anchors(pairs: DataFrame) -> DataFrame:
    """The anchors (book, source, target, how) that can stand together: as many as possible, then exact names (3) before numbers (1)."""

    def book(g: dict[str, np.ndarray]) -> list[tuple]:
        keep = increasing_subset([(s, t, 3.0 if h == "exact" else 1.0) for s, t, h in zip(g["source"], g["target"], g["how"], strict=True)])
        return [(int(g["book"][i]), int(g["source"][i]), int(g["target"][i]), g["how"][i]) for i in keep]

    return per_group(pairs.select("book", "source", "target", "how"), "book", book, "book long, source long, target long, how string", ["source", "target"])
