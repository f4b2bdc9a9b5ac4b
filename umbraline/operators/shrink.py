"""Boxes trimmed to their text by the colours under their corners."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.functions import pandas_udf

#: Squared distance of text and background colours below which nothing can be told apart.
LEAST_CONTRAST = 192
SMALLEST = 2
# Why trimming ended (or never began).
NO_COLOURS, TOO_CLOSE, TOO_SMALL, DEGENERATE, CAPPED, CLEAR = "no_colors", "colors_too_close", "too_small", "degenerate", "cap_reached", "no_violation"


def _papers(image: np.ndarray, box: tuple[int, int, int, int], radius: int, ink: np.ndarray, paper: np.ndarray):
    """Says of a pixel of the box whether the rounded mean colour around it is nearer to the background than to the text.

    Sums over all rectangles from the corner give each mean in constant time.  Means only reach
    as far as the image does, so pixels further outside are like the last ones of theirs.
    """
    x, y, w, h = box

    def reach(start: int, length: int, size: int) -> tuple[int, int, np.ndarray, np.ndarray]:
        low, high = (min(max(p, -radius), size - 1 + radius) for p in (start, start + length - 1))
        at = np.arange(low, high + 1)
        return low, high, np.clip(at - radius, 0, size - 1), np.clip(at + radius, 0, size - 1) + 1

    top, bottom, y0, y1 = reach(y, h, image.shape[0])
    left, right, x0, x1 = reach(x, w, image.shape[1])
    sums = np.zeros((y1[-1] - y0[0] + 1, x1[-1] - x0[0] + 1, 3), np.int64)
    sums[1:, 1:] = image[y0[0] : y1[-1], x0[0] : x1[-1]].astype(np.int64).cumsum(0).cumsum(1)
    y0, y1, x0, x1 = y0 - y0[0], y1 - y0[0], x0 - x0[0], x1 - x0[0]
    inside = sums[np.ix_(y1, x1)] - sums[np.ix_(y0, x1)] - sums[np.ix_(y1, x0)] + sums[np.ix_(y0, x0)]
    colour = np.floor(inside / ((y1 - y0)[:, None] * (x1 - x0))[:, :, None] + 0.5)
    nearer = (((colour - paper) ** 2).sum(2) < ((colour - ink) ** 2).sum(2)).tolist()
    return lambda px, py: nearer[min(max(py, top), bottom) - top][min(max(px, left), right) - left]


def shrunk(image: np.ndarray, box: tuple[int, int, int, int], ink: np.ndarray, paper: np.ndarray, radius: int = 1, most: float = 0.5) -> tuple[int, int, int, int, str]:
    """The box after trimming, and why trimming ended.

    A side moves in by a pixel while both of its corners are background, so it stops at the
    text; sides are tried in the order left, right, top, bottom, after each step anew, and each
    loses ``most`` of the box's width or height at most.
    """
    x, y, w, h = box
    if ((ink - paper) ** 2).sum() < LEAST_CONTRAST:
        return (*box, TOO_CLOSE)
    if min(w, h) <= SMALLEST:
        return (*box, TOO_SMALL)
    wide, tall = int(np.floor(w * most)), int(np.floor(h * most))
    left, top, right, bottom = x, y, x + w - 1, y + h - 1
    edges, reason = (x, right, y, bottom), CLEAR
    paper_at = _papers(image, box, radius, ink, paper)
    while True:
        if right - left < SMALLEST or bottom - top < SMALLEST:
            reason = DEGENERATE
            break
        tl, tr, bl, br = (paper_at(px, py) for py in (top, bottom) for px in (left, right))
        room = (wide - (left - edges[0]), wide - (edges[1] - right), tall - (top - edges[2]), tall - (edges[3] - bottom))
        loose = (tl and bl, tr and br, tl and tr, bl and br)
        side = next((k for k in range(4) if loose[k] and room[k] > 0), None)
        if side is None:
            reason = CAPPED if any(loose) else CLEAR
            break
        left, right, top, bottom = left + (side == 0), right - (side == 1), top + (side == 2), bottom - (side == 3)
    new = (left, top, right - left + 1, bottom - top + 1)
    return (*new, reason if new != tuple(box) else CLEAR)


def shrink(boxes: DataFrame, radius: int = 1, most: float = 0.5) -> DataFrame:
    """``x, y, w, h`` of each box after trimming and ``reason``.

    Rows bring their pixels: ``pixels`` (RGB bytes, row by row), ``width``, ``height``, and the
    colours ``ink`` and ``paper`` as [r, g, b]; without colours or pixels nothing is trimmed.
    """

    @pandas_udf("x int, y int, w int, h int, reason string")
    def trim(pixels: pd.Series, width: pd.Series, height: pd.Series, x: pd.Series, y: pd.Series, w: pd.Series, h: pd.Series, ink: pd.Series, paper: pd.Series) -> pd.DataFrame:
        out, known = [], {}
        for p, pw, ph, *box, a, b in zip(pixels, width, height, x, y, w, h, ink, paper, strict=True):
            if p is None or a is None or b is None or None in list(a) + list(b):
                out.append((*box, NO_COLOURS))
                continue
            # Equal boxes on equal pictures are trimmed once in a batch.
            key = (p, int(pw), int(ph), *map(int, box), *a, *b)
            if key not in known:
                image = np.frombuffer(p, np.uint8).reshape(int(ph), int(pw), 3)
                known[key] = shrunk(image, tuple(map(int, box)), np.asarray(a, float), np.asarray(b, float), radius, most)
            out.append(known[key])
        return pd.DataFrame(out, columns=["x", "y", "w", "h", "reason"])

    done = boxes.withColumn("_s", trim("pixels", "width", "height", "x", "y", "w", "h", "ink", "paper"))
    return done.drop("pixels", "x", "y", "w", "h").select("*", "_s.*").drop("_s")


def filled(image: np.ndarray, rects: list[tuple[int, int, int, int]], colour: tuple[int, int, int] = (0, 0, 0)) -> np.ndarray:
    """The image with rectangles painted over, as far as they lie inside it."""
    out = image.copy()
    for x, y, w, h in rects:
        out[max(0, y) : max(0, y + h), max(0, x) : max(0, x + w)] = colour
    return out
