"""Pairs of boxes near each other on one frame, without looking at all pairs of a frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pixels of a cell's sides.
CELL = 128


def _in_cells(rows: DataFrame, prefix: str, x: Column, y: Column, right: Column, bottom: Column, cell: tuple[float, float]) -> DataFrame:
    """A row for each cell that a rectangle touches, with the first of them."""
    first = lambda v, size: F.floor(v / size).cast("int")
    across, down = (first(x, cell[0]), first(right, cell[0])), (first(y, cell[1]), first(bottom, cell[1]))
    placed = rows.withColumn(f"{prefix}_cx", across[0]).withColumn(f"{prefix}_cy", down[0])
    return placed.withColumn("cx", F.explode(F.sequence(*across))).withColumn("cy", F.explode(F.sequence(*down)))


def near_pairs(left: DataFrame, right: DataFrame, reach: tuple[Column | float, Column | float], on: tuple[str, ...] = ("video", "frame"), cell: tuple[float, float] = (CELL, CELL), points: bool = False) -> DataFrame:
    """Pairs of ``left`` (columns ``a_x, a_y, a_w, a_h``, ...) and ``right`` (``b_...``) whose rectangles may meet.

    A left rectangle is grown by ``reach`` to each side (with ``points``, both are their centres);
    all pairs that meet then are among the rows, each once, and few others: those that share a
    cell of the frame.  A rectangle stands in every cell that it touches, and a pair counts in
    the first that both touch.  Boxes far apart never meet, so a crowded frame costs what its
    crowded places do, and its cells are spread over tasks.
    """
    c = F.col

    def rect(p: str) -> list[Column]:
        if points:
            x, y = c(f"{p}_x") + c(f"{p}_w") / 2, c(f"{p}_y") + c(f"{p}_h") / 2
            return [x, y, x, y]
        return [c(f"{p}_x"), c(f"{p}_y"), c(f"{p}_x") + c(f"{p}_w"), c(f"{p}_y") + c(f"{p}_h")]

    x, y, r, b = rect("a")
    dx, dy = (v if isinstance(v, Column) else F.lit(float(v)) for v in reach)
    own = _in_cells(left, "a", x - dx, y - dy, r + dx, b + dy, cell)
    other = _in_cells(right, "b", *rect("b"), cell)
    met = own.join(other, [*on, "cx", "cy"])
    return met.where((c("cx") == F.greatest("a_cx", "b_cx")) & (c("cy") == F.greatest("a_cy", "b_cy"))).drop("cx", "cy", "a_cx", "a_cy", "b_cx", "b_cy")
