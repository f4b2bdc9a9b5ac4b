"""Schemas of the relations, and the parameters of the operators."""

from __future__ import annotations

from dataclasses import dataclass

FRAME = "video string, frame int, source_index int, source_fps double, width int, height int, hash_p array<bigint>, hash_d array<bigint>"
BLOCK = "video string, frame int, ocr_index int, block_id string, type string, text string, confidence double, left double, top double, w double, h double, child_ids array<string>"
BOX = "video string, frame int, box_pos int, x int, y int, w int, h int, text string, score double, origin string, label string, track_id string, instance_id string, branch string, category string, text_color_hex string, background_color_hex string"
DECISION = "video string, frame int, pos int, ocr_index int, keep boolean, text string, reason string"
LINK = "video string, frame_a int, frame_b int, pos int, b_index int, a_index int, reason string"
REGION = "video string, frame int, branch string, sub_id string, bbox array<int>, confidence double, reason string"
LEAF = "branch string, kind string, text string, fuzzy double, category string, description string"


@dataclass(frozen=True)
class DetectParams:
    min_confidence: float = 10.0
    fuzzy: float = 0.82
    pad: int = 2


@dataclass(frozen=True)
class DedupParams:
    threshold: int = 2
    max_gap: int = 1

    @property
    def reach(self) -> int:
        """Rows after a kept one by which another must be kept."""
        return self.max_gap + 2


@dataclass(frozen=True)
class LinkParams:
    iou_weight: float = 0.7
    text_weight: float = 0.3
    least: float = 0.12
    inherit_least: float = 0.15
    centre: float = 0.08


@dataclass(frozen=True)
class GapParams:
    move_px: float = 8.0
    rel_w: float = 0.1
    rel_h: float = 0.1
    rel_area: float = 0.15
    new_area: float = 0.01
    depth: int = 5


@dataclass(frozen=True)
class ExportStyle:
    color: str = "black"
    padding: int = 0


def frame_range(first: int | None, last: int | None, n: int, clamp: str = "error") -> tuple[int, int]:
    """1-based inclusive range inside 1..n.

    ``clamp="error"`` raises if the range lies beyond the end; ``clamp="inside"`` moves its
    start onto the last frame instead.
    """
    low = max(1, first if first is not None else 1)
    if clamp == "inside":
        low = min(low, max(1, n))
    high = min(max(1, last if last is not None else n), n)
    if low > high:
        raise ValueError(f"no frames between {low} and {high}")
    return low, high


MOST_BYTES = 500 << 20


def request(fps: float | None, dedup_threshold: int | None, max_gap: int | None, content_type: str | None = None, size: int | None = None, content_hash: str | None = None, expected_hash: str | None = None) -> dict:
    """Checked request values: rates of 0 or less mean none, counts are 0 at least.

    What is no video, too large, or of another hash than expected is an error.
    """
    if content_type is not None and not content_type.startswith("video/"):
        raise ValueError(f"no video: {content_type}")
    if size is not None and size > MOST_BYTES:
        raise ValueError(f"{size} bytes are more than {MOST_BYTES}")
    if expected_hash is not None and content_hash is not None and expected_hash != content_hash:
        raise ValueError("the content is not the one expected")
    return {"fps": fps if fps and fps > 0 else None, "dedup_threshold": max(0, dedup_threshold if dedup_threshold is not None else 2), "max_gap": max(0, max_gap if max_gap is not None else 1)}
