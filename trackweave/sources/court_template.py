"""The court's keypoints. Label, position on the court image of 300 by 161 pixels, and the index of the same point in
the older model of 18 points (-1: none); and the groups of points that sides and boundaries are judged by."""

from __future__ import annotations

TEMPLATE = (
    ("01", 0, 0, 0), ("02", 0, 10, 1), ("04", 0, 55, 2), ("05", 0, 106, 3), ("07", 0, 151, 4), ("08", 0, 161, 5), ("09", 17, 80, -1), ("10", 44, 10, -1), ("11", 44, 151, -1),
    ("12", 61, 55, 8), ("13", 61, 80, -1), ("14", 61, 106, 9), ("15", 87, 0, -1), ("16", 93, 80, -1), ("17", 87, 161, -1), ("19", 150, 0, 7), ("21", 150, 80, -1), ("23", 150, 161, 6),
    ("25", 213, 0, -1), ("26", 207, 80, -1), ("27", 213, 161, -1), ("28", 239, 55, 16), ("29", 239, 80, -1), ("30", 239, 106, 17), ("31", 256, 10, -1), ("32", 256, 151, -1),
    ("33", 283, 80, -1), ("34", 300, 0, 15), ("35", 300, 10, 14), ("37", 300, 55, 13), ("38", 300, 106, 12), ("40", 300, 151, 11), ("41", 300, 161, 10),
)
LEFT, RIGHT, CENTER = (0, 1, 2, 3, 4, 5), (27, 28, 29, 30, 31, 32), (15, 16, 17)
TOP, BOTTOM = (0, 15, 27), (5, 17, 32)
LEFT_INNER, RIGHT_INNER = (9, 11), (21, 23)


def old_template(width: int = 300, height: int = 161, long_m: float = 28.0, wide_m: float = 15.0) -> list[tuple[int, int]]:
    """Positions of the 18 points of the older model, from metres, cut to whole pixels."""
    down = [int(m / wide_m * height) for m in (0.91, 5.18, 10.0, 14.1)]
    left, right = int(5.79 / long_m * width), int((long_m - 5.79) / long_m * width)
    edge = [0, *down, height]
    inner = down[1:3]
    return [
        *((0, y) for y in edge), (width // 2, height), (width // 2, 0), *((left, y) for y in inner), *((width, y) for y in reversed(edge)), *((right, y) for y in inner),
    ]
