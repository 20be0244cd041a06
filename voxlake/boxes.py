"""World boxes as dictionaries {axis: (lo, hi)}: what plans are built from on the driver. functions.geometry has the column forms."""

from __future__ import annotations

import math

Box = dict[str, tuple[float, float]]


def intersect(a: Box, b: Box) -> Box | None:
    """The common box over shared axes; None where boxes only touch, or share no axis."""
    out = {x: (max(a[x][0], b[x][0]), min(a[x][1], b[x][1])) for x in a if x in b}
    return out if out and all(lo < hi for lo, hi in out.values()) else None


def unite(a: Box, b: Box) -> Box:
    ends = lambda x: [box[x] for box in (a, b) if x in box]
    return {x: (min(lo for lo, _ in ends(x)), max(hi for _, hi in ends(x))) for x in [*a, *(x for x in b if x not in a)]}


def voxels(box: Box, scale: dict[str, float]) -> dict[str, int]:
    return {x: max(1, round((hi - lo) / scale[x])) for x, (lo, hi) in box.items()}


def shrunk(box: Box, size: dict[str, float], scale: dict[str, float], pad: bool) -> Box | None:
    """Where centres of outputs of `size` may lie; too small a box gives one voxel at its centre if padded, else None."""
    out = {}
    for x, (lo, hi) in box.items():
        a, b, mid = lo + size[x] / 2, hi - size[x] / 2, (lo + hi) / 2
        if a >= b and not pad:
            return None
        out[x] = (a, b) if a < b else (mid - scale[x] / 2, mid + scale[x] / 2)
    return out


def centre(box: Box, scale: dict[str, float], index: int) -> dict[str, float]:
    """World coordinates of a flat index over the box's grid in C order; indices wrap."""
    grid = voxels(box, scale)
    rest, out = index % math.prod(grid.values()), {}
    for x in reversed(list(box)):
        rest, k = divmod(rest, grid[x])
        out[x] = box[x][0] + (k + 0.5) * scale[x]
    return {x: out[x] for x in box}


def tiles(box: Box, scale: dict[str, float], size: dict[str, float]) -> list[int]:
    """Flat indices that tile the box; the last tile's width is never visited beyond the box, as centres end there."""
    grid, axes = voxels(box, scale), list(box)
    count = {x: max(1, round((box[x][1] - box[x][0]) / size.get(x, scale[x]))) for x in axes}
    flat = [0]
    for x in axes:
        flat = [f * grid[x] + k * grid[x] // count[x] for f in flat for k in range(count[x])]
    return flat


def cover(box: Box, scale: dict[str, float], size: dict[str, float]) -> list[dict[str, float]]:
    """Centres of tiles that cover a whole bounding box, the last ones moved inwards: the corrected form of tiles()."""
    out: list[dict[str, float]] = [{}]
    for x, (lo, hi) in box.items():
        n = max(1, math.ceil((hi - lo) / size[x] - 1e-9))
        out = [c | {x: min(lo + (k + 0.5) * size[x], max(hi - size[x] / 2, lo + size[x] / 2))} for c in out for k in range(n)]
    return out
