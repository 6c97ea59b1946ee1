"""The nearest of many points, within one cell's group."""

from __future__ import annotations

import numpy as np

#: Points of a box, boxes a side, and boxes of one side that are compared at a time.
A_BOX, MOST_BOXES, AT_A_TIME = 8, 64, 64


def _boxes(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points dealt to a grid: their order by box, where each box begins (and the end), and its bounds x0, x1, y0, y1."""
    n = min(MOST_BOXES, max(1, int(np.sqrt(len(x) / A_BOX))))
    at = [np.minimum(((v - v.min()) / max(v.max() - v.min(), 1e-9) * n).astype(np.int64), n - 1) for v in (x, y)]
    box = at[0] * n + at[1]
    order = np.argsort(box, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(box[order]) > 0])
    bounds = np.stack([f.reduceat(v[order], first) for v in (x, y) for f in (np.minimum, np.maximum)])
    return order, np.r_[first, len(x)], bounds


def closest(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, radius: float) -> np.ndarray:
    """For each point of a the distance of its nearest point of b; inf where there is none within the radius.

    Boxes of a meet boxes of b by their bounds: one that can't be as near as the farthest point of the best one is left out.
    """
    out = np.full(len(ax), np.inf)
    if not len(ax) or not len(bx):
        return out
    (ao, af, a), (bo, bf, b) = _boxes(ax, ay), _boxes(bx, by)
    px, py = bx[bo], by[bo]
    for s in range(0, a.shape[1], AT_A_TIME):
        x0, x1, y0, y1 = (v[s : s + AT_A_TIME, None] for v in a)
        low = np.maximum(np.maximum(b[0] - x1, x0 - b[1]), 0) ** 2 + np.maximum(np.maximum(b[2] - y1, y0 - b[3]), 0) ** 2
        high = np.maximum(b[1] - x0, x1 - b[0]) ** 2 + np.maximum(b[3] - y0, y1 - b[2]) ** 2
        keep = low <= np.minimum(high.min(1), radius * radius)[:, None] * (1 + 1e-9) + 1e-9
        for i, kept in enumerate(keep):
            which = np.flatnonzero(kept)
            if not len(which):
                continue
            rows = ao[af[s + i] : af[s + i + 1]]
            best = np.full(len(rows), np.inf)
            for k in which:
                qx, qy = px[bf[k] : bf[k + 1]], py[bf[k] : bf[k + 1]]
                for p in range(0, len(qx), 4096):
                    best = np.minimum(best, ((ax[rows, None] - qx[p : p + 4096]) ** 2 + (ay[rows, None] - qy[p : p + 4096]) ** 2).min(1))
            out[rows] = np.sqrt(best)
    return np.where(out <= radius, out, np.inf)
