"""Homographies from key points: joined by name, solved for each calibration in its own task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SOLVED = "calibration_id string, homography array<array<double>>, points int, mean_error double, max_error double, accepted boolean"


def solve(image: np.ndarray, court: np.ndarray) -> np.ndarray:
    """The matrix that maps image points to court points: exact for four, least squares for more. Points are centred and
    scaled first, so that the system is well conditioned."""

    def normal(p):
        scale = np.sqrt(2) / max(1e-12, np.linalg.norm(p - p.mean(axis=0), axis=1).mean())
        return np.array([[scale, 0, -scale * p[:, 0].mean()], [0, scale, -scale * p[:, 1].mean()], [0, 0, 1]])

    if len(image) < 4:
        raise ValueError("four points are needed")
    a, b = normal(image), normal(court)
    p = np.c_[image, np.ones(len(image))] @ a.T
    q = np.c_[court, np.ones(len(court))] @ b.T
    zero = np.zeros_like(p)
    rows = np.concatenate([np.hstack([p, zero, -q[:, :1] * p]), np.hstack([zero, p, -q[:, 1:2] * p])])
    h = np.linalg.inv(b) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ a
    if abs(h[2, 2]) < 1e-12 or not np.isfinite(h).all():
        raise ValueError("the points don't give a matrix")
    return h / h[2, 2]


def errors(h: np.ndarray, image: np.ndarray, court: np.ndarray) -> np.ndarray:
    p = np.c_[image, np.ones(len(image))] @ h.T
    return np.linalg.norm(p[:, :2] / p[:, 2:] - court, axis=1)


def solve_robust(image: np.ndarray, court: np.ndarray, tolerance: float = 5.0, rounds: int = 64, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The least-squares matrix of the largest set of points that agree within the tolerance, found from seeded draws of
    four; and which points agree."""
    rng = np.random.default_rng(seed)
    best = np.ones(len(image), bool) if len(image) == 4 else np.zeros(len(image), bool)
    for _ in range(rounds if len(image) > 4 else 0):
        draw = rng.choice(len(image), 4, replace=False)
        try:
            ok = errors(solve(image[draw], court[draw]), image, court) <= tolerance
        except (ValueError, np.linalg.LinAlgError):
            continue
        if ok.sum() > best.sum():
            best = ok
    return solve(image[best], court[best]), best


def calibrate(keypoints: DataFrame, court_points: DataFrame, most_error: float = 1.5, least_points: int = 4, tolerance: float = 5.0) -> DataFrame:
    """A row for each calibration. keypoints: calibration_id, name, x, y (pixels); court_points: name, court_x, court_y.

    accepted: enough points, and a mean error (metres, over all of them) within the limit. Too few points give a null matrix."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image, court = pdf[["x", "y"]].to_numpy(float), pdf[["court_x", "court_y"]].to_numpy(float)
        try:
            h, _ = solve_robust(image, court, tolerance)
            e = errors(h, image, court)
            row = h.tolist(), len(image), round(float(e.mean()), 6), round(float(e.max()), 6), bool(len(image) >= least_points and e.mean() <= most_error)
        except (ValueError, np.linalg.LinAlgError):
            row = None, len(image), None, None, False
        return pd.DataFrame([(pdf["calibration_id"].iloc[0], *row)], columns=[c.split()[0] for c in SOLVED.split(", ")])

    return keypoints.join(court_points, "name").groupBy("calibration_id").applyInPandas(run, SOLVED)
