"""Constant-velocity Kalman filters over box measurements, for all tracks at once.

A coordinate and its velocity depend on no other coordinate, so a covariance is, for each of the four, its variance, its
covariance with its velocity, and the velocity's variance: arrays of shape (tracks, 3, 4) instead of (tracks, 8, 8).
"""

from __future__ import annotations

import numpy as np

POSITION, VELOCITY = 1 / 20, 1 / 160


class BoxFilter:
    """State: four box coordinates and their velocities. Noise scales with the box height.

    form "xyah": centre, aspect, height. form "xywh": centre, width, height. All arguments have a row for each track.
    """

    def __init__(self, form: str = "xyah"):
        self.form = form

    def measure(self, tlwh: np.ndarray) -> np.ndarray:
        x, y, w, h = np.asarray(tlwh, float).reshape(-1, 4).T
        return np.stack([x + w / 2, y + h / 2, w / np.maximum(h, 1e-9) if self.form == "xyah" else w, h], -1)

    def to_tlwh(self, mean: np.ndarray) -> np.ndarray:
        cx, cy, a, h = mean[:, :4].T
        w = a * h if self.form == "xyah" else a
        return np.stack([cx - w / 2, cy - h / 2, w, h], -1)

    def _variances(self, mean: np.ndarray, factor: float, aspect: float) -> np.ndarray:
        h = np.maximum(mean[:, 3], 1e-3)
        w = h if self.form == "xyah" else np.maximum(mean[:, 2], 1e-3)
        third = np.full_like(h, aspect) if self.form == "xyah" else factor * w
        return np.stack([factor * w, factor * h, third, factor * h], -1) ** 2

    def initiate(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = np.concatenate([z, np.zeros_like(z)], 1)
        return mean, np.stack([self._variances(mean, 2 * POSITION, 1e-2), np.zeros_like(z), self._variances(mean, 10 * VELOCITY, 1e-5)], 1)

    def predict(self, mean: np.ndarray, cov: np.ndarray, dt: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        more = max(dt, 1e-9)
        place, both, speed = cov[:, 0], cov[:, 1], cov[:, 2]
        ahead = mean.copy()
        ahead[:, :4] += dt * mean[:, 4:]
        grown = [place + 2 * dt * both + dt * dt * speed + more * self._variances(mean, POSITION, 1e-2), both + dt * speed, speed + more * self._variances(mean, VELOCITY, 1e-5)]
        return ahead, np.stack(grown, 1)

    def project(self, mean: np.ndarray, cov: np.ndarray, trust: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """What a measurement is expected to be, and the variance of each of its coordinates."""
        return mean[:, :4], cov[:, 0] + trust * self._variances(mean, POSITION, 1e-1)

    def update(self, mean: np.ndarray, cov: np.ndarray, z: np.ndarray, trust: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        seen, s = self.project(mean, cov, trust)
        place, speed, off = cov[:, 0] / s, cov[:, 1] / s, z - seen
        gained = np.stack([place * place * s, place * speed * s, speed * speed * s], 1)
        return mean + np.concatenate([place * off, speed * off], 1), cov - gained

    def gated(self, mean: np.ndarray, cov: np.ndarray, z: np.ndarray, limit: float, meeting) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tracks, measurements and squared Mahalanobis distances of the pairs within ``limit``; only measurements whose centre is within reach are compared."""
        seen, s = self.project(mean, cov)
        reach = np.sqrt(limit * s[:, :2]) * (1 + 1e-9) + 1e-9
        i, j = meeting(seen[:, :2] - reach, seen[:, :2] + reach, z[:, :2], z[:, :2])
        far = ((z[j] - seen[i]) ** 2 / s[i]).sum(-1)
        return i[far <= limit], j[far <= limit], far[far <= limit]

    def gating(self, mean: np.ndarray, cov: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Squared Mahalanobis distances (tracks, measurements)."""
        seen, s = self.project(mean, cov)
        return ((z[None] - seen[:, None]) ** 2 / s[:, None]).sum(-1)
