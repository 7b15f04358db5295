"""Detection: pictures through a pluggable scorer, class and confidence filters, background stripping.

A scorer takes uint8 pictures (height x width x 3) and gives (boxes, classes, scores) in its input's pixels. It is made
once per Python worker by a factory, for instance one that loads an ONNX session.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DETECTIONS = "array<struct<class_name: string, confidence: float, x_min: float, y_min: float, x_max: float, y_max: float>>"
CLUSTERS, ROUNDS, STARTS, GRID = 5, 50, 4, 100


def scaled(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """image on another grid, bilinear between pixel centres when it grows, by triangles of the source's size when it shrinks."""

    def weights(n: int, m: int) -> np.ndarray:
        scale = n / m
        reach = max(scale, 1.0)
        center = (np.arange(m) + 0.5) * scale - 0.5
        w = np.maximum(0, 1 - np.abs(center[:, None] - np.arange(n)) / reach)
        return w / w.sum(1, keepdims=True)

    out = np.einsum("ij,jkc->ikc", weights(image.shape[0], height), image.astype(np.float64))
    out = np.einsum("ij,kjc->kic", weights(image.shape[1], width), out)
    return np.floor(out + 0.5).clip(0, 255).astype(np.uint8)


def kmeans(points: np.ndarray, k: int = CLUSTERS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Centres and each point's cluster: the best of some seeded starts, whose centres are drawn by squared distance."""
    rng, best = np.random.default_rng(seed), None
    points = points.astype(np.float64)
    for _ in range(STARTS):
        centers = points[[rng.integers(len(points))]]
        while len(centers) < k:
            d2 = ((points[:, None] - centers[None]) ** 2).sum(2).min(1)
            pick = rng.choice(len(points), p=d2 / d2.sum()) if d2.sum() else rng.integers(len(points))
            centers = np.vstack([centers, points[pick]])
        own = None
        for _ in range(ROUNDS):
            d2 = ((points[:, None] - centers[None]) ** 2).sum(2)
            now = d2.argmin(1)
            if own is not None and (now == own).all():
                break
            own = now
            centers = np.array([points[own == c].mean(0) if (own == c).any() else centers[c] for c in range(k)])
        cost = ((points - centers[own]) ** 2).sum()
        if best is None or cost < best[0]:
            best = cost, centers, own
    return best[1], best[2]


def background(image: np.ndarray, seed: int = 0) -> np.ndarray:
    """The centre of the largest colour cluster of the picture, at 100 x 100 pixels."""
    centers, own = kmeans(scaled(image, GRID, GRID).reshape(-1, 3), seed=seed)
    return centers[np.bincount(own, minlength=len(centers)).argmax()]


def stripped(image: np.ndarray, distance: float) -> np.ndarray:
    """image with the pixels whose colour is within `distance` of the background's in black."""
    near = ((image.astype(np.float64) - background(image)) ** 2).sum(-1) <= distance * distance
    return np.where(near[..., None], 0, image).astype(np.uint8)


def decoded(boxes: np.ndarray, classes: np.ndarray, scores: np.ndarray, labels: list[str], height: int, width: int, least: float) -> list[dict]:
    """Detections of at least that score, boxes in shares of the picture. Classes count from 1; one beyond the labels is
    named by its number."""
    out = []
    for box, c, s in zip(np.asarray(boxes).reshape(-1, 4), classes, scores, strict=True):
        if s >= least:
            k = int(c + 0.5) - 1
            out.append({"class_name": labels[k] if 0 <= k < len(labels) else str(k + 1), "confidence": s, "x_min": box[0] / width, "y_min": box[1] / height, "x_max": box[2] / width, "y_max": box[3] / height})
    return out


def detected(images: DataFrame, factory: Callable, labels: list[str], height: int, width: int, least: float = 0.6, strip: float = 0.0, soft: bool = False) -> DataFrame:
    """path, detections of each distinct path of images (path, height, width, pixels: rgb bytes). With `soft`, a picture that
    fails has null detections."""
    kept: list = []

    def detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = kept[0] if kept else factory()
        if not kept:
            kept.append(scorer)
        for batch in batches:
            out = []
            for row in batch.itertuples():
                try:
                    image = scaled(np.frombuffer(row.pixels, np.uint8).reshape(row.height, row.width, 3), height, width)
                    out.append(decoded(*scorer(stripped(image, strip) if strip > 0 else image), labels, height, width, least))
                except Exception:
                    if not soft:
                        raise
                    out.append(None)
            yield pd.DataFrame({"path": batch["path"], "detections": out})

    return images.select("path", "height", "width", "pixels").dropDuplicates(["path"]).mapInPandas(detect, f"path string, detections {DETECTIONS}")


def confident(detections: Column, least: float, classes: list[str] | None = None) -> Column:
    """Those of at least that confidence and, unless classes is empty, of one of the classes."""
    return F.filter(detections, lambda d: (d["confidence"] >= least) & (d["class_name"].isin(classes) if classes else F.lit(True)))


def counted(detections: Column, name: str) -> Column:
    return F.coalesce(F.size(F.filter(detections, lambda d: d["class_name"] == name)), F.lit(0))
