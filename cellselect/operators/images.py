"""Image jobs on rows of the image-source shape (height, width, nChannels, data).

Spark distributes the rows; the pixel work is small numpy code per image. Batches are cut by bytes
(``session.tune``), and one output frame is yielded per image, so memory follows image size only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from cellselect.functions import constants as K
from cellselect.operators.catalog import pending_crops

PRESETS = {"crops": (K.HEADINGS, 384), "tiles": (tuple(range(0, 360, 45)), 1024)}  # (headings, size)


def _pixels(row) -> np.ndarray:
    return np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.nChannels)


def view_grid(height: int, width: int, heading: float, fov: float, size: int, pitch: float) -> tuple[np.ndarray, np.ndarray]:
    """Source row and column (fractional) of each pixel of a perspective view of an equirect image."""
    half = np.tan(np.radians(fov) / 2)
    x, y = np.meshgrid(np.linspace(-half, half, size), -np.linspace(-half, half, size))
    p = np.radians(pitch)
    up, ahead = y * np.cos(p) + np.sin(p), np.cos(p) - y * np.sin(p)
    lng = np.arctan2(x, ahead) + np.radians(heading)
    lat = np.arctan2(up, np.hypot(x, ahead))
    return (0.5 - lat / np.pi) * height - 0.5, (lng / (2 * np.pi) + 0.5) * width - 0.5


def bilinear(img: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Bilinear sample; columns wrap around, rows stop at the poles."""
    h, w = img.shape[:2]
    r0, c0 = np.floor(rows).astype(int), np.floor(cols).astype(int)
    fr, fc = (rows - r0)[..., None], (cols - c0)[..., None]
    ra, rb = np.clip(r0, 0, h - 1), np.clip(r0 + 1, 0, h - 1)
    ca, cb = c0 % w, (c0 + 1) % w
    top = img[ra, ca] * (1 - fc) + img[ra, cb] * fc
    low = img[rb, ca] * (1 - fc) + img[rb, cb] * fc
    return np.rint(top * (1 - fr) + low * fr).astype(np.uint8)


VIEW_SCHEMA = "{key} {type}, heading int, path string, size int, data binary, error string"


def render_views(images: DataFrame, key: str = "pano_id", headings: Sequence[int] = K.HEADINGS, fov: float = 90.0,
                 size: int = 384, pitch: float = 0.0, done: DataFrame | None = None) -> DataFrame:
    """Perspective views per equirect row; images whose last view exists are skipped before any pixel
    is read. An image that cannot be rendered yields one row with its error."""
    todo = images if done is None else pending_crops(images, done, key, max(headings))
    kind = dict(todo.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grids: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                name = getattr(row, key)
                try:
                    img = _pixels(row).astype(np.float32)
                    out = []
                    for h in headings:
                        at = (row.height, row.width, h)
                        if at not in grids:
                            if len(grids) > 64:
                                grids.clear()
                            grids[at] = view_grid(row.height, row.width, h, fov, size, pitch)
                        out.append((name, h, f"{str(name)[:2]}/{name}_{h:03d}.jpg", size, bilinear(img, *grids[at]).tobytes(), None))
                except Exception as e:  # noqa: BLE001 - one bad image must not fail the job
                    out = [(name, None, None, None, None, repr(e))]
                yield pd.DataFrame(out, columns=[key, "heading", "path", "size", "data", "error"]).astype({"heading": "Int32", "size": "Int32"})

    cols = [key, "height", "width", "nChannels", "data"]
    return todo.select(*cols).mapInPandas(run, VIEW_SCHEMA.format(key=key, type=kind))


def manifest(views: DataFrame, key: str = "pano_id") -> DataFrame:
    """(key, heading, path) of rendered views."""
    return views.where("error IS NULL").select(key, "heading", "path")


def trim_black(images: DataFrame, key: str = "pano_id") -> DataFrame:
    """Cut all-black borders; an all-black image stays as it is."""
    kind = dict(images.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                img = _pixels(row)
                lit = img.any(axis=2)
                rows, cols = np.flatnonzero(lit.any(axis=1)), np.flatnonzero(lit.any(axis=0))
                if rows.size:
                    img = img[rows[0]:rows[-1] + 1, cols[0]:cols[-1] + 1]
                yield pd.DataFrame([(getattr(row, key), img.shape[0], img.shape[1], row.nChannels, img.tobytes())],
                                   columns=[key, "height", "width", "nChannels", "data"])

    return images.select(key, "height", "width", "nChannels", "data").mapInPandas(
        run, f"{key} {kind}, height int, width int, nChannels int, data binary")


def encode(images: DataFrame, fn: Callable[[list[np.ndarray]], np.ndarray], key: str = "pano_id") -> DataFrame:
    """Vectors of image rows by a user function that sees a batch of pixel arrays at a time."""
    kind = dict(images.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                vectors = np.asarray(fn([_pixels(r) for r in pdf.itertuples(index=False)]), dtype=np.float32)
                yield pd.DataFrame({key: pdf[key], "embedding": list(vectors)})

    return images.select(key, "height", "width", "nChannels", "data").mapInPandas(run, f"{key} {kind}, embedding array<float>")
