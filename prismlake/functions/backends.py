"""Feature extraction from images by backends that may or may not be there.

A backend is a class with a name and methods on decoded or raw bytes. Each Python worker makes one when it first needs it.
Rows pass through mapInPandas in batches; where a backend is missing or fails on a row, the row's features are null.
"""

from __future__ import annotations

import importlib.util
from abc import ABC, abstractmethod
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismlake.shipping import ship

FACES = "faces array<struct<top:int,right:int,bottom:int,left:int>>, landmarks array<struct<left_eye:array<struct<x:double,y:double>>,right_eye:array<struct<x:double,y:double>>>>, encodings array<array<float>>"


class FaceBackend(ABC):
    """Boxes, eyes and encodings of the faces in an image; in the same order."""

    name: str
    #: Modules that must be installed.
    needs: tuple[str, ...] = ()

    @abstractmethod
    def load(self, content: bytes): ...

    @abstractmethod
    def detect(self, image) -> list[dict[str, int]]: ...

    def landmarks(self, image) -> list[dict]:
        return []

    def encode(self, image) -> list[list[float]]:
        return []

    def distance(self, a: list[float], b: list[float]) -> float:
        return float(np.linalg.norm(np.asarray(a, float) - np.asarray(b, float)))


BACKENDS: dict[str, type[FaceBackend]] = {}


def register(backend: type[FaceBackend]) -> type[FaceBackend]:
    BACKENDS[backend.name] = backend
    return backend


def _there(backend) -> bool:
    return all(importlib.util.find_spec(m.partition(".")[0]) for m in backend.needs)


def choose(wanted: str = "auto", order: tuple[str, ...] | None = None) -> type[FaceBackend] | None:
    """The backend of this name, or the first in order whose modules are installed; None if there is none."""
    names = (order or tuple(BACKENDS)) if wanted == "auto" else (wanted,)
    return next((BACKENDS[n] for n in names if n in BACKENDS and _there(BACKENDS[n])), None)


@cache
def _instance(backend: type[FaceBackend]) -> FaceBackend:
    return backend()


def with_faces(images: DataFrame, backend: type[FaceBackend] | None) -> DataFrame:
    """images (photo_id, content) with their faces; null without a backend and for images that it can't read."""
    if backend is None:
        return images.select("photo_id", *(F.lit(None).cast(t).alias(n) for n, t in (x.split(" ", 1) for x in FACES.split(", "))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _instance(backend)
        for batch in batches:
            rows = []
            for content in batch["content"]:
                try:
                    image = own.load(content)
                    rows.append((own.detect(image), own.landmarks(image), own.encode(image)))
                except Exception:  # noqa: BLE001  one bad image must not end the scan
                    rows.append((None, None, None))
            yield pd.DataFrame({"photo_id": batch["photo_id"], **{n: [r[i] for r in rows] for i, n in enumerate(("faces", "landmarks", "encodings"))}})

    ship(images.sparkSession)
    return images.select("photo_id", "content").mapInPandas(run, f"photo_id string, {FACES}")


class Scorer(ABC):
    """Quality of an image's bytes, from 0 to 1."""

    name: str
    needs: tuple[str, ...] = ()

    @abstractmethod
    def score(self, content: bytes) -> float | None: ...


SCORERS: dict[str, type[Scorer]] = {}


def register_scorer(scorer: type[Scorer]) -> type[Scorer]:
    SCORERS[scorer.name] = scorer
    return scorer


def scorer_chain(order: tuple[str, ...]) -> type[Scorer] | None:
    """The first scorer in order that is registered and whose modules are installed; None if there is none."""
    return next((SCORERS[n] for n in order if n in SCORERS and _there(SCORERS[n])), None)


def with_scores(images: DataFrame, scorer: type[Scorer] | None) -> DataFrame:
    """images (photo_id, content) with `score`; null without a scorer, and for images that it can't read."""
    if scorer is None:
        return images.select("photo_id", F.lit(None).cast("double").alias("score"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _instance(scorer)
        for batch in batches:
            scores = []
            for content in batch["content"]:
                try:
                    scores.append(own.score(content))
                except Exception:  # noqa: BLE001  one bad image must not end the scan
                    scores.append(None)
            yield pd.DataFrame({"photo_id": batch["photo_id"], "score": pd.array(scores, "Float64")})

    ship(images.sparkSession)
    return images.select("photo_id", "content").mapInPandas(run, "photo_id string, score double")


def quality(mean: Column, deviation: Column) -> Column:
    """Of an image's mean and deviation, without a model: 0.4 and 0.6 of both, each cut to its range."""
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return 0.4 * clip((mean - 0.2) / 1.5) + 0.6 * clip((deviation - 0.2) / 1.0)


def difference_hash(pixels: Column, width: int = 9, height: int = 8) -> Column:
    """64 bits of grey pixels in rows of nine: whether each is darker than its right neighbour."""
    at = F.sequence(F.lit(0), F.lit((width - 1) * height - 1))
    place = lambda i: F.floor(i / (width - 1)).cast("int") * width + i % (width - 1)
    return F.aggregate(at, F.lit(0).cast("long"), lambda acc, i: F.shiftleft(acc, 1).bitwiseOR(F.when(F.get(pixels, place(i) + 1) > F.get(pixels, place(i)), 1).otherwise(0)))


def perceptual_hash(pixels: Column, side: int = 32, kept: int = 8) -> Column:
    """kept * kept bits of side * side grey pixels, row by row: whether each of the lowest waves of their cosine transform is above the median of these."""
    at = np.arange(side)
    waves = np.cos(np.pi * np.outer(np.arange(kept), 2 * at + 1) / (2 * side))

    def hashes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for row in batch:
                if row is None or len(row) != side * side:
                    out.append(None)
                    continue
                low = waves @ np.asarray(row, float).reshape(side, side) @ waves.T
                bits = np.packbits((low > np.median(low)).ravel())
                out.append(int.from_bytes(bits.tobytes().rjust(8, b"\0"), "big", signed=True))
            yield pd.Series(out, dtype="Int64")

    return F.pandas_udf(hashes, "long")(pixels)


def video_hashes(frames: DataFrame, side: int = 32, kept: int = 8) -> DataFrame:
    """(video_id, frames, thumb) of chosen frames (video_id, position, pixels): their hashes in order, and that of the middle one; frames that can't be hashed are left out."""
    ship(frames.sparkSession)
    hashed = frames.select("video_id", "position", perceptual_hash(F.col("pixels"), side, kept).alias("hash")).where("hash IS NOT NULL")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", "hash"))), lambda x: x["hash"])
    found = hashed.groupBy("video_id").agg(ordered.alias("frames"))
    return found.withColumn("thumb", F.get("frames", F.floor(F.size("frames") / 2).cast("int")))
