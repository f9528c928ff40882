"""Detection by a cascade of rectangle features, over whole batches of images.

A window is tried at every place of an image. A stage adds up the votes of its features, and a window that stays under the stage's
threshold is out, so most are looked at by the first stage alone. A feature is a weighted sum over rectangles, each of which costs four
look-ups in the image's summed-area table, whatever its size. The cascade is a table of stages, trained elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake import fixtures
from prismlake.registry import query
from prismlake.shipping import ship

#: Features of a cascade at most; its table is small and goes to all tasks.
FEATURES = 100_000
STAGES = "stage int, threshold double, feature int, cut double, below double, above double, rects array<struct<x:int,y:int,w:int,h:int,weight:double>>"
#: Windows that are looked at together.
BLOCK = 200_000


@dataclass
class Cascade:
    """stages: in order, each a threshold and features (cut, vote below it, vote from it on, rectangles); of windows of a width and height."""

    stages: list[tuple[float, list[tuple[float, float, float, list[tuple[int, int, int, int, float]]]]]]
    width: int
    height: int

    @classmethod
    def of(cls, table: DataFrame, width: int, height: int) -> Cascade:
        """Of a table of stages (STAGES)."""
        rows = table.orderBy("stage", "feature").limit(FEATURES + 1).collect()
        if len(rows) > FEATURES:
            raise ValueError(f"a cascade of over {FEATURES} features")
        held: dict[int, tuple[float, list]] = {}
        for r in rows:
            held.setdefault(r["stage"], (r["threshold"], []))[1].append((r["cut"], r["below"], r["above"], [tuple(x) for x in r["rects"]]))
        return cls([held[k] for k in sorted(held)], width, height)

    def windows(self, images: np.ndarray, step: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(image, y, x) of the windows of images (n, height, width) that pass all stages, and how many features were evaluated."""
        n, height, width = images.shape
        if height < self.height or width < self.width:
            return (*(np.zeros(0, np.int64) for _ in range(3)), 0)
        sums = np.zeros((n, height + 1, width + 1), np.int64 if np.issubdtype(images.dtype, np.integer) else float)
        np.cumsum(np.cumsum(images, axis=1, dtype=sums.dtype), axis=2, out=sums[:, 1:, 1:])
        grid = np.meshgrid(np.arange(n), np.arange(0, height - self.height + 1, step), np.arange(0, width - self.width + 1, step), indexing="ij")
        image, y, x = (g.ravel() for g in grid)
        evaluated = 0
        for threshold, features in self.stages:
            votes = np.zeros(len(image))
            for cut, below, above, rects in features:
                value = np.zeros(len(image))
                for dx, dy, w, h, weight in rects:
                    top, left = y + dy, x + dx
                    value += weight * (sums[image, top + h, left + w] - sums[image, top, left + w] - sums[image, top + h, left] + sums[image, top, left])
                votes += np.where(value < cut, below, above)
                evaluated += len(image)
            stays = votes >= threshold
            image, y, x = image[stays], y[stays], x[stays]
        return image, y, x, evaluated


def detected(images: DataFrame, key: str, cascades: dict[str, Cascade], step: int = 1) -> DataFrame:
    """The key of images (key, width: int, height: int, pixels: array<int>, row by row), and for each cascade a column of how many windows it passes; null for pixels that aren't width x height."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths, heights = (batch.column(batch.schema.get_field_index(c)).fill_null(0).to_numpy() for c in ("width", "height"))
            pixels = batch.column(batch.schema.get_field_index("pixels"))
            lengths = pyarrow.compute.list_value_length(pixels).fill_null(-1).to_numpy()
            counts = {name: [None] * batch.num_rows for name in cascades}
            sizes = {(h, w) for h, w, n in zip(heights.tolist(), widths.tolist(), lengths.tolist(), strict=True) if h and w and h * w == n}
            for h, w in sizes:
                rows = np.flatnonzero((heights == h) & (widths == w) & (lengths == h * w))
                each = max(1, BLOCK // (h * w))
                for some in np.split(rows, range(each, len(rows), each)):
                    found = np.array(pixels.take(pa.array(some)).to_pylist(), np.int64).reshape(len(some), h, w)
                    for name, cascade in cascades.items():
                        held = np.bincount(cascade.windows(found, step)[0], minlength=len(some))
                        for i, n in zip(some.tolist(), held.tolist(), strict=True):
                            counts[name][i] = n
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(key)), *(pa.array(c, pa.int64()) for c in counts.values())], names=[key, *counts])

    ship(images.sparkSession)
    own = images.select(key, "width", "height", "pixels")
    return own.mapInArrow(run, ", ".join([f"`{key}` {images.schema[key].dataType.simpleString()}", *(f"`{c}` bigint" for c in cascades)]))


#: Two small cascades for windows of 4 x 4: (stage, threshold, feature, cut, below, above, rectangles).
_EYE = [(0, 1.0, 0, 0.0, 0.0, 1.0, [(0, 0, 4, 2, 1.0), (0, 2, 4, 2, -1.0)]), (1, 1.0, 0, 50.0, 0.0, 0.5, [(0, 0, 2, 4, 1.0), (2, 0, 2, 4, -1.0)]), (1, 1.0, 1, -20.0, 0.25, 0.5, [(1, 1, 2, 2, 4.0), (0, 0, 4, 4, -1.0)])]
_SMILE = [(0, 1.5, 0, 10.0, 1.0, 0.5, [(0, 2, 4, 2, 1.0)]), (0, 1.5, 1, 0.0, 0.5, 1.0, [(0, 0, 1, 4, 1.0), (3, 0, 1, 4, 1.0)]), (2, 1.0, 0, -30.0, 0.0, 1.0, [(0, 3, 4, 1, 1.0)])]


def _passes(rows) -> str:
    """SQL that adds up the pixels of each rectangle, one by one."""
    total = lambda x, y, w, h: " + ".join(f"p[(wy + {y + j}) * 8 + wx + {x + i} + 1]" for j in range(h) for i in range(w))
    value = lambda rects: " + ".join(f"({weight}::DOUBLE) * ({total(x, y, w, h)})" for x, y, w, h, weight in rects)
    stages = {}
    for stage, threshold, _, cut, below, above, rects in rows:
        stages.setdefault((stage, threshold), []).append(f"CASE WHEN {value(rects)} < {cut} THEN {below} ELSE {above} END")
    return " AND ".join(f"{' + '.join(votes)} >= {threshold}" for (_, threshold), votes in stages.items())


@query("cascade_faces", f"""WITH i AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1000)::BIGINT) AS p FROM embeddings),
    c AS (SELECT vec_id, count(*) FILTER ({_passes(_EYE)}) AS eyes, count(*) FILTER ({_passes(_SMILE)}) AS smiles FROM i, range(5) a(wx), range(5) b(wy) GROUP BY vec_id)
    SELECT vec_id, eyes, smiles, smiles + 2 * least(eyes, 2) AS score FROM c""")
def cascade_faces(spark, d):
    """Eyes and smiles that two cascades find in faces of 8 x 8 pixels, and the faces' scores."""
    v = fixtures.table(spark, d, "embeddings")
    images = v.select("vec_id", F.lit(8).alias("width"), F.lit(8).alias("height"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("int")).alias("pixels"))
    found = detected(images, "vec_id", {name: Cascade.of(spark.createDataFrame(rows, STAGES), 4, 4) for name, rows in (("eyes", _EYE), ("smiles", _SMILE))})
    return found.select("vec_id", "eyes", "smiles", (F.col("smiles") + 2 * F.least("eyes", F.lit(2))).alias("score"))
