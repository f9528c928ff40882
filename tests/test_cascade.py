from __future__ import annotations

import random

import numpy as np
import pytest
from prismlake.functions.cascade import STAGES, Cascade, detected


def brute(stages, image, width, height, step):
    """(y, x) of the windows that pass, by sums over pixels."""
    found = []
    for y in range(0, len(image) - height + 1, step):
        for x in range(0, len(image[0]) - width + 1, step):
            for threshold, features in stages:
                votes = 0.0
                for cut, below, above, rects in features:
                    value = sum(weight * sum(int(image[y + dy + j][x + dx + i]) for j in range(h) for i in range(w)) for dx, dy, w, h, weight in rects)
                    votes += below if value < cut else above
                if votes < threshold:
                    break
            else:
                found.append((y, x))
    return found


def random_stages(rng, width, height):
    def rect():
        x, y = rng.randrange(width), rng.randrange(height)
        return (x, y, rng.randrange(1, width - x + 1), rng.randrange(1, height - y + 1), rng.choice([1.0, -1.0, 2.0]))

    return [(0.5, [(rng.randrange(-50, 50), rng.choice([0.0, 0.5]), rng.choice([0.5, 1.0]), [rect() for _ in range(rng.randrange(1, 4))]) for _ in range(rng.randrange(1, 4))]) for _ in range(4)]


@pytest.mark.parametrize(("seed", "step"), [(1, 1), (2, 1), (3, 2), (4, 3)])
def test_windows_are_those_of_brute_force_and_most_leave_early(seed, step):
    rng = random.Random(seed)
    stages = random_stages(rng, 5, 4)
    images = np.random.default_rng(seed).integers(-20, 21, (12, 9, 11))
    image, y, x, evaluated = Cascade(stages, 5, 4).windows(images, step)
    assert list(zip(image.tolist(), y.tolist(), x.tolist(), strict=True)) == [(i, *w) for i in range(12) for w in brute(stages, images[i], 5, 4, step)]
    places = len(range(0, 6, step)) * len(range(0, 7, step)) * 12
    assert evaluated <= places * sum(len(f) for _, f in stages)
    assert len(Cascade(stages, 50, 4).windows(images)[0]) == 0


def test_a_table_of_stages_over_images_of_several_sizes(spark, monkeypatch):
    from prismlake.functions import cascade

    monkeypatch.setattr(cascade, "BLOCK", 200)
    rng = random.Random(7)
    stages = random_stages(rng, 3, 3)
    table = spark.createDataFrame([(s, float(t), f, float(c), b, a, r) for s, (t, features) in enumerate(stages) for f, (c, b, a, r) in enumerate(features)], STAGES)
    rows = [(i, w, h, [rng.randrange(-9, 10) for _ in range(w * h)]) for i, (w, h) in enumerate([(3, 3), (7, 5), (5, 7), (2, 9)] * 6)] + [(90, 3, 3, [1] * 8), (91, 3, 3, None), (92, None, 3, [1, 2, 3]), (93, 0, 0, [])]
    images = spark.createDataFrame(rows, "i long, width int, height int, pixels array<int>")
    found = {r.i: r.n for r in detected(images, "i", {"n": Cascade.of(table.repartition(3), 3, 3)}).collect()}
    for i, w, h, pixels in rows[:24]:
        assert found[i] == len(brute(stages, [pixels[y * w : (y + 1) * w] for y in range(h)], 3, 3, 1)), i
    assert [found[i] for i in range(90, 94)] == [None] * 4
