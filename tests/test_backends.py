"""The adapters of models, driven by a stub."""

import numpy as np
import pytest

from tessera.functions import raster as R
from tessera.operators import backends


class Stub(backends.Model):
    """Fills the box: as logits, and by half the frame's size if asked for several masks."""

    def __init__(self, fails=(), empty=False):
        self.fails, self.empty, self.calls = fails, empty, []

    def encode(self, rgb):
        self.shape = rgb.shape[:2]

    def predict(self, boxes, points=None, labels=None, several=False):
        self.calls.append((len(boxes), None if points is None else points.tolist(), None if labels is None else labels.tolist(), several))
        if several in self.fails:
            raise ValueError("not so")
        out = np.full((len(boxes), 1, *self.shape), -3.0, np.float32)
        for k, (x0, y0, x1, y1) in enumerate(boxes.astype(int)):
            out[k, 0, y0:y1, x0:x1] = -1.0 if self.empty else 5.0
        out = np.repeat(out, 3, axis=1)[0] if several else out
        return (out[:, ::2, ::2] if several else out), np.array([0.9, np.nan, 0.5, 0.8][: out.shape[0]])


def adapter(kind, model):
    b = kind(lambda: model)
    b.set_image(np.zeros((60, 80, 3), np.uint8))
    return b


def test_batched():
    model = Stub()
    found = adapter(backends.Batched, model).candidates((10, 10, 40, 30), None, "balanced")
    assert [c.prompt for c in found] == ["original box", "expand 4%", "contract 3%"] and [c.score for c in found] == [0.9, 0.0, 0.5]
    assert model.calls == [(3, None, None, False)] and found[0].mask.sum() == 600
    assert found[1].mask.shape == (60, 80)
    with pytest.raises(RuntimeError, match="degenerate"):
        adapter(backends.Batched, Stub()).candidates((79, 10, 79, 30), None, "fast")
    with pytest.raises(RuntimeError, match="no prompt"):
        adapter(backends.Batched, Stub(empty=True)).candidates((10, 10, 40, 30), None, "fast")


def test_interactive():
    model = Stub()
    found = adapter(backends.Interactive, model).candidates((10, 10, 40, 30), None, "maximum")
    assert found[0].prompt == "original box / mask 1" and found[0].mask.shape == (60, 80) and found[0].mask.sum() == 600
    inside = list(map(float, R.interior_point(max(found, key=lambda c: c.score).mask)))
    points = [c for c in model.calls if c[1]]
    assert points[0] == (1, [inside], [1], True) and all(c[3] for c in model.calls)
    assert {c.prompt.split(" / ")[0] for c in found} >= {"box + inferred interior point", "expand 6%"}
    model = Stub(fails=(True,))  # only single masks
    found = adapter(backends.Interactive, model).candidates((10, 10, 40, 30), None, "fast")
    assert [c[3] for c in model.calls] == [True, False] and [c.prompt for c in found] == ["original box / mask 1"]
    with pytest.raises(RuntimeError, match="every prompt failed"):
        adapter(backends.Interactive, Stub(fails=(True, False))).candidates((10, 10, 40, 30), None, "balanced")


def test_points_outside_of_the_mask():
    m = np.zeros((50, 50), bool)
    m[10:20, 10:20] = True
    assert R.negative_points(m, (0, 0, 100, 100)) == [(12, 49), (49, 12)][::-1]
    assert R.negative_points(~m, (10, 10, 20, 20)) == [(11, 11), (18, 11)]


def test_registry():
    with pytest.raises(ValueError, match="no backend"):
        backends.build("other")
    with pytest.raises(RuntimeError, match="no model"):
        backends.build("sam2").load()
    backends.use_model("sam2", Stub)
    try:
        assert isinstance(backends.maker("sam2")().__class__, type) and backends.build("sam2").name == "sam2"
    finally:
        backends.REGISTRY["sam2"] = backends.Batched
