"""Segmentation backends: one is loaded per Python worker and asked for candidates of each object."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from tessera.functions import raster as R
from tessera.schema import PROMPTS


@dataclass
class Candidate:
    mask: np.ndarray
    score: float
    prompt: str
    metrics: dict = field(default_factory=dict)


class Backend:
    """What a model must offer. Masks have the image's size."""

    name = "none"

    def load(self) -> None:
        """Called once per worker."""

    def set_image(self, rgb: np.ndarray) -> None:
        raise NotImplementedError

    def candidates(self, box: tuple, polygon: np.ndarray | None, preset: str) -> list[Candidate]:
        raise NotImplementedError

    def close_image(self) -> None:
        """Called after an image's last object."""

    @property
    def device_label(self) -> str:
        return "CPU"


def perturbed(box: tuple, w: int, h: int, scale: float, dx: float, dy: float) -> tuple:
    x0, y0, x1, y1 = box
    bw, bh = max(1.0, x1 - x0), max(1.0, y1 - y0)
    clamp = lambda v, hi: max(0.0, min(float(hi), v))
    return clamp(
        x0 - bw * scale / 2 + bw * dx, w - 1,
    ), clamp(y0 - bh * scale / 2 + bh * dy, h - 1), clamp(x1 + bw * scale / 2 + bw * dx, w - 1), clamp(y1 + bh * scale / 2 + bh * dy, h - 1)


class Fallback(Backend):
    """The deterministic placeholder: source polygons as they are, ellipses for boxes. Its output is always reported as placeholder."""

    name = "fallback"

    def set_image(self, rgb: np.ndarray) -> None:
        self.h, self.w = rgb.shape[:2]

    def candidates(self, box: tuple, polygon: np.ndarray | None, preset: str) -> list[Candidate]:
        if polygon is not None and len(polygon):
            return [Candidate(R.from_polygon(polygon, self.w, self.h), 0.65, "existing polygon")]
        out = []
        for i, (name, scale, dx, dy) in enumerate(PROMPTS["fallback"].get(preset, PROMPTS["fallback"]["fast"])):
            x0, y0, x1, y1 = perturbed(box, self.w, self.h, scale, dx, dy)
            m = R.ellipse(self.w, self.h, int((x0 + x1) / 2), int((y0 + y1) / 2), max(1, int((x1 - x0) * 0.45)), max(1, int((y1 - y0) * 0.45)))
            out.append(Candidate(m, 0.70 - 0.02 * i, name))
        return out


class Model:
    """A segmentation model that an adapter drives. Masks may be logits, probabilities or booleans, of any size."""

    def encode(self, rgb: np.ndarray) -> None:
        raise NotImplementedError

    def predict(self, boxes: np.ndarray, points: np.ndarray | None = None, labels: np.ndarray | None = None, several: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(masks, scores) for boxes (n x 4) with one mask each, or for one box with points and several masks."""
        raise NotImplementedError

    def release(self) -> None:
        """Forgets the image."""


class Prompting(Backend):
    """What adapters share: a model that is made once per worker, the frame, and masks made of its output."""

    def __init__(self, make=None):
        self.make, self.model = make, None

    def load(self) -> None:
        if self.model is None:
            if self.make is None:
                raise RuntimeError(f"no model is registered for {self.name}; see use_model()")
            self.model = self.make()

    def set_image(self, rgb: np.ndarray) -> None:
        self.load()
        self.h, self.w = rgb.shape[:2]
        self.model.encode(rgb)

    def close_image(self) -> None:
        if self.model is not None:
            self.model.release()

    def masks(self, output: np.ndarray, scores: np.ndarray, probabilities: bool) -> list[tuple[np.ndarray, float]]:
        """Masks of the frame's size with their scores; a score that isn't finite counts as 0."""
        output, scores = np.asarray(output), np.asarray(scores, float).ravel()
        out = []
        for i, m in enumerate(output.reshape(-1, *output.shape[-2:])):
            if m.dtype.kind == "f":
                m = R.binarised(m) if probabilities else np.nan_to_num(m, nan=-1.0) > 0
            m = m.astype(bool)
            if m.shape != (self.h, self.w):
                m = R.resized(m, self.w, self.h)
            out.append((m, float(scores[i]) if i < len(scores) and np.isfinite(scores[i]) else 0.0))
        return out

    def prompts(self, box: tuple, preset: str) -> list[tuple[str, tuple]]:
        table = PROMPTS[self.name]
        return [(name, perturbed(box, self.w, self.h, *move)) for name, *move in table.get(preset, table["balanced"])]


def usable(box: tuple) -> bool:
    return bool(np.isfinite(box).all()) and box[2] - box[0] >= 1 and box[3] - box[1] >= 1


class Batched(Prompting):
    """All prompts of an object in one call, one mask each; degenerate prompts are left out."""

    name = "sam2"

    def candidates(self, box: tuple, polygon: np.ndarray | None, preset: str) -> list[Candidate]:
        asked = [(name, b) for name, b in self.prompts(box, preset) if usable(b)]
        if not asked:
            raise RuntimeError(f"degenerate box {box}")
        found = self.masks(*self.model.predict(np.array([b for _, b in asked], np.float32)), probabilities=True)
        out = [Candidate(m, score, asked[min(i, len(asked) - 1)][0]) for i, (m, score) in enumerate(found) if m.any()]
        if not out:
            raise RuntimeError("no prompt gave a mask")
        return out


class Interactive(Prompting):
    """One call for each prompt, several masks each, then points: the best mask's interior, and corners that it leaves out.

    A prompt may fail as long as another one doesn't; a call without a mask is tried again for a single mask.
    """

    name = "sam3"

    def candidates(self, box: tuple, polygon: np.ndarray | None, preset: str) -> list[Candidate]:
        out: list[Candidate] = []
        failed: list[str] = []

        def ask(name: str, b: tuple, points: list | None = None, labels: list | None = None) -> None:
            try:
                out.extend(self.asked(name, b, points, labels))
            except Exception as e:  # the other prompts may still do
                failed.append(f"{name}: {e}")

        for name, b in self.prompts(box, preset):
            ask(name, b)
        if out and preset in ("balanced", "maximum"):
            best = max(out, key=lambda c: c.score).mask
            base = perturbed(box, self.w, self.h, 0.03, 0.0, 0.0)
            inside = R.interior_point(best)
            ask("box + inferred interior point", base, [inside], [1])
            if preset == "maximum" and (outside := R.negative_points(best, base)):
                ask("box + interior + exterior points", base, [inside, *outside], [1] + [0] * len(outside))
        if not out:
            raise RuntimeError("every prompt failed: " + " | ".join(failed[:4]))
        return out

    def asked(self, name: str, box: tuple, points: list | None, labels: list | None) -> list[Candidate]:
        if not usable(box):
            raise ValueError(f"degenerate box {box}")
        at = None if points is None else np.array(points, np.float32)
        marks = None if labels is None else np.array(labels, np.int32)
        errors = []
        for several in (True, False):
            try:
                found = self.masks(*self.model.predict(np.array([box], np.float32), at, marks, several), probabilities=False)
            except Exception as e:  # some models only fail when asked for several masks
                errors.append(f"{type(e).__name__}: {e}")
                continue
            if any(m.any() for m, _ in found):
                return [Candidate(m, score, f"{name} / mask {j + 1}") for j, (m, score) in enumerate(found) if m.any()]
            errors.append("only empty masks")
        raise RuntimeError(", ".join(errors))


#: Backends by name, made once per worker.
REGISTRY: dict[str, Callable[[], Backend]] = {"fallback": Fallback, "sam2": Batched, "sam3": Interactive}


def use_model(name: str, make: Callable[[], Model]) -> None:
    """Gives an adapter its model: `make` is called once per worker, so models are loaded where they run."""
    adapter = {"sam2": Batched, "sam3": Interactive}[name]
    REGISTRY[name] = lambda: adapter(make)


def maker(name: str) -> Callable[[], Backend]:
    """What makes a backend; it goes to the workers, where registrations of the driver aren't known."""
    if name not in REGISTRY:
        raise ValueError(f"no backend named {name}; there are {sorted(REGISTRY)}")
    return REGISTRY[name]


def build(name: str) -> Backend:
    return maker(name)()
