"""Folder to dataset and back: scan, convert, resume, guard, stream."""

import json
import shutil

import numpy as np
import pytest

from tessera.operators import backends, control, render
from tessera.operators.backends import Candidate
from tessera.plans.convert import Settings
from tessera.sources import images as I
from tessera.sources.decode import pixels
from tessera.sources.names import class_names
from tessera.streaming.convert import convert, convert_stream


def picture(path, w=160, h=120, seed=0):
    rng = np.random.default_rng(seed)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(render.png(rng.integers(0, 255, (h, w, 3), dtype=np.uint8)))


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "source"
    for i, name in enumerate(("a", "b", "c", "d")):
        picture(root / "images/train" / f"{name}.png", seed=i)
    labels = root / "labels/train"
    labels.mkdir(parents=True)
    (labels / "a.txt").write_text("0 0.5 0.5 0.4 0.4\n\n2 0.3 0.3 0.2 0.2\n")
    (labels / "b.txt").write_text("0 not numbers here\n0 0.5 0.5 0.2 0.2\n")
    (labels / "c.txt").write_text("0 0.1 0.1 0.8 0.1 0.8 0.8 0.1 0.8\n")
    (root / "data.yaml").write_text("names: [Hair]\n")
    return root


def test_scan(spark, folder):
    data = I.scan(spark, str(folder))
    assert {r.relative_image: (r.width, r.height) for r in data.images.collect()} == {f"images/train/{n}.png": (160, 120) for n in "abcd"}
    got = {(r.relative_image[-5], r.instance_index): (r.class_id, r.kind) for r in data.annotations.collect()}
    assert got == {("a", 0): (0, "detection"), ("a", 1): (2, "detection"), ("b", 0): (0, "detection"), ("c", 0): (0, "polygon")}
    assert [(r.relative_image, r.line_no, r.issue) for r in data.issues.collect()] == [("images/train/b.png", 1, "Line 1: non-numeric YOLO annotation")]
    assert data.names == {0: "Hair"}
    with pytest.raises(FileNotFoundError):
        I.scan(spark, str(folder / "missing"))


def test_names(spark, tmp_path):
    (tmp_path / "classes.txt").write_text("one\n\ntwo\n")
    assert class_names(spark, str(tmp_path)) == {0: "one", 1: "two"}
    (tmp_path / "z.YAML").write_text("names: {0: x, 3: y}\n")
    (tmp_path / "a.yaml").write_text("names: [\n")
    (tmp_path / "b.yml").write_text("names: {first: x}\n")
    assert class_names(spark, str(tmp_path)) == {0: "x", 3: "y"}
    (tmp_path / "a").mkdir()
    (tmp_path / "a/data.yaml").write_text("names: [nested]\n")
    assert class_names(spark, str(tmp_path)) == {0: "nested"}
    (tmp_path / "dataset.yaml").write_text("names: [root]\n")
    assert class_names(spark, str(tmp_path)) == {0: "root"}
    (tmp_path / "data.yaml").write_text("names: [first]\n")
    assert class_names(spark, str(tmp_path)) == {0: "first"}


@pytest.mark.parametrize("name", ["data/x/data", "set(1)", "a+b", "x[1]{2} %41?*"])
def test_any_root(spark, folder, tmp_path, name):
    """Roots whose last name stands earlier in the path, or holds characters that patterns and URIs give a meaning."""
    root, out = tmp_path / "in" / name, tmp_path / "out" / name
    shutil.copytree(folder, root)
    (root / "images/train/a.png").rename(root / "images/train/a %41[1].png")
    (root / "labels/train/a.txt").rename(root / "labels/train/a %41[1].txt")
    summary = convert(spark, str(root), str(out), Settings(copy_images=True))
    assert (summary["images"], summary["processed_object_rows"], summary["failed_images"]) == (4, 3, 1)
    assert len((out / "dataset/labels/train/a %41[1].txt").read_text().splitlines()) == 2 and (out / "dataset/images/train/a %41[1].png").exists()
    assert control.completed(spark, str(out)).where("objects > 0").count() == 2
    again = convert(spark, str(root), str(out))
    assert (again["processed_object_rows"], again["failed_images"]) == (3, 1)


def test_a_run_that_never_ended_leaves_no_rows(spark, folder, tmp_path, monkeypatch):
    out = str(tmp_path / "out")

    def lost(*_):
        raise OSError("the machine went away")

    with monkeypatch.context() as m:
        m.setattr(control, "mark_completed", lost)
        with pytest.raises(OSError):
            convert(spark, str(folder), out)
    assert list((tmp_path / "out/_debug_and_logs/reports/objects.csv").iterdir())
    assert convert(spark, str(folder), out)["processed_object_rows"] == 3
    assert convert(spark, str(folder), out)["processed_object_rows"] == 3


def test_an_image_without_a_result_is_a_failure(spark, folder, tmp_path, monkeypatch):
    from tessera.plans import convert as plan

    refine = plan.refine
    monkeypatch.setattr(plan, "refine", lambda *a: refine(*a).where("relative_image not like '%c.png'"))
    summary = convert(spark, str(folder), str(tmp_path / "out"))
    assert (summary["processed_object_rows"], summary["failed_images"]) == (2, 2)
    monkeypatch.undo()
    summary = convert(spark, str(folder), str(tmp_path / "out"))
    assert (summary["processed_object_rows"], summary["failed_images"]) == (3, 1)


def test_rounds_can_be_stopped_and_taken_up(spark, folder, tmp_path):
    steering, out = control.Steering(), str(tmp_path / "out")
    assert steering.toggle_pause() and not steering.toggle_pause()
    steering.stop()
    stopped = convert(spark, str(folder), out, steering=steering)
    assert stopped["processed_object_rows"] == 0 and (steering.done, steering.total) == (0, 4)
    steering = control.Steering()
    assert convert(spark, str(folder), out, steering=steering, round_images=1)["processed_object_rows"] == 3
    assert steering.done == steering.total == 4


def test_outputs_are_no_sources(spark, folder, tmp_path):
    convert(spark, str(folder), str(tmp_path / "out"), Settings(copy_images=True, save_comparisons=True, save_previews=True))
    assert len(list((tmp_path / "out/_debug_and_logs/comparisons").rglob("*.png"))) == 2
    with pytest.raises(ValueError, match="output of a conversion"):
        I.scan(spark, str(tmp_path / "out/dataset"))


def test_convert_resume_and_guards(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    summary = convert(spark, str(folder), out, Settings(save_overlays=True, save_masks=True, copy_images=True))
    assert (summary["images"], summary["processed_object_rows"], summary["failed_images"]) == (4, 3, 1)
    assert "placeholder" in summary["warning"] and summary["prompts_seen"]
    labels = tmp_path / "out/dataset/labels/train"
    lines = (labels / "a.txt").read_text().splitlines()
    assert [x.split()[0] for x in lines] == ["0", "2"] and all(0 <= float(v) <= 1 for x in lines for v in x.split()[1:])
    assert (labels / "d.txt").read_text() == "" and not (labels / "b.txt").exists()
    assert "names" in (tmp_path / "out/dataset/data.yaml").read_text() and "class_1" in (tmp_path / "out/dataset/data.yaml").read_text()
    assert len(list((tmp_path / "out/_debug_and_logs/overlays").rglob("*.png"))) == 2
    masks = sorted(p.name for p in (tmp_path / "out/_debug_and_logs/masks/images/train/a").iterdir())
    assert masks == ["instance_000.png", "instance_001.png"]
    assert (tmp_path / "out/dataset/images/train/a.png").read_bytes() == (folder / "images/train/a.png").read_bytes()
    picture(folder / "images/train/e.png", seed=9)
    (folder / "labels/train/e.txt").write_text("0 0.5 0.5 0.5 0.5\n")
    before = (labels / "a.txt").stat().st_mtime_ns
    again = convert(spark, str(folder), out)
    assert again["processed_object_rows"] == 4 and (labels / "a.txt").stat().st_mtime_ns == before and (labels / "e.txt").exists()
    with pytest.raises(RuntimeError):
        convert(spark, str(folder), out, Settings(preset="fast"))
    with pytest.raises(ValueError):
        convert(spark, str(folder), str(folder / "out"))
    assert control.generated_marker(spark, f"{out}/dataset/labels") == out
    assert control.free_output(spark, out) == out + "_v2" and control.artifact_dir(spark, out, "reports").endswith("_debug_and_logs/reports")


class Strands(backends.Backend):
    def set_image(self, rgb):
        self.shape = rgb.shape[:2]

    def candidates(self, box, polygon, preset):
        m = np.zeros(self.shape, bool)
        m[40:46, 30:130] = m[80:86, 30:130] = True
        return [Candidate(m, 0.9, "strands")]


def test_two_strands_give_two_rows(spark, tmp_path):
    from tessera.plans.convert import refined

    b = Strands()
    b.set_image(np.zeros((120, 160, 3)))
    profile = {"close_kernel": 0, "open_kernel": 0, "min_component_area": 2, "preserve_thin": True, "max_leakage": 0.28, "target_fidelity": 0.995, "max_parts": 0}
    got = refined({"bbox": {"x0": 20, "y0": 30, "x1": 140, "y1": 100}, "polygon": None}, profile, b, "fast", np.zeros((120, 160), bool))
    assert got["parts"] == 2 and len(got["rings"]) == 2 and got["fidelity"] == pytest.approx(1.0) and got["stability"] == 1.0


def test_stream_takes_up_new_images_only(spark, folder, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    convert_stream(spark, str(folder), out, check).awaitTermination()
    first = json.loads((tmp_path / "out/_debug_and_logs/reports/summary.json").read_text())
    assert first["processed_object_rows"] == 3
    picture(folder / "images/train/f.png", seed=5)
    (folder / "labels/train/f.txt").write_text("1 0.5 0.5 0.3 0.3\n")
    convert_stream(spark, str(folder), out, check).awaitTermination()
    second = json.loads((tmp_path / "out/_debug_and_logs/reports/summary.json").read_text())
    assert second["processed_object_rows"] == 4


def test_pictures():
    rgb = np.random.default_rng(0).integers(0, 255, (20, 30, 3), dtype=np.uint8)
    data = render.png(rgb)
    assert (pixels(data) == rgb).all() and I.image_size(data) == (30, 20)
    assert I.image_size(b"nothing") is None
    assert render.comparison(rgb, rgb).shape == (20, 72, 3)
    drawn = render.overlay(rgb, [(2, 2, 8, 8)], [([np.array([(10, 5), (20, 5), (20, 15), (10, 15)])], "accepted")])
    assert (drawn != rgb).any() and drawn.shape == rgb.shape


@pytest.mark.parametrize("kind", ["JPEG", "TIFF", "WEBP"])
def test_formats_of_the_image_library(kind):
    """Where an image library is installed, its formats are read too; sizes are read without it."""
    import io

    image = pytest.importorskip("PIL.Image")
    out = io.BytesIO()
    image.fromarray(np.full((20, 30, 3), 90, np.uint8)).save(out, kind)
    assert I.image_size(out.getvalue()) == (30, 20)
    got = pixels(out.getvalue())
    assert got.shape == (20, 30, 3) and abs(int(got.mean()) - 90) < 3
