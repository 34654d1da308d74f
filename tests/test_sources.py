"""Numbered lines and XYZ frames: the same for any size of splits."""

import random

import pytest

from granula.sources import lines, xyz


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out, r = tmp_path_factory.mktemp("xyz"), random.Random(3)
    frames = {}
    for name in ("a", "b"):
        text, frames[name] = "", []
        for k in range(40):
            n = r.choice([0, 1, 3, 12]) if k else 1234
            comment = r.choice(["", "7", "1 2", "frame 3 of 4", "a comment"])
            atoms = [(r.choice(["Au", "1", "Co"]), *(r.choice([r.randint(-9, 9), round(r.uniform(-9, 9), 3)]) for _ in range(3)), r.choice([None, 0, 1])) for _ in range(n)]
            count = f" {n}  " if n < 1000 or r.random() < 0.1 else "1 234"
            text += f"{count}\n{comment}\n" + "".join(" ".join(str(v) for v in a if v is not None) + "\n" for a in atoms) + "\n" * r.choice([0, 0, 2])
            frames[name].append((comment, atoms))
        (out / f"{name}.xyz").write_text(text if name == "a" else text.rstrip("\n"))
    return out, frames


@pytest.mark.parametrize("split", [97, 1000, 1 << 20])
def test_frames_for_any_size_of_splits(spark, folder, split):
    path, frames = folder
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, str(split) if "max" in k else "1")
        rows = xyz.read_xyz(spark, str(path))
        parts = lines.numbered_lines(spark, str(path)).rdd.getNumPartitions()
        assert parts > 50 or split > 97
        got = {}
        for x in rows.collect():
            got.setdefault((x.path.rsplit("/", 1)[1][0], x.frame), []).append((x.atom_id, x.comment, x.element, x.x, x.y, x.z, x.surf))
        want = {(n, f): [(i, c, a[0], *map(float, a[1:4]), a[4]) for i, a in enumerate(atoms, 1)] for n, fs in frames.items() for f, (c, atoms) in enumerate(fs, 1) if atoms}
        assert {k: sorted(v) for k, v in got.items()} == want
        text = sorted((x.path, x.line_no, x.line) for x in lines.numbered_lines(spark, str(path)).collect())
        for name in "ab":
            whole = (path / f"{name}.xyz").read_text().split("\n")
            mine = [x[2] for x in text if x[0].endswith(f"{name}.xyz")]
            assert mine == whole[: len(mine)] and not any(whole[len(mine) :])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_written_frames_are_read_again(spark, tmp_path):
    rows = [("p", 1, "first", 2, "Co", 1.5, 2.0, 3.0, 1), ("p", 1, "first", 1, "Au", 0.0, -1.0, 2.5, 0), ("p", 2, None, 1, "Au", 1.0, 1.0, 1.0, 1)]
    atoms = spark.createDataFrame(rows, "path string, frame int, comment string, atom_id int, element string, x double, y double, z double, surf int")
    xyz.write_xyz(atoms, str(tmp_path / "out"), ("surf",))
    got = sorted((x.comment, x.atom_id, x.element, x.x, x.y, x.z, x.surf) for x in xyz.read_xyz(spark, str(tmp_path / "out")).collect())
    assert got == sorted(("" if c is None else c, i, *rest) for _, _, c, i, *rest in rows)
    odd = atoms.selectExpr("* except (x)", "cast(null as double) AS x")
    xyz.write_xyz(odd, str(tmp_path / "nulls"), ("surf",))
    assert {(x.x, x.y is None, x.surf is None) for x in xyz.read_xyz(spark, str(tmp_path / "nulls")).collect()} == {(None, False, False)}


def test_cut_off_and_broken_lines(spark, tmp_path):
    (tmp_path / "x.xyz").write_text("3\nc\nAu 1 2 3\nAu 1 x\n")
    got = [(x.atom_id, x.element, x.x, x.y, x.z) for x in xyz.read_xyz(spark, str(tmp_path)).orderBy("atom_id").collect()]
    assert got == [(1, "Au", 1.0, 2.0, 3.0), (2, "Au", 1.0, None, None)]
