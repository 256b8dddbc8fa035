"""Headers as tables, the NIfTI sink and the MAT source."""

import itertools
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from latmix.operators import lattice
from latmix.sources import matfile, nifti, nifti_sink


def turn(a, b, c):
    x, y, z = ([[1, 0, 0], [0, np.cos(a), -np.sin(a)], [0, np.sin(a), np.cos(a)]], [[np.cos(b), 0, np.sin(b)], [0, 1, 0], [-np.sin(b), 0, np.cos(b)]], [[np.cos(c), -np.sin(c), 0], [np.sin(c), np.cos(c), 0], [0, 0, 1]])
    return np.array(x) @ np.array(y) @ np.array(z)


def affine(rot, zoom, origin):
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = rot @ np.diag(zoom), origin
    return out


def test_exponentials():
    rng = np.random.default_rng(1)
    for scale in (1e-6, 0.3, 1.0):
        x = rng.normal(size=(4, 4)) * scale
        assert np.allclose(lattice.logm(lattice.expm(x)), x, atol=1e-9)
    assert np.allclose(lattice.expm(np.diag([1.0, 2.0])), np.diag(np.exp([1.0, 2.0])))
    assert np.allclose(lattice.logm(np.diag([8.0, 0.1, 3.0, 1.0])), np.diag(np.log([8.0, 0.1, 3.0, 1.0])))


def test_axial():
    """All 48 ways to lay down an image come back to the same one, voxel by voxel."""
    base, dim = affine(turn(0.1, -0.05, 0.2), (1.0, 2.0, 3.0), (5.0, 6.0, 7.0)), (4, 5, 6)
    for p in itertools.permutations(range(3)):
        for f in itertools.product((1, -1), repeat=3):
            laid = np.zeros((4, 4))
            laid[3, 3] = 1
            for a in range(3):
                laid[p[a], a] = f[a]
                if f[a] < 0:
                    laid[p[a], 3] = dim[p[a]] + 1
            got, d = lattice.to_axial(base @ laid, [dim[x] for x in p])
            assert np.allclose(got, base) and d == dim


def test_without_shear():
    rng = np.random.default_rng(2)
    M = affine(turn(0.2, 0.1, -0.3), (1.5, 0.8, 2.0), (10.0, -4.0, 3.0))
    assert np.allclose(lattice.without_shear(M), M)
    S = M.copy()
    S[:3, :3] += rng.normal(size=(3, 3)) * 0.05
    got = lattice.without_shear(S)
    gram = got[:3, :3].T @ got[:3, :3]
    assert np.allclose(gram, np.diag(np.diag(gram)), atol=1e-8)
    for a, (x, y, z) in itertools.product((1e-3, -1e-3), np.eye(3)):  # no neighbour of its kind is nearer
        for other in (affine(turn(*(a * v for v in (x, y, z))), (1, 1, 1), (0, 0, 0)) @ got, got @ np.diag([1 + a * x, 1 + a * y, 1 + a * z, 1])):
            other[:3, 3] = got[:3, 3]
            assert ((other - S) ** 2).sum() >= ((got - S) ** 2).sum() - 1e-12


def test_average_of_rotations(spark):
    """Turns about one axis average to the mean angle; the box holds all images but for a twentieth."""
    angles, rows = (-0.2, 0.0, 0.1, 0.3), []
    for n, a in enumerate(angles):
        M, dim = affine(turn(0, 0, a), (1.0, 1.0, 2.0), (0.0, 0.0, 0.0)), [20, 20, 10]
        if n % 2:  # one axis flipped
            flip = np.diag([1.0, -1.0, 1.0, 1.0])
            flip[1, 3] = 21
            M = M @ flip
        rows.append((M.ravel().tolist(), dim))
    M, dim = lattice.average_header(spark.createDataFrame(rows, "mat array<double>, dim array<int>").repartition(3))
    assert np.allclose(M[:3, :3], turn(0, 0, np.mean(angles)) @ np.diag([1, 1, 2])) and dim[2] == 10 - np.floor(9 * 0.05) and dim[0] > 20
    few, d = lattice.average_affine([np.array(m).reshape(4, 4) for m, _ in rows], [d for _, d in rows])
    assert np.allclose(few, M) and d == dim
    flat = lattice.average_affine([np.eye(4)], [(5, 5, 1)])
    assert flat[1][2] == 1
    with pytest.raises(ValueError):
        lattice.average_header(spark.createDataFrame([], "mat array<double>, dim array<int>"))


def test_reorient_gives_the_image_back(spark):
    """A flipped and exchanged image comes out as the plain one; higher degrees hit voxels too."""
    dim = (4, 3, 5)
    x = np.random.default_rng(3).normal(size=dim)
    laid = np.array([[0, -1.0, 0, 5.0], [1.0, 0, 0, 0], [0, 0, 1.0, 0], [0, 0, 0, 1]])  # voxel (a, b, c) lies at (5 - b, a, c)
    img = spark.createDataFrame([(j + 1, 4 - i, k + 1, float(x[i, j, k])) for i, j, k in np.ndindex(*dim)], "i int, j int, k int, v double")
    for degree in (0, 1, 4):
        out, M, d = lattice.reorient(img, laid, (3, 4, 5), degree=degree)
        got = {(r["i"], r["j"], r["k"]): r["v"] for r in out.collect()}
        assert d == dim and np.allclose(M, np.eye(4)) and all(abs(got[i + 1, j + 1, k + 1] - x[i, j, k]) < 1e-9 for i, j, k in np.ndindex(*dim))


def test_sink(spark, tmp_path):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(3, 4, 5)), rng.integers(-90, 90, size=(2, 3, 2, 2)).astype(float)
    rows = [("x.nii", i + 1, j + 1, k + 1, 1, float(x[i, j, k])) for i, j, k in np.ndindex(*x.shape) if k != 2] + [("y.nii.gz", i + 1, j + 1, k + 1, c + 1, float(y[i, j, k, c])) for i, j, k, c in np.ndindex(*y.shape)]
    rows += [("x.nii", 9, 1, 1, 1, 5.0), ("none.nii", 1, 1, 1, 1, 1.0), ("x.nii", 1, 1, 1, 2, 5.0)]
    heads = [("x.nii", [3, 4, 5], np.diag([1.0, 2.0, 3.0, 1.0]).ravel().tolist()), ("y.nii.gz", [2, 3, 2, 2], np.eye(4).ravel().tolist()), ("empty.nii", [2, 2, 2], np.eye(4).ravel().tolist())]
    voxels = spark.createDataFrame(rows, "name string, i int, j int, k int, c int, v double").repartition(5)
    headers = spark.createDataFrame(heads, "name string, dim array<int>, mat array<double>")
    nifti_sink.write(voxels, headers, f"file://{tmp_path}/out", 64, description="by slices")
    assert sorted(os.listdir(tmp_path / "out")) == ["empty.nii", "x.nii", "y.nii.gz"]
    want = {"x.nii": x * (np.arange(5) != 2), "y.nii.gz": y, "empty.nii": np.zeros((2, 2, 2))}
    for name, v in want.items():
        dim, M, values = nifti.parse((tmp_path / "out" / name).read_bytes())
        assert dim == v.shape and np.allclose(values.reshape(dim, order="F"), v)
    assert np.allclose(nifti.parse((tmp_path / "out" / "x.nii").read_bytes())[1], np.diag([1, 2, 3, 1]))
    nifti_sink.write(voxels.where("name = 'y.nii.gz'"), headers.where("name = 'y.nii.gz'"), f"file://{tmp_path}/small", 256, 0.5, 1.0)
    assert np.allclose(nifti.parse((tmp_path / "small" / "y.nii.gz").read_bytes())[2].reshape(y.shape, order="F"), np.clip(y, -63.0, 64.5))


def test_sink_of_a_failed_job(spark, tmp_path):
    """A task that fails leaves nothing behind that looks like an image."""
    bad = spark.createDataFrame([("x.nii", 1, 1, 1, 1.0)], "name string, i int, j int, k int, v double").withColumn("v", F.raise_error("broken").cast("double"))
    headers = spark.createDataFrame([("x.nii", [2, 2, 2], np.eye(4).ravel().tolist())], "name string, dim array<int>, mat array<double>")
    with pytest.raises(Exception, match="broken"):
        nifti_sink.write(bad, headers, f"file://{tmp_path}/out")
    assert not (tmp_path / "out").exists() or not [f for f in os.listdir(tmp_path / "out") if not f.startswith(".")]


# MAT files ------------------------------------------------------------------------------------------------
def element(kind, payload, end="<", small=False):
    if small:
        return struct.pack(end + "I", len(payload) << 16 | kind) + payload.ljust(4, b"\0")
    return struct.pack(end + "II", kind, len(payload)) + payload + b"\0" * (-len(payload) % 8)


def array(name, cls, dim, *parts, flags=0, end="<"):
    head = element(6, struct.pack(end + "II", cls | flags, 0), end) + element(5, struct.pack(f"{end}{len(dim)}i", *dim), end) + element(1, name.encode(), end, small=0 < len(name) <= 4)
    return element(14, head + b"".join(parts), end)


def file(*arrays, end="<"):
    return b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack(end + "H", 0x0100) + (b"IM" if end == "<" else b"MI") + b"".join(arrays)


def double(name, x, end="<", **more):
    x = np.asarray(x, float)
    return array(name, 6, x.shape, element(9, x.astype(end + "f8").tobytes(order="F"), end), end=end, **more)


def test_mat_files(spark, tmp_path):
    x = np.arange(6).reshape(2, 3)
    packed = zlib.compress(double("packed", x))
    inner = [double("", [[1.5]]), array("", 4, (1, 3), element(16, b"abc", small=True)), double("", [[2.5]]), array("", 4, (1, 2), element(17, "é!".encode("utf-16-le")))]
    arrays = [
        double("x", x), struct.pack("<II", 15, len(packed)) + packed, array("n", 8, (1, 3), element(1, struct.pack("3b", -1, 2, 3), small=True)), array("flag", 9, (1, 2), element(2, b"\1\0", small=True), flags=0x200),
        array("words", 4, (2, 3), element(16, "".join("abcdef"[r * 3 + c] for c in range(3) for r in range(2)).encode())),
        array("s", 2, (1, 2), element(5, struct.pack("<i", 8), small=True), element(1, b"num".ljust(8, b"\0") + b"text".ljust(8, b"\0")), *inner),
        array("cell", 1, (1, 2), double("", [[7.0]]), array("", 1, (1, 1), double("", [[8.0, 9.0]]))),
        array("sp", 5, (3, 2), element(5, struct.pack("<2i", 2, 0)), element(5, struct.pack("<3i", 0, 1, 2)), element(9, struct.pack("<2d", 4.0, 5.0))),
        array("z", 6, (1, 1), element(9, struct.pack("<d", 1.0)), element(9, struct.pack("<d", -2.0)), flags=0x800), double("none", np.zeros((0, 0))),
    ]
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.mat").write_bytes(file(*arrays))
    (tmp_path / "deep" / "b.mat").write_bytes(file(double("x", [[3.25]], end=">"), end=">"))
    (tmp_path / "cut.mat").write_bytes(file(double("whole", [[1.0]]), double("lost", x))[:-20])
    (tmp_path / "bad.mat").write_bytes(b"nonsense")
    (tmp_path / "x.txt").write_bytes(b"no")
    rows = matfile.read(spark, str(tmp_path))
    got = {(r["path"].rsplit("/", 1)[1], r["name"]): r for r in rows.collect()}
    a = {n: r for (f, n), r in got.items() if f == "a.mat"}
    for name in ("x", "packed"):
        assert a[name]["kind"] == "double" and a[name]["dim"] == [2, 3] and np.allclose(np.reshape(a[name]["number"], (2, 3), order="F"), x)
    assert a["n"]["kind"] == "int8" and a["n"]["number"] == [-1, 2, 3] and a["flag"]["kind"] == "logical" and a["flag"]["number"] == [1, 0]
    assert a["words"]["text"] == "abc\ndef" and a["s"]["kind"] == "struct" and a["s(1).num"]["number"] == [1.5] and a["s(1).text"]["text"] == "abc" and a["s(2).num"]["number"] == [2.5] and a["s(2).text"]["text"] == "é!"
    assert a["cell(1)"]["number"] == [7.0] and a["cell(2)(1)"]["number"] == [8.0, 9.0] and np.allclose(np.reshape(a["sp"]["number"], (3, 2), order="F"), [[0, 5], [0, 0], [4, 0]])
    assert a["z"]["number"] == [1.0] and a["z"]["imag"] == [-2.0] and a["none"]["number"] == [] and a["none"]["dim"] == [0, 0]
    assert [n for f, n in got if f == "cut.mat"] == ["whole"] and not [f for f, _ in got if f in ("bad.mat", "x.txt")]
    assert sorted(r["value"] for r in matfile.parameter(rows, "x").collect()) == [0.0, 3.25]
    assert matfile.parameter(rows, "s(1).text").head()["value"] is None
