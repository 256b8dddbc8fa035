"""Small pieces: generators, collapsed priors, image dimensions, non-finite values, the catalogue's entries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from latmix.operators import gmm, lattice, observations
from latmix.sources import catalog


def test_regularised_generators():
    assert lattice.regularised("rigid") == lattice.regularised("translation") == []
    assert lattice.regularised("affine") == list(range(6, 12)) and lattice.regularised("affine", True) == [3, 4, 5]
    assert lattice.regularised("similitude") == [6] and lattice.regularised("similitude", True) == [3]


def test_collapsed_prior():
    V = np.array([np.diag([1.0, 2.0]), np.diag([3.0, 1.0]), np.eye(2)])
    prior = gmm.Prior(np.array([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]]), np.array([1.0, 3.0, 5.0]), V, np.array([4.0, 6.0, 8.0]), np.array([1.0, 2.0, 3.0]))
    got = gmm.collapse_prior(prior, [0, 0, 1])
    assert np.allclose(got.mu, [[2, 3], [9, 9]]) and np.allclose(got.b, [2, 5]) and np.allclose(got.n, [5, 8]) and np.allclose(got.alpha, [3, 3])
    want = (np.linalg.inv(4 * V[0]) + np.linalg.inv(6 * V[1])) / 2
    assert np.allclose(np.linalg.inv(got.n[0] * got.V[0]), want) and np.allclose(got.V[1], V[2])


def test_image_dimension(spark):
    frame = lambda dims: spark.createDataFrame([(d,) for d in dims], "dim array<int>")
    assert [r[0] for r in catalog.image_dimension(frame([[3, 4, 5], [1, 1, 2]])).collect()] == [3]
    assert [r[0] for r in catalog.image_dimension(frame([[3, 4], [3, 4, 1]])).collect()] == [2]
    assert catalog.image_dimension(frame([])).count() == 0
    with pytest.raises(Exception, match="two and of three"):
        catalog.image_dimension(frame([[3, 4, 5], [3, 4, 1]])).collect()


def test_non_finite(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,), (float("-inf"),)], "a double")
    assert [r[0] for r in observations.canonical(df, ["a"]).collect()] == [1.0, None, float("inf"), None, float("-inf")]
    assert [r[0] for r in observations.canonical(df, ["a"], finite=True).collect()] == [1.0, None, None, None, None]


def test_subjects_entries(spark):
    """Order of first sight, files of a channel, last open values, and what a subject lacks."""
    F_ = "name string, population string, modality string, channel string, hospital string, rater string, protocol string, tissue string, type string, pth string, ix_img int, open map<string,string>, file string, seq int"
    rows = [
        ("n", "p", "MRI", "T2", None, None, None, None, None, "b", 2, {"age": "1", "sex": "f"}, "f", 3), ("n", "p", "MRI", "T1", "h", None, None, None, "image", "a", 1, {"age": "2"}, "f", 1),
        ("n", "p", "MRI", "T2", None, None, None, None, None, "c", 1, None, "f", 2), ("n", "p", "CT", "", None, None, None, None, None, "d", 1, {}, "f", 4),
        ("n", "p", None, None, None, "r2", "q", None, "label", "l2", None, None, "f", 6), ("n", "p", None, None, None, "r1", "q", None, "label", "l1", None, None, "f", 5), ("n", "p", None, None, None, None, None, "gm", "segmentation", "s", None, None, "f", 7),
        ("m", "", None, None, None, "r", None, None, "label", "x", None, None, "f", 8), (None, "p", "MRI", "T1", None, None, None, None, None, "z", None, None, "f", 9), ("o", "", None, None, None, None, None, None, "other", "y", None, None, "f", 10),
    ]
    got = {r["subject"]: r for r in catalog.subjects(spark.createDataFrame(rows, F_).repartition(4)).collect()}
    assert set(got) == {"p_n", "m", "o"} and got["p_n"]["records"] == 7 and got["p_n"]["seq"] == 1 and got["p_n"]["hospital"] == "h"
    m = got["p_n"]["modalities"]
    assert [(x["modality"], [(c["channel"], c["seq"], c["n"]) for c in x["channels"]]) for x in m] == [("MRI", [("T1", 1, 1), ("T2", 2, 2)]), ("CT", [("", 4, 1)])]
    assert [(x["rater"], x["protocol"], x["pth"]) for x in got["p_n"]["labels"]] == [("r1", "q", "l1"), ("r2", "q", "l2")] and [x["tissue"] for x in got["p_n"]["segmentations"]] == ["gm"]
    assert got["p_n"]["open"] == {"age": "1", "sex": "f"} and got["m"]["modalities"] is None and got["m"]["open"] is None and len(got["m"]["labels"]) == 1
    assert got["o"]["modalities"] is None and got["o"]["labels"] is None and got["o"]["segmentations"] is None and got["o"]["records"] == 1
    assert catalog.subjects(spark.createDataFrame([], F_)).count() == 0
    assert catalog.populations(catalog.subjects(spark.createDataFrame(rows, F_))).where(F.col("population") == "p").count() == 1


def test_views_of_odd_tables(spark):
    import numpy as np

    from latmix.operators import gmm, views

    rows = [(1.0, 5.0, None, 2.0), (3.0, 5.0, None, 1.0), (None, 5.0, None, 7.0)]
    got = views.channel_density(spark.createDataFrame(rows, "a double, b double, c double, w double"), ["a", "b", "c"], 4, "w").collect()
    of = {(r["channel"], r["bin"]): (r["centre"], r["density"]) for r in got}
    assert len(of) == 12 and of[0, 0] == (1.25, 2 / 3 / 0.5) and of[0, 1] == (1.75, 0.0) and of[0, 3] == (2.75, 1 / 3 / 0.5)
    assert of[1, 0] == (5.0, None) and of[2, 3] == (None, None)
    model = gmm.Mixture(np.array([[0.0, 1.0], [2.0, 3.0]]), np.array([[[4.0, 1.0], [1.0, 1.0]], [[1.0, 0.0], [0.0, 2.0]]]), np.log([0.25, 0.75]))
    line = views.curves(spark, model, 601).where("channel = 0 AND cluster = 0").orderBy("point").collect()
    assert abs(line[0]["x"] + 1.5) < 1e-12 and abs(line[-1]["x"] - 1.5) < 1e-12
    assert abs(sum(r["density"] for r in line) * 3 / 600 - 0.25 * 0.9973) < 1e-3
    seen = views.contours(spark, model, 61).where("cluster = 1").collect()
    assert len(seen) == 61 * 61 and abs(sum(r["density"] for r in seen) * 0.1 * 0.1 / 2**0.5 - 0.9946) < 2e-3
    # the middle contour of a density is an ellipse at sqrt(2 ln 2) deviations
    assert all(r["inside"] == ((r["x"] - 2) ** 2 + 2 * (r["y"] - 3) ** 2 < 2 * np.log(2)) for r in seen)
    flat = spark.createDataFrame([(1, 1, 1, [0.5, 0.5]), (2, 1, 1, [0.0, 0.0])], "i int, j int, k int, z array<double>")
    assert sorted(map(tuple, views.class_slices(flat, "z", (2, 1, 1), views.hues(2)).collect()), key=str) == [("axial", 1, 1, 0.5, 0.5, 0.5), ("axial", 2, 1, None, None, None)]


def test_paths_by_extension_and_repeated_records(spark):
    from latmix.sources import catalog

    rows = [("/d/a.json", ""), ("/d/a.json", ""), ("/d/b.json", ""), ("/d/c.json", "x.nii"), ("/d/c.json", "/e/y.img"), ("/d/c.json", "none.nii"), ("/d/c.json", None), (None, ""), (None, "z")]
    recs = spark.createDataFrame(rows, "file string, pth string")
    files = spark.createDataFrame([(p,) for p in ("/d/a.img", "/d/a.nii.gz", "/d/a.nii.gz", "/d/b.img.gz", "/d/b.txt", "/d/x.nii", "/e/y.img", None)], "path string")
    got = sorted((r["file"] or "", r["pth"]) for r in catalog.resolve_paths(recs, files).collect())
    assert got == sorted([("/d/a.json", "/d/a.nii.gz")] * 2 + [("/d/b.json", "/d/b.img.gz"), ("/d/c.json", "/d/x.nii"), ("/d/c.json", "/e/y.img"), ("/d/c.json", ""), ("/d/c.json", ""), ("", ""), ("", "")])
    assert catalog.resolve_paths(recs.limit(0), files).count() == 0
