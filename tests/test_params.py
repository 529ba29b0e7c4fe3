"""Parameters and outputs of earlier runs: what is taken again and what is still to do; flags beside metrics."""

import json
import math

import pytest

from tesserae import schemas
from tesserae.operators import quality
from tesserae.sources import params

SHAPES = ((40, 50), (30, 30))
WHOLE = {"version": 1, "reference_roi": [5, 15, 0, 20], "moving_roi": [25, 35, -4, 6], "fit_window": [1, 2, 3, 4]}


def put(folder, name, payload):
    (folder / name).write_text(payload if isinstance(payload, str) else json.dumps(payload))


def test_stage_parameters_are_taken_again(spark, tmp_path):
    path = str(tmp_path / "stage.json")
    assert params.stage_para(spark, path, SHAPES) is None
    put(tmp_path, "paa.yaml", "reference_roi: [0, 90, 0, 4]\nmoving_roi: [0, 4, 0, 4]\nfit_window: [0, 1, 0, 1]\n")
    assert params.stage_para(spark, path, SHAPES) == ((0, 40, 0, 4), (0, 4, 0, 4), (0, 1, 0, 1))
    put(tmp_path, "selection.json", WHOLE)
    put(tmp_path, "stage.json", {**WHOLE, "version": 2})
    assert params.stage_para(spark, path, SHAPES) == ((5, 15, 0, 20), (20, 30, 0, 10), (1, 2, 3, 4))
    for bad in ("{", {**WHOLE, "fit_window": [2, 1, 0, 1]}, {**WHOLE, "moving_roi": None}, {"version": 1}):
        put(tmp_path, "stage.json", bad)
        assert params.stage_para(spark, path, SHAPES)[1] == (20, 30, 0, 10)
    put(tmp_path, "stage.json", {**WHOLE, "reference_roi": [0, 1, 0, 1]})
    assert params.stage_para(spark, path, SHAPES)[0] == (0, 1, 0, 1)


def test_fits_are_found_where_older_runs_left_them(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        params.qc_stats(spark, str(tmp_path))
    put(tmp_path, "stats.json", {"snr": {"scale": "log", "mean": 1, "std": 0.5}, "flag": {"scale": "boolean", "true_count": 3}})
    assert {tuple(r) for r in params.qc_stats(spark, str(tmp_path)).collect()} == {("snr", "log", 1.0, 0.5), ("flag", "boolean", None, None)}
    (tmp_path / "stats").mkdir()
    put(tmp_path / "stats", "stats.json", {"snr": {"scale": "log", "mean": 2, "std": 0.5}})
    assert params.qc_stats(spark, str(tmp_path)).first().mean == 2.0


def test_outputs_without_a_whole_file_are_missing(spark, tmp_path):
    folder = tmp_path / "out"
    assert params.missing_outputs(spark, str(folder)) == list(params.OUTPUTS)
    folder.mkdir()
    (folder / "AC.tif").write_bytes(b"x")
    (folder / "B.tif").write_bytes(b"")
    (folder / "AC-qc.tif.part").write_bytes(b"x")
    assert params.missing_outputs(spark, str(folder), ["AC-qc", "AC", "B"]) == ["AC-qc", "B"]
    with pytest.raises(ValueError):
        params.missing_outputs(spark, str(folder), ["Z"])


def test_patches_with_a_model_and_a_whole_profile_are_done(spark, tmp_path):
    names = ["0-0-0-0", "0-0-0-1", "0-0-1-0", "0-0-1-1"]
    patches = spark.createDataFrame([(n,) for n in names], "name string")
    models, profile = tmp_path / "model", tmp_path / "profile"
    assert params.pending_patches(spark, patches, str(models), str(profile)).count() == 4
    models.mkdir(), profile.mkdir()
    head = ",".join(c.split()[0] for c in schemas.PROFILE.split(", ")[1:])
    for n, whole, size in ((names[0], True, 3), (names[1], False, 3), (names[2], True, 0)):
        (models / f"{n}.tif.hdf5").write_bytes(b"x" * size)
        (profile / f"{n}.tif.csv").write_text((head if whole else head.replace(",snr", "")) + "\n0,1,2\n")
    assert sorted(r.name for r in params.pending_patches(spark, patches, str(models), str(profile)).collect()) == names[1:]


def test_flags_beside_metrics(spark):
    rows = [("a", 0, 1.0, True), ("a", 1, 2.0, False), ("b", 0, 3.0, None)]
    df = spark.createDataFrame(rows, "patch string, component_index int, snr double, flag boolean")
    flag = quality.Metric("flag", "boolean")
    assert tuple(quality.sweep(df, None, flag).first()) == (None, 1, 2)
    assert [r.value for r in quality.render_values(df, flag, ["patch", "component_index"]).orderBy("patch", "component_index").collect()] == [1.0, 0.0, None]
    both = [quality.Metric("snr", lower_z=-1.0), flag]
    stats = quality.fit(df, both)
    assert [r.metric for r in stats.collect()] == ["snr"]
    assert [r.keep for r in quality.with_keep(df, stats, both).orderBy("snr").collect()] == [False, True, True]
    with pytest.raises(ValueError):
        quality.Metric("flag", "boolean", 1.0)


def test_profiles_fit_their_models(spark):
    profile = spark.createDataFrame([("a", 0, 1.0), ("a", 1, math.nan), ("c", 0, 2.0)], "patch string, component_index int, snr double")
    models = lambda *rows: spark.createDataFrame(rows, "patch string, n long")
    assert quality.profiles_of_models(models(("a", 2), ("b", 4)), profile).count() == 2
    for bad in (("a", 3), ("a", 1)):
        with pytest.raises(Exception, match="patch a"):
            quality.profiles_of_models(models(bad), profile).count()
    twice = spark.createDataFrame([("a", 0, 1.0), ("a", 0, 1.0), ("a", 2, 1.0)], profile.schema)
    with pytest.raises(Exception, match="patch a"):
        quality.profiles_of_models(models(("a", 3)), twice).count()


def test_fits_and_metadata_are_written_and_found(spark, tmp_path):
    df = spark.createDataFrame([("snr", 10.0), ("snr", 1000.0)], "name string, snr double")
    metric = quality.Metric("snr", "log", -1.0)
    params.write_stats(spark, str(tmp_path), quality.fit(df, [metric]))
    back = params.qc_stats(spark, str(tmp_path))
    assert {tuple(r) for r in back.collect()} == {("snr", "log", 2.0, 1.0)} and quality.specs(back, [metric]).count() == 1
    sources, folder = {"dataset_root": "/data/a", "crop": "/data/b/"}, str(tmp_path / "viewer")
    assert not params.cache_is_valid(spark, folder, sources, [])
    params.write_metadata(spark, folder, sources, (40, 50), 1000, 10.0, 7, {"c": "traces_c.bin"})
    assert not params.cache_is_valid(spark, folder, sources, [])  # the traces are not there
    params.put_text(spark, f"{folder}/traces_c.bin", "x")
    assert params.cache_is_valid(spark, folder, sources, ["metadata.json"])
    assert not params.cache_is_valid(spark, folder, {**sources, "crop": "/data/c"}, [])
    found = params.mapping(spark, [f"{folder}/metadata.json"], ["neuron_count"])
    assert found["full_height"] == 40 and found["trace_sources"]["c"]["file"] == "traces_c.bin"
