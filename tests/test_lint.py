import json

import pytest
from folders import BOXES, CAMERA, GPS, IMU, TRACK, rows_of, sound, spoilt, ticks

from plumbline.plans.lint import lint_dataset

#: (severity, check, file, row) of the spoilt log, in order.
EXPECTED = """error missing_sensor_files sensors/sonar.csv
error broken_paths sensors/bow_camera.csv 4
error declared_sensors_exist metadata.json
warning duration_matches_timestamps metadata.json
warning dataset_version_present metadata.json
error monotonic_timestamps sensors/bow_camera.csv 5
warning duplicate_timestamps sensors/bow_camera.csv 4
warning duplicate_timestamps labels/buoys.csv 4
warning large_timestamp_gaps sensors/bow_camera.csv 6
warning large_timestamp_gaps labels/buoys.csv 5
error sensor_dimensions sensors/bow_camera.csv 3
error sensor_dimensions sensors/bow_camera.csv 6
warning missing_frames sensors/bow_camera.csv 6
error sensor_time_overlap
warning timestamp_offset
warning pairwise_sync_gap
warning frequency_stability sensors/bow_camera.csv
error calibration_exists calibration.json
error intrinsics_shape calibration.json
error intrinsics_values calibration.json
error extrinsics_shape calibration.json
error quaternion_norm calibration.json
error label_confidence_range labels/buoys.csv 4
error label_geometry labels/buoys.csv 5
error label_timestamps_match_sensor_range labels/buoys.csv 5
warning track_id_consistency labels/buoys.csv
warning label_bbox_jumps labels/buoys.csv 3
error duplicate_track_id_timestamp labels/buoys.csv 3
error duplicate_track_id_timestamp labels/buoys.csv 4
warning short_tracks labels/buoys.csv
warning label_size_changes labels/buoys.csv 3
warning label_size_changes labels/buoys.csv 4
error trajectory_finite_values trajectories/boat.csv 4
warning unrealistic_speed trajectories/boat.csv 3
warning unrealistic_acceleration trajectories/boat.csv 3
warning yaw_range trajectories/boat.csv 3""".splitlines()


def told(report):
    return [" ".join(str(x) for x in (i.severity, i.check_name.removeprefix("check_"), i.file, i.row) if x is not None) for i in report.issues]


def names(report):
    return {i.check_name.removeprefix("check_") for i in report.issues}


def test_sound_log_has_no_findings(spark, tmp_path):
    report = lint_dataset(sound(tmp_path), spark=spark)
    assert told(report) == [] and report.passed and len(report.checks_run) == 41


def test_spoilt_log_in_order(spark, tmp_path):
    report = lint_dataset(spoilt(tmp_path), spark=spark)
    assert told(report) == EXPECTED
    errors = sum(x.startswith("error") for x in EXPECTED)
    assert report.count_by_severity() == {"error": errors, "warning": len(EXPECTED) - errors, "info": 0} and not report.passed
    gap = report.stats["sync"]["pairwise_gaps"]["bow_camera:hull_imu"]
    assert gap["median_gap_sec"] == pytest.approx((71.25 - 53.5 + 71.5 - 53.5) / 2) and gap["max_gap_sec"] == pytest.approx(71.75 - 53.5)
    assert report.stats["sync"]["sensors"]["bow_camera"]["frame_count"] == 5.0
    doc = json.loads(report.to_json())
    assert doc["findings"] == doc["issues"] and "### shots" not in report.to_markdown() and f"### {CAMERA}" in report.to_markdown() and report.to_html() == report.to_html()


def box(t, x=40, width=24, kind="buoy", track="green", confidence=0.7):
    return (t, track, kind, x, 96, width, 31, confidence)


@pytest.mark.parametrize(
    ("changes", "checks", "expected"),
    [
        ({"sensors/sonar.csv": rows_of("", [(t + 0.125,) for t in ticks(4)], "timestamp")}, "sync", {"pairwise_sync_gap", "timestamp_offset"}),
        ({CAMERA: rows_of(CAMERA, [(t, "shots/b0.png", 9, 9) for t in (50, 50.25, 50.5, 51.75)])}, "check_missing_frame_bursts", {"missing_frame_bursts"}),
        ({CAMERA: rows_of(CAMERA, [(t, f"shots/b{i}.png", -4, 240) for i, t in enumerate(ticks(4))], "timestamp,filename,width,height")}, "sensors,files", {"sensor_dimensions"}),
        ({BOXES: rows_of(BOXES, [box(50), box(50.25, 940, kind="crane"), box(50.5, 940, 200)])}, "labels", {"track_id_consistency", "label_bbox_jumps", "label_size_changes"}),
        ({BOXES: rows_of(BOXES, [box(51, track="")] * 2 + [box("dusk", track="", confidence="nan")])}, "labels", {"duplicate_track_id_timestamp", "label_confidence_range", "label_timestamps_match_sensor_range"}),
        ({BOXES: rows_of(BOXES, [box(t) for t in (50, 50.25, 50.5, 51.5)])}, "labels", {"label_missing_timestamps"}),
        ({BOXES: rows_of(BOXES, [box(50), box(50.25)])}, "labels", {"short_tracks"}),
        ({TRACK: rows_of(TRACK, [(50, 1, 1, 0, 0, 0), (50.5, 1, 1, "inf", 0, 0), (51, "?", 1, 0, 0, 0)])}, "trajectories", {"trajectory_finite_values", "stationary_dataset", "yaw_range"}),
        ({TRACK: rows_of(TRACK, [(50, 0, 0), (51, 6, 0)], "timestamp,x,y")}, "trajectories", {"trajectory_columns"}),
        ({GPS: ""}, "files,metadata", {"empty_files"}),
        ({GPS: "timestamp,lat,lon,alt\n50,53,9,4,1,1\n"}, "files", {"load_csv"}),
        ({GPS: "timestamp,lat,lon\n50,53,9\n52,53,9\n"}, "check_sensor_columns", {"sensor_columns"}),
        ({BOXES: "timestamp,class\n50,buoy\n"}, "check_label_columns", {"label_columns"}),
        ({"metadata.json": "[]"}, "metadata", {"load_json"}),
        ({"metadata.json": {"dataset_name": "", "version": "7b", "sensors": [], "duration_sec": -1}}, "check_metadata_schema", {"metadata_schema"}),
        ({"calibration.json": {"bow_camera": {"intrinsics": [[0, 0, 0], [0, 1, 0], [0, 0, 1]], "extrinsics": {"translation": [0, 0, 0], "rotation_quat": [0, 0, 1, 0]}}, "hull_imu": "none", "mast_gps": {}}}, "calibration", {"intrinsics_values", "extrinsics_shape"}),
        ({IMU: rows_of(IMU, [(t, 0, 0, 0, 0, 0, 0) for t in (51.5, 51.0, 51.0625, 51.25, 52.0)])}, "check_monotonic_timestamps,check_frequency_stability", {"monotonic_timestamps", "frequency_stability"}),
        ({"copies/b3.png": b"x"}, "check_duplicate_filenames", {"duplicate_filenames"}),
        ({"metadata.json": None, "calibration.json": None}, "all", {"required_files"}),
    ],
)
def test_single_changes(spark, tmp_path, changes, checks, expected):
    config = {"max_pairwise_sync_gap_sec": 0.1} if "sensors/sonar.csv" in changes else None
    assert names(lint_dataset(sound(tmp_path, changes), config, checks, spark=spark)) == expected


def test_policy(spark, tmp_path):
    path = spoilt(tmp_path)
    report = lint_dataset(path, {"rules": {"enabled": ["labels"], "disabled": ["check_short_tracks"], "severity": {"check_track_id_consistency": "error"}}}, spark=spark)
    assert "short_tracks" not in names(report) and len(report.checks_run) == 9
    changed = next(i for i in report.issues if i.check_name == "check_track_id_consistency")
    assert changed.severity == "error" and changed.metadata["original_severity"] == "warning" and changed.metadata["classes"] == ["buoy", "crane"]
    assert lint_dataset(path, checks="no_such", spark=spark).issues[0].severity == "error"
    assert lint_dataset(path, {"no_such": 1}, spark=spark).issues[0].check_name == "load_config"
    assert lint_dataset(str(tmp_path / "none"), spark=spark).issues[0].check_name == "load_dataset"
    assert report.should_fail("error") and not lint_dataset(path, checks="check_yaw_range", spark=spark).should_fail("error")


def test_groups_as_callables(spark, tmp_path):
    from plumbline import check_label_consistency, check_sensor_synchronization
    from plumbline.config import LintConfig
    from plumbline.sources.bundle import load_bundle

    b = load_bundle(spark, spoilt(tmp_path), LintConfig())
    assert {i.check_name for i in check_sensor_synchronization(b)} == {f"check_{n}" for n in ("sensor_time_overlap", "timestamp_offset", "pairwise_sync_gap", "frequency_stability")} | {"check_missing_frame_bursts"}
    assert {i.check_name for i in check_label_consistency(b)} >= {"check_track_id_consistency", "check_short_tracks"}
