import json
import math

import pytest
from folders import CAMERA, rows_of, sound, spoilt, ticks, write

from plumbline import cli
from plumbline.config import load_config, make_config, parse_yaml
from plumbline.plans.diff import compare_datasets
from plumbline.plans.stats import compute_dataset_stats


def test_stats(spark, tmp_path):
    s = compute_dataset_stats(sound(tmp_path), spark=spark)
    assert s.duration_sec == 2 and s.frame_counts == {"bow_camera": 9, "hull_imu": 33, "mast_gps": 5}
    assert s.inferred_rates_hz["hull_imu"] == pytest.approx(16) and s.label_class_counts == {"buoy": 9}
    assert s.track_length_summary.median == 9 and s.speed_summary.max == pytest.approx(math.hypot(3, 0.25)) and s.issue_summary == {"error": 0, "info": 0, "warning": 0}
    assert json.loads(s.to_json())["confidence_summary"]["count"] == 9 and "| hull_imu | 33 |" in s.to_markdown()


def test_diff(spark, tmp_path):
    old = sound(tmp_path / "old")
    shorter = rows_of(CAMERA, [(t, "shots/b0.png", 320, 240) for t in ticks(4)[:7]])
    new = sound(tmp_path / "new", {CAMERA: shorter, "sensors/sonar.csv": rows_of("", [(t,) for t in ticks(4)], "timestamp")})
    d = compare_datasets(old, new, spark=spark)
    assert {(c.category, c.name) for c in d.regressions} >= {("frame_counts", "bow_camera")}
    assert ("sensors", "sonar") in {(c.category, c.name) for c in d.improvements}
    assert d.summary["changes"] == len(d.changes) and "## Regressions" in d.to_markdown()


def test_cli_exit_codes(spark, tmp_path, capsys):
    fine, broken = sound(tmp_path / "sound"), spoilt(tmp_path / "spoilt")
    assert cli.main(["lint", fine, "--checks", "labels"]) == 0
    assert cli.main(["lint", broken, "--checks", "labels", "--format", "json"]) == 1
    out = capsys.readouterr().out
    assert json.loads(out[out.index("{") :])["passed"] is False
    assert cli.main(["lint", fine, "--checks", "nope"]) == 2 and cli.main(["nope"]) == 2
    assert cli.main(["report", broken, "--checks", "trajectories", "--output", str(tmp_path / "r.html"), "--fail-on", "any"]) == 1
    assert (tmp_path / "r.html").read_text().startswith("<!doctype html>")
    assert cli.main(["report", broken, "--checks", "files", "--output", str(tmp_path / "r.txt")]) == 2
    assert cli.main(["adapters", fine, "--format", "json"]) == 0
    hub = write(tmp_path / "m", {"a.mcap": b"x"})
    assert cli.main(["inspect", hub]) == 0 and cli.main(["validate", hub]) == 0 and cli.main(["validate", hub, "--deep"]) == 1
    assert cli.main(["export-manifest", hub, "--output", str(tmp_path / "m.json")]) == 0
    assert json.loads((tmp_path / "m.json").read_text())["adapter_name"] == "mcap"
    assert cli.main(["stats", str(tmp_path / "none")]) == 2


def test_config(tmp_path):
    text = "max_speed_mps: 5  # slow\nrules:\n  disabled:\n    - labels\n  severity:\n    check_yaw_range: error\nexpected_sensor_rates:\n  imu: 50\n"
    (tmp_path / "plumbline.yaml").write_text(text)
    c = load_config(None, str(tmp_path))
    assert c.max_speed_mps == 5 and c.rules.disabled == ["labels"] and c.rules.severity == {"check_yaw_range": "error"} and c.expected_sensor_rates == {"imu": 50}
    assert parse_yaml("a: [1, 'x']\nb: true\n") == {"a": [1, "x"], "b": True}
    for wrong in ({"nope": 1}, {"max_speed_mps": "x"}, {"rules": {"nope": 1}}, {"issue_regression_severity": "bad"}, {"rules": {"severity": {"check_yaw_range": "bad"}}}):
        with pytest.raises(ValueError):
            make_config(wrong)
