"""Small dataset folders for tests: two seconds of a survey boat's log, and the same log spoilt."""

import json
from pathlib import Path

CAMERA, IMU, GPS = "sensors/bow_camera.csv", "sensors/hull_imu.csv", "sensors/mast_gps.csv"
BOXES, TRACK = "labels/buoys.csv", "trajectories/boat.csv"
HEADS = {
    CAMERA: "timestamp,path,width,height",
    IMU: "timestamp,ax,ay,az,gx,gy,gz",
    GPS: "timestamp,lat,lon,alt",
    BOXES: "timestamp,track_id,class,x,y,width,height,confidence",
    TRACK: "timestamp,x,y,yaw,vx,vy",
}
MOUNT = {"translation": [0.4, -0.1, 1.2], "rotation_quat": [0.5, 0.5, -0.5, 0.5]}
LENS = [[410, 0, 160], [0, 415, 120], [0, 0, 1]]


def write(root: Path, files: dict) -> str:
    for rel, content in files.items():
        p = Path(root, rel)
        p.parent.mkdir(parents=True, exist_ok=True)
        if isinstance(content, bytes):
            p.write_bytes(content)
        else:
            p.write_text(content if isinstance(content, str) else json.dumps(content))
    return str(root)


def rows_of(file: str, rows, header: str | None = None) -> str:
    lines = (",".join("" if x is None else str(x) for x in r) for r in rows)
    return "\n".join([header or HEADS[file], *lines]) + "\n"


def ticks(hz: int, seconds: float = 2.0, start: float = 50.0) -> list[float]:
    """Times that binary fractions hold exactly."""
    return [start + i / hz for i in range(int(hz * seconds) + 1)]


def log() -> dict:
    """Files of the log, without findings."""
    shots = [f"shots/b{i}.png" for i in range(9)]
    return {
        "metadata.json": {"dataset_name": "harbour run", "version": "7b", "sensors": ["bow_camera", "hull_imu", "mast_gps"], "duration_sec": 2},
        "calibration.json": {"bow_camera": {"intrinsics": LENS, "extrinsics": MOUNT}, "hull_imu": {"extrinsics": MOUNT}, "mast_gps": {"extrinsics": MOUNT}},
        CAMERA: rows_of(CAMERA, [(t, shot, 320, 240) for t, shot in zip(ticks(4), shots, strict=True)]),
        IMU: rows_of(IMU, [(t, 0.02, -0.01, 9.79, 0, 0.001, 0) for t in ticks(16)]),
        GPS: rows_of(GPS, [(t, 53.54 + i * 1e-5, 9.97, 4) for i, t in enumerate(ticks(2))]),
        BOXES: rows_of(BOXES, [(t, "green", "buoy", 40 + 3 * i, 96, 24, 31, 0.7) for i, t in enumerate(ticks(4))]),
        TRACK: rows_of(TRACK, [(t, 3 * (t - 50), 0.2, 0.1, 3, 0.25) for t in ticks(8)]),
        **{shot: b"pixels" for shot in shots},
    }


def sound(root: Path, changes: dict | None = None) -> str:
    """The log below ``root``; ``changes`` replace files, None drops them."""
    return write(root, {k: v for k, v in (log() | (changes or {})).items() if v is not None})


def spoilt(root: Path) -> str:
    """The log with defects of every group."""
    shots = ["shots/b0.png", "shots/b1.png", "shots/lost.png", "shots/b3.png", "shots/b4.png"]
    seen = [(50.0, 320, 240), (50.25, 320, 0), (50.25, 320, 240), (50.125, 320, 240), (53.5, "wide", 240)]
    return sound(
        root,
        {
            "metadata.json": {"dataset_name": "harbour run", "version": 7, "sensors": ["bow_camera", "sonar", "hull_imu"], "duration_sec": 25},
            "calibration.json": {"bow_camera": {"intrinsics": LENS[:2], "extrinsics": MOUNT}, "hull_imu": {"intrinsics": [[-1, 0, 0], [0, 1, 0], [0, 0, 1]], "extrinsics": {"translation": [0, 0], "rotation_quat": [0.6, 0, 0, 0.6]}}},
            CAMERA: rows_of(CAMERA, [(t, shot, w, h) for (t, w, h), shot in zip(seen, shots, strict=True)]),
            IMU: rows_of(IMU, [(t, 0, 0, 9.79, 0, 0, 0) for t in (71.0, 71.25, 71.5, 71.75)]),
            GPS: None,
            BOXES: rows_of(BOXES, [(50.0, "red", "buoy", 10, 10, 20, 20, 0.5), (50.25, "red", "crane", 600, 10, 20, 90, 0.5), (50.25, "red", "buoy", 600, 10, 20, 20, -0.25), (90.0, "blue", "buoy", 5, 5, 0, 9, 1)]),
            TRACK: rows_of(TRACK, [(50.0, 0, 0, 0.1, 3, 0), (50.5, 1, 0, 3.5, 3, 88), ("noon", 2, 0, 0, 3, 0)]),
        },
    )
