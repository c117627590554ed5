"""MATLAB files written here byte by byte, read back by Spark."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from tessera.sources import matlab, recordings


def element(kind: int, data: bytes, order: str) -> bytes:
    if len(data) <= 4:
        return struct.pack(order + "I", len(data) << 16 | kind) + data.ljust(4, b"\0")
    return struct.pack(order + "II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def matrix(name: str, value, order: str) -> bytes:
    if isinstance(value, str):
        cls, kind, dims, body = 4, 17, (1, len(value)), value.encode("utf-16-le" if order == "<" else "utf-16-be")
    elif value is None:
        cls, kind, dims, body = 1, 1, (0, 0), b""
    else:
        value = np.atleast_2d(value)
        cls, kind = (6, 9) if value.dtype.kind == "f" else (12, 5)
        dims, body = value.shape, value.astype(order + ("f8" if cls == 6 else "i4")).tobytes(order="F")
    parts = [element(6, struct.pack(order + "II", cls, 0), order), element(5, struct.pack(order + "ii", *dims), order), element(1, name.encode(), order)]
    parts += [] if value is None else [element(kind, body, order)]
    return element(14, b"".join(parts), order)


def written(variables: dict, order: str = "<", packed: bool = False) -> bytes:
    header = b"made by hand".ljust(124) + struct.pack(order + "H", 0x0100) + (b"IM" if order == "<" else b"MI")
    body = [matrix(k, v, order) for k, v in variables.items()]
    if packed:
        body = [struct.pack(order + "II", 15, len(z)) + z for z in (zlib.compress(x) for x in body)]
    return header + b"".join(body)


def variables(t: int = 12) -> dict:
    return {
        "note": "a text",
        "other": None,
        "xy": np.stack([100.0 + np.arange(t), np.full(t, 50.0)], axis=1),
        "dir": np.arange(t) * 3.0,
        "pos_sample_rate": np.array(50, dtype=np.int32),
        "pixels_per_m": 1000.0,
        "spikes_times": np.array([3.0, 4.0]),
        "spk_sample_rate": 100.0,
    }


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("packed", [False, True])
def test_parse(order, packed):
    got = matlab.parse(written(variables(), order, packed))
    assert got["note"] == "a text" and got["other"] is None and got["pos_sample_rate"].tolist() == [[50]]
    assert np.array_equal(got["xy"], variables()["xy"]) and got["spikes_times"].ravel().tolist() == [3.0, 4.0]
    with pytest.raises(ValueError, match="level 5"):
        matlab.parse(b"x" * 200)


def test_recordings_from_files(spark, tmp_path):
    (tmp_path / "a.mat").write_bytes(written(variables()))
    (tmp_path / "b.mat").write_bytes(written(variables(20), ">", True))
    samples, spikes, meta = matlab.read(spark, f"{tmp_path}/*.mat")
    names = {r.source_file: r.cell_id for r in meta.collect()}
    got = recordings.track(samples, spikes, meta).collect()
    assert sum(r.cell_id == names["a.mat"] for r in got) == 12 and sum(r.cell_id == names["b.mat"] for r in got) == 20
    a = {r.t: r for r in got if r.cell_id == names["a.mat"]}
    assert [a[t].s for t in range(5)] == [0, 0.5, 1.5, 0, 0]
    assert abs(a[0].x - 0.1) < 1e-12 and {r.dir_deg for r in samples.collect()} == {3.0 * k for k in range(20)}
    broken = variables()
    del broken["dir"], broken["xy"]
    with pytest.raises(ValueError, match="xy, dir"):
        matlab.recording(written(broken), "c.mat")
