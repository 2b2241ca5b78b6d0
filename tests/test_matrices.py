"""Matrix files against numpy; MAT files are written byte by byte here."""

import struct
import zlib

import numpy as np
import pytest

from candora.sources import matrices

CODES = {"i1": 1, "u1": 2, "i2": 3, "u2": 4, "i4": 5, "u4": 6, "f4": 7, "f8": 9, "i8": 12, "u8": 13}


def element(order, code, data):
    if 0 < len(data) <= 4:
        return struct.pack(f"{order}I", len(data) << 16 | code) + data.ljust(4, b"\0")
    return struct.pack(f"{order}II", code, len(data)) + data + b"\0" * (-len(data) % 8)


def numbers(order, kind, values):
    return element(order, CODES[kind], np.asarray(values).astype(f"{order}{kind}").tobytes())


def variable(order, name, matrix, kind="f8", sparse=False, compressed=False):
    x = np.asarray(matrix)
    flags = struct.pack(f"{order}II", 5 if sparse else 6, 0)
    body = element(order, 6, flags) + numbers(order, "i4", x.shape) + element(order, 1, name.encode())
    if sparse:
        column, row = np.nonzero(x.T)
        ends = np.r_[0, np.cumsum(np.bincount(column, minlength=x.shape[1]))]
        body += numbers(order, "i4", row) + numbers(order, "i4", ends) + numbers(order, kind, x[row, column])
    else:
        body += numbers(order, kind, x.T.ravel())
    whole = struct.pack(f"{order}II", 14, len(body)) + body
    if compressed:
        packed = zlib.compress(whole)
        return struct.pack(f"{order}II", 15, len(packed)) + packed
    return whole


def mat(path, order, *parts):
    head = b"test".ljust(124, b" ") + struct.pack(f"{order}H", 0x0100) + (b"IM" if order == "<" else b"MI")
    path.write_bytes(head + b"".join(parts))
    return str(path)


def read(spark, *args, **kwargs):
    df = matrices.read_matrix_file(spark, *args, **kwargs)
    rows = sorted(df.collect(), key=lambda r: r["row"])
    assert [r["row"] for r in rows] == list(range(len(rows)))
    return np.array([r["features"] for r in rows]), df.rdd.getNumPartitions()


X = np.round(np.random.default_rng(1).normal(size=(301, 5)), 3)


@pytest.mark.parametrize("shaped", [lambda x: x, lambda x: np.asfortranarray(x), lambda x: x.astype("f4"), lambda x: (x * 100).astype("i2"), lambda x: x[:, 0]])
def test_npy(spark, tmp_path, shaped):
    x = shaped(X)
    np.save(tmp_path / "x.npy", x)
    got, parts = read(spark, str(tmp_path / "x.npy"), range_bytes=400)
    assert (got == np.asarray(x, float).reshape(301, -1)).all() and parts > 2


@pytest.mark.parametrize("order", ["<", ">"])
def test_mat(spark, tmp_path, order):
    sparse = X * (np.abs(X) > 1) * (np.arange(301) % 7 > 0)[:, None]
    small = np.round(X * 10).clip(-100, 100)
    path = mat(
        tmp_path / "m.mat", order, variable(order, "dense", X), variable(order, "bytes", small, "i1"), variable(order, "net", sparse, sparse=True),
        variable(order, "label", np.arange(301)[None, :] % 2, "u1", compressed=True), variable(order, "packed", X, compressed=True),
        variable(order, "thin", sparse, sparse=True, compressed=True),
    )
    for name, want in (("dense", X), ("bytes", small), ("net", sparse), ("packed", X), ("thin", sparse)):
        got, _ = read(spark, path, name, range_bytes=600)
        assert (got == want).all(), name
    label = read(spark, path, "label")[0]
    assert label.shape == (1, 301) and (label[0] == np.arange(301) % 2).all()
    for name, want in (("dense", X), ("net", sparse)):
        cells = matrices.read_matrix_file(spark, path, name, "entries", 600)
        assert cells.rdd.getNumPartitions() > 2
        assert {(r["row"], r["column"]): r["value"] for r in cells.collect()} == {(i, j): want[i, j] for i, j in zip(*np.nonzero(want), strict=True)}
    with pytest.raises(ValueError):
        matrices.read_matrix_file(spark, path)


def test_folders_and_empty_files(spark, tmp_path):
    for k, part in enumerate((X[:100], X[100:100], X[100:])):
        np.save(tmp_path / f"part-{k}.npy", part)
    assert (read(spark, str(tmp_path))[0] == X).all()
    df = spark.createDataFrame([(k, X[k].tolist()) for k in range(301)], "review_id long, features array<double>").repartition(3)
    folder = str(tmp_path / "out")
    matrices.write_matrix_files(df, folder, "review_id")
    assert (read(spark, folder)[0] == X).all()
    np.save(tmp_path / "bad.npy", np.zeros((2, 2, 2)))
    with pytest.raises(ValueError):
        matrices.read_matrix_file(spark, str(tmp_path / "bad.npy"))
