import struct
import zlib

import numpy as np
import pytest

from strandweave.errors import IntegrityError, SchemaError
from strandweave.functions import provenance
from strandweave.sources import mat
from strandweave.streaming import controllers as C


def element(kind, body):
    return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)


def matrix(name, values):
    values = np.asarray(values, np.float64)
    body = element(6, struct.pack("<II", 6, 0)) + element(5, struct.pack("<ii", *values.shape)) + element(1, name.encode()) + element(9, values.tobytes(order="F"))
    return element(14, body)


def test_mat_variables(spark, tmp_path):
    a = np.arange(6.0).reshape(2, 3)
    squeezed = zlib.compress(matrix("packed", a + 1))
    content = b"MATLAB 5.0".ljust(124) + b"\x00\x01IM" + matrix("plain", a) + struct.pack("<II", 15, len(squeezed)) + squeezed
    (tmp_path / "x.mat").write_bytes(content)
    assert sorted((r["name"], r["kind"], r["shape"]) for r in mat.structure(spark, str(tmp_path / "x.mat")).collect()) == [("packed", "double", [2, 3]), ("plain", "double", [2, 3])]
    assert [r["value"] for r in mat.numbers(spark, str(tmp_path / "x.mat"), "packed").orderBy("i").collect()] == (a + 1).ravel(order="F").tolist()
    with pytest.raises(SchemaError):
        list(mat.variables(b"no"))


def test_commit_and_reveal():
    nonce = provenance.new_nonce()
    c = provenance.commitment(42, nonce)
    assert provenance.require_revealed(42, nonce, c) == 42
    with pytest.raises(IntegrityError):
        provenance.require_revealed(43, nonce, c)
    with pytest.raises(SchemaError):
        provenance.commitment(1, "short")
    assert provenance.seed_from_beacon("p", "a") != provenance.seed_from_beacon("p", "b")


def test_assumptions():
    a = provenance.Assumption("A1", 1.0, "ms", "M")
    assert provenance.Assumptions([a]).require("A1") == [a]
    with pytest.raises(IntegrityError):
        provenance.Assumptions([a]).require("A2")
    with pytest.raises(IntegrityError):
        provenance.Assumptions([a, a])
    with pytest.raises(SchemaError):
        provenance.Assumption("A1", 1.0, "ms", "?")


def test_arbiter_order_and_hysteresis():
    arbiter = C.Arbiter((5.0, 2.0), (4.0, 1.0), 20)
    state, since, seen = C.SEEK, 0, []
    for t, groom, feed in [(0, 0, 0), (10, 0, 4), (20, 0, 2), (30, 5, 4), (40, 3, 9), (50, 1, 9), (60, 0, 0), (70, 0, 0), (80, 0, 9)]:
        new = arbiter.next_state(state, since, t, {"groom": groom, "feed": feed})
        since = since if new == state else t
        state = new
        seen.append(state)
    assert seen == [C.SEEK, C.FEED, C.FEED, C.GROOM, C.GROOM, C.RESUME, C.RESUME, C.SEEK, C.FEED]


def test_steering():
    assert C.steering(0, 0, 1, 1) == 0
    assert C.steering(3, 1, 1.0, 1.0) == 0.5 == -C.steering(1, 3, 1.0, 1.0)
    assert C.steering(3, 1, 10.0, 1.0) == 1.0
