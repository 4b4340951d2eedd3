import hashlib

import numpy as np
import pytest

from lumenspark.functions import identity as I
from lumenspark.functions import noise


def test_canonical_grammar():
    assert I.canonical_bytes({"b": [1, True, None], "a": 0.5}) == b"m2{s1:af3fe0000000000000;s1:ba3[i1;b1;n;]}"
    assert I.canonical_bytes("é") == I.canonical_bytes("é") == "s2:é".encode()
    assert I.canonical_bytes(np.float64(1)) != I.canonical_bytes(1) and I.canonical_bytes(np.array([1, 2])) == b"a2[i1;i2;]"
    for bad in (float("nan"), {1}, b"x", {1: 2}, {"é": 1, "é": 2}):
        with pytest.raises((TypeError, ValueError)):
            I.canonical_bytes(bad)


def test_seals_and_tokens():
    record = I.sealed({"x": 1}, "sha")
    assert I.is_sealed(record, "sha") and not I.is_sealed(record | {"x": 2}, "sha")
    assert [I.number_token(x) for x in (0.5, 0.75, 1.0, 3.0, -1e-20)] == ["0p5", "0p75", "1", "3", "m9p9999999999999995em21"]
    assert I.json_line({"b": 1, "a": "é"}) == '{"a":"é","b":1}\n'.encode()
    assert I.selection_identity([3, 5])["count"] == 2
    with pytest.raises(ValueError):
        I.selection_identity([3, 3])


def test_noise_key_and_quantiles():
    key = noise.Key("p", 1, "i", "c", 0, "s")
    data = b"".join(len(x).to_bytes(8, "big") + x for x in (b"p", b"1", b"i", b"c", b"0", b"s"))
    assert key.digest_seed() == int.from_bytes(hashlib.sha256(data).digest()[:8], "little")
    assert key.derived("shot") != key.derived("dark")
    p = np.array([1e-12, 0.001, 0.025, 0.3, 0.5, 0.975, 1 - 1e-9])
    from math import erfc, sqrt

    assert np.allclose([0.5 * erfc(-x / sqrt(2)) for x in noise.normal_quantile(p)], p, rtol=1e-12, atol=1e-15)
    u = (np.arange(20000) + 0.5) / 20000
    for m in (0.3, 4.0, 900.0):
        k = noise.poisson_quantile(u, np.full(len(u), m))
        assert abs(k.mean() - m) < 0.01 * m + 0.01 and abs(k.var() - m) < 0.03 * m + 0.02
    assert noise.poisson_quantile(np.array([0.9]), np.array([0.0]))[0] == 0


def test_noise_does_not_depend_on_partitions(spark):
    from pyspark.sql import functions as F

    key = noise.Key("p", 1, "i", "c", 0, "s")
    made = lambda n: sorted(spark.range(0, 200, 1, n).select("id", noise.captured_electrons(F.lit(50.0), F.lit(2.0), F.lit(60.0), F.lit(1.5), F.col("id"), key).alias("e")).collect())
    one, four = made(1), made(4)
    assert one == four and 45 < np.mean([r.e for r in one]) < 55
