"""Cache keys against the standard library's JSON: floats, escapes, letters beyond ASCII and beyond 16 bits."""

import hashlib
import json
import random

import pytest

from pyspark.sql import functions as F

from cellspark.functions import paths as P

COLUMNS = "image string, weights string, mtime double, size bigint"


def payload(image, weights, mtime, size):
    return {"cell_size": 512, "image": image, "output_shape": [256, 1024], "output_type": "patch_tokens_bovw", "weights_mtime": mtime, "weights_path": weights, "weights_size": size}


def test_keys_equal_json(spark):
    rng = random.Random(5)
    odd = ["", "plain.png", 'a"b\\c', "tab\tline\nreturn\rback\bform\f", "\x00\x01\x1f\x7f", "é/ß/日本", "😀/𝒳", " ퟿￿"]
    numbers = [0.0, 1.0, -2.5, 0.0001, 0.1, 1700000000.0, 1700000000.1234567, 1e15, 123456789012345.6, 9999999.0, 10000000.0, 0.00123]
    rows = [(a, b, rng.choice(numbers), rng.choice([0, 7, 2**40])) for a in odd for b in odd] + [("x", "y", n, 1) for n in numbers]
    rows += [("x", "y", round(rng.uniform(1e9, 2e9), 6), 1) for _ in range(500)]
    got = spark.createDataFrame(rows, COLUMNS).select("*", P.cache_key(*map(F.col, ("image", "weights", "mtime", "size"))).alias("key")).collect()
    for r in got:
        want = json.dumps(payload(r["image"], r["weights"], r["mtime"], r["size"]), sort_keys=True)
        assert r["key"] == hashlib.sha1(want.encode()).hexdigest(), want


def test_nulls_and_sizes(spark):
    rows = spark.createDataFrame([("x", "y", None, None)], COLUMNS)
    want = json.dumps(payload("x", "y", None, None), sort_keys=True)
    assert rows.select(P.cache_key(*map(F.col, ("image", "weights", "mtime", "size")))).first()[0] == hashlib.sha1(want.encode()).hexdigest()
    with pytest.raises(Exception, match="not a JSON number here"):
        spark.createDataFrame([(1e16,)], "x double").select(P.json_number(F.col("x"))).collect()
