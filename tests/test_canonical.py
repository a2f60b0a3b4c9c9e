"""Canonical JSON against the standard library's dump with sorted keys."""

import hashlib
import json
import random
import struct

from pyspark.sql import functions as F

from provena.functions import canonical
from provena.operators import integrity


def _dump(t):
    def pairs(x):
        if len({k for k, _ in x}) < len(x):
            raise ValueError("repeated key")
        return dict(x)

    try:
        return json.dumps(json.loads(t, object_pairs_hook=pairs), sort_keys=True, ensure_ascii=False)
    except ValueError:
        return None


def _value(rng, deep):
    kind = rng.randrange(9 if deep else 7)
    if kind > 6:
        size = rng.randrange(4)
        return [_value(rng, deep - 1) for _ in range(size)] if kind == 7 else {"".join(rng.choice("aZ_é😀\"\\\n ") for _ in range(rng.randrange(4))): _value(rng, deep - 1) for _ in range(size)}
    return [None, True, rng.randrange(-5, 10**rng.randrange(1, 30)), rng.uniform(-1, 1) * 10 ** rng.randrange(-20, 25), round(rng.uniform(0, 1000), rng.randrange(4)), "".join(rng.choice("ab\"\\/\b\f\n\r\t\x00\x01\x1f#é漢😀 ") for _ in range(rng.randrange(12))), rng.choice([-0.0, 1e16, 1e15, 1e-4, 1e-5, 123456789012345680.0, 5e-324, 1.7976931348623157e308, 0.1 + 0.2])][kind]


def test_form_is_that_of_a_sorted_dump(spark):
    rng = random.Random(8)
    texts = [json.dumps(_value(rng, 4), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) for _ in range(700)]
    texts += ['{"b": 1, "a": {"d": [1.0, 1.50, 1E5, 1e+05, 100e-2, -0, -0.0, 0e9, 12345678901234567890, 0.1e-6]}}', '"\\u0001#5"', '"\\u0001##x"', '{"\\u0001#k": "\\/\\u00e9\\ud83d\\ude00"}', "", "{", '{"a": 1, "a": 2}', "[1, 2", "nul", "[01]", "1e400", "[[[[[[[[[[[[1]]]]]]]]]]]]", '"' + "x\\n" * 20000 + '"', "[" + "1.5, " * 3000 + "2]"]
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(-1, None, "x")], "i long, t string, digest string")
    got = {r["i"]: r["digest"] for r in integrity.canonical_digests(d, "t").collect()}
    for i, t in enumerate(texts):
        want = _dump(t)
        assert got[i] == (None if want is None else hashlib.sha256(want.encode()).hexdigest()), t[:200]
    assert got[-1] is None and integrity.canonical_digests(d.limit(0), "t").count() == 0


def test_doubles_have_their_shortest_form(spark):
    rng = random.Random(4)
    values = [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(4000)]
    values = [v for v in values if v == v and abs(v) != float("inf")]
    d = spark.createDataFrame([(repr(v),) for v in values], "t string").select("t", canonical.number(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in d if "." in r["t"] or "e" in r["t"]] == [r["t"] for r in d if "." in r["t"] or "e" in r["t"]]


def test_keys_sort_by_characters_and_depth_is_bounded(spark, monkeypatch):
    texts = ['{"a": 1, "a!": 2, "a\\"": 3, "": 4, "\\n": 5, "\u00e9": 6, "\U0001F600": 7, "\uffee": 8}', "[[1]]", "[[[1]]]", "[[[[1]]]", '{"x": [[2]]}']
    monkeypatch.setattr(integrity, "LEVELS", 2)
    d = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r["i"]: r["digest"] for r in integrity.canonical_digests(d, "t").collect()}
    want = [hashlib.sha256(_dump(t).encode()).hexdigest() for t in texts[:2]]
    assert [got[0], got[1]] == want and got[2] is got[3] is got[4] is None
