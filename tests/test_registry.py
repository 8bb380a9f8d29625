"""Name registry against a replay one by one; first JSON objects against the decoder."""

import hashlib
import json

import numpy as np
import pytest

from assaykit.functions.parsing import first_object, object_at
from assaykit.streaming import state

SCHEMA = "key string, name string, at long"


def replay(requests, bound=None):
    bound = dict(bound or {})
    digest = lambda k: hashlib.sha256(k.encode()).hexdigest()
    for key, name, _ in sorted((r for r in requests if r[0] is not None), key=lambda r: (r[2], digest(r[0]), (r[1] or "").strip())):
        name = (name or "").strip()
        if digest(key) not in bound and name and name not in bound.values():
            bound[digest(key)] = name
    return bound


@pytest.mark.parametrize("n,keys,names", [(10_000, 900, 300), (2000, 50, 400), (500, 500, 3)])
def test_registry_is_that_of_a_replay(spark, n, keys, names):
    rng = np.random.default_rng(n)
    requests = [(f"k{rng.integers(keys)}", [f" n{rng.integers(names)}", " ", None][min(2, int(rng.integers(12)))] if rng.random() < 0.2 else f"n{rng.integers(names)}", int(rng.integers(n))) for _ in range(n)] + [(None, "n1", 0)]
    got = state.registry(spark.createDataFrame(requests, SCHEMA))
    assert {r["key_hash"]: r["name"] for r in got.collect()} == replay(requests)
    known, bound = None, {}
    ordered = sorted(requests, key=lambda r: r[2])
    for part in (ordered[: n // 3], ordered[n // 3 : n // 2], ordered[n // 2 :]):
        known = state.registry(spark.createDataFrame(part, SCHEMA), known)
        bound = replay(part, bound)
        assert {r["key_hash"]: r["name"] for r in known.collect()} == bound


def test_first_objects(spark):
    rng = np.random.default_rng(0)
    pieces = ['{"a": {"b": "}{"}}', "{x}", '{"k": 1', "[1, {}]", '{"q": "\\"}"}', "{}", "text", '{"u": [1, {"v": null}]}', '"', "}", "{", "\\", "é"]
    texts = ["".join(rng.choice(pieces, int(rng.integers(0, 6)))) for _ in range(400)] + [None, "", "{" * 3000, '{"a":' * 1500, '{"n": NaN}']
    got = [r["o"] for r in spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", first_object("t").alias("o")).orderBy("i").collect()]

    def want(t):
        for at, c in enumerate(t or ""):
            if c == "{":
                try:
                    return t[at : json.JSONDecoder().raw_decode(t, at)[1]]
                except (ValueError, RecursionError):
                    pass
        return None

    assert got == [want(t) for t in texts] and object_at('see {this} {"a": {"b": {"k": "}"}} x') == '{"b": {"k": "}"}}'
