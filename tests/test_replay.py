"""Cut outputs against a plain replay, one cut at a time."""

import re

import numpy as np
from pyspark.sql import functions as F

from assaykit.operators import replay

PATTERN = r"\bRating: [1-7]"


def rating(text):
    found = re.findall(r"\bRating: ([1-7])\b", text)
    return int(found[-1]) if found else 0


def test_cuts_are_those_of_a_plain_replay(spark):
    rng = np.random.default_rng(3)
    pieces = ["Rating: 3", "Rating: 7", "Rating: 75", "xRating: 2", "</think>", "some words ", " ", "Rating: 1.", "\n", "Rating: 9"]
    rows = [(f"varied {i % 3}", ["s", "t"][i % 2], i // 3, int(i // 3 % 2), i % 3, " ".join(rng.choice(pieces, int(rng.integers(0, 9)))) if i % 17 else None) for i in range(120)]
    df = spark.createDataFrame([(f"u{r[2] % 3}", ["s", "t"][r[2] % 2], r[2], int(r[2] % 5 < 2), r[4], r[5]) for r in rows], "unit string, scenario string, index long, label int, member int, text string")
    got = {(r["cut"], r["scope"]): r for r in replay.replay_cuts(df, PATTERN, [12, 25], "</think>").collect()}
    data = [tuple(r) for r in df.collect()]

    def first(t):
        m = re.search(r"\bRating: [1-7]\b", t)
        return t[: m.end()] if m else t

    cuts = {"full": lambda t: t, "cap 12": lambda t: t[:12], "cap 25": lambda t: t[:25], "marker": lambda t: t.split("</think>", 1)[0], "first rating": first}

    def ba(rows):
        tpr, fpr = (np.mean([d for y, d in rows if y == k]) for k in (1, 0))
        return (tpr + 1 - fpr) / 2

    for name, cut in cuts.items():
        one = {}
        for unit, scenario, index, label, _, text in data:
            k = one.setdefault((unit, scenario, index, label), [0, 0, 0, 0, 0])
            t = text or ""
            k[0], k[1] = max(k[0], rating(cut(t))), max(k[1], rating(t))
            k[2], k[3], k[4] = k[2] + len(cut(t)), k[3] + len(t), k[4] + (rating(cut(t)) == 0)
        every = got[name, "all"]
        assert every["rows"] == len(one) and every["unrated"] == sum(v[4] for v in one.values())
        assert abs(every["balanced_accuracy"] - ba([(k[3], v[0] >= 2) for k, v in one.items()])) < 1e-9
        assert abs(every["agreement"] - np.mean([(v[0] >= 2) == (v[1] >= 2) for v in one.values()])) < 1e-9
        assert abs(every["chars"] - sum(v[2] for v in one.values()) / sum(v[3] for v in one.values())) < 1e-9
        units = [ba([(k[3], v[0] >= 2) for k, v in one.items() if k[0] == u]) for u in ("u0", "u1", "u2")]
        assert abs(got[name, "macro"]["balanced_accuracy"] - np.mean(units)) < 1e-9 and (name, "s") in got
    assert replay.replay_cuts(df.limit(0), PATTERN, [5], "x").collect() == []


def test_many_ratings_take_time_in_proportion(spark):
    """Before, each rating split the whole text again for each rating before it."""
    import time

    text = "7 of 7, 3a 5 " * 5_000
    began = time.time()
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string").repartition(1)
    got = df.select(replay.rating_stream(F.col("t"), "[1-7]").alias("s")).collect()
    assert time.time() - began < 60
    plain = [(m.end(), int(m.group()), not re.match(r"\w", text[m.end() :][:1])) for m in re.finditer("[1-7]", text)]
    lists = {len(r["s"]) if r["s"] is not None else None: r["s"] for r in got}
    assert lists[0] == [] and None in lists and [tuple(x) for x in lists[20_000]] == plain
