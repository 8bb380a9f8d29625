"""Near duplicates among texts that quote passages which many others quote."""

import numpy as np

from assaykit.llm import ngram_join


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def components(rows):
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = {k: a if v == b else v for k, v in label.items()}
    return label


def quoting(rng, n):
    """Texts of 60 words of their own with two of eight passages of 40; every sixth is a near copy of another."""
    words = [f"w{k}" for k in range(4000)]
    passages = [" ".join(rng.choice(words, 40)) for _ in range(8)]
    rows = []
    for i in range(n):
        a, b = rng.choice(8, 2, replace=False)
        own = list(rng.choice(words, 60))
        rows.append((i, " ".join([passages[a], *own, passages[b]])))
        if i % 6 == 5:
            rows.append((1000 + i, rows[-1][1] + " changed at its end"))
    return rows


def test_quoted_passages_send_no_texts_to_cells(spark, monkeypatch):
    """All texts met in cells that grow with the square of their number, as the passages chain them to one group."""
    monkeypatch.setattr(ngram_join, "LONG", 3)
    monkeypatch.setattr(ngram_join, "SPARE", 2)
    # In large tables a window of a million tokens holds too few of a passage for it to be found frequent while reading.
    monkeypatch.setattr(ngram_join, "frequent_tokens", lambda texts: np.zeros(0, np.uint64))
    dealt, deal = [], ngram_join.in_cells
    monkeypatch.setattr(ngram_join, "in_cells", lambda members: dealt.append(members.count()) or deal(members))
    rows = quoting(np.random.default_rng(8), 48)
    found = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = components(rows)
    assert {r["doc_id"]: r["component_id"] for r in found} == want and len(set(want.values())) == 48
    assert not dealt


def test_texts_of_nothing_but_quoted_passages_still_meet(spark, monkeypatch):
    """Texts of which four fifths are quoted have no rarer tokens to meet by; their links are found in cells, also among repeated ids."""
    monkeypatch.setattr(ngram_join, "LONG", 3)
    monkeypatch.setattr(ngram_join, "SPARE", 1)
    monkeypatch.setattr(ngram_join, "CELL", 3)
    monkeypatch.setattr(ngram_join, "frequent_tokens", lambda texts: np.zeros(0, np.uint64))
    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in range(4000)]
    passages = [" ".join(rng.choice(words, 40)) for _ in range(5)]
    rows = [(i, " ".join([passages[i % 5], passages[(i + 1 + i // 5) % 5], *rng.choice(words, int(rng.integers(0, 9)))])) for i in range(40)]
    want = components(rows)
    twice = [*rows, *rows[::4]]
    found = ngram_join.jaccard_components(spark.createDataFrame(twice, "doc_id long, text string"), links=True).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == want and len(found) == 50 and 1 < len(set(want.values())) < 40


def test_only_the_most_frequent_tokens_are_taken(spark, monkeypatch):
    """As many as may be, those of the highest counts; of equal counts a share."""
    monkeypatch.setattr(ngram_join, "MOST_FREQUENT", 500)
    rng = np.random.default_rng(10)
    tokens = [int(h) for h in rng.integers(-(2**63), 2**63 - 1, 2300)]
    counted = spark.createDataFrame([(h, 90 if k < 300 else 70) for k, h in enumerate(tokens)], "h long, c long")
    got = {int(x) for x in ngram_join._most_frequent(counted).view(np.int64)}
    assert set(tokens[:300]) <= got <= set(tokens) and 440 < len(got) < 560
    monkeypatch.setattr(ngram_join, "MOST_FREQUENT", 5000)
    assert len(ngram_join._most_frequent(counted)) == 2300 and not len(ngram_join._most_frequent(counted.filter("c > 100")))
