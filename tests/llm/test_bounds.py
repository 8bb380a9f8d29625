"""Cells of the n-gram join, the bound on batches, and models that may not be encoded word by word."""

import collections
import tempfile

import numpy as np

from assaykit.llm import ngram_join, queries, suffix_dedup, token_counts
from assaykit.llm.graph import components
from assaykit.llm.textio import cut_few


def test_unrelated_groups_share_no_cells(spark):
    """5,000 sets in 50 groups are sent about once each; before, every set was sent to all of 9 parts."""
    members = spark.createDataFrame([(i, i % 50) for i in range(5000)], "id long, label long")
    cells = ngram_join.in_cells(members)
    assert cells.count() == 5000 and cells.filter("NOT same").isEmpty()
    big = spark.createDataFrame([(i, 0) for i in range(2000)] + [(9000 + i, 1 + i // 2) for i in range(40)], "id long, label long")
    rows = ngram_join.in_cells(big).collect()
    parts = -(-2000 // ngram_join.CELL)
    assert len(rows) == 2000 * parts + 40
    held, part = collections.defaultdict(set), {r["id"]: r["part"] for r in rows}
    for r in rows:
        held[r["id"]].add((r["g"], r["i"], r["j"]))
    rng = np.random.default_rng(0)
    for a, b in rng.integers(0, 2000, (300, 2)).tolist():  # each pair is decided by exactly one cell
        if a != b:
            met = [c for c in held[a] & held[b] if c[1] == c[2] or part[a] != part[b]]
            assert len(met) == 1


def test_components_with_many_frequent_lists(spark, monkeypatch):
    """Long lists of several unrelated families, decided in cells of two sets."""
    monkeypatch.setattr(ngram_join, "LONG", 3)
    monkeypatch.setattr(ngram_join, "SPARE", 1)
    monkeypatch.setattr(ngram_join, "CELL", 2)
    rng, rows = np.random.default_rng(8), []
    for family in range(3):
        base = [f"f{family}w{k}" for k in range(60)]
        for i in range(14):
            words = list(base)
            for at in rng.integers(0, 60, int(rng.integers(0, 3))):
                words[int(at)] = f"x{family}{i}{at}"
            rows.append((family * 100 + i, " ".join(words[: 60 - int(rng.integers(0, 4))])))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert got == {i: find(i) for i in sets}


def model(path, **normalizer):
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    for piece, kind in [("<unk>", 2), ("<s>", 3), ("</s>", 3)]:
        proto.pieces.add(piece=piece, score=0, type=kind)
    for b in range(256):
        proto.pieces.add(piece=f"<0x{b:02X}>", score=-20, type=6)
    for k, piece in enumerate(["▁", "a", "b", "▁a", "▁b", "ab"]):
        proto.pieces.add(piece=piece, score=-1 - k / 7, type=1)
    proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback, proto.trainer_spec.unk_id = 1, True, 0
    spec = {"name": "identity", "add_dummy_prefix": True, "remove_extra_whitespaces": False, "escape_whitespaces": True} | normalizer
    for k, v in spec.items():
        setattr(proto.normalizer_spec, k, v)
    path.write_bytes(proto.SerializeToString())
    return str(path)


def test_models_that_fold_spaces_are_given_whole_texts(spark, tmp_path):
    import sentencepiece

    texts = ["a  b", " a", "a b ", "  ", "ab   ab", "", None, "b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for name, options in (("plain", {}), ("folds", {"remove_extra_whitespaces": True}), ("bare", {"add_dummy_prefix": False})):
        path = model(tmp_path / f"{name}.model", **options)
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, path).collect()}
        assert got == {i: len(sp.encode(t or "")) for i, t in enumerate(texts)}, name


def test_counts_of_the_query_and_its_batches(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    texts = ["word " * 5000, "é", None, "", "a b  c", "x" * 20_000]
    path = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame([(i, t, "n", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, source string, n_bytes int").write.parquet(f"{path}/documents.parquet")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    rows = {r["doc_id"]: r for r in queries.queries()["op10_token_counts"](spark, path).collect()}
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 1000
    for i, t in enumerate(texts):
        n = len(sp.encode(t or ""))
        assert (rows[i]["n_tokens"], rows[i]["n_bytes"], rows[i]["over_limit"]) == (n, len((t or "").encode()), n > 4096)
        fit = rows[i]["fit_bytes"]
        assert len(sp.encode((t or "").encode()[:fit].decode())) <= 4096 and (fit == len((t or "").encode())) == (n <= 4096)


def _shuffled(spark) -> int:
    """Bytes of shuffles written by all stages so far."""
    new = spark.sparkContext._jvm.java.util.ArrayList
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(new(), False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), new()).iterator()
    total = 0
    while stages.hasNext():
        total += stages.next().shuffleWriteBytes()
    return total


def test_long_lists_of_contexts_do_not_shuffle_the_texts(spark, monkeypatch):
    """Beyond the bound on what is broadcast, the result stays and texts without repeats go to no shuffle."""
    rng = np.random.default_rng(5)
    shared = rng.bytes(450).hex()
    rows = [(i, rng.bytes(10_000).hex() + (shared if i < 3 else "")) for i in range(150)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = lambda: sorted(tuple(r) for r in suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans").collect())
    start = _shuffled(spark)
    usual = found()
    assert [r[2] for r in usual[:4]] == [900, 900, 900, 0]
    monkeypatch.setattr(suffix_dedup, "MOST_BROADCAST_ENTRIES", 1)
    before = _shuffled(spark)
    assert found() == usual
    assert (_shuffled(spark) - before) - (before - start) < 500_000  # of 3,000,000 bytes of text, which two shuffles carried


def test_small_components_take_few_tasks(spark):
    """A few links over many shuffle partitions: no round has a join by shuffle, and each writes few files."""
    keys = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    spark.sparkContext.setJobGroup("few", "few links")
    try:
        links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102)], "x long, y long")
        found = {r["node"]: r["label"] for r in components(links).collect()}
        tracker = spark.sparkContext.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("few") for s in tracker.getJobInfo(j).stageIds}
        tasks = sum(i.numTasks for s in stages if (i := tracker.getStageInfo(s)) and i.numCompletedTasks)
    finally:
        spark.sparkContext._jsc.clearJobGroup()
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)}
    assert tasks < 600
    assert len(cut_few(spark.range(1000, numPartitions=50), 1000, 400).inputFiles()) == 3
