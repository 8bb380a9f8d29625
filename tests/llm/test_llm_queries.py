"""The queries of the operators on small tables with nulls, repeats and clashing columns, against brute force; held-out accuracy."""

import collections
import hashlib
import tempfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.llm import mixing, pieces, queries, suffix_dedup
from assaykit.llm.queries import model_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, size string"
DATA = "/root/testdata/sf0.01"


def folder(spark, rows, schema=SCHEMA):
    """A table of documents as a query finds it."""
    path = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    return path


def doc(i, text, source="s"):
    return (i, text, "en", source, len(text or ""), 9, "x")


WORDS = [f"w{k}" for k in range(400)]
BASE = " ".join(WORDS[:60])
ROWS = [doc(1, BASE, "a"), doc(1, BASE, "a"), doc(1, BASE, "a"), doc(2, None, "a"), doc(3, "", None), doc(None, "one two three", None), doc(4, BASE + " tail", "b"), doc(5, " ".join(WORDS[100:250]), "b"), doc(6, "é  ü\n\tx", "c"), doc(7, " ".join(WORDS[250:330]), None)]


def rows_of(name, spark, sf_dir):
    return queries.queries()[name](spark, sf_dir).collect()


def test_mix_has_one_row_for_each_row(spark):
    got = rows_of("op7_source_mix", spark, folder(spark, ROWS))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in ROWS)
    assert all(0 <= r["taken"] <= 3 * r["size"] and sum(r["shard_words"]) == r["taken"] for r in got)
    names = sorted({r[3] for r in ROWS}, key=lambda s: (s is None, s or ""))
    size = {s: sum(len((r[1] or "").split()) for r in ROWS if r[3] == s) for s in names}
    targets = mixing.fill_targets([size[s] for s in names], [1, 2, 3, 1][: len(names)], 3)
    want, taken = {(size[s], round(t, 6)): round(t) for s, t in zip(names, targets, strict=True)}, collections.Counter()
    for r in got:
        taken[r["source_size"], round(r["target"], 6)] += r["taken"]
    assert all(taken[k] == n for k, n in want.items())
    again = sorted(map(str, rows_of("op7_source_mix", spark, folder(spark, ROWS[::-1]))))
    assert again == sorted(map(str, got))


def test_components_of_repeated_nameless_and_tied_rows(spark):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows_of("op1_ngram_jaccard", spark, folder(spark, ROWS))}
    assert len(rows_of("op1_ngram_jaccard", spark, folder(spark, ROWS))) == len(ROWS)
    assert {(1, 56, 1), (4, 57, 1), (2, 0, 2), (3, 0, 3), (6, 1, 6), (5, 146, 5), (None, 1, None)} <= got


def test_shards_of_the_query(spark):
    got = rows_of("op2_external_shuffle", spark, folder(spark, ROWS))
    text = {(r[0], r[1]): (len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in ROWS}
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == collections.Counter((i, *text[i, t]) for i, t in [(r[0], r[1]) for r in ROWS])
    for s in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots))) and len(slots) in (len(ROWS) // 8, -(-len(ROWS) // 8))


def brute_spans(raw, span):
    seen = collections.Counter(b[s : s + span] for b in raw for s in range(len(b) - span + 1))
    for b in raw:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - span + 1):
            if seen[b[s : s + span]] > 1:
                gone[s : s + span] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
        yield gone, list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


@pytest.mark.parametrize("hot", [64, 2])
def test_repeated_strings_and_passages(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = np.random.default_rng(7)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefghé"), rng.integers(2, 9))) for _ in range(n))
    passage, short, long_ = text(52), text(45), text(160)
    texts = [text(30) + " " + passage + " " + text(20), passage + " " + text(40), text(5) + " " + short, short + " " + text(9), long_, text(3) + " " + long_ + " " + text(3), None, "", "ab " * 300, text(80)]
    rows = [doc(i, t) for i, t in enumerate(texts)] + [doc(9, texts[9])]
    got = sorted(rows_of("op8_repeated_strings", spark, folder(spark, rows)), key=lambda r: r["doc_id"])
    raw = [(r[1] or "").encode() for r in rows]
    for r, b, (gone, spans), (_, passages) in zip(got, raw, brute_spans(raw, 400), brute_spans(raw, 200), strict=True):
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), int(gone.sum()), len(spans), hashlib.sha256(kept).hexdigest())
        want = [(x, y) for x, y in passages if y - x >= 400 or len([w for w in _words(b) if x <= w[0] and w[1] <= y]) >= 51]
        assert (r["n_passages"], r["passage_bytes"]) == (len(want), sum(y - x for x, y in want))
    assert got[0]["n_passages"] == got[1]["n_passages"] == 1 and got[2]["n_passages"] == got[3]["n_passages"] == 0


def _words(b):
    out, start = [], None
    for i, c in enumerate(b + b" "):
        sep = c in b" \t\n\x0b\x0c\r"
        if not sep and start is None:
            start = i
        if sep and start is not None:
            out.append((start, i))
            start = None
    return out


def test_very_long_texts(spark):
    shared = " ".join(f"s{k}" for k in range(120))
    long_ = " ".join(f"x{k}" for k in range(200_000))
    at = 1_000_000 - 200
    rows = [doc(1, long_[:at] + " " + shared + " " + long_[at:]), doc(2, "a " + shared + " b")]
    got = {r["doc_id"]: r for r in rows_of("op8_repeated_strings", spark, folder(spark, rows))}
    assert all(len(shared) <= got[i]["n_removed"] <= len(shared) + 2 for i in (1, 2)) and got[1]["n_bytes"] > 1_000_000
    nine = {r["doc_id"]: r for r in rows_of("op9_sentencepiece", spark, folder(spark, rows))}
    ten = {r["doc_id"]: r for r in rows_of("op10_token_counts", spark, folder(spark, rows))}
    assert all(nine[i]["parity"] and nine[i]["round_trip"] and nine[i]["n_tokens"] == ten[i]["n_tokens"] for i in (1, 2))


def test_pieces_are_those_of_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    texts = [r[1] for r in ROWS] + [" lead", "a  b   c ", "日本 \x00 🙂", "x▁y  z ", "  ", "\n"]
    got = pieces.encode_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model_path(), decoded=True).collect()
    assert all(r["ids"] == sp.encode((r["text"] or "").replace("▁", " ")) and r["parity"] and r["round_trip"] for r in got) and len(got) == len(texts)


def test_parts_of_a_long_text_and_a_full_memory(monkeypatch):
    monkeypatch.setattr(pieces, "LONG_TEXT", 50)
    monkeypatch.setattr(pieces, "MOST_CACHED", 20)
    codec = pieces.Codec(model_path())
    text = "  ".join(r[1] or "" for r in ROWS) + "   end "
    body = np.frombuffer(text.encode(), np.uint8)
    parts = list(pieces._parts(body, True))
    ids = np.concatenate([codec.encode(body[a:b], np.array([0, b - a]))[0] for a, b in parts]).tolist()
    assert len(parts) > 10 and ids == codec.original.encode(text)


def test_unigram_model(tmp_path):
    """A model whose scores and byte fallback are set by hand."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    for piece, kind in [("<unk>", 2), ("<s>", 3), ("</s>", 3)]:
        proto.pieces.add(piece=piece, score=0, type=kind)
    for b in range(256):
        proto.pieces.add(piece=f"<0x{b:02X}>", score=-20, type=6)
    for k, piece in enumerate(["▁", "a", "b", "c", "ab", "▁ab", "abc", "▁c", "ca", "bca", "▁▁"]):
        proto.pieces.add(piece=piece, score=-1 - k / 7, type=1)
    proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback, proto.trainer_spec.unk_id = 1, True, 0
    proto.normalizer_spec.name, proto.normalizer_spec.add_dummy_prefix = "identity", True
    proto.normalizer_spec.remove_extra_whitespaces, proto.normalizer_spec.escape_whitespaces = False, True
    path = tmp_path / "u.model"
    path.write_bytes(proto.SerializeToString())
    sp, codec = sentencepiece.SentencePieceProcessor(model_file=str(path)), pieces.Codec(str(path))
    texts = ["abcab cab", "ab  abc", "xé ab", "", "c", "bcabca abcabc"]
    assert codec.encode_texts(texts) == [sp.encode(t) for t in texts]
    assert codec.decode(codec.encode_texts(texts)) == texts


@pytest.mark.parametrize("name,label,least", [("op4_quality_trees", "quality", 0.95), ("op5_toxicity_convolution", "toxic", 0.9)])
def test_held_out_rows_are_told_apart(spark, name, label, least):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = queries.queries()[name](spark, DATA).join(labels, "doc_id").filter("held_out").select("score", F.col(label).alias("y"), "predicted").collect()
    pos, neg = [r["score"] for r in rows if r["y"] == 1], [r["score"] for r in rows if r["y"] == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert len(pos) > 10 and len(neg) > 10 and auc >= least


def test_empty_tables(spark):
    path = folder(spark, [])
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    for name, query in queries.queries().items():
        assert not query(spark, path).collect(), name
