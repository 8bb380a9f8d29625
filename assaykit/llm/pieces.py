"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is parsed, and its normaliser, word marker, scores and byte
fallback are rebuilt as a tokenizer of the other library: unigram scores as a
unigram model, a BPE model's scores as the order of its merges. Batches are
encoded by the library's threads. Texts are cut where a word ends and the marker
of the next begins (no piece crosses such a place). Segments are told apart by 64-bit
hashes of their bytes; each that a worker has not met is encoded by that tokenizer, and its ids
are compared with those of the original library: ``parity`` tells whether all segments of a
text agreed; only where one did not are the original's ids taken. Decoding is the tokenizer's own.
"""

from __future__ import annotations

import itertools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textio import chunks, small_batches, span_hashes, text_bytes, tidy

MARK = "▁"
MOST_CACHED, MOST_CACHED_IDS = 300_000, 2_400_000  # segments a worker remembers, about 20 MB
LONG_TEXT = 4_000_000  # longer texts are encoded in parts, cut where a segment begins
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


def parse_model(path_or_bytes):
    """The model's protobuf message."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    data = path_or_bytes
    if not isinstance(data, bytes):
        with open(path_or_bytes, "rb") as f:
            data = f.read()
    proto.ParseFromString(data)
    return proto


def bpe_merges(proto) -> list[tuple[str, str]]:
    """Every way to make a piece of two others, in the order of the made piece's score."""
    ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == _NORMAL}
    score = {p.piece: p.score for p in proto.pieces if p.type == _NORMAL}
    found = [(-score[x], ids[x], ids[x[:k]], ids[x[k:]], x[:k], x[k:]) for x in ids for k in range(1, len(x)) if x[:k] in ids and x[k:] in ids]
    return [(m[4], m[5]) for m in sorted(found)]


def rebuild(proto):
    """A tokenizer of the tokenizers library with the model's normaliser, marker, scores and byte fallback."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    unk = next((i for i, p in enumerate(proto.pieces) if p.type == _UNKNOWN), 0)
    if proto.trainer_spec.model_type == 1:
        model = models.Unigram([(p.piece, p.score) for p in proto.pieces], unk, proto.trainer_spec.byte_fallback)
    elif proto.trainer_spec.model_type == 2:
        model = models.BPE({p.piece: i for i, p in enumerate(proto.pieces)}, bpe_merges(proto), unk_token=proto.pieces[unk].piece, fuse_unk=True, byte_fallback=proto.trainer_spec.byte_fallback)
    else:
        raise ValueError("only unigram and BPE models have pieces with scores")
    out = Tokenizer(model)
    spec, steps = proto.normalizer_spec, []
    if spec.precompiled_charsmap:
        steps.append(normalizers.Precompiled(spec.precompiled_charsmap))
    if spec.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    out.normalizer = normalizers.Sequence(steps)
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if spec.add_dummy_prefix else [])])
    return out


def splits_at_spaces(proto) -> bool:
    """Whether texts may be encoded word by word: spaces stay as they are, and no piece goes on behind a space."""
    spec = proto.normalizer_spec
    plain = spec.name == "identity" and not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and spec.add_dummy_prefix
    return plain and not any(MARK in p.piece.lstrip(MARK) or p.type == _USER for p in proto.pieces)


class Codec:
    """Ids of texts and texts of ids, for one model file."""

    def __init__(self, model_path: str, threads: int = 2):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        import sentencepiece

        proto = parse_model(model_path)
        self.original = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.tokenizer = rebuild(proto)
        self.splits = splits_at_spaces(proto)
        self.forget()

    def forget(self) -> None:
        self.hashes, self.uses = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.first, self.count, self.agreed = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, bool)
        self.ids = np.zeros(0, np.int32)

    def segments(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end of each segment, without the marker before it, and the index of each text's first one (n+1)."""
        filled = offsets[:-1][np.diff(offsets) > 0]
        if not self.splits:
            return filled, offsets[1:][np.diff(offsets) > 0], np.searchsorted(filled, offsets)
        space = body == 0x20
        heads = np.zeros(len(body) + 1, bool)
        heads[filled] = True
        marks = np.flatnonzero(space[1:] & ~space[:-1] & ~heads[1 : len(body)]) + 1
        # A text that ends in its marker has an empty segment at the place where the next text begins: it belongs before that.
        owner = np.concatenate([np.searchsorted(offsets, filled, side="right") - 1, np.searchsorted(offsets, marks, side="right") - 1])
        at = np.concatenate([filled, marks + 1])
        order = np.lexsort((at, owner))
        begins, owner = at[order], owner[order]
        last = np.concatenate([owner[1:] != owner[:-1], [True]])[: len(owner)]
        ends = np.where(last, offsets[1:][owner], np.concatenate([begins[1:], [0]])[: len(begins)] - 1)
        return begins, ends, np.searchsorted(owner, np.arange(len(offsets)))

    def _encoded(self, words: list[str]) -> tuple[list[list[int]], np.ndarray]:
        """Ids by the rebuilt tokenizer, those of the original where they differ, and whether they agreed."""
        empty = [i for i, w in enumerate(words) if not w]
        mine = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        theirs = self.original.encode(words, num_threads=1)
        for i in empty:  # a marker alone: alone it is no text, so both libraries are asked behind a word
            mine[i] = self.tokenizer.encode("a ", add_special_tokens=False).ids[len(self.tokenizer.encode("a", add_special_tokens=False).ids) :]
            theirs[i] = self.original.encode("a ")[len(self.original.encode("a")) :]
        agreed = np.fromiter((a == b for a, b in zip(mine, theirs, strict=True)), bool, len(words))
        for i in np.flatnonzero(~agreed).tolist():
            mine[i] = theirs[i]
        return mine, agreed

    def _shrink(self) -> None:
        """When the memory is full, the half most used stays."""
        if len(self.hashes) <= MOST_CACHED and len(self.ids) <= MOST_CACHED_IDS:
            return
        kept = np.argsort(-self.uses, kind="stable")[: MOST_CACHED // 2]
        kept = np.sort(kept[np.cumsum(self.count[kept]) <= MOST_CACHED_IDS // 2])
        count = self.count[kept]
        first = (np.cumsum(count) - count).astype(np.int32)
        place = np.repeat(self.first[kept] - first, count) + np.arange(int(count.sum()))
        self.ids, self.hashes, self.uses = self.ids[place], self.hashes[kept], self.uses[kept] // 2
        self.count, self.agreed, self.first = count, self.agreed[kept], first

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Add segments to the memory."""
        found, agreed = [], []
        for at in range(0, len(words), 10_000):
            ids, ok = self._encoded(words[at : at + 10_000])
            found += ids
            agreed.append(ok)
        count = np.fromiter(map(len, found), np.int64, len(found))
        at = np.searchsorted(self.hashes, hashes)
        first = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(found), np.int32, int(count.sum()))])
        self.hashes, self.uses = np.insert(self.hashes, at, hashes), np.insert(self.uses, at, 0)
        self.first, self.count, self.agreed = np.insert(self.first, at, first), np.insert(self.count, at, count), np.insert(self.agreed, at, np.concatenate(agreed))

    def encode(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts as UTF-8 bytes without literal markers: all ids, the number of each text's, and whether the libraries agreed."""
        self._shrink()
        begins, ends, first = self.segments(body, offsets)
        if not len(begins):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64), np.ones(len(offsets) - 1, bool)
        hashes, sample, which, uses = np.unique(span_hashes(body, begins, ends), return_index=True, return_inverse=True, return_counts=True)
        known = np.zeros(len(hashes), bool)
        if len(self.hashes):
            known = self.hashes[np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)] == hashes
        if not known.all():
            new = sample[~known]
            view = memoryview(np.ascontiguousarray(body))
            self._learn(hashes[~known], [str(view[a:b], "utf-8") for a, b in zip(begins[new].tolist(), ends[new].tolist(), strict=True)])
        at = np.searchsorted(self.hashes, hashes)
        self.uses[at] = np.minimum(self.uses[at].astype(np.int64) + uses, 2**30)
        place = at[which]
        count = self.count[place].astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.repeat(self.first[place] - upto[:-1], count) + np.arange(int(upto[-1]))]
        wrong = np.concatenate([[0], np.cumsum(~self.agreed[place])])
        return ids, upto[first[1:]] - upto[first[:-1]], wrong[first[1:]] == wrong[first[:-1]]

    def encode_texts(self, texts: list[str]) -> list[list[int]]:
        """Ids of a few texts."""
        raw = [t.replace(MARK, " ").encode() if self.splits else t.encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        ids, sizes, _ = self.encode(np.frombuffer(b"".join(raw), np.uint8), offsets)
        return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] if len(texts) else []

    def decode(self, rows: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(rows, skip_special_tokens=False)


def _rows(ids: np.ndarray, sizes: np.ndarray) -> list[list[int]]:
    flat, ends = ids.tolist(), np.cumsum(sizes).tolist()
    return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


_codecs: dict[str, Codec] = {}


def codec(model_path: str) -> Codec:
    """The codec of this worker process, which later tasks use again."""
    if model_path not in _codecs:
        _codecs.clear()
        _codecs[model_path] = Codec(model_path)
    return _codecs[model_path]


def _parts(body: np.ndarray, splits: bool):
    """Ranges of a long text, cut where a segment begins; its marker is in none of them."""
    at = 0
    while splits and len(body) - at > LONG_TEXT:
        space = body[at + LONG_TEXT :] == 0x20
        marks = np.flatnonzero(space & ~np.concatenate([[body[at + LONG_TEXT - 1] == 0x20], space[:-1]]))
        if not len(marks):
            break
        to = at + LONG_TEXT + int(marks[0])
        yield at, to
        at = to + 1
    yield at, len(body)


def encode_texts(df: DataFrame, model_path: str, decoded: bool = False) -> DataFrame:
    """All columns of ``df`` plus ``ids`` array<int>, ``n_tokens`` long and ``parity`` boolean.

    With ``decoded`` also ``round_trip`` boolean: whether the ids, decoded by the tokenizer, give the text again (a literal
    marker reads as the space that it is to the model).
    Null and empty texts have no ids and parity true. Whole texts are encoded, repeated rows each; clashing columns
    are replaced; an empty table gives no rows. No shuffle; a worker holds one chunk of texts (or one part of a long
    text) and a bounded memory of segments. Segments are remembered by a 64-bit hash.
    """
    small_batches(df.sparkSession)
    added = ["ids", "n_tokens", "parity", *["round_trip"] * decoded]
    df = df.drop(*added)
    columns = df.columns
    at_text = columns.index("text")

    def run(batches):
        mine = codec(model_path)
        for batch in batches:
            column = batch.column(at_text).cast(pa.string())
            if mine.splits:
                column = pc.replace_substring(column, MARK, " ")
            body, offsets = text_bytes(column)
            for a, b in chunks(offsets):
                part, bounds = body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                if b - a == 1 and len(part) > LONG_TEXT:
                    some = [mine.encode(part[p:q], np.array([0, q - p])) for p, q in _parts(part, mine.splits)]
                    ids, sizes, parity = np.concatenate([x[0] for x in some]), sum(x[1] for x in some), np.array([all(x[2][0] for x in some)])
                else:
                    ids, sizes, parity = mine.encode(part, bounds)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ids))
                values = [lists, pa.array(sizes), pa.array(parity)]
                if decoded:
                    values.append(pc.equal(pa.array(mine.decode(_rows(ids, sizes)), pa.string()), column.slice(a, b - a).fill_null("")))
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in batch.columns], *values], names=[*columns, *added])

    kinds = {"ids": "array<int>", "n_tokens": "long"}
    schema = df.limit(0).withColumns({c: F.lit(None).cast(kinds.get(c, "boolean")) for c in added}).schema
    return df.mapInArrow(tidy(run), schema)


def decode_ids(df: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of ``df`` but ``ids``, plus the text that the ids stand for.

    Null ids decode to null, no ids to the empty text; repeated rows each; an empty table gives no rows. A column
    of the name ``out`` is replaced. Bytes that are no UTF-8 become the replacement character.
    """
    rest = [c for c in df.columns if c not in (ids, out)]
    df = df.select(*[F.col(f"`{c}`") for c in rest], ids)

    def run(batches):
        mine = codec(model_path)
        for batch in batches:
            lists = batch.column(len(rest))
            sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
            flat, upto = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
            for a, b in chunks(upto, 200_000):
                array = pa.array(mine.decode(_rows(flat[upto[a] : upto[b]], sizes[a:b])), pa.string(), mask=~lists.slice(a, b - a).is_valid().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in batch.columns[: len(rest)]], array], names=[*rest, out])

    return df.mapInArrow(tidy(run), df.drop(ids).limit(0).withColumn(out, F.lit("").cast("string")).schema)
