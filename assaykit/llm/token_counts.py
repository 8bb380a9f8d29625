"""Token counts by prefix dynamic programming.

A piece of the vocabulary never holds the word marker after another character,
so no merge crosses the place where a word ends and a marker begins. The count
at the end of word i is therefore the count at the end of word i-1 plus the
tokens of word i alone: one pass stores the exact count at every such prefix, and
truncation and budget questions are answered by a search in it. Any other prefix
costs the encoding of one part of a word (``prefix_counts``).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import MARK, parse_model, splits_at_spaces
from .textio import small_batches

_SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_CACHED, _LONGEST = 200_000, 48


class PrefixCounter:
    """Counts of a sentencepiece model at the end of every word of a text."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        #: Without this property only whole texts may be encoded.
        self.splits = splits_at_spaces(parse_model(model_path))
        self.lone_marker = 3 if self.model.piece_to_id(MARK) == self.model.unk_id() else 1
        self.known: dict[str, int] = {}

    def segments(self, text: str) -> list[str]:
        """The words of a text, each as the library must be given it: its first marker is the one that the library adds."""
        if not text:
            return []
        if not self.splits:
            return [text]
        text = text.replace(MARK, " ")
        parts = text.split(" ")
        if "" not in parts:
            return parts
        return [x[1:].replace(MARK, " ") for x in _SEGMENT.findall(MARK + text.replace(" ", MARK))]

    def counts(self, rows: list[list[str]]) -> list[np.ndarray]:
        """For each row of segments the number of tokens of each."""
        if len(self.known) > _CACHED:
            self.known = {}
        known = self.known
        new = list(set().union(*rows).difference(known)) if rows else []
        extra = {}
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            for word, ids in zip(some, self.model.encode(some, num_threads=1), strict=True):
                # The segment that is only a marker is the empty word, for which the library gives no tokens.
                n = len(ids) if word else self.lone_marker
                (known if len(word) <= _LONGEST else extra)[word] = n
        get = known.__getitem__ if not extra else (lambda w: known[w] if w in known else extra[w])
        return [np.fromiter(map(get, row), np.int64, len(row)) for row in rows]

    def prefix_count(self, body: bytes, ends: np.ndarray, sums: np.ndarray, n_bytes: int) -> int:
        """Exact tokens of the first ``n_bytes`` of a text: the stored count of its whole words, plus the part of the next word.

        ``ends`` and ``sums`` are the stored prefixes (``prefix_bytes, prefix_tokens``). Only that part is encoded; a
        code point of which bytes are missing counts as the replacement character.
        """
        k = int(np.searchsorted(ends, n_bytes, side="right"))
        have, at = (int(sums[k - 1]), int(ends[k - 1])) if k else (0, 0)
        if k == len(ends) or n_bytes <= at:
            return have
        if not k:
            return len(self.model.encode(body[:n_bytes].decode("utf-8", "replace")))
        if body[at : at + 1] != b" " and n_bytes - at < len(MARK.encode()):
            rest = body[at:n_bytes].decode("utf-8", "replace")  # within a literal marker
            return have + len(self.model.encode("a" + rest)) - len(self.model.encode("a"))
        rest = body[at + (1 if body[at : at + 1] == b" " else len(MARK.encode())) : n_bytes].decode("utf-8", "replace")
        return have + (len(self.model.encode(rest)) if rest else self.lone_marker)


def prefix_ends(text: str, segments: list[str]) -> np.ndarray:
    """UTF-8 byte offset of the end of each segment."""
    if not segments:
        return np.zeros(0, np.int64)
    if len(segments) == 1:
        return np.array([len(text.encode())])
    sizes = np.fromiter((len(x.encode()) for x in segments), np.int64, len(segments))
    return np.cumsum(sizes + 1) - 1


def count_tokens(df: DataFrame, model_path: str, limit: int = 4096, keep_prefixes: bool = False) -> DataFrame:
    """Per row ``doc_id, n_bytes, n_tokens, over_limit, fit_bytes`` (bytes of the longest prefix of whole words within ``limit`` tokens).

    ``keep_prefixes`` adds ``prefix_bytes`` and ``prefix_tokens``: the end of each word and the exact count there.
    Null and empty texts have no tokens. Repeated rows are counted each. Other columns are not read. A literal
    word marker in a text is the space to the model and to this count. No shuffle; memory is one Arrow batch.
    """
    small_batches(df.sparkSession)
    fields = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_bytes long" + ", prefix_bytes array<long>, prefix_tokens array<long>" * keep_prefixes

    def run(batches):
        counter = PrefixCounter(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [x or "" for x in part.column(1).to_pylist()]
                rows = [counter.segments(x) for x in texts]
                cols = [[], [], [], [], []]
                for text, row, each in zip(texts, rows, counter.counts(rows), strict=True):
                    sums = np.cumsum(each)
                    n = int(sums[-1]) if len(sums) else 0
                    n_bytes = len(text.encode())
                    fit = n_bytes
                    if n > limit or keep_prefixes:
                        ends = prefix_ends(text, row) if MARK not in text else prefix_ends_marked(text, row)
                        k = int(np.searchsorted(sums, limit, side="right"))
                        fit = n_bytes if n <= limit else int(ends[k - 1]) if k else 0
                    cols[0].append(n_bytes)
                    cols[1].append(n)
                    cols[2].append(fit)
                    if keep_prefixes:
                        cols[3].append(ends)
                        cols[4].append(sums)
                n_tokens = np.array(cols[1], np.int64)
                arrays = [part.column(0), pa.array(cols[0], pa.int64()), pa.array(n_tokens), pa.array(n_tokens > limit), pa.array(cols[2], pa.int64())]
                names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_bytes"]
                if keep_prefixes:
                    arrays += [pa.array(x, pa.list_(pa.int64())) for x in cols[3:]]
                    names += ["prefix_bytes", "prefix_tokens"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, fields)


def prefix_counts(df: DataFrame, model_path: str, n_bytes: str = "cut_bytes") -> DataFrame:
    """All columns of ``df`` plus ``cut_tokens`` long: the exact tokens of the first ``n_bytes`` bytes of ``text``.

    ``df`` holds ``text`` with the stored ``prefix_bytes`` and ``prefix_tokens``; the text is not encoded again but for a part of one
    word. Null texts have no tokens; a null or negative length counts as 0, one beyond the text as the whole text.
    """
    names = [c for c in df.columns if c != "cut_tokens"]
    df = df.select(*[F.col(f"`{c}`") for c in names])

    def run(batches):
        counter = PrefixCounter(model_path)
        for batch in batches:
            col = {n: batch.column(names.index(n)).to_pylist() for n in ("text", "prefix_bytes", "prefix_tokens", n_bytes)}
            out = [counter.prefix_count((t or "").encode(), np.array(e or [], np.int64), np.array(s or [], np.int64), max(0, n or 0)) for t, e, s, n in zip(*col.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*names, "cut_tokens"])

    return df.mapInArrow(run, df.limit(0).withColumn("cut_tokens", F.lit(None).cast("long")).schema)


def prefix_ends_marked(text: str, segments: list[str]) -> np.ndarray:
    """As ``prefix_ends``, for a text that holds literal markers (three bytes where a space has one)."""
    chars = np.cumsum(np.fromiter((len(x) for x in segments), np.int64, len(segments)) + 1) - 1
    sizes = np.cumsum([0] + [len(c.encode()) for c in text])
    return sizes[chars]
