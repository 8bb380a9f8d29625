"""The text helpers of the library, under the name by which the operators of this subpackage know them."""

from ..functions.arrowtext import BATCH_ROWS, CHUNK_BYTES, MOST_AMONG, SEPARATORS, WORD, among, chunks, cut, cut_few, cut_parts, held, lowered, met, mix, powers, shared_dir, shingle_sets, short_hash, short_hashes, small_batches, span_hashes, text_bytes, tidy, word_bounds

__all__ = ["BATCH_ROWS", "CHUNK_BYTES", "MOST_AMONG", "SEPARATORS", "WORD", "among", "chunks", "cut", "cut_few", "cut_parts", "held", "lowered", "met", "mix", "powers", "shared_dir", "shingle_sets", "short_hash", "short_hashes", "small_batches", "span_hashes", "text_bytes", "tidy", "word_bounds"]
