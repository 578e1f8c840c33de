"""SentencePiece encoding and decoding through a distinct-chunk table.

With no vocabulary piece that holds a whitespace marker after another character, no merge can cross the
place where a marker follows a non-marker. The marked text (`▁` for each space, one in front) therefore
falls into chunks `▁*[^▁]*` that are segmented independently. Each distinct chunk of a batch is segmented
once by the library; a text's ids are its chunks' ids joined back by position, and its decoded text is
joined the same way. The table persists across batches of a task up to `max_table` entries and is then
started again, so memory is bounded whatever the vocabulary of the corpus.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import field, map_texts

MARK = "\u2581"
#: A run of spaces or markers, then everything up to the next one.
_CHUNK = re.compile(f"[ {MARK}]+[^ {MARK}]*")
MAX_TABLE = 400_000
LONG_CHUNK = 200


class ChunkCodec:
    """Encoder and decoder over whole texts, equal to the library's encode() and decode() of the same model."""

    def __init__(self, model_file: str, max_table: int = MAX_TABLE):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.max_table = max_table
        self.ids: dict[str, bytes] = {}  # chunk -> its ids as 32-bit integers
        self.odd: dict[str, str] = {}  # chunks that don't decode to themselves
        # Chunks are independent only under these properties of the model; else whole texts are segmented.
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()))
        self.by_chunk = (
            not any(MARK in p.lstrip(MARK) for p in pieces)
            and self.sp.normalize(" a  b ") == f"{MARK}{MARK}a{MARK}{MARK}b{MARK}"
            and self.sp.normalize("\uff21 \u00e9\u0301") == f"{MARK}\uff21{MARK}\u00e9\u0301"
        )

    def _segment(self, chunks: list[str]) -> None:
        """Puts chunks into the table; the library's own leading marker stands for the first one of each."""
        made = self.sp.encode([c[1:] for c in chunks], num_threads=1)
        lone = [self.sp.piece_to_id(MARK)]  # the library encodes "" to nothing; a marker alone is its own piece
        made = [x or lone for x in made]
        for chunk, ids, text in zip(chunks, made, self.sp.decode(made, num_threads=1)):
            self.ids[chunk] = np.array(ids, np.int32).tobytes()
            if " " + text != chunk:
                self.odd[chunk] = " " + text

    def encode_decode(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """Ids (32-bit integers) and decoded text of each text; nothing for null."""
        texts = [t or "" for t in texts]
        if not self.by_chunk:
            made = self.sp.encode(texts, num_threads=1)
            return [(np.array(x, np.int32).tobytes(), self.sp.decode(x) if x else "") for x in made]
        cut = [_CHUNK.findall(" " + t) if t else [] for t in texts]
        new = set(chain.from_iterable(cut)).difference(self.ids)
        if new:
            self._segment(list(new))
        known, odd = self.ids.__getitem__, self.odd
        out = []
        for text, chunks in zip(texts, cut):
            ids = b"".join(map(known, chunks))
            same = not odd or odd.keys().isdisjoint(chunks)
            out.append((ids, text if same else "".join(odd.get(c, c) for c in chunks)[1:]))
        for c in new:
            if len(c) > LONG_CHUNK:
                del self.ids[c]
                odd.pop(c, None)
        if len(self.ids) > self.max_table:
            self.ids.clear()
            odd.clear()
        return out


@lru_cache(maxsize=2)
def _codec(model_file: str, max_table: int) -> ChunkCodec:
    """One codec, with its table, per Python worker: tasks that reuse the worker find the table filled."""
    return ChunkCodec(model_file, max_table)


def sentencepiece_codec(
    df: DataFrame,
    model_file: str,
    id_cols: list[str] | None = None,
    text_col: str = "text",
    ids_col: str = "ids",
    decoded_col: str = "decoded",
    max_table: int = MAX_TABLE,
) -> DataFrame:
    """`id_cols` of each row with the token ids of its whole text and the text those ids decode to.

    One row out per row in, in no order. Null text: null ids and null decoded text. Empty text: no ids
    and the empty text. Repeated rows repeat. Other columns of `df` are not read. Texts of any length are
    encoded whole. `model_file` must exist at the same path on every executor.
    """

    def start():
        codec = _codec(model_file, max_table)

        def work(texts):
            made = codec.encode_decode([None if t is None else t.decode() for t in texts])
            flat = np.frombuffer(b"".join(ids for ids, _ in made), np.int32)
            ends = np.cumsum([0, *(len(ids) // 4 for ids, _ in made)])
            null = np.array([t is None for t in texts])
            offsets = pa.array(ends.astype(np.int32), mask=np.append(null, False))
            return {ids_col: pa.ListArray.from_arrays(offsets, pa.array(flat)), decoded_col: [None if n else x for n, (_, x) in zip(null, made)]}

        return work

    new = T.StructType([field(ids_col, T.ArrayType(T.IntegerType())), field(decoded_col, T.StringType())])
    return map_texts(df, id_cols or ["doc_id"], text_col, new, start)
