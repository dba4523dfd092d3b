"""SentencePiece encoding and decoding over a table of distinct chunks.

In a vocabulary whose pieces hold the white-space marker only at their front,
no merge crosses from a word's end into the next marker. A text is then a row
of marked words (a run of markers and the characters up to the next marker)
that segment independently: each distinct marked word is segmented and decoded
once per task, kept in a bounded table, and ids are joined back by position.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import by_value

by_value(__name__)

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]+|{MARK}+$")
TABLE_CHARS = 48_000_000  # the distinct table starts anew beyond so many characters
BATCH_CHARS = 2_000_000  # results are handed on when so many characters are done


class Codec:
    """Exact encode and decode of one model, word by word.

    Falls back to whole texts if the model does not allow the split: a piece
    crosses a marker, or the normaliser is not the identity with a dummy
    prefix and kept spaces."""

    def __init__(self, path: str):
        self.whole = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.whole.get_piece_size()
        pieces = [self.whole.id_to_piece(i) for i in range(size)]
        self.pieces = [p.replace(MARK, " ") for p in pieces]
        kinds = (self.whole.is_byte, self.whole.is_control, self.whole.is_unknown, self.whole.is_unused)
        self.special = {i for i in range(size) if any(kind(i) for kind in kinds)}
        probe = "a ﬁ½  b\t\n c "
        self.split = (not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
                      and self.whole.decode(self.whole.encode(probe)) == probe
                      and "".join(self.whole.encode(f"x  {probe}", out_type=str)).startswith(f"{MARK}x{MARK}{MARK}"))
        self.lone = [self.whole.piece_to_id(MARK)]
        # a known piece in front keeps the decoder from dropping a chunk's own marker
        self.front = self.whole.encode("a")
        self.front_text = self.whole.decode(self.front)
        self.table: dict[str, tuple[list[int], str]] = {}
        self.held = 0

    def learn(self, words: set[str]) -> None:
        """Segment and decode words that the table does not have."""
        size = sum(map(len, words))
        if self.held + size > TABLE_CHARS:
            self.table.clear()
            self.held = 0
        self.held += size
        new = [w for w in words if w not in self.table and w != MARK]
        # the library puts the first marker back; a lone marker is a piece of its own
        for word, ids in zip(new, self.whole.encode([w[1:] for w in new], num_threads=1)):
            self.table[word] = ids, self.decoded(ids)
        self.table[MARK] = self.lone, self.decoded(self.lone)

    def decoded(self, ids: list[int]) -> str:
        """Text of ids that are not the first of a document."""
        if self.special.isdisjoint(ids):
            return "".join([self.pieces[i] for i in ids])
        return self.whole.decode(self.front + ids)[len(self.front_text):]  # bytes, controls

    def round_trip(self, text: str) -> tuple[list[int], str]:
        if not self.split:
            ids = self.whole.encode(text)
            return ids, self.whole.decode(ids)
        if not text:
            return [], ""
        words = CHUNK.findall(MARK + text.replace(" ", MARK))
        distinct = set(words)
        if not distinct <= self.table.keys():
            self.learn(distinct)
        known = [self.table[w] for w in words]
        # the decoder drops the dummy prefix of the first piece
        out = [self.whole.decode(known[0][0]), *(k[1] for k in known[1:])]
        return list(itertools.chain.from_iterable(k[0] for k in known)), "".join(out)


def encode_decode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text",
                  carry: tuple | list = ()) -> DataFrame:
    """(key, ids array<int>, decoded string[, carried struct]) of every row.

    Null and empty texts have no ids and decode to the empty string. Repeated
    rows are encoded each; empty tables give no rows; a very long text or word
    is processed whole. Columns not named are not read; carried ones travel in
    one struct, so their names cannot clash."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
                       (F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(0)).alias("carried"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for batch in batches:
            texts, at = batch.column(1), 0
            while at < batch.num_rows:
                start, done, ids, out = at, 0, [], []
                while at < batch.num_rows and done < BATCH_CHARS:
                    value = texts[at].as_py()
                    i, t = codec.round_trip(value)
                    ids.append(np.array(i, np.int32))
                    out.append(t)
                    done += len(value)
                    at += 1
                part = batch.slice(start, at - start)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(out, pa.string()), part.column(2)],
                    names=["key", "ids", "decoded", "carried"])

    out = rows.mapInArrow(coded, f"key {kinds['key']}, ids array<int>, decoded string, carried {kinds['carried']}")
    return out.select(F.col("key").alias(key), "ids", "decoded", *(["carried"] if carry else []))
