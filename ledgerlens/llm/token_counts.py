"""Token counts with overlap resynchronisation for huge documents.

Documents up to ``chunk_chars`` are cut at every proven boundary (see below);
each distinct run between two boundaries is encoded once per task and its
count kept in a bounded table.

A document above ``chunk_chars`` is encoded in overlapping chunks with
offsets. Two neighbours are spliced at a boundary that both encodings have and
that is proven stable: white space after a non-space character always starts a
new pre-token, whatever came before, so tokens on either side of it do not
depend on the other. Where an overlap holds no such boundary it is widened,
at last to the whole document.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import by_value

by_value(__name__)

CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 1 << 10
TABLE_CHARS = 32_000_000  # the table of distinct runs starts anew beyond so many characters
#: Unicode's White_Space characters, as the tokenizer's pattern has them (a fixed list).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A pre-token ends before white space that follows anything else.
STABLE = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")

#: Text between two such boundaries.
RUN = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+\\Z")


class RunCounts:
    """Token counts of distinct runs, which add up to a text's count."""

    def __init__(self, tokenizer):
        self.tokenizer, self.table, self.held = tokenizer, {}, 0

    def count(self, text: str) -> int:
        runs = RUN.findall(text)
        distinct = set(runs)
        if not distinct <= self.table.keys():
            size = sum(map(len, distinct))
            if self.held + size > TABLE_CHARS:
                self.table, self.held = {}, 0
            self.held += size
            new = [r for r in distinct if r not in self.table]
            self.table.update(zip(new, map(len, self.tokenizer.encode_batch_fast(new, add_special_tokens=False))))
        return sum(map(self.table.__getitem__, runs))


def starts(tokenizer, text: str) -> list[int]:
    """Start offsets (characters) of the tokens of a text."""
    return [a for a, _ in tokenizer.encode(text, add_special_tokens=False).offsets]


def count_spliced(tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of ``text``, encoded in chunks of about ``chunk`` characters."""
    total, begin = 0, 0  # tokens before begin are counted; begin is a proven boundary
    end = min(len(text), chunk)
    left = starts(tokenizer, text[:end])
    while end < len(text):
        width, cut = overlap, None
        while cut is None and width < end - begin:
            lo = end - width
            nxt = min(len(text), lo + chunk)
            right = [lo + a for a in starts(tokenizer, text[lo:nxt])]
            # the last character of a chunk may still change its token
            both = {begin + a for a in left} & set(right)
            cut = next((m.start() for m in STABLE.finditer(text, lo + 1, end - 1) if m.start() in both), None)
            if cut is None:
                width *= 2
        if cut is None:  # no boundary in this chunk at all: widen it to twice the size
            end = min(len(text), begin + 2 * (end - begin))
            left = starts(tokenizer, text[begin:end])
            continue
        total += sum(1 for a in left if begin + a < cut)
        left = [a - cut for a in right if a >= cut]
        begin, end = cut, nxt
    return total + len(left)


def token_counts(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = 1024,
                 chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row, tokens as the
    tokenizers library gives them for the whole text, without added special
    tokens; special strings inside a text are handled as the file says.

    Null and empty texts have no bytes and no tokens. Repeated rows are
    counted each; empty tables give no rows; other columns are not read. No
    text is cut: a huge one is spliced from overlapping chunks."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), body.alias("text"), F.octet_length(body).cast("long").alias("n_bytes"))
    kind = rows.schema["key"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(tokenizer)
        tok.no_truncation()
        tok.no_padding()
        runs = RunCounts(tok)
        for batch in batches:
            counts = []
            for text in batch.column(1):
                value = text.as_py()
                counts.append(count_spliced(tok, value, chunk_chars, overlap_chars) if len(value) > chunk_chars
                              else runs.count(value))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())],
                                             names=["key", "n_bytes", "n_tokens"])

    out = rows.mapInArrow(counted, f"key {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
