"""Token counts of whole texts; huge ones in overlapping chunks that are resynchronised.

A chunk's encoding is right except near its cut ends. Two neighbours share an overlap; where both have a token boundary
between white space and a word, and the same ids on either side of it for RUN tokens, what lies before comes from the first and
what lies after from the second: no piece of these vocabularies crosses white space, so that boundary is proven.
If the overlap holds no such place it is doubled, up to all that the first holds, and then the document is encoded whole.

Null and empty texts have no tokens. Repeated rows and doc_ids are counted row by row; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_text, sliced
from .word_tokens import word_tokens

#: Characters of a chunk and of its overlap with the next at first, and tokens that must agree on either side of a splice.
CHUNK, OVERLAP, RUN = 16_384, 256, 2


@dataclass
class Chunk:
    """The tokens of a text from place `low` on: ids, and where each begins and ends, counted from low. What lies before token `skip` is another chunk's."""

    low: int
    ids: list[int]
    places: list[tuple[int, int]]
    skip: int = 0

    def around(self, k: int) -> list[tuple[int, int, int]]:
        """RUN tokens on either side of the beginning of token k, in the text's own places."""
        own = range(k - RUN, k + RUN)
        return [(self.ids[x], self.places[x][0] + self.low, self.places[x][1] + self.low) for x in own]


class Library:
    """A public tokenizer's file: tokenizers for .json, sentencepiece for .model."""

    def __init__(self, path: str):
        self.words = None
        if path.endswith(".json"):
            self.words = word_tokens(path)
            self.kind, self.own = "json", self.words.library
            if not self.words.plain:
                self.words = None
        else:
            import sentencepiece

            self.kind, self.own = "model", sentencepiece.SentencePieceProcessor(model_file=path)

    def chunk(self, text: str, low: int = 0, high: int | None = None) -> Chunk:
        """The tokens of text[low:high]."""
        if self.kind == "json":
            found = self.own.encode(text[low:high], add_special_tokens=False)
            return Chunk(low, found.ids, found.offsets)
        found = self.own.encode(text[low:high], return_type="offset_mapping")
        return Chunk(low, found["ids"], found["offsets"])

    def parts(self, text: str, at: int) -> bool:
        """Whether no token can cross place `at`: a word begins there, by a sentencepiece with its blank."""
        if self.kind == "json":
            return text[at - 1].isspace() and not text[at].isspace()
        return text[at] == " " and not text[at - 1].isspace() and not text[at + 1 : at + 2].isspace()

    def count(self, raw: bytes) -> int:
        if self.words is not None:
            return len(self.words.encode(raw)) // self.words.size
        text = raw.decode("utf-8", "replace")
        if self.kind == "json":
            return len(self.own.encode(text, add_special_tokens=False).ids)
        return len(self.own.encode(text, num_threads=1))


def splice(library: Library, text: str, left: Chunk, right: Chunk, low: int, high: int) -> tuple[int, int] | None:
    """Tokens of left and right that begin at the first proven common boundary; None if there is none in the overlap [low, high). Only the
    overlap's tokens are looked at."""
    begins = {}
    for k, (start, _) in enumerate(right.places):
        if start + right.low >= high:
            break
        begins[start + right.low] = k
    first = bisect_right(left.places, low - left.low, key=lambda t: t[0])
    for i in range(max(first, left.skip + RUN), len(left.ids) - RUN + 1):
        start = left.places[i][0] + left.low if i < len(left.ids) else high
        if i + RUN > len(left.ids) or left.places[i + RUN - 1][1] + left.low >= high:
            break
        j = begins.get(start)
        if j is not None and j >= RUN and j + RUN <= len(right.ids) and library.parts(text, start) and left.around(i) == right.around(j):
            return i, j
    return None


def pieces(library: Library, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[Chunk, int, int]]:
    """The tokens of a text by chunks, the same as of the whole: chunk, first token, last token and one; none, and no more, if no place proves a splice."""
    at, own, wide = 0, library.chunk(text, 0, chunk), overlap
    end = min(len(text), chunk)
    while end < len(text):
        low = max(at, end - wide)
        stop = min(len(text), low + chunk + wide)
        new = library.chunk(text, low, stop)
        if found := splice(library, text, own, new, low, end):
            yield own, own.skip, found[0]
            new.skip = found[1]
            own, at, end, wide = new, new.places[found[1]][0] + low, stop, overlap
        elif low > at:
            wide *= 2
        else:  # no place that both chunks prove
            yield own, 0, 0
            return
    if len(own.ids) > own.skip:
        yield own, own.skip, len(own.ids)


def spliced(library: Library, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Ids of a text by chunks: the same as of the whole."""
    ids: list[int] = []
    for own, first, last in pieces(library, text, chunk, overlap):
        if first == last:
            return library.chunk(text).ids
        ids += own.ids[first:last]
    return ids


def spliced_count(library: Library, raw: bytes, chunk: int = CHUNK) -> int:
    """How many ids spliced() gives; no more than a chunk's are held, and of a text that can't be spliced their number only."""
    n = 0
    for _, first, last in pieces(library, raw.decode("utf-8", "replace"), chunk):
        if first == last:
            return library.count(raw)
        n += last - first
    return n


_OPEN: dict[str, Library] = {}


def count(path: str, raw: bytes, chunk: int = CHUNK) -> int:
    if path not in _OPEN:
        _OPEN[path] = Library(path)
    library = _OPEN[path]
    if len(raw) <= chunk:
        return library.count(raw)
    return spliced_count(library, raw, chunk)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            texts = part.column(1).to_pylist()
            counts = [count(tokenizer, x) for x in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text(text))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
