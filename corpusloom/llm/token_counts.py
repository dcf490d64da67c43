"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are made."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import texts

#: A blank as the vocabulary writes it.
SPACE = "▁"
#: Strings a worker remembers, the longest of them, and code points of a text that are taken at once; all only bound memory.
REMEMBER, SHORT, PIECE = 1_000_000, 64, 1_000_000


def count_merges(symbols: list[str], rank: dict[str, int]) -> int:
    """Merges until no two neighbours form a piece: always the pair of lowest rank, of equal ones the leftmost.

    A heap holds candidate pairs as rank and place in one number, a linked list the symbols that are left. ``pair`` has the
    rank that each symbol forms with its right neighbour at present (-1: none); a candidate of another rank is stale.
    """
    size, get = len(symbols), rank.get
    text = list(symbols)
    pair = [get(x + y, -1) for x, y in zip(text, text[1:])]
    pair.append(-1)
    heap = [r << 40 | i for i, r in enumerate(pair) if r >= 0]
    if not heap:
        return 0
    left, right = list(range(-1, size - 1)), list(range(1, size + 1))
    heapq.heapify(heap)
    merges = 0
    while heap:
        low = heapq.heappop(heap)
        a = low & 0xFFFFFFFFFF
        if pair[a] != low >> 40:
            continue
        merges += 1
        b = right[a]
        joined = text[a] = text[a] + text[b]
        pair[b] = pair[a] = -1
        right[a] = after = right[b]
        if after < size:
            left[after] = a
            pair[a] = r = get(joined + text[after], -1)
            if r >= 0:
                heapq.heappush(heap, r << 40 | a)
        before = left[a]
        if before >= 0:
            pair[before] = r = get(text[before] + joined, -1)
            if r >= 0:
                heapq.heappush(heap, r << 40 | before)
    return merges


class Pieces(dict):
    """Number of tokens by string, filled as strings are met."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        if any(self.model.is_unused(i) for i in ids):
            raise ValueError("vocabularies with unused pieces are not supported")
        score = {self.model.id_to_piece(i): self.model.get_score(i) for i in ids if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))}
        place = {x: k for k, x in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {p: place[x] for p, x in score.items()}  # pieces of one score have one rank
        self.single = {p for p in score if len(p) == 1}
        if any(c not in self.single for p in score for c in p):
            raise ValueError("a piece has a character that is no piece")
        self.bytes = any(self.model.is_byte(i) for i in ids)
        if not self.bytes:
            raise ValueError("vocabularies without bytes are not supported")
        # where no piece goes on with a blank after another character, nothing merges across such a place
        apart = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in score)
        self.find = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall if apart else (lambda text: [text])
        self.cut = re.compile(f"(?<=[^{SPACE}]){SPACE}").search if apart else (lambda text, at: None)

    def tokens(self, string: str) -> int:
        """Symbols (a character, or each byte of one that is no piece) less merges."""
        symbols = list(string)
        at_first = len(symbols) if self.single.issuperset(symbols) else sum(1 if c in self.single else len(c.encode()) for c in symbols)
        return at_first - count_merges(symbols, self.rank)

    def __missing__(self, string: str) -> int:
        n = self.tokens(string)
        if len(string) <= SHORT:
            if len(self) >= REMEMBER:
                self.clear()
            self[string] = n
        return n

    def count(self, text: str) -> int:
        """Tokens of a whole text; a long one is taken in parts between which nothing merges."""
        text, total, start = self.model.normalize(text), 0, 0
        while start < len(text):
            stop = self.cut(text, start + PIECE) if len(text) - start > PIECE else None
            end = stop.start() if stop else len(text)
            total += sum(map(self.__getitem__, self.find(text[start:end] if start or stop else text)))
            start = end
        return total


_LOADED: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) per row of ``docs``.

    Counts are those of the sentencepiece BPE model at ``path`` (which every executor has), after its normalisation,
    without begin and end; its special strings are ordinary text. Characters outside the vocabulary count their bytes.
    Null or empty texts have no token, null ids and repeated rows are kept, an empty table stays empty. Models with
    user-defined or unused pieces or without bytes are not supported. Rows need no shuffle; a worker remembers short
    strings that it has counted.
    """
    kind = docs.schema[id_col]
    out = T.StructType([T.StructField("id", kind.dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from corpusloom.llm.token_counts import pieces

        known = pieces(path)
        for batch in batches:
            found = [known.count(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=out.names)

    some = texts(docs, id_col, text_col).select("id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    counted = some.mapInArrow(run, out)
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
