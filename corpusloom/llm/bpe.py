"""Byte-level BPE in DuckDB, one in-memory database per Python worker.

The words that a task has not met before become rows (word, position, token). A recursive query joins
neighbours with the merge table and contracts each word's leftmost pair of minimum rank until nothing merges.
Decoding is an ordered aggregation of the tokens' bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code points (or ids) taken at once, bytes of new words merged at once and distinct strings a worker remembers; all only
#: bound memory.
PIECE, MERGE, REMEMBER = 1_500_000, 500_000, 1_000_000
#: The same for jobs whose executors hold more than this step: a worker takes 340 MB at most instead of 620, for half as much
#: CPU again.
SMALL = (500_000, 125_000, 150_000)
#: A blank at either end of a text or next to other white space.
BLANKS = r"^ | $|[\s\x0b\x1c-\x1f\x{85}\pZ] | [\s\x0b\x1c-\x1f\x{85}\pZ]"

# A row is a token of a word, with the rank m of the pair that it forms with its right neighbour (null: none). A round finds each
# word's lowest rank and contracts its places, the left one of two that overlap; only the leftmost where the new token may
# take part in an earlier rank (wary). Contracting the others in one round gives what one by one would give.
# A word's last row has no pair, so ranks looked up to the left need no test that they belong to the same word.
# ENCODE reads neighbours in stored order (one thread keeps it, and the query stops if it doesn't) and keeps all rounds;
# for LONG words the second form sorts, and keeps the last state of each place only (id -1: contracted away).
LONG = 64
ENCODE = """
WITH RECURSIVE step(w, pos, id, m, wary, round) AS (
    SELECT w, pos, id, merged, wary, 0 FROM parts LEFT JOIN merges ON pair = id * 1000000::BIGINT + nxt
    UNION ALL
    SELECT w, pos, new, merged, x.wary, round FROM (
        SELECT w, pos, round, CASE WHEN take THEN m ELSE id END AS new,
            CASE WHEN take THEN CASE WHEN k2 >> 32 = w THEN CASE WHEN m2 = best AND m1 IS DISTINCT FROM best AND (NOT strict OR k2 & 4294967295 = first) THEN best ELSE id2 END END
                 WHEN k1 >> 32 = w THEN CASE WHEN m1 = best AND m IS DISTINCT FROM best AND (NOT strict OR k1 & 4294967295 = first) THEN best ELSE id1 END END AS nxt
        FROM (SELECT *, m = best AND p1 IS DISTINCT FROM best AND (NOT strict OR pos = first) AS take,
                p1 = best AND p2 IS DISTINCT FROM best AND (NOT strict OR k0 & 4294967295 = first) AS gone FROM (
            SELECT g.*, b >> 33 AS best, (b >> 32) & 1 = 1 AS strict, b & 4294967295 AS first
            FROM (SELECT w, pos, id, m, round + 1 AS round,
                lag((w::BIGINT << 32) + pos) OVER () AS k0, lead((w::BIGINT << 32) + pos) OVER () AS k1, lead((w::BIGINT << 32) + pos, 2) OVER () AS k2,
                lag(m) OVER () AS p1, lag(m, 2) OVER () AS p2, lead(m) OVER () AS m1, lead(m, 2) OVER () AS m2, lead(id) OVER () AS id1, lead(id, 2) OVER () AS id2
            FROM step) g JOIN (SELECT w, min((m::BIGINT << 33) + (wary::BIGINT << 32) + pos) AS b FROM step WHERE m IS NOT NULL GROUP BY w) USING (w)
            WHERE CASE WHEN k0 >= (w::BIGINT << 32) + pos THEN error('rows lost their order') END IS NULL)) WHERE gone IS DISTINCT FROM true) q
    LEFT JOIN merges x ON x.pair = new * 1000000::BIGINT + nxt)
SELECT w, pos, id, round FROM step
"""
ENCODE_LONG = """
WITH RECURSIVE step(w, pos, id, m, wary) USING KEY (w, pos) AS (
    SELECT w, pos, id, merged, wary FROM parts LEFT JOIN merges ON pair = id * 1000000::BIGINT + nxt
    UNION ALL
    SELECT w, pos, new, merged, x.wary FROM (
        SELECT w, pos, CASE WHEN gone THEN -1 WHEN take THEN m ELSE id END AS new,
            CASE WHEN take THEN CASE WHEN take2 THEN best ELSE id2 END WHEN take1 THEN best ELSE id1 END AS nxt
        FROM (SELECT *, b >> 32 AS best, lag(take) OVER o AS gone, lead(take) OVER o AS take1, lead(take, 2) OVER o AS take2, lead(id) OVER o AS id1, lead(id, 2) OVER o AS id2 FROM (
            SELECT *, coalesce(m = b >> 32 AND lag(m) OVER o IS DISTINCT FROM (b >> 32) AND (NOT wary OR pos = (b & 4294967295)), false) AS take FROM (
                SELECT w, pos, id, m, wary, min((m::BIGINT << 32) + pos) OVER (PARTITION BY w) AS b FROM step WHERE id >= 0)
            WHERE b IS NOT NULL WINDOW o AS (PARTITION BY w ORDER BY pos)) WINDOW o AS (PARTITION BY w ORDER BY pos))) q
    LEFT JOIN merges x ON x.pair = new * 1000000::BIGINT + nxt)
SELECT w, pos, id, 0 AS round FROM step WHERE id >= 0 ORDER BY w, pos
"""


class Engine:
    """Vocabulary, merge table and the strings encoded so far."""

    def __init__(self, path: str, pattern: str, merged: int = MERGE, remembered: int = REMEMBER):
        import duckdb
        import regex

        self.merged, self.remembered = merged, remembered

        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        tokens = [base64.b64decode(a) for a, _ in pairs]
        ids = [int(b) for _, b in pairs]
        self.find = regex.compile(pattern).findall
        self.rank = dict(zip(tokens, ids))
        self.single = np.array([self.rank.get(bytes([b]), -1) for b in range(256)], dtype=np.int32)
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "250MB", "temp_directory": ""})
        self.con.execute("SET disabled_optimizers = 'join_order,build_side_probe_side'")  # joins keep the order of their left side
        self.con.register("given", pa.table({"id": pa.array(ids, pa.int32()), "h": [t.hex() for t in tokens]}))
        self.con.execute("CREATE TABLE vocab AS SELECT * FROM given")
        # every way to write a token as two tokens
        self.con.execute(
            "CREATE TABLE merges AS WITH cuts AS (SELECT id, h, unnest(range(2, length(h), 2)) AS k FROM vocab WHERE length(h) > 2), "
            "pair AS (SELECT a.id AS l, b.id AS r, c.id AS merged FROM cuts c JOIN vocab a ON a.h = c.h[1:c.k] JOIN vocab b ON b.h = c.h[c.k + 1:]) "
            "SELECT l * 1000000::BIGINT + r AS pair, merged, merged IN (SELECT l FROM pair WHERE merged < l UNION ALL SELECT r FROM pair WHERE merged < r) AS wary FROM pair"
        )
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.again = np.zeros(0, bool)

    def forget_rare(self) -> None:
        """Keeps the strings met again since they were learnt or last kept; none if they are most of what may be remembered."""
        kept = np.flatnonzero(self.again)
        if 4 * len(kept) > 3 * self.remembered:
            return self.forget()
        strings = [x for x, again in zip(self.known, self.again.tolist()) if again]  # a dict lists its strings by slot
        ids, sizes = self.gather(kept)
        self.forget()
        self.store(strings, ids, sizes)

    def slots(self, strings: list[str]) -> np.ndarray:
        """Place of each string in what is known, -1: not known."""
        known = self.known
        return np.fromiter((known.get(x, -1) for x in strings), np.int64, len(strings))

    def merge(self, words: list[bytes], query: str) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words, one after the other, and their numbers."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size)
        ids = self.single[np.frombuffer(b"".join(words), np.uint8)]
        if (ids < 0).any():
            raise ValueError("the vocabulary lacks a single byte")
        nxt = np.append(ids[1:], -1).astype(np.int32)
        nxt[end - 1] = -1
        w = np.repeat(np.arange(len(words), dtype=np.int32), size)
        pos = (np.arange(len(ids)) - np.repeat(end - size, size)).astype(np.int32)
        self.con.register("parts", pa.table({"w": w, "pos": pos, "id": ids, "nxt": nxt}))
        got = self.con.sql(query).to_arrow_table()
        self.con.unregister("parts")
        w, ids, rounds = (got.column(c).to_numpy() for c in ("w", "id", "round"))
        last = np.zeros(len(words), rounds.dtype)
        np.maximum.at(last, w, rounds)
        final = np.flatnonzero(rounds == last[w])
        final = final[np.argsort(w[final], kind="stable")]
        return ids[final], np.bincount(w[final], minlength=len(words))

    def store(self, strings: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.known.update(zip(strings, range(len(self.known), len(self.known) + len(strings))))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, ids.astype(np.int32)])
        self.again = np.concatenate([self.again, np.zeros(len(strings), bool)])

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.sizes[slots]
        end = np.cumsum(size)
        return self.flat[np.arange(int(size.sum())) + np.repeat(self.starts[slots] - (end - size), size)], size

    def learn(self, strings: list[str]) -> None:
        """Encodes distinct strings, none of them known, that end where a match of the pattern ends."""
        found = [self.find(x) for x in strings]
        fresh = [w for w in dict.fromkeys(w for x in found for w in x) if w not in self.known]
        raw = [w.encode() for w in fresh]
        rank = np.fromiter((self.rank.get(b, -1) for b in raw), np.int64, len(raw))
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        whole = np.flatnonzero(rank >= 0)
        self.store([fresh[i] for i in whole], rank[whole], np.ones(len(whole), np.int64))
        for query, some in ((ENCODE, np.flatnonzero((rank < 0) & (size <= LONG))), (ENCODE_LONG, np.flatnonzero((rank < 0) & (size > LONG)))):
            for a in self.chunks(size[some].tolist(), self.merged):
                self.store([fresh[i] for i in some[a]], *self.merge([raw[i] for i in some[a]], query))
        rest = [i for i, x in enumerate(strings) if x not in self.known]
        ids, sizes = self.gather(self.slots([w for i in rest for w in found[i]]))
        ends = np.cumsum([0, *(len(found[i]) for i in rest)])
        self.store([strings[i] for i in rest], ids, np.diff(np.concatenate([[0], np.cumsum(sizes)])[ends]))

    @staticmethod
    def chunks(sizes: list[int], most: int = PIECE) -> Iterator[slice]:
        a, total = 0, 0
        for b, n in enumerate(sizes):
            if total and total + n > most:
                yield slice(a, b)
                a, total = b, 0
            total += n
        if a < len(sizes):
            yield slice(a, len(sizes))

    def encode(self, texts: pa.Array) -> pa.Array:
        """A blank between two other characters starts a match, so a text is cut there, and each distinct piece is matched once.
        Texts with other blanks are matched whole."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, BLANKS).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        whole = pa.array([self.find(x) for x in texts.filter(pa.array(odd)).to_pylist()], pa.list_(pa.string()))
        counts = np.empty(len(odd), np.int64)
        counts[odd], counts[~odd] = whole.value_lengths().to_numpy(), cut.value_lengths().to_numpy()
        pieces = cut.flatten()
        first = np.zeros(len(pieces), bool)
        first[np.cumsum(counts[~odd]) - counts[~odd]] = True
        pieces = pc.if_else(pa.array(first), pieces, pc.binary_join_element_wise("", pieces, " "))
        strings = pa.concat_arrays([pieces, whole.flatten()])
        coded = strings.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        slots = self.slots(distinct)
        self.again[slots[slots >= 0]] = True
        if (slots < 0).any():
            if len(self.known) > self.remembered:
                self.forget_rare()
                slots = self.slots(distinct)
            self.learn([distinct[i] for i in np.flatnonzero(slots < 0)])
            slots = self.slots(distinct)
        slots = slots[coded.indices.to_numpy()]
        mask = np.repeat(odd, counts)
        ordered = np.empty(len(mask), np.int64)
        ordered[~mask], ordered[mask] = slots[: len(pieces)], slots[len(pieces) :]
        ids, n = self.gather(ordered)
        bounds = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])]
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))

    def decode(self, ids: pa.Array) -> pa.Array:
        """Null lists and ids outside the vocabulary decode to nothing."""
        size = pc.fill_null(ids.value_lengths(), 0).to_numpy().astype(np.int64)
        flat = ids.flatten()
        at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        self.con.register("ids", pa.table({"d": pa.array(np.repeat(np.arange(len(size)), size)), "pos": pa.array(at), "id": flat}))
        got = self.con.sql("SELECT d, unhex(string_agg(h, '' ORDER BY pos)) AS b FROM ids JOIN vocab USING (id) GROUP BY d").to_arrow_table()
        self.con.unregister("ids")
        place = np.full(len(size), -1, np.int64)
        place[got.column("d").to_numpy()] = np.arange(got.num_rows)
        found = got.column("b").combine_chunks().take(pa.array(place, mask=place < 0))
        return pc.fill_null(found.cast(pa.binary()), b"")


_ENGINES: dict[tuple, Engine] = {}


def engine(path: str, pattern: str, merged: int = MERGE, remembered: int = REMEMBER) -> Engine:
    key = path, pattern, merged, remembered
    if key not in _ENGINES:
        _ENGINES[key] = Engine(*key)
    return _ENGINES[key]


def _mapped(df: DataFrame, column: str, out: T.StructType, convert, piece: int = PIECE) -> DataFrame:
    """Adds the columns that ``convert`` makes of pieces of ``column`` as the last ones of ``out``."""

    def run(batches):
        from corpusloom.llm.bpe import Engine

        for batch in batches:
            col = batch.column(batch.schema.get_field_index(column))
            sizes = [x or 0 for x in (pc.utf8_length(col) if pa.types.is_string(col.type) else col.value_lengths()).to_pylist()]
            for a in Engine.chunks(sizes, piece):
                part = batch.slice(a.start, a.stop - a.start)
                yield pa.RecordBatch.from_arrays([*part.columns, *convert(part.column(part.schema.get_field_index(column)))], names=out.names)
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, out)


def _fresh(df: DataFrame, name: str) -> None:
    if name in df.columns:
        raise ValueError(f"the frame already has a column {name}")


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """All columns of ``df`` and the token ids of its texts (null or empty: no id), without special tokens.

    ``path`` is a rank file that every executor has. Rows are independent: repeated rows give equal ids, an
    empty frame stays empty. A clash of ``ids_col`` with a column is refused.
    """
    _fresh(df, ids_col)

    def convert(col):
        from corpusloom.llm.bpe import engine

        return [engine(path, pattern).encode(col)]

    return _mapped(df, text_col, T.StructType([*df.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]), convert)


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """All columns of ``df`` and the bytes that its ids stand for (null or no id: no bytes)."""
    _fresh(df, bytes_col)

    def convert(col):
        from corpusloom.llm.bpe import engine

        return [engine(path, pattern).decode(col)]

    return _mapped(df, ids_col, T.StructType([*df.schema.fields, T.StructField(bytes_col, T.BinaryType())]), convert)


def encode_and_decode(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", bytes_col: str = "decoded", bounds: tuple[int, int, int] = (PIECE, MERGE, REMEMBER)) -> DataFrame:
    """encode, then decode of its ids, in one pass: one Python worker per core instead of two. ``bounds`` (see PIECE) only
    trade memory for CPU; ``SMALL`` suits executors that hold much else."""
    _fresh(df, ids_col)
    _fresh(df, bytes_col)
    piece, *kept = bounds

    def convert(col):
        from corpusloom.llm.bpe import engine

        ids = engine(path, pattern, *kept).encode(col)
        return [ids, engine(path, pattern, *kept).decode(ids)]

    added = [T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(bytes_col, T.BinaryType())]
    return _mapped(df, text_col, T.StructType([*df.schema.fields, *added]), convert, piece)


def ids_sha256(ids_col: str = "ids"):
    return F.sha2(F.array_join(F.col(ids_col).cast("array<string>"), ","), 256)
