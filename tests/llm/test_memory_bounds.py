"""What a worker remembers is bounded, and forgetting changes no result."""

import public_tokenizers as p
import pyarrow as pa

from corpusloom.llm import bpe


def test_a_small_memory_keeps_what_comes_again_and_gives_the_same_ids():
    path = p.path("byte_bpe_multi_50k.tiktoken")
    word = lambda k: chr(97 + k // 26) + chr(97 + k % 26)
    texts = [pa.array([f"always zqxa{word(k)} zqxb{word(k)}, zqxc{word(k)}  zqxd{word(k)}" for k in range(a, a + 10)] + ["always zqxagain", None]) for a in range(0, 300, 10)]
    small, large = bpe.engine(path, p.PATTERN, 200, 60), bpe.engine(path, p.PATTERN)
    for part in texts:
        ids = small.encode(part)
        assert ids.equals(large.encode(part))
        assert small.decode(ids).to_pylist() == [(t or "").encode() for t in part.to_pylist()]
        assert len(small.known) <= 60 + 150 and len(small.again) == len(small.sizes) == len(small.known)
    assert len(large.known) > 900 and {"always", " zqxagain"} <= set(small.known)


def test_bounds_change_no_row(spark):
    path = p.path("byte_bpe_multi_50k.tiktoken")
    rows = [(k, None if k % 7 == 0 else f"word{k % 13} Zeile{k}\n\n  über {'x' * k} {k}") for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    both = [bpe.encode_and_decode(df, path, p.PATTERN, bounds=b).orderBy("doc_id").collect() for b in [(300, 100, 40), (bpe.PIECE, bpe.MERGE, bpe.REMEMBER)]]
    assert both[0] == both[1] and [bytes(r["decoded"]).decode() for r in both[0]] == [t or "" for _, t in rows]
