"""Spelling variants, token counts and conversation repair against plain computations and edge cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import neardup, repair, spelling, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def one_apart(a, b):
    """By trying every edit of the longer word."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, times=2):
    near = {w: [v for v in counts if one_apart(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts}


def as_dict(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_variants_equal_brute_force(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 8))) for _ in range(350)} | {"aaaaa", "aaaaaa", "aaaaaaa", "y" * 3000, "y" * 2999, "y" * 1500 + "z" + "y" * 1500, "🙂" * 5 + "a", "🙂" * 5}
    counts = {w: rng.choice([3, 3, 4, 7, 15, 40, 90]) for w in words}
    got = as_dict(spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == brute_variants(counts)
    assert any(r[1] != r[0] for r in got.values() if r[0])  # chains of more than one link


def test_variants_in_tiles_of_several_blocks(spark, monkeypatch):
    """All words of one bucket, cut into blocks: nothing is lost between two blocks."""
    monkeypatch.setattr(spelling, "BLOCK", 8)
    rng = random.Random(6)
    words = {"prefix" + "".join(rng.choice("ab") for _ in range(6)) for _ in range(60)}
    counts = {w: rng.randint(3, 60) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert spelling.tiles(df).where("i <> j").count() > 0
    assert as_dict(spelling.group_variants(df)) == brute_variants(counts)


def test_words_of_whole_texts(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcéA×ÿ") for _ in range(rng.randint(4, 7))) for _ in range(60)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 400))) for _ in range(40)] + [None, "", "  ", "12 _", "x" * 50000, "Ĳıß ĀĀĀĀĀ"]
    texts += texts[:2]
    docs = spark.createDataFrame([(i if i != 3 else None, t, "w", 1) for i, t in enumerate(texts)], "doc_id long, text string, word string, n int")
    want = Counter()
    for i, t in enumerate(texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i if i != 3 else ''}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
    assert {r["word"]: r["n"] for r in spelling.word_counts(docs).collect()} == want
    assert spelling.word_counts(docs.limit(0)).count() == 0 and spelling.group_variants(spelling.word_counts(docs.limit(0))).count() == 0


def test_counts_equal_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(1)
    texts = ["".join(rng.choice(a) for _ in range(rng.randint(0, 60))) for a in ("  ▁ab<s>/\n\té①梦\x00　🙂ﬁthe", "thein agoro  ") for _ in range(300)]
    texts += ["<s> </s> <unk> <0x0A> <|endoftext|>", " ", "   ", "", "ab" * 40000, "の" * 5000, "🙂" * 2000, "a " * 3000, " " * 5000, "x\n" * 2500]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, None, 2), (0, texts[0], 1)], "doc_id long, text string, id int")
    got = token_counts.count_tokens(docs, MODEL).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = "" if r["doc_id"] is None else texts[r["doc_id"]]
        n = len(model.encode(text))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 4096), text[:50]
    assert token_counts.count_tokens(docs.limit(0), MODEL).count() == 0


def test_long_texts_are_counted_in_parts(monkeypatch):
    known = token_counts.Pieces(MODEL)
    rng = random.Random(2)
    text = "".join(rng.choice("theagoin   \n①") for _ in range(5000))
    whole = known.count(text)
    for size in (1, 7, 100):
        monkeypatch.setattr(token_counts, "PIECE", size)
        assert known.count(text) == whole


def brute_repair(rows, insert):
    """Every string of edits that is not already too dear."""
    best = None

    def go(i, roles, cost, audit, inserted):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
            best = (cost, audit)
        if inserted < 4:
            for r in "ua":
                go(i, roles + r, cost + insert, audit + "I", inserted + 1)
        if i < len(rows):
            initial, fault = rows[i]
            go(i + 1, roles, cost + 2, audit + "D", inserted)
            if fault not in "bd":
                more = 5 if fault == "t" else 0
                go(i + 1, roles + (initial or "?"), cost + more, audit + "K", inserted)
                for r in "ua":
                    go(i + 1, roles + r, cost + 1 + more, audit + "R", inserted)

    go(0, "", 0, "", 0)
    return best


@pytest.mark.parametrize("insert", [5, 1])
def test_search_equals_brute_force(monkeypatch, insert):
    """With dear insertions, and with cheap ones, which are then part of the answer."""
    monkeypatch.setattr(repair, "INSERT", insert)
    rng = random.Random(3)
    audits = set()
    for _ in range(400):
        rows = [(rng.choice(["s", "u", "a", "u", "a", "t", ""]), rng.choice("....tbd")) for _ in range(rng.randint(0, 4))]
        assert repair.cheapest(rows) == brute_repair(rows, insert), rows
        audits.add(repair.cheapest(rows)[1])
    assert any("I" in a for a in audits) == (insert == 1)


def test_search_is_linear_in_long_conversations():
    rng = random.Random(4)
    rows = [(rng.choice("suaua"), rng.choice("......tbd")) for _ in range(30000)]
    cost, audit = repair.cheapest(rows)
    assert len(audit) == 30000 and cost < 60000
    kept = "".join({"K": i, "R": "?", "D": ""}[e] for (i, _), e in zip(rows, audit))
    state = "s" if kept[0] == "s" else ""
    assert all(c in ("?", "ua"[k % 2]) for k, c in enumerate(kept[len(state) :])) and len(kept[len(state) :]) % 2 == 0


def plain_repair(rows):
    """What repair returns for one conversation's (turn, role, text), computed directly."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, codes = set(), []
    for _, role, text in rows:
        said = text.strip(" \t\n\x0b\x0c\r")
        codes.append((role[:1], "b" if not said else "d" if (role, text) in seen else "." if said[-1] in ".!?" else "t"))
        seen.add((role, text))
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(codes))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit = brute_repair(codes, 5)
    out, i = [], 0
    start = 1 if audit.lstrip("D")[:1] == "K" and codes[len(audit) - len(audit.lstrip("D"))][0] == "s" else 0
    for e in audit:
        who = ("user", "assistant")[(len(out) - start) % 2]
        if e != "D":
            out.append(f"{rows[i][1] if e == 'K' else who}:{rows[i][2] if e != 'I' else ''}")
        i += e != "I"
    digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return (gaps, *(sum(f == x for _, f in codes) for x in "bdt"), illegal, cost, audit, digest)


def test_repair_of_whole_conversations(spark):
    rng = random.Random(5)
    roles, said = ["system", "user", "assistant", "user", "assistant", "tool", "", "ulysses"], ["Hi.", "Yes!", "so", "", " \t\n", "why? ", "a:b\nc."]
    rows = [(c if c else None, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(said)) for c in range(60) for _ in range(rng.randint(1, 6))]
    df = spark.createDataFrame(rows, "conv long, turn long, role string, text string")
    convs = spark.createDataFrame([(c,) for c in {r[0] for r in rows} | {999}], "conv long")
    got = {r["conv"]: tuple(r)[1:] for r in repair.repair(df, convs).collect()}
    for c in got:
        assert got[c] == plain_repair([r[1:] for r in rows if r[0] == c]), c
    assert got[999] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_damage_and_edge_cases(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"a.b!{c}?") for c in range(8) for t in range(5)] + [(None, None, None, None), (3, None, None, "x."), (7, 2, "user", None)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, ahead int, conv string")
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [(c, t, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    assert Counter(tuple(r) for r in repair.damaged(df).collect()) == Counter(want)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair_damaged(df).collect()}
    assert set(got) == {r[0] for r in rows}
    for c in got:
        assert got[c] == plain_repair([r[1:] for r in want if r[0] == c])
    assert repair.repair_damaged(df.limit(0)).count() == 0


def test_a_long_conversation_of_copies(spark):
    """One conversation holds nearly all rows, most of them the same."""
    long = spark.range(6000).select(F.lit(1).cast("long").alias("conv"), (F.col("id") % 3000).alias("turn"), F.lit("user").alias("role"), F.when(F.col("id") % 10 == 0, F.concat(F.lit("n"), F.col("id"), F.lit("."))).otherwise("again.").alias("text"))
    r = repair.repair(long, long.select("conv").distinct()).first()
    assert (r["gaps"], r["blank"], r["truncated"], r["duplicate"]) == (0, 0, 0, 5399) and len(r["audit"]) == 6000 and r["cost"] >= 2 * 5399


def test_a_large_group_of_near_copies_is_compared_in_proportion(spark, monkeypatch):
    """Variants of one text, many below 0.8 of each other: classes as by brute force, and a pair row per member and round."""
    import test_llm as plain

    from corpusloom.llm import neardup

    rng = random.Random(12)
    base = [f"w{k}" for k in range(120)]

    def variant():
        words = list(base)
        for at in rng.sample(range(120), rng.choice([1, 2, 3, 4, 5])):
            words[at] = f"x{rng.randrange(10**6)}"
        return " ".join(words)

    texts = [variant() for _ in range(260)] + [variant()] * 3 + [" ".join(rng.sample(base, 60)) for _ in range(5)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, gone string")
    bags = [plain.shingle_bag(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and plain.similarity(bags[i], bags[j]) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    compared = []
    real = neardup.verified

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(neardup, "verified", counted)
    monkeypatch.setattr(neardup, "BLOCK", 50)
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    assert got == dict(enumerate(root)) and sum(compared) < 20 * len(texts) < len(texts) ** 2 / 6
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root))


def test_last_near_duplicate_step_gives_links_not_the_pairs_of_a_bucket(spark, monkeypatch):
    # one bucket, three classes of mutually similar texts and one text of its own: joining them takes few links
    rng = random.Random(4)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for _ in range(150):
        words = list(base)
        words[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts.append(" ".join(base[:100]))
    rows = [(7, i, i % 3 if i < 150 else 150, 0) for i in range(151)]
    open_ = neardup.cut(spark.createDataFrame(rows, "key long, id long, root long, main long"))
    hashed = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", neardup.word_hashes(F.col("text")).alias("words"))
    monkeypatch.setattr(neardup, "BLOCK", 50)
    got = [(r["a"], r["b"]) for r in neardup._linked(open_, neardup.cut(hashed), 0.8).collect()]
    linked = {frozenset((a % 3, b % 3)) for a, b in got}
    assert len(linked) >= 2 and all(len(x) == 2 for x in linked) and all(max(p) < 150 for p in got)
    assert len(got) <= 2 * 10  # two a tile at most, four blocks make ten tiles


def test_filter_passes_all_that_is_wanted_and_little_else(spark):
    rows = spark.range(-5000, 5000)
    wanted = rows.where("id % 100 = 0")
    got = {r["id"] for r in neardup.among(rows, "id", wanted).collect()}
    assert {r["id"] for r in wanted.collect()} <= got and len(got) < 150
    assert neardup.among(rows, "id", wanted.limit(0)).count() == 0
