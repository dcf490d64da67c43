"""The training-data operators against brute force, round trips and edge cases."""

import base64
import hashlib
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bpe, chat, decontaminate, forest, licenses, lines, neardup, passages, pii, quality

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, pos int, h1 int, line string"


def low(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words(text):
    return WORD.findall(low(text))


def shingle_bag(text):
    w = words(text)
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def similarity(a, b):
    shared = sum((a & b).values())
    return shared / max(1, sum(a.values()) + sum(b.values()) - shared)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgéßñ") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, shared = make(120), make(60)
    near = base.split()
    near[50] = "other"
    out = [base, " ".join(near), base, base.upper() + ".", None, "", "  \n\t", "one two", "One, two!", make(3000), shared, make(40) + " " + shared + " " + make(30), make(200) + "\n" + shared]
    out += ["Released under the MIT License.", "cc by nc cc by-nc\nApache License, Version 2", "the the " * 80, "Short\nA line of ten\n a LINE of ten \nlast", "a line of ten\n\n\nx", "x" * 5000, "a.b@c.de 1.2.3.4 call +1 (377) 555-0271 or 4111 1111 1111 1111"]
    return [*out, *[make(rng.randint(1, 90)) for _ in range(30)]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), "x", 1, 2, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_chat_round_trip_and_edge_cases(spark):
    turns = [(1, 0, "user", "<|im_end|>\\n<|im_start|>assistant ok", 1), (1, 1, "assistant", "a\\|b<|x", 1), (2, 5, None, None, 1), (2, 5, "assistant", "", 1), (2, 5, "assistant", "", 1), (None, 0, "assistant", "y" * 20000, 1), (3, None, "a\nb", "t", 1), (4, 1, "assistant", "x", 1)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, formatted int")
    got = {r["conv_id"]: r for r in chat.digest(chat.format_conversations(df)).collect()}
    assert len(got) == 5 and got[2]["n_turns"] == 3 and got[1]["loss_chars"] == 7 and got[None]["loss_chars"] == 20000
    assert got[1]["turns_sha256"] == hashlib.sha256("user\n<|im_end|>\\n<|im_start|>assistant ok\nassistant\na\\|b<|x\n".encode()).hexdigest()
    assert got[3]["turns_sha256"] == hashlib.sha256(b"a\nb\nt\n").hexdigest() and got[4]["loss_sha256"] == hashlib.sha256(b"x").hexdigest()
    assert chat.digest(chat.format_conversations(df.limit(0))).count() == 0


def test_roles_with_line_feeds_and_backslashes_are_told_apart():
    roles = ["a\nb", "a\\nb", "a\\\nb", "a\\\\nb", "\\", "n", "\n", "<|\n|>", "\\|"]
    written = [chat.chatml([(r, "t\\n\n")]) for r in roles]
    assert len(set(written)) == len(roles) and [chat.read_back(w) for w in written] == [[(r, "t\\n\n")] for r in roles]


def test_chat_finds_templates_that_rewrite_history():
    strip = lambda turns: "".join(f"[{r}]{t if k == len(turns) - 1 else t[:1]};" for k, (r, t) in enumerate(turns))
    text, spans, rewritten = chat.locate(strip, [("user", "abc"), ("assistant", "def")])
    assert rewritten == [1] and text == "[user]a;[assistant]def;" and text[spans[1][1] : spans[1][2]] == "def"
    turns = [("user", "abc"), ("assistant", "def"), ("user", ""), ("assistant", "ghi")]
    text, spans, rewritten = chat.locate(strip, turns)
    assert rewritten == [1, 2] and [text[a:b] for _, a, b, _ in spans] == ["a", "d", "", "ghi"]
    last = lambda turns: "".join(f"[{r}]{t};" for r, t in turns[-2:])
    text, spans, rewritten = chat.locate(last, turns)
    assert [text[a:b] for _, a, b, _ in spans] == ["", "", "", "ghi"] and spans[0] == spans[1] == (0, 0, 0, 0) and spans[3][3] == len(text)
    text, spans, rewritten = chat.locate(chat.chatml, [("user", "xy"), ("assistant", "yx")])
    assert not rewritten and [text[a:b] for _, a, b, _ in spans] == ["xy", "yx"]


def test_decontamination_equals_brute_force(spark, docs, texts):
    items = [texts[10], texts[10].upper().replace(" ", ", "), "one two", None, "", "x " * 3, " ".join(texts[0].split()[10:60])]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, gram int")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.find_leaks(docs.union(docs.limit(3)), bench).collect()}
    want = {}
    for d, t in enumerate(texts):
        w = words(t)
        for i, item in enumerate(items):
            n = len(words(item))
            if n and w:
                bags = [Counter(tuple(w[s : s + n][j : j + min(5, n)]) for j in range(len(w[s : s + n]) - min(5, n) + 1)) for s in range(max(1, len(w) - n + 1))]
                best = max(similarity(b, shingle_bag(item)) for b in bags)
                if best >= 0.8:
                    want[d, i] = best
    assert got == pytest.approx(want) and len(want) > 6
    assert decontaminate.find_leaks(empty(spark), bench).count() == 0 and decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    left = decontaminate.drop_leaked(docs, bench)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_decontamination_finds_items_in_another_order(spark):
    rng = random.Random(9)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    a, b, c = fresh(32), fresh(32), fresh(20)
    held = [fresh(50) + b + a + fresh(50), b + a, fresh(3) + a + b, c + a + fresh(7) + b + c, fresh(9) + a + fresh(50)]
    items = [a + b, b + a + ["x"] * 3]
    docs, bench = (spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(x)], f"{name} long, text string") for name, x in (("doc_id", held), ("item_id", items)))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.find_leaks(docs, bench).collect()}
    want = {}
    for d, w in enumerate(held):
        for i, item in enumerate(items):
            n = len(item)
            best = max(similarity(shingle_bag(" ".join(w[s : s + n])), shingle_bag(" ".join(item))) for s in range(max(1, len(w) - n + 1)))
            if best >= 0.8:
                want[d, i] = best
    assert got == pytest.approx(want) and (0, 0) in want and (3, 0) not in want


def test_license_places_and_containment(spark, docs, texts):
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    assert len(got) == len(texts)
    for d, t in enumerate(texts):
        w = words(t)
        at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        r = got[d]
        assert (r["n_words"], r["n_base"]) == (len(w), len(at)) and 0 <= r["score"] <= 1
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    notice = " ".join(["word"] * 150) + " This Source Code Form is subject to the terms of the Mozilla Public License v 2.0"
    one = spark.createDataFrame([(None, notice, 1)], "doc_id long, text string, line int")
    assert licenses.scan_licenses(one).first()["labels"] == "mpl-2" and licenses.scan_licenses(one.limit(0)).count() == 0


def base_spans(text):
    """The patterns as they stand."""
    luhn = lambda s: sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(s))) % 10 == 0
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]


def test_pii_base_patterns_equal_plain_regular_expressions():
    rng = random.Random(2)
    alphabet = "ab1234567890.@+- ()_é4111@.."
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        assert sorted(pii.find(text)) == sorted(base_spans(text))


def test_pii_disguises_map_back_to_the_source(spark, docs):
    cases = {"write to john [at] mail (dot) example dot com now": "john [at] mail (dot) example dot com", "jоhn@exаmple.com": "jоhn@exаmple.com", "call plus one three seven seven five five five oh two seven one !": "plus one three seven seven five five five oh two seven one", "ｊ＠ｅ．ｃｏｍ": "ｊ＠ｅ．ｃｏｍ"}
    for text, span in cases.items():
        base, added = pii.scan(text)
        assert any(text[a:b] == span for _, a, b in base + added), (text, base, added)
    for clean in ("one two three at home", "we met at noon dot", "five at ten", "the cat at the door. Dot came"):
        assert pii.scan(clean) == ([], [])
    got = pii.find_pii(docs)
    assert got.count() == docs.count() and pii.find_pii(empty(docs.sparkSession)).count() == 0
    r = got.where("n_email = 1").first()
    assert (r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1)


def test_pii_disguises_by_kind():
    cases = [
        ("mail user[@]example[.]com now", "email", "user[@]example[.]com"),
        ("host 192[.]168[.]0[.]1 is up", "ip", "192[.]168[.]0[.]1"),
        ("ask jane at example.com, please", "email", "jane at example.com"),
        ("ask jane @ example.com.", "email", "jane @ example.com"),
        ("on 192 dot 168 dot 0 dot 1.", "ip", "192 dot 168 dot 0 dot 1"),
        ("on one nine two dot one six eight dot zero dot one, then", "ip", "one nine two dot one six eight dot zero dot one"),
        ("to jane dot doe@example.com", "email", "jane dot doe@example.com"),
        ("a (at) b (dot) org", "email", "a (at) b (dot) org"),
    ]
    for text, kind, span in cases:
        base, added = pii.scan(text)
        assert (kind, span) in [(k, text[a:b]) for k, a, b in added], (text, base, added)
    assert pii.scan("to jane dot doe@example.com")[0] == [("email", 12, 27)]
    for clean in ("look at example.com", "see us at example.com and", "Version 1 dot 2 dot 3", "at 5.30 and at 6", "one dot two dot three dot", "999 dot 1 dot 1 dot 1", "list [.] of (.) marks", "met @ noon."):
        assert pii.scan(clean) == ([], []), clean
    assert pii.scan("plain a@b.org and c@d.org") == ([("email", 6, 13), ("email", 18, 25)], [])


def test_pii_is_linear_in_long_runs():
    for unit in ("(", " ", "a", "dot ", " dot", "[ ", "1 dot ", "one ", "at ", "a@", "@ ", "a.", "plus "):
        for text in (unit * (200_000 // len(unit)), "(" + unit * (200_000 // len(unit)), "a at b." + unit * (200_000 // len(unit))):
            start = time.process_time()
            pii.scan(text)
            assert time.process_time() - start < 2, (unit, time.process_time() - start)


def test_near_duplicate_classes_equal_brute_force(spark, docs, texts):
    bags = [shingle_bag(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similarity(bags[i], bags[j]) >= 0.8 or bags[i] == bags[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    got = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in neardup.near_duplicates(docs.union(docs.limit(4))).collect()}
    assert got == {i: (r, root.count(r)) for i, r in enumerate(root)} and root[1] == 0 and root[5] == 4
    assert neardup.near_duplicates(empty(spark)).count() == 0
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root))


def test_signatures_estimate_weighted_jaccard_without_bias():
    import numpy as np

    h = np.arange(1, 61, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = np.arange(60) % 5 + 1, (np.arange(60) * 7) % 6 + 1
    sig = neardup.signatures(np.concatenate([h, h]), np.repeat([0, 1], 60), np.concatenate([a, b]), 2, 4096)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 4 * (want * (1 - want) / 4096) ** 0.5


def test_quality_ranks_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    fitted = labels.where("doc_id % 2 = 0")
    got = quality.classify(docs, fitted).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert sum(r["keep"] == (r["quality"] == 1) for r in got) / len(got) > 0.97
    assert quality.classify(docs.limit(0), labels).count() == 0 and quality.classify(docs, labels.limit(0)).where("not keep").count() == 0
    kept = quality.keep_good(docs, fitted)
    assert kept.columns == docs.columns


def test_quality_shrinks_sparse_groups(spark):
    rows = [(i, "good words here now" if i < 90 else "BAD!! $$$", "x", "h" if i < 95 else None) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i < 90)) for i in range(0, 100, 3)] + [(1, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == 100 and got[0]["keep"] and not got[99]["keep"] and got[99]["host_posterior"] < got[0]["host_posterior"]


def test_forest_exact_on_small_tables_and_edge_cases(spark):
    rng = random.Random(1)
    vecs = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(60)]
    vecs[7], vecs[8], vecs[9], vecs[10], vecs[11] = vecs[5], vecs[5], None, [0.0] * 8, [float("nan")] * 8
    vecs[12], vecs[13] = [1.0, None] * 4, [1.0, 2.0]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vecs)] + [(None, vecs[0], 1)], "vec_id long, embedding array<float>, rank int")
    got = forest.nearest(df, F.col("vec_id") % 5 == 0, k=3).collect()
    import struct

    f32 = lambda v: [struct.unpack("f", struct.pack("f", x))[0] for x in v]
    good = {i: f32(v) for i, v in enumerate(vecs) if i not in (9, 10, 11, 12, 13)}
    for q in good:
        if q % 5 == 0:
            want = sorted((sum((a - b) ** 2 for a, b in zip(v, good[q])) ** 0.5, i) for i, v in good.items() if i != q)[:3]
            mine = sorted((r["rank"], r["score"], r["vec_id"]) for r in got if r["query_id"] == q)
            assert [m[2] for m in mine] == [i for _, i in want] and [m[1] for m in mine] == pytest.approx([d for d, _ in want])
    assert forest.nearest(df.limit(0), F.lit(True)).count() == 0 and forest.nearest(df.where("vec_id = 1"), F.lit(True)).count() == 0


def test_forest_recall(spark):
    import numpy as np

    sf = "/root/testdata/sf0.1"
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = {(r["query_id"], r["vec_id"]) for r in forest.nearest(df, F.col("vec_id") % 100 == 0).collect()}
    rows = df.collect()
    x, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    want = set()
    for i in np.flatnonzero(ids % 100 == 0):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        want |= {(int(ids[i]), int(ids[j])) for j in np.lexsort((ids, d))[:10]}
    assert len(got & want) / len(want) >= 0.9


def test_line_dedup_equals_brute_force(spark, docs, texts):
    rows = list(enumerate(texts)) + [(2, texts[2])]
    strip = " \t\n\x0b\x0c\r"
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            key = low(line.strip(strip))
            if len(key) >= 10:
                holders.setdefault(key, set()).add(i)
    want = []
    for i, t in rows:
        whole = (t or "").split("\n")
        kept = [x for x in whole if len(h := holders.get(low(x.strip(strip)), {i})) < 2 or min(h) == i]
        want.append((i, "\n".join(kept), len(whole), len(whole) - len(kept)))
    got = [tuple(r) for r in lines.dedup_lines(docs.union(docs.where("doc_id = 2"))).collect()]
    assert sorted(got) == sorted(want) and any(w[3] for w in want)
    assert lines.dedup_lines(empty(spark)).count() == 0
    new = lines.replace_texts(docs)
    assert new.columns == docs.columns and {r["doc_id"]: r["text"] for r in new.collect()} == {w[0]: w[1] for w in want}
    unnamed = spark.createDataFrame([(None, "a line of ten"), (4, "A line of ten"), (None, None)], "doc_id long, text string")
    assert sorted(r["n_dropped"] for r in lines.dedup_lines(unnamed).collect()) == [0, 0, 1]


def test_byte_bpe_equals_tiktoken(spark, docs, texts):
    import public_tokenizers as p
    import tiktoken

    path = p.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    token = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    odd = ["".join(rng.choice("abcdeéñ世界 \n\t\r\x1c\x1f\x85 ​'sStTlre12٣½.,!<|>🙂ǅ\x00") for _ in range(60)) for _ in range(150)]
    odd += ["a" * 700, "ab" * 400, " " * 300, "<|endoftext|>", " x ", "".join(rng.choice("etaoinshr") for _ in range(600))]
    df = docs.select("doc_id", "text", "id").union(spark.createDataFrame([(1000 + i, t, "x") for i, t in enumerate(odd)], "doc_id long, text string, id string"))
    ids = bpe.encode(df, path, p.PATTERN)
    back = {r["doc_id"]: r for r in bpe.decode(ids, path, p.PATTERN).collect()}
    for i, t in [*enumerate(texts), *((1000 + i, t) for i, t in enumerate(odd))]:
        assert back[i]["ids"] == token.encode_ordinary(t or "") and bytes(back[i]["decoded"]) == (t or "").encode()
    once = bpe.encode_and_decode(df, path, p.PATTERN).collect()
    assert all(r["ids"] == back[r["doc_id"]]["ids"] and r["decoded"] == back[r["doc_id"]]["decoded"] for r in once)
    assert bpe.encode(empty(spark), path, p.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(df.withColumn("ids", F.lit(1)), path, p.PATTERN)


def test_compact_windows_cover_every_subsequence_once():
    import numpy as np

    rng = np.random.default_rng(4)
    for n, t in ((30, 5), (12, 12), (40, 1)):
        v = rng.integers(1, 12, n).astype(np.uint64)
        at = passages.minima(v, np.full(n, n), t)
        left, right = passages.compact_windows(v, at, np.zeros(len(at), int), np.zeros(1, int), np.full(1, n))
        found = list(zip(left, at, right))
        for i in range(n):
            for j in range(i + t - 1, n):
                over = [c for a, c, b in found if a <= i <= c <= j <= b]
                assert over == [i + int(np.argmin(v[i : j + 1]))]


def test_overlaid_windows_agree_with_every_subsequence():
    import numpy as np

    rng, t, hashes, enough = np.random.default_rng(5), 6, 4, 2
    count = np.array([30, 0, 3, 25, 6, 40])
    shingle = passages.mix(rng.integers(1, 25, int(count.sum())).astype(np.uint64))
    hit = np.unique(shingle)[::3]
    row, first, last, k, s, f = passages.overlaid(shingle, count, hit, t, hashes, enough)
    want = []
    for r, (a, n) in enumerate(zip(np.cumsum(count) - count, count)):
        starts, met = [], {}
        for i in range(a, a + n - t + 1):
            best = [(int(shingle[i + int(np.argmin(passages.values(shingle[i : i + t], g)))]), g) for g in range(hashes)]
            met[i] = {x for x in best if x[0] in set(hit.tolist())}
            if len(met[i]) >= enough:
                starts.append(i)
        runs = passages.runs(np.isin(np.arange(len(shingle)), starts), t)
        want += [(r, x, y, {m for i in range(x, y - t + 1) for m in met[i]}) for x, y in runs]
    assert [(r, a, b) for r, a, b in zip(row, first, last)] == [w[:3] for w in want] and len(want) > 3
    for i, w in enumerate(want):
        assert {(int(x), int(g)) for x, g in zip(s[k == i], f[k == i])} == w[3]


def test_passages_find_every_exact_run(spark, docs, texts):
    runs = {}
    for i, t in enumerate(texts):
        w = words(t)
        for k in range(len(w) - 49):
            runs.setdefault(tuple(w[k : k + 50]), set()).add(i)
    want = set().union(*(h for h in runs.values() if len(h) > 1))
    got = passages.repeated_passages(docs.union(docs.limit(2))).collect()
    assert want <= {r["doc_id"] for r in got} and {r["doc_id"] for r in got} <= want | {0, 1, 2, 3}
    for r in got:
        a, b = (" ".join(words(texts[i])[s : s + n]) for i, s, n in ((r["doc_id"], r["start_word"], r["n_words"]), (r["rep_id"], r["rep_start"], r["rep_words"])))
        assert r["similarity"] == pytest.approx(similarity(shingle_bag(a), shingle_bag(b))) and r["similarity"] >= 0.8 and r["n_words"] >= 50
    assert passages.repeated_passages(empty(spark)).count() == 0


def test_matches_cover_every_similar_window():
    import numpy as np

    rng, t = random.Random(8), 46
    hashed = lambda w: np.array([hash(tuple(w[i : i + 5])) & (2**63 - 1) for i in range(len(w) - 4)], np.uint64)
    cases = []
    for n in (54, 80, 160, 300):
        for rate in (0.01, 0.02, 0.03, 0.04):
            for vocabulary in (6, 10**6):
                one = [rng.randrange(vocabulary) for _ in range(n)]
                two = []
                for w in one:
                    kind = rng.choice("rid") if rng.random() < rate else ""
                    two += {"": [w], "r": [-rng.randrange(10**6)], "i": [w, -rng.randrange(10**6)], "d": []}[kind]
                cases.append((one, two if rng.random() < 0.7 else two[n // 2 :] + two[: n // 2]))
    eighty = list(range(80))
    cases.append((eighty, [-w if w in (30, 55) else w for w in eighty]))
    cases.append((list(range(50)), [-1, *range(1, 49), -2]))
    cases.append((list(range(50)), [*range(25), -1, -2, *range(25, 50)]))
    cases.append((list(range(600)), [-w if w % 36 == 35 else w for w in range(600)]))
    found = 0
    for one, two in cases:
        x, y = hashed(one), hashed(two)
        got = passages.matches(x, y, t, 0.8)
        for a, b, p, q, score in got:
            assert score == pytest.approx(similarity(Counter(x[a:b].tolist()), Counter(y[p:q].tolist()))) and score >= 0.8 and b - a >= t
        covered = {k for a, b, *_ in got for k in range(a, b)}
        bags = [Counter(y[j : j + t + more].tolist()) for more in (0, 2) for j in range(len(y) - t - more + 1)]
        for i in range(0, len(x) - t + 1, 3):
            bag = Counter(x[i : i + t].tolist())
            if any(similarity(bag, other) >= 0.8 for other in bags):
                found += 1
                inner = set(range(i, i + t))
                assert len(inner - covered) == 0 or any(x[k] not in y for k in inner - covered) and len(inner & covered) >= t - 10, (i, one, two)
    assert found > 200


def test_words_are_hashed_from_bytes_as_spark_does(spark):
    import numpy as np
    import pyarrow as pa

    from corpusloom.llm import packing, shingles

    odd = ["", None, " ", "a" * 31, "B" * 32, "b" * 33 + " " + "c" * 100 + "\u00e9" * 70, "\u00dcn\u00ef ABC def-ghi's 12345678 123456789 x\u65e5\u672c\u8a9e \x00y\x7fz \U0001f600 K", "x" * 64 + " " + "Y" * 63, "-", "end ", "\tq"]
    odd += [f"w{i} " * i for i in range(20)]
    rows = spark.createDataFrame(list(enumerate(odd)), "i long, text string").select("i", shingles.word_hashes(F.col("text")).alias("w"), F.xxhash64("i").alias("h")).orderBy("i").collect()
    got = []
    for _, _, h, size in packing.text_words(pa.array(odd, pa.string())):
        got += [w.view(np.int64).tolist() for w in np.split(h, np.cumsum(size)[:-1])]
    assert got == [r["w"] for r in rows]
    assert packing.hash_longs(np.arange(len(rows))).view(np.int64).tolist() == [r["h"] for r in rows]


def test_pairs_are_matched_at_once_as_one_by_one(monkeypatch):
    import numpy as np

    from corpusloom.llm import matching

    rng, t = random.Random(12), 46
    hashed = lambda w: [hash(tuple(w[i : i + 5])) & (2**63 - 1) for i in range(len(w) - 4)]
    base = [rng.randrange(10**6) for _ in range(400)]
    phrase = [rng.randrange(10**6) for _ in range(12)]
    parts = []
    for k in range(40):
        # texts changed every 20 to 60 words, with repeated phrases in every second, pass over no window
        w = [x if rng.random() > rng.choice((0.0, 0.02, 0.04)) else -rng.randrange(10**6) for x in base[rng.randrange(100) : rng.randrange(200, 400)]]
        parts.append(np.array(hashed(w + phrase * 8 + w[:70] if k % 2 else w), np.uint64))
    code, codes = matching.coded(np.concatenate(parts))
    assert len(np.unique(code)) == len(np.unique(np.concatenate(parts)))
    end = np.cumsum([len(p) for p in parts])
    x, y = (z.ravel() for z in np.meshgrid(np.arange(40), np.arange(40)))
    one = [(k, *m) for k, (i, j) in enumerate(zip(x, y)) for m in matching.matches(parts[i], parts[j], t, 0.8)]
    found = []
    for points in (matching.POINTS, 300):
        monkeypatch.setattr(matching, "POINTS", points)
        start = time.process_time()
        found.append(sorted(matching.Matcher(code, codes, end - np.diff(end, prepend=0), end, t, 0.8).run(x, y)))
        if points > 300:
            assert time.process_time() - start < 5  # 0.8 s; one by one, with a step per shingle, 8.8 s
    assert found[0] == found[1] == sorted(one) and len(one) > 1000
    for k, a, b, p, q, score in one[::17]:
        assert score == pytest.approx(similarity(Counter(parts[x[k]][a:b].tolist()), Counter(parts[y[k]][p:q].tolist()))) and score >= 0.8 and b - a >= t


def test_passages_at_the_edge_meet_in_enough_functions():
    from math import comb

    n, m = passages.HASHES, passages.ENOUGH
    assert sum(comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(m, n + 1)) > 0.989


def test_passages_list_every_member_of_a_family(spark):
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows, parts = [], {}
    for family in range(40):
        base = fresh(60)
        for member in range(8):
            mine = list(base)
            for k in rng.sample((10, 18, 26, 34, 42, 50), rng.randint(1, 2)):
                mine[k] = fresh(1)[0]
            # half of the members go straight on with a passage of another family
            more = rows[rng.randrange(len(rows))][1].split()[:60] if rows and member % 2 else []
            parts[len(rows)] = mine + more
            rows.append((len(rows), " ".join(mine + more + fresh(20))))
    bags = {i: [Counter(tuple(w[j : j + 5]) for j in range(a, a + 56)) for a in range(0, len(w), 60)] for i, w in parts.items()}
    want = {i for i in bags if any(similarity(x, y) >= 0.8 for j in bags if i != j for x in bags[i][:1] for y in bags[j])}
    got = {r["doc_id"] for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want) > 100 and not want - got


def test_pipeline_stages_keep_the_columns_of_documents(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    rows = docs.collect()
    assert rows and all(r["decodes"] for r in rows)
    assert corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{sf}/documents.parquet").limit(0), sf).count() == 0
