"""Edge cases, brute-force versions and round trips of the training-data operators on small tables."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tomeweave.llm import automaton, bpe, components, divergence, language, minhash, mixing, near_dup, ngram_join, passages, quality, rangecoder, runs, secrets, tokenfiles, topk, urls
from tomeweave.llm.common import shared_path

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
WORDS = [f"w{i}" for i in range(300)]


def text_of(seed, n=120):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = text_of(1).split()
    near = base.copy()
    near[60] = "changed"
    rows = [
        (1, text_of(1), "en", "a", 1), (2, " ".join(near), "en", "a", 1), (3, text_of(1), "en", "b", 1), (4, None, None, None, None), (5, "", "en", "", 0), (6, "one two", "en", "a", 1),
        (7, "one two", "en", "a", 1), (8, LONG, "en", "c", 1), (9, text_of(9), "fr", None, 1), (9, text_of(9), "fr", None, 1), (None, text_of(10), "de", "b", 1), (11, " \t\n", "en", "b", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df, *names):
    return df.withColumns({n: F.lit("own") for n in names})


# Quality ------------------------------------------------------------------------------------------


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(covered))


def test_quality_measures_match_brute_force():
    r = random.Random(0)
    for _ in range(300):
        text = "".join(r.choice(["a", "b", "é", " ", "\n", "\x0b", "\x1c", "#", "<", "a b c ", "中"]) for _ in range(r.randint(0, 60)))
        assert quality.measure_text(text) == brute_measures(text)
    assert quality.measure_text(None) == (0, 0, 0, 0, 0, 0)


def test_quality_ledger(docs, empty):
    rows, at = quality.ledger(clashing(docs, "ledger"))
    assert at != "ledger" and {r["ledger"] for r in rows.collect()} == {"own"}
    kept = [r["doc_id"] for r in quality.apply_policy(docs).collect()]
    assert sorted(x or 0 for x in kept) == [0, 1, 2, 3, 8, 9, 9]
    assert quality.apply_policy(docs).columns == docs.columns and quality.apply_policy(empty).count() == 0
    bits = rows.select(F.col(at)["failed"].alias("failed"))
    found = {r["rule"]: (r["n_failed"], r["n_only"]) for r in quality.ablation(bits).collect()}
    masks, mask = [r["failed"] for r in bits.collect()], quality.POLICIES[quality.DEFAULT_POLICY]
    for rule in quality.RULES:
        assert found[rule.name] == (sum(bool(m & rule.bit) for m in masks), sum(m & mask == rule.bit for m in masks))


# Secrets ------------------------------------------------------------------------------------------

BASE = {
    "assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), 20),
    "hex": (re.compile("[0-9a-f]+"), 24),
}


def brute_spans(text):
    found = [(m.start(), n, kind, m.end()) for n, (kind, (p, least)) in enumerate(BASE.items()) for m in p.finditer(text) if len(m[2] if kind == "assign" else m[0]) >= least]
    return [(kind, s, e) for s, _, kind, e in sorted(found)]


def test_secrets_match_the_regexes():
    r = random.Random(1)
    parts = ["token", "SECRET", "api_key", "ApiKey", "passwd", "=", ":", " ", '"', "'", "AKIA", "AKIAABCDEFGH", "0123456789abcdef", "deadbeef", "é", "XYZ0", "\n", "-", "x", "a"]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert [s for s in secrets.scan(text) if s[0] in BASE] == brute_spans(text)
    assert secrets.scan(None) == secrets.scan("") == []
    assert [k for k, _, _ in secrets.scan("ghp_" + "a1B2" * 9)] == ["github"]


def test_secret_frames(spark, empty):
    rows = spark.createDataFrame([(1, "x token = abcdef123 y", "s"), (2, None, "s"), (2, None, "s"), (3, "a" * 100_000, "s")], "doc_id long, text string, secrets string")
    found, at = secrets.find_secrets(rows)
    assert at != "secrets" and [len(r[at]) for r in found.orderBy("doc_id").collect()] == [1, 0, 0, 1]
    masked = {r["doc_id"]: r["text"] for r in secrets.mask_secrets(rows).collect()}
    assert masked == {1: "x [SECRET] y", 2: None, 3: "[SECRET]"}
    assert secrets.mask_secrets(empty).count() == 0


def test_automaton_is_minimal_and_right():
    rule = automaton.parse("(ab|a)*c{2,3}")
    machine = automaton.compile_rules([rule], anywhere=False)
    for n in range(3000):
        text = "".join(random.Random(n).choice("abc") for _ in range(n % 8))
        state = 0
        for c in text.encode():
            state = machine.table[state][c]
        assert bool(machine.accepts[state]) == bool(re.fullmatch("(ab|a)*c{2,3}", text))
    assert len(machine.table) <= 8


# BPE ----------------------------------------------------------------------------------------------


def library(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_bpe_equals_the_library():
    with open(PATH, encoding="utf-8") as file:
        own, lib = bpe.codec(file.read()), Tokenizer.from_file(PATH)
    r = random.Random(2)
    parts = ["a", "the", "'s", "'RE", "é", "é", "İ", "ß", "Σ", " ", "\n", "中文", "<|endoftext|>", "<|end", "123", "²", "!!", "😀", "‍", "th" * 20, "\x1c", "\x85", "ﬁ", "가"]
    for _ in range(1500):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        ids = lib.encode(text, add_special_tokens=False).ids
        assert list(bpe.unpack(own.encode(text))) == ids
        assert own.decode(own.encode(text)) == lib.decode(ids, skip_special_tokens=False)
    long = "a" * 5000 + "the" * 5000
    assert list(bpe.unpack(own.encode(long))) == lib.encode(long, add_special_tokens=False).ids


def test_bpe_in_batches_with_blanks_of_all_kinds():
    """Pieces are new to a task together, so their words must not get mixed up; the order of a set varies with the seed of its hashes, here with the order of the texts."""
    with open(PATH, encoding="utf-8") as file:
        spec, lib = file.read(), Tokenizer.from_file(PATH)
    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    r = random.Random(12)
    letters = ["10", "km", "é", "ß", "中", "a", "'s", "²", "naïve", "!", "\u0301", "<|endoftext|>"]
    for seed in range(40):
        own, texts = bpe.Codec(spec), []
        for _ in range(60):
            pieces = ["".join(r.choice(letters + blanks) for _ in range(r.randint(1, 4))) for _ in range(5)]
            texts.append(r.choice([" ", "\n"]).join([*pieces, f"10{blanks[seed % len(blanks)]}km", blanks[r.randrange(len(blanks))]]))
        r.shuffle(texts)
        assert [list(bpe.unpack(x)) for x in own.encode_all(texts)] == [x.ids for x in lib.encode_batch(texts, add_special_tokens=False)]


def test_bpe_frames(docs, empty):
    rows, ids, decoded = bpe.round_trip(clashing(docs, "ids", "decoded"), PATH)
    lib = Tokenizer.from_file(PATH)
    for r in rows.collect():
        want = lib.encode(r["text"] or "", add_special_tokens=False).ids
        assert list(bpe.unpack(bytes(r[ids]))) == want and r[decoded] == lib.decode(want, skip_special_tokens=False) and r["ids"] == "own"
    encoded, ids = bpe.encode(docs, PATH)
    again, text = bpe.decode(encoded, PATH, ids)
    assert again.filter(F.col(text).isNull()).count() == 0 and bpe.encode(empty, PATH)[0].count() == 0


# Near-duplicates ----------------------------------------------------------------------------------


def brute_components(rows):
    sets = {}
    for k, (_, text) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    forest = components.Forest()
    for a in sets:
        forest.find(a)
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                forest.join(a, b)
    least = {}
    for k in sets:
        least.setdefault(forest.find(k), []).append(rows[k][0])
    out = []
    for k in sets:
        ids = [x for x in least[forest.find(k)] if x is not None]
        c = rows[k][0] if not sets[k] else min(ids) if ids else None
        out.append((rows[k][0], len(sets[k]), c, rows[k][0] == c))
    return Counter(out)


def test_near_duplicates_match_brute_force(spark, docs, empty):
    r = random.Random(3)
    rows = [(d["doc_id"], d["text"]) for d in docs.collect()]
    for group in range(6):
        base = text_of(100 + group, 150).split()
        for k in range(8):
            copy = base.copy()
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(150)] = f"edit{r.random()}"
            rows.append((1000 + group * 10 + k, " ".join(copy).title() if k == 3 else " ".join(copy)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("own")).repartition(4)
    found = Counter((x["doc_id"], x["n_shingles"], x["component_id"], x["kept"]) for x in near_dup.near_duplicates(frame).collect())
    assert found == brute_components(rows)
    assert near_dup.near_duplicates(empty).count() == 0


def test_large_clusters_are_finished_by_tiles(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_CLASSES", 5)
    r, base, rows = random.Random(4), text_of(7, 150).split(), []
    for k in range(40):
        copy = base.copy()
        for _ in range(r.randint(0, 5)):
            copy[r.randrange(150)] = f"edit{r.random()}"
        rows.append((k, " ".join(copy)))
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((x["doc_id"], x["n_shingles"], x["component_id"], x["kept"]) for x in found.collect()) == brute_components(rows)


def test_keep_one(docs, empty):
    left = near_dup.keep_one(docs)
    assert left.columns == docs.columns
    assert sorted(x["doc_id"] or 0 for x in left.collect()) == [0, 1, 4, 5, 6, 8, 9, 11]
    assert near_dup.keep_one(empty).count() == 0


def test_keep_one_tells_rows_of_one_id_apart(spark):
    def near(seed):
        words = text_of(seed).split()
        words[60] = "changed"
        return " ".join(words)

    copies = [(1, text_of(1)), (None, near(1)), (2, text_of(2)), (3, near(2)), (3, text_of(4))]  # copies under a null or repeated id
    ties = [(None, text_of(5)), (None, near(5)), (7, text_of(6)), (7, near(6)), (8, text_of(8)), (8, text_of(8))]
    own = [(None, text_of(3)), (None, None), (None, None), (3, "")]
    left = [(d["doc_id"], d["text"]) for d in near_dup.keep_one(spark.createDataFrame(copies + ties + own, "doc_id long, text string")).collect()]
    assert Counter(left) >= Counter(own + [(1, text_of(1)), (2, text_of(2)), (3, text_of(4)), (8, text_of(8))])
    assert sum(x in ties[:2] for x in left) == sum(x in ties[2:4] for x in left) == 1
    assert len(left) == 10


def test_superminhash_estimates_jaccard():
    a, b = np.arange(1, 2001, dtype=np.uint64), np.arange(301, 2301, dtype=np.uint64)
    mix = lambda x: minhash._mixed(x)
    found = np.mean([(minhash.signature(mix(a + np.uint64(s))) == minhash.signature(mix(b + np.uint64(s)))).mean() for s in range(0, 200_000, 10_000)])
    assert abs(found - 1700 / 2300) < 0.03
    assert (minhash.signature(np.empty(0, np.uint64)) == np.uint64(2**64 - 1)).all()


def test_components_equal_a_plain_forest(spark):
    r = random.Random(5)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(150)]
    forest = components.Forest()
    for a, b in links:
        forest.join(a, b)
    found = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: forest.find(x) for a, b in links if a != b for x in (a, b)}


# Token files --------------------------------------------------------------------------------------


def test_range_coder_round_trips():
    r = np.random.default_rng(0)
    for ids in (np.array([]), np.array([0]), np.array([2**32 - 1, 0, 5]), r.integers(0, 2**32, 5000), r.zipf(1.3, 9000) % 49408, np.tile(r.integers(0, 40000, 37), 300)):
        ids = ids.astype("<u4")
        assert (rangecoder.expand(rangecoder.compress(ids, 512)) == ids).all()
    data = bytearray(rangecoder.compress(np.arange(5000, dtype="<u4")))
    data[-40] ^= 1
    with pytest.raises(ValueError):
        rangecoder.expand(bytes(data))
    assert len(rangecoder.compress(np.tile(np.arange(50), 400).astype("<u4"))) < 4000


def test_token_files(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(tokenfiles, "SEGMENT_IDS", 300)
    for frame in (clashing(docs, "ids", "start"), empty):
        path = shared_path(spark, "test-ids")
        tokenfiles.write(frame, path, PATH)
        got = [(r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(bytes(r["ids"]))) for r in tokenfiles.read(spark, path).orderBy("start").collect()]
        rows, at, want = sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=lambda r: (r[0] is not None, r[0] or 0)), 0, []
        for d, text in rows:
            ids = np.array([*library(text), 2], "<u4")
            want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        assert got == want


def test_library_is_asked_for_new_words_only():
    with open(PATH, encoding="utf-8") as file:
        own = tokenfiles.LibraryEncoder(file.read())
    asked, ask = [], own._asked
    own._asked = lambda texts: asked.append(texts) or ask(texts)
    odd = ["İstanbul ŉ ſo ÀÉ×÷ª²", "e\u0301 \u0301x o\u0302\u0301, a\u00a0b\x1cc \u2028 d", "it's IT'S ''s 'll_x 12a3", "<|endoftext|> x<|startoftext|>y <|end of|>", "好的ß ΣΑΣ fi\ufb01", "w" * 3000, "\x0b\x0c", "🙂a", "a\0b"]
    texts = ["Word, word. WORD! word", None, "", " \n", *odd, " ".join(odd)]
    for _ in range(2):
        ids, counts = own.encode_all(pa.array(texts).slice(1))
        assert counts.tolist() == [len(library(x)) for x in texts[1:]] and ids.tolist() == [k for x in texts[1:] for k in library(x)]
    del asked[:]
    assert own.encode_all(pa.array(texts[:1]))[0].tolist() == library(texts[0])
    assert own.encode_all(pa.array(["word (word) Word,word"]))[0].tolist() == library("word (word) Word,word")
    assert sorted(x for part in asked for x in part) == ["!", "(", ")", ",", ".", "word"]


def test_plain_words_are_parted_as_the_library_parts_them():
    with open(PATH, encoding="utf-8") as file:
        own, lib = tokenfiles.LibraryEncoder(file.read()), Tokenizer.from_file(PATH)
    r = np.random.default_rng(5)
    some = [*"strvemldSTRVEMLDaxé90.,-  \n\t", "'ll", "'RE", "'v", "Ÿ", "ſ", "×"]
    texts = ["".join(r.choice(some, r.integers(0, 30))) for _ in range(2000)]
    odd = [x + str(r.choice(["\u0301", "İ", "\u00a0", "<|endoftext|>", "\0", "好", "'"])) + y for x, y in zip(texts, texts[1:], strict=False)]
    for given in (texts, odd, [*texts, *odd]):
        ids, counts = own.encode_all(pa.array(given))
        want = [lib.encode(x, add_special_tokens=False).ids for x in given]
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [k for x in want for k in x]


def test_plain_words_need_the_model_alone():
    with open(PATH, encoding="utf-8") as file:
        own = tokenfiles.LibraryEncoder(file.read())
    own.library = None  # its normaliser and splitter would run over all words again
    text = "It's PLAIN, isn't it? Été 2024"
    assert own.encode_all(pa.array([text]))[0].tolist() == library(text)


# Passages -----------------------------------------------------------------------------------------


def brute_repeats(rows):
    """Per row (id, removed spans), by strings: lines and sentences of eight words or more, short ones with what follows."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        body, own, gone = text or "", [], set()
        for gap in (r"\n", r"\n|(?<=[.!?])\s"):
            starts = [0, *(m.end() for m in re.finditer(gap, body))]
            pieces = [(s, body[s:e]) for s, e in zip(starts, [*starts[1:], len(body)], strict=True) if body[s:e].strip()]
            for i in range(len(pieces)):
                taken = next((k for k in range(i + 1, len(pieces) + 1) if len(" ".join(x for _, x in pieces[i:k]).split()) >= 8), None)
                if taken is None and i:
                    continue
                part = pieces[i:taken]
                start, (last, tail) = part[0][0] + len(part[0][1]) - len(part[0][1].lstrip()), part[-1]
                own.append((start, last + len(tail.rstrip()), " ".join(" ".join(x for _, x in part).lower().split())))
        for start, end, unit in own:
            if unit in seen or any(u == unit and s < start for s, _, u in own):
                gone |= set(range(start, end))
        seen |= {u for _, _, u in own}
        marks = "".join("x" if k in gone else "b" if body[k].isspace() else "." for k in range(len(body)))
        out.append((doc_id, tuple((m.start(), m.end()) for m in re.finditer(r"x(?:[xb]*x)?", marks))))
    return Counter(out)


def test_repeats_match_brute_force(spark):
    r = random.Random(41)
    sentences = [" ".join(r.choice(WORDS) for _ in range(r.randint(1, 14))) + r.choice([".", "!", "", "? "]) for _ in range(40)]
    rows = [(k, "".join(r.choice(sentences).capitalize() + r.choice([" ", "\n", " \n\n", "  "]) for _ in range(r.randint(0, 9)))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, " \n"), (103, "five words and no more"), (104, "Five  words\nand no more"), (105, "ten words " * 5), (106, "ten words " * 5), (None, rows[7][1])]
    for part in (rows, rows[:9]):
        frame = spark.createDataFrame(part, "doc_id long, text string").repartition(3)
        got, kept, removed = passages.drop_repeats(frame)
        found = got.collect()
        assert Counter((x["doc_id"], tuple((s["start"], s["end"]) for s in x[removed])) for x in found) == brute_repeats(part)
        for x in found:
            gone = {k for s in x[removed] for k in range(s["start"], s["end"])}
            assert x[kept] == (None if x["text"] is None else "".join(c for k, c in enumerate(x["text"]) if k not in gone))


def test_repeats_in_frames(spark, docs, empty):
    shared = "This passage of some words stands in several documents. It has a second sentence of its own. And. A third one to end it with."
    rows = [(3, f"Begin here with other words than before. {shared}"), (1, f"{shared}\nEnd of the first of them all, with more words."), (2, f"Hello there my friend and all of the others,\n{shared}"), (4, None), (5, ""), (None, shared)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"kept_text": F.lit("own"), "gone": F.lit(1)})
    got, kept, _ = passages.drop_repeats(frame)
    assert kept != "kept_text"
    found = {r["doc_id"]: r for r in got.collect()}
    assert found[1][kept] == rows[1][1] and found[2][kept].strip() == "Hello there my friend and all of the others," and found[None][kept] == ""
    assert passages.drop_repeats(empty)[0].count() == 0 and passages.drop_repeats(docs)[0].count() == docs.count()


def test_rows_of_one_id_are_told_apart(spark):
    passage = " ".join(f"w{k}" for k in range(30)) + "."
    rows = [(7, passage), (7, passage), (None, "Own words stand before it, nine of them here. " + passage), (None, passage), (None, passage), (3, "of " + passage), (8, "Short line."), (9, "Short line.")]
    got, kept, removed = passages.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    whole = [(r["doc_id"], r[kept]) for r in got.collect() if passage in (r[kept] or "")]
    assert sorted(whole, key=str) == sorted([(3, "of " + passage), (7, passage)], key=str) and got.count() == len(rows)
    assert {r["doc_id"]: r[kept] for r in got.collect() if r["doc_id"] in (8, 9)} == {8: "Short line.", 9: ""}
    texts = spark.createDataFrame([("b", passage), ("a", passage)], "doc_id string, text string")
    assert {r["doc_id"]: r[kept] for r in passages.drop_repeats(texts)[0].collect()} == {"a": passage, "b": ""}


# Mixing -------------------------------------------------------------------------------------------


def brute_targets(sizes):
    weights = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes, key=lambda x: (x is None, x or "")))}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        open_ = [s for s in sizes if s not in full]
        level = {s: rest * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if level[s] >= 3 * sizes[s]}
        if not over:
            return {**{s: 3 * sizes[s] for s in full}, **level}
        full |= over


def test_mix(spark, docs, empty):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()] + [(100 + k, text_of(k, 20 + k), ["a", "c", None, "d"][k % 4]) for k in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit("own"), "taken": F.lit("own")})
    m = mixing.mix(frame)
    got = m.rows.collect()
    assert len(got) == len(rows) and m.size != "size"
    sizes, taken = Counter(), Counter()
    for r in got:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        assert r[m.size] == n and r[m.taken] <= 3 * n
        sizes[r["source"]] += n
        taken[r["source"]] += r[m.taken]
    for s, target in brute_targets(sizes).items():
        assert abs(taken[s] - target) < 1 and abs(next(r for r in got if r["source"] == s)[m.target] - target) < 1e-6
    key = lambda r: (r["doc_id"] or 0, r["text"] or "", r[m.taken])
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(frame.repartition(7)).rows.collect()))
    assert mixing.mix(empty).rows.count() == 0 and mixing.mixed_documents(docs).columns == docs.columns


# Language -----------------------------------------------------------------------------------------


def test_suffix_automaton_parses_greedily():
    r = random.Random(6)
    for _ in range(200):
        train, text = ("".join(r.choice("abc") for _ in range(r.randint(1, 30))) for _ in range(2))
        text, at, count = text.replace("c", "d") if r.random() < 0.3 else text, 0, 0
        while at < len(text):
            n = 1
            while at + n < len(text) and text[at : at + n + 1] in train:
                n += 1
            at += n
            count += 1
        assert language.SuffixAutomaton(train).phrases(text) == count


def test_language_sample_takes_each_text_once(spark):
    texts = [text_of(k, 20) for k in range(5)]
    rows = spark.createDataFrame([(x, "en") for x in texts], "text string, lang string").crossJoin(spark.range(300)).drop("id")
    assert [name for name, _ in language.sample(rows)] == ["en"]
    assert sorted(language.sample(rows)[0][1].split()) == sorted(" ".join(texts).split())


def test_language_frames(spark, docs, empty):
    r = random.Random(7)
    say = lambda words: " ".join(r.choice(words) for _ in range(60))
    en, de = "the of and thing house water with which".split(), "der und nicht schön straße wasser mit welche".split()
    train = spark.createDataFrame([(k, say(en if k % 2 else de), "en" if k % 2 else "de") for k in range(40)] + [(98, None, "en"), (99, "x", None)], "doc_id long, text string, lang string")
    samples = language.sample(train)
    assert [s[0] for s in samples] == ["de", "en"] and language.sample(empty) == ()
    rows = spark.createDataFrame([(1, "the water of the house", "x"), (2, "nicht schön", "x"), (3, None, "x"), (4, " 123 !", "x"), (4, " 123 !", "x")], "doc_id long, text string, language string")
    got, at = language.predict(rows, samples)
    assert [r[at]["lang"] for r in got.orderBy("doc_id").collect()] == ["en", "de", "und", "und", "und"]
    assert all(0 <= r[at]["score"] <= 1 for r in got.collect())
    assert {r[0]["lang"] for r in language.predict(rows, ())[0].select(at).collect()} == {"und"}


def test_lanes_parse_as_the_automaton_does(monkeypatch):
    r = random.Random(11)
    texts = ["".join(r.choice("abcd ") for _ in range(r.randint(0, 60))) for _ in range(60)] + ["abcd " * 3000]
    for most in (language.FULL_MOVES, 0):
        monkeypatch.setattr(language, "FULL_MOVES", most)
        samples = tuple((str(k), "".join(r.choice("abc ") for _ in range(60))) for k in range(3))
        found = language.Model(samples).phrases(texts)
        for k, (_, own) in enumerate(samples):
            automaton = language.SuffixAutomaton(language.plain(own))
            assert found[k].tolist() == [automaton.phrases(x) for x in texts]


def test_only_letters_are_read():
    for k in range(0x110000):
        c = chr(k)
        assert bool(language.plain(c)) == unicodedata.category(c).startswith("L"), hex(k)
    assert language.plain("½ Ⅷ ① x²Y") == " x y "


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = language.held_out(F.col("doc_id"))
    rows, at = language.predict(docs.filter(out).select("doc_id", "text", "lang"), language.sample(docs.filter(~out)))
    found = [(r["lang"], r[at]["lang"]) for r in rows.collect() if r["lang"] and r["text"]]
    assert len(found) > 30 and sum(a == b for a, b in found) >= 0.97 * len(found)


# Search -------------------------------------------------------------------------------------------


def test_topk_matches_brute_force(spark):
    r = np.random.default_rng(1)
    vectors = [list(map(float, v)) for v in r.normal(size=(300, 8)) * np.repeat([0.2, 1, 3], 100)[:, None]]
    rows = [(k, v) for k, v in enumerate(vectors)] + [(300 + k, vectors[7]) for k in range(40)] + [(400, None), (401, [1.0, None]), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (None, vectors[0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("own"))
    got = Counter((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in topk.search(frame, F.col("vec_id") % 20 == 0).collect())
    q = {k: np.floor(np.array(v) * 64).astype(int) for k, v in rows if k is not None and k < 400}
    want = Counter()
    for a in q:
        if a % 20 == 0:
            best = sorted(((-int(q[a] @ q[b]), b) for b in q if b != a))[:20]
            want.update((a, n, b, -s) for n, (s, b) in enumerate(best, start=1))
    assert got == want
    assert topk.search(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = topk.search(frame.filter("vec_id < 3"), F.col("vec_id") % 20 == 0)
    assert few.count() == 2


# URLs ---------------------------------------------------------------------------------------------


def test_url_rules(spark):
    cases = {
        "https://Blog.Example.ORG/en/12?x": ("blog.example.org", "/en/12", "example.org/en/1", "block"), "http://a.org/x": ("a.org", "/x", "org/", "allow"), "http://b.org/y/": ("b.org", "/y/", "org/", "allow"), "http://a.org": ("a.org", "", None, "allow"),
        "http://x.com/fr/1": ("x.com", "/fr/1", "com/fr/", "allow"), "http://x.com/de/1#t": ("x.com", "/de/1", "com/de/", "block"), "nothing": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://notorg/x": ("notorg", "/x", None, "allow"),
    }
    rows = spark.createDataFrame([(k, u) for k, u in enumerate(cases)] * 2, "page_id long, url string").withColumns({"host": F.lit("own"), "n": F.lit("own")})
    got, names = urls.judge(rows)
    found = {r["url"]: tuple(r[names[x]] for x in ("host", "path", "rule", "verdict")) for r in got.collect()}
    assert found == cases and got.count() == 2 * len(cases)
    assert urls.judge(rows.limit(0))[0].count() == 0


def test_url_templates_learn_from_labels(spark):
    rows = [("x.com", f"http://x.com/de/{k}") for k in range(30)] + [("x.com", f"http://x.com/other/{k}") for k in range(30)] + [("y.com", f"http://y.com/fr/{k}") for k in range(30)] + [("y.com", "http://y.com/zz/1")]
    got, names = urls.judge(spark.createDataFrame(rows, "h string, url string"))
    verdicts = {r["url"]: r[names["verdict"]] for r in got.collect()}
    assert verdicts["http://x.com/other/3"] == "block" and verdicts["http://y.com/zz/1"] == "allow"


def test_deep_paths_branch_and_end(spark):
    rows = [f"http://x.com/a/b/c/d/{k % 2}e/x{k % 3}" for k in range(60)] + ["http://x.com/" + "/".join("s" * 2000)]
    rules = (urls.Rule("block", "x.com", "/a/b/c/d/0e/"), urls.Rule("allow", "x.com", "/a/b/c/d/1e/x0"))
    got, names = urls.judge(spark.createDataFrame([(x,) for x in rows], "url string"), rules=rules)
    found = {r["url"]: r for r in got.collect()}
    assert len(found[rows[-1]][names["template"]].split("/")) == 2001 and got.count() == len(rows)
    assert found["http://x.com/a/b/c/d/0e/x1"][names["verdict"]] == "block" and found["http://x.com/a/b/c/d/1e/x0"][names["verdict"]] == "allow"


def test_hashes_are_stable():
    assert hashlib.sha256(minhash.shingles("A b c d e f").tobytes()).hexdigest() == hashlib.sha256(minhash.shingles("a B  c\td e\nf").tobytes()).hexdigest()


# Source divergence --------------------------------------------------------------------------------


def brute_divergence(rows, least):
    """From (text, lang, source), by the definition."""
    texts = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), lang or "", source or "") for t, lang, source in rows]
    out = []
    for lang in {x[1] for x in texts}:
        within = Counter(term for t, own, _ in texts if own == lang for term in set(t))
        kept = [term for term, n in within.items() if n >= least]
        groups = sorted({s for _, own, s in texts if own == lang})
        counts = {g: Counter(term for t, own, s in texts if (own, s) == (lang, g) for term in t if term in set(kept)) for g in groups}
        counts[None] = sum(counts.values(), Counter())
        v = len(kept)
        p = {g: {x: 1 + 10**9 * (c[x] + 2) // (sum(c.values()) + 2 * v) for x in kept} for g, c in counts.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for g in groups:
            pairs = [(-sum(f(p[g][x], p[h][x]) for x in kept), h.encode()) for h in groups if h != g]
            terms = [(-f(p[g][x], p[None][x]), x.encode()) for x in kept if counts[g][x] and p[g][x] > p[None][x]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:10])):
                out += [(lang, g, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(items)]
    return Counter(out)


@pytest.mark.parametrize(("rows_", "columns_"), [(32, 1024), (2, 3)])
def test_divergence_matches_brute_force(spark, empty, monkeypatch, rows_, columns_):
    monkeypatch.setattr(divergence, "ROWS", rows_)
    monkeypatch.setattr(divergence, "COLS", columns_)
    r = random.Random(21)
    words = ["Été", "été", "中文", "naïve", *"abcdefghijklmnopqrstuvw"]
    rows = [(" ".join(r.choice(words[k % 5 :]) + r.choice(["", "1", ",", "'s"]) for _ in range(r.randint(0, 30))), r.choice(["en", "en", "fr", None]), r.choice(["a", "b", "c", "d", "é", None])) for k in range(160)]
    rows += [(None, "en", "nothing"), ("", "xx", "one"), (None, "xx", "two"), ("alone", "yy", "only")] + [("many " * 5000, "en", "a")] * 3
    frame = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit("own"), "n": F.lit("own")}).repartition(3)
    assert Counter(map(tuple, divergence.divergence(frame).collect())) == brute_divergence(rows, 10)
    assert divergence.divergence(empty).count() == 0


def test_joint_leaves_visit_all_cells_of_either_tree():
    r = np.random.default_rng(5)
    for _ in range(50):
        a, b = (r.random((5, 16)) < 0.1 for _ in range(2))
        trees = [divergence.Tree(*(x.astype(np.int64) for x in np.nonzero(m)), 4) for m in (a, b)]
        found = set(zip(*(x.tolist() for x in divergence.joint_leaves(*trees, 4, 5, 5, False)), strict=True))
        assert found == {(i, j, k) for i in range(5) for j in range(5) for k in range(16) if a[i, k] or b[j, k]}


# Periodic runs ------------------------------------------------------------------------------------


def brute_runs(words, least):
    """Every maximal stretch with a period, smallest period first."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda x: (x[0], x[2]))


def test_runs_match_brute_force():
    r = random.Random(22)
    for _ in range(1500):
        n, letters = r.randint(0, 60), r.choice([1, 2, 3, 5, 20])
        words = [str(r.randrange(letters)) for _ in range(n)]
        if n and r.random() < 0.5:
            a, p = r.randrange(n), r.randint(1, 9)
            words = [x if i < a else words[min(a + (i - a) % p, n - 1)] for i, x in enumerate(words)]
        assert runs.find_runs(words) == brute_runs(words, 12)
        numbers = {x: k for k, x in enumerate(dict.fromkeys(words))}
        assert n < 3 or runs.runs_of(np.array([numbers[x] for x in words]), 3) == brute_runs(words, 3)


def test_runs_are_collapsed(spark, empty):
    long = " ".join(f"w{k % 700}" for k in range(3500))
    rows = [(1, "a b c " * 5, "x"), (2, None, "x"), (3, "", "x"), (4, "a  b", "x"), (4, "a  b", "x"), (5, long, "x"), (None, "no run", "x")]
    found, at, collapsed = runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, runs string"))
    assert (at, found.count()) == ("_runs", 7)
    got = {r["doc_id"]: ([tuple(x) for x in r[at]], r[collapsed]) for r in found.collect()}
    assert got == {1: ([(0, 15, 3)], "a b c"), 2: ([], None), 3: ([], ""), 4: ([], "a b"), 5: ([(0, 3500, 700)], " ".join(f"w{k}" for k in range(700))), None: ([], "no run")}
    assert runs.periodic_runs(empty)[0].count() == 0


def test_op12_matches_brute_force(spark):
    from tomeweave.llm.queries_runs import op12_periodic_runs

    sf_dir = "/root/testdata/sf0.001"
    want = Counter()
    for doc_id, text in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [x if i < a else words[a + (i - a) % p] for i, x in enumerate(words)]
        found = runs.find_runs(words) if n > 3000 else brute_runs(words, 12)
        kept = [x for i, x in enumerate(words) if not any(s + q <= i < s + length for s, length, q in found)]
        best = max(found, key=lambda x: x[1], default=None)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{length},{q}\n" for s, length, q in found), " ".join(kept))]
        want[(doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *digests)] += 1
    assert Counter(map(tuple, op12_periodic_runs(spark, sf_dir).collect())) == want


# N-gram Jaccard join ------------------------------------------------------------------------------


def brute_join(rows):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    forest = components.Forest()
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                forest.join(a, b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(forest.find(k), []).append(rows[k][0])
    least = {g: min((x for x in own if x is not None), default=None) for g, own in groups.items()}
    return Counter((doc_id, len(own), least[forest.find(k)] if own else doc_id) for k, ((doc_id, _), own) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize("small_bounds", [False, True])
def test_ngram_join_matches_brute_force(spark, docs, empty, monkeypatch, small_bounds):
    """With small bounds: many parts, batches and frequent n-grams, and clusters of several blocks."""
    if small_bounds:
        for name, value in {"COUNTERS": 256, "FREQUENT": 6, "BATCH": 3000, "PART": 2500, "BLOCK_SETS": 5}.items():
            monkeypatch.setattr(ngram_join, name, value)
    r = random.Random(31)
    rows = [(d["doc_id"], d["text"]) for d in docs.collect()]
    passage = text_of(77, 60)
    for group in range(6):
        base = text_of(200 + group, 150).split()
        for k in range(12):
            copy = base.copy()
            for _ in range(r.randint(0, 5)):
                copy[r.randrange(len(copy))] = f"edit{r.random()}"
            if k % 5 == 4:
                del copy[: r.randint(0, 25)]
            rows.append((1000 + group * 20 + k, " ".join(copy).title() if k == 3 else " ".join(copy)))
    rows += [(2000 + k, f"{text_of(300 + k, 40)} {passage} {text_of(400 + k, r.randint(1, 40))}") for k in range(30)]
    rows += [(None, text_of(1)), (None, "a null id alone of its kind"), (7, text_of(203, 150)), (3000, "one TWO"), (3001, "two one")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("own"), "node": F.lit("own")}).repartition(4)
    assert Counter(map(tuple, ngram_join.jaccard_join(frame).collect())) == brute_join(rows)
    assert ngram_join.jaccard_join(empty).count() == 0


def test_prefix_tree_finds_all_links():
    r = random.Random(32)
    for _ in range(200):
        base = sorted(r.sample(range(80), 30))
        sets = [np.array(sorted({*r.sample(base, r.randint(24, 30)), *r.sample(range(80), r.randint(0, 4))})) for _ in range(r.randint(1, 12))]
        sizes = np.array([len(x) + r.randint(0, 3) for x in sets])
        tree, place = ngram_join.PrefixTree(sets, sizes), np.zeros(80, np.int64)
        for a, own in enumerate(sets):
            both = [len(set(own) & set(x)) for x in sets]
            found = {(k, n) for k, n in tree.linked(own, int(sizes[a]), place) if 100 * n >= 85 * (sizes[a] + sizes[k] - n)}
            assert found == {(k, n) for k, n in enumerate(both) if 100 * n >= 85 * (sizes[a] + sizes[k] - n)}


def test_summary_names_all_frequent_numbers():
    r = np.random.default_rng(7)
    summary = ngram_join.Summary(50)
    numbers = np.concatenate([r.integers(0, 5000, 20_000), np.repeat(np.arange(10_000, 10_010), 600)]).astype(np.uint64)
    r.shuffle(numbers)
    for part in np.array_split(numbers, 40):
        summary.add(part)
    assert len(summary.keys) <= 50 and set(range(10_000, 10_010)) <= set(summary.keys.tolist())
