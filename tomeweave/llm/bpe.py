"""BPE encoding and decoding with segment trees over adjacent pair ranks.

The vocabulary is that of a public tokenizer file (a parameter); nothing is
trained. A word's symbols stand in a linked list; a segment tree holds, for each
symbol, the rank of its pair with the next one. The root is the leftmost pair of
the lowest rank. A merge changes three leaves, each in logarithmic time, and
merging ends when no leaf holds a rank. The words that a slice of texts has and its task does not know
are merged together: each has a tree of its own (a row), and a step takes every row's root. Words of
more than ``ROW_SYMBOLS`` symbols have their trees to themselves.

The file's own normaliser and word splitter (they define what a word is) come from
the tokenizers library; merging, ids and decoding are done here. Blanks never join
or normalise with what surrounds them, so texts are handled piece by piece between
ASCII blanks (this holds for a file whose words never reach over a blank; others are refused),
and each task remembers the pieces it has seen, up to a bound.

Defined cases: a null text counts as empty and encodes to no ids; an empty list
decodes to the empty string; a null list decodes to null; words of any length are
merged whole; strings of special tokens become their ids; unknown ids decode to nothing; added columns give way
to columns of the input with the same name. Ids are packed as little-endian
unsigned 32-bit integers in a binary column.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomeweave.llm.common import release, slices, spare

#: Pieces, and as many words, in each of a task's two generations of memory.
REMEMBERED = 120_000

#: Letters beyond which a piece or word is not remembered after its slice.
LONG_PIECE = 100
#: Symbols of a row at most, and rows merged together.
ROW_SYMBOLS, ROWS = 64, 2048
#: Blanks of any kind. Pieces end at ASCII ones only; a piece that holds another one is split alone, since its words cannot be told from its neighbours'.
_BLANK = re.compile(r"\s")
#: Letters of the texts that are handled together.
TOGETHER = 300_000


class Pairs:
    """Ranks of pairs of symbols in an open-addressing table, for many pairs at once."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, pairs: dict[int, int]):
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, self.NONE, np.int32)
        slots = self._slots(np.fromiter(pairs, np.int64, len(pairs))).tolist()
        for (key, rank), slot in zip(pairs.items(), slots, strict=True):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.ranks[slot] = key, rank

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """A rank for each key; NONE where the pair never merges."""
        slot = self._slots(keys)
        there = self.keys.take(slot)
        out = self.ranks.take(slot)
        again = np.flatnonzero((there != keys) & (there >= 0))
        out[there != keys] = self.NONE
        while len(again):
            slot[again] = (slot[again] + 1) & ((1 << self.bits) - 1)
            there = self.keys.take(slot[again])
            hit = there == keys[again]
            out[again[hit]] = self.ranks.take(slot[again[hit]])
            again = again[~hit & (there >= 0)]
        return out


def merge_rows(symbols: np.ndarray, pairs: Pairs, made: np.ndarray, base: int) -> np.ndarray:
    """Merges every row of ``symbols`` (a power of two wide, ended by the number ``base - 1``, that no pair has) until no pair is left.

    A node of a row's tree holds rank * width + place, so its root is the leftmost of the lowest rank. Gone symbols become -1.
    """
    n, width = symbols.shape
    shift, end = width.bit_length() - 1, base - 1
    none = np.int64(Pairs.NONE) << shift
    # One more column stands for "no symbol" on either side.
    flat = np.full((n, width + 1), end, np.int64)
    flat[:, :width] = symbols
    place = np.arange(width)
    tree = np.empty((n, 2 * width), np.int64)
    tree[:, 0] = none
    ranks = pairs.find((flat[:, :-1] * base + flat[:, 1:]).ravel()).reshape(n, width).astype(np.int64)
    tree[:, width:] = np.where(ranks == Pairs.NONE, none, (ranks << shift) + place)
    level = width
    while level > 1:
        half = level // 2
        tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level = half
    after, before = np.empty((n, width + 1), np.int64), np.empty((n, width + 1), np.int64)
    after[:, :width], before[:, 1:] = place + 1, place
    after[:, width], before[:, 0] = width, width
    flat, tree, after, before = flat.ravel(), tree.ravel(), after.ravel(), before.ravel()
    rows = np.arange(n)
    while True:
        top = tree.take(rows * (2 * width) + 1)
        going = top < none
        if not going.all():
            rows, top = rows[going], top[going]
        if not len(rows):
            break
        at, node = rows * (width + 1), rows * (2 * width)
        k, new = top & (width - 1), made.take(top >> shift)
        gone = after.take(at + k)
        then, prior = after.take(at + gone), before.take(at + k)
        flat[at + k], flat[at + gone] = new, -1
        after[at + k], before[at + then] = then, k
        before[at] = np.where(k == 0, width, before[at])
        flat[at + width] = end
        right = pairs.find(new * base + flat.take(at + then)).astype(np.int64)
        left = pairs.find(flat.take(at + prior) * base + new).astype(np.int64)
        # Three leaves change: the pairs of the merged symbol, of the one before, and of the one gone.
        tree[node + width + gone] = none
        tree[node + width + k] = np.where(right == Pairs.NONE, none, (right << shift) + k)
        first = prior == width
        prior = np.where(first, k, prior)
        tree[node + width + prior] = np.where(first, tree.take(node + width + k), np.where(left == Pairs.NONE, none, (left << shift) + prior))
        for leaf in (gone, k, prior):
            up = (leaf + width) >> 1
            while up[0]:
                below = node + 2 * up
                tree[node + up] = np.minimum(tree.take(below), tree.take(below + 1))
                up = up >> 1
    out = flat.reshape(n, width + 1)[:, :width]
    return np.where(out == end, -1, out)


def merge_pairs(symbols: list[int], ranks: dict[int, int], made: list[int], base: int) -> list[int]:
    """The same for one word of any length: merges the leftmost pair of the lowest rank until none is left.

    ``ranks`` maps left * base + right to the pair's rank, ``made`` a rank to the merged symbol.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    rank_of, none = ranks.get, len(made) * n
    width = 1 << (n - 1).bit_length()
    tree = [none] * (2 * width)
    for k, (a, b) in enumerate(zip(symbols, symbols[1:])):  # noqa: B905
        if (rank := rank_of(a * base + b)) is not None:
            tree[width + k] = rank * n + k
    for k in range(width - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(k: int, rank: int | None) -> None:
        node = width + k
        tree[node] = none if rank is None else rank * n + k
        while node > 1:
            node >>= 1
            least = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == least:
                break
            tree[node] = least

    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    symbols = symbols.copy()
    while (top := tree[1]) < none:
        rank, k = divmod(top, n)
        gone = after[k]
        symbols[k] = new = made[rank]
        symbols[gone] = -1
        then = after[k] = after[gone]
        prior = before[k]
        put(gone, None)
        if then < n:
            before[then] = k
            put(k, rank_of(new * base + symbols[then]))
        else:
            put(k, None)
        if prior >= 0:
            put(prior, rank_of(symbols[prior] * base + new))
    return [x for x in symbols if x >= 0]


class Recent:
    """What was seen last, in two generations; the young one is filled beyond ``most`` by one slice at most."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.young: dict = {}
        self.old: dict = {}

    def turn(self) -> None:
        """Before a slice: a full generation grows old."""
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}

    def missing(self, wanted: set) -> list:
        """Takes what is known of ``wanted`` into the young generation and returns the rest."""
        new = wanted - self.young.keys()
        known = new & self.old.keys()
        self.young.update({x: self.old[x] for x in known})
        return list(new - known)

    def clear(self) -> None:
        self.young, self.old = {}, {}


class Codec:
    """Encodes and decodes by a tokenizer file's JSON text."""

    def __init__(self, spec: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        library, parsed = Tokenizer.from_str(spec), json.loads(spec)
        self.normalise = library.normalizer.normalize_str if library.normalizer else str
        self.words = library.pre_tokenizer.pre_tokenize_str
        model = parsed["model"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("continuing_subword_prefix") or parsed.get("decoder"):
            raise ValueError("this tokenizer file asks for more than BPE with word ends")
        self.vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in parsed["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        plain = lambda x: [word for word, _ in self.words(self.normalise(x))]
        if any(plain(a + blank + b) != plain(a) + plain(b) for blank in " \t\n" for a, b in (("a", "b"), ("1", "2"), ("!", "?"), ("a.", "b"), ("a", "."))):
            raise ValueError("this tokenizer file's words may reach over a blank")
        last = max([*self.vocab.values(), *self.special.values()])
        self.base = last + 2  # the number last + 1 is no symbol
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        self.ranks = {self.vocab[a] * self.base + self.vocab[b]: k for k, (a, b) in enumerate(pairs)}
        self.made = [self.vocab[a + b] for a, b in pairs]
        self.pairs, self.made_row = Pairs(self.ranks), np.array(self.made, np.int64)
        single = [x for x in self.vocab if len(x) == 1]
        self.inner = np.full(max(map(ord, single)) + 2, -1, np.int64)  # the last entry: letters that the vocabulary lacks
        self.final = self.inner.copy()
        for x in single:
            self.inner[ord(x)] = self.vocab[x]
            self.final[ord(x)] = self.vocab.get(x + self.suffix, -1)
        names = {v: k for k, v in {**self.vocab, **self.special}.items()}
        self.tokens = [names.get(k) for k in range(last + 1)]
        self.plain = _plain_pattern(parsed)
        self.plain_or_break = re.compile(self.plain.pattern + "|\n") if self.plain else None
        self.seen_words, self.seen_pieces = Recent(remembered), Recent(remembered)

    def forget(self) -> None:
        """At a task's end: its process stays, for tasks of other kinds."""
        self.seen_words.clear()
        self.seen_pieces.clear()

    def merged(self, words: list[str]) -> list[bytes]:
        """The packed ids of words that are not empty."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        letters = np.minimum(letters, len(self.inner) - 1).astype(np.int64)
        symbols, ends = self.inner.take(letters), lengths.cumsum() - 1
        symbols[ends] = self.final.take(letters[ends])
        known = symbols >= 0
        if not known.all():
            lengths = np.add.reduceat(known.astype(np.int64), np.concatenate([[0], ends[:-1] + 1]))
            symbols = symbols[known]
        begins = np.concatenate([[0], lengths.cumsum()])
        out: list[bytes] = [b""] * len(words)
        least, width = 0, 4
        while width <= ROW_SYMBOLS:
            chosen = np.flatnonzero((lengths > least) & (lengths <= width))
            for part in range(0, len(chosen), ROWS):
                mine = chosen[part : part + ROWS]
                own, place = lengths[mine], np.arange(width)
                inside = place < own[:, None]
                rows = np.full((len(mine), width), self.base - 1, np.int64)
                rows[inside] = symbols[np.repeat(begins[mine] - own.cumsum() + own, own) + np.arange(own.sum())]
                rows = merge_rows(rows, self.pairs, self.made_row, self.base)
                left = rows >= 0
                data, stops = rows[left].astype("<u4").tobytes(), (4 * left.sum(axis=1).cumsum()).tolist()
                start = 0
                for word, stop in zip(mine.tolist(), stops, strict=True):
                    out[word] = data[start:stop]
                    start = stop
            least, width = width, width * 2
        for word in np.flatnonzero(lengths > least).tolist():
            out[word] = pack(merge_pairs(symbols[begins[word] : begins[word + 1]].tolist(), self.ranks, self.made, self.base))
        return out

    def words_of(self, piece: str) -> list[str]:
        """The words of a text without ASCII blanks, as the file splits it; special tokens are words."""
        out = []
        for part in self.split.split(piece) if self.split else [piece]:
            if part in self.special:
                out.append(part)
            elif part:
                out += [word for word, _ in self.words(self.normalise(part))]
        return out

    def _plain_words(self, pieces: list[str]) -> list[list[str]]:
        """The same for pieces of printable ASCII without special tokens, by the file's pattern, in one go."""
        out: list[list[str]] = [[]]
        for word in self.plain_or_break.findall("\n".join(pieces).lower()):
            if word == "\n":
                out.append([])
            else:
                out[-1].append(word)
        return out

    def _other_words(self, pieces: list[str]) -> list[list[str]]:
        """The same for other pieces without special tokens and blanks of any kind, by the library in one go; piece by piece where their ends blur all the same."""
        each = self.normalise(" ".join(pieces)).split(" ")
        if len(each) != len(pieces):
            return [self.words_of(x) for x in pieces]
        out, end, at = [[] for _ in pieces], len(each[0]), 0
        for word, (start, _) in self.words(" ".join(each)):
            while start >= end:
                at += 1
                end += 1 + len(each[at])
            out[at].append(word)
        return out

    def resolve(self, unknown: list[bytes]) -> dict[bytes, bytes]:
        """The packed ids of pieces."""
        text = [x.decode() for x in unknown]
        plain, other, slow = [], [], []
        for k, x in enumerate(text):
            if (self.split and self.split.search(x)) or _BLANK.search(x):
                slow.append(k)
            elif self.plain and x.isascii() and x.isprintable():
                plain.append(k)
            else:
                other.append(k)
        parts: list[list[str]] = [[]] * len(text)
        for chosen, split in ((plain, self._plain_words), (other, self._other_words), (slow, lambda own: [self.words_of(x) for x in own])):
            if chosen:
                for k, words in zip(chosen, split([text[k] for k in chosen]), strict=True):
                    parts[k] = words
        self.seen_words.turn()
        fresh = self.seen_words.missing({word for words in parts for word in words})
        known = self.seen_words.young
        if fresh:
            known.update(zip(fresh, self.merged(fresh), strict=True))
        specials = {word: pack([self.special[word]]) for k in slow for word in parts[k] if word in self.special}
        known.update(specials)
        found = {x: known[words[0]] if len(words) == 1 else b"".join([known[word] for word in words]) for x, words in zip(unknown, parts, strict=True)}
        for word in [*specials, *(word for word in fresh if len(word) > LONG_PIECE)]:
            known.pop(word, None)
        return found

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The packed ids of texts."""
        out, group, held = [], [], 0
        for text in texts:
            group.append(text or "")
            held += len(group[-1])
            if held >= TOGETHER:
                out += self._encoded(group)
                group, held = [], 0
        return out + self._encoded(group)

    def _encoded(self, texts: list[str]) -> list[bytes]:
        """The same for a group, which shares the merging of words that are new."""
        self.seen_pieces.turn()
        pieces = [x.encode().split() for x in texts]
        unknown = self.seen_pieces.missing(set().union(*pieces))
        known = self.seen_pieces.young
        if unknown:
            known.update(self.resolve(unknown))
        out = [b"".join(map(known.__getitem__, own)) for own in pieces]
        for piece in unknown:
            if len(piece) > LONG_PIECE:
                del known[piece]
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, packed: bytes | None) -> str | None:
        if packed is None:
            return None
        ids = unpack(packed)
        try:
            return " ".join(map(self.tokens.__getitem__, ids))
        except (IndexError, TypeError):  # ids that the vocabulary lacks
            return " ".join([self.tokens[x] for x in ids if x < len(self.tokens) and self.tokens[x] is not None])


def _plain_pattern(parsed: dict, letters: str = "A-Za-z") -> re.Pattern | None:
    """The file's word pattern for printable ASCII (and more ``letters``), where letters and digits need no tables; None if the file's steps are others."""
    steps = [x["type"] for x in parsed["normalizer"].get("normalizers", [])] if parsed.get("normalizer") else []
    splits = parsed["pre_tokenizer"].get("pretokenizers", []) if parsed.get("pre_tokenizer") else []
    if steps != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in splits] != ["Split", "ByteLevel"]:
        return None
    split, byte_level = splits
    if not split["invert"] or split["behavior"] != "Removed" or byte_level["add_prefix_space"] or byte_level["use_regex"]:
        return None
    pattern = split["pattern"]["Regex"]
    if re.search(r"\\p\{(?![LN]\})", pattern):
        return None
    inside = lambda x: x[0].replace(r"\p{L}", letters).replace(r"\p{N}", "0-9")
    return re.compile(re.sub(r"\[[^\]]*\]", inside, pattern))


def pack(ids: list[int]) -> bytes:
    out = array("I", ids)
    if _BIG:
        out.byteswap()
    return out.tobytes()


def unpack(packed: bytes) -> array:
    out = array("I")
    out.frombytes(packed)
    if _BIG:
        out.byteswap()
    return out


_BIG = array("H", [1]).tobytes() == b"\x00\x01"


@lru_cache(maxsize=2)
def codec(spec: str, remembered: int = REMEMBERED) -> Codec:
    return Codec(spec, remembered)


def share(spark: SparkSession, path: str) -> Broadcast:
    """A tokenizer file's text for all tasks; its size is the file's, whatever the data."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, path: str, text: str = "text", name: str = "ids", remembered: int = REMEMBERED) -> tuple[DataFrame, str]:
    """``docs`` with the packed ids of ``text``; also returns that column's name."""
    spec, name = share(docs.sparkSession, path), spare(docs, name)

    @F.pandas_udf(T.BinaryType())
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(spec.value, remembered)
        for batch in texts:
            for part in slices(batch):
                yield pd.Series(own.encode_all(part.tolist()), dtype=object)
        own.forget()
        release()

    return docs.withColumn(name, run.asNondeterministic()(F.col(f"`{text}`").cast("string"))), name


def round_trip(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", remembered: int = REMEMBERED) -> tuple[DataFrame, str, str]:
    """``docs`` with the packed ids of ``text`` and the text decoded from them, in one pass; also returns the columns' names."""
    spec, both = share(docs.sparkSession, path), spare(docs, "both")
    fields = [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]

    @F.pandas_udf(T.StructType(fields))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(spec.value, remembered)
        for batch in texts:
            for part in slices(batch):
                packed = own.encode_all(part.tolist())
                yield pd.DataFrame({"ids": pd.Series(packed, dtype=object), "decoded": pd.Series([own.decode(x) for x in packed], dtype=object)})
        own.forget()
        release()

    ids, decoded = spare(docs, ids), spare(docs, decoded)
    rows = docs.withColumn(both, run.asNondeterministic()(F.col(f"`{text}`").cast("string")))
    return rows.withColumns({ids: F.col(both)["ids"], decoded: F.col(both)["decoded"]}).drop(both), ids, decoded


def decode(rows: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> tuple[DataFrame, str]:
    """``rows`` with the text of the packed ``ids``; also returns that column's name."""
    spec, name = share(rows.sparkSession, path), spare(rows, name)

    @F.pandas_udf(T.StringType())
    def run(packed: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(spec.value)
        for batch in packed:
            for part in slices(batch):
                yield pd.Series([own.decode(x) for x in part], dtype=object)

    return rows.withColumn(name, run.asNondeterministic()(F.col(f"`{ids}`"))), name
