"""Token-id files: all ids of a corpus in ascending order of doc_id, range-coded.

``write`` sorts the documents over many tasks by range of doc_id; each task encodes its range
in order and emits segments: whole documents, up to ``SEGMENT_IDS`` ids (a longer document is
a segment alone), coded by ``rangecoder`` in independent, checksummed blocks. The files are Parquet tables of
segments, so any store that Spark reaches will do. ``read`` gives every segment its
place by a prefix sum over ranges and over a range's segments, and decodes the segments independently.

Ids come from the tokenizers library. Blanks part its words, so it is asked once for each distinct word
that a process has not seen lately (tasks that follow each other in it share this memory, which is bounded), for many at a time.

Defined cases: ids of documents are whole numbers (others are cast to them, and a cast that fails raises); a null or empty text has only the end id; a null id comes first; rows of equal id are
ordered by text (and equal rows are equal in the file, too); an empty table gives an empty file set.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomeweave.llm import rangecoder
from tomeweave.llm.bpe import LONG_PIECE, _plain_pattern, share
from tomeweave.llm.common import release, small

SEGMENT_IDS = 8_000_000
#: Words in each of a process's two generations of memory.
REMEMBERED = 500_000
#: Bytes of the texts that are handled together; a longer text is handled alone.
TOGETHER = 16_000_000
SEGMENTS = "part int, segment int, n_ids long, doc_ids array<long>, lengths array<long>, data binary"
#: Letters beyond ASCII that no letter beside them composes with, and whose lower case is one letter.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ"


def joined(starts: np.ndarray, lengths: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The stretches of ``data`` that begin at ``starts``, one after the other."""
    shift = (starts - (lengths.cumsum() - lengths)).astype(np.int32 if len(data) < 1 << 31 else np.int64)
    at = np.repeat(shift, lengths)
    at += np.arange(len(at), dtype=at.dtype)
    return data.take(at)


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sums of consecutive stretches that end at ``ends``."""
    return np.diff(np.concatenate([[0], values.cumsum()])[ends], prepend=0)


#: Kinds of bytes. Bytes beyond ASCII are OTHER until they are found to be of ``LETTERS``.
BLANK, LETTER, DIGIT, SIGN, OTHER = range(5)


def _kind(x: int) -> int:
    if x in b" \t\n\x0b\x0c\r":
        return BLANK
    return OTHER if not 0x21 <= x <= 0x7E else LETTER if chr(x).isalpha() else DIGIT if chr(x).isdigit() else SIGN


KINDS = bytes(map(_kind, range(256)))
LOWER = bytes(range(256)).lower()
#: The lower case of the letters of ``LETTERS`` that take two bytes, by their number; 0 for what is none of them.
TWO_BYTES = np.array([ord(chr(x).lower()) if x >= 0x80 and re.match(f"[{LETTERS}]", chr(x)) else 0 for x in range(0x180)])
#: The file's pattern of words that ``words`` follows.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def words(text: bytes, special: re.Pattern | None, whole: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of a text that begins and ends with a line end, where they begin, and which of them are pieces between blanks that were left whole.

    Those are the pieces that hold other letters or special tokens (``whole``: all pieces); the other ones are parted by the pattern in lower case.
    """
    raw, kind = np.frombuffer(text, np.uint8), np.frombuffer(text.translate(KINDS), np.uint8).copy()
    lower = np.frombuffer(text.translate(LOWER), np.uint8).copy()
    odd = np.flatnonzero(kind == OTHER)
    if len(odd):
        at = odd[(raw[odd] >= 0xC3) & (raw[odd] <= 0xC5)]
        own = TWO_BYTES.take(((raw[at] & 0x1F).astype(np.int64) << 6) | (raw[at + 1] & 0x3F))
        at, own = at[own > 0], own[own > 0]
        kind[at] = kind[at + 1] = LETTER
        lower[at], lower[at + 1] = 0xC0 | (own >> 6), 0x80 | (own & 0x3F)
        odd = odd[kind[odd] == OTHER]
    if special:
        odd = np.append(odd, np.array([x.start() for x in special.finditer(text)], np.int64))
    if whole:
        np.copyto(kind, OTHER, where=kind != BLANK)
        lower = raw
    elif len(odd):
        blanks = np.flatnonzero(kind == BLANK)
        piece = np.unique(np.searchsorted(blanks, odd))
        first, size = blanks[piece - 1] + 1, blanks[piece] - blanks[piece - 1] - 1
        at = np.repeat(first - (size.cumsum() - size), size) + np.arange(size.sum())
        kind[at], lower[at] = OTHER, raw[at]
    edge = kind[1:] != kind[:-1]
    edge |= kind[1:] == DIGIT  # each by itself
    runs = np.flatnonzero(edge) + 1
    of_word = kind.take(runs) != BLANK
    starts, ends = runs[of_word], np.append(runs[1:], len(kind))[of_word]
    # A lone apostrophe takes the letters that the pattern names from the word after it.
    lone = np.flatnonzero((lower.take(starts) == ord("'")) & (ends - starts == 1))
    lone = lone[(kind[starts[lone]] == SIGN) & (kind[ends[lone]] == LETTER)]
    one, two = lower[ends[lone]].astype(np.int64), lower[ends[lone] + 1].astype(np.int64)
    taken = np.where(np.isin(one, list(b"stmd")), 1, np.where(np.isin(one << 8 | two, [int.from_bytes(x) for x in (b"re", b"ve", b"ll")]), 2, 0))
    ends[lone] += taken
    starts[lone + 1] += taken
    if taken.any():
        left = ends > starts
        starts, ends = starts[left], ends[left]
    offsets = np.append(0, (ends - starts).cumsum()).astype(np.int32)
    data = lower[kind != BLANK]
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), starts, kind.take(starts) == OTHER


class Words:
    """Distinct words with the place and number of their ids."""

    def __init__(self, words: pa.Array, lengths: np.ndarray, data: np.ndarray):
        self.words, self.lengths, self.data = words, lengths, data
        self.starts = lengths.cumsum() - lengths

    def chosen(self, at: np.ndarray) -> Words:
        lengths = self.lengths.take(at)
        return Words(self.words.take(pa.array(at)), lengths, joined(self.starts.take(at), lengths, self.data))

    def with_more(self, more: Words) -> Words:
        return Words(pa.concat_arrays([self.words, more.words]), np.append(self.lengths, more.lengths), np.append(self.data, more.data))


def no_words() -> Words:
    return Words(pa.array([], pa.binary()), np.empty(0, np.int64), np.empty(0, "<u4"))


class LibraryEncoder:
    """Ids by the tokenizers library, which is asked for many new words, or pieces between blanks, at a time, blanks between them.

    Pieces of plain letters and signs are parted into words over whole arrays of bytes, as the file's own pattern does, and the
    library's model is asked for these; the last id of a word tells its end. Other pieces are asked for whole, with all of the library's steps.
    """

    ASKED = 1000

    def __init__(self, spec: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, parsed = Tokenizer.from_str(spec), json.loads(spec)
        self.library.no_truncation()
        self.library.no_padding()
        plain = lambda x: self.library.encode(x, add_special_tokens=False).ids
        if any(plain(a + blank + b) != plain(a) + plain(b) for blank in " \t\n" for a, b in (("a", "b"), ("1", "2"), ("!", "?"), ("a.", "b"), ("a", "."))):
            raise ValueError("this tokenizer file's words may reach over a blank")
        # The same model for words that are normalised and parted already.
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.young, self.old, self.parted = no_words(), no_words(), self._parted(parsed)
        special = "|".join(re.escape(x["content"]) for x in parsed["added_tokens"])
        self.special = re.compile(special.encode()) if special else None

    def _parted(self, parsed: dict) -> bool:
        """Whether words may be parted here; not where the file is of another kind, or the library disagrees on a letter."""
        model, suffix = parsed["model"], parsed["model"].get("end_of_word_suffix")
        byte_letters = {x for x in model["vocab"] if len(x) == 1}
        if not _plain_pattern(parsed) or parsed["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != PATTERN:
            return False
        if not suffix or model["type"] != "BPE" or len(byte_letters) != 256 or any(x + suffix not in model["vocab"] for x in byte_letters):
            return False
        letters = "".join(x for x in map(chr, range(0x180)) if re.match(f"[!-~{LETTERS}]", x))
        own, split = self.library.normalizer.normalize_str(letters), self.library.pre_tokenizer.pre_tokenize_str
        mine = [x.decode() for x in words(f"\n{letters}\n".encode(), None, False)[0].to_pylist()]
        if own != letters.lower() or any(len(split(x)) != 1 for x in own) or [own[a:b] for _, (a, b) in split(own)] != mine:
            return False
        if self._asked(mine) != [self.library.encode(" ".join(mine), add_special_tokens=False).ids]:
            return False
        self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
        self.ends[[k for x, k in model["vocab"].items() if x.endswith(suffix)]] = True
        return True

    def _asked(self, texts: list[str]) -> list[list[int]]:
        """The ids of the words, each part of them joined by blanks."""
        parts = [" ".join(texts[k : k + self.ASKED]) for k in range(0, len(texts), self.ASKED)]
        return [x.ids for x in self.model.encode_batch_fast(parts, add_special_tokens=False)]

    def _ids_of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, and how many each has."""
        if not words:
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        ids = np.concatenate([np.array(x, "<u4") for x in self._asked(words)])
        stops = np.flatnonzero(self.ends.take(ids)) + 1
        if len(stops) != len(words):
            raise ValueError("the library parts a word")
        return ids, np.diff(stops, prepend=0)

    def _ids_of_others(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces of any kind; a token's place tells its piece."""
        ids, counts = [np.empty(0, "<u4")], [np.empty(0, np.int64)]
        for begin in range(0, len(pieces), self.ASKED):
            part = pieces[begin : begin + self.ASKED]
            got = self.library.encode(" ".join(part), add_special_tokens=False)
            ends = np.fromiter(map(len, part), np.int64, len(part)) + 1
            cuts = np.searchsorted(np.array([start for start, _ in got.offsets], np.int64), ends.cumsum())
            ids.append(np.array(got.ids, "<u4"))
            counts.append(np.diff(cuts, prepend=0))
        return np.concatenate(ids), np.concatenate(counts)

    def _ids_of(self, distinct: pa.Array, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and number of the ids of each word, and the ids that these are places in; ``whole``: which words are whole pieces."""
        if len(self.young.words) >= REMEMBERED:
            self.young, self.old = no_words(), self.young
        found = [pc.index_in(distinct, value_set=x.words).fill_null(-1).to_numpy() for x in (self.young, self.old)]
        again = np.flatnonzero((found[0] < 0) & (found[1] >= 0))
        new = np.flatnonzero((found[0] < 0) & (found[1] < 0))
        parts, others = new[~whole[new]], new[whole[new]]
        text = lambda at: distinct.take(pa.array(at)).cast(pa.string()).to_pylist()
        first, n_first = self._ids_of_words(text(parts))
        second, n_second = self._ids_of_others(text(others))
        fresh = Words(distinct.take(pa.array(np.append(parts, others))), np.append(n_first, n_second), np.append(first, second))
        recent = self.old.chosen(found[1].take(again)).with_more(fresh)
        all_ = self.young.with_more(recent)
        place = found[0].astype(np.int64)
        place[np.concatenate([again, parts, others])] = np.arange(len(self.young.words), len(all_.words))
        out = all_.starts.take(place), all_.lengths.take(place), all_.data
        size = pc.binary_length(recent.words).to_numpy()
        self.young = self.young.with_more(recent.chosen(np.flatnonzero(size <= LONG_PIECE))) if len(size) and size.max() > LONG_PIECE else all_
        return out

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        texts, edge = texts.fill_null(""), pa.array([""], texts.type)
        own = pa.concat_arrays([edge, texts, edge])  # line ends around each text
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), "\n")[0].as_buffer().to_pybytes()
        found, starts, whole = words(text, self.special, not self.parted)
        coded = found.dictionary_encode()
        at = coded.indices.to_numpy()
        wholes = np.zeros(len(coded.dictionary), bool)
        wholes[at[whole]] = True
        begins, lengths, data = self._ids_of(coded.dictionary, wholes)
        own_lengths = lengths.take(at)
        upto = np.searchsorted(starts, 1 + (pc.binary_length(texts).to_numpy().astype(np.int64) + 1).cumsum())
        return joined(begins.take(at), own_lengths, data), sums(own_lengths, upto)


@lru_cache(maxsize=2)
def library_encoder(spec: str) -> LibraryEncoder:
    return LibraryEncoder(spec)


def parts_of(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """First and last row (exclusive) of the texts that are handled together."""
    upto = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64).cumsum()
    begin = 0
    while begin < len(upto):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + TOGETHER, "right")))
        yield begin, end
        begin = end


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, text: str = "text", doc_id: str = "doc_id") -> None:
    """Writes the segments of all documents to ``path``."""
    spec = share(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        own, part, segment = library_encoder(spec.value), TaskContext.get().partitionId(), 0
        ids, doc_ids, lengths, held = [], [], [], 0
        schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("data", pa.binary())])

        def emit() -> pa.RecordBatch:
            whole = np.concatenate(ids)
            ids.clear()
            return pa.RecordBatch.from_pylist([{"part": part, "segment": segment, "n_ids": held, "doc_ids": doc_ids, "lengths": lengths, "data": rangecoder.compress(whole)}], schema)

        for batch in batches:
            for begin, end in parts_of(batch["t"]):
                coded, counts = own.encode_all(batch["t"].slice(begin, end - begin))
                coded = np.insert(coded, counts.cumsum(), np.uint32(end_id))  # after each document
                at = taken = 0
                for d, n in zip(batch["d"].slice(begin, end - begin).to_pylist(), (counts + 1).tolist(), strict=True):
                    if doc_ids and held + n > SEGMENT_IDS:
                        ids.append(coded[taken:at])
                        yield emit()
                        segment, taken = segment + 1, at
                        doc_ids, lengths, held = [], [], 0
                    doc_ids.append(d)
                    lengths.append(n)
                    held += n
                    at += n
                ids.append(coded[taken:])
        if doc_ids:
            yield emit()
        release()

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("d"), F.col(f"`{text}`").cast("string").alias("t"))
    order = [F.col("d").asc_nulls_first(), F.xxhash64("t"), F.col("t")]
    # The hash keeps rows of one id from being one range; numbers of partitions come from the session.
    ranged = rows.repartitionByRange(F.col("d").asc_nulls_first(), F.xxhash64("t")).sortWithinPartitions(*order)
    ranged.mapInArrow(run, SEGMENTS).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (packed) of every document in the files."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    sizes = segments.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))  # a row per written file range
    parts = sizes.withColumn("part_start", F.coalesce(F.sum("part_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        segments.select("part", "segment", "n_ids").withColumn("inner_start", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
        .join(parts, "part").select("part", "segment", (F.col("part_start") + F.col("inner_start")).alias("start"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library_encoder.cache_clear()  # what a process remembers from writing
        for batch in batches:
            for row in batch.to_pylist():
                ids, lengths = rangecoder.expand(row["data"]), np.array(row["lengths"], np.int64)
                ends = np.append(0, 4 * lengths.cumsum())
                packed = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(ids)]).cast(pa.binary())
                own = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends[:-1] // 4), pa.array(lengths), packed]
                yield pa.RecordBatch.from_arrays(own, ["doc_id", "start", "n_tokens", "ids"])
        release()

    return segments.join(small(starts), ["part", "segment"]).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def checksum(rows: DataFrame) -> DataFrame:
    """The packed ids as their unsigned crc32."""
    return rows.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
