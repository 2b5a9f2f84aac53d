"""Retrieval over chunks: TF-IDF, BM25 and phrases for batches of questions.

Here are an index as rows (document frequencies and vector norms, by aggregation), the scores of all pairs, and
answers from ranked chunks. Ranking itself, which keeps no scores, is in ``scan``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeweave import lexicon
from tomeweave.functions import text as T
from tomeweave.functions.grams import ANALYZERS, tokens
from tomeweave.operators.lineage import cut

#: Questions whose vectors are held by a task at once.
QUESTION_BLOCK = 512
#: Rows of a ranking that are broadcast.
BROADCAST_ROWS = 500_000
K1, B, EPSILON = 1.5, 0.75, 0.25


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` over all cores, at most four parts each: chunks come from few files, and one long document makes many of them.

    What follows reads its rows in batches, so large parts need no more memory than small ones.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(max(cores, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * cores)), F.xxhash64(key))


def gram_counts(rows: DataFrame, key: str, analyzer: str, text: str = "text") -> DataFrame:
    """(key, gram, tf), counted within each text before anything is shuffled."""
    grams, kind = ANALYZERS[analyzer], rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), 200):  # few texts make many grams
                part = batch.iloc[begin : begin + 200]
                counts = [Counter(grams(x or "")) for x in part["text"]]
                yield pd.DataFrame({"key": np.repeat(part["key"].to_numpy(), [len(c) for c in counts]), "gram": [g for c in counts for g in c], "tf": [n for c in counts for n in c.values()]})

    return spread(rows.select(F.col(key).alias("key"), F.col(text).alias("text")), "text").mapInPandas(run, f"key {kind}, gram string, tf long").withColumnRenamed("key", key)


@dataclass(frozen=True)
class Index:
    """``df``: (gram, df) over n texts; ``counts``: (key, gram, tf)."""

    n: int
    df: DataFrame
    counts: DataFrame
    key: str
    analyzer: str

    def weights(self, extra: int = 0) -> DataFrame:
        """(key, gram, w): tf times the smoothed idf of n + extra texts, not yet normalised."""
        idf = F.log(F.lit(1.0 + self.n + extra) / (F.col("df") + 1)) + 1
        return self.counts.join(self.df, "gram").select(self.key, "gram", (F.col("tf") * idf).alias("w"))

    def norms(self, extra: int = 0) -> DataFrame:
        return self.weights(extra).groupBy(self.key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def build_index(rows: DataFrame, key: str, analyzer: str, text: str = "text", keep: bool = False) -> Index:
    """``keep`` writes the counts to the shared folder, for indexes of short texts whose counts are read several times."""
    counts = gram_counts(rows, key, analyzer, text)
    counts = cut(counts) if keep else counts
    return Index(rows.count(), cut(counts.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))), counts, key, analyzer)


def tfidf(index: Index) -> DataFrame:
    """(key, gram, weight) with vectors of length 1."""
    return index.weights().join(index.norms(), index.key).select(index.key, "gram", (F.col("w") / F.col("norm")).alias("weight"))


@dataclass(frozen=True)
class Bm25:
    """What BM25 needs of the corpus: texts, mean length, document frequencies, and the floor for negative idf."""

    n: int
    mean_length: float
    df: DataFrame
    floor: float

    def idf(self, df: int) -> float:
        own = math.log(self.n - df + 0.5) - math.log(df + 0.5)
        return own if own >= 0 else self.floor


def build_bm25(rows: DataFrame, text: str = "text") -> Bm25:
    counts = gram_counts(rows.withColumn("one", F.lit(1)), "one", "tokens", text)
    found = cut(counts.groupBy("gram").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")))
    n = rows.count()
    idf = F.log(F.lit(n + 0.5) - F.col("df")) - F.log(F.col("df") + 0.5)
    total, mean = found.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.avg(idf), F.lit(0.0))).first()
    return Bm25(n, total / n if n else 0.0, found.select("gram", "df"), EPSILON * mean)


def query_terms(question: Column) -> Column:
    """Up to eight terms of a question, the longest first: tokens without stopwords and particles, and its Latin words."""
    found = F.filter(F.transform(F.regexp_extract_all(question, F.lit(rf"[{T.CJK}A-Za-z0-9]+"), 0), F.lower), lambda x: (F.length(x) >= 2) & ~x.isin(*lexicon.QUESTION_STOPWORDS))

    def plain(x: Column) -> Column:
        for word in sorted(lexicon.QUESTION_STOPWORDS, key=lambda w: (-len(w), w)):
            x = F.replace(x, F.lit(word), F.lit(""))
        return F.regexp_replace(x, "^[的是了呢吗呀]+|[的是了呢吗呀]+$", "")

    kept = F.filter(F.transform(found, plain), lambda x: F.length(x) >= 2)
    latin = F.regexp_extract_all(question, F.lit("[A-Za-z][A-Za-z0-9-]{1,}"), 0)
    ranked = F.transform(F.array_distinct(F.concat(kept, latin)), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))
    return F.slice(F.transform(F.array_sort(ranked), lambda x: x["x"]), 1, 8)


def phrase_part(term: str, count: int) -> float:
    return min(1.0, 0.55 + 0.18 * count + 0.03 * min(len(term), 8))


class _Sparse:
    """Rows by gram, columns by question; only the entries that are not zero."""

    def __init__(self, rows: list[np.ndarray], columns: list[np.ndarray], values: list[np.ndarray], n_rows: int, n_columns: int):
        row, self.n = np.concatenate([np.empty(0, np.int64), *rows]).astype(np.int64), n_columns
        order = np.argsort(row, kind="stable")
        self.column, self.value = np.concatenate([np.empty(0, np.int64), *columns]).astype(np.int64)[order], np.concatenate([np.empty(0), *values])[order]
        self.begin = np.concatenate([[0], np.bincount(row, minlength=n_rows).cumsum()])

    def weighted(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The sum of the rows, each times its weight."""
        begin = self.begin[rows]
        length = self.begin[rows + 1] - begin
        at = np.repeat(begin - length.cumsum() + length, length) + np.arange(length.sum())
        return np.bincount(self.column[at], weights=self.value[at] * np.repeat(weights, length), minlength=self.n)


#: A term's first characters, by which its chunks are found.
_HEAD = 4


@dataclass
class _Block:
    """One block of questions as sparse vectors over its own vocabularies."""

    ids: list
    terms: list[list[str]]
    grams: dict[str, int]
    vectors: _Sparse
    fitted: _Sparse | None
    words: dict[str, int]
    word_weights: _Sparse
    mean_length: float

    def __post_init__(self) -> None:
        self.heads: dict[int, list[tuple[int, str]]] = {}
        for q, terms in enumerate(self.terms):
            for term in terms:
                if (at := self.grams.get(term.lower()[:_HEAD])) is not None:  # else no chunk has the term
                    self.heads.setdefault(at, []).append((q, term))

    def scores(self, text: str, norm: float, analyzer: str, phrases: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cosine, BM25 and phrase score of one chunk for every question."""
        own = Counter(c for g in ANALYZERS[analyzer](text) if (c := self.grams.get(g)) is not None)
        rows, tf = np.fromiter(own.keys(), np.int64, len(own)), np.fromiter(own.values(), float, len(own))
        dot = self.vectors.weighted(rows, tf)
        if self.fitted is None:
            length = np.full(len(self.ids), norm)
        else:  # the question is part of what the idf was fitted on
            length = np.sqrt(np.maximum(norm * norm + self.fitted.weighted(rows, tf * tf), 0))
        cosine = np.divide(dot, length, out=np.zeros(len(self.ids)), where=length > 0)
        phrase = np.zeros(len(self.ids))
        for at in own if phrases else ():
            for q, term in self.heads.get(at, ()):
                if count := text.count(term):
                    phrase[q] += phrase_part(term, count)
        return cosine, self.bm25(text), np.minimum(phrase, 1.0)

    def bm25(self, text: str) -> np.ndarray:
        found = tokens(text)
        own = Counter(c for g in found if (c := self.words.get(g)) is not None)
        rows, tf = np.fromiter(own.keys(), np.int64, len(own)), np.fromiter(own.values(), float, len(own))
        return self.word_weights.weighted(rows, tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(found) / self.mean_length)))


def _blocks(questions: DataFrame, index: Index, bm25: Bm25, fit_question: bool) -> Iterator[_Block]:
    """questions: (question_id, question). At most about QUESTION_BLOCK of them are on the driver at a time."""
    n = questions.count()
    parts = max(1, -(-n // QUESTION_BLOCK))
    rows = questions.select("question_id", "question", query_terms(F.col("question")).alias("terms"))
    for part in range(parts):
        asked = rows.filter(F.pmod(F.xxhash64(F.col("question_id").cast("string")), F.lit(parts)) == part).orderBy("question_id").collect()
        if not asked:
            continue
        counts = [Counter(ANALYZERS[index.analyzer](r["question"] or "")) for r in asked]
        words = [Counter(tokens(r["question"] or "")) for r in asked]
        spark = questions.sparkSession

        def frequencies(found: list[Counter], df: DataFrame) -> dict[str, int]:
            names = pd.DataFrame({"gram": sorted({g for c in found for g in c})}, dtype=str)
            if names.empty:
                return {}
            return {r["gram"]: r["df"] for r in df.join(F.broadcast(spark.createDataFrame(names)), "gram").collect()}  # the block's grams

        # Terms lose stopwords inside, so their heads need not be grams of the question.
        heads = Counter(t.lower()[:_HEAD] for r in asked for t in r["terms"])
        gram_df, word_df = frequencies([*counts, heads], index.df), frequencies(words, bm25.df)
        grams = {g: k for k, g in enumerate(gram_df)}
        df = np.array(list(gram_df.values()), float)
        total = index.n + fit_question
        plain = np.log((1 + total) / (1 + df)) + 1
        rows, values, more = [], [], []
        for own in counts:
            at = np.array([grams[g] for g in own if g in grams], np.int64)
            tf = np.array([n for g, n in own.items() if g in grams], float)
            idf = np.log((1 + total) / (2 + df[at])) + 1 if fit_question else plain[at]
            square = float(((tf * idf) ** 2).sum())
            if fit_question:
                alone = np.array([n for g, n in own.items() if g not in grams], float)
                square += float(((alone * (math.log((1 + total) / 2) + 1)) ** 2).sum())
            rows.append(at)
            values.append(tf * idf * idf / math.sqrt(square) if square > 0 else np.zeros(len(at)))
            more.append(idf**2 - plain[at] ** 2)
        columns = [np.full(len(at), q) for q, at in enumerate(rows)]
        names = {g: k for k, g in enumerate(word_df)}
        word_rows = [np.array([names[g] for g in own if g in names], np.int64) for own in words]
        weights = [np.array([count * bm25.idf(word_df[g]) for g, count in own.items() if g in names], float) for own in words]
        yield _Block(
            [r["question_id"] for r in asked], [list(r["terms"]) for r in asked], grams, _Sparse(rows, columns, values, len(grams), len(asked)),
            _Sparse(rows, columns, more, len(grams), len(asked)) if fit_question else None, names,
            _Sparse(word_rows, [np.full(len(x), q) for q, x in enumerate(word_rows)], weights, len(names), len(asked)), bm25.mean_length or 1.0,
        )


def all_scores(chunks: DataFrame, questions: DataFrame, index: Index, bm25: Bm25, fit_question: bool = False, phrases: bool = True) -> DataFrame:
    """question_id, chunk_id and the three scores of every pair with one above zero; BM25 not yet divided by its maximum."""
    normed = cut(spread(chunks.select("chunk_id", "text").join(index.norms(int(fit_question)), "chunk_id", "left").na.fill(0.0, ["norm"]), "chunk_id"))
    kind = questions.schema["question_id"].dataType.simpleString()
    schema = f"question_id {kind}, chunk_id string, tfidf double, bm25 double, phrase double"
    out = questions.sparkSession.createDataFrame([], schema)
    for block in _blocks(questions, index, bm25, fit_question):
        shared = questions.sparkSession.sparkContext.broadcast(block)
        analyzer = index.analyzer

        def score(batches: Iterator[pd.DataFrame], shared=shared, analyzer=analyzer) -> Iterator[pd.DataFrame]:
            own = shared.value
            for batch in batches:
                for begin in range(0, len(batch), 500):
                    part = batch.iloc[begin : begin + 500]
                    found = [own.scores(x, norm, analyzer, phrases) for x, norm in zip(part["text"], part["norm"], strict=True)]
                    three = [np.stack([f[i] for f in found]).ravel() for i in range(3)]
                    rows = pd.DataFrame({"question_id": np.tile(np.array(own.ids, dtype=object), len(part)), "chunk_id": np.repeat(part["chunk_id"].to_numpy(), len(own.ids)), "tfidf": three[0], "bm25": three[1], "phrase": three[2]})
                    yield rows[(rows["tfidf"] != 0) | (rows["bm25"] != 0) | (rows["phrase"] != 0)]

        out = out.unionByName(normed.mapInPandas(score, schema))
    return out


def _any_of(c: Column, words: tuple[str, ...]) -> Column:
    return c.rlike("|".join(words))


def best_sentence(text: Column, term: Column, question: Column) -> Column:
    """The sentence with the term that fits the question best, to 260 characters; without one, what surrounds the term."""
    plain = T.strip(F.regexp_replace(text, r"(?U)\s+", " "))
    asks = _any_of(question, lexicon.DEFINITION_QUESTION)

    def rank(x: Column, i: Column) -> Column:
        cue = F.when(asks & _any_of(x, lexicon.DEFINITION_CUES), 0).otherwise(1) + F.when(asks & _any_of(x, lexicon.ACTION_CUES), 1).otherwise(0)
        return F.struct(cue.alias("p"), F.abs(F.length(x) - 120).alias("d"), F.length(x).alias("n"), i.alias("i"), x.alias("x"), F.contains(x, term).alias("has"))

    sentences = F.filter(F.transform(F.split(plain, r"(?U)(?<=[。！？；;])\s*"), rank), lambda x: x["has"])
    at = F.instr(plain, term)
    around = F.when(at > 0, F.substring(plain, F.greatest(F.lit(1), at - 90), F.lit(170) + F.least(at - 1, F.lit(90)))).otherwise(F.lit(""))
    return F.when(F.size(sentences) > 0, F.substring(F.array_min(sentences)["x"], 1, 260)).otherwise(around)


def place(row_book: Column, row_chapter: Column, row_page: Column) -> Column:
    return F.concat(F.lit("["), row_book, F.lit(", "), row_chapter, F.lit(", 第"), row_page.cast("string"), F.lit("页]"))


def with_texts(ranked: DataFrame, chunks: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """``ranked`` with ``columns`` of its chunks. The few rows of a ranking go to where the chunks are; chunks are only dealt out for rankings of very many questions."""
    ranked = cut(ranked)
    few = ranked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return chunks.select(*by, *columns).join(F.broadcast(ranked) if few else ranked, by)


def answers(ranked: DataFrame, chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """Per question the answer with its source, the citations in rank order and the source texts; a fixed text where nothing was found."""
    rows = with_texts(ranked, chunks, ["chunk_id"], ["book_id", "chapter", "page", "text"]).join(questions.select("question_id", "question"), "question_id")
    return answers_of(rows, questions.select("question_id"))


def answers_of(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The same for ranked chunks with their texts and questions; ``asked`` has the columns that name an answer."""
    by = asked.columns
    term = F.get(F.filter(query_terms(F.col("question")), lambda t: F.contains(F.col("text"), t)), 0)
    rows = rows.withColumn("term", term).withColumn("sentence", F.when(F.col("term").isNotNull(), best_sentence(F.col("text"), F.col("term"), F.col("question"))).otherwise(F.lit("")))
    source = place(F.col("book_id"), F.col("chapter"), F.col("page"))
    evidence = F.when(F.col("sentence") != "", F.concat(T.clean_answer_text(F.col("sentence")), F.lit(" "), source))
    rows = rows.select(*by, "rank", evidence.alias("evidence"), F.concat(F.substring("text", 1, 260), F.lit("... "), source).alias("opening"), F.round("score", 4).alias("relevance"), "book_id", "chapter", "page", "text")
    each = rows.groupBy(*by).agg(
        F.min_by("evidence", F.when(F.col("evidence").isNotNull(), F.col("rank"))).alias("evidence"), F.min_by("opening", "rank").alias("opening"),
        F.array_sort(F.collect_list(F.struct("rank", "book_id", "chapter", "page", "relevance", "text"))).alias("found"),
    )
    joined = asked.join(each, by, "left")
    cited = F.transform("found", lambda x: F.concat_ws("|", x["book_id"], x["chapter"], x["page"].cast("string"), F.format_string("%.4f", x["relevance"])))
    none = F.array().cast("array<string>")
    return joined.select(*by, F.coalesce("evidence", "opening", F.lit(lexicon.NO_ANSWER)).alias("answer"), F.coalesce(cited, none).alias("citations"), F.coalesce(F.transform("found", lambda x: x["text"]), none).alias("source_chunks"))
