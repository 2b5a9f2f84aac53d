"""The pipeline against a plain version of its stages, and the queries against brute force."""

import hashlib
import re
from collections import Counter

import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_operators import brute_components, brute_measures, text_of
from tomeweave.llm import common, secrets


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    base = text_of(1, 150).split()
    near = base.copy()
    near[70] = "edited"
    rows = [(1, " ".join(base), "en", "a", 1), (2, " ".join(near), "en", "a", 1), (3, "too short", "en", "a", 1), (4, None, None, None, None)]
    rows += [(10 + k, text_of(50 + k, 80) + (" token = abcdef0123 " if k % 3 == 0 else ""), "en", ["a", "b", "c"][k % 3], 1) for k in range(30)]
    rows += [(50, "same same " * 100, "en", "b", 1), (51, "a ### b *** " * 50 + text_of(3, 60), "en", "b", 1)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return folder


def test_stages_and_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}

    def passes(text):
        n, chars, symbols, lines, dup, repeat = brute_measures(text)
        return n >= 50 and 100 * repeat <= 50 * n and 100 * symbols <= 10 * n and 100 * dup <= 50 * lines and 2 * n <= chars <= 15 * n

    kept = {d: t for d, t in rows.items() if passes(t)}
    one = {d for d, _, _, keep in brute_components(list(kept.items())) if keep}
    masked = {d: secrets.masked(kept[d], secrets.scan(kept[d])) for d in one}
    out = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES, (kept, {d: kept[d] for d in one}, masked), strict=False):
        out = stage(spark, out, sf_dir)
        assert out.columns == docs.columns, name
        assert {r["doc_id"]: r["text"] for r in out.collect()} == want, name
    mixed = corpus_pipeline.source_mix(spark, out, sf_dir)
    assert mixed.columns == docs.columns
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert set(copies) <= one and max(copies.values()) <= 3
    words = lambda d: len(re.findall(r"[^\x20\x09-\x0D]+", masked[d]))
    assert abs(sum(n * words(d) for d, n in copies.items()) - sum(map(words, one))) <= 3 * max(map(words, one))
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(r["doc_id"] for r in found) == copies
    for r in found:
        ids = lib.encode(masked[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and bytes(r["ids"]) == b"".join(x.to_bytes(4, "little") for x in ids)
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_pipeline_of_an_empty_table(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_batches_are_bounded_unless_the_session_says_otherwise(spark):
    spark.conf.unset(common.BATCH_BYTES)
    common.bound_batches(spark)
    assert int(spark.conf.get(common.BATCH_BYTES)) == common.MOST_BYTES

    @F.pandas_udf("long")
    def lengths(texts: pd.Series) -> pd.Series:
        return pd.Series([int(texts.str.len().sum())] * len(texts))

    texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("word "), 1000).alias("text"))
    held = texts.select(lengths("text").alias("n")).agg(F.max("n").alias("n")).first()["n"]
    assert held <= common.MOST_BYTES + 5000
    spark.conf.set(common.BATCH_BYTES, 12345)
    common.bound_batches(spark)
    assert int(spark.conf.get(common.BATCH_BYTES)) == 12345
    spark.conf.unset(common.BATCH_BYTES)
