"""Golden cases of the rules on names and terms."""

import re

import pytest
from pyspark.sql import functions as F

from tomeweave.operators import terms

#: Name, text, what is left of it; one or more for each way to be turned away, and for each kind of cleaning.
CASES = [
    ("", "空白", None),
    ("图3", "胆囊的位置（图3-2）", None),
    ("第二章消化", "第二章消化", None),
    ("值得注意", "值得注意,胆汁会浓缩", None),
    ("胃*腺", "胃*腺位于黏膜", None),
    ("ATP", "肌肉消耗ATP", None),
    ("肠", "小肠很长", None),
    ("小肠上皮组织与大肠上皮组织之间的连接结构", "", None),
    ("李教授", "李教授讲解肝的结构", None),
    ("Ca离子", "Ca离子进入肌细胞", None),
    ("该腺体促进", "该腺体促进消化", None),
    ("下列胆汁", "下列胆汁成分", None),
    ("肝之叶", "肝之叶较大", None),
    ("释放胆汁", "肝释放胆汁", None),
    ("胆汁", "胆汁是黄色的", None),
    ("肝门", "肝门有血管通过", "肝门"),
    ("胆囊管", "胆囊管连接胆总管", "胆囊管"),
    ("胃腺细胞（", "胃腺细胞（壁细胞等）分泌盐酸", "胃腺细胞"),
    ("例如胃蛋白酶", "例如胃蛋白酶分解蛋白质", "胃蛋白酶"),
    ("小肠由上皮细胞", "小肠由上皮细胞围成", "上皮细胞"),
    ("胰腺导管系统", "文中没有它", "胰腺导管系统"),
]


def test_validate(spark):
    rows = spark.createDataFrame(list(enumerate(CASES)), "k long, c struct<raw: string, text: string, name: string>").select("k", "c.raw", "c.text")
    found = {r["k"]: r for r in terms.validated(rows, "raw", "text").collect()}
    assert {k: found[k]["name"] if k in found else None for k in range(len(CASES))} == {k: name for k, (_, _, name) in enumerate(CASES)}
    assert all(r["quality"] >= 0.52 for r in found.values())
    by_name = {r["name"]: r for r in found.values()}
    assert by_name["胰腺导管系统"]["warnings"] == ["not_in_source"] and by_name["胰腺导管系统"]["quality"] == 0.76
    assert by_name["胃腺细胞"]["warnings"] == [] and by_name["肝门"]["quality"] == 0.7


def test_loose_endings_are_cut(spark):
    rows = spark.createDataFrame([("肝门在及", "肝门在右侧"), ("肝门的", "")], "raw string, text string")
    assert [(r["name"], r["quality"], r["warnings"]) for r in terms.validated(rows, "raw", "text").collect()] == [("肝门", 0.62, ["trimmed_fragment"])] * 2


#: What is cut before a known word; a name that begins with it is cut up to the next one.
HEADS = [("成熟的红细胞", "红细胞"), ("红细胞", "红细胞"), ("红细胞和白细胞", "红细胞"), ("红细胞旁白细胞的动脉", "白细胞的动脉"), ("测定用膜片钳", "膜片钳"), ("膜片钳与电压钳", "电压钳"), ("甲由乙由上皮细胞", "上皮细胞"), ("肝 脏（右", "肝脏"), ("肝）脏（右", "肝）脏（右"), ("", ""), ("  ", "")]


@pytest.mark.parametrize(("raw", "name"), HEADS)
def test_clean_name(spark, raw, name):
    assert spark.createDataFrame([(raw,)], "x string").select(terms.clean_name(F.col("x")).alias("n")).first()["n"] == name


def frame(spark, text):
    return spark.createDataFrame([("b", "c", text, text)], "book_id string, chapter_id string, content string, graph_text string")


def test_candidates_of_a_chapter(spark):
    text = "胆囊管（cystic duct）连接胆总管。胃蛋白酶是指胃腺分泌的酶。图3（见下）所示。胆囊管（cystic duct）较短。\n一、胆囊动脉\n胆囊管很短，胆囊管也细"
    found = terms.chapter_candidates(frame(spark, text)).orderBy("cand_ord").collect()
    got = [(r["name"], r["method"], r["source_text"]) for r in found]
    assert ("胆囊管", "term_annotation", "胆囊管（cystic duct）连接胆总管。") in got and ("胆囊管", "term_annotation", "胆囊管（cystic duct）较短。") in got
    # A definition begins with the sentence end before it, so what is around it begins a sentence earlier.
    assert ("胃蛋白酶", "definition_sentence", "胆囊管（cystic duct）连接胆总管。胃蛋白酶是指胃腺分泌的酶。") in got
    assert ("胆囊动脉", "heading", "一、胆囊动脉") in got and [n for n, m, _ in got if m == "frequency_term"]
    assert all(r["quality"] >= 0.52 for r in found) and not any(r["name"].startswith("图") for r in found)
    empty = terms.chapter_candidates(spark.createDataFrame([("b", "c", None, None), ("b", "d", "", "")], frame(spark, "").schema))
    assert empty.count() == 0


def test_matches_have_their_places(spark):
    texts = ["", "ab", "xaby aab", "a" * 5, "ab\x01ab\x03b", "中ab。ab"]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", terms.matches(F.col("x"), "a+(b)").alias("m"))
    for r in rows.collect():
        assert [(m["word"], m["start"], m["end"]) for m in r["m"]] == [(m[1], *m.span()) for m in re.finditer("a+(b)", r["x"])]


@pytest.mark.parametrize("text", ["一。二三。四", "甲乙丙", "甲\n乙丙；丁", "x" * 400, "。x" + "y" * 300])
def test_sentence_around(spark, text):
    for start in range(0, len(text), 3):
        end = min(start + 2, len(text))
        left = max(text.rfind(x, 0, start) for x in "。\n；")
        rights = [k for x in "。\n；" if (k := text.find(x, end)) >= 0]
        want = text[left + 1 : min(rights, default=min(len(text), end + 180)) + 1].strip()
        got = spark.createDataFrame([(text,)], "x string").select(terms.sentence_around(F.col("x"), F.lit(start), F.lit(end)).alias("s")).first()["s"]
        assert got == want
        if start > 12:
            break


def test_question_terms(spark):
    chunks = spark.createDataFrame([("k", "胃蛋白酶（pepsin）位于胃液。观察了很多动物。胃蛋白酶是指一类酶。"), ("n", None)], "chunk_id string, text string")
    found = [r["term"] for r in terms.chunk_terms(chunks).orderBy("chunk_id", "pos").collect()]
    assert "胃蛋白酶" in found and not any(x.startswith("观察") for x in found) and len(found) == len(set(found))
    names = spark.createDataFrame([("细胞", ""), ("肝门静脉注射", "肝门静脉"), ("肝门静脉注射", "别的")], "name string, source string")
    assert [r["t"] for r in names.select(terms.graph_term(F.col("name"), F.col("source")).alias("t")).collect()] == [None, "肝门静脉", None]


def test_keywords(spark):
    found = terms.keywords(frame(spark, "胆囊管连接胆总管，胆囊管，胆囊管，胃腺，胃腺。因素分析")).collect()
    assert [(r["rank"], r["word"], r["n"]) for r in found][:1] == [(1, "胆囊管", 3)]


def test_scores_and_sentences(spark):
    rows = spark.createDataFrame([("血压",), ("胆囊管",), ("第3级动脉瘤",), ("x",)], "x string")
    c = F.col("x")
    got = {r["x"]: (r["t"], r["s"], r["f"]) for r in rows.select("x", terms.trimmed_to_suffix(c).alias("t"), terms.name_score(c, F.lit(1)).alias("s"), terms.first_sentence_with(F.concat(F.lit("短。前面一句话里有"), c, F.lit("这个词。后面")), c).alias("f")).collect()}
    assert got == {
        "血压": ("血压", 0.8, "前面一句话里有血压这个词"), "胆囊管": ("胆囊管", 0.76, "前面一句话里有胆囊管这个词"),
        "第3级动脉瘤": ("第3级动脉", 0.36, "前面一句话里有第3级动脉瘤这个词"), "x": ("x", 0.5, "前面一句话里有x这个词"),
    }
