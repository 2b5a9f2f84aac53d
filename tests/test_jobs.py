"""Jobs on small literal tables, and properties that hold for any input."""

import hashlib
import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tomeweave.functions import grams
from tomeweave.functions import text as T
from tomeweave.operators import chapters as P
from tomeweave.operators import integrate as I
from tomeweave.operators import dictionary, knowledge, questions, relations, retrieval, scan, simjoin
from tomeweave.operators.chunks import RetrievalConfig, build_chunks, index_status, split_text, write_index
from tomeweave.operators.places import placed
from tomeweave.plans import corpus
from tomeweave.plans.retrieval import CONFIG
from tomeweave.sources import files
from tomeweave.streaming import intake

CHUNK = "chunk_id string, book_id string, chapter_id string, chapter string, page long, text string"


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_text_rules(spark):
    assert one(spark, "肾上 腺素  and hyper- tension", T.normalize_pdf_line) == "肾上腺素 and hypertension"
    assert one(spark, "血液\n系统（ 一 ）", T.normalize_text_flow) == "血液系统（一）"
    assert one(spark, "第三章 血液", T.is_chapter_heading) and not one(spark, "第三章 " + "血" * 60, T.is_chapter_heading)
    assert one(spark, "CHAPTER 7: On cells", T.is_chapter_heading)
    assert one(spark, "12 ｜ 血液", T.is_running_header) and one(spark, "XIV", T.is_running_header) and not one(spark, "第三章 血液", T.is_running_header)
    assert one(spark, "a\n第 12 页\n7\nb", T.clean_page_text) == "a\nb"
    assert one(spark, "Leuko-cyte", T.merge_key) == "白细胞" and one(spark, "a_B c", T.normalize_name) == "a_bc"
    assert one(spark, "x/生理学.v2.txt", T.infer_title) == "生理学.v2" and one(spark, "a/b?c", T.safe_filename) == "a_b_c"


def test_sections(spark):
    docs = spark.createDataFrame([("m", "stem", "intro\n# One\nbody\n\n## Empty\n### Two\nmore\n"), ("n", "stem", "# only"), ("e", "stem", "")], "book_id string, title string, text string")
    rows = P.split_sections(docs, True).orderBy("book_id", "chapter_id").collect()
    assert [(r["book_id"], r["chapter_id"], r["title"], r["content"]) for r in rows] == [
        ("e", "ch_001", "stem", ""), ("m", "ch_001", "stem", "intro"), ("m", "ch_002", "One", "body"), ("m", "ch_003", "Two", "more"), ("n", "ch_001", "stem", "# only"),
    ]


def test_pages(spark):
    pages = [("b", "t", 1, "第一章 绪论\nx"), ("b", "t", 2, "y"), ("b", "t", 3, "第二章 细胞\nz"), *[("c", "t", k, f"p{k}") for k in range(1, 46)]]
    rows = P.chapters_from_pages(spark.createDataFrame(pages, "book_id string, title string, page_no long, text string")).orderBy("book_id", "chapter_id").collect()
    assert [(r["title"], r["page_start"], r["page_end"]) for r in rows] == [("t", 1, 2), ("第二章 细胞", 3, 3), ("t 第1部分", 1, 20), ("t 第2部分", 21, 40), ("t 第3部分", 41, 45)]


def test_front_matter_is_not_useful(spark):
    rows = [("b", "c1", 1, "03_生理学_3", 1, "前言"), ("b", "c2", 2, "第三章 血液", 91, "前言与血液"), ("b", "c3", 3, "x", 2, "教材编写")]
    frame = spark.createDataFrame(rows, "book_id string, chapter_id string, chapter_ord long, title string, page_start long, content string")
    assert [r["chapter_id"] for r in P.useful_chapters(frame).collect()] == ["c2"]


def test_chunks_rejoin_to_the_text(spark):
    r = random.Random(0)
    texts = ["".join(r.choice("ab中 \n") for _ in range(n)) for n in (0, 1, 49, 50, 51, 90, 91, 500)]
    frame = spark.createDataFrame([(x,) for x in texts], "x string")
    for row in frame.select("x", split_text(F.col("x"), 50, 10).alias("c"), T.strip(F.regexp_replace("x", r"\n{3,}", "\n\n")).alias("plain")).collect():
        rejoined = "".join(c if k == 0 else c[10:] for k, c in enumerate(row["c"]))
        assert rejoined == row["plain"] and all(len(c) <= 50 for c in row["c"])
    with pytest.raises(ValueError):
        split_text(F.lit("x"), 10, 10)


def test_a_long_text_is_split_in_linear_time(spark):
    frame = spark.createDataFrame([("some words and more\n" * 50_000,)], "x string").cache()
    frame.select(F.size(split_text(F.col("x"), 50, 10))).collect()
    began = time.perf_counter()
    n = frame.select(F.size(split_text(F.col("x"), 500, 100)).alias("n")).first()["n"]
    assert n == 2500 and time.perf_counter() - began < 2


def test_enriched_edges_equal_their_sql(spark, tmp_path):
    import duckdb

    from tomeweave.plans import knowledge as plan

    parts = ["the ere and sh", "thesh and that, er for on", "tion with ere ing", "re and there is ing ent", "ea st er, and in ing"]
    r = random.Random(9)
    rows = [(k, ". ".join(r.choice(parts) for _ in range(12)), "en", f"s{k % 2}", 1) for k in range(14)] + [(20, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = plan.g12_enriched_in_documents(spark, str(tmp_path))
    names = ["book_id", "source", "target", "relation_type", "description"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({plan.G12_SQL})").fetchall()
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want) and want


def test_the_whole_integration_merges_keeps_and_removes(spark):
    names = [("a", "Cell membrane"), ("b", "cell membrane"), ("a", "liver protein synthesis"), ("b", "liver protein syntheses"), ("a", "thermodynamics"), ("b", "optics")]
    rows = [(f"n{k}", k, name, f"{name} text", "", book, book, "c", 1, "x", 0.5) for k, (book, name) in enumerate(names)]
    nodes = spark.createDataFrame(rows, "node_id string, node_ord long, name string, definition string, source_text string, book_id string, book_title string, chapter string, page int, category string, quality_score double")
    edges = spark.createDataFrame([("n0", "n4", "contains", 1), ("n1", "n4", "contains", 2), ("n0", "n1", "parallel", 3), ("n2", "n5", "applies_to", 4)], "source string, target string, relation_type string, edge_ord long")
    every = I.run_integration(nodes, edges, 10_000)
    assert sorted((d["action"], d["n_affected"]) for d in every.decisions.collect()) == [("keep", 1), ("keep", 1), ("merge", 2), ("merge", 2)]
    assert every.edges.count() == 2 and every.stats.first()["merge_count"] == 2
    few = I.run_integration(nodes, edges, 200)
    kept = {r["node_id"] for r in few.nodes.collect()}
    assert few.decisions.filter("action = 'remove'").count() == 4 - len(kept) > 0
    assert all(e["source"] in kept and e["target"] in kept for e in few.edges.collect())
    left = files.remove_book({"nodes": nodes, "edges": edges}, "b")
    assert [(e["source"], e["target"]) for e in left["edges"].collect()] == [("n0", "n4")]
    again = I.run_integration(left["nodes"], left["edges"], 10_000)
    assert {d["action"] for d in again.decisions.collect()} == {"keep"} and again.nodes.count() == 3
    assert I.run_integration(nodes.limit(0), edges.limit(0), 0).nodes.count() == 0


def node(k, name, source, chapter="c", method="term_annotation", book="b"):
    return (f"n{k}", book, chapter, name, name + "的定义。", source, "核心概念", chapter, method, k)


NODES = "node_id string, book_id string, chapter_id string, name string, definition string, source_text string, category string, chapter string, extraction_method string, node_ord long"


def test_relations(spark):
    system = spark.createDataFrame([node(1, "血液系统", "血液系统包括红细胞和白细胞。"), node(2, "红细胞", "血液系统包括红细胞和白细胞。")], NODES)
    none = spark.createDataFrame([], "book_id string, source string, target string, relation_type string, description string, edge_ord long")
    added = relations.enrich_relations(system, none).collect()
    assert [(e["source"], e["target"], e["relation_type"]) for e in added] == [("n1", "n2", "contains")]
    cells = spark.createDataFrame([node(1, "红细胞", "红细胞和白细胞（white cell）。"), node(2, "白细胞", "白细胞（white cell）。")], NODES)
    assert [e["relation_type"] for e in relations.chapter_edges(cells).collect()] == ["parallel"]


def test_chapter_nodes(spark):
    rows = [("b", "ch_1", 1, "第三章 血液", 91, "肝细胞（hepatocyte）是肝的主要成分。血浆蛋白（plasma protein）由肝细胞合成。")]
    chapters = spark.createDataFrame(rows, "book_id string, chapter_id string, chapter_ord long, title string, page_start long, content string")
    assert {"肝细胞", "血浆蛋白"} <= {r["name"] for r in knowledge.chapter_nodes(chapters).collect()}


def test_leader_clusters_equal_the_plain_loop(spark):
    r = random.Random(2)
    n, pairs = 40, sorted({(a, b) for a, b in ((r.randrange(40), r.randrange(40)) for _ in range(90)) if a < b})
    nodes = spark.createDataFrame([(k, k, str(k)) for k in range(n)], "node_id long, node_ord long, book_id string")
    found = {x["node_id"]: x["leader_id"] for x in simjoin.leader_clusters(nodes, spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = {}
    for k in range(n):
        if k not in want:
            want[k] = k
            want.update({b: k for a, b in pairs if a == k and b not in want})
    assert found == want


def test_similar_pairs_equal_brute_force(spark):
    r = random.Random(3)
    names = [" ".join(r.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(4)) for _ in range(40)]
    nodes = spark.createDataFrame([(k, k, str(k % 3), x, "") for k, x in enumerate(names)], "node_id long, node_ord long, book_id string, name string, definition string")
    vectors = {}
    for row in simjoin.name_vectors(nodes).collect():
        vectors.setdefault(row["node_id"], {})[row["gram"]] = row["weight"]
    dot = lambda a, b: sum(w * vectors[b].get(g, 0) for g, w in vectors[a].items())
    want = {(a, b) for a in range(40) for b in range(a + 1, 40) if a % 3 != b % 3 and dot(a, b) >= 0.62}
    assert {(x["a"], x["b"]) for x in simjoin.similar_pairs(nodes).collect()} == want


def test_copies_meet_once_and_cluster_as_if_listed(spark, monkeypatch):
    r, seen, pairs = random.Random(5), [], simjoin._pairs
    names = [" ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(2)) for _ in range(60)] + ["hot copy"] * 40
    r.shuffle(names)
    nodes = spark.createDataFrame([(k, k, f"b{r.randrange(3)}", x, "") for k, x in enumerate(names)], "node_id long, node_ord long, book_id string, name string, definition string")

    def count(own, first, threshold):
        found = pairs(own, first, threshold)
        seen.append((first.count(), found.count()))
        return found

    monkeypatch.setattr(simjoin, "_pairs", count)
    found = {x["node_id"]: x["leader_id"] for x in simjoin.clusters(nodes).collect()}
    listed = simjoin.similar_pairs(nodes)
    assert found == {x["node_id"]: x["leader_id"] for x in simjoin.leader_clusters(nodes, listed).collect()}
    books = {x["node_id"]: x["book_id"] for x in nodes.collect()}
    hot = [k for k, x in enumerate(names) if x == "hot copy"]
    got = {(x["a"], x["b"]) for x in listed.collect()}
    assert {(a, b) for a in hot for b in hot if a < b and books[a] != books[b]} <= got and all(a < b for a, b in got)
    assert all(n <= 3 * 17 and m < len(got) / 4 for n, m in seen)


def test_clusters_list_no_pairs_and_equal_the_plain_loop(spark, monkeypatch):
    """Blocks of a few nodes and grams: leaders claim nodes of their own block, of later ones, and nodes of their own book stay."""
    r = random.Random(23)
    words = ["alpha", "beta", "gamma", "delta"]
    rows = [(f"n{k:03}", k, r.choice(["a", "b", "c", None]), " ".join(r.choice(words) for _ in range(3)), r.choice(["", "text"])) for k in range(120)] + [("n999", 999, "a", "", "")]
    nodes = spark.createDataFrame(rows, "node_id string, node_ord long, book_id string, name string, definition string")
    want = {x["node_id"]: x["leader_id"] for x in simjoin.leader_clusters(nodes, simjoin.similar_pairs(nodes)).collect()}

    def listed(*_):
        raise AssertionError("all pairs are listed")

    monkeypatch.setattr(simjoin, "_pairs_of", listed)
    for most, grams in ((16, 2_000_000), (4096, 900)):
        monkeypatch.setattr(simjoin, "BLOCK_NODES", most)
        monkeypatch.setattr(simjoin, "BLOCK_GRAMS", grams)
        assert {x["node_id"]: x["leader_id"] for x in simjoin.clusters(nodes).collect()} == want
    assert len(set(want.values())) < 100


def test_remapped_edges_are_dealt_out_once_for_either_end(spark):
    edges = spark.createDataFrame([("n0", "n1", "contains", 4), ("n0", "n2", "contains", 2), ("n0", "n2", "contains", 1), ("n1", "n2", "parallel", 3), ("n1", "gone", "parallel", 5)], "source string, target string, relation_type string, edge_ord long")
    mapping = spark.createDataFrame([("n0", "m"), ("n1", "n1"), ("n2", "n1")], "node_id string, integrated_id string")
    found = I.remap_edges(edges, mapping)
    assert [tuple(x) for x in found.collect()] == [("m", "n1", "contains", 1)]
    with_joins = found._jdf.queryExecution().optimizedPlan().toString()
    assert with_joins.count("Aggregate") == 1

def test_integration_queries_group_similar_singletons(spark, monkeypatch):
    from tomeweave.plans import fusion

    names = [("a", "Cell membrane"), ("b", "cell membrane"), ("a", "liver protein synthesis"), ("b", "liver protein syntheses"), ("a", "thermodynamics")]
    rows = [(f"n{k}", k, name, f"{name} text", "", book, book, "c", 1, "x", 0.5) for k, (book, name) in enumerate(names)]
    schema = "node_id string, node_ord long, name string, definition string, source_text string, book_id string, book_title string, chapter string, page int, category string, quality_score double"
    monkeypatch.setattr(fusion, "nodes", lambda *_: spark.createDataFrame(rows, schema))
    mapped = {x["node_id"]: x["integrated_id"] for x in fusion.i7_node_map(spark, "").collect()}
    assert mapped["n0"] == mapped["n1"] != mapped["n2"] == mapped["n3"] and mapped["n4"] == "n4"
    decided = sorted((x["action"], x["n_affected"]) for x in fusion.i6_decisions(spark, "").collect())
    assert decided == [("keep", 1), ("merge", 2), ("merge", 2)]


@pytest.mark.parametrize("chars", [50, 400, 100_000])
def test_trim_equals_the_plain_loop(spark, chars):
    r = random.Random(chars)
    rows = [(f"n{k}", k, "x" * r.randint(1, 90), r.randint(1, 4)) for k in range(60)]
    frame = spark.createDataFrame([(a, b, "name", c, d) for a, b, c, d in rows], "node_id string, node_ord long, name string, definition string, frequency long")
    kept, removed = I.trim_to_compression(frame, chars)
    left, target, current, gone = sorted(rows, key=lambda x: (x[3], len(x[2]))), int(chars * 0.3), sum(len(x[2]) for x in rows), []
    if round(current / chars, 4) > 0.3 and current > target:
        least = max(1, min(len(left), target // 40)) if target else 1
        while len(left) > least and current > target:
            gone.append(left.pop(0))
            current -= len(gone[-1][2])
        if current > target:
            left = [(a, b, c[: max(1, target // len(left))], d) for a, b, c, d in left]
    assert {x["node_id"] for x in removed.collect()} == {x[0] for x in gone}
    assert {x["node_id"]: x["definition"] for x in kept.collect()} == {x[0]: x[2] for x in left}


def test_retrieval_ranks_the_concept_first(spark):
    noise = "这个概念的核心定义是什么？" * 20
    rows = [(f"chunk_{k}", "生理学", "c", "第十一章 内分泌", 360 + k, noise) for k in range(8)] + [("chunk_8", "生理学", "c", "第十一章 内分泌", 361, "肾上腺 素是肾上腺髓质分泌的激素，肾上腺素主要作用于心血管。")]
    chunks = spark.createDataFrame(rows, CHUNK)
    asked = spark.createDataFrame([(1, "肾上腺素这个概念的核心定义是什么？"), (2, "zzz")], "question_id long, question string")
    ranked = scan.retrieve(chunks, asked, CONFIG)
    assert ranked.filter("question_id = 1 AND rank = 1").first()["chunk_id"] == "chunk_8"
    found = {r["question_id"]: r for r in retrieval.answers(ranked, chunks, asked).collect()}
    assert found[1]["answer"].endswith("[生理学, 第十一章 内分泌, 第361页]") and "肾上腺素是肾上腺髓质" in found[1]["answer"]
    assert found[2]["answer"] == "当前知识库中未找到相关信息" and found[2]["citations"] == []


def test_evaluation(spark):
    text = "肾上腺素是肾上腺髓质分泌的激素。肾上腺素主要作用于心血管系统，使心率加快。"
    chapters = spark.createDataFrame([("生理学", "c1", 1, "第十一章 内分泌", 361, text)], "book_id string, chapter_id string, chapter_ord long, title string, page_start long, content string")
    chunks = build_chunks(chapters, RetrievalConfig(120, 20))
    asked = questions.generate_questions(chunks, knowledge.chapter_nodes(chapters), 3)
    first = asked.orderBy("question_id").first()
    assert first["expected_book"] == "生理学" and first["expected_page"] == 361 and first["expected_terms"] and first["answer_hint"]
    row = questions.evaluate(chunks, asked, RetrievalConfig(120, 20), "small").first()
    assert row["recall_at_5"] == 1.0 and row["citation_accuracy"] == 1.0 and row["avg_context_tokens"] > 0
    grid = questions.config_grid(spark)
    assert grid.count() == 48
    worse = spark.createDataFrame([("a", 0.5, 1.0, 1.0, 1.0), ("b", 1.0, 0.1, 0.1, 0.1)], "config_name string, recall_at_5 double, citation_accuracy double, answer_accuracy double, mrr double")
    assert questions.choose_best(worse).first()["config_name"] == "b"


def corpus_of(spark, n=40, seed=5):
    r = random.Random(seed)
    words = ["细胞膜", "红细胞", "激素", "receptor", "Cell", "membrane", "naïve", "of", "the", "a1"]
    rows = [(f"book{k % 3}", f"c{k}", k, f"第{k}章 {words[k % 4]}", 30 + k, " ".join(r.choice(words) + r.choice(["", "。", ","]) for _ in range(r.randint(0, 120)))) for k in range(n)]
    return spark.createDataFrame(rows, "book_id string, chapter_id string, chapter_ord long, title string, page_start long, content string")


def plain_scores(texts, asked, analyzer, fit_question):
    """Cosine and BM25 of every text for a question, by their formulas."""
    grams_of = grams.ANALYZERS[analyzer]
    counts, own = [Counter(grams_of(x)) for x in texts], Counter(grams_of(asked))
    fitted = [*counts, own] if fit_question else counts
    df = Counter(g for c in fitted for g in c)
    idf = {g: math.log((1 + len(fitted)) / (1 + n)) + 1 for g, n in df.items()}
    length = lambda c: math.sqrt(sum((n * idf[g]) ** 2 for g, n in c.items() if g in idf))
    dots = [sum(c[g] * n * idf[g] ** 2 for g, n in own.items() if g in c) for c in counts]
    cosine = [d / length(c) / length(own) if d else 0.0 for d, c in zip(dots, counts, strict=True)]
    words = [grams.tokens(x) for x in texts]
    found, mean = Counter(g for w in words for g in set(w)), sum(map(len, words)) / len(words)
    raw = {g: math.log(len(texts) - n + 0.5) - math.log(n + 0.5) for g, n in found.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    weight = {g: x if x >= 0 else floor for g, x in raw.items()}
    bm25 = [sum(n * weight[g] * w.count(g) * 2.5 / (w.count(g) + 1.5 * (0.25 + 0.75 * len(w) / mean)) for g, n in Counter(grams.tokens(asked)).items() if g in w) for w in words]
    return cosine, bm25


@pytest.mark.parametrize("by_join", [False, True])
@pytest.mark.parametrize("fit_question", [False, True])
def test_scan_matches_the_formulas(spark, monkeypatch, by_join, fit_question):
    """Every chunk's score under each analyzer; vector lengths come from a broadcast or from a join."""
    if by_join:
        monkeypatch.setattr(scan, "BROADCAST_GRAMS", 0)
    monkeypatch.setattr(scan, "PART_LETTERS", 2000)
    chunks = build_chunks(corpus_of(spark), RetrievalConfig(120, 20))
    rows = [(r["chunk_id"], r["text"]) for r in chunks.collect()]
    asked = [(1, "红细胞的细胞膜是什么"), (2, "Which receptor of the cell membrane"), (3, "zzz"), (4, "")]
    frame = spark.createDataFrame(asked, "question_id long, question string")
    configs = [(a, RetrievalConfig(120, 20, 4, a, 0.6, 0.4, 0.0, False, 0.005)) for a in ("char_2_5", "char_wb_2_4")]
    fitted = scan.fit(chunks.withColumn("way", F.lit("w")), ("char_2_5", "char_wb_2_4"), fit_question)
    found = {}
    for r in scan.retrieve_all(fitted, frame, {"w": configs}).orderBy("rank").collect():
        found.setdefault((r["config_name"], r["question_id"]), []).append((r["chunk_id"], round(r["score"], 7)))
    for analyzer, _ in configs:
        for number, question in asked:
            cosine, bm25 = plain_scores([x for _, x in rows], question, analyzer, fit_question)
            top = max(bm25) or 1.0
            best = sorted((-round(0.6 * c + 0.4 * b / top, 9), name) for (name, _), c, b in zip(rows, cosine, bm25, strict=True))[:4]
            assert found.get((analyzer, number), []) == [(name, round(-x, 7)) for x, name in best if -x > 0.005]


def test_grid_equals_single_evaluations(spark):
    """All configurations in one scan give the rows that each gives alone."""
    chapters = corpus_of(spark)
    asked = spark.createDataFrame(
        [(f"q{k}", q, "book1", f"第{k}章 {w}", "", [w]) for k, (q, w) in enumerate([("红细胞是什么", "细胞膜"), ("细胞膜的receptor", "红细胞"), ("激素 membrane", "激素"), ("none at all", "receptor"), ("Cell naïve", "receptor")])],
        "question_id string, question string, expected_book string, expected_chapter string, expected_chunk_id string, expected_terms array<string>",
    )
    grid = questions.grid()
    assert len({(c.chunk_size, c.overlap) for c in grid}) == 12 and len(grid) == 48
    rows = questions.evaluate_grid(chapters, asked, grid)
    assert rows.count() == 48 and {r["config_name"] for r in rows.collect()} == {questions.config_name(c) for c in grid}
    together = {r["config_name"]: r.asDict() for r in questions.evaluate_grid(chapters, asked, [grid[0], grid[3], grid[21], grid[46]]).collect()}
    for c in (grid[0], grid[3], grid[46]):
        alone = questions.evaluate(build_chunks(chapters, c), asked, c, questions.config_name(c)).first().asDict()
        assert alone == together[questions.config_name(c)]


def test_names_in_texts(spark, monkeypatch):
    r = random.Random(9)
    names = ["a", "ab", "abc", "bc", "b b", "", "细胞", "红细胞", "x" * 40, None, "ab"]
    texts = [None, "", *("".join(r.choice("abc 细胞红x") for _ in range(r.randint(0, 80))) for _ in range(60)), "x" * 200]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    for letters in (4_000_000, 12):
        monkeypatch.setattr(dictionary, "PART_LETTERS", letters)
        found = dictionary.dictionary_join(rows, "text", spark.createDataFrame([(x,) for x in names], "name string"))
        want = Counter((k, n, t.find(n)) for k, t in enumerate(texts) if t is not None for n in {x for x in names if x is not None} if n in t)
        assert Counter((x["k"], x["name"], x["start"]) for x in found.collect()) == want


def test_grams():
    assert grams.char_ngrams("Ab  c", 2, 3) == ["ab", "b ", " c", "ab ", "b c"]
    assert grams.char_wb_ngrams("a bc", 2, 4) == [" a", "a ", " a ", " b", "bc", "c ", " bc", "bc ", " bc "]
    assert grams.tokens("Na 细胞膜") == ["na", "细", "胞", "膜", "细胞", "胞膜", "细胞膜"]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("好".encode() + b"\xff x")
    (tmp_path / "b.md").write_text("# T\nx")
    rows = {r["title"]: r["text"] for r in files.read_corpus(spark, str(tmp_path)).collect()}
    assert rows == {"a": "好 x", "b": "# T\nx"}
    books = spark.createDataFrame([("b1", 1), ("b2", 2)], "book_id string, x long")
    files.write_tables({"books": books}, f"{tmp_path}/out")
    again = files.read_tables(spark, f"{tmp_path}/out", ["books"])
    assert sorted(map(tuple, again["books"].select("book_id", "x").collect())) == [("b1", 1), ("b2", 2)]
    assert [r["book_id"] for r in files.remove_book(again, "b1")["books"].collect()] == ["b2"]
    (tmp_path / "c.exe").write_text("x")
    with pytest.raises(ValueError):
        files.read_corpus(spark, str(tmp_path))


def test_a_write_that_dies_leaves_the_old_state(spark, tmp_path):
    path, schema = f"{tmp_path}/state", "book_id string, x long"
    with pytest.raises(ValueError):
        files.read_tables(spark, path, ["books"])
    assert files.read_tables(spark, path, ["books"], {"books": {"x": ("long", 0)}})["books"].count() == 0
    files.write_tables({"books": spark.createDataFrame([("b1", 1)], schema), "notes": spark.createDataFrame([(1,)], "n long")}, path)

    @F.udf("long")
    def dies(x):
        raise RuntimeError("killed")

    broken = spark.createDataFrame([(5,)], "n long").select(dies("n").alias("n"))
    with pytest.raises(Exception, match="killed"):
        files.write_tables({"books": spark.createDataFrame([("b2", 2)], schema), "notes": broken}, path)
    again = files.read_tables(spark, path, ["books", "notes", "marks"], {"books": {"title": ("string", "none"), "x": ("long", 9)}, "marks": {"m": ("int", 0)}})
    assert [(r["book_id"], r["x"], r["title"]) for r in again["books"].collect()] == [("b1", 1, "none")]
    assert again["notes"].first()["n"] == 1 and again["marks"].columns == ["m"] and again["marks"].count() == 0
    files.write_tables({"books": spark.createDataFrame([("b3", 3)], schema)}, path)
    now = files.read_tables(spark, path, ["books", "notes"], {"notes": {"n": ("long", 0)}})
    assert now["books"].first()["book_id"] == "b3" and now["notes"].count() == 0


def test_a_parser_that_raises_fails_its_row_alone(spark, tmp_path):
    def parser(text):
        if "bad" in text:
            raise ValueError(f"bad text of {len(text)}")
        if text == "odd":
            raise KeyError()
        return text.upper()

    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None), (4, " "), (5, "odd"), (6, "b")], "k long, content string")
    kept = files.quarantine(files.parsed(rows, parser), f"{tmp_path}/bad")
    assert sorted((r["k"], r["value"]) for r in kept.collect()) == [(1, "A"), (6, "B")]
    assert {r["k"]: r["error"] for r in spark.read.parquet(f"{tmp_path}/bad").collect()} == {2: "bad text of 3", 3: "no text", 4: "no text", 5: "KeyError"}


def test_lines_of_files_over_several_splits(spark, tmp_path):
    """A file that falls into many splits gives the chapters that it gives as one value, with bytes that are no UTF-8 anywhere."""
    r, folder = random.Random(3), tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    texts = {}
    for k in range(4):
        rows = [b"# head %d" % i if r.random() < 0.1 else r.choice([b"", "\u597d\u7684 text".encode(), b"\xff\xe5 x", b"line " * r.randint(1, 9)]) for i in range(60 * k)]
        (folder / f"{k}.md").write_bytes(b"\n".join(rows))
        texts[f"{k}.md"] = b"\n".join(rows).decode(errors="ignore")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128")
    try:
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 10
        lines = files.read_lines(spark, f"{tmp_path}/in")
        found = {}
        for x in lines.orderBy("filename", "pos").collect():
            found.setdefault(x["filename"], []).append((x["pos"], x["line"]))
        chapters = P.split_line_sections(lines, True)
        got = {tuple(x) for x in chapters.drop("book_id").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {k: "\n".join(x for _, x in v).rstrip("\n") for k, v in found.items()} == {k: v.rstrip("\n") for k, v in texts.items() if v}
    assert all([p for p, _ in v] == list(range(len(v))) for v in found.values())
    whole = P.split_sections(files.read_corpus(spark, f"{tmp_path}/in").filter("text <> ''"), True)
    assert got == {tuple(x) for x in whole.drop("book_id").collect()} and len(got) > 3


def test_query_of_lines_matches_its_sql_on_odd_documents(spark, tmp_path):
    """Carriage returns, a text's own U+FFFD, zeros, and ids that are null or below zero."""
    texts = [None, "", "\n", "one\ntwo\n", "a\r\nb\rc", "own � and �a", "\0a\0b�\0", "same\nsame", "好 x\n\n "]
    rows = [(d, texts[k % len(texts)]) for k, d in enumerate([*range(-12, 30), None, None])]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for d, text in rows:
        file = None if d is None else int(math.fmod(d, 7))
        want.update((file, hashlib.sha1(x.encode()).hexdigest()) for x in (text or "").split("\n"))
    got = corpus.s1_read_lines(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r["file"], r["digest"]): r["n"] for r in got} == want


def test_documents_are_parsed_in_the_stream(spark, tmp_path):
    docs = spark.createDataFrame([(f"b{k}", f"book {k}", "" if k == 3 else f"# one\n{'x' * 700}\n# two\n{k}") for k in range(6)], "book_id string, title string, text string")
    for half in (docs.filter("book_id < 'b3'"), docs.filter("book_id >= 'b3'")):
        half.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        rows = intake.arriving(spark, f"{tmp_path}/in", docs.schema)
        intake.append_documents(rows, f"{tmp_path}/out", f"{tmp_path}/bad", f"{tmp_path}/seen", RetrievalConfig()).awaitTermination(120)
    columns = ["chunk_id", "book_id", "chapter", "text"]
    read = lambda: sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select(columns).collect()))
    want = sorted(map(tuple, build_chunks(P.split_sections(docs.filter("text <> ''"), True), RetrievalConfig()).select(columns).collect()))
    assert read() == want and [x["book_id"] for x in spark.read.parquet(f"{tmp_path}/bad").collect()] == ["b3"]
    # The last batch fails after its write and comes again.
    intake.write_batch(docs.filter("book_id >= 'b3'"), 1, f"{tmp_path}/out", f"{tmp_path}/bad", RetrievalConfig(), True)
    assert read() == want and spark.read.parquet(f"{tmp_path}/bad").count() == 1


def test_stream_intake(spark, tmp_path):
    chapters = spark.createDataFrame([("b", "c1", 1, "t", 1, "x" * 600)], "book_id string, chapter_id string, chapter_ord long, title string, page_start long, content string")
    for _ in range(2):
        chapters.write.mode("append").parquet(f"{tmp_path}/in")
        rows = intake.arriving(spark, f"{tmp_path}/in", chapters.schema)
        intake.append_chunks(rows, f"{tmp_path}/out", f"{tmp_path}/checkpoint", RetrievalConfig()).awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4


def test_entry_points():
    import __spark_entry__

    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 90


def test_similar_classes_expand_to_the_pairs(spark):
    r = random.Random(17)
    texts = ["red cell membrane", "red cell membranes", "a red cell membrane", "optics of lenses", "thermodynamics", "", "optic of lenses"]
    rows = [(f"n{k:02}", k, r.choice(["a", "b", "c", None]), r.choice(texts), "") for k in range(60)]
    nodes = spark.createDataFrame(rows, "node_id string, node_ord long, book_id string, name string, definition string")
    members, pairs = simjoin.similar_classes(nodes)
    of = {x["node_id"]: x["class_id"] for x in members.collect()}
    linked = {(x["a"], x["b"]) for x in pairs.collect()}
    linked |= {(b, a) for a, b in linked} | {(of[n], of[n]) for n, _, _, t, _ in rows if t}
    want = {(x["a"], x["b"]) for x in simjoin.similar_pairs(nodes).collect()}
    expanded = {(x, y) for x, i, book, _, _ in rows for y, j, other, _, _ in rows if i < j and book and other and book != other and (of[x], of[y]) in linked}
    assert expanded == want and want
    links = Counter(n for pair in want for n in pair)
    assert {x["node_id"]: x["n_links"] for x in members.collect()} == {n: links[n] for n, *_ in rows}
    assert all(of[n] == min(m for m, _, _, u, _ in rows if u == t) for n, _, _, t, _ in rows)


@pytest.mark.parametrize("n", [0, 1, 500])
def test_places_equal_a_plain_loop(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice(["a", "a", "b", "c", None]), i, rng.randrange(40), rng.choice([None, -2, 1, 3]), "replaced") for i in range(n)]
    frame = spark.createDataFrame(rows, "g string, i int, o int, v int, place string")
    found = {r["i"]: (r["place"], r["group_rows"], r["total"]) for r in placed(frame, ["g"], ["o", "i"], {"total": F.col("v")}).collect()}
    expected, sizes = {}, Counter(r[0] for r in rows)
    seen, totals = Counter(), Counter()
    for g, i, _, v, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        seen[g] += 1
        totals[g] += v or 0
        expected[i] = (seen[g], sizes[g], totals[g])
    assert found == expected


def test_a_large_group_lies_in_several_ranges(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"), (-F.col("id")).alias("o"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = placed(rows, ["g"], ["o"])
        ranges = rows.repartitionByRange(F.col("g"), F.col("o")).filter("g = 'hot'").select(F.spark_partition_id()).distinct().count()
        wrong = out.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("o"))).filter("n <> place").count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranges > 1 and wrong == 0 and out.count() == 20_000


def test_index_status_has_the_time_of_the_index(spark, tmp_path):
    path = str(tmp_path / "index")
    assert index_status(spark, path).collect() == [(0, 0, None)]
    pages = spark.createDataFrame([("b", "c", "t", 1, "x" * 1200)], "book_id string, chapter_id string, title string, page_start int, content string")
    write_index(build_chunks(pages, RetrievalConfig()), path, F.lit("2024-05-06 07:08:09").cast("timestamp"))
    assert [(r[0], r[1], str(r[2])) for r in index_status(spark, path).collect()] == [(1, 3, "2024-05-06 07:08:09")]
    write_index(build_chunks(pages.limit(0), RetrievalConfig()), path)
    books, chunks, at = index_status(spark, path).first()
    assert (books, chunks) == (0, 0) and at is not None


def test_states_keep_types_and_empty_tables(spark, tmp_path):
    path = str(tmp_path / "state")
    books = spark.createDataFrame([("007", 1), ("010", 2)], "book_id string, n int")
    files.write_tables({"books": books, "none": books.limit(0)}, path)
    read = files.read_tables(spark, path, ["books", "none"])
    assert sorted((r["book_id"], r["n"]) for r in read["books"].collect()) == [("007", 1), ("010", 2)]
    assert read["none"].collect() == [] and sorted(read["none"].columns) == ["book_id", "n"]


def test_tokens_as_numbers_are_those_of_one_text():
    r = random.Random(31)
    texts = ["".join(r.choice("abzAZ09 .,-\n血液细胞İKß一鿿龥") for _ in range(r.randrange(40))) for _ in range(300)] + ["", " "]
    rows, numbers = scan.Numbers()(scan.TOKENS, texts)
    names: dict = {}
    for k, text in enumerate(texts):
        want, got = Counter(grams.tokens(text)), Counter(numbers[rows == k].tolist())
        assert sorted(want.values()) == sorted(got.values())
        for token in want:
            alone = scan.Numbers()(scan.TOKENS, [token])[1].tolist()
            assert set(alone) <= set(got) and names.setdefault(tuple(sorted(alone)), token) == token


@pytest.mark.parametrize("kind", ["char_2_5", "char_wb_2_4", scan.TOKENS])
def test_tallies_are_sums_over_texts(kind, monkeypatch):
    """Grams of each text, and texts of each gram however often a task writes what it holds."""
    import pandas as pd

    r = random.Random(37)
    texts = ["".join(r.choice("ab c\n血") for _ in range(r.randrange(30))) for _ in range(60)] + ["", "a"]
    make = scan.Numbers()
    want = Counter((n, t) for t, n in zip(*(x.tolist() for x in make(kind, texts)), strict=True))
    numbers, rows, often = make.tallied(kind, texts)
    assert Counter(dict(zip(zip(numbers.tolist(), rows.tolist(), strict=True), often.tolist(), strict=True))) == want and len(numbers) == len(want)
    monkeypatch.setattr(scan, "BATCH_LETTERS", 100)
    for pending, held in ((4_000_000, 4_000_000), (50, 60)):
        monkeypatch.setattr(scan, "PENDING", pending)
        monkeypatch.setattr(scan, "HELD", held)
        frame = pd.DataFrame({"way": ["v", "w"] * 31, "chunk_id": [f"c{k}" for k in range(62)], "text": texts})
        found, total = Counter(), 0
        for part in scan._counting((kind,), 3)(iter([frame])):
            total += part["total"].sum()
            for way, packed, counts in zip(part["way"], part["numbers"], part["counts"], strict=True):
                found.update(dict(zip(((way, x) for x in scan._unpacked(packed).tolist()), scan.np.frombuffer(counts, scan.np.int64).tolist(), strict=True)))
        assert found == Counter(("vw"[t % 2], n) for n, t in want) and total == sum(want.values())


def test_frequencies_are_broadcast_in_groups_of_ways(monkeypatch):
    monkeypatch.setattr(scan, "BROADCAST_GRAMS", 10)
    together, alone = scan._runs([("a", 0, 4), ("b", 0, 3), ("b", 1, 3), ("c", 0, 2), ("d", 0, 6), ("d", 1, 4), ("d", 2, 5)])
    assert together == [["a", "b"], ["c"]] and alone == {"d": [(0, 1), (2, 2)]}


def test_ranked_rows_meet_their_texts_without_dealing_out_chunks(spark, monkeypatch):
    ranked = spark.createDataFrame([(1, 1, "c1"), (1, 2, "c2"), (2, 1, "c1")], "question_id long, rank long, chunk_id string")
    chunks = spark.createDataFrame([("c1", "x"), ("c2", "y"), ("c3", "z")], "chunk_id string, text string")
    for most in (3, 2):
        monkeypatch.setattr(retrieval, "BROADCAST_ROWS", most)
        found = retrieval.with_texts(ranked, chunks, ["chunk_id"], ["text"])
        assert {(x["question_id"], x["rank"], x["text"]) for x in found.collect()} == {(1, 1, "x"), (1, 2, "y"), (2, 1, "x")}
        assert ("broadcast" in found._jdf.queryExecution().logical().toString()) == (most == 3)


def test_expected_passages_are_looked_for_once(spark, monkeypatch):
    from tomeweave.plans import knowledge as plans

    monkeypatch.setattr(plans, "questions", lambda *_: spark.createDataFrame([(1, "red cell"), (2, "no such words")], "question_id long, question string"))
    docs = [("a", "ch_2", 2, "Two", "a red cell membrane"), ("b", "ch_1", 1, "One", "the red cell")]
    monkeypatch.setattr(plans, "chapters", lambda *_: spark.createDataFrame(docs, "book_id string, chapter_id string, chapter_ord long, title string, content string"))
    found = plans._expected(spark, "")
    assert [(x["question_id"], x["expected_chapter"]) for x in found.collect()] == [(1, "One")]
    assert "ArrowEvalPython" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_each_document_is_a_file_in_one_folder(spark, tmp_path, monkeypatch):
    docs = [(1, "a\nb"), (2, ""), (3, None), (4, "a\nb"), (5, "c\n")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus, "_written", lambda *_: f"{tmp_path}/corpus")
    found = {(x["suffix"], x["digest"]): x["n"] for x in corpus.s1_read_corpus(spark, str(tmp_path)).collect()}
    assert found == Counter((".txt", hashlib.sha1(((text or "") + "\n").encode()).hexdigest()) for _, text in docs)
    files = [x for x in (tmp_path / "corpus").rglob("part-*.txt") if x.stat().st_size]  # a task without rows may leave an empty file, which holds no document
    assert len(files) == 5 and all(x.parent == tmp_path / "corpus" for x in files)
