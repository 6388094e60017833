"""Rules without SQL: sources, chapters, context, registries, streams."""

import io
import json
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docquarry import pipelines, registry
from docquarry.functions import text as T
from docquarry.operators import chapters, chunks, context, strategies
from docquarry.sources import files
from docquarry.streaming import windows


def column(spark, expression, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expression.alias("x")).first().x


def test_files_by_suffix(spark, tmp_path):
    word = io.BytesIO()
    with zipfile.ZipFile(word, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{files.WORD[1:-1]}"><w:body><w:p><w:r><w:t>One</w:t><w:t> two</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Three</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "a.TXT").write_bytes(b"\xef\xbb\xbfa\xffb\n" + b"line\n" * 85)
    (tmp_path / "b.docx").write_bytes(word.getvalue())
    (tmp_path / "c.pdf").write_bytes(b"p1|  |p3")
    got = {r.path[-5:]: r for r in files.read_files(spark, str(tmp_path), lambda d: d.decode().split("|")).collect()}
    assert got["a.TXT"].text.startswith("a\ufffdb\n") and (got["a.TXT"].page_count, got["a.TXT"].line_count) == (2, 86)
    assert got[".docx"].text == "One two\n\nThree" and got["c.pdf"].text == "p1\n\np3"
    assert sorted(r.name for r in files.listing(spark, str(tmp_path)).collect()) == ["a.TXT", "b.docx", "c.pdf"]
    with pytest.raises(ValueError, match="unsupported"):
        files.parse("x/y.exe", b"")
    with pytest.raises(ValueError, match="unsupported"):
        files.parse("x.d/noname", b"")


def test_broken_files_become_error_rows(spark, tmp_path):
    for name, data in (("a.txt", b"fine"), ("b.docx", b"no archive"), ("c.pdf", b"p1|p2"), ("d.pdf", b"broken"), ("e.exe", b"x"), ("f.md", b" "), ("g.txt", b"")):  # Spark gives no row for g.txt
        (tmp_path / name).write_bytes(data)

    def strict(data):
        if b"|" not in data:
            raise OSError("no pages")
        return ["", " "]

    def plain(data):
        if data == b"broken":
            raise OSError("damaged")
        return data.decode().split("|")

    got = {r.path[-5:]: r for r in files.read_files(spark, str(tmp_path), [strict, plain], errors=True).collect()}
    assert len(got) == 6 and got["a.txt"].text == "fine" and got["a.txt"].error is None
    assert (got["c.pdf"].text, got["c.pdf"].page_count, got["c.pdf"].error) == ("p1\n\np2", 2, None)
    assert got["/f.md"].text == " " and got["/f.md"].error is None
    assert {n: r.error.split(":")[0] for n, r in got.items() if r.error} == {".docx": "BadZipFile", "d.pdf": "OSError", "e.exe": "ValueError"}
    assert got["d.pdf"].text is None and got["d.pdf"].page_count is None and got["d.pdf"].error == "OSError: damaged"
    assert files.first_pages(b"x|y", [strict]) == ["", " "]
    with pytest.raises(OSError, match="damaged"):
        files.first_pages(b"broken", [strict, plain])


def test_question_files_and_sets(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps(["one?", {"question": " two? "}, ""]))
    (tmp_path / "q.txt").write_text("# head\n\n one? \ntwo?\n")
    for name in ("q.json", "q.txt"):
        assert sorted(r.question for r in files.question_file(spark, str(tmp_path / name)).collect()) == ["one?", "two?"]
    (tmp_path / "set.json").write_text(json.dumps([{"question_id": "q1", "question": "a", "relevant_chunks": ["c1", "c2"]}, {"question_id": "q0", "question": "b", "relevant_chunks": ["c2"]}]))
    corpus, queries, qrels = files.custom_set(spark, str(tmp_path / "set.json"))
    assert dict(map(tuple, corpus.collect())) == {"c1": "a", "c2": "b"} and queries.count() == 2 and qrels.count() == 3
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text('{"_id": "d", "title": "T", "text": "x"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q", "text": "x"}\n')
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq\td\t2\n")
    assert [d.count() for d in files.evaluation_set(spark, str(tmp_path))] == [1, 1, 1]
    files.write_report(queries, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2


def test_page_sources(spark):
    pages = spark.createDataFrame([(1, 2, " b "), (1, 1, "a"), (1, 3, "  ")], "doc int, page int, text string")
    assert files.joined_pages(pages).first().text == "a\n\nb"
    regions = spark.createDataFrame([(1, 1, "bad", 0.2), (1, 2, "good", 0.9), (1, 3, "poor", 0.1)], "doc int, n int, text string, confidence double")
    answers = spark.createDataFrame([(1, "[1] better\n[2] unasked")], "doc int, answer string")
    assert {r.n: r.text for r in files.replaced_regions(regions, answers).collect()} == {1: "better", 2: "good", 3: "poor"}
    assert column(spark, files.first_text(F.col("a"), F.col("b"), F.col("c")), a=" ", b="x", c="y") == "x"
    frames = files.event_frames(spark.createDataFrame([(1, "abcdefghij"), (2, "")], "id int, text string")).orderBy("id", "n").collect()
    assert [json.loads(r.frame[6:])["content"] for r in frames] == ["abcdefgh", "ij", ""] and frames[0].frame.endswith("\n\n")


@pytest.mark.parametrize(("text", "number"), [("十二", 12), ("一百二十三", 123), ("十", 10), ("三十", 30), ("七", 7), ("42", 42), ("〇", 0), ("一百", 100), (" 五 ", 5)])
def test_numerals(spark, text, number):
    assert column(spark, T.numeral(F.col("t")), t=text) == number


@pytest.mark.parametrize(("raw", "title"), [("# 第一章 绪论", "第一章：绪论"), ("第3童  数据...", "第3章：数据"), ("Chapter 2 Models:", "Chapter 2: Models"), ("chapter 7", "chapter 7"), ("  ", ""), ("附录", "附录"), ("第二篇", "第二章")])
def test_titles(spark, raw, title):
    assert column(spark, T.normal_title(F.col("t")), t=raw) == title


@pytest.mark.parametrize(("text", "found"), [('x {"a": {"b": 1}} y {"c": 2}', '{"a": {"b": 1}}'), ("none", None), ("{open", None), ('```json\n{"a": 1}\n```', '{"a": 1}'), ("} {}", "{}")])
def test_first_object(spark, text, found):
    assert column(spark, T.first_object(F.col("t")), t=text) == found


def test_chapters_are_found_beside_a_table_of_contents():
    toc = "第1章 A\n第2章 B\n第3章 C\n第4章 D\n"
    body = "".join(f"第{i}章 {c}\n" + f"text of chapter {i} " * 40 + "\n" for i, c in enumerate("ABCD", 1))
    text = toc + "x" * 600 + "\n" + body
    got = chapters.pieces(text, [(f"第{i}章 {c}", "") for i, c in enumerate("ABCD", 1)] + [("第9章 Z", "")])
    assert [g[1] for g in got] == [0, 1, 2, 3, 4] and got[-1] == (-1, 4, "")
    assert [p for p, *_ in got[:4]] == [text.index(f"第{i}章", len(toc)) for i in range(1, 5)]
    assert chapters.Marks(toc).crowded(5) and not chapters.Marks("第1章 " + "x" * 500).crowded(0)
    assert chapters.pieces(None, []) == [] and chapters.pieces("", [("Lost", ""), ("", "x")]) == [(-1, 0, "")]


def test_headings_with_other_gaps_are_found_however_far_they_are():
    title = [("Chapter 4: The Model", "")]
    assert [p for p, *_ in chapters.pieces("intro " * 5 + "Chapter 4   The  Model\n" + "words " * 30, title)] == [30]
    far = "word" + " " * 900 + "\n\n" * 700 + "intro "
    assert [p for p, *_ in chapters.pieces(far + "Chapter 4\n\nThe :  Model\n" + "words " * 30, title)] == [len(far)]
    assert chapters.pieces("Chapter 40 " + "words " * 30 + "Chapter 4 " + "words " * 30, [("Chapter 4", "")])[0][0] == 191


def test_headings_are_not_found_inside_words():
    text = "Of Lostaezez las, reLost and Lost\n" + "words " * 30
    assert [p for p, *_ in chapters.pieces(text, [("Lost", "")])] == [29]
    assert chapters.pieces(text.replace("Lost\n", "so\n"), [("Lost", "nowhere to be found")]) == [(-1, 0, "")]
    assert [p for p, *_ in chapters.pieces("xLost words fo Lost words follow here", [("", "Lost words fo")])] == [15]  # a marker may end in a word


def test_short_chapters_and_headings_at_one_place():
    text = "".join(f"Chapter {i} Part {c}\nsome words of it\n" for i, c in enumerate("abcdef", 1))
    heads = [(f"Chapter {i} Part {c}", "") for i, c in enumerate("abcdef", 1)]
    assert [(p, i) for p, i, _ in chapters.pieces(text, heads)] == [(text.index(h), i) for i, (h, _) in enumerate(heads)]
    assert [i for _, i, _ in chapters.pieces("Start here\n" + "text " * 60, [("First", "Start here"), ("Second", "Start here")])] == [0]


def test_contents_at_the_head_of_a_chapter_go():
    toc, body = "".join(f"Chapter {i} {c}\n" for i, c in enumerate("ABCDE", 1)), "Chapter 1 A\n" + "text of it " * 40
    assert chapters.after_contents(toc + body) == body.strip()
    assert chapters.after_contents(toc + "Preface\n" + "text of it " * 40) == "Preface\n" + ("text of it " * 40).strip()
    assert chapters.after_contents(toc + "short") == toc + "short" and chapters.after_contents("no table") == "no table"
    wide = "".join(f"Chapter {i}\n" + "x" * 400 for i in range(9))
    assert chapters.after_contents(wide) == wide


def test_split_of_a_frame(spark):
    long = "Chapter 1 One\n" + "text " * 200_000 + "\nChapter 2 Two\n" + "more " * 100
    heads = "array<struct<title:string,marker:string>>"
    rows = [(1, long, [("Chapter 2 Two", ""), ("Chapter 1 One", None)], "x"), (1, long, [("Chapter 2 Two", ""), ("Chapter 1 One", None)], "x"), (2, None, [("Gone", "g")], "x"), (3, "some text", None, "x"), (4, "", [], "x"), (None, "Start\n" + "a b " * 20, [("", "Start")], "x")]
    got = chapters.split(spark.createDataFrame(rows, f"doc_id long, text string, headings {heads}, place string")).collect()
    assert sorted((r.doc_id or 0, r.place, r.position, r.title) for r in got) == sorted([(0, 0, 0, "章节1"), *2 * [(1, 0, 0, "Chapter 1: One"), (1, 1, long.index("Chapter 2"), "Chapter 2: Two")], (2, 0, -1, "Gone")])


def compressed_by_rule(sections, limit):
    def cut(text, n):
        if len(text) <= n:
            return text
        head = text[:n]
        line = head.rfind("\n")
        return (head[:line] if line > n // 2 else head) + "\n...（截断）"

    total = lambda: sum(map(len, sections.values()))
    for phase in (1, 3):
        for name in context.COMPRESSED:
            if total() <= limit:
                return sections
            sections[name] = cut(sections[name], context.LIMITS[name] if phase == 1 else context.HARD_CHARS)
    return sections


def test_compression_keeps_to_the_order(spark):
    base = {s: "" for s in context.SECTIONS} | {"context": "c\n" * 1000, "evidence": "e" * 1000, "task": "t" * 100}
    for hard in (5000, 1200, 1000):
        got = context.compress(spark.createDataFrame([(1, *base.values())], ["qid", *context.SECTIONS]), hard).first()
        want = compressed_by_rule(dict(base), 2 * hard)
        assert [got[s] for s in context.SECTIONS] == list(want.values()) and got.compressed == (sum(map(len, base.values())) > 2 * hard)
    text = "First. Second. 重要 third.\n\nNext one! 必须 so."
    assert column(spark, context.summarised(F.col("t")), t=text) == "First。；重要 third。；Next one。；必须 so。\n（摘要）"
    assert column(spark, context.summarised(F.col("t")), t="...") == "......\n（摘要）"


def test_a_fragment_that_does_not_fit_is_skipped(spark):
    rows = [(1, 0, "x" * 100, 0.9), (1, 1, "x" * 300, 0.8), (1, 2, "x" * 90, 0.7), (2, 0, "", 0.5)]
    got = context.select(spark.createDataFrame([(q, o, "tool", c, t) for q, o, c, t in rows], "qid int, ord long, source string, content string, total double"), 100)
    assert {r.qid: [x.ord for x in r.selected] for r in got.collect()} == {1: [0, 2], 2: [0]}


def reference_sentences(text, size, overlap):
    import re

    out, now = [], ""
    for s in (x.strip() for x in re.split(r"(?<=[。！？.!?])\s*", text)):
        if not s:
            continue
        if not now or len(now) + len(s) <= size:
            now = f"{now} {s}".strip()
        else:
            out.append(now)
            now = f"{now[-overlap:]} {s}" if len(now) > overlap else s
    return [*out, now] if now else out


def test_sentences_follow_the_rule(spark):
    texts = ["One. Two! Three? " * 60, "天地玄黄。宇宙洪荒！" * 50, "x" * 900 + ". b. " + "c" * 850, "\u3000a.\u3000b.\u3000" * 200, "", "no end"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", chunks.sentences(F.col("t"), 300, 50).alias("c")).collect()
    assert {r.i: r.c for r in rows} == {i: reference_sentences(t, 300, 50) for i, t in enumerate(texts)}
    docs = spark.createDataFrame([(1, "a\n\nb\n \n" + "c" * 796, "f.txt", "第二章"), (2, None, "g", ""), (3, " \n ", "h", "")], "doc_id long, text string, file string, chapter string")
    assert [(r.chunk_id, r.text) for r in chunks.chunk(docs).orderBy("position").collect()] == [("f.txt_Ch2_0", "a\n\nb"), ("f.txt_Ch2_1", "c" * 796)]


def test_ids_skip_those_in_use(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a_v1"), (3, "a"), (4, "a"), (5, "b"), (6, "b"), (7, "a_v1")], "n int, base string")
    got = {r.n: r.unique_id for r in chunks.unique_ids(rows, "base", "n").collect()}
    assert got == {1: "a", 2: "a_v1", 3: "a_v2", 4: "a_v3", 5: "b", 6: "b_v1", 7: "a_v1_v1"}


def test_tools_and_skills(spark):
    seen = []
    tools = registry.ToolRegistry(before=[lambda n, a: seen.append(n)], after=[lambda n, o, s: seen.append(o)], permitted={"double", "fail"})
    tools.register("double", "twice", lambda x: 2 * x)
    tools.register("fail", "fails", lambda: 1 / 0)
    tools.register("secret", "not for all", lambda: 1)
    got = tools.dispatch([{"name": "double", "args": {"x": 4}}, {"name": "unknown"}, {"name": "fail"}, {"name": "secret"}])
    assert [g[:2] for g in got] == [("double", 8), ("fail", None), ("secret", None)] and "not permitted" in got[2][2] and seen == ["double", 8, "fail"]
    skills = registry.SkillRegistry()
    for name, trigger in (("solve", "default"), ("tutor", "toggle"), ("quiz", "auto")):
        skills.register(registry.Skill(name, name, trigger))
    rows = spark.createDataFrame([("tutor", "quiz"), ("", "quiz"), ("quiz", "tutor"), (None, None)], "t string, c string")
    assert [r.s for r in rows.select(skills.route(F.col("t"), F.col("c")).alias("s")).collect()] == ["tutor", "quiz", "solve", "solve"]


def test_slots_and_strategies(spark):
    def letters():
        return lambda texts: [[float(t.count(c)) + 0.01 for c in "abcdef"] for t in texts]

    def failing():
        calls = []

        def model(prompt):
            calls.append(prompt)
            if prompt == "never" or len(calls) < 2:
                raise OSError
            return prompt.upper()

        return model

    corpus = spark.createDataFrame([(1, "aaa bbb word"), (2, "bbb ccc"), (3, "ccc ddd word"), (4, "fff")], "doc_id long, text string")
    corpus = corpus.withColumn("embedding", registry.embedding_slot(letters)("text"))
    queries = corpus.where("doc_id <= 2").select(F.col("doc_id").alias("qid"), "text", F.col("embedding").alias("q"))
    for name in ("sparse", "dense", "overlap", "hybrid", "supplement"):
        got = registry.retrieve(name, corpus, queries, 2).where("rank = 1").collect()
        assert {r.qid: r.doc_id for r in got} == {1: 1, 2: 2}, name
    scorer = registry.pair_slot(lambda: lambda pairs: [float(len(t)) for _, t in pairs])
    lists = corpus.select(F.lit(1).alias("qid"), "doc_id", "text", F.lit("dense").alias("source"), F.col("doc_id").alias("rank"))
    best = strategies.rerank(lists, queries, 2, scorer).orderBy("rank").collect()
    assert [r.doc_id for r in best] == [1, 3]
    prompts = spark.createDataFrame([("a",), ("never",), (None,)], "p string").coalesce(1)
    assert [r.x for r in prompts.select(registry.text_slot(failing, 1, 0.0)("p").alias("x")).collect()] == ["A", None, None]
    with pytest.raises(ValueError, match="unknown strategy"):
        registry.retrieve("none", corpus, queries)


def test_streams(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"user_id": rng.integers(0, 5, 300), "event_id": np.arange(300), "at": np.sort(rng.integers(0, 5000, 300)).astype(float)})
    events = spark.createDataFrame(rows).select("user_id", "event_id", "at", F.timestamp_seconds("at").alias("ts"))
    for i, part in enumerate((events.where("event_id < 150"), events.where("event_id >= 150"))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    out = windows.limit_stream(stream, 3, 200.0)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    want = {r.event_id: r.accepted for r in windows.limit_calls(events.select("user_id", "event_id", "at"), 3, 200.0).collect()}
    assert {r.event_id: r.accepted for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "docs/0"))
    grow = lambda: windows.append_new(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs/*")), str(tmp_path / "index"), str(tmp_path / "ci")).awaitTermination(120)
    assert grow()
    spark.createDataFrame([(4, "b"), (5, "c")], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "docs/1"))
    assert grow()
    assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "index")).collect()) == [1, 2, 5]


def test_ingest_and_extract(spark):
    text = "第1章 A\n" + "alpha beta. " * 30 + "\n第2章 B\n" + "gamma delta. " * 30
    docs = spark.createDataFrame([(1, "f.txt", text, [("第1章 A", ""), ("第2章 B", "")]), (2, "g.md", "alone", []), (3, "h.md", "alone", None)], "doc_id long, file string, text string, headings array<struct<title:string,marker:string>>")
    got = pipelines.ingest(docs, size=200, overlap=0).collect()
    assert {r.chunk_id for r in got if r.doc_id == 1} >= {"f.txt_Ch1_0", "f.txt_Ch2_0"} and [r.file for r in got if r.text == "alone"] == ["g.md"]
    index = spark.createDataFrame([(r.hash,) for r in got if r.doc_id == 1], "hash string")
    assert [r.doc_id for r in pipelines.ingest(docs, index, 200, 0).collect()] == [2]
    batches = spark.createDataFrame([(0, 0, "f", "c", "k0", "x"), (0, 1, "f", "c", "k1", "y"), (1, 0, "g", "", "k2", "z"), (1, 1, "g", "", "k3", " ")], "batch int, pos int, doc string, chapter string, chunk_id string, text string")
    answers = [{"concepts": [{"name": " Alpha ", "source_fragment": 1, "related_fragments": [0, 1, 7]}, {"name": "beta", "source_fragment": 9}], "relations": [{"source": "ALPHA", "target": "beta"}, {"source": "alpha", "target": "alpha"}, {"source": "x", "target": "beta"}]}, {"concepts": [{"name": "alpha"}, {"name": ""}]}]
    model = lambda c: F.when(c.contains("k2") | c.contains("文件"), F.lit("Sure: " + json.dumps(answers[1]))).otherwise(F.lit("```" + json.dumps(answers[0]) + "```"))
    concepts, relations, rest = pipelines.extract(batches, model)
    assert {r.key: (r.chunk_id, r.related_chunk_ids) for r in concepts.collect()} == {"alpha": ("k1", ["k0"]), "beta": ("k0", [])}
    assert relations.count() == 1 and sorted(r.chunk_id for r in rest.collect()) == ["k2", "k3"]


def test_evaluation_of_strategies(spark):
    corpus = spark.createDataFrame([(f"d{i}", f"word{i} common text") for i in range(8)], "doc_id string, text string")
    queries = spark.createDataFrame([("q1", "word1"), ("q2", "word2 common"), ("q3", "nothing here")], "qid string, text string")
    qrels = spark.createDataFrame([("q1", "d1", 1), ("q2", "d2", 2), ("q2", "d3", 1)], "qid string, doc_id string, grade int")
    got = {r.strategy: r for r in pipelines.evaluate(corpus, queries, qrels, ["sparse", "overlap"], 1).collect()}
    assert got["sparse"].recall == 0.5 and got["sparse"].num_queries == 3 and got["sparse"].empty_results == 1 and got["sparse"].ndcg == 1.0 and got["overlap"].mrr == got["sparse"].mrr


def test_sources_are_gathered(spark):
    one = spark.createDataFrame([(1, "a", 1, None)], "qid int, content string, priority int, age_hours double")
    got = context.gather({"user_question": one, "tool": one}).orderBy("place").collect()
    assert [r.source for r in got] == ["user_question", "tool"]
    made = context.assemble(context.gather({"user_question": one, "tool": one}).withColumn("ord", F.col("place")), F.lit("a"))
    assert made.select(context.prompt().alias("p")).first().p == "## Role & Policies\na\n\n## Task\na\n\n## State\n（无）\n\n## Evidence\n（无）\n\n## Context\n（无）\n\n## Output Format\n（无）"


def test_episode_text(spark):
    from docquarry.operators import answering

    schema = "id int, goal string, observations array<string>, lesson string, reflection map<string,string>, corrected_behavior string, question_pattern string, keywords array<string>"
    rows = [(1, "g", ["a", "", "b"], "", {"lesson": "old"}, "c", "", ["k"]), (2, "g", [], "new", {"lesson": "old"}, None, "p", None), (3, None, None, None, None, None, None, None), (4, "", ["x", None], None, {}, "", "", [])]
    got = {r.id: r.search_text for r in answering.episode_text(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: "g a  b old c k", 2: "g new p", 3: "", 4: " x"}
