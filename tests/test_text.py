from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexspan.functions import chunking, columns, snippets
from lexspan.functions.chunking import Block, chunk_blocks, text_blocks
from lexspan.plans.search_plan import build_plan, ext_list
from lexspan.sources.decode import clean, decode
from lexspan.sources.folders import glob_regex


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


def test_plan_routes():
    plan = build_plan("袋线瓶线标准报价 技术方案书")
    assert "袋线" in plan.terms
    plan = build_plan("GS1 标准体系与 tracecode 字段")
    assert {"GS1", "tracecode"} <= set(plan.substring)
    plan = build_plan("码")
    assert not plan.substring and plan.single == ("码",)
    assert "单元识别代码" in build_plan('找一下 "单元识别代码" 的定义').phrases
    assert "单元识别代码" in build_plan("找一下 “单元识别代码” 的定义").phrases
    assert not build_plan("") and len(build_plan(" ".join(f"w{i}" for i in range(50))).terms) == 20
    assert build_plan("ＧＳ１").terms == build_plan("GS1").terms
    assert "the" not in build_plan("the trace of it").terms
    assert ext_list("docx, .PDF xlsx") == [".docx", ".pdf", ".xlsx"] and ext_list(["MD"]) == [".md"] and ext_list(None) == []


def test_columns(spark):
    assert one(spark, "袋线瓶线", columns.cjk_bigrams) == ["袋线", "线瓶", "瓶线"]
    assert one(spark, "产 线 追 溯 系统 GS1 标准", columns.ocr_cleanup) == "产线追溯系统 GS1 标准"
    assert one(spark, "ＧＳ１ gs1 Trace", columns.index_terms) == ["gs1", "trace"]
    assert one(spark, "产线追溯系统上线运行", columns.index_terms)[0] == "产线追溯系统上线运行" and "追溯" in one(spark, "产线追溯系统上线运行", columns.index_terms)
    assert one(spark, None, columns.index_terms) is None
    assert one(spark, "a\r\nb\x00 \n\n\n\n\n\nc", columns.clean_text) == "a\nb\n\n\nc"
    assert one(spark, 'a<b>"&', columns.html_escape) == "a&lt;b&gt;&quot;&amp;"
    assert one(spark, "a，b！ ；c", columns.clauses) == ["a", "b", "c"]


def test_heading_levels_agree(spark):
    lines = ["# 一级标题", "### x", "一、总体要求", "（三）具体实施", "2.1.3 接口定义", "第三章 总则", "普通正文。", "", "x" * 90, "1. a"]
    assert [one(spark, t, columns.heading_level) for t in lines] == [chunking.heading_level(t) for t in lines] == [1, 3, 2, 2, 2, 2, 0, 0, 0, 2]


def test_chunk_breadcrumb():
    got = chunk_blocks([Block("heading", "一、系统概述", 1), Block("para", "A" * 60), Block("heading", "1.1 架构", 2), Block("para", "B" * 60)], 200, 0)
    assert [c["heading"] for c in got] == ["一、系统概述", "一、系统概述 / 1.1 架构"]


def test_chunk_pages_long_overlap_titles_blank():
    assert chunk_blocks([Block("page", n=3), Block("para", "x")], 900, 0)[0]["page"] == 3
    long = chunk_blocks([Block("para", "一句话到这里结束。" * 400)], 200, 0)
    assert len(long) > 3 and all(len(c["text"]) < 900 for c in long)
    two = chunk_blocks([Block("para", c * 320) for c in "XYZ"], 320, 60)
    assert two[1]["text"].startswith("X")
    titles = chunk_blocks([Block("heading", t, 2) for t in ("概述", "系统架构", "接口")])
    assert len(titles) == 1 and "系统架构" in titles[0]["text"] and titles[0]["heading"] == "概述 / 系统架构 / 接口"
    assert chunk_blocks([Block("para", "   ")]) == [] and chunk_blocks([]) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab。 \n", max_size=300), max_size=8))
def test_chunks_cover_text(lines):
    text = "\n".join(lines)
    got = "".join(c["text"] for c in chunk_blocks(text_blocks(text), 100, 0))
    squash = lambda s: "".join(s.split())
    assert squash(got) == squash("".join(b.text for b in text_blocks(text)))


def test_chunker_column_handles_null_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "一、x\ny")], "id int, t string").select("id", chunking.chunker()("t").alias("c"))
    assert {r["id"]: len(r["c"]) for r in df.collect()} == {1: 0, 2: 0, 3: 1}


def test_snippets_and_marks():
    text = "x" * 500 + " 追溯 码 " + "y" * 500
    s = snippets.snippet(text, ["追溯"])
    assert "「追溯」" in s and s.startswith("…") and s.endswith("…")
    assert snippets.snippet("abc", ["zz"]) == "abc"
    assert snippets.highlight("<b>追溯</b>", ["追溯"]) == '&lt;b&gt;<mark id="first-hit">追溯</mark>&lt;/b&gt;'
    assert snippets.highlight("a" * 400, ["a"]).count("<mark") == 300


def test_decode():
    assert decode("追溯".encode("gb18030"))[0] == "追溯"
    assert decode("﻿追溯".encode("utf-8"))[0] == "追溯"
    assert decode(b"\xff\xfe" + "ab".encode("utf-16-le"))[0] == "ab"
    assert decode(b"")[0] == "" and decode(b"\xff\xff\x80")[1]
    assert clean("a \r\n\n\n\n\n\nb") == "a\n\n\nb"


def test_globs():
    import re

    m = lambda p, s: bool(re.match(glob_regex(p), s))
    assert m("**/*.md", "a/b/c.md") and m("**/*.md", "c.md") and not m("*.md", "a/c.md") and m("~$*", "~$x.docx") and not m("?.md", "ab.md")
