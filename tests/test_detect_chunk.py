"""Structure detection and chunkers, on texts of the known kinds."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import chunkset
from quillspark.operators.chunk import ChunkOptions, Chunkers, chunk_documents, merge_small, paragraph_chunks
from quillspark.operators.detect import DetectOptions, detect, heading_levels

BODY = "The parties agree to all that is said here and to nothing else."
AGREEMENT = "\n" + "\n\n".join(f"{n}. {title}\n\n{BODY}\n\n" + "\n\n".join(f"{n}.{m} Point\n{BODY}" for m in range(1, points + 1)) for n, title, points in ((1, "DUTIES", 2), (2, "PAYMENT TERMS", 2), (3, "LEAVE", 2), (4, "NOTICE", 1)))
ACT = "\n".join(f"Article {a} - Matter\n" + f"Section {a}. Rule\n" + "\n".join(f"({c}) {BODY} {BODY}" for c in range(1, n + 1)) for a, n in ((1, 3), (2, 5), (3, 1), (4, 2)))
POLICY = "\n".join(f"PART {h}\n" + "\n".join(f"({c}) item {c} of the list" for c in "abcdefg"[: 4 + h % 2]) for h in "1234".translate(str.maketrans("1234", "1234")) for h in [int(h)])


def docs(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "doc_id string, text string")


def found(spark, text, **more):
    return detect(docs(spark, a=text), **more).select("detection.*").first()


def chunks(spark, text, **options):
    return chunk_documents(docs(spark, a=text), options=ChunkOptions(**options)).orderBy("ordinal").collect()


def test_numbered(spark):
    d = found(spark, AGREEMENT)
    assert (d.doc_type, d.section_count, round(d.confidence, 6), d.is_sequential) == ("numbered_sections", 15, 0.9, True)
    made = chunks(spark, AGREEMENT)
    assert [c.chunk_id for c in made] == [f"section_{i}" for i in range(1, 5)]
    assert made[1].hierarchy == ["2. PAYMENT TERMS"]


def test_subsections_carry_their_parent(spark):
    made = chunks(spark, f"\n1. ALPHA BETA\n{BODY}\n1.1. Inner part\n{BODY}\n2. GAMMA DELTA\n{BODY}\n3. LAST PART\n{BODY}", min_chunk_size=0)
    inner = next(c for c in made if c.chunk_id == "section_1_1")
    assert inner.hierarchy == ["1. ALPHA BETA", "1.1. Inner part"]
    assert inner.content.startswith("[Context: The parties")


def test_short_sections_give_no_chunk(spark):
    assert chunks(spark, "\n1. ONE PART\nshort\n2. TWO PART\nshort") == []


def test_statute(spark):
    d = found(spark, ACT)
    assert (d.doc_type, d.article_count, round(d.confidence, 6), d.clause_count) == ("statute", 8, 0.85, 11)
    made = chunks(spark, ACT)
    assert any(c.chunk_id == "article_1_clause_2" or "clause_2" in c.chunk_id for c in made)
    assert all(c.hierarchy for c in made)


def test_policy(spark):
    d = found(spark, POLICY)
    assert d.doc_type == "policy_or_terms" and d.dominant_pattern == "letter"
    assert chunks(spark, POLICY)[0].chunk_id.startswith("block_0")


def test_layout(spark):
    blocks = [(t, size, False, False, (0.0, float(i))) for i, (t, size) in enumerate((("Heading one", 20.0), (BODY, 10.0), ("Heading two", 14.0), (BODY, 10.0), ("Heading three", 13.0), (BODY, 10.0)))]
    schema = "doc_id string, text string, layout struct<headings:array<struct<level:int>>,blocks:array<struct<text:string,font_size:double,is_bold:boolean,is_centered:boolean,position:struct<x:double,y:double>>>,base_font_size:double>"
    df = spark.createDataFrame([("a", "\n".join(b[0] for b in blocks), ([(1,), (2,), (3,)], blocks, 10.0))], schema)
    made = chunk_documents(df, layout_col="layout", options=ChunkOptions(min_chunk_size=0)).orderBy("ordinal").collect()
    assert {c.doc_type for c in made} == {"layout_based"} and made[0].hierarchy[-1] == "Heading one"
    assert df.select(heading_levels(F.col("layout.headings")).alias("m")).first().m == {1: 1, 2: 1, 3: 1}


def test_unstructured_is_one_chunk_as_observed_and_several_as_documented(spark):
    text = "\n\n".join(f"Paragraph {i}. {BODY * 3}" for i in range(12))
    assert found(spark, text).paragraph_count == 12
    assert len(chunks(spark, text)) == 1
    assert len(chunks(spark, text, semantics="documented")) > 1


def test_thresholds(spark):
    assert found(spark, "Article 1 only", options=DetectOptions(statute_least=1)).doc_type == "statute"
    assert found(spark, "Article 1 only").doc_type == "unstructured"


@pytest.mark.parametrize("text", [None, "", " \n\n "])
def test_nothing_gives_no_chunks(spark, text):
    df = spark.createDataFrame([("a", text)], "doc_id string, text string")
    assert detect(df).select("detection.doc_type").first()[0] == "unstructured"
    assert chunk_documents(df).count() == 0


def test_fixed_width_chunks_are_the_whole_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(2345))
    options = ChunkOptions(max_chunk_size=500, preserve_sentence_integrity=False, sentence_overlap=False)
    parts = docs(spark, a=text).select(F.explode(paragraph_chunks(F.col("text"), options)).alias("c")).collect()
    assert "".join(p.c.content for p in parts) == text


def test_merge_needs_both_small(spark):
    kind = "array<struct<content:string,chunk_id:string,hierarchy:array<string>,start_pos:int,end_pos:int,metadata:map<string,string>>>"
    df = spark.createDataFrame([([("a" * n, str(i), [], i, i + 1, {}) for i, n in enumerate((5, 5, 50, 5))],)], f"c {kind}")
    out = df.select(merge_small(F.col("c"), 10).alias("c")).first().c
    assert [(c.chunk_id, len(c.content)) for c in out] == [("0", 12), ("2", 50), ("3", 5)]
    assert out[0].metadata == {"merged": "true"} and out[0].end_pos == 2


def test_clean_text_drops_blank_lines(spark):
    df = docs(spark, a=" x \n\n\t\n y")
    assert df.select(T.clean_text(F.col("text"))).first()[0] == "x\ny"
    assert df.select(T.clean_text(F.col("text"), "documented")).first()[0] == "x\n\ny"


def test_unknown_chunker():
    with pytest.raises(ValueError, match="no chunker"):
        Chunkers().get("poem")


def test_statistics_and_exports(spark):
    df = docs(spark, a=AGREEMENT, b="")
    made = chunk_documents(df)
    stats = {r.doc_id: r for r in chunkset.statistics(df, made).collect()}
    assert stats["a"].total_chunks == 4 and stats["b"].total_chunks == 0 and stats["b"].avg_chunk_size == 0.0
    assert chunkset.by_id(made, "section_2").count() == 1
    assert chunkset.by_hierarchy(made, ["3. LEAVE"]).count() == 1
    assert chunkset.export(made, "markdown").orderBy("ordinal").first().body.startswith("# 1. DUTIES\n\n")
    assert chunkset.export(made, "json").count() == chunkset.export(made, "csv").count() == 4
    with pytest.raises(ValueError, match="no export"):
        chunkset.export(made, "pdf")


def test_a_text_is_cut_once(spark):
    plan = chunk_documents(docs(spark, a=AGREEMENT, b="", c=ACT))._jdf.queryExecution().optimizedPlan()
    assert "Generate" in plan.toString() and not [line for line in plan.treeString().split("\n") if line.strip(" :+-").startswith("Filter") and "size(" in line]
    assert plan.toString().count("section_number") == 1
