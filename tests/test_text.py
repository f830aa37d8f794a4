"""Text functions and chunkers."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.functions.chunking import sentence_chunks, sentence_chunks_column, sentence_spans
from loomgraph.plans.config import Config


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first()["x"]


def test_clean(spark):
    assert one(spark, T.clean(F.lit(" a \n b\0c \x1c"))) == "a bc"
    assert one(spark, T.clean(F.lit("a \0 b"))) == "a b"
    assert one(spark, T.clean_late(F.lit("a \0 b"))) == "a  b"
    assert one(spark, T.clean(F.lit(None).cast("string"))) is None


@pytest.mark.parametrize("n,sizes", [(0, [0]), (512, [512]), (513, [512, 51]), (1000, [512, 512, 76])])
def test_fixed_chunks(spark, n, sizes):
    got = one(spark, T.fixed_chunks(F.lit("x" * n)))
    assert [len(c) for c in got] == sizes


def test_chunk_sizes_are_checked():
    with pytest.raises(ValueError):
        T.fixed_chunks(None, 10, 10)


def test_word_chunks(spark):
    got = one(spark, T.word_chunks(F.lit(" ".join(f"w{i}" for i in range(640)))))
    assert [len(c.split()) for c in got] == [300, 300]
    assert one(spark, T.word_chunks(F.lit(""))) == []
    assert len(one(spark, T.word_chunks(F.lit("w " * 5000)))) == 10


@pytest.mark.parametrize("name,want", [("the cat", "Cat"), ("the", "The"), ("a", None), ("gpt2x", "Gpt2X"), ("foo_bar", "Foo_Bar"), ("An  old\tmap", "Old Map"), ("ßa", "Ssa"), ("élan", "Élan")])
def test_entity(spark, name, want):
    assert one(spark, T.entity(F.lit(name))) == want


@pytest.mark.parametrize("label,want", [("Graph (ADT)", "graph_adt"), ("C++", "c"), ("é x", "é_x")])
def test_node_id(spark, label, want):
    assert one(spark, T.node_id(F.lit(label))) == want


def test_relations_and_types(spark):
    assert one(spark, T.relation(F.lit("used for"))) == "USED_FOR"
    assert one(spark, T.relation(F.lit("x"))) is None
    assert one(spark, T.edge_type(F.lit("is_a"))) == "IS_A"
    assert one(spark, T.edge_type(F.lit("DEFINED_AS"))) == "RELATED_TO"


def test_triple_lines(spark):
    assert one(spark, T.format_triple(F.lit("a"), F.lit("R"), F.lit("b"))) == "S:a|R:R|O:b"
    assert tuple(one(spark, T.parse_triple(F.lit("S: a |R:IS_A|O:S:b")))) == ("a", "IS_A", "S:b")
    assert one(spark, T.parse_triple(F.lit("S:a|R:b"))) is None
    got = one(spark, T.parse_generated(F.lit("x\n### Output:\nS:a|R:B|O:c\nnoise\nS:bad")))
    assert [(t.subject, t.relation, t.object, t.confidence) for t in got] == [("a", "B", "c", 0.9)]


@pytest.mark.parametrize("url,want", [("https://www.youtube.com/watch?v=abcdefghijk&t=1", "abcdefghijk"), ("https://youtu.be/ABC-_345678", "ABC-_345678"), ("https://youtube.com/embed/abcdefghijk", "abcdefghijk"), ("https://example.com", None)])
def test_video_ids(spark, url, want):
    assert one(spark, T.video_id(F.lit(url))) == want
    assert one(spark, T.is_video_url(F.lit(url))) is (want is not None)


def test_times_and_dates(spark):
    assert [one(spark, T.timestamp_label(F.lit(s))) for s in (59, 3661, 360000)] == ["00:59", "01:01:01", "100:00:00"]
    assert one(spark, T.duration_label(F.lit(605))) == "10:05"
    assert one(spark, T.thousands(F.lit(1234567))) == "1,234,567"
    assert [one(spark, T.upload_date(F.lit(d))) for d in ("20240131", "20241399", "soon")] == ["2024-01-31", "20241399", "soon"]


def test_front_matter(spark):
    got = one(spark, T.front_matter(F.lit("---\ntitle: A: b\nx: 1\nx: 2\n---\nbody")))
    assert got == {"fm_title": "A: b", "fm_x": "2"}
    assert one(spark, T.front_matter(F.lit("no marks"))) == {}


def test_metadata_round_trip(spark):
    kept = T.stringify_metadata(F.create_map(F.lit("a"), F.lit("42"), F.lit("b"), F.lit(None).cast("string"), F.lit("c"), F.lit("True")))
    assert one(spark, kept) == {"a": "42", "b": "None", "c": "True"}
    back = T.sniff_metadata(kept)
    assert one(spark, F.try_variant_get(back["a"], "$", "int")) == 42
    assert one(spark, F.try_variant_get(back["c"], "$", "string")) == "True"


def test_names_words_and_levels(spark):
    assert one(spark, T.safe_filename(F.lit("a/b: c-d_e"))) == "a_b_ c-d_e"
    assert one(spark, T.concept_words(F.lit("Alpha beta Gamma Alpha Ab Äpfel"))) == ["Alpha", "Gamma", "Äpfel"]
    assert [one(spark, T.difficulty(F.lit(i), F.lit(4))) for i in range(4)] == ["easy", "easy", "medium", "hard"]
    assert [one(spark, T.time_needed(F.lit(n))) for n in (1, 4)] == ["30 minutes", "2.0 hours"]
    assert one(spark, T.section(F.lit("x ## Transcript y ## Transcript z"), "## Transcript")) == " y "
    assert one(spark, T.section(F.lit("none"), "## Transcript")) == "none"


def test_subtitles_and_transcripts(spark):
    events = F.array(F.struct(F.array(F.struct(F.lit("a").alias("utf8")), F.struct(F.lit("b").alias("utf8"))).alias("segs")), F.struct(F.array(F.struct(F.lit(" \n").alias("utf8")), F.struct(F.lit(" ").alias("utf8"))).alias("segs")))
    assert one(spark, T.subtitle_text(events)).strip() == "ab"
    entries = F.array(F.struct(F.lit(61).alias("start"), F.lit("hi").alias("text")))
    assert one(spark, T.transcript_lines(entries)) == "[01:01] hi"


def test_sentence_chunks_end_and_lose_nothing():
    text = "a" * 100 + ". " + "b" * 498
    got = sentence_chunks(text)
    assert "".join(got).count("b") >= 498 and got[0] == "a" * 100 + "."
    early = "x" * 10 + ". " + "y" * 988
    assert sum(c.count("y") for c in sentence_chunks(early)) >= 988
    assert sentence_chunks("") == [""]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab.!? \n", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_sentence_spans_cover_every_character(text, size, overlap):
    spans = sentence_spans(text, size, overlap)
    assert spans[0][0] == 0 and spans[-1][1] >= len(text)
    assert all(a < c <= b for (a, b), (c, _) in zip(spans, spans[1:]))
    assert all(b - a <= max(size, 0) for a, b in spans)


def test_sentence_chunks_column(spark):
    df = spark.createDataFrame([("One. " * 300,), (None,)], "t string").select(sentence_chunks_column(F.col("t")).alias("c"))
    a, b = (r.c for r in df.collect())
    assert len(a) > 2 and all(len(x) <= 512 for x in a) and b is None


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("top_k: 7\nreasoner:\n  gaps: 3\n  unknown: 1\n")
    c = Config.load(str(path))
    assert (c.top_k, c.gaps, c.chunk_size) == (7, 3, 512)
