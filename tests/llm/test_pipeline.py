"""The pipeline stage by stage against plain Python."""

from collections import Counter

import pytest

pytest.importorskip("loomgraph.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from loomgraph.llm import langid, mixing, tokens  # noqa: E402
from tests.llm.helpers import DOCS, corpus, words  # noqa: E402
from tests.llm.test_operators import brute_components, brute_substrings, brute_targets, clashing  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en", s, n) for i, (_, t, _, s, n) in enumerate(corpus(7, 120))]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path, rows


def test_each_stage_on_what_its_predecessor_kept(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "substring_dedup", "mixing", "packing"]

    docs = steps["language_id"](spark, docs, path)
    assert docs.columns == columns
    kept = [r for r in rows if r[1] is not None and any(c.isalpha() for c in r[1])]
    assert sorted(map(tuple, docs.collect()), key=lambda r: r[0]) == kept

    docs = steps["near_duplicates"](spark, docs, path)
    assert docs.columns == columns
    firsts = {c for _, _, c in brute_components(kept)}
    kept = [r for r in kept if r[0] in firsts]
    assert sorted(r.doc_id for r in docs.collect()) == [r[0] for r in kept]

    docs = steps["substring_dedup"](spark, docs, path).persist()
    assert docs.columns == columns
    counts = {d: (n, gone) for d, n, gone, _ in brute_substrings(kept)}
    left = {r.doc_id: r for r in docs.collect()}
    assert set(left) == {d for d, (n, gone) in counts.items() if not gone or n > gone}
    assert all(len(words(r.text)) == counts[d][0] - counts[d][1] and r.n_chars == len(r.text) for d, r in left.items())

    mixed = steps["mixing"](spark, docs, path)
    assert mixed.columns == columns
    times = Counter(r.doc_id for r in mixed.collect())
    sizes = Counter()
    for r in left.values():
        sizes[r.source] += len(words(r.text))
    targets = brute_targets(dict(sizes))
    for s, target in targets.items():
        own = [r for r in left.values() if r.source == s]
        taken = sum(times[r.doc_id] * len(words(r.text)) for r in own)
        assert abs(taken - target) <= max(len(words(r.text)) for r in own) / 2 + 1.5
        assert all(times[r.doc_id] <= 3 or not words(r.text) for r in own)

    packed = steps["packing"](spark, mixed, path).collect()
    tok = tokens.library("byte_bpe_50k.json")
    expected = sum(n * (len(tok.encode(left[d].text, add_special_tokens=False)) + 1) for d, n in times.items())
    assert sum(r.length for r in packed) == expected


def test_run_gives_the_last_stage(spark, folder):
    path, _ = folder
    out = corpus_pipeline.run(spark, path)
    assert out.count() > 0 and "sequence_id" in out.columns


def test_stages_keep_extra_columns_and_stand_empty_tables(spark, folder):
    path, rows = folder
    docs = clashing(spark.createDataFrame(rows[:30] + [(None, "words without an id in this text", "en", None, 0), (None, None, None, None, None)], DOCS))
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs, none = stage(spark, docs, path), stage(spark, none, path)
        assert docs.count() > 0 and none.count() == 0


def test_repeated_rows_are_mixed_each(spark):
    rows = [(1, "a b c d", None, "s", 7)] * 6 + [(2, "x y", None, "t", 3)] * 2
    df = spark.createDataFrame(rows, DOCS)
    plan = mixing.mix(df).collect()
    out = mixing.apply_mix(df).collect()
    assert len(plan) == 8
    assert abs(sum(len(words(r.text)) for r in out) - sum(r.taken for r in plan)) <= 4
    assert langid.keep_identified(df).collect() == []  # nothing to learn from
