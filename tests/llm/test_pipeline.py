"""The pipeline stage by stage against plain Python over the given documents."""

import random

import corpus_pipeline
from concordat.llm.language_id import Letters
from concordat.sources.tables import load
from tests.llm.test_decontamination import brute as hits
from tests.llm.test_mixing import targets
from tests.llm.test_ngram_jaccard import brute as components
from tests.llm.test_secret_scan import brute as secrets


def test_stages(spark, sf):
    docs = load(spark, sf, "documents")
    extra = [(10**6 + i, t, None, "extra", 0) for i, t in enumerate([None, "", "123 !!", "und " * 30000])]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    bench = [(r.item_id, r.text) for r in load(spark, sf, "benchmark").collect()]
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        rows = out.collect()
        kept = {r.doc_id: r for r in rows}
        assert len(kept) == len(rows)
        if name == "language_id":
            letters = {i for i, r in before.items() if len(Letters([r.text]).starts)}
            assert set(kept) <= letters and len(kept) >= 0.99 * len(letters)
        if name == "near_duplicates":
            assert set(kept) == {c[2] for c in components([(i, r.text) for i, r in before.items()], 5, 80, 100)}
        if name == "decontamination":
            assert set(kept) == {i for i, r in before.items() if not hits(r.text, bench)[4]} and len(kept) < len(before)
        if name == "secrets":
            assert set(kept) == set(before)
            assert all((kept[i].text == r.text) or "[SECRET]" in kept[i].text for i, r in before.items())
            assert all("[SECRET]" in kept[i].text and kept[i].n_chars == len(kept[i].text) for i, r in before.items() if secrets(r.text))
        if name == "mix":
            sizes = {}
            for r in before.values():
                sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
            want, taken = targets(sizes), {}
            for r in rows:
                taken[r.source] = taken.get(r.source, 0) + r.taken
            assert set(kept) == set(before) and all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
            break
        assert out.columns == docs.columns
        docs, before = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), docs.schema), kept


def test_language_stage(spark, sf):
    """Foreign scripts and texts between languages go, clean ones stay."""
    docs = load(spark, sf, "documents")
    by_lang = {}
    for r in docs.filter("lang is not null and length(text) > 500").collect():
        by_lang.setdefault(r.lang, []).append(r.text[:400])
    clean = {lang: texts[0] for lang, texts in by_lang.items()}
    russian, han, arabic = "что это как для она они был после только " * 20, "漢字文章日本語中国語" * 20, "هذا نص باللغة العربية " * 20
    odd = [russian, han, arabic, "слово", "".join(clean.values()), next(iter(clean.values())) + russian]
    extra = [(10**6 + i, t, None, "extra", 0) for i, t in enumerate(odd)] + [(2 * 10**6 + i, t + " слово 漢字", None, "extra", 0) for i, t in enumerate(clean.values())]
    out = corpus_pipeline.languages(spark, docs.unionByName(spark.createDataFrame(extra, docs.schema)), sf)
    kept = {r.doc_id: r.lang for r in out.collect()}
    assert len(clean) == 4 and not [i for i in kept if 10**6 <= i < 2 * 10**6]
    assert [kept[2 * 10**6 + i] for i in range(len(clean))] == list(clean)


def test_empty(spark, sf):
    docs = load(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).collect() == []


def test_python_stages_get_few_documents_at_a_time(spark, sf, monkeypatch):
    """What a stage in Python keeps is written before it returns, under the limit on batches; the setting is put back."""
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, write = spark.conf.get(key), corpus_pipeline.cut_lineage
    monkeypatch.setattr(corpus_pipeline, "cut_lineage", lambda df: (seen.append(int(spark.conf.get(key))), write(df))[1])
    docs = load(spark, sf, "documents").limit(50)
    for stage in (corpus_pipeline.languages, corpus_pipeline.secrets):
        assert stage(spark, docs, sf).count() <= 50
    assert seen == [corpus_pipeline.ROWS] * 2 and spark.conf.get(key) == before
