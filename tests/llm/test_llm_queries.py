"""The registered queries: against SQL where there is some, else against brute force, a round trip or held-out rows."""

import html
import re
import zlib

import numpy as np
import pytest
from helpers import SF, check_packing, jaccard_brute

from reelframe.llm import decontam, langid, ngram_join, packing, quality, queries
from reelframe.llm.common import table


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_twin(spark, duck, name):
    got, expected = queries.queries()[name](spark, SF).toPandas(), duck.execute(queries.oracle_sql()[name]).fetchdf()
    columns = sorted(got.columns)
    rows = lambda d: sorted(tuple(map(str, r)) for r in d[columns].itertuples(index=False))
    assert columns == sorted(expected.columns) and rows(got) == rows(expected)


def test_shards_against_sql_with_many_splits(spark, duck, monkeypatch):
    from reelframe.llm import sharding

    limit = 40_000
    got = sharding.assign_shards(table(spark, SF, "documents"), limit_bytes=limit).toPandas()
    sql = queries.OP9_SQL.replace(str(sharding.LIMIT_BYTES), str(limit))
    expected = duck.execute(sql).fetchdf()
    rows = lambda d: sorted(zip(d.doc_id, d.n_bytes, d.depth, d.prefix, d.shard))
    ours = got[~got.oversized]
    theirs = expected[expected.doc_id.isin(ours.doc_id)]
    assert rows(ours) == rows(theirs) and got.shard.nunique() > 5
    assert (ours.groupby("shard").n_bytes.sum() <= limit).all() and set(got[got.oversized].n_bytes > limit) <= {True}


def scores(spark, name, label, threshold):
    d = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas().set_index("doc_id")[label]
    got = queries.queries()[name](spark, "/root/testdata/sf0.1").toPandas()
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]
    assert got.score.between(0, 1).all() and ((got.score >= threshold) == (got.predicted == 1)).all()
    assert got.doc_id.is_unique and len(got) == 10_000
    got = got[got.held_out & got.doc_id.isin(d.index)]
    return got.score.to_numpy(), d.loc[got.doc_id].to_numpy(), got.predicted.to_numpy()


def auc(score, y):
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable")
    return (order[y == 1].mean() - order[y == 0].mean()) / len(y) + 0.5


def test_toxicity_on_held_out_rows(spark):
    score, y, predicted = scores(spark, "op1_toxicity", "toxic", 0.7)
    assert auc(score, y) > 0.95 and y[predicted == 1].mean() > 0.95 and predicted[y == 1].mean() > 0.8  # some of these labels mark texts without a sign


def test_quality_on_held_out_rows(spark):
    score, y, predicted = scores(spark, "op4_quality", "quality", 0.5)
    assert auc(score, y) > 0.99 and (predicted == y).mean() > 0.98


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id").lang
    got = queries.op7_language_id(spark, "/root/testdata/sf0.1").toPandas()
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]
    held = got[got.held_out]
    assert (held.lang_pred == docs.loc[held.doc_id].to_numpy()).mean() > 0.97 and held.score.between(0, 1).all()
    assert held.rejected.mean() < 0.01


def test_packing_round_trip(spark):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    tokenizer = packing.encoder_of(packing.default_tokenizer()).tokenizer
    assert check_packing(queries.op8_packing(spark, SF).collect(), rows, tokenizer) < 0.01


def simple_main_text(source):
    inner = re.search(r"<article>(.*)</article>", source, re.S).group(1)
    parts = re.split(r"</?(?:p|h1)>", inner)
    parts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p))).split()) for p in parts]
    return "\n\n".join(p for p in parts if p)


def test_pages_against_their_article(spark):
    pages = table(spark, SF, "pages").toPandas().set_index("page_id").html
    got = queries.op10_html_extraction(spark, SF).toPandas()
    assert len(got) == len(pages) and (got.n_chars == got.text.str.len()).all()
    for i, text in zip(got.page_id, got.text):
        assert text == simple_main_text(pages[i]), i


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as pipeline

    docs = table(spark, SF, "documents")
    rows = docs.toPandas()
    good = quality.fit_quality(docs, table(spark, SF, "labels"))
    rows = rows[[good.score(np.array([quality.measures(t)]))[0] >= 0.5 for t in rows.text]]
    kept = pipeline.quality_stage(spark, docs, SF)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(rows.doc_id)
    model = langid.fit_languages(kept)
    sizes = model.sizer()
    known = [(j := langid.judge(sizes, True, t))[0] != "und" and j[1] >= langid.MIN_MARGIN for t in rows.text]
    rows = rows[known]
    kept = pipeline.language_stage(spark, kept, SF)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(rows.doc_id)
    component = jaccard_brute(list(zip(rows.doc_id, rows.text)))
    rows = rows[[component[i][1] == i for i in rows.doc_id]]
    kept = pipeline.near_copy_stage(spark, kept, SF)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(rows.doc_id)
    from helpers import contamination_brute

    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    scanner = decontam.Scanner([(str(i), t.encode()) for i, t in items])
    suspects = [i for i, t in zip(rows.doc_id, rows.text) if scanner.scan(decontam.words(t.encode()))[1]]
    bad = {i for i in suspects for n, hit, _ in [contamination_brute(rows.set_index("doc_id").text[i], items)] if hit and 20 * hit >= n}
    rows = rows[~rows.doc_id.isin(bad)]
    kept = pipeline.decontamination_stage(spark, kept, SF)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(rows.doc_id)
    tokenizer = packing.encoder_of(packing.default_tokenizer()).tokenizer
    assert check_packing(pipeline.run(spark, SF).collect(), list(zip(rows.doc_id, rows.text)), tokenizer) < 0.02
    assert [n for n, _ in pipeline.STAGES][2] == "ngram_jaccard_join" and ngram_join.PERCENT == 85
