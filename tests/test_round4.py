"""Fits whose numerics depend on each other, texts that rows share, terms added up where the text is."""

import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from patchlake.operators import features, models, splits, tfidf
from patchlake.plans import bindings, queries

SF = "/root/testdata/sf0.001"


def history_like(spark, n=3000):
    """Numerics of which some are sums of others, on very different scales."""
    rng = np.random.default_rng(5)
    commits = rng.integers(0, 400, n)
    fixes, plus = rng.binomial(commits, 0.3), commits * rng.integers(20, 30, n)
    minus = plus // 3 + rng.integers(0, 5, n)
    label = (rng.random(n) < 1 / (1 + np.exp(0.5 - fixes / 80))).astype(int)
    rows = [tuple(map(float, r)) for r in zip(commits, fixes, plus, minus, plus + minus)]
    return spark.createDataFrame([(str(i), int(y), *r) for i, (y, r) in enumerate(zip(label, rows))], "record_id string, label int, a double, b double, c double, d double, e double")


@pytest.fixture
def passes(monkeypatch):
    made, real = [], models.sums
    monkeypatch.setattr(models, "sums", lambda *given: made.append(1) or real(*given))
    return made


def test_a_fit_of_dependent_numerics_takes_a_few_passes(spark, passes):
    df = history_like(spark)
    fitted = models.train(df, 4000, numerics=["a", "b", "c", "d", "e"])
    assert len(passes) <= 12
    slopes = models.gradient(fitted, df).collect()
    assert max(abs(r.gradient) for r in slopes) <= 1.01 * models.SLOPE_SHARE * max(abs(r.start) for r in slopes)


def records(spark):
    rng = random.Random(3)
    words = ["guard", "raise", "none", "docs", "style", "x", "É"]
    texts = {f"c{i}": " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12))) for i in range(25)}
    texts["c3"], texts["c4"] = "", None
    rows = [(f"{i}:{j}", f"c{i}", j % 2 if i % 3 else 1, rng.random(), "A" if j else "M", ".py") for i in range(30) for j in range(i % 5)]
    df = spark.createDataFrame(rows, "record_id string, commit_hash string, label int, a double, change_type string, extension string")
    return df, spark.createDataFrame(list(texts.items()), "commit_hash string, model_text string")


def test_texts_that_rows_share_equal_texts_of_their_own(spark):
    df, table = records(spark)
    own, texts = df.join(table, "commit_hash", "left"), models.Texts(table, "commit_hash")
    blocks = {"numerics": ["a"], "categories": features.CATEGORIES, "text_pattern": tfidf.WORD, "min_docs": 2, "max_share": 0.9}
    fitted, shared = models.train(own, 4000, **blocks), models.train(df, 4000, texts=texts, **blocks)
    assert sorted(fitted.text.vocab.collect()) == sorted(shared.text.vocab.collect()) and fitted.text.size > 10
    assert shared.model.weights == pytest.approx(fitted.model.weights, abs=1e-2)
    slopes = [{r.slot: (r.start, r.gradient) for r in found.collect()} for found in (models.gradient(fitted, own), models.gradient(fitted, df, texts=texts))]
    assert slopes[0].keys() == slopes[1].keys()
    assert [x for k in slopes[0] for x in slopes[0][k]] == pytest.approx([x for k in slopes[0] for x in slopes[1][k]], abs=1e-12)
    scores = [{r.record_id: r.probability_bug_fix for r in found.collect()} for found in (fitted.score(own), fitted.score(df, texts=texts))]
    assert len(scores[1]) == df.count() and scores[0] == pytest.approx(scores[1])


def test_blocks_hold_a_shared_text_once(spark):
    df, table = records(spark)
    texts = models.Texts(table, "commit_hash")
    classifier, _ = models.fit_blocks(df, text_pattern=tfidf.WORD, texts=texts, min_docs=1, max_share=1.0)
    rows = models.training_rows(classifier, df.coalesce(1), F.lit(1.0), "rows", texts)
    found = rows.opened().map(lambda b: (len(b.label), b.texts)).collect()
    rows.release()
    assert sum(n for n, _ in found) == df.count() and sum(t for _, t in found) < df.count() / 2


def test_a_numeric_without_a_value_is_an_error(spark):
    df = spark.createDataFrame([("1", 0, 1.0), ("2", 1, None)], "record_id string, label int, a double")
    with pytest.raises(Exception, match="a numeric feature has no value"):
        models.train(df, 10, numerics=["a"])


def test_many_categories_count_one_by_one(spark):
    rows = [(str(i), i % 2, f"k{i % 700}", ".py") for i in range(1400)]
    df = spark.createDataFrame(rows, "record_id string, label int, change_type string, extension string")
    fitted = models.train(df, 500, categories=features.CATEGORIES)
    slopes = models.gradient(fitted, df).collect()
    assert len(slopes) == 702 and max(abs(r.gradient) for r in slopes) <= 1.01 * models.SLOPE_SHARE * max(abs(r.start) for r in slopes)


def zipf_documents(spark, n=300):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{min(k, 4000)}" for k in rng.zipf(1.3, 60)) for _ in range(n)]
    terms, docs = Counter(), Counter()
    for text in texts:
        words = text.split()
        found = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        terms.update(found)
        docs.update(set(found))
    return tfidf.documents(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text"), terms, docs


@pytest.mark.parametrize("max_terms,max_share", [(40, 0.95), (40, 0.02), (100_000, 0.95)])
def test_vocabulary_is_exact_where_rare_terms_stay(spark, monkeypatch, max_terms, max_share):
    docs, terms, df = zipf_documents(spark)
    leasts, real = [], tfidf.term_totals
    monkeypatch.setattr(tfidf, "term_totals", lambda *given: leasts.append(given[3]) or real(*given))
    got = [(r.term, r.corpus_count, r.df) for r in tfidf.vocabulary(docs, 300, max_terms=max_terms, max_share=max_share).collect()]
    able = [t for t in terms if 2 <= df[t] <= 300 * max_share]
    assert sorted(got) == sorted((t, terms[t], df[t]) for t in sorted(able, key=lambda t: (-terms[t], t))[:max_terms])
    assert (leasts[0] > 1) == (max_terms == 40)
    if max_share == 0.02:  # the frequent terms are left out, so rarer ones had to be asked for again
        assert len(leasts) > 1


def test_rare_terms_do_not_move(spark):
    docs, terms, _ = zipf_documents(spark)
    buckets = tfidf.bucket_counts(docs)
    assert buckets.sum() == sum(terms.values())
    least = sorted(terms.values())[-40]
    moved = {r.term: r.corpus_count for r in tfidf.term_totals(docs, tfidf.WORD, buckets, least).collect()}
    assert {t for t, n in terms.items() if n >= least} <= moved.keys() and len(moved) < len(terms) / 20
    assert all(terms[t] == n for t, n in moved.items())


def test_words_are_those_of_the_sql(spark):
    texts = ["e\u0301te\u0301 É²x x½ a_b  Ⅷ", "\u00a0ÀB\u2003c\u200dd\u001ce", "don't a  bb c-dd", "", None, "日本 语a İSTANBUL ΣΑΣ"]
    for pattern in (tfidf.WORD, tfidf.LONG_WORD):
        words, rows, codes, _ = tfidf.split_words(pa.array([[t] for t in texts], pa.list_(pa.string())), pattern)
        got = [[words[int(c)].as_py() for c in codes[rows == i]] for i in range(len(texts))]
        sql = "select coalesce(regexp_extract_all(lower($t), $p), [])"
        assert got == [duckdb.execute(sql, {"t": t, "p": pattern}).fetchone()[0] for t in texts]


def test_coefficients_take_few_passes_over_narrow_rows(spark, passes, monkeypatch):
    written, real = [], queries.stored
    monkeypatch.setattr(queries, "stored", lambda df, name: written.append(df.columns) or real(df, name))
    assert queries.QUERIES["q_coefficients"](spark, SF).count() == 9 and len(passes) <= 12
    assert written == [["commit_hash", "timestamp", "label", "historical_features"]]


def test_columns_of_the_message_are_made_where_commits_are_read(spark):
    changes = bindings.file_changes(spark, SF, {"label": queries.text.is_fix_message(F.col("message")).cast("int")})
    want = splits.label_by_message(bindings.file_changes(spark, SF)).select("commit_hash", "file_path", "label")
    assert sorted(changes.select(want.columns).collect()) == sorted(want.collect())
    assert "message" not in changes.columns


def test_slopes_of_a_fit_take_two_passes(spark, passes):
    df, table = records(spark)
    texts = models.Texts(table, "commit_hash")
    classifier, _ = models.fit_blocks(df, text_pattern=tfidf.WORD, texts=texts, min_docs=1, max_share=1.0)
    blank = classifier.with_model(models.Linear(np.zeros(classifier.size()), 0.0))
    found = models.gradient(blank, df, texts=texts)
    assert len(passes) == 2 and "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert all(r.start == r.gradient for r in found.collect()) and found.count() == classifier.size() + 1
