"""Lexicon, TF-IDF, sampling and augmentation on small tables."""

import math
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from casebook.operators import augment, lexicon, sampling, tfidf, vocabfilter
from casebook.sources.tables import read_features, write_features


def counts(spark, words):
    return spark.createDataFrame(list(Counter(words).items()), "token string, n long")


def lemma_map(df):
    return {r.token: r.lemma for r in df.collect()}


def test_lexicon_defaults_to_the_corpus(spark):
    words = ["loan", "loans", "story", "stories", "charge", "charged", "pay", "paying", "bus", "men", "man"]
    got = lemma_map(lexicon.build_lexicon(counts(spark, words)))
    assert got == {
        "loan": "loan", "loans": "loan", "story": "story", "stories": "story", "charge": "charge",
        "charged": "charge", "pay": "pay", "paying": "pay", "bus": "bus", "men": "men", "man": "man",
    }


def test_lexicon_with_dictionary_and_exceptions(spark):
    words = ["geese", "leaves", "paying", "lies"]
    attested = spark.createDataFrame(
        [("n", "leaf"), ("v", "leave"), ("v", "pay"), ("n", "lie"), ("v", "ly")],
        "kind string, word string",
    )
    exceptions = spark.createDataFrame([("n", "geese", "goose")], "kind string, token string, lemma string")
    got = lemma_map(lexicon.build_lexicon(counts(spark, words), attested, exceptions))
    assert got == {"geese": "goose", "leaves": "leaf", "paying": "pay", "lies": "lie"}


@pytest.mark.parametrize("hot_tokens", [10, 1])
def test_lemmatise_keeps_order_and_empty_documents(spark, hot_tokens):
    docs = spark.createDataFrame(
        [(1, ["loans", "pay", "loans", "fees"]), (2, []), (3, ["pay", "new"])],
        "doc_id long, tokens array<string>",
    )
    lex = spark.createDataFrame(
        [("loans", 2, "loan"), ("pay", 2, "pay"), ("fees", 1, "fee")],
        "token string, n long, lemma string",
    )
    got = {r.doc_id: r.tokens for r in lexicon.lemmatise(docs, lex, hot_tokens=hot_tokens).collect()}
    assert got == {1: ["loan", "pay", "loan", "fee"], 2: [], 3: ["pay", "new"]}


def test_vocabulary_filter_bounds(spark):
    df = spark.createDataFrame([(n,) for n in (4, 5, 500, 501)], "n int").select(
        "n", F.transform(F.sequence(F.lit(1), "n"), lambda i: i.cast("string")).alias("tokens")
    )
    assert sorted(r.n for r in vocabfilter.keep_by_vocabulary(df, "tokens").collect()) == [5, 500]
    s = vocabfilter.vocabulary_stats(df, "tokens").first()
    assert (s.original, s.removed_low, s.removed_high, s.final) == (4, 1, 1, 2)
    assert (s.mean_unique, s.median_unique, s.pct_kept) == (252.5, 252.5, 50.0)
    empty = vocabfilter.vocabulary_stats(df.limit(0), "tokens").first()
    assert empty.original == 0 and empty.pct_kept is None


TEXTS = [(1, "loan payment loan"), (2, "payment late"), (3, "loan"), (4, "")]


def corpus(spark, texts):
    return tfidf.with_terms(
        spark.createDataFrame(
            [(i, t.split()) for i, t in texts], "doc_id long, tokens array<string>"
        )
    )


def test_weights_by_hand(spark, tmp_path):
    docs = corpus(spark, TEXTS[:3])
    vocab = tfidf.fit_vocabulary(docs, min_df=1, max_df=1.0).cache()
    assert [r.term for r in vocab.orderBy("term_id").collect()] == [
        "late", "loan", "loan payment", "payment", "payment late", "payment loan",
    ]
    long = tfidf.long_form(tfidf.transform(docs, vocab), vocab)
    got = {(r.doc_id, r.term): round(r.weight, 6) for r in long.collect()}
    assert got == {
        (1, "loan"): 0.62561, (1, "loan payment"): 0.485842, (1, "payment"): 0.369495,
        (1, "payment loan"): 0.485842, (2, "late"): 0.622766, (2, "payment"): 0.47363,
        (2, "payment late"): 0.622766, (3, "loan"): 1.0,
    }
    unseen = tfidf.transform(corpus(spark, [(9, "loan unseen"), (10, "nothing known")]), vocab)
    assert [tuple(r) for r in tfidf.long_form(unseen, vocab).collect()] == [(9, "loan", 1.0)]
    path = str(tmp_path / "features")
    write_features(unseen, path)
    loaded = {r.doc_id: r.features for r in read_features(spark, path).collect()}
    assert loaded[9].size == 6 and loaded[9][1] == 1.0 and loaded[10].numNonzeros() == 0


def test_weights_against_plain_python(spark):
    texts = [(i, " ".join(f"w{(i * j) % 17}" for j in range(1, 9 + i % 5))) for i in range(40)]
    docs = corpus(spark, texts)
    vocab = tfidf.fit_vocabulary(docs, max_features=60, min_df=3, max_df=0.95).cache()

    def terms(t):
        w = [x for x in t.split() if len(x) > 1]
        return w + [f"{a} {b}" for a, b in zip(w, w[1:])]

    tfs = {i: Counter(terms(t)) for i, t in texts}
    df, cf = Counter(), Counter()
    for c in tfs.values():
        df.update(c.keys())
        cf.update(c)
    kept = sorted((t for t in df if 3 <= df[t] <= 0.95 * 40), key=lambda t: (-cf[t], t))[:60]
    idf = {t: math.log(41 / (1 + df[t])) + 1 for t in kept}
    want = {}
    for i, c in tfs.items():
        w = {t: (1 + math.log(n)) * idf[t] for t, n in c.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        want.update({(i, t): x / norm for t, x in w.items()})
    long = tfidf.long_form(tfidf.transform(docs, vocab), vocab).collect()
    assert {(r.doc_id, r.term): r.weight for r in long} == pytest.approx(want)


def test_cap_and_empty_vocabulary(spark):
    docs = corpus(spark, TEXTS)
    assert [r.term for r in tfidf.fit_vocabulary(docs, 2, 1, 1.0).orderBy("cf").collect()] == [
        "payment", "loan",
    ]
    nothing = tfidf.fit_vocabulary(docs, min_df=100).cache()
    assert all(not r.features.indices for r in tfidf.transform(docs, nothing).collect())


def strata(spark, sizes):
    data, i = [], 0
    for name, n in sizes.items():
        for _ in range(n):
            data.append((i, name))
            i += 1
    return spark.createDataFrame(data, "doc_id long, label string")


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 5}, {"a": 997, "b": 3, "c": 1}, {"a": 2}])
def test_split_quotas(spark, sizes):
    df = strata(spark, sizes)
    got = sampling.split_labels(df, "doc_id", "label").cache()
    assert got.count() == df.count()
    total = math.ceil(0.2 * sum(sizes.values()))
    per = Counter(r.label for r in got.where("is_test").collect())
    assert sum(per.values()) == total
    share = {k: total * n / sum(sizes.values()) for k, n in sizes.items()}
    assert all(math.floor(share[k]) <= per[k] <= math.floor(share[k]) + 1 for k in sizes)
    again = sampling.split_labels(df.repartition(5), "doc_id", "label")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("sizes", [{"a": 103, "b": 10}, {"a": 3, "b": 1, "c": 5}])
def test_folds_are_even(spark, sizes):
    got = sampling.with_folds(strata(spark, sizes), "doc_id", "label", 5).collect()
    assert len(got) == sum(sizes.values())
    per = Counter((r.label, r.fold) for r in got)
    for k, n in sizes.items():
        assert {per[k, f] for f in range(5)} <= {n // 5, n // 5 + 1}


def test_group_folds_keep_groups_together(spark):
    df = strata(spark, {"a": 50}).withColumn("source", F.col("doc_id") % 7)
    got = sampling.with_folds(df, "doc_id", "label", 5, group_column="source")
    assert got.groupBy("source").agg(F.count_distinct("fold").alias("k")).where("k > 1").count() == 0


def test_augmentation_gates(spark):
    df = spark.createDataFrame(
        [(1, "a b c"), (2, "none"), (3, "empty"), (4, "accent"), (5, "fail"), (6, "x" * 5001)],
        "doc_id long, text string",
    )

    def paraphrase(t):
        if t == "fail":
            raise ValueError(t)
        return {"none": None, "empty": "", "accent": "é"}.get(t, t.upper())

    got = augment.paraphrase_rows(df, "text", paraphrase, tasks=2).collect()
    assert [tuple(r) for r in got] == [(-2, "A B C", 1, True)]
    made = augment.paraphrase_rows(df, "text", augment.neighbour_swap())
    assert made.where("source_doc_id = 1").first().text == "b a c"
    both = augment.append_augmented(df, made.limit(0))
    assert both.count() == 6 and not any(r.is_augmented for r in both.collect())


def test_paraphrase_counts(spark):
    def paraphrase(t):
        if t == "boom":
            raise RuntimeError
        return {"none": None, "blank": "", "accent": "\u00e9"}.get(t, t + "!")

    texts = ["fine", "boom", "none", "blank", "accent", "x" * 5001, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    row = augment.paraphrase_counts(df, "text", paraphrase, tasks=2).first()
    assert row.asDict() == {
        "n_skipped": 2, "n_attempts": 5, "n_failed": 3, "n_rejected": 1, "n_kept": 1}


def test_most_frequent_takes_ties_by_term(spark):
    df = spark.createDataFrame([("d", 3), ("a", 1), ("c", 1), ("b", 1), ("e", 2)], "t string, n long")
    for k, want in [(1, "d"), (3, "ade"), (4, "abde"), (5, "abcde"), (9, "abcde")]:
        got = {r.t for r in tfidf.most_frequent(df, "n", "t", k).collect()}
        assert got == set(want)


def test_only_rare_tokens_are_taken_out(spark, monkeypatch):
    words = [f"w{i}s" for i in range(40)]
    docs = spark.createDataFrame(
        [(i, ["plain", words[i % 40], "other", words[0], words[i % 7]]) for i in range(60)] + [(99, None)],
        "doc_id long, tokens array<string>")
    lex = lexicon.build_lexicon(lexicon.token_counts(docs).unionByName(
        spark.createDataFrame([(w[:-1], 0) for w in words], "token string, n long"))).localCheckpoint()
    frames = {}
    monkeypatch.setattr(lexicon, "stage", lambda df, name: frames.setdefault(name, df.localCheckpoint()))
    want = {r.doc_id: r.tokens for r in lexicon.lemmatise(docs, lex).collect()}
    got = {r.doc_id: r.tokens for r in lexicon.lemmatise(docs, lex, hot_tokens=7).collect()}
    assert got == want and got[99] == [] and got[1] == ["plain", "w1", "other", "w0", "w1"]
    taken = [t.token for r in frames["lemmatised"].collect() for t in r.rest]
    assert set(taken) == set(words[7:]) and len(taken) == 40 - 7 + 20 - 7


def test_term_counts_where_rows_lie(spark, monkeypatch):
    monkeypatch.setattr(tfidf, "TERMS_AT_ONCE", 3)
    rows = [(1, ["a", "b", "a"]), (2, ["a"]), (2, ["a", "c"]), (None, ["x"]), (None, ["x"]), (3, []), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, terms array<string>")
    got = {(r.doc_id, r.term): r.tf for r in tfidf.term_counts(docs).collect()}
    assert got == {(1, "a"): 2, (1, "b"): 1, (2, "a"): 2, (2, "c"): 1, (None, "x"): 2}
    alone = tfidf.term_counts(docs.where("doc_id = 1"))._jdf.queryExecution().optimizedPlan().toString()
    assert alone.count("MapInArrow") == 2
    found = {r.term: (r.df, r.cf) for r in tfidf.term_statistics(docs).collect()}
    assert found == {"a": (3, 4), "b": (1, 1), "c": (1, 1), "x": (2, 2)}


def test_bigrams_are_paired_in_the_tasks(spark, monkeypatch):
    words = ["a", "bb", "bb cc", "cc", "\u00e9\u00e9", "\u00e9", "dd", None, ""]
    rows = [(i, [words[(i * 7 + j * j) % len(words)] for j in range(i % 11)]) for i in range(60)]
    docs = spark.createDataFrame(rows + [(99, None)], "doc_id long, tokens array<string>").repartition(3)
    terms = tfidf.with_terms(docs.where("tokens is not null"))
    want = {r.term: (r.df, r.cf) for r in tfidf.term_statistics(terms).collect()}
    assert "bb cc" in want and "bb cc dd" in want
    got = {r.term: (r.df, r.cf) for r in tfidf.term_statistics(docs, "tokens").collect()}
    assert got == want
    vocab = tfidf.fit_vocabulary(docs, min_df=2, max_df=1.0, tokens="tokens").cache()
    wide = {r.doc_id: r.features for r in tfidf.transform(terms, vocab).collect()}
    made = {r.doc_id: r.features for r in tfidf.transform(docs, vocab, "tokens").collect()}
    assert made.pop(99).indices == [] and len(made) == 60
    for i, own in made.items():
        assert own.indices == wide[i].indices == sorted(set(own.indices))
        assert own["values"] == pytest.approx(wide[i]["values"])
        assert not own.indices or sum(w * w for w in own["values"]) == pytest.approx(1)


def test_few_terms_at_a_time_give_the_same(monkeypatch):
    column = pa.array([["bb", "cc", "bb", "cc"], [], None, ["cc"], ["bb", "cc"]] * 9)

    def counts():
        out = Counter()
        for first, rows, codes, n, names in tfidf._coded(column, True):
            for r, c, k in zip(rows.tolist(), codes.tolist(), n.tolist()):
                out[first + r, names[c].as_py()] += k
        return out

    whole = counts()
    assert whole[0, "bb cc"] == 2 and whole[3, "cc"] == 1
    monkeypatch.setattr(tfidf, "TERMS_AT_ONCE", 6)
    assert counts() == whole


def test_labels_travel_with_their_texts(spark):
    """Lemmas need no join with their labels: no document is shuffled."""
    docs = spark.createDataFrame(
        [(i, f"loans loan payment number{i}", f"issue {i % 2}") for i in range(9)],
        "doc_id long, narrative string, issue string")
    lemmas, _ = lexicon.clean_corpus(docs, "narrative", keep=["issue"])
    assert {r.doc_id: r.issue for r in lemmas.collect()} == {i: f"issue {i % 2}" for i in range(9)}
    assert "Exchange" not in lemmas._jdf.queryExecution().executedPlan().toString()
    lex = spark.createDataFrame(
        [("loans", 9, "loan"), ("payments", 1, "payment")], "token string, n long, lemma string")
    rows = spark.createDataFrame(
        [(1, ["loans"], "x"), (2, ["payments", "loans"], "y"), (3, [], None)],
        "doc_id long, tokens array<string>, rest string")
    got = lexicon.lemmatise(rows, lex, hot_tokens=1, keep=["rest"]).collect()
    assert {r.doc_id: (r.tokens, r.rest) for r in got} == {
        1: (["loan"], "x"), 2: (["payment", "loan"], "y"), 3: ([], None)}
