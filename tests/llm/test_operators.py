"""Edge cases and properties on small tables."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from casebook.llm import (
    chat, encoder, exact_dedup, language, lm_score, ngram_join, packing, phrase_index, secrets,
    sharding, token_counts, wordhash,
)

ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one two three four five six seven"),
    (4, "one two three four five six seven"), (5, "ONE two three four five six seven"),
    (None, "one two three four five six seven"), (6, "!!! ... ???"), (7, "x" * 70_000),
    (8, "word " * 30_000), (9, "é ü ß 中文 ́ <|endoftext|>"), (10, "a b"),
]
OPERATORS = {
    "sharding": sharding.shard_documents,
    "packing": packing.pack,
    "token_counts": lambda d: token_counts.with_suffix_sums(token_counts.length_histogram(d)),
    "secrets": secrets.scan,
    "language": language.languages,
    "exact_dedup": exact_dedup.equal_texts,
    "lm_score": lm_score.score,
    "ngram_join": ngram_join.similar,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_table(documents, name):
    assert OPERATORS[name](documents([])).collect() == []
    rows = OPERATORS[name](documents(ODD)).collect()
    if name not in ("packing", "token_counts"):
        assert len(rows) == len(ODD)


# --- sharding -----------------------------------------------------------------------------------


def test_shard_growth_moves_rows_only_into_the_new_shard(spark):
    keys = spark.range(5000).select(F.col("id").cast("string").alias("key"))
    rows = keys.select(
        sharding.shard_of(F.col("key"), [1.0] * 6).alias("old"),
        sharding.shard_of(F.col("key"), [1.0] * 7).alias("new"),
    ).collect()
    moved = [r for r in rows if r["old"] != r["new"]]
    assert all(r["new"] == 6 for r in moved) and 500 < len(moved) < 950


def test_shard_weights(spark):
    rows = spark.range(20000).select(
        sharding.shard_of(F.col("id").cast("string"), [1.0, 3.0]).alias("s")
    ).groupBy("s").count().collect()
    assert 0.73 < {r["s"]: r["count"] for r in rows}[1] / 20000 < 0.77
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("id"), [1.0, 0.0])


def test_slots_are_gapless(documents):
    rows = sharding.shard_documents(documents(ODD)).collect()
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert {r["size"] for r in rows if r["doc_id"] in (1, 2)} == {8}


# --- tokens and packing -------------------------------------------------------------------------


def test_ids_equal_the_tokenizer():
    path = encoder.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    texts = [t for _, t in ODD if t] + [
        "Don't we'll it's 12 a1b2 ... <html>&amp;</html> café CAFÉ x²", "İstanbul ΣΑΣ ﬁ №5 \x1c a\x85b",
        "naïve—dash “quotes” ½ 3µm ªº", "é ñ a ́b",
    ]
    for text in texts:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.packed_ids(text, path), "<u4").tolist() == want


def test_differencing_is_near_equal():
    rng = random.Random(5)
    for ways in (1, 2, 3, 7):
        sizes = [rng.randint(1, 900) for _ in range(60)]
        parts = packing.difference(sizes, ways)
        assert sorted(itertools.chain(*parts)) == list(range(60)) and len(parts) == ways
        sums = [sum(sizes[i] for i in p) for p in parts]
        assert max(sums) - min(sums) < 60


def test_two_way_differencing_of_a_known_case():
    # 8 and 7 leave 1, 6 and 5 leave 1, 4 and 1 leave 3, 3 and 1 leave 2.
    parts = packing.difference([8, 7, 6, 5, 4], 2)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in parts) == [14, 16]


def test_window_count_rises_when_capacity_is_exceeded():
    assert len(packing.windows([6, 6, 6], 10)) == 3
    assert packing.windows([10], 10) == [[0]]


def test_limits_and_quantiles(documents):
    histogram = token_counts.length_histogram(documents([(i, "a " * i) for i in range(10)])).cache()
    limits = {r["limit"]: r for r in token_counts.at_limits(histogram, [0, 4, 100]).collect()}
    assert limits[4]["docs_over"] == 5 and limits[4]["tokens_kept"] == 0 + 1 + 2 + 3 + 4 * 6
    assert limits[0]["tokens_kept"] == 0 and limits[100]["docs_over"] == 0
    summed = token_counts.with_suffix_sums(histogram)
    assert token_counts.quantile(summed, 0.5).first()["n_tokens"] == 4


# --- phrases ------------------------------------------------------------------------------------


def test_words_are_found_like_the_pattern():
    column = pa.array(["Ab-c é1\x7fz", "", None, "Z" * 5000 + " 9"], pa.string())
    (_, _, hashes, counts), = wordhash.blocks(column, phrase_index.WORD)
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = [w for t in column.to_pylist() for w in pattern.findall((t or "").lower())]
    assert counts.tolist() == [4, 0, 0, 2]
    assert len(set(words)) == len(set(hashes.tolist())) == len(words)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_phrases(spark, documents):
    long = " ".join(f"w{i}" for i in range(20))
    benchmark = items(spark, [(1, long), (2, "Short one"), (10, "short ONE"), (3, None), (4, "...")])
    found = {
        r["doc_id"]: r
        for r in phrase_index.contamination(phrase_index.matches(documents([
            (1, "x " + " ".join(f"W{i}" for i in range(3, 16)) + " y"),
            (2, " ".join(f"w{i}" for i in range(3, 15))),
            (3, "a short-one, short one two"), (4, "short"), (5, "one"), (6, None), (7, ""),
            (8, "short one " + "z " * 100),
        ]), benchmark)).collect()
    }
    assert (found[1]["n_hit"], found[1]["n_words"], found[1]["n_items"]) == (13, 15, 1)
    assert found[2]["n_hit"] == 0 and not found[2]["contaminated"]
    assert (found[3]["n_hit"], found[3]["n_items"]) == (4, 2)
    assert found[4]["n_hit"] == found[5]["n_hit"] == 0  # no phrase runs over two documents
    assert found[6]["n_words"] == 0 and not found[7]["contaminated"]
    assert found[8]["n_hit"] == 2 and not found[8]["contaminated"]


def test_blocks_of_items_give_the_same(spark, documents, monkeypatch):
    rows = documents([(i, f"alpha beta w{i} gamma delta w{i + 1}") for i in range(30)])
    benchmark = items(spark, [(i, f"w{i} gamma") for i in range(12)] + [(50, "gamma delta")])
    once = phrase_index.contamination(phrase_index.matches(rows, benchmark)).collect()
    monkeypatch.setattr(phrase_index, "ITEMS_PER_BLOCK", 3)
    monkeypatch.setattr(phrase_index, "TERMS_KEPT", 2)
    assert sorted(phrase_index.contamination(phrase_index.matches(rows, benchmark)).collect()) == sorted(once)


def test_no_items(spark, documents):
    rows = phrase_index.contamination(
        phrase_index.matches(documents(ODD), items(spark, []))).collect()
    assert len(rows) == len(ODD) and not any(r["contaminated"] for r in rows)


def test_proximity(spark, documents):
    index = phrase_index.build(documents([
        (1, "red x x blue"), (2, "blue red"), (3, "red x x x x x blue"), (4, "red"), (5, "blue")]))
    phrases = phrase_index.Phrases([("7", "red blue")])
    assert {r["doc_id"] for r in phrase_index.near(index, phrases, 4).collect()} == {1, 2}


# --- chat ---------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, pieces string"


def test_chat_round_trip(spark):
    tricky = [r"\### Assistant: </turn> ok", "</turn>\n<turn:user>x", "\\", "\\\\<part>", "", None, "a\nb"]
    rows = [(1, i, ["user", "assistant", "assistant", None, "a>b\\"][i % 5], t, "z")
            for i, t in enumerate(tricky * 2)]
    random.Random(3).shuffle(rows)
    out = chat.format_conversations(spark.createDataFrame(rows, TURNS)).select(
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss(F.col("pieces")).alias("loss"), "formatted").first()
    want = [(r[2] or "", r[3] or "") for r in sorted(rows, key=lambda r: r[1])]
    assert [tuple(t) for t in out["turns"]] == want
    assert out["loss"] == "".join(t for r, t in want if r == "assistant")
    runs = [r for i, (r, _) in enumerate(want) if i == 0 or want[i - 1][0] != r]
    assert out["formatted"].count("</turn>\n") == len(runs)


def test_chat_ties_nulls_and_empty(spark):
    rows = [(None, 1, "user", "b", ""), (None, 1, "user", "a", ""), (2, None, "user", "x", ""),
            (2, 0, "user", "y", ""), (2, 0, "user", "y", "")]
    out = chat.digest(chat.format_conversations(spark.createDataFrame(rows, TURNS))).collect()
    assert {r["conv_id"]: r["n_turns"] for r in out} == {None: 2, 2: 3}
    assert chat.digest(chat.format_conversations(spark.createDataFrame([], TURNS))).collect() == []


# --- secrets, language --------------------------------------------------------------------------


def test_random_strings_are_told_from_identifiers():
    rng = np.random.default_rng(99)
    words = "the quick brown fox get element by class name open file handle user account".split()
    texts = [" ".join(rng.choice(words, 200)) + " snake_case_name camelCaseName" for _ in range(50)]
    model = secrets.fit(texts)
    keys = ["".join(rng.choice(list(secrets._LETTERS[:64]), 32)) for _ in range(200)]
    plain = ["_".join(rng.choice(words, 6)) for _ in range(200)]
    assert np.mean([secrets.score(k, model) >= secrets.MARGIN for k in keys]) > 0.98
    assert np.mean([secrets.score(p, model) >= secrets.MARGIN for p in plain]) < 0.02
    spans = secrets.spans_of(f"é see {keys[0]} here", model)
    assert spans == [(6, 38, "markov")]
    assert secrets.masked(f"é see {keys[0]} here", spans) == "é see [markov] here"


@pytest.fixture(scope="module")
def key_model(folder):
    texts = pq.read_table(f"{folder}/documents.parquet")["text"].to_pylist()
    return secrets.fit([t[:4000] for t in texts if t])


ALPHABETS = {
    "lower": secrets._LETTERS[26:62], "upper hex": "0123456789ABCDEF", "letters": secrets._LETTERS[:62],
    "base64": secrets._LETTERS[:64],
}


@pytest.mark.parametrize("alphabet", ALPHABETS)
@pytest.mark.parametrize("prefix", [
    "", "services/team/", "my_long_prefix_", "the-quarterly-report-of-the-billing-team-"])
def test_keys_inside_longer_runs(key_model, alphabet, prefix):
    """A key counts as found when a span covers it but for a few characters at its ends."""
    rng = np.random.default_rng(21)
    keys = ["".join(rng.choice(list(ALPHABETS[alphabet]), 32)) for _ in range(100)]
    found = [
        any(a <= len(prefix) + 8 and b >= len(prefix) + 24 for a, b, _ in secrets.spans_of(
            f"{prefix}{key}", key_model)) for key in keys]
    assert np.mean(found) >= 0.9


def test_plain_names_and_parts_beside_patterns(key_model):
    rng = np.random.default_rng(22)
    words = np.array("report team billing service account number status payment invoice".split())
    plain = ["-/_"[i % 3].join(rng.choice(words, 6)) for i in range(600)]
    assert sum(bool(secrets.spans_of(p, key_model)) for p in plain) <= 6
    key = "".join(rng.choice(list(secrets._LETTERS[:62]), 40))
    text = f"token=abc.def {key}/{'0f' * 14}Z{key}"
    spans = secrets.spans_of(text, key_model)
    at = text.index("0f")
    assert (at, at + 28, "hex") in spans
    marks = [s for s in spans if s[2] == "markov"]
    assert len(marks) == 2 and marks[0][1] <= at and marks[1][0] >= at + 28
    assert secrets.best_stretch(np.array([-1.0, 2, 3, -1, 4, -9, 5])) == (1, 5)


def test_base_spans_drop_failing_matches():
    assert secrets.base_spans("token=token : abcdefgh") == []
    assert secrets.base_spans('Api_Key": "abcdef') == [(0, 17, "assign")]
    assert secrets.base_spans("AKIA" + "A" * 15) == []
    assert secrets.base_spans("x" + "0f" * 12 + "G") == [(1, 25, "hex")]


def test_language_without_labels_or_letters(documents):
    rows = language.languages(documents([(1, "some text", None), (2, "more", None)])).collect()
    assert {(r["lang_pred"], r["score"]) for r in rows} == {("und", 0.0)}
    mixed = [(i, "the cat and the dog " * 5, "en") for i in range(40)] + [
        (i + 40, "der hund und die katze " * 5, "de") for i in range(40)]
    rows = language.languages(documents([*mixed, (200, "123 ...", "en"), (201, None, "en")])).collect()
    found = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert found[200] == found[201] == "und"
    assert all(found[i] == ("en" if i < 40 else "de") for i in range(80))


# --- duplicates ---------------------------------------------------------------------------------


def test_exact_groups(documents):
    rows = exact_dedup.equal_texts(documents([
        (5, "a b c"), (3, "abc"), (9, "a  b c"), (4, None), (2, ""), (8, " "), (7, "abcd"),
        (6, "q" * 48), (11, "q" * 49), (12, "q" * 48 + " "), (1, "z"), (1, "z"), (None, "abc"),
        (13, "q" * 400 + "x"), (14, "q" * 400 + "y"), (15, "q" * 400 + "x"),
    ])).collect()
    keep = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in rows}
    assert keep == {
        (5, 9, 4), (3, 9, 4), (9, 9, 4), (None, 9, 4), (4, 8, 3), (2, 8, 3), (8, 8, 3), (7, 7, 1),
        (6, 12, 2), (12, 12, 2), (11, 11, 1), (1, 1, 2), (13, 13, 2), (15, 13, 2), (14, 14, 1),
    }
    assert sorted((r["doc_id"] or 0) for r in rows if r["kept"]) == [1, 7, 8, 9, 11, 12, 13, 14]


def variants(rng, words, n, changes):
    out = []
    for _ in range(n):
        copy = list(words)
        for _ in range(rng.randint(0, changes)):
            copy[rng.randrange(len(copy))] = f"v{rng.random()}"
        out.append(" ".join(copy))
    return out


def brute_components(texts):
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("small", [False, True])
def test_similar_documents(documents, monkeypatch, small):
    """Families at and around the threshold, shared passages, long lists cut into blocks."""
    if small:
        monkeypatch.setattr(ngram_join, "LIST_BLOCK", 4)
        monkeypatch.setattr(ngram_join, "SPLIT_COUNT", 3)
        monkeypatch.setattr(ngram_join, "BUCKET_TOKENS", 50)
        monkeypatch.setattr(ngram_join, "HUBS", 1)
    rng = random.Random(17)
    texts = []
    for family in range(6):
        words = [f"f{family}w{i}" for i in range(rng.choice([40, 90, 150]))]
        texts += variants(rng, words, 14, 6)
    passage = [f"p{i}" for i in range(60)]
    texts += [" ".join(passage + [f"u{k}x{i}" for i in range(40)]) for k in range(25)]
    texts += ["one two", "one two", "one", "", "a a a a a a a a", "a a a a a"]
    want, sizes = brute_components(texts)
    got = ngram_join.similar(documents(list(enumerate(texts)))).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(want))
    assert {r["doc_id"]: r["n_shingles"] for r in got} == dict(enumerate(sizes))


def test_chain_of_links_is_one_component(spark):
    ids = [int(x >> np.uint64(1)) for x in wordhash.mixed(np.arange(1, 202, dtype=np.uint64))]
    edges = [*zip(ids[:150], ids[1:151]), (ids[160], ids[161]), (ids[170], ids[170])]
    labels = ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()
    low, pair = min(ids[:151]), min(ids[160:162])
    want = {**{i: low for i in ids[:151]}, ids[160]: pair, ids[161]: pair}
    assert {r["node"]: r["label"] for r in labels} == want


# --- language model, pipeline -------------------------------------------------------------------


def test_scores_leave_the_document_out(documents):
    rows = {r["doc_id"]: r for r in lm_score.score(documents([
        (1, "a b"), (2, "a b"), (3, "c d c d"), (4, None)])).collect()}
    # Elsewhere: a once and "a b" once of 6 words for documents 1 and 2.
    assert rows[1]["log_score"] == pytest.approx(np.log(1 / 6) + np.log(1 / 1))
    assert rows[3]["n_unseen"] == 4 and rows[3]["n_backed_off"] == 3
    assert rows[3]["log_score"] == pytest.approx(4 * np.log(0.5 / 4) + 3 * np.log(0.4))
    assert rows[4]["n_words"] == 0 and rows[4]["log_score"] == 0


def test_trigram_scores(documents):
    rows = {r["doc_id"]: r for r in lm_score.score(documents([
        (1, "a b c"), (2, "a b c"), (3, "x b c")]), order=3).collect()}
    assert rows[1]["log_score"] == pytest.approx(np.log(1 / 6) + np.log(1 / 1) + np.log(1 / 1))
    assert rows[3]["log_score"] == pytest.approx(
        np.log(0.5 / 6) + np.log(0.4 * 2 / 6) + np.log(0.4 * 2 / 2))


def test_pipeline_keeps_columns_and_survives_odd_rows(spark, documents, folder):
    rows = documents([*ODD, *[(100 + i, f"plain text number {i} of the table", "en") for i in range(9)]])
    for _, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, rows, folder)
        assert out.schema.names == rows.schema.names
        rows = out.cache()
    left = [r["doc_id"] for r in rows.collect()]
    assert len(left) == len(set(left)) and set(range(100, 109)) <= set(left)
    assert not {1, 2, 3, 6} & set(left)
    empty = documents([])
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, empty, folder).collect() == []
