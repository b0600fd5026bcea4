"""Every query of the folder with SQL against DuckDB; the others against brute force."""

import binascii
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from compare import connect, difference
from tokenizers import Tokenizer

import corpus_pipeline
from casebook.llm import encoder, secrets
from casebook.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.fixture(scope="module")
def docs(folder):
    return pq.read_table(f"{folder}/documents.parquet").to_pylist()


@pytest.fixture(scope="module")
def ids(docs):
    tokenizer = Tokenizer.from_file(encoder.tokenizer_path())
    return {
        d["doc_id"]: [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 2] for d in docs
    }


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, folder, con, name):
    assert difference(spark, con, folder, QUERIES[name], SQL[name]) is None


def test_one_query_for_each_number():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES)
    assert numbers == list(range(1, 14))


def test_packing_covers_every_id_once(spark, folder, ids):
    rows = QUERIES["op2_packing"](spark, folder).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        part = np.array(own[r["start"]:r["start"] + r["length"]], "<u4")
        assert r["ids_crc32"] == binascii.crc32(part.tobytes())
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for doc, parts in pieces.items():
        end = 0
        for start, length in sorted(parts):
            assert start == end
            end += length
        assert end == len(ids[doc])
    padding = 0
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
        padding += 4096 - end
    assert padding <= 0.06 * sum(map(len, ids.values())) + 4096


def test_token_counts(spark, folder, ids):
    lengths = Counter(len(x) - 1 for x in ids.values())
    total, tokens = sum(lengths.values()), sum(n * c for n, c in lengths.items())
    rows = QUERIES["op3_token_counts"](spark, folder).collect()
    assert {r["n_tokens"]: r["n_docs"] for r in rows} == lengths
    for r in rows:
        n = r["n_tokens"]
        assert r["docs_from"] == sum(c for m, c in lengths.items() if m >= n)
        assert r["tokens_from"] == sum(m * c for m, c in lengths.items() if m >= n)
        assert r["docs_upto"] == sum(c for m, c in lengths.items() if m <= n)
        assert r["truncated_tokens"] == sum(min(m, n) * c for m, c in lengths.items())
        assert (r["all_docs"], r["all_tokens"]) == (total, tokens)


def brute_base(text):
    spans = []
    words = "password|passwd|secret|token|api_?key"
    pattern = re.compile(
        rf"""((?a:(?i:{words})))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
    )
    for m in pattern.finditer(text):
        if len(m[2]) >= 6 and m[1].isascii():
            spans.append((m.start(), 0, m.end(), "assign"))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            spans.append((m.start(), 1, m.end(), "access"))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 24:
            spans.append((m.start(), 2, m.end(), "hex"))
    return [(kind, start, end) for start, _, end, kind in sorted(spans)]


def test_secret_scan(spark, folder, docs):
    rows = {r["doc_id"]: r for r in QUERIES["op6_secret_scan"](spark, folder).collect()}
    assert set(rows) == {d["doc_id"] for d in docs}
    for d in docs:
        base = brute_base(d["text"] or "")
        r = rows[d["doc_id"]]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        kinds = Counter(k for k, _, _ in base)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (
            kinds["assign"], kinds["access"], kinds["hex"])
        spans = [s for s in r["spans"].split(",") if s]
        assert [s for s in spans if not s.startswith("markov")] == [
            f"{k}:{a}:{b}" for k, a, b in base]


def test_language_of_held_out_rows(spark, folder, docs):
    lang = {d["doc_id"]: d["lang"] for d in docs}
    rows = QUERIES["op7_language_id"](spark, folder).collect()
    assert len(rows) == len(docs)
    assert {r["doc_id"] for r in rows if r["held_out"]} == {
        i for i in lang if binascii.crc32(str(i).encode()) % 3 == 1}
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_pipeline(spark, folder, docs, con):
    """Each stage on what the one before kept, against SQL and plain Python."""
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    text = {d["doc_id"]: d["text"] for d in docs}
    stages = dict(corpus_pipeline.STAGES)
    after = {}
    for name, function in list(stages.items())[:-1]:
        rows = spark.createDataFrame(
            function(spark, rows, folder).toPandas(), rows.schema)
        assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after[name] = {r["doc_id"] for r in rows.collect()}
    first, equal, near, clean = after.values()
    assert first == {i for i, t in text.items() if any(c.isalpha() for c in t or "")}
    groups = defaultdict(list)
    for i in first:
        groups[re.sub(r"[\x20\x09-\x0D]+", "", text[i])].append(i)
    assert equal == {min(g, key=lambda i: (-len(text[i]), i)) for g in groups.values()}

    def left(ids):
        con.execute("CREATE OR REPLACE TEMP TABLE kept AS SELECT unnest(?) AS doc_id", [sorted(ids)])
        return "(SELECT * FROM documents SEMI JOIN kept USING (doc_id))"

    sql = re.sub(r"FROM documents\b", f"FROM {left(equal)} AS d", SQL["op10_ngram_join"])
    found = con.execute(f"SELECT doc_id FROM ({sql}) WHERE doc_id = component_id").fetchall()
    assert near == {i for i, in found}
    sql = re.sub(r"FROM documents\b", f"FROM {left(near)} AS d", SQL["op4_decontamination"])
    found = con.execute(f"SELECT doc_id FROM ({sql}) WHERE NOT contaminated").fetchall()
    assert clean == {i for i, in found}
    pieces = stages["packing"](spark, rows, folder).collect()
    assert {p["doc_id"] for p in pieces} == clean
    assert secrets.KINDS[0] == "assign"
