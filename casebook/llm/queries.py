"""The operators of this folder as queries over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from casebook.llm import (
    chat, divergence, exact_dedup, inner_search, language, lm_score, ngram_join, packing,
    phrase_index, repair, secrets, sharding, token_counts,
)
from casebook.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def _documents(spark, folder):
    return read_table(spark, folder, "documents")


@query
def op1_sharding(spark, folder):
    return sharding.shard_documents(_documents(spark, folder))



# The checksum is linear: every byte adds a value that depends on it and on its distance from the
# end, split into blocks of 256 bytes, so it is a join with two small tables and an XOR.
SQL["op1_sharding"] = """
WITH RECURSIVE
one AS (
    SELECT b, list_reduce([b] || range(8), lambda c, i:
        CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
    FROM unnest(range(256)) t(b)
),
low AS (
    SELECT 0 AS d, b, v FROM one
    UNION ALL SELECT 0, 256, 4294967295
    UNION ALL
    SELECT d + 1, low.b, xor(low.v >> 8, one.v) FROM low JOIN one ON one.b = low.v & 255
    WHERE d < 255
),
step AS (
    SELECT 0 AS d, j, 1::BIGINT << j::INT AS v FROM unnest(range(32)) t(j)
    UNION ALL
    SELECT d + 1, j, xor(step.v >> 8, one.v) FROM step JOIN one ON one.b = step.v & 255
    WHERE d < 256
),
high AS (
    SELECT 0 AS h, j, v FROM step WHERE d = 0
    UNION ALL
    SELECT h + 1, high.j, bit_xor(step.v)
    FROM high JOIN step ON step.d = 256 AND (high.v >> step.j::INT) & 1 = 1
    WHERE h < (SELECT max(strlen(text)) // 256 + 1 FROM documents)
    GROUP BY h, high.j
),
rows AS (
    SELECT doc_id, coalesce(text, '') AS text, doc_id::VARCHAR AS key FROM documents
),
bytes AS (
    SELECT doc_id, unnest(range(strlen(text) - 1, -1, -1)) AS d,
        ('0x' || unnest(regexp_extract_all(hex(encode(text)), '..')))::BIGINT AS b
    FROM rows
    UNION ALL SELECT doc_id, strlen(text), 256 FROM rows
),
blocks AS (
    SELECT doc_id, bytes.d // 256 AS h, bit_xor(low.v) AS v
    FROM bytes JOIN low ON low.d = bytes.d % 256 AND low.b = bytes.b
    GROUP BY 1, 2
),
sums AS (
    SELECT doc_id, xor(4294967295, bit_xor(high.v)) AS text_crc32
    FROM blocks JOIN high ON high.h = blocks.h AND (blocks.v >> high.j::INT) & 1 = 1
    GROUP BY doc_id
),
draws AS (
    SELECT doc_id, s, ('0x' || substr(md5(key || '/' || s), 1, 13))::BIGINT AS draw
    FROM rows, unnest(range(25)) t(s)
),
won AS (
    SELECT doc_id, arg_max(s, draw) FILTER (s < 24) AS shard, arg_max(s, draw) AS grown_shard
    FROM draws GROUP BY doc_id
)
SELECT doc_id, strlen(text) + 8 AS size, text_crc32, 'key' AS law, shard::INT AS shard,
    grown_shard::INT AS grown_shard,
    row_number() OVER (PARTITION BY shard ORDER BY substr(md5(key), 1, 3), doc_id) - 1 AS slot
FROM rows JOIN sums USING (doc_id) JOIN won USING (doc_id)
"""


@query
def op2_packing(spark, folder):
    return packing.pack(_documents(spark, folder)).drop("ids")


@query
def op3_token_counts(spark, folder):
    return token_counts.with_suffix_sums(token_counts.length_histogram(_documents(spark, folder)))


@query
def op4_decontamination(spark, folder):
    found = phrase_index.matches(_documents(spark, folder), read_table(spark, folder, "benchmark"))
    return phrase_index.contamination(found)


SQL["op4_decontamination"] = r"""
WITH folded AS (
    SELECT doc_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
),
item_words AS (
    SELECT item_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM benchmark
),
item_windows AS (
    SELECT DISTINCT item_id, least(len(words), 13) AS width,
        array_to_string(words[i:i + least(len(words), 13) - 1], ' ') AS phrase
    FROM item_words, LATERAL unnest(range(1, greatest(len(words) - 12, 1) + 1)) t(i)
    WHERE len(words) > 0
),
widths AS (SELECT DISTINCT width FROM item_windows),
doc_windows AS (
    SELECT doc_id, i, width, array_to_string(words[i:i + width - 1], ' ') AS phrase
    FROM folded, widths, LATERAL unnest(range(1, len(words) - width + 2)) t(i)
),
found AS (
    SELECT doc_id, i, item_id, width FROM doc_windows JOIN item_windows USING (width, phrase)
),
hits AS (
    SELECT doc_id, count(DISTINCT i + j) AS n_hit
    FROM found, LATERAL unnest(range(width)) t(j) GROUP BY doc_id
),
items AS (
    SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS digest
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, coalesce(len(words), 0) AS n_words, coalesce(n_hit, 0) AS n_hit,
    coalesce(n_items, 0) AS n_items, coalesce(digest, sha256('')) AS items_sha256,
    coalesce(n_hit > 0 AND 20 * n_hit >= len(words), false) AS contaminated
FROM folded LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op5_chat_formatting(spark, folder):
    rows = read_table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    tricky = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame(
        [(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], rows.schema
    )
    return chat.digest(chat.format_conversations(rows.unionByName(extra)))


SQL["op5_chat_formatting"] = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'),
        (-7, 1, 'assistant', '\### Assistant: </turn> ok')
),
marked AS (
    SELECT *, length(text) + length(regexp_replace(text, '[^\\<>]', '', 'g')) AS escaped,
        length(role) + length(regexp_replace(role, '[^\\<>]', '', 'g')) AS escaped_role,
        role IS DISTINCT FROM lag(role) OVER (
            PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS opens
    FROM rows
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), ''
        ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
        FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(escaped + CASE WHEN opens THEN escaped_role + 7 + 8 ELSE 6 END)::BIGINT
        AS formatted_chars
FROM marked GROUP BY conv_id
"""


@query
def op6_secret_scan(spark, folder):
    return secrets.digest(secrets.scan(_documents(spark, folder)))


@query
def op7_language_id(spark, folder):
    return language.languages(_documents(spark, folder))


@query
def op8_exact_dedup(spark, folder):
    return exact_dedup.equal_texts(_documents(spark, folder))


SQL["op8_exact_dedup"] = r"""
WITH rows AS (
    SELECT doc_id, length(coalesce(text, '')) AS n_chars,
        sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
    FROM documents
),
ranked AS (
    SELECT *, first_value(doc_id) OVER w AS keep_id,
        count(*) OVER (PARTITION BY text_sha256) AS group_size
    FROM rows WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked
"""


@query
def op9_lm_scoring(spark, folder):
    scored = lm_score.score(_documents(spark, folder), lm_score.ORDER)
    return scored.withColumn("log_score", F.round("log_score", 4))


SQL["op9_lm_scoring"] = r"""
WITH folded AS (
    SELECT doc_id, coalesce(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+'), []) AS words
    FROM documents
),
places AS (
    SELECT doc_id, unnest(words) AS w1, unnest(range(len(words))) AS i FROM folded
),
grams AS (
    SELECT *, lag(w1) OVER w AS w2, lag(w1, 2) OVER w AS w3
    FROM places WINDOW w AS (PARTITION BY doc_id ORDER BY i)
),
counted AS (
    SELECT *, count(*) OVER (PARTITION BY w1) - count(*) OVER (PARTITION BY doc_id, w1) AS c1,
        count(*) OVER (PARTITION BY w2, w1) - count(*) OVER (PARTITION BY doc_id, w2, w1) AS c2,
        count(*) OVER (PARTITION BY w3, w2, w1)
            - count(*) OVER (PARTITION BY doc_id, w3, w2, w1) AS c3,
        (SELECT count(*) FROM places) - count(*) OVER (PARTITION BY doc_id) AS n
    FROM grams
),
with_contexts AS (
    SELECT *, lag(c1) OVER w AS before1, lag(c2) OVER w AS before2
    FROM counted WINDOW w AS (PARTITION BY doc_id ORDER BY i)
),
scored AS (
    SELECT doc_id, count(*) AS n_words,
        count(*) FILTER (CASE WHEN i > 1 THEN c3 = 0 ELSE i = 1 AND c2 = 0 END) AS n_backed_off,
        count(*) FILTER (c1 = 0) AS n_unseen,
        sum(CASE WHEN i > 1 AND c3 > 0 THEN ln(c3 / before2)
            WHEN i > 0 AND c2 > 0 THEN ln(c2 / before1) + ln(0.4) * (least(i, 2) - 1)
            ELSE ln(greatest(c1, 0.5) / greatest(n, 1)) + ln(0.4) * least(i, 2)
            END) AS log_score
    FROM with_contexts GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_backed_off, 0) AS n_backed_off,
    coalesce(n_unseen, 0) AS n_unseen, round(coalesce(log_score, 0), 4) AS log_score
FROM documents LEFT JOIN scored USING (doc_id)
"""


@query
def op10_ngram_join(spark, folder):
    return ngram_join.similar(_documents(spark, folder)).select(
        "doc_id", "n_shingles", "component_id"
    )


SQL["op10_ngram_join"] = r"""
WITH RECURSIVE folded AS (
    SELECT doc_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS words
    FROM documents
),
shingles AS (
    SELECT DISTINCT doc_id,
        hash(array_to_string(words[i:i + least(len(words), 5) - 1], ' ')) AS shingle
    FROM folded, LATERAL unnest(range(1, greatest(len(words) - 4, 1) + 1)) t(i)
    WHERE len(words) > 0
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
    GROUP BY 1, 2
),
links AS (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * shared >= 80 * (x.n + y.n - shared)
),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION
    SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.other
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
LEFT JOIN sizes USING (doc_id)
"""


@query
def op11_conversation_repair(spark, folder):
    rows = read_table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return repair.audited(repair.damage(rows))


# One step of the recursion is one turn: at most one turn is inserted before it (more would only
# cost), and the states are the phases. Cheaper first, then the lesser audit.
SQL["op11_conversation_repair"] = r"""
WITH RECURSIVE keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
    FROM conversations
),
hashed AS (
    SELECT *, xor(4294967295, list_reduce(
        [4294967295::BIGINT] || list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT),
        lambda s, b: list_reduce([xor(s, b)] || range(8), lambda x, i:
            CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 20 AS kind
    FROM keyed
),
damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g')
            ELSE text END AS text,
        unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM hashed
),
placed AS (
    SELECT *, row_number() OVER w AS i, row_number() OVER (
            PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
        left(lag(role) OVER w, 1) || left(role, 1) AS pair,
        NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
        regexp_matches(text, '[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*$') AS cut
    FROM damaged
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy)
),
rows AS (
    SELECT conv_id, turn, i, role, text, left(role, 1) AS initial, pair, blank,
        NOT blank AND again AS duplicate, NOT blank AND NOT again AND cut AS truncated
    FROM placed
),
stats AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
        count(*) FILTER (truncated) AS truncated, max(i) AS n,
        count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM rows GROUP BY conv_id
),
inserts AS (
    SELECT * FROM (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''),
        (0, 2, 2, 'I'), (1, 2, 2, 'I'), (2, 3, 2, 'I'), (3, 2, 2, 'I')) t(p, q, price, letters)
),
edits AS (
    SELECT * FROM (VALUES (0, 's', 1, 0, 'K'), (0, 'u', 2, 0, 'K'), (1, 'u', 2, 0, 'K'),
        (3, 'u', 2, 0, 'K'), (2, 'a', 3, 0, 'K'), (0, '', 2, 2, 'R'), (1, '', 2, 2, 'R'),
        (3, '', 2, 2, 'R'), (2, '', 3, 2, 'R'), (0, '', 0, 3, 'D'), (1, '', 1, 3, 'D'),
        (2, '', 2, 3, 'D'), (3, '', 3, 3, 'D')) t(p, initial, q, price, letter)
),
states AS (
    SELECT conv_id, 0::BIGINT AS i, 0 AS phase, {'c': 0::BIGINT, 'a': ''} AS way FROM stats
    UNION ALL
    SELECT conv_id, i, phase, way FROM (
        SELECT r.conv_id, r.i, e.q AS phase, min({
            'c': s.way.c + n.price + e.price + CASE WHEN r.truncated AND e.letter <> 'D'
                THEN 1 ELSE 0 END, 'a': s.way.a || n.letters || e.letter}) AS way
        FROM states s
        JOIN rows r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i + 1
        JOIN inserts n ON n.p = s.phase
        JOIN edits e ON e.p = n.q AND (e.initial = '' OR e.initial = r.initial)
            AND (e.letter = 'D' OR NOT (r.blank OR r.duplicate))
        GROUP BY r.conv_id, r.i, e.q
    )
),
solved AS (
    SELECT s.conv_id, min({'c': s.way.c + t.price, 'a': s.way.a || t.letters}) AS way
    FROM states s JOIN stats n ON n.conv_id IS NOT DISTINCT FROM s.conv_id AND n.n = s.i
    JOIN (VALUES (0, 0, ''), (1, 4, 'II'), (2, 2, 'I'), (3, 0, '')) t(p, price, letters)
        ON t.p = s.phase
    GROUP BY s.conv_id
),
letters AS (
    SELECT conv_id, unnest(range(1, length(way.a) + 1)) AS place,
        unnest(string_split(way.a, '')) AS letter
    FROM solved WHERE way.a <> ''
),
numbered AS (
    SELECT *, sum(CASE WHEN letter = 'I' THEN 0 ELSE 1 END) OVER (
        PARTITION BY conv_id ORDER BY place)::BIGINT AS i
    FROM letters
),
stay AS (
    SELECT m.conv_id, m.place, m.letter, r.role, CASE WHEN m.letter = 'I' THEN '' ELSE r.text END AS text,
        row_number() OVER (PARTITION BY m.conv_id ORDER BY m.place) AS k,
        first_value(m.letter = 'K' AND r.initial = 's') OVER (
            PARTITION BY m.conv_id ORDER BY m.place) AS led
    FROM numbered m LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM m.conv_id AND r.i = m.i
    WHERE m.letter <> 'D'
),
lines AS (
    SELECT conv_id, place, CASE WHEN letter = 'K' THEN role
        WHEN (k - led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text AS line
    FROM stay
),
mended AS (
    SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY place)) AS digest
    FROM lines GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
    coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, coalesce(way.c, 0) AS cost, coalesce(way.a, '') AS audit,
    coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN stats ON stats.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN solved ON solved.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN mended ON mended.conv_id IS NOT DISTINCT FROM c.conv_id
"""


@query
def op12_source_divergence(spark, folder):
    return divergence.audit(_documents(spark, folder))


SQL["op12_source_divergence"] = r"""
WITH folded AS (
    SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
),
counts AS (
    SELECT lang, source, term, count(*) AS n, count(DISTINCT row) AS docs
    FROM (SELECT lang, source, row, unnest(terms) AS term FROM folded) GROUP BY ALL
),
kept AS (
    SELECT lang, term, sum(n)::HUGEINT AS n FROM counts GROUP BY lang, term HAVING sum(docs) >= 30
),
langs AS (
    SELECT lang, coalesce(n, 0)::HUGEINT AS n, coalesce(v, 0)::HUGEINT AS v
    FROM (SELECT DISTINCT lang FROM folded)
    LEFT JOIN (SELECT lang, sum(n) AS n, count(*) AS v FROM kept GROUP BY lang) USING (lang)
),
groups AS (
    SELECT lang, source, coalesce(n, 0)::HUGEINT AS n
    FROM (SELECT DISTINCT lang, source FROM folded) LEFT JOIN (
        SELECT lang, source, sum(counts.n) AS n FROM counts SEMI JOIN kept USING (lang, term)
        GROUP BY lang, source) USING (lang, source)
),
shares AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        1 + 1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT // (g.n + 5 * l.v) AS p,
        1 + 1000000000 * (k.n + 5) // (l.n + 5 * l.v) AS q
    FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang)
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
    GROUP BY ALL
),
found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value,
    row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM found
QUALIFY part = 'pair' OR rank <= 50
"""


@query
def op13_inner_product_search(spark, folder):
    return inner_search.nearest(read_table(spark, folder, "embeddings"))


SQL["op13_inner_product_search"] = """
WITH usable AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x:
        x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT a.vec_id AS query_id, b.vec_id, coalesce(list_sum(list_transform(
        list_zip(a.v, b.v), lambda z: coalesce(z[1] * z[2], 0))), 0)::BIGINT AS score
    FROM usable a JOIN usable b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, row_number() OVER w::INT AS rank, vec_id, score FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY rank <= 5
"""
