"""The queries of this subpackage, op1_ to op13_ and pipeline, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bytenet as op2
from tidemark.llm import exact as op4
from tidemark.llm import jaccard as op7
from tidemark.llm import merkle as op13
from tidemark.llm import mixing as op10
from tidemark.llm import personal as op5
from tidemark.llm import pieces as op6
from tidemark.llm import rules as op3
from tidemark.llm import secrets as op1
from tidemark.llm import spelling as op11
from tidemark.llm import token_files as op9
from tidemark.llm import toxicity as op12
from tidemark.llm import warc as op8
from tidemark.llm.common import prepare, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = lambda spark, sf_dir: run(prepare(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


@query("op1_secrets")
def secrets(spark, sf_dir):
    return op1.secrets(table(spark, sf_dir, "documents"))


@query("op2_quality_classifier")
def quality_classifier(spark, sf_dir):
    return op2.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


RULES_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
    SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
           list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
    FROM d),
p AS (
    SELECT r, unnest(ws[1:len(ws) - 2]) AS a, unnest(ws[2:len(ws) - 1]) AS b,
           unnest(ws[3:len(ws)]) AS c,
           unnest(range(1, len(ws) - 1)) AS pos
    FROM w WHERE len(ws) >= 3),
v AS (SELECT r, pos, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM p),
c AS (
    SELECT r, count(DISTINCT pos + k) AS n_repeat_words
    FROM v, (SELECT unnest([0, 1, 2]) AS k) WHERE n >= 2 GROUP BY r),
b AS (
    SELECT w.*, len(ws)::BIGINT AS n_words,
           length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
           (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
           (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
           coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
    FROM w LEFT JOIN c USING (r)),
f AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS capitals,
           length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS letters,
           length(text) - length(replace(text, '!', '')) AS exclamations,
           length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS digits
    FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 30 * n_words OR n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * len(ls)
            OR word_chars < 2 * n_words OR word_chars > 16 * n_words
            OR 100 * capitals > 60 * (letters + 1) OR 100 * exclamations > 50 * n_words
            OR 100 * digits > 30 * word_chars) AS kept
FROM f
"""


@query("op3_quality_rules", RULES_SQL)
def quality_rules(spark, sf_dir):
    return op3.quality_rules(table(spark, sf_dir, "documents"))


EXACT_SQL = """
WITH t AS (
    SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
    FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM t WINDOW same AS (PARTITION BY text_sha256)
"""


@query("op4_exact_dedup", EXACT_SQL)
def exact_dedup(spark, sf_dir):
    return op4.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op5_personal_data")
def personal_data(spark, sf_dir):
    return op5.personal_data(table(spark, sf_dir, "documents"))


@query("op6_sentence_pieces")
def sentence_pieces(spark, sf_dir):
    return op6.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op7_jaccard_join")
def jaccard_join(spark, sf_dir):
    return op7.jaccard_groups(table(spark, sf_dir, "documents"))


WARC_SQL = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
           sha256(coalesce(html, '')) AS payload_digest
    FROM pages),
f AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


@query("op8_warc", WARC_SQL)
def warc(spark, sf_dir):
    return op8.archives(table(spark, sf_dir, "pages"))


@query("op9_token_files")
def token_files(spark, sf_dir):
    return op9.token_files(table(spark, sf_dir, "documents"),
                           public_tokenizers.path("byte_bpe_50k.json"))


@query("op10_mixing")
def mixing(spark, sf_dir):
    return op10.mix(table(spark, sf_dir, "documents"))


# crc32 bit by bit, lowest first, of a text whose code points have one or two bytes in UTF-8.
CRC_SQL = """
xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
    flatten(list_transform(string_split({text}, ''), lambda c: CASE
        WHEN c = '' THEN []::BIGINT[] WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT]
        ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)]::BIGINT[] END)),
    lambda b: list_transform(range(8), lambda i: (b >> i) & 1)))),
    lambda a, x: xor(a >> 1, 3988292384 * (xor(a, x) & 1))))"""

SPELLING_SQL = r"""
WITH RECURSIVE t AS (
    SELECT coalesce(doc_id::VARCHAR, '') AS id,
           unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run
    FROM documents),
r AS (
    SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run,
           count(*) AS k
    FROM t GROUP BY ALL),
h AS (SELECT run, k, length(run) AS size, """ + CRC_SQL.format(text="id || ':' || run") + """ AS crc FROM r),
w AS (
    SELECT CASE WHEN crc % 199 = 0 THEN left(run, crc % size) || substr(run, crc % size + 2)
                ELSE run END AS word, k
    FROM h),
v AS (
    SELECT word, sum(k)::BIGINT AS n FROM w WHERE length(word) >= 6
    GROUP BY word HAVING sum(k) >= 5),
d AS (
    SELECT word, i, left(word, i) || substr(word, i + 2) AS less
    FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
p AS (
    SELECT a.word, b.word AS other FROM d a JOIN d b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
    UNION SELECT d.word, v.word FROM d JOIN v ON d.less = v.word
    UNION SELECT v.word, d.word FROM d JOIN v ON d.less = v.word),
b AS (
    SELECT p.word, count(*) AS n_near, first(p.other ORDER BY o.n DESC, p.other) AS best,
           max(o.n) AS best_n
    FROM p JOIN v o ON o.word = p.other GROUP BY p.word),
f AS (
    SELECT v.word, n, coalesce(n_near, 0) AS n_near,
           CASE WHEN best_n >= 5 * n THEN best END AS form,
           CASE WHEN best_n >= 5 * n THEN best_n END AS form_n
    FROM v LEFT JOIN b USING (word)),
walk AS (
    SELECT word, word AS at FROM f
    UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NOT NULL),
ends AS (SELECT walk.word, walk.at AS root FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN ends USING (word)
"""


@query("op11_spelling_variants", SPELLING_SQL)
def spelling_variants(spark, sf_dir):
    return op11.spelling_variants(table(spark, sf_dir, "documents"))


@query("op12_toxicity")
def toxicity(spark, sf_dir):
    return op12.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


MANIFEST_SQL = """
WITH RECURSIVE d AS (
    SELECT row_number() OVER () AS r, *, """ + CRC_SQL.format(text="coalesce(doc_id::VARCHAR, '')") + """ AS crc
    FROM documents),
x AS (
    SELECT *, concat(
        coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'),
        coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
        coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
        CASE WHEN crc % 3 = 0
             THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
             ELSE text END AS changed
    FROM d),
h AS (
    SELECT r, doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
           sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) AS changed
    FROM x),
leaves AS (
    SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
           row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
           count(*) OVER (PARTITION BY lang) AS size
    FROM h),
nodes AS (
    SELECT tree, 0 AS level, pos, size, leaf AS hash FROM leaves
    UNION ALL
    SELECT tree, level + 1, pos // 8, (any_value(size) + 7) // 8, sha256(string_agg(hash, '' ORDER BY pos))
    FROM nodes WHERE size > 1 GROUP BY tree, level, pos // 8),
subroots AS (SELECT tree, hash FROM nodes WHERE size = 1),
top AS (
    SELECT 0 AS level, tree AS pos, (SELECT count(*) FROM subroots) AS size, hash FROM subroots
    UNION ALL
    SELECT level + 1, pos // 8, (any_value(size) + 7) // 8, sha256(string_agg(hash, '' ORDER BY pos))
    FROM top WHERE size > 1 GROUP BY level, pos // 8),
runs AS (
    SELECT tree, level, pos // 8 AS up, list(hash ORDER BY pos) AS hs
    FROM nodes WHERE size > 1 GROUP BY ALL
    UNION ALL SELECT -1, level, pos // 8 AS up, list(hash ORDER BY pos) FROM top WHERE size > 1 GROUP BY ALL),
inner_walk AS (
    SELECT r, tree, 0 AS level, pos, changed AS folded, '' AS proof FROM leaves
    UNION ALL
    SELECT w.r, w.tree, w.level + 1, w.pos // 8,
           sha256(array_to_string(hs[1:w.pos % 8], '') || folded || array_to_string(hs[w.pos % 8 + 2:], '')),
           proof || array_to_string(hs[1:w.pos % 8], '') || array_to_string(hs[w.pos % 8 + 2:], '')
    FROM inner_walk w JOIN runs ON runs.tree = w.tree AND runs.level = w.level AND up = w.pos // 8),
walk AS (
    SELECT r, 0 AS level, tree AS pos, folded, proof
    FROM (SELECT r, tree, arg_max(folded, level) AS folded, arg_max(proof, level) AS proof
          FROM inner_walk GROUP BY r, tree)
    UNION ALL
    SELECT w.r, w.level + 1, w.pos // 8,
           sha256(array_to_string(hs[1:w.pos % 8], '') || folded || array_to_string(hs[w.pos % 8 + 2:], '')),
           proof || array_to_string(hs[1:w.pos % 8], '') || array_to_string(hs[w.pos % 8 + 2:], '')
    FROM walk w JOIN runs ON runs.tree = -1 AND runs.level = w.level AND up = w.pos // 8),
ends AS (SELECT r, arg_max(folded, level) AS folded, arg_max(proof, level) AS proof FROM walk GROUP BY r)
SELECT doc_id, leaf, s.hash AS subroot, t.hash AS root, sha256(proof) AS proof_sha256,
       folded AS folded_root, folded = t.hash AS verified
FROM leaves JOIN ends USING (r) JOIN subroots s USING (tree), (SELECT hash FROM top WHERE size = 1) t
"""


@query("op13_merkle_manifest", MANIFEST_SQL)
def merkle_manifest(spark, sf_dir):
    return op13.manifest(table(spark, sf_dir, "documents"))
