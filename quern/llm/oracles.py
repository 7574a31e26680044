"""SQL for DuckDB that states the results of those training-data queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

SUBSTRING_DEDUP = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
places AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS pos FROM w WHERE len(words) >= 20),
windows AS (SELECT doc_id, pos, array_to_string(list_slice(words, pos, pos + 19), ' ') AS content FROM places),
later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY content ORDER BY doc_id, pos) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, pos + step AS pos FROM later, (SELECT unnest(range(0, 20)) AS step)),
single AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
kept AS (SELECT s.doc_id, count(*) AS n, string_agg(s.word, ' ' ORDER BY s.pos) AS words FROM single s LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.pos = s.pos WHERE g.pos IS NULL GROUP BY s.doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(len(w.words) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.words, '')) AS kept_sha256 FROM w LEFT JOIN kept k ON k.doc_id = w.doc_id
"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS weights FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.weights, c.weights) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS words FROM benchmark),
places AS (SELECT item_id, words, least(10, len(words)) AS n, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS pos FROM b WHERE len(words) > 0),
items AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(words, pos, pos + n - 1), ' ') AS content FROM places),
sizes AS (SELECT DISTINCT n FROM items),
spots AS (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS pos FROM d, sizes WHERE len(words) >= n),
found AS (SELECT s.doc_id, s.pos, s.n, i.item_id FROM (SELECT doc_id, pos, n, array_to_string(list_slice(words, pos, pos + n - 1), ' ') AS content FROM spots) s JOIN items i ON i.n = s.n AND i.content = s.content),
hit AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS word FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items, sha256(coalesce(m.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit h ON h.doc_id = d.doc_id LEFT JOIN named m ON m.doc_id = d.doc_id
"""


#: What a work says when it is under a license: the names of licenses behind a verb, or their identifiers, as whole words.
#: The texts of licenses themselves are in none of the tables.
LICENSE_SCAN = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS words FROM documents),
told AS (SELECT *, ' ' || array_to_string(words, ' ') || ' ' AS said FROM d),
gnu(label, name) AS (VALUES ('gpl-2.0', 'gnu general public license version 2'), ('gpl-3.0', 'gnu general public license version 3'), ('lgpl-2.1', 'gnu lesser general public license version 2 1'),
    ('lgpl-3.0', 'gnu lesser general public license version 3'), ('agpl-3.0', 'gnu affero general public license version 3')),
other(label, name) AS (VALUES ('mit', 'mit license'), ('apache-2.0', 'apache license version 2 0'), ('mpl-2.0', 'mozilla public license version 2 0'), ('bsd-2-clause', 'bsd 2 clause license'), ('bsd-3-clause', 'bsd 3 clause license'),
    ('isc', 'isc license'), ('zlib', 'zlib license'), ('epl-2.0', 'eclipse public license version 2 0'), ('bsl-1.0', 'boost software license version 1 0'), ('ofl-1.1', 'sil open font license version 1 1')),
named AS (SELECT * FROM gnu UNION ALL SELECT * FROM other),
by_name AS (SELECT label, ' ' || verb || ' under the ' || name || ' ' AS phrase FROM named, (SELECT unnest(['licensed', 'released', 'distributed', 'available']) AS verb)),
by_mark AS (SELECT label, ' spdx license identifier ' || replace(replace(label, '-', ' '), '.', ' ') || ' ' AS phrase FROM named),
kinds(kind, conditions) AS (VALUES ('by', 'attribution'), ('by-sa', 'attribution sharealike'), ('by-nc', 'attribution noncommercial'), ('by-nc-sa', 'attribution noncommercial sharealike'), ('by-nd', 'attribution noderivatives'), ('by-nc-nd', 'attribution noncommercial noderivatives')),
versions(version, suffix) AS (VALUES ('3.0', 'unported'), ('4.0', 'international')),
commons AS (SELECT 'cc-' || kind || '-' || version AS label, unnest([' licensed under cc ' || replace(kind, '-', ' ') || ' ' || replace(version, '.', ' ') || ' ', ' licensed under a creative commons ' || conditions || ' ' || replace(version, '.', ' ') || ' ' || suffix || ' license ']) AS phrase FROM kinds, versions),
statements AS (SELECT * FROM by_name UNION ALL SELECT * FROM by_mark UNION ALL SELECT * FROM commons),
found AS (SELECT doc_id, list(DISTINCT label) AS labels FROM told JOIN statements ON contains(said, phrase) GROUP BY doc_id),
phrases(phrase, label) AS (VALUES (['mit', 'license'], 'mit'), (['apache', 'license'], 'apache'), (['general', 'public', 'license'], 'gpl')),
spots AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS pos FROM d),
base AS (SELECT s.doc_id, s.pos - 1 AS start, p.label FROM spots s JOIN phrases p ON list_slice(s.words, s.pos, s.pos + len(p.phrase) - 1) = p.phrase),
counted AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM base GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(n.n_base, 0) AS n_base, n.first_word, n.last_word, coalesce(array_to_string(n.labels, ','), '') AS base_labels,
    array_to_string(list_sort(list_distinct(list_concat(coalesce(n.labels, []), coalesce(f.labels, [])))), ',') AS labels, CASE WHEN n.n_base > 0 OR len(f.labels) > 0 THEN 1.0::double ELSE 0.0::double END AS score
FROM d LEFT JOIN counted n ON n.doc_id = d.doc_id LEFT JOIN found f ON f.doc_id = d.doc_id
"""

#: Hexadecimal digits stand for bytes; equal strings are told by their digests.
SUFFIX_DEDUP = """WITH texts AS (
    SELECT row_number() OVER () AS row_no, doc_id, hex(encode(coalesce(text, ''))) AS hexed FROM documents),
starts AS (
    SELECT row_no, place, substr(hexed, 1 + 2 * place, 800) AS string
    FROM (SELECT row_no, hexed, unnest(range(0, length(hexed) // 2 - 399)) AS place FROM texts)),
repeated AS (SELECT row_no, place FROM (SELECT row_no, place, count(*) OVER (PARTITION BY md5_number(string)) AS times FROM starts) WHERE times > 1),
numbered AS (
    SELECT row_no, place, sum(CASE WHEN place <= before + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY row_no ORDER BY place) AS span
    FROM (SELECT row_no, place, coalesce(lag(place) OVER (PARTITION BY row_no ORDER BY place), -401) AS before FROM repeated)),
spans AS (SELECT row_no, span, min(place) AS a, max(place) + 400 AS b FROM numbered GROUP BY row_no, span),
pieces AS (
    SELECT row_no, a, coalesce(lag(b) OVER (PARTITION BY row_no ORDER BY a), 0) AS kept_from, b FROM spans),
gone AS (
    SELECT p.row_no, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last,
        string_agg(substr(hexed, 1 + 2 * kept_from, 2 * (a - kept_from)), '' ORDER BY a) AS before_last
    FROM pieces p JOIN texts t ON p.row_no = t.row_no GROUP BY p.row_no)
SELECT doc_id, CAST(length(hexed) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
    CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
    sha256(unhex(coalesce(before_last || substr(hexed, 1 + 2 * last), hexed))) AS kept_sha256
FROM texts LEFT JOIN gone ON texts.row_no = gone.row_no
"""
