"""DuckDB SQL of the numbered queries that SQL can express on whole tables.

The other queries rest on trained models, published tokenizers or byte positions; the
tests compare them with plain versions or held-out labels.
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_COMPONENTS = """
    both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach AS (
        SELECT a AS node, a AS other FROM both_ways
        UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON l.a = r.other),
    component AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)"""

_VECTORS = f"""
WITH RECURSIVE
    usable AS (
        SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_dot_product(e, e)) AS size
        FROM embeddings
        WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
        ON a.vec_id < b.vec_id AND len(a.e) = len(b.e)
        AND list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.9),
    {_COMPONENTS},
    degree AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT v.vec_id, coalesce(d.n, 0) AS n_links, coalesce(c.component_id, v.vec_id) AS component_id,
       coalesce(c.component_id, v.vec_id) = v.vec_id AS kept
FROM embeddings v LEFT JOIN degree d ON d.a = v.vec_id LEFT JOIN component c ON c.node = v.vec_id
"""

_COPIES = f"""
WITH RECURSIVE
    worded AS (
        SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
    shingles AS (
        SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
        FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i
              FROM worded WHERE len(words) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    common AS (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
        FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id < y.doc_id
        GROUP BY x.doc_id, y.doc_id),
    links AS (
        SELECT c.a, c.b FROM common c JOIN sizes p ON p.doc_id = c.a JOIN sizes q ON q.doc_id = c.b
        WHERE 100 * c.n >= 75 * (p.n + q.n - c.n)),
    {_COMPONENTS}
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id,
       coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN component c ON c.node = d.doc_id
"""

_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LEAKS = f"""
WITH
    items AS (SELECT item_id, regexp_extract_all({_LOWER}, {_WORD}) AS words FROM benchmark),
    windows AS (
        SELECT DISTINCT item_id, words[i:i + 9] AS passage
        FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i
              FROM items WHERE len(words) > 0)),
    docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS words FROM documents),
    lengths AS (SELECT DISTINCT len(passage) AS size FROM windows),
    places AS (
        SELECT doc_id, size, i, array_to_string(words[i:i + size - 1], ' ') AS passage
        FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i
              FROM docs, lengths WHERE len(words) >= size)),
    found AS (
        SELECT p.doc_id, p.i, p.size, w.item_id FROM places p
        JOIN windows w ON len(w.passage) = p.size AND array_to_string(w.passage, ' ') = p.passage),
    hit AS (
        SELECT doc_id, count(DISTINCT place) AS n
        FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM found) GROUP BY doc_id),
    which AS (
        SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.words) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(w.n, 0) AS n_items,
       sha256(coalesce(w.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit h ON h.doc_id = d.doc_id LEFT JOIN which w ON w.doc_id = d.doc_id
"""

# The first turns that conversation c takes: crc32 of its decimal form, bit by bit, modulo 6.
_TRIE = """
WITH
    own AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place
        FROM conversations WHERE conv_id IS NOT NULL),
    ids AS (
        SELECT conv_id, conv_id - conv_id % 100 AS base,
               xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                   lambda crc, c: list_reduce(list_prepend(xor(crc, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                       lambda v, bit: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)),
                   4294967295::BIGINT) % 6 AS kept
        FROM (SELECT DISTINCT conv_id FROM own)),
    heads AS (
        SELECT i.conv_id, o.place, o.role, o.text FROM ids i JOIN own o ON o.conv_id = i.base AND o.place < i.kept),
    rebuilt AS (
        SELECT conv_id, 0 AS part, place, role, text FROM heads
        UNION ALL
        SELECT i.conv_id, 1, o.place, o.role, o.text FROM ids i JOIN own o ON o.conv_id = i.conv_id AND o.place >= i.kept),
    gathered AS (
        SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY part, place) AS turns FROM rebuilt GROUP BY conv_id),
    sequences AS (
        SELECT i.conv_id, coalesce(g.turns, []) AS turns FROM ids i LEFT JOIN gathered g ON g.conv_id = i.conv_id),
    members AS (
        SELECT conv_id, depth, turns[1:depth] AS path, turns
        FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM sequences)),
    nodes AS (
        SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
               coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(turns) = depth), '') AS ends
        FROM members GROUP BY path, depth),
    children AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
    valued AS (
        SELECT n.*, coalesce(c.n, 0) AS n_children, CASE WHEN c.n IS NULL THEN 1 ELSE 0 END AS leaf,
               CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * length(n.path[n.depth].t) END AS worth
        FROM nodes n LEFT JOIN children c ON c.path = n.path),
    subtrees AS (
        SELECT path[1:above] AS path, sum(leaf) AS n_leaves, sum(worth) AS saved_tokens
        FROM (SELECT *, unnest(range(0, depth + 1)) AS above FROM valued) GROUP BY 1)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM valued v JOIN subtrees s ON s.path = v.path
LEFT JOIN nodes p ON v.depth > 0 AND p.depth = v.depth - 1 AND p.path = v.path[1:v.depth - 1]
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_near_vectors": _VECTORS, "op2_near_copies": _COPIES, "op6_decontaminate": _LEAKS, "op13_prefix_trie": _TRIE}
