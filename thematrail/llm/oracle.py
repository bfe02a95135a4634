"""DuckDB SQL that gives the rows of the registered queries, written from their contracts."""

from __future__ import annotations

# every word stands between spaces of its own here, as RE2 knows word ends for ASCII only
_SPELLINGS = [
    (r" (?:(sub|un) *)?licen[cs](e|es|ed|ing|ee|ees|able) ", r" \1licens\2 "),
    (r" ([a-z]{3,})is(e|es|ed|ing|ation|ations) ", r" \1iz\2 "),
    (r" (hon|fav|lab|col)our", r" \1or"),
    (r" whilst ", " while "),
    (r" per +cent ", " percent "),
    (r" (acknowledg|judg)ement", r" \1ment"),
    (r" copyright +owner", " copyright  holder"),
    (r" non +(commercial|infringement|exclusive)", r" non\1"),
    (r" (program|catalog|analog)(me|ue)(s?) ", r" \1\3 "),
    (r" https?( +www)? ", " http "),
]


def _canonical(text: str) -> str:
    value = rf"regexp_replace(lower(coalesce({text}, '')), '(?m)^[^\n\pL]*(?:copyright|\(c\)|©)[^\n]*[0-9]{{4}}[^\n]*$|^[^\n\pL]*(?:copyright \(c\)|©)[^\n]*$|^[^\n\pL]*all rights reserved[^\n\pL]*$', '', 'g')"
    value = rf"' ' || regexp_replace(regexp_replace({value}, '[^\pL\pN\n]+', '  ', 'g'), '\n', ' ' || chr(10) || ' ', 'g') || ' '"
    for pattern, one in _SPELLINGS:
        value = f"regexp_replace({value}, '{pattern}', '{one}', 'g')"
    value = f"regexp_replace({value}, ' +', ' ', 'g')"
    return f"list_filter(list_transform(string_split({value}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


SQL = {
    "op1_collision_counts": """
        WITH RECURSIVE vectors AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), sized AS (
            SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS norm FROM vectors WHERE list_dot_product(v, v) > 0
        ), links AS (
            SELECT a.vec_id AS x, b.vec_id AS y FROM sized a JOIN sized b
            ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.93
        ), reach AS (
            SELECT vec_id AS node, vec_id AS r FROM embeddings UNION SELECT reach.node, links.y FROM reach JOIN links ON reach.r = links.x
        ), least AS (
            SELECT node, min(r) AS component_id FROM reach GROUP BY node
        )
        SELECT e.vec_id, (SELECT count(*) FROM links WHERE x = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept
        FROM embeddings e JOIN least ON node = e.vec_id
    """,
    "op7_setsketch": """
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM words
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), links AS (
            SELECT x, y FROM (
                SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL)
            JOIN sizes nx ON nx.doc_id = x JOIN sizes ny ON ny.doc_id = y WHERE 100 * k >= 80 * (nx.n + ny.n - k)
        ), reach AS (
            SELECT doc_id AS node, doc_id AS r FROM documents UNION SELECT reach.node, links.y FROM reach JOIN links ON reach.r = links.x
        ), least AS (
            SELECT node, min(r) AS component_id FROM reach GROUP BY node
        )
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
        FROM documents d JOIN least ON node = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id
    """,
    # no document is a whole licence text: the notices that occur are looked up
    "op3_licence_digests": f"""
        WITH known AS (
            SELECT licence, sha256(array_to_string({_canonical('text')}, ' ')) AS known
            FROM (VALUES ('Apache-2.0', 'Licensed under the Apache License, Version 2.0.'), ('CC-BY-NC-4.0', 'Licensed under CC BY-NC 4.0.'),
                ('GPL-3.0', 'This work is licensed under the GNU General Public License, version 3.'), ('MIT', 'Released under the MIT License.')) n (licence, text)
        ), canonical AS (
            SELECT doc_id, {_canonical('text')} AS lines FROM documents
        ), found AS (
            SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices, count(*) AS n_notices
            FROM (SELECT doc_id, unnest(lines) AS line FROM canonical) l JOIN known ON known = sha256(line) GROUP BY doc_id
        )
        SELECT c.doc_id, sha256(array_to_string(lines, ' ')) AS text_digest, k.licence, coalesce(f.notices, '') AS notices, coalesce(f.n_notices, 0) AS n_notices
        FROM canonical c LEFT JOIN known k ON k.known = sha256(array_to_string(lines, ' ')) LEFT JOIN found f ON f.doc_id = c.doc_id
    """,
    "op5_merkle_audit": """
        WITH records AS (
            SELECT page_id, page_id // 1000 AS file, html, page_id % 211 AS n,
                'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
                || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
                || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
            FROM pages
        )
        SELECT page_id, file, coalesce(sum(strlen(record)) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
            strlen(record) AS length, sha256(record) AS digest,
            CASE WHEN html IS NULL OR n NOT IN (17, 101, 202) THEN 'intact' WHEN n = 202 THEN 'missing' WHEN html = '' AND n = 101 THEN 'intact' ELSE 'corrupt' END AS status
        FROM records
    """,
    "op4_digest_index": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
            doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op10_source_mix": """
        WITH sized AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
        ), sources AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::BIGINT AS w
            FROM sized GROUP BY source
        ), ranked AS (
            SELECT *, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS k FROM sources
        ), levels AS (  -- with the first k - 1 sources at their caps, twice the words left and the weights they are left to
            SELECT r.k, (SELECT 3 * sum(source_size) FROM ranked) - 4 * coalesce(sum(c.source_size), 0) AS rest,
                (SELECT sum(w) FROM ranked) - coalesce(sum(c.w), 0) AS rest_w
            FROM ranked r LEFT JOIN ranked c ON c.k < r.k GROUP BY r.k
        ), held AS (
            SELECT l.rest::DOUBLE AS rest, l.rest_w::DOUBLE AS rest_w, l.k FROM levels l JOIN ranked r USING (k)
            WHERE 4 * r.source_size * l.rest_w >= l.rest * r.w ORDER BY l.k LIMIT 1
        ), targets AS (
            SELECT r.source, r.source_size,
                CASE WHEN r.k < h.k THEN 2.0 * r.source_size ELSE r.w * h.rest / (2 * h.rest_w) END::DOUBLE AS target
            FROM ranked r, held h
        ), best AS (
            SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id
        ), drawn AS (
            SELECT s.doc_id, s.source, s.size,
                -ln((('0x' || substr(md5(s.doc_id || ':0'), 1, 13))::BIGINT + 1) / 4503599627370496.0)
                    / CASE b.quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END AS key
            FROM sized s LEFT JOIN best b USING (doc_id)
        ), summed AS (
            SELECT d.*, t.source_size, t.target,
                CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
                sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id) - size / 2.0 AS middle
            FROM drawn d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target,
            (size * (epochs + CASE WHEN target - epochs * source_size > 0 AND middle <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM summed
    """,
}


def _clusters(rounds: int = 10) -> str:
    """All rounds of the centroid clustering, one pair of tables each."""
    nearest = """SELECT vec_id, whole, away AS distance, cluster FROM (
  SELECT v.row, v.vec_id, v.whole, c.cluster, list_sum(list_transform(list_zip(v.whole, c.centroid), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS away
  FROM whole v, c{0} c) QUALIFY row_number() OVER (PARTITION BY row ORDER BY away, cluster) = 1"""
    steps = "".join(
        f""", a{n} AS MATERIALIZED ({nearest.format(n)}),
c{n + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(mean, centroid) AS centroid FROM c{n} LEFT JOIN (
    SELECT cluster, list(floor_mean ORDER BY d) AS mean FROM (
      SELECT cluster, d, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS floor_mean
      FROM (SELECT cluster, unnest(whole) AS x, generate_subscripts(whole, 1) AS d FROM a{n}) GROUP BY cluster, d)
    GROUP BY cluster) USING (cluster))"""
        for n in range(rounds)
    )
    return f"""WITH whole AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS whole FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY key, whole) - 1)::INTEGER AS cluster, whole AS centroid
  FROM (SELECT sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS key, whole FROM whole ORDER BY key, whole LIMIT 8)){steps},
last AS MATERIALIZED ({nearest.format(rounds)})
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(list_transform(centroid, lambda x: x::VARCHAR), ',')) AS centroid_sha256
FROM last JOIN c{rounds} USING (cluster)"""


SQL["op12_vantage_centroids"] = _clusters()


#: The automaton of conversations: inserts that lead from a state to another, where a role leads, and what a row can be made to.
_INSERTS = """inserts(p, mid, ins) AS (VALUES (0, 0, []), (0, 2, ['user:']), (0, 3, ['user:', 'assistant:']), (1, 1, []), (1, 2, ['user:']),
  (1, 3, ['user:', 'assistant:']), (2, 2, []), (2, 3, ['assistant:']), (3, 3, []), (3, 2, ['user:'])),
moves(mid, initial, nxt) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
reroles(mid, nxt, made) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
edits AS (
  SELECT p, nxt, 'K' AS op, initial, NULL AS made, 0 AS price, ins FROM inserts JOIN moves USING (mid)
  UNION ALL SELECT p, nxt, 'R', NULL, made, 2, ins FROM inserts JOIN reroles USING (mid)
  UNION ALL SELECT p, mid, 'D', NULL, NULL, 3, ins FROM inserts)"""

_LAST = r"right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1)"

SQL["op13_grammar_repair"] = f"""WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
ids AS (SELECT DISTINCT conv_id, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c FROM conversations),
hit AS (
  SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 20 AS hit
  FROM conversations, crc),
kept AS (
  SELECT c, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN hit = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hit WHERE hit <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS k, left(role, 1) AS initial, {_LAST} AS final FROM kept),
told AS MATERIALIZED (
  SELECT *, CASE WHEN final = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY k) > 1 THEN 'duplicate'
    WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS kind,
    coalesce(lag(initial) OVER (PARTITION BY c ORDER BY k) || initial NOT IN ('su', 'ua', 'au'), FALSE) AS illegal
  FROM placed),
{_INSERTS},
best AS (
  SELECT c, 0::BIGINT AS k, 0 AS state, {{'cost': 0::BIGINT, 'audit': '', 'made': []::VARCHAR[]}} AS way FROM ids
  UNION ALL
  SELECT b.c, t.k, e.nxt, min({{'cost': b.way.cost + e.price + 2 * len(e.ins) + (t.kind = 'truncated' AND e.op <> 'D')::BIGINT,
    'audit': b.way.audit || repeat('I', len(e.ins)) || e.op,
    'made': list_concat(b.way.made, e.ins, CASE WHEN e.op = 'D' THEN [] ELSE [coalesce(e.made, t.role) || ':' || t.text] END)}})
  FROM best b JOIN told t ON b.c = t.c AND t.k = b.k + 1
  JOIN edits e ON e.p = b.state AND (e.op = 'D' OR t.kind NOT IN ('blank', 'duplicate') AND (e.op = 'R' OR e.initial = t.initial))
  GROUP BY b.c, t.k, e.nxt),
ends(state, ins) AS (VALUES (0, []), (1, ['user:', 'assistant:']), (2, ['assistant:']), (3, [])),
figures AS (
  SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (kind = 'blank') AS blank,
    count(*) FILTER (kind = 'duplicate') AS duplicate, count(*) FILTER (kind = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM told GROUP BY c),
ways AS (
  SELECT b.c, min({{'cost': way.cost + 2 * len(ins), 'audit': way.audit || repeat('I', len(ins)), 'made': list_concat(way.made, ins)}}) AS way
  FROM best b JOIN figures f ON b.c = f.c AND b.k = f.n JOIN ends USING (state) GROUP BY b.c)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(way.cost, 0)::BIGINT AS cost, coalesce(way.audit, '') AS audit,
  sha256(coalesce(array_to_string(way.made, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN figures USING (c) LEFT JOIN ways USING (c)"""
