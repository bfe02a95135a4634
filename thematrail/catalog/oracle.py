"""SQL for DuckDB that gives the rows of each registered query."""

from __future__ import annotations

import re

from . import inputs
from .queries import BLOCK_TURNS, CATEGORIES, CHOSEN_NAMES, CHUNK_CHARS, GROUPS, PAGE_CHARS, PAGE_GROUPS, ROWS_PER_CHUNK


# white space that is stripped from names and sentences
WHITESPACE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _terms(lexicon: dict) -> dict:
    return {category: sorted({" ".join(re.findall(r"[^\W_]+", t.lower())) for t in terms}) for category, terms in lexicon.items()}


def _sizes(terms) -> list[int]:
    return sorted({t.count(" ") + 1 for t in terms})


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _listed(values: list[str]) -> str:
    return ", ".join(_quoted(v) for v in values)


OWNERS = """owners AS (
  SELECT o_orderkey AS row_id, c_name AS entity, c_mktsegment AS grp
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

MENTIONS = f"""{OWNERS},
mentions AS (
  SELECT row_id, entity, grp, category, mentions FROM (
    SELECT l_orderkey AS row_id, p_brand AS category, CAST(sum(l_quantity) AS BIGINT) AS mentions
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
  JOIN owners USING (row_id))"""

NAME_LISTS = f"""{OWNERS},
lists AS (
  SELECT row_id, entity, grp, names FROM (
    SELECT row_id, string_agg(name, ', ' ORDER BY name) AS names FROM (
      SELECT DISTINCT l_orderkey AS row_id, p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey)
    GROUP BY row_id)
  JOIN owners USING (row_id)),
names AS (
  SELECT row_id, entity, grp, trim(unnest(string_split(names, ','))) AS name FROM lists)"""

SHARES = """
  SELECT category, mentions, CAST(mentions AS DOUBLE) / nullif(CAST((SELECT sum(mentions) FROM {rows}) AS DOUBLE), 0) * 100 AS share
  FROM (SELECT category, CAST(sum(mentions) AS BIGINT) AS mentions FROM {rows} WHERE category IS NOT NULL GROUP BY category)"""

TOP_ROWS = f"""{MENTIONS},
shared AS (
  SELECT entity, category, row_id, mentions,
         CAST(mentions AS DOUBLE) / nullif(CAST(sum(mentions) OVER (PARTITION BY entity) AS DOUBLE), 0) * 100 AS share
  FROM mentions),
top_rows AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY entity ORDER BY share DESC NULLS LAST, category, row_id) AS INTEGER) AS place
  FROM shared QUALIFY place <= 5)"""

EDGES = f"""{TOP_ROWS},
lead_categories AS (
  SELECT category, CAST(sum(mentions) AS BIGINT) AS mentions,
         CAST(sum(mentions) AS DOUBLE) / (SELECT CAST(sum(mentions) AS DOUBLE) FROM top_rows) * 100 AS share
  FROM top_rows GROUP BY category ORDER BY share DESC, category LIMIT 5),
held AS (SELECT DISTINCT entity, category FROM top_rows WHERE category IN (SELECT category FROM lead_categories)),
counted AS (
  SELECT l.category AS a, r.category AS b, count(*) AS n
  FROM held l JOIN held r ON l.entity = r.entity AND l.category < r.category GROUP BY ALL),
edges AS (SELECT a, b, n, CAST(n AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE) * 100 AS weight FROM counted)"""

THEME_TEXTS = """theme_texts AS (
  SELECT doc_id AS row_id, lang AS entity, lang AS grp, source AS category, n_chars AS mentions, text AS summary FROM documents)"""


def _split_sentences(text: str) -> str:
    found = rf"regexp_extract_all({text}, '[^.!?\n]+[.!?]*')"
    return f"list_filter(list_transform({found}, lambda s: trim(s, {_quoted(WHITESPACE)})), lambda s: length(s) > 0)"


def _summary(rows: str, n: int = 3) -> str:
    """Summary of each category of ``rows`` (category, row_id, summary)."""
    words = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
    return f"""term_counts AS (
  SELECT category, term, count(*) AS n_texts FROM (
    SELECT DISTINCT category, row_id, unnest({words.format('summary')}) AS term FROM {rows})
  GROUP BY ALL),
key_terms AS (SELECT category, term, n_texts FROM term_counts JOIN (SELECT category, count(*) AS n FROM {rows} GROUP BY category) USING (category)
  WHERE n_texts * 20 >= n),
cut AS (
  SELECT category, row_id, unnest(found) AS sentence, generate_subscripts(found, 1) AS pos
  FROM (SELECT category, row_id, {_split_sentences('summary')} AS found FROM {rows})),
single AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY category, sentence ORDER BY row_id, pos) = 1),
scores AS (
  SELECT w.category, w.sentence, count(*) AS score
  FROM (SELECT DISTINCT category, sentence, unnest({words.format('sentence')}) AS term FROM single) w
  JOIN key_terms k ON w.category = k.category AND w.term = k.term GROUP BY ALL),
chosen AS (
  SELECT s.*, coalesce(score, 0) AS score FROM single s LEFT JOIN scores c ON s.category = c.category AND s.sentence = c.sentence
  QUALIFY row_number() OVER (PARTITION BY s.category ORDER BY coalesce(score, 0) DESC, row_id, pos) <= {n}),
summaries AS (SELECT category, string_agg(sentence, ' ' ORDER BY row_id, pos) AS summary FROM chosen GROUP BY category)"""


def _sentence_graph(rows: str) -> str:
    """Scores of the sentences of each category of ``rows`` by power iteration over their shared words, until no word's share of the category's
    strongest moves by more than a thousandth, or the strongest is no more than a thousand."""
    return rf"""nodes AS MATERIALIZED (
  SELECT *, list_distinct(regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}]+')) AS terms FROM (
    SELECT category, row_id, unnest(found) AS sentence, generate_subscripts(found, 1) AS pos
    FROM (SELECT category, row_id, {_split_sentences('summary')} AS found FROM {rows}))
  QUALIFY row_number() OVER (PARTITION BY category, sentence ORDER BY row_id, pos) = 1),
held AS MATERIALIZED (SELECT category, row_id, pos, len(terms) AS n_terms, unnest(terms) AS term FROM nodes),
weights AS MATERIALIZED (
  SELECT category, term, n, length(bin(n_all // n)) - 1 AS w FROM (SELECT category, term, count(*) AS n FROM held GROUP BY ALL)
  JOIN (SELECT category, count(*) AS n_all FROM nodes GROUP BY ALL) USING (category) WHERE n * 2 <= n_all),
links AS MATERIALIZED (SELECT * FROM held JOIN weights USING (category, term)),
strengths(round, category, term, w, y, moved) AS (
  SELECT 0, category, term, w, CAST(n * 1000000 AS HUGEINT), 1.0::DOUBLE FROM weights
  UNION ALL
  SELECT round + 1, category, term, w, new_y, max(CASE WHEN new_top > 1000 THEN abs(new_y / new_top - y / top) END) OVER (PARTITION BY category) FROM (
    SELECT *, max(y) OVER (PARTITION BY category) AS top, max(new_y) OVER (PARTITION BY category) AS new_top FROM (
      SELECT s.round, category, term, s.w, s.y, t.new_y FROM strengths s JOIN (
        SELECT category, term, sum(x) AS new_y FROM links JOIN (
          SELECT category, row_id, pos, sum(wy) // (any_value(n_terms) + 8) // any_value(d) AS x FROM links JOIN (
            SELECT category, term, w * y AS wy, max(w * y) OVER (PARTITION BY category) // 1000000 + 1 AS d FROM strengths) USING (category, term)
          GROUP BY ALL) USING (category, row_id, pos) GROUP BY ALL) t USING (category, term)
      WHERE s.moved > 0.001))),
valued AS (
  SELECT category, row_id, pos, sum(wy) // (any_value(n_terms) + 8) // any_value(d) AS x FROM links JOIN (
    SELECT category, term, w * y AS wy, max(w * y) OVER (PARTITION BY category) // 1000000 + 1 AS d FROM (
      SELECT * FROM strengths QUALIFY round = max(round) OVER (PARTITION BY category))) USING (category, term) GROUP BY ALL),
scored AS (
  SELECT category, row_id, pos, sentence, CAST(coalesce(x, 0) AS BIGINT) AS score FROM nodes LEFT JOIN valued USING (category, row_id, pos))"""


def _found(lexicon: dict, table: str, rows: str = "", sizes: list[int] | None = None) -> str:
    """Sentences, word runs and term hits of every document; instead of a lexicon, the SQL of its ``rows`` and the sizes of its terms."""
    terms = _terms(lexicon)
    rows = rows or "VALUES " + ", ".join(f"({_quoted(c)}, {_quoted(t)})" for c, found in terms.items() for t in found)
    runs = " UNION ALL ".join(
        f"SELECT doc_id, ps[i] AS pos, array_to_string(w[i:i + {n - 1}], ' ') AS term FROM "
        f"(SELECT doc_id, ps, w, unnest(range(1, len(w) - {n - 2})) AS i FROM {table}_words WHERE len(w) >= {n})"
        for n in sizes or _sizes(t for found in terms.values() for t in found)
    )
    return rf"""{table}_lexicon(category, term) AS ({rows}),
{table}_sentences AS (
  SELECT doc_id, pos, passage, regexp_extract_all(lower(passage), '[\p{{L}}\p{{N}}]+') AS w FROM (
    SELECT doc_id, unnest(found) AS passage, generate_subscripts(found, 1) AS pos
    FROM (SELECT doc_id, {_split_sentences('text')} AS found FROM documents))),
{table}_words AS (
  SELECT doc_id, flatten(list(w ORDER BY pos)) AS w, flatten(list(list_transform(w, lambda x: pos) ORDER BY pos)) AS ps FROM {table}_sentences GROUP BY doc_id),
{table}_runs AS ({runs}),
{table}_hits AS (SELECT doc_id, pos, category, r.term FROM {table}_runs r JOIN {table}_lexicon l ON r.term = l.term),
{table}_counts AS (
  SELECT doc_id, source AS entity, lang AS grp, length(text) AS n_chars, category, mentions FROM (
    SELECT doc_id, category, count(*) AS mentions FROM {table}_hits GROUP BY ALL) JOIN documents USING (doc_id)),
{table}_passages AS (
  SELECT doc_id, category, CAST(place AS INTEGER) AS place, CAST(n_terms AS INTEGER) AS n_terms, passage FROM (
    SELECT doc_id, pos, category, count(DISTINCT term) AS n_terms,
           row_number() OVER (PARTITION BY doc_id, category ORDER BY count(DISTINCT term) DESC, pos) AS place
    FROM {table}_hits GROUP BY doc_id, pos, category)
  JOIN {table}_sentences USING (doc_id, pos) WHERE place <= 3),
{table}_rated AS (SELECT *, mentions * 100000.0::DOUBLE / n_chars AS rate FROM {table}_counts),
{table}_scored AS (
  SELECT *, 1 + 5 * (rank() OVER (PARTITION BY category ORDER BY rate) - 1) // count(*) OVER (PARTITION BY category) AS score
  FROM {table}_rated),
{table}_results AS (
  SELECT doc_id, entity, grp, category, mentions AS mention_count, examples, CAST(score AS BIGINT) AS importance_score
  FROM {table}_scored LEFT JOIN (
    SELECT doc_id, category, string_agg(passage, chr(10) ORDER BY place) AS examples FROM {table}_passages GROUP BY ALL)
  USING (doc_id, category))"""


def _names_found() -> str:
    spelled = {name: [name] for name in inputs.NAMES}
    return f"""{_found(spelled, 'n')},
found AS (
  SELECT doc_id, string_agg(category, ', ' ORDER BY category) AS names
  FROM (SELECT DISTINCT doc_id, category FROM n_hits) GROUP BY doc_id),
found_lists AS (SELECT doc_id, source AS entity, lang AS grp, names FROM documents LEFT JOIN found USING (doc_id))"""


QUESTIONS = """questions AS (
  SELECT query_id, list(v ORDER BY pos) AS q FROM (
    SELECT CAST(label AS BIGINT) AS query_id, pos, avg(CAST(v AS DOUBLE)) AS v FROM (
      SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)
    GROUP BY ALL)
  GROUP BY query_id)"""


def _nearest(k: int, where: str = "TRUE", asked: str = QUESTIONS) -> str:
    return f"""{asked},
distances AS (
  SELECT query_id, vec_id AS page_id, doc_id, lang, source, list_sum(list_transform(list_zip(embedding, q),
         lambda x: (CAST(x[1] AS DOUBLE) - x[2]) * (CAST(x[1] AS DOUBLE) - x[2]))) AS raw, round(raw, 6) AS distance
  FROM questions, embeddings LEFT JOIN documents ON vec_id = doc_id WHERE {where}),
nearest AS (
  SELECT query_id, page_id, lang, source, raw, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY raw, page_id) AS INTEGER) AS rank
  FROM distances QUALIFY rank <= {k})"""


SOURCES = """sources AS (
  SELECT query_id, rank AS number, page_id, coalesce(CAST(1 + doc_id % 9 AS VARCHAR), 'N/A') AS page_number, coalesce(source, 'N/A') AS entity, coalesce(lang, 'N/A') AS grp,
         coalesce('doc:' || doc_id, 'N/A') AS link, text
  FROM (SELECT query_id, page_id, rank FROM nearest) LEFT JOIN documents ON page_id = doc_id),
contexts AS (
  SELECT query_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY number), '') AS context FROM sources GROUP BY query_id)"""


HISTORY = """history AS (
  SELECT conv_id, turn, n_messages, history, question FROM (
    SELECT conv_id, turn, role, CAST(count(*) OVER earlier AS INTEGER) AS n_messages,
           coalesce(string_agg(role || ': ' || text, chr(10)) OVER earlier, '') AS history, text AS question
    FROM conversations
    WINDOW earlier AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  WHERE role = 'user')"""


CONVERSATION_QUESTIONS = """questions AS (
  SELECT {'conv_id': conv_id, 'turn': turn} AS query_id, embedding AS q FROM conversations
  JOIN embeddings ON vec_id = (conv_id * 7 + turn) % (SELECT count(*) FROM embeddings) WHERE role = 'user')"""


#: Whole-number weights of pages and questions, and every score of every pair that shares a term.
WEIGHTS = r"""page_terms AS MATERIALIZED (SELECT doc_id AS page_id, term, count(*) AS n FROM (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) GROUP BY ALL),
idfs AS MATERIALIZED (SELECT term, CAST(round(ln(((SELECT count(*) FROM documents) + 1.0::DOUBLE) / (count(*) + 1)) * 1000) AS BIGINT) AS idf FROM page_terms GROUP BY term),
weights AS MATERIALIZED (SELECT page_id, term, CAST(n * idf AS BIGINT) AS weight FROM page_terms JOIN idfs USING (term) WHERE idf > 0),
squares AS (SELECT page_id, CAST(sum(weight * weight) AS BIGINT) AS square FROM weights GROUP BY page_id)"""


def _question_weights(name: str, texts: str) -> str:
    return rf"""{name} AS MATERIALIZED (SELECT conv_id, turn, term, CAST(count(*) * any_value(idf) AS BIGINT) AS weight FROM (
  SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM {texts}) JOIN idfs USING (term) WHERE idf > 0 GROUP BY ALL)"""


def _best_pages(name: str, asked: str, k: int) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT conv_id, turn, page_id, dot / (sqrt(CAST(asked_square AS DOUBLE)) * sqrt(CAST(square AS DOUBLE))) AS score,
    CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, page_id) AS INTEGER) AS rank
  FROM (SELECT conv_id, turn, page_id, CAST(sum(a.weight * w.weight) AS DOUBLE) AS dot FROM {asked} a JOIN weights w USING (term) GROUP BY ALL)
  JOIN (SELECT conv_id, turn, CAST(sum(weight * weight) AS BIGINT) AS asked_square FROM {asked} GROUP BY ALL) USING (conv_id, turn)
  JOIN squares USING (page_id) QUALIFY rank <= {k})"""


EXPANDED = """added AS MATERIALIZED (
  SELECT conv_id, turn, term, CASE WHEN weakest < w THEN weakest ELSE w END AS weight FROM (
    SELECT conv_id, turn, term, CAST(sum(w) AS BIGINT) AS w FROM (
      SELECT conv_id, turn, term, floor(weight / sqrt(CAST(square AS DOUBLE)) * 1000) AS w FROM first_hits JOIN weights USING (page_id) JOIN squares USING (page_id)
      UNION ALL
      SELECT conv_id, turn, term, floor(weight / sqrt(CAST(sum(weight * weight) OVER (PARTITION BY conv_id, turn) AS DOUBLE)) * 500) FROM told)
    GROUP BY ALL)
  ANTI JOIN asked USING (conv_id, turn, term)
  LEFT JOIN (SELECT conv_id, turn, min(weight) AS weakest FROM asked GROUP BY ALL) USING (conv_id, turn)
  WHERE w > 0 QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY w DESC, term) <= 10),
more AS MATERIALIZED (SELECT * FROM asked UNION ALL SELECT conv_id, turn, term, weight FROM added)"""


#: Figures that are also answered from stored sums.
STORED = ("category_share", "group_category_share", "top_contributors", "filtered_category_share", "filter_stats")


def oracle_sql() -> dict[str, str]:
    direct = {**_tables(), **_texts(), **_retrieval(), **_extraction()}
    return {name: sql.strip() for name, sql in {**direct, **{f"stored_{name}": direct[name] for name in STORED}}.items()}


def _tables() -> dict[str, str]:
    chosen = f"grp IN ({_listed(GROUPS)}) AND category IN ({_listed(CATEGORIES)})"
    shares = SHARES.format(rows="mentions")
    domain = """WITH {m} SELECT 0 AS ord, 'All' AS value UNION ALL SELECT DISTINCT 1, {c} FROM mentions"""
    label = "CAST(row_number() OVER (ORDER BY {m} DESC, {k}) - 1 AS INTEGER)"
    top10 = "SELECT name FROM (SELECT name, count(*) AS n FROM {rows} GROUP BY name ORDER BY n DESC, name LIMIT 10)"

    def in_group(rows: str) -> str:
        return f"""
  SELECT name, grp, n, CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY grp) AS DOUBLE) * 100 AS share
  FROM (SELECT name, grp, count(*) AS n FROM {rows} WHERE name IN ({top10.format(rows=rows)}) GROUP BY ALL)"""

    group_shares = f"""WITH {MENTIONS} SELECT grp, category, mentions,
  CAST(mentions AS DOUBLE) / nullif(CAST(sum(mentions) OVER (PARTITION BY grp) AS DOUBLE), 0) * 100 AS share
FROM (SELECT grp, category, CAST(sum(mentions) AS BIGINT) AS mentions FROM mentions GROUP BY ALL)"""
    kept = f"mentions AS (SELECT * FROM all_mentions WHERE grp IN ({_listed(GROUPS)}))"
    kept_edges = EDGES.replace("mentions AS (", "all_mentions AS (", 1).replace("shared AS (", f"{kept},\nshared AS (", 1)
    kept_names = f"kept AS (SELECT * FROM names WHERE grp IN ({_listed(GROUPS)}) AND name IN ({_listed(CHOSEN_NAMES)}))"
    ends = "SELECT a AS category FROM edges UNION ALL SELECT b FROM edges"
    return {
        "sum_by_category": f"WITH {MENTIONS} SELECT category, CAST(sum(mentions) AS BIGINT) AS mentions FROM mentions GROUP BY ALL",
        "sum_by_group_category": f"WITH {MENTIONS} SELECT grp, category, CAST(sum(mentions) AS BIGINT) AS mentions FROM mentions GROUP BY ALL",
        "sum_by_entity": f"WITH {MENTIONS} SELECT entity, CAST(sum(mentions) AS BIGINT) AS mentions FROM mentions GROUP BY ALL",
        "total_mentions": f"WITH {MENTIONS} SELECT CAST(coalesce(sum(mentions), 0) AS BIGINT) AS mentions FROM mentions",
        "category_share": f"WITH {MENTIONS} {shares}",
        "group_category_share": group_shares,
        "report_round_trip": group_shares,
        "top_contributors": f"""WITH {MENTIONS}, best AS (
  SELECT entity, CAST(sum(mentions) AS BIGINT) AS mentions FROM mentions GROUP BY entity ORDER BY mentions DESC, entity LIMIT 10)
SELECT entity, mentions, {label.format(m='mentions', k='entity')} AS rank, rank || ' - ' || entity AS label FROM best""",
        "entity_row_share": f"""WITH {MENTIONS} SELECT row_id, entity, grp, category, mentions,
  CAST(mentions AS DOUBLE) / nullif(CAST(sum(mentions) OVER (PARTITION BY entity) AS DOUBLE), 0) * 100 AS share FROM mentions""",
        "filter_members": f"WITH {MENTIONS} SELECT * FROM mentions WHERE {chosen}",
        "filter_members_all": f"WITH {MENTIONS} SELECT * FROM mentions",
        "filter_members_empty": f"WITH {MENTIONS} SELECT * FROM mentions WHERE FALSE",
        "filtered_category_share": f"WITH {MENTIONS}, kept AS (SELECT * FROM mentions WHERE grp IN ({_listed(GROUPS)})) {SHARES.format(rows='kept')}",
        "domain_groups": domain.format(m=MENTIONS, c="grp"),
        "domain_entities": domain.format(m=MENTIONS, c="entity"),
        "domain_categories": domain.format(m=MENTIONS, c="category"),
        "filter_stats": f"WITH {MENTIONS} SELECT count(*) AS n_rows, count(*) = 0 AS is_empty FROM mentions WHERE {chosen}",
        "top_categories": f"WITH {MENTIONS} SELECT category, CAST(sum(mentions) AS BIGINT) AS mentions FROM mentions GROUP BY category ORDER BY mentions DESC, category LIMIT 5",
        "top_category_rows": f"""WITH {MENTIONS} SELECT * FROM mentions WHERE category IN (
  SELECT category FROM mentions GROUP BY category ORDER BY sum(mentions) DESC, category LIMIT 5)""",
        "preview": f"WITH {THEME_TEXTS} SELECT * FROM theme_texts ORDER BY row_id LIMIT 10",
        "entity_top_rows": f"WITH {TOP_ROWS} SELECT entity, category, row_id, mentions, share, place FROM top_rows",
        "global_top_categories": f"WITH {EDGES} SELECT category, mentions, share FROM lead_categories",
        "entity_items": f"WITH {TOP_ROWS} SELECT entity, string_agg(DISTINCT category, ',' ORDER BY category) AS items FROM top_rows GROUP BY entity",
        "entity_pairs": f"""WITH {TOP_ROWS}, held AS (SELECT DISTINCT entity, category FROM top_rows)
SELECT l.category AS a, r.category AS b, count(*) AS n FROM held l JOIN held r ON l.entity = r.entity AND l.category < r.category GROUP BY ALL""",
        "filtered_cooccurrence": f"WITH {kept_edges} SELECT a, b, n, weight FROM edges",
        "cooccurrence_edges": f"WITH {EDGES} SELECT a, b, n, weight FROM edges",
        "gated_cooccurrence": f"WITH {EDGES} SELECT a, b, n, weight FROM edges WHERE (SELECT count(DISTINCT category) FROM mentions) > 1",
        "closed_gate_cooccurrence": f"WITH {EDGES} SELECT a, b, n, weight FROM edges WHERE (SELECT count(DISTINCT category) FROM mentions WHERE category = 'Brand#1') > 1",
        "graph_nodes": f"WITH {EDGES} SELECT category FROM lead_categories UNION {ends.replace('UNION ALL', 'UNION')}",
        "graph_degree": f"""WITH {EDGES}, nodes AS (SELECT category FROM lead_categories UNION SELECT category FROM ({ends}))
SELECT n.category, count(e.category) AS degree, count(e.category) * 5 AS marker_size
FROM nodes n LEFT JOIN ({ends}) e ON n.category = e.category GROUP BY n.category""",
        "domain_list_groups": domain.format(m=NAME_LISTS, c="grp").replace("FROM mentions", "FROM lists"),
        "domain_name_entities": domain.format(m=NAME_LISTS, c="entity").replace("FROM mentions", "FROM names"),
        "domain_names": domain.format(m=NAME_LISTS, c="name").replace("FROM mentions", "FROM names"),
        "explode_names": f"WITH {NAME_LISTS} SELECT row_id, entity, grp, name FROM names",
        "filter_name_list": f"WITH {NAME_LISTS} SELECT row_id, entity, grp, names FROM lists WHERE row_id IN (SELECT row_id FROM names WHERE name IN ({_listed(CHOSEN_NAMES)}))",
        "count_by_name": f"WITH {NAME_LISTS} SELECT name, count(*) AS n FROM names GROUP BY ALL",
        "count_by_name_group": f"WITH {NAME_LISTS} SELECT name, grp, count(*) AS n FROM names GROUP BY ALL",
        "name_share_top10": f"""WITH {NAME_LISTS}, best AS (SELECT name, count(*) AS n FROM names GROUP BY name ORDER BY n DESC, name LIMIT 10)
SELECT name, n, CAST(n AS DOUBLE) / CAST((SELECT count(*) FROM names) AS DOUBLE) * 100 AS share,
  {label.format(m='n', k='name')} AS rank, rank || ' - ' || name AS label FROM best""",
        "name_group_share_top10": f"WITH {NAME_LISTS} {in_group('names')}",
        "filtered_name_group_share": f"WITH {NAME_LISTS}, {kept_names} {in_group('kept')}",
        "found_name_group_share": f"""WITH {_names_found()}, exploded AS (SELECT grp, category AS name FROM (
  SELECT DISTINCT doc_id, category FROM n_hits) JOIN found_lists USING (doc_id)) {in_group('exploded')}""",
    }


def _texts() -> dict[str, str]:
    rolled = f"""SELECT category, row_id // {ROWS_PER_CHUNK} AS chunk, count(*) AS n_rows, string_agg(summary, ' ' ORDER BY row_id) AS text
FROM theme_texts {{}} GROUP BY ALL"""
    paragraph = "'Rôle des Banques Publiques de Développement dans le fichier ' || source || ' :' || chr(10) || text || chr(10) || chr(10)"
    top5 = "SELECT category FROM theme_texts GROUP BY category ORDER BY sum(mentions) DESC, category LIMIT 5"
    mapped = f"WITH {THEME_TEXTS}, {_summary('theme_texts')}"
    cut = f"""SELECT * EXCLUDE (whole), CAST(length(text) AS BIGINT) AS n_chars FROM (
  SELECT *, substr(whole, chunk * {CHUNK_CHARS} + 1, {CHUNK_CHARS}) AS text FROM (
    SELECT *, unnest(range((length(whole) + {CHUNK_CHARS - 1}) // {CHUNK_CHARS})) AS chunk FROM ({{}})))"""
    joined = "SELECT category, string_agg(summary, ' ' ORDER BY row_id) AS whole FROM theme_texts {} GROUP BY category"
    graph = f"WITH RECURSIVE {THEME_TEXTS}, {_sentence_graph('theme_texts')}"
    return {
        "sentence_ranks": f"{graph} SELECT category, row_id, sentence, score FROM scored",
        "graph_summaries": f"""{graph} SELECT category, string_agg(sentence, ' ' ORDER BY row_id, pos) AS summary FROM (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY category ORDER BY score DESC, row_id, pos) <= 3) GROUP BY category""",
        "category_chunks": f"WITH {THEME_TEXTS} {cut.format(joined.format(''))}",
        "category_chunks_top5": f"WITH {THEME_TEXTS} {cut.format(joined.format(f'WHERE category IN ({top5})'))}",
        "context_chunks": cut.format(f"SELECT string_agg({paragraph}, chr(10) ORDER BY doc_id) AS whole FROM documents"),
        "text_by_category_all": f"WITH {THEME_TEXTS} {rolled.format('')}",
        "text_by_category_top5": f"WITH {THEME_TEXTS} {rolled.format(f'WHERE category IN ({top5})')}",
        "entity_context": f"""SELECT doc_id // {ROWS_PER_CHUNK} AS chunk, count(*) AS n_rows,
  string_agg({paragraph}, chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY ALL""",
        "summary_key_terms": f"{mapped} SELECT category, term, n_texts FROM key_terms",
        "summarize_map": f"{mapped} SELECT category, summary FROM summaries",
        "summary_by_category": f"""WITH {THEME_TEXTS}, kept AS (SELECT * FROM theme_texts WHERE category IN ({top5})),
{_summary('kept')} SELECT category, summary, '**' || category || '** : ' || summary AS entry FROM summaries""",
        "summarize_reduce": f"""WITH {THEME_TEXTS}, first AS (WITH {_summary('theme_texts')} SELECT * FROM summaries),
whole AS (SELECT '' AS category, category AS row_id, summary FROM first), {_summary('whole')} SELECT summary FROM summaries""",
        "summary_of_leading": f"""WITH {THEME_TEXTS}, kept AS (SELECT * FROM theme_texts WHERE category IN ({top5})),
first AS (WITH {_summary('kept')} SELECT * FROM summaries),
whole AS (SELECT '' AS category, category AS row_id, summary FROM first), {_summary('whole')} SELECT summary FROM summaries""",
        "role_summary": f"""WITH whole AS (SELECT '' AS category, doc_id AS row_id, {paragraph} AS summary FROM documents),
{_summary('whole')} SELECT summary FROM summaries""",
    }


def _retrieval() -> dict[str, str]:
    groups = f"lang IN ({_listed(PAGE_GROUPS)})"
    shown = "SELECT query_id, page_id, distance, rank FROM nearest"
    before, _, after = inputs.SYSTEM_TEXT.partition("{context}")
    blocks = f"turn // {BLOCK_TURNS}"
    asked = _question_weights("asked", "conversations WHERE role = 'user'")
    told = _question_weights("told", "(SELECT conv_id, turn, history AS text FROM history)")
    found = "SELECT conv_id, turn, page_id, score, rank FROM"
    return {
        "knn_top10": f"WITH {_nearest(10)} {shown}",
        "knn_by_blocks": f"WITH {_nearest(10)} {shown}",
        "knn_by_cells": f"WITH {_nearest(10)} {shown}",
        "knn_by_cells_filtered": f"WITH {_nearest(10, groups)} {shown}",
        "knn_empty_selection": f"WITH {_nearest(10)} {shown}",
        "knn_filtered_pre": f"WITH {_nearest(10, groups)} {shown}",
        "knn_group_replaces_entity": f"WITH {_nearest(10, groups)} {shown}",
        "knn_filtered_post": f"""WITH {_nearest(20)}, kept AS (
  SELECT query_id, page_id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY raw, page_id) AS INTEGER) AS place
  FROM nearest WHERE {groups})
SELECT query_id, page_id, distance, place AS rank FROM kept WHERE place <= 10""",
        "list_sources": f"WITH {_nearest(10)}, {SOURCES} SELECT query_id, number, page_id, page_number, entity, grp, link, text FROM sources",
        "stuff_context": f"WITH {_nearest(10)}, {SOURCES} SELECT query_id, context FROM contexts",
        "tfidf_vectors": f"WITH {WEIGHTS} SELECT page_id, term, weight / sqrt(CAST(square AS DOUBLE)) AS weight FROM weights JOIN squares USING (page_id)",
        "tfidf_nearest": f"WITH {WEIGHTS}, {asked}, {_best_pages('best', 'asked', 10)} {found} best",
        "expanded_nearest": f"WITH {WEIGHTS}, {HISTORY}, {asked}, {told}, {_best_pages('first_hits', 'asked', 3)}, {EXPANDED}, {_best_pages('best', 'more', 10)} {found} best",
        "history_before": f"WITH {HISTORY} SELECT * FROM history",
        "history_before_in_blocks": f"WITH {HISTORY} SELECT * FROM history",
        "history_blocks": f"""SELECT conv_id, {blocks} AS block, CAST(count(*) AS INTEGER) AS n_messages,
  string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history FROM conversations GROUP BY ALL""",
        "assemble_prompt": f"""WITH {_nearest(10, asked=CONVERSATION_QUESTIONS)}, {SOURCES}, {HISTORY}
SELECT conv_id, turn, {_quoted(before)} || coalesce(context, '') || {_quoted(after)} || chr(10)
  || CASE WHEN n_messages = 0 THEN '' ELSE history || chr(10) END || 'user: ' || question AS prompt
FROM history LEFT JOIN contexts ON query_id = {{'conv_id': conv_id, 'turn': turn}}""",
    }


def _extraction() -> dict[str, str]:
    themes = _found(inputs.THEMES, "t")
    both = f"{themes}, {_found(inputs.AREAS, 'a')}"
    words = r"array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')[1:%d], ' ')"
    opening = _found({}, "o", f"SELECT DISTINCT source, term FROM (SELECT source, {words % 2} AS term FROM documents) WHERE term <> ''", [1, 2])
    name = f"SELECT DISTINCT term, term FROM (SELECT {words % 3} AS term FROM benchmark) WHERE term <> ''"
    named = _found({}, "b", name, [1, 2, 3])
    opened = f"WITH {opening} SELECT doc_id, entity, grp, n_chars, category, mentions FROM o_counts"
    shown = f"WITH {opening} SELECT doc_id, category, place, n_terms, passage FROM o_passages"
    return {
        "lexicon_mentions": opened,
        "lexicon_mentions_joined": opened,
        "lexicon_passages": shown,
        "lexicon_passages_joined": shown,
        "lexicon_names": f"""WITH {named}, listed AS (
  SELECT doc_id, string_agg(category, ', ' ORDER BY category) AS names FROM (SELECT DISTINCT doc_id, category FROM b_hits) GROUP BY doc_id)
SELECT doc_id, source AS entity, lang AS grp, names FROM documents LEFT JOIN listed USING (doc_id)""",
        "split_pages": rf"""SELECT doc_id, entity, grp, unnest(parts) AS text, CAST(generate_subscripts(parts, 1) AS INTEGER) AS page_number FROM (
  SELECT doc_id, source AS entity, lang AS grp,
         regexp_extract_all(text, '(?s).{{1,{PAGE_CHARS}}}(?:\n|\z)|.{{{PAGE_CHARS}}}') AS parts FROM documents)""",
        "count_mentions": f"WITH {themes} SELECT doc_id, entity, grp, n_chars, category, mentions FROM t_counts",
        "example_passages": f"WITH {themes} SELECT doc_id, category, place, n_terms, passage FROM t_passages",
        "importance": f"WITH {themes} SELECT doc_id, entity, grp, n_chars, category, mentions, rate, CAST(score AS BIGINT) AS score FROM t_scored",
        "find_names": f"WITH {_names_found()} SELECT doc_id, entity, grp, names FROM found_lists",
        "structured_results": f"WITH {themes} SELECT * FROM t_results",
        "compile_mentions": f"WITH {both} SELECT * FROM t_results UNION ALL SELECT * FROM a_results",
        "found_category_share": f"WITH {both}, kept AS (SELECT * FROM t_counts UNION ALL SELECT * FROM a_counts) {SHARES.format(rows='kept')}",
        "csv_round_trip": "SELECT lang AS grp, source AS entity, doc_id AS category, n_chars AS mentions, text AS summary FROM documents",
        "stored_pages": """SELECT vec_id AS page_id, CAST(1 + doc_id % 9 AS INTEGER) AS page_number, source AS entity, lang AS grp, 'doc:' || doc_id AS link, text,
  array_to_string(list_transform(embedding, lambda x: CAST(CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT) AS VARCHAR)), ',') AS components
FROM embeddings LEFT JOIN documents ON vec_id = doc_id""",
        "csv_large_numbers": """SELECT CAST('9007199254740993' AS BIGINT) + doc_id AS category, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE n_chars END AS mentions,
  source AS entity, lang AS grp FROM documents""",
    }
