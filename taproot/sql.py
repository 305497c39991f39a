"""The queries of the core in SQL, for an engine that knows recursion, lists and structs."""

from __future__ import annotations

from taproot.functions import linguistic as ling

_FOREST = r"""
WITH RECURSIVE newest AS (
  SELECT document_id, snippet_id, nullif(regexp_replace(max_by(coalesce(parent_id, ''), extracted_at), '^\s+|\s+$', '', 'g'), '') AS parent_id
  FROM snippet_nodes GROUP BY 1, 2),
forest AS (
  SELECT a.document_id, a.snippet_id, b.snippet_id AS parent_id
  FROM newest a LEFT JOIN newest b ON a.document_id = b.document_id AND a.parent_id = b.snippet_id),
down AS (
  SELECT document_id, snippet_id, snippet_id AS root_id, 0 AS depth, [snippet_id] AS path FROM forest WHERE parent_id IS NULL
  UNION ALL
  SELECT f.document_id, f.snippet_id, d.root_id, d.depth + 1, list_append(d.path, f.snippet_id)
  FROM forest f JOIN down d ON f.document_id = d.document_id AND f.parent_id = d.snippet_id),
lost AS (SELECT f.* FROM forest f ANTI JOIN down d ON f.document_id = d.document_id AND f.snippet_id = d.snippet_id),
way AS (
  SELECT document_id, snippet_id, parent_id AS stop FROM lost
  UNION
  SELECT w.document_id, w.snippet_id, l.parent_id FROM way w JOIN lost l ON w.document_id = l.document_id AND w.stop = l.snippet_id),
ring AS (SELECT document_id, snippet_id FROM way WHERE snippet_id = stop),
cycles AS (
  SELECT w.document_id, w.snippet_id, min(w.stop) AS cycle_id
  FROM way w JOIN ring r ON w.document_id = r.document_id AND w.stop = r.snippet_id GROUP BY 1, 2)
"""
_P2_SIZES = """,
lost_sizes AS (
  SELECT w.document_id, w.stop AS snippet_id, count(*) + 1 AS subtree FROM way w
  ANTI JOIN ring r ON w.document_id = r.document_id AND w.stop = r.snippet_id GROUP BY 1, 2),
sizes AS (SELECT document_id, unnest(path) AS snippet_id FROM down),
subtree AS (SELECT document_id, snippet_id, count(*) AS subtree FROM sizes GROUP BY 1, 2)
"""

SQL = {
    "p2_found": _FOREST + "SELECT document_id, snippet_id, cycle_id FROM cycles",
    "p2_hierarchy": _FOREST + _P2_SIZES + """
SELECT d.document_id, d.snippet_id, d.root_id, CAST(d.depth AS INTEGER) AS depth, CAST(s.subtree AS INTEGER) AS subtree, CAST(NULL AS VARCHAR) AS cycle_id,
       array_to_string(d.path, ' > ') AS path
FROM down d JOIN subtree s ON d.document_id = s.document_id AND d.snippet_id = s.snippet_id
UNION ALL
SELECT c.document_id, c.snippet_id, NULL, NULL, CASE WHEN r.snippet_id IS NULL THEN CAST(coalesce(s.subtree, 1) AS INTEGER) END, c.cycle_id, NULL
FROM cycles c LEFT JOIN ring r ON c.document_id = r.document_id AND c.snippet_id = r.snippet_id
LEFT JOIN lost_sizes s ON c.document_id = s.document_id AND c.snippet_id = s.snippet_id""",
    "p2_descendants": _FOREST + """,
ways AS (
  SELECT document_id, snippet_id, parent_id AS ancestor_id, 1 AS distance, [parent_id] AS met FROM lost WHERE parent_id <> snippet_id
  UNION ALL
  SELECT w.document_id, w.snippet_id, l.parent_id, w.distance + 1, list_append(w.met, l.parent_id)
  FROM ways w JOIN lost l ON w.document_id = l.document_id AND w.ancestor_id = l.snippet_id
  WHERE l.parent_id <> w.snippet_id AND NOT list_contains(w.met, l.parent_id))
SELECT document_id, path[i] AS ancestor_id, snippet_id, CAST(depth - i + 1 AS INTEGER) AS distance
FROM (SELECT document_id, snippet_id, depth, path, unnest(range(1, depth + 1)) AS i FROM down)
UNION ALL
SELECT document_id, ancestor_id, snippet_id, CAST(distance AS INTEGER) FROM ways""",
}


# White space of any script, as the engine's own \\s knows only that of ASCII.
_SPACE = r"\t-\r\x{1c}- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


_N_WORDS = _count("text", f"[^{_SPACE}]+")
_LOW_TITLE = f"lower({_strip('title')})"
_NODES = f"""nodes AS (
  SELECT document_id, snippet_id AS node_id, {_strip("replace(coalesce(text, ''), chr(0), '')")} AS text, sequence_no AS seq, level, level_label, snippet_type AS kind, label = 'list_item' AS grouped, page_no
  FROM graph_snippets QUALIFY row_number() OVER (PARTITION BY document_id, snippet_id ORDER BY extracted_at DESC) = 1)"""
_EDGES = """links AS (
  SELECT document_id, parent_id, child_id, coalesce(max(weight), CASE max(relation) WHEN 'section' THEN 1.0 WHEN 'list_item' THEN 0.6 WHEN 'root' THEN 0.1 ELSE 0.8 END) AS weight, max(relation) AS relation
  FROM edges GROUP BY 1, 2, 3)"""
_RELATION = """CASE WHEN e.relation IN ('reference', 'unreferenced_media', 'root') THEN e.relation WHEN c.kind = 'table' THEN 'media_table' WHEN c.kind = 'image' THEN 'media_figure'
  WHEN p.h AND c.h THEN 'section' WHEN c.grouped AND p.h THEN 'heading_list' WHEN c.grouped THEN 'text_list' WHEN p.h THEN 'heading_text' ELSE 'text_text' END"""
_CONTEXT = f"""{_NODES}, {_EDGES}, named AS (SELECT *, coalesce(level_label IN ('Title', 'Heading', 'Root'), false) AS h FROM nodes),
related AS (SELECT e.document_id, e.parent_id, e.child_id, e.weight, {_RELATION} AS supply_relation FROM links e
  JOIN named p ON e.document_id = p.document_id AND e.parent_id = p.node_id JOIN named c ON e.document_id = c.document_id AND e.child_id = c.node_id)"""
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_BEST = "best AS (SELECT document_id, child_id AS node_id, max({'weight': weight, 'parent_id': parent_id}) AS b FROM links GROUP BY 1, 2)"
_CHAIN = f"""{_NODES}, {_EDGES}, {_BEST},
tied AS (SELECT n.document_id, n.node_id, p.node_id AS up_id, b.b.weight AS up FROM nodes n LEFT JOIN best b ON n.document_id = b.document_id AND n.node_id = b.node_id
  LEFT JOIN nodes p ON p.document_id = n.document_id AND p.node_id = b.b.parent_id),
rooted AS (
  SELECT document_id, node_id FROM tied WHERE up_id IS NULL
  UNION ALL
  SELECT t.document_id, t.node_id FROM tied t JOIN rooted r ON t.document_id = r.document_id AND t.up_id = r.node_id),
sized AS (SELECT n.*, CASE WHEN r.node_id IS NOT NULL THEN t.up_id END AS up_id, t.up, {_N_WORDS} AS words, length(text) AS chars, coalesce(level_label IN ('Title', 'Heading', 'Root'), false) AS h
  FROM nodes n JOIN tied t USING (document_id, node_id) LEFT JOIN rooted r USING (document_id, node_id)),
far AS (
  SELECT document_id, node_id, node_id AS spot, 0 AS distance, 1.0::DOUBLE AS cumulative FROM sized
  UNION ALL
  SELECT f.document_id, f.node_id, s.up_id, f.distance + 1, f.cumulative * s.up FROM far f JOIN sized s ON f.document_id = s.document_id AND f.spot = s.node_id WHERE s.up_id IS NOT NULL)"""


def _merge_sql(gate: str) -> str:
    """Units by a recursion that stops at the first ancestor that isn't let in or doesn't fit."""
    return f"""WITH RECURSIVE {_CHAIN},
grown AS (
  SELECT document_id, node_id, node_id AS spot, words::BIGINT AS w, chars::BIGINT AS c, 1 AS k, 1.0::DOUBLE AS cum, greatest(words, chars // 4)::BIGINT AS token_count, text, node_id AS members, 0 AS n, [page_no] AS pages
  FROM sized WHERE text <> '' AND coalesce(kind, '') <> 'root'
  UNION ALL
  SELECT g.document_id, g.node_id, t.node_id, g.w + t.words, g.c + t.chars, g.k + (t.text <> '')::INT, g.cum * s.up,
         greatest(g.w + t.words, (g.c + t.chars + 2 * (g.k + (t.text <> '')::INT - 1)) // 4), CASE WHEN t.text = '' THEN g.text ELSE t.text || chr(10) || chr(10) || g.text END, t.node_id || ',' || g.members, g.n + 1, CASE WHEN t.text = '' THEN g.pages ELSE list_prepend(t.page_no, g.pages) END
  FROM grown g JOIN sized s ON g.document_id = s.document_id AND g.spot = s.node_id JOIN sized t ON t.document_id = s.document_id AND t.node_id = s.up_id
  WHERE g.token_count <= 1024 AND {gate} AND greatest(g.w + t.words, (g.c + t.chars + 2 * (g.k + (t.text <> '')::INT - 1)) // 4) <= 1024),
crumbs AS (SELECT f.document_id, f.node_id, string_agg(s.text, ' > ' ORDER BY f.distance DESC) AS breadcrumb FROM far f JOIN sized s ON f.document_id = s.document_id AND f.spot = s.node_id
  WHERE f.distance > 0 AND s.h AND s.text <> '' GROUP BY 1, 2)
SELECT g.document_id, g.node_id AS unit_id, g.text, g.members, coalesce(breadcrumb, '') AS breadcrumb, g.token_count,
  array_to_string(list_filter(g.pages, lambda x, i: x IS NOT NULL AND list_position(g.pages, x) = i), ',') AS pages, g.n AS links FROM grown g
LEFT JOIN crumbs USING (document_id, node_id) QUALIFY row_number() OVER (PARTITION BY g.document_id, g.node_id ORDER BY g.n DESC) = 1"""


_IDF = f"""stems AS (SELECT document_id, node_id, list_distinct(list_transform({_WORDS}, lambda x: x[1:6])) AS t FROM nodes),
idf AS (SELECT term, ln(((SELECT count(*) FROM nodes) + 1) / (count(*) + 1)) + 1 AS idf FROM (SELECT unnest(t) AS term FROM stems) GROUP BY 1)"""

SQL |= {
    "current_snippets": "SELECT document_id, snippet_id, label, sequence_no, text FROM snippet_nodes QUALIFY row_number() OVER (PARTITION BY document_id, snippet_id ORDER BY extracted_at DESC) = 1",
    "snippet_ids": "SELECT DISTINCT document_id, local_ref, snippet_id AS node_id FROM graph_snippets",
    "graph_edges": f"WITH {_EDGES} SELECT document_id, parent_id, child_id, round(weight, 6) AS weight, relation FROM links",
    "supply_relations": f"WITH {_CONTEXT} SELECT document_id, parent_id, child_id, supply_relation FROM related",
    "resolved_parents": """
WITH items AS (SELECT document_id, snippet_id AS node_id, sequence_no AS seq, coalesce(level, 2147483647) AS depth, level FROM snippet_nodes
  QUALIFY row_number() OVER (PARTITION BY document_id, snippet_id ORDER BY extracted_at DESC) = 1),
near AS (SELECT a.document_id, a.node_id, max({'seq': b.seq, 'node_id': b.node_id}).node_id AS parent_id FROM items a
  JOIN items b ON a.document_id = b.document_id AND b.depth < a.depth AND (b.seq, b.node_id) < (a.seq, a.node_id) GROUP BY 1, 2),
tops AS (SELECT document_id, node_id, row_number() OVER (PARTITION BY document_id ORDER BY seq, node_id) AS r FROM items WHERE level = 0)
SELECT i.document_id, i.node_id, coalesce(n.parent_id, nullif(t.node_id, i.node_id), u.node_id) AS parent_id
FROM items i LEFT JOIN near n ON i.document_id = n.document_id AND i.node_id = n.node_id LEFT JOIN tops t ON i.document_id = t.document_id AND t.r = 1
LEFT JOIN tops u ON i.document_id = u.document_id AND u.r = 2""",
    "document_roots": f"""
WITH {_NODES}, named AS (SELECT document_id, max({_LOW_TITLE}) AS title FROM documents_meta GROUP BY 1)
SELECT document_id, coalesce(arg_min(node_id, {{'a': seq, 'b': node_id}}) FILTER (lower({_strip('text')}) = title), arg_min(node_id, {{'a': seq, 'b': node_id}}) FILTER (level_label = 'Title'), '#/document-root') AS root_id
FROM nodes LEFT JOIN named USING (document_id) GROUP BY 1""",
    "structural_weights": f"WITH {_EDGES} SELECT document_id, parent_id, child_id, CASE relation WHEN 'section' THEN 1.0 WHEN 'text' THEN 0.8 WHEN 'list_item' THEN 0.6 WHEN 'root' THEN 0.1 ELSE 0.8 END::DOUBLE AS weight FROM links",
    "idf_terms": f"WITH {_NODES}, {_IDF} SELECT term, round(idf, 6) AS idf FROM idf",
    "bm25_weights": f"""
WITH {_NODES}, {_EDGES}, words AS (SELECT document_id, node_id, {_WORDS} AS t FROM nodes),
stats AS (SELECT document_id, count(*) AS n, avg(len(t)) AS avgdl FROM words GROUP BY 1),
tf AS (SELECT document_id, node_id, term, count(*) AS tf FROM (SELECT document_id, node_id, unnest(t) AS term FROM words) GROUP BY 1, 2, 3),
df AS (SELECT document_id, term, count(*) AS df FROM tf GROUP BY 1, 2),
scored AS (SELECT e.document_id, e.parent_id, e.child_id, greatest(0, sum(ln((n - df + 0.5) / (df + 0.5)) * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * len(w.t) / avgdl)))) AS score
  FROM links e JOIN tf c ON e.document_id = c.document_id AND e.child_id = c.node_id JOIN tf p ON e.document_id = p.document_id AND e.parent_id = p.node_id AND p.term = c.term
  JOIN df ON df.document_id = e.document_id AND df.term = c.term JOIN words w ON w.document_id = e.document_id AND w.node_id = e.parent_id JOIN stats s ON s.document_id = e.document_id GROUP BY 1, 2, 3),
filled AS (SELECT e.document_id, e.parent_id, e.child_id, coalesce(score, 0) AS score FROM links e LEFT JOIN scored USING (document_id, parent_id, child_id))
SELECT document_id, parent_id, child_id, round(CASE WHEN max(score) OVER d > 0 THEN score / max(score) OVER d ELSE 0 END, 6) AS weight FROM filled WINDOW d AS (PARTITION BY document_id)""",
    "embedding_cosines": """
SELECT vec_id, before, round(greatest(0, least(1, list_dot_product(a, b) / (CASE WHEN list_dot_product(a, a) = 0 THEN 1 ELSE sqrt(list_dot_product(a, a)) END * CASE WHEN list_dot_product(b, b) = 0 THEN 1 ELSE sqrt(list_dot_product(b, b)) END))), 5) AS weight
FROM (SELECT vec_id, lag(vec_id) OVER w AS before, embedding::DOUBLE[] AS a, lag(embedding) OVER w::DOUBLE[] AS b FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)) WHERE before IS NOT NULL""",
    "complementarity": f"""
WITH {_NODES}, {_EDGES}, {_IDF},
pairs AS (SELECT e.document_id, e.parent_id, e.child_id, p.t AS pt, c.t AS ct FROM links e JOIN stems p ON e.document_id = p.document_id AND e.parent_id = p.node_id JOIN stems c ON e.document_id = c.document_id AND e.child_id = c.node_id),
novel AS (SELECT document_id, parent_id, child_id, sum(idf) AS novel FROM (SELECT document_id, parent_id, child_id, idf, row_number() OVER (PARTITION BY document_id, parent_id, child_id ORDER BY idf DESC) AS r
  FROM (SELECT document_id, parent_id, child_id, unnest(pt) AS term, ct FROM pairs) JOIN idf USING (term) WHERE NOT list_contains(ct, term)) WHERE r <= 8 GROUP BY 1, 2, 3),
mass AS (SELECT document_id, node_id AS child_id, sum(idf) AS mass FROM (SELECT document_id, node_id, unnest(t) AS term FROM stems) JOIN idf USING (term) GROUP BY 1, 2)
SELECT e.document_id, e.parent_id, e.child_id, round(CASE WHEN coalesce(novel, 0) + coalesce(mass, 0) > 0 THEN coalesce(novel, 0) / (coalesce(novel, 0) + coalesce(mass, 0)) ELSE 0 END, 6) AS complementarity
FROM links e LEFT JOIN novel USING (document_id, parent_id, child_id) LEFT JOIN mass USING (document_id, child_id)""",
    "node_tokens": f"WITH {_NODES} SELECT document_id, node_id, greatest({_N_WORDS}, length(text) // 4)::BIGINT AS tokens FROM nodes",
    "tree_parents": f"WITH {_EDGES}, {_BEST} SELECT document_id, node_id, b.parent_id AS parent_id, round(b.weight, 6) AS weight FROM best",
    "tree_ancestors": f"WITH RECURSIVE {_CHAIN} SELECT document_id, node_id, spot AS ancestor_id, distance, round(cumulative, 6) AS cumulative FROM far WHERE distance > 0",
    "merge_none": _merge_sql("false"),
    "merge_all_ancestors": _merge_sql("true"),
    "merge_weighted": _merge_sql("s.up >= 0.5 AND g.cum * s.up >= 0"),
    "relation_mix": f"WITH {_CONTEXT} SELECT supply_relation, count(*) AS edges, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(avg(weight), 6) AS mean_weight FROM related GROUP BY 1",
    "chunk_sizes": f"""
WITH newest AS (SELECT variant, text FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC) = 1)
SELECT variant, count(*) AS chunks, round(avg(greatest({_count("coalesce(text, '')", f"[^{_SPACE}]+")}, length(coalesce(text, '')) // 4)), 6) AS mean_tokens FROM newest GROUP BY 1""",
}


# --- parsed items and media -----------------------------------------------------

_ITEMS = f"""pages AS (SELECT document_id, page_no, max(width) AS width, max(height) AS height FROM page_geometry GROUP BY 1, 2),
now AS (SELECT * FROM snippet_nodes QUALIFY row_number() OVER (PARTITION BY document_id, snippet_id ORDER BY extracted_at DESC) = 1),
raw AS (SELECT n.*, coalesce(p.height, 0) AS h, upper(coalesce(bbox.coord_origin, '')) = 'TOPLEFT' AS top FROM now n LEFT JOIN pages p ON n.document_id = p.document_id AND n.page_no = p.page_no WHERE bbox IS NOT NULL),
items AS (SELECT document_id, snippet_id AS node_id, sequence_no AS seq, page_no, label, text, level, level_label, coalesce(is_grouped, false) AS grouped, coalesce(region, 'body') AS region, font_key, line_heights,
  {_strip("coalesce(parent_id, '')")} AS up, bbox.l AS l, bbox.r AS r, CASE WHEN top THEN h - bbox.t ELSE bbox.t END AS t, CASE WHEN top THEN h - bbox.b ELSE bbox.b END AS b FROM raw)"""
_PICTURES = """pictures AS (SELECT document_id, '#/pictures/' || page_no AS node_id, max(seq) AS seq, page_no, min(l) AS l, max(t) AS t, max(r) AS r, min(b) AS b FROM items WHERE region = 'figure' AND page_no IS NOT NULL GROUP BY document_id, page_no),
refs AS (SELECT *, CASE WHEN grouped THEN '#/groups/' || up WHEN region = 'figure' THEN '#/pictures/' || page_no ELSE '#/body' END AS ref FROM items),
texts AS (SELECT document_id, node_id, seq, page_no, text, level, level_label, grouped, region, coalesce(ref, '#/body') AS ref, l, t, r, b FROM refs
  UNION ALL SELECT document_id, '#/captions/' || page_no, seq, page_no, 'Fig. ' || page_no, 1000, 'Body', false, 'figure', node_id, l, b - 10, r, b - 20 FROM pictures)"""


def _parents(texts: str) -> str:
    """Parents by all rules, by joins of every text with those before it."""
    may = "(b.region = a.region OR a.region IN ('sidebar', 'figure') AND b.region = 'body')"
    return f"""deep AS (SELECT *, coalesce(level, 2147483647) AS depth FROM {texts}),
opening AS (SELECT document_id, ref, region, min({{'seq': seq, 'node_id': node_id}}) AS k FROM deep WHERE grouped GROUP BY 1, 2, 3),
introduced AS (SELECT a.document_id, a.ref, a.region, max({{'seq': b.seq, 'node_id': b.node_id}}).node_id AS parent_id FROM opening a
  JOIN deep b ON a.document_id = b.document_id AND (b.seq, b.node_id) < (a.k.seq, a.k.node_id) AND {may} GROUP BY 1, 2, 3),
near AS (SELECT a.document_id, a.node_id, max({{'seq': b.seq, 'node_id': b.node_id}}).node_id AS parent_id FROM deep a
  JOIN deep b ON a.document_id = b.document_id AND b.depth < a.depth AND (b.seq, b.node_id) < (a.seq, a.node_id) AND {may} GROUP BY 1, 2),
tops AS (SELECT document_id, node_id, row_number() OVER (PARTITION BY document_id ORDER BY seq, node_id) AS r FROM deep WHERE level = 0),
parents AS (SELECT d.document_id, d.node_id, coalesce(CASE WHEN d.grouped THEN g.parent_id WHEN d.ref <> '#/body' THEN d.ref END, n.parent_id, nullif(t.node_id, d.node_id), u.node_id) AS parent_id
  FROM deep d LEFT JOIN introduced g ON d.document_id = g.document_id AND d.ref = g.ref AND d.region = g.region LEFT JOIN near n ON d.document_id = n.document_id AND d.node_id = n.node_id
  LEFT JOIN tops t ON d.document_id = t.document_id AND t.r = 1 LEFT JOIN tops u ON d.document_id = u.document_id AND u.r = 2)"""


_NAMED = rf"(?i)\b(figure|fig|table|abbildung|tabelle|abb|tab)[{_SPACE}]*\.?[{_SPACE}]*(\d+)"
_CAPTIONS = rf"""captions AS (SELECT m.document_id, m.node_id AS media_id, min({{'gap': greatest(m.l - c.r, c.l - m.r, 0) + greatest(m.b - c.t, c.b - m.t, 0), 'seq': c.seq, 'node_id': c.node_id, 'text': c.text}}) AS c
  FROM pictures m JOIN texts c ON m.document_id = c.document_id AND m.page_no = c.page_no AND regexp_matches(c.text, '^[{_SPACE}▶▪●•·‣→>»|–—-]*(?i:Tab|Abb|Table|Figure|Fig)\.?[{_SPACE}]*\d+')
  WHERE greatest(m.l - c.r, c.l - m.r, 0) = 0 AND greatest(m.b - c.t, c.b - m.t, 0) <= 50 OR greatest(m.b - c.t, c.b - m.t, 0) = 0 AND greatest(m.l - c.r, c.l - m.r, 0) <= 12 GROUP BY 1, 2)"""
_PLACED_MEDIA = rf"""{_ITEMS}, {_PICTURES}, {_parents("texts")}, {_CAPTIONS},
rules AS (SELECT * FROM (VALUES (0, 'Figure', 'figure'), (1, 'Fig.', 'fig'), (2, 'Table', 'table'), (3, 'Abbildung', 'abbildung'), (4, 'Tabelle', 'tabelle'), (5, 'Abb.', 'abb'), (6, 'Tab.', 'tab'), (7, 'Abb', 'abb'), (8, 'Tab', 'tab')) x(no, word, base)),
names AS (SELECT document_id, media_id, c.node_id AS own, no, base, regexp_extract(c.text, '(?i)\b' || base || '[{_SPACE}]*\.?[{_SPACE}]*(\d+)', 1) AS number FROM captions, rules WHERE contains(c.text, word)),
said AS (SELECT DISTINCT document_id, node_id, lower(base) AS base, number FROM (SELECT document_id, node_id, unnest(regexp_extract_all(text, '{_NAMED}', 1)) AS base, unnest(regexp_extract_all(text, '{_NAMED}', 2)) AS number FROM texts)),
found AS (SELECT n.document_id, n.media_id, n.no, s.node_id, x.seq, x.level, x.level_label, p.parent_id FROM names n JOIN said s ON n.document_id = s.document_id AND n.base = s.base AND n.number = s.number AND n.own <> s.node_id
  JOIN texts x ON x.document_id = s.document_id AND x.node_id = s.node_id JOIN parents p ON p.document_id = s.document_id AND p.node_id = s.node_id),
firsts AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY document_id, media_id, no ORDER BY seq, node_id) = 1),
chosen AS (SELECT * FROM firsts WHERE parent_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_id, media_id ORDER BY no) = 1),
before AS (SELECT m.document_id, m.node_id AS media_id, x.node_id, x.level FROM pictures m JOIN texts x ON m.document_id = x.document_id AND x.level_label IN ('Title', 'Heading', 'Root') AND x.region NOT IN ('sidebar', 'figure')
    AND (coalesce(x.page_no, -1), -x.t) < (m.page_no, -m.t)
  QUALIFY row_number() OVER (PARTITION BY m.document_id, m.node_id ORDER BY coalesce(x.page_no, -1) DESC, -x.t DESC, x.node_id DESC) = 1),
placed AS (SELECT m.document_id, m.node_id, CASE WHEN c.media_id IS NOT NULL THEN c.parent_id ELSE b.node_id END AS parent_id, CASE WHEN c.media_id IS NOT NULL THEN c.level ELSE coalesce(b.level + 1, 1000) END::INTEGER AS level,
    CASE WHEN c.media_id IS NOT NULL THEN c.level_label WHEN b.media_id IS NOT NULL THEN 'Unreferenced Image' ELSE '' END AS level_label, m.seq, m.page_no
  FROM pictures m LEFT JOIN chosen c ON m.document_id = c.document_id AND m.node_id = c.media_id LEFT JOIN before b ON m.document_id = b.document_id AND m.node_id = b.media_id),
inside AS (SELECT x.*, p.parent_id FROM texts x JOIN parents p USING (document_id, node_id) JOIN pictures m ON m.document_id = x.document_id AND m.node_id = p.parent_id
  LEFT JOIN (SELECT DISTINCT document_id, c.node_id AS node_id FROM captions) k ON k.document_id = x.document_id AND k.node_id = x.node_id WHERE x.region = 'figure' AND k.node_id IS NULL),
labels AS (SELECT document_id, parent_id AS node_id, string_agg({_strip("text")}, ' · ' ORDER BY seq, node_id) FILTER ({_strip("text")} <> '') AS labels FROM inside GROUP BY 1, 2)"""
_BOXES = f"""{_ITEMS}, span AS (SELECT document_id, min(l) + max(r) AS w, abs(min(b) + max(t)) AS h FROM items GROUP BY 1),
sized AS (SELECT DISTINCT i.document_id, i.page_no, coalesce(p.width, s.w) AS width, coalesce(p.height, s.h) AS height FROM items i JOIN span s USING (document_id) LEFT JOIN pages p ON p.document_id = i.document_id AND p.page_no = i.page_no),
rules AS (SELECT DISTINCT i.document_id, i.page_no, unnest([i.t + 1, i.b]) AS d FROM items i JOIN sized z ON z.document_id = i.document_id AND z.page_no = i.page_no WHERE label = 'title' AND 2000 >= 0.6 * z.width),
boxes AS (SELECT i.document_id, i.page_no, i.l - 1 AS l, i.t + 12 AS t, i.r + 1 AS r, i.b - 12 AS b FROM items i JOIN sized z ON z.document_id = i.document_id AND z.page_no = i.page_no
  WHERE region = 'sidebar' AND i.r - i.l + 2 >= 40 AND i.t - i.b + 24 >= 20 AND NOT (i.r - i.l + 2 >= 0.95 * z.width AND i.t - i.b + 24 >= 0.95 * z.height)),
ruled AS (SELECT i.document_id, i.node_id, count(r.d) AS block FROM items i LEFT JOIN rules r ON i.document_id = r.document_id AND i.page_no = r.page_no AND i.t < r.d GROUP BY 1, 2),
spots AS (SELECT i.*, u.block::INTEGER AS block, CASE WHEN z.width IS NULL OR (i.l + i.r) / 2 < z.width / 2 THEN 0 ELSE 1 END::INTEGER AS "column"
  FROM items i JOIN ruled u USING (document_id, node_id) LEFT JOIN sized z ON z.document_id = i.document_id AND z.page_no = i.page_no)"""
_LOGS = "ln((n - df + 0.5) / (df + 0.5))"


def _bm25(query: str, target: str, name: str) -> str:
    return f"""{name} AS (SELECT e.document_id, e.parent_id, e.child_id, greatest(0, sum({_LOGS} * h.tf * 2.5 / (h.tf + 1.5 * (0.25 + 0.75 * len(w.t) / avgdl)))) AS score
  FROM links e JOIN tf q ON e.document_id = q.document_id AND e.{query} = q.node_id JOIN tf h ON e.document_id = h.document_id AND e.{target} = h.node_id AND h.term = q.term
  JOIN df ON df.document_id = e.document_id AND df.term = q.term JOIN words w ON w.document_id = e.document_id AND w.node_id = e.{target} JOIN stats s ON s.document_id = e.document_id GROUP BY 1, 2, 3)"""


_TF = f"""{_NODES}, {_EDGES}, words AS (SELECT document_id, node_id, {_WORDS} AS t FROM nodes),
stats AS (SELECT document_id, count(*) AS n, avg(len(t)) AS avgdl FROM words GROUP BY 1),
tf AS (SELECT document_id, node_id, term, count(*) AS tf FROM (SELECT document_id, node_id, unnest(t) AS term FROM words) GROUP BY 1, 2, 3),
df AS (SELECT document_id, term, count(*) AS df FROM tf GROUP BY 1, 2)"""
_SIMILAR = f"""{_TF}, {_bm25("child_id", "parent_id", "scored")},
filled AS (SELECT e.document_id, e.parent_id, e.child_id, e.weight AS own, e.relation, coalesce(score, 0) AS score FROM links e LEFT JOIN scored USING (document_id, parent_id, child_id)),
alike AS (SELECT *, CASE WHEN max(score) OVER d > 0 THEN score / max(score) OVER d ELSE 0 END AS x FROM filled WINDOW d AS (PARTITION BY document_id))"""
_STRUCTURAL = "CASE relation WHEN 'section' THEN 1.0 WHEN 'list_item' THEN 0.6 WHEN 'media' THEN 0.9 WHEN 'unreferenced_media' THEN 0.3 WHEN 'reference' THEN 0.7 WHEN 'root' THEN 0.1 ELSE 0.8 END::DOUBLE"
_DOT = "list_dot_product(p.v, c.v) / (CASE WHEN list_dot_product(p.v, p.v) = 0 THEN 1 ELSE sqrt(list_dot_product(p.v, p.v)) END * CASE WHEN list_dot_product(c.v, c.v) = 0 THEN 1 ELSE sqrt(list_dot_product(c.v, c.v)) END)"
_COSINES = f"""vectors AS (SELECT document_id, node_id, embedding::DOUBLE[] AS v FROM nodes JOIN embeddings ON vec_id = seq),
cosines AS (SELECT e.document_id, e.parent_id, e.child_id, coalesce(greatest(0, least(1, {_DOT})), 0) AS y FROM links e
  LEFT JOIN vectors p ON e.document_id = p.document_id AND e.parent_id = p.node_id LEFT JOIN vectors c ON e.document_id = c.document_id AND e.child_id = c.node_id)"""


def _listed(words: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words.split()) + "]"


def _votes(words: str, lang: str) -> str:
    return f"len(list_filter({words}, lambda x: list_contains({_listed(ling.MARKERS[lang])}, x)))"


_TREE_SUMS = f"""{_CHAIN}, depths AS (SELECT document_id, node_id, max(distance) AS depth FROM far GROUP BY 1, 2)"""


def _spreads(parts: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS metric, weight FROM ({select})" for name, select in parts.items())


def _cards(longest: int) -> str:
    def cut(text: str) -> str:
        flat = _strip(f"regexp_replace({text}, '[{_SPACE}]+', ' ', 'g')")
        return f"CASE WHEN length({flat}) > {longest} THEN substr({flat}, 1, {longest}) || ' […]' ELSE {flat} END"

    return f"""named AS (SELECT *, coalesce(level_label IN ('Title', 'Heading', 'Root'), false) AS h FROM nodes),
cards AS (SELECT substr(sha256(e.document_id || ':' || e.parent_id || ':' || e.child_id), 1, 16) AS uid, e.document_id, e.parent_id, e.child_id, {_RELATION} AS relation, {cut("p.text")} AS parent_text, {cut("c.text")} AS child_text
  FROM links e JOIN named p ON e.document_id = p.document_id AND e.parent_id = p.node_id JOIN named c ON e.document_id = c.document_id AND e.child_id = c.node_id)"""


_LEVELS = ", ".join(f"({x})" for x in (0.0, 0.3, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0))
# Sizes of the units at each threshold, by a recursion up the chain of every node.
_SIZES = """grown AS (
  SELECT threshold, document_id, node_id, node_id AS spot, words::BIGINT AS w, chars::BIGINT AS c, 1 AS k, greatest(words, chars // 4)::BIGINT AS tokens, 0 AS n
  FROM sized, grid WHERE text <> '' AND coalesce(kind, '') <> 'root'
  UNION ALL
  SELECT threshold, g.document_id, g.node_id, t.node_id, g.w + t.words, g.c + t.chars, g.k + (t.text <> '')::INT, greatest(g.w + t.words, (g.c + t.chars + 2 * (g.k + (t.text <> '')::INT - 1)) // 4), g.n + 1
  FROM grown g JOIN sized s ON g.document_id = s.document_id AND g.spot = s.node_id JOIN sized t ON t.document_id = s.document_id AND t.node_id = s.up_id
  WHERE g.tokens <= 1024 AND s.up >= threshold AND greatest(g.w + t.words, (g.c + t.chars + 2 * (g.k + (t.text <> '')::INT - 1)) // 4) <= 1024),
ends AS (SELECT * FROM grown QUALIFY row_number() OVER (PARTITION BY threshold, document_id, node_id ORDER BY n DESC) = 1),
means AS (SELECT threshold, count(*) AS units, avg(tokens) AS mean_tokens FROM ends GROUP BY 1)"""
SQL |= {
    "ruled_parents": f"WITH {_ITEMS}, refs AS (SELECT *, coalesce(CASE WHEN grouped THEN '#/groups/' || up WHEN region = 'figure' THEN '#/pictures/' || page_no ELSE '#/body' END, '#/body') AS ref FROM items), {_parents('refs')} SELECT * FROM parents",
    "media_mentions": f"WITH {_NODES} SELECT DISTINCT document_id, node_id, lower(base) AS base, number FROM (SELECT document_id, node_id, unnest(regexp_extract_all(text, '{_NAMED}', 1)) AS base, unnest(regexp_extract_all(text, '{_NAMED}', 2)) AS number FROM nodes)",
    "media_captions": f"WITH {_ITEMS}, {_PICTURES}, {_CAPTIONS} SELECT document_id, media_id, c.node_id AS node_id, c.text AS text FROM captions",
    "media_parents": f"WITH {_PLACED_MEDIA} SELECT document_id, node_id, parent_id, level, level_label FROM placed",
    "media_texts": f"WITH {_PLACED_MEDIA} SELECT m.document_id, m.node_id, c.c.text AS caption, concat_ws(chr(10), c.c.text, labels) AS text FROM pictures m LEFT JOIN captions c ON m.document_id = c.document_id AND m.node_id = c.media_id LEFT JOIN labels l ON l.document_id = m.document_id AND l.node_id = m.node_id",
    "reference_edges": f"WITH {_PLACED_MEDIA} SELECT DISTINCT f.document_id, f.node_id AS parent_id, f.media_id AS child_id, 0.7::DOUBLE AS weight, 'reference' AS relation FROM found f JOIN chosen c ON f.document_id = c.document_id AND f.media_id = c.media_id AND f.no = c.no",
    "built_edges": f"""WITH RECURSIVE {_PLACED_MEDIA},
holding AS (SELECT DISTINCT document_id, parent_id FROM parents),
gone AS (SELECT i.document_id, i.node_id FROM inside i LEFT JOIN holding h ON h.document_id = i.document_id AND h.parent_id = i.node_id WHERE h.parent_id IS NULL AND greatest({_count("coalesce(text, '')", f"[^{_SPACE}]+")}, length(coalesce(text, '')) // 4) <= 8),
made AS (SELECT x.document_id, x.node_id, p.parent_id, level_label, 'text' AS kind, grouped, text, seq, level FROM texts x JOIN parents p USING (document_id, node_id) ANTI JOIN gone g ON g.document_id = x.document_id AND g.node_id = x.node_id
  UNION ALL SELECT document_id, node_id, parent_id, level_label, 'image', false, NULL, seq, level FROM placed),
meta AS (SELECT document_id, lower({_strip("arg_max(title, ingested_at)")}) AS title FROM documents_meta WHERE title IS NOT NULL GROUP BY 1),
tied AS (SELECT m.document_id, coalesce(arg_min(node_id, {{'a': seq, 'b': node_id}}) FILTER (kind = 'text' AND lower({_strip("replace(coalesce(text, ''), chr(0), '')")}) = title), arg_min(node_id, {{'a': seq, 'b': node_id}}) FILTER (kind = 'text' AND level_label = 'Title'), '#/document-root') AS root_id FROM made m LEFT JOIN meta USING (document_id) GROUP BY 1),
all_nodes AS (SELECT document_id, node_id, parent_id, level_label, kind, grouped, seq, level FROM made UNION ALL SELECT document_id, root_id, NULL, 'Root', 'root', false, -1, -1 FROM tied WHERE root_id = '#/document-root'),
joined AS (SELECT n.document_id, r.root_id, n.node_id AS child_id, p.node_id AS known, CASE WHEN n.kind = 'image' THEN CASE WHEN n.level_label = 'Unreferenced Image' THEN 'unreferenced_media' ELSE 'media' END
    WHEN n.grouped THEN 'list_item' WHEN p.level_label IN ('Title', 'Heading', 'Root') AND n.level_label IN ('Title', 'Heading', 'Root') THEN 'section' ELSE 'text' END AS relation
  FROM all_nodes n JOIN tied r USING (document_id) LEFT JOIN all_nodes p ON p.document_id = n.document_id AND p.node_id = n.parent_id AND p.node_id <> n.node_id WHERE n.node_id <> r.root_id),
final AS (SELECT document_id, coalesce(known, root_id) AS parent_id, child_id, CASE WHEN known IS NULL THEN 'root' ELSE relation END AS relation FROM joined),
reach AS (SELECT document_id, root_id AS node_id FROM tied UNION SELECT f.document_id, f.child_id FROM final f JOIN reach r ON f.document_id = r.document_id AND f.parent_id = r.node_id),
lost AS (SELECT f.* FROM final f ANTI JOIN reach r ON r.document_id = f.document_id AND r.node_id = f.child_id),
way AS (SELECT document_id, child_id AS node_id, parent_id AS stop FROM lost UNION SELECT w.document_id, w.node_id, l.parent_id FROM way w JOIN lost l ON w.document_id = l.document_id AND w.stop = l.child_id),
ring AS (SELECT document_id, node_id FROM way WHERE node_id = stop),
part AS (SELECT w.document_id, w.node_id, min(w.stop) AS part FROM way w JOIN ring r ON w.document_id = r.document_id AND w.stop = r.node_id GROUP BY 1, 2),
extra AS (SELECT p.document_id, arg_min(p.node_id, {{'a': n.level, 'b': n.seq, 'c': p.node_id}}) AS child_id FROM part p JOIN all_nodes n USING (document_id, node_id) GROUP BY p.document_id, p.part),
whole AS (SELECT * FROM final UNION ALL SELECT x.document_id, root_id, child_id, 'root' FROM extra x JOIN tied USING (document_id))
SELECT *, {_STRUCTURAL} AS weight FROM whole""",
    "page_places": f'WITH {_BOXES} SELECT document_id, node_id, page_no, block, "column", row_number() OVER (PARTITION BY document_id ORDER BY page_no NULLS FIRST, block, seq, node_id)::INTEGER AS place FROM spots',
    "page_regions": f"""WITH {_BOXES}, n AS (SELECT document_id, page_no, count(*) AS n FROM rules GROUP BY 1, 2),
below AS (SELECT DISTINCT s.document_id, s.page_no FROM spots s JOIN n ON n.document_id = s.document_id AND n.page_no = s.page_no AND s.block = n.n),
held AS (SELECT DISTINCT s.document_id, s.node_id FROM spots s JOIN boxes x ON s.document_id = x.document_id AND s.page_no = x.page_no AND s.l >= x.l - 2 AND s.r <= x.r + 2 AND s.t <= x.t + 2 AND s.b >= x.b - 2)
SELECT s.document_id, s.node_id, CASE WHEN region = 'figure' THEN 'figure' WHEN h.node_id IS NOT NULL THEN 'sidebar' WHEN s.page_no = 1 AND n.n >= 2 AND s.block = n.n - 1 AND w.page_no IS NOT NULL THEN 'front_matter' ELSE 'body' END AS region
FROM spots s LEFT JOIN held h USING (document_id, node_id) LEFT JOIN n ON n.document_id = s.document_id AND n.page_no = s.page_no LEFT JOIN below w ON w.document_id = s.document_id AND w.page_no = s.page_no""",
    "document_titles": f"""WITH {_ITEMS}, high AS (SELECT *, coalesce(line_heights[1], 0) AS high FROM items WHERE page_no = 1)
SELECT document_id, text AS title FROM high QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY high DESC, CASE WHEN high > 0 THEN t ELSE 0 END, seq, text) = 1""",
    "height_histogram": f"""WITH {_ITEMS}, mid AS (SELECT document_id, round(median(h), 1) AS height FROM (SELECT document_id, node_id, unnest(line_heights) AS h FROM (SELECT document_id, snippet_id AS node_id, line_heights FROM now)) WHERE h IS NOT NULL GROUP BY document_id, node_id)
SELECT document_id, height, count(*) AS n FROM mid GROUP BY 1, 2""",
    "bm25_symmetric": f"""WITH {_TF}, {_bm25("child_id", "parent_id", "ahead")}, {_bm25("parent_id", "child_id", "back")},
filled AS (SELECT e.document_id, e.parent_id, e.child_id, greatest(coalesce(a.score, 0), coalesce(b.score, 0)) AS score FROM links e LEFT JOIN ahead a USING (document_id, parent_id, child_id) LEFT JOIN back b USING (document_id, parent_id, child_id))
SELECT document_id, parent_id, child_id, round(CASE WHEN max(score) OVER d > 0 THEN score / max(score) OVER d ELSE 0 END, 6) AS weight FROM filled WINDOW d AS (PARTITION BY document_id)""",
    "inverted_similarity": f"WITH {_SIMILAR} SELECT document_id, parent_id, child_id, round(1 - x, 6) AS weight FROM alike",
    "combined_weights": f"WITH {_SIMILAR} SELECT document_id, parent_id, child_id, round((own + x) / 2, 6) AS weight FROM alike",
    "reweighed_edges": f"WITH {_SIMILAR} SELECT document_id, parent_id, child_id, relation, round({_STRUCTURAL} * x, 6) AS weight FROM alike",
    "semantic_weights": f"WITH {_NODES}, {_EDGES}, {_COSINES} SELECT document_id, parent_id, child_id, round(y, 5) AS weight FROM cosines",
    "blended_similarity": f"WITH {_SIMILAR}, {_COSINES} SELECT s.document_id, s.parent_id, s.child_id, round(0.25 * y + 0.75 * x, 5) AS weight FROM alike s JOIN cosines USING (document_id, parent_id, child_id)",
    "merge_means": f"WITH RECURSIVE {_CHAIN}, grid AS (SELECT * FROM (VALUES {_LEVELS}) x(threshold)), {_SIZES} SELECT threshold::DOUBLE AS min_weight, units, round(mean_tokens, 6) AS mean_tokens FROM means",
    "merge_calibration": f"""WITH RECURSIVE {_CHAIN}, choices AS (SELECT DISTINCT weight AS threshold FROM links UNION SELECT 0.0 UNION SELECT least(1.0, max(weight) + 1e-9) FROM links),
grid AS (SELECT threshold FROM choices UNION SELECT 2.0), {_SIZES},
goal AS (SELECT greatest(1.0, 2 * mean_tokens) AS target FROM means WHERE threshold = 2.0),
tried AS (SELECT threshold, mean_tokens, target, abs(mean_tokens - target) AS gap FROM means, goal WHERE threshold <= 1.0)
SELECT arg_min(threshold, {{'gap': gap, 'threshold': threshold}})::DOUBLE AS min_weight, max(target) AS target, arg_min(mean_tokens, {{'gap': gap, 'threshold': threshold}}) AS achieved, count(*)::INTEGER AS evaluated, true AS exhaustive FROM tried""",
    "graph_summary": f"""WITH RECURSIVE {_TREE_SUMS} SELECT document_id, count(*) AS nodes, count(*) FILTER (b.node_id IS NULL) AS roots, count(*) FILTER (h) AS headings, max(CASE WHEN r.node_id IS NOT NULL THEN depth END)::INTEGER AS depth, sum(words)::BIGINT AS words
FROM sized LEFT JOIN depths USING (document_id, node_id) LEFT JOIN (SELECT document_id, node_id FROM best) b USING (document_id, node_id) LEFT JOIN (SELECT document_id, node_id FROM rooted) r USING (document_id, node_id) GROUP BY 1""",
    "document_languages": f"""WITH {_NODES}, head AS (SELECT document_id, {_WORDS} AS w FROM nodes QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY seq, node_id) <= 200)
SELECT document_id, CASE WHEN sum({_votes("w", "en")}) > sum({_votes("w", "de")}) THEN 'en' ELSE 'de' END AS lang FROM head GROUP BY 1""",
    "relation_mix_by_language": f"""WITH {_CONTEXT}, head AS (SELECT document_id, {_WORDS} AS w FROM nodes QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY seq, node_id) <= 200),
langs AS (SELECT document_id, CASE WHEN sum({_votes("w", "en")}) > sum({_votes("w", "de")}) THEN 'en' ELSE 'de' END AS lang FROM head GROUP BY 1),
pooled AS (SELECT lang, supply_relation FROM related JOIN langs USING (document_id) UNION ALL SELECT 'all', supply_relation FROM related)
SELECT lang, supply_relation, count(*) AS edges, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS share FROM pooled GROUP BY 1, 2""",
    "repeated_texts": f"WITH {_NODES}, flat AS (SELECT document_id, regexp_replace({_strip('text')}, '[{_SPACE}]+', ' ', 'g') AS text FROM nodes) SELECT document_id, text, count(*) AS n FROM flat WHERE length(text) > 25 GROUP BY 1, 2 HAVING count(*) >= 3",
    "graph_checks": f"""WITH {_CONTEXT}, {_BEST}, faults AS (
  SELECT n.document_id, unnest(list_filter([CASE WHEN b.node_id IS NULL AND NOT h THEN 'orphan' END, CASE WHEN level_label = 'Heading' AND length(text) > 120 THEN 'long_heading' END,
    CASE WHEN kind IN ('image', 'table') AND level_label = 'Unreferenced Image' THEN 'unreferenced_media' END, CASE WHEN text = '' THEN 'empty' END], lambda x: x IS NOT NULL)) AS fault
  FROM named n LEFT JOIN (SELECT document_id, node_id FROM best) b USING (document_id, node_id)
  UNION ALL
  SELECT e.document_id, unnest(list_filter([CASE WHEN p.level_label IN ('Title', 'Heading') AND c.level_label IN ('Title', 'Heading') AND c.level <= p.level THEN 'inverted_level' END,
    CASE WHEN p.page_no > 0 AND c.page_no > 0 AND abs(c.page_no - p.page_no) > 2 THEN 'distant_edge' END], lambda x: x IS NOT NULL))
  FROM links e JOIN named p ON e.document_id = p.document_id AND e.parent_id = p.node_id JOIN named c ON e.document_id = c.document_id AND e.child_id = c.node_id)
SELECT document_id, fault, count(*) AS n FROM faults GROUP BY 1, 2""",
    "metric_spread": f"""WITH {_SIMILAR}, pooled AS ({_spreads({"structural": f"SELECT {_STRUCTURAL} AS weight FROM links", "bm25": "SELECT x AS weight FROM alike", "uniform": "SELECT 1.0 AS weight FROM links"})})
SELECT metric, count(*) AS edges, round(avg(weight), 6) AS mean, round(stddev_pop(weight), 6) AS deviation, round(min(weight), 6)::DOUBLE AS least, round(max(weight), 6)::DOUBLE AS most, count(DISTINCT round(weight, 4)) AS different, count(*) FILTER (weight = 0) AS zeros FROM pooled GROUP BY 1""",
    "metric_agreement": f"""WITH {_SIMILAR}, v AS (SELECT round({_STRUCTURAL}, 6) AS a, round(x, 6) AS b FROM alike),
ranked AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM v)
SELECT 'structural' AS a, 'bm25' AS b, round(corr(ra, rb), 6) AS value FROM ranked UNION ALL SELECT 'structural', '', round(stddev_pop(a), 6) FROM ranked UNION ALL SELECT 'bm25', '', round(stddev_pop(b), 6) FROM ranked""",
    "graph_relationships": f"""WITH {_NODES}, {_EDGES}, named AS (SELECT document_id, max({_LOW_TITLE}) AS title FROM documents_meta GROUP BY 1),
roots AS (SELECT document_id, coalesce(arg_min(node_id, {{'a': seq, 'b': node_id}}) FILTER (lower({_strip('text')}) = title), arg_min(node_id, {{'a': seq, 'b': node_id}}) FILTER (level_label = 'Title'), '#/document-root') AS root_id FROM nodes LEFT JOIN named USING (document_id) GROUP BY 1)
SELECT document_id, parent_id AS source, child_id AS target, CASE WHEN relation = 'reference' THEN 'REFERENCES' ELSE 'HAS_CHILD' END AS kind, weight FROM links
UNION ALL SELECT document_id, document_id, root_id, 'HAS_ROOT', NULL FROM roots""",
    "graph_outline": f"""WITH RECURSIVE {_CHAIN}, {_BEST.replace("best AS", "best_again AS")},
ways AS (SELECT f.document_id, f.node_id, string_agg(format('{{:08d}}:{{}}', coalesce(s.seq, 99999999), s.node_id), '/' ORDER BY f.distance DESC) AS way FROM far f JOIN sized s ON f.document_id = s.document_id AND f.spot = s.node_id GROUP BY 1, 2),
deep AS (SELECT document_id, node_id, max(distance)::INTEGER AS depth FROM far GROUP BY 1, 2)
SELECT document_id, node_id, depth, way, repeat('  ', depth) || coalesce(level_label, '-') || ' ' || substr(regexp_replace({_strip('text')}, '[{_SPACE}]+', ' ', 'g'), 1, 90) AS line FROM sized JOIN ways USING (document_id, node_id) JOIN deep USING (document_id, node_id)""",
    "merge_subtree": f"""WITH RECURSIVE {_CHAIN}, units AS (SELECT * FROM sized WHERE text <> '' AND coalesce(kind, '') <> 'root'),
sums AS (SELECT f.document_id, f.spot AS head, f.node_id, u.text, u.page_no, row_number() OVER w AS pos, greatest(sum(u.words) OVER w, (sum(u.chars) OVER w + 2 * (count(*) OVER w - 1)) // 4)::BIGINT AS t
  FROM far f JOIN units u ON f.document_id = u.document_id AND f.node_id = u.node_id JOIN units h ON h.document_id = f.document_id AND h.node_id = f.spot AND h.h
  WINDOW w AS (PARTITION BY f.document_id, f.spot ORDER BY f.distance > 0, u.seq, u.node_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
stops AS (SELECT *, max((t > 1024 AND pos > 1)::INT) OVER (PARTITION BY document_id, head ORDER BY pos) AS stopped FROM sums),
carried AS (SELECT * FROM stops WHERE stopped = 0),
made AS (SELECT document_id, head AS unit_id, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS text, string_agg(node_id, ',' ORDER BY pos) AS members, max(t) AS token_count, list(page_no ORDER BY pos) AS pages FROM carried GROUP BY 1, 2
  UNION ALL SELECT u.document_id, u.node_id, u.text, u.node_id, greatest(u.words, u.chars // 4)::BIGINT, [u.page_no] FROM units u ANTI JOIN carried c ON c.document_id = u.document_id AND c.node_id = u.node_id),
crumbs AS (SELECT f.document_id, f.node_id AS unit_id, string_agg(s.text, ' > ' ORDER BY f.distance DESC) AS breadcrumb FROM far f JOIN sized s ON f.document_id = s.document_id AND f.spot = s.node_id WHERE f.distance > 0 AND s.h AND s.text <> '' GROUP BY 1, 2)
SELECT document_id, unit_id, text, members, coalesce(breadcrumb, '') AS breadcrumb, token_count, array_to_string(list_filter(pages, lambda x, i: x IS NOT NULL AND list_position(pages, x) = i), ',') AS pages, 0 AS links FROM made LEFT JOIN crumbs USING (document_id, unit_id)""",
    "syntactic_needs": f"""WITH {_CONTEXT}, ends AS (SELECT e.document_id, e.parent_id, e.child_id, p.text AS p_text, c.text AS text FROM links e JOIN nodes p ON e.document_id = p.document_id AND e.parent_id = p.node_id JOIN nodes c ON e.document_id = c.document_id AND e.child_id = c.node_id),
read AS (SELECT *, {_WORDS} AS w, lower(regexp_replace(text, '^[\\s\\-–—•*·]+', '')) AS opened, regexp_extract(regexp_replace(text, '^[\\s\\-–—•*·§]+', ''), '^\\P{{L}}*(\\p{{L}})', 1) AS letter FROM ends),
said AS (SELECT *, {_votes("w", "en")} > {_votes("w", "de")} AS en, regexp_extract(opened, '^[^\\p{{L}}\\p{{N}}_]*([\\p{{L}}\\p{{N}}_]+)', 1) AS first FROM read),
signs AS (SELECT *, len(list_filter(w, lambda x: list_contains(CASE WHEN en THEN {_listed(ling.FINITE["en"])} ELSE {_listed(ling.FINITE["de"])} END, x))) = 0 AS a, NOT regexp_matches(trim(text, ' '), '[.!?]$') AS b,
  list_contains(CASE WHEN en THEN {_listed(ling.CONNECTIVES["en"])} ELSE {_listed(ling.CONNECTIVES["de"])} END, first) OR {" OR ".join(f"starts_with(opened, '{x}')" for x in ling.PHRASES)} AS c, regexp_matches(letter, '^\\p{{Ll}}') AS d, ends_with(rtrim(p_text, ' '), ':') AS e FROM said)
SELECT document_id, parent_id, child_id, round((a::INT + b::INT + c::INT + d::INT + 2 * e::INT) / 6, 6) AS need FROM signs""",
    "graph_snippets": f"WITH {_NODES} SELECT sha256(document_id || ':' || node_id) AS snippet_id, document_id, seq, level, substr(text, 1, 100) AS preview, coalesce(page_no::VARCHAR, '') AS pages FROM nodes",
    "chunk_headings": """WITH newest AS (SELECT chunk_id, meta FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC) = 1)
SELECT chunk_id, coalesce(array_to_string(from_json(json_extract(meta, '$.headings'), '["VARCHAR"]'), ' > '), '') AS headings, 0 AS places FROM newest""",
    "edge_ancestors": f"""WITH RECURSIVE {_NODES}, {_EDGES}, ahead AS (SELECT document_id, node_id, grouped, lead(node_id) OVER (PARTITION BY document_id ORDER BY seq, node_id) AS next FROM nodes),
up AS (SELECT DISTINCT * FROM (SELECT document_id, child_id AS node_id, parent_id AS ancestor_id FROM links UNION ALL SELECT document_id, next, node_id FROM ahead WHERE grouped AND next IS NOT NULL) WHERE node_id <> ancestor_id),
way AS (SELECT *, 1 AS distance FROM up UNION SELECT w.document_id, w.node_id, u.ancestor_id, w.distance + 1 FROM way w JOIN up u ON w.document_id = u.document_id AND w.ancestor_id = u.node_id WHERE w.distance < 100 AND u.ancestor_id <> w.node_id)
SELECT document_id, node_id, ancestor_id, min(distance)::INTEGER AS distance FROM way GROUP BY 1, 2, 3""",
    "counterfactual_parents": f"""WITH RECURSIVE {_NODES}, {_EDGES}, up AS (SELECT DISTINCT document_id, child_id AS node_id, parent_id AS ancestor_id FROM links),
way AS (SELECT * FROM up UNION SELECT w.document_id, w.node_id, u.ancestor_id FROM way w JOIN up u ON w.document_id = u.document_id AND w.ancestor_id = u.node_id),
ring AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY control) - 1 AS at, count(*) OVER (PARTITION BY document_id) AS n FROM (SELECT DISTINCT l.document_id, parent_id AS control, {_strip("text")} AS text FROM links l JOIN nodes x ON x.document_id = l.document_id AND x.node_id = l.parent_id)),
tried AS (SELECT e.document_id, e.parent_id, e.child_id, k.control, (k.at - p.at - greatest(1, p.n // 2) + 2 * p.n) % p.n AS step FROM links e JOIN ring p ON e.document_id = p.document_id AND e.parent_id = p.control JOIN ring k ON k.document_id = e.document_id
  LEFT JOIN way w ON w.document_id = e.document_id AND w.node_id = e.child_id AND w.ancestor_id = k.control WHERE k.text <> '' AND k.control NOT IN (e.parent_id, e.child_id) AND w.node_id IS NULL)
SELECT document_id, parent_id, child_id, arg_min(control, step) AS control FROM tried GROUP BY 1, 2, 3""",
    "edge_cards": f"WITH {_NODES}, {_EDGES}, {_cards(80)} SELECT * FROM cards",
    "strongest_edges": f"""WITH {_SIMILAR}, {_cards(60)}, pooled AS (SELECT 'structural' AS metric, document_id, parent_id, child_id, {_STRUCTURAL} AS weight FROM links UNION ALL SELECT 'bm25', document_id, parent_id, child_id, round(x, 9) FROM alike),
best AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY weight DESC, document_id, parent_id, child_id)::INTEGER AS place FROM pooled QUALIFY place <= 10)
SELECT metric, place, round(weight, 6) AS weight, document_id, parent_id, child_id, relation, parent_text, child_text FROM best JOIN cards USING (document_id, parent_id, child_id)""",
    "fragmentation": rf"""WITH {_NODES}, ahead AS (SELECT *, lead(node_id) OVER w AS next_id, lead(text) OVER w AS next, lead(page_no) OVER w AS next_page FROM nodes WHERE text <> '' WINDOW w AS (PARTITION BY document_id ORDER BY seq, node_id)),
scored AS (SELECT *, (NOT regexp_matches(text, '[.!?:;…][^A-Za-z0-9_]*$'))::INT + coalesce(regexp_matches(next, '^[^A-Za-z0-9_]*\p{{Ll}}'), false)::INT + coalesce(next_page = page_no + 1, false)::INT AS score FROM ahead WHERE next_page - page_no <= 1 AND NOT coalesce(level_label IN ('Title', 'Heading', 'Root'), false))
SELECT document_id, node_id, next_id, score FROM scored WHERE score >= 2""",
    "built_nodes": f"""WITH {_PLACED_MEDIA},
holding AS (SELECT DISTINCT document_id, parent_id FROM parents),
gone AS (SELECT i.document_id, i.node_id FROM inside i LEFT JOIN holding h ON h.document_id = i.document_id AND h.parent_id = i.node_id WHERE h.parent_id IS NULL AND greatest({_count("coalesce(text, '')", f"[^{_SPACE}]+")}, length(coalesce(text, '')) // 4) <= 8),
kept AS (SELECT x.document_id, 'text' AS kind, level_label FROM texts x ANTI JOIN gone g ON g.document_id = x.document_id AND g.node_id = x.node_id),
meta AS (SELECT document_id, lower({_strip("arg_max(title, ingested_at)")}) AS title FROM documents_meta WHERE title IS NOT NULL GROUP BY 1),
bare AS (SELECT x.document_id FROM texts x ANTI JOIN gone g ON g.document_id = x.document_id AND g.node_id = x.node_id LEFT JOIN meta m ON m.document_id = x.document_id GROUP BY 1
  HAVING count(*) FILTER (level_label = 'Title') = 0 AND count(*) FILTER (lower({_strip("replace(coalesce(text, ''), chr(0), '')")}) = title) = 0)
SELECT document_id, kind, level_label, count(*) AS n FROM (SELECT * FROM kept UNION ALL SELECT document_id, 'image', level_label FROM placed UNION ALL SELECT document_id, 'root', 'Root' FROM bare) GROUP BY 1, 2, 3""",
    "document_fields": f"""WITH {_ITEMS}, refs AS (SELECT *, coalesce(CASE WHEN grouped THEN '#/groups/' || up WHEN region = 'figure' THEN '#/pictures/' || page_no ELSE '#/body' END, '#/body') AS ref FROM items),
wanted AS (SELECT * FROM (VALUES ('therapy', 'treat', 1, 2), ('control', 'monitor', 1, 3), ('none', 'xyzzy', 1, 9)) x(field, label, low, high)),
rows AS (SELECT r.document_id, w.field, w.label AS word, r.node_id, r.seq, r.text, r.ref, r.l, r.t, r.b FROM refs r JOIN wanted w ON r.page_no BETWEEN w.low AND w.high),
held AS (SELECT * FROM rows WHERE contains(lower(text), word) QUALIFY row_number() OVER (PARTITION BY document_id, field ORDER BY seq, node_id) = 1),
near AS (SELECT r.document_id, r.field, CASE WHEN r.ref = h.ref THEN r.node_id ELSE r.ref END AS ref FROM rows r JOIN held h ON r.document_id = h.document_id AND r.field = h.field AND abs(h.b - r.t) < 6 AND abs(h.l - r.l) < 6
  QUALIFY row_number() OVER (PARTITION BY r.document_id, r.field ORDER BY r.seq, CASE WHEN r.ref = h.ref THEN r.node_id ELSE r.ref END) = 1)
SELECT h.document_id, h.field, coalesce(n.ref, h.node_id) AS ref FROM held h LEFT JOIN near n ON h.document_id = n.document_id AND h.field = n.field""",
    "expand_parent": rf"""WITH RECURSIVE {_CHAIN}, asked AS (SELECT * FROM (VALUES ('insulin', ['insulin', 'insulintherapie', 'insuline']), ('control', ['control', 'kontrolle', 'contrôle'])) x(query_id, terms)),
worded AS (SELECT *, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}]+')) AS w FROM sized),
hits AS (SELECT a.query_id, s.document_id, s.node_id, round(len(list_filter(w, lambda x: list_contains(a.terms, x))) / len(w), 6) AS score, t.up_id, t.up FROM worded s JOIN tied t USING (document_id, node_id), asked a WHERE len(list_filter(w, lambda x: list_contains(a.terms, x))) > 0),
sides AS (SELECT h.query_id, h.document_id, h.node_id, h.score, p.node_id AS parent_id, s.text, p.text AS p_text, greatest(s.words, s.chars // 4) AS own,
    greatest(s.words + p.words, (s.chars + p.chars + CASE WHEN s.chars > 0 AND p.chars > 0 THEN 2 ELSE 0 END) // 4) AS both_tokens, row_number() OVER (PARTITION BY h.query_id, h.document_id ORDER BY h.score DESC, h.node_id) AS place
  FROM hits h JOIN sized s ON s.document_id = h.document_id AND s.node_id = h.node_id LEFT JOIN sized p ON p.document_id = h.document_id AND p.node_id = h.up_id AND h.up >= 0),
served AS (
  SELECT query_id, document_id, 0 AS place, 2000 AS budget FROM sides GROUP BY 1, 2
  UNION ALL
  SELECT s.query_id, s.document_id, v.place + 1, (v.budget - CASE WHEN s.parent_id IS NOT NULL AND s.both_tokens <= 2048 AND s.both_tokens - s.own <= v.budget THEN s.both_tokens - s.own ELSE 0 END)::INTEGER
  FROM served v JOIN sides s ON s.query_id = v.query_id AND s.document_id = v.document_id AND s.place = v.place + 1),
fitted AS (SELECT s.*, s.parent_id IS NOT NULL AND s.both_tokens <= 2048 AND s.both_tokens - s.own <= v.budget AS fits FROM sides s JOIN served v ON s.query_id = v.query_id AND s.document_id = v.document_id AND v.place = s.place - 1),
crumbs AS (SELECT f.document_id, f.node_id, string_agg(s.text, ' > ' ORDER BY f.distance DESC) AS breadcrumb FROM far f JOIN sized s ON f.document_id = s.document_id AND f.spot = s.node_id WHERE f.distance > 0 AND s.h AND s.text <> '' GROUP BY 1, 2)
SELECT query_id, document_id, node_id AS unit_id, score, CASE WHEN fits THEN 'parent' ELSE 'hit' END AS reason, CASE WHEN fits THEN parent_id || ',' || node_id ELSE node_id END AS members, '' AS absorbed,
  CASE WHEN fits THEN both_tokens - own ELSE 0 END::INTEGER AS added_tokens, CASE WHEN fits THEN both_tokens ELSE own END::INTEGER AS token_count,
  CASE WHEN fits AND p_text <> '' THEN p_text || chr(10) || chr(10) || text ELSE text END AS text, coalesce(breadcrumb, '') AS breadcrumb FROM fitted LEFT JOIN crumbs USING (document_id, node_id)""",
    "recentred_complementarity": f"""WITH RECURSIVE {_CHAIN}, {_IDF}, named AS (SELECT *, coalesce(level_label IN ('Title', 'Heading', 'Root'), false) AS h FROM nodes), rarest AS (SELECT coalesce(max(idf), 1.0) AS rarest FROM idf),
counted AS (SELECT document_id, node_id, len({_WORDS}) AS len FROM nodes),
ends AS (SELECT e.document_id, e.parent_id, e.child_id, ({_RELATION}) IN ('section', 'heading_list', 'heading_text') AS heads, k.len FROM links e JOIN named p ON e.document_id = p.document_id AND e.parent_id = p.node_id
  JOIN named c ON e.document_id = c.document_id AND e.child_id = c.node_id JOIN counted k ON k.document_id = e.document_id AND k.node_id = e.parent_id),
stand AS (SELECT DISTINCT n.document_id, n.node_id AS control, n.h, k.len FROM links e JOIN named n ON n.document_id = e.document_id AND n.node_id = e.parent_id JOIN counted k ON k.document_id = n.document_id AND k.node_id = n.node_id WHERE n.text <> ''),
kept AS (SELECT e.document_id, e.parent_id, e.child_id, s.control FROM ends e JOIN stand s ON s.document_id = e.document_id AND s.h = e.heads AND s.control NOT IN (e.parent_id, e.child_id)
  ANTI JOIN (SELECT document_id, node_id AS child_id, spot AS control FROM far WHERE distance > 0) u ON u.document_id = e.document_id AND u.child_id = e.child_id AND u.control = s.control
  QUALIFY row_number() OVER (PARTITION BY e.document_id, e.parent_id, e.child_id ORDER BY abs(s.len - e.len), s.control) <= 8),
wanted AS (SELECT document_id, parent_id, child_id FROM links UNION SELECT document_id, control, child_id FROM kept),
pairs AS (SELECT w.document_id, w.parent_id, w.child_id, p.t AS pt, c.t AS ct FROM wanted w JOIN stems p ON w.document_id = p.document_id AND w.parent_id = p.node_id JOIN stems c ON w.document_id = c.document_id AND w.child_id = c.node_id),
novel AS (SELECT document_id, parent_id, child_id, sum(idf) AS novel FROM (SELECT *, row_number() OVER (PARTITION BY document_id, parent_id, child_id ORDER BY idf DESC) AS r
  FROM (SELECT document_id, parent_id, child_id, coalesce(idf, rarest) AS idf FROM (SELECT document_id, parent_id, child_id, unnest(list_filter(pt, lambda x: NOT list_contains(ct, x))) AS term FROM pairs) LEFT JOIN idf USING (term), rarest)) WHERE r <= 8 GROUP BY 1, 2, 3),
mass AS (SELECT document_id, node_id AS child_id, sum(coalesce(idf, rarest)) AS mass FROM (SELECT document_id, node_id, unnest(t) AS term FROM stems) LEFT JOIN idf USING (term), rarest GROUP BY 1, 2),
scored AS (SELECT w.document_id, w.parent_id, w.child_id, CASE WHEN coalesce(novel, 0) + coalesce(mass, 0) > 0 THEN coalesce(novel, 0) / (coalesce(novel, 0) + coalesce(mass, 0)) ELSE 0 END AS v FROM wanted w LEFT JOIN novel USING (document_id, parent_id, child_id) LEFT JOIN mass USING (document_id, child_id)),
base AS (SELECT k.document_id, k.parent_id, k.child_id, avg(s.v) AS base FROM kept k JOIN scored s ON s.document_id = k.document_id AND s.parent_id = k.control AND s.child_id = k.child_id GROUP BY 1, 2, 3)
SELECT e.document_id, e.parent_id, e.child_id, round(greatest(0, CASE WHEN base IS NULL THEN 0 ELSE v - base END), 6) AS complementarity FROM links e JOIN scored USING (document_id, parent_id, child_id) LEFT JOIN base USING (document_id, parent_id, child_id)""",
}
