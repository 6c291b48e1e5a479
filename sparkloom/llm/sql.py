"""DuckDB SQL for the queries of this package that SQL can express."""

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op4_url_filters"] = r"""
WITH rules(host, path, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
urls AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages),
fits AS (
  SELECT u.page_id, u.host, u.path, r.host || r.path AS rule, r.action,
         row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC) AS n
  FROM urls u LEFT JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM fits WHERE n = 1
"""

ORACLE_SQL["op10_exact_dedup"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""


def _license_sql() -> str:
    from .licenses import NOTICE, RULES, SENTENCES, SPDX, called, patterns

    sentences = ", ".join(f"('{name}', '{value}')" for name, value in SENTENCES.items())
    rules = ", ".join(f"('{name}', ',{','.join(ids)},')" for name, ids in [*RULES, *((x, (NOTICE + x,)) for x in sorted(set(called().values())))])
    names = ", ".join(f"('{name}', '{NOTICE}{ident}')" for name, ident in called().items())
    notice, expression, each = patterns()
    ends = r"regexp_replace({0}, '([.!?;])[ \t\r\f]+', '\1' || chr(10), 'g')"
    normal = "trim(regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))"
    return f"""
WITH known(name, sentence) AS (VALUES {sentences}),
called(name, ident) AS (VALUES {names}),
rules(licence, ids) AS (VALUES {rules}),
texts AS (SELECT doc_id, 0 AS reading, coalesce(text, '') AS t FROM documents
          UNION ALL SELECT doc_id, 1, regexp_replace(coalesce(text, ''), '[ \\t\\r\\n\\f]+', ' ', 'g') FROM documents),
parts AS (SELECT doc_id, reading, unnest(string_split({ends.format('t')}, chr(10))) AS s, generate_subscripts(string_split({ends.format('t')}, chr(10)), 1) AS place FROM texts),
normed AS (SELECT doc_id, reading, place, {normal} AS n FROM parts WHERE length(s) >= 3),
told AS (SELECT doc_id, reading, place, n FROM normed WHERE n IN (SELECT sentence FROM known) OR contains(n, ' under ') OR contains(n, 'covered by ') OR contains(n, 'governed by ') OR contains(n, ' or ') OR contains(n, ' and ') OR contains(n, '{SPDX}')),
named AS (SELECT t.doc_id, t.reading, t.place,
                 CASE WHEN contains(n, '{SPDX}') OR regexp_matches(n, '{expression}') THEN regexp_extract_all('or ' || n, '{each}', 1) ELSE [regexp_extract(n, '{notice}', 1)] END AS xs
          FROM told t WHERE n NOT IN (SELECT sentence FROM known)),
listed AS (SELECT doc_id, reading, place, unnest(xs) AS x, generate_subscripts(xs, 1) AS turn FROM named),
found AS (SELECT t.doc_id, t.reading, t.place, 0 AS turn, k.name FROM told t JOIN known k ON t.n = k.sentence
          UNION ALL SELECT l.doc_id, l.reading, l.place, l.turn, c.ident FROM listed l JOIN called c ON c.name = l.x),
readings AS (SELECT doc_id, reading, string_agg(name, ',' ORDER BY place, turn) AS ids, count(*) AS n FROM found GROUP BY doc_id, reading),
best AS (SELECT doc_id, ids, n FROM readings QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, reading) = 1),
fits AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licenses FROM best JOIN rules r ON contains(',' || best.ids || ',', r.ids) GROUP BY doc_id)
SELECT d.doc_id, coalesce(b.ids, '') AS sentence_ids, coalesce(b.n, 0) AS n_sentences, coalesce(f.licenses, '') AS licenses
FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id LEFT JOIN fits f ON d.doc_id = f.doc_id
"""


ORACLE_SQL["op9_license_scan"] = _license_sql()

ORACLE_SQL["op1_near_dedup"] = r"""
WITH RECURSIVE
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b WHERE 100 * c.both >= 75 * (x.n + y.n - c.both)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, label) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.label FROM reach r JOIN edges e ON e.a = r.doc_id),
labels AS (SELECT doc_id, min(label) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""
