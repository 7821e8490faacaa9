"""SQL for the operators that SQL can express, over whole tables, without filters, hashes or partitions of work.

Not here: 1 (merges are a loop over each word), 2 (a schedule is a loop over slots), 5 (a model of all
bytes of the corpus), 10 (maximisation is a loop over estimates). Tests hold these against brute force.
"""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Smallest node reachable over links(a, b) both ways, for nodes(id).
_REACH = "reach AS (SELECT id AS node, id AS root FROM nodes UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node), least AS (SELECT node AS id, min(root) AS component_id FROM reach GROUP BY node)"

OP3 = f"""WITH RECURSIVE sound AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  unit AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS r FROM sound),
  links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.r * b.r) >= 0.93),
  nodes AS (SELECT DISTINCT vec_id AS id FROM embeddings), {_REACH}, counted AS (SELECT a, count(DISTINCT b) AS n FROM links GROUP BY a)
SELECT id AS vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, id = component_id AS kept FROM least LEFT JOIN counted ON a = id"""

OP4 = f"""WITH RECURSIVE split_ AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", _LOWER)} AS w FROM documents),
  sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM split_),
  items AS (SELECT doc_id, unnest(s) AS item FROM sets),
  often AS (SELECT item FROM items GROUP BY item HAVING count(*) > 1),
  shared AS (SELECT i.doc_id, i.item FROM items i JOIN often USING (item)),
  common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shared x JOIN shared y ON x.item = y.item AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
  links AS (SELECT a, b FROM common c JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n >= 80 * (len(x.s) + len(y.s) - n)),
  nodes AS (SELECT doc_id AS id FROM documents), {_REACH}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON id = doc_id"""

_HOST = r"translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2)"


def op6(rules: list[tuple[str, str]]) -> str:
    cases, verdicts = [], []
    for action, rule in sorted(rules, key=lambda r: -len(r[1])):
        host, path = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
        cases.append(f"WHEN {fits} THEN '{rule}'")
        verdicts.append(f"WHEN rule = '{rule}' THEN '{action}'")
    return f"""WITH p AS (SELECT page_id, coalesce(url, '') AS url, {_HOST} AS host, {_PATH} AS path FROM pages),
  c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '') END AS key FROM p),
  listed AS (SELECT DISTINCT key FROM c WHERE contains(url, 'ref=') AND key IS NOT NULL),
  ruled AS (SELECT *, CASE {' '.join(cases)} END AS rule FROM c)
SELECT page_id, host, path, rule, CASE {' '.join(verdicts)} WHEN listed.key IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict FROM ruled LEFT JOIN listed ON listed.key = ruled.key"""


def _escaped(text: str) -> str:
    found = " + ".join(f"(length({text}) - length(replace({text}, '{x}', ''))) / {len(x)}" for x in ("\\", "<|", "<s>", "</s>", "[INST]", "[/INST]"))
    return f"(length({text}) + {found})"


OP7 = f"""WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
  per AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss, sum(23 + {_escaped('role')} + {_escaped('text')}) AS chars FROM said GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS attachment_tokens FROM per"""

OP8 = f"""WITH split_ AS (SELECT doc_id, {_WORDS} AS w FROM documents),
  starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM split_ WHERE len(w) >= 50),
  windows AS (SELECT doc_id, p, array_to_string(list_slice(w, p, p + 49), ' ') AS t FROM starts),
  firsts AS (SELECT t, min(doc_id) AS least FROM windows GROUP BY t),
  hits AS (SELECT doc_id, p FROM windows JOIN firsts USING (t) WHERE least < doc_id),
  gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM hits),
  words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM split_),
  kept AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS t, count(*) AS n FROM words x LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.i = x.i WHERE g.i IS NULL GROUP BY x.doc_id)
SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM split_ s LEFT JOIN kept k ON k.doc_id = s.doc_id"""

#: The pages of the tables hold one article of headings, paragraphs, bold text and line breaks.
OP9 = r"""WITH body AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS t FROM pages),
  plain AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(t, '</?(p|h1|br)>', ' ', 'g'), '</?b>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM body)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM plain"""


#: Each order applied step by step: a document goes at the first of its failures.
OP12 = r"""
WITH RECURSIVE letters(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders(o) AS (SELECT l FROM letters UNION ALL SELECT o || l FROM orders, letters WHERE NOT contains(o, l)),
texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
firsts AS (SELECT text, min(doc_id) AS first_id FROM texts GROUP BY text),
said AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
words AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts),
fails AS (
  SELECT w.doc_id, w.part,
    CASE WHEN len(w.w) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(w.w)) < 50 * len(w.w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 3 * length(w.text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(w.text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN f.first_id < w.doc_id THEN 'E' ELSE '' END AS failed
  FROM words w JOIN firsts f ON f.text = w.text),
counted AS (
  SELECT part, failed, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM fails LEFT JOIN said USING (doc_id) GROUP BY part, failed),
full_orders AS (SELECT o FROM orders WHERE length(o) = 5),
went AS (
  SELECT part, o, failed, n, good, toxic,
    (SELECT min(position(l IN o)) FROM letters WHERE contains(failed, l)) AS gone_at
  FROM counted, full_orders),
steps AS (SELECT o, s::INT AS step, o[s] AS letter FROM full_orders, range(1, 6) t(s)),
found AS (
  SELECT part, steps.o AS filter_order, step, letter,
    sum(CASE WHEN gone_at IS NULL OR gone_at > step THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN gone_at = step THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN contains(failed, letter) AND gone_at < step THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN failed = letter THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN gone_at = step THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN gone_at = step THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM went JOIN steps ON steps.o = went.o GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM found"""
