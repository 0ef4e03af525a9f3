"""DuckDB SQL for the opN queries that SQL can express."""

from __future__ import annotations

from lattice.llm import mixing, urls

OP2 = r"""
WITH said AS (SELECT '<|im_end|><|im_start|>assistant ok' AS t),
rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', t FROM said UNION ALL SELECT -1, 1, 'assistant', t FROM said),
marked AS (SELECT *, replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<|', '%3C|') AS r, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS b FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(12 + length(r) + 1 + length(b) + 11)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""

OP4 = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT a AS node, a AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
roots AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, coalesce(component_id, s.doc_id) AS component_id FROM sets s LEFT JOIN roots ON node = s.doc_id
"""


def op7(levels: int = 4) -> str:
    """The rules and the template tree of ``urls.judge``, unrolled to ``levels`` levels; open branches beyond give no rows."""
    rules = sorted(urls.RULES, key=lambda r: -(len(r[1]) + len(r[2])))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in rules) + " END"
    action = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{a}'" for a, h, p in rules) + " END"
    variable = urls.VARIABLE
    sql = rf"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{urls.UPPER}', '{urls.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT *, {rule} AS rule, {action} AS act FROM parts),
segs AS (SELECT *, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '{variable}') THEN regexp_replace(s, '{variable}', '{{v}}\3') ELSE s END) AS segs FROM ruled),
paths AS (SELECT host, segs, count(*) AS n, count(*) FILTER (act = 'block') AS b FROM segs GROUP BY ALL),
l0 AS (SELECT p.host, segs, segs AS rest, p.host AS branch, q.purity, n, b FROM paths p JOIN (SELECT host, (sum(b) + 4.0 * 0.02) / (sum(n) + 4.0) AS purity FROM paths GROUP BY host) q USING (host))
"""
    for k in range(levels):
        sql += f""", e{k} AS (SELECT branch, sum(b) = 0 OR sum(b) = sum(n) OR min(rest) = max(rest) AS leaf, min(rest) AS lo, max(rest) AS hi FROM l{k} GROUP BY branch),
c{k} AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(lo), len(hi)) + 1), lambda i: lo[i] <> hi[i])) - 1, least(len(lo), len(hi))) AS same FROM e{k}),
r{k} AS (SELECT l.*, leaf, lo, hi, same, array_to_string(list_concat([branch], lo[1:same]), '/') AS name FROM l{k} l JOIN c{k} USING (branch)),
f{k} AS (SELECT host, segs, rest[same + 1:] AS rest, name AS branch, purity, n, b, coalesce(rest[same + 1], '') AS s FROM r{k} WHERE NOT leaf),
w{k} AS (SELECT f.*, CASE WHEN kids > 16 AND s <> '' THEN '*' ELSE s END AS g FROM f{k} f JOIN (SELECT branch, count(DISTINCT s) AS kids FROM f{k} GROUP BY branch) USING (branch)),
k{k} AS (SELECT branch, g, sum(n)::BIGINT AS n, sum(b)::BIGINT AS b, first(purity) AS up FROM w{k} GROUP BY branch, g),
p{k} AS (SELECT *, lag(n) OVER o AS n0, lag(b) OVER o AS b0 FROM k{k} WINDOW o AS (PARTITION BY branch ORDER BY b / n, g)),
z{k} AS (SELECT *, CASE WHEN coalesce(((b * n0 - b0 * n)::DOUBLE * (b * n0 - b0 * n)::DOUBLE * (n + n0)) / nullif((n * n0)::DOUBLE * ((b + b0) * (n + n0 - b - b0)), 0), 0) < 3.84 AND b / n - b0 / n0 <= 0.2 THEN 0 ELSE 1 END AS new FROM p{k}),
g{k} AS (SELECT *, sum(new) OVER (PARTITION BY branch ORDER BY b / n, g) AS grp FROM z{k}),
m{k} AS (SELECT branch, g, (sum(b) OVER q + 4.0 * up) / (sum(n) OVER q + 4.0) AS purity, branch || '/' || CASE WHEN count(*) OVER q > 1 THEN '{{' || min(g) OVER q || '|..}}' ELSE min(g) OVER q END AS next FROM g{k} WINDOW q AS (PARTITION BY branch, grp)),
l{k + 1} AS (SELECT w.host, w.segs, w.rest[2:] AS rest, m.next AS branch, m.purity, w.n, w.b FROM w{k} w JOIN m{k} m ON m.branch = w.branch AND m.g = w.g)
"""
    leaves = " UNION ALL ".join(f"SELECT host, segs, CASE WHEN lo = hi THEN name ELSE name || '/**' END AS template, purity FROM r{k} WHERE leaf" for k in range(levels))
    return sql + f""", leaves AS ({leaves})
SELECT page_id, r.host, path, rule, coalesce(act, CASE WHEN purity >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict, template, round(purity, 9)::DOUBLE AS purity
FROM segs r JOIN leaves USING (host, segs)"""


def _filled(table: str, name: str, want: str, most: str, room: str, by: str) -> str:
    """``filled``: ``want`` times one factor per group, so that least(it, ``most``) sums to ``room``, as in ``mixing``."""
    here = f"(PARTITION BY {by} ORDER BY need DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f""", {name}_n AS (SELECT *, coalesce({want} / nullif({most}, 0), 0) AS need FROM {table}),
{name}_o AS (SELECT *, {room} - coalesce(sum({most}) OVER {here}, 0) AS free, sum({want}) OVER (PARTITION BY {by}) - coalesce(sum({want}) OVER {here}, 0) AS rest FROM {name}_n),
{name}_c AS (SELECT *, CASE WHEN rest > 1e-15 THEN greatest(free, 0) / rest END AS c FROM {name}_o),
{name}_f AS (SELECT *, CASE WHEN {room} < sum({most}) OVER (PARTITION BY {by}) * (1 - 1e-9) THEN max(CASE WHEN c * need <= 1 AND free >= 0 THEN c END) OVER (PARTITION BY {by}) END AS factor FROM {name}_c),
{name} AS (SELECT * EXCLUDE (need, free, rest, c, factor), CASE WHEN {want} > 0 THEN CASE WHEN factor IS NOT NULL THEN factor * {want} ELSE greatest({want}, {most}) END ELSE 0 END AS filled FROM {name}_f)"""


def op10(temperature: float = 0.7, rounds: int = 8, keep: float = 0.8) -> str:
    axes = mixing.AXES
    sql = r"""
WITH words AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda w: w <> ''))::BIGINT AS w, ('0x' || left(md5('mix:' || coalesce(doc_id::VARCHAR, text, '')), 8))::BIGINT / 4294967296.0 AS u FROM documents),
rows AS (SELECT doc_id, source, lang, CASE WHEN contains(t, ' | ') THEN 'list' WHEN w < 100 THEN 'short' WHEN w < 400 THEN 'medium' ELSE 'long' END AS topic, greatest(w, 1) AS n_tokens, u FROM words),
cells AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM rows GROUP BY ALL),
k0 AS (SELECT *, tokens::DOUBLE / sum(tokens) OVER () AS weight"""
    for a in axes:
        sql += f", pow(sum(tokens) OVER (PARTITION BY {a})::DOUBLE / sum(tokens) OVER (), {temperature}) AS p_{a}, row_number() OVER (PARTITION BY {a} ORDER BY source, lang, topic) AS i_{a}"
    sql += " FROM cells), j0 AS (SELECT source, lang, topic, tokens, weight" + "".join(f", p_{a} / sum(CASE WHEN i_{a} = 1 THEN p_{a} ELSE 0 END) OVER () AS p_{a}" for a in axes) + " FROM k0)"
    last = "j0"
    for r in range(rounds):
        for a in axes:
            name = f"r{r}_{a}"
            sql += f", {name} AS (SELECT * REPLACE (CASE WHEN sum(weight) OVER (PARTITION BY {a}) > 0 THEN weight * p_{a} / sum(weight) OVER (PARTITION BY {a}) ELSE 0 END AS weight) FROM {last})"
            last = name
    sql += f", within AS (SELECT *, CASE WHEN weight > 0 THEN tokens / (sum(tokens) OVER () * {keep}) ELSE 0 END AS most, 1.0::DOUBLE AS one FROM {last})"
    last = "within"
    for a in axes:
        first = f"row_number() OVER (PARTITION BY {a} ORDER BY source, lang, topic) = 1"
        sql += f", v_{a} AS (SELECT *, CASE WHEN {first} THEN sum(weight) OVER (PARTITION BY {a}) ELSE 0 END AS w, CASE WHEN {first} THEN sum(most) OVER (PARTITION BY {a}) ELSE 0 END AS m FROM {last})"
        sql += _filled(f"v_{a}", f"t_{a}", "w", "m", "one", "1")
        sql += f", x_{a} AS (SELECT * EXCLUDE (w, m, filled), max(least(filled, m)) OVER (PARTITION BY {a}) AS room_{a} FROM t_{a})"
        last = f"x_{a}"
    for r in range(rounds):
        for a in axes:
            sql += _filled(last, f"f{r}_{a}", "weight", "most", f"room_{a}", a)
            sql += f", y{r}_{a} AS (SELECT * EXCLUDE (weight, filled), filled AS weight FROM f{r}_{a})"
            last = f"y{r}_{a}"
    sql += f", capped AS (SELECT source, lang, topic, tokens, least(weight, most) AS weight FROM {last})"
    return sql + f""", need AS (SELECT *, weight / tokens AS need FROM capped),
c AS (SELECT *, ({keep} * sum(tokens) OVER () - coalesce(sum(tokens) OVER w, 0)) / nullif(greatest(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0), 1e-12), 1e-12) AS c FROM need WINDOW w AS (ORDER BY need DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT source, lang, topic, least(1.0, coalesce(max(CASE WHEN c * need <= 1 AND c >= 0 THEN c END) OVER (), 1e300) * need) AS probability FROM c)
SELECT doc_id, source, lang, topic, n_tokens, round(probability, 9)::DOUBLE AS probability, round(1 / probability, 9)::DOUBLE AS weight FROM rows JOIN p USING (source, lang, topic) WHERE u < p.probability"""


ORACLES: dict[str, str] = {"op2_chat_formatting": OP2, "op4_ngram_jaccard": OP4, "op7_url_filter": op7(), "op10_source_mixing": op10()}
