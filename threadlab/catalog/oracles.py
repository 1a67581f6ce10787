"""The same results in plain SQL over the given tables."""

from __future__ import annotations

from threadlab.functions.text import WHITESPACE

ORACLES: dict[str, str] = {}

# Fixed values, written out here so that a wrong constant of the library shows as a difference.
CLASSES = ("belief", "fact-check", "other")
MISINFORMS, CORRECTS, NEUTRAL = COARSE_LABELS = (
    "spreads misinformation", "corrects misinformation", "provides neutral or unrelated commentary",
)
LABEL_MAP = {
    **dict.fromkeys((MISINFORMS, "outrage", "endorse", "disbelief", "insistence", "criminal"), "belief"),
    **dict.fromkeys((CORRECTS, "fact-check", "skepticism", "clarification", "photoshop"), "fact-check"),
    **dict.fromkeys((NEUTRAL, "off-topic", "meta"), "other"),
}
TERMS = {
    MISINFORMS: "trash idiot clown scum worthless moron pathetic loser stupid disgusting".split(),
    CORRECTS: "thaner oninth atthen ndthble".split(),
}
PRIORS = {NEUTRAL: 0.5}
# Per topic: the candidate labels, and the term that stands for each.
FINE = {
    "en": {"outrage": "the", "endorse": "and", "skepticism": "that", "fact-check": "her",
           "off-topic": "ing", "meta": "not"},
    "de": {"disbelief": "der", "insistence": "und", "clarification": "die", "skepticism": "ein",
           "political": "ich", "meta": "nicht"},
    "fr": {"criminal": "les", "insistence": "que", "clarification": "est", "photoshop": "dans",
           "political": "une", "meta": "pas"},
    "es": {"outrage": "los", "endorse": "que", "skepticism": "del", "fact-check": "una",
           "off-topic": "con", "meta": "por"},
}


def _list(items) -> str:
    return ", ".join("'" + x + "'" for x in items)


def _mapped(column: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABEL_MAP.items())
    return f"CASE {column} {cases} ELSE {column} END"


# ---- views -----------------------------------------------------------------------------------

COMMENTS = """
c0 AS (SELECT *, event_id // 50 AS n, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
       FROM events),
v_comments AS (
  SELECT 'p' || (event_id % 50) AS post_id, 'c' || event_id AS id,
         CASE WHEN event_type = 'error' THEN NULL ELSE 'u' || user_id END AS author,
         event_type || ' ' || props AS body, CAST(floor(value) AS BIGINT) AS score,
         CASE WHEN n = 0 OR k < 10 THEN 't3_p' || (event_id % 50)
              ELSE 't1_c' || ((n * k // 100) * 50 + event_id % 50) END AS parent_fullname,
         date_trunc('second', ts) AS created, n AS seq
  FROM c0),
v_rows AS (
  SELECT *, regexp_extract(parent_fullname, '_(.*)$', 1) AS parent_id,
         parent_fullname LIKE 't1%' AS is_reply,
         strftime(created, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS created_utc
  FROM v_comments),
v_posts AS (
  SELECT post_id, max(score) AS score, count(*) AS num_comments, min(created_utc) AS created_utc,
         's' || (CAST(substr(post_id, 2) AS INT) % 7) AS subreddit,
         CASE WHEN CAST(substr(post_id, 2) AS INT) % 2 = 1 THEN 1 END AS old
  FROM v_rows GROUP BY post_id),
v_done AS (
  SELECT DISTINCT post_id FROM v_rows
  WHERE seq = 0 AND (body LIKE 'view %' OR body LIKE 'purchase %')),
v_edges AS (
  SELECT c.post_id, c.author AS source, p.author AS target, c.id AS comment_id
  FROM v_rows c JOIN v_rows p ON p.post_id = c.post_id AND p.id = c.parent_id
  WHERE c.is_reply AND c.author IS NOT NULL AND p.author IS NOT NULL AND p.author <> '')
"""

TREE = COMMENTS + """,
tree AS (
  SELECT post_id, id, 0 AS depth, [seq] AS path FROM v_rows WHERE NOT is_reply
  UNION ALL
  SELECT c.post_id, c.id, t.depth + 1, list_append(t.path, c.seq)
  FROM v_rows c JOIN tree t ON t.post_id = c.post_id AND t.id = c.parent_id WHERE c.is_reply),
placed AS (
  SELECT post_id, id, depth, path,
         row_number() OVER (PARTITION BY post_id ORDER BY depth, path) - 1 AS bfs_pos
  FROM tree)
"""

STATS = """
v_stats AS (
  SELECT post_id, count(DISTINCT person) AS nodes, max(edges) AS edges
  FROM (SELECT post_id, unnest([source, target]) AS person,
               count(DISTINCT source || '>' || target) OVER (PARTITION BY post_id) AS edges
        FROM v_edges)
  GROUP BY post_id)
"""

GOLD = """
v_gold AS (
  SELECT d.doc_id AS id, d.text AS comment, d.lang AS topic,
         CASE WHEN l.toxic = 1 THEN 'belief' WHEN l.quality = 0 THEN 'fact-check' ELSE 'other' END
           AS label
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id)
"""

DIRTY = GOLD + """,
v_dirty AS (
  SELECT id,
         CASE id % 10 WHEN 0 THEN NULL WHEN 1 THEN '[Removed]' WHEN 2 THEN '[deleted]'
              WHEN 3 THEN 'two words' WHEN 6 THEN replace(comment, ' ', chr(160)) ELSE comment END
           AS comment,
         CASE id % 10 WHEN 4 THEN ' EN' || chr(9) ELSE topic END AS topic,
         CASE id % 10 WHEN 4 THEN ' Fact_Check ' WHEN 5 THEN 'fact check' WHEN 7 THEN NULL
              ELSE label END AS label
  FROM v_gold)
"""

PRED = f"""
p0 AS (
  SELECT event_id AS id, 't' || (user_id % 4) AS topic,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, value AS max_logit,
         CASE event_type WHEN 'click' THEN 'spreads misinformation' WHEN 'view' THEN 'photoshop'
              WHEN 'purchase' THEN 'meta' WHEN 'signup' THEN 'political' WHEN 'error' THEN 'off-topic'
         END AS pred_raw,
         CAST(event_id % 5 + 1 AS INT) AS fold, 'm' || (event_id % 2) AS model_key
  FROM events),
v_pred AS (
  SELECT *, CASE WHEN k < 30 THEN 'belief' WHEN k < 60 THEN 'fact-check' ELSE 'other' END AS gold,
         {_mapped("pred_raw")} AS pred
  FROM p0)
"""

SCORES = f"""
v_scores AS (
  SELECT event_id AS id, l.pos, l.label, ((event_id * (l.pos + 3) * 7919) % 10) / 10.0 AS score
  FROM events, (VALUES {", ".join(f"({i}, '{c}')" for i, c in enumerate(CLASSES))}) l(pos, label))
"""

HISTORY = """
v_history AS (
  SELECT event_id // 10 AS run, CAST(event_id % 10 + 1 AS INT) AS epoch,
         CASE WHEN event_type <> 'signup' THEN value END AS loss,
         floor(value / 5.0) / 100.0 AS eval_metric
  FROM events)
"""

EXPERIMENTS = GOLD + """,
v_exp AS (
  SELECT 'ul_all_topics' AS experiment_name, id, topic, label FROM v_gold
  UNION ALL
  SELECT 'ul_' || topic, id, topic, label FROM v_gold)
"""


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WHITESPACE}]+|[{WHITESPACE}]+$', '', 'g')"


def _label(x: str) -> str:
    return f"replace(replace(lower({_strip(x)}), 'fact_check', 'fact-check'), 'fact check', 'fact-check')"


def _words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[^{WHITESPACE}]+'))"


def _valid(x: str, least: int = 3) -> str:
    return (
        f"(coalesce({x}, '') <> '' AND lower(coalesce({x}, '')) NOT IN ('[removed]', '[deleted]')"
        f" AND {_words(f'coalesce({x}, {chr(39)*2})')} >= {least})"
    )


# ---- threads ---------------------------------------------------------------------------------

_URL = "^https?://([^/?#]+)/([^/?#]+)/([^/?#]+)"
ORACLES["resolve_links"] = f"""
SELECT page_id, nullif(regexp_extract(url, '{_URL}', 1), '') AS host,
       nullif(regexp_extract(url, '{_URL}', 2), '') AS part_1,
       nullif(regexp_extract(url, '{_URL}', 3), '') AS part_2
FROM pages"""

ORACLES["pending_posts"] = f"""
WITH {COMMENTS} SELECT post_id, subreddit, num_comments FROM v_posts
WHERE post_id NOT IN (SELECT post_id FROM v_done)"""

ORACLES["comment_timestamps"] = f"WITH {COMMENTS} SELECT post_id, id, created_utc FROM v_rows"

ORACLES["comment_rows"] = f"""
WITH {COMMENTS} SELECT id, parent_id, NOT is_reply AS is_top_level, coalesce(author, 'None') AS author
FROM v_rows"""

ORACLES["reply_edges"] = f"WITH {COMMENTS} SELECT post_id, source, target, comment_id FROM v_edges"

ORACLES["distinct_edges"] = f"""
WITH RECURSIVE {TREE}
SELECT e.post_id, e.source, e.target, arg_max(e.comment_id, p.bfs_pos) AS comment_id,
       count(*) AS n_replies
FROM v_edges e JOIN placed p ON p.post_id = e.post_id AND p.id = e.comment_id
GROUP BY e.post_id, e.source, e.target"""

ORACLES["reply_network_stats"] = f"WITH {COMMENTS}, {STATS} SELECT post_id, nodes, edges FROM v_stats"



def _layout_round(r: int, rounds: int) -> str:
    """Positions p{r + 1} from p{r}: pushes of the cells around, pulls of the edges, a step."""
    cell = "(x - ((x % side) + side) % side) // side"
    apart = "sqrt(dx * dx + dy * dy)"
    whole = "CAST(floor({} * 1073741824.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)".format
    return f"""
k{r} AS MATERIALIZED (SELECT *, {cell} AS cx, {cell.replace("x", "y")} AS cy FROM p{r}),
g{r} AS (SELECT post_id, cx, cy, count(*) AS m, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(y) AS BIGINT) AS sy FROM k{r} GROUP BY ALL),
near{r} AS (
  SELECT k.post_id, k.node, k.n, g.m - o.own AS m,
    (k.x - CAST(g.sx - o.own * k.x AS DOUBLE) / (g.m - o.own)) / 1073741824.0::DOUBLE AS dx,
    (k.y - CAST(g.sy - o.own * k.y AS DOUBLE) / (g.m - o.own)) / 1073741824.0::DOUBLE AS dy
  FROM k{r} k, (SELECT i, j, CASE WHEN i = 0 AND j = 0 THEN 1 ELSE 0 END AS own
                FROM (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j)) o, g{r} g
  WHERE g.post_id = k.post_id AND g.cx = k.cx + o.i AND g.cy = k.cy + o.j AND g.m > o.own),
pushed{r} AS (
  SELECT post_id, node, dx, dy, CAST(m AS DOUBLE) * (1.0::DOUBLE / sqrt(CAST(n AS DOUBLE))) * (1.0::DOUBLE / sqrt(CAST(n AS DOUBLE))) AS push,
    greatest({apart}, 0.01::DOUBLE) AS d FROM near{r}),
met{r} AS (
  SELECT e.post_id, e.a, e.b, dx, dy, greatest({apart}, 0.01::DOUBLE) / (1.0::DOUBLE / sqrt(CAST(n AS DOUBLE))) AS pull FROM (
    SELECT e.post_id, e.a, e.b, p.n, CAST(p.x - q.x AS DOUBLE) / 1073741824.0::DOUBLE AS dx,
      CAST(p.y - q.y AS DOUBLE) / 1073741824.0::DOUBLE AS dy
    FROM pairs e JOIN p{r} p ON p.post_id = e.post_id AND p.node = e.a JOIN p{r} q ON q.post_id = e.post_id AND q.node = e.b) e),
f{r} AS (
  SELECT post_id, node, CAST(sum(fx) AS DOUBLE) / 1073741824.0::DOUBLE AS px, CAST(sum(fy) AS DOUBLE) / 1073741824.0::DOUBLE AS py FROM (
    SELECT post_id, node, {whole("dx * push / (d * d)")} AS fx, {whole("dy * push / (d * d)")} AS fy FROM pushed{r}
    UNION ALL SELECT post_id, a, {whole("dx * pull * -1.0::DOUBLE")}, {whole("dy * pull * -1.0::DOUBLE")} FROM met{r}
    UNION ALL SELECT post_id, b, {whole("dx * pull * 1.0::DOUBLE")}, {whole("dy * pull * 1.0::DOUBLE")} FROM met{r}) GROUP BY ALL),
s{r} AS (
  SELECT p.*, coalesce(px, 0.0::DOUBLE) AS px, coalesce(py, 0.0::DOUBLE) AS py
  FROM p{r} p LEFT JOIN f{r} f ON f.post_id = p.post_id AND f.node = p.node),
t{r} AS (
  SELECT *, {0.1 * (1 - r / (rounds + 1))!r}::DOUBLE
    / CASE WHEN sqrt(px * px + py * py) < 0.01::DOUBLE THEN 0.1::DOUBLE ELSE sqrt(px * px + py * py) END AS share FROM s{r}),
p{r + 1} AS MATERIALIZED (
  SELECT post_id, node, x + {whole("px * share")} AS x, y + {whole("py * share")} AS y, n, side FROM t{r})"""


ORACLES["network_layout"] = f"""
WITH {COMMENTS},
pairs AS MATERIALIZED (
  SELECT DISTINCT post_id, least(source, target) AS a, greatest(source, target) AS b FROM v_edges WHERE source <> target),
nodes AS (SELECT post_id, source AS node FROM v_edges UNION SELECT post_id, target FROM v_edges),
sized AS (SELECT *, count(*) OVER (PARTITION BY post_id) AS n FROM nodes),
p0 AS MATERIALIZED (
  SELECT post_id, node, CAST('0x' || substr(md5('42:' || post_id || ':' || node || ':x'), 1, 8) AS BIGINT) >> 2 AS x,
    CAST('0x' || substr(md5('42:' || post_id || ':' || node || ':y'), 1, 8) AS BIGINT) >> 2 AS y, n,
    CAST(floor(2147483648.0::DOUBLE / sqrt(CAST(n AS DOUBLE))) AS BIGINT) AS side
  FROM sized),{",".join(_layout_round(r, 4) for r in range(4))},
centre AS (
  SELECT post_id, CAST(sum(x) AS DOUBLE) / count(*) AS mx, CAST(sum(y) AS DOUBLE) / count(*) AS my,
    min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p4 GROUP BY post_id),
edge AS (SELECT *, greatest(x1 - mx, mx - x0, y1 - my, my - y0) AS far FROM centre)
SELECT p.post_id, p.node, round(CASE WHEN far > 0 THEN (x - mx) / far ELSE 0.0 END, 6) AS x,
  round(CASE WHEN far > 0 THEN (y - my) / far ELSE 0.0 END, 6) AS y
FROM p4 p JOIN edge e ON e.post_id = p.post_id"""

_UPSERT = f"""
WITH {COMMENTS}, {STATS}
SELECT p.post_id, <extra>,
       CASE WHEN d.post_id IS NULL THEN coalesce(s.nodes, p.old) ELSE p.old END AS nodes,
       CASE WHEN d.post_id IS NULL THEN coalesce(s.edges, p.old) ELSE p.old END AS edges
FROM v_posts p LEFT JOIN v_done d ON d.post_id = p.post_id LEFT JOIN v_stats s ON s.post_id = p.post_id"""
ORACLES["upsert_post_stats"] = _UPSERT.replace("<extra>", "p.subreddit, CAST(0.5 AS DOUBLE) AS time")
ORACLES["process_pending_threads"] = _UPSERT.replace("<extra>", "p.num_comments").replace(
    ", p.old)", ", 0)"
)

ORACLES["comment_depth"] = f"WITH RECURSIVE {TREE} SELECT post_id, id, depth FROM tree"

ORACLES["bfs_order"] = f"WITH RECURSIVE {TREE} SELECT post_id, id, depth, bfs_pos FROM placed"

ORACLES["orphan_comments"] = f"""
WITH RECURSIVE {TREE.replace("FROM v_rows", "FROM v_named").replace(
    "," + chr(10) + "v_posts AS", "," + chr(10)
    + "v_named AS (SELECT * FROM v_rows WHERE author IS NOT NULL)," + chr(10) + "v_posts AS")}
SELECT post_id, id FROM v_named n
WHERE NOT EXISTS (SELECT 1 FROM tree t WHERE t.post_id = n.post_id AND t.id = n.id)"""

ORACLES["thread_documents"] = f"""
WITH RECURSIVE {TREE},
e AS (SELECT post_id, count(*) AS n_edges FROM v_edges GROUP BY post_id)
SELECT p.post_id, v.num_comments, v.created_utc, count(*) AS n_comments,
       coalesce(max(e.n_edges), 0) AS n_edges,
       arg_min(p.id, p.bfs_pos) AS first_id, arg_max(p.id, p.bfs_pos) AS last_id
FROM placed p JOIN v_posts v ON v.post_id = p.post_id LEFT JOIN e ON e.post_id = p.post_id
GROUP BY p.post_id, v.num_comments, v.created_utc"""

ORACLES["flatten_threads"] = f"""
WITH RECURSIVE {TREE}
SELECT r.post_id, r.id, coalesce(r.author, 'None') AS author, r.body, r.score, r.parent_id, t.depth,
       r.created_utc
FROM v_rows r JOIN tree t ON t.post_id = r.post_id AND t.id = r.id"""

ORACLES["thread_files"] = ORACLES["flatten_threads"]

ORACLES["incremental_ingest"] = ORACLES["reply_edges"]

# ---- gold standard and labels ----------------------------------------------------------------

ORACLES["scan_posts"] = """
SELECT 'web' AS topic, url AS link, 'g' || page_id AS post_id, 's' AS subreddit,
       'a "quoted", title ' || page_id AS title,
       CASE WHEN page_id % 3 = 0 THEN 53000 ELSE length(html) END AS upvotes,
       CASE WHEN page_id % 3 = 0 THEN NULL ELSE page_id END AS comments,
       CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'one, two' END AS cites,
       CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'kept ' END AS notes,
       CAST(NULL AS BIGINT) AS nodes, 7 AS edges, round(page_id / CAST(7 AS DOUBLE), 3) AS time
FROM pages"""

ORACLES["scan_gold"] = f"""
WITH {DIRTY} SELECT CAST(id AS VARCHAR) AS id, md5(comment) AS comment_md5, topic, label FROM v_dirty"""

ORACLES["filled_posts"] = f"""
WITH l AS (
  SELECT page_id, nullif(regexp_extract(url, '{_URL}', 1), '') AS part_0,
         nullif(regexp_extract(url, '{_URL}', 2), '') AS part_1,
         nullif(regexp_extract(url, '{_URL}', 3), '') AS part_2,
         CASE WHEN page_id % 2 = 1 THEN 'g' || page_id END AS given_id,
         nullif(CASE page_id % 3 WHEN 1 THEN regexp_extract(url, '^https?://([^/?#]+)', 1)
                                 WHEN 2 THEN 'elsewhere' END, '') AS given_place
  FROM pages)
SELECT page_id, coalesce(given_id, part_1) AS post_id, coalesce(given_place, part_0) AS subreddit,
       part_2 AS title,
       coalesce(given_id = part_1, true) AND coalesce(given_place = part_0, true) AS link_ok
FROM l"""

ORACLES["prepare_gold"] = f"""
WITH {DIRTY}
SELECT id, md5(comment) AS comment_md5, lower({_strip("topic")}) AS topic, {_label("label")} AS label
FROM v_dirty
WHERE comment IS NOT NULL AND topic IS NOT NULL AND label IS NOT NULL
  AND lower({_strip("topic")}) IN ('de', 'en', 'es')"""

ORACLES["topic_filter"] = f"""
WITH {DIRTY} SELECT id, topic, lower(label) AS label FROM v_dirty WHERE topic = 'en'"""

ORACLES["normalize_labels"] = f"""
WITH {DIRTY} SELECT id, {_label("label")} AS label, lower({_strip("topic")}) AS topic FROM v_dirty"""

ORACLES["valid_comments"] = f"""
WITH {DIRTY}
SELECT id, {_valid("comment")} AS valid, {_valid("comment", 1)} AS valid_1, {_words("comment")} AS words
FROM v_dirty"""

ORACLES["label_map_scan"] = f"""
WITH {PRED}, m(label, mapped) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in LABEL_MAP.items())})
SELECT m.label, m.mapped, count(p.id) AS n FROM m LEFT JOIN v_pred p ON p.pred_raw = m.label
GROUP BY m.label, m.mapped"""

ORACLES["map_labels"] = f"WITH {PRED} SELECT id, pred_raw, pred FROM v_pred"

ORACLES["encode_labels"] = f"""
WITH {EXPERIMENTS}
SELECT experiment_name, id, label,
       dense_rank() OVER (PARTITION BY experiment_name ORDER BY label) - 1 AS label_id
FROM v_exp"""

# ---- scoring ---------------------------------------------------------------------------------


def _hits(label: str) -> str:
    words, prior = _list(TERMS.get(label, ())), PRIORS.get(label, 0.0)
    if not words:
        return f"CAST({prior} AS DOUBLE)"
    return f"CAST(len(list_filter(toks, lambda t: t IN ({words}))) AS DOUBLE) + {prior}"


def _zero_shot(source: str, scores: list[str], columns: str, names=COARSE_LABELS) -> str:
    """Labelled rows from per-label score expressions over ``toks`` or ``comment``."""
    named = ", ".join(f"{s} AS s{i}" for i, s in enumerate(scores))
    every = ", ".join(f"s{i}" for i in range(len(scores)))
    top = f"greatest({every})"
    cases = " ".join(f"WHEN s{i} = {top} THEN '{x}'" for i, x in enumerate(names))
    total = " + ".join(f"exp(s{i} - {top})" for i in range(len(scores)))
    return f"""
t0 AS (SELECT *, {_valid("comment")} AS valid,
              regexp_extract_all(lower(coalesce(comment, '')), '[a-z]{{3,}}') AS toks FROM {source}),
t1 AS (SELECT *, {named} FROM t0),
t2 AS (SELECT id, topic, lower(label) AS assigned_label,
              CASE WHEN valid THEN CASE {cases} END ELSE 'other' END AS pred_label,
              CASE WHEN valid THEN 1.0 / ({total}) ELSE 1.0 END AS raw_score
       FROM t1),
labelled AS (SELECT id, topic, assigned_label, pred_label, {_mapped("pred_label")} AS pred_label_mapped,
                    round(raw_score, 6) AS pred_score FROM t2)
{columns}"""


_LEXICON = [_hits(x) for x in COARSE_LABELS]
_STUB = [
    f"CAST(length(coalesce(comment, '')) - length(replace(coalesce(comment, ''), '{c}', '')) AS DOUBLE)"
    for c in "eao"
]
ORACLES["zero_shot_lexicon"] = f"WITH {DIRTY}, " + _zero_shot("v_dirty", _LEXICON, "SELECT * FROM labelled")
ORACLES["zero_shot_model"] = f"WITH {DIRTY}, " + _zero_shot("v_dirty", _STUB, "SELECT * FROM labelled")

def _fine(topic: str) -> str:
    names = list(FINE[topic])
    scores = [
        f"CAST(len(list_filter(toks, lambda t: t = '{term}')) AS DOUBLE) + {0.5 if i == len(names) - 1 else 0.0}"
        for i, term in enumerate(FINE[topic].values())
    ]
    source = f"(SELECT * FROM v_gold WHERE topic = '{topic}')"
    return "SELECT * FROM (WITH " + _zero_shot(source, scores, "SELECT * FROM labelled", names) + ")"


ORACLES["zero_shot_pairs"] = ORACLES["zero_shot_model"]
ORACLES["zero_shot_topics"] = f"WITH {GOLD} " + " UNION ALL ".join(_fine(t) for t in FINE)

ORACLES["label_prototypes"] = """
WITH e AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding) AS x
           FROM embeddings)
SELECT label, count(*) AS n, pos, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM e GROUP BY label, pos"""

ORACLES["zero_shot_prototype"] = """
WITH e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS pos,
                  CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
p AS (SELECT label AS candidate, pos, avg(x) AS m FROM e GROUP BY label, pos),
c AS (SELECT e.vec_id, e.label, p.candidate,
             sum(e.x * p.m) / (sqrt(sum(e.x * e.x)) * sqrt(sum(p.m * p.m))) AS cosine
      FROM e JOIN p ON p.pos = e.pos GROUP BY e.vec_id, e.label, p.candidate)
SELECT vec_id, label, arg_max(candidate, cosine) AS pred_label, round(max(cosine), 6) AS cosine
FROM c GROUP BY vec_id, label"""

ORACLES["label_ranking"] = f"""
WITH {SCORES}
SELECT id, pos, label, CAST(score AS DOUBLE) AS score,
       row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) AS rank
FROM v_scores"""

ORACLES["argmax_label"] = f"""
WITH {SCORES}
SELECT id, label AS pred_label, CAST(score AS DOUBLE) AS pred_score
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) AS r FROM v_scores)
WHERE r = 1"""

# ---- metrics ---------------------------------------------------------------------------------


def _per_class(source: str, gold: str, pred: str, keys: list[str], gold_only: bool, name: str = "m") -> str:
    """Class rows (keys, label, tp, pred_n, support, total, precision, recall, f1) as ``name``."""
    k = ", ".join(keys)
    keep = "WHERE support > 0" if gold_only else ""
    return f"""
{name}0 AS (
  SELECT {k}, label, sum(s) AS support, sum(q) AS pred_n, sum(h) AS tp
  FROM (SELECT {k}, {gold} AS label, 1 AS s, 0 AS q, CASE WHEN {gold} = {pred} THEN 1 ELSE 0 END AS h
        FROM {source}
        UNION ALL SELECT {k}, {pred}, 0, 1, 0 FROM {source})
  GROUP BY {k}, label),
{name}1 AS (SELECT *, sum(support) OVER (PARTITION BY {k}) AS total,
                   sum(tp) OVER (PARTITION BY {k}) AS correct,
                   CASE WHEN pred_n > 0 THEN tp / CAST(pred_n AS DOUBLE) ELSE 0 END AS precision,
                   CASE WHEN support > 0 THEN tp / CAST(support AS DOUBLE) ELSE 0 END AS recall
            FROM {name}0),
{name} AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                          ELSE 0 END AS f1 FROM {name}1 {keep})"""


_CLASS_COLUMNS = ("topic, label, round(precision, 6) AS precision, round(recall, 6) AS recall, "
                  "round(f1, 6) AS f1, CAST(support AS BIGINT) AS support")

ORACLES["zero_shot_evaluation"] = f"WITH {GOLD}, " + _zero_shot(
    "v_gold", _LEXICON,
    "," + _per_class("labelled", "assigned_label", "pred_label_mapped", ["topic"], True)
    + f"SELECT {_CLASS_COLUMNS} FROM m",
)

ORACLES["labelled_results"] = f"WITH {GOLD}, " + _zero_shot("v_gold", _LEXICON, "SELECT * FROM labelled")
ORACLES["evaluation_outputs"] = f"WITH {GOLD}, " + _zero_shot(
    "v_gold", _LEXICON,
    "," + _per_class("labelled", "assigned_label", "pred_label_mapped", ["topic"], True)
    + ", hits AS (SELECT topic, round(avg(CASE WHEN assigned_label = pred_label_mapped THEN 1.0 ELSE 0.0 END), 6)"
    + f" AS accuracy FROM labelled GROUP BY topic) SELECT {_CLASS_COLUMNS}, accuracy FROM m JOIN hits USING (topic)",
)

ORACLES["accuracy"] = f"""
WITH {PRED}
SELECT topic, count(*) AS n, count(*) FILTER (WHERE gold = pred) AS correct,
       round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM v_pred GROUP BY topic"""


def _matrix(predicted: str) -> str:
    return f"""
g AS (SELECT DISTINCT topic, gold AS label FROM v_pred),
u AS (SELECT topic, label FROM g UNION SELECT topic, pred FROM v_pred),
grid AS (SELECT a.topic, a.label AS true_label, b.label AS pred_label
         FROM {predicted} a JOIN {predicted} b ON b.topic = a.topic),
cells AS (SELECT topic, gold, pred, count(*) AS n FROM v_pred GROUP BY ALL),
matrix AS (SELECT grid.topic, grid.true_label, grid.pred_label, coalesce(c.n, 0) AS n
           FROM grid LEFT JOIN cells c
             ON c.topic = grid.topic AND c.gold = grid.true_label AND c.pred = grid.pred_label)"""


ORACLES["confusion_matrix"] = f"WITH {PRED}, {_matrix('g')} SELECT * FROM matrix"
ORACLES["confusion_matrix_union"] = f"WITH {PRED}, {_matrix('u')} SELECT * FROM matrix"
ORACLES["confusion_matrix_wide"] = f"""
WITH {PRED}
SELECT topic, gold AS true_label, count(*) FILTER (WHERE pred = 'belief') AS belief,
       count(*) FILTER (WHERE pred = 'fact-check') AS fact_check,
       count(*) FILTER (WHERE pred = 'other') AS other
FROM v_pred GROUP BY topic, gold"""
ORACLES["confusion_matrix_normalized"] = f"""
WITH {PRED}, {_matrix('u')},
t AS (SELECT *, sum(n) OVER (PARTITION BY topic, true_label) AS total FROM matrix)
SELECT topic, true_label, pred_label,
       CASE WHEN total > 0 THEN round(n / CAST(total AS DOUBLE), 6) ELSE 0.0 END AS share FROM t"""

ORACLES["per_class_metrics"] = (
    f"WITH {PRED}, {_per_class('v_pred', 'gold', 'pred', ['topic'], True)} SELECT {_CLASS_COLUMNS} FROM m"
)

_UNION = _per_class("v_pred", "gold", "pred", ["topic"], False)
_MACRO = {m: f"avg({m})" for m in ("precision", "recall", "f1")}
_WEIGHTED = {m: f"sum({m} * support) / CAST(sum(support) AS DOUBLE)" for m in _MACRO}
_ACC = "CAST(max(correct) AS DOUBLE) / max(total)"

ORACLES["macro_weighted_averages"] = f"""
WITH {PRED}, {_UNION}
SELECT topic, {", ".join(f"round({x}, 6) AS macro_{m}" for m, x in _MACRO.items())},
       {", ".join(f"round({x}, 6) AS weighted_{m}" for m, x in _WEIGHTED.items())},
       round({_ACC}, 6) AS accuracy, CAST(sum(support) AS BIGINT) AS support
FROM m GROUP BY topic"""

ORACLES["classification_report"] = f"""
WITH {PRED}, {_UNION}
SELECT {_CLASS_COLUMNS} FROM m
UNION ALL SELECT topic, 'accuracy', NULL, NULL, round({_ACC}, 6), CAST(max(total) AS BIGINT) FROM m GROUP BY topic
UNION ALL SELECT topic, 'macro avg', {", ".join(f"round({x}, 6)" for x in _MACRO.values())},
       CAST(sum(support) AS BIGINT) FROM m GROUP BY topic
UNION ALL SELECT topic, 'weighted avg', {", ".join(f"round({x}, 6)" for x in _WEIGHTED.values())},
       CAST(sum(support) AS BIGINT) FROM m GROUP BY topic"""

_OVR = """
r AS (
  SELECT t.topic, c.class, count(*) FILTER (WHERE gold = c.class AND pred = c.class) AS tp,
         count(*) FILTER (WHERE gold <> c.class AND pred = c.class) AS fp,
         count(*) FILTER (WHERE gold <> c.class AND pred <> c.class) AS tn,
         count(*) FILTER (WHERE gold = c.class AND pred <> c.class) AS fn
  FROM v_pred t, (VALUES %s) c(class) GROUP BY t.topic, c.class)"""


def _safe(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a}) / CAST({b} AS DOUBLE) ELSE 0.0 END"


ORACLES["one_vs_rest_metrics"] = f"""
WITH {PRED}, {_OVR % ", ".join(f"('{c}')" for c in (*CLASSES, "never"))},
q AS (SELECT *, {_safe("tp + tn", "(tp + fp + tn + fn)")} AS a, {_safe("tp", "(tp + fp)")} AS p,
             {_safe("tp", "(tp + fn)")} AS rc, {_safe("tn", "(tn + fp)")} AS s FROM r)
SELECT topic, class, tp, fp, tn, fn, round(a, 6) AS accuracy, round(p, 6) AS precision,
       round(rc, 6) AS recall, round(s, 6) AS specificity,
       round({_safe("2 * p * rc", "(p + rc)")}, 6) AS f1
FROM q"""

ORACLES["binary_cells"] = f"""
WITH {PRED}, {_OVR % ", ".join(f"('{c}')" for c in CLASSES)}
SELECT topic, class, 'True Negative' AS metric, tn AS value FROM r
UNION ALL SELECT topic, class, 'False Positive', fp FROM r
UNION ALL SELECT topic, class, 'False Negative', fn FROM r
UNION ALL SELECT topic, class, 'True Positive', tp FROM r"""

ORACLES["error_analysis"] = f"""
WITH {PRED}, wrong AS (SELECT * FROM v_pred WHERE gold <> pred)
SELECT id, gold, pred, max_logit, (SELECT count(*) FROM wrong) AS n_errors
FROM wrong ORDER BY id LIMIT 50"""

ORACLES["cv_summary"] = f"""
WITH {PRED}, {_per_class("v_pred", "gold", "pred", ["topic", "model_key", "fold"], False)},
lines AS (
  {" UNION ALL ".join(
    f"SELECT topic, model_key, fold, replace(label, '-', '_') || '_{x}' AS metric, CAST({x} AS DOUBLE) AS value FROM m"
    for x in ("precision", "recall", "f1", "support"))}
  UNION ALL SELECT topic, model_key, fold, 'accuracy', {_ACC} FROM m GROUP BY topic, model_key, fold
  {" ".join(f"UNION ALL SELECT topic, model_key, fold, 'macro_{k}', {x} FROM m GROUP BY topic, model_key, fold"
            for k, x in _MACRO.items())}
  UNION ALL SELECT topic, model_key, fold, 'weighted_f1', {_WEIGHTED["f1"]} FROM m
    GROUP BY topic, model_key, fold)
SELECT topic, model_key, metric, round(avg(value), 6) AS mean,
       CASE WHEN count(*) = 1 THEN 0.0 ELSE round(stddev_samp(value), 6) END AS std
FROM lines GROUP BY topic, model_key, metric"""

# ---- splits ----------------------------------------------------------------------------------

ORACLES["class_counts"] = f"""
WITH {EXPERIMENTS} SELECT experiment_name, label, count(*) AS n FROM v_exp GROUP BY ALL"""
ORACLES["unstratifiable_classes"] = ORACLES["class_counts"] + " HAVING count(*) < 5"

_RAW_NAME = "'ul:' || lang || '/' || source || ' a-b' || chr(92) || 'c'"
ORACLES["experiment_names"] = f"""
SELECT doc_id, translate({_RAW_NAME}, '/' || chr(92) || ' :-', '_____') AS name,
       replace(source, '-', '_') AS class_key, translate({_RAW_NAME}, '/ ', '__') AS file_name
FROM documents"""

ORACLES["experiment_expansion"] = f"""
WITH {EXPERIMENTS} SELECT experiment_name, id, label FROM v_exp WHERE experiment_name <> 'ul_es'"""

_KEY = "md5('42:' || id)"
ORACLES["stratified_kfold"] = f"""
WITH {EXPERIMENTS}
SELECT experiment_name, id, label,
       CAST((row_number() OVER (PARTITION BY experiment_name ORDER BY label, {_KEY}, id) - 1) % 5 + 1
            AS INT) AS fold
FROM v_exp"""


def _quota(source: str, n: str, size: str, out: str, name: str, group: str = "") -> str:
    """``source`` (one row per class) with ``out`` rows kept on the train side, as ``name``."""
    by = f"PARTITION BY {group}" if group else ""
    return f"""
{name}0 AS (SELECT *, sum({n}) OVER ({by}) AS tot FROM {source}),
{name}1 AS (SELECT *, tot - CAST(ceil(CAST({size} AS DOUBLE) * tot) AS BIGINT) AS keep FROM {name}0),
{name}2 AS (SELECT *, CAST({n} * keep // tot AS BIGINT) AS fl, CAST({n} * keep % tot AS BIGINT) AS rest
            FROM {name}1),
{name}3 AS (SELECT *, row_number() OVER ({by} ORDER BY rest DESC, label) AS place,
                   keep - sum(fl) OVER ({by}) AS left_over FROM {name}2),
{name} AS (SELECT * EXCLUDE (tot, keep, fl, rest, place, left_over),
                  fl + CASE WHEN place <= left_over THEN 1 ELSE 0 END AS {out} FROM {name}3)"""


_CLASSES = "k AS (SELECT label, count(*) AS n FROM v_gold GROUP BY label)"
_RANKED = f"""
ranked AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {_KEY}, id) - 1 AS r
           FROM v_gold)"""

ORACLES["stratified_split"] = f"""
WITH {GOLD}, {_CLASSES}, {_quota("k", "n", "0.15", "quota", "q")}, {_RANKED}
SELECT ranked.id, ranked.label, CASE WHEN r < quota THEN 'train' ELSE 'test' END AS role
FROM ranked JOIN q ON q.label = ranked.label"""

ORACLES["train_val_test_split"] = f"""
WITH {GOLD}, {_CLASSES}, {_quota("k", "n", "0.3", "train_n", "q")},
h AS (SELECT *, n - train_n AS held FROM q), {_quota("h", "held", "0.5", "val_n", "w")}, {_RANKED}
SELECT ranked.id, ranked.label,
       CASE WHEN r < train_n THEN 'train' WHEN r < train_n + val_n THEN 'val' ELSE 'test' END AS role
FROM ranked JOIN w ON w.label = ranked.label"""

ORACLES["fold_roles"] = f"""
WITH {GOLD},
f AS (SELECT label, (row_number() OVER (ORDER BY label, {_KEY}, id) - 1) % 5 + 1 AS fold FROM v_gold),
runs AS (SELECT CAST(r.run AS INT) AS run, f.* FROM f, (VALUES (1), (2), (3), (4), (5)) r(run)),
k AS (SELECT run, label, count(*) FILTER (WHERE fold <> run) AS n,
             count(*) FILTER (WHERE fold = run) AS n_test FROM runs GROUP BY run, label),
{_quota("k", "n", "0.15", "quota", "q", "run")}
SELECT run, label, quota AS n_train, n - quota AS n_val, n_test FROM q"""

ORACLES["cv_outputs"] = f"""
WITH {EXPERIMENTS},
f AS (SELECT experiment_name AS e, label,
             (row_number() OVER (PARTITION BY experiment_name ORDER BY label, {_KEY}, id) - 1) % 5 + 1 AS fold
      FROM v_exp WHERE experiment_name IN (
        SELECT experiment_name FROM (SELECT experiment_name, label, count(*) AS n FROM v_exp GROUP BY ALL)
        GROUP BY experiment_name HAVING min(n) >= 5)),
runs AS (SELECT e || r.run AS run, e, CAST(r.run AS INT) AS n_run, label, fold
         FROM f, (VALUES (1), (2), (3), (4), (5)) r(run)),
k AS (SELECT run, e, n_run, label, count(*) FILTER (WHERE fold <> n_run) AS n,
             count(*) FILTER (WHERE fold = n_run) AS n_test FROM runs GROUP BY ALL),
{_quota("k", "n", "0.15", "quota", "q", "run")}
SELECT e AS experiment_name, m.model_key, n_run AS fold, sum(quota) AS n_train, sum(n - quota) AS n_val,
       sum(n_test) AS n_test,
       {", ".join(f"sum(n_test) FILTER (WHERE label = '{c}') AS {c.replace('-', '_')}_support" for c in CLASSES)}
FROM q, (VALUES ('softmax'), ('hidden')) m(model_key) GROUP BY e, m.model_key, n_run"""

ORACLES["training_log"] = """
SELECT event_type AS kind, count(*) AS n,
       count(*) FILTER (WHERE event_type <> 'error') AS n_lines,
       sum(CASE WHEN event_type <> 'error' THEN event_id END)::BIGINT AS ids,
       round(sum(CASE WHEN event_type IN ('click', 'view') THEN CAST(value AS DECIMAL(38, 4)) END)::DOUBLE, 6) AS loss,
       max(CASE WHEN event_type = 'view' THEN 'a "b" ' || user_id END) AS note,
       sum(CASE WHEN event_type = 'signup' THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) END)::BIGINT AS k,
       count(*) FILTER (WHERE event_type = 'signup') AS n_null
FROM events GROUP BY event_type"""

_RUNS = "experiment_name || '/' || model_key || '/' || fold"
_ALL = _per_class("all_rows", "gold", "pred", ["one"], False, "w")
_FIGURES = f"""
figures AS (
  {" UNION ALL ".join(f"SELECT replace(label, '-', '_') || '_{x}' AS key, CAST({x} AS DOUBLE) AS value FROM w"
                      for x in ("precision", "recall", "f1", "support"))}
  UNION ALL SELECT 'accuracy', {_ACC} FROM w
  {" ".join(f"UNION ALL SELECT 'macro_{k}', {x} FROM w" for k, x in _MACRO.items())}
  UNION ALL SELECT 'weighted_f1', {_WEIGHTED["f1"]} FROM w)"""
ORACLES["report_sinks"] = f"""
WITH {PRED},
rows AS (SELECT topic AS experiment_name, * FROM v_pred),
all_rows AS (SELECT 1 AS one, * FROM v_pred),
{_per_class("rows", "gold", "pred", ["experiment_name", "model_key", "fold"], False)},
{_ALL}, {_FIGURES},
labels AS (SELECT gold AS label FROM v_pred UNION SELECT pred FROM v_pred),
cells AS (
  SELECT a.label AS t, b.label AS p, (SELECT count(*) FROM v_pred WHERE gold = a.label AND pred = b.label) AS n
  FROM labels a, labels b),
shares AS (SELECT *, sum(n) OVER (PARTITION BY t) AS total FROM cells)
SELECT 'rows' AS output, {_RUNS} AS key, count(*)::DOUBLE AS value FROM rows GROUP BY ALL
UNION ALL SELECT 'logits', {_RUNS}, round(sum(CAST(max_logit AS DECIMAL(38, 4)))::DOUBLE, 6) FROM rows GROUP BY {_RUNS}
UNION ALL SELECT 'report', {_RUNS} || '/' || label, round(f1, 6) FROM m
UNION ALL SELECT 'report', {_RUNS} || '/accuracy', round({_ACC}, 6) FROM m GROUP BY {_RUNS}
UNION ALL SELECT 'report', {_RUNS} || '/macro avg', round({_MACRO["f1"]}, 6) FROM m GROUP BY {_RUNS}
UNION ALL SELECT 'report', {_RUNS} || '/weighted avg', round({_WEIGHTED["f1"]}, 6) FROM m GROUP BY {_RUNS}
UNION ALL (SELECT 'error', id::VARCHAR, round(max_logit, 6) FROM v_pred WHERE gold <> pred ORDER BY id LIMIT 50)
UNION ALL SELECT 'matrix', t || '/' || p, CASE WHEN total > 0 THEN round(n / CAST(total AS DOUBLE), 6) ELSE 0.0 END FROM shares
UNION ALL SELECT 'json', key, round(value, 6) FROM figures
UNION ALL SELECT 'text', key, round(value, 6) FROM figures"""

ORACLES["workflow_outputs"] = f"""
WITH {GOLD.replace("v_gold", "v_all")}, v_gold AS (SELECT * FROM v_all WHERE topic = 'en'),
{_CLASSES}, {_quota("k", "n", "0.3", "train_n", "q")},
h AS (SELECT *, n - train_n AS held FROM q), {_quota("h", "held", "0.5", "val_n", "w")},
t AS (SELECT label, held - val_n AS n_test FROM w)
SELECT 'report' AS output, label AS key, CAST(n_test AS BIGINT) AS value FROM t
UNION ALL SELECT 'report', x.label, CAST((SELECT sum(n_test) FROM t) AS BIGINT)
FROM (VALUES ('accuracy'), ('macro avg'), ('weighted avg')) x(label)
UNION ALL SELECT 'binary_cells', label, CAST(n_test AS BIGINT) FROM t
UNION ALL SELECT 'history', 'stops_by_rule', 1"""

ORACLES["text_feature_totals"] = f"""
WITH {GOLD} SELECT id, label, least({_words("coalesce(comment, '')")}, 256) AS tokens FROM v_gold"""

# ---- histories -------------------------------------------------------------------------------

ORACLES["early_stopping"] = f"""
WITH {HISTORY},
a AS (SELECT *, max(eval_metric) OVER (PARTITION BY run ORDER BY epoch
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
      FROM v_history),
b AS (SELECT *, epoch - max(CASE WHEN before IS NULL OR eval_metric > before THEN epoch END)
                OVER (PARTITION BY run ORDER BY epoch) AS stale FROM a),
c AS (SELECT *, coalesce(min(CASE WHEN stale >= 2 THEN epoch END) OVER (PARTITION BY run),
                         max(epoch) OVER (PARTITION BY run)) AS stop_epoch FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY eval_metric DESC, epoch) AS r
      FROM c WHERE epoch <= stop_epoch)
SELECT run, stop_epoch, epoch AS best_epoch, eval_metric AS best_metric FROM d WHERE r = 1"""

ORACLES["learning_curve"] = f"""
WITH {HISTORY}
SELECT run, epoch, 'loss' AS series, loss AS value FROM v_history WHERE loss IS NOT NULL
UNION ALL SELECT run, epoch, 'eval_metric', eval_metric FROM v_history WHERE eval_metric IS NOT NULL"""
