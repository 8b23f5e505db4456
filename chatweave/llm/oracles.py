"""DuckDB SQL for the queries of this subpackage that SQL can express.

The others are tested against brute force or held-out labels: op1 (a tree of
elements), op3 and op9 (trained models), op4, op5 and op11 (byte-pair merges).
"""

from __future__ import annotations

from chatweave.llm import curriculum, quality_rules
from chatweave.llm.queries import URL_RULES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"


def _op2() -> str:
    candidates = ", ".join(
        f"('{rule}', {i}, {c!r}::DOUBLE)" for rule, (_, cutoffs) in quality_rules.RULES.items() for i, c in enumerate(cutoffs)
    )
    value = "CASE c.rule " + " ".join(f"WHEN '{rule}' THEN {expr.replace('/', '::DOUBLE /')}" for rule, (expr, _) in quality_rules.RULES.items()) + " END"
    alpha, delta, n_rules = quality_rules.ALPHA / len(quality_rules.RULES), quality_rules.DELTA, len(quality_rules.RULES)
    return f"""
WITH w AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i
  FROM (SELECT doc_id, {WORDS.format('text')} AS ws FROM documents)),
grams AS (SELECT doc_id, i, word, lead(word) OVER d AS w2, lead(word, 2) OVER d AS w3 FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
again AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, word, w2, w3) AS n FROM grams WHERE w3 IS NOT NULL) WHERE n > 1),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n, sum(length(word)) AS chars FROM w GROUP BY doc_id),
stats AS (
  SELECT d.doc_id, coalesce(d.lang, 'und') AS stratum, coalesce(counts.n, 0)::BIGINT AS n_words, coalesce(counts.chars, 0)::BIGINT AS word_chars,
         len(regexp_extract_all(coalesce(d.text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
         coalesce(cover.n, 0)::BIGINT AS n_repeat_words
  FROM documents d LEFT JOIN counts USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN cover USING (doc_id)),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stats),
marks AS (
  SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IN (0, 1)
  GROUP BY doc_id HAVING min(quality) = max(quality)),
c(rule, step, cutoff) AS (VALUES {candidates}),
tried AS (
  SELECT stratum, rule, step, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (good AND hit) AS k, count(*) FILTER (NOT good AND hit) AS caught
  FROM (SELECT b.stratum, c.*, m.good, {value} > c.cutoff AS hit FROM based b JOIN marks m USING (doc_id), c WHERE NOT b.base_failed)
  GROUP BY ALL),
tested AS (
  SELECT *, CASE WHEN k >= n * {alpha!r} THEN 1.0 ELSE (
    SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({alpha!r}) + (n - j) * ln(1 - {alpha!r})))
    FROM (SELECT unnest(range(0, k + 1)) AS j)) END AS p
  FROM tried),
certified AS (
  SELECT *, max(CASE WHEN p > {delta!r} / ((SELECT count(DISTINCT stratum) FROM tried) * {n_rules}) THEN 1 ELSE 0 END)
    OVER (PARTITION BY stratum, rule ORDER BY step) AS failed
  FROM tested),
cuts AS (
  SELECT stratum, rule, cutoff FROM certified WHERE failed = 0 AND caught - {quality_rules.FALSE_COST} * k > 0
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY caught - {quality_rules.FALSE_COST} * k DESC, step) = 1),
hits AS (
  SELECT DISTINCT b.doc_id FROM based b JOIN cuts c ON c.stratum = b.stratum AND {value} > c.cutoff WHERE NOT b.base_failed)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM hits) AS kept
FROM based"""


def _op6() -> str:
    rules = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in URL_RULES)
    return f"""
WITH r(rule, h, p, verdict) AS (VALUES {rules}),
u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages)
SELECT page_id, host, path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM u LEFT JOIN LATERAL (
  SELECT rule, verdict FROM r WHERE (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p)
  ORDER BY length(rule) DESC, length(h) DESC, rule DESC LIMIT 1) b ON true"""


def _position(share: str) -> str:
    """The integrated curve of each weight, inverted."""
    cases = []
    for weight, knots in curriculum.CURVES.items():
        total = sum((t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(knots, knots[1:]))
        done, text = 0.0, ""
        for (t0, a), (t1, b) in zip(knots, knots[1:]):
            r = f"({share} * {total!r}::DOUBLE - {done!r}::DOUBLE)"
            at = f"({t0!r}::DOUBLE + 2 * {r} / ({a!r}::DOUBLE + sqrt(greatest(0.0::DOUBLE, {a * a!r}::DOUBLE + {2 * (b - a) / (t1 - t0)!r}::DOUBLE * {r}))))"
            text = at if not text else f"CASE WHEN {share} * {total!r}::DOUBLE >= {done!r}::DOUBLE THEN {at} ELSE {text} END"
            done += (t1 - t0) * (a + b) / 2
        cases.append(f"WHEN weight = {weight} THEN {text}")
    return "CASE " + " ".join(cases) + " END"


def _op7() -> str:
    most = curriculum.MOST_EPOCHS
    weights = ", ".join(map(str, curriculum.WEIGHTS))
    taken = " + ".join(f"CASE WHEN size > 0 AND middle + {e} * source_size < target THEN 1 ELSE 0 END" for e in range(most))
    return f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len({WORDS.format('text')}), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 't' || coalesce(text, ''))), 1, 15))::BIGINT AS r
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM s),
c AS (SELECT *, ([{weights}])[(k - 1) % {len(curriculum.WEIGHTS)} + 1] AS weight, ({most} * source_size)::DOUBLE AS cap FROM k),
l AS (
  SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
  FROM c WINDOW o AS (ORDER BY cap / weight, k)),
f AS (SELECT level FROM l WHERE level * weight <= cap ORDER BY cap / weight, k LIMIT 1),
t AS (SELECT source, source_size, weight, coalesce(least(cap, (SELECT level FROM f) * weight), cap) AS target FROM l),
m AS (
  SELECT d.doc_id, d.size, t.source_size, t.weight, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.r, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT
           + d.size / 2.0::DOUBLE AS middle
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (({taken}) * size)::BIGINT AS taken,
       CASE WHEN size > 0 AND middle < target THEN {_position('(middle / target)')} END AS first_position
FROM m"""


OP8 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS ws FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [ws]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i:i + 3]) END) AS gram
  FROM d),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(b) FROM reach r WHERE r.a = d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id)"""

OP10 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
WHERE rank <= 10"""

OP12 = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\n\\x0b\\x0c\\r]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS ws FROM pieces),
n AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
runs AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*)::HUGEINT AS f
  FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w), (SELECT unnest([1, 2, 3, 4, 5]) AS k)
  WHERE i + k - 1 <= len(ws) GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT lang, k, phrase, f, c, array_to_string(string_split(phrase, ' ')[1:c], ' ') AS head, array_to_string(string_split(phrase, ' ')[c + 1:k], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS c FROM runs WHERE k > 1)),
scored AS (
  SELECT lang, k, phrase, cuts.f AS a, c, l.f AS l, r.f AS r, n.n, (1000::HUGEINT * cuts.f * n.n::HUGEINT) // (l.f * r.f) AS score
  FROM cuts JOIN n USING (lang) JOIN (SELECT lang, phrase AS head, f FROM runs) l USING (lang, head) JOIN (SELECT lang, phrase AS tail, f FROM runs) r USING (lang, tail)),
worst AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS place FROM scored) s
  WHERE place = 1 AND NOT EXISTS (
    SELECT 1 FROM runs g WHERE g.lang = s.lang AND g.k > s.k AND g.f >= s.a AND contains(' ' || g.phrase || ' ', ' ' || s.phrase || ' ')))
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst)
WHERE rank <= 2000"""



def _op13() -> str:
    """Ten rounds, each a step of its own."""

    def assigned(centroids: str) -> str:
        square = "list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        return f"SELECT * FROM (SELECT r, vec_id, v.x, c, {square} AS d FROM v, {centroids} c) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1"

    steps = []
    for i in range(10):
        steps.append(f"a{i} AS MATERIALIZED ({assigned(f'c{i}')})")
        steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT o.c, coalesce(m.x, o.x) AS x FROM c{i} o LEFT JOIN (
    SELECT c, list(CASE WHEN s < 0 THEN -((-s + n - 1) // n) ELSE s // n END ORDER BY i) AS x
    FROM (SELECT c, i, sum(x[i])::HUGEINT AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, 65)) AS i) GROUP BY c, i) GROUP BY c) m USING (c))""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::HUGEINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('3:' || vec_id) AS h, x FROM v WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT 8)),
{', '.join(steps)},
last AS MATERIALIZED ({assigned('c10')})
SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(k.x, ',')) AS centroid_sha256
FROM last JOIN c10 k USING (c)"""


ORACLES: dict[str, str] = {
    "op2_quality_rules": _op2(),
    "op6_url_rules": _op6(),
    "op7_curriculum_mix": _op7(),
    "op8_ngram_join": OP8,
    "op10_norm_topk": OP10,
    "op12_phrases": OP12,
    "op13_centroid_clusters": _op13(),
}
