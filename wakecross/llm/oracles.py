"""The SQL that the queries are compared with, where SQL can express them."""

OP6 = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM documents
), i AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n,
    array_to_string(list_slice(ws, p, p + least(len(ws), 10) - 1), ' ') AS phrase
  FROM i, LATERAL unnest(generate_series(1, greatest(1, len(ws) - 9))) AS g(p)
  WHERE len(ws) > 0
), sizes AS (
  SELECT DISTINCT n FROM windows
), runs AS (
  SELECT doc_id, p, n, array_to_string(list_slice(ws, p, p + n - 1), ' ') AS phrase
  FROM w, sizes, LATERAL unnest(generate_series(1, len(ws) - n + 1)) AS g(p)
), found AS (
  SELECT r.doc_id, r.p, r.n, s.item_id FROM runs r JOIN windows s ON r.n = s.n AND r.phrase = s.phrase
), hit AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit
  FROM found, LATERAL unnest(generate_series(p, p + n - 1)) AS g(word) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS item FROM found) GROUP BY doc_id
)
SELECT w.doc_id, cast(len(ws) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP5 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * cast(x AS double))) AS terms FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (
  SELECT vec_id, min(terms) AS terms FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, cast(list_inner_product(q.terms, c.terms) AS bigint) AS score
  FROM q JOIN v c ON q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS integer) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

OP11 = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p
), grams AS (
  SELECT lang, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS phrase
  FROM w, (VALUES (1), (2), (3)) AS sizes(k), LATERAL unnest(generate_series(1, len(ws) - k + 1)) AS g(i)
), f AS (
  SELECT lang, k, phrase, lang || chr(9) || phrase AS name, count(*) AS a FROM grams GROUP BY lang, k, phrase
), n AS (
  SELECT lang, cast(sum(a) AS bigint) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 10
), cuts AS (
  SELECT lang, k, phrase, a, cut, lang || chr(9) || array_to_string(list_slice(ws, 1, cut), ' ') AS head,
    lang || chr(9) || array_to_string(list_slice(ws, cut + 1, k), ' ') AS rest
  FROM c, LATERAL unnest(generate_series(1, k - 1)) AS g(cut)
), scored AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, cuts.a, x.a AS l, y.a AS r, cut,
    cast((cast(1000000 AS hugeint) * cuts.a * cuts.a) // (cast(x.a AS hugeint) * y.a) AS bigint) AS score
  FROM cuts JOIN f x ON x.name = head JOIN f y ON y.name = rest
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inner_pairs AS (
  SELECT lang, array_to_string(list_slice(ws, i, i + 1), ' ') AS phrase, max(a) AS longest
  FROM c, (VALUES (1), (2)) AS g(i) WHERE k = 3 GROUP BY ALL
), kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN inner_pairs USING (lang, phrase) WHERE k = 3 OR longest IS NULL OR 100 * longest < 50 * a
)
SELECT lang, cast(rank AS integer) AS rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
) JOIN n USING (lang) WHERE rank <= 2000
"""

OP13 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), total AS (
  SELECT count(*) AS docs, cast(sum(len(ts)) AS bigint) AS terms FROM d WHERE len(ts) > 0
), i AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT DISTINCT item_id, text FROM benchmark)
), q AS (
  SELECT item_id, term, count(*) AS times FROM i GROUP BY item_id, term
), o AS (
  SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d
), tf AS (
  SELECT doc_id, n, term, count(*) AS tf FROM o WHERE term IN (SELECT term FROM q) GROUP BY doc_id, n, term
), df AS (
  SELECT term, cast(floor(1000 * ln((2 * docs + 2) / cast(2 * count(*) + 1 AS double))) AS bigint) AS w FROM tf, total GROUP BY term, docs
), s AS (
  SELECT item_id, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms)))) AS bigint) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term), total GROUP BY item_id, doc_id
)
SELECT item_id, cast(rank AS integer) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0
) WHERE rank <= 20
"""

ORACLES = {
    "op5_topk": OP5,
    "op6_decontamination": OP6,
    "op11_collocations": OP11,
    "op13_ball_tree": OP13,
}
