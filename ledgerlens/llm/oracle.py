"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from ledgerlens.llm import chat, quality, urls

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def topk(k: int = 10) -> str:
    return f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s
) WHERE place <= {k}"""


def url_filters(rounds: int = 8, damping: float = 0.85, least: float = 0.1) -> str:
    rules = sorted(urls.RULES, key=lambda r: (-len(r.host + r.path), r))
    fits = [(f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))", r) for r in rules]
    text = " ".join(f"WHEN {c} THEN '{r.host}{r.path}'" for c, r in fits)
    verdict = " ".join(f"WHEN {c} THEN '{r.verdict}'" for c, r in fits)
    host = lambda x: f"translate(coalesce(regexp_extract({x}, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}')"
    href = urls.HREF.replace("'", "''")
    moved = lambda i: f"""SELECT kind, e."to" AS host, r.score * e.part * {damping!r} AS score, r.evenly * e.part * {damping!r} AS evenly
    FROM r{i} r JOIN e USING (kind, host)"""  # noqa: E731
    step = "\n".join(
        f"""), r{i} AS (
  SELECT kind, host, sum(score) AS score, sum(evenly) AS evenly FROM (
    SELECT kind, host, score * {1 - damping!r} AS score, {1 - damping!r}::DOUBLE AS evenly FROM r0
    UNION ALL {moved(i - 1)}
  ) GROUP BY ALL"""
        for i in range(1, rounds)
    )
    return rf"""
WITH parts AS (
  SELECT page_id, html, {host("url")} AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), judged AS (
  SELECT page_id, html, host, path, CASE {text} END AS rule, CASE {verdict} END AS ruled FROM parts
), seeds AS (
  SELECT host, avg(CASE WHEN ruled = 'allow' THEN 1.0 ELSE 0 END) AS trust,
    avg(CASE WHEN ruled = 'block' THEN 1.0 ELSE 0 END) AS distrust
  FROM judged WHERE host <> '' GROUP BY host
), links AS (
  SELECT DISTINCT page_id, host AS source, CASE
    WHEN starts_with(x, '//') THEN {host("'http:' || x")}
    WHEN regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {host("x")}
    WHEN regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN '' ELSE host END AS target
  FROM (SELECT page_id, host, unnest(regexp_extract_all(html, '{href}', 1)) AS x FROM judged WHERE host <> '')
), n AS (
  SELECT source, target, count(*) AS pages FROM links WHERE target <> '' AND target <> source GROUP BY ALL
), edges2 AS (
  SELECT 'trust' AS kind, source AS host, target AS "to", pages FROM n
  UNION ALL SELECT 'distrust', target, source, pages FROM n
), e AS (
  SELECT kind, host, "to", pages / sum(pages) OVER (PARTITION BY kind, host) AS part FROM edges2
), own AS (
  SELECT 'trust' AS kind, host, trust AS seed FROM seeds UNION ALL SELECT 'distrust', host, distrust FROM seeds
), r0 AS (
  SELECT kind, host, coalesce(seed, 0.0)::DOUBLE AS score, 1.0::DOUBLE AS evenly
  FROM (SELECT kind, host FROM e UNION SELECT kind, "to" FROM e) LEFT JOIN own USING (kind, host)
{step}
), shares AS (
  SELECT kind, host, seed * {1 - damping!r} AS part FROM own
  UNION ALL SELECT kind, host, sum(score) / sum(evenly) * {damping!r} FROM ({moved(rounds - 1)}) GROUP BY ALL
), bad AS (
  SELECT host FROM shares GROUP BY host HAVING
    coalesce(sum(part) FILTER (kind = 'distrust'), 0) >= {least}
    AND coalesce(sum(part) FILTER (kind = 'distrust'), 0) > coalesce(sum(part) FILTER (kind = 'trust'), 0)
)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged"""


def chat_formatting() -> str:
    escaped = lambda x: f"length(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))"
    marks = len(chat.OPEN + chat.OPENED + chat.CLOSE)
    return rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    CAST(sum({marks} + {escaped("role")} + {escaped("text")}) AS BIGINT) AS formatted_chars
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM g"""


def quality_rules() -> str:
    kept = []
    for r in quality.RULES:
        bottom = "1.0" if r.denominator == "one" else f"CAST({r.denominator} AS DOUBLE)"
        tests = [f"{r.numerator} >= {float(r.least)!r} * {bottom}"] if r.least is not None else []
        tests += [f"{r.numerator} <= {float(r.most)!r} * {bottom}"] if r.most is not None else []
        kept.append(f"(({' AND '.join(tests)}) OR n_words < {r.from_words})")
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i : i + 4], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d WHERE len(words) >= 5)
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS times FROM windows), range(5) t(k)
  WHERE times > 1 GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(words) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '{quality.SYMBOLS}', '')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
    len(list_filter(words, lambda w: lower(w) IN ({stop}))) AS n_stop_words
  FROM d LEFT JOIN covered USING (doc_id)
), f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(kept)} AS kept FROM f"""


def ngram_jaccard(percent: int = 80, n: int = 5, more: str = "") -> str:
    words = WORDS.replace("coalesce(text, '')", f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, {words} AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, unnest(CASE WHEN len(words) >= {n}
      THEN list_transform(range(1, len(words) - {n - 2}), lambda i: array_to_string(words[i : i + {n - 1}], ' '))
      ELSE [array_to_string(words, ' ')] END) AS shingle
    FROM d WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (shingle)
    WHERE x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * c >= {percent} * (na.n + nb.n - c)
), r(doc_id, reach) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reach = l.a
)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.reach) AS component_id{more}
FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id"""


def fill_in_middle(seed: int = 7, fim_percent: int = 100, spm_percent: int = 50) -> str:
    word = lambda i: f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)"
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
    sha256(concat('{seed}:', doc_id)) AS h FROM documents
), c AS (
  SELECT doc_id, text, units, len(units) AS n,
    CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR {word(2)} % 100 >= {fim_percent} THEN 'plain'
      WHEN {word(3)} % 100 < {spm_percent} THEN 'spm' ELSE 'psm' END AS form,
    least({word(0)} % (len(units) + 1), {word(1)} % (len(units) + 1)) AS a,
    greatest({word(0)} % (len(units) + 1), {word(1)} % (len(units) + 1)) AS b FROM d
), p AS (
  SELECT *, array_to_string(units[1 : a], '') AS prefix, array_to_string(units[a + 1 : b], '') AS middle,
    array_to_string(units[b + 1 : n], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p"""


def clusters(k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3) -> str:
    def assign(i: int) -> str:
        return f"""a{i} AS MATERIALIZED (
  SELECT row, any_value(vec_id) AS vec_id, any_value(w) AS w, min({{'d': d, 'k': k}}) AS best FROM (
    SELECT row, vec_id, w, k, list_sum(list_transform(range(1, {dims + 1}), lambda i: (w[i] - c[i]) * (w[i] - c[i]))) AS d
    FROM v, c{i}) GROUP BY row
)"""

    steps = "".join(
        f"""{assign(i - 1)}, c{i} AS MATERIALIZED (
  SELECT o.k, coalesce(m.c, o.c) AS c FROM c{i - 1} o LEFT JOIN (
    SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (
      SELECT best.k AS k, i, sum(w[i]) AS s, count(*) AS n FROM a{i - 1}, range(1, {dims + 1}) t(i) GROUP BY ALL) GROUP BY k
  ) m USING (k)
), """
        for i in range(1, rounds + 1)
    )
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256(concat('{seed}:', vec_id)), w) - 1 AS k, w AS c FROM v
  ORDER BY sha256(concat('{seed}:', vec_id)), w LIMIT {k}
), {steps}{assign(rounds)}
SELECT vec_id, CAST(best.k AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance,
  CAST(sum(best.d) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c{rounds}.k = best.k"""


ORACLE: dict[str, str] = {
    "op3_exact_topk": topk(),
    "op5_url_filters": url_filters(),
    "op6_chat_formatting": chat_formatting(),
    "op7_quality_rules": quality_rules(),
    "op8_ngram_jaccard": ngram_jaccard(),
    "op11_fill_in_middle": fill_in_middle(),
    "op12_minhash": ngram_jaccard(85, 3, ", r.doc_id = min(r.reach) AS kept"),
    "op13_centroids": clusters(),
}
