"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

import re
import string

from . import mixing, pii, quality, sharding

BLANK = r"[\x20\x09-\x0D]+"
LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{BLANK}'), lambda w: w <> '')"


def _spans(kind: str, pattern: str, valid: str) -> str:
    """Rows doc_id, a, rank, e, kind, hit of one kind; ``valid`` may use hit, a and text."""
    return f"""SELECT doc_id, a, {pii.KINDS.index(kind)} AS rank, e, '{kind}' AS kind, t, hit FROM (
      SELECT doc_id, t, hit, list_sum(list_slice(lens, 1, i)) - length(hit) AS a, list_sum(list_slice(lens, 1, i)) AS e FROM (
        SELECT doc_id, t, lens, unnest(hits) AS hit, generate_subscripts(hits, 1) AS i FROM (
          SELECT *, list_transform(hits, lambda h, k: length(h) + length(gaps[k])) AS lens FROM (
            SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS hits, string_split_regex(t, '{pattern}') AS gaps FROM d)))) WHERE {valid}"""


DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"
LUHN = f"""length({DIGITS}) BETWEEN 14 AND 19 AND list_sum(list_transform(range(length({DIGITS})), lambda k: CASE WHEN k % 2 = 0
  THEN substr({DIGITS}, length({DIGITS}) - k, 1)::INT ELSE CASE WHEN substr({DIGITS}, length({DIGITS}) - k, 1)::INT > 4
  THEN substr({DIGITS}, length({DIGITS}) - k, 1)::INT * 2 - 9 ELSE substr({DIGITS}, length({DIGITS}) - k, 1)::INT * 2 END END)) % 10 = 0"""
OCTETS = """len(list_filter(string_split(hit, '.'), lambda p: length(regexp_replace(p, '^0+', '')) > 3
  OR coalesce(try_cast(regexp_replace(p, '^0+', '') AS INT), 0) > 255)) = 0"""
SOLID = "replace(hit, ' ', '')"
MOD97 = f"""length({SOLID}) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(
  string_split(substr({SOLID}, 5) || left({SOLID}, 4), ''), lambda c: instr('{pii.LETTERS}', c) * 100 + ascii(c))),
  lambda r, c: CASE WHEN c >= 100 THEN (r * 100 + c // 100 + 9) % 97 ELSE (r * 10 + c - 48) % 97 END) = 1"""


#: The contract's base patterns.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _plain(pattern: str) -> str:
    """Without look-behinds and possessive loops, which change no match."""
    return re.sub(r"\(\?<!\[[^\]]*\]\)", "", pattern).replace("++", "+").replace("}+", "}").replace("(?:", "(")


def _score(kind: str) -> str:
    before = f"substr(t, greatest(a - {pii.CONTEXT}, 0)::BIGINT + 1, least(a, {pii.CONTEXT})::BIGINT)"
    return f"""least(100, greatest(0, {pii.SCORES[kind]} + CASE WHEN regexp_matches({before}, '{pii.RAISING[kind]}') THEN {pii.GAIN} ELSE 0 END
      - CASE WHEN regexp_matches({before}, '{pii.LOWERING}') THEN {pii.LOSS} ELSE 0 END))"""


def _pii() -> str:
    valid = {"ip": OCTETS, "card": LUHN, "phone": f"length({DIGITS}) BETWEEN 10 AND 15", "iban": MOD97}
    valid["secret"] = "regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]')"
    rows = {
        k: f"SELECT *, {_score(k)} AS score FROM ({_spans(k, BASE.get(k) or _plain(p), valid.get(k, 'true'))})"
        for k, p in pii.PATTERNS.items()
    }
    base = " UNION ALL ".join(rows[k] for k in pii.KINDS[:4])
    more = " UNION ALL ".join(rows[k] for k in pii.KINDS[4:])
    joined = lambda x: f"coalesce(string_agg({x}, ',' ORDER BY a, rank), '')"
    written = joined("kind || ':' || a::BIGINT || ':' || e::BIGINT")
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.KINDS[:4])
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), b AS MATERIALIZED ({base}), m0 AS ({more}),
      m AS (SELECT * FROM m0 WHERE score >= {pii.MIN_SCORE} AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = m0.doc_id AND b.a < m0.e AND m0.a < b.e)),
      bs AS (SELECT doc_id, {counts}, {written} AS base FROM b GROUP BY 1),
      al AS (SELECT doc_id, {written} AS spans, {joined("score::BIGINT::VARCHAR")} AS scores, count(*) AS n_spans FROM (SELECT * FROM b UNION ALL SELECT * FROM m) GROUP BY 1)
      SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.KINDS[:4])}, sha256(coalesce(base, '')) AS base_sha256,
        coalesce(spans, '') AS spans, coalesce(scores, '') AS scores, coalesce(n_spans, 0) AS n_spans
        FROM d LEFT JOIN bs ON bs.doc_id = d.doc_id LEFT JOIN al ON al.doc_id = d.doc_id"""


def _ngram(width: int = 3, percent: int = 90) -> str:
    gram = " || ' ' || ".join(f"ws[i + {k}]" for k in range(width))
    return f"""WITH RECURSIVE w AS (SELECT doc_id, {words(LOWER)} AS ws FROM documents),
      s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {width} THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - {width - 2}), lambda i: {gram})) END AS g FROM w),
      u AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
      l AS MATERIALIZED (SELECT a.doc_id AS p, b.doc_id AS q FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
      r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT l.q, r.root FROM r JOIN l ON l.p = r.id)
      SELECT s.doc_id, len(g)::BIGINT AS n_shingles, c.component_id, (SELECT count(*) FROM l WHERE l.p = s.doc_id) AS n_links FROM s
      JOIN (SELECT id, min(root) AS component_id FROM r GROUP BY 1) c ON c.id = s.doc_id"""


EMBED = """WITH RECURSIVE l AS MATERIALIZED (SELECT a.vec_id AS p, b.vec_id AS q FROM embeddings a JOIN embeddings b
    ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.93),
  r AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT l.q, r.root FROM r JOIN l ON l.p = r.id),
  c AS (SELECT id, min(root) AS component_id FROM r GROUP BY 1)
  SELECT id AS vec_id, (SELECT count(*) FROM l WHERE l.p = id) AS n_links, component_id, id = component_id AS kept FROM c"""


def _sharding() -> str:
    k, seed = sharding.SHARDS, sharding.SEED
    table = "list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END))"
    crc = """xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'),
      lambda b: ('0x' || b)::BIGINT)), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"""
    order = "h, doc_id, size, text_crc32"
    return f"""WITH t AS MATERIALIZED (SELECT {table} AS tab),
      b AS MATERIALIZED (SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 AS size, {crc} AS text_crc32,
        md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null ' || coalesce(text, ''))) AS h FROM documents, t),
      r AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY {order}) - 1 + 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS fraction FROM b),
      p AS (SELECT *, row_number() OVER (ORDER BY fraction, source NULLS LAST, {order}) - 1 AS pos, count(*) OVER () AS n FROM r),
      s AS (SELECT *, (pos * {k} // n)::INT AS shard FROM p)
      SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, shard, (pos - (shard * n + {k - 1}) // {k})::BIGINT AS slot,
        NULL::INT AS grown_shard, fraction FROM s"""


def _mixing() -> str:
    turn = lambda xs, kind: f"(CAST([{', '.join(map(str, xs))}] AS {kind}[]))[(i % {len(xs)}) + 1]"
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{mixing.WORD}')) AS size,
        md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null ' || coalesce(text, ''))) AS h FROM documents),
      s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY 1),
      s1 AS (SELECT *, {turn(mixing.WEIGHTS, "BIGINT")} AS w, {turn(mixing.SLOPES, "DOUBLE")} AS slope, source_size * {mixing.MAX_EPOCHS} AS most FROM s0),
      s2 AS (SELECT *, most::DOUBLE / w AS level FROM s1),
      s3 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER o, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS rate
        FROM s2 WINDOW o AS (ORDER BY level, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      f AS (SELECT level AS fl, i AS fi, rate AS fr FROM s3 WHERE most > rate * w ORDER BY level, i LIMIT 1),
      s AS (SELECT s3.*, CASE WHEN (level, i) >= (fl, fi) THEN fr * w ELSE most::DOUBLE END AS target FROM s3 LEFT JOIN f ON true),
      r AS (SELECT d.*, source_size, target, slope, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
        FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
      p AS (SELECT *, greatest(least(floor(target - epochs * source_size)::BIGINT - before, size), 0) AS part FROM r),
      q AS (SELECT *, CASE WHEN size > 0 THEN epochs + (part > 0)::INT ELSE 0 END AS copies, 1.0::DOUBLE - slope AS back,
        least((before + size / 2.0::DOUBLE) / target, 1.0::DOUBLE) AS u FROM p)
      SELECT doc_id, size::BIGINT AS size, source_size, target, (epochs * size + part)::BIGINT AS taken, copies::BIGINT AS copies,
        CASE WHEN copies > 0 THEN 2.0::DOUBLE * u / (back + sqrt(back * back + 4.0::DOUBLE * slope * u)) END AS first_position FROM q"""


def _quality() -> str:
    """Written out with the rules' own numbers."""
    n = f"len({words('x')})"
    count = lambda p: f"len(regexp_extract_all(x, '{p}'))"
    symbols, furniture = "[#*$%&|<>]", quality.BOILERPLATE.replace("'", "''")
    fails = f"""({count(symbols)} > 0.1::DOUBLE * length(array_to_string({words("x")}, ''))
      OR {count("!{2,}")} > 0.3::DOUBLE * {n}
      OR {count("[|]")} >= 2 AND {count("[|]")} > 0.2::DOUBLE * {n}
      OR {n} >= 10 AND len(list_distinct({words("x")})) < 0.3::DOUBLE * {n}
      OR {n} <= 12 AND regexp_matches(lower(x), '{furniture}')
      OR {n} <= 8 AND NOT regexp_matches(x, '[.!?:;\u2026\u3002\uff01\uff1f"\u201d\u00bb)][\\x20\\x09-\\x0D]*$'))"""
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
      w AS MATERIALIZED (SELECT doc_id, t, {words("t")} AS ws, list_filter(string_split(t, chr(10)),
        lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
      g AS (SELECT doc_id, list_slice(ws, i, i + 4) AS win, i FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
      k AS (SELECT doc_id, unnest(list(i)) AS i FROM g GROUP BY doc_id, win HAVING count(*) > 1),
      v AS (SELECT doc_id, count(DISTINCT i + z) AS n FROM k, range(5) q(z) GROUP BY 1),
      a AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(t, '{symbols}')) AS n_symbols,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(v.n, 0) AS n_repeat_words,
        length(array_to_string({words(f"array_to_string(list_filter(ls, lambda x: NOT {fails}), chr(10))")}, '')) AS clean_chars
        FROM w LEFT JOIN v ON v.doc_id = w.doc_id),
      b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a)
      SELECT *, NOT (base_failed OR clean_chars < 0.7::DOUBLE * word_chars) AS kept FROM b"""


def _lines() -> str:
    """Written out with the rule's own numbers: 3 leading tokens, 10 texts, 4 words, 60 %, 50 words for two texts."""
    mask = "CASE WHEN regexp_matches(w, '[0-9@]|://') THEN '<*>' ELSE w END"
    path = lambda *p: "n || ' ' || " + " || ' ' || ".join(p)
    ways = ", ".join(path(*p) for p in (("ws[1]", "ws[2]", "ws[3]"), ("ws[1]", "ws[2]", "'<any>'"), ("ws[1]", "'<any>'", "ws[3]"), ("'<any>'", "ws[2]", "ws[3]")))
    return f"""WITH r AS (SELECT doc_id, text, md5(text) AS h, string_split(text, chr(10)) AS ls FROM documents),
      l0 AS (SELECT doc_id, h, i - 1 AS i, trim(ls[i], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line
        FROM (SELECT doc_id, h, ls, unnest(range(1, len(ls) + 1)) AS i FROM r)),
      l1 AS (SELECT doc_id, h, i, line, list_transform({words("line")}, lambda w: {mask}) AS ws FROM l0 WHERE line <> ''),
      l AS MATERIALIZED (SELECT *, len(ws) AS n FROM l1),
      w AS (SELECT doc_id, h, i, unnest([{ways}]) AS leaf, unnest(range(4)) AS way FROM l WHERE n >= 4),
      hot AS (SELECT leaf FROM w GROUP BY 1 HAVING count(DISTINCT h) >= 10),
      p AS (SELECT doc_id, h, i, arg_min(leaf, way) AS leaf FROM w SEMI JOIN hot USING (leaf) GROUP BY 1, 2, 3),
      t AS MATERIALIZED (SELECT doc_id, h, i, n, leaf, place, ws[place] AS token FROM (SELECT l.doc_id, l.h, l.i, n, ws, p.leaf, unnest(range(1, n + 1)) AS place
        FROM l JOIN p ON p.doc_id = l.doc_id AND p.h = l.h AND p.i = l.i) WHERE ws[place] <> '<*>'),
      f AS (SELECT leaf, place, token FROM t GROUP BY 1, 2, 3 HAVING count(*) >= 10),
      c AS (SELECT doc_id, h, i, leaf || ' : ' || string_agg(place || ' ' || token, ' ' ORDER BY place) AS key FROM t SEMI JOIN f USING (leaf, place, token)
        GROUP BY doc_id, h, i, leaf, n HAVING count(*) >= 0.6::DOUBLE * n AND count(*) FILTER (place > 3) >= 0.6::DOUBLE * (n - 3)),
      k AS MATERIALIZED (SELECT doc_id, h, i, 'template ' || key AS key, 10 AS need FROM c
        UNION ALL SELECT doc_id, h, i, 'line ' || line, CASE WHEN n >= 50 THEN 2 ELSE 10 END FROM l),
      z AS (SELECT key, arg_min(h, (doc_id, h)) AS fh, min(doc_id) AS fd FROM k GROUP BY key, need HAVING count(DISTINCT h) >= need),
      g AS (SELECT doc_id, h, list(DISTINCT i) AS gone FROM k JOIN z USING (key) WHERE NOT (k.doc_id = fd AND h = fh) GROUP BY 1, 2),
      o AS (SELECT r.doc_id, coalesce(len(ls), 0) AS n_lines, coalesce(len(gone), 0) AS n_dropped, CASE WHEN gone IS NULL THEN text ELSE array_to_string(
        list_filter(ls, lambda x, j: NOT list_contains(gone, j - 1)), chr(10)) END AS c FROM r LEFT JOIN g ON g.doc_id = r.doc_id AND g.h = r.h)
      SELECT doc_id, n_lines, n_dropped, length(c) AS clean_chars, md5(c) AS clean_md5 FROM o"""


def oracle_sql() -> dict[str, str]:
    """op3, op5 and op6 rest on libraries SQL does not have; tests hold them against brute force."""
    return {
        "op1_pii": _pii(), "op2_ngram_join": _ngram(), "op4_embedding_dedup": EMBED, "op7_sharding": _sharding(),
        "op8_mixing": _mixing(), "op9_quality": _quality(), "op10_line_dedup": _lines(),
    }
