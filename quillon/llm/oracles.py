"""SQL (DuckDB) for the operators that SQL can express; the others are tested against brute force."""

from __future__ import annotations

from . import licenses, mixing, topk

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), '{u}', '{l}'), '[^\x20\x09-\x0D]+')".format(u=_UPPER, l=_LOWER)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    out = f"translate({text}, '{_UPPER}', '{_LOWER}')"
    for pattern, by in licenses.STEPS:
        out = f"regexp_replace({out}, {_quoted(pattern)}, {_quoted(by)}, 'g')"
    return f"trim({out})"


def license_scan() -> str:
    known = ", ".join(f"('{d}', '{n}')" for d, n in sorted(licenses.known_digests().items()))
    return f"""WITH known AS (SELECT * FROM (VALUES {known}) AS k(digest, license)),
      docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
      lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs),
      hits AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM (SELECT doc_id, sha256({_canonical('line')}) AS digest FROM lines) JOIN known USING (digest) GROUP BY 1),
      whole AS (SELECT doc_id, sha256({_canonical('text')}) AS digest FROM docs)
      SELECT w.doc_id, w.digest, k.license, coalesce(h.n, 0) AS n_notices, coalesce(h.notices, '') AS notices FROM whole w LEFT JOIN known k USING (digest) LEFT JOIN hits h USING (doc_id)"""


def topk_search_benchmark(k: int = 10) -> str:
    k1, b = topk.K1, topk.B
    return f"""WITH dw AS (SELECT doc_id, {_WORDS} AS ws FROM documents WHERE doc_id IS NOT NULL),
      about AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(len(ws)) AS DOUBLE) / count(*) AS mean FROM dw),
      tf AS (SELECT doc_id, w, CAST(count(*) AS DOUBLE) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, unnest(ws) AS w, CAST(len(ws) AS DOUBLE) AS dl FROM dw) GROUP BY 1, 2),
      q AS (SELECT query_id, w, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({_WORDS}) AS w FROM benchmark WHERE item_id IS NOT NULL) GROUP BY 1, 2),
      idf AS (SELECT w, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM (SELECT w, CAST(count(*) AS DOUBLE) AS df FROM tf WHERE w IN (SELECT w FROM q) GROUP BY 1), about),
      scored AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * ({k1}::DOUBLE + 1) / (tf + {k1}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * dl / mean))), 6) AS score FROM q JOIN idf USING (w) JOIN tf USING (w), about GROUP BY 1, 2)
      SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= {k}"""


def topk_search(k: int = 10) -> str:
    """The same search with the documents whose ids are divisible by 50 as queries."""
    return topk_search_benchmark(k).replace("SELECT item_id AS query_id", "SELECT doc_id AS query_id").replace("FROM benchmark WHERE item_id IS NOT NULL", "FROM documents WHERE doc_id % 50 = 0")


def mixing_sql(seed: int = 42) -> str:
    most = mixing.MOST
    return rf"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
      s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
      s1 AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s0),
      s2 AS (SELECT *, CAST({most} * source_size AS DOUBLE) / weight AS level FROM s1),
      s3 AS (SELECT *, CAST(sum(source_size) OVER () - {most} * coalesce(sum(source_size) OVER w, 0) AS DOUBLE) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS rise FROM s2
        WINDOW w AS (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      s4 AS (SELECT *, least(CAST({most} * source_size AS DOUBLE), weight * coalesce(max(CASE WHEN rise <= level THEN rise END) OVER (), 0)) AS target,
        CAST(CAST('0x' || substr(md5('{seed}:' || coalesce(source, chr(1) || 'null')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296::DOUBLE AS start FROM s3),
      r AS (SELECT d.doc_id, d.size, s4.source_size, s4.target, s4.start, CASE WHEN s4.source_size > 0 THEN least(s4.target / CAST(s4.source_size AS DOUBLE), {most}::DOUBLE) ELSE 0 END AS f,
        CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS LAST) - 1 AS DOUBLE) AS rank FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source),
      c AS (SELECT *, least(CAST(floor(start + (rank + 1) * f) - floor(start + rank * f) AS INT), {most}) AS copies FROM r)
      SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS INT) AS copies FROM c"""


def near_duplicates(percent: int = 85) -> str:
    return f"""WITH RECURSIVE dw AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
      sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS i FROM dw WHERE len(ws) > 0)),
      n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
      common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
      links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
      reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
      SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id"""


def line_dedup() -> str:
    white = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(doc_id, -9223372036854775808) AS doc, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
      l AS (SELECT r, doc, i, ls[i] AS line, translate(trim(ls[i], {white}), '{_UPPER}', '{_LOWER}') AS key FROM (SELECT r, doc, ls, unnest(generate_series(1, len(ls))) AS i FROM d)),
      k AS (SELECT key, max(doc) AS keeper FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT r) >= 3),
      m AS (SELECT l.*, k.key IS NOT NULL AND doc <> keeper AS dropped FROM l LEFT JOIN k USING (key))
      SELECT any_value(d.doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256 FROM m JOIN d USING (r) GROUP BY r"""


def interval_painting(batches: int = 50, most: int = 7) -> str:
    names = ("n_rows", "n_distinct", "total", "least", "greatest", "median")
    zero = ("n_rows", "n_distinct", "total")
    olds = ", ".join(f"lag({c}, 1, {'0' if c in zero else 'NULL'}) OVER w AS old_{c}, {c} AS new_{c}" for c in names)
    crc = f"""(WITH RECURSIVE t(n, c, k) AS (SELECT i, CAST(i AS BIGINT), 0 FROM range(256) AS r(i) UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM t WHERE k < 8) SELECT list(c ORDER BY n) FROM t WHERE k = 8)"""
    return f"""WITH tbl AS MATERIALIZED (SELECT {crc} AS t),
      h AS (SELECT coalesce(source, '') AS source, coalesce(lang, '') AS lang, text, n_chars, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM documents, tbl WHERE doc_id IS NOT NULL),
      p AS (SELECT source, lang, text, n_chars, h % {batches} AS b, (h // {batches}) % {most} AS q FROM h),
      i AS (SELECT source, lang, text, n_chars AS v, b AS a, b + q AS z FROM p UNION ALL SELECT source, lang, text, n_chars + q, b + q, {batches} FROM p WHERE q % 3 = 0),
      e AS (SELECT source, lang, text, v, unnest(generate_series(a, least(z, {batches}) - 1)) AS batch FROM i),
      s AS (SELECT source, lang, batch, count(*) AS n_rows, count(DISTINCT text) AS n_distinct, CAST(coalesce(sum(v), 0) AS BIGINT) AS total, min(v) AS least, max(v) AS greatest, list_sort(list(v) FILTER (v IS NOT NULL))[count(v) // 2 + 1] AS median FROM e GROUP BY ALL),
      g AS (SELECT source, lang, batch FROM (SELECT DISTINCT source, lang FROM i), range({batches}) AS r(batch)),
      f AS (SELECT g.*, coalesce(n_rows, 0) AS n_rows, coalesce(n_distinct, 0) AS n_distinct, coalesce(total, 0) AS total, least, greatest, median FROM g LEFT JOIN s USING (source, lang, batch)),
      o AS (SELECT CAST(batch AS INT) AS batch, source, lang, {olds} FROM f WINDOW w AS (PARTITION BY source, lang ORDER BY batch))
      SELECT * FROM o WHERE {" OR ".join(f"old_{c} IS DISTINCT FROM new_{c}" for c in names)}"""


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": license_scan(), "op5_topk_search": topk_search(), "op5_topk_search_benchmark": topk_search_benchmark(), "op6_mixing": mixing_sql(), "op10_near_duplicates": near_duplicates(), "op11_line_dedup": line_dedup(), "op12_interval_painting": interval_painting()}
