"""Helpers that write the oracle's DuckDB SQL from the same constants."""

from __future__ import annotations

TERM_RE_SQL = "[\\p{L}\\p{N}]+"
TOKENS_SQL = "len(regexp_extract_all({x}, '[^\\s]+'))"


def lit(s: str) -> str:
    """A SQL string expression equal to ``s`` (newlines as chr(10))."""
    parts = s.split("\n")
    q = ["'" + p.replace("'", "''") + "'" for p in parts]
    return " || chr(10) || ".join(q)


def fill(template: str, **slots: str) -> str:
    """SQL concatenation of a {slot} template; slots are SQL expressions."""
    out, rest = [], template
    while rest:
        i = rest.find("{")
        if i < 0:
            out.append(lit(rest))
            break
        j = rest.index("}", i)
        if i:
            out.append(lit(rest[:i]))
        out.append(f"({slots[rest[i + 1:j]]})")
        rest = rest[j + 1:]
    return " || ".join(out)


def bisect_ctes(src: str, limit: int, prefix: str = "bs") -> str:
    """Recursive bisection of (request_id, text) rows of ``src`` -> {prefix}_leaves."""
    tok = TOKENS_SQL.format(x="piece")
    return f"""{prefix}_t(request_id, path, piece) AS (
      SELECT request_id, '', text FROM {src}
      UNION ALL
      SELECT request_id, path || b, CASE WHEN b = '0' THEN substr(piece, 1, length(piece) // 2)
                                         ELSE substr(piece, length(piece) // 2 + 1) END
      FROM {prefix}_t, (VALUES ('0'), ('1')) v(b) WHERE {tok} > {limit}),
    {prefix}_leaves AS (SELECT request_id, path, piece FROM {prefix}_t WHERE {tok} <= {limit})"""


def pack_ctes(src: str, limit: int, prefix: str = "pk") -> str:
    """Greedy line packing of (request_id, text) rows of ``src`` -> {prefix}_packed."""
    return f"""{prefix}_lt AS (
      SELECT request_id, pos, line, len(regexp_extract_all(line, '[^\\s]+')) AS t FROM (
        SELECT request_id, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS line
        FROM (SELECT request_id, string_split(text, chr(10)) AS ls FROM {src}))),
    {prefix}_walk(request_id, pos, chunk, tok) AS (
      SELECT request_id, pos, CASE WHEN t <= {limit} THEN 0 ELSE 1 END, t FROM {prefix}_lt WHERE pos = 0
      UNION ALL
      SELECT w.request_id, l.pos,
             CASE WHEN w.tok + l.t <= {limit} THEN w.chunk ELSE w.chunk + 1 END,
             CASE WHEN w.tok + l.t <= {limit} THEN w.tok + l.t ELSE l.t END
      FROM {prefix}_walk w JOIN {prefix}_lt l ON l.request_id = w.request_id AND l.pos = w.pos + 1),
    {prefix}_packed AS (SELECT request_id, CAST(chunk AS BIGINT) AS chunk_no,
           string_agg(line, chr(10) ORDER BY pos) AS chunk, CAST(sum(t) AS BIGINT) AS n_tokens
      FROM {prefix}_walk JOIN {prefix}_lt USING (request_id, pos) GROUP BY request_id, chunk)"""


def tfidf_ctes(src: str) -> str:
    """tf, df, n and per-message score over (id, message) rows of ``src``."""
    return f"""tf_t AS (SELECT id, unnest(regexp_extract_all(lower(message), '{TERM_RE_SQL}')) AS term FROM {src}),
    tf AS (SELECT id, term, count(*) AS tf FROM tf_t GROUP BY ALL),
    nd AS (SELECT count(*) AS n FROM {src}),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    sc AS (SELECT tf.id, sum(tf.tf * ln((1 + nd.n) / (1 + df.df))) / sqrt(sum(tf.tf)) AS score
           FROM tf JOIN df USING (term), nd GROUP BY tf.id)"""


def hashed_ctes(src: str, key: str, text: str, prefix: str) -> str:
    """Bucket counts of 64-bucket hashed terms -> {prefix}_b(k, bucket, c), {prefix}_n(k, norm)."""
    return f"""{prefix}_t AS (SELECT {key} AS k, unnest(regexp_extract_all(lower({text}), '{TERM_RE_SQL}')) AS term FROM {src}),
    {prefix}_b AS (SELECT k, CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % 64 AS bucket, count(*) AS c
                   FROM {prefix}_t GROUP BY ALL),
    {prefix}_n AS (SELECT k, sqrt(sum(c * c)) AS norm FROM {prefix}_b GROUP BY k)"""
