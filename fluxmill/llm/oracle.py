"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from fluxmill.llm.quality import FLOORS, MIN_GROUP, MOST_STEPS, QUANTILE, SHARE, UNIT, _chi2_cdf, chi2_quantile

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

WARC = f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
    g AS (SELECT *, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS top FROM p)
    SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
        array_to_string(list_transform(range(0, 32), lambda i: substr('{_BASE32}', CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
        CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> top THEN top END AS refers_to
    FROM g
"""

_STATISTICS = r"""
    WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
    rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
    cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
    lines AS (SELECT doc_id, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
    base AS (
      SELECT t.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(body) - length(translate(body, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
      FROM t JOIN lines USING (doc_id) LEFT JOIN cov USING (doc_id)),
    stats AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, greatest(n_words, 1)::DOUBLE AS n FROM base)
"""


def quality(share: float = SHARE, steps: int = MOST_STEPS, quantile: float = QUANTILE, least: int = MIN_GROUP) -> str:
    """The whole estimate as a chain of common table expressions: three starts, all concentration steps, the smallest determinant."""
    dims, floors = range(len(FLOORS)), list(FLOORS.values())
    lower = [(i, j) for i in dims for j in range(i + 1)]
    vector = [f"round({UNIT} * ln(greatest(word_chars, 1) / n))::BIGINT AS x0"] + [f"round({UNIT} * ln(1 + 100 * {c} / n))::BIGINT AS x{k}" for k, c in enumerate(("n_symbols", "n_dup_lines", "n_repeat_words"), 1)]
    distance = " + ".join("(" + " + ".join(f"w{i}{j} * (x{j} / {UNIT}.0 - m{j})" for j in range(i + 1)) + ")^2" for i in dims)
    bin_of = lambda d: f"floor(64 * ln(1 + least({d}, 1e12)))::INT"
    z = [f"abs(x{k} - c{k}) / {UNIT} / sqrt((1.4826 * a{k} / {UNIT})^2 + {floors[k]}^2)" for k in dims]
    norms = [" + ".join(f"({c})^2" for c in z), f"greatest({', '.join(z)})^2", f"({' + '.join(z)})^2"]
    columns = ", ".join(f"x{k}" for k in dims)
    out = [
        _STATISTICS.strip(),
        f"""sized AS (SELECT *, count(*) FILTER (NOT base_failed) OVER (PARTITION BY lang, source) AS n_source, count(*) FILTER (NOT base_failed) OVER (PARTITION BY lang) AS n_lang FROM stats),
        v AS MATERIALIZED (SELECT *, {", ".join(vector)}, 's' || coalesce('=' || lang, '-') || chr(10) || coalesce('=' || source, '-') AS own, 'l' || coalesce('=' || lang, '-') AS wider,
            CASE WHEN n_source >= {least} THEN 's' || coalesce('=' || lang, '-') || chr(10) || coalesce('=' || source, '-') WHEN n_lang >= {least} THEN 'l' || coalesce('=' || lang, '-') ELSE 'r' END AS g FROM sized),
        e AS MATERIALIZED (SELECT m.g, {columns} FROM (SELECT unnest([own, wider, 'r']) AS g, {columns} FROM v WHERE NOT base_failed) m WHERE m.g IN (SELECT g FROM v)),
        mid AS MATERIALIZED (SELECT g, {", ".join(f"quantile_cont(x{k}, 0.5) AS c{k}" for k in dims)} FROM e GROUP BY g),
        dev AS MATERIALIZED (SELECT g, {", ".join(f"any_value(c{k}) AS c{k}, quantile_cont(abs(x{k} - c{k}), 0.5) AS a{k}" for k in dims)} FROM e JOIN mid USING (g) GROUP BY g),
        d1 AS MATERIALIZED (""" + " UNION ALL ".join(f"SELECT g, {k} AS start, {bin_of(n)} AS b, {columns} FROM e JOIN dev USING (g)" for k, n in enumerate(norms)) + ")",
    ]
    factor = share / _chi2_cdf(chi2_quantile(share, len(FLOORS)), len(FLOORS) + 2)
    for k in range(1, steps + 1):
        root = []
        for j in dims:
            root.append(f"sqrt(greatest(s{j}{j}" + "".join(f" - l{j}{m}^2" for m in range(j)) + f", 1e-12)) AS l{j}{j}")
            root += [f"(s{i}{j}" + "".join(f" - l{i}{m} * l{j}{m}" for m in range(j)) + f") / l{j}{j} AS l{i}{j}" for i in dims if i > j]
        inverse = [f"1 / l{i}{i} AS w{i}{i}" if i == j else "-(" + " + ".join(f"l{i}{m} * w{m}{j}" for m in range(j, i)) + f") / l{i}{i} AS w{i}{j}" for i in dims for j in range(i + 1)]
        cov = [f"(t{i}{j} / n - t{i} / n * t{j} / n) / {UNIT}^2 * {factor!r}" + (f" + {floors[i]}^2" if i == j else "") + f" AS s{i}{j}" for i, j in lower]
        placed = f"d{k} AS MATERIALIZED (SELECT e.g, start, {bin_of(distance)} AS b, {columns} FROM e JOIN p{k - 1} USING (g)), " if k > 1 else ""
        out.append(f"""
        {placed}c{k} AS MATERIALIZED (SELECT g, start, quantile_cont(b, {share}) AS cut FROM d{k} GROUP BY ALL),
        s{k} AS MATERIALIZED (SELECT g, start, count(*)::DOUBLE AS n, {", ".join(f"sum(x{i})::DOUBLE AS t{i}" for i in dims)}, {", ".join(f"sum(x{i} * x{j})::DOUBLE AS t{i}{j}" for i, j in lower)} FROM d{k} JOIN c{k} USING (g, start) WHERE b <= cut GROUP BY ALL),
        q{k} AS (SELECT g, start, {", ".join(f"t{i} / n / {UNIT} AS m{i}" for i in dims)}, {", ".join(cov)} FROM s{k}),
        r{k} AS (SELECT *, {", ".join(root)} FROM q{k}),
        p{k} AS MATERIALIZED (SELECT g, start, {", ".join(f"m{i}" for i in dims)}, {", ".join(inverse)}, {" + ".join(f"2 * ln(l{i}{i})" for i in dims)} AS volume FROM r{k})""")
    return ",".join(out) + f""",
        best AS (SELECT * FROM p{steps} QUALIFY row_number() OVER (PARTITION BY g ORDER BY volume, start) = 1)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
          NOT base_failed AND coalesce({distance} <= {chi2_quantile(quantile, len(FLOORS))!r}, true) AS kept
        FROM v LEFT JOIN best USING (g)"""


#: CRC-32 of a number's digits, bit by bit: each byte is followed by eight shifts.
_HELD_OUT = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten([[CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(CAST(doc_id AS VARCHAR), '')])),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295) % 5 = 0"""

LANGUAGE = f"SELECT doc_id, {_HELD_OUT} AS held_out, coalesce(regexp_matches(text, '\\p{{L}}'), false) AS lettered, true AS scored FROM documents"

TOXICITY = f"SELECT doc_id, {_HELD_OUT} AS held_out, true AS agrees FROM documents"

MEDIA = r"""
    WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS body FROM documents),
    p AS (SELECT doc_id, body, octet_length(body) AS n, CASE WHEN octet_length(body) = 0 THEN 64 ELSE CAST((64 - octet_length(body) % 64) % 64 AS BIGINT) END AS more FROM t)
    SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(n + more AS BIGINT) AS payload_bytes, sha256(body || repeat('\x00'::BLOB, more)) AS payload_sha256 FROM p
"""

#: Sources are filled in the order of their limits by weight; the level is the first that the next limit isn't below.
TARGETS = r"""
    WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    w AS (SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)]::DOUBLE AS weight, 2.0 * source_size AS most, 1.5 * sum(source_size) OVER () AS budget FROM s),
    f AS (SELECT *, coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
        sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS place FROM w),
    l AS (SELECT arg_min((budget - full_before) / open, place) FILTER (WHERE (budget - full_before) / open * weight <= most) AS level FROM f)
    SELECT doc_id, size, source_size, least(coalesce(level, 1e300) * weight, most)::DOUBLE AS target
    FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source CROSS JOIN l
"""


ORACLE: dict[str, str] = {"language_folds": LANGUAGE, "mixing_targets": TARGETS, "toxicity_folds": TOXICITY, "media_payloads": MEDIA, "op6_warc": WARC, "op8_quality": quality()}
