"""SQL for DuckDB of the same names as plans/queries.py, on the same tables."""

from __future__ import annotations

from .queries import DOMAINS, RECORDS, REGISTRY

# The character classes of functions/text.py as RE2 writes them.
WS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
LETTER = r"[\p{L}\p{Nl}\p{No}]"
DIACRITIC = r"[\x{064B}-\x{0655}\x{0670}]"
TATWEEL = "chr(1600)"
LATIN = r"[A-Za-z\x{C0}-\x{24F}]"
ARABIC = r"[\x{0600}-\x{06FF}]"


def strip(t: str) -> str:
    return rf"regexp_replace(regexp_replace({t}, '^{WS}+', ''), '{WS}+$', '')"


def tidy(t: str) -> str:
    for pattern, to in ((r"\r\n?", "chr(10)"), (r"[ \t\f\x0B]+", "' '"), (r" *\n *", "chr(10)"), (r"\n{3,}", "chr(10) || chr(10)")):
        t = f"regexp_replace({t}, '{pattern}', {to}, 'g')"
    return strip(t)


def normalized(t: str) -> str:
    return tidy(rf"regexp_replace(replace({t}, {TATWEEL}, ''), '{DIACRITIC}', '', 'g')")


def words(t: str) -> str:
    return f"list_filter(string_split_regex({t}, '{WS}+'), lambda w: w <> '')"


def count(t: str, pattern: str) -> str:
    return f"len(regexp_extract_all({t}, '{pattern}'))"


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b}) END)"


def unique_ratio(w: str) -> str:
    return ratio(f"len(list_distinct({w}))", f"len({w})")


def script_ratio(t: str, block: str) -> str:
    return ratio(count(t, block), count(t, LETTER))


def language(t: str) -> str:
    return f"(CASE WHEN regexp_matches({t}, '{ARABIC}') AND regexp_matches({t}, '[A-Za-z]') THEN 'mixed' WHEN regexp_matches({t}, '{ARABIC}') THEN 'ar' WHEN regexp_matches({t}, '[A-Za-z]') THEN 'en' ELSE 'other' END)"


LINES = rf"""raw_lines AS (SELECT doc_id, lang, source, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS raw
  FROM (SELECT doc_id, lang, source, string_split_regex(text, '{LINE_END}') AS l FROM documents)),
lines AS (SELECT doc_id, lang, source, pos, raw, {normalized("raw")} AS line FROM raw_lines WHERE {normalized("raw")} <> '')"""
QUALITY = f"(length(line) >= 30 AND length(line) <= 20000 AND {script_ratio('line', LATIN)} >= 0.5 AND {unique_ratio(words('line'))} >= 0.3)"
EVAL = rf"""{LINES}, bench AS (SELECT {normalized("b")} AS line FROM (SELECT unnest(string_split_regex(text, '{LINE_END}')) AS b FROM benchmark)),
blocked AS (SELECT line FROM lines WHERE doc_id % 100 = 0 AND pos = 0 UNION SELECT line FROM bench WHERE line <> '')"""
JUDGED = f"""{EVAL}, tested AS (SELECT *, {QUALITY} AS q, line IN (SELECT line FROM blocked) AS e FROM lines),
ranked AS (SELECT *, row_number() OVER (PARTITION BY line, q AND NOT e ORDER BY doc_id, pos) AS r FROM tested),
judged AS (SELECT *, CASE WHEN NOT q THEN 'quality' WHEN e THEN 'eval' WHEN r > 1 THEN 'duplicate' ELSE 'accepted' END AS verdict FROM ranked),
summed AS (SELECT *, sum((verdict = 'accepted')::BIGINT) OVER (ORDER BY doc_id, pos) AS so_far FROM judged)"""
VERDICTS = ", ".join(f"count(*) FILTER (WHERE verdict = '{v}') AS {v}" for v in ("quality", "eval", "duplicate", "accepted"))
BYTES = "(strlen(line) + 1)"


def chunked(t: str, limit: int, cumulative: bool = False) -> str:
    """A text's chunks, as a fold over its sentences."""
    lines = f"list_filter(list_transform(string_split(regexp_replace({t}, '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: {strip('x')}), lambda x: x <> '')"
    parts = f"flatten(list_transform({lines}, lambda l: list_filter(list_transform(string_split(l, '. '), lambda p, i: CASE WHEN {strip('p')} <> '' AND i < len(string_split(l, '. ')) THEN {strip('p')} || '.' ELSE {strip('p')} END), lambda p: p <> '')))"
    states = f"list_transform({parts}, lambda p: {{'opened': p, 'size': length(p), 'done': []::VARCHAR[]}})"
    grown = "length(a.opened || ' ' || b.opened)" + (" + a.size" if cumulative else "")
    fold = f"list_reduce({states}, lambda a, b: CASE WHEN a.size + length(b.opened) + 1 > {limit} THEN {{'opened': b.opened, 'size': b.size, 'done': list_append(a.done, a.opened)}} ELSE {{'opened': a.opened || ' ' || b.opened, 'size': {grown}, 'done': a.done}} END)"
    return f"CASE WHEN len({parts}) = 0 THEN []::VARCHAR[] ELSE list_filter(list_append(({fold}).done, ({fold}).opened), lambda c: length(c) BETWEEN 40 AND {limit}) END"


def ranks(table: str, by: str, length: str) -> str:
    """p50 and p90 of each group by rank."""
    return f"""(SELECT {by}, max({length}) FILTER (WHERE rn = floor(n / 2.0)) AS p50, max({length}) FILTER (WHERE rn = floor(n * 0.9)) AS p90
  FROM (SELECT {by}, {length}, row_number() OVER (PARTITION BY {by} ORDER BY {length}) - 1 AS rn, count(*) OVER (PARTITION BY {by}) AS n FROM {table}) GROUP BY {by})"""


def quoted(x: object) -> str:
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else str(x)


def values(rows: list[tuple], names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) AS t({names})"


REGISTRY_ROWS = values([(*r, k + 1) for k, r in enumerate(REGISTRY)], "source_id, language, role, license, provenance, status, line_no")
ALLOWED = "license IN ('Apache-2.0', 'MIT', 'CC0', 'Public Domain', 'ODC-By-1.0', 'CC-BY-4.0')"
FORBIDDEN = "regexp_matches(replace(upper(license), '_', '-'), 'NC|ND|RESEARCH|NON-COMMERCIAL|UNKNOWN')"
REQUIRED = " UNION ALL ".join(f"SELECT source_id AS label, 'missing required field ''{k}''' AS problem FROM reg WHERE {k} IS NULL OR {k} = ''" for k in ("source_id", "language", "role", "license", "provenance", "status"))
REGISTRY_PROBLEMS = f"""reg AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY line_no) AS r FROM {REGISTRY_ROWS}), problems AS ({REQUIRED}
  UNION ALL SELECT source_id, 'duplicate source_id' FROM reg WHERE r > 1
  UNION ALL SELECT source_id, 'invalid status ''' || status || '''' FROM reg WHERE status NOT IN ('approved', 'conditional_review', 'pending_provenance', 'rejected')
  UNION ALL SELECT source_id, 'approved with ' || CASE WHEN license = 'CC-BY-SA-4.0' THEN 'conditional' WHEN {FORBIDDEN} THEN 'forbidden' ELSE 'unapproved' END || ' license ''' || license || '''' FROM reg WHERE status = 'approved' AND NOT {ALLOWED}
  UNION ALL SELECT source_id, 'approved with unverified provenance ''' || provenance || '''' FROM reg WHERE status = 'approved' AND upper(provenance) IN ('UNVERIFIED', '', 'UNKNOWN')
  UNION ALL SELECT source_id, 'forbidden license ''' || license || ''' must not be approved' FROM reg WHERE status = 'approved' AND {FORBIDDEN})"""


def taxonomy_sql() -> str:
    """The expected problems of the taxonomy, from its rows."""
    subs = [(d, k, s, i, ",".join(langs)) for k, (d, _, ss) in enumerate(DOMAINS) for i, (s, langs) in enumerate(ss)]
    doms = [(d, k, w, len(ss)) for k, (d, w, ss) in enumerate(DOMAINS)]
    return f"""WITH d AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY k) AS r FROM {values(doms, "domain, k, weight, n")}),
s AS (SELECT *, row_number() OVER (PARTITION BY subdomain ORDER BY k, i) AS r FROM {values(subs, "domain, k, subdomain, i, langs")})
SELECT domain AS label, 'duplicate domain id' AS problem FROM d WHERE r > 1
UNION ALL SELECT domain, 'weight must be a positive number' FROM d WHERE weight <= 0
UNION ALL SELECT domain, 'subdomains must be a non-empty list' FROM d WHERE n = 0
UNION ALL SELECT domain || '/' || subdomain, 'duplicate subdomain id' FROM s WHERE r > 1
UNION ALL SELECT domain || '/' || subdomain, 'languages must be a non-empty list' FROM s WHERE langs = ''
UNION ALL SELECT domain || '/' || subdomain, 'language ''' || l || ''' not declared in taxonomy languages' FROM (SELECT domain, subdomain, unnest(string_split(langs, ',')) AS l FROM s WHERE langs <> '') WHERE l NOT IN ('msa', 'en', 'arz')"""


def pilot_sql() -> str:
    recs = [(*r[:7], r[7], r[8], r[9], r[10], k + 1) for k, r in enumerate(RECORDS)]
    subs = [(d, s, ",".join(langs)) for d, _, ss in DOMAINS for s, langs in ss]
    label = "coalesce(record_id, 'record#' || line_no)"
    fields = " UNION ALL ".join(f"SELECT {label} AS label, 'missing required field ''{k}''' AS problem FROM r WHERE {k} IS NULL" for k in ("record_id", "pilot"))
    return f"""WITH raw AS (SELECT * FROM {values(recs, "record_id, domain, subdomain, language, source_id, license, provenance, text, off, pilot, intended_use, line_no")}),
h AS (SELECT *, sha256(CASE WHEN off = 3 THEN 'else' ELSE text END) AS sha, coalesce(off, length(text)) AS chars FROM raw),
tax AS (SELECT * FROM {values(subs, "domain, subdomain, langs")}),
reg AS (SELECT source_id, arg_max(license, line_no) AS reg_license FROM {REGISTRY_ROWS} GROUP BY source_id),
r AS (SELECT h.*, tax.langs, reg.reg_license, row_number() OVER (PARTITION BY record_id ORDER BY line_no) AS rid, row_number() OVER (PARTITION BY sha ORDER BY line_no) AS rsha
  FROM h LEFT JOIN tax USING (domain, subdomain) LEFT JOIN reg ON h.source_id = reg.source_id)
{fields}
UNION ALL SELECT {label}, 'records without ''pilot'': true are refused' FROM r WHERE NOT coalesce(pilot, false)
UNION ALL SELECT {label}, 'intended_use must be ''pipeline_validation_only''' FROM r WHERE intended_use <> 'pipeline_validation_only'
UNION ALL SELECT {label}, 'duplicate record_id' FROM r WHERE record_id IS NOT NULL AND rid > 1
UNION ALL SELECT {label}, 'duplicate text_sha256 (exact dedup violation)' FROM r WHERE rsha > 1
UNION ALL SELECT {label}, 'unknown domain/subdomain ''' || domain || '/' || subdomain || '''' FROM r WHERE langs IS NULL
UNION ALL SELECT {label}, 'language ''' || language || ''' not allowed for ''' || domain || '/' || subdomain || '''' FROM r WHERE langs IS NOT NULL AND NOT list_contains(string_split(langs, ','), language)
UNION ALL SELECT {label}, 'source_id ''' || source_id || ''' not found in source registry' FROM r WHERE reg_license IS NULL
UNION ALL SELECT {label}, 'license ''' || license || ''' does not match registry license ''' || reg_license || ''' for source ''' || source_id || '''' FROM r WHERE license <> reg_license
UNION ALL SELECT {label}, 'unverified provenance ''' || provenance || '''' FROM r WHERE reg_license IS NOT NULL AND upper(provenance) IN ('UNVERIFIED', 'UNKNOWN', '')
UNION ALL SELECT {label}, 'text does not hash to text_sha256' FROM r WHERE sha256(text) <> sha
UNION ALL SELECT {label}, 'text_chars must be a positive integer' FROM r WHERE chars <= 0
UNION ALL SELECT {label}, 'text_chars (' || chars || ') != len(text) (' || length(text) || ')' FROM r WHERE chars <> length(text)"""


PROFILE = f"""profiled AS (SELECT g, count(*) AS lines, sum(length(t)) AS chars, min(length(t)) AS min_len, max(length(t)) AS max_len, sum({count("t", LATIN)}) AS script_chars, sum(len({words("t")})) AS words,
  sum((contains(t, '  ') OR contains(t, chr(9)) OR {strip("t")} <> t)::BIGINT) AS odd, count(DISTINCT t) AS distinct_lines FROM texts GROUP BY g),
vocabulary AS (SELECT g, count(DISTINCT w) AS unique_words FROM (SELECT g, unnest({words("t")}) AS w FROM texts) GROUP BY g)"""
PARAMETERS = "(VALUES (768, 12, 4, 64, 2048, 32768, 8, true, true), (512, 8, 8, 64, 1536, 32000, 6, false, false), (1024, 16, 4, 64, 2816, 50257, 24, true, false)) AS c(hidden, heads, kv_heads, head_dim, inner_size, vocab, layers, qk_norm, tied)"


def oracle_sql() -> dict[str, str]:
    big = lambda x, name: f"({x})::BIGINT AS {name}"
    padded = "' ' || chr(9) || text || chr(13) || chr(10) || chr(10) || chr(10) || ' x ' || chr(11) || ' y ' || chr(160)"
    marked = "concat(chr(1605), chr(1615), chr(1581), chr(1600), chr(1600), chr(1605), chr(1614), chr(1617), chr(1583), ' ', text)"
    return {
        "normalize_documents": f"SELECT doc_id, sha256({normalized('text')}) AS sha, {big('length(' + normalized('text') + ')', 'n')} FROM documents",
        "whitespace_functions": f"SELECT doc_id, {tidy('t')} AS tidy, {strip('t')} AS stripped, (contains(text, '  ') OR contains(text, chr(9)) OR {strip('text')} <> text) AS odd, replace(text, chr(10), ' ') AS flat FROM (SELECT doc_id, text, {padded} AS t FROM documents)",
        "arabic_marks": f"SELECT doc_id, replace(t, {TATWEEL}, '') AS no_tatweel, regexp_replace(t, '{DIACRITIC}', '', 'g') AS no_diacritics, {script_ratio('t', ARABIC)} AS ratio, {language('t')} AS lang_id FROM (SELECT doc_id, {marked} AS t FROM documents)",
        "split_lines_and_words": f"SELECT doc_id, {big(f'len(list_filter(string_split_regex(text, {chr(39)}{LINE_END}{chr(39)}), lambda x: x <> {chr(39)}{chr(39)}))', 'n_lines')}, {big('len(' + words('text') + ')', 'n_words')}, {big('len(list_distinct(' + words('text') + '))', 'n_unique')} FROM documents",
        "unique_word_ratio": f"SELECT doc_id, {unique_ratio(words('text'))} AS ratio FROM documents",
        "script_ratios": f"SELECT doc_id, {script_ratio('text', LATIN)} AS latin_ratio, {ratio(count('text', LATIN), 'length(text)')} AS latin_share, {big(count('text', ARABIC), 'arabic_chars')} FROM documents",
        "text_lengths": "SELECT doc_id, length(text)::BIGINT AS n_chars, strlen(text)::BIGINT AS n_bytes, substr(text, 1, 70) AS head, true AS valid FROM documents",
        "fingerprints": "SELECT doc_id, sha256(text) AS sha, substr(sha256(text), 1, 12) AS short_sha, true AS is_digest, regexp_matches(source, '^[0-9a-f]{64}$') AS source_is_digest FROM documents",
        "language_id_counts": f"WITH {LINES} SELECT {language('line')} AS lang_id, count(*) AS n FROM lines GROUP BY 1",
        "safe_ratios": f"SELECT lang, {ratio('chars', 'words')} AS chars_per_word, 0.0::DOUBLE AS none, round_even((chars / 8.0)::DOUBLE, 0)::BIGINT AS rounded FROM (SELECT lang, sum(length(text)) AS chars, sum(len({words('text')})) AS words FROM documents GROUP BY lang)",
        "parameter_counts": f"""SELECT *, layers * block_per_layer + embedding + hidden + output_head AS total FROM (SELECT *, layers * block_per_layer AS transformer_total FROM (
SELECT *, attention_per_layer + mlp_per_layer + 2 * hidden + qk_norm_per_layer AS block_per_layer FROM (
SELECT hidden::BIGINT AS hidden, layers::BIGINT AS layers, (2 * hidden * hidden + 2 * hidden * kv_heads * head_dim)::BIGINT AS attention_per_layer, (3 * hidden * inner_size)::BIGINT AS mlp_per_layer, (CASE WHEN qk_norm THEN hidden + kv_heads * head_dim ELSE 0 END)::BIGINT AS qk_norm_per_layer,
  (vocab * hidden)::BIGINT AS embedding, (CASE WHEN tied THEN 0 ELSE vocab * hidden END)::BIGINT AS output_head FROM {PARAMETERS})))""",
        "line_quality_counts": f"WITH {LINES} SELECT {QUALITY} AS passes, count(*) AS n FROM lines GROUP BY 1",
        "raw_line_quality": f"WITH {LINES} SELECT (length({strip('raw')}) >= 30 AND {unique_ratio(words('raw'))} >= 0.3) AS passes, count(*) AS n FROM raw_lines WHERE raw <> '' GROUP BY 1",
        "document_length_window": f"SELECT doc_id, length(t)::BIGINT AS n FROM (SELECT doc_id, {normalized('text')} AS t FROM documents) WHERE length(t) BETWEEN 40 AND 8000",
        "script_ratio_filter": f"SELECT lang, count(*) AS n FROM documents WHERE {script_ratio('text', LATIN)} >= 0.95 GROUP BY lang",
        "heading_and_fallback": "SELECT (coalesce(nullif(CASE WHEN turn % 3 = 0 THEN '' WHEN turn % 3 = 1 THEN text END, ''), nullif(role, '')) IN ('user', 'assistant', 'system')) AS fell_back, count(*) AS n FROM conversations WHERE NOT starts_with(text, '=') GROUP BY 1",
        "idempotency_check": f"SELECT count(*) AS checked, count(*) FILTER (WHERE {normalized('text')} <> text) AS mismatches FROM (SELECT text FROM documents WHERE {strip('text')} <> '' ORDER BY doc_id LIMIT 500)",
        "normalization_reasons": f"""WITH t AS (SELECT doc_id, text, [CASE WHEN nfc_normalize(text) <> text THEN 'nfkc' END, CASE WHEN contains(text, {TATWEEL}) THEN 'tatweel' END, CASE WHEN regexp_matches(text, '{DIACRITIC}') THEN 'diacritics' END, CASE WHEN {tidy("text")} <> text THEN 'whitespace' END] AS rs FROM documents WHERE {strip("text")} <> ''),
u AS (SELECT doc_id, substr(text, 1, 70) AS head, unnest(rs) AS reason FROM t)
SELECT r.reason, count(u.doc_id) AS n, arg_min(u.head, u.doc_id) AS example FROM (VALUES ('nfkc'), ('tatweel'), ('diacritics'), ('whitespace')) AS r(reason) LEFT JOIN u USING (reason) GROUP BY r.reason""",
        "normalization_totals": f"SELECT samples, changed, samples - changed AS unchanged, {ratio('changed', 'samples')} AS changed_rate FROM (SELECT count(*) AS samples, count(*) FILTER (WHERE {normalized('text')} <> text) AS changed FROM documents WHERE {strip('text')} <> '')",
        "exact_dedup_docs": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text",
        "exact_dedup_lines": f"WITH {LINES} SELECT doc_id, pos::BIGINT AS pos FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS r FROM lines) WHERE r = 1",
        "duplicate_rate_by_source": f"SELECT source, n, n - d AS duplicates, {ratio('n - d', 'n')} AS rate FROM (SELECT source, count(*) AS n, count(DISTINCT text) AS d FROM documents GROUP BY source)",
        "cross_category_dedup": f"WITH {LINES}, placed AS (SELECT *, CASE lang WHEN 'fr' THEN 0 WHEN 'en' THEN 1 ELSE 2 END AS place FROM lines) SELECT lang, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY place, doc_id, pos) AS r FROM placed) WHERE r = 1 GROUP BY lang",
        "dedup_across_runs": "SELECT min(doc_id) AS doc_id FROM documents WHERE doc_id % 2 = 1 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0) GROUP BY text",
        "duplicate_keys": "SELECT doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY n_chars ORDER BY doc_id) AS r FROM documents) WHERE r > 1",
        "decontaminate_lines": f"WITH {EVAL} SELECT doc_id, count(*) AS kept FROM lines WHERE line NOT IN (SELECT line FROM blocked) GROUP BY doc_id",
        "train_overlap": f"WITH s AS (SELECT doc_id, {tidy('replace(text, chr(10), chr(32))')} AS t FROM documents) SELECT doc_id FROM s WHERE doc_id % 10 = 0 AND t NOT IN (SELECT t FROM s WHERE doc_id % 10 <> 0)",
        "distinct_digests": f"WITH {EVAL} SELECT count(*) AS n FROM (SELECT line FROM blocked UNION SELECT line FROM lines)",
        "category_union": "SELECT lang, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM (SELECT doc_id, lang FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, lang FROM documents WHERE lang = 'fr') GROUP BY lang",
        "verdict_counters": f"WITH {JUDGED} SELECT {VERDICTS} FROM judged",
        "verdict_counters_by_source": f"WITH {JUDGED} SELECT source, verdict, count(*) AS n FROM judged GROUP BY source, verdict",
        "accept_until_target_exact": f"WITH {JUDGED} SELECT {VERDICTS} FROM summed WHERE (SELECT max(so_far) FROM summed) < 2000 OR (doc_id, pos) <= (SELECT (doc_id, pos) FROM summed WHERE so_far = 2000 AND verdict = 'accepted')",
        "accept_until_target_row": f"WITH {JUDGED} SELECT {VERDICTS} FROM summed WHERE doc_id <= coalesce((SELECT min(doc_id) FROM summed WHERE so_far >= 2000), 9223372036854775807)",
        "document_build": f"""WITH t AS (SELECT doc_id, {normalized("text")} AS t FROM documents), j AS (SELECT *, length(t) BETWEEN 40 AND 8000 AS q, t IN (SELECT t FROM t WHERE doc_id % 50 = 7) AS e FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY t, q AND NOT e ORDER BY doc_id) AS r FROM j)
SELECT count(*) FILTER (WHERE q AND NOT e AND r = 1) AS accepted, count(*) FILTER (WHERE q AND (e OR r > 1)) AS duplicates_or_eval, count(*) FILTER (WHERE NOT q) AS invalid_length_or_type FROM r""",
        "first_of_category": "(SELECT doc_id, lang FROM documents WHERE lang = 'de' ORDER BY doc_id LIMIT 25) UNION ALL (SELECT doc_id, lang FROM documents WHERE lang = 'es' ORDER BY doc_id LIMIT 25)",
        "chunk_documents": f"WITH c AS (SELECT doc_id, {chunked('text', 1000)} AS cs FROM documents) SELECT doc_id, pos::BIGINT AS pos, length(chunk)::BIGINT AS n, sha256(chunk) AS sha FROM (SELECT doc_id, generate_subscripts(cs, 1) - 1 AS pos, unnest(cs) AS chunk FROM c)",
        "chunk_documents_cumulative": f"WITH c AS (SELECT doc_id, {chunked('text', 8000, True)} AS cs FROM documents) SELECT doc_id, pos::BIGINT AS pos, length(chunk)::BIGINT AS n FROM (SELECT doc_id, generate_subscripts(cs, 1) - 1 AS pos, unnest(cs) AS chunk FROM c)",
        "heldout_build": f"""WITH t AS (SELECT doc_id, {normalized("text")} AS t FROM documents), c AS (SELECT doc_id, {chunked("t", 8000)} AS cs FROM t),
p AS (SELECT doc_id, generate_subscripts(cs, 1) AS pos, unnest(cs) AS chunk FROM c), held AS (SELECT *, chunk IN (SELECT chunk FROM p WHERE doc_id % 10 <> 0) AS seen FROM p WHERE doc_id % 10 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk, seen ORDER BY doc_id, pos) AS r FROM held)
SELECT count(*) FILTER (WHERE NOT seen AND r = 1) AS accepted, count(*) FILTER (WHERE NOT seen AND r > 1) AS duplicate, count(*) FILTER (WHERE seen) AS train_overlap FROM r""",
        "heldout_build_limited": f"""WITH t AS (SELECT doc_id, {normalized("text")} AS t FROM documents), c AS (SELECT doc_id, {chunked("t", 8000)} AS cs FROM t),
p AS (SELECT doc_id, generate_subscripts(cs, 1) AS pos, unnest(cs) AS chunk FROM c), held AS (SELECT *, chunk IN (SELECT chunk FROM p WHERE doc_id % 10 <> 0) AS seen FROM p WHERE doc_id % 10 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk, seen ORDER BY doc_id, pos) AS r FROM held),
s AS (SELECT *, sum(CASE WHEN NOT seen AND r = 1 THEN 1 ELSE 0 END) OVER (ORDER BY doc_id, pos) AS so_far FROM r)
SELECT count(*) FILTER (WHERE NOT seen AND r = 1) AS accepted, count(*) FILTER (WHERE NOT seen AND r > 1) AS duplicate, count(*) FILTER (WHERE seen) AS train_overlap FROM s WHERE so_far < 50 OR so_far = 50 AND NOT seen AND r = 1""",
        "token_windows": """WITH s AS (SELECT w, (w * 2654435761 + 12345) % ((SELECT count(*) FROM documents) - 16) AS start FROM range(64) AS t(w)),
d AS (SELECT w, doc_id - start AS k, n_chars FROM s JOIN documents ON doc_id BETWEEN start AND start + 16)
SELECT w AS window, string_agg(n_chars::VARCHAR, ',' ORDER BY k) FILTER (WHERE k < 16) AS x, string_agg(n_chars::VARCHAR, ',' ORDER BY k) FILTER (WHERE k > 0) AS y FROM d GROUP BY w""",
        "byte_budget_sample": f"WITH {LINES} SELECT count(*) AS n, sum({BYTES})::BIGINT AS bytes FROM (SELECT *, sum({BYTES}) OVER (ORDER BY doc_id, pos) AS b FROM lines) WHERE b <= 200000",
        "tail_lines": f"WITH {LINES}, s AS (SELECT *, sum({BYTES}) OVER (ORDER BY doc_id, pos) AS b FROM lines) SELECT doc_id, pos::BIGINT AS pos FROM s WHERE b - {BYTES} > (SELECT max(b) FROM s) - 50000 ORDER BY doc_id, pos LIMIT 40",
        "proportional_sample": f"""WITH {LINES}, s AS (SELECT *, sum({BYTES}) OVER (PARTITION BY lang ORDER BY doc_id, pos) AS b, sum({BYTES}) OVER (PARTITION BY lang) AS size, sum({BYTES}) OVER () AS total FROM lines)
SELECT lang, count(*) AS n, sum({BYTES})::BIGINT AS bytes FROM s WHERE b <= 300000 * size // total GROUP BY lang""",
        "train_val_split": "SELECT split, count(*) AS n, sum(n_chars)::BIGINT AS chars, min(doc_id) AS first_id FROM (SELECT *, CASE WHEN row_number() OVER (ORDER BY doc_id) <= floor((SELECT count(*) FROM documents) * 0.95) THEN 'train' ELSE 'validation' END AS split FROM documents) GROUP BY split",
        "shard_manifest": f"""WITH {LINES} SELECT shard, count(*) AS line_count, sum(length(line))::BIGINT AS char_count, sum({BYTES})::BIGINT AS bytes, sha256(string_agg(line, chr(10) ORDER BY doc_id, pos) || chr(10)) AS sha256
FROM (SELECT *, (row_number() OVER (ORDER BY doc_id, pos) - 1) // 1000 AS shard FROM lines) GROUP BY shard""",
        "running_totals": "SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id)::BIGINT AS chars_so_far FROM documents",
        "text_profile_by_lang": f"""WITH {LINES}, texts AS (SELECT lang AS g, line AS t, length(line) AS n_chars FROM lines), {PROFILE}
SELECT g AS lang, lines, {ratio("chars", "lines")} AS mean_len, min_len, p50 AS p50_len, p90 AS p90_len, max_len, chars::BIGINT AS chars, {ratio("script_chars", "chars")} AS script_character_ratio, words::BIGINT AS words, unique_words, {ratio("unique_words", "words")} AS unique_word_ratio,
  lines - distinct_lines AS duplicate_lines, {ratio("lines - distinct_lines", "lines")} AS duplicate_rate, 0::BIGINT AS invalid_utf8, odd::BIGINT AS whitespace_anomalies
FROM profiled JOIN vocabulary USING (g) JOIN {ranks("texts", "g", "n_chars")} USING (g)""",
        "profile_status": "SELECT source, count(*) - count(DISTINCT text) AS duplicate_lines, CASE WHEN count(*) = count(DISTINCT text) THEN 'PASS' ELSE 'FAIL' END AS status FROM documents GROUP BY source",
        "length_percentiles": f"SELECT lang, p50, p90 FROM {ranks('documents', 'lang', 'n_chars')}",
        "source_balance": f"SELECT source, bytes::BIGINT AS bytes, {ratio('bytes', '(SELECT sum(strlen(text)) FROM documents)')} AS share FROM (SELECT source, sum(strlen(text)) AS bytes FROM documents GROUP BY source)",
        "language_ratio": f"SELECT {ratio('a', 't')} AS en_share, {ratio('b', 't')} AS fr_share, {ratio('a', 'b')} AS ratio FROM (SELECT sum(strlen(text)) FILTER (WHERE lang = 'en') AS a, sum(strlen(text)) FILTER (WHERE lang = 'fr') AS b, sum(strlen(text)) AS t FROM documents)",
        "category_manifest": f"""WITH {LINES}, c AS (SELECT {language("line")} AS category, count(*) AS line_count, sum(len({words("line")}))::BIGINT AS word_count, sum(length(line))::BIGINT AS char_count, sum({BYTES})::BIGINT AS bytes FROM lines GROUP BY 1)
SELECT g.category, coalesce(line_count, 0) AS line_count, coalesce(word_count, 0) AS word_count, coalesce(char_count, 0) AS char_count, coalesce(bytes, 0) AS bytes FROM (VALUES ('ar'), ('en'), ('mixed'), ('other')) AS g(category) LEFT JOIN c USING (category)""",
        "manifest_comparison": "SELECT 'de' AS lang, 'line_count' AS \"column\", count(*)::VARCHAR AS expected, (count(*) + 1)::VARCHAR AS actual FROM documents WHERE lang = 'de' UNION ALL SELECT 'es', 'present', 'true', NULL",
        "metrics_side_by_side": "SELECT lang, count(*) FILTER (WHERE doc_id % 2 = 0) AS old_docs, sum(n_chars) FILTER (WHERE doc_id % 2 = 0)::BIGINT AS old_chars, count(*) FILTER (WHERE doc_id % 2 = 1) AS new_docs, sum(n_chars) FILTER (WHERE doc_id % 2 = 1)::BIGINT AS new_chars FROM documents GROUP BY lang",
        "contamination_report": f"WITH {JUDGED}, c AS (SELECT {VERDICTS} FROM judged) SELECT 0::BIGINT AS train_overlap_rejected, eval AS eval_overlap_rejected, 0::BIGINT AS train_hashes_checked, duplicate AS dup_rejected, eval AS contamination_count, accepted AS heldout_lines_final FROM c",
        "worst_lines": f"WITH {LINES} SELECT doc_id, pos::BIGINT AS pos, {ratio('length(line)', 'len(' + words('line') + ')')} AS score, substr(line, 1, 80) AS head FROM lines ORDER BY score DESC, doc_id, pos LIMIT 5",
        "registry_gate": f"WITH {REGISTRY_PROBLEMS} SELECT label, problem FROM problems",
        "registry_split": f"SELECT string_agg(source_id, ',' ORDER BY source_id) FILTER (WHERE status = 'approved') AS approved, string_agg(source_id, ',' ORDER BY source_id) FILTER (WHERE status IN ('conditional_review', 'pending_provenance', 'rejected')) AS not_ingestable FROM {REGISTRY_ROWS}",
        "ingest_permission": f"SELECT source_id, source_id IN (SELECT source_id FROM {REGISTRY_ROWS} WHERE status = 'approved') AND source_id IN ('web_a', 'old_e') AS granted FROM (VALUES ('web_a'), ('wiki_b'), ('old_e'), ('gone')) AS a(source_id)",
        "license_rules": f"SELECT line_no::BIGINT AS line_no, {ALLOWED} AS allowed, {FORBIDDEN} AS forbidden FROM {REGISTRY_ROWS}",
        "taxonomy_gate": taxonomy_sql(),
        "taxonomy_size": f"SELECT {len(DOMAINS)}::BIGINT AS domains, {sum(len(ss) for _, _, ss in DOMAINS)}::BIGINT AS subdomains",
        "pilot_gate": pilot_sql(),
        "gate_status": f"WITH {REGISTRY_PROBLEMS} SELECT count(*) AS problems, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM problems",
        "role_balance": f"SELECT role, bytes::BIGINT AS bytes, {ratio('bytes', '(SELECT sum(strlen(text)) FROM conversations)')} AS share FROM (SELECT role, sum(strlen(text)) AS bytes FROM conversations GROUP BY role)",
        "conversation_stats": f"SELECT conv_id, count(*) AS turns, sum(len({words('text')}))::BIGINT AS words FROM conversations GROUP BY conv_id",
        "label_join_quality": "SELECT quality, toxic, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY quality, toxic",
        "html_text_lines": rf"SELECT page_id, count(*) AS n_lines FROM (SELECT page_id, unnest(string_split(regexp_replace(regexp_replace(html, '<script>[^<]*</script>|<style>[^<]*</style>', ' ', 'g'), '<[^>]*>', chr(10), 'g'), chr(10))) AS l FROM pages) WHERE {strip('l')} <> '' GROUP BY page_id",
        "incremental_dedup": f"WITH {LINES}, d AS (SELECT DISTINCT line FROM lines WHERE {QUALITY}) SELECT count(*) AS n, sum(length(line))::BIGINT AS chars FROM d",
    }
