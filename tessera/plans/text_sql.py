"""DuckDB SQL of the text operators: claims and their gate, sections of made-up reports, chunks, HTML."""

from __future__ import annotations

from ..operators.claims import CURRENCIES, MINUS_SIGNS, NEGATING, PERCENT, SCALE_WORDS
from ..operators.sections import MIN_CHARS, PAGES, POINTER

SPACE = r"[ \t\n\x0B\f\r]"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_RUN = "[0-9]+(?:[.,][0-9]+)*"
_MINUS = "[" + "".join("\\-" if s == "-" else s for s in MINUS_SIGNS) + "]"
_MONEY = "[" + "".join(CURRENCIES) + "]"
_OPENING = rf"(?:^|[^\p{{L}}\p{{N}}_.])(\(?(?:{_MINUS}[ \t]?)?(?:{_MONEY}[ \t]?)?(?:{_MINUS}[ \t]?)?)$"
_SCALE = rf"(?i)^({SPACE}*(?:{'|'.join([*SCALE_WORDS, *PERCENT])}))(?:[^\p{{L}}\p{{N}}_]|$)"
_FACTOR = "CASE scale_word " + " ".join(f"WHEN '{w}' THEN {f}" for w, f in SCALE_WORDS.items()) + " ELSE 1.0 END"
_PER_CENT = ", ".join(f"'{p}'" for p in PERCENT)

#: Ends in `claims`: doc_id, k (sentence), raw, value, is_percentage, start, end, opens, closes.
CLAIMS_SQL = rf"""cut AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])({SPACE})', '\1' || chr(1) || '\2', 'g'), chr(1)) AS parts FROM documents),
sentences AS (SELECT doc_id, k, body, (sum(length(body)) OVER (PARTITION BY doc_id ORDER BY k) - length(body))::BIGINT AS spot FROM (SELECT doc_id, unnest(parts) AS body, unnest(range(len(parts))) AS k FROM cut)),
found AS (SELECT doc_id, k, spot, length(body) AS size, regexp_extract_all(body, '{_RUN}') AS runs, string_split_regex(body, '{_RUN}') AS gaps FROM sentences WHERE regexp_matches(body, '[0-9]')),
runs AS (SELECT *, sum(length(gap)) OVER w + sum(length(run)) OVER w - length(run) AS place FROM (SELECT doc_id, k, spot, size, unnest(runs) AS run, unnest(range(len(runs))) AS i, unnest(gaps[:-2]) AS gap, unnest(gaps[2:]) AS behind, len(runs) AS n FROM found)
    WINDOW w AS (PARTITION BY doc_id, k ORDER BY i)),
lined AS (SELECT *, CASE WHEN i > 0 THEN '0' ELSE '' END || gap AS before, behind || CASE WHEN i < n - 1 THEN '0' ELSE '' END AS rest,
    max(CASE WHEN contains(gap, chr(10)) THEN place - length(string_split(gap, chr(10))[-1]) END) OVER (PARTITION BY doc_id, k ORDER BY i) AS line FROM runs),
whole AS (SELECT *, CASE WHEN regexp_matches(run, '^[0-9]{{1,3}}(?:,[0-9]{{3}})+(?:[.,]|$)') THEN regexp_extract(run, '^([0-9]{{1,3}}(?:,[0-9]{{3}})+)(?:[.,]|$)', 1) ELSE regexp_extract(run, '^[0-9]+') END AS whole FROM lined WHERE regexp_matches(before, '{_OPENING}')),
parted AS (SELECT *, regexp_extract(run[length(whole) + 1:], '^\.[0-9]+') AS part, regexp_extract(before, '{_OPENING}', 1) AS opening FROM whole),
tailed AS (SELECT *, run[length(whole) + length(part) + 1:] || rest AS tail FROM parted),
scaled AS (SELECT *, regexp_extract(tail, '{_SCALE}', 1) AS scale FROM tailed),
glued AS (SELECT *, scale = '' AND regexp_matches(tail, '^[\p{{L}}\p{{N}}_]') AS glued, regexp_extract(tail[length(scale) + 1:], '^({SPACE}*\))(?:[^\p{{L}}\p{{N}}_]|$)', 1) AS closing FROM scaled),
numbers AS (SELECT *, CASE WHEN glued THEN whole ELSE whole || part END AS number, CASE WHEN glued THEN '' ELSE closing END AS shut, lower(trim(scale, {_BLANKS})) AS scale_word FROM glued WHERE NOT glued OR part <> ''),
valued AS (SELECT *, replace(number, ',', '')::DOUBLE AS size_, opening[1] = '(' AND shut <> '' AS bracketed FROM numbers),
kept AS (SELECT *, CASE WHEN bracketed THEN opening ELSE ltrim(opening, '(') END AS lead FROM valued
    WHERE regexp_matches(opening, '{_MONEY}') OR scale <> '' OR NOT (regexp_matches(number, '^[0-9]{{1,3}}$') OR (size_ = floor(size_) AND size_ BETWEEN 1900 AND 2100))),
claims AS (SELECT doc_id, k, lead || number || scale || CASE WHEN bracketed THEN shut ELSE '' END AS raw,
    size_ * {_FACTOR} * CASE WHEN bracketed OR regexp_matches(opening, '{_MINUS}') OR regexp_matches(before[:length(before) - length(opening)], '(?i)(?:{'|'.join(NEGATING)})[^\p{{L}}\p{{N}}_]{{0,4}}$') THEN -1 ELSE 1 END AS value,
    scale_word IN ({_PER_CENT}) AS is_percentage, (spot + place - length(lead))::INTEGER AS start, (spot + coalesce(line, 0))::INTEGER AS opens, (spot + size)::INTEGER AS closes FROM kept),
"""

#: Ends in `gated`: doc_id and the measures of the gate. The figures of `held` (doc_id, value) are verified.
GATE_SQL = rf"""judged AS (SELECT c.*, CASE WHEN NOT is_percentage THEN EXISTS (SELECT 1 FROM held h, (SELECT unnest([1.0, 1e3, 1e6, 1e9]) AS f) WHERE h.doc_id = c.doc_id AND h.value <> 0 AND abs(c.value * f - h.value) / abs(h.value) <= 0.01) END AS ok FROM claims c),
counts AS (SELECT doc_id, count(*) AS n, count(ok) AS checked, count(*) FILTER (NOT ok) AS bad FROM judged GROUP BY doc_id),
firsts AS (SELECT doc_id, k, min(opens) AS first FROM judged WHERE NOT ok GROUP BY ALL),
shown AS (SELECT s.doc_id, string_agg(CASE WHEN first IS NULL THEN body ELSE body[:first - spot] END, '' ORDER BY s.k) AS text FROM sentences s LEFT JOIN firsts USING (doc_id, k) GROUP BY s.doc_id),
gated AS (SELECT d.doc_id, coalesce(n, 0)::INTEGER AS n_claims, coalesce(checked, 0)::INTEGER AS n_checked, coalesce(bad, 0)::INTEGER AS n_unsupported, round((checked - bad) / nullif(checked, 0), 3) AS support_rate,
    d.text AS before_, CASE WHEN coalesce(bad, 0) = 0 THEN d.text ELSE trim(s.text, {_BLANKS}) END AS after_ FROM documents d LEFT JOIN counts USING (doc_id) LEFT JOIN shown s USING (doc_id)),
measured AS (SELECT *, len(list_filter(string_split_regex(before_, '{SPACE}+'), lambda w: w <> ''))::INTEGER AS words_before, len(list_filter(string_split_regex(after_, '{SPACE}+'), lambda w: w <> ''))::INTEGER AS words_after,
    (length(before_) - length(replace(before_, '.', '')) - length(after_) + length(replace(after_, '.', '')))::INTEGER AS sentences_removed FROM gated)
"""

_STAND = f"' >|' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LEAST = " ".join(f"WHEN '{i}' THEN floor(least(3.0, greatest(0.5, length(whole) / 250000)) * {n})" for i, n in MIN_CHARS.items())

#: Sections of reports that hold their five headings in order and no title.
SECTIONS_SQL = rf"""parts AS (SELECT source || '-' || (spot // 5)::VARCHAR AS accession, spot % 5 AS place, text FROM (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS spot FROM documents)),
pieces AS (SELECT accession, place, ['1', '1A', '7', '7A', '8'][place + 1] AS item, 'Item ' || ['1', '1A', '7', '7A', '8'][place + 1] || '. Part' || chr(10) || repeat(text || chr(10) || chr(10), 12) AS piece FROM parts),
reports AS (SELECT accession, string_agg(piece, '' ORDER BY place) AS whole FROM pieces GROUP BY accession),
heads AS (SELECT accession, place, item, coalesce(string_agg(piece, '') OVER (PARTITION BY accession ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS above FROM pieces),
starts AS (SELECT accession, place, item, CASE WHEN above = '' THEN 0 ELSE length(rtrim(above, {_STAND})) + instr(above[length(rtrim(above, {_STAND})) + 1:], chr(10)) END AS start FROM heads),
ends AS (SELECT s.*, whole, coalesce(lead(start) OVER (PARTITION BY accession ORDER BY place), length(whole)) AS finish FROM starts s JOIN reports USING (accession)),
bodies AS (SELECT accession, item, start, finish, whole, trim(whole[start + 1:finish], {_BLANKS}) AS body FROM ends),
sized AS (SELECT *, len(string_split_regex(body, '{SPACE}+')) AS n_words, CASE WHEN contains(body, chr(10)) THEN body[instr(body, chr(10)) + 1:] ELSE body END AS below FROM bodies WHERE length(body) >= CASE item {_LEAST} END),
sections AS (SELECT accession, item, start::INTEGER AS char_start, finish::INTEGER AS char_end, n_words::INTEGER AS n_tokens, body, length(whole) AS n_chars FROM sized
    WHERE NOT (n_words <= 150 AND regexp_matches(below, '{POINTER}') AND (regexp_matches(below, '{PAGES}') OR len(list_filter(string_split_regex(below, '{SPACE}+'), lambda w: w <> '')) < 120)))
"""

#: Chunks of texts without tables: the packing, block by block, as a recursion over all texts at once.
CHUNKS_SQL = rf"""texts AS (SELECT doc_id::VARCHAR AS accession, lang, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents),
split AS (SELECT accession, string_split_regex(text, '\n{SPACE}*\n') AS bodies, regexp_extract_all(text, '\n{SPACE}*\n') AS gaps FROM texts),
paragraphs AS (SELECT accession, i, body, (coalesce(sum(length(body) + length(coalesce(gap, ''))) OVER (PARTITION BY accession ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS spot
    FROM (SELECT accession, unnest(bodies) AS body, unnest(list_resize(gaps, len(bodies))) AS gap, unnest(range(len(bodies))) AS i FROM split)),
blocks AS (SELECT accession, row_number() OVER (PARTITION BY accession ORDER BY i) - 1 AS k, trim(body, {_BLANKS}) AS body, spot + length(body) - length(ltrim(body, {_BLANKS})) AS start,
    regexp_full_match(trim(body, {_BLANKS}), '[A-Z][^\n]{{10,120}}[.:]?') AS heading, floor(len(string_split_regex(trim(body, {_BLANKS}), '{SPACE}+')) * 1.33)::BIGINT AS tokens FROM paragraphs WHERE trim(body, {_BLANKS}) <> ''),
upto AS (SELECT accession, k, heading, tokens, sum(tokens) OVER (PARTITION BY accession ORDER BY k)::BIGINT AS total FROM blocks),
sums AS (SELECT accession, [0::BIGINT] || list(total ORDER BY k) AS s, list(heading ORDER BY k) AS h, count(*) AS n FROM upto GROUP BY accession),
RECURSIVE_steps
taken AS (SELECT accession, unnest(out, recursive := true) FROM steps WHERE len(out) > 0),
runs AS (SELECT accession, a, z, row_number() OVER (PARTITION BY accession ORDER BY z, a) AS r, count(*) OVER (PARTITION BY accession) AS n FROM (SELECT accession, a, z FROM taken UNION ALL SELECT accession, a, n AS z FROM steps WHERE j = n AND fresh < n)),
made AS (SELECT r.accession, r, r.n, min(b.start) AS first, max_by(b.start + length(b.body), b.k) AS last, string_agg(b.body, chr(10) || chr(10) ORDER BY b.k) AS raw, any_value(upper(lang) || ' | FY2024 | Item 1A | Risk Factors') AS prefix
    FROM runs r JOIN blocks b ON b.accession = r.accession AND b.k >= r.a AND b.k < r.z JOIN texts t ON t.accession = r.accession GROUP BY ALL),
counted AS (SELECT *, floor(len(string_split_regex(prefix || ' ' || raw, '{SPACE}+')) * 1.33) < 25 AND r = n AND n > 1 AS runt FROM made),
joined AS (SELECT c.accession, c.r, c.first, coalesce(x.last, c.last) AS last, c.prefix || chr(10) || chr(10) || c.raw || coalesce(chr(10) || chr(10) || x.raw, '') AS text
    FROM counted c LEFT JOIN counted x ON x.accession = c.accession AND x.r = c.r + 1 AND x.runt WHERE NOT c.runt)
SELECT substr(sha1(accession || ':1A:' || (r - 1)::VARCHAR), 1, 16) AS chunk_id, accession, (r - 1)::INTEGER AS chunk_index, floor(len(string_split_regex(text, '{SPACE}+')) * 1.33)::INTEGER AS n_tokens, false AS has_table,
    first::INTEGER AS char_start, last::INTEGER AS char_end, md5(text) AS digest FROM joined
"""
_CARRY = "greatest({a}, len(list_filter(s[:j + 1], lambda x: x <= s[j + 1] - 60)) - 1)"
_FULL = "s[j + 2] - s[{a} + 1] > 450"
_STEPS = f"""steps(accession, j, a, fresh, out, n) AS (
    SELECT accession, 0::BIGINT, 0::BIGINT, 0::BIGINT, []::STRUCT(a BIGINT, z BIGINT)[], n FROM sums
    UNION ALL SELECT accession, j + 1, CASE WHEN late THEN greatest(a2, len(list_filter(s[:j + 2], lambda x: x <= s[j + 2] - 60)) - 1) ELSE a2 END, CASE WHEN late THEN j + 1 WHEN cut1 OR cut2 THEN j ELSE fresh END,
        CASE WHEN (cut1 OR cut2) AND fresh < j THEN [{{'a': a, 'z': j}}] ELSE [] END || CASE WHEN late THEN [{{'a': a2, 'z': j + 1}}] ELSE [] END, n
    FROM (SELECT *, s[j + 2] - s[a2 + 1] >= 700 AS late FROM (SELECT *, CASE WHEN cut2 THEN {_CARRY.format(a="a1")} ELSE a1 END AS a2 FROM (SELECT *, a1 < j AND {_FULL.format(a="a1")} AS cut2
        FROM (SELECT *, CASE WHEN cut1 THEN {_CARRY.format(a="a")} ELSE a END AS a1 FROM (SELECT t.*, s.s, s.h[j + 1] AND s.s[j + 1] - s.s[a + 1] > 270 AS cut1 FROM steps t JOIN sums s USING (accession) WHERE j < t.n))))))
,"""
CHUNKS_SQL = "WITH RECURSIVE " + CHUNKS_SQL.replace("RECURSIVE_steps", _STEPS.strip())

_BREAKS = "p|div|br|tr|li|h[1-6]|section|article|header|footer|table|thead|tbody|hr|blockquote|dd|dt|figcaption"
_ENTITIES = (("&nbsp;", "chr(160)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "''''"), ("&copy;", "'©'"), ("&middot;", "'·'"), ("&amp;", "'&'"))


def _unescaped(x: str) -> str:
    for name, plain in _ENTITIES:
        x = f"replace({x}, '{name}', {plain})"
    return x


#: Text of well-formed pages without tables, by replacement.
HTML_SQL = rf"""WITH bare AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<head\b.*?</head\s*>|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>', '', 'g') AS t FROM pages),
plain AS (SELECT page_id, {_unescaped(_unescaped(f"regexp_replace(regexp_replace(t, '(?i)</?(?:{_BREAKS})(?:[ /][^>]*)?>', chr(10), 'g'), '(?s)<[^>]+>', '', 'g')"))} AS t FROM bare),
tidy AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(translate(t, chr(160) || chr(8199) || chr(8239) || chr(8201) || chr(8202) || chr(8203) || chr(65279), '       '), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), {_BLANKS}) AS t FROM plain)
SELECT page_id, 0::INTEGER AS n_tables, len(list_filter(string_split_regex(t, '{SPACE}+'), lambda w: w <> ''))::INTEGER AS n_words, 'dom' AS parser_used, md5(t) AS digest FROM tidy"""
