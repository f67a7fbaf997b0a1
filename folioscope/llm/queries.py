"""The queries of this package and their SQL, for __spark_entry__.py."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, ctw, cws, decontaminate, html_crf, jaccard_join, langid, lexical, packing, phrases, quality, quality_rules, token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ctw_score": ctw.op1_ctw_score,
    "op2_language_id": langid.op2_language_id,
    "op3_chat_format": chat.op3_chat_format,
    "op4_html_main_text": html_crf.op4_html_main_text,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_packing": packing.op6_packing,
    "op8_fingerprints": cws.op8_fingerprints,
    "op9_quality": quality.op9_quality,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op7_token_counts": token_files.op7_token_counts,
    "op11_lexical_search": lexical.op11_lexical_search,
    "op12_quality_rules": quality_rules.op12_quality_rules,
    "op13_phrases": phrases.op13_phrases,
}

#: A-Z in lower case, then words between blanks and 0x09-0x0D.
_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
#: A-Z in lower case of a text that may be null.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
_TOKENS = "regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+|[!-/:-@\\[-`{-~]+')"
_BUCKETS, _PAIR = quality_rules.BUCKETS, quality_rules.PAIR
_ESCAPED = "'" + "|".join(re.escape(c) for c in sorted((*chat.CONTROLS, chat.ESCAPE), key=len, reverse=True)) + "'"

ORACLE_SQL: dict[str, str] = {
    "op3_chat_format": f"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
said AS (SELECT conv_id, count(*) AS n_turns, string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text) AS all_text,
coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
CAST(sum(length(regexp_replace(role, {_ESCAPED}, 'xx', 'g')) + length(regexp_replace(text, {_ESCAPED}, 'xx', 'g')) + {len("<|turn|>") + 1 + len("<|end|>") + 1}) AS BIGINT) AS formatted_chars FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(all_text) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, false AS rewrites FROM said""",
    "op5_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS l FROM documents),
grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) >= 4 THEN list_transform(range(1, len(l) - 2), lambda i: concat_ws(' ', l[i], l[i + 1], l[i + 2], l[i + 3])) WHEN len(l) > 0 THEN [array_to_string(l, ' ')] ELSE [] END) AS g FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * o >= 85 * (s.n + t.n - o)),
steps AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, steps.y FROM reach JOIN steps ON reach.r = steps.x)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r) AS component_id FROM documents d JOIN reach USING (doc_id) LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id""",
    # items of five words and more, which all of the table's are; every window of a document that shares a shingle with an item
    "op10_decontaminate": """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS l FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS l FROM benchmark),
wg AS (SELECT doc_id, unnest(range(len(l) - 4)) AS pos, unnest(list_transform(range(1, len(l) - 3), lambda k: array_to_string(l[k : k + 4], ' '))) AS g FROM w WHERE len(l) >= 5),
ig AS (SELECT item_id, unnest(range(len(l) - 4)) AS pos, unnest(list_transform(range(1, len(l) - 3), lambda k: array_to_string(l[k : k + 4], ' '))) AS g FROM i),
shares AS (SELECT DISTINCT doc_id, item_id FROM wg JOIN ig USING (g)),
windows AS (SELECT doc_id, item_id, len(i.l) AS n_words, unnest(range(greatest(1, len(w.l) - len(i.l) + 1))) AS place FROM shares JOIN w USING (doc_id) JOIN i USING (item_id)),
cut AS (SELECT v.*, w.l[place + 1 : place + n_words] AS l FROM windows v JOIN w USING (doc_id)),
own AS (SELECT doc_id, item_id, place, n_words, g, count(*) AS n FROM (SELECT doc_id, item_id, place, n_words, unnest(list_transform(range(1, len(l) - 3), lambda k: array_to_string(l[k : k + 4], ' '))) AS g FROM cut) GROUP BY ALL),
theirs AS (SELECT item_id, g, count(*) AS m FROM ig GROUP BY ALL),
scored AS (SELECT doc_id, item_id, place, n_words, sum(least(n, coalesce(m, 0))) AS common, sum(n) AS n FROM own LEFT JOIN theirs USING (item_id, g) GROUP BY ALL),
rated AS (SELECT *, CAST(common AS DOUBLE) / CAST(n + (n_words - 4) - common AS DOUBLE) AS similarity FROM scored)
SELECT doc_id, item_id, place AS start_word, n_words, similarity FROM rated WHERE similarity >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, place) = 1""",
    "op11_lexical_search": f"""WITH t AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY doc_id), s AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM d),
i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT item_id, term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) AS w FROM i JOIN f USING (term), s),
scored AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nn) // ll)))) AS BIGINT) AS score FROM w JOIN p USING (term) JOIN d USING (doc_id), s GROUP BY ALL),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
    # up to the bound on trusted rows, which the table is below
    "op12_quality_rules": f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS l FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(l) - 3)) AS p, unnest(list_transform(range(1, len(l) - 3), lambda k: array_to_string(l[k : k + 4], ' '))) AS g FROM w WHERE len(l) >= 5),
repeated AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM repeated, range(5) AS r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
tokens AS (SELECT doc_id, list_transform({_TOKENS}, lambda x: CAST('0x' || substr(md5(x), 1, 8) AS BIGINT)) AS h FROM documents),
grams AS (SELECT doc_id, unnest(list_concat(list_transform(h, lambda x: x % {_BUCKETS}), list_transform(range(1, len(h)), lambda k: (h[k] * {_PAIR} + h[k + 1]) % {_BUCKETS}))) AS b FROM tokens),
counted AS (SELECT doc_id, b, count(*) AS c FROM grams GROUP BY ALL),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
sums AS (SELECT b, sum(c) AS raw, coalesce(sum(c) FILTER (WHERE doc_id IN (SELECT doc_id FROM good)), 0) AS trusted FROM counted GROUP BY b),
whole AS (SELECT sum(raw) AS raw, sum(trusted) AS trusted FROM sums),
weights AS (SELECT b, CASE WHEN a.trusted = 0 THEN 0 ELSE CAST(floor(ln((s.trusted + {quality_rules.SMOOTH}) / (s.raw * (a.trusted / a.raw) + {quality_rules.SMOOTH})) * 1e6 + 0.5) AS BIGINT) END AS weight FROM sums s, whole a),
llr AS (SELECT doc_id, CAST(sum(c * weight) AS BIGINT) AS llr, CAST(sum(c) AS BIGINT) AS n_grams FROM counted JOIN weights USING (b) GROUP BY doc_id),
base AS (SELECT doc_id, len(l) AS n_words, length(array_to_string(l, '')) AS word_chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
coalesce(llr, 0) AS llr, coalesce(n_grams, 0) AS n_grams FROM w JOIN documents USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN llr USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND llr >= {quality_rules.THRESHOLD} * (n_grams + {quality_rules.PRIOR}) AS kept FROM base""",
    "op13_phrases": f"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda x: x <> '') AS l FROM pieces),
runs AS (SELECT lang, k, unnest(list_transform(range(1, len(l) - k + 2), lambda i: array_to_string(l[i : i + k - 1], ' '))) AS phrase FROM words, range(1, 4) AS r(k) WHERE len(l) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM runs GROUP BY ALL), total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
held AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a AS longer FROM candidates WHERE k = 3),
stay AS (SELECT c.lang, c.phrase, any_value(a) AS a, any_value(w) AS w, any_value(k) AS k FROM candidates c LEFT JOIN held h ON c.lang = h.lang AND c.phrase = h.phrase GROUP BY ALL HAVING max(longer) IS NULL OR 100 * max(longer) < 50 * any_value(a)),
cuts AS (SELECT lang, phrase, a, c, array_to_string(w[1:c], ' ') AS x, array_to_string(w[c + 1:], ' ') AS y FROM stay, range(1, 3) AS r(c) WHERE c < k),
scores AS (SELECT cuts.lang, cuts.phrase, a, c, l.f AS l, r.f AS r, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y),
least AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM least JOIN total USING (lang))
SELECT * FROM ranked WHERE rank <= 2000""",
}
