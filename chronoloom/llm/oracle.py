"""DuckDB SQL for the queries of this folder that SQL can express.

The others rest on hashes, iteration or vocabularies that it lacks; tests hold them against plain
references.
"""

from __future__ import annotations

from chronoloom.llm.quality import STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)

_QUALITY = rf"""WITH split AS (
    SELECT doc_id, coalesce(text, '') AS body,
           list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)),
                       lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents),
windows AS (
    SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS three
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM split)),
repeated AS (
    SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, three) > 1),
covered AS (
    SELECT doc_id, count(DISTINCT i + d) AS n FROM repeated, (VALUES (0), (1), (2)) steps(d)
    GROUP BY doc_id),
counted AS (
    SELECT s.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
           length(body) - length(translate(body, '#*$%&|<>', '')) AS n_symbols,
           len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
           len(list_filter(words, lambda x: x IN ({_STOP}))) AS stops, len(lines) AS n_lines,
           len(list_filter(lines, lambda x: ltrim(x, ' ')[1] IN ('-', '*', '•'))) AS bullets,
           len(list_filter(lines, lambda x: x LIKE '%...' OR x LIKE '%…')) AS cuts
    FROM split s LEFT JOIN covered c ON s.doc_id = c.doc_id),
judged AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2 AND 15 AND n_symbols / n_words <= 0.1
           AND stops / n_words >= 0.02 AND n_repeat_words / n_words <= 0.4
           AND n_dup_lines / n_lines <= 0.5 AND bullets / n_lines <= 0.9
           AND cuts / n_lines <= 0.5 AS kept
FROM judged"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": _QUALITY}
