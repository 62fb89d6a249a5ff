"""DuckDB SQL for the queries that SQL can express over whole tables.

Fingerprints with XXH64, base-32 digests, tokenizers, trained models and approximate search are beyond it; those
queries are held against brute force in the tests.
"""

from tidemark.llm.licenses import LOWER, TEMPLATES, UPPER, WORD


def _templates() -> str:
    rows = ", ".join(f"({n}, '{t.label}', {str(t.base).lower()}, {t.k}, {len(t.words)}, {t.grams}, {t.words!r})" for n, t in enumerate(TEMPLATES))
    return f"templates(template, label, base, k, t_words, t_grams, t) AS (VALUES {rows})"


OP1 = f"""WITH {_templates()},
texts AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents),
tg AS (SELECT template, label, base, k, t_words, t_grams, t_pos, array_to_string(t[t_pos + 1 : t_pos + k], ' ') AS gram FROM (SELECT *, unnest(generate_series(0, t_grams - 1)) AS t_pos FROM templates)),
grams AS (SELECT uid, k, pos, array_to_string(ws[pos + 1 : pos + k], ' ') AS gram FROM (SELECT uid, k, ws, unnest(generate_series(0, len(ws) - k)) AS pos FROM texts, (SELECT unnest([2, 4]) AS k) WHERE len(ws) >= k)),
votes AS (SELECT uid, template, label, base, k, t_words, t_grams, pos - t_pos AS diagonal, list(DISTINCT t_pos) AS hit FROM grams JOIN tg USING (k, gram) GROUP BY ALL),
marked AS (SELECT *, len(hit) <> t_grams AND t_words >= 5 AS merge FROM votes),
gaps AS (SELECT *, CASE WHEN NOT merge THEN 1 WHEN diagonal - lag(diagonal) OVER (PARTITION BY uid, template, merge ORDER BY diagonal) <= 3 THEN 0 ELSE 1 END AS gap FROM marked),
chains AS (SELECT *, sum(gap) OVER (PARTITION BY uid, template, merge ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS chain FROM gaps),
spans AS (SELECT uid, label, base, merge, t_words, t_grams, len(list_distinct(flatten(list(hit)))) / t_grams AS coverage, min(diagonal + list_min(hit)) AS start, max(diagonal + list_max(hit) + k) AS stop FROM chains GROUP BY uid, template, label, base, merge, k, t_words, t_grams, chain),
good AS (SELECT * FROM spans WHERE CASE WHEN merge THEN coverage >= 0.75 AND stop - start <= t_words + 6 ELSE coverage = 1 END)
SELECT doc_id, len(ws)::BIGINT AS n_words, count(*) FILTER (base AND NOT merge) AS n_base, min(start) FILTER (base AND NOT merge) AS first_word, max(start) FILTER (base AND NOT merge) AS last_word,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (base AND NOT merge)), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (label IS NOT NULL)), ','), '') AS labels, round(coalesce(max(coverage), 0), 6)::DOUBLE AS score
FROM texts LEFT JOIN good USING (uid) GROUP BY uid, doc_id, ws"""

OP4 = r"""WITH texts AS (SELECT row_number() OVER () AS uid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
windows AS (SELECT uid, i, array_to_string(ws[i : i + 34], ' ') AS w FROM (SELECT uid, ws, unnest(generate_series(1, len(ws) - 34)) AS i FROM texts WHERE len(ws) >= 35)),
twice AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
gone AS (SELECT uid, list(DISTINCT n) AS gone FROM (SELECT uid, unnest(generate_series(i, i + 34)) AS n FROM windows SEMI JOIN twice USING (w)) GROUP BY uid),
words AS (SELECT uid, n, w FROM (SELECT uid, unnest(ws) AS w, generate_subscripts(ws, 1) AS n FROM texts)),
cut AS (SELECT uid, string_agg(w, ' ' ORDER BY n) AS kept FROM words ANTI JOIN (SELECT uid, unnest(gone) AS n FROM gone) USING (uid, n) GROUP BY uid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM texts LEFT JOIN gone USING (uid) LEFT JOIN cut USING (uid)"""

ORACLE_SQL: dict[str, str] = {"op1_license_scan": OP1, "op4_substring_dedup": OP4}
