"""DuckDB SQL for the queries that SQL can express over whole tables."""

QUALITY_RULES = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS win
      FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 8) AS r(k) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
ls AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
       FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
        coalesce(n_lines, 0) AS n_lines,
        length(regexp_replace(t, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) AS letters
      FROM w LEFT JOIN ls USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * word_chars < 22 * n_words OR word_chars > 15 * n_words
    OR 5 * n_symbols > n_words OR (n_lines >= 6 AND 2 * n_dup_lines > n_lines)
    OR 100 * letters < 60 * word_chars) AS kept
FROM b
"""

RANKED_SEARCH = r"""
WITH q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
c AS (SELECT doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM d WHERE len(terms) > 0),
s AS (SELECT count(*) AS all_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM c),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM c) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(all_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term),
i AS (SELECT doc_id, p.term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * all_docs) // all_terms))) AS impact FROM p JOIN w ON p.term = w.term, s),
r AS (SELECT item_id, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM q JOIN i ON q.term = i.term GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""


def license_sentences() -> str:
    """Sentence identifiers by a CASE chain, then one step a rule over the identifier sequences."""
    from assayer.llm.licenses import ANCHOR, RULES, SENTENCES

    chain = " ".join(f"WHEN regexp_full_match(sentence, '{p}') THEN '{n}'" for n, p in SENTENCES)
    steps, last = [], "r0"
    for i, (name, pattern) in enumerate(RULES, 1):
        steps.append(
            f"r{i} AS (SELECT doc_id, ids, regexp_replace(rest, '{pattern}', ';', 'g') AS rest, "
            f"CASE WHEN regexp_matches(rest, '{pattern}') AND NOT list_contains(found, '{name}') THEN list_append(found, '{name}') ELSE found END AS found FROM {last})"
        )
        last = f"r{i}"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS nr, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
c AS (SELECT * FROM d WHERE regexp_matches(t, '{ANCHOR}')),
p AS (SELECT nr, doc_id, string_split(regexp_replace(t, '([.!?])[\x20\t\r]+', '\1' || chr(10), 'g'), chr(10)) AS parts FROM c),
u AS (SELECT nr, doc_id, unnest(parts) AS raw, unnest(generate_series(1, len(parts))) AS nth FROM p),
n AS (SELECT nr, doc_id, nth, trim(regexp_replace(raw, '[^a-z0-9]+', ' ', 'g')) AS sentence FROM u),
i AS (SELECT nr, doc_id, nth, CASE WHEN NOT regexp_matches(sentence, '{ANCHOR}') THEN '' {chain} ELSE 'unknown' END AS id FROM n),
g AS (SELECT doc_id, list(id ORDER BY nth) AS ids FROM i WHERE id <> '' GROUP BY nr, doc_id),
r0 AS (SELECT doc_id, ids, ',' || array_to_string(ids, ',,') || ',' AS rest, CAST([] AS VARCHAR[]) AS found FROM g),
{", ".join(steps)}
SELECT doc_id, array_to_string(list_sort(found), ',') AS licenses, array_to_string(ids, ',') AS sentence_ids,
  CAST(len(list_filter(ids, lambda x: x <> 'unknown')) AS BIGINT) AS n_known,
  CAST(len(list_filter(ids, lambda x: x = 'unknown')) AS BIGINT) AS n_unknown,
  array_to_string(list_filter(regexp_split_to_array(rest, '[,;]+'), lambda x: x NOT IN ('', 'unknown')), ',') AS unmatched
FROM {last}
"""
