"""DuckDB SQL the queries are compared with."""

from __future__ import annotations

from namefold.llm.decontaminate import BREAK, SPAN
from namefold.llm.line_dedup import WINDOW
from namefold.llm.merkle import ARITY
from namefold.llm.mixing import MOST_REPEATS, SEED, WEIGHTS
from namefold.llm.quality_rules import MIN_WORDS, RULES, STOP_WORDS

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_KNOWN = {
    "n_words": "n_words", "mean_word_chars": "word_chars / greatest(n_words, 1)", "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "stop_word_ratio": "n_stop_words / greatest(n_words, 1)", "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
}
_VERDICT = " AND ".join(f"{_KNOWN[measure]} {comparison} {bound}" for _, measure, comparison, bound in RULES)

QUALITY_RULES_SQL = rf"""
WITH worded AS (
  SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM worded)),
doubled AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM doubled) GROUP BY doc_id),
measured AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(list_filter(words, lambda x: lower(x) IN ({_STOP}))) AS BIGINT) AS n_stop_words
  FROM worded LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_VERDICT} AS kept, n_stop_words
FROM (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured)
"""

EXACT_DEDUP_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

LINE_DEDUP_SQL = rf"""
WITH lined AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
spoken AS (
  SELECT doc_id, line, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS j
  FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(0, len(lines))) AS pos FROM lined) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
windows AS (
  SELECT doc_id, pos, {", ".join(f"lead(pos, {k}) OVER d AS pos{k}" for k in range(1, WINDOW))},
         {" || chr(10) || ".join(["line"] + [f"lead(line, {k}) OVER d" for k in range(1, WINDOW)])} AS w
  FROM spoken WINDOW d AS (PARTITION BY doc_id ORDER BY j)),
later AS (SELECT * FROM windows WHERE w IS NOT NULL QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) > 1),
gone AS (SELECT DISTINCT doc_id, unnest([pos, {", ".join(f"pos{k}" for k in range(1, WINDOW))}]) AS pos FROM later),
kept AS (
  SELECT doc_id, count(g.pos) AS n_removed, count(*) AS n_lines, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (g.pos IS NULL), '') AS kept_text
  FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(0, len(lines))) AS pos FROM lined) l LEFT JOIN gone g USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, sha256(kept_text) AS kept_sha256 FROM kept
"""

_WEIGHT = f"[{', '.join(map(str, WEIGHTS))}]"
MIXING_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len({_WORDS}) AS size, md5(coalesce(text, '')) AS digest,
         row_number() OVER (PARTITION BY source, doc_id, md5(coalesce(text, ''))) - 1 AS number FROM documents),
total AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT source, source_size, source_size * {MOST_REPEATS} AS cap,
         {_WEIGHT}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight FROM total),
placed AS (SELECT *, row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST) AS pos FROM ranked),
leveled AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / sum(weight) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM placed),
goals AS (
  SELECT source, source_size,
         least(CAST(cap AS DOUBLE), (SELECT level FROM leveled WHERE level * weight <= cap ORDER BY pos LIMIT 1) * weight) AS target FROM leveled),
rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || digest || '|' || number || '|{SEED}'), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS coin
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST((floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM rated
"""

_ITEM_WORDS = f"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BREAK}'), lambda x: x <> '')"
DECONTAMINATE_SQL = f"""
WITH dw AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
iw AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_ITEM_WORDS} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item, l, array_to_string(w[i:i + l - 1], ' ') AS win
  FROM (SELECT item, w, least(len(w), {SPAN}) AS l, unnest(range(1, len(w) - least(len(w), {SPAN}) + 2)) AS i FROM iw WHERE len(w) > 0)),
found AS (
  SELECT doc_id, i, l, win
  FROM (SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS win
        FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM dw, (SELECT DISTINCT l FROM wins) WHERE len(w) >= l))
  WHERE win IN (SELECT win FROM wins)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM found JOIN wins USING (win)) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

#: Levels that the SQL below can climb: sources and documents of a source up to ARITY to this power.
_CLIMB = 5


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _tree(name: str, lowest: str) -> str:
    """All levels above ``lowest`` (tree, pos, whole, node), the trees' roots, and each level's runs of siblings."""
    levels = "".join(
        f"{name}{k + 1} AS (SELECT tree, t.pos // {ARITY} AS pos, (min(whole) + {ARITY - 1}) // {ARITY} AS whole, sha256(string_agg(node, '' ORDER BY t.pos)) AS node"
        f" FROM {name}{k} t WHERE whole > 1 GROUP BY tree, t.pos // {ARITY}),\n" for k in range(_CLIMB)
    )
    roots = " UNION ALL ".join(f"SELECT tree, node FROM {name}{k} WHERE whole = 1" for k in range(_CLIMB + 1))
    runs = ",\n".join(f"{name}_runs{k} AS (SELECT tree, t.pos // {ARITY} AS run, list(node ORDER BY t.pos) AS nodes FROM {name}{k} t WHERE whole > 1 GROUP BY tree, t.pos // {ARITY})" for k in range(_CLIMB))
    return f"{name}0 AS ({lowest}),\n{levels}{name}_roots AS ({roots}),\n{runs}"


def _climb(name: str, start: str) -> str:
    """From (tree, pos, proof, folded) of each leaf up to its tree's root."""
    steps = "".join(
        f"""{name}_up{k + 1} AS (
  SELECT u.* REPLACE (u.pos // {ARITY} AS pos, proof || coalesce(array_to_string(nodes[1:u.pos % {ARITY}], '') || array_to_string(nodes[u.pos % {ARITY} + 2:], ''), '') AS proof,
    CASE WHEN nodes IS NULL THEN folded ELSE sha256(array_to_string(nodes[1:u.pos % {ARITY}], '') || folded || array_to_string(nodes[u.pos % {ARITY} + 2:], '')) END AS folded)
  FROM {name}_up{k} u LEFT JOIN {name}_runs{k} r ON u.tree = r.tree AND u.pos // {ARITY} = r.run),
""" for k in range(_CLIMB)
    )
    return f"{name}_up0 AS ({start}),\n{steps}"


_LOWER = "translate(CAST(text AS VARCHAR), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LEAF = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))))"""
MERKLE_SQL = f"""
WITH leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, sha256({_LEAF} || {_field("text")}) AS leaf,
         CASE WHEN {_CRC32} % 5 = 0 THEN sha256({_LEAF} || {_field(_LOWER)}) END AS changed FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS whole FROM leaves),
{_tree("doc", "SELECT tree, pos, whole, leaf AS node FROM numbered")},
{_tree("src", "SELECT 1 AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS whole, node, tree AS source FROM doc_roots")},
{_climb("doc", "SELECT doc_id, tree, pos, '' AS proof, coalesce(changed, leaf) AS folded, leaf, tree AS source FROM numbered")}
{_climb("src", f"SELECT u.doc_id, 1 AS tree, s.pos, u.proof, u.folded, u.leaf, s.node AS subroot FROM doc_up{_CLIMB} u JOIN src0 s USING (source)")}
done AS (SELECT u.*, r.node AS root FROM src_up{_CLIMB} u, src_roots r)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM done
"""
