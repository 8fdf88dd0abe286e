"""The answer grammar of replies as SQL, for the check of :mod:`plumbline.functions.parsing` against another engine."""

from __future__ import annotations

from plumbline.functions import parsing as P
from plumbline.plans import question_queries as Q


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def _unwrapped(text: str) -> str:
    """One layer of marks or answer tags taken off, as long as something is inside."""
    layers = [(r"\*\*", r"\*\*"), ("__", "__"), ("`", "`"), ("“", "”"), ('"', '"'), ("‘", "’"), ("'", "'"), *[(f"<(?i:{t})>", f"</(?i:{t})>") for t in P._WRAPPING_TAGS.split("|")]]
    cases = " ".join(f"WHEN regexp_full_match({text}, '(?s){_quoted(a)}(.*\\S.*){_quoted(b)}') THEN trim(regexp_extract({text}, '(?s)^{_quoted(a)}(.*\\S.*){_quoted(b)}$', 1))" for a, b in layers)
    return f"CASE {cases} ELSE {text} END"


def _grammar() -> str:
    """The grammar over one symbol for each word; a letter stands for itself, so the match holds the letters."""
    return P._GRAMMAR.pattern.replace("?P<selection>", "").replace("?P<reference>", "").replace("?P<weak>", "").replace("L", "[A-Z]")


def parsed_sql() -> str:
    """CTEs that end in ``scored`` (response_id, provider, model_name, failed, gold, status, choice, hit) of every reply.

    Each is materialised: inlined, every layer would repeat the ones below it in all its cases.
    """
    strip = "[" + "".join(f"\\{c}" if c in "()[]{}.?" else c for c in P._STRIPPED) + "]"
    roles = " ".join(f"WHEN lower(b) IN ({', '.join(repr(w) for w in words)}) THEN '{role}'" for role, words in P._ROLES.items())
    bare = f"regexp_replace(w, '^{_quoted(strip)}+|{_quoted(strip)}+$', '', 'g')"
    symbol = f"[CASE WHEN list_contains(labels, upper(b)) THEN upper(b) WHEN b IN ('or', 'and') THEN 'k' {roles} WHEN b <> '' THEN 'e' ELSE '_' END FOR b IN bares]"
    commits = " ".join(f"WHEN regexp_full_match(t, '(?i){_quoted(c.pattern)}') THEN lower(trim(regexp_extract(t, '(?i)^(?:{_quoted(c.pattern)})$', 1)))" for c in P._COMMITS)
    cue, copula, apposition = (_quoted(p.pattern) for p in (P._CUE, P._COPULA, P._APPOSITION))
    states = f"""o.text = t OR lower(o.text) = committed
  OR (ends_with(lower(t), lower(o.text)) AND regexp_full_match(left(t, length(t) - length(o.text)), '(?i){cue}'))
  OR (ends_with(lower(body), lower(o.text)) AND regexp_full_match(left(body, length(body) - length(o.text)), '(?i){cue}'))
  OR (ends_with(lower(sentence), lower(o.text)) AND length(sentence) > length(o.text) AND regexp_full_match(left(sentence, length(sentence) - length(o.text)), '(?i){copula}'))
  OR (starts_with(t, o.text) AND regexp_full_match(substr(t, length(o.text) + 1), '{apposition}'))"""
    mentions = "regexp_matches(lower(t), '(^|[^0-9a-z])' || regexp_escape(lower(o.text)) || '([^0-9a-z]|$)')"
    gold = "coalesce(nullif(upper(trim(correct_option)), ''), chr(65 + correct_index), '')"
    layers = ", ".join(f"u{i} AS MATERIALIZED (SELECT * REPLACE ({_unwrapped('t')} AS t) FROM u{i - 1})" for i in range(1, 5))
    return f"""{Q._Q}, {Q._LABELLED}, one AS (SELECT question_id, opts, {gold} AS gold FROM (SELECT q.*, lab.opts, row_number() OVER (PARTITION BY q.question_id ORDER BY q.ordinal) AS rn FROM q JOIN lab USING (ordinal) WHERE q.question_id IS NOT NULL) WHERE rn = 1),
u0 AS MATERIALIZED (SELECT response_id, provider, model_name, coalesce(status = 'failure', FALSE) AS failed, gold, coalesce(opts, []) AS opts, coalesce({Q._WS.format("raw_text")}, '') AS t FROM model_responses LEFT JOIN one USING (question_id)),
{layers},
w AS MATERIALIZED (SELECT *, [o.label FOR o IN opts] AS labels, CASE WHEN t = '' THEN [] ELSE string_split(t, ' ') END AS words FROM u4),
b AS MATERIALIZED (SELECT *, [{bare} FOR w IN words] AS bares, [CASE WHEN regexp_matches(w, '[.!?]$') THEN '|' ELSE '' END FOR w IN words] AS stops FROM w),
y AS MATERIALIZED (SELECT *, array_to_string([x[1] || x[2] FOR x IN list_zip({symbol}, stops)], '') AS symbols FROM b),
g AS MATERIALIZED (SELECT *, [x FOR x IN regexp_extract_all(symbols, '{_grammar()}', 1) IF x <> ''] AS selections, regexp_extract_all(symbols, '{_grammar()}', 0) AS found FROM y),
h AS MATERIALIZED (SELECT *, regexp_extract_all(coalesce(selections[-1], found[-1], ''), '[A-Z]') AS letters FROM g),
s AS MATERIALIZED (SELECT *, CASE WHEN regexp_matches(t, '[.!]$') THEN rtrim(left(t, length(t) - 1)) ELSE t END AS body, CASE {commits} END AS committed,
  trim(regexp_replace([x FOR x IN string_split(regexp_replace(t, '([.!?)])\\s+', '\\1' || chr(1), 'g'), chr(1)) IF trim(x) <> ''][-1], '[.!?]+$', '')) AS sentence FROM h),
k AS MATERIALIZED (SELECT *, [o.label FOR o IN opts IF coalesce({states}, FALSE)] AS stated, len([1 FOR o IN opts IF {mentions}]) AS n_mentioned FROM s),
parsed AS (SELECT response_id, provider, model_name, failed, gold,
  CASE WHEN failed THEN NULL WHEN len(list_distinct(letters)) > 1 THEN 'parse_ambiguous' WHEN len(letters) > 0 THEN 'parse_ok' WHEN t = '' THEN 'parse_missing' WHEN len(stated) = 1 THEN 'parse_ok' WHEN len(stated) > 1 OR n_mentioned > 1 THEN 'parse_ambiguous' ELSE 'parse_missing' END AS status,
  CASE WHEN failed OR len(list_distinct(letters)) > 1 THEN NULL WHEN len(letters) > 0 THEN letters[1] WHEN t <> '' AND len(stated) = 1 THEN stated[1] END AS choice FROM k),
scored AS (SELECT *, choice IS NOT NULL AND choice = gold AS hit FROM parsed)"""


_SCORE = "CASE WHEN choice IS NULL THEN 'score_unscorable' WHEN coalesce(hit, FALSE) THEN 'score_correct' ELSE 'score_incorrect' END"
ORACLE_SQL = {
    "parse_replies": f"WITH {parsed_sql()} SELECT response_id, provider, model_name, choice AS parsed_choice, status AS parse_status, gold AS correct_option, CASE WHEN choice IS NOT NULL THEN coalesce(hit, FALSE) END AS is_correct, {_SCORE} AS score_status FROM scored",
    "parse_summary": f"WITH {parsed_sql()} SELECT provider, model_name, status AS parse_status, {_SCORE} AS score_status, count(*) AS n FROM scored GROUP BY ALL",
}
