"""DuckDB SQL for the queries that SQL can express, from the same parameters."""

from __future__ import annotations

from sluice.llm.diagonals import GRAM, PHRASES, STATEMENTS, TEMPLATES
from sluice.llm.mixing import Mixture


def license_diagonals(slack: int = 4, share: float = 0.6) -> str:
    """op2_license_diagonals: every word with those after it against every gram of every template."""
    rows = []
    for k, t in enumerate(PHRASES + TEMPLATES + STATEMENTS):
        words, n = t.words.split(), GRAM[t.base]
        for at in range(len(words) - n + 1):
            gram = [f"'{w}'" for w in words[at : at + n]] + ["NULL"] * (3 - n)
            rows.append(f"({k}, '{t.label}', {t.base}, {len(words) - n + 1}, {at}, {', '.join(gram)})")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    labels = "coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER ({}), '')"
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents
), words AS (
  SELECT r, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM docs
), grams AS (
  SELECT r, pos, word AS w1, lead(word) OVER following AS w2, lead(word, 2) OVER following AS w3 FROM words WINDOW following AS (PARTITION BY r ORDER BY pos)
), templates(template, label, base, whole, at_word, w1, w2, w3) AS (
  VALUES {', '.join(rows)}
), hits AS (
  SELECT r, template, label, base, whole, at_word, pos, pos - at_word AS diagonal
  FROM grams JOIN templates USING (w1, w2) WHERE base OR grams.w3 = templates.w3
), merged AS (
  SELECT d.r, d.template, d.label, d.base, d.whole, d.diagonal, count(DISTINCT h.at_word) AS n, min(h.pos) AS first_pos
  FROM (SELECT DISTINCT r, template, label, base, whole, diagonal FROM hits) d
  JOIN hits h ON h.r = d.r AND h.template = d.template AND abs(h.diagonal - d.diagonal) <= CASE WHEN d.base THEN 0 ELSE {slack} END
  GROUP BY ALL
), spans AS (
  SELECT r, label, base, first_pos, n / whole AS coverage, CASE WHEN base THEN n = whole ELSE n / whole >= {share} AND NOT EXISTS (
    SELECT 1 FROM merged o WHERE o.r = m.r AND o.template = m.template AND abs(o.diagonal - m.diagonal) <= {slack}
    AND (o.n > m.n OR o.n = m.n AND o.diagonal < m.diagonal)
  ) END AS holds
  FROM merged m
)
SELECT doc_id, len(words)::BIGINT AS n_words, count(*) FILTER (holds AND base) AS n_base,
  min(first_pos) FILTER (holds AND base)::BIGINT AS first_word, max(first_pos) FILTER (holds AND base)::BIGINT AS last_word,
  {labels.format('holds AND base')} AS base_labels, {labels.format('holds')} AS labels, coalesce(max(coverage), 0)::DOUBLE AS score
FROM docs LEFT JOIN spans USING (r) GROUP BY r, doc_id, words"""


def mixing(mixture: Mixture) -> str:
    """op9_mixing: budgets level by level, then every row's place in its leaf's last epoch by a running sum."""
    tree = mixture.tree
    leaf = ", ".join(f"k{k}" for k in range(len(tree)))

    def weight(k: int) -> str:
        named = "".join(f" WHEN k{k} = '{value}' THEN {float(w)!r}::DOUBLE" for value, w in mixture.weights.get(tree[k], {}).items())
        return f"CASE{named} ELSE 1::DOUBLE END" if named else "1::DOUBLE"

    levels = []
    for k in range(len(tree)):
        own = ", ".join(f"k{j}" for j in range(k + 1))
        siblings = "PARTITION BY " + ", ".join(f"k{j}" for j in range(k)) if k else ""
        levels.append(f"""
n{k} AS (SELECT {own}, w{k} AS w, given, sum(cap) AS cap, CASE WHEN w{k} > 0 THEN sum(cap) / w{k} ELSE 'inf'::DOUBLE END AS ratio FROM g{k} GROUP BY {own}, w{k}, given),
o{k} AS (
  SELECT *, coalesce(sum(cap) OVER (up ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent, sum(w) OVER (up ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w
  FROM n{k} WINDOW up AS ({siblings} ORDER BY ratio, k{k})
), f{k} AS (SELECT *, coalesce(rest_w <= 0 OR ratio <= (given - spent) / nullif(rest_w, 0), true) AS whole FROM o{k}),
p{k} AS (
  SELECT {own}, CASE WHEN whole THEN cap ELSE least(cap, greatest(0::DOUBLE, w * ((given - sum(CASE WHEN whole THEN cap ELSE 0 END) OVER ({siblings})) / nullif(sum(CASE WHEN whole THEN 0 ELSE w END) OVER ({siblings}), 0)))) END AS given
  FROM f{k}
), g{k + 1} AS (SELECT g{k}.* EXCLUDE (given), p{k}.given FROM g{k} JOIN p{k} USING ({own}))""")
    digits = "substr(md5({}), 1, 15)"
    wanted = f"{float(mixture.total_tokens)!r}::DOUBLE" if mixture.total_tokens is not None else f"sum(tokens)::DOUBLE * {mixture.share!r}::DOUBLE"
    usable = " AND ".join(f"w{k} > 0" for k in range(len(tree)))
    source = "coalesce(source, '')"
    return f"""
WITH docs AS (
  SELECT doc_id, lang, source, 'domain' || ((instr('0123456789abcdef', substr(md5({source}), 1, 1)) - 1) % 4) AS domain,
    len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) + 1 AS n, {digits.format("coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')")} AS hash
  FROM documents
), leaves AS (
  SELECT {', '.join(f"coalesce({c}::VARCHAR, '') AS k{k}" for k, c in enumerate(tree))}, sum(n)::BIGINT AS tokens FROM docs GROUP BY ALL
), weighed AS (
  SELECT *, {', '.join(f"{weight(k)} AS w{k}" for k in range(len(tree)))} FROM leaves
), capped AS (
  SELECT *, CASE WHEN {usable} THEN tokens::DOUBLE * {mixture.max_epochs} ELSE 0 END AS cap FROM weighed
), g0 AS (
  SELECT *, (SELECT least({wanted}, sum(cap)) FROM capped) AS given FROM capped
),{','.join(levels)},
budgets AS (SELECT {leaf}, tokens, floor(given + 1e-6::DOUBLE)::BIGINT AS budget FROM g{len(tree)}),
placed AS (
  SELECT d.*, budget // tokens AS epochs, budget % tokens AS rest, {digits.format(f"hash || ':{mixture.seed}:' || (budget // tokens)")} AS key
  , {leaf} FROM docs d JOIN budgets ON {' AND '.join(f"coalesce({c}::VARCHAR, '') = k{k}" for k, c in enumerate(tree))}
), chosen AS (
  SELECT *, epochs + (sum(n) OVER (PARTITION BY {leaf} ORDER BY key) <= rest)::BIGINT AS copies FROM placed
)
SELECT doc_id, domain, lang, source, n::BIGINT AS tokens, unnest(range(copies))::INT AS epoch FROM chosen"""
