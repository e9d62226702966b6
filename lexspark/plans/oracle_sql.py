"""DuckDB SQL statements of the named queries (the independent oracle).

Each statement runs on the driver's pre-registered views (``documents`` ...)
and restates the fixture rules and the operator semantics in plain SQL.
"""

from __future__ import annotations

from lexspark.functions.patterns import LATIN_START

TOKEN_RE = r"\p{L}+|[^ \t\p{L}]"
ENDING_RE = "(tion|ing|ment|en|s|e)$"
TAG_TAIL_RE = r'(?:\+[0-9]+|".*|;.*)+$'
LEAD_PUNCT_RE = r"""^(?:"|!|''|,|\.|\?|:|;|\||\-|\+|\(|\)|\[|\]|\{|\}|%|\*|/|&|=|>|<|_|\s)"""
EXCL_TAGS_RE = "(?i)^(?:Np|H|punct)"
SCRIPT_RE = LATIN_START

# ---- common table expressions -------------------------------------------------

CTE = {}

CTE["doc_lines"] = """doc_lines AS (
  SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line,
         CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS sent_no
  FROM documents)"""

CTE["line_stream"] = """line_stream AS (
  SELECT doc_id, unnest(ls) AS line, CAST(unnest(range(len(ls))) AS INTEGER) AS line_no
  FROM (SELECT doc_id, flatten(list_transform(string_split(text, chr(10)),
          lambda x, i: list_concat([x], list_transform(range((doc_id + i - 1) % 4), lambda z: ' ')))) AS ls
        FROM documents))"""

CTE["raw_tokens"] = f"""raw_tokens0 AS (
  SELECT doc_id, lang, sent_no,
         unnest(regexp_extract_all(line, '{TOKEN_RE}')) AS word,
         CAST(unnest(range(len(regexp_extract_all(line, '{TOKEN_RE}')))) AS INTEGER) AS word_no
  FROM doc_lines),
raw_tokens AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, lang,
         CASE doc_id % 10 WHEN 8 THEN 'dev' WHEN 9 THEN 'test' ELSE 'training' END AS part,
         sent_no, word_no, CASE WHEN (doc_id + 3 * sent_no + word_no) % 97 <> 2 THEN word END AS word,
         CASE WHEN (doc_id + 3 * sent_no + word_no) % 97 = 1 THEN NULL
              WHEN NOT regexp_matches(word, '^\\p{{L}}') OR doc_id % 7 = 0
                   OR regexp_replace(word, '{ENDING_RE}', '') = '' THEN word
              ELSE regexp_replace(word, '{ENDING_RE}', '') END AS lemma,
         (CASE WHEN (doc_id + 3 * sent_no + word_no) % 97 = 0 THEN NULL
               WHEN NOT regexp_matches(word, '^\\p{{L}}') THEN 'punct'
               WHEN word_no > 0 AND regexp_matches(word, '^\\p{{Lu}}') THEN 'Np' || lang
               WHEN length(word) <= 3 THEN 'R' || CASE WHEN doc_id % 5 = 0 THEN 'c' ELSE '' END
               WHEN length(word) <= 6 THEN 'Nc' || lang
               WHEN doc_id % 10 >= 8 AND (doc_id + word_no) % 5 = 0 THEN 'Xu' || lang
               ELSE 'Vp' || lang END)
         || CASE WHEN doc_id % 11 = 0 THEN '+0' ELSE '' END AS tag
  FROM raw_tokens0)"""

CTE["clean"] = f"""lowered AS (
  SELECT doc_id, lang, part, sent_no, word_no,
         CASE WHEN word IS NOT NULL AND lemma IS NOT NULL AND tag IS NOT NULL THEN lower(word) ELSE word END AS word,
         CASE WHEN word IS NOT NULL AND lemma IS NOT NULL AND tag IS NOT NULL THEN lower(lemma) ELSE lemma END AS lemma,
         CASE WHEN word IS NOT NULL AND lemma IS NOT NULL AND tag IS NOT NULL THEN lower(tag) ELSE tag END AS tag
  FROM raw_tokens),
clean AS (
  SELECT doc_id, lang, part, sent_no, word_no, word, lemma, regexp_replace(tag, '{TAG_TAIL_RE}', '') AS tag
  FROM lowered
  WHERE NOT (word IS NULL AND tag IS NOT NULL)
    AND NOT coalesce(regexp_matches(word, '{LEAD_PUNCT_RE}'), false)
    AND (word IS NULL OR ((regexp_replace(tag, '{TAG_TAIL_RE}', '') IS DISTINCT FROM 'punct')
                          AND (lemma IS DISTINCT FROM 'punct'))))"""

EVAL_PRED = (f"coalesce(regexp_matches({{w}}, '{SCRIPT_RE}'), false) "
             f"AND NOT coalesce(regexp_matches({{t}}, '{EXCL_TAGS_RE}'), false)")


def eval_pred(w="word", t="tag"):
    return EVAL_PRED.format(w=w, t=t)


CTE["flagged"] = f"""flagged AS (
  SELECT *, {eval_pred()} AS is_eval FROM clean)"""

CTE["alltok"] = """alltok AS (SELECT * FROM flagged WHERE is_eval)"""

CTE["bl_lemma"] = """bl_lemma AS (
  SELECT word, lemma FROM (
    SELECT word, lemma, row_number() OVER (PARTITION BY word ORDER BY n DESC, lemma) AS rk
    FROM (SELECT word, lemma, count(*) AS n FROM clean
          WHERE part = 'training' AND word IS NOT NULL AND lemma IS NOT NULL GROUP BY word, lemma))
  WHERE rk = 1)"""

CTE["bl_tag"] = """bl_tag AS (
  SELECT word, tag FROM (
    SELECT word, tag, row_number() OVER (PARTITION BY word ORDER BY n DESC, tag) AS rk
    FROM (SELECT word, tag, count(*) AS n FROM clean
          WHERE part = 'training' AND word IS NOT NULL AND tag IS NOT NULL GROUP BY word, tag))
  WHERE rk = 1)"""

CTE["bl_model"] = """bl_model AS (
  SELECT coalesce(l.word, t.word) AS word, l.lemma, t.tag
  FROM bl_lemma l FULL OUTER JOIN bl_tag t ON l.word = t.word)"""

CTE["preds"] = """preds0 AS (
  SELECT c.part, c.doc_id, c.sent_no, c.word_no, c.word,
         coalesce(m.lemma, c.word) AS pl, m.tag AS pt
  FROM clean c LEFT JOIN bl_model m ON c.word = m.word
  WHERE c.part IN ('dev', 'test')),
preds AS (
  SELECT CAST(mm.model_id AS INTEGER) AS model_id, p.part, p.doc_id, p.sent_no, p.word_no, p.word,
         CASE WHEN (p.doc_id + 2 * p.word_no) % 101 = 0 THEN NULL
              WHEN (p.doc_id + p.word_no) % (13 + mm.model_id) = 0 THEN p.pl || 'x'
              ELSE p.pl END AS lemma,
         CASE WHEN (p.doc_id + 2 * p.word_no) % 101 = 0 THEN NULL
              WHEN (p.doc_id + p.sent_no + p.word_no) % (17 + mm.model_id) = 0 THEN 'zz'
              ELSE p.pt END AS tag
  FROM preds0 p, (SELECT unnest([1, 2, 3]) AS model_id) mm)"""

SPACED = "array_to_string(string_split(coalesce({x}, ''), ''), ' ')"


def spaced(x):
    return SPACED.format(x=x)


CTE["hyps"] = f"""hw AS (
  SELECT model_id, part, doc_id, sent_no, word_no,
         concat_ws(' + ', {spaced('lemma')}, {spaced('tag')}) AS full_,
         {spaced('lemma')} AS bare,
         word_no = min(word_no) OVER (PARTITION BY model_id, part, doc_id, sent_no) AS is_first,
         word_no = max(word_no) OVER (PARTITION BY model_id, part, doc_id, sent_no) AS is_last
  FROM preds),
hyps AS (
  SELECT model_id, part, doc_id, sent_no,
         '<w> ' || coalesce(string_agg(CASE WHEN sent_no % 10 = 3 AND is_last THEN NULL
                                            WHEN sent_no % 10 = 5 AND is_first THEN bare
                                            ELSE full_ END, ' <s> ' ORDER BY word_no), '')
         || CASE WHEN sent_no % 10 = 7 THEN ' <s> x + y' ELSE '' END || ' </w>' AS line
  FROM hw GROUP BY model_id, part, doc_id, sent_no)"""

CTE["truth_eos"] = """truth_eos AS (
  SELECT * FROM (SELECT *, word_no = max(word_no) OVER (PARTITION BY part, doc_id, sent_no) AS eos
                 FROM clean WHERE part IN ('dev', 'test'))
  WHERE word IS NOT NULL AND lemma IS NOT NULL AND tag IS NOT NULL)"""

CTE["match"] = """match0 AS (
  SELECT mm.model_id, t.part, t.doc_id, t.sent_no, t.word_no,
         p.word AS word_prediction, p.lemma AS lemma_prediction, p.tag AS tag_prediction,
         t.word AS word_truth, t.lemma AS lemma_truth, t.tag AS tag_truth, t.eos
  FROM truth_eos t CROSS JOIN (SELECT DISTINCT model_id FROM preds) mm
  LEFT JOIN preds p USING (model_id, part, doc_id, sent_no, word_no)),
train_words AS (SELECT DISTINCT word FROM clean WHERE part = 'training' AND word IS NOT NULL),
train_tags AS (SELECT DISTINCT tag FROM clean WHERE part = 'training' AND tag IS NOT NULL),
amb_truth AS (SELECT part, word FROM clean WHERE part IN ('dev', 'test') GROUP BY part, word
              HAVING count(DISTINCT lemma) > 1),
amb_train AS (SELECT word FROM clean WHERE part = 'training' GROUP BY word HAVING count(DISTINCT lemma) > 1),
truth_tags AS (SELECT DISTINCT part, tag FROM clean WHERE part IN ('dev', 'test') AND tag IS NOT NULL),
flags AS (
  SELECT m.*,
         coalesce(m.lemma_prediction = m.lemma_truth, false) AS lemma_match,
         coalesce(m.tag_prediction = m.tag_truth, false) AS tag_match,
         coalesce(m.lemma_prediction = m.lemma_truth, false) AND coalesce(m.tag_prediction = m.tag_truth, false) AS joint_match,
         m.word_truth IN (SELECT word FROM train_words) AS seen_word,
         (EXISTS (SELECT 1 FROM amb_truth a WHERE a.part = m.part AND a.word = m.word_prediction)
          OR EXISTS (SELECT 1 FROM amb_train b WHERE b.word = m.word_prediction)) AS ambiguous,
         coalesce(m.tag_truth IN (SELECT tag FROM train_tags), false) AS seen_tag,
         (coalesce(m.tag_prediction IN (SELECT tag FROM train_tags), false)
          OR EXISTS (SELECT 1 FROM truth_tags x WHERE x.part = m.part AND x.tag = m.tag_prediction)) AS existent_tag
  FROM match0 m
  WHERE """ + eval_pred("m.word_truth", "m.tag_truth") + ")"

ORDER = ["doc_lines", "line_stream", "raw_tokens", "clean", "flagged", "alltok", "bl_lemma", "bl_tag", "bl_model",
         "preds", "hyps", "truth_eos", "match"]


def with_(*names) -> str:
    """WITH clause holding the named CTEs (and what they need), in dependency order."""
    need = set(names)
    deps = {"raw_tokens": ["doc_lines"], "clean": ["raw_tokens"], "flagged": ["clean"], "alltok": ["flagged"],
            "bl_lemma": ["clean"], "bl_tag": ["clean"], "bl_model": ["bl_lemma", "bl_tag"],
            "preds": ["bl_model", "clean"], "hyps": ["preds"], "truth_eos": ["clean"],
            "match": ["preds", "truth_eos", "clean"]}
    stack = list(names)
    while stack:
        n = stack.pop()
        for d in deps.get(n, []):
            if d not in need:
                need.add(d)
                stack.append(d)
    return "WITH " + ",\n".join(CTE[n] for n in ORDER if n in need) + "\n"
