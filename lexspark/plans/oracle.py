"""DuckDB statements of the named queries (``ORACLE[name]``)."""

from __future__ import annotations

from lexspark.plans.oracle_sql import EXCL_TAGS_RE, TOKEN_RE, eval_pred, spaced, with_

ORACLE = {}

TOK = "part, doc_id, sent_no, word_no, word, lemma, tag"

ORACLE["clean_tokens"] = with_("clean") + f"SELECT {TOK} FROM clean"

ORACLE["eval_filter"] = with_("clean") + f"SELECT {TOK} FROM clean WHERE {eval_pred()}"

ORACLE["rejects"] = with_("preds") + f"""SELECT model_id, {TOK} FROM preds
WHERE word IS NOT NULL AND (lemma IS NULL OR tag IS NULL)"""

ORACLE["qa_counts"] = with_("clean") + """SELECT a.part, a.n_tokens, a.n_alpha, f.n_lemmas_multi_form, r.n_words_multi_reading
FROM (SELECT part, count(*) AS n_tokens, count(*) FILTER (WHERE regexp_matches(word, '\\p{L}')) AS n_alpha
      FROM clean GROUP BY part) a
LEFT JOIN (SELECT part, count(*) FILTER (WHERE k > 1) AS n_lemmas_multi_form
           FROM (SELECT part, lemma, count(DISTINCT word) AS k FROM clean WHERE lemma IS NOT NULL GROUP BY part, lemma) GROUP BY part) f
  ON a.part = f.part
LEFT JOIN (SELECT part, count(*) FILTER (WHERE k > 1) AS n_words_multi_reading
           FROM (SELECT part, word, count(DISTINCT CASE WHEN lemma IS NOT NULL AND tag IS NOT NULL THEN (lemma, tag) END) AS k FROM clean GROUP BY part, word) GROUP BY part) r
  ON a.part = r.part"""

ORACLE["pairs_rejects"] = with_("clean") + f"""SELECT {TOK} FROM clean
WHERE word IS NOT NULL AND (lemma IS NULL OR tag IS NULL)"""

ORACLE["sentence_numbers"] = with_("line_stream") + """SELECT doc_id, line_no,
  CAST(coalesce(sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (
    PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS sent_no
FROM line_stream QUALIFY trim(line) <> ''"""

ORACLE["eos_flags"] = with_("clean") + """SELECT part, doc_id, sent_no, word_no,
  word_no = max(word_no) OVER (PARTITION BY part, doc_id, sent_no) AS eos FROM clean"""

ORACLE["char_ngrams"] = with_("clean") + """SELECT part, doc_id, sent_no, word_no,
  array_to_string(regexp_extract_all(word, '(?s).{1,2}'), ' ') AS ngrams2,
  array_to_string(regexp_extract_all(word, '(?s).{1,3}'), ' ') AS ngrams3 FROM clean"""

ORACLE["partition_stats"] = with_("flagged") + """SELECT n.part, n.n_tokens, n.n_eval_tokens,
  coalesce(t.n_word_types, 0) AS n_word_types, coalesce(t.n_lemma_types, 0) AS n_lemma_types,
  coalesce(t.n_tag_types, 0) AS n_tag_types
FROM (SELECT part, count(*) AS n_tokens, count(*) FILTER (WHERE is_eval) AS n_eval_tokens FROM flagged GROUP BY part) n
LEFT JOIN (SELECT part,
    CAST(count(DISTINCT word) + max(CASE WHEN word IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_word_types,
    CAST(count(DISTINCT lemma) + max(CASE WHEN lemma IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_lemma_types,
    CAST(count(DISTINCT tag) + max(CASE WHEN tag IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_tag_types
  FROM flagged WHERE is_eval GROUP BY part) t ON n.part = t.part"""

ORACLE["tag_frequency"] = with_("alltok") + """SELECT tag, count(word) AS n FROM alltok
WHERE part = 'training' AND tag IS NOT NULL GROUP BY tag"""

_LT = """, lt AS (SELECT part, 'word' AS "column", word AS value FROM alltok
  UNION ALL SELECT part, 'lemma', lemma FROM alltok
  UNION ALL SELECT part, 'tag', tag FROM alltok),
ld AS (SELECT DISTINCT part, "column", value FROM lt),
tr AS (SELECT DISTINCT "column", value FROM lt WHERE part = 'training')
"""

ORACLE["unseen_types"] = with_("alltok") + _LT + """SELECT o.part, o."column", count(*) AS n_types FROM ld o
WHERE o.part <> 'training' AND NOT EXISTS (
  SELECT 1 FROM tr t WHERE t."column" = o."column" AND t.value IS NOT DISTINCT FROM o.value)
GROUP BY o.part, o."column" """

ORACLE["unseen_tokens"] = with_("alltok") + _LT + """SELECT o.part, o."column", count(*) AS n_tokens FROM lt o
WHERE o.part <> 'training' AND NOT EXISTS (
  SELECT 1 FROM tr t WHERE t."column" = o."column" AND t.value IS NOT DISTINCT FROM o.value)
GROUP BY o.part, o."column" """

ORACLE["lemma_ambiguity"] = with_("alltok") + """SELECT part,
  count(*) FILTER (WHERE kw > 1) / count(*) AS share_multi_form,
  count(*) FILTER (WHERE kt > 1) / count(*) AS share_multi_tag
FROM (SELECT part, lemma, count(DISTINCT word) AS kw, count(DISTINCT tag) AS kt FROM alltok
      WHERE lemma IS NOT NULL GROUP BY part, lemma) GROUP BY part"""

ORACLE["word_ambiguity"] = with_("alltok") + """SELECT part,
  round(count(*) FILTER (WHERE kl > 1) / count(*), 5) AS share_multi_lemma,
  round(count(*) FILTER (WHERE kt > 1) / count(*), 5) AS share_multi_tag
FROM (SELECT part, word, count(DISTINCT lemma) AS kl, count(DISTINCT tag) AS kt FROM alltok
      WHERE word IS NOT NULL GROUP BY part, word) GROUP BY part"""

for _name, _by in (("top_lemmas_forms", "word"), ("top_lemmas_tags", "tag")):
    ORACLE[_name] = with_("alltok") + f"""SELECT lemma, count(DISTINCT {_by}) AS n FROM alltok
WHERE part = 'training' AND lemma IS NOT NULL GROUP BY lemma HAVING count(DISTINCT {_by}) > 1
ORDER BY n DESC, lemma LIMIT 20"""

ORACLE["ambiguous_tokens"] = with_("alltok") + """SELECT part,
  CAST(coalesce(sum(n) FILTER (WHERE kl > 1), 0) AS BIGINT) AS n_ambiguous_lemma,
  CAST(coalesce(sum(n) FILTER (WHERE kl > 1 OR kt > 1), 0) AS BIGINT) AS n_ambiguous_any
FROM (SELECT part, word, count(*) AS n, count(DISTINCT lemma) AS kl, count(DISTINCT tag) AS kt
      FROM alltok WHERE word IS NOT NULL GROUP BY part, word) GROUP BY part"""

ORACLE["baseline_fit"] = with_("bl_model") + "SELECT word, lemma, tag FROM bl_model"

ORACLE["baseline_predict"] = with_("bl_model") + """SELECT c.part, c.doc_id, c.sent_no, c.word_no, c.word,
  coalesce(m.lemma, c.word) AS lemma, coalesce(m.tag, 'unk') AS tag
FROM clean c LEFT JOIN bl_model m ON c.word = m.word WHERE c.part IN ('dev', 'test')"""

ORACLE["baseline_scores"] = with_("flagged", "bl_model") + """, ev AS (SELECT * FROM flagged WHERE is_eval),
lt AS (SELECT part, 'word' AS c, word AS v FROM ev UNION ALL SELECT part, 'lemma', lemma FROM ev
       UNION ALL SELECT part, 'tag', tag FROM ev),
ld AS (SELECT DISTINCT part, c, v FROM lt),
ut AS (SELECT o.part, o.c, o.v FROM ld o WHERE o.part <> 'training' AND NOT EXISTS (
         SELECT 1 FROM ld t WHERE t.part = 'training' AND t.c = o.c AND t.v IS NOT DISTINCT FROM o.v)),
aw AS (SELECT part, word FROM ev WHERE word IS NOT NULL GROUP BY part, word HAVING count(DISTINCT lemma) > 1),
tok AS (SELECT f.*,
  f.is_eval AND EXISTS (SELECT 1 FROM ut WHERE ut.part = f.part AND ut.c = 'word' AND ut.v IS NOT DISTINCT FROM f.word) AS uw,
  f.is_eval AND EXISTS (SELECT 1 FROM ut WHERE ut.part = f.part AND ut.c = 'lemma' AND ut.v IS NOT DISTINCT FROM f.lemma) AS ul,
  f.is_eval AND EXISTS (SELECT 1 FROM ut WHERE ut.part = f.part AND ut.c = 'tag' AND ut.v IS NOT DISTINCT FROM f.tag) AS utg,
  f.is_eval AND EXISTS (SELECT 1 FROM aw WHERE aw.part = f.part AND aw.word = f.word) AS amb
  FROM flagged f WHERE f.part IN ('dev', 'test')),
pr AS (SELECT tok.*, coalesce(m.lemma, tok.word) AS pl, m.tag AS pt FROM tok LEFT JOIN bl_model m ON tok.word = m.word),
x AS (SELECT part,
  CASE WHEN coalesce(pl = lemma, false) THEN 1 ELSE 0 END AS l,
  CASE WHEN coalesce(pt = tag, false) THEN 1 ELSE 0 END AS t,
  CASE WHEN coalesce(pl = lemma, false) AND coalesce(pt = tag, false) THEN 1 ELSE 0 END AS j,
  unnest(list_filter(['pre_all_tokens', CASE WHEN is_eval THEN 'all_tokens' END,
    CASE WHEN uw THEN 'unseen_word_tokens' END, CASE WHEN ul THEN 'unseen_lemma_tokens' END,
    CASE WHEN utg THEN 'unseen_tag_tokens' END, CASE WHEN amb THEN 'ambiguous_word_tokens' END],
    lambda s: s IS NOT NULL)) AS scope
  FROM pr)
SELECT part, scope, count(*) AS n, sum(l) / count(*) AS lemma_acc, sum(t) / count(*) AS tag_acc,
  sum(j) / count(*) AS joint_acc FROM x GROUP BY part, scope"""

FLAG_COLS = """model_id, part, doc_id, sent_no, word_no, word_prediction, lemma_prediction, tag_prediction,
  word_truth, lemma_truth, tag_truth, eos, lemma_match, tag_match, joint_match, seen_word, ambiguous,
  seen_tag, existent_tag"""

ORACLE["match_flags"] = with_("match") + f"SELECT {FLAG_COLS} FROM flags"

_SLICES = {
    "all": "true",
    "unseen": "NOT seen_word",
    "ambiguous": "ambiguous",
    "lemma_errors": "NOT lemma_match",
    "unseen_tag": "NOT seen_tag",
    "nonexistent_tag": "NOT existent_tag",
}
_METRICS = ("lemma", "tag", "joint")

ORACLE["score_slices"] = with_("match") + """, x AS (SELECT model_id, part,
  CAST(lemma_match AS INTEGER) AS lemma, CAST(tag_match AS INTEGER) AS tag, CAST(joint_match AS INTEGER) AS joint,
  unnest(list_filter([""" + ", ".join(f"CASE WHEN {p} THEN '{n}' END" for n, p in _SLICES.items()) + """],
    lambda s: s IS NOT NULL)) AS slice FROM flags),
a AS (SELECT model_id, part, slice, count(*) AS n, sum(lemma) AS lemma, sum(tag) AS tag, sum(joint) AS joint
      FROM x GROUP BY model_id, part, slice)
""" + "\nUNION ALL\n".join(
    f"SELECT model_id, part, slice, '{m}' AS metric, round({m} / n, 5) AS value, n FROM a" for m in _METRICS)

_row_cols = []
for _s in ("all", "unseen", "ambiguous"):
    _p = _SLICES[_s]
    for _m in _METRICS:
        _row_cols.append(
            f"CASE WHEN count(*) FILTER (WHERE {_p}) > 0 THEN round(sum(CAST({_m}_match AS INTEGER)) FILTER (WHERE {_p})"
            f" / count(*) FILTER (WHERE {_p}), 5) END AS {_s}_{_m}")
ORACLE["score_row"] = with_("match") + "SELECT model_id, part, " + ",\n  ".join(_row_cols) + \
    " FROM flags GROUP BY model_id, part"

ORACLE["error_distribution"] = with_("match") + """, x AS (
  SELECT model_id, part, 'ambiguous' AS dimension, ambiguous AS flag FROM flags WHERE NOT lemma_match
  UNION ALL SELECT model_id, part, 'seen_word', seen_word FROM flags WHERE NOT lemma_match),
c AS (SELECT model_id, part, dimension, flag, count(*) AS n FROM x GROUP BY model_id, part, dimension, flag)
SELECT model_id, part, dimension, flag, n, n / sum(n) OVER (PARTITION BY model_id, part, dimension) AS share FROM c"""


def _confusion(p, t, where):
    return with_("match") + f"""SELECT model_id, part, {p}, {t}, count(word_prediction) AS n FROM flags
WHERE {where} AND {p} IS NOT NULL AND {t} IS NOT NULL GROUP BY model_id, part, {p}, {t}"""


ORACLE["tag_confusion"] = _confusion("tag_prediction", "tag_truth", "NOT tag_match")
ORACLE["lemma_confusion"] = _confusion("lemma_prediction", "lemma_truth", "NOT lemma_match")
ORACLE["lemma_confusion_ambiguous"] = _confusion("lemma_prediction", "lemma_truth", "NOT lemma_match AND ambiguous")
ORACLE["lemma_confusion_unseen"] = _confusion("lemma_prediction", "lemma_truth", "NOT lemma_match AND NOT seen_word")
ORACLE["lemma_errors_by_tag"] = _confusion("tag_prediction", "tag_truth", "NOT lemma_match")

_MARKUP = r"</?[^>]>|\s+"


def _parse(x):
    """A1 in SQL on an expression already stripped of markup and blanks."""
    tail = f"string_split({x}, '+')[-1]"
    lemma = (f"nullif(CASE WHEN contains({x}, '+') THEN left({x}, length({x}) - length({tail}) - 1) "
             f"ELSE {x} END, '')")
    tag = f"CASE WHEN contains({x}, '+') THEN nullif({tail}, '') END"
    return lemma, tag


_L, _T = _parse("x")

_WH = f""", wh AS (SELECT model_id, part, doc_id, sent_no, word_no,
  '<w> ' || concat_ws(' + ', {spaced('lemma')}, {spaced('tag')}) || ' </w>' AS line FROM preds),
wp AS (SELECT model_id, part, doc_id, sent_no, word_no, regexp_replace(line, '{_MARKUP}', '', 'g') AS x FROM wh),
parsed AS (SELECT model_id, part, doc_id, sent_no, word_no, {_L} AS lemma, {_T} AS tag FROM wp)
"""

ORACLE["parse_hypotheses"] = with_("preds") + _WH + \
    "SELECT model_id, part, doc_id, sent_no, word_no, lemma, tag FROM parsed"

ORACLE["align_words"] = with_("preds") + _WH + """SELECT m.model_id, c.part, c.doc_id, c.sent_no, c.word_no, c.word, p.lemma, p.tag
FROM raw_tokens c CROSS JOIN (SELECT DISTINCT model_id FROM preds) m LEFT JOIN parsed p USING (model_id, part, doc_id, sent_no, word_no)
WHERE c.part IN ('dev', 'test')"""


def _align_sentences(truth_cte):
    return with_("hyps") + f""", truth AS (
  SELECT part, doc_id, sent_no, word_no, word,
         CAST(row_number() OVER (PARTITION BY part, doc_id, sent_no ORDER BY word_no) - 1 AS INTEGER) AS idx
  FROM {truth_cte} WHERE part IN ('dev', 'test')),
pieces0 AS (SELECT model_id, part, doc_id, sent_no, unnest(string_split(line, '<s>')) AS piece,
                   CAST(unnest(range(len(string_split(line, '<s>')))) AS INTEGER) AS idx FROM hyps),
pieces1 AS (SELECT model_id, part, doc_id, sent_no, idx, regexp_replace(piece, '{_MARKUP}', '', 'g') AS x FROM pieces0),
pieces AS (SELECT model_id, part, doc_id, sent_no, idx, {_L} AS lemma, {_T} AS tag FROM pieces1)
SELECT m.model_id, t.part, t.doc_id, t.sent_no, t.word_no, t.word, p.lemma, p.tag
FROM truth t CROSS JOIN (SELECT DISTINCT model_id FROM hyps) m
LEFT JOIN pieces p ON p.model_id = m.model_id AND p.part = t.part AND p.doc_id = t.doc_id
  AND p.sent_no = t.sent_no AND p.idx = t.idx"""


ORACLE["align_check"] = with_("preds") + """, truth AS (SELECT part, doc_id, sent_no, word_no FROM raw_tokens WHERE part IN ('dev', 'test'))
SELECT model_id, count(t.word_no) AS n_matched, (SELECT count(*) FROM truth) - count(t.word_no) AS n_missing,
  count(*) - count(t.word_no) AS n_extra
FROM preds p LEFT JOIN truth t USING (part, doc_id, sent_no, word_no) GROUP BY model_id"""

ORACLE["align_sentences"] = _align_sentences("clean")
ORACLE["align_corpus"] = _align_sentences("raw_tokens")

ORACLE["align_surplus"] = with_("hyps") + f""", truth AS (
  SELECT part, doc_id, sent_no, count(*) AS k FROM clean WHERE part IN ('dev', 'test') AND {eval_pred()} GROUP BY ALL),
h AS (SELECT model_id, part, doc_id, sent_no, len(string_split(line, '<s>')) AS pieces FROM hyps)
SELECT model_id, part, doc_id, sent_no, CASE WHEN k IS NULL THEN 'no truth' ELSE 'beyond the sentence' END AS reason,
  CASE WHEN k IS NULL THEN 1 ELSE pieces - k END AS n
FROM h LEFT JOIN truth USING (part, doc_id, sent_no) WHERE k IS NULL OR pieces > k"""

# Line diff: the alignment table of every sentence, a row of it per step of the recursion.  ``common`` and ``hunk`` are the
# costs (edits * 10^6 + hunks) of the best alignments that end with a common line or with a changed one; cells lie in a band as wide
# as the lines that differ by position, which no best alignment leaves.  The common start of both sentences is skipped.
ORACLE["line_diff"] = with_("hyps", "truth_eos").replace("WITH ", "WITH RECURSIVE ", 1) + f""", p AS (SELECT model_id, part, doc_id, sent_no, list({{'lemma': lemma, 'tag': tag}} ORDER BY i) AS ys FROM (
  SELECT h.model_id, h.part, h.doc_id, h.sent_no, h.i, {_L} AS lemma, {_T} AS tag FROM (
    SELECT model_id, part, doc_id, sent_no, i, regexp_replace(ls[i], '{_MARKUP}', '', 'g') AS x FROM (
      SELECT *, string_split(line, '<s>') AS ls, unnest(range(1, len(string_split(line, '<s>')) + 1)) AS i FROM hyps)) h)
  GROUP BY ALL),
t AS (SELECT part, doc_id, sent_no, list({{'lemma': lemma, 'tag': tag}} ORDER BY word_no) AS xs FROM truth_eos GROUP BY ALL),
every AS (SELECT part, count(*) AS blank FROM (SELECT DISTINCT part, doc_id, sent_no FROM raw_tokens) GROUP BY part),
lines AS (SELECT part, blank + coalesce((SELECT sum(len(xs)) FROM t WHERE t.part = every.part), 0) AS n_lines FROM every),
pair AS (SELECT row_number() OVER () AS id, model_id, part, coalesce(xs, []) AS xs, ys FROM p LEFT JOIN t USING (part, doc_id, sent_no)),
seq AS (SELECT id * 3 + k AS id, model_id, part, k,
  list_transform(xs, lambda r: CASE k WHEN 0 THEN r.lemma WHEN 1 THEN r.tag ELSE r.lemma || chr(10) || r.tag END) AS x,
  list_transform(ys, lambda r: CASE k WHEN 0 THEN r.lemma WHEN 1 THEN r.tag ELSE r.lemma || chr(10) || r.tag END) AS y
  FROM pair, (SELECT unnest([0, 1, 2]) AS k)),
d AS (SELECT *, len(list_filter(range(1, least(len(x), len(y)) + 1), lambda i: x[i] IS DISTINCT FROM y[i])) AS differ,
  coalesce(list_filter(range(1, least(len(x), len(y)) + 1), lambda i: x[i] IS DISTINCT FROM y[i])[1], least(len(x), len(y)) + 1) - 1 AS skip FROM seq),
w AS (SELECT id, model_id, part, k, x[skip + 1:] AS x, y[skip + 1:] AS y, len(x) - skip AS n, len(y) - skip AS m,
  differ + abs(len(x) - len(y)) AS band FROM d),
ti AS (SELECT id, unnest(range(1, n + 1)) AS i, unnest(x) AS v FROM w WHERE n > 0 AND m > 0),
tj AS (SELECT id, unnest(range(1, m + 1)) AS j, unnest(y) AS v FROM w WHERE n > 0 AND m > 0),
r AS (
  SELECT id, 0 AS i, j, n, m, band, CASE WHEN j = 0 THEN 0 ELSE 1000000000000000 END AS common,
    CASE WHEN j = 0 THEN 1000000000000000 ELSE j * 1000000 + 1 END AS hunk
  FROM (SELECT id, n, m, band, unnest(range(0, least(m, band) + 1)) AS j FROM w WHERE n > 0 AND m > 0)
  UNION ALL
  SELECT id, i, j, n, m, band, common, least(gone, coalesce(min(least(gone, common + 1) - j * 1000000) OVER (
      PARTITION BY id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + j * 1000000, 1000000000000000)) AS hunk
  FROM (SELECT c.id, c.i, c.j, c.n, c.m, c.band, c.gone, CASE WHEN ti.v = tj.v THEN c.met ELSE 1000000000000000 END AS common
        FROM (SELECT id, i + 1 AS i, j + s AS j, n, m, band, min(CASE WHEN s = 1 THEN least(common, hunk) ELSE 1000000000000000 END) AS met,
                min(CASE WHEN s = 0 THEN least(hunk, common + 1) + 1000000 ELSE 1000000000000000 END) AS gone
              FROM r, (SELECT unnest([0, 1]) AS s) WHERE i < n AND j + s <= m AND abs(j + s - i - 1) <= band GROUP BY 1, 2, 3, 4, 5, 6) c
        JOIN ti ON ti.id = c.id AND ti.i = c.i LEFT JOIN tj ON tj.id = c.id AND tj.j = c.j)),
h AS (SELECT id, least(common, hunk) % 1000000 AS hunks FROM r WHERE i = n AND j = m
  UNION ALL SELECT id, 1 FROM w WHERE (n = 0) <> (m = 0)),
s AS (SELECT model_id, part, k, coalesce(sum(hunks), 0) AS hunks FROM w LEFT JOIN h USING (id) GROUP BY ALL)
SELECT model_id, part, CAST(any_value(n_lines) AS BIGINT) AS n_lines,
  CAST(sum(hunks) FILTER (WHERE k = 0) AS BIGINT) AS lemma_hunks, CAST(sum(hunks) FILTER (WHERE k = 1) AS BIGINT) AS tag_hunks,
  CAST(sum(hunks) FILTER (WHERE k = 2) AS BIGINT) AS joint_hunks,
  1 - sum(hunks) FILTER (WHERE k = 0) / any_value(n_lines) AS lemma_acc, 1 - sum(hunks) FILTER (WHERE k = 1) / any_value(n_lines) AS tag_acc,
  1 - sum(hunks) FILTER (WHERE k = 2) / any_value(n_lines) AS joint_acc
FROM s JOIN lines USING (part) GROUP BY model_id, part"""

ORACLE["diff_accuracy"] = with_("match") + """, whole AS (
  SELECT *, coalesce(lemma_prediction = lemma_truth, false) AS lemma_match,
         coalesce(tag_prediction = tag_truth, false) AS tag_match,
         coalesce(lemma_prediction = lemma_truth AND tag_prediction = tag_truth, false) AS joint_match FROM match0),
blank AS (SELECT part, count(*) AS nb FROM (SELECT DISTINCT part, doc_id, sent_no FROM raw_tokens) GROUP BY part),
h AS (SELECT model_id, part, doc_id, sent_no,
  CASE WHEN NOT lemma_match AND coalesce(lag(lemma_match) OVER w, true) THEN 1 ELSE 0 END AS hl,
  CASE WHEN NOT tag_match AND coalesce(lag(tag_match) OVER w, true) THEN 1 ELSE 0 END AS ht,
  CASE WHEN NOT joint_match AND coalesce(lag(joint_match) OVER w, true) THEN 1 ELSE 0 END AS hj
  FROM whole WINDOW w AS (PARTITION BY model_id, part, doc_id, sent_no ORDER BY word_no)),
s AS (SELECT model_id, part, doc_id, sent_no, count(*) AS k, sum(hl) AS hl, sum(ht) AS ht, sum(hj) AS hj
      FROM h GROUP BY model_id, part, doc_id, sent_no)
SELECT model_id, part, CAST(sum(k) + any_value(nb) AS BIGINT) AS n_lines,
  1 - sum(hl) / (sum(k) + any_value(nb)) AS lemma_acc, 1 - sum(ht) / (sum(k) + any_value(nb)) AS tag_acc,
  1 - sum(hj) / (sum(k) + any_value(nb)) AS joint_acc FROM s JOIN blank USING (part) GROUP BY model_id, part"""

# ---- example construction ---------------------------------------------------

from lexspark.plans.oracle_examples import sentence_pairs_sql, word_context_sql  # noqa: E402

ORACLE["word_context_units"] = word_context_sql(k=20)
ORACLE["word_context_chars"] = word_context_sql(n=2, N=25)
ORACLE["word_context_words"] = word_context_sql(context_unit="word", k=5)
ORACLE["word_context_tags"] = word_context_sql(k=20, tags=True)
ORACLE["word_context_span"] = word_context_sql(k=20, span=1)
ORACLE["target_lines"] = "SELECT part, doc_id, sent_no, word_no, target FROM (" + word_context_sql(
    k=0, word_unit="word", tag_unit="word", tag_first=True) + ")"
ORACLE["length_filter"] = """SELECT part, doc_id, sent_no, word_no, n_source, n_target FROM (
  SELECT *, CAST(len(string_split(source, ' ')) AS INTEGER) AS n_source,
            CAST(len(string_split(target, ' ')) AS INTEGER) AS n_target FROM (""" + word_context_sql(k=40, tags=True) + """))
WHERE n_source <= 120 AND n_target <= 120"""
ORACLE["sentence_pairs"] = sentence_pairs_sql()
ORACLE["sentence_splits"] = sentence_pairs_sql(n=2, size=50)

# ---- vocabulary, reports, run averages, grids --------------------------------

from lexspark.config import TEST_GRID  # noqa: E402


def _pairs(where):
    return f"(SELECT * FROM ({word_context_sql(k=20)}) WHERE {where})"


_VOCAB = f"""sym AS (
  SELECT 'source' AS side, unnest(string_split(source, ' ')) AS symbol FROM {_pairs("part = 'training'")} p1
  UNION ALL
  SELECT 'target', unnest(string_split(target, ' ')) FROM {_pairs("part = 'training'")} p2),
voc AS (SELECT side, symbol, count(*) AS freq,
  CAST(row_number() OVER (PARTITION BY side ORDER BY count(*) DESC, symbol) + 1 AS BIGINT) AS id
  FROM sym GROUP BY side, symbol)"""

ORACLE["vocabulary"] = "WITH " + _VOCAB + " SELECT side, symbol, freq, id FROM voc"


def _enc(side):
    return f"""{side}_e AS (
  SELECT part, doc_id, sent_no, word_no,
    string_agg(CAST(coalesce(v.id, 1) AS VARCHAR), ' ' ORDER BY e.pos) AS {side}_ids
  FROM (SELECT part, doc_id, sent_no, word_no, unnest(string_split({side}, ' ')) AS sym,
               unnest(range(len(string_split({side}, ' ')))) AS pos FROM devp) e
  LEFT JOIN voc v ON v.side = '{side}' AND v.symbol = e.sym
  GROUP BY part, doc_id, sent_no, word_no)"""


ORACLE["encode_lines"] = "WITH " + _VOCAB + f""",
devp AS {_pairs("true")},
{_enc('source')},
{_enc('target')}
SELECT s.part, s.doc_id, s.sent_no, s.word_no, s.source_ids, t.target_ids
FROM source_e s JOIN target_e t USING (part, doc_id, sent_no, word_no)"""

ORACLE["error_report"] = with_("match") + """, runs AS (
  SELECT part, doc_id, sent_no, CAST(model_id AS VARCHAR) || '_lemma' AS label,
    list(CASE WHEN lemma_match THEN coalesce(lemma_prediction, '') ELSE replace(upper(coalesce(lemma_prediction, '')), 'ẞ', 'SS') END
         ORDER BY word_no) AS cells
  FROM flags GROUP BY part, doc_id, sent_no, model_id),
truth AS (
  SELECT part, doc_id, sent_no, 'original_word' AS label, list(word_truth ORDER BY word_no) AS cells
  FROM (SELECT DISTINCT part, doc_id, sent_no, word_no, word_truth FROM flags) GROUP BY part, doc_id, sent_no)
SELECT part, doc_id, sent_no, label,
  array_to_string(list_transform(list_prepend(label, cells), lambda x: rpad(x, 15, ' ')), ' ') AS line
FROM (SELECT * FROM runs UNION ALL SELECT * FROM truth)"""

_RUNS = with_("match") + """, x AS (SELECT model_id, part, CAST(lemma_match AS INTEGER) AS lemma,
             CAST(tag_match AS INTEGER) AS tag, CAST(joint_match AS INTEGER) AS joint,
             unnest(list_filter(['all', CASE WHEN NOT seen_word THEN 'unseen' END,
                                 CASE WHEN ambiguous THEN 'ambiguous' END], lambda s: s IS NOT NULL)) AS slice
      FROM flags),
a AS (SELECT model_id, part, slice, count(*) AS n, sum(lemma) AS lemma, sum(tag) AS tag, sum(joint) AS joint
      FROM x GROUP BY model_id, part, slice),
sc AS (
  SELECT model_id, slice, metric, value FROM (
    SELECT model_id, part, slice, 'lemma' AS metric, round(lemma / n, 5) AS value FROM a
    UNION ALL SELECT model_id, part, slice, 'tag', round(tag / n, 5) FROM a
    UNION ALL SELECT model_id, part, slice, 'joint', round(joint / n, 5) FROM a)
  WHERE part = 'dev' AND slice IN ('all', 'unseen', 'ambiguous')),
runs AS (
  SELECT CAST(1000 + ii.i + 8 * jj.j AS INTEGER) AS job_id, sc.model_id, sc.slice, sc.metric,
         sc.value + CAST(0.001 AS DOUBLE) * jj.j AS value
  FROM sc, (SELECT unnest(range(8)) AS i) ii, (SELECT unnest(range(3)) AS j) jj
  WHERE sc.model_id = 1 + ii.i % 3)
"""

ORACLE["run_average"] = _RUNS + """SELECT model_id, slice, metric, round(avg(value), 5) AS mean, count(*) AS n_runs
FROM runs GROUP BY model_id, slice, metric"""

_GRID = """ga AS (SELECT CAST((job_id - 1000) % 8 AS INTEGER) AS experiment, slice, metric,
                 round(avg(value), 5) AS mean, count(*) AS n_runs
          FROM runs WHERE job_id >= 1000 GROUP BY 1, slice, metric)"""

ORACLE["grid_average"] = _RUNS + ", " + _GRID + " SELECT experiment, slice, metric, mean, n_runs FROM ga"

_CFG_VALUES = ", ".join(f"({i}, '{TEST_GRID[i].config_id('corpus')}')" for i in range(8))
ORACLE["results_sheet"] = _RUNS + ", " + _GRID + f""", cf AS (SELECT * FROM (VALUES {_CFG_VALUES}) t(experiment, config_id))
SELECT cf.experiment, cf.config_id, coalesce(regexp_extract(cf.config_id, '_([0-9]+)u_', 1), '') AS context_size,
       ga.slice, ga.metric, ga.mean, ga.n_runs
FROM cf JOIN ga ON cf.experiment = ga.experiment WHERE ga.slice = 'all' AND ga.metric = 'joint'"""


def _grid_one(cfg):
    sql = word_context_sql(n=cfg.n, context_unit=cfg.context_unit,
                           k=cfg.context_size, N=cfg.context_char_size)
    return f"""SELECT '{cfg.config_id('corpus')}' AS config_id, count(*) AS n_pairs,
  CAST(sum(len(string_split(source, ' '))) AS BIGINT) AS n_source_symbols,
  CAST(sum(len(string_split(target, ' '))) AS BIGINT) AS n_target_symbols,
  CAST(max(len(string_split(source, ' '))) AS INTEGER) AS max_source
FROM ({sql})"""


ORACLE["config_grid"] = "\nUNION ALL\n".join(_grid_one(c) for c in TEST_GRID)

ORACLE["collapse_blanks"] = with_("line_stream") + """SELECT doc_id, line_no, CASE WHEN b THEN '' ELSE line END AS line
FROM (SELECT doc_id, line_no, line, trim(line, ' ' || chr(9)) = '' AS b,
             lag(trim(line, ' ' || chr(9)) = '') OVER (ORDER BY doc_id, line_no) AS pb FROM line_stream)
WHERE pb IS NOT NULL AND NOT (b AND pb)"""

# ---- readers and sinks: what a file holds after it has been written and read again ---

from lexspark.functions.patterns import NA_TOKENS  # noqa: E402

_NA = ", ".join("'" + x + "'" for x in NA_TOKENS)


def _read(*cols):
    return ", ".join(f"CASE WHEN {c} NOT IN ({_NA}) THEN {c} END AS {c}" for c in cols)


_COMPLETE = "word IS NOT NULL AND lemma IS NOT NULL AND tag IS NOT NULL"
_ROWS = f"CAST(row_number() OVER (PARTITION BY part, doc_id, sent_no ORDER BY word_no) - 1 AS INTEGER) AS word_no, {_read('word', 'lemma', 'tag')}"

ORACLE["corpus_files"] = with_("clean") + f""", s AS (
  SELECT part, doc_id, sent_no, CAST(row_number() OVER (PARTITION BY part ORDER BY doc_id, sent_no) - 1 AS INTEGER) AS sent
  FROM (SELECT DISTINCT part, doc_id, sent_no FROM raw_tokens)),
w AS (SELECT part, doc_id, sent_no, {_ROWS} FROM clean WHERE {_COMPLETE})
SELECT part, sent AS sent_no, word_no, word, lemma, tag FROM w JOIN s USING (part, doc_id, sent_no)"""

ORACLE["format_files"] = with_("clean") + f""", c AS (SELECT * FROM clean WHERE part <> 'training' AND {_COMPLETE}),
w AS (SELECT doc_id, sent_no, CAST(row_number() OVER (ORDER BY doc_id, sent_no, word_no) - 1 AS INTEGER) AS row_no,
  CAST(dense_rank() OVER (ORDER BY doc_id, sent_no) - 1 AS INTEGER) AS sent, {_ROWS} FROM c)
SELECT format, CASE WHEN format = 'no_sentences' THEN 0 ELSE sent END AS sent_no,
  CASE WHEN format = 'no_sentences' THEN row_no ELSE word_no END AS word_no, word, lemma, tag
FROM w, (SELECT unnest(['numbered', 'conllu', 'no_sentences']) AS format)"""

ORACLE["prediction_files"] = with_("preds") + f"""SELECT 'lines' AS source, model_id,
  row_number() OVER (PARTITION BY model_id ORDER BY part, doc_id, sent_no, word_no) - 1 AS n, {_read('word', 'lemma', 'tag')} FROM preds
UNION ALL SELECT 'export', model_id, count(*), word, lemma, tag FROM preds GROUP BY model_id, word, lemma, tag"""

ORACLE["hypothesis_files"] = with_("hyps") + """SELECT model_id,
  row_number() OVER (PARTITION BY model_id ORDER BY part, doc_id, sent_no) - 1 AS line_no, line FROM hyps"""

ORACLE["pair_files"] = f"""SELECT row_number() OVER (ORDER BY part, doc_id, sent_no, word_no) - 1 AS line_no, source, target
FROM {_pairs("part <> 'training'")}"""

ORACLE["exported_tables"] = with_("match") + """, t AS (
  SELECT 'match' AS "table", model_id, part FROM flags
  UNION ALL SELECT 'tag_confusion', model_id, part FROM (SELECT DISTINCT model_id, part, tag_prediction, tag_truth FROM flags
    WHERE NOT tag_match AND tag_prediction IS NOT NULL AND tag_truth IS NOT NULL)
  UNION ALL SELECT 'lemma_confusion', model_id, part FROM (SELECT DISTINCT model_id, part, lemma_prediction, lemma_truth FROM flags
    WHERE NOT lemma_match AND lemma_prediction IS NOT NULL AND lemma_truth IS NOT NULL))
SELECT "table", model_id, part, count(*) AS n FROM t GROUP BY ALL"""

ORACLE["length_report"] = f"""SELECT part, count(*) AS n_examples, count(*) FILTER (WHERE ns > 100) AS n_long_source,
  count(*) FILTER (WHERE nt > 100) AS n_long_target, CAST(max(ns) AS INTEGER) AS longest_source, CAST(max(nt) AS INTEGER) AS longest_target
FROM (SELECT part, len(string_split(source, ' ')) AS ns, len(string_split(target, ' ')) AS nt FROM ({word_context_sql(k=40)})) GROUP BY part"""

ORACLE["type_estimates"] = with_("clean") + """, l AS (
  SELECT DISTINCT part, 'word' AS "column", word AS value FROM clean WHERE word IS NOT NULL
  UNION ALL SELECT DISTINCT part, 'lemma', lemma FROM clean WHERE lemma IS NOT NULL
  UNION ALL SELECT DISTINCT part, 'tag', tag FROM clean WHERE tag IS NOT NULL)
SELECT part, "column", count(*) AS n_types, CASE WHEN part <> 'training' THEN count(*) FILTER (WHERE NOT EXISTS (
    SELECT 1 FROM l t WHERE t.part = 'training' AND t."column" = l."column" AND t.value = l.value)) END AS n_unseen,
  true AS types_near, CASE WHEN part <> 'training' THEN true END AS unseen_near
FROM l GROUP BY part, "column\""""
