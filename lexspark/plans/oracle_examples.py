"""DuckDB statements for example construction (word-and-context, sentence mode).

Relational restatement: every context unit gets a document-level position
and character offsets; a focus word's context is the units at the positions
next to it (equi-join on generated positions), filtered by the budget and
the sentence span, then aggregated in position order.
"""

from __future__ import annotations

from lexspark.plans.oracle_sql import with_


def _units(expr, unit, n=1):
    if unit == "word":
        return f"[{expr}]"
    if unit == "ngram":
        return f"regexp_extract_all({expr}, '(?s).{{1,{n}}}')"
    return f"regexp_extract_all({expr}, '(?s).')"


def _spaced(expr, unit, n=1):
    return f"array_to_string({_units(expr, unit, n)}, ' ')"


def word_context_sql(source="clean", n=1, context_unit="char", k=20, N=None, span=0, tags=False,
                     word_unit="char", tag_unit="char", tag_first=False):
    cu = _units("word", "word" if context_unit == "word" else "ngram", n)
    step = "0" if context_unit == "word" else f"j * {n}"
    B = N if N is not None else k
    wu = "word" if word_unit == "word" else "char"
    lem, tg = _spaced("f.lemma", wu), _spaced("f.tag", tag_unit)
    tbody = f"{tg} || ' + ' || {lem}" if tag_first else f"{lem} || ' + ' || {tg}"
    if N is not None:
        lcond, rcond = f"x.c0u >= f.cs - {N}", f"x.c1u <= f.ce + {N}"
    else:
        lcond = rcond = "true"
    tag_sfx = (f"|| CASE WHEN x.side = 'L' AND (lead(x.word_no) OVER s IS NULL OR lead(x.sent_no) OVER s <> x.sent_no "
               f"OR lead(x.word_no) OVER s <> x.word_no) THEN ' + ' || {_spaced('x.tag', tag_unit)} ELSE '' END"
               if tags else "")
    return with_("clean") + f""", tk AS (
  SELECT part, doc_id, sent_no, word_no, word, lemma, tag, {cu} AS cu FROM {source}
  WHERE word IS NOT NULL AND lemma IS NOT NULL AND tag IS NOT NULL),
tw AS (SELECT *,
  CAST(coalesce(sum(len(cu)) OVER d, 0) AS BIGINT) AS a0,
  CAST(coalesce(sum(length(word)) OVER d, 0) AS BIGINT) AS ch0
  FROM tk WINDOW d AS (PARTITION BY part, doc_id ORDER BY sent_no, word_no
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
un AS (SELECT part, doc_id, sent_no, word_no, tag, a0 + j + 1 AS pos, ch0 + {step} AS c0u,
              ch0 + {step} + length(u) AS c1u, u
       FROM (SELECT *, unnest(cu) AS u, unnest(range(len(cu))) AS j FROM tw)),
fw AS (SELECT part, doc_id, sent_no, word_no, word, lemma, tag, a0 + 1 AS a, a0 + len(cu) AS b,
              ch0 AS cs, ch0 + length(word) AS ce FROM tw),
cand AS (
  SELECT f.*, 'L' AS side, unnest(range(greatest(1, f.a - {B}), f.a)) AS pos FROM fw f
  UNION ALL
  SELECT f.*, 'R' AS side, unnest(range(f.b + 1, f.b + 1 + {B})) AS pos FROM fw f),
sel AS (
  SELECT f.part, f.doc_id, f.sent_no AS fs, f.word_no AS fw, f.side, x.pos, x.sent_no, x.word_no, x.u, x.tag
  FROM cand f JOIN un x ON x.part = f.part AND x.doc_id = f.doc_id AND x.pos = f.pos
  WHERE abs(x.sent_no - f.sent_no) <= {span}
    AND CASE WHEN f.side = 'L' THEN {lcond} ELSE {rcond} END),
rend AS (
  SELECT part, doc_id, fs, fw, side, pos,
    CASE WHEN lag(x.word_no) OVER s IS NOT NULL AND (lag(x.sent_no) OVER s <> x.sent_no
              OR lag(x.word_no) OVER s <> x.word_no) THEN '<s> ' ELSE '' END || x.u
    {tag_sfx if tags else ''} AS piece, side = 'L' AS is_left
  FROM (SELECT *, side AS side_ FROM sel) x WINDOW s AS (PARTITION BY part, doc_id, fs, fw, side ORDER BY pos)),
ctx AS (
  SELECT part, doc_id, fs, fw,
    string_agg(piece, ' ' ORDER BY pos) FILTER (WHERE side = 'L') AS lc,
    string_agg(piece, ' ' ORDER BY pos) FILTER (WHERE side = 'R') AS rc
  FROM rend GROUP BY part, doc_id, fs, fw)
SELECT f.part, f.doc_id, f.sent_no, f.word_no,
  '<w> ' || CASE WHEN c.lc IS NULL THEN '' ELSE c.lc || ' ' END || '<lc> ' || {_spaced('f.word', wu)}
    || ' <rc> ' || CASE WHEN c.rc IS NULL THEN '' ELSE c.rc || ' ' END || '</w>' AS source,
  '<w> ' || {tbody} || ' </w>' AS target
FROM fw f LEFT JOIN ctx c ON c.part = f.part AND c.doc_id = f.doc_id AND c.fs = f.sent_no AND c.fw = f.word_no"""


def sentence_pairs_sql(source="clean", n=1, size=None, word_unit="char", tag_unit="char"):
    wu = "word" if word_unit == "word" else "ngram"
    su = _spaced("word", wu, n)
    ts = f"{_spaced('lemma', wu, n)} || ' + ' || {_spaced('tag', tag_unit)}"
    tl = f"len({_units('lemma', wu, n)}) + 1 + len({_units('tag', tag_unit)}) + 1"
    if size is None:
        split = "0"
        pre = ""
    else:
        pre = f""", lens AS (
  SELECT part, doc_id, sent_no, list({tl} ORDER BY word_no) AS ls FROM {source}
  WHERE word IS NOT NULL AND lemma IS NOT NULL AND tag IS NOT NULL GROUP BY part, doc_id, sent_no),
starts AS (
  SELECT part, doc_id, sent_no, list_reduce(ls, lambda acc, x: CASE WHEN acc.i > 0 AND acc.cur + x > {size}
      THEN {{'i': acc.i + 1, 'cur': 1 + x, 'starts': list_append(acc.starts, acc.i)}}
      ELSE {{'i': acc.i + 1, 'cur': acc.cur + x, 'starts': acc.starts}} END,
      {{'i': 0, 'cur': 1, 'starts': [0]}}).starts AS st FROM lens)"""
        split = "len(list_filter(s.st, lambda v: v <= t.idx)) - 1"
    return with_("clean") + f""", t0 AS (
  SELECT *, row_number() OVER (PARTITION BY part, doc_id, sent_no ORDER BY word_no) - 1 AS idx FROM {source}
  WHERE word IS NOT NULL AND lemma IS NOT NULL AND tag IS NOT NULL){pre},
t AS (SELECT t.*, CAST({split} AS INTEGER) AS split_no FROM t0 t
      {'' if size is None else 'JOIN starts s USING (part, doc_id, sent_no)'})
SELECT part, doc_id, sent_no, split_no,
  '<w> ' || string_agg({su}, ' <s> ' ORDER BY word_no) || ' </w>' AS source,
  '<w> ' || string_agg({ts}, ' <s> ' ORDER BY word_no) || ' </w>' AS target
FROM t GROUP BY part, doc_id, sent_no, split_no"""
