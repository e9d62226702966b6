"""Named queries against their DuckDB statements on the smallest data set."""

import duckdb
import pytest

import __spark_entry__ as E

TABLES = ["documents", "conversations"]
NAMES = ["clean_tokens", "partition_stats", "baseline_scores", "score_slices", "align_sentences",
         "word_context_chars", "word_context_span", "word_context_tags", "sentence_splits", "diff_accuracy",
         "collapse_blanks", "pairs_rejects", "align_check", "length_filter", "encode_lines", "qa_counts"]


def _norm(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    rows = [tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in data]
    return sorted(rows, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, sf_dir, con, name):
    df = E.queries()[name](spark, sf_dir)
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _norm(df.columns, [tuple(r) for r in df.collect()]) == _norm(dcols, res.fetchall())


def test_entry_runs(spark):
    assert E.entry(spark).count() > 0


def test_partitioning_does_not_change_examples(spark, sf_dir):
    from lexspark.config import TransformConfig
    from lexspark.operators.context import as_text, build_examples
    from lexspark.plans import corpus
    ct = corpus.clean_tokens(spark, sf_dir)
    cfg = TransformConfig(context_char_size=10, n=2, context_span=1)
    a = as_text(build_examples(ct.repartition(1), cfg)).collect()
    b = as_text(build_examples(ct.repartition(7), cfg)).collect()
    key = lambda r: (r.part, r.doc_id, r.sent_no, r.word_no)
    assert sorted(a, key=key) == sorted(b, key=key)
