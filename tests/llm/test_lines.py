"""Line dedup against a plain statement of its rule, and its columns that clash."""

import random


def plain(rows):
    """doc_id -> (kept text, lines, removed): a pair of lines goes where it stands at an earlier place that it does not overlap."""
    first, gone = {}, {}
    order = sorted((i, t.split("\n")) for i, t in rows if t is not None)
    for i, lines in order:
        gone[i] = set()
        for k, pair in enumerate(zip(lines, lines[1:])):
            at = first.setdefault(pair, (i, k))
            if at != (i, k) and not (at[0] == i and k - at[1] == 1):
                gone[i] |= {k, k + 1}
    return {i: ("\n".join(x for k, x in enumerate(lines) if k not in gone[i]), len(lines), len(gone[i])) for i, lines in order}


def test_lines_equal_the_plain_rule(spark):
    from lexspark.llm.lines import dedup
    r = random.Random(6)
    passages = [[f"p{n}.{k}" for k in range(n)] for n in range(2, 7)]
    rows = [(0, None), (1, ""), (2, "\n\n\n"), (3, "a\na\na\na\na"), (4, "x" * 20_000)]
    for i in range(5, 90):
        lines = []
        while len(lines) < r.randrange(1, 40):
            lines += r.choice([r.choice(passages), [f"own {i} {len(lines)}"], [r.choice("abc")], [""]])
        rows.append((i, "\n".join(lines)))
    rows.append((90, "\n".join(f"long {k % 700}" for k in range(20_000))))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, h int").repartition(4)
    got = {x["doc_id"]: (x["text"], x["n_lines"], x["n_removed"]) for x in dedup(df).collect()}
    assert got == plain(rows) | {0: (None, 0, 0)}
