import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tradewell.llm import line_dedup, queries
from tradewell.llm.line_dedup import dedup_lines, within_edits

WHITE = " \t\n\x0b\f\r"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abc", max_size=14), st.text("abc", max_size=14), st.integers(0, 4))
def test_band_equals_the_whole_table(a, b, limit):
    assert within_edits(a, b, limit) == (edits(a, b) <= limit)


def plain(docs, limit=2, least=30, equal=30):
    """{(id, text)}: dropped line numbers, ids of the lines that stay, text; over all pairs.

    Lines of ``least`` characters or more are compared by edits, those of ``equal`` or more as they are.
    """
    rows = sorted({(2**63 - 1 if i is None else i, t or "") for i, t in docs})
    first = {}
    for i, t in rows:
        for at, x in enumerate(t.split("\n")):
            if len(x.strip(WHITE)) >= equal:
                place = (i, at, t)
                first[x.strip(WHITE)] = min(first.get(x.strip(WHITE), place), place, key=lambda p: p[:2])
    lines = list(first)
    up = {x: x for x in lines}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    long = [x for x in lines if len(x) >= least]
    for k, a in enumerate(long):
        for b in long[:k]:
            if abs(len(a) - len(b)) <= limit and within_edits(a, b, limit):
                lo, hi = sorted((root(a), root(b)), key=lambda x: first[x][:2])
                up[hi] = lo
    out = {}
    for i, t in rows:
        gone, of, stay = [], set(), []
        for at, x in enumerate(t.split("\n")):
            bare = x.strip(WHITE)
            if len(bare) >= equal and first[root(bare)] != (i, at, t):
                gone.append(at)
                of.add(first[root(bare)][0])
            else:
                stay.append(x)
        out[i, t] = gone, sorted(of), "\n".join(stay)
    return out


def test_query_equals_all_pairs(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = plain(docs, equal=1)
    got = {r.doc_id: r for r in queries.op2_line_dedup(spark, sf).collect()}
    for i, t in docs:
        gone, of, text = want[i, t or ""]
        r = got[i]
        assert r.dropped == ",".join(map(str, gone)) and r.n_dropped == len(gone) and r.class_ids == of
        assert r.kept_sha256 == hashlib.sha256(text.encode()).hexdigest()
    left = [x.strip(WHITE) for text in {k: v[2] for k, v in want.items()}.values() for x in text.split("\n")]
    left = [x for x in left if x]
    assert len(left) == len(set(left))  # no line that is not blank stays twice


def near_copies(seed, n):
    """Lines with zero to three edits of a few, so that chains and large shared segments arise."""
    rng = random.Random(seed)
    bases = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(30, 50))).strip() + "xyz" for _ in range(4)]
    docs = []
    for i in range(n):
        lines = []
        for _ in range(3):
            x = list(rng.choice(bases))
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(x))
                x[k : k + 1] = rng.choice(([], [rng.choice("abcdef")], [x[k], "q"]))
            lines.append("".join(x))
        docs.append((i, "\n".join(lines)))
    return docs


def test_near_copies_in_blocks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK_ROWS", 8)
    docs = near_copies(3, 60)
    want = plain(docs)
    found = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).select("row.doc_id", "text", "dropped", "class_ids")
    for r in found.collect():
        assert (r.dropped, r.class_ids, r.text) == want[docs[r.doc_id]]


def test_equal_short_lines_go_if_asked_for(spark):
    long = "a line of a text that is long enough"
    docs = [
        (1, f"All rights reserved.\n\n- x\n{long}"),
        (2, f" All rights reserved. \nAll rights reserved!\n\n- x\n{long[:-1]}"),
        (3, "- x\n- y\nAll rights reserved."),
    ]
    found = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), equal_chars=1)
    got = {r.doc_id: (r.dropped, r.text) for r in found.select("row.doc_id", "dropped", "text").collect()}
    assert got == {1: ([], docs[0][1]), 2: ([0, 3, 4], "All rights reserved!\n"), 3: ([0, 2], "- y")}


def test_odd_rows(odd, empty, clash):
    want = plain([(r.doc_id, r.text) for r in odd.collect()])
    got = dedup_lines(odd)
    for r in got.collect():
        key = (2**63 - 1 if r.row.doc_id is None else r.row.doc_id, r.row.text or "")
        assert (r.dropped, r.class_ids, r.text) == want[key]
    assert got.count() == odd.count()
    shown = lambda df: sorted(map(str, df.select("row.doc_id", "text", "n_lines", "dropped", "class_ids").collect()))
    assert shown(dedup_lines(clash)) == shown(got)
    assert dedup_lines(clash).select("row.*").columns == clash.columns
    assert dedup_lines(empty).collect() == []
