import random

import numpy as np
import pytest

from siteloom.llm import spans
from siteloom.llm.mixing import mixed, rates, reached_shares
from siteloom.llm.packing import container_fill, packed, sum_of_squares
from siteloom.llm.spans import SPAN, chains, exact_runs, gap_matches, match_left, match_right, passages, shared_chars, shared_passages, shared_spans
from siteloom.llm.tokens import count_tokens, encoder, token_counts

DOCS = "doc_id long, text string, source string, seed long, cls string, pos int, tokens string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x", 2, "y") for i, t, s in rows], DOCS)


# ------------------------------------------------------------------ shared spans


def brute(rows, k=SPAN):
    own, multi = {}, set()
    for i, t, _ in rows:
        for w in {t[j : j + k] for j in range(len(t or "") - k + 1)}:
            if own.setdefault(w, i) != i:
                multi.add(w)
    out = {}
    for i, t, _ in rows:
        covered = [False] * len(t or "")
        for j in range(len(t or "") - k + 1):
            if t[j : j + k] in multi:
                covered[j : j + k] = [True] * k
        if any(covered):
            out[i] = sum(covered)
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefgh \U0001f642é\n") for _ in range(n))
    parts = [text(n) for n in (150, 199, 200, 201, 260, 420, 900)]
    rows = []
    for i in range(60):
        body = text(rng.randrange(0, 300))
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(parts)
            lo = rng.choice([0, 0, rng.randrange(0, 60)])
            hi = len(p) - rng.choice([0, 0, rng.randrange(0, 60)])
            body += p[lo:hi] + text(rng.randrange(0, 120))
        rows.append((i, body, None))
    twice = text(230)
    rows += [(100, rows[3][1], None), (101, rows[3][1], None), (102, None, None), (103, "", None), (104, twice + "x" + twice, None), (105, "a" * 450, None), (106, "a" * 300 + "b", None), (107, text(150), None)]
    return rows


def found(df):
    rows = [tuple(r) for r in shared_chars(df).collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


@pytest.mark.parametrize("most", [32, 1])
def test_shared_chars_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(spans, "MOST_CONTEXTS", most)
    rows = corpus()
    expected = brute(rows)
    assert len(expected) > 30 and found(docs(spark, rows).repartition(3)) == expected


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(spans, "PIECE", 700)
    monkeypatch.setattr(spans, "BROADCAST_ROWS", 0)
    rows = corpus(2)[:25] + [(900, "".join(t for _, t, _ in corpus(2)[:25]), None)]
    assert found(docs(spark, rows)) == brute(rows)


def test_no_documents(spark):
    assert found(docs(spark, [])) == {} and shared_passages(docs(spark, [(1, "x" * 500, None), (None, "x" * 500, None)])).count() == 0


def edited(rng, text, every):
    """The text with a substitution, insertion or deletion about every so many characters."""
    out, at = [], 0
    while at < len(text):
        step = rng.randrange(int(every * 0.9), int(every * 1.3))
        out.append(text[at : at + step])
        at += step
        kind = rng.randrange(3)
        if at < len(text):
            out.append({0: "#" , 1: "#" + text[at], 2: ""}[kind])
            at += 1
    return "".join(out)


def test_planted_fuzzy_passages(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    rows, planted = [], []
    for i in range(60):
        core, every = text(rng.randrange(300, 900)), rng.choice([70, 90, 120])
        before = text(rng.randrange(0, 200))
        rows += [(2 * i, before + core + text(50), None), (2 * i + 1, text(80) + edited(rng, core, every) + text(rng.randrange(100)), None)]
        planted.append((2 * i, 2 * i + 1, len(before), len(before) + len(core)))
    got = {(r.a, r.b): r for r in shared_passages(docs(spark, rows)).collect()}
    hit = sum((a, b) in got and min(hi, got[a, b].end_a) - max(lo, got[a, b].start_a) >= 0.8 * (hi - lo) for a, b, lo, hi in planted)
    assert hit >= 0.9 * len(planted) and set(got) <= {(a, b) for a, b, _, _ in planted}
    # exact runs alone hold too few of them
    assert len(found(docs(spark, rows))) < len(planted)


def group_of_quotations(n, size=600, every=250):
    """Records that each quote one core with edits of their own, behind texts of their own."""
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    core = text(size)
    return [(i, text(rng.randrange(150)) + edited(rng, core, every) + text(150), None) for i in range(n)]


@pytest.mark.parametrize("block", [1000, 5])
def test_passages_of_every_two_records(spark, monkeypatch, block):
    monkeypatch.setattr(spans, "BLOCK", block)
    rows = group_of_quotations(14)
    rows += [(100, rows[3][1], None), (-5, rows[3][1], None), (101, "z" + rows[0][1][:60] + "y" * 300, None)]
    got = {}
    for r in shared_passages(docs(spark, rows).repartition(3)).collect():
        got[r.a, r.b] = max(got.get((r.a, r.b), 0), r.end_a - r.start_a)
        for d, start, end in ((r.a, r.start_a, r.end_a), (r.b, r.start_b, r.end_b)):
            assert 0 <= start <= end - SPAN and end <= len(dict((i, t) for i, t, _ in rows)[d])
    ids = sorted([*range(14), 100, -5])
    assert set(got) == {(a, b) for a in ids for b in ids if a < b} and min(got.values()) > 450
    assert got[3, 100] == got[-5, 3] == len(rows[3][1])


def test_passages_of_repeated_text(spark):
    unit = group_of_quotations(1)[0][1]
    rows = [(1, "a" * 3000 + unit[:90], None), (2, unit[100:190] + "a" * 2500, None), (3, "a" * 20 + "b" * 20 + "a" * 250, None)]
    rows += [(4, unit[:70] * 40, None), (5, unit[500:550] + unit[20:70] + unit[:70] * 30 + unit[:30], None)]
    got = {}
    for r in shared_passages(docs(spark, rows)).collect():
        got[r.a, r.b] = max(got.get((r.a, r.b), 0), r.agreeing)
    assert got[1, 2] == 2500 and got[1, 3] == got[2, 3] == 250 and got[4, 5] == 2180 and len(got) == 4


def test_runs_of_a_seed():
    hashes = spans.Hashes(np.frombuffer(("ab" * 50 + "xyz" * 40).encode("utf-32-le"), np.uint32))
    first, last, step = spans.tandem_runs(hashes, np.zeros(10, int), np.array([0, 2, 4, 6, 50, 100, 103, 106, 7, 9]), np.array([1, 1, 1, 1, 1, 2, 2, 2, 3, 3], np.uint64))
    assert sorted(zip(first.tolist(), last.tolist(), step.tolist())) == [(0, 3, 2), (4, 4, 0), (5, 7, 3), (8, 8, 0), (9, 9, 0)]
    assert spans.run_matches(5, 5, 0, 9, 9, 0) == {(5, 9)} and spans.run_matches(0, 90, 30, 7, 7, 0) == {(0, 7), (30, 7), (60, 7), (90, 7)}
    assert spans.run_matches(0, 90, 30, 0, 30, 30) == {(0, 0), (30, 30), (30, 0), (60, 30), (60, 0), (90, 30)}


def test_members_of_large_groups(spark):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    shared = text(300)
    rows = [(i, text(150) + shared + text(150), None) for i in range(40)]
    rows.append((100, rows[0][1], None))
    spans_of = {}
    for r in shared_spans(docs(spark, rows)).collect():
        assert rows[min(r.doc_id, 40)][1][r.start : r.start + r.length] and r.length == 100
        spans_of.setdefault(r.span_id, set()).add(r.doc_id)
    assert max(map(len, spans_of.values())) == 41  # every pair of the 41 follows
    assert found(docs(spark, rows)) == brute(rows)


def test_chains_and_alignment():
    assert chains([(0, 0), (50, 50), (120, 300), (200, 200), (50, 50)], 100) == [[(0, 0), (50, 50), (200, 200)], [(120, 300)]]
    assert match_right("abcdx", 0, "abcdy", 0) == 4 and match_left("xbcd", 4, "ybcd", 4) == 3 and match_right("a", 1, "b", 0) == 0
    a = "q" * 30 + "".join(chr(97 + i * 7 % 26) + str(i) for i in range(100)) + "z"
    b = "w" * 5 + a[30:-1]
    assert exact_runs(0, a, 0, b, [(60, 35)], 100) == [(30, 5, len(a) - 31)]
    assert gap_matches("kitten", "sitting") == 4 and gap_matches("abc", "abc") == 3 and gap_matches("", "abc") == 0 and gap_matches("abcd" * 50, "abcd" * 40) == 160
    x, y = "".join(chr(97 + i * i % 23) for i in range(300)), "".join(chr(97 + i * i * i % 19) for i in range(300))
    one, two = x + "-" * 10 + y, x + "+" * 12 + y
    assert passages(0, one, 0, two, [(100, 100), (400, 402)], 32) == [(0, 610, 0, 612, 600)]


# ------------------------------------------------------------------ tokens, containers, mixing


def test_token_counts(spark):
    long = "Every page of the crawl was read.\nEs ist nichts. 12345 $$ " * 9_000
    assert count_tokens(long) == len(encoder().encode_ordinary(long))
    assert [count_tokens(x) for x in (None, "", " \n ")] == [0, 0, 0] and count_tokens("x" * 450_000) > 0
    got = token_counts(docs(spark, [(1, "one two", "a"), (2, None, "a"), (3, "", None), (None, "x", None), (4, "<|endoftext|>", None)]), ("source",)).collect()
    assert sorted((r.doc_id, r.source, r.tokens) for r in got) == [(1, "a", 2), (4, None, count_tokens("<|endoftext|>"))]


def brute_sum_of_squares(sizes, capacity):
    levels, out, opened = {}, [], 0
    for s in sizes:
        def cost(level, s=s):
            n = {h: len(v) for h, v in levels.items()}
            if level:
                n[level] -= 1
            if level + s < capacity:
                n[level + s] = n.get(level + s, 0) + 1
            return sum(x * x for x in n.values())

        options = [h for h, v in levels.items() if v and h + s <= capacity]
        best = min([*options, 0], key=lambda h: (cost(h), h == 0, -h))
        if best:
            c = levels[best].pop()
        else:
            c, opened = opened, opened + 1
        out.append(c)
        if best + s < capacity:
            levels.setdefault(best + s, []).append(c)
    return out


def test_sum_of_squares():
    rng = random.Random(9)
    for _ in range(40):
        cap = rng.choice([1, 7, 30])
        sizes = [rng.randint(1, cap) for _ in range(60)]
        got = sum_of_squares(sizes, cap)
        assert got == brute_sum_of_squares(sizes, cap)
        fill = {}
        for s, c in zip(sizes, got):
            fill[c] = fill.get(c, 0) + s
        assert max(fill.values()) <= cap


def test_packing(spark):
    rng = random.Random(8)
    sizes = {i: rng.choice([1, 3, 50, 99, 100, 101, 250, 300]) for i in range(500)}
    counts = spark.createDataFrame([(i, n) for i, n in sizes.items()], "doc_id long, tokens int")
    kinds = spark.createDataFrame([("c", 100), ("c", 100), ("d", 64), ("bad", None), ("none", 0), (None, 5)], "container_kind string, capacity_tokens int")
    parts = packed(counts, kinds, shard_items=60)
    rows = parts.collect()
    for kind, cap in (("c", 100), ("d", 64)):
        mine = [r for r in rows if r.container_kind == kind]
        fill, pieces = {}, {}
        for r in mine:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.tokens
            pieces.setdefault(r.doc_id, []).append((r.part_no, r.token_start, r.tokens))
        assert max(fill.values()) <= cap and set(pieces) == set(sizes)
        for i, p in pieces.items():
            p.sort()
            assert [x for x, _, _ in p] == list(range(len(p))) and sum(n for _, _, n in p) == sizes[i]
            assert [s for _, s, _ in p] == [k * cap for k in range(len(p))] and (len(p) == 1 or sizes[i] > cap)
    assert {r.container_kind for r in rows} == {"c", "d"}
    assert {r.container_kind: r.records for r in container_fill(parts, kinds).collect()} == {"c": 500, "d": 500}
    assert packed(counts.limit(0), kinds).count() == 0 and packed(counts, kinds.limit(0)).count() == 0


def test_mixing(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["big"] * 6 + ["mid"] * 3 + ["small", None, "other"]), rng.randint(1, 400)) for i in range(6000)]
    counts = spark.createDataFrame(rows, "doc_id long, source string, tokens int")
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.3, 2), ("small", 0.3, 4), ("absent", 0.0, 2)], "source string, target_share double, max_repeats int")
    for blocks in (100_000, 50):
        chosen = mixed(counts, targets, block_records=blocks)
        got = {r.doc_id: r for r in chosen.collect()}
        cap, known = {"big": 1, "mid": 2, "small": 4}, {i: (s, t) for i, s, t in rows}
        assert all(1 <= r.uses <= cap[r.source] and known[r.doc_id] == (r.source, r.tokens) for r in got.values())
        for r in reached_shares(chosen, targets).collect():
            assert r.actual_share == pytest.approx(r.target_share, abs=0.004)
    plan, total = rates(counts, targets)
    assert max(r["rate"] / r["cap"] for r in plan) == pytest.approx(1.0)
    small, _ = rates(counts, targets, total_tokens=1000)
    assert sum(r["rate"] * r["tokens"] for r in small) == pytest.approx(1000)
    assert mixed(counts.limit(0), targets).count() == 0 and mixed(counts, targets.limit(0)).count() == 0


def test_registered_queries_run_on_the_smallest_tables(spark):
    from siteloom.llm.queries import ORACLES, QUERIES

    assert set(ORACLES) <= set(QUERIES)
    for name, q in QUERIES.items():
        assert q(spark, "/root/testdata/sf0.001").count() > 0, name
