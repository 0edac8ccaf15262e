import random

from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np

from kmerloom.functions import clusters, kernels, packed, scan

DNA = st.text("ACGT", min_size=1, max_size=120)


@given(DNA)
@settings(max_examples=50, deadline=None)
def test_reverse_complement_is_its_own_inverse(s):
    assert kernels.revcomp(kernels.revcomp(s)) == s


@given(st.text("ACGTN", max_size=200), st.integers(1, 31))
@settings(max_examples=100, deadline=None)
def test_rolled_kmers(s, k):
    value = lambda w: -1 if "N" in w else int(w.translate(str.maketrans("ACGT", "0123")), 4)
    words = packed.rolled(np.frombuffer(s.encode(), np.uint8), k)
    assert words.tolist() == [value(s[i : i + k]) for i in range(len(s) - k + 1)]
    assert packed.complement(words, k).tolist() == [value(kernels.revcomp(s[i : i + k])) for i in range(len(s) - k + 1)]


def test_windows_of_long_rows_go_through_in_portions(monkeypatch):
    import pyarrow as pa

    rng = random.Random(4)
    rows = ["".join(rng.choice("ACGTN" if rng.random() < 0.05 else "ACGT") for _ in range(n)) for n in (0, 3, 50, 7, 400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows)], names=["id", "s"])
    for portion in (8, 1 << 20):
        monkeypatch.setattr(packed, "PORTION", portion)
        got = [x for b in packed.window_batches("s", 5, 3, 4)([batch]) for x in zip(*(c.to_pylist() for c in b.columns))]
        value = lambda w: int(w.translate(str.maketrans("ACGT", "0123")), 4)
        want = [(r, i, value(s[i : i + 5]), value(s[i + 4 : i + 9])) for r, s in enumerate(rows) for i in range(0, len(s) - 8, 3) if "N" not in s[i : i + 5] + s[i + 4 : i + 9]]
        assert got == want


def test_segments_cover_a_contig_and_overlap():
    rng = random.Random(1)
    seq = "N" * 7 + "".join(rng.choice("ACGT") for _ in range(900)) + "NN" + "".join(rng.choice("ACGT") for _ in range(50))
    cut = kernels.cut_contig(seq, [], [], 11, 100, 200)
    assert cut[0][0] == 7 and cut[-1] == (909, 959)
    assert all(b[0] == a[1] - 10 for a, b in zip(cut[:-2], cut[1:-1]))


def test_segments_end_where_two_kmers_in_a_row_are_no_repeats():
    rng = random.Random(6)
    for _ in range(200):
        n, k, low, high = rng.randint(50, 400), 5, 20, 60
        bad = [rng.random() < rng.choice((0.3, 0.9)) for _ in range(n)]
        runs = [i for i in range(n) if bad[i] and (i == 0 or not bad[i - 1])]
        last = [next((j for j in range(i, n) if j + 1 == n or not bad[j + 1])) for i in runs]
        free = lambda i: i >= n or not bad[i]
        want, start = [], 0
        while n - start > high:
            end = next((i for i in range(start + low + 1, start + high) if free(i) and free(i - 1)), start + high)
            want.append((start, min(n, end + k - 1)))
            start = end
        assert kernels.cut_contig("A" * n, runs, last, k, low, high) == [*want, (start, n)]


def test_mates_overlap_by_a_kmer_or_more_and_may_differ_away_from_the_end():
    rng = random.Random(3)
    for overlap in range(23, 80):
        s = "".join(rng.choice("ACGT") for _ in range(200 - overlap))
        assert kernels.merge_mates(s[:100], kernels.revcomp(s[-100:]), 23) == (s, "")
    s = "".join(rng.choice("ACGT") for _ in range(120))
    other = list(s[20:])
    for i in (5, 15, 30):  # read errors in the overlap, none of them beside R1's end
        other[i] = {"A": "C", "C": "G", "G": "T", "T": "A"}[other[i]]
    assert kernels.merge_mates(s[:100], kernels.revcomp("".join(other)), 23) == (s, "")


def test_mates_are_merged_where_they_overlap():
    rng = random.Random(2)
    s = "".join(rng.choice("ACGT") for _ in range(150))
    assert kernels.merge_mates(s[:100], kernels.revcomp(s[50:]), 23) == (s, "")
    assert kernels.merge_mates(s[:60] + "A" * 30, kernels.revcomp(s[:60]), 23)[1] == ""


def test_sequence_distance():
    assert kernels.sequence_distance("ACGTTGCAACGTTGA", "ACGTTGCAACGTTGA") == 0
    assert kernels.sequence_distance("A" * 20, "C" * 20) == 1


def as_hits(code, pos, score, n1, border=None):
    one = lambda x: np.array(x, np.int64)[:, None, :]
    return scan.Hits(one(code), one(pos), one(score), np.array([n1]), np.array([len(code[0])]), np.array([n1 if border is None else border]))


def test_a_planted_junction_is_found():
    n = 150
    code, pos, score = [[0] * n, [0] * n], [[-1] * n, [-1] * n], [[0] * n, [0] * n]
    for i in range(n):
        if i < 40:
            code[0][i], pos[0][i], score[0][i] = 31, 500 + i, 5
        elif i >= 62:
            code[0][i], pos[0][i], score[0][i] = 31 << 10, 900 + i, 5
    t = scan.find(as_hits(code, pos, score, n))
    assert [(k, a, b, s) for k, a, b, s in zip(t["kind"], t["bp_start"], t["bp_end"], t["secondary"])] == [(scan.EXACT, 40, 62, False), (scan.EXACT, 40, 62, True)]


def test_jumps_behind_the_first_mate_s_own_end_are_not_corrected():
    """Merged mates: a position that strays behind R1's end keeps the last position as anchor, before it the majority."""
    n = 150

    def first_anchor(border, jump):
        code, pos, score = [[0] * n, [0] * n], [[-1] * n, [-1] * n], [[0] * n, [0] * n]
        for i in range(n):
            if i < 90:
                code[0][i], pos[0][i], score[0][i] = 31, 500 + i + (300 if i >= jump else 0), 5
            elif i >= 112:
                code[0][i], pos[0][i], score[0][i] = 31 << 10, 900 + i, 5
        t = scan.find(as_hits(code, pos, score, n, border))
        return t["left_pos"][0]

    assert first_anchor(n, 80) == 500 + 89  # corrected to the majority
    assert first_anchor(80, 80) == 800 + 89  # the jump is over R1's end


def test_odd_offsets_take_the_hit_between_their_neighbours():
    n = 30
    code, pos, score = [[31] * n, [0] * n], [[100 + i for i in range(n)], [-1] * n], [[5] * n, [0] * n]
    code[0][9], pos[0][9], score[0][9] = 0, -1, 0  # odd: filled in
    code[0][10], pos[0][10], score[0][10] = 0, -1, 0  # even: looked up, absent
    h = as_hits(code, pos, score, n)
    scan.interpolated(h)
    assert (h.code[0, 0, 9], h.pos[0, 0, 9], h.score[0, 0, 9]) == (31, 109, 5) and h.code[0, 0, 10] == 0


ROW = {"kind": "SPLIT", "vague": False, "left_code": 31, "left_pos": 10, "left_fwd": True, "right_code": 62, "right_pos": 20, "right_fwd": True, "seq": "A" * 40, "bp_len": 30, "left_kmers": 5, "right_kmers": 5, "left_score": 1.0, "right_score": 1.0, "split_cnt": 1, "pe_cnt": 0, "left_cnt": 1, "right_cnt": 1, "bp_score_sum": 0.0, "barcodes": [], "flag": 1}


def test_similar_records_merge():
    out = clusters.merge_range([dict(ROW), {**ROW, "left_pos": 60, "bp_len": 25, "flag": 2}])
    assert len(out) == 1 and out[0]["bp_len"] == 25 and out[0]["flag"] == 3 and out[0]["split_cnt"] == 2


def test_range_merge_does_not_depend_on_order():
    rng = random.Random(5)
    rows = [{**ROW, "left_pos": rng.randrange(600), "right_pos": rng.randrange(300), "bp_len": rng.randint(20, 90), "kind": rng.choice(("SPLIT", "PE"))} for _ in range(60)]
    key = lambda rs: sorted((r["left_pos"], r["right_pos"], r["bp_len"], r["left_kmers"], r["split_cnt"]) for r in rs)
    want = key(clusters.merge_range([dict(r) for r in rows]))
    for _ in range(5):
        rng.shuffle(rows)
        assert key(clusters.merge_range([dict(r) for r in rows])) == want


def test_composite_hits_need_a_triple_of_equal_codes():
    def run(found, strand, size=60, gap=18):
        """Ambiguous everywhere; found: offset -> (code, pos) of the pair that starts there along the strand."""
        flip = (lambda i: i) if strand == 0 else (lambda i: size - 1 - i)
        code, pos, score = [[99] * size, [99] * size], [[-1] * size, [-1] * size], [[1] * size, [1] * size]
        h = as_hits(code, pos, score, size)
        words = np.array([flip(i) for i in range(size)])[None, None, :].repeat(2, 0)  # the k-mer at an offset is its distance along the strand
        words[1 - strand] += 1000
        pairs = scan.Pairs([i for i in found], [i + gap for i in found], [c for c, _ in found.values()], [p for _, p in found.values()])
        scan.refine(h, words, pairs, gap, (1 << 46) - 1)
        return {i: (h.code[strand, 0, flip(i)], h.pos[strand, 0, flip(i)], h.score[strand, 0, flip(i)]) for i in range(size)}

    for strand in (0, 1):
        ambiguous = {i: (99, -1, 1) for i in range(60)}
        two = run({10: (5, 100), 13: (5, 103)}, strand)  # a chance pair is no run
        assert two == ambiguous | {10: (scan.FULL, -1, 1), 13: (scan.FULL, -1, 1)}
        mixed = run({10: (5, 100), 13: (6, 103), 16: (5, 106)}, strand)
        assert mixed == ambiguous | {i: (scan.FULL, -1, 1) for i in (10, 13, 16)}
        run_of_three = run({10: (5, 100), 13: (5, 103), 16: (5, 106)}, strand)
        assert [run_of_three[i] for i in (10, 13, 16)] == [(5, 100, 4), (5, 103, 4), (5, 106, 4)]
        raised = {i for i, x in run_of_three.items() if x == (99, -1, 3)}
        assert raised == {19, 22, 25, 28, 31}  # 16 + 3 .. below 16 + gap
