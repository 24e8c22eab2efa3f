import random
from itertools import groupby

import numpy as np
import pytest
from brute import gap_affine, graph_paths, levenshtein, replay
from hypothesis import given, settings, strategies as st

from seqloom.kernels import affine, bits, dags, growing, orders, pairs, waves

words = st.text(alphabet="ACGT", max_size=25)

# Pairs with known distances.
KNOWN = [
    ("Hello, world!", "Hello, world!", 0),
    ("Test_Case_#1", "Test_Case_#1", 0),
    ("Hello, world!", "Hell, world!", 1),
    ("Test_Case_#1", "Test_Case_#2", 1),
    ("Test_Case_#1", "Test_Case_#10", 1),
    ("My Cat", "My Case", 2),
    ("Hello, world!", "Goodbye, world!", 7),
    ("Test_Case_#3", "Case #3", 6),
]


def coded(texts):
    return [pairs.symbols(t) for t in texts]


@pytest.mark.parametrize("a, b, distance", KNOWN)
def test_known_distances(a, b, distance):
    for kernel in (pairs.align_pairs, pairs.wavefront_pairs):
        scores, ops = kernel(coded([a]), coded([b]))
        assert scores[0] == distance == replay(a, b, ops[0])
    assert bits.bit_distance(*coded([a, b])) == distance


def test_long_known_pair():
    pattern, text = "TCTTTACTCGCGCGTTGGAGAAATACAATAGT" * 4, "TCTATACTGCGCGTTTGGAGAAATAAAATAGT" * 4
    script = "MMMXMMMMDMMMMMMMIMMMMMMMMMXMMMMMM" * 4
    for kernel in (pairs.align_pairs, pairs.wavefront_pairs):
        scores, ops = kernel(coded([pattern]), coded([text]))
        assert scores[0] == 16 and ops[0] == script


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(words, words), min_size=1, max_size=8))
def test_pairwise_kernels_agree_with_the_table(couples):
    a, b = zip(*couples)
    want = [levenshtein(x, y) for x, y in couples]
    for kernel in (pairs.align_pairs, pairs.wavefront_pairs):
        scores, ops = kernel(coded(a), coded(b))
        assert list(scores) == want == [replay(x, y, o) for x, y, o in zip(a, b, ops)]
    assert [bits.bit_distance(*coded(c)) for c in couples] == want


def test_table_in_blocks_bits_and_batches_give_the_same_script(monkeypatch):
    rng = random.Random(3)
    a, b = ([" ".join(rng.choices("ab c", k=rng.randint(0, 40))) for _ in range(60)] for _ in range(2))
    monkeypatch.setattr(pairs, "LONG", 1 << 60)
    whole = pairs.align_pairs(coded(a), coded(b))
    monkeypatch.setattr(pairs, "CELLS", 50)
    blocks = pairs.align_pairs(coded(a), coded(b))
    monkeypatch.setattr(pairs, "LONG", 0)
    by_bits = pairs.align_pairs(coded(a), coded(b))
    monkeypatch.setattr(bits, "BLOCK_BITS", 64)
    bit_blocks = pairs.align_pairs(coded(a), coded(b))
    assert whole[1] == blocks[1] == by_bits[1] == bit_blocks[1]


@settings(max_examples=60, deadline=None)
@given(words, words, st.integers(0, 12))
def test_band_is_exact_up_to_its_width(a, b, width):
    scores, ops = pairs.align_pairs(coded([a]), coded([b]), bandwidth=width)
    distance = levenshtein(a, b)
    assert replay(a, b, ops[0]) == scores[0] >= distance
    assert distance > width or scores[0] == distance


def test_band_reaches_the_last_row():
    scores, ops = pairs.align_pairs(coded(["A"]), coded(["AB"]), bandwidth=1)
    assert (scores[0], ops[0]) == (1, "MI")


def test_own_match_predicate_sees_symbols_and_positions():
    ignore_first = lambda p, t, v, h: (p == t) | (v == 0)
    for kernel in (pairs.align_pairs, pairs.wavefront_pairs):
        assert kernel(coded(["XBC"]), coded(["ABC"]), ignore_first)[0][0] == 0


def test_byte_and_character_units():
    assert bits.bit_distance(pairs.symbols("é"), pairs.symbols("e")) == 2
    assert bits.bit_distance(pairs.symbols("é", "char"), pairs.symbols("e", "char")) == 1


def random_graph(rng, size=6):
    count = rng.randint(1, size)
    texts = ["".join(rng.choices("ACG", k=rng.randint(0, 5))) for _ in range(count)]
    preds = [rng.sample(range(v), rng.randint(0, min(v, 3))) for v in range(count)]
    return texts, preds, "".join(rng.choices("ACG", k=rng.randint(0, 12)))


def test_graph_aligners_agree_with_path_enumeration():
    rng = random.Random(11)
    for _ in range(300):
        texts, preds, query = random_graph(rng)
        routes = graph_paths(preds)
        want = min(levenshtein(query, "".join(texts[v] for v in r)) for r in routes)
        for kernel in (dags.table_align, waves.wavefront_align):
            score, path = kernel(pairs.symbols(query), coded(texts), preds)
            assert [v for v, _ in path] in routes
            spelled = "".join(texts[v] for v, _ in path)
            assert score == want == replay(query, spelled, "".join(o for _, o in path))


def test_affine_costs_agree_with_path_enumeration():
    rng = random.Random(12)
    choices = [affine.Penalties(), affine.UNIT, affine.Penalties(3, 1, 2), affine.Penalties(5, 0, 1)]
    for _ in range(150):
        texts, preds, query = random_graph(rng)
        cost = rng.choice(choices)
        want = min(
            gap_affine(query, "".join(texts[v] for v in r), cost.mismatch, cost.gap_open, cost.gap_extend)
            for r in graph_paths(preds)
        )
        for kernel in (affine.affine_table, affine.affine_wavefront):
            assert kernel(pairs.symbols(query), coded(texts), preds, cost) == want


def test_orders_are_topological_and_keep_aligned_nodes_together():
    rng = random.Random(5)
    for _ in range(100):
        count = rng.randint(1, 9)
        edges = [(u, v, 1) for v in range(count) for u in rng.sample(range(v), rng.randint(0, min(v, 3)))]
        preds, succs, _ = orders.neighbours(count, edges)
        peers = [[] for _ in range(count)]
        for order in (orders.newest_first(preds, succs), orders.aligned_depth_first(preds, peers)):
            at = {v: r for r, v in enumerate(order)}
            assert sorted(order) == list(range(count)) and all(at[u] < at[v] for u, v, _ in edges)


def test_cycles_are_refused():
    preds, succs, _ = orders.neighbours(3, [(0, 1, 1), (1, 2, 1), (2, 1, 1)])
    with pytest.raises(orders.CyclicGraph):
        orders.newest_first(preds, succs)
    with pytest.raises(orders.CyclicGraph):
        orders.aligned_depth_first(preds, [[], [], []])


def test_branch_completion_sets_rivals_aside():
    # node 3 is best but no sink; its successor 4 prefers the heavier edge from 2
    edges = [(0, 1, 10), (1, 3, 9), (0, 2, 1), (2, 4, 5), (3, 4, 4)]
    preds, succs, weights = orders.neighbours(5, edges)
    _, path = orders.heaviest_path([0, 1, 2, 3, 4], preds, succs, weights)
    assert path == [0, 1, 3, 4]


def test_score_table_is_the_textbook_table():
    table = pairs.score_table(*coded(["ACGT", "AGT"]))
    assert np.array_equal(table, [[levenshtein("ACGT"[:v], "AGT"[:h]) for v in range(5)] for h in range(4)])


def test_long_wavefronts_and_bands_equal_the_short_ones(monkeypatch):
    rng = random.Random(31)
    some = lambda: pairs.symbols("".join(rng.choices("abc", k=rng.randint(0, 25))))
    left, right = [some() for _ in range(60)], [some() for _ in range(60)]
    scores, scripts = pairs.wavefront_pairs(left, right)
    assert [pairs.long_wavefront(a, b) for a, b in zip(left, right)] == list(zip(scores, scripts))
    banded = pairs.align_pairs(left, right, bandwidth=5)
    full = pairs.align_pairs(left, right)
    for i, score in enumerate(full[0]):
        assert score > 5 or (banded[0][i], banded[1][i]) == (score, full[1][i])
    monkeypatch.setattr(pairs, "CELLS", 40)
    again = pairs.align_pairs(left, right, bandwidth=5)
    assert list(again[0]) == list(banded[0]) and again[1] == banded[1]


def test_wavefronts_of_long_near_strings():
    """Work follows the distance: 60,000 symbols, 40 edits."""
    rng = random.Random(8)
    text = rng.choices("acgt", k=60_000)
    other = list(text)
    for at in rng.sample(range(60_000), 40):
        other[at] = "n"
    (score,), (script,) = pairs.wavefront_pairs([pairs.symbols("".join(text))], [pairs.symbols("".join(other))])
    assert score == 40 == script.count("X") and len(script) == 60_000


def test_large_tables_give_the_same_as_small_ones():
    """Any bound on the cells held together gives equal scores, replayed scripts, and free ends."""
    rng = random.Random(21)
    made = [random_graph(rng) for _ in range(150)]
    graphs = [dags.Graph(coded(texts), preds) for texts, preds, _ in made]
    patterns = [pairs.symbols(query) for *_, query in made]
    for end in ("global", "query"):
        want = [score for score, _ in dags.align_all(graphs, patterns, end=end)]
        for cells in (5, 60, 1000):
            for found in (dags.align_all(graphs, patterns, end=end, cells=cells), waves.wave_all(graphs, patterns, end=end, cells=cells)):
                assert [score for score, _ in found] == want
                for (score, path), (texts, _, query) in zip(found, made):
                    ops = "".join(o for _, o in path)
                    spelled = "".join(texts[v] for v, _ in path)
                    spelled = spelled[: len(ops) - ops.count("D")] if end == "query" else spelled
                    assert replay(query, spelled, ops) == score


def affine_cost_of(ops, cost):
    gaps = [len(list(run)) for op, run in groupby(ops) if op in "ID"]
    return ops.count("X") * cost.mismatch + ops.count("M") * cost.match + sum(cost.gap_open + n * cost.gap_extend for n in gaps)


def test_affine_scripts_cost_what_they_say():
    rng = random.Random(22)
    made = [random_graph(rng) for _ in range(150)]
    graphs = [dags.Graph(coded(texts), preds) for texts, preds, _ in made]
    patterns = [pairs.symbols(query) for *_, query in made]
    for cost in (affine.Penalties(), affine.Penalties(3, 1, 2), affine.Penalties(2, 5, 1, 1)):
        for cells in (9, 200, 1 << 22):
            for (score, path), (texts, preds, query) in zip(dags.align_all(graphs, patterns, affine.AffineCosts(cost), cells=cells), made):
                ops, spelled = "".join(o for _, o in path), "".join(texts[v] for v, _ in path)
                assert [v for v, _ in path] in graph_paths(preds)
                replay(query, spelled, ops)
                assert affine_cost_of(ops, cost) == score
                if cost.match == 0:
                    assert score == min(
                        gap_affine(query, "".join(texts[v] for v in r), cost.mismatch, cost.gap_open, cost.gap_extend)
                        for r in graph_paths(preds)
                    )


def test_fronts_hold_the_furthest_place_of_every_diagonal():
    rng = random.Random(23)
    for _ in range(150):
        texts, preds, query = random_graph(rng)
        graph, pattern = dags.Graph(coded(texts), preds), pairs.symbols(query)
        final, want = dags.align_all([graph], [pattern])[0][0], {}
        for i, h, column in dags.segment_tables(graph, pattern):
            for v, score in enumerate(column.tolist()):
                if score <= final:
                    want[score, i, h - v] = max(want.get((score, i, h - v), -1), h)
        columns = (x.tolist() for x in waves.front_rows(graph, pattern))
        assert {(s, i, k): reach for s, i, k, reach in zip(*columns)} == want


def test_graphs_grow_by_alignment():
    """Paths spell their sequences, graphs stay acyclic, and edits explain every new node."""
    rng = random.Random(24)
    texts = [["".join(rng.choices("ACG", k=rng.randint(0, 14))) for _ in range(rng.randint(1, 6))] for _ in range(40)]
    texts += [["ACGT"] * 5, ["", "AC", ""], []]
    graphs, added = growing.fold([[pairs.symbols(t, "char") for t in ts] for ts in texts])
    for ts, graph, found in zip(texts, graphs, added):
        orders.newest_first(graph.preds, graph.succs)
        assert ["".join(chr(graph.symbols[v]) for v in path) for _, path in found] == ts
        assert len(graph.symbols) <= sum(score for score, _ in found)
        for t, (_, path) in zip(ts, found):
            assert all(a in graph.preds[b] for a, b in zip(path, path[1:]))
        for v, peers in enumerate(graph.aligned):
            column = [v, *peers]
            assert all(set(column) == {u, *graph.aligned[u]} for u in column)
            assert len({graph.symbols[u] for u in column}) == len(column)
        if len(ts) > 1 and ts[0] and ts[1]:
            assert found[1][0] == levenshtein(ts[0], ts[1])
    assert len(graphs[40].symbols) == 4 and added[40][4][0] == 0
