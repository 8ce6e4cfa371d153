"""Operators on small models against enumeration: machines, junction trees, structured RNA, blocked alignment, bitmaps of places."""

import itertools
import random
from functools import cache

import numpy as np
import pytest
from lodestone.functions import special
from lodestone.operators import align, align_blocks, covariance, graph_models, machines, phylogeny, tree_search
from lodestone.sources import files, outputs


@pytest.mark.parametrize("kind", ["c_svc", "one_class", "epsilon_svr"])
def test_machines_meet_the_conditions_of_optimality(kind):
    rng = np.random.default_rng(1)
    for _ in range(5):
        x = rng.normal(size=(30, 4))
        target = x[:, 0] + 0.3 * rng.normal(size=30) if kind == "epsilon_svr" else np.where(x[:, 0] > 0, 1.0, -1.0)
        gram = machines.kernel("rbf", x, x, 0.5)
        coef, rho = machines.train(kind, gram, target, c=1.5, nu=0.3, epsilon=0.1, eps=1e-7)
        assert machines.optimality_gap(kind, gram, target, coef, rho, c=1.5, epsilon=0.1) < 1e-4
        if kind == "one_class":
            assert coef.sum() == pytest.approx(9) and coef.min() >= 0 and coef.max() <= 1 + 1e-9
        elif kind == "epsilon_svr":
            assert coef.sum() == pytest.approx(0, abs=1e-6) and np.abs(coef).max() <= 1.5 + 1e-9
        else:
            assert coef.sum() == pytest.approx(0, abs=1e-6)


def test_nu_machines_agree_with_their_other_form():
    """A nu-SVC is a C-SVC with c = 1 / r up to scale; a nu-SVR is an epsilon-SVR with the width that it finds."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 3))
    y = np.where(x[:, 0] + 0.5 * rng.normal(size=40) > 0, 1.0, -1.0)
    gram = machines.kernel("linear", x, x)
    coef, rho = machines.train("nu_svc", gram, y, nu=0.4, eps=1e-8)
    c = np.abs(coef).max()
    other, shift = machines.train("c_svc", gram, y, c=c, eps=1e-8)
    assert np.allclose(gram @ coef - rho, gram @ other - shift, atol=1e-3)
    t = x[:, 0] + 0.2 * rng.normal(size=40)
    coef, rho = machines.train("nu_svr", gram, t, c=1.0, nu=0.3, eps=1e-8)
    error = np.abs(t - (gram @ coef - rho))
    free = (np.abs(coef) > 1e-7) & (np.abs(coef) < 1 - 1e-7)
    width = error[free].mean()
    assert np.allclose(error[free], width, atol=1e-4)
    other, shift = machines.train("epsilon_svr", gram, t, c=1.0, epsilon=width, eps=1e-8)
    assert np.allclose(gram @ coef - rho, gram @ other - shift, atol=1e-3)


def test_machines_of_many_classes_vote_and_are_saved():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(20, 2)) * 0.3 + c for c in ((0, 0), (3, 0), (0, 3))])
    y = np.repeat([2.0, 5.0, 9.0], 20)
    machine = machines.fit("c_svc", x, y, "rbf", c=10.0, gamma=1.0)
    assert (machine.predict(x) == y).all() and machine.values(x).shape == (60, 3)
    again = machines.Machine.load(machine.save(), 2)
    assert np.allclose(again.values(x), machine.values(x)) and again.labels == [2.0, 5.0, 9.0]
    with pytest.raises(ValueError):
        machines.train("nu_svc", np.eye(4), np.array([1, 1, 1, -1]), nu=0.9)


def _random_factors(rng, names, sizes, n):
    out = []
    for _ in range(n):
        scope = sorted(rng.choice(names, size=rng.integers(1, 4), replace=False).tolist())
        out.append((scope, rng.random([sizes[v] for v in scope]) + 0.05))
    return out + [([v], np.ones(sizes[v])) for v in names]


def test_junction_trees_equal_enumeration():
    rng = np.random.default_rng(4)
    for _ in range(15):
        names = list("abcdef")
        sizes = {v: int(rng.integers(2, 4)) for v in names}
        factors = _random_factors(rng, names, sizes, 7)
        evidence = {"b": 1}
        joint = graph_models._product(graph_models.with_evidence(factors, evidence), names, sizes)
        tree = graph_models.JunctionTree(factors, sizes).calibrate(evidence)
        assert tree.log_likelihood() == pytest.approx(np.log(joint.sum()))
        split = graph_models.by_components(factors, sizes, evidence)
        for k, v in enumerate(names):
            want = joint.sum(axis=tuple(i for i in range(6) if i != k))
            assert np.allclose(tree.marginal(v), want / want.sum()) and np.allclose(split[v], want / want.sum())
        best = tree.most_probable(evidence)
        assert joint[tuple(best[v] for v in names)] == pytest.approx(joint.max())


def test_series_equal_enumeration():
    rng = np.random.default_rng(5)
    model = graph_models.SeriesModel([0.6, 0.4], [[0.7, 0.3], [0.2, 0.8]], [[0.5, 0.3, 0.2], [0.1, 0.4, 0.5]])
    for n in (1, 2, 5):
        seen = [None if rng.random() < 0.2 else int(rng.integers(3)) for _ in range(n)]
        paths = {}
        for s in itertools.product(range(2), repeat=n):
            p = model.initial[s[0]]
            for t in range(n):
                p *= (model.transition[s[t - 1], s[t]] if t else 1) * (model.emission[s[t], seen[t]] if seen[t] is not None else 1)
            paths[s] = p
        total = sum(paths.values())
        p, moves, ll = model.smooth(seen)
        assert ll == pytest.approx(np.log(total)) and moves.sum() == pytest.approx(n - 1)
        for t in range(n):
            assert p[t, 1] == pytest.approx(sum(v for s, v in paths.items() if s[t]) / total)
        assert paths[tuple(model.decode(seen))] == pytest.approx(max(paths.values()))


def _plain_score(model, x, gap, insert):
    """The best score of the whole of x, by recursion over nodes and parts."""
    s = model.scores

    @cache
    def best(v, i, j):
        kind, a, b, children = model.nodes[v]
        found = [-1e9]
        if kind == "end":
            found.append(0.0 if i == j else -1e9)
        elif kind == "fork":
            found += [best(children[0], i, k) + best(children[1], k, j) for k in range(i, j + 1)]
        else:
            c = children[0]
            found.append(best(c, i, j) + gap * (2 if kind == "pair" else 1))
            lost = gap if kind == "pair" else 0
            if i < j and kind in ("left", "pair"):
                found.append(best(c, i + 1, j) + s.single[model.query[a], x[i]] + lost)
            if i < j and kind in ("right", "pair"):
                found.append(best(c, i, j - 1) + s.single[model.query[b], x[j - 1]] + lost)
            if i + 1 < j and kind == "pair":
                found.append(best(c, i + 1, j - 1) + s.pair[model.query[a], model.query[b], x[i], x[j - 1]])
        if i < j:
            found += [best(v, i + 1, j) + insert, best(v, i, j - 1) + insert]
        return max(found)

    return best(len(model.nodes) - 1, 0, len(x))


def test_structured_search_equals_recursion():
    rng = random.Random(6)
    for structure in ("<<..>>", "<.>.<.>", "..", "<<>>.<.>"):
        query = "".join(rng.choices("ACGU", k=len(structure)))
        model = covariance.Model(query, structure, covariance.simple_scores())
        for _ in range(4):
            target = "".join(rng.choices("ACGU", k=rng.randint(1, 9)))
            x = covariance.codes(target)
            tables = model.fill(x, len(x))
            for end in range(1, len(x) + 1):
                for d in range(1, end + 1):
                    assert tables[-1][end, d] == pytest.approx(_plain_score(model, x[end - d : end], -3.0, -2.0))
            score, aligned, shape = model.align(target)
            assert aligned.replace("-", "").upper() == target and len(aligned) == len(shape)
            assert score == pytest.approx(tables[-1][len(x), len(x)])
            hits = model.scan(target, len(x), -100.0)
            assert max(v for *_, v in hits) == pytest.approx(tables[-1][1:, 1:].max())
    with pytest.raises(ValueError):
        covariance.pair_table("<<>")


def test_blocked_alignment_equals_the_whole_table():
    rng = random.Random(7)
    for t in range(60):
        a = "".join(rng.choices("ACGT", k=rng.randint(0, 40)))
        b = a[:15] + "TT" + a[20:] if t % 2 else "".join(rng.choices("ACGT", k=rng.randint(0, 40)))
        want = align.local_alignments(a, b, 1)
        for block in (1, 7, 64):
            score, sa, ea, sb, eb, x, y = align_blocks.long_alignment(a, b, block)
            assert score == (want[0][0] if want else 0) and align_blocks.alignment_score(x, y) == score
            assert x.replace("-", "") == a[sa:ea] and y.replace("-", "") == b[sb:eb]
    assert align_blocks.render("AC-T", "ACGT", 3) == "AC-\n|| \nACG\n\nT\n|\nT\n"


def test_constrained_joining_and_lengths():
    tree = phylogeny.parse_newick("((a:0.1,b:0.2):0.15,(c:0.1,d:0.3):0.2,(e:0.25,f:0.1):0.1);")
    names = sorted(tree.leaves())
    paths = phylogeny.path_distances(tree)
    d = np.array([[paths.get((min(a, b), max(a, b)), 0.0) for b in names] for a in names])
    free = tree_search.constrained_joining(names, d, phylogeny.Node("", 0, [phylogeny.Node(n) for n in names]))
    assert phylogeny.same_topology(free, tree) and all(abs(phylogeny.path_distances(free)[k] - v) < 1e-9 for k, v in paths.items())
    for text in ("((a,c),b,d,e,f);", "((a,c,e),(b,d,f));"):
        constraint = phylogeny.parse_newick(text)
        assert phylogeny.satisfies(tree_search.constrained_joining(names, d, constraint), constraint)


def test_files_round_trip():
    rows = [("one", "ACGT-ACGTTA" * 9), ("two", "AC-TTACG--A" * 9)]
    for kind in ("fasta", "pir", "genbank", "embl", "ig", "stockholm", "clustal", "msf", "selex", "nexus", "phylip"):
        back = [(i, s.upper()) for i, _, s in files.parse_sequences(outputs.format_sequences(rows, kind))]
        want = [(i, s.replace("-", "") if kind in ("genbank", "embl") else s) for i, s in rows]
        assert back == want, kind
    records = [b"", b"abc", bytes(300)]
    assert outputs.unpack_records(outputs.pack_records(records)) == records
    with pytest.raises(ValueError):
        outputs.unpack_records(outputs.pack_records([b"abcd"])[:-1] + b"\x07")


def test_subsets_and_roots():
    assert list(iter(lambda p=[[0, 1]]: p.__setitem__(0, special.next_subset(p[0], 4)) or p[0], None)) == [[0, 2], [0, 3], [1, 2], [1, 3], [2, 3]]
    assert special.brent_root(lambda x: x**5 - 3, 0, 3) == pytest.approx(3**0.2)
    with pytest.raises(ValueError):
        special.brent_root(lambda x: x * x + 1, -1, 1)
