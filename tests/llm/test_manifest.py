"""The Merkle manifest against a plain recursion with hashlib."""

import hashlib
import zlib

import numpy as np
import pytest

from treegauge.llm import manifest
from treegauge.llm import sha_states as sha

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def digest(row, text):
    return h(field(row[0]) + field(row[3]) + field(row[2]) + field(row[4]) + field(text))


def grow(nodes):
    """The root, and for every node the (left, right) siblings on its way up."""
    paths, groups, now = [[] for _ in nodes], [[i] for i in range(len(nodes))], list(nodes)
    while len(now) > 1:
        runs = [now[a:a + 3] for a in range(0, len(now), 3)]
        for a, run in enumerate(runs):
            for k in range(len(run)):
                for i in groups[3 * a + k]:
                    paths[i].append((run[:k], run[k + 1:]))
        groups = [sum(groups[a:a + 3], []) for a in range(0, len(now), 3)]
        now = [h("".join(run)) for run in runs]
    return now[0], paths


def expected(rows):
    trees = {}
    for s in {r[3] for r in rows}:
        mine = sorted(((r[0] is not None, r[0] or 0, digest(r, r[1]), r) for r in rows if r[3] == s), key=lambda x: x[:3])
        trees[s] = mine, *grow([x[2] for x in mine])
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    root, over = grow([trees[s][1] for s in order])
    out = []
    for j, s in enumerate(order):
        for (_, _, leaf, r), path in zip(trees[s][0], trees[s][2]):
            turned = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            folded, proof = digest(r, r[1].replace("\n", "") if turned else r[1]), ""
            for left, right in path + over[j]:
                folded, proof = h("".join(left) + folded + "".join(right)), proof + "".join(left + right)
            out.append((r[0], leaf, trees[s][1], root, h(proof), folded, folded == root))
    return out


def by_text(row):
    return tuple(map(str, row))


AWKWARD = [(None, "a\nb", None, None, None), (None, "a\nb", None, None, None), (7, None, "x", "hot", 1), (7, "", "x", "hot", 1),
           (10**17 + 1, "ä\n", "é", "ü", 3), (-5, "q\n", "q", "hot", 1), (8, "long\n" * 200_000, "x", "", 9)]


@pytest.mark.parametrize("rows", [
    AWKWARD, AWKWARD[:1], AWKWARD[2:4], [AWKWARD[4]] * 5,
    [(i, f"text {i}\nmore" if i % 3 else f"t{i}", "en", "hot" if i < 2300 else f"s{i % 40}", i) for i in range(2500)],
    [(i, f"{i}\n", None, f"s{i}", None) for i in range(800)],  # more trees than one page of the top tree holds
])
def test_manifest_against_recursion(spark, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", pos string")  # an extra column with a name used inside
    got = [tuple(r) for r in manifest.verify_documents(docs).collect()]
    assert sorted(got, key=by_text) == sorted(expected(rows), key=by_text)


def test_empty_table(spark):
    assert manifest.verify_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_states_are_taken_up_again(spark):
    texts = [h(str(i)) for i in range(40)]
    blocks = sha.blocks_of(texts)
    assert sha.texts_of(blocks) == texts
    before = sha.states_of(sha.bytes_of(sha.take_up(sha.start_states(20), blocks[::2])))
    got = sha.texts_of(sha.finish(sha.take_up(before, blocks[1::2]), np.full(20, 2)))
    assert got == [h(a + b) for a, b in zip(texts[::2], texts[1::2])]


def test_parents_keep_the_state_before_each_child(spark):
    rows = [(i, f"t{i}", None, "a", None) for i in range(10)]
    built = manifest.build(spark.createDataFrame(rows, DOCS))
    leaves = [r.digest for r in built.leaves.orderBy("pos").collect()]
    first = built.nodes().where("tree = 'sa' and level = 1 and pos = 0").first()
    states = [bytes(first.states)[32 * k:32 * k + 32] for k in range(3)]
    assert states[0] == sha.bytes_of(sha.start_states(1))[0]
    assert states[2] == sha.bytes_of(sha.take_up(sha.states_of([states[1]]), sha.blocks_of([leaves[1]])))[0]
    resumed = sha.finish(sha.take_up(sha.states_of([states[2]]), sha.blocks_of([leaves[2]])), np.array([3]))
    assert sha.texts_of(resumed) == [first.digest] == [h("".join(leaves[:3]))]
