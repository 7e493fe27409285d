"""Corpus operators on awkward inputs and against brute-force versions."""

import hashlib
import itertools
import math
import random
import re
import textwrap
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from treegauge.llm import bpe, components, flat_graph, licenses, line_dedup, mixing, near_texts, near_vectors, quality, sharding, token_counts, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, content string, range int, size int"


def frame(spark, rows):
    """Documents with extra columns whose names clash with names used inside the operators."""
    return spark.createDataFrame([(i, t, "en", s, None, "x", 1, 2) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def awkward(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    body = [" ".join(rng.choices(words, k=60)) for _ in range(12)]
    long = "\n".join(" ".join(rng.choices(words, k=30)) for _ in range(800))
    rows = [(k, t, f"s{k % 3}") for k, t in enumerate(body)]
    rows += [(20, body[0], "s0"), (21, body[0].upper(), None), (22, body[1] + " extra", "s1"), (22, body[1] + " extra", "s1"), (23, None, "s2"),
             (24, "", None), (None, body[2], "s2"), (None, None, None), (25, " \t\n ", "s0"), (26, long, "s0"), (27, "short", "s1"),
             (28, body[3] + "\n" + body[4] + "\n" + body[3], "s1"), (29, body[3].replace(" ", "  ", 3), "s0"), (30, "é́ <|endoftext|> ΑΣ Σ\x85b\x1cc " * 30, "s1")]
    return rows


def test_empty_tables(spark):
    docs = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    for out in (mixing.mix_sources(docs), licenses.scan_licenses(docs), sharding.place(docs), quality.score_documents(docs),
                toxicity.score_toxicity(docs, labels), near_texts.join_near_texts(docs), line_dedup.duplicate_lines(docs),
                near_vectors.near_vectors(vectors), bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json")),
                token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)):
        assert out.count() == 0


def test_near_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 16))
    x[300:420] = x[6] + 0.02 * rng.normal(size=(120, 16))
    x[500:520] = x[7]
    rows = [(k, [float(v) for v in np.float32(x[k])], k % 2 if k < 200 else 0) for k in range(900)]
    rows += [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [math.nan] * 16, 0), (2003, rows[5][1], None), (2004, [1.0, None], 0), (None, rows[5][1], 0),
             rows[5], (2005, rows[5][1][:8], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in near_vectors.near_vectors(df, shard=64).collect()}
    y = np.array([r[1] for r in rows[:900]], dtype=np.float64)
    y /= np.linalg.norm(y, axis=1)[:, None]
    label = np.array([r[2] for r in rows[:900]])
    near = (y @ y.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    found = np.array([got[k].n_links for k in range(900)])
    assert (found <= near.sum(axis=1)).all() and found.sum() >= 0.97 * near.sum()
    assert got[2000].n_links == got[2001].n_links == got[2002].n_links == got[2003].n_links == got[2005].n_links == 0
    assert got[419].component_id == 6 and not got[419].kept and got[6].kept
    result = near_vectors.near_vectors(df, shard=64)
    assert near_vectors.audit_recall(df, result) >= 0.9


def test_flat_graph_finds_its_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = flat_graph.build(x)
    met = flat_graph.search(x, graph, x[:200], np.full((200, 1), flat_graph.medoid(x)))
    assert (met.argmax(axis=1) == np.arange(200)).mean() > 0.9


def test_line_dedup(spark):
    a = "one two three four five six seven eight nine ten eleven"
    rows = [(1, a, "s"), (2, f"x\n{a.upper()}", "s"), (3, a.replace("five", "FIVER"), "s"), (4, a + " twelve", "s"), (5, a.replace(" six", ""), "s"),
            (6, a.replace("one", "uno").replace("ten", "diez"), "s"), (7, "a b c\na b c", "s"), (8, None, "s"), (9, "", None), (None, a, "s"), (1, a, "s"),
            (10, "p q r s t\np q r s t\n" + "p q r s u", "s")]
    got = {(r.doc_id, r.line_no): (r.first_doc_id, r.edits) for r in line_dedup.duplicate_lines(frame(spark, rows)).collect()}
    assert got == {(2, 1): (1, 0), (3, 0): (1, 1), (4, 0): (1, 1), (5, 0): (1, 1), (None, 0): (1, 0), (10, 1): (10, 0)}
    cleaned = [(r.doc_id, r.text) for r in line_dedup.drop_duplicate_lines(frame(spark, rows)).collect()]
    assert len(cleaned) == len(rows) and (2, "x") in cleaned and (8, None) in cleaned and cleaned.count((1, a)) == 2


def test_line_dedup_against_all_pairs(spark):
    rng = random.Random(5)
    base = [rng.choices("abcdef", k=rng.randint(9, 13)) for _ in range(25)]
    lines = []
    for _ in range(250):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            at, what = rng.randrange(len(words)), rng.randrange(3)
            words[at:at + 1] = [[], [rng.choice("abcdef")], [words[at], rng.choice("abcdef")]][what]
        lines.append(words)

    def apart(x, y):
        if len(x) == len(y):
            return sum(p != q for p, q in zip(x, y))
        short, long = sorted((x, y), key=len)
        return 1 if len(long) - len(short) == 1 and any(long[:k] + long[k + 1:] == short for k in range(len(long))) else 9

    expected = {}
    for i, x in enumerate(lines):
        equal = [j for j in range(i) if lines[j] == x]
        firsts = {tuple(y): k for k, y in reversed(list(enumerate(lines)))}
        near = [j for j in set(firsts.values()) if j < i and apart(lines[j], x) == 1 and max(len(lines[j]), len(x)) >= line_dedup.EDIT_WORDS]
        if equal:
            expected[i] = (min(equal), 0)
        elif near:
            expected[i] = (min(near), 1)
    got = line_dedup.duplicate_lines(frame(spark, [(i, " ".join(w), "s") for i, w in enumerate(lines)])).collect()
    assert {r.doc_id: (r.first_doc_id, r.edits) for r in got} == expected


def test_token_counts(spark, awkward):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoder, lengths = token_counts._encoder(path, public_tokenizers.PATTERN)
    got = Counter()
    for r in token_counts.count_tokens(frame(spark, awkward), path, public_tokenizers.PATTERN).collect():
        got[r.doc_id, r.section, r.n_tokens, r.n_crossing] += 1
    expected = Counter()
    for i, text, _ in awkward:
        lines, at, owner = (text or "").split("\n"), 0, []
        for k, line in enumerate(lines):
            owner += [k] * (len(line.encode()) + (k < len(lines) - 1))
        n, crossing = Counter(), Counter()
        for token in encoder.encode_ordinary(text or ""):
            mine = Counter(owner[at:at + lengths[token]])
            section = max(mine, key=lambda s: (mine[s], -s))
            n[section] += 1
            crossing[section] += len(mine) > 1
            at += lengths[token]
        for k in range(len(lines)):
            expected[i, k, n[k], crossing[k]] += 1
    assert got == expected
    starts, crossed = token_counts.allocate(np.array([3, 6]), np.array([2, 6]), "start")
    assert starts.tolist() == [0, 1] and crossed.tolist() == [True, False]
    assert token_counts.allocate(np.array([3, 6]), np.array([1, 6]), "majority")[0].tolist() == [1, 1]


def test_bpe_is_the_tokenizers_own(spark, awkward):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    expected = []
    for i, text, _ in awkward:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    got = [tuple(r) for r in bpe.encode_documents(frame(spark, awkward), path, cut_bits=2).collect()]
    assert Counter(got) == Counter(expected)


def test_bpe_mends_joins_that_do_not_agree(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    text = b"alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega " * 4
    batch = bpe.Batch([text], 1)
    chunks = [batch.chunk(i) for i in range(len(batch.spans))]
    asked = []

    def disagree(path, lefts, rights, ids):
        asked.append(len(lefts))
        return np.array([len(a) % 2 == 0 for a in lefts], dtype=bool)

    monkeypatch.setattr(bpe, "joins_agree", disagree)
    units, ids = bpe.mended_units(path, batch, chunks, np.zeros(len(chunks), dtype=bool))
    assert len(asked) > 1 and 1 < len(units) < len(chunks)  # joins of mended chunks are checked anew
    assert [a for a, _ in units[1:]] == [b for _, b in units[:-1]] and units[-1][1] == len(chunks)
    rows = bpe._encode_batch(path, 1, np.zeros(1 << 10, dtype=np.uint32), [1], [text], set())
    expected = Tokenizer.from_file(path).encode(text.decode(), add_special_tokens=False).ids
    assert np.concatenate(ids).tolist() == expected
    assert rows[0][2] == len(expected) and rows[0][3] == hashlib.sha256(np.array(expected, dtype="<u4").tobytes()).hexdigest()


def test_bpe_encodes_a_chunk_once_and_as_one_text(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    text = " ".join(f"word{k % 13} it's {k}" for k in range(400)).encode()
    batch = bpe.Batch([text, text], 4)
    chunks = [batch.chunk(i) for i in range(len(batch.spans))]
    encoded = []
    own = bpe.text_ids
    monkeypatch.setattr(bpe, "text_ids", lambda path, texts: encoded.extend(texts) or own(path, texts))
    bpe.mended_units(path, batch, chunks, np.zeros(len(chunks), dtype=bool))
    assert len(chunks) > 4 and sorted(encoded) == sorted(set(chunks))


def test_bpe_chunks_from_words_are_those_of_their_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [" ".join(f"Word{k % 13}'s \u00e9t\u00e9 {k}, <|endoftext|>x" for k in range(200)).encode(), b"", b"one", b"\xe4\xb8\xad\xcc\x81 \xcc\x81a"]
    batch = bpe.Batch(texts, 3)
    chunks = [batch.chunk(i) for i in range(len(batch.spans))]
    which = list(range(0, len(chunks), 2))
    got = bpe.ids_by_words(path, batch, which)
    assert [x.tolist() for x in got] == [x.tolist() for x in bpe.text_ids(path, [chunks[i] for i in which])]


def test_bpe_normalises_like_the_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    signs = [chr(c) for c in [*range(1, 9), *range(14, 0x250), *range(0x300, 0x310), *range(0x390, 0x3d0), *range(0x2000, 0x20b0), 0x1e9e, 0x212b, 0xfb01]]
    texts = [f"Aa{x}Bb {x}'S \u00c9{x} 9{x}" for x in signs] + [
        "x<|endoftext|>Y", "x<|ENDOFTEXT|>Y", "\u0130STANBUL", "\u039f\u0394\u039f\u03a3 \u03a3", "E\u0301cole \u00c9COLE", ""]
    got = bpe.word_ids(path, [t.encode() for t in texts])
    assert [ids.tolist() for ids in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_bpe_chunks_end_in_periodic_texts():
    batch = bpe.Batch([b"a " * 50_000, b"b"], 30)
    assert max(b - a for a, b in batch.spans) <= bpe.MOST_WORDS and batch.text_of[-1] == 1


def test_bpe_tokenizers_that_look_across_spaces_take_whole_texts(spark, awkward):
    assert bpe.misfit(public_tokenizers.path("word_bpe_49k.json")) is None
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert bpe.misfit(path) is not None
    tokenizer = Tokenizer.from_file(path)
    got = Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in bpe.encode_documents(frame(spark, awkward), path).collect())
    expected = Counter()
    for i, text, _ in awkward:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        expected[i, len(ids), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == expected


def test_mixing(spark, awkward):
    rows = mixing.mix_sources(frame(spark, awkward)).collect()
    assert len(rows) == len(awkward)
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    assert abs(sum(r.taken for r in rows) - 1.5 * total) <= 2 * largest
    by_target = {}
    for r in rows:
        assert r.taken in (0, r["size"], 2 * r["size"])
        by_target.setdefault((r.source_size, r.target), []).append(r.taken)
    for (size, target), taken in by_target.items():
        assert target <= 2 * size and abs(sum(taken) - target) <= 2 * largest
    again = mixing.mix_sources(frame(spark, list(reversed(awkward)))).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))


def test_quality_base_counts(spark, awkward):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                  for r in quality.score_documents(frame(spark, awkward)).collect())
    expected = Counter()
    for i, text, _ in awkward:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        windows = Counter(zip(words, words[1:], words[2:]))
        hit = {k + s for k in range(len(words) - 2) if windows[tuple(words[k:k + 3])] > 1 for s in range(3)}
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
        expected[i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed] += 1
    assert got == expected


def test_template_lines_deplete(spark):
    rng = random.Random(2)
    template = " ".join(f"menu{k}" for k in range(60))
    rows = [(k, template + "\n" + " ".join(f"x{rng.random()}" for _ in range(10 if k % 2 else 200)), "host") for k in range(60)]
    rows += [(100 + k, " ".join(f"y{rng.random()}" for _ in range(80)), "host") for k in range(30)]
    kept = {r.doc_id: r.kept for r in quality.score_documents(frame(spark, rows)).collect()}
    assert not kept[1] and kept[0] and kept[100]
    assert dict(quality.remove_template_lines(frame(spark, rows)).collect())[1] == rows[1][1].split("\n")[1]


def test_hot_hosts_keep_no_template_lines(spark):
    template = " ".join(f"menu{k}" for k in range(60))
    rows = [(k, template + "\n" + f"own{k}" if k < 200 else " ".join(f"y{k}x{j}" for j in range(60)), "hot") for k in range(3000)]
    kept = {r.doc_id: r.kept for r in quality.score_documents(frame(spark, rows)).collect()}
    assert not any(kept[k] for k in range(200)) and all(kept[k] for k in range(200, 3000))


def test_copies_count_as_documents(spark):
    text = " ".join(f"z{k}" for k in range(60))
    rows = [(k, text, "h") for k in range(30)] + [(50, text + "\nan end of its own", "h")]
    rows += [(60, text, None)] + [(70, text.upper(), "once")] * 30
    got = {r.doc_id: r.n_template_words for r in quality.score_documents(frame(spark, rows)).collect()}
    assert got[0] == got[29] == got[50] == 60 and got[60] == got[70] == 0


def test_near_texts_in_blocks_of_any_size(spark, awkward):
    rng = random.Random(9)
    base = [f"v{k}" for k in rng.choices(range(1000), k=120)]
    rows = list(awkward)
    for k in range(40):
        words = list(base)
        words[rng.randrange(120)] = f"n{k}"
        rows.append((100 + k, " ".join(words), "s0"))
    whole = Counter(map(tuple, near_texts.join_near_texts(frame(spark, rows)).collect()))
    assert whole == Counter(map(tuple, near_texts.join_near_texts(frame(spark, rows), block=7).collect()))
    by_id = {r[0]: r for r in whole}
    sets = {100 + k: None for k in range(40)}
    for i, text, _ in rows:
        if i in sets:
            w = text.split()
            sets[i] = {tuple(w[j:j + 5]) for j in range(len(w) - 4)}
    links = Counter()
    for a, b in itertools.combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
            links[a] += 1
            links[b] += 1
    assert all(by_id[i][2] == links[i] and by_id[i][3] == 100 for i in sets)
    assert by_id[20][1] == 0 and by_id[21][1] == 0 and not by_id[20][4] and by_id[0][4] and by_id[23][4] and by_id[24][4]
    assert near_texts.recall(0.8) > 0.999


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, 101), (101, 102), (5, 5), (102, 100), (None, 3)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{k: 1 for k in range(1, 61)}, 100: 100, 101: 100, 102: 100}


def test_licenses(spark):
    text = "Some words. Released under the MIT License.\nMore!\nlicensed under the APACHE license, version 2.0."
    rows = licenses.scan_licenses(frame(spark, [(1, text, "s"), (2, None, "s"), (3, "", "s"), (4, licenses.SENTENCES["f"] + "\n" + licenses.SENTENCES["g"], "s"), (None, text, "s")])).collect()
    got = {r.doc_id: (r.sentence_ids, r.licenses, r.license) for r in rows}
    assert got[1] == got[None] == ("ea", "Apache-2.0,MIT", "Apache-2.0")
    assert got[2] == got[3] == ("", "", None) and got[4] == ("fg", "MIT", "MIT")


APACHE = """ * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     https://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software is distributed on an "AS IS" BASIS.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */"""


def test_wrapped_licences(spark):
    def wrap(keys, sign, width=70):
        text = " ".join((licenses.SENTENCES | licenses.MORE_SENTENCES)[k] for k in keys)
        return "\n".join(sign + line for line in textwrap.wrap(text, width))

    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. "
    texts = {1: "/* Copyright\n" + APACHE, 2: "MIT License\n\n" + wrap("fgh", "# "), 3: wrap("jk", "// "), 4: wrap("oq", "REM ", 50),
             5: licenses.SENTENCES["o"] + " 1. Redistributions of source code. 3. " + licenses.SENTENCES["p"] + "\r\n" + wrap("q", "; "),
             6: mpl + "2.0.", 7: mpl + "1.1.", 8: wrap("B", " * "), 9: "It was released under the MIT\nLicense. No more.", 10: wrap("e", "", 12)}
    got = {r.doc_id: (r.sentence_ids, r.license) for r in licenses.scan_licenses(frame(spark, [(k, t, "s") for k, t in texts.items()])).collect()}
    assert got == {1: ("bcd", "Apache-2.0"), 2: ("fgh", "MIT"), 3: ("jk", "GPL-3.0-or-later"), 4: ("oq", "BSD-2-Clause"), 5: ("opq", "BSD-3-Clause"),
                   6: ("r", "MPL-2.0"), 7: ("", None), 8: ("B", "LGPL-2.1-or-later"), 9: ("", None), 10: ("e", "MIT")}


def test_maximal_segments_against_the_definition():
    rng = random.Random(4)
    for _ in range(200):
        values = np.array([rng.choice([-3, -2, -1, 1, 2, 3]) for _ in range(rng.randint(0, 30))], dtype=float)

        def best(lo, hi, values):
            sums = [(values[a:b].sum(), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)]
            top = max(sums, default=(0,))
            return [] if top[0] <= 0 else best(lo, top[3], values) + [(top[3], top[4], top[0])] + best(top[4], hi, values)

        shift = values + np.linspace(0.01, 0.02, len(values)) ** 2  # no ties: the definition names the segments
        got, expected = toxicity.maximal_segments(shift), best(0, len(values), shift)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in expected]
        assert [s for *_, s in got] == pytest.approx([s for *_, s in expected])


def test_evidence_of_several_segments_adds_up():
    one, two = toxicity.joint_evidence([4.0]), toxicity.joint_evidence([4.0, 4.0])
    assert one == 4.0 and two > 5 and toxicity.joint_evidence([]) == -math.inf
    assert toxicity.joint_evidence([4.0, -3.0]) == 4.0


def test_toxic_stems_add_up_and_short_beginnings_do_not_borrow(spark):
    rng = random.Random(5)
    parts = ["ka", "lo", "mi", "ru", "se", "ta", "ne", "po", "vu", "gi"]
    rows, labels = [], []
    for i in range(1200):
        text = ["".join(rng.choices(parts, k=4)) for _ in range(80)]
        if i % 6 == 0:
            for _ in range(5):
                text[rng.randrange(80)] = "zorka" + "".join(rng.choices(parts, k=2))
        elif i % 2:
            text[3] = "zor" + "".join(rng.choices(parts[1:], k=3))
        rows.append((i, " ".join(text), "s"))
        labels.append((i, int(i % 6 == 0)))
    docs, labels = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    assert "zorka" in model.scores and "zor" not in model.scores
    got = toxicity.score_toxicity(docs, labels).where("held_out").collect()
    assert np.mean([r.predicted == (r.doc_id % 6 == 0) for r in got]) > 0.98


def test_the_labelled_sample_is_bounded_in_rows(spark):
    docs = frame(spark, [(k % 7, f"text {k}", "s") for k in range(300)])
    labels = spark.createDataFrame([(k, 1) for k in range(7)], "doc_id long, toxic int")
    assert toxicity.labelled_sample(docs, labels, 2).count() <= 2


def test_toxicity_learns_and_never_from_held_out_rows(spark):
    rng = random.Random(8)
    words, bad = [f"q{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(600)], ["vile", "awful", "nasty"]
    rows, labels = [], []
    for i in range(1500):
        text = rng.choices(words, k=80)
        toxic = i % 6 == 0
        for _ in range(5 * toxic):
            text[rng.randrange(80)] = rng.choice(bad)
        rows.append((i, " ".join(text), "s"))
        labels.append((i, int(toxic)))
    rows += [(9000, None, "s"), (9001, "", "s"), (None, "vile awful nasty vile awful", "s")]
    docs = frame(spark, rows)
    frame_labels = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, frame_labels).collect()}
    held = [i for i, _ in labels if got[i].held_out]
    assert np.mean([got[i].predicted == (i % 6 == 0) for i in held]) > 0.97
    assert got[9000].score == got[9001].score < 0.5 and got[None].predicted == 1
    turned = spark.createDataFrame([(i, 1 - t if got[i].held_out else t) for i, t in labels], "doc_id long, toxic int")
    assert {r.doc_id: r.score for r in toxicity.score_toxicity(docs, turned).collect()} == {i: r.score for i, r in got.items()}
    kept = toxicity.drop_toxic(docs, frame_labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got.values())


def test_sharding(spark, tmp_path):
    table = sharding.lookup_table()
    loads = Counter(table)
    assert max(loads.values()) - min(loads.values()) <= 1
    fewer = sharding.lookup_table(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(table, fewer) if a != len(sharding.SHARDS) - 1)
    assert moved < 0.1 * len(table)
    docs = frame(spark, [(k, "t", "s") for k in range(200)] + [(None, "t", "s"), (7, "u", "s")])
    placed = {(r.doc_id, r.shard) for r in sharding.place(docs).collect()}
    assert len(placed) == 201
    shard = sharding.write_shards(docs, str(tmp_path / "out"))
    back = sharding.read_shards(docs, str(tmp_path / "out"), shard)
    assert {(r.doc_id, r.shard) for r in back.collect()} == placed and back.count() == 202
    assert Counter(map(tuple, back.drop(shard).collect())) == Counter(map(tuple, docs.collect()))
    got = sharding.shard_documents(docs)
    assert {(r.doc_id, r.shard) for r in got.collect()} == placed and got.count() == 202
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_a_hot_id_is_written_by_several_tasks(spark, tmp_path):
    long = " ".join(f"w{k}" for k in range(20_000))
    rows = [(5, f"{k} {long}", "s", k) for k in range(40)] + [(5, None, None, 0), (5, "", "s", 0), (5, "", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Shard string, slot int").repartition(8)
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        shard = sharding.write_shards(docs, str(tmp_path / "hot"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert shard == "shard_"
    back = sharding.read_shards(docs, str(tmp_path / "hot"), shard)
    assert Counter(map(tuple, back.drop(shard).collect())) == Counter(rows)
    assert back.select(shard).distinct().count() == 1 and len(back.inputFiles()) > 2


def test_several_vectors_or_texts_under_one_id(spark):
    e1, e2 = [1.0, 0.0, 0.1], [0.0, 1.0, 0.1]
    rows = [(1, e1, 1), (1, e2, 1), (2, [1.0, 0.01, 0.1], 1), (3, [0.01, 1.0, 0.1], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("class_id", F.lit("x"))
    got = sorted(tuple(r)[:4] for r in near_vectors.near_vectors(vectors).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]
    audited = near_vectors.audited_vectors(vectors.where("vec_id > 1 or embedding[0] > 0.5"))
    assert {r.recall for r in audited.collect()} == {1.0}
    words = [f"w{k}" for k in range(60)]
    docs = frame(spark, [(1, " ".join(words), "s"), (1, "  ".join(words).upper(), "s"), (2, " ".join(words[:58]), "s")])
    links = sorted((r.doc_id, r.n_links, r.component_id) for r in near_texts.join_near_texts(docs).collect())
    assert links == [(1, 1, 1), (1, 1, 1), (2, 1, 1)]


def test_extra_columns_with_the_names_of_helpers(spark):
    words = " ".join(f"w{k}" for k in range(30))
    rows = [(1, words, "a"), (2, words, "a"), (None, words + " x", "b"), (None, "one two three four five six", "b")]
    docs = frame(spark, rows)
    for name in ("_row_key", "_taken_row", "_times", "_equal", "_time", "_row", "_gone_lines", "_gone_id", "_gone_content"):
        docs = docs.withColumn(name, F.lit(name)).withColumn(name.upper() + "_", F.lit(1))
    for out in (mixing.mixed_rows(docs), near_texts.drop_near_texts(docs), line_dedup.drop_duplicate_lines(docs)):
        found = out.collect()
        assert out.columns == docs.columns and found and all(r["_row_key"] == "_row_key" and r["_times"] == "_times" for r in found)


def test_null_ids_are_spread_over_the_ranges_of_the_shuffle(spark):
    docs = frame(spark, [(None, f"text number {k} of many", "s") for k in range(3000)])
    taken = [r.taken for r in mixing.mix_sources(docs).collect()]
    assert sum(taken) == 1.5 * 5 * 3000 and set(taken) == {5, 10}
