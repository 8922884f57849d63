"""Brute force, round trips, held-out accuracy and edge cases of the operators on texts."""

import base64
import hashlib
import itertools
import math
import random
import re
import time
import unicodedata

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from turnpike.llm import _components, byte_bpe, line_dedup, quality_gam, quality_rules, simhash, substring, toxicity
from turnpike.llm._components import Forest, components
from turnpike.llm._features import COUNTS, MEASURES, SPAN, measure
from turnpike.llm._text import WordHashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, as extra columns of the input.
CLASH = ("id", "fp", "h", "t", "y", "doc", "line", "site", "w", "v", "score", "predicted", "label_id", "pattern", "size", "copy", "target", "seeds")
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def frame(spark, rows, clash=True):
    full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    f = spark.createDataFrame(full, DOCS)
    return f.withColumns({c: F.lit("x") for c in CLASH}) if clash else f


def prose(rng, n, kinds=400):
    return " ".join(f"w{int(rng.paretovariate(0.9)) % kinds}{'.' if rng.random() < 0.1 else ''}" for _ in range(n))


@pytest.fixture(scope="module")
def messy(spark):
    """Nulls, empty, wordless and very long texts, copies, repeated rows, null ids and sources, clashing columns."""
    rng = random.Random(11)
    base = prose(rng, 120)
    rows = [(i, prose(rng, rng.randrange(1, 90)), f"s{i % 9}") for i in range(40)]
    rows += [(100 + i, base, f"s{i}") for i in range(12)]
    rows += [(200, base + " tail words here", "s1"), (201, "lead in " + base, "s2"), (202, base.replace("w1 ", "zz ", 1), "s3")]
    rows += [(300, None, "s1"), (301, "", "s2"), (302, " \n\t ", None), (303, "\u3000\u00a0\u3000", "s1"), (304, prose(rng, 30_000), "s4"), (305, "naïve Ünïcode 🙂 tökens", None)]
    rows += [(None, base, "s5"), (None, None, None), (7, rows[7][1], "s7"), (7, rows[7][1], "s7")]
    return rows


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (2000, 1999), (1999, 2000)] + [(rng.randrange(3000, 3100), rng.randrange(3000, 3100)) for _ in range(80)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    expected = {(n, find(n)) for e in edges for n in e if find(n) != n}
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(5))
    assert {tuple(r) for r in got.collect()} == expected
    assert components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0


def test_stars_leave_the_rounds_of_components(spark, monkeypatch):
    """A long chain takes many rounds; stars that are done are not among their rows, and every node still gets its root."""
    rng = random.Random(2)
    chain = list(range(200_000, 200_300))
    rng.shuffle(chain)
    stars = spark.range(30_000).select((F.col("id") - F.col("id") % 6).alias("a"), F.col("id").alias("b"))
    edges = stars.unionByName(spark.createDataFrame(list(zip(chain, chain[1:])), "a long, b long"))
    rows, cut = [], _components.cut

    def counted(df, *how):
        out = cut(df, *how)
        rows.append(out.count())
        return out

    monkeypatch.setattr(_components, "cut", counted)
    got = sorted(tuple(r) for r in components(edges).collect())
    assert got == [(i, i - i % 6) for i in range(30_000) if i % 6] + [(i, 200_000) for i in range(200_001, 200_300)]
    # The stars are laid down once as edges and once as done.
    assert sum(rows) < 2 * 25_000 + 10_000, rows
    rows.clear()
    monkeypatch.setattr(_components, "MOST_OPEN", 1, raising=False)
    assert sorted(tuple(r) for r in components(edges).collect()) == got and sum(rows) > 3 * 25_000


def test_forest_of_blocks():
    forest, ids = Forest(6), np.array([50, 40, 30, 20, 10, 5])
    forest.link(np.array([0, 1]), np.array([1, 2]))
    forest.link(np.array([4]), np.array([5]))
    a, b = forest.stars(ids)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == {(50, 30), (40, 30), (10, 5)}


# -- byte-level BPE


@pytest.fixture(scope="module")
def tokenizer():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBpe.from_file(PATH, public_tokenizers.PATTERN)


def test_bpe_equals_the_library(bpe, tokenizer):
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyzàéñ你好мир  \n\t\x0b\x1c\xa0\u3000²½Ⅷ0123456789.,!'🙂ก"
    texts = ["", " ", "'s 're I'LL", "a" * 5000, " " * 3000, "x\x1cy \x1d z", "\r\n \r\n"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.choice([1, 3, 20, 200]))) for _ in range(400)]
    texts += ["".join(rng.choice("abcdefgh") for _ in range(20_000))]
    for text in texts:
        assert bpe.encode(text) == tokenizer.encode_ordinary(text), text[:80]
        assert bpe.decode(bpe.encode(text)) == text.encode()


def test_bpe_of_an_odd_vocabulary():
    """Tokens that merging never reaches are used only where a piece is one of them."""
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"xyz": 259, b"aa": 260, b"aaaa": 261}
    own, other = byte_bpe.ByteBpe(ranks, r"\S+|\s+"), tiktoken.Encoding("o", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    for text in ("abc", "abcbc", "bcabc", "xyz", "xyzx", "axyz", "aaaaa", "aaaaaaa aab", "aabcab"):
        assert own.encode(text) == other.encode_ordinary(text), text


def test_bpe_query_columns(spark, messy, tokenizer):
    got = byte_bpe.encode_decode(frame(spark, messy), PATH, public_tokenizers.PATTERN).collect()
    expected = []
    for i, text, _ in messy:
        ids = tokenizer.encode_ordinary(text or "")
        expected.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    empty = byte_bpe.encode_decode(frame(spark, []), PATH, public_tokenizers.PATTERN, with_ids=True)
    assert empty.count() == 0 and empty.columns[-1] == "ids"


def test_bpe_ids_decode_to_the_text(spark):
    f = frame(spark, [(1, "héllo wörld", "s"), (2, None, "s")])
    enc = byte_bpe.encode_decode(f, PATH, public_tokenizers.PATTERN, with_ids=True)
    got = byte_bpe.decode_ids(enc, PATH, public_tokenizers.PATTERN).collect()
    assert {r.doc_id: bytes(r.bytes) for r in got} == {1: "héllo wörld".encode(), 2: b""}


# -- SimHash


def simhash_brute(rows):
    prints = []
    for _, text, _ in rows:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    low = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    low[a] = low[b] = min(low[a], low[b])
        if all(low[a] == low[low[a]] for a in range(len(rows))):
            break
    groups = {}
    for k, (i, _, _) in enumerate(rows):
        groups.setdefault(low[k], []).append(i)
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return [(i, format(prints[k], "016x"), least[low[k]]) for k, (i, _, _) in enumerate(rows)]


@pytest.mark.parametrize("how", [{}, {"leaf": 4}])
def test_simhash_against_brute_force(spark, messy, how):
    messy = messy + [(5, "another text under id five", "s1"), (5, messy[5][1] + " more", "s2"), (5, None, "s3")]
    got = simhash.near_duplicates(frame(spark, messy), **how)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(simhash_brute(messy), key=str)
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_simhash_tree_on_dense_fingerprints(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 6, dtype=np.int64)
    fps = np.unique(np.concatenate([base[k] ^ (np.int64(1) << rng.integers(0, 62, 300)) ^ (np.int64(1) << rng.integers(0, 62, 300)) for k in range(6)] + [rng.integers(0, 1 << 63, 900, dtype=np.int64)]))
    low = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    while True:
        new = np.where(near, low[None, :], len(fps)).min(axis=1)
        if (new == low).all():
            break
        low = new
    expected = {(int(i), int(low[i])) for i in range(len(fps)) if low[i] != i}
    f = spark.createDataFrame([(int(x), i) for i, x in enumerate(fps.tolist())], "fp long, rep long")
    # Leaves of one make twelve levels, two more than have radii for each node.
    for leaf, block in ((100_000, 100_000), (200, 100_000), (200, 60), (1, 100_000)):
        assert {tuple(r) for r in components(simhash.link_classes(f, leaf=leaf, block=block)).collect()} == expected


def test_simhash_keeps_one_of_each_group(spark, messy):
    f = frame(spark, messy)
    kept = simhash.keep_one(f)
    assert kept.columns == f.columns
    expected = {c for _, _, c in simhash_brute(messy) if c is not None}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(expected)


def test_unlike_rows_of_one_id_stay(spark):
    """Rows under a null id, or under one id, are judged by their texts: one of them is a copy of another document."""
    rng = random.Random(13)
    a, b, c, d = (prose(rng, 80, 4000) for _ in range(4))
    rows = [(1, a, "s"), (None, a, "s"), (None, b, "s"), (None, b, "t"), (None, c, "s"), (5, d, "s"), (5, a, "s"), (5, d, "s")]
    for keep in (simhash.keep_one, simhash.keep_dissimilar):
        got = [(r.doc_id, r.text, r.source) for r in keep(frame(spark, rows)).collect()]
        assert sorted(got, key=str) == sorted([(1, a, "s"), (None, b, "s"), (None, c, "s"), (5, d, "s")], key=str)


def shingle_sets(text):
    w = words(text.lower())
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def test_similar_texts_are_found(spark):
    """Recall of pairs from 0.8 on, and no pair below: every kept row and every row gone is compared with brute force."""
    rng = random.Random(14)
    rows, alike = [], {}
    for k in range(600):
        w = [f"v{rng.randrange(20_000)}" for _ in range(rng.choice([40, 150, 300]))]
        other = list(w)
        for _ in range(rng.randrange(1, 1 + max(1, len(w) // 35))):
            other[rng.randrange(len(w))] = "other"
        rows += [(2 * k, " ".join(w), "s"), (2 * k + 1, " ".join(other), "s")]
        x, y = shingle_sets(rows[-2][1]), shingle_sets(rows[-1][1])
        alike[2 * k + 1] = len(x & y) / len(x | y)
    gone = {i for i, _, _ in rows} - {r.doc_id for r in simhash.keep_dissimilar(frame(spark, rows)).collect()}
    due = {i for i, j in alike.items() if j >= 0.8}
    assert gone <= due and len(due) > 150 and len(alike) - len(due) > 150
    edge = {i for i in due if alike[i] < 0.85}
    assert len(gone & due) >= 0.99 * len(due) and len(gone & edge) >= 0.97 * len(edge), (len(gone), len(due), len(gone & edge), len(edge))
    print("recall", len(gone), len(due), len(gone & edge), len(edge))


@pytest.mark.parametrize(("leaf", "broadcast"), [(32_768, 1_000), (20, 0)])
def test_candidates_are_near_fingerprints(spark, leaf, broadcast):
    """Texts share a key in a table if and only if chains of fingerprints of that table, few bits apart, join them."""
    rng = random.Random(16)
    base = [[rng.getrandbits(simhash.BITS) for _ in range(simhash.PRINTS)] for _ in range(6)]
    near = lambda p: p ^ sum(1 << b for b in rng.sample(range(simhash.BITS), rng.randrange(0, 5)))
    prints = {n: [near(p) for p in base[n % 6]] for n in range(90)}
    classes = spark.createDataFrame([(n, 0, p) for n, p in prints.items()], "node long, fp long, prints array<long>")
    got = {}
    for r in simhash._near_groups(classes, leaf=leaf, broadcast=broadcast).collect():
        got.setdefault(r.key, set()).add(r.node)
    expected = []
    for k in range(simhash.PRINTS):
        todo = set(prints)
        while todo:
            group, new = set(), {min(todo)}
            while new:
                group |= new
                todo -= new
                new = {n for n in todo if any((prints[n][k] ^ prints[m][k]).bit_count() <= simhash.NEAR for m in new)}
            expected += [tuple(sorted(group))] if len(group) > 1 else []
    assert sorted(tuple(sorted(x)) for x in got.values()) == sorted(expected) and len(expected) > simhash.PRINTS * 6


def test_similar_texts_in_a_crowd(spark):
    """Near copies of one text that are not all alike are linked over others."""
    rng = random.Random(15)
    base = [f"v{rng.randrange(20_000)}" for _ in range(200)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(w), "s"))
    rows += [(300, " ".join(base).upper(), "s"), (301, None, "s"), (302, " ", "s"), (303, "two words", "s"), (304, "Two  words", "s")]
    sets = {i: shingle_sets(t or "") for i, t, _ in rows}
    low = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            low[i] = min(low[j] for j in sets if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    got = {r.doc_id for r in simhash.keep_dissimilar(frame(spark, rows)).collect()}
    # Bands are chances: text 60, 0.815 like its nearest, shares none with any of them and stays.
    assert got - set(low.values()) <= {60} and set(low.values()) <= got
    assert simhash.keep_dissimilar(frame(spark, [])).count() == 0


@pytest.mark.parametrize("bits", [1 << 26, 64])
def test_sets_are_made_without_a_shuffle_of_texts(spark, messy, monkeypatch, bits):
    """Only shingle sets of candidates are exchanged, also where a full filter passes every text; rows are the same."""
    monkeypatch.setattr(simhash, "MOST_FILTER_BITS", bits, raising=False)
    rng = random.Random(17)
    rows, plans, cut = messy + [(1000 + i, prose(rng, 60, 4000), "s") for i in range(100)], [], simhash.cut
    rows += [(2000 + i, rows[-1 - i][1] + " more", "s") for i in range(40)]

    def planned(df, *how):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df, *how)

    monkeypatch.setattr(simhash, "cut", planned)
    kept = [r.doc_id for r in simhash.keep_dissimilar(frame(spark, rows)).collect()]
    sets, low = [shingle_sets(t or "") for _, t, _ in rows], list(range(len(rows)))
    for _ in rows:
        new = [min(low[j] for j in range(len(rows)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) for i in range(len(rows))]
        if new == low:
            break
        low = new
    assert sorted(kept) == sorted(min(rows[j][0] for j in range(len(rows)) if low[j] == k and rows[j][0] is not None) for k in set(low))
    # What lies below the map that makes the sets: no join, no aggregation, so no exchange.
    maker = re.compile(r"MapInArrow .*\[node#\w+, s#\w+\]")
    made = [p.splitlines() for p in plans if maker.search(p)]
    assert len(made) == 1, plans
    at = next(k for k, line in enumerate(made[0]) if maker.search(line))
    depth = lambda line: re.search("[A-Za-z]", line).start()
    below = list(itertools.takewhile(lambda line: depth(line) > depth(made[0][at]), made[0][at + 1 :]))
    assert below and not re.search("Join|Aggregate|Repartition|Sort", " ".join(line.split("[")[0] for line in below)), made


def test_filter_holds_its_keys(spark):
    keys = np.random.default_rng(3).integers(-(1 << 63), 1 << 63, 40_000)
    found = simhash._filter(spark.createDataFrame([(int(k),) for k in keys[:5000]], "key long"))
    passed = simhash._passes(found, keys)
    assert passed[:5000].all() and passed[5000:].mean() < 0.03
    assert not simhash._passes(simhash._filter(spark.createDataFrame([], "key long")), keys).any()


# -- substring dedup


def repeats_brute(rows, length=13):
    first = {}
    for i, text, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(text)
        for k in range(len(w) - length + 1):
            first.setdefault(tuple(w[k : k + length]), i)
    out = []
    for i, text, _ in rows:
        w = words(text)
        gone = [False] * len(w)
        if i is not None:
            for k in range(len(w) - length + 1):
                if first[tuple(w[k : k + length])] < i:
                    gone[k : k + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [10_000, 5, 0])
@pytest.mark.parametrize("batch", ["10000", "5"])
def test_repeats_against_brute_force(spark, messy, batch, hot):
    """All anchors extended in their groups, some, or none; a text of few kinds of words repeats itself and others."""
    rng = random.Random(4)
    passage = prose(rng, 60)
    messy = messy + [(350 + i, " ".join(rng.choice("ab") for _ in range(400 * i)), "s1") for i in range(4)] + [(360, "a " * 3000, "s"), (361, "a " * 14 + "b", "s"), (362, "a " * 9, "s")]
    rows = messy + [(400 + i, f"{prose(rng, 20)} {' '.join(words(passage)[i % 30 : i % 30 + 10 + i])} {prose(rng, 20)}", "s1") for i in range(40)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = substring.remove_repeats(frame(spark, rows).repartition(4), hot_holders=hot).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got), key=str) == sorted(repeats_brute(rows), key=str)


def test_a_repeated_id_is_a_copy_only_as_a_whole(spark):
    """A row that copies a smaller document doesn't take the other row of its id along, nor hide it from larger ids."""
    rng = random.Random(16)
    a, b, c = (prose(rng, 60, 4000) for _ in range(3))
    rows = [(1, a, "s"), (5, a, "s"), (5, b, "s"), (9, f"{c} {b}", "s"), (12, a, "s"), (12, a, "s"), (12, None, "s")]
    got = substring.remove_repeats(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(repeats_brute(rows), key=str)


def test_repeats_give_text_and_spans(spark):
    passage = " ".join(f"p{i}" for i in range(15))
    f = frame(spark, [(1, f"a b {passage}", "s"), (2, f"{passage} c d", "s"), (3, "p0 p1", "s")])
    got = {r.doc_id: (r.kept_text, r.spans) for r in substring.remove_repeats(f, with_text=True, with_spans=True).collect()}
    assert got == {1: (f"a b {passage}", []), 2: ("c d", [[0, 15]]), 3: ("p0 p1", [])}
    assert substring.remove_repeats(frame(spark, [])).count() == 0


# -- line dedup


def test_lines_on_many_sites_go_but_for_the_first_holder(spark):
    rows = [(i, f"Own line {i}.\n  Shared footer \nOther {i}\n\n", f"s{i}") for i in range(10)]
    rows += [(50 + i, f"Rare {i}\nOn seven sites", f"s{i}") for i in range(7)] + [(60, "On seven sites", "s0"), (61, "On seven sites", None)]
    rows += [(70, None, "s1"), (71, "", "s2"), (72, "Shared footer", None), (None, "x\nShared footer", "s3"), (73, "Shared footer\nShared footer", "s4")]
    f = frame(spark, rows)
    got = line_dedup.remove_spread_lines(f)
    assert got.columns == [*f.columns, "_lines_removed"]
    texts = {r.doc_id: (r.text, r["_lines_removed"]) for r in got.collect()}
    assert texts[0] == (rows[0][1], 0)
    assert texts[3] == ("Own line 3.\nOther 3\n\n", 1)
    assert texts[53] == ("Rare 3\nOn seven sites", 0)
    assert texts[70] == (None, 0) and texts[71] == ("", 0) and texts[72] == ("", 1) and texts[73] == ("", 2)
    assert texts[None] == ("x\nShared footer", 0)
    assert got.count() == len(rows)
    assert line_dedup.remove_spread_lines(frame(spark, [])).count() == 0


def lines_brute(rows, min_sites):
    """What is left of each row's text, by plain sets."""
    sites, first = {}, {}
    for i, text, site in rows:
        for line in (text or "").split("\n"):
            bare = line.strip(" \t\n\x0b\x0c\r")
            if bare and site is not None:
                sites.setdefault(bare, set()).add(site)
                if i is not None:
                    first[bare] = min(i, first.get(bare, i))
    gone = {line for line, found in sites.items() if len(found) >= min_sites}
    out = []
    for i, text, _ in rows:
        lines = [] if text is None else text.split("\n")
        keys = [line.strip(" \t\n\x0b\x0c\r") for line in lines]
        kept = [line for line, k in zip(lines, keys, strict=True) if i is None or k not in gone or first.get(k) == i]
        out.append((i, None if text is None else "\n".join(kept), len(lines) - len(kept)))
    return out


@pytest.mark.parametrize("broadcast_lines", [200_000, 0])
@pytest.mark.parametrize("min_sites", [1, 2, 3, 5])
def test_line_dedup_equals_brute_force(spark, messy, min_sites, broadcast_lines, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", broadcast_lines)
    rng = random.Random(min_sites)
    pool = [f"line {k}" for k in range(30)] + ["", "  ", "\t\u3000"]
    rows = [(i, t and t.replace(". ", ".\n"), s) for i, t, s in messy]
    rows += [(1000 + i, "\n".join(rng.choice(pool) + " " * rng.randrange(2) for _ in range(rng.randrange(12))), rng.choice(["a", "b", "c", "d", "e", "f", None])) for i in range(120)]
    # One id with unlike texts, a repeated first holder, and a long text in which nearly every line is boilerplate.
    rows += [(1000, "line 1\nown", "a"), (1000, "line 1\nown", "a"), (1000, "line 2\nline 3", "b"), (None, "line 1", "z"), (5000, "\n".join(pool * 2_000 + ["end"]), "g")]
    got = [(r.doc_id, r.text, r["_lines_removed"]) for r in line_dedup.remove_spread_lines(frame(spark, rows), min_sites=min_sites).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "", r[2])
    assert sorted(got, key=order) == sorted(lines_brute(rows, min_sites), key=order)


def test_sketches_decide_far_from_the_threshold(spark):
    rows = [(i, "Everywhere", f"site{i}") for i in range(400)] + [(1000 + i, "Edge line", f"site{i}") for i in range(100)] + [(2000 + i, "Below", f"site{i}") for i in range(99)]
    got = {r.sites for r in line_dedup.spread_lines(frame(spark, rows), min_sites=100).collect()}
    assert 100 in got and len(got) == 2 and 380 <= max(got) <= 420


# -- quality


def counts_brute(text):
    w = words(text)
    grams = {}
    for k in range(len(w) - 2):
        grams.setdefault(tuple(w[k : k + 3]), []).append(k)
    covered = {k + j for ks in grams.values() if len(ks) > 1 for k in ks for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered))


def test_counts_against_brute_force(messy):
    rng = random.Random(6)
    texts = [t for _, t, _ in messy] + ["a b c a b c", "a a a a", "x\nx\n\n \nx ", "#*$%&|<>é", "a b a b a", "\n\n", "one\r\none\r\n"]
    texts += ["".join(rng.choice("ab \n|é") for _ in range(40)) for _ in range(200)]
    for text in texts:
        assert measure((text or "").encode(), WordHashes())[0] == counts_brute(text), text


def measures_brute(text):
    """The measures of a text by name, character by character and word by word."""
    w, text = words(text), text or ""
    n, chars = len(w), "".join(w)
    if not n:
        return dict.fromkeys(MEASURES, 0.0)
    lines = [x for x in text.split("\n") if words(x)]
    covered = {k: 0 for k in (3, 8)}
    for k in covered:
        grams = [tuple(w[i : i + k]) for i in range(n - k + 1)]
        covered[k] = len({i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(k)}) if n < 3000 else None
    parts = [w[i : i + SPAN] for i in range(0, n // SPAN * SPAN, SPAN)] or [w]
    data = "".join(w).encode()
    alnum = sum(b > 127 or chr(b).isalnum() for b in data)
    return {
        "log_words": math.log1p(n), "word_length": len(chars) / n, "symbols": sum(text.count(c) for c in "#*$%&|<>") / n,
        "dup_lines": (len(lines) - len(set(lines))) / len(lines), "repeat_words": covered[3] and covered[3] / n, "upper": sum("A" <= c <= "Z" for c in text) / len(chars),
        "digits": sum("0" <= c <= "9" for c in text) / len(chars), "exclaims": text.count("!") / n, "pipes": text.count("|") / n, "stops": text.count(".") / n, "commas": text.count(",") / n,
        "top_word": max(w.count(x) for x in set(w)) / n, "distinct": sum(len(set(p)) / len(p) for p in parts) / len(parts), "twins": sum(a == b for a, b in zip(w, w[1:])) / max(1, n - 1),
        "lines": len(lines) / n, "longest_word": max(len(x.encode()) for x in w), "non_ascii": (len(text.encode()) - len(text)) / len(chars), "repeat_wide": covered[8] and covered[8] / n, "alnum": alnum / len(data),
    }


def test_measures_against_brute_force(messy):
    rng = random.Random(16)
    texts = [t for _, t, _ in messy if len(t or "") < 20_000] + ["A b! C, d. | 1 é", "x\nx\n\n \nx", "one", prose(rng, 1500, 60)]
    for text in texts:
        got, expected = dict(zip(MEASURES, measure((text or "").encode(), WordHashes())[1], strict=True)), measures_brute(text)
        for name in MEASURES:
            assert got[name] == pytest.approx(expected[name] or 0.0, abs=1e-12), (name, text[:80])


def verdicts_brute(texts, rounds=200):
    """Kept or not by expectation-maximisation over single documents."""
    base, votes = [], []
    for text in texts:
        n, m, repeated = len(words(text)), measures_brute(text), counts_brute(text)[4]
        base.append(n < 50 or 100 * repeated > 50 * n)
        row = []
        for rule in quality_rules.RULES:
            x, good, bad = (1 if rule.above else -1) * np.array([m[rule.measure], rule.good, rule.bad])
            row.append(0 if not n else -1 if x >= bad else 1 if x <= good else 0)
        votes.append(row)
    voters = [v for v, failed in zip(votes, base, strict=True) if not failed]
    a, b, share = [0.95] * len(votes[0]), [0.4] * len(votes[0]), 0.8

    def posterior(row):
        good, bad = share, 1 - share
        for vote, right, caught in zip(row, a, b, strict=True):
            good *= {1: right, -1: 1 - right, 0: 1}[vote]
            bad *= {1: 1 - caught, -1: caught, 0: 1}[vote]
        return good / (good + bad)

    for k in range(rounds):
        p = [posterior(v) for v in voters]
        if k == rounds - 1:
            final = dict(zip(map(tuple, voters), p, strict=True))
        for r in range(len(a)):
            up, down = [sum(q for q, v in zip(p, voters, strict=True) if v[r] == s) for s in (1, -1)]
            up_bad, down_bad = [sum(1 - q for q, v in zip(p, voters, strict=True) if v[r] == s) for s in (1, -1)]
            a[r] = min(max((up + 1.9) / (up + down + 2), 0.501), 1 - 1e-6)
            b[r] = min(max((down_bad + 0.8) / (up_bad + down_bad + 2), 1e-3), 1 - 1e-6)
        share = min(max((sum(p) + 1.6) / (len(p) + 2), 1e-6), 1 - 1e-6)
    return [not failed and final[tuple(v)] >= 0.5 for v, failed in zip(votes, base, strict=True)]


def test_verdicts_equal_brute_force(spark, messy):
    rng = random.Random(17)
    texts = [t for _, t, _ in messy if len(t or "") < 20_000]
    for i in range(90):
        w = [f"word{rng.randrange(3000)}" for _ in range(rng.choice([60, 120, 400]))]
        junk = i % 6
        if junk == 1:
            w = [x + "%$#" for x in w]
        elif junk == 2:
            w = [x.upper() + "!" for x in w]
        elif junk == 3:
            w = w[:12] * (len(w) // 24) + w
        texts.append(("\n" if i % 4 else " ").join(w))
    got = {r.doc_id: r.kept for r in quality_rules.judge(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    expected = verdicts_brute(texts)
    assert [got[i] for i in range(len(texts))] == expected and 20 < sum(expected) < len(texts) - 20


def test_long_prose_is_not_rejected_for_its_length(spark):
    rng = random.Random(18)
    rows = [(i, " ".join(f"word{rng.randrange(4000)}" for _ in range(n)), "s") for i, n in enumerate([100] * 40 + [60_000] * 3)]
    assert all(r.kept for r in quality_rules.judge(frame(spark, rows)).collect())


def test_rules_keep_clean_documents_and_reject_junk(spark, messy):
    rng = random.Random(8)
    clean = lambda: " ".join(f"word{rng.randrange(3000)}" for _ in range(150))
    rows = [(i, clean(), "s") for i in range(150)]
    rows += [(500 + i, " ".join(w + "%%%$" for w in words(clean())), "s") for i in range(15)]
    rows += [(600, "short text", "s"), (601, None, "s"), (602, "again and again " * 60, "s"), (None, rows[0][1], None)]
    got = {r.doc_id: r for r in quality_rules.judge(frame(spark, rows)).collect()}
    assert all(got[i].kept for i in range(150)) and not any(got[500 + i].kept or got[500 + i].base_failed for i in range(15))
    assert [got[i].base_failed for i in (600, 601, 602)] == [True] * 3 and got[None].kept
    for i, text, _ in rows:
        assert tuple(got[i][c] for c in COUNTS) == counts_brute(text)
    assert quality_rules.judge(frame(spark, [])).count() == 0
    assert quality_rules.judge(frame(spark, messy)).count() == len(messy)


def test_estimate_recovers_accuracies():
    rng = np.random.default_rng(5)
    good = rng.random(40_000) < 0.8
    right = np.where(good[:, None], [0.95, 0.9, 0.85, 0.9], [0.8, 0.7, 0.9, 0.6])
    votes = np.where(rng.random((40_000, 4)) < right, 1, -1) * np.where(good, 1, -1)[:, None] * (rng.random((40_000, 4)) < 0.9)
    kinds, counts = np.unique(votes, axis=0, return_counts=True)
    _, found = quality_rules.estimate(kinds, counts)
    assert np.abs(found["good_right"] - [0.95, 0.9, 0.85, 0.9]).max() < 0.03 and np.abs(found["bad_right"] - [0.8, 0.7, 0.9, 0.6]).max() < 0.06 and abs(found["share"] - 0.8) < 0.03


def test_additive_model_learns_interactions():
    rng = np.random.default_rng(6)
    x = rng.random((6000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x[:4000], y[:4000])
    assert ((model.score(x[4000:]) > 0.5) == y[4000:]).mean() > 0.9 and any({i, j} == {0, 1} for i, j, _ in model.pairs)
    assert quality_gam.fit(x[:0], y[:0]).score(x[:2]) == pytest.approx([0.5, 0.5])
    assert (quality_gam.fit(x[:50], np.ones(50)).score(x[:2]) > 0.9).all()


def test_scores_equal_a_look_up_by_loops(spark, messy):
    docs = frame(spark, messy)
    model = quality_gam.train(docs, spark.createDataFrame([(i, int(i % 2)) for i in range(40)], "doc_id long, quality int"))

    def bin_of(edges, x):
        return sum(bool(e <= x) for e in edges)

    expected = []
    for i, text, _ in messy:
        x = measure((text or "").encode(), WordHashes())[1]
        logit = model.base + sum(table[bin_of(model.edges[k], x[k])] for k, table in enumerate(model.tables))
        logit += sum(table[bin_of(model.pair_edges[a], x[a])][bin_of(model.pair_edges[b], x[b])] for a, b, table in model.pairs)
        expected.append((i, round(1 / (1 + math.exp(-logit)), 9)))
    got = [(r.doc_id, round(r.score, 9)) for r in quality_gam.score(docs, model).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str) and len({s for _, s in got}) > 10


def held_out_accuracy(spark, name, label, limit):
    from turnpike.llm import queries

    sf = "/root/testdata/sf0.01"
    got = queries.queries()[name](spark, sf)
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    assert got.count() == docs.count() and got.where("score between 0 and 1 and score is not null").count() == docs.count()
    held = got.join(labels, "doc_id").where("held_out")
    assert held.where(f"predicted = {label}").count() / held.count() >= limit


def test_held_out_quality(spark):
    held_out_accuracy(spark, "op4_quality_gam", "quality", 0.95)


def test_held_out_toxicity(spark):
    held_out_accuracy(spark, "op1_toxicity", "toxic", 0.93)


def test_classifier_on_messy_rows(spark, messy):
    docs = frame(spark, messy)
    labels = spark.createDataFrame([(i, int(i % 2), int(i % 3 == 0), "x") for i in range(40)] + [(None, 1, 1, "x"), (3, None, None, "x"), (5, 0, 0, "x")], "doc_id long, quality int, toxic int, text string")
    model = quality_gam.train(docs, labels)
    assert quality_gam.score(docs, model).count() == len(messy)
    assert quality_gam.accept(docs, model).columns == docs.columns
    assert quality_gam.score(docs, quality_gam.train(docs, labels.where("false"))).select("score").distinct().count() == 1
    assert quality_gam.score(frame(spark, []), model).count() == 0


# -- toxicity


def test_folding():
    assert toxicity.fold("1D10T ｉｄｉｏｔ ıdiоt i\u200bdiot").split() == ["idiot"] * 4
    # Accents, strokes and styles fold; marks that a script needs don't break its words.
    assert toxicity.fold("ídíőt i̶d̶i̶o̶t 𝗶𝗱𝗶𝗼𝘁 ⓘⓓⓘⓞⓣ 🅸🅳🅸🅾🆃 !d!ot pi$$ed").split() == ["idiot"] * 5 + ["d", "ot", "pissed"]
    assert toxicity.fold(unicodedata.normalize("NFD", "Idíot")) == "idiot"
    assert toxicity.fold("Ö-ß!").split() == ["o", "ß"]
    assert toxicity.fold("हिन्दी में").split() == ["हिन्दी", "में"]


def measure_brute(lexicon, text):
    """Weights of words by comparing every word with every term and every phrase at every place."""
    w = toxicity.fold(text).split()
    spared = {j for phrase in lexicon.exceptions for i in range(len(w)) if w[i : i + 2] == phrase.split() for j in (i, i + 1)}
    best = [max([v for t, v in lexicon.terms.items() if (x.startswith(t[:-1]) if t.endswith("*") else x == t)], default=0.0) for x in w]
    total = sum(b for i, b in enumerate(best) if i not in spared)
    return total, total / max(toxicity.LEAST_WORDS, len(w)) ** 0.5


def test_lexicon_equals_brute_force():
    rng = random.Random(6)
    vocabulary = ["bad", "badly", "luck", "thing", "scum", "scummy", "trash", "can", "fine", "b4d", "Lück"]
    lexicon = toxicity.Lexicon({"bad": 3.0, "bad*": 2.5, "scum*": 4.0, "trash": 5.0}, ("bad luck", "trash can", "can trash", "luck bad"))
    for n in (0, 1, 2, 5, 30, 200):
        for _ in range(40):
            text = " ".join(rng.choice(vocabulary) for _ in range(n)) + rng.choice(["", "!", "\n"])
            got, expected = lexicon.measure(text), measure_brute(lexicon, text)
            assert abs(got[0] - expected[0]) < 1e-9 and abs(got[1] - expected[1]) < 1e-9, text


def test_hit_dense_text_takes_linear_time():
    lexicon = toxicity.Lexicon({"bad": 3.0}, ("bad luck",))
    text = "bad luck bad thing " * 270_000
    began = time.perf_counter()
    assert lexicon.measure(text)[0] == 3.0 * 270_000
    assert time.perf_counter() - began < 10


def test_exceptions_and_lengths():
    lexicon = toxicity.Lexicon({"trash": 5.0, "scu*": 4.0}, ("trash can",))
    assert lexicon.measure("the trash can is full")[0] == 0.0
    assert lexicon.measure("you trash, SCUMMY 7rash")[0] == 14.0
    assert lexicon.measure("trashy miscue")[0] == 0.0
    assert lexicon.measure("")[0] == 0.0
    one, two = lexicon.measure("trash " + "word " * 30)[1], lexicon.measure("trash " + "word " * 3000)[1]
    assert one > two > 0


def test_toxicity_on_messy_rows(spark, messy):
    docs = frame(spark, messy + [(900 + i, f"you f0ulw{'о' if i % 2 else 'o'}rd number {i} " * 3, "s") for i in range(12)])
    labels = spark.createDataFrame([(900 + i, 1) for i in range(8)] + [(i, 0) for i in range(40)] + [(None, 1), (2, None)], "doc_id long, toxic int")
    lexicon = toxicity.train(docs, labels, modulus=1_000_003, held_out=1_000_002)
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, lexicon).collect()}
    assert all(got[900 + i] for i in range(12)) and not any(got[i] for i in range(40)) and got[300] == 0
    assert toxicity.train(docs, labels.where("toxic = 0")).terms == {}
    assert toxicity.score(frame(spark, []), lexicon).count() == 0


def test_overlaps_equal_sets():
    rng = np.random.default_rng(21)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))) for _ in range(23)]
    first, second = np.arange(0, 15), np.arange(8, 23)
    got = simhash._overlaps(np.concatenate(sets), np.array([len(x) for x in sets]), first, second)
    assert got.tolist() == [[len(np.intersect1d(sets[a], sets[b])) for b in second] for a in first]


def test_links_in_blocks_join_what_brute_force_joins(spark):
    """A crowd under one key whose texts are about as often similar as not, in one block and in many."""
    rng = np.random.default_rng(22)
    base = rng.integers(0, 1 << 62, 100)
    sets = [np.unique(np.where(rng.random(100) < rng.choice([0.03, 0.12, 0.3]), rng.integers(0, 1 << 62, 100), base)) for _ in range(120)]
    rows = [(k, n, 0, n - n % 3, [int(x) for x in sets[n]]) for n in range(120) for k in ((0,) if n % 2 else (0, 1))] + [(2, 500, 0, 500, [1, 2])]
    left = spark.createDataFrame([r[:4] for r in rows], "key long, node long, fp long, root long")
    kept = spark.createDataFrame(sorted({(r[1], tuple(r[4])) for r in rows}), "node long, s array<long>")
    parent = {n: n - n % 3 for n in range(120)}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in range(120):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if both / (len(sets[a]) + len(sets[b]) - both) >= 0.8:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    expected = {(n, find(n)) for n in range(0, 120, 3) if find(n) != n}
    assert 5 < len(expected) < 39
    for block in (1_500, 17):
        got = components(simhash._links_in_blocks(left, kept, 0.8, 22, block)).collect()
        assert {(r.node, r.root) for r in got} == expected
