"""Every stage of the corpus pipeline against a plain version of it, on a small corpus with what the stages look for."""

import hashlib
import math
import random

import corpus_pipeline
import pytest
import tiktoken
from public_tokenizers import PATTERN, path
from pyspark.sql import functions as F
from tiktoken.load import load_tiktoken_bpe

from turnpike.llm import mixture, quality_gam
from turnpike.llm._features import measure
from turnpike.llm._text import WordHashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = " \t\n\x0b\x0c\r"


def corpus():
    """Clean and junk texts, lines of many sites, near and exact copies, nulls, repeated ids and rows, one hot source."""
    rng = random.Random(31)
    word = lambda: f"w{rng.randrange(3000)}"
    rows = []
    for i in range(240):
        text = "\n".join(" ".join(word() for _ in range(12)) for _ in range(rng.randrange(4, 9)))
        if i % 6 == 0:
            text = " ".join(f"{word()}|$%#" for _ in range(80))
        elif i % 4 == 0:
            text += "\n  Shared footer line of all sites "
        rows.append((i, text, "en", "hot" if i % 3 == 0 else f"s{i % 11}", len(text)))
    for i in range(60):
        of = rows[rng.randrange(1, 200)][1]
        words = of.split(" ")
        if i % 2:
            words[rng.randrange(len(words))] = "changed"
        rows.append((1000 + i, " ".join(words), "de", f"s{i % 5}", len(of)))
    rows += [(2000, None, None, None, None), (2001, "", "en", "s1", 0), (None, rows[1][1], "en", "s2", 5), (7, "another text under seven " * 15, "en", None, 1), rows[5], rows[5]]
    labels = [(r[0], int(r[0] % 6 != 0), 0) for r in rows[:240]]
    return rows, labels


def stripped(line):
    return line.strip(SPACE)


def quality_plain(rows, labels, spark):
    docs = spark.createDataFrame(rows, DOCS)
    model = quality_gam.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))

    def score(text):
        x = measure((text or "").encode(), WordHashes())[1]
        at = lambda edges, v: sum(bool(e <= v) for e in edges)
        total = model.base + sum(t[at(model.edges[k], x[k])] for k, t in enumerate(model.tables))
        total += sum(t[at(model.pair_edges[a], x[a])][at(model.pair_edges[b], x[b])] for a, b, t in model.pairs)
        return 1 / (1 + math.exp(-total))

    return [r for r in rows if score(r[1]) >= 0.7]


def lines_plain(rows, least=8):
    sites, first = {}, {}
    for i, text, _, source, _ in rows:
        for line in (text or "").split("\n"):
            if stripped(line) and source is not None:
                sites.setdefault(stripped(line), set()).add(source)
                if i is not None:
                    first[stripped(line)] = min(i, first.get(stripped(line), i))
    out = []
    for i, text, lang, source, n in rows:
        lines = None if text is None else text.split("\n")
        kept = lines and [x for x in lines if i is None or len(sites.get(stripped(x), ())) < least or first.get(stripped(x)) == i]
        same = lines is None or len(kept) == len(lines)
        out.append((i, text, lang, source, n) if same else (i, "\n".join(kept), lang, source, len("\n".join(kept))))
    return out


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def similar_plain(rows):
    """The first row of each group: the smallest id, nulls last, then the digest; groups are joined by similarity."""
    sets, group = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(a):
        while group[a] != a:
            a = group[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                group[find(a)] = find(b)
    digest = lambda t: (t is None, "" if t is None else hashlib.md5(t.encode()).hexdigest())
    key = lambda r: (r[0] is None, r[0] or 0, digest(r[1]), [(x is not None, x) for x in r])
    best = {}
    for k, r in enumerate(rows):
        if find(k) not in best or key(r) < key(best[find(k)]):
            best[find(k)] = r
    return list(best.values())


def taken_plain(rows):
    """The rows in the order of their source's shuffled stream with the words that the mix takes of each, slot by slot and block by block."""
    size = lambda r: len((r[1] or "").split())
    names = sorted({r[3] for r in rows if r[3] is not None}, key=lambda s: s.encode()) + ([None] if any(r[3] is None for r in rows) else [])
    total = {s: sum(size(r) for r in rows if r[3] == s) for s in names}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, free = {}, set(names)
    while free:
        level = (1.5 * sum(total.values()) - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * total[s]}
        target |= {s: 2.0 * total[s] for s in over} if over else {s: weight[s] * level for s in free}
        free = free - over if over else set()
    goal = {s: math.floor(target[s] + 0.5) for s in names}
    block = {s: max(1, min(mixture.BLOCK, -(-goal[s] // mixture.PARTS))) for s in names}
    own = {s: -(-goal[s] // block[s]) for s in names}
    slots, high, low, up = sum(own.values()), {}, {}, 0
    for s in names:
        low[s] = math.floor(up / slots * mixture.CYCLE)
        up += own[s]
        high[s] = math.floor(up / slots * mixture.CYCLE)
    rank, taken = dict.fromkeys(names, 0), {}
    for i in range(slots):
        point = i * mixture.STEP % mixture.CYCLE
        s = next((s for s in names if low[s] <= point < high[s]), "nobody")
        n_blocks = -(-total[s] // block[s]) if s in total else 0
        if s in rank:
            if rank[s] < 2 * n_blocks:
                taken[s, rank[s] % n_blocks] = taken.get((s, rank[s] % n_blocks), 0) + 1
            rank[s] += 1
    out = []
    for s in names:
        order = sorted((r for r in rows if r[3] == s), key=lambda r: (hashlib.md5(f"{'null' if r[0] is None else r[0]}-mix".encode()).hexdigest(), r[0] or 0, size(r)))
        start = 0
        for r in order:
            out.append((r, sum(taken.get((s, w // block[s]), 0) for w in range(start, start + size(r)))))
            start += size(r)
    return out


def mix_plain(rows):
    """Rows of the mix: a document as often as it is taken, and the words at the end of a source's last block."""
    size, by_id, out = lambda r: len((r[1] or "").split()), {}, []
    placed = taken_plain(rows)
    for r, words in placed:
        a, b = by_id.get((r[0], r[3]), (0, 0))
        by_id[r[0], r[3]] = (a + words, b + size(r))
    for r, _ in placed:
        words, all_of_id = by_id[r[0], r[3]]
        if size(r) and words:
            part = words * size(r) // all_of_id
            for cut in [0] * (part // size(r)) + [part % size(r)] * (part % size(r) > 0):
                text = " ".join(r[1].split()[:cut]) if cut else r[1]
                out.append((r[0], text, r[2], r[3], len(text)))
    return out


def bpe_plain(rows):
    coder = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=load_tiktoken_bpe(str(path("byte_bpe_multi_50k.tiktoken"))), special_tokens={})
    out = []
    for r in rows:
        ids = coder.encode_ordinary(r[1] or "")
        packed = b"".join(t.to_bytes(4, "little") for t in ids)
        out.append((r[0], len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels = corpus()
    place = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(place / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(place / "labels.parquet"))
    return str(place)


def test_stages_equal_their_plain_versions(spark, folder):
    rows, labels = corpus()
    plain = {
        "quality_classifier": lambda r: quality_plain(r, labels, spark), "line_dedup": lines_plain, "simhash": similar_plain, "mixture": mix_plain, "byte_bpe": bpe_plain,
    }
    docs, counts = spark.read.parquet(f"{folder}/documents.parquet"), []
    order = lambda r: [(x is None, str(x)) for x in r]
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        got = sorted((tuple(r) for r in stage(spark, docs, folder).collect()), key=order)
        assert got == sorted(plain[name](before), key=order), name
        counts.append(len(got))
        if name != "byte_bpe":
            docs = spark.createDataFrame(got, DOCS).repartition(3)
    assert counts[0] < len(rows) and counts[2] < counts[1] and counts[4] == counts[3] > 100


def test_extra_columns_with_clashing_names_change_nothing(spark, folder):
    names = ("id", "fp", "h", "t", "y", "doc", "line", "site", "at", "print", "node", "bands", "key", "group", "digest", "size", "copy", "target", "bucket", "score", "predicted", "label_id", "s", "k")
    plain = spark.read.parquet(f"{folder}/documents.parquet")
    docs, extra = plain, plain.withColumns({c: F.lit("x") for c in names})
    order = lambda r: [(x is None, str(x)) for x in r]
    for name, stage in corpus_pipeline.STAGES:
        one, two = stage(spark, docs, folder), stage(spark, extra, folder)
        if name != "byte_bpe":
            assert two.columns == extra.columns
        got = [sorted((tuple(r) for r in f.select(*one.columns).collect()), key=order) for f in (one, two)]
        assert got[0] == got[1], name
        if name != "byte_bpe":
            docs = spark.createDataFrame(got[0], DOCS)
            extra = docs.withColumns({c: F.lit("x") for c in names})


def test_mix_of_long_texts_and_equal_places(spark):
    """A text longer than blocks, ids that repeat and so have one place in the shuffle, rows that repeat."""
    rng = random.Random(33)
    rows = [(i % 40, "w " * rng.randrange(0, 60), "en", f"s{i % 3}", 0) for i in range(150)] + [(500, "long " * 60_000, "en", "s1", 0), (501, "x " * 9_000, "en", "s2", 0), (7, None, "en", None, 0), (None, "a b c", "en", None, 0)]
    rows += rows[:6]
    got = mixture.mix(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    size = lambda r: len((r[1] or "").split())
    expected = sorted(((r[0], r[3], size(r), words) for r, words in taken_plain(rows)), key=str)
    assert sorted(((r.doc_id, r.source, r["size"], r.taken) for r in got), key=str) == expected


def test_run_gives_the_last_stage_and_leaves_its_folder_alone(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    first = sorted(map(tuple, out.collect()), key=str)
    assert first == sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=str) and len(first) > 100
    assert all("5-byte_bpe" in f for f in out.inputFiles())
