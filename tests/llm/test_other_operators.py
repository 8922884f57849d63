"""URL filter, vectors, mixing, the pipeline."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from turnpike.llm import mixture, queries, url_filter, vector_dedup

# -- URL filter


def test_urls(spark):
    urls = [
        "https://www.Example.COM/en/70?x=1", "http://a.com/en/1", "http://com/en/", "http://notcom/en/1", "http://b.example.net/de/81", "http://b.net/de/8", "http://x.org/es/1",
        "http://free-bets.example.org/a", "http://free.example.org/a?x=free", "http://adulthood.example.org/", "http://x.org/PORN-x", "mailto:nobody", "", None, "://", "http://h#f/en/", "x://u:p@com:80/en/",
    ]
    f = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(f, queries.URL_RULES).collect()}
    assert got[0] == ("www.example.com", "/en/70", "example.com/en/7", "allow")
    assert got[1] == ("a.com", "/en/1", "com/en/", "block") and got[2] == ("com", "/en/", "com/en/", "block")
    assert got[3] == ("notcom", "/en/1", None, "allow")
    assert got[4][2:] == ("example.net/de/8", "block") and got[5][2:] == ("net/de/", "allow") and got[6][2:] == ("org/es/", "block")
    assert got[7][2:] == (None, "block") and got[8][3] == "allow" and got[9][3] == "allow" and got[10][3] == "block"
    assert got[11] == ("", "", None, "allow") and got[12] == ("", "", None, "allow") and got[13] == ("", "", None, "allow")
    assert got[14] == ("", "", None, "allow") and got[15] == ("h", "", None, "allow") and got[16][0] == "u:p@com:80"
    assert url_filter.judge(f.where("false")).count() == 0


def test_vocabulary_weighs_its_terms(spark):
    """Harmless pages with one soft term stay, several distinct ones or a strict one reject; long and repeated URLs too."""
    allowed = ["http://a.org/sex-education", "http://a.org/adult-learning", "http://a.org/anti-spam-policy", "http://a.org/free-deals-for-veterans", "http://a.org/casino/casino/casino", "http://a.org/porntip", "http://a.org/cheaper-pillsbury"]
    blocked = ["http://a.org/PORN", "http://casino-bonus.com", "http://a.org/viagra?buy=cheap-pills", "http://a.org/apuestas-gratis", "http://a.org/" + "x/" * 100_000 + "casino-bets"]
    f = spark.createDataFrame([(i, u) for i, u in enumerate(allowed + blocked + blocked)], "page_id long, url string")
    got = [r.verdict for r in url_filter.judge(f).orderBy("page_id").collect()]
    assert got == ["allow"] * len(allowed) + ["block"] * 2 * len(blocked)


# -- vectors


def vectors_brute(rows, threshold=0.93):
    ok = [v is not None and lab is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    units = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if k else None for (_, v, _), k in zip(rows, ok, strict=True)]
    n, low = [0] * len(rows), list(range(len(rows)))

    def find(a):
        while low[a] != a:
            a = low[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and float(units[a] @ units[b]) >= threshold:
                n[a] += 1
                n[b] += 1
                low[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, n[k], least.get(find(k)), i is not None and i == least[find(k)]) for k, (i, _, _) in enumerate(rows)]


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((12, 16))
    rows = []
    for i in range(150):
        v = centres[i % 12] + rng.standard_normal(16) * 0.12 * (i % 4)
        rows.append((i, [float(np.float32(x)) for x in v], i % 2 if i % 11 else None))
    rows += [(200 + i, rows[3][1], 1) for i in range(5)] + [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] + [1.0] * 15, 1), (303, [float("inf")] + [1.0] * 15, 1), (304, [None] + [1.0] * 15, 1)]
    rows += [(305, [], 1), (306, [1.0, 0.0], 1), (307, [2.0, 0.0], 1), (308, [-0.0, 1.0], 0), (309, [0.0, 1.0], 0), (3, rows[3][1], 1), (None, rows[3][1], 1), (None, None, None)]
    f = spark.createDataFrame([(i, v, lab, "x") for i, v, lab in rows], "vec_id long, embedding array<float>, label int, n string").repartition(3)
    expected = sorted(vectors_brute(rows), key=str)
    for how in ({}, {"block": 4}):
        assert sorted(map(tuple, vector_dedup.near_vectors(f, **how).collect()), key=str) == expected
    assert vector_dedup.near_vectors(f.where("false")).count() == 0


def test_a_cosine_at_the_threshold_links(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [0.6, 0.8], 0), (3, [0.0, 5.0], 0), (4, [3.0, 4.0], 1), (5, [1e200, 1e200], 2), (6, [1e-200, 1e-200], 2)]
    f = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_vectors(f, threshold=0.6).collect()}
    assert got == {1: (1, 1), 2: (2, 1), 3: (1, 1), 4: (0, 4), 5: (1, 5), 6: (1, 5)}


def test_vectors_of_the_table_against_brute_force(spark):
    f = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, None if r.embedding is None else list(r.embedding), r.label) for r in f.collect()]
    got = sorted(map(tuple, vector_dedup.near_vectors(f).collect()), key=str)
    ids, labels = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    x = np.array([r[1] for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93) & (labels[:, None] == labels[None, :])
    low = ids.copy()
    while True:
        new = np.where(near, low[None, :], low.max()).min(axis=1)
        if (new == low).all():
            break
        low = new
    assert got == sorted(zip(ids.tolist(), (near.sum(axis=1) - 1).tolist(), low.tolist(), (low == ids).tolist(), strict=True), key=str)


def test_tables_reach_the_recall():
    p = vector_dedup.meeting_probability(4.0) ** 8
    assert 1 - (1 - p) ** vector_dedup.tables_for(0.999, 8, 4.0) >= 0.999


# -- mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, target string"


def water_fill(sizes, weights=(3, 1, 2), share=1.5):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, target, free = share * sum(sizes.values()), {}, set(names)
    while free:
        level = (total - sum(target.values())) / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level > 2 * sizes[s]}
        if not over:
            target |= {s: w[s] * level for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    return target


def mixed_rows():
    rng = random.Random(10)
    rows = []
    for i in range(400):
        source = rng.choices(["hot", "b", "é", "z", None, "tiny"], [60, 10, 10, 10, 9, 1])[0]
        rows.append((i, " ".join("w" for _ in range(rng.randrange(0, 120))), source))
    return rows + [(900, None, "b"), (901, "", "none"), (902, " \n", "none"), (None, "a b c", "z"), (7, rows[7][1], rows[7][2])]


def test_targets_and_taken(spark):
    rows = mixed_rows()
    f = spark.createDataFrame([(i, t, "en", s, 0, "x") for i, t, s in rows], DOCS).repartition(5)
    got = mixture.mix(f).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    target = water_fill(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert len(got) == len(rows)
    for s, t in taken.items():
        assert abs(t - target[s]) <= max(0.01 * target[s], 6), s
    again = mixture.mix(f.repartition(2)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)
    assert mixture.mix(f.where("false")).count() == 0
    assert mixture.mix(f.where("text is null or text = ''")).agg(F.sum("taken"), F.max("target")).first()[:2] == (0, 0.0)


def test_small_sources_reach_their_targets_beside_large_ones(spark):
    """Blocks of the large sources are larger than the small sources as a whole."""
    rng = random.Random(12)
    sizes = {f"large{k}": 50_000 for k in range(8)} | {f"tiny{k}": 4 for k in range(8)} | {f"small{k:02}": 500 + 97 * k for k in range(30)}
    rows = [(s, n) for s, total in sizes.items() for n in [100] * (total // 100) + [total % 100]]
    rng.shuffle(rows)
    f = spark.createDataFrame([(i, "w " * n, "en", s, 0, "x") for i, (s, n) in enumerate(rows)], DOCS)
    got = mixture.mix(f, block=64).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(got) == len(sizes)
    for r in got:
        assert abs(r.taken - r.target) <= max(0.02 * r.target, 3), r


def test_mixed_corpus_holds_the_words_taken(spark):
    f = spark.createDataFrame([(i, t, "en", s, 0, "x") for i, t, s in mixed_rows()[:-1]], DOCS)
    plan = {(r.doc_id, r.source): r.taken for r in mixture.mix(f).collect()}
    out = mixture.apply_mix(f)
    assert out.columns == f.columns
    words = {}
    for r in out.collect():
        words[r.doc_id, r.source] = words.get((r.doc_id, r.source), 0) + len(r.text.split())
    assert words == {k: v for k, v in plan.items() if v}


def test_every_prefix_of_the_schedule_is_close(spark):
    cycle = mixture.CYCLE
    shares = spark.createDataFrame([("a", 0, cycle // 2), ("b", cycle // 2, cycle // 2 + cycle // 3), ("c", cycle // 2 + cycle // 3, cycle), ("none", 5, 5)], "source string, low long, high long")
    rows = sorted(mixture.schedule(shares, 3000).collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(3000))
    seen = {"a": 0, "b": 0, "c": 0}
    for r in rows:
        assert r["rank"] == seen[r.source]
        seen[r.source] += 1
        for s, part in (("a", 1 / 2), ("b", 1 / 3), ("c", 1 / 6)):
            assert abs(seen[s] - part * (r.slot + 1)) < 6


# -- pipeline


def test_pipeline_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, sf)
        path = str(tmp_path / name)
        out.write.parquet(path)
        out = spark.read.parquet(path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        if name in ("quality_classifier", "simhash"):
            assert out.join(before, docs.columns, "left_semi").count() == out.count() <= before.count()
        if name == "line_dedup":
            assert out.count() == before.count()
        before = out
    assert before.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and before.count() > 100
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_on_messy_documents(spark, tmp_path):
    (tmp_path / "x").mkdir()
    rows = [(i, f"word{i} " * 5 + "\nshared line here", "en", f"s{i}", 1) for i in range(12)] + [(50, None, None, None, None), (51, "", "en", "s1", 0), (None, "x y z", "en", "s1", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "x/documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "x/labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "x"))
    assert out.where("n_tokens > 0").count() > 0
    docs.where("false").write.parquet(str(tmp_path / "y/documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "y/labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "y")).count() == 0
