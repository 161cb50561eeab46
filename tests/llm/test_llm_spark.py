"""The llm operators on small tables: odd rows, empty tables, clashing columns, brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import attention, common, decontam, jaccard, neighbours, pieces, quality, scoring, secrets, sharding, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in zip(ids, texts)], DOCS)


def prose(seed, n):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


ODD = [None, "", " \n\t", "one", "A b C", "same text here", "same text here", "é" * 50, "x " * 5000]


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://M.Example.COM/en/7x?q#f", "https://example.net/de/8", "http://a.net/de/", "http://x.org:80/es/", "http://com/en/", "ftp://é.com/en/1", "http://a.com?x/en/"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] + [(None, urls[4], "h", "r"), (4, urls[4], "h", "r")], "page_id long, url string, host string, rule string")
    rows = url_filter.judge_urls(pages).collect()
    assert len(rows) == len(urls) + 2
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert got[0] == got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("m.example.com", "/en/7x", "example.com/en/7", "allow") and got[5][2:] == ("example.net/de/8", "block")
    assert got[6][2:] == ("net/de/", "allow") and got[7][2:] == (None, "allow") and got[8][2:] == ("com/en/", "block") and got[10][1:] == ("", None, "allow")
    assert url_filter.judge_urls(pages.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, rules=()).collect()} == {"allow"}


def test_sharding(spark):
    rng = random.Random(1)
    texts = ODD + ["copy " * 40] * 200 + [prose(i, rng.randrange(1, 60)) for i in range(400)]
    docs = table(spark, texts).withColumn("size", F.lit(1)).withColumn("shard", F.lit("x"))
    docs = docs.union(docs.limit(3)).union(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    rows = sharding.shard_by_bytes(spark, docs, 5).collect()
    assert len(rows) == len(texts) + 5
    by_text, total = {}, Counter()
    text_of = dict(enumerate(texts))
    for r in rows:
        total[r.shard] += r.size
        if r.doc_id is not None:
            t = text_of[r.doc_id] or ""
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t.encode()) + 16, zlib.crc32(t.encode()), "bytes", None)
            by_text.setdefault(t, set()).add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    for s in range(5):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.shard_by_bytes(spark, docs.limit(0)).count() == 0


def test_warc(spark):
    html = ["<p>a", "<p>a", None, "", "é\r\n\r\nz", "<p>a", "long " * 9000]
    urls = ["http://a.b/1", "http://a.b/1", None, "x", "http://c.d/ é?q", "http://a.b/2", "http://z"]
    pages = spark.createDataFrame([(i, u, h, "c") for i, (u, h) in enumerate(zip(urls, html))] + [(None, "http://n", "<p>n", "c"), (6, "http://z", html[6], "c")], "page_id long, url string, html string, digest string")
    rows = warc.archive_round_trip(spark, pages).collect()
    assert len(rows) == 9
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes, bytes(r.payload) if r.payload is not None else None) for r in rows}
    assert got[0] == ("revisit", 5, 4, None) and got[1] == ("revisit", 5, 4, None) and got[5] == ("response", None, 4, b"<p>a")
    assert got[2] == ("revisit", 3, 0, None) and got[3] == ("response", None, 0, b"") and got[4][3] == html[4].encode() and got[None][0] == "response"
    assert all(r.payload_digest == warc.base32_digest((html[r.page_id] or "").encode()) for r in rows if r.page_id is not None)
    assert {r.record_type for r in warc.archive_round_trip(spark, pages, min_bytes=10_000).filter("page_id < 6").collect()} == {"response"}
    assert warc.archive_round_trip(spark, pages.limit(0)).count() == 0


def test_warc_lookup_of_a_url(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    pages = spark.range(200).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.x/"), F.col("id") % 20).alias("url"), F.concat(F.lit("p"), "id").alias("html"))
    ws = common.Workspace(spark, "test")
    parts = warc.build_index(ws, warc.write_archives(ws, pages))
    keys = spark.createDataFrame([(warc.surt("http://h.x/3") + " ",), (warc.surt("http://none/") + " ",)], "key string")
    assert sorted(r.page_id for r in warc.lookup(ws, parts, keys).collect()) == [i for i in range(200) if i % 20 == 3]


def spans_by_hand(text):
    found = []
    for order, (kind, pattern, flags, ok) in enumerate((
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 12),
        ("access", r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 18),
        ("hex", r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 16),
    )):
        found += [(m.start(), order, m.end(), kind) for m in re.finditer(pattern, text or "", flags) if ok(m)]
    return sorted(found)


def test_secrets(spark):
    texts = ODD + ["Token: 'abcdefghijkl' tokén=ab", "é api_key=0123456789abcdef0123 x", "AKIAABCDEFGHIJ12345 AKIAshort", "secret = short password:longenough123", "ſecret=abcdefghijklm", "deadbeefdeadbee" + "f" * 3, "ghp_" + "Z" * 36]
    docs = table(spark, texts).withColumn("spans", F.lit("clash"))
    rows = {r.doc_id: [(s.start, s.end, s.kind) for s in r.spans] for r in secrets.scan_secrets(docs).collect()}
    assert len(rows) == len(texts)
    base = {"assign", "access", "hex"}
    for i, t in enumerate(texts):
        assert [s for s in rows[i] if s[2] in base] == [(a, b, k) for a, _, b, k in spans_by_hand(t)]
    assert rows[len(texts) - 1] == [(0, 40, "hosting")]
    out = {r.doc_id: r for r in secrets.redact_secrets(docs).collect()}
    assert out[0].text is None and out[4].text == texts[4] and out[len(ODD)].text.startswith("[assign]") and out[0].spans == "clash"
    assert secrets.scan_secrets(docs.limit(0)).count() == 0


def test_pieces(spark):
    docs = table(spark, ODD + ["wörd ▁x\n", "same text here"])
    rows = pieces.encode_texts(docs, pieces.model_bytes(), decoded="back").collect()
    assert all(r.text == r.back for r in rows) and rows[0].ids is None and rows[1].ids == [] and rows[1].score == 0.0
    assert all(r.score >= o.score for r in rows for o in r.others)
    back = pieces.decode_ids(docs.limit(0).withColumn("ids", F.array(F.lit(1))), pieces.model_bytes())
    assert back.count() == 0
    clash = pieces.encode_texts(docs.withColumn("ids", F.lit(1)).withColumn("score", F.lit("x")), pieces.model_bytes()).collect()
    assert [r.ids for r in clash] == [r.ids for r in rows] and [r.score for r in clash] == [r.score for r in rows]
    assert pieces.encode_texts(docs.limit(0), pieces.model_bytes()).count() == 0


def sets_of(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components_by_hand(texts):
    sets, root = [sets_of(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return [len(s) for s in sets], root


def near_copies(seed, n, most):
    rng, base = random.Random(seed), prose(seed, 120).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(most)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("short_list", [64, 3])
def test_jaccard(spark, monkeypatch, short_list):
    monkeypatch.setattr(jaccard, "SHORT_LIST", short_list)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 900)
    monkeypatch.setattr(jaccard, "PIVOT_ROWS", 4)
    monkeypatch.setattr(jaccard, "RANGE_SHINGLES", 700)
    monkeypatch.setattr(jaccard, "PIVOTS", 1)
    shared = prose(99, 60)
    texts = ODD + near_copies(1, 40, 6) + near_copies(2, 12, 3) + [f"{shared} {prose(i, 50)}" for i in range(30, 50)] + ["a b c d e f", "A B c d e f", "a b c d e", "b c d e f"]
    n, root = components_by_hand(texts)
    docs = table(spark, texts).withColumn("component_id", F.lit("clash"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_components(spark, docs).collect()}
    assert got == {i: (n[i], root[i]) for i in range(len(texts))}
    kept = [r.doc_id for r in jaccard.one_of_each(spark, docs).collect()]
    assert sorted(root[i] for i in kept) == sorted(set(root))


def test_jaccard_odd_ids(spark):
    docs = table(spark, ["p q r s t u", "p q r s t u", "x y z", None], [None, 7, 7, None])
    got = sorted(jaccard.similar_components(spark, docs).collect(), key=str)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(None, 2, 7), (7, 2, 7), (7, 1, 7), (None, 0, None)}
    assert jaccard.similar_components(spark, docs.limit(0)).count() == 0
    assert jaccard.one_of_each(spark, docs).count() == 3


def test_decontamination(spark):
    items = [" ".join(random.Random(i).choices([f"q{i}v{k}" for k in range(30)] + WORDS[:20], k=36)) for i in range(6)]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)] + [(90, None, 1), (91, "", 1), (0, items[0], 1)], "item_id long, text string, hits int")
    half = items[3].split()
    near = " ".join(w if k % 9 else "other" for k, w in enumerate(half))
    texts = ODD + [prose(i, 300) for i in range(20)] + [f"{prose(50, 90)} {items[1]} {prose(51, 200)}", f"{prose(52, 10)} {near.upper()}.", items[5], " ".join(half[:9]) + prose(53, 60)]
    docs = table(spark, texts).withColumn("hits", F.lit("clash"))
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark, docs, bench).collect()}
    first = len(ODD) + 20
    assert got == {(first, 1), (first + 1, 3), (first + 2, 5)}
    kept = decontam.drop_contaminated(spark, docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {first, first + 1, first + 2}
    assert decontam.contaminated(spark, docs.limit(0), bench).count() == 0 and decontam.contaminated(spark, docs, bench.limit(0)).count() == 0
    assert decontam.drop_contaminated(spark, docs, bench.limit(0)).count() == len(texts)


def test_quality(spark):
    rng = random.Random(2)
    texts = ODD + [prose(i, rng.randrange(20, 120)) + "." if i % 3 else " ".join(f"{w}!!" for w in prose(i, 60).upper().split()) for i in range(300)]
    docs = table(spark, texts).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i + len(ODD), int(i % 3 > 0), 0) for i in range(300)] + [(None, 1, 0), (3, None, 0), (12, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.score_quality(spark, docs, labels).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id >= len(ODD)]
    assert {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows} == {True}
    assert sum(r.predicted == int((r.doc_id - len(ODD)) % 3 > 0) for r in held) >= 0.97 * len(held)
    kept = quality.keep_good(spark, docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.predicted}
    assert {r.score for r in quality.score_quality(spark, docs, labels.limit(0)).collect()} == {1.0}
    assert quality.score_quality(spark, docs.limit(0), labels).count() == 0


def test_every_training_document_teaches(spark):
    model = pieces.model_bytes()
    layout = attention.Layout(np.arange(scoring.Subwords(model).size) % 7.0)
    first = layout.blank()
    for i in range(4):
        docs = table(spark, [prose(i, 40)], [i]).coalesce(1)
        moved = [not np.array_equal(first, scoring.train_everywhere(docs, first, layout, model, turn)) for turn in range(scoring.ROUNDS)]
        assert sum(moved) == 1, i


def test_texts_are_cut_once(spark, monkeypatch):
    model = pieces.model_bytes()
    texts = ODD + [prose(i, 60) for i in range(30)]
    held = lambda i: i % 4 == 0
    docs = table(spark, texts).withColumn("held_out", F.col("doc_id") % 4 == 0)
    rows = scoring.cut(docs, model).cache()
    s = scoring.Subwords(model)
    counts = Counter()
    for i, t in enumerate(texts):
        words = (t or "").encode().lower().split()
        ids = [x for w in words for x in s.sp.encode(w.decode()) or [s.sp.unk_id()]] + [s.end]
        (kept,) = rows.filter(F.col("word").isNull() & (F.col("doc_id") == i)).collect()
        assert np.frombuffer(kept.pieces, s.kind).tolist() == ids and kept.text == t
        counts.update([] if held(i) else [*words, scoring.END])
    got = rows.filter("word IS NOT NULL").groupBy("word").agg(F.sum("c")).collect()
    assert {bytes(w): c for w, c in got} == counts
    # what is kept teaches without the text
    layout = attention.Layout(scoring.count_ids(rows.filter("word IS NULL AND NOT held_out"), model))
    kept = rows.filter("word IS NULL").coalesce(1)
    state = layout.blank()
    want = scoring.train_everywhere(docs.coalesce(1), state, layout, model, 0)
    monkeypatch.setattr(scoring, "turn_of", lambda: F.col("turn"))
    turned = kept.withColumn("turn", F.pmod(F.crc32(F.concat_ws(":", F.lit("turn"), F.col("doc_id").cast("string")).cast("binary")), F.lit(scoring.ROUNDS)))
    assert np.allclose(scoring.train_everywhere(turned.withColumn("text", F.lit(None).cast("string")), state, layout, model, 0), want, atol=1e-4)
    assert not np.allclose(want, state, atol=1e-4)


def test_scoring(spark, monkeypatch):
    monkeypatch.setattr(scoring, "HEAD_WORDS", 50)
    texts = ODD + [prose(i, 80) for i in range(60)]
    docs = table(spark, texts).withColumn("score", F.lit("clash"))
    docs = docs.union(docs.filter("doc_id = 9"))
    rows = scoring.score_texts(spark, docs, pieces.model_bytes()).collect()
    counts = Counter()
    for i, t in [*enumerate(texts), (9, texts[9])]:
        if zlib.crc32(str(i).encode()) % 10:
            counts.update((t or "").encode().lower().split())
            counts["end"] += 1
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(texts) + 1
    for r in rows:
        words = (texts[r.doc_id] or "").encode().lower().split() + ["end"]
        want = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(w in counts for w in words), n)
        assert abs(r.base_score - want) < 1e-6 * abs(want) and r.score < 0 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
    assert len({round(r.score, 6) for r in rows if r.doc_id == 9}) == 1
    assert scoring.score_texts(spark, docs.limit(0), pieces.model_bytes()).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(500, 6)), 2)
    x[100:300] = x[100]
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)] + [(900, None, "c"), (1000, [0.0] * 6, "c"), (1100, [1.0, None] + [0.0] * 4, "c"), (1200, [float("nan")] * 6, "c"), (1300, [1.0] * 5, "c"), (None, [1.0] * 6, "c"), (7, x[7].tolist(), "c")]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = {}
    for r in neighbours.neighbours(spark, data, F.pmod("vec_id", F.lit(100)) == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert set(got) == {0, 100, 200, 300, 400}
    hits = total = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(500), d)) if i != q][:10]
        assert found == sorted(found) and all(abs(d[i] - s) < 1e-12 for s, i in found) and len(found) == 10
        hits, total = hits + len({i for _, i in found} & set(want)), total + 10
    assert hits >= 0.9 * total and [i for _, i in got[100]] == list(range(101, 111))
    assert neighbours.neighbours(spark, data.limit(0), F.lit(True)).count() == 0
    assert len(neighbours.neighbours(spark, data.limit(3), F.lit(True)).collect()) == 6


def test_neighbours_of_tiny_leaves_are_complete(spark, monkeypatch):
    """Few visits to leaves of one or two vectors: every query still gets k, and chunks of all sides meet."""
    monkeypatch.setattr(neighbours, "LEAF_SAMPLE", 1)
    monkeypatch.setattr(neighbours, "CHUNK", 2)
    monkeypatch.setattr(neighbours, "calibrated", lambda *_: 1)
    rng = np.random.default_rng(4)
    x = np.r_[rng.normal(size=(150, 4)), rng.normal(size=(3, 4)) + 100]
    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = neighbours.neighbours(spark, data, F.col("vec_id") % 7 == 5).collect()
    counts = Counter(r.query_id for r in rows)
    assert set(counts) == {i for i in range(153) if i % 7 == 5} and set(counts.values()) == {10}
    assert all(abs(math.dist(x[r.query_id], x[r.vec_id]) - r.score) < 1e-9 and r.vec_id != r.query_id for r in rows)
    every = neighbours.neighbours(spark, data.limit(6), F.lit(True)).groupBy("query_id").count().collect()
    assert [r["count"] for r in every] == [5] * 6


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)]
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in common.components(common.Workspace(spark, "t"), spark.createDataFrame(links, "a long, b long"), "c").collect()}
    assert got == {a: find(a) for a in root if find(a) != a}


def test_pipeline(spark):
    import corpus_pipeline

    item = " ".join(f"bench{i}" for i in range(30))
    texts = ODD + [prose(i, 90) for i in range(40)] + [prose(3, 90) + " tail", prose(60, 40) + " " + item, "Some words here. password = 'hunter2hunter2' and more words " + prose(61, 40)]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    folder = common.shared_dir(spark) + f"/pipeline-{hashlib.md5(str(random.random()).encode()).hexdigest()}"
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{folder}/{name}.parquet")
    rows = corpus_pipeline.run(spark, folder).collect()
    kept = {r.doc_id for r in rows}
    near = {len(ODD) + 3, len(ODD) + 40}
    assert len(kept & near) == 1 and len(ODD) + 41 not in kept and len(ODD) + 42 in kept and all(r.lossless for r in rows)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "pieces"]
    secret = secrets.redact_secrets(docs).filter(F.col("doc_id") == len(ODD) + 42).first()
    assert "hunter2" not in secret.text
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name


def pipeline_folder(spark, docs, labels, bench):
    folder = common.shared_dir(spark) + f"/pipeline-{hashlib.md5(str(random.random()).encode()).hexdigest()}"
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_pipeline_on_odd_rows(spark):
    """Null ids, repeated rows, clashing columns, and empty tables."""
    import corpus_pipeline

    item = " ".join(f"bench{i}" for i in range(30))
    texts = [None, "", " \n", "one two", prose(1, 60), prose(1, 60), f"{prose(2, 50)} {item}", prose(3, 70)]
    docs = table(spark, texts, [None, None, 5, 5, 6, None, 8, 9])
    docs = docs.union(docs.filter("doc_id = 9")).withColumns({c: F.lit("clash") for c in ("ids", "score", "others", "decoded", "_row", "_text", "_good", "key", "root", "h", "spans")})
    labels = spark.createDataFrame([(None, 1, 0), (6, None, 0), (9, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(0, item), (None, item), (1, None), (2, "")], "item_id long, text string")
    folder = pipeline_folder(spark, docs, labels, bench)
    rows = corpus_pipeline.run(spark, folder).collect()
    # one of the two copies, one of the repeated rows, no document with the item; blanks stay
    assert len(rows) == 6 and sum(r.doc_id == 9 for r in rows) == 1 and all(r.doc_id != 8 for r in rows) and all(r.lossless for r in rows)
    assert sorted(len(r.ids or []) == 0 for r in rows) == [False] * 3 + [True] * 3 or sum(r.ids is None for r in rows) == 1
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    assert corpus_pipeline.run(spark, pipeline_folder(spark, docs.limit(0), labels.limit(0), bench.limit(0))).count() == 0


def test_one_of_each_needs_no_places(spark):
    """The same folder read with other numbers of tasks gives the same rows."""
    texts = near_copies(5, 60, 4) + [prose(i, 40) for i in range(60, 160)] + ["", None, "", None]
    folder = common.shared_dir(spark) + f"/places-{hashlib.md5(str(random.random()).encode()).hexdigest()}"
    table(spark, texts).repartition(7).write.parquet(folder)
    got = []
    for size in ("128m", "1k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got.append(sorted(str(r.doc_id) for r in jaccard.one_of_each(spark, spark.read.parquet(folder)).collect()))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    n, root = components_by_hand(texts)
    assert got[0] == got[1] and len(got[0]) == len(set(root))


def test_decontamination_of_odd_rows(spark):
    item = " ".join(f"q{i}" for i in range(20))
    bench = spark.createDataFrame([("a", item), ("b", item), (None, "other words here for nothing")], "item_id string, text string")
    docs = spark.createDataFrame([("x", f"{prose(1, 30)} {item}"), ("x", f"{prose(1, 30)} {item}"), (None, item), ("y", None), (None, "")], "doc_id string, text string")
    got = sorted((str(r.doc_id), r.item_id) for r in decontam.contaminated(spark, docs, bench).collect())
    assert got == [("None", "a"), ("None", "b"), ("x", "a"), ("x", "b")]
    assert sorted(str(r.doc_id) for r in decontam.drop_contaminated(spark, docs, bench).collect()) == ["None", "y"]


def test_written_tables_leave_no_shuffle_files(spark):
    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {x.rpartition("/")[2] for x in files.mkString("\n").split("\n") if "/shuffle_" in x}

    before, setting = shuffles(), spark.conf.get(common._CLEANUP_SETTING, None)
    ws = common.Workspace(spark, "t")
    written = ws.table(spark.range(5000).repartition(3, "id").groupBy((F.col("id") % 7).alias("g")).count(), "counts")
    end = time.time() + 5
    while shuffles() - before and time.time() < end:  # files go in the background
        time.sleep(0.2)
    assert not shuffles() - before and spark.conf.get(common._CLEANUP_SETTING, None) == setting
    assert sum(r["count"] for r in written.collect()) == 5000


@pytest.mark.parametrize("often", [8, 1000])
def test_hashes_that_meet(spark, monkeypatch, often):
    monkeypatch.setattr(jaccard, "RANGE_SHINGLES", 50)
    monkeypatch.setattr(jaccard, "OFTEN", often)
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << jaccard.HASH_BITS, 120)
    held = [sorted({int(pool[0]), *rng.choice(pool, 6).tolist()}) if i % 9 else [] for i in range(80)]
    rows = [(i * (1 << 31), i % 3 == 0, bytearray(jaccard.as_bytes(np.array(h, np.uint64)))) for i, h in enumerate(held)]
    size, heads = Counter(x for h in held for x in h), Counter(x for i, h in enumerate(held) if i % 3 == 0 for x in h)
    ws = common.Workspace(spark, "t")
    got = jaccard._meeting(ws.table(spark.createDataFrame(rows, "rid long, head boolean, listed binary").repartition(3), "rows"))
    assert sorted(map(tuple, got.collect())) == sorted((x, rid, size[x], heads[x]) for (rid, _, _), h in zip(rows, held) for x in h if heads[x] > 1)
