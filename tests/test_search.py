"""Space, text, vectors, passages, delimited files."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import retrieval
from tessera.engine import Engine, media_kind
from tessera.errors import DuplicateError, MaintenanceError, SqlBindingError, SqlUnsupportedError
from tessera.functions import geo
from tessera.operators import vectors
from tessera.operators.features import Features, nearest_words, vocabulary
from tessera.operators.text import TextIndex, query_words
from tessera.sources.delimited import delimiter, read_delimited


@pytest.fixture(scope="module")
def places(spark):
    rng = random.Random(3)
    rows = [(i, rng.uniform(-12.29, -11.81), rng.uniform(-77.24, -76.76)) for i in range(300)]
    e = Engine(spark)
    e.register("places", spark.createDataFrame(rows, "id long, latitud double, longitud double"), "id")
    return e, rows


def _metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((p - q) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(a[1] - b[1]) / 2) ** 2
    return 2 * 6371008.771415059 * math.asin(math.sqrt(h))


@pytest.mark.parametrize("radius", [0, 500, 5000, 50_000])
def test_radius(places, radius):
    e, rows = places
    point = (-12.05, -77.03)
    want = [r[0] for r in rows if _metres(r[1:], point) <= radius]
    assert [r["id"] for r in e.spatial_radius("places", point, radius).collect()] == want
    assert [r[0] for r in e.sql(f"SELECT id FROM places WHERE DISTANCIA(ubicacion, POINT(-12.05, -77.03)) <= {radius} ORDER BY id").fetchall(999)] == want


def test_nearest(places):
    e, rows = places
    want = [i for _, i in sorted((_metres(r[1:], (-12.0, -77.0)), r[0]) for r in rows)]
    assert [r["id"] for r in e.spatial_knn("places", (-12.0, -77.0), 7).collect()] == want[:7]
    assert [r[0] for r in e.sql("SELECT id FROM places ORDER BY DISTANCE(ubicacion, p) LIMIT 7", {"p": (-12.0, -77.0)}).fetchall(9)] == want[:7]
    assert e.spatial_knn("places", (-12.0, -77.0), 0).count() == 0


def test_polygon(spark):
    ring = [(-12.20, -77.15), (-12.20, -76.85), (-12.10, -76.85), (-12.10, -77.00), (-11.95, -77.00), (-11.95, -77.15)]
    rows = [(1, -12.15, -76.9), (2, -12.0, -77.1), (3, -12.0, -76.9), (4, -12.20, -77.0), (5, -12.10, -77.00), (6, -12.25, -77.0)]
    e = Engine(spark)
    e.register("p", spark.createDataFrame(rows, "id long, latitud double, longitud double"), "id")
    assert [r["id"] for r in e.spatial_polygon("p", ring).collect()] == [1, 2, 4, 5]
    for bad in ([(-12.0, -77.0)] * 3, [(-12.2, -77.1), (-12.1, -77.0), (-12.2, -77.0), (-12.1, -77.1)], [(-12.2, -77.2), (-12.1, -77.1), (-12.0, -77.0)]):
        with pytest.raises(SqlBindingError):
            geo.polygon(bad)


@pytest.mark.parametrize("text", ["SELECT id FROM places WHERE DISTANCIA(ubicacion, POINT(10.0, 10.0)) < 5", "SELECT DISTANCIA(nope, POINT(-12.0, -77.0)) FROM places", "SELECT COUNT(*) FROM places ORDER BY DISTANCIA(ubicacion, POINT(-12.0, -77.0))"])
def test_spatial_errors(places, text):
    with pytest.raises((SqlBindingError, SqlUnsupportedError)):
        places[0].sql(text)


@pytest.fixture(scope="module")
def library(spark):
    e = Engine(spark)
    e.register("docs", spark.createDataFrame([(30, "base base datos"), (7, "Base."), (11, "datos índice"), (90, "...")], "id long, texto string"), "id")
    e.publish_text("docs", "id", "texto")
    return e


def _bm25(docs, query):
    words = {i: query_words(t) for i, t in docs}
    n, mean = len(docs), sum(map(len, words.values())) / len(docs)
    out = {}
    for i, ws in words.items():
        score = 0.0
        for term in sorted(set(query_words(query))):
            df = sum(term in x for x in words.values())
            if df and term in ws:
                tf = ws.count(term)
                score += math.log1p((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))
        if score:
            out[i] = score
    return out


def test_text(library):
    docs = [(30, "base base datos"), (7, "Base."), (11, "datos índice"), (90, "...")]
    got = dict(library.sql("SELECT id, SCORE() FROM docs WHERE MATCH(texto, 'base datos') USING BM25").fetchall(9))
    assert got == pytest.approx(_bm25(docs, "base datos"), rel=1e-10) and got[30] == pytest.approx(1.2357761692752447, rel=1e-10)
    ranked = library.sql("SELECT id, SCORE() AS s FROM docs WHERE MATCH(texto, 'base datos nada') USING TF_IDF ORDER BY s DESC LIMIT 2").fetchall(9)
    assert [r[0] for r in ranked] == [30, 7] and ranked[0][1] == pytest.approx(0.9684388219443362, rel=1e-10) and ranked[1][1] == pytest.approx(0.7071067811865475, rel=1e-10)
    assert library.sql("SELECT id FROM docs WHERE MATCH(texto, 'nada') USING BM25").fetchall(9) == []
    for bad in ("SELECT id FROM docs WHERE MATCH(id, 'x') USING BM25", "SELECT SCORE() FROM docs", "SELECT id FROM docs WHERE MATCH(texto, 'x') USING BM25 ORDER BY texto", "SELECT id FROM docs WHERE MATCH(texto, 'x') USING BM25 AND id = 1"):
        with pytest.raises(Exception, match="."):
            library.sql(bad)


def test_words(spark):
    assert query_words("Café_x, ÑANDÚ 12") == ["café", "x", "ñandú", "12"]
    rows = spark.createDataFrame([(1, "Café b"), (2, None)], "id long, t string")
    index = TextIndex.build(rows, "id", "t", exact=True)
    assert {r["term"] for r in index.lexicon.collect()} == {"café", "b"} and index.n == 2


@pytest.fixture(scope="module")
def cloud(spark):
    x = np.random.default_rng(1).standard_normal((600, 12))
    x[1] = x[0]
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vector array<float>")


def _true(x, q, metric, k):
    x = x.astype(np.float32).astype(float)
    s = -np.linalg.norm(x - q, axis=1) if metric == "euclidean" else x @ q if metric == "dot" else x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q)
    return np.lexsort((np.arange(len(x)), -s))[:k].tolist()


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_vectors(cloud, metric):
    x, df = cloud
    q = [float(v) for v in x[0].astype(np.float32)]
    want = _true(x, np.array(q), metric, 10)
    assert [r["id"] for r in vectors.exact(df, q, 10, metric).collect()] == want
    index = vectors.IvfIndex.build(df, metric)
    assert [r["id"] for r in index.search(q, 10, len(index.centres)).collect()] == want
    graphs = vectors.HnswIndex.build(df, metric, rows_per_graph=400)
    assert vectors.recall([r["id"] for r in graphs.search(q, 10).collect()], want) >= 0.9
    assert graphs.search(q, 600).count() == 600 and graphs.search(q, 10).schema["id"].dataType.simpleString() == "bigint"
    assert index.search(q, 600).count() == 600  # widens until enough


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_default_recall(spark, metric, tmp_path):
    """With their defaults, stored indexes without clear cells still find 0.9 of the neighbours."""
    x = np.random.default_rng(2).standard_normal((2500, 24))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vector array<float>")
    for index in (vectors.IvfIndex.build(df, metric).save(f"{tmp_path}/ivf"), vectors.HnswIndex.build(df, metric, f"{tmp_path}/hnsw", rows_per_graph=1000)):
        found = []
        for i in range(0, 2500, 100):
            q = [float(v) for v in x[i].astype(np.float32)]
            found.append(vectors.recall([r["id"] for r in index.search(q, 10).collect()], _true(x, np.array(q), metric, 10)))
        assert np.mean(found) >= 0.9


def _tied_cloud(spark):
    """900 vectors, every third a copy of another, and their table in a few partitions."""
    x = np.random.default_rng(6).standard_normal((900, 8)).astype(np.float32).astype(float)
    x[::3] = x[1]
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vector array<float>").repartition(3)


def _lists(found, n):
    out = [[] for _ in range(n)]
    for r in found.orderBy("query", F.desc("score"), "id").collect():
        out[r["query"]].append(r["id"])
    return out


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_many_queries(spark, metric, tmp_path):
    """Queries asked together find what they find alone, ties among copies by id."""
    x, df = _tied_cloud(spark)
    asked = x[[0, 5, 300, 701]]
    many = lambda found: _lists(found, len(asked))
    assert many(vectors.exact_many(df, asked, 7, metric)) == [[r["id"] for r in vectors.exact(df, q.tolist(), 7, metric).collect()] for q in asked]
    ivf, hnsw = vectors.IvfIndex.build(df, metric).save(f"{tmp_path}/ivf"), vectors.HnswIndex.build(df, metric, f"{tmp_path}/hnsw", rows_per_graph=400)
    assert hnsw.blocks.count() == 3
    for index in (ivf, hnsw):
        assert many(index.search_many(asked, 7)) == [[r["id"] for r in index.search(q.tolist(), 7).collect()] for q in asked]
    assert [len(ids) for ids in many(ivf.search_many(asked, 1000, 1))] == [900] * 4


@pytest.mark.parametrize("kind", ["ivf", "hnsw"])
def test_recall_jobs(spark, kind, tmp_path):
    """The number of jobs doesn't grow with the number of queries."""
    from tessera.queries import QUERIES

    x, df = _tied_cloud(spark)
    jobs = []
    for copies in (1, 6):
        rows = df.crossJoin(spark.range(copies).select(F.col("id").alias("copy"))).selectExpr("id + 900 * copy AS vec_id", "vector AS embedding")
        rows.coalesce(1).write.parquet(f"{tmp_path}/{copies}/embeddings.parquet")
        spark.sparkContext.setJobGroup(f"recall-{kind}-{copies}", "")
        got = QUERIES[f"vector_recall_{kind}"](spark, f"file://{tmp_path}/{copies}").collect()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"recall-{kind}-{copies}")))
        spark.sparkContext.setJobGroup("", "")
        assert [(r["metric"], r["asked"], r["recall_is_0_9"]) for r in got] == [(m, 9 * copies, True) for m in vectors.METRICS]
    assert jobs[1] <= jobs[0] + 3


def test_graph_of_copies():
    """Copies and lone points: every point can be reached, and a stored graph is the same graph."""
    rng = np.random.default_rng(4)
    x = np.vstack([np.repeat(rng.standard_normal((3, 5)), 200, axis=0), rng.standard_normal((40, 5)) + 50])
    graph = vectors.Graph.load(vectors.Graph.build(x).dump())
    for i in (0, 250, 599, 620):
        found = graph.search(x[i], 3, 8)
        assert i in found and {j for j in range(640) if (x[j] == x[i]).all()} <= {*found.tolist()}
    assert len(graph.search(x[0], 640, 8)) == 640 and not len(vectors.Graph.build(np.zeros((0, 3))).search(np.zeros(3), 2, 8))
    assert vectors.Graph.build(np.ones((1, 3))).search(np.ones(3), 2, 8).tolist() == [0]


def test_vector_errors(spark, cloud):
    with pytest.raises(SqlBindingError):
        vectors.exact(cloud[1], [0.0] * 12, 3)
    with pytest.raises(SqlBindingError):
        vectors.check_collection(spark.createDataFrame([(1, [0.0]), (2, [1.0])], "id long, vector array<float>"))


def test_passages(spark):
    text = " ".join(f"w{i}" for i in range(1130))
    rows = retrieval.chunks(spark.createDataFrame([(5, text)], "id long, t string"), "id", "t").orderBy("position").collect()
    assert [len(r["content"].split()) for r in rows] == [226] * 5 and " ".join(r["content"] for r in rows) == text
    assert retrieval.citations("so [S1] and [S2] [S1]", ["S1", "S2"]) == ["S1", "S2"]
    with pytest.raises(SqlBindingError):
        retrieval.citations("see [S9]", ["S1"])
    with pytest.raises(Exception, match="200 words"):
        retrieval.chunks(spark.createDataFrame([(5, "short")], "id long, t string"), "id", "t").collect()


def test_passages_by_bytes(spark):
    """More parts while a part is too long, down to 200 words each; then the text is refused."""
    cut = lambda n, width, **more: retrieval.chunks(spark.createDataFrame([(5, " ".join(["x" * width] * n))], "id long, t string"), "id", "t", **more).orderBy("position").collect()
    assert [len(r["content"].split()) for r in cut(1000, 15)] == [250] * 4  # 3,999 bytes fit 4,015
    assert [len(r["content"].split()) for r in cut(1000, 18)] == [200] * 5  # five parts at most
    with pytest.raises(Exception, match="no cut fits"):
        cut(1000, 30)
    assert [(r["position"], r["content"]) for r in cut(1000, 30, refuse=False)] == [(0, None)] == [(r["position"], r["content"]) for r in cut(199, 3, refuse=False)]
    many = cut(20_300, 4, row_bytes=1069)  # 201 words fit, so about 101 parts, long after the first count of 81
    assert len(many) == 101 and max(len(r["content"]) for r in many) <= 1005
    papers = spark.createDataFrame([(1, None), (2, "")], "id long, t string")
    assert [r["position"] for r in retrieval.chunks(papers, "id", "t", refuse=False).collect()] == [0, 0]


def test_chunks_agree_with_sql(spark, tmp_path):
    """Words of many bytes don't change the cut: chunks beyond the operator's row size, and texts that no cut would fit."""
    import duckdb

    import __spark_entry__ as entry

    texts = [(i, " ".join(f"{'x' * width}{j}" for j in range(n)), "s") for i, (n, width) in enumerate([(260, 18), (1130, 18), (700, 40), (250, 3), (199, 40)])]
    spark.createDataFrame(texts, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["rag_chunks"](spark, f"file://{tmp_path}").collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, got), key=key) == sorted(db.execute(entry.oracle_sql()["rag_chunks"]).fetchall(), key=key)
    assert max(len(r[2] or "") for r in got) > retrieval.ROW_BYTES


def test_text_refuses_repeated_ids(spark):
    with pytest.raises(DuplicateError):
        TextIndex.build(spark.createDataFrame([(1, "a"), (1, "b")], "id long, t string"), "id", "t")


def test_text_without_index(spark, library):
    """The same scores without a published index; a table without key is refused."""
    e = Engine(spark)
    e.register("docs", library.registered["docs"].frame, "id")
    e.register("loose", library.registered["docs"].frame)
    text = "SELECT id, SCORE() FROM docs WHERE MATCH(texto, 'base datos') USING {}"
    for model in ("BM25", "TF_IDF"):
        assert e.sql(text.format(model)).fetchall(9) == library.sql(text.format(model)).fetchall(9)
    assert e.sql("EXPLAIN " + text.format("BM25")).text.splitlines()[1].strip().startswith("TextScan")
    assert "TextIndexScan" in library.sql("EXPLAIN " + text.format("BM25")).text
    with pytest.raises(SqlBindingError):
        e.sql(text.format("BM25").replace("docs", "loose"))


def test_text_orders(library):
    rows = library.text_search("docs", "texto", "base datos").collect()
    assert [r["id"] for r in rows] == [30, 7, 11]
    assert [r["id"] for r in library.text_search("docs", "texto", "base datos", order="score_asc", limit=2).collect()] == [11, 7]
    assert [r["id"] for r in library.text_search("docs", "texto", "base datos", order="id_desc").collect()] == [30, 11, 7]
    with pytest.raises(SqlBindingError):
        library.text_search("docs", "texto", "x", order="best")


def test_media_keys(spark, tmp_path):
    assert media_kind("a.JPG") == "image" and media_kind("x-1.mp3", "audio") == "audio"
    for bad in ("", ".jpg", "a/b.jpg", "a..b.jpg", "a.gif", "a" * 125 + ".jpg", "a.jpg"):
        with pytest.raises(SqlBindingError):
            media_kind(bad, "audio" if bad == "a.jpg" else None)
    e = Engine(spark, f"file://{tmp_path}")
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 1.0])], "id long, vector array<float>")
    e.register("m", spark.createDataFrame([(1, "a.png"), (2, "b.png"), (3, "c.png")], "id long, media_key string"), "id")
    with pytest.raises(SqlBindingError):
        e.publish_media("m", "id", rows, kind="audio")
    e.publish_media("m", "id", rows, kind="image")
    for index in ("IVF", "HNSW"):
        for _ in range(2):
            assert [r[0] for r in e.sql(f"SELECT id FROM m WHERE SIMILAR_TO('a.png', k=2) USING {index} WITH METRIC=cosine").fetchall(9)] == [1, 2]
    assert len(e.registered["m"].media.indexes) == 2 and len(list((tmp_path / ".indexes" / "m").iterdir())) == 2
    assert [r["id"] for r in e.vector_search("m", [0.0, 2.0], 1, "HNSW").collect()] == [3]
    with pytest.raises(SqlBindingError):
        e.sql("SELECT id FROM m WHERE SIMILAR_TO('../a.png', k=2) USING IVF WITH METRIC=cosine")


def test_similar_to_is_exact(spark):
    """Without clear cells the default number of probed cells misses neighbours; SIMILAR_TO over an inverted file does not."""
    x = np.random.default_rng(2).standard_normal((2500, 24)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vector array<float>")
    e = Engine(spark)
    e.register("m", df.selectExpr("id", "concat('v', id, '.jpg') AS media_key"), "id")
    e.publish_media("m", "id", df)
    missed = 0
    for metric in vectors.METRICS:
        for i in (7, 100, 1200):
            got = e.sql(f"SELECT id, SIMILARITY_SCORE() FROM m WHERE SIMILAR_TO('v{i}.jpg', k=10) USING IVF WITH METRIC={metric}").fetchall(10)
            assert [r[0] for r in got] == _true(x, x[i], metric, 10)
            missed += [r["id"] for r in e.vector_search("m", f"v{i}.jpg", 10, "IVF", metric).collect()] != [r[0] for r in got]
    assert missed
    # Where cells are clear the bounds leave most out.
    clear = np.repeat(np.eye(16), 50, axis=0) * 100 + np.random.default_rng(3).standard_normal((800, 16)) / 100
    index = vectors.IvfIndex.build(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(clear)], "id long, vector array<double>"), "euclidean", cells=16)
    far = np.linalg.norm(index.centres - clear[0], axis=1)
    assert (index._bounds(clear[0]) >= -1.0).sum() == (far < 1.0).sum() < 16 and (index.radii < 1.0).all()
    assert [r["id"] for r in index.search_exactly(clear[0].tolist(), 5).collect()] == _true(clear, clear[0], "euclidean", 5)


def test_retrieve(spark):
    e = Engine(spark)
    e.register("c", spark.createDataFrame([(11, 1, 1, "stars and gas"), (21, 2, 1, "cells and genes")], "chunk_id long, paper_id long, position long, content string"), "chunk_id")
    e.register("p", spark.createDataFrame([(1, "Sky"), (2, "Life")], "paper_id long, title string"), "paper_id")
    e.publish_text("c", "chunk_id", "content")
    assert [(r["label"], r["title"], r["chunk_id"]) for r in e.retrieve("c", "p", "which genes").collect()] == [("S1", "Life", 21)]
    assert e.retrieve("c", "p", "nothing known").count() == 0


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;x;ok;s\n1;2.5;true;a\n2;3;FALSE;\n")
    p = read_delimited(spark, str(tmp_path / "a.csv"))
    assert p.columns == [("id", "INTEGER"), ("x", "FLOAT"), ("ok", "BOOLEAN"), ("s", "VARCHAR")]
    assert [tuple(r) for r in p.frame.collect()] == [(1, 2.5, True, "a"), (2, 3.0, False, "")]
    (tmp_path / "b.csv").write_text("a,a\n1,2\n")
    with pytest.raises(MaintenanceError):
        read_delimited(spark, str(tmp_path / "b.csv"))
    (tmp_path / "c.csv").write_text("a,b\n1,2,3\n")
    with pytest.raises(Exception, match="."):
        read_delimited(spark, str(tmp_path / "c.csv")).frame.collect()
    assert delimiter("a|b|c,d") == "|"


def test_load_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;x;s\n1;2.5;abc\n2;3;\n")
    (tmp_path / "b.csv").write_text("id;s\n1;a\n1;b\n")
    e = Engine(spark, f"file://{tmp_path}/tables")
    assert e.session().load_delimited("t", str(tmp_path / "a.csv"), "id") == 2
    assert e.sql("SELECT id, x, s FROM t ORDER BY id").fetchall(9) == [(1, 2.5, "abc"), (2, 3.0, "")]
    for name, file, key in (("t", "a.csv", "id"), ("u", "b.csv", "id"), ("u", "a.csv", "nope"), ("u", "a.csv", "x")):
        with pytest.raises((SqlBindingError, DuplicateError)):
            e.session().load_delimited(name, str(tmp_path / file), key)
    assert {*e.store.catalog["tables"]} == {"t"}


def test_features(spark, tmp_path):
    """Histograms, TF-IDF vectors and a query's vector against loops over objects; what is refused."""
    rng = np.random.default_rng(4)
    rows = [(i % 23, [float(x) for x in rng.normal(i % 5, 1.0, 3)]) for i in range(400)] + [(99, [0.0, 0.0, 0.0])] * 2
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    centres = vocabulary(df, 6)
    assert centres.shape == (6, 3) and np.array_equal(centres, vocabulary(df, 6))
    centres[5] = centres[2]  # equally near words: the lower one
    counts = {}
    for i, v in rows:
        far = [sum((a - float(b)) ** 2 for a, b in zip(v, c, strict=True)) for c in centres]
        counts.setdefault(i, [0] * 6)[far.index(min(far))] += 1
    n = len(counts)
    idf = [math.log((n + 1) / (sum(h[j] > 0 for h in counts.values()) + 1)) + 1 for j in range(6)]
    weigh = lambda h: [(1 + math.log(k)) * w if k else 0.0 for k, w in zip(h, idf, strict=True)]
    for path in (None, f"file://{tmp_path}/words"):
        built = Features.build(df, centres, path)
        assert built.n == n and {(r["id"], r["word"]): r["n"] for r in built.counts.collect()} == {(i, j): k for i, h in counts.items() for j, k in enumerate(h) if k}
        got = {r["id"]: r["vector"] for r in built.vectors().collect()}
        assert got.keys() == counts.keys() and all(got[i] == pytest.approx(weigh(h), rel=1e-6) for i, h in counts.items())
    assert built.query([v for i, v in rows if i == 7]) == pytest.approx(got[7]) and got[7][5] == 0
    assert list(nearest_words(np.zeros((1, 3)), np.ones((3, 3)))) == [0]
    e = Engine(spark)
    e.register("images", spark.createDataFrame([(i, f"p{i}.jpg") for i in counts], "id long, media_key string"), "id")
    e.publish_media("images", "id", built.vectors())
    assert e.sql("SELECT id FROM images WHERE SIMILAR_TO('p7.jpg', k=1) USING IVF WITH METRIC=cosine").fetchall(9)
    for bad in ([], [(1, [1.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [math.nan])], [(None, [1.0])]):
        with pytest.raises(SqlBindingError):
            vocabulary(spark.createDataFrame(bad, "id long, vector array<double>"), 1)
    for size in (0, 500):
        with pytest.raises(SqlBindingError):
            vocabulary(df, size)
    for call in (lambda: Features.build(df, centres[:, :2]), lambda: built.query([[1.0]])):
        with pytest.raises(SqlBindingError):
            call()
