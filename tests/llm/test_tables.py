"""Operators over whole tables against plain versions."""

import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from starsift.llm import components, forest, packing, pivots, sharding


def test_recall(sf_dir, result):
    table = pq.read_table(f"{sf_dir}/embeddings.parquet")
    ids, x = table["vec_id"].to_numpy(), np.array(table["embedding"].to_pylist(), dtype=np.float64)
    got, hits = result("op1_permutation_index"), 0
    by_id = dict(zip(ids.tolist(), x))
    for q, rows in got.groupby("query_id"):
        assert q not in set(rows.vec_id) and list(rows["rank"]) == list(range(1, 21))
        assert list(rows.score) == sorted(rows.score, reverse=True)
        assert rows.score.to_numpy() == pytest.approx([by_id[q] @ by_id[v] for v in rows.vec_id], abs=1e-12)
        score = x @ by_id[q]
        score[ids == q] = -9
        hits += len(set(ids[np.lexsort((ids, -score))[:20]]) & set(rows.vec_id))
    assert got.query_id.nunique() == (ids % 20 == 0).sum() and hits / len(got) >= 0.9


def test_nearest_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [3.0, 1.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0]), (4, None), (5, [0.0, 0.0]),
            (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (20, [0.5, 0.5]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id int, embedding array<float>, score int")
    out = pivots.nearest(df, df.where("vec_id % 20 = 0"), 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in out] == [(0, 1), (0, 2), (0, 3), (20, 1), (20, 2), (20, 3)]
    assert pivots.nearest(df.limit(0), df.limit(0)).collect() == []


def test_same_vectors_tie_by_id(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 8))
    x[::3] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = list(enumerate(x.tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = pivots.nearest(df, df.where("vec_id % 20 = 0"), 5).where("query_id = 60").orderBy("rank").collect()
    assert [r.vec_id for r in out] == [0, 3, 6, 9, 12]


def test_shards(documents, result):
    got = result("op3_lpt_sharding")
    texts = {d["doc_id"]: d["text"] or "" for d in documents}
    assert len(got) == len(documents) and (got.law == "bytes").all() and got.grown_shard.isna().all()
    for r in got.itertuples():
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    assert got.groupby(got.doc_id.map(texts))["shard"].nunique().max() == 1
    for _, rows in got.groupby("shard"):
        assert sorted(rows.slot) == list(range(len(rows)))
    loads = got.groupby("shard")["size"].sum()
    assert len(loads) == 16 and loads.max() - loads.min() <= got["size"].median()


def test_lpt_equals_heap():
    import heapq

    rng = np.random.default_rng(1)
    for _ in range(30):
        sizes = sorted(set(rng.integers(1, 400, 20).tolist()), reverse=True)
        classes = [(s, int(rng.integers(1, 60))) for s in sizes]
        heap = [(0, s) for s in range(5)]
        for size, n in classes:
            for _ in range(n):
                load, s = heapq.heappop(heap)
                heapq.heappush(heap, (load + size, s))
        given = sharding.lpt(classes, 5)
        loads = sorted(sum(size * g[s] for (size, _), g in zip(classes, given)) for s in range(5))
        assert loads == sorted(load for load, _ in heap) and [sum(g) for g in given] == [n for _, n in classes]


def test_shard_odd_rows(spark, odd, tmp_path):
    rows = sharding.shard(odd, 4).collect()
    assert len(rows) == odd.count()
    assert len({r.shard for r in rows if r.doc_id in (1, 2)}) == 1  # null counts as empty
    assert sharding.shard(odd.limit(0), 4).collect() == []
    few = odd.where("doc_id in (4, 5, 7)")
    sharding.write_shards(few, sharding.shard(few, 2), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def plain_fit(sizes, sources, clusters, capacity, per_source):
    bins, out = [], []
    for size, source, cluster in zip(sizes, sources, clusters):
        fit = [
            (capacity - sum(s for s, _, _ in b), at) for at, b in enumerate(bins)
            if capacity - sum(s for s, _, _ in b) >= size and cluster not in [c for _, _, c in b]
            and [x for _, x, _ in b].count(source) < per_source
        ]
        at = min(fit)[1] if fit else len(bins)
        bins[at:at] = [[]] if at == len(bins) else []
        out.append((at, sum(s for s, _, _ in bins[at])))
        bins[at].append((size, source, cluster))
    return out


def test_best_fit_equals_plain():
    rng = np.random.default_rng(4)
    for _ in range(25):
        n = 120
        sizes = sorted(rng.integers(1, 90, n).tolist(), reverse=True)
        sources = rng.choice(["hot", "hot", "hot", "a", "b"], n).tolist()
        clusters = rng.integers(0, 40, n).tolist()
        assert packing.best_fit(sizes, sources, clusters, 100, 2) == plain_fit(sizes, sources, clusters, 100, 2)


def check_bins(rows, per_source=4):
    packed = rows.dropna(subset=["bin"])
    for _, b in packed.groupby(["cell", "bin"]):
        assert b["size"].sum() <= packing.CAPACITY and b.cluster.nunique() == len(b)
        ends = (b.offset + b["size"]).sort_values()
        assert (b.offset.sort_values().to_numpy()[1:] >= ends.to_numpy()[:-1]).all()


def test_packing(documents, result):
    got = result("op5_best_fit_packing")
    check_bins(got)
    words = {d["doc_id"]: len((d["text"] or "").encode().split()) for d in documents}
    assert got.groupby("doc_id")["size"].sum().to_dict() == words


def test_packing_odd_rows(spark, odd):
    sized = odd.select("doc_id", "source", packing.word_count().alias("n"), packing.text_cluster().alias("cluster"))
    got = packing.pack(sized, size="n", cluster="cluster").toPandas()
    check_bins(got)
    assert got["size"].sum() == sum(len((r.text or "").split()) for r in odd.collect())
    assert (got.doc_id == 2).sum() == 2
    assert packing.pack(sized.limit(0), size="n", cluster="cluster").collect() == []


def plain_groups(texts, words, percent=80):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        k = min(words, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((top(a), top(b)))
                    root[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


def check_groups(rows, want):
    assert len(rows) == len(want)
    for r in rows:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_near_duplicates(spark, documents, result):
    check_groups(list(result("op6_minhash_forest").itertuples()), plain_groups({d["doc_id"]: d["text"] for d in documents}, 2))


@pytest.mark.parametrize("words", [2, 5])
def test_near_copies_of_one_text(spark, words):
    """A crowded region: many copies of one text, each with its own changes, beside pairs and chains."""
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in rng.integers(0, 5000, 120)]
    texts = {}
    for i in range(250):
        copy = list(base)
        for at in rng.choice(120, int(rng.integers(1, 9)), replace=False):
            copy[at] = f"x{rng.integers(0, 10**6)}"
        texts[i] = " ".join(copy)
    for i in range(250, 330, 2):
        own = [f"w{j}" for j in rng.integers(0, 5000, 60)]
        texts[i], texts[i + 1] = " ".join(own), " ".join(own[:-4])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    check_groups(forest.near_duplicates(df, words=words).collect(), plain_groups(texts, words))


def test_only_link_in_a_crowded_group(spark):
    """5,000 copies of one text with own changes; 40 texts are linked with one little changed copy each and nothing else."""
    rng = np.random.default_rng(3)
    fresh = iter(range(10**6))
    base = [f"w{i}" for i in range(100)]

    def changed(words, places):
        out = list(words)
        for at in places:
            out[at] = f"x{next(fresh)}"
        return out

    sets = [base] + [changed(base, rng.choice(100, 8, replace=False)) for _ in range(5000)]
    for i in range(40):
        own = rng.permutation(100)
        near = changed(base, own[:3])
        far = changed(near, own[3:14])
        both = len(set(near) & set(far))
        assert 100 * both >= 80 * (200 - both) and 100 * len(set(base) & set(far)) < 80 * (200 - len(set(base) & set(far)))
        sets += [near, far]
    df = spark.createDataFrame([(i, " ".join(s)) for i, s in enumerate(sets)], "doc_id long, text string").repartition(4)
    rows = forest.near_duplicates(df, words=1).collect()
    assert len(rows) == len(sets) and {r.component_id for r in rows} == {0}
    assert [r.doc_id for r in rows if r.kept] == [0]


def test_parity_maps_bound_sets_of_any_size():
    rng = np.random.default_rng(4)
    for n in (1, 3, 250, 3000, 30_000):
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        for own in (0, n // 9, n // 3):
            y = np.unique(np.r_[x[own:], rng.integers(0, 2**63, own // 2, dtype=np.uint64)])
            if not len(y):
                continue
            maps = [np.frombuffer(forest._parity(s), dtype=np.uint64)[None, :] for s in (x, y)]
            least = min(m.shape[1] for m in maps)
            one, two = (forest._narrowed(m, least) for m in maps)
            assert np.bitwise_count(one ^ two).sum() <= len(np.setxor1d(x, y))
            assert (forest._narrowed(one, 4) == forest._narrowed(maps[0], 4)).all()


def test_long_family_gives_few_candidates(spark, monkeypatch):
    """300 copies of a 3,000-word text with own changes, unlinked (similarity near 0.57); two of them have a linked copy."""
    rng = np.random.default_rng(11)
    fresh = iter(range(10**7))
    base = [f"w{i}" for i in range(3000)]
    sets = []
    for _ in range(300):
        copy = list(base)
        for at in rng.choice(3000, 410, replace=False):
            copy[at] = f"x{next(fresh)}"
        sets.append(copy)
    sets += [sets[5][:-100], sets[250][:-100]]
    rows, write = {}, forest.stored

    def counted(df, name):
        out = write(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(forest, "stored", counted)
    df = spark.createDataFrame([(i, " ".join(s)) for i, s in enumerate(sets)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in forest.near_duplicates(df, words=1).collect()}
    assert got == {i: i for i in range(300)} | {300: 5, 301: 250}
    assert rows["left"] + rows["pairs"] < 5000


def test_near_duplicates_odd_rows(spark, odd):
    rows = forest.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[5].component_id == 4 and by_id[2].component_id == 2 and by_id[2].n_shingles == 0
    assert by_id[7].n_shingles == 1 and not by_id[None].kept
    assert forest.near_duplicates(odd.limit(0)).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 90), (90, 95), (200, 200), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {90: 90, 95: 90, 100: 90, 200: 200}


def test_pipeline(spark, sf_dir, documents):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {d["doc_id"]: d["text"] for d in documents}
    sizes = [len(texts)]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
            rows = {r.doc_id: r.text for r in docs.collect()}
            if name == "near-duplicates":
                want = plain_groups(before, 5)
                assert set(rows) == {i for i, (_, root) in want.items() if i == root}
            if name == "secrets":
                assert set(rows) == set(before) and not any("AKIA" in (t or "") and "[SECRET]" not in t for t in rows.values())
            before = rows
            sizes.append(len(rows))
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] == sizes[4] > 0.5 * sizes[0]
    assert docs.groupBy().sum("size").first()[0] == sum(len((t or "").split()) for t in before.values())


def test_pipeline_odd_rows(spark, odd, sf_dir):
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        docs.collect()
    docs = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.collect() == []
