"""Exact, near and embedding duplicates against brute force on the smallest tables and on odd rows."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import queries
from lodestone.llm.common import connected_components, joined, looked_up
from lodestone.llm.embedding_dedup import embedding_links
from lodestone.llm.exact_dedup import _named, exact_dedup
from lodestone.llm.simhash import _linked, candidate_lists, parts, parts_for, simhash_groups, with_distances

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize(("block", "most_repeated"), [(3, 1 << 20), (3, 0), (4096, 1 << 20), (4096, 0)])
def test_exact_copies(spark, tables, block, most_repeated):
    texts = [None, "", "A", "a", "É", "é", "ab" * 5000, "AB" * 5000, "ab" * 4999 + "aa", "abc", "abcabc", "abcabcabc", "x", " x", "abd"]
    rows = [(k, t, "clash") for k, t in enumerate(texts)]
    if block > 3:
        rows += [(1000 + r["doc_id"], r["text"], "clash") for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    groups = defaultdict(list)
    for doc_id, text, _ in rows:
        groups[(text or "").translate(UPPER)].append(doc_id)
    expected = sorted((d, max(g), len(g), d == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g)
    table = spark.createDataFrame(rows, "doc_id long, text string, name string").repartition(4)
    found = exact_dedup(table, block, most_repeated).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, found.collect())) == expected
    assert exact_dedup(table.limit(0), block, most_repeated).count() == 0


def test_block_names_are_places_in_one_order(spark):
    values = sorted({bytes([k % 7, k % 11, k % 3]) for k in range(400)})
    table, names = spark.createDataFrame([(bytearray(v),) for v in values] * 2, "block binary"), []
    for parts in (1, 5):
        rows = _named(table.repartition(parts), ["block"], "names").collect()
        names.append({bytes(r["block"]): r["name"] for r in rows})
    assert names[0] == names[1] and sorted(names[0]) == values and sorted(names[0].values()) == list(range(len(values)))
    assert _named(table.limit(0), ["block"], "names").count() == 0


@pytest.mark.parametrize("most_repeated", [1 << 20, 0])
def test_exact_copies_without_ids_and_repeated(spark, most_repeated):
    rows = [(None, "A"), (None, "a"), (3, "a"), (3, "a"), (7, None), (None, ""), (None, "alone"), (8, "B"), (9, "b")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, size int")
    found = sorted(((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"], r["kept"]) for r in exact_dedup(table, most_repeated=most_repeated).collect()))
    assert found == [(-1, -1, 1, True), (-1, 3, 4, False), (-1, 3, 4, False), (-1, 7, 2, False), (3, 3, 4, True), (3, 3, 4, True), (7, 7, 2, True), (8, 9, 2, False), (9, 9, 2, True)]


def simhash(text: str | None) -> int:
    words = [w for w in "".join(" " if c in "\x20\t\n\x0b\x0c\r" else c for c in (text or "").translate(UPPER)).split(" ") if w]
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    if not shingles:
        return 0
    ones = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        ones.update(k for k in range(64) if h >> k & 1)
    return sum(1 << k for k, n in ones.items() if 2 * n > len(shingles))


def test_near_copies(spark, tables):
    odd = [None, "", " \n", "one", "one two three four", "ONE two three four", "a b c d e f", "  x y z w v", "longer " * 3000]
    documents = [(1000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    rows = [(k, t) for k, t in enumerate(odd)] + documents
    prints = {d: simhash(t) for d, t in rows}
    ids = sorted(prints)
    value = np.array([prints[d] for d in ids], dtype=np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(value[:, None] ^ value[None, :]) <= 4, 1))
    expected = components(ids, [(ids[a], ids[b]) for a, b in near.tolist()])
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", table_literal()).repartition(4)
    found = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash_groups(table).collect()}
    assert found == {d: (prints[d], expected[d]) for d in ids}
    assert simhash_groups(table.limit(0)).count() == 0


def table_literal():
    from pyspark.sql import functions as F

    return F.lit("clash")


@pytest.mark.parametrize(("count", "block"), [(6, 512), (6, 8), (7, 16), (8, 512), (9, 512)])
def test_near_fingerprints_at_every_number_of_parts(spark, count, block):
    """Planted groups at every distance up to five bits, against all pairs."""
    rng = np.random.default_rng(count * block)
    centres = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    values = {int(c) for c in centres}
    for k, c in enumerate(centres.tolist()):
        for _ in range(3 if k else 60):
            values.add(c ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False)))
    fps = np.array(sorted(values), dtype=np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4, 1))
    expected = components(fps.tolist(), fps[near].tolist())
    table = with_distances(spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")).repartition(4)
    pairs = [(r["src"] & (1 << 64) - 1, r["dst"] & (1 << 64) - 1) for r in candidate_lists(table, count, block).mapInArrow(_linked, "src long, dst long").collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
    assert components(fps.tolist(), pairs) == expected


def test_parts_grow_with_the_corpus():
    assert [parts_for(n) for n in (0, 4_000_000, 5_000_000, 10**9, 10**11)] == [6, 6, 7, 8, 9]
    assert all(sum(w for _, w in parts(m)) == 64 for m in range(6, 12))


def test_near_copies_without_ids_and_repeated(spark):
    text = "one two three four five six seven"
    rows = [(None, text), (None, "quite another text with other words in it"), (3, text), (3, text), (5, None), (None, "")]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, least long, far0 int")
    found = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in simhash_groups(table).collect())
    assert found == [(-1, -1), (-1, 3), (-1, 5), (3, 3), (3, 3), (5, 5)]


def test_near_copies_query(spark, tables):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    for r in queries.op7_simhash_neardup(spark, tables).collect():
        assert r["fingerprint"] == f"{simhash(texts[r['doc_id']]):016x}"


def brute_force_links(rows, threshold=0.93):
    good = [(k, np.array(v, dtype=np.float64), g) for k, v, g in rows if g is not None and v and None not in v and np.isfinite(np.array(v, dtype=float)).all() and np.any(v)]
    links, n = [], Counter()
    unit = [v / np.linalg.norm(v) for _, v, _ in good]
    for a in range(len(good)):
        for b in range(a + 1, len(good)):
            if good[a][2] == good[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links.append((good[a][0], good[b][0]))
                n.update(links[-1])
    part = components([k for k, _, _ in rows], links)
    return sorted((k, n[k], part[k], part[k] == k) for k, _, _ in rows)


def test_embedding_links(spark, tables):
    rows = [tuple(r) for r in spark.read.parquet(f"{tables}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    found = queries.op5_embedding_neardup(spark, tables).select("vec_id", "n_links", "component_id", "kept")
    assert sorted(map(tuple, found.collect())) == brute_force_links(rows)


def test_embedding_links_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(7)
    centre = rng.standard_normal(8)
    rows = [(0, None, 1), (1, [0.0, 0.0], 1), (2, [nan, 1.0], 1), (3, [inf, 1.0], 1), (4, [1.0, None], 1), (5, [1.0, 0.0], None), (6, [], 1), (7, [1.0, 0.0], 1), (8, [2.0, 0.0], 1), (9, [1.0, 0.0], 2)]
    rows += [(20 + k, (centre + 0.12 * rng.standard_normal(8)).astype(np.float32).tolist(), 3) for k in range(120)]
    rows += [(200 + k, [1.0, 0.5, 0.25], 4) for k in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, embedding_links(table).select("vec_id", "n_links", "component_id", "kept").collect())) == brute_force_links(rows)
    assert embedding_links(table.limit(0)).count() == 0


@pytest.mark.parametrize("values", [1 << 21, 4000])
def test_embedding_links_between_tight_groups(spark, values):
    rng = np.random.default_rng(11)
    common = rng.standard_normal(64)
    rows = []
    for group in range(12):
        centre = common / np.linalg.norm(common) + 0.22 * rng.standard_normal(64) / 8
        rows += [(100 * group + k, (centre + 0.03 * rng.standard_normal(64) / 8).astype(np.float32).tolist(), 1) for k in range(12)]
    expected = brute_force_links(rows)
    assert {(n, part) for _, n, part, _ in expected} == {(len(rows) - 1, 0)}
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = embedding_links(table, values=values).select("vec_id", "n_links", "component_id", "kept")
    assert sorted(map(tuple, found.collect())) == expected


def test_embedding_links_of_few_pairs_in_a_large_label(spark, tmp_path):
    rng = np.random.default_rng(13)
    vectors = rng.standard_normal((60_000, 64))
    vectors[1:800:2] = vectors[0:800:2] + 0.37 * rng.standard_normal((400, 64))
    vectors = vectors.astype(np.float32)
    unit = vectors[:800].astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    expected = {(k, k + 1) for k in range(0, 800, 2) if unit[k] @ unit[k + 1] >= 0.93}
    assert len(expected) > 150
    columns = [pa.array(np.arange(len(vectors))), pa.array(list(vectors), pa.list_(pa.float32())), pa.array(np.ones(len(vectors), np.int32))]
    pq.write_table(pa.table(columns, names=["vec_id", "embedding", "label"]), tmp_path / "embeddings.parquet", row_group_size=8192)
    found = embedding_links(spark.read.parquet(str(tmp_path / "embeddings.parquet"))).filter("n_links > 0").collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in found} == {(k, 1, a) for a, b in expected for k in (a, b)}


def planted_pairs(number: int, sigma: float, seed: int):
    """Vectors of one label, the first two of each number linked or nearly so, and the links."""
    rng = np.random.default_rng(seed)
    vectors = rng.standard_normal((2 * number, 64))
    vectors[1::2] = vectors[0::2] + sigma * rng.standard_normal((number, 64))
    vectors = vectors.astype(np.float32)
    unit = vectors.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    return vectors, [(2 * k, 2 * k + 1) for k in np.flatnonzero((unit[0::2] * unit[1::2]).sum(axis=1) >= 0.93).tolist()]


def written(tmp_path, vectors):
    columns = [pa.array(np.arange(len(vectors))), pa.array(list(vectors), pa.list_(pa.float32())), pa.array(np.ones(len(vectors), np.int32))]
    pq.write_table(pa.table(columns, names=["vec_id", "embedding", "label"]), tmp_path / "embeddings.parquet", row_group_size=4096)
    return str(tmp_path / "embeddings.parquet")


def test_isolated_pairs_of_one_large_label(spark, tmp_path):
    """8,000 pairs near the threshold: lists lose some, the audit says so, and the label is compared in full."""
    vectors, links = planted_pairs(8_000, 0.37, 17)
    assert len(links) > 5_000
    rows = embedding_links(spark.read.parquet(written(tmp_path, vectors))).collect()
    assert {(r["vec_id"], r["component_id"]) for r in rows if r["n_links"]} == {(k, a) for a, b in links for k in (a, b)}
    assert all(r["n_links"] <= 1 for r in rows)
    (recall, again), *others = {(r["audit_recall"], r["compared_all"]) for r in rows}
    assert not others and 0.9 < recall <= 1 and again == (recall < 1)


def test_a_label_that_passes_its_audit(spark, tmp_path):
    """Groups of four, far apart: the graph alone has all links, so most vertices are never compared with the label."""
    rng = np.random.default_rng(19)
    centres = rng.standard_normal((1_000, 64))
    vectors = (np.repeat(centres, 4, axis=0) + 0.05 * rng.standard_normal((4_000, 64))).astype(np.float32)
    rows = embedding_links(spark.read.parquet(written(tmp_path, vectors)), sample=200).collect()
    assert {(r["n_links"], r["component_id"] - r["vec_id"] // 4 * 4, r["audit_recall"], r["compared_all"]) for r in rows} == {(3, 0, 1.0, False)}


def test_embedding_links_of_precise_vectors_and_repeated_rows(spark):
    """Components in double precision are not rounded; equal rows are vectors of their own; other columns may be named as the operator's own."""
    near = [1.0, 0.0, 1e-9]
    rows = [(1, [1.0, 0.0, 0.0], 1), (2, near, 1), (2, near, 1), (3, [0.0, 1.0, 0.0], 1), (None, near, 1)]
    table = spark.createDataFrame([(*r, 7, True) for r in rows], "vec_id long, embedding array<double>, label int, n int, hot boolean")
    found = sorted(((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in embedding_links(table).collect()))
    assert found == [(-1, 3, 1, False), (1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 0, 3, True)]


def test_lookup_of_few_and_many_keys(spark):
    rows = spark.range(1000).selectExpr("if(id % 3 = 0, 0, id) AS key", "id")
    table = rows.select("key").distinct().filter("key % 2 = 0").selectExpr("key", "key * 2 AS twice")
    for how, number in (("inner", 334 + 333), ("left", 1000)):
        few, many = (sorted(map(tuple, looked_up(rows, table, "key", "id", how, most).select("key", "id", "twice").collect()), key=str) for most in (10_000, 3))
        assert few == many and len(few) == number


def test_join_with_hot_keys_and_without(spark):
    for share in (3, 10**9):  # a third of all rows has key 0, or none more than another
        rows = spark.range(6000).selectExpr(f"if(id % {share} = 0, 0, id) AS key", "id").union(spark.sql("SELECT CAST(NULL AS long), -1L"))
        table = rows.filter("key is not null").groupBy("key").count().withColumnRenamed("count", "n").withColumn("twice", F.col("key") * 2)
        found = joined(rows, table, ["key"])
        assert sorted((r["key"], r["id"], r["twice"]) for r in found.collect()) == sorted((r["key"], r["id"], 2 * r["key"]) for r in rows.filter("key is not null").collect())
        assert ("Union" in found._jdf.queryExecution().optimizedPlan().toString()) == (share == 3)
    assert joined(rows.limit(0), table.limit(0), ["key"]).count() == 0


def test_components_of_hubs_and_chains(spark):
    links = [(0, k) for k in range(1, 2500)] + [(k, k + 1) for k in range(3000, 3040)] + [(2499, 5000), (6000, 6000), (7001, 7000)]
    found = connected_components(spark.createDataFrame([*links, (None, 1)], "src long, dst long").repartition(4))
    expected = components({n for pair in links[:-2] + links[-1:] for n in pair}, links[:-2] + links[-1:])
    assert {r["node"]: r["root"] for r in found.collect()} == expected


@pytest.mark.parametrize(("groups", "size"), [(60, 20), (12, 100)])
def test_embedding_links_of_groups_come_from_the_graph(spark, tmp_path, groups, size):
    """Groups larger than a list and isolated pairs: the closed components have all links, so the label isn't compared in full."""
    rng = np.random.default_rng(groups)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    vectors = unit(rng.normal(size=(4000, 64)))
    for g in range(groups):
        centre = unit(rng.normal(size=64))
        around = rng.normal(size=(size, 64))
        around = unit(around - (around @ centre)[:, None] * centre)
        vectors[g * size : (g + 1) * size] = np.sqrt(0.975) * centre + np.sqrt(0.025) * around
    for k in range(3000, 3100, 2):
        vectors[k + 1] = unit(vectors[k] + 0.3 * unit(rng.normal(size=64)))
    vectors = vectors[rng.permutation(4000)].astype(np.float32)
    exact = unit(vectors.astype(np.float64))
    close = exact @ exact.T >= 0.93
    np.fill_diagonal(close, False)
    roots = components(range(4000), np.argwhere(close).tolist())
    rows = embedding_links(spark.read.parquet(written(tmp_path, vectors)), sample=400).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in rows} == {(k, int(n), roots[k]) for k, n in enumerate(close.sum(axis=1))}
    assert {(r["audit_recall"], r["compared_all"]) for r in rows} == {(1.0, False)}
