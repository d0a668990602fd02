"""Benchmark passages, collocations and whitening against SQL and plain restatements."""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

from lodestone.llm import queries
from lodestone.llm.collocations import Slots, _frequent, collocations, shuffled_collocations
from lodestone.llm.common import tree_sum
from lodestone.llm.decontamination import contaminated
from lodestone.llm.whitening import _squares, whitened

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_decontamination", "op12_collocations"])
def test_same_rows_as_sql(spark, tables, name):
    con = duckdb.connect()
    for path in Path(tables).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    said = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in said.description]
    found = queries.QUERIES[name](spark, tables)
    assert sorted(map(str, found.select(columns).toPandas().itertuples(index=False, name=None))) == sorted(map(str, said.fetchall()))


def words_of(text):
    return [(m[0].translate(UPPER), *m.span()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))]


def brute_hits(documents, items, window=10):
    out = []
    for doc_id, text in documents:
        words = words_of(text)
        hit, named = set(), set()
        for item_id, item in items:
            wanted = [w for w, _, _ in words_of(item)]
            for win in {tuple(wanted[k : k + window]) for k in range(max(1, len(wanted) - window + 1))} - {()}:
                for k in range(len(words) - len(win) + 1):
                    if tuple(w for w, _, _ in words[k : k + len(win)]) == win:
                        hit.update(range(k, k + len(win)))
                        named |= {str(item_id)} - {"None"}
        runs = [k for k in sorted(hit) if k - 1 not in hit], [k for k in sorted(hit) if k + 1 not in hit]
        spans = [(words[a][1], words[b][2]) for a, b in zip(*runs, strict=True)]
        out.append((doc_id if doc_id is not None else -1, len(words), len(hit), sorted(named), spans))
    return sorted(out)


@pytest.mark.parametrize("block", [7, 200_000])
def test_passages_of_test_items(spark, tables, block):
    ten, long = "a b c d e f g h i j", " ".join(f"w{k}" for k in range(14))
    items = [(1, ten), (2, long), (3, "Short ITEM"), (4, None), (5, ""), (6, "..."), (None, "nameless one here"), (7, ten + " k"), (7, "été señor"), (10, "short item")]
    texts = [
        None, "", "!?", "A, b. C d\n(e) f-g h i J", "x " + ten + " k " + ten, long, "w0 " + long[: len(long) - 8], "short, item short", "SHORT item", "the nameless one here",
        "ÉTÉ señor été SEÑOR été, señor!", "\x00short\x7fitem" + " x" * 30_000, ten[:-2], "a a b c d e f g h i j j", "日本 short 日本 item", "日本 — short — item 🙂 b",
    ]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, texts[7])]
    table = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, items int").repartition(3)
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, runs string")
    found = contaminated(table, bench, block=block).collect()
    said = sorted(((r[0] if r[0] is not None else -1), r["n_words"], r["n_hit"], r["items"], [tuple(s) for s in r["spans"]]) for r in found)
    assert said == brute_hits(rows, items)
    none = contaminated(table, bench.limit(0)).collect()
    assert len(none) == len(rows) and not any(r["n_hit"] or r["items"] for r in none)
    assert contaminated(table.limit(0), bench).count() == 0


def brute_phrases(documents, least, longest, first):
    counts, totals = Counter(), Counter()
    for lang, text in documents:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, *words[k : k + m]) for m in range(1, longest + 1) for k in range(len(words) - m + 1))
    often = {p: a for p, a in counts.items() if a >= least}
    inside = {(p[0], *p[s : s + m]) for p, a in often.items() for m in range(1, len(p) - 1) for s in range(1, len(p) - m + 1) if 100 * a >= 100 * often[(p[0], *p[s : s + m])]}
    scored = {}
    for p, a in often.items():
        if len(p) > 2 and p not in inside:
            cuts = [(1000 * a * totals[p[0]] // (often[p[: k + 1]] * often[(p[0], *p[k + 1 :])]), k, often[p[: k + 1]], often[(p[0], *p[k + 1 :])]) for k in range(1, len(p) - 1)]
            score, _, left, right = min(cuts)
            scored.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), left, right))
    return sorted(
        (lang, k + 1, phrase.decode(), -a, left, right, totals[lang], -score) for lang, rows in scored.items() for k, (score, a, phrase, left, right) in enumerate(sorted(rows)[:first])
    )


def test_phrases(spark):
    rng = np.random.default_rng(5)
    vocabulary = ["The", "of", "House", "new", "york", "été", "日本", "a\x00b", "x" * 40, "-", "and"]
    drawn = lambda n: " ".join(rng.choice(vocabulary, n, p=rng.permutation([0.3, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05, 0.04, 0.03, 0.02, 0.01])))
    ends = [". ", ", ", "\t", "\r\n", "; ", "?", " "]
    rows = [(["en", "fr", None, "und"][k % 4], "".join(drawn(int(rng.integers(0, 30))) + ends[int(rng.integers(7))] for _ in range(4))) for k in range(80)]
    rows += [("en", "new york new york new york city"), ("en", None), ("fr", ""), ("de", ". , \t"), ("xx", "one of them" * 3)] + [("en", "only here as one phrase.")] * 9 + [("en", drawn(20_000))]
    table = spark.createDataFrame([(*r, 1) for r in rows], "lang string, text string, key int").repartition(5)
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    for least, longest, first in ((4, 5, 40), (9, 3, 2000), (10**6, 5, 10)):
        expected = brute_phrases(rows, least, longest, first)
        assert sorted(map(tuple, collocations(table, least, longest, first).select(columns).collect())) == expected
        assert sorted(map(tuple, shuffled_collocations(table, least, longest, first).select(columns).collect())) == expected
    assert sorted(map(tuple, collocations(table, 4, 5, 40, most=20).select(columns).collect())) == brute_phrases(rows, 4, 5, 40)
    assert collocations(table.limit(0)).count() == 0


def test_rare_phrases_do_not_count_as_frequent_ones(spark, monkeypatch):
    """More different phrases of frequent words than a task may hold frequent ones, and few of them frequent: nothing goes by the plain shuffle."""
    rng = np.random.default_rng(6)
    rows = [("en", " ".join(f"w{k}" for k in rng.integers(0, 150, 300)) + " one two three four") for _ in range(200)]
    table = spark.createDataFrame(rows, "lang string, text string").repartition(3)

    def shuffled(*_):
        raise AssertionError("phrases were counted by the plain shuffle")

    monkeypatch.setattr("lodestone.llm.collocations.shuffled_collocations", shuffled)
    found = collocations(table, 20, 4, 40, most=1000).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(map(tuple, found.collect())) == brute_phrases(rows, 20, 4, 40)


def test_phrases_pass_the_driver_in_parts_and_are_looked_up_in_rounds(spark, monkeypatch):
    """More frequent pairs than a task holds at once: the texts are gone through again, and no hash is made on the driver or handed on whole."""
    rng = np.random.default_rng(8)
    rows = [("en", " ".join(f"w{k}" for k in rng.integers(0, 25, 400)) + " one two three four.") for _ in range(60)]
    table = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    handed = []

    def broadcast(value, put=spark.sparkContext.broadcast):
        handed.append(len(value.keys))
        return put(value)

    def refused(*_):
        raise AssertionError("a hash was made on the driver, or phrases were counted by the plain shuffle")

    monkeypatch.setattr(spark.sparkContext, "broadcast", broadcast)
    monkeypatch.setattr("lodestone.llm.collocations.Slots.__init__", refused)
    monkeypatch.setattr("lodestone.llm.collocations.shuffled_collocations", refused)
    found = collocations(table, 25, 4, 900, most=100, part=40).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    expected = brute_phrases(rows, 25, 4, 900)
    assert sum(len(r[2].split(" ")) == 2 for r in expected) > 300
    assert sorted(map(tuple, found.collect())) == expected
    assert len(handed) > 12 and max(handed) <= 60


@pytest.mark.parametrize("held", [1, 50, 1 << 21])
def test_phrases_are_added_up_over_what_tasks_send(spark, held):
    rng = np.random.default_rng(7)
    lists = [[*rng.integers(-1, 12, 40).tolist(), -1] for _ in range(2000)]
    table = spark.createDataFrame([(x,) for x in lists], "words array<int>").repartition(3)
    counts = Counter(x[k] << 32 | x[k + 1] for x in lists for k in range(40) if x[k] >= 0 and x[k + 1] >= 0)
    pairs = [(np.frombuffer(r["keys"], np.int64), np.frombuffer(r["counts"], np.int64)) for r in _frequent(table, 2, 450, 5, held).collect()]
    assert sorted((int(k), int(n)) for keys, ns in pairs for k, n in zip(keys, ns, strict=True)) == sorted((k, n) for k, n in counts.items() if n >= 450)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_slots_are_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(-(1 << 63), 1 << 63, 2 * n, dtype=np.int64))[:n]
    slots = Slots(keys)
    assert sorted(slots.find(keys).tolist()) == list(range(len(keys))) and (slots.keys[slots.find(keys)] == keys).all()
    other = np.setdiff1d(rng.integers(-(1 << 63), 1 << 63, 1000, dtype=np.int64), keys)
    assert (slots.find(other) == -1).all()


def test_arrays_are_added_in_a_tree(spark):
    rng = np.random.default_rng(1)
    arrays = {(p, t): rng.integers(0, 90, 5) for p in range(70) for t in range(3) if (p + t) % 4}
    table = spark.createDataFrame([(p, t, bytearray(a.astype(np.int64).tobytes())) for (p, t), a in arrays.items()], "part int, tile int, numbers binary")
    for most in (None, 100):
        for row in tree_sum(table, "int64", most, fan=4).collect():
            total = sum(a for (_, t), a in arrays.items() if t == row["tile"])
            assert np.frombuffer(row["numbers"], np.int64).tolist() == (total if most is None else np.minimum(total, most)).tolist()


def plain_whitening(x):
    n, total = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = np.array([[n * a - s for a, s in zip(row, total, strict=True)] for row in x], dtype=object)
    centred = y.astype(float) / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    return values[order], centred @ directions[:, order] / np.sqrt(np.maximum(values[order], 1e-300)), [int(d) for d in (y * y).sum(axis=1)]


@pytest.mark.parametrize("size", [1, 5, 32, 70])
def test_whitening(spark, size):
    rng = np.random.default_rng(size)
    good = (rng.normal(size=(300, size)) * np.linspace(0.3, 3, size) + rng.normal(size=(300, 1))).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(good)] + [(None, good[0].tolist()), (4, good[4].tolist())]
    bad = [(900, None), (901, []), (902, [None] * size), (903, [float("nan")] * size), (904, [float("inf")] * size), (905, [0.5] * (size + 1))]
    table = spark.createDataFrame([(*r, 1) for r in rows + bad], "vec_id long, embedding array<float>, component int").repartition(7)
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows]
    values, plain, squares = plain_whitening(x)
    found = whitened(table).toPandas()
    k = min(32, size)
    assert len(found) == len(rows) * k and set(found["n"]) == {len(rows)} and found["identity_error"].nunique() == 1 and found["identity_error"][0] < 1e-9
    assert np.allclose(found.groupby("component")["explained"].first(), values[:k] / values.sum(), rtol=1e-9)
    wide = found[found["vec_id"].notna()].drop_duplicates(["vec_id", "component"]).pivot(index="vec_id", columns="component", values="whitened").loc[range(300)].to_numpy()
    signs = np.sign((wide * plain[:300, :k]).sum(axis=0))
    assert np.abs(wide * signs - plain[:300, :k]).max() < 1e-7
    assert found[found["component"] == 1].groupby("vec_id")["deviation"].first().loc[range(300)].map(int).tolist() == squares[:300]


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitened(spark.createDataFrame([(1, [2.0, 3.0]), (2, [2.0, 3.0])], schema)).count() == 0
    flat = whitened(spark.createDataFrame([(k, [float(k), 1.0]) for k in range(4)], schema)).toPandas()
    assert set(flat["component"]) == {1} and np.allclose(flat["explained"], 1)
    huge = whitened(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0])], schema)).toPandas()
    assert len(huge) and np.isfinite(huge["whitened"]).all()


def test_squares_are_exact_at_every_size():
    rng = np.random.default_rng(2)
    for scale, n in ((10, 5), (1 << 40, 3000), (1 << 53, 10**9)):
        x = rng.integers(-scale, scale, (20, 3))
        total = [int(s) + 7 for s in x.sum(axis=0)]
        exact = [sum((n * int(a) - s) ** 2 for a, s in zip(row, total, strict=True)) for row in x]
        assert [int(s) for s in _squares(x, n, np.array(total, dtype=object))[1]] == exact
