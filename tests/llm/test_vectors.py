"""Product codes against plain nearest entries, and the query against its SQL."""

import duckdb
import numpy as np
import pytest

from barloom.llm import queries, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def plain(rows, entries=64, rounds=2, parts=16):
    """(id, code, error, label) by comparing every part with every entry."""
    good = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(np.float32(x)) for x in r[1])]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = max(1, -(-max((len(r[1]) for r in good), default=0) // parts))
    v = np.zeros((len(good), parts * width), np.int64)
    for i, r in enumerate(good):
        v[i, : len(r[1])] = np.floor(np.float64(np.array(r[1], np.float32)) * 256)
    v = v.reshape(len(good), parts, width)
    books = v[:entries].copy()

    def near():
        d = ((v[:, None] - books[None]) ** 2).sum(axis=3)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        at, _ = near()
        new = books.copy()
        for p in range(parts):
            for e in set(at[:, p].tolist()):
                new[e, p] = v[at[:, p] == e, p].sum(axis=0) // (at[:, p] == e).sum()
        books = new
    at, d = near()
    return sorted(((r[0], "".join(f"{e:02x}" for e in a), int(x.sum()), r[2]) for r, a, x in zip(good, at, d)), key=str), books.transpose(1, 0, 2)


@pytest.mark.parametrize("n", [0, 1, 5, 300])
def test_codes_equal_plain_search(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i * 3 % 101, [float(x) for x in np.round(rng.normal(0, 0.2, 32), 2 if i % 2 else 7)], int(rng.integers(0, 3)) if i % 5 else None, "x") for i in range(n)]
    if n > 4:
        rows += [(900, None, 1, ""), (901, [], 1, ""), (902, [0.5] * 31 + [None], 1, ""), (903, [0.5] * 31 + [float("nan")], 1, ""), (904, [float("inf")] * 32, 1, ""), (905, [0.25] * 20, 1, ""), (None, [-0.0] * 32, 2, "")]
        rows += rows[:4]  # repeated rows
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = vectors.compress(df).collect()
    if n == 0:
        assert got == []
        return
    rows = [(i, None if v is None else [None if x is None else np.float32(x) for x in v], label, c) for i, v, label, c in rows]
    want, books = plain(rows)
    assert sorted(((r.vec_id, r.code, r.error, r.label) for r in got), key=str) == want
    totals = {}
    for _, _, e, label in want:
        totals[label] = totals.get(label, 0) + e
    assert all(r.label_error == totals[r.label] for r in got)
    assert {r.codebooks_sha256 for r in got} == {vectors.digest(books)}


def test_candidates_hold_the_nearest_entry_and_few_more():
    rng = np.random.default_rng(1)
    entries, q = rng.integers(-100, 100, (64, 4)), rng.integers(-150, 150, (2000, 4))
    cells = vectors.Cells(entries)
    d = ((q[:, None] - entries) ** 2).sum(axis=2)
    could = cells.candidates(q)
    assert could[np.arange(len(q)), d.argmin(axis=1)].all()
    assert could.mean() < 0.25  # most entries are never compared
    index, dist = cells.nearest(q)
    assert (index == d.argmin(axis=1)).all() and (dist == d.min(axis=1)).all()


def test_many_labels_are_salted(spark, monkeypatch):
    rows = spark.createDataFrame([(i, i % 7 if i % 7 else None, "0", i) for i in range(200)], "vec_id long, label int, code string, error long")
    want = sorted(map(tuple, vectors.with_label_error(rows).collect()), key=str)
    monkeypatch.setattr(vectors, "FEW_LABELS", 2)
    assert sorted(map(tuple, vectors.with_label_error(rows).collect()), key=str) == want and len(want) == 200


def test_query_equals_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    cur = c.execute(queries.SQL["op11_vector_codes"])
    names = [d[0] for d in cur.description]
    got = queries.op11_vector_codes(spark, sf)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(cur.fetchall())
