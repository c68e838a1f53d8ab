"""Vector codes, against exhaustive search in whole numbers, and against SQL."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from uvsieve.llm import vectorcodes
from uvsieve.llm.queries import ORACLE_SQL, QUERIES
from uvsieve.llm.vectorcodes import Codebooks, compress, expand, with_label_error

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error double, vector string, bounds string"


def exhaustive(rows, parts, entries, rounds):
    """rows: (vec_id, whole numbers). Codes, errors and codebooks, by Python's own numbers."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(rows[0][1]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, v in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p])) for p, x in enumerate(c)] for c in cut]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, f in zip(cut, found, strict=True) if f[p][1] == e]
                if own:
                    books[p][e] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    found = assign()
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for (i, _), f in zip(rows, found, strict=True)], digest


def run(spark, rows, **options):
    coded, books = compress(spark.createDataFrame(rows, SCHEMA), **options)
    got = with_label_error(coded).collect()
    return got, books


def floors(v):
    return [math.floor(1024 * float(np.float32(x))) for x in v]


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_rows_against_exhaustive_search(spark, seed):
    draw = random.Random(seed)
    vectors = [[draw.gauss(c, 0.05) for _ in range(12)] for c in [draw.uniform(-1, 1) for _ in range(40)] for _ in range(8)]
    vectors += [[0.25] * 12] * 5 + [[-0.0005 * k] * 12 for k in range(5)]
    rows = [(draw.choice([k, k, k, None, 5]), v, draw.choice([None, 1, 1, 2])) for k, v in enumerate(vectors)]
    bad = [(1000, None, 1), (1001, [0.1] * 11 + [None], 1), (1002, [0.1] * 11 + [math.nan], 1), (1003, [0.1] * 11 + [math.inf], 1), (1004, [], 1), (1005, [0.1] * 8, 1), (1006, [0.1] * 10, 1)]
    got, books = run(spark, [(*r, "a", 0.5, "b", "c") for r in rows + bad], parts=4, entries=16, rounds=4)
    want, digest = exhaustive([(i, floors(v)) for i, v, _ in rows], 4, 16, 4)
    assert sorted(repr((r["vec_id"], bytes(r["code"]).hex(), r["error"])) for r in got) == sorted(map(repr, want)) and books.digest() == digest
    sums = {}
    for r in got:
        sums[r["label"]] = sums.get(r["label"], 0) + r["error"]
    assert all(sums[r["label"]] == r["label_error"] for r in got) and None in sums


def test_numbers_far_out(spark):
    draw = random.Random(3)
    rows = [(k, [draw.uniform(-1, 1) * 10.0 ** draw.randint(0, 9) for _ in range(8)], k % 2, "a", 0.5, "b", "c") for k in range(40)]
    rows.append((100, [1e30, -1e30] * 4, 1, "a", 0.5, "b", "c"))
    got, books = run(spark, rows, parts=4, entries=8, rounds=2)
    longest = lambda x: max(-(2**63), min(2**63 - 1, x))
    want, digest = exhaustive([(r[0], [longest(x) for x in floors(r[1])]) for r in rows], 4, 8, 2)
    assert books.digest() == digest
    assert sorted((r["vec_id"], bytes(r["code"]).hex(), r["error"] or 0) for r in got) == [(i, c, e if e < 2**63 else 0) for i, c, e in want]


def test_few_rows_and_none(spark):
    got, books = run(spark, [(2, [0.5, 1.0, 0.0, 0.0], 1, "a", 0.5, "b", "c"), (2, [0.5, 1.0, 0.0, 0.0], 1, "a", 0.5, "b", "c"), (1, [1.0, 1.0, 1.0, -1.0], None, "a", 0.5, "b", "c")])
    assert sorted(bytes(r["code"]).hex() for r in got) == ["00000000", "01000101", "01000101"] and all(r["error"] == r["label_error"] == 0 for r in got)
    coded, books = compress(spark.createDataFrame([], SCHEMA))
    assert books is None and with_label_error(coded).count() == 0
    coded, books = compress(spark.createDataFrame([(1, [0.5, 0.25, 1.0, -1.0], 1, "a", 0.5, "b", "c")], SCHEMA))
    back = expand(coded, books).first()["embedding"]
    assert max(abs(a - b) for a, b in zip(back, [0.5, 0.25, 1.0, -1.0], strict=True)) < 1 / 1024


def test_bounds_save_scans_and_change_nothing():
    """Rounds with bounds give the same codes as scans of everything; net displacements save more than sums of steps."""
    draw = np.random.default_rng(5)
    centres = draw.normal(0, 300, (64, 4, 8))
    x = np.floor(centres[draw.integers(0, 64, 3000)] + draw.normal(0, 30, (3000, 4, 8))).astype(np.int64)
    books = Codebooks([x[:64].transpose(1, 0, 2).copy()], groups=8)
    state = (np.zeros((3000, 4), np.uint8), np.full((3000, 4, 8), -np.inf, np.float32), np.zeros((3000, 4, 8), np.uint8))
    counts = []
    for _ in range(6):
        books.scanned = 0
        errors = books.prepare().assign(x, *state)
        counts.append(books.scanned)
        fresh = (np.zeros((3000, 4), np.uint8), np.full((3000, 4, 8), -np.inf, np.float32), np.zeros((3000, 4, 8), np.uint8))
        assert Codebooks(books.history, groups=8).prepare().assign(x, *fresh) == errors and (fresh[0] == state[0]).all()
        new = books.last.copy()
        for p in range(4):
            for e in range(64):
                own = x[state[0][:, p] == e, p]
                if len(own):
                    new[p, e] = own.sum(0) // len(own)
        books.history.append(new)
    assert counts[0] == 3000 * 4 * 64 and counts[-1] < counts[0] / 4
    net = books.prepare().moved  # from each round until now
    steps = [np.maximum.reduceat(vectorcodes._norms(b - a), range(0, 64, 8), axis=1) for a, b in zip(books.history[:-1], books.history[1:], strict=True)]
    drifts = np.array([np.sum(steps[k:], axis=0) if k < len(steps) else np.zeros((4, 8)) for k in range(len(books.history))])
    assert (net <= drifts + 1e-6).all() and net[0].sum() < 0.95 * drifts[0].sum()


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, size):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/{size}/embeddings.parquet'")
    want = con.sql(ORACLE_SQL["op11_vector_codes"])
    got = QUERIES["op11_vector_codes"](spark, f"/root/testdata/{size}")
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
