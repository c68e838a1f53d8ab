"""What the steps of scoring hold at once: so much for each token of a block, and nothing of the block or shard before."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import zstandard

from uvsieve.llm import lmscore

TOKENS = 300_000
SHARDS = 3


@pytest.fixture(scope="module")
def blocks():
    rng = np.random.default_rng(5)
    words = np.array([f"w{k}" for k in range(50_000)])
    texts = [[" ".join(words[np.minimum(rng.zipf(1.3, TOKENS // 100), 50_000) - 1]) for _ in range(100)] for _ in range(4)]
    rows = [(k, 100 * k + i, t) for k, block in enumerate(texts) for i, t in enumerate(block)]
    packed = [zstandard.compress(t.encode()) for _, _, t in rows]
    return pa.table({"block": pa.array([k for k, _, _ in rows], pa.int32()), "doc_id": [i for _, i, _ in rows], "training": [i % 5 != 1 for _, i, _ in rows], "packed": packed})


@pytest.fixture(scope="module")
def asked(blocks):
    return pa.Table.from_batches(lmscore._asking(SHARDS, {})(iter(blocks.to_batches()))).sort_by("shard")


@pytest.fixture(scope="module")
def answers(asked):
    asked = asked.append_column("survey", pa.array(["0:1000,1:100"] * asked.num_rows))
    return asked, pa.Table.from_batches(lmscore._answering({})(iter(asked.combine_chunks().to_batches())))


def of(table, column, *values):
    """The table's batches where the column has one of the values."""
    return iter(table.filter(pc.is_in(table[column], pa.array(values, pa.int32()))).combine_chunks().to_batches())


def peak(work):
    """Bytes that ``work`` held at once, its results dropped as they come."""
    tracemalloc.start()
    for _ in work():
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most


def test_a_block_asks_in_little_memory_for_each_token(blocks, asked):  # asked: so that tables kept for good are there
    assert peak(lambda: lmscore._asking(SHARDS, {})(of(blocks, "block", 0))) < 135 * TOKENS


def test_blocks_of_a_task_are_not_held_together(blocks, asked):
    one, four = (peak(lambda v=v: lmscore._asking(SHARDS, {})(of(blocks, "block", *v))) for v in ([0], [0, 1, 2, 3]))
    assert four < 1.3 * one


def test_shards_of_a_task_are_not_held_together(answers):
    for work in (lmscore._surveying({}), lmscore._answering({})):
        each = max(peak(lambda k=k, w=work: w(of(answers[0], "shard", k))) for k in range(SHARDS))
        assert peak(lambda w=work: w(of(answers[0], "shard", *range(SHARDS)))) < 1.1 * each


def test_a_shard_is_added_up_in_little_memory_for_each_question(answers):
    asked = next(of(answers[0], "shard", 0))
    messages = asked.column("packed").to_pylist()
    questions = lmscore.Told(messages, {}).ends[-1].sum()
    assert peak(lambda: [lmscore.Told(messages, {})]) < 60 * questions


def test_a_block_is_scored_in_little_memory_for_each_token(blocks, answers):
    own, told = (pa.Table.from_batches(of(x, "block", 0)) for x in (blocks, answers[1]))
    told = told.append_column("survey", pa.array(["0:1000,1:100"] * told.num_rows))
    assert peak(lambda: [lmscore._scoring({})(own, told)]) < 135 * TOKENS
