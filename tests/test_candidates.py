import numpy as np
import pytest

import __spark_entry__
from voxmill.operators.candidates import chunk_candidates

NONE = np.empty((0, 2))


def clips(rows, others=NONE, gap=0.3, least=1.0, most=10.0, overlap=0.1):
    return chunk_candidates([(s, e, 0.9 - i / 10) for i, (s, e) in enumerate(rows)], np.array(others, float).reshape(-1, 2), overlap, gap, least, most)


def test_merge_gap_foreign_speech_and_split():
    assert clips([(0, 2), (2.1, 4)]) == [(0, 4, 0.8)]
    assert clips([(0, 2), (2.2, 4)], [(2.02, 2.18)]) == [(0, 2, 0.9), (2.2, 4, 0.8)]
    assert clips([(0, 2), (2.4, 4)]) == [(0, 2, 0.9), (2.4, 4, 0.8)]
    assert clips([(0, 20.5)]) == [(0, 10, 0.9), (10, 20, 0.9)]
    assert clips([(0, 2), (3, 5)], [(0.5, 1), (0.5, 1)], overlap=0.9) == [(3, 5, 0.8)]
    assert clips([]) == []


def test_entry_gives_the_clips_of_the_whole_chain(spark):
    assert __spark_entry__.entry(spark).count() == 209


@pytest.mark.parametrize("sf, n", [("sf0.01", 1503), ("sf0.1", 2335)])
def test_candidates_at_other_scales(spark, sf, n):
    assert __spark_entry__.queries()["candidates"](spark, f"/root/testdata/{sf}").count() == n
