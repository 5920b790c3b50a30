"""What travels to a task: functions by reference, never the caches of the driver."""

import numpy as np
import pytest
from pyspark import cloudpickle

from tidemark.llm import near_dedup, substring_dedup, suffix_dedup

LARGEST = 100_000


class Recorder:
    """Stands for a DataFrame and keeps the functions given to it."""

    def __init__(self):
        self.functions = []

    def mapInArrow(self, function, schema):  # noqa: N802
        self.functions.append(function)
        return self

    def __getattr__(self, name):
        return lambda *args, **kwargs: self


@pytest.fixture(scope="module")
def used_on_the_driver():
    found = near_dedup.shingle_set(" ".join(f"word{i}" for i in range(5000)))
    for seed in range(3):
        near_dedup.signature(found, seed=seed)
    substring_dedup.word_hashes([b"w%d" % i for i in range(5000)])
    suffix_dedup._powers()
    assert len(found) and np.all(found[:-1] < found[1:])


@pytest.mark.parametrize("build", [near_dedup.sketches, near_dedup.shingle_sets])
def test_task_functions_stay_small(used_on_the_driver, build):
    rows = Recorder()
    build(rows)
    assert rows.functions
    assert all(len(cloudpickle.dumps(f)) < LARGEST for f in rows.functions)


@pytest.mark.parametrize(
    "function", [near_dedup.signature, near_dedup.shingle_set, substring_dedup.word_hashes, suffix_dedup._powers]
)
def test_module_functions_go_by_reference(used_on_the_driver, function):
    assert len(cloudpickle.dumps(function)) < 1000
