"""Values sent to workers hold no class of this package: workers have no copy of it."""

import numpy as np

from quillstream.llm import decontaminate, language, neighbours, toxicity
from quillstream.llm.common import received, send


def test_sent_values_name_no_module_of_the_package(spark):
    a = np.arange(4.0)
    values = [toxicity.Model(a.astype(np.uint64), a, a), language.Model(["en"], a, a, a, a), decontaminate.Phrases([("k", [1, 2, 3])]),
              neighbours.Index(a, a, 2, a, a)]
    for value in values:
        shared = send(spark, value)
        with open(shared._path, "rb") as f:
            assert b"quillstream" not in f.read()
        back = received(type(value), shared)
        assert type(back) is type(value) and set(vars(back)) == set(vars(value))
    assert received(language.Model, send(spark, None)) is None
