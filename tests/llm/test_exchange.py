import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from placeloom.llm import exchange as ex
from placeloom.llm.common import mix


def total():
    class Total:
        def merge(self, k, columns, at, n):
            return [np.bincount(at, c, n).astype(np.int64) for c in columns]

        def finish(self, k, merged):
            return [merged[0], merged[0] > 1]

        def count(self, merged):
            return len(merged[0])

    return Total()


@pytest.mark.parametrize(("bits", "group"), [(8, 512), (2, 3), (1, 2)])
def test_sums_come_back_to_every_child(spark, bits, group):
    r = random.Random(bits)
    children = {f"c{i}": sorted(mix(np.array(sorted({r.randrange(60) for _ in range(r.randrange(1, 30))}), np.uint64)).tolist()) for i in range(14)}
    rows = [(c, [str(h) for h in hs]) for c, hs in children.items()]

    groups = ex.groups_of(14, group)

    def ask(batches):
        from placeloom.llm.exchange import split

        for pdf in batches:
            for c, hs in zip(pdf["c"], pdf["hs"], strict=True):
                h = np.array([int(x) for x in hs], np.uint64)
                yield from split(c, [[h, np.arange(1, len(h) + 1)]], groups, bits=bits)

    asked = spark.createDataFrame(rows, "c string, hs array<string>").repartition(3).mapInPandas(ask, ex.ASK_DDL)
    answers, n = ex.exchange(asked, 14, total(), bits, group)
    want = Counter()
    for hs in children.values():
        for i, h in enumerate(hs):
            want[h] += i + 1
    assert n == len(want)
    got = answers.toPandas()
    for c, hs in children.items():
        [[sums, many]] = ex.gathered(got[got["child"] == c])
        assert sums.tolist() == [want[h] for h in hs] and many.tolist() == [want[h] > 1 for h in hs]
    assert not ex.gathered(pd.DataFrame({"bucket": [], "answer": []}))
