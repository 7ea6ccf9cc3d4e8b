"""Tables that are made anew round by round."""

import os

from emberframe.operators.settle import Generations


def test_only_the_last_generation_stays(spark):
    rounds = Generations(spark)
    table = rounds.put(spark.range(10))
    first = rounds.folder
    for _ in range(3):
        table = rounds.put(table.selectExpr("id + 1 as id"))
    assert sorted(r.id for r in table.collect()) == list(range(3, 13))
    assert not os.path.exists(first) and os.path.exists(rounds.folder)
