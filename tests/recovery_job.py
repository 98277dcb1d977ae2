"""Run by test_recovery.py in its own process (a session whose tasks may be retried)."""

import json
import sys

sys.path.insert(0, sys.argv[1])

from pyspark import TaskContext  # noqa: E402

from lendflow.operators import knn as K  # noqa: E402
from lendflow.operators import inverted as L  # noqa: E402
from lendflow.plans.queries import queries  # noqa: E402
from lendflow.session import build_session, checkpoint_dir  # noqa: E402

sf = sys.argv[2]
spark = build_session("local[4,3]", shuffle_partitions=4)   # up to 3 attempts per task
checkpoint_dir(spark)
names = ["knn_exact", "retrieve_lexical", "citations"]
clean = {n: sorted(map(tuple, queries()[n](spark, sf).collect())) for n in names}


def failing(make):
    def wrapper(*a, **kw):
        inner = make(*a, **kw)

        def fn(left, right):
            if TaskContext.get().attemptNumber() == 0:
                raise RuntimeError("injected loss of the task's executor")
            return inner(left, right)
        return fn
    return wrapper


K._kernel = failing(K._kernel)
L._search = failing(L._search)
faulty = {n: sorted(map(tuple, queries()[n](spark, sf).collect())) for n in names}
print(json.dumps({n: [len(clean[n]), clean[n] == faulty[n]] for n in names}))
