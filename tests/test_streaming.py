import json
import tempfile

from docs_helper import docs_frame
from folio.plans import index as IX
from folio.streaming.requests_stream import answer_stream


def test_stream_of_requests(spark):
    d = docs_frame(spark, [(1, "p", "module", "Alpha.Beta", "alpha gamma"), (2, "p", "function", "X.gamma/1", "beta")])
    base = tempfile.mkdtemp(prefix="folio-stream-test-")
    IX.build_search_index(d, f"{base}/index")
    reqs = f"{base}/requests"
    import os
    os.makedirs(reqs)
    with open(f"{reqs}/r1.json", "w") as f:
        for r in [{"request_id": 1, "q": "gamma", "packages": "p"}, {"request_id": 2, "q": "-gamma", "packages": "p"}]:
            f.write(json.dumps(r) + "\n")
    q = answer_stream(spark, reqs, f"{base}/index", f"{base}/out", f"{base}/ckpt")
    q.awaitTermination(120)
    out = spark.read.parquet(f"{base}/out")
    got = sorted((r.request_id, r.id) for r in out.collect())
    assert got == [(1, 1), (1, 2)]
