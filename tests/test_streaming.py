import os
import tempfile

from flowsentry.functions.features import with_features
from flowsentry.operators.arbitrate import arbitrate, threat_flows
from flowsentry.functions.rules import with_rule_scores
from flowsentry.operators.thresholds import adaptive_thresholds
from flowsentry.sources.fixture import load_flows
from flowsentry.streaming.score import score_stream, write_threat_flows


def test_stream_matches_batch(spark):
    base = tempfile.mkdtemp(prefix="flowsentry-stream-")
    flows = load_flows(spark, "/root/testdata/sf0.001")
    src = os.path.join(base, "in")
    flows.write.parquet(src)
    thr = adaptive_thresholds(with_features(flows))
    stream = spark.readStream.schema(flows.schema).parquet(src)
    q = write_threat_flows(score_stream(stream, thr), os.path.join(base, "out"), os.path.join(base, "ckpt"))
    q.awaitTermination(120)
    got = spark.read.parquet(os.path.join(base, "out")).count()
    want = threat_flows(arbitrate(with_rule_scores(with_features(flows), thr))).count()
    assert got == want == 186
