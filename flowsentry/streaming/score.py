"""Per-flow verdicts on a streaming DataFrame.

The per-flow operators (features P1-P7, rule flags R1-R13, arbitration B1-B5)
are stateless row expressions, so once the adaptive thresholds of a batch run
are known they apply to ``spark.readStream`` input unchanged.  This module only
wires the existing operators to Structured Streaming; it adds no operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT_CONFIG, DetectionConfig
from ..functions.features import with_features
from ..functions.rules import with_rule_scores
from ..operators.arbitrate import arbitrate, threat_flows
from ..operators.thresholds import Thresholds


def score_stream(stream: DataFrame, thresholds: Thresholds, cfg: DetectionConfig = DEFAULT_CONFIG) -> DataFrame:
    """Threat flows of a streaming flow table, judged with fixed thresholds."""
    return threat_flows(arbitrate(with_rule_scores(with_features(stream, cfg), thresholds), cfg))


def write_threat_flows(scored: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append the threat flows as parquet; ``checkpoint`` must be a shared,
    durable folder so the query resumes after a failure."""
    w = (scored.select("row_id", "src_ip", "dst_ip", "protocol", "threat_type", "severity", "confidence")
         .writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
         .outputMode("append"))
    return (w.trigger(availableNow=True) if once else w).start()
