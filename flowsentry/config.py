"""Detection parameters.

Everything that must equal the behaviour being reproduced lives here, in one
frozen dataclass, so a run is fully described by one value and no module keeps
global state.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (must stay exactly as written for identical results)
# ---------------------------------------------------------------------------
FLOW_COLUMNS = (
    "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "tos",
    "packets", "bytes", "flows", "start_time", "end_time",
)
REQUIRED_COLUMNS = (
    "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
    "packets", "bytes", "flows", "start_time", "end_time",
)
HEADER_HINT_COLUMNS = (
    "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packets", "bytes", "flows",
)
NUMERIC_COLUMNS = ("packets", "bytes", "flows", "src_port", "dst_port")
TIME_COLUMNS = ("start_time", "end_time")
# strptime-style formats tried in order after automatic detection, as Spark patterns
TIME_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS][.S]",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][.S]",
    "MM/dd/yyyy HH:mm",
    "dd/MM/yyyy HH:mm:ss",
)
# The sentences that alerts give as evidence.
PORT_SCAN_EVIDENCE = "Scanning %s unique destination ports with small average packet size (%s)"
HORIZONTAL_SCAN_EVIDENCE = "Scanning %d unique destination IPs"
BOTNET_EVIDENCE = "High flow count (%d) to %d unique destinations - botnet pattern"
ICMP_SWEEP_EVIDENCE = "ICMP sweep to %s unique destinations with %s total packets"
FEATURE_COLUMNS = (
    "bytes_per_packet", "packets_per_sec", "flow_duration",
    "udp_ratio", "dst_port_flag", "packets", "bytes", "flows",
)
COMMON_HIGH_PORTS = (8080, 8443, 3306, 5432, 6379)
BRUTE_FORCE_PORTS = (22, 23, 3389, 445, 5900, 8080)
SUSPICIOUS_PROTOCOLS = ("GRE", "ESP", "OSPF")
# rule slots in label order: (flag column, label text)
RULE_SLOTS = (
    ("flood_score", "Flood"),
    ("suspicious_protocol_score", "Suspicious Protocol"),
    ("ddos_score", "DDoS"),
    ("udp_flood_score", "UDP Flood"),
    ("exfil_score", "Data Exfiltration"),
    ("brute_score", "Brute Force"),
    ("large_flow_score", "Large Flow"),
    ("icmp_sweep_score", "ICMP Sweep"),
)
SEVERITY_RANK = {"CONFIRMED": 4, "HIGH": 3, "SUSPICIOUS": 2, "MONITOR": 1}
PORT_SCAN_TYPE = "Port Scan (Aggregated)"
HORIZONTAL_SCAN_TYPE = "Horizontal Scan (Aggregated)"
BOTNET_TYPE = "Botnet Activity (High Flow Count)"
ICMP_SWEEP_TYPE = "ICMP Sweep (Aggregated)"
ML_ONLY_TYPE = "Anomalous Traffic (ML)"
RULE_ML_SUFFIX = " (Rule + ML)"
ESCALATION_SUFFIX = " (Escalated due to cross-threat pattern)"
DEFAULT_EVIDENCE_PREFIX = "Rule-based detection for "
EVIDENCE_TEXTS = {
    "packets": "High packet count",
    "bytes": "Large byte transfer",
    "packets_per_sec": "High packet rate",
    "bytes_per_packet": "Unusually high bytes/packet",
    "flow_duration": "Very short flow duration",
    "fallback": "Multivariate anomaly (Isolation Forest)",
}


@dataclass(frozen=True)
class DetectionConfig:
    # adaptive thresholds
    quantile: float = 0.95
    empty_p95: tuple = (("packets", 1000.0), ("bytes", 100000.0),
                        ("bytes_per_packet", 500.0), ("packets_per_sec", 500.0))
    # rule factors and floors
    flood_packets: float = 500.0
    ddos_pps: tuple = (1.5, 100.0)
    ddos_packets: tuple = (1.2, 100.0)
    exfil_bytes: tuple = (2.0, 10000.0)
    exfil_bpp: tuple = (1.5, 200.0)
    brute_packets: tuple = (0.5, 10.0)
    udp_flood_pps: tuple = (2.0, 200.0)
    udp_flood_packets: float = 100.0
    large_flow_bytes: tuple = (3.0, 50000.0)
    large_flow_duration: float = 1.0
    min_duration: float = 0.001
    pps_clip: float = 1e7
    # feature sanitising for the forest
    posinf: float = 1e9
    neginf: float = -1e9
    # rule confidences
    one_rule_confidence: float = 0.50
    multi_rule_confidence: float = 0.85
    # isolation forest
    seed: int = 42
    n_trees: int = 100
    max_samples: int = 256
    contamination: float = 0.05
    ml_type_score: float = 0.70
    ml_confirmed_score: float = 0.85
    # aggregation detectors
    port_scan_min_ports: int = 5
    port_scan_max_avg_packets: float = 5.0
    port_scan_high_ports: int = 50
    horizontal_min_dsts: int = 15
    horizontal_share: float = 0.05
    horizontal_high_dsts: int = 500
    botnet_min_flows: int = 50
    botnet_min_dsts: int = 30
    icmp_min_dsts: int = 2
    # temporal correlation: (min flows, max span seconds)
    temporal_rules: tuple = ((2, 60.0), (3, 300.0))
    # output
    max_alerts: int = 1000
    histogram_bins: int = 20
    timeline_bins: int = 30
    # sketch accuracy of the exact quantiles' narrowing rounds
    approx_accuracy: int = 10_000


DEFAULT_CONFIG = DetectionConfig()
