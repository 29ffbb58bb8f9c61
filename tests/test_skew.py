"""A single source holding a third of all flows, spread over many partitions:
every per-source result must equal a brute-force count."""

from collections import Counter

from flowsentry.config import DetectionConfig
from flowsentry.plans.analyze import alerts_before_cut, score_flows


def test_hot_source(make_flows):
    rows = []
    for i in range(900):
        if i % 3 == 0:   # the hot scanner: one source, many destinations and ports
            rows.append(dict(src_ip="10.6.6.6", dst_ip=f"172.20.{i % 7}.{i % 250}", dst_port=float(1000 + i % 40),
                             packets=2.0, protocol="icmp" if i % 2 else "TCP"))
        else:
            rows.append(dict(src_ip=f"10.0.{i % 5}.{i % 11}", dst_ip="192.168.0.1", packets=float(1 + i % 900)))
    flows = make_flows(rows).repartition(16)
    sf = score_flows(flows, DetectionConfig(), ml=None, persist=False)
    alerts = {(r.src_ip, r.threat_type): r for r in alerts_before_cut(sf).collect()}
    hot = [r for r in rows if r["src_ip"] == "10.6.6.6"]
    dsts = {r["dst_ip"] for r in hot}
    icmp_dsts = {r["dst_ip"] for r in hot if r["protocol"] == "icmp"}
    assert alerts[("10.6.6.6", "Botnet Activity (High Flow Count)")].flow_count == len(hot)
    assert alerts[("10.6.6.6", "ICMP Sweep (Aggregated)")].flow_count == len(icmp_dsts)
    assert alerts[("10.6.6.6", "ICMP Sweep (Aggregated)")].dst_ip == ", ".join(sorted(icmp_dsts))
    # horizontal threshold: max(15, int(0.05 * 900)) = 45 distinct destinations
    assert (("10.6.6.6", "Horizontal Scan (Aggregated)") in alerts) == (len(dsts) >= 45)
    # per-pair port scans of the hot source match a brute-force count
    pairs = Counter((r["dst_ip"]) for r in hot)
    ports = {}
    for r in hot:
        ports.setdefault(r["dst_ip"], set()).add(r["dst_port"])
    want = sum(1 for d in pairs if len(ports[d]) >= 5)
    rows_ps = [r for r in alerts_before_cut(sf).collect()
               if r.src_ip == "10.6.6.6" and r.threat_type == "Port Scan (Aggregated)"]
    assert len(rows_ps) == want
