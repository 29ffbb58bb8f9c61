"""DuckDB SQL for every oracle-checked query.

These strings are an independent second implementation used only to check
the Spark plans: they run in DuckDB over the driver's parquet views, starting
from the same ``flows`` fixture text.  Numeric literals are cast to DOUBLE so
DuckDB does not switch to DECIMAL arithmetic.
"""

from __future__ import annotations

from ..config import RULE_SLOTS
from ..functions.rounding import cut_points
from ..sources.fixture import flows_cte_duckdb

D = "::DOUBLE"

FEAT = f"""
f0 as (
  select *, end_time - start_time as raw_duration,
    case when end_time - start_time <= 0 then 0.001{D} else end_time - start_time end as flow_duration,
    bytes / (case when packets = 0 then 1.0{D} else packets end) as bpp0
  from flows),
f1 as (select *, packets / flow_duration as pps0 from f0),
feat as (
  select * exclude (bpp0, pps0),
    coalesce(case when isnan(bpp0) then 0.0{D} else bpp0 end, 0.0{D}) as bytes_per_packet,
    coalesce(case when isnan(pps0) then 0.0{D} else pps0 end, 0.0{D}) as packets_per_sec_raw,
    case when upper(protocol) = 'UDP' or protocol = '17' then 1.0{D} else 0.0{D} end as udp_ratio,
    case when dst_port > 1024 and dst_port not in (8080, 8443, 3306, 5432, 6379) then 1.0{D} else 0.0{D} end
      as dst_port_flag,
    least(greatest(coalesce(case when isnan(pps0) then 0.0{D} else pps0 end, 0.0{D}), 0.0{D}), 10000000.0{D})
      as packets_per_sec
  from f1)"""


def _nearest(col: str, name: str) -> str:
    return (f"q_{name} as (select {col} as v, row_number() over (order by {col}) - 1 as i, "
            f"count(*) over () as n from feat where {col} is not null)")


P95 = ",\n".join([
    _nearest("packets", "pkt"), _nearest("bytes", "byt"),
    _nearest("bytes_per_packet", "bpp"), _nearest("packets_per_sec", "pps"),
]) + """,
p as (select
  (select v from q_pkt where i = cast(round((n - 1) * 0.95) as bigint)) as pkt_p95,
  (select v from q_byt where i = cast(round((n - 1) * 0.95) as bigint)) as byt_p95,
  (select v from q_bpp where i = cast(round((n - 1) * 0.95) as bigint)) as bpp_p95,
  (select v from q_pps where i = cast(round((n - 1) * 0.95) as bigint)) as pps_p95)"""

THR = f"""
thr as (select
  greatest(pps_p95 * 1.5{D}, 100.0{D}) as ddos_pps, greatest(pkt_p95 * 1.2{D}, 100.0{D}) as ddos_packets,
  greatest(byt_p95 * 2.0{D}, 10000.0{D}) as exfil_bytes, greatest(bpp_p95 * 1.5{D}, 200.0{D}) as exfil_bpp,
  greatest(pkt_p95 * 0.5{D}, 10.0{D}) as brute_packets, greatest(pps_p95 * 2.0{D}, 200.0{D}) as udp_flood_pps,
  greatest(byt_p95 * 3.0{D}, 50000.0{D}) as large_flow_bytes
  from p)"""

_SLOTS = ", ".join(f"case when {c} > 0 then '{n}' else '' end" for c, n in RULE_SLOTS)

RULES = f"""
r0 as (
  select feat.*,
    case when packets > 500 then 1 else 0 end as flood_score,
    case when upper(protocol) in ('GRE', 'ESP', 'OSPF') then 1 else 0 end as suspicious_protocol_score,
    case when packets_per_sec > (select ddos_pps from thr) and packets > (select ddos_packets from thr)
         then 1 else 0 end as ddos_score,
    case when udp_ratio = 1.0 and packets_per_sec > (select udp_flood_pps from thr) and packets > 100
         then 1 else 0 end as udp_flood_score,
    case when bytes > (select exfil_bytes from thr) and bytes_per_packet > (select exfil_bpp from thr)
         then 1 else 0 end as exfil_score,
    case when dst_port in (22, 23, 3389, 445, 5900, 8080) and packets > (select brute_packets from thr)
         then 1 else 0 end as brute_score,
    case when bytes > (select large_flow_bytes from thr) and flow_duration < 1.0
         then 1 else 0 end as large_flow_score,
    0 as icmp_sweep_score
  from feat),
r1 as (select *, flood_score + suspicious_protocol_score + ddos_score + udp_flood_score + exfil_score
                 + brute_score + large_flow_score + icmp_sweep_score as total_rule_score from r0),
rules as (
  select *,
    case when total_rule_score = 0 then null when total_rule_score = 1 then 'HIGH' else 'CONFIRMED' end
      as rule_severity,
    case when total_rule_score = 0 then null
         else trim(replace(concat_ws(';', {_SLOTS}), ';;', ';'), ';') end as rule_threat_type,
    case when total_rule_score = 0 then 0.0{D} when total_rule_score = 1 then 0.5{D} else 0.85{D} end
      as rule_confidence
  from r1)"""


def _arb(ml_score: str, ml_label: str, evidence: str) -> str:
    return f"""
m0 as (select *, {ml_score} as ml_score, {ml_label} as ml_label from rules),
m1 as (select *, {evidence} as ml_evidence,
         case when ml_label = 1 then 0.5{D} + 0.4{D} * ml_score else 0.0{D} end as ml_confidence from m0),
arb as (
  select *,
    case when rule_threat_type is not null and ml_label = 1 then rule_threat_type || ' (Rule + ML)'
         when rule_threat_type is not null then rule_threat_type
         when ml_label = 1 and ml_score > 0.70{D} then 'Anomalous Traffic (ML)' end as threat_type,
    case when rule_severity = 'CONFIRMED' or (ml_label = 1 and ml_score > 0.85{D}) then 'CONFIRMED'
         when rule_severity = 'HIGH' or (ml_label = 1 and ml_score > 0.70{D}) then 'HIGH'
         else 'MONITOR' end as severity,
    least(greatest(
      case when rule_threat_type is not null and ml_label = 1
             then rule_confidence + (1.0{D} - rule_confidence) * ml_confidence * 0.5{D}
           when rule_threat_type is not null then rule_confidence
           when ml_label = 1 then ml_confidence
           else 0.0{D} end, 0.0{D}), 1.0{D}) as confidence
  from m1),
threats as (select * from arb where threat_type is not null)"""


ARB_SHIPPED = _arb(f"0.0{D}", "0", "''")

# Moments over every row.
MOMENTS = f"""
mom as (select
  avg(packets) as m_pkt, stddev_pop(packets) + 1e-9 as s_pkt,
  avg(bytes) as m_byt, stddev_pop(bytes) + 1e-9 as s_byt,
  avg(packets_per_sec) as m_pps, stddev_pop(packets_per_sec) + 1e-9 as s_pps,
  avg(bytes_per_packet) as m_bpp, stddev_pop(bytes_per_packet) + 1e-9 as s_bpp,
  avg(flow_duration) as m_dur, stddev_pop(flow_duration) + 1e-9 as s_dur
  from feat)"""

_EVIDENCE_ML = f"""trim(case when ml_label = 0 then ''
  when packets > (select m_pkt + 2 * s_pkt from mom) then 'High packet count; ' ||
       case when bytes > (select m_byt + 2 * s_byt from mom) then 'Large byte transfer; ' else '' end
  when bytes > (select m_byt + 2 * s_byt from mom) then 'Large byte transfer; '
  when packets_per_sec > (select m_pps + 2 * s_pps from mom) then 'High packet rate; '
  when bytes_per_packet > (select m_bpp + 2 * s_bpp from mom) then 'Unusually high bytes/packet; '
  when flow_duration < (select m_dur - 2 * s_dur from mom) then 'Very short flow duration; '
  else 'Multivariate anomaly (Isolation Forest)' end, '; ')"""

ARB_INJECTED = _arb(f"(row_id % 100) / 99.0{D}", "case when row_id % 20 = 0 then 1 else 0 end", _EVIDENCE_ML)

DETECT = f"""
d1 as (
  select src_ip, dst_ip, threat_type, severity, protocol, count(*) as flow_count,
         max(confidence) as confidence, arg_min_null(ml_evidence, row_id) as evidence
  from threats group by src_ip, dst_ip, threat_type, severity, protocol),
pairs as (
  select src_ip, dst_ip, count(*) as pair_flows,
         count(distinct dst_port) + max(case when dst_port is null then 1 else 0 end) as unique_ports,
         avg(packets) as avg_packets, arg_min_null(protocol, row_id) as first_protocol
  from flows group by src_ip, dst_ip),
d2 as (
  select src_ip, dst_ip, 'Port Scan (Aggregated)' as threat_type,
         case when unique_ports > 50 then 'high' else 'medium' end as severity,
         coalesce(upper(first_protocol), 'NONE') as protocol, unique_ports as flow_count,
         least(0.99{D}, 0.5{D} + 0.01{D} * unique_ports) as confidence,
         printf('Scanning %d unique destination ports with small average packet size (%.1f)',
                unique_ports, avg_packets) as evidence
  from pairs where unique_ports >= 5 and avg_packets < 5),
srcs as (
  select src_ip, count(*) as src_flows,
         count(distinct dst_ip) + max(case when dst_ip is null then 1 else 0 end) as unique_dsts,
         arg_min_null(protocol, row_id) as first_protocol,
         string_agg(distinct dst_ip, ', ' order by dst_ip) as dst_list
  from flows group by src_ip),
d3 as (
  select src_ip, coalesce(dst_list, '') as dst_ip, 'Horizontal Scan (Aggregated)' as threat_type,
         case when unique_dsts > 500 then 'high' else 'medium' end as severity,
         coalesce(upper(first_protocol), 'NONE') as protocol, unique_dsts as flow_count,
         least(0.99{D}, 0.5{D} + 0.001{D} * unique_dsts) as confidence,
         'Scanning ' || unique_dsts || ' unique destination IPs' as evidence
  from srcs
  where unique_dsts >= greatest(15, cast(floor(0.05{D} * (select count(*) from flows)) as bigint))),
d4 as (
  select src_ip, coalesce(dst_list, '') as dst_ip, 'Botnet Activity (High Flow Count)' as threat_type,
         'confirmed' as severity, coalesce(upper(first_protocol), 'NONE') as protocol,
         src_flows as flow_count, least(0.99{D}, 0.70{D} + 0.01{D} * (src_flows / 10.0{D})) as confidence,
         'High flow count (' || src_flows || ') to ' || unique_dsts || ' unique destinations - botnet pattern'
           as evidence
  from srcs where src_flows > 50 and unique_dsts > 30),
icmp as (
  select src_ip, count(distinct dst_ip) + max(case when dst_ip is null then 1 else 0 end) as unique_dsts,
         coalesce(sum(packets), 0.0{D}) as total_packets,
         string_agg(distinct dst_ip, ', ' order by dst_ip) as dst_list
  from flows where upper(protocol) = 'ICMP' group by src_ip),
d5 as (
  select src_ip, coalesce(dst_list, '') as dst_ip, 'ICMP Sweep (Aggregated)' as threat_type,
         'confirmed' as severity, 'ICMP' as protocol, unique_dsts as flow_count,
         least(0.99{D}, 0.70{D} + 0.01{D} * unique_dsts) as confidence,
         'ICMP sweep to ' || unique_dsts || ' unique destinations with ' || total_packets::varchar
           || ' total packets' as evidence
  from icmp where unique_dsts >= 2),
temporal as (
  select src_ip, min(start_time) as first_seen, max(start_time) as last_seen, count(*) as threat_flow_count,
         coalesce((count(*) >= 2 and max(start_time) - min(start_time) <= 60)
                  or (count(*) >= 3 and max(start_time) - min(start_time) <= 300), false) as temporal
  from threats group by src_ip),
raw_alerts as (
  select src_ip, dst_ip, threat_type, severity, protocol, flow_count, confidence, evidence from d1
  union all select src_ip, dst_ip, threat_type, severity, protocol, flow_count, confidence, evidence from d2
  union all select src_ip, dst_ip, threat_type, severity, protocol, flow_count, confidence, evidence from d3
  union all select src_ip, dst_ip, threat_type, severity, protocol, flow_count, confidence, evidence from d4
  union all select src_ip, dst_ip, threat_type, severity, protocol, flow_count, confidence, evidence from d5)"""

_CUTS = "[" + ", ".join(f"{c!r}{D}" for c in cut_points(100, 2)) + "]"

CALIBRATE = f"""
k0 as (
  select a.*, coalesce(t.temporal, false) as tp,
    case when contains(a.threat_type, 'Port Scan') or contains(a.threat_type, 'Horizontal Scan') then 1
         when a.flow_count = 1 and not (contains(a.threat_type, '(Rule + ML)') or contains(a.threat_type, 'Aggregated')) then 2
         when (contains(a.threat_type, '(Rule + ML)') or contains(a.threat_type, 'Aggregated'))
              or (coalesce(t.temporal, false) and a.severity = 'CONFIRMED') then 3
         when a.flow_count = 2 and not coalesce(t.temporal, false) then 4
         when a.severity = 'CONFIRMED' then 5
         when a.severity = 'HIGH' then 6
         else 7 end as branch
  from raw_alerts a left join temporal t on a.src_ip is not distinct from t.src_ip),
k1 as (
  select src_ip, dst_ip, threat_type, protocol, flow_count, branch, tp as temporal,
    case when branch in (1, 3, 5) then 'CONFIRMED' when branch = 4 then 'SUSPICIOUS'
         when branch = 6 then 'HIGH' else 'MONITOR' end as severity,
    least(case when branch = 1 then 0.85{D} + 0.14{D} * confidence
               when branch = 2 then least(0.60{D}, greatest(0.40{D},
                  case when confidence < 0.6 then 0.40{D} + 0.05{D} * (confidence / 0.6{D})
                       when confidence < 0.8 then 0.45{D} + 0.10{D} * ((confidence - 0.6{D}) / 0.2{D})
                       else 0.55{D} + 0.05{D} * ((confidence - 0.8{D}) / 0.2{D}) end))
               when branch in (3, 5) then 0.75{D} + 0.24{D} * confidence
               when branch in (4, 6) then 0.55{D} + 0.20{D} * confidence
               else 0.40{D} + 0.20{D} * confidence end, 0.99{D}) as confidence_raw,
    coalesce(nullif(evidence, ''), 'Rule-based detection for ' || threat_type) as evidence
  from k0),
cuts as (select unnest({_CUTS}) as cut, generate_subscripts({_CUTS}, 1) - 1 as k),
calibrated as (
  select k1.*, (select max(k) from cuts where cut <= confidence_raw)::DOUBLE / 100.0{D} as confidence from k1),
sev_rank as (
  select *, case severity when 'CONFIRMED' then 4 when 'HIGH' then 3 when 'SUSPICIOUS' then 2
                          when 'MONITOR' then 1 else 0 end as rnk from calibrated),
prof as (select src_ip, count(distinct threat_type) as threat_types, max(rnk) as max_rank
         from sev_rank group by src_ip),
escalated as (
  select s.src_ip, s.dst_ip, s.threat_type, s.protocol, s.flow_count, s.branch,
    case when lift then least(0.99{D}, s.confidence_raw + 0.10{D}) else s.confidence_raw end as confidence_raw,
    case when lift then least(0.99{D}, s.confidence + 0.10{D}) else s.confidence end as confidence,
    case when lift then top else s.severity end as severity,
    case when lift then s.evidence || ' (Escalated due to cross-threat pattern)' else s.evidence end as evidence,
    lift as escalated
  from (select s.*, case p.max_rank when 4 then 'CONFIRMED' when 3 then 'HIGH' when 2 then 'SUSPICIOUS'
                                    when 1 then 'MONITOR' end as top,
               coalesce(p.threat_types >= 2 and s.severity <> (case p.max_rank when 4 then 'CONFIRMED'
                   when 3 then 'HIGH' when 2 then 'SUSPICIOUS' when 1 then 'MONITOR' end), false) as lift
        from sev_rank s left join prof p on s.src_ip is not distinct from p.src_ip) s),
ranked as (
  select src_ip, dst_ip, threat_type, protocol, flow_count, confidence, severity, evidence
  from escalated
  order by case severity when 'CONFIRMED' then 4 when 'HIGH' then 3 when 'SUSPICIOUS' then 2
                         when 'MONITOR' then 1 else 0 end desc,
           confidence desc, confidence_raw desc, src_ip, dst_ip, threat_type, protocol, flow_count, evidence
  limit 1000)"""


def with_ctes(*parts: str) -> str:
    return "with " + flows_cte_duckdb() + ",\n" + ",\n".join(p.strip() for p in parts) + "\n"


BASE_SHIPPED = (FEAT, P95, THR, RULES, ARB_SHIPPED)
BASE_INJECTED = (FEAT, P95, THR, RULES, MOMENTS, ARB_INJECTED)
ALERTS_SHIPPED = BASE_SHIPPED + (DETECT, CALIBRATE)

# every escalated alert
FINAL = """
final as (select src_ip, dst_ip, threat_type, protocol, flow_count, confidence, severity, evidence from escalated)"""

TIMELINE = f"""
tt as (select start_time as t from threats where start_time is not null and not isnan(start_time)
         and abs(start_time) <> 'inf'::DOUBLE),
tb as (select min(t) as lo, max(t) as hi,
              (case when max(t) - min(t) <= 0 then 1.0{D} else max(t) - min(t) end) / 30.0{D} as width from tt),
tc as (select least(greatest(cast(floor((t - (select lo from tb)) / (select width from tb)) as integer), 0), 29)
              as bin, count(*) as c from tt group by 1),
timeline as (
  select g.bin,
         case when (select lo from tb) > 1e9 then
              strftime(make_timestamp(cast(floor(((select lo from tb) + (g.bin + 0.5{D}) * (select width from tb))
                                                 * 1000000.0{D}) as bigint)), '%H:%M:%S')
              else 'T+' || round(((select lo from tb) + (g.bin + 0.5{D}) * (select width from tb))
                                 - (select lo from tb), 1)::varchar || 's' end as time,
         coalesce(tc.c, 0) as threat_count
  from (select range::integer as bin from range(30)) g left join tc on g.bin = tc.bin
  where (select lo from tb) is not null
  union all select 0, 'N/A', 0 where (select lo from tb) is null)"""

GROUND_TRUTH = """
truth as (select src_ip, case when contains(label, 'BENIGN') then 'benign' else 'threat' end as ground_truth
          from flows),
det as (select distinct src_ip from final where src_ip is not null and src_ip <> ''),
outcomes as (
  select t.ground_truth, t.src_ip,
         case when t.ground_truth = 'threat' and d.src_ip is not null then 'tp'
              when t.ground_truth = 'threat' then 'fn'
              when d.src_ip is not null then 'fp' else 'tn' end as outcome
  from (select distinct ground_truth, src_ip from truth) t left join det d on t.src_ip = d.src_ip),
conf as (
  select count(*) filter (where ground_truth = 'threat') as unique_threat_ips,
         count(*) filter (where ground_truth = 'benign') as unique_benign_ips,
         count(*) filter (where outcome = 'tp') as true_positives,
         count(*) filter (where outcome = 'fp') as false_positives,
         count(*) filter (where outcome = 'tn') as true_negatives,
         count(*) filter (where outcome = 'fn') as false_negatives from outcomes),
rates as (
  select *,
    coalesce(true_positives::DOUBLE / nullif(true_positives + false_positives, 0), 0.0::DOUBLE) as precision,
    coalesce(true_positives::DOUBLE / nullif(true_positives + false_negatives, 0), 0.0::DOUBLE) as recall,
    coalesce((true_positives + true_negatives)::DOUBLE / nullif(unique_threat_ips + unique_benign_ips, 0),
             0.0::DOUBLE) as accuracy,
    coalesce(false_positives::DOUBLE / nullif(unique_benign_ips, 0), 0.0::DOUBLE) as false_positive_rate,
    coalesce(false_negatives::DOUBLE / nullif(unique_threat_ips, 0), 0.0::DOUBLE) as false_negative_rate
  from conf),
acc as (select *, case when precision + recall > 0 then 2 * (precision * recall) / (precision + recall)
                       else 0.0::DOUBLE end as f1_score from rates)"""

ALERTS_FINAL = ALERTS_SHIPPED + (FINAL,)


def numpy_bin(col: str) -> str:
    """DuckDB text of the 20-bin index with evenly spaced edges (see stats.histogram_bin)."""
    raw = f"least(cast(floor({col} * 20) as integer), 19)"
    lower = f"({raw})::DOUBLE * 0.05{D}"
    upper = f"(case when {raw} + 1 = 20 then 1.0{D} else ({raw} + 1)::DOUBLE * 0.05{D} end)"
    return (f"case when {col} >= 0 and {col} <= 1 and not isnan({col}) then "
            f"case when {col} < {lower} then {raw} - 1 when {raw} < 19 and {col} >= {upper} then {raw} + 1 "
            f"else {raw} end end")
