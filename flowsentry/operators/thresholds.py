"""Adaptive thresholds.

T1 needs the *nearest-rank* 95th percentile of four columns: the element at
0-based index ``k = floor((n-1)*q + 0.5)`` of the sorted non-null values (a NaN
counts as missing).

Scale: the element is found by narrowing.  A bounded sketch
(``percentile_approx``) over the open range that still holds the element
proposes three values around its rank; one count of the rows below, at and
between them either meets the element or leaves one open gap, which holds at
most a few parts in ``approx_accuracy`` of the rows before.  So one algorithm
serves every size: two column-pruned scans a round (one in the first, where the job
that wrote the rows has observed its sketch), all columns together, a
round for every factor of about ``approx_accuracy / 10`` in the row count, and
scalars are all that the driver sees.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_CONFIG, DetectionConfig

P95_COLUMNS = ("packets", "bytes", "bytes_per_packet", "packets_per_sec")


def nearest_rank_index(n: int, q: float) -> int:
    return int(math.floor((n - 1) * q + 0.5))


def _literal(v: float) -> str:
    return f"double('{float(v)!r}')"


def _inside(col: str, lo, hi) -> str:
    """Rows of ``col`` that take part, strictly between ``lo`` and ``hi``."""
    parts = [f"`{col}` IS NOT NULL AND NOT isnan(`{col}`)"]
    if lo is not None:
        parts.append(f"`{col}` > {_literal(lo)}")
    if hi is not None:
        parts.append(f"`{col}` < {_literal(hi)}")
    return " AND ".join(parts)


def _proposals(col: str, rank: float, eps: float, accuracy: int, where: str, alias: str) -> F.Column:
    at = ", ".join(f"{min(1.0, max(0.0, r))!r}D" for r in (rank - eps, rank, rank + eps))
    return F.expr(f"percentile_approx(CASE WHEN {where} THEN `{col}` END, array({at}), {accuracy})").alias(alias)


def first_round(cols, q: float | dict = 0.95, cfg: DetectionConfig = DEFAULT_CONFIG) -> list[F.Column]:
    """What the first round asks of all rows: their number, each column's number
    of values, and the sketch's proposals.  A job that writes the rows can
    observe these aggregates on the way (``DataFrame.observe``)."""
    share = q if isinstance(q, dict) else dict.fromkeys(cols, q)
    return [F.count(F.lit(1)).alias("rows"),
            *[F.expr(f"count_if({_inside(c, None, None)})").alias(f"n{i}") for i, c in enumerate(cols)],
            *[_proposals(c, share[c], 4.0 / cfg.approx_accuracy, cfg.approx_accuracy, _inside(c, None, None), f"p{i}") for i, c in enumerate(cols)]]


def exact_nearest_quantiles(df: DataFrame, cols, q: float | dict = 0.95,
                            cfg: DetectionConfig = DEFAULT_CONFIG, first: dict | None = None) -> tuple[dict, int]:
    """Returns ({col: value or None}, total row count); ``None`` when a column
    has no value.  ``q`` is one share for all columns or a share per column.

    A round asks the sketch for the values just below, at and just above the
    wanted rank, then counts the rows up to each of them.  The sketch's rank
    error is at most ``1 / approx_accuracy``, so the gap that is left holds a
    small fixed share of the rows, and once that share is under one row the
    sketch is exact.  ``first``: the results of :func:`first_round` over the
    same rows, if they are known."""
    cols = list(cols)
    share = q if isinstance(q, dict) else dict.fromkeys(cols, q)
    acc = cfg.approx_accuracy
    eps = 4.0 / acc
    if first is None:
        first = df.agg(*first_round(cols, share, cfg)).first().asDict()
    out: dict = {c: None for c in cols}
    # per open column: wanted index among the rows inside (lo, hi), their number, lo, hi
    state = {c: (nearest_rank_index(first[f"n{i}"], share[c]), first[f"n{i}"], None, None)
             for i, c in enumerate(cols) if first[f"n{i}"]}
    proposed = {c: first[f"p{i}"] for i, c in enumerate(cols) if c in state}
    while state:
        todo = list(state)
        if not proposed:
            got = df.agg(*[_proposals(c, (k + 0.5) / n, eps, acc, _inside(c, lo, hi), f"p{i}")
                           for i, c in enumerate(todo) for k, n, lo, hi in [state[c]]]).first()
            proposed = {c: got[f"p{i}"] for i, c in enumerate(todo)}
        probes = []
        for i, c in enumerate(todo):
            _, _, lo, hi = state[c]
            for j, v in enumerate(proposed[c]):
                for op, name in (("<", "below"), ("<=", "upto")):
                    probes.append(F.expr(f"count_if({_inside(c, lo, hi)} AND `{c}` {op} {_literal(v)})")
                                  .alias(f"{name}{i}_{j}"))
        counts = df.agg(*probes).first()
        for i, c in enumerate(todo):
            k, n, lo, hi = state.pop(c)
            gap = [0, n, lo, hi]            # rows before the gap, rows before its end, its ends
            for j, v in enumerate(proposed[c]):
                below, upto = counts[f"below{i}_{j}"], counts[f"upto{i}_{j}"]
                if below <= k < upto:
                    out[c] = float(v)
                elif upto <= k and upto >= gap[0]:
                    gap[0], gap[2] = upto, v
                elif k < below and below < gap[1]:
                    gap[1], gap[3] = below, v
            if out[c] is None:
                state[c] = (k - gap[0], gap[1] - gap[0], gap[2], gap[3])
        proposed = {}
    return out, int(first["rows"])


@dataclass(frozen=True)
class Thresholds:
    """The four percentiles, the derived rule cut-offs (T2) and the row count."""
    n_rows: int
    pkt_p95: float
    byt_p95: float
    bpp_p95: float
    pps_p95: float
    cfg: DetectionConfig = DEFAULT_CONFIG

    @property
    def ddos_pps(self) -> float:
        f, floor = self.cfg.ddos_pps
        return max(self.pps_p95 * f, floor)

    @property
    def ddos_packets(self) -> float:
        f, floor = self.cfg.ddos_packets
        return max(self.pkt_p95 * f, floor)

    @property
    def exfil_bytes(self) -> float:
        f, floor = self.cfg.exfil_bytes
        return max(self.byt_p95 * f, floor)

    @property
    def exfil_bpp(self) -> float:
        f, floor = self.cfg.exfil_bpp
        return max(self.bpp_p95 * f, floor)

    @property
    def brute_packets(self) -> float:
        f, floor = self.cfg.brute_packets
        return max(self.pkt_p95 * f, floor)

    @property
    def udp_flood_pps(self) -> float:
        f, floor = self.cfg.udp_flood_pps
        return max(self.pps_p95 * f, floor)

    @property
    def large_flow_bytes(self) -> float:
        f, floor = self.cfg.large_flow_bytes
        return max(self.byt_p95 * f, floor)

    def p95_row(self) -> dict:
        return {"pkt_p95": self.pkt_p95, "byt_p95": self.byt_p95,
                "bpp_p95": self.bpp_p95, "pps_p95": self.pps_p95}

    def rule_row(self) -> dict:
        return {"ddos_pps": self.ddos_pps, "ddos_packets": self.ddos_packets,
                "exfil_bytes": self.exfil_bytes, "exfil_bpp": self.exfil_bpp,
                "brute_packets": self.brute_packets, "udp_flood_pps": self.udp_flood_pps,
                "large_flow_bytes": self.large_flow_bytes}


def adaptive_thresholds(features: DataFrame, cfg: DetectionConfig = DEFAULT_CONFIG, first: dict | None = None) -> Thresholds:
    """T1 + T2 on a frame that carries the P-features.  The four values come
    back to the driver as scalars and re-enter plans as literals, so every rule
    predicate is constant-folded and can reach the scan."""
    vals, rows = exact_nearest_quantiles(features, P95_COLUMNS, cfg.quantile, cfg, first)
    defaults = dict(cfg.empty_p95)
    if rows == 0:
        vals = dict(defaults)
    else:
        missing = [c for c in P95_COLUMNS if vals[c] is None]
        if missing:
            raise ValueError(f"cannot compute adaptive thresholds: no non-null values in {missing}")
    return Thresholds(rows, vals["packets"], vals["bytes"], vals["bytes_per_packet"],
                      vals["packets_per_sec"], cfg)


def thresholds_frame(spark, thr: Thresholds, which: str = "p95") -> DataFrame:
    """One-row frame of the percentiles (``p95``) or rule cut-offs (``rules``)."""
    row = thr.p95_row() if which == "p95" else thr.rule_row()
    schema = ", ".join(f"{k} double" for k in row)
    return spark.createDataFrame([tuple(float(v) for v in row.values())], schema)
