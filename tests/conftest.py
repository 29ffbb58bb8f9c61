import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

FLOW_SCHEMA = ("row_id long, src_ip string, dst_ip string, src_port double, dst_port double, protocol string, "
               "tos int, packets double, bytes double, flows double, start_time double, end_time double")
DEFAULT_FLOW = dict(src_ip="10.0.0.1", dst_ip="10.0.0.2", src_port=40000.0, dst_port=443.0, protocol="TCP",
                    tos=0, packets=10.0, bytes=1000.0, flows=1.0, start_time=1.7e9, end_time=1.7e9 + 2)
FLOW_COLS = ["row_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "tos", "packets", "bytes",
             "flows", "start_time", "end_time"]


@pytest.fixture(scope="session")
def spark():
    from flowsentry.session import build_session
    s = build_session(master="local[4]", shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture
def make_flows(spark):
    def make(rows):
        out = []
        for i, r in enumerate(rows):
            d = dict(DEFAULT_FLOW, row_id=i)
            d.update(r)
            out.append(tuple(d[c] for c in FLOW_COLS))
        return spark.createDataFrame(out, FLOW_SCHEMA)
    return make
