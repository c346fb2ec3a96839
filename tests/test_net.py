import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from textloom.functions import net
from textloom.operators import listing


@pytest.mark.parametrize(
    ("remote", "forwarded", "got"),
    [("1.2.3.4:80", None, "1.2.3.4"), ("10.0.0.1:9", "5.6.7.8, 9.9.9.9, 10.0.0.2", "9.9.9.9"), ("10.0.0.1", "x", "10.0.0.1"), ("[::1]:80", "5.5.5.5", "::1"), ("odd", None, "odd"), ("8.8.8.8", "1.1.1.1", "8.8.8.8")],
)
def test_client_ip(spark, remote, forwarded, got):
    assert net.client_ip(remote, forwarded, ["10.0.0.0/8"]) == got
    frame = spark.createDataFrame([(remote, forwarded)], "r string, f string")
    assert frame.select(net.client_ips(["10.0.0.0/8"])("r", "f")).first()[0] == got


def test_origins_and_requirements():
    allowed = ["https://a.example", "localhost", "http://b.example:81"]
    assert [net.origin_allowed(o, allowed) for o in ("", "https://a.example", "http://a.example", "http://localhost:3000", "http://b.example", "http://b.example:81", "https://a.example.evil")] == [True, True, False, True, False, True, False]
    good = {"scheme": "exact", "network": "eip155:8453", "amount": "100", "asset": "x", "pay_to": "y"}
    assert net.requirement_errors(good) == [] and net.requirement_errors(good | {"amount": "-1"}) and net.requirement_errors(good | {"network": "x"}) and net.requirement_errors(good | {"amount": "000"})


def test_counters_come_with_the_rows(spark):
    seen = Observation()
    docs = spark.createDataFrame([("ok",), ("ok",), ("error",), ("secret_excluded",)], "status string")
    assert listing.observed(docs, seen).filter(F.lit(True)).count() == 4
    assert seen.get == {"scanned": 4, "indexed": 2, "skipped": 1, "errors": 1}
