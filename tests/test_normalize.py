"""Edge rows of the vendor normalisers (FIXTURES section 3)."""
from costlens import schema as SC
from costlens.operators import normalize as N


def _azure(spark, tags):
    rows = [("2026-01-01 00:00:00", "Storage", 1.0, t, 0, "none") for t in tags]
    return N.normalize_azure(spark.createDataFrame(rows, SC.RAW_AZURE))


def test_json_tags(spark):
    tags = ['{"env": null}', None, "", "bad", "[1]", "5", '{"env": "Production", "team": "FinTech"}',
            '{"team": "X"}']
    out = [(r["normalized_env"], r["normalized_team"]) for r in _azure(spark, tags).collect()]
    assert out == [("none", "unknown"), ("unknown", "unknown"), ("unknown", "unknown"),
                   ("unknown", "unknown"), ("unknown", "unknown"), ("unknown", "unknown"),
                   ("production", "fintech"), ("unknown", "x")]


def test_aws_maps_and_null_tokens(spark):
    rows = [("2026-01-01 00:00:00", "AmazonEC2", 2.5, 2.0, "NA", "CoreEngine", 0, "none"),
            ("2026-01-02 00:00:00", None, 1.0, 1.0, None, "", 1, "spike"),
            ("2026-01-03 00:00:00", "AmazonQuantum", 1.0, 1.0, "Staging", "null", 0, "none")]
    out = N.normalize_aws(spark.createDataFrame(rows, SC.RAW_AWS)).collect()
    assert [r["unified_category"] for r in out] == ["COMPUTE", "OTHER", "OTHER"]
    assert [r["normalized_env"] for r in out] == ["unknown", "unknown", "staging"]
    assert [r["normalized_team"] for r in out] == ["coreengine", "unknown", "unknown"]
    assert [r["anomaly_type"] for r in out] == ["none", "spike", "none"]
    assert out[0]["cost"] == 2.5   # unblended, not net


def test_gcp_date_only_timestamps(spark):
    rows = [("2026-01-01", "Cloud Network", 3.0, "prod", "analytics", 0, "none")]
    r = N.normalize_gcp(spark.createDataFrame(rows, SC.RAW_GCP)).first()
    assert str(r["timestamp"]) == "2026-01-01 00:00:00" and r["unified_category"] == "NETWORK"
