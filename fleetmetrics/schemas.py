"""Schemas of the tables that the jobs read and write."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, DoubleType, IntegerType, LongType, MapType, StringType, StructType, TimestampType

_TAGS = MapType(StringType(), StringType())
_TYPES = {"string": StringType(), "double": DoubleType(), "bigint": LongType(), "int": IntegerType(), "boolean": BooleanType(), "timestamp": TimestampType(), "date": DateType(), "tags": _TAGS}


def struct(text: str, **more: DataType) -> StructType:
    """A struct of `name type` pairs; made without a session, so that the module can be imported anywhere."""
    out = StructType()
    for pair in text.split(", "):
        name, kind = pair.split()
        out = out.add(name, (_TYPES | more)[kind])
    return out


_POINT = ArrayType(struct("name string, value double, ts bigint, tags tags"))
_PROCESS = ArrayType(struct("pid int, command string, user string, cpuPercent double, rssMb bigint"))

INGEST_BATCH = struct("batch_id string, token string, agentId string, host string, metrics points, processes processes", points=_POINT, processes=_PROCESS)
CREDENTIALS = struct("token string, org_id string")
SAMPLE = struct("org_id string, metric string, tags tags, value double, ts timestamp, seq bigint")
FLAT_SAMPLE = struct("org_id string, host string, metric string, metric_value double, ts timestamp")
SERIES = struct(
    "series_id bigint, org_id string, metric string, tags tags, tags_text string, "
    "series_key string, first_seen timestamp, last_seen timestamp"
)
STORED_SAMPLE = struct("series_id bigint, ts timestamp, value double, seq bigint")
ROLLUP = struct(
    "series_id bigint, resolution string, bucket_ts timestamp, sample_count bigint, "
    "sum_value double, min_value double, max_value double, last_value double"
)
WATERMARK = struct("resolution string, processed_to timestamp")
HOST_SNAPSHOT = struct("org_id string, host string, captured_at timestamp, payload_json string")
PROCESSES = _PROCESS
HOST_COUNTERS = struct(
    "host string, ts timestamp, cpu_load double, mem_total bigint, mem_available bigint, disk_total bigint, "
    "disk_free bigint, bytes_recv bigint, bytes_sent bigint, process_count bigint, thread_count bigint"
)
ALERT_RULE = struct(
    "org_id string, rule_key string, name string, expression string, severity string, for_seconds int, "
    "resolve_seconds int, cooldown_seconds int, enabled boolean, created_at timestamp, updated_at timestamp"
)
DECISION = struct("org_id string, rule_key string, host string, tick timestamp, violating boolean, observed double, error string")
ALERT_STATE = struct(
    "org_id string, rule_key string, host string, state string, violation_since timestamp, "
    "recovery_since timestamp, episode_start timestamp, cooldown_until timestamp"
)
TRANSITION = struct(
    "org_id string, rule_key string, host string, tick timestamp, state string, transition string, transition_start timestamp, recovered_at timestamp, "
    "observed double, violation_since timestamp, recovery_since timestamp, episode_start timestamp, cooldown_until timestamp"
)
EPISODE = struct(
    "episode_key string, rule_id string, org_id string, host string, state string, incident_id bigint, "
    "incident_number string, started_at timestamp, resolved_at timestamp"
)
