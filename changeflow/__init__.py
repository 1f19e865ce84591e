"""Change-data replication and replication-health analytics on PySpark."""

from changeflow.functions.ranges import TimeRange
from changeflow.session import build_session, scratch_dir
from changeflow.sinks.current_table import CurrentTable
from changeflow.sinks.registry import register_sink, resolve_sinks
from changeflow.sources.change_log import Position, read_changes
from changeflow.sources.monitor_tables import read_monitor
from changeflow.streaming.apply import ApplyJob, start_apply
from changeflow.targets import Schedule, TargetConfig

__all__ = [
    "ApplyJob",
    "CurrentTable",
    "Position",
    "Schedule",
    "TargetConfig",
    "TimeRange",
    "build_session",
    "read_changes",
    "read_monitor",
    "register_sink",
    "resolve_sinks",
    "scratch_dir",
    "start_apply",
]
