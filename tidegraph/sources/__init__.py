"""Where changes come from and where differences go."""

from tidegraph.sources.mapping import MappingRule, map_records
from tidegraph.sources.push import HttpSource, PushSource, TablePoller, jdbc_table, snapshot_changes
from tidegraph.sources.readers import json_folder, kafka_topic, mock_changes, mock_stream, script_file, table_snapshot
from tidegraph.sources.sinks import EventStream, file_sink, jdbc_sink, kafka_sink, log_sink, memory_sink, post_sink, procedure_sink, render, routed

__all__ = [
    "EventStream", "HttpSource", "MappingRule", "PushSource", "TablePoller", "file_sink", "jdbc_sink", "jdbc_table", "json_folder", "kafka_sink", "kafka_topic", "log_sink", "map_records",
    "memory_sink", "mock_changes", "mock_stream", "post_sink", "procedure_sink", "render", "routed", "script_file", "snapshot_changes", "table_snapshot",
]
