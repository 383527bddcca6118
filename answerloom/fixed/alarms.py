"""Alarm rules, histogram bounds and routing."""

# Threshold alarms
# (alarm, metric, statistic, period s, periods, threshold, comparison, severity).
THRESHOLD_ALARMS = [
    ("HighInferenceLatency", "InferenceLatency", "p95", 300, 1, 15000.0, "GreaterThanThreshold", "warning"),
    ("CriticalInferenceLatency", "InferenceLatency", "p95", 300, 2, 30000.0, "GreaterThanThreshold", "critical"),
    ("LowConfidenceScore", "ConfidenceScore", "Average", 600, 2, 0.70, "LessThanThreshold", "warning"),
    ("HighErrorRate", "ErrorCount", "Sum", 300, 1, 10.0, "GreaterThanThreshold", "critical"),
    ("LowThinkBlockRate", "ThinkBlockPresent", "Average", 900, 2, 0.80, "LessThanThreshold", "warning"),
    ("IdleInstance", "CPUUtilization", "Average", 3600, 20, 5.0, "LessThanThreshold", "info"),
    ("LowDiskSpace", "disk_used_percent", "Average", 300, 1, 85.0, "GreaterThanThreshold", "warning"),
]

# Duration alarms
# (alarm, signal, quantile, window s, threshold, comparison, hold s, severity).
DURATION_ALARMS = [
    ("HighInferenceLatency", "inference_seconds", 0.95, 300, 15.0, ">", 300, "warning"),
    ("CriticalLatency", "inference_seconds", 0.95, 300, 30.0, ">", 120, "critical"),
    ("LowConfidence", "confidence", 0.50, 600, 0.70, "<", 600, "warning"),
    ("HighErrorRate", "errors_per_second", None, 300, 0.1, ">", 120, "critical"),
    ("LowThinkBlockRate", "think_ratio", None, 900, 0.80, "<", 900, "warning"),
    ("ServiceDown", "up", None, 60, 0.0, "==", 60, "critical"),
    ("HighActiveRequests", "active_requests", None, 60, 10.0, ">", 120, "warning"),
]

# Upper bounds of the histogram buckets.
REQUEST_SECONDS_BOUNDS = [0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 30.0, 60.0]
INFERENCE_SECONDS_BOUNDS = [1.0, 2.0, 5.0, 10.0, 20.0, 30.0, 60.0]
CONFIDENCE_BOUNDS = [0.5, 0.6, 0.7, 0.75, 0.80, 0.85, 0.90, 0.95, 1.0]

# Channels per severity.
CHANNELS = {
    "warning": ["ops-email", "ops-slack"],
    "critical": ["ops-email", "ops-slack", "pagerduty"],
    "info": ["ops-slack"],
}
