"""Sources and sinks and the driver-table roles used by the checks."""
