from rillspark.streaming.queries import Events, PushedStream, fan_out, limited, run_available, stream_of, throttle_stream, uniq_stream, windows, write_available

__all__ = ["Events", "PushedStream", "fan_out", "limited", "run_available", "stream_of", "throttle_stream", "uniq_stream", "windows", "write_available"]
