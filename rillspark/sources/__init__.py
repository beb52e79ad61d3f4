from rillspark.sources.build import END, GeneratorSource, frame_of, generated_frame, pulled, read_bytes, read_lines, records_frame, recursive_frame

__all__ = ["END", "GeneratorSource", "frame_of", "generated_frame", "pulled", "read_bytes", "read_lines", "records_frame", "recursive_frame"]
