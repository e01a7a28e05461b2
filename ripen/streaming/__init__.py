from .labels import StreamRun, bucket_counts_stream, label_stream, run_available, write_in_turn

__all__ = ["StreamRun", "bucket_counts_stream", "label_stream", "run_available", "write_in_turn"]
