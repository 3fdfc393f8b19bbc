"""Tables: storage, catalogue, snapshots, readers and sinks."""
